import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.functions.features import GROUPS, feature_names
from framelark.operators import metrics, quality, reports, stream
from framelark.operators.windows import frames, window_features

IDS = "A B A A C B A B C A A B".split()


@pytest.fixture(scope="module")
def tiny(spark):
    """One capture of 12 messages; two of them at the same time."""
    t = [0, 10, 20, 20, 35, 50, 60, 75, 80, 95, 100, 120]
    rows = [(0, t[i] * 1000, "ABC".index(IDS[i]), 8 - i % 3, int(i == 11), i) for i in range(12)]
    return spark.createDataFrame(rows, "capture long, t_us long, can_id long, dlc long, label int, seq long")


def brute(rows, w=10):
    """The 26 features of every window, by hand."""
    rows = sorted(rows, key=lambda r: (r.t_us, r.seq))
    last, dt = {}, []
    for r in rows:
        dt.append(None if r.can_id not in last else (r.t_us - last[r.can_id]) / 1e6)
        last[r.can_id] = r.t_us
    made = []
    for s in range(len(rows) - w + 1):
        part = rows[s : s + w]
        gaps = np.diff([r.t_us for r in part]) / 1e6
        d = [x for x in dt[s : s + w] if x is not None]
        counts = [sum(r.can_id == i for r in part) for i in {r.can_id for r in part}]
        dl = [r.dlc for r in part if r.dlc >= 0]
        dur = (part[-1].t_us - part[0].t_us) / 1e6
        std = lambda x: float(np.std(x)) if len(x) > 1 else 0.0
        mean = lambda x: float(np.mean(x)) if len(x) else 0.0
        made.append({
            "msg_count": w, "window_duration": dur, "n_unique_ids_basic": len(counts), "iat_mean": gaps.mean(), "iat_std": gaps.std(), "iat_min": gaps.min(), "iat_max": gaps.max(), "iat_median": np.median(gaps),
            "iat_range": np.ptp(gaps), "iat_cv": gaps.std() / (abs(gaps.mean()) + 1e-12), "msg_rate_hz": w / (dur + 1e-12), "dt_id_mean": mean(d), "dt_id_std": std(d), "dt_id_min": min(d, default=0), "dt_id_max": max(d, default=0),
            "dt_id_cv": std(d) / (abs(mean(d)) + 1e-12), "n_unique_ids": len(counts), "id_diversity": len(counts) / w, "cmafid": max(counts), "cmifid": min(counts), "id_entropy": -sum(c / w * math.log(c / w + 1e-12) for c in counts),
            "n_repeated_ids": sum(c > 1 for c in counts), "max_id_share": max(counts) / w, "dlc_mean": mean(dl), "dlc_std": std(dl), "dlc_max": max(dl, default=0), "y": int(any(r.label for r in part)), "pos": s,
        })
    return made


@pytest.mark.parametrize("change", ["", "no_dlc", "one_id"])
def test_features_by_hand(spark, tiny, change):
    rows = tiny if not change else tiny.withColumn("dlc", F.lit(-1).cast("long")) if change == "no_dlc" else tiny.withColumn("can_id", F.lit(7).cast("long"))
    got = window_features(rows, tuple(GROUPS), slice_us=30_000).orderBy("pos").collect()
    want = brute(rows.collect())
    assert len(got) == 3
    for g, w in zip(got, want):
        for name in [*feature_names(tuple(GROUPS)), "y", "pos"]:
            assert g[name] == pytest.approx(w[name], abs=1e-9), name


def test_groups_in_order():
    assert feature_names(("dlc", "temporal")) == [*GROUPS["temporal"], *GROUPS["dlc"]]
    assert len(feature_names()) == 23
    with pytest.raises(ValueError):
        feature_names(("none",))


@pytest.mark.parametrize("slice_us", [1, 7_000, 10**9])
def test_positions_and_recurrence_dont_depend_on_slices(spark, tiny, slice_us):
    both = tiny.unionByName(tiny.withColumn("capture", F.lit(1).cast("long")))
    got = stream.positions(stream.recurrence(both, slice_us), slice_us).orderBy("capture", "pos").collect()
    assert [r.seq for r in got] == [*range(12)] * 2
    assert [r.dt_us for r in got[:5]] == [None, None, 20000, 0, None]


def test_long_capture_over_stretches(spark):
    rows = spark.range(1000).select(F.lit(0).alias("capture"), F.col("id").alias("pos"), F.col("id").alias("v"))
    got = frames(rows, ["v"], 10, stretch=64)
    assert got.count() == 991 and got.where("frame[0].v <> pos or frame[9].v <> pos + 9").count() == 0


@pytest.mark.parametrize("n", [47, 48, 200])
def test_blocks(spark, n):
    got = {r.split: (r.start, r.stop) for r in stream.blocks(spark.createDataFrame([(0, n)], "capture long, n long")).collect()}
    if n < 48:
        return
    u = n - 18
    tr, va = int(u * 0.6), int(u * 0.2)
    assert got == {"train": (0, tr), "val": (tr + 9, tr + 9 + va), "test": (tr + va + 18, n)}
    with pytest.raises(ValueError):
        stream.blocks(spark.createDataFrame([(0, n)], "capture long, n long"), train=0.9)


def test_short_captures_are_left_out(spark):
    assert stream.blocks(spark.createDataFrame([(0, 47)], "capture long, n long")).count() == 0


@pytest.mark.parametrize("n,m", [(100, 7), (10, 10), (5, 9), (1000, 1), (37, 36), (999, 2)])
def test_even_starts(spark, n, m):
    spans = spark.createDataFrame([(0, "train", 0, n + 9)], "capture long, split string, start long, stop long")
    got = sorted(r.pos for r in stream.starts(spans, 10, 1, F.lit(m)).collect())
    want = list(range(n)) if n <= m else sorted({int(x) for x in np.linspace(0, n - 1, m)})
    assert got == want


def test_folds_are_apart(spark):
    rows = stream.folds(spark.range(103).withColumnRenamed("id", "k"), ["k"], 4, 9).collect()
    for f in range(4):
        test = {r.row for r in rows if r.fold == f and r.role == "test"}
        train = {r.row for r in rows if r.fold == f and r.role == "train"}
        assert test and not test & train and min(abs(a - b) for a in test for b in train) >= 9
    assert sorted(r.row for r in rows if r.role == "test") == list(range(103))


def test_cap(spark):
    rows = spark.range(100).select((F.col("id") % 4 > 0).cast("long").alias("capture"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("t_us"))
    got = stream.cap(stream.positions(rows), 20).groupBy("capture").agg(F.count("*").alias("n"), F.min("pos").alias("low")).orderBy("capture").collect()
    assert [(r.n, r.low) for r in got] == [(5, 0), (15, 0)]
    assert stream.cap(stream.positions(rows), 1000).count() == 100


def test_clean(spark):
    raw = spark.createDataFrame([("1.5", "3", "x", "1", None, 0), ("bad", "3", "1", "1", "2", 1), ("2", "-1", "1", "0", "2", 2), ("3", "4", "5", None, "2", 3)], "timestamp string, can_id string, dlc string, label string, capture string, seq long")
    assert [tuple(r) for r in stream.clean(raw).collect()] == [(1.5, 3, -1, 1, 0, 0)]


def test_scaler_and_alignment(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    scaler = quality.fit_scaler(rows, ["a", "b"])
    s = scaler.first()
    assert s.a_scale == pytest.approx(np.std([1, 2, 4])) and s.b_scale == 1
    assert {round(r.b, 9) for r in quality.scale(rows, scaler, ["a", "b"]).collect()} == {0.0}
    assert quality.align(rows.drop("b"), ["a", "b"]).first().b == 0.0


def test_single_class_metrics(spark):
    rows = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "y int, predicted int, score double").withColumn("k", F.lit(1))
    r = metrics.classification(rows, ["k"]).first()
    assert r.mcc is None and r.recall == 0 and r.balanced_accuracy == 0.5 and r.false_positive_rate == 0.5
    assert metrics.roc_auc(rows, ["k"]).first().roc_auc is None


def test_identical_ranks_agree(spark):
    long = spark.createDataFrame([(f, k, float(k % 3)) for f in range(3) for k in range(6)], "fold int, feature int, value double")
    pairs = metrics.fold_pairs(metrics.ranked(long))
    assert metrics.consistency(metrics.spearman(pairs)).first().score == pytest.approx(1)
    assert {round(r.tau, 9) for r in metrics.kendall(pairs).collect()} == {1.0}
    assert {r.jaccard for r in metrics.jaccard_topk(metrics.ranked(long), 2).collect()} == {1.0}
    assert metrics.consistency(metrics.spearman(pairs.where("false"))).first().score == 0.5


def test_plus_minus(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (1.0, None), (None, None)], "m double, s double")
    assert [r[0] for r in rows.select(reports.plus_minus(F.col("m"), F.col("s"))).collect()] == ["1.0000 ± 0.5000", "1.0000", ""]


def test_leakage_of_overlapping_spans(spark):
    starts = spark.createDataFrame([(0, "train", 0), (0, "val", 5)], "capture long, split string, pos long")
    assert [tuple(r) for r in quality.span_overlaps(starts, 10).collect()] == [("train", "val", 5)]


def test_whole_queries_take_every_window():
    from framelark.plans import catalog

    assert catalog.WHOLE_BUDGET == {"train": 40_000, "val": 12_000, "test": 12_000}
    for name in ("split_window_starts_whole", "split_summary_whole", "blocked_kfold_whole"):
        assert "THEN 40000 ELSE 12000 END" in catalog.SQL[name] and "400 ELSE 120 " not in catalog.SQL[name]
    for name in ("leakage_span_disjoint_whole", "scaler_train_whole"):
        assert "windows AS m" in catalog.SQL[name] and "ELSE 120" not in catalog.SQL[name]


def test_spans_of_any_starts(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), str(s), int(p)) for c, s, p in zip(rng.integers(0, 2, 60), rng.choice(["test", "train", "val"], 60), rng.integers(0, 1500, 60))]
    for window in (1, 10, 64, 150):
        held = {s: {(c, p + k) for c, t, p in rows if t == s for k in range(window)} for s in ("test", "train", "val")}
        want = {(a, b): n for a, b in (("test", "train"), ("test", "val"), ("train", "val")) if (n := len(held[a] & held[b]))}
        got = quality.span_overlaps(spark.createDataFrame(rows + rows[:5], "capture long, split string, pos long"), window)
        assert {(r.a, r.b): r.shared for r in got.collect()} == want


def test_starts_of_a_block_are_spread(spark):
    spans = spark.createDataFrame([(0, "train", 0, 200_009)], "capture long, split string, start long, stop long")
    made = stream.starts(spans)
    held = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("pos").alias("told")).collect()
    assert len(held) > 1 and sum(r.n for r in held) == sum(r.told for r in held) == 200_000 and (min(r.low for r in held), max(r.high for r in held)) == (0, 199_999)
    assert "HashAggregate(keys=[capture" not in made._jdf.queryExecution().simpleString().split("Generate explode(sequence(first")[0]  # no task holds all starts
    wide = spark.createDataFrame([(0, "train", 0), (0, "val", 10**7 - 5)], "capture long, split string, pos long")
    assert quality.span_overlaps(wide, 10**7).first().shared == 5


def test_streamed_windows_over_batches(spark, tmp_path):
    from framelark.streaming.count_windows import RESULT, drain

    rng = np.random.default_rng(2)
    n = 300
    rows = [(int(c), int(t), int(i), int(l), k) for k, (c, t, i, l) in enumerate(zip(rng.integers(0, 2, n), np.sort(rng.integers(0, 10**6, n)) * 100, rng.integers(0, 5, n), rng.random(n) < 0.05))]
    rows += [(9, 5, 1, 0, n), (9, 6, 2, 0, n + 200)]  # a capture of two messages in batches apart
    schema = "capture long, t_us long, can_id long, label int, seq long"
    for k, part in enumerate((rows[:7], rows[7:10], rows[10:150], rows[150:])):  # the first batches hold less than a window
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for window in (1, 4, 10):
        stream_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = drain(stream_, window, 10**6)
        assert [t for _, t in got.dtypes] == [c.strip().split(" ")[1].replace("long", "bigint") for c in RESULT.split(",")]
        made = {(r.capture, r.pos): r for r in got.collect()}
        assert got.count() == len(made)
        for c in (0, 1, 9):
            own = [r for r in rows if r[0] == c]
            assert {p for k, p in made if k == c} == set(range(len(own) - window + 1))
            for p in range(len(own) - window + 1):
                part, r = own[p : p + window], made[c, p]
                gaps = np.diff([m[1] for m in part]) / 1e6
                assert (r.n_unique_ids, r.y) == (len({m[2] for m in part}), max(m[3] for m in part)) and r.window_duration == pytest.approx((part[-1][1] - part[0][1]) / 1e6)
                if window > 1:
                    assert (r.iat_mean, r.iat_min, r.iat_max) == pytest.approx((gaps.mean(), gaps.min(), gaps.max()))


def test_streamed_windows_run_no_python(spark):
    from framelark.streaming.count_windows import STATE, count_windows, last_messages

    batch = spark.createDataFrame([(0, k, k % 3, 0, k) for k in range(30)], "capture long, t_us long, can_id long, label int, seq long")
    held = spark.createDataFrame([], STATE)
    for made in (count_windows(batch, held), last_messages(batch, held)):
        assert "Pandas" not in made._jdf.queryExecution().toString() and "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in last_messages(batch, held).collect()) == list(range(21, 30)) and count_windows(batch, held).count() == 21


def test_only_messages_of_chosen_windows_are_framed(spark, monkeypatch):
    from framelark.operators import windows

    rows = spark.range(3000).select((F.col("id") % 2).alias("capture"), (F.col("id") * 1000 + F.col("id") % 7).alias("t_us"), (F.col("id") * 7 % 5).alias("can_id"), (F.col("id") % 9).alias("dlc"), (F.col("id") % 50 == 0).cast("int").alias("label"), F.col("id").alias("seq"))
    starts = spark.createDataFrame([(c, "x", p) for c in (0, 1) for p in (0, 5, 6, 40, 700, 701, 1490)], "capture long, split string, pos long")
    framed, real = [], windows.frames
    monkeypatch.setattr(windows, "frames", lambda placed, *a: framed.append(placed.count()) or real(placed, *a))
    want = window_features(rows, tuple(GROUPS), slice_us=10**6, starts=starts).orderBy("capture", "pos").collect()
    for limit in (windows.BROADCAST, 0):
        monkeypatch.setattr(windows, "BROADCAST", limit)
        assert window_features(rows, tuple(GROUPS), slice_us=10**6, starts=starts, most=14).orderBy("capture", "pos").collect() == want
    assert len(want) == 14 and framed == [3000, 2 * (16 + 10 + 11 + 10)] + [2 * (16 + 10 + 11 + 10)]


def test_importances_read_the_stream_twice(spark, tmp_path, monkeypatch):
    from framelark.operators import windows
    from framelark.plans import search_queries as q
    from framelark.search import arms

    rows = spark.range(3000).select((F.col("id") % 2).alias("capture"), (F.col("id") * 1000).alias("t_us"), (F.col("id") * 7 % 5).alias("can_id"), (F.col("id") % 9).alias("dlc"), (F.col("id") % 50 == 0).cast("int").alias("label"), F.col("id").alias("seq"))
    odd = spark.createDataFrame([(None, 5, 1, 0, 0, 9001), (0, None, 1, 0, 0, 9002), (1, None, 2, 0, 1, 9003)], "capture long, t_us long, can_id long, dlc long, label int, seq long")  # without a place
    rows.union(odd).coalesce(1).write.parquet(str(tmp_path / "rows"))
    read = spark.sparkContext.accumulator(0)
    settings = q.small()
    settings.slice_us, settings.budget = 300_000, {"train": 60, "val": 20, "test": 20}

    def counted(parts):
        for part in parts:
            read.add(len(part))
            yield part

    stored = spark.read.parquet(str(tmp_path / "rows"))
    seen = stored.mapInPandas(counted, stored.schema)
    got = arms.prepare(seen, settings)
    assert 2 * 3003 <= read.value <= 3 * 3003  # slices, messages and the first with a dlc
    known = stream.slices(stored, settings.slice_us)
    assert sorted(map(tuple, arms._lengths(known).collect())) == [(0, 1500), (1, 1500)]
    for counts in (None, known):  # a message without a time moves none
        assert stream.positions(stored, settings.slice_us, known=counts).agg(F.min("pos"), F.max("pos"), F.count("*")).first() == (0, 1499, 3000)
    plain = windows.window_features(stored, slice_us=settings.slice_us).orderBy("capture", "pos").collect()
    assert windows.window_features(stored, slice_us=settings.slice_us, known=known).orderBy("capture", "pos").collect() == plain and len(plain) == 2 * 1491
    assert {s: len(y) for s, (_, y) in got.parts.items()} == {"train": 60, "val": 20, "test": 20}
