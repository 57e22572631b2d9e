"""Queries by name: ``QUERIES`` (spark, sf_dir) -> DataFrame, and ``SQL``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.features import GROUPS, feature_names
from ..operators import metrics, quality, reports, stream, tables
from ..operators.windows import window_features
from .inputs import DAY_US, MESSAGES_SQL, RANKS_SQL, RUNS_SQL, SCORES_SQL, importances, messages, runs, scores, table

ALL = tuple(GROUPS)
BUDGET = {"train": 400, "val": 120, "test": 120}
WHOLE_BUDGET = {"train": 40_000, "val": 12_000, "test": 12_000}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.positions(messages(spark, sf_dir), DAY_US)


# ------------------------------------------------------------------ stream
@query(f"WITH {MESSAGES_SQL} SELECT capture, pos, t_us, can_id, CAST(dlc AS INTEGER) AS dlc, label FROM placed")
def stream_ordered(spark, sf_dir):
    return _placed(spark, sf_dir).select("capture", "pos", "t_us", "can_id", "dlc", "label")


@query(f"WITH {MESSAGES_SQL} SELECT capture, seq, can_id, dt_us / 1e6 AS dt_s FROM placed")
def dt_id_recurrence(spark, sf_dir):
    return stream.recurrence(messages(spark, sf_dir), DAY_US).select("capture", "seq", "can_id", (F.col("dt_us") / 1e6).alias("dt_s"))


FEATURES_SQL = f"""WITH {MESSAGES_SQL},
w AS (
  SELECT s.capture AS capture, s.pos AS pos, m.pos - s.pos AS k, m.t_us AS t_us, m.can_id AS can_id, m.dlc AS dlc, m.label AS label, m.dt_us / 1e6 AS dt, CASE WHEN m.pos > s.pos THEN m.gap END AS gap
  FROM placed s JOIN placed m ON m.capture = s.capture AND m.pos BETWEEN s.pos AND s.pos + 9),
ids AS (SELECT capture, pos, can_id, count(*) AS c FROM w GROUP BY ALL),
freq AS (
  SELECT capture, pos, CAST(count(*) AS DOUBLE) AS u, CAST(max(c) AS DOUBLE) AS most, CAST(min(c) AS DOUBLE) AS least, -sum(c / 10.0 * ln(c / 10.0 + 1e-12)) AS entropy,
         CAST(count(*) FILTER (WHERE c > 1) AS DOUBLE) AS repeated FROM ids GROUP BY ALL),
base AS (
  SELECT capture, pos, count(*) AS size, (max(t_us) - min(t_us)) / 1e6 AS duration, avg(gap) AS g_mean, stddev_pop(gap) AS g_std, min(gap) AS g_min, max(gap) AS g_max, median(gap) AS g_med,
         coalesce(avg(dt), 0) AS d_mean, CASE WHEN count(dt) > 1 THEN stddev_pop(dt) ELSE 0 END AS d_std, coalesce(min(dt), 0) AS d_min, coalesce(max(dt), 0) AS d_max,
         coalesce(avg(dlc) FILTER (WHERE dlc >= 0), 0) AS l_mean, CASE WHEN count(*) FILTER (WHERE dlc >= 0) > 1 THEN stddev_pop(dlc) FILTER (WHERE dlc >= 0) ELSE 0 END AS l_std,
         CAST(coalesce(max(dlc) FILTER (WHERE dlc >= 0), 0) AS DOUBLE) AS l_max, CAST(max(label) > 0 AS INTEGER) AS y
  FROM w GROUP BY capture, pos),
told AS (
  SELECT capture, pos, y, 10.0::DOUBLE AS msg_count, duration AS window_duration, u AS n_unique_ids_basic, g_mean AS iat_mean, g_std AS iat_std, g_min AS iat_min, g_max AS iat_max, g_med AS iat_median,
         g_max - g_min AS iat_range, g_std / (abs(g_mean) + 1e-12) AS iat_cv, 10 / (duration + 1e-12) AS msg_rate_hz, d_mean AS dt_id_mean, d_std AS dt_id_std, d_min AS dt_id_min, d_max AS dt_id_max,
         d_std / (abs(d_mean) + 1e-12) AS dt_id_cv, u AS n_unique_ids, u / 10 AS id_diversity, most AS cmafid, least AS cmifid, entropy AS id_entropy, repeated AS n_repeated_ids, most / 10 AS max_id_share,
         l_mean AS dlc_mean, l_std AS dlc_std, l_max AS dlc_max
  FROM base JOIN freq USING (capture, pos) WHERE size = 10)
"""


def _features(spark, sf_dir, groups=ALL):
    return _rounded(window_features(messages(spark, sf_dir), groups, slice_us=DAY_US))


for _name, _groups in {"window_features_basic": ("basic", "temporal"), "window_features_temporal": ("temporal",), "window_features_temporal_id": ("temporal_id",), "window_features_frequency": ("frequency",), "window_features_dlc": ("dlc",), "window_features_all": ALL}.items():
    QUERIES[_name] = partial(_features, groups=_groups)
    SQL[_name] = FEATURES_SQL + "SELECT capture, pos, y, " + ", ".join(f"round({n}, 6) AS {n}" for n in feature_names(_groups)) + " FROM told"


@query(f"""WITH {MESSAGES_SQL},
gaps AS (SELECT capture, t_us, label, dlc, can_id, gap FROM placed),
each AS (SELECT capture, count(*) AS n, max(t_us) - min(t_us) AS duration, median(CAST(round(gap * 1e6) AS BIGINT)) AS gap, sum(label) AS attacks FROM gaps GROUP BY capture)
SELECT CAST(sum(n) AS BIGINT) AS n_messages, count(*) AS n_captures, round(sum(attacks) / sum(n), 6) AS attack_rate, round(sum(duration) / 1e6, 6) AS duration_s, round(median(gap) / 1e6, 6) AS median_gap_s,
       round(sum(n) / (sum(duration) / 1e6), 6) AS rate_hz, (SELECT max(dlc) >= 0 FROM messages) AS has_dlc, (SELECT count(DISTINCT can_id) FROM messages) AS n_ids FROM each""")
def stream_statistics(spark, sf_dir):
    return _rounded(reports.stream_statistics(messages(spark, sf_dir)))


@query(f"""WITH {MESSAGES_SQL},
sizes AS (SELECT capture, count(*) AS n, sum(count(*)) OVER () AS total FROM placed GROUP BY capture),
share AS (SELECT *, CASE WHEN total > 500 THEN least(n, greatest(1, CAST(round_even(500.0 * n / total, 0) AS BIGINT))) ELSE n END AS quota FROM sizes),
spans AS (SELECT *, (n - quota) // 2 AS start FROM share)
SELECT capture, seq, CAST(pos - start AS BIGINT) AS pos FROM placed JOIN spans USING (capture) WHERE pos >= start AND pos < start + quota""")
def cap_per_capture(spark, sf_dir):
    return stream.cap(_placed(spark, sf_dir), 500).select("capture", "seq", F.col("pos").cast("long").alias("pos"))


BLOCKS_SQL = f"""WITH {MESSAGES_SQL},
sizes AS (SELECT capture, count(*) AS n, count(*) - 18 AS usable FROM placed GROUP BY capture),
cuts AS (SELECT *, CAST(trunc(usable * 0.6::DOUBLE) AS BIGINT) AS tr, CAST(trunc(usable * 0.2::DOUBLE) AS BIGINT) AS va FROM sizes WHERE usable >= 30),
blocks AS (
  SELECT capture, 'train' AS split, CAST(0 AS BIGINT) AS start, tr AS stop FROM cuts
  UNION ALL SELECT capture, 'val', tr + 9, tr + 9 + va FROM cuts
  UNION ALL SELECT capture, 'test', tr + 18 + va, n FROM cuts),
counted AS (SELECT *, stop - start - 9 AS windows, count(*) OVER (PARTITION BY split) AS nb FROM blocks),
limited AS (SELECT *, least(windows, greatest(1, CASE split WHEN 'train' THEN 400 ELSE 120 END // nb)) AS m FROM counted),
even AS (
  SELECT DISTINCT capture, split, start + CASE WHEN m >= windows THEN j WHEN j = m - 1 THEN CASE WHEN m = 1 THEN 0 ELSE windows - 1 END
         ELSE CAST(floor(j * (CAST(windows - 1 AS DOUBLE) / (m - 1))) AS BIGINT) END AS pos
  FROM (SELECT *, unnest(range(m)) AS j FROM limited WHERE windows > 0))
"""


def _blocks(spark, sf_dir):
    return stream.blocks(stream.sizes(_placed(spark, sf_dir)))


@query(BLOCKS_SQL + "SELECT capture, split, start, stop FROM blocks")
def chronological_split(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(BLOCKS_SQL + "SELECT capture, split, pos FROM even")
def split_window_starts_even(spark, sf_dir):
    return stream.split_starts(_blocks(spark, sf_dir), BUDGET)


@query(BLOCKS_SQL + ", labelled AS (SELECT e.split, e.capture, e.pos, CAST(max(m.label) > 0 AS INTEGER) AS y FROM even e JOIN placed m ON m.capture = e.capture AND m.pos BETWEEN e.pos AND e.pos + 9 GROUP BY ALL) SELECT split, count(*) AS n_windows, round(avg(y), 6) AS attack_rate FROM labelled GROUP BY split")
def split_summary(spark, sf_dir):
    return _summary(spark, sf_dir, stream.split_starts(_blocks(spark, sf_dir), BUDGET))


def _summary(spark, sf_dir, starts):
    rows = window_features(messages(spark, sf_dir), ("basic",), slice_us=DAY_US, starts=starts)
    return _rounded(rows.groupBy("split").agg(F.count("*").alias("n_windows"), F.avg("y").alias("attack_rate")))


@query(BLOCKS_SQL + """, numbered AS (SELECT capture, pos, row_number() OVER (ORDER BY capture, pos) - 1 AS r, count(*) OVER () AS n FROM even WHERE split = 'train'),
bounds AS (SELECT k AS fold, CAST(floor(k * (n / 4.0)) AS BIGINT) AS low, CASE WHEN k = 3 THEN n ELSE CAST(floor((k + 1) * (n / 4.0)) AS BIGINT) END AS high FROM (SELECT unnest(range(4)) AS k), (SELECT max(n) AS n FROM numbered)),
roles AS (SELECT fold, capture, pos, CASE WHEN r >= low AND r < high THEN 'test' WHEN r < low - 9 OR r >= high + 9 THEN 'train' END AS role FROM numbered, bounds WHERE high > low)
SELECT CAST(fold AS INTEGER) AS fold, capture, pos, role FROM roles WHERE role IS NOT NULL""")
def blocked_kfold(spark, sf_dir):
    return _folds(stream.split_starts(_blocks(spark, sf_dir), BUDGET))


def _folds(starts):
    return stream.folds(starts.where("split = 'train'"), ["capture", "pos"], 4, stream.WINDOW - 1).select("fold", "capture", "pos", "role")


# ------------------------------------------------------------------ leakage
@query(BLOCKS_SQL + ", gaps AS (SELECT capture, split, lead(start) OVER (PARTITION BY capture ORDER BY start) - stop AS gap FROM blocks) SELECT capture, split, gap, gap >= 9 AS passed FROM gaps WHERE gap IS NOT NULL")
def leakage_gap_check(spark, sf_dir):
    return quality.gap_check(_blocks(spark, sf_dir), stream.WINDOW)


@query(BLOCKS_SQL + """, spans AS (SELECT DISTINCT split, capture, unnest(range(pos, pos + 10)) AS at FROM even),
splits AS (SELECT * FROM (VALUES ('test', 'train'), ('test', 'val'), ('train', 'val')) AS v(a, b))
SELECT a, b, (SELECT count(*) FROM spans x JOIN spans z ON x.capture = z.capture AND x.at = z.at WHERE x.split = a AND z.split = b) AS shared FROM splits""")
def leakage_span_disjoint(spark, sf_dir):
    return _overlaps(spark, stream.split_starts(_blocks(spark, sf_dir), BUDGET))


def _overlaps(spark, starts):
    found = quality.span_overlaps(starts, stream.WINDOW)
    splits = spark.createDataFrame([("test", "train"), ("test", "val"), ("train", "val")], "a string, b string")
    return splits.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))


SCALED = ("iat_mean", "iat_max", "id_entropy")


@query(FEATURES_SQL.rstrip() + "," + BLOCKS_SQL.split(MESSAGES_SQL + ",")[1] + ", train AS (SELECT told.* FROM told JOIN even USING (capture, pos) WHERE split = 'train') SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS {c}_scale" for c in SCALED) + " FROM train")
def scaler_train_only(spark, sf_dir):
    return _scaler(spark, sf_dir, stream.split_starts(_blocks(spark, sf_dir), BUDGET))


def _scaler(spark, sf_dir, starts):
    rows = window_features(messages(spark, sf_dir), ("temporal", "frequency"), slice_us=DAY_US, starts=starts.where("split = 'train'"))
    return _rounded(quality.fit_scaler(rows, list(SCALED)))


# ------------------------------------------------------------------ the same with the study's budget, or every window
WHOLE_SQL = BLOCKS_SQL.replace("THEN 400 ELSE 120 END", "THEN 40000 ELSE 12000 END")
EVERY_SQL = BLOCKS_SQL.replace("least(windows, greatest(1, CASE split WHEN 'train' THEN 400 ELSE 120 END // nb)) AS m", "windows AS m")


def _whole_starts(spark, sf_dir):
    return stream.split_starts(_blocks(spark, sf_dir), WHOLE_BUDGET)


@query(SQL["split_window_starts_even"].replace(BLOCKS_SQL, WHOLE_SQL))
def split_window_starts_whole(spark, sf_dir):
    return _whole_starts(spark, sf_dir)


@query(SQL["split_summary"].replace(BLOCKS_SQL, WHOLE_SQL))
def split_summary_whole(spark, sf_dir):
    return _summary(spark, sf_dir, _whole_starts(spark, sf_dir))


@query(SQL["blocked_kfold"].replace(BLOCKS_SQL, WHOLE_SQL))
def blocked_kfold_whole(spark, sf_dir):
    return _folds(_whole_starts(spark, sf_dir))


@query(SQL["leakage_span_disjoint"].replace(BLOCKS_SQL, EVERY_SQL))
def leakage_span_disjoint_whole(spark, sf_dir):
    return _overlaps(spark, stream.starts(_blocks(spark, sf_dir)))


@query(SQL["scaler_train_only"].replace(BLOCKS_SQL.split(MESSAGES_SQL + ",")[1], EVERY_SQL.split(MESSAGES_SQL + ",")[1]))
def scaler_train_whole(spark, sf_dir):
    return _scaler(spark, sf_dir, stream.starts(_blocks(spark, sf_dir)))


def _split_features(spark, sf_dir, split):
    starts = stream.starts(_blocks(spark, sf_dir)).where(F.col("split") == split)
    return window_features(messages(spark, sf_dir), ("temporal", "frequency"), slice_us=DAY_US, starts=starts)


_MEAN_GAP_SQL = "greatest(" + ", ".join(f"abs(avg({c}) FILTER (WHERE split = '{{0}}') - avg({c}) FILTER (WHERE split = 'train')) / CASE WHEN stddev_pop({c}) FILTER (WHERE split = 'train') > 0 THEN stddev_pop({c}) FILTER (WHERE split = 'train') ELSE 1 END" for c in SCALED) + ")"


@query(FEATURES_SQL.rstrip() + "," + EVERY_SQL.split(MESSAGES_SQL + ",")[1] + ", split_rows AS (SELECT told.*, split FROM told JOIN even USING (capture, pos)), gaps AS (SELECT " + _MEAN_GAP_SQL.format("train") + " AS t, " + _MEAN_GAP_SQL.format("val")
       + " AS v FROM split_rows) SELECT 'train_mean' AS \"check\", t < 0.05 AS passed, round(t, 6) AS value FROM gaps UNION ALL SELECT 'val_mean', v > 1e-6, round(v, 6) FROM gaps")
def leakage_scaler_means(spark, sf_dir):
    train, names = _split_features(spark, sf_dir, "train"), list(SCALED)
    scaler = quality.fit_scaler(train, names)
    scaled = [quality.scale(rows, scaler, names) for rows in (train, _split_features(spark, sf_dir, "val"))]
    return _rounded(quality.scaler_check(*scaled, names))


@query(FEATURES_SQL + f"SELECT 'scaler_unchanged' AS \"check\", true AS passed, 0.0::DOUBLE AS value UNION ALL SELECT 'column_order', true, {len(SCALED)}::DOUBLE UNION ALL SELECT 'target_non_empty', count(*) > 0, count(*)::DOUBLE FROM told WHERE capture >= 2")
def leakage_target_checks(spark, sf_dir):
    """Captures 0 and 1 are the source, 2 and 3 the target that its scaler standardises."""
    names = list(SCALED)
    source, target = (window_features(messages(spark, sf_dir).where(f"capture {side} 2"), ("temporal", "frequency"), slice_us=DAY_US) for side in ("<", ">="))
    scaler = quality.fit_scaler(source, names)
    scaled = quality.scale(quality.align(target, names), scaler, names)
    return quality.target_checks(scaler, quality.fit_scaler(source, names), names, scaled)


# ------------------------------------------------------------------ ingest
@query("""WITH raw AS (SELECT l_orderkey, l_linenumber, CASE l_quantity::INT % 8 WHEN 0 THEN 'T' WHEN 1 THEN ' R ' WHEN 2 THEN 'Attack Free' WHEN 3 THEN 'attack_free' WHEN 4 THEN 'DoS_attack' WHEN 5 THEN 'weird' WHEN 6 THEN NULL ELSE 'Normal' END AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN flag IN ('T', 'Attack Free', 'DoS_attack') THEN 1 ELSE 0 END AS TINYINT) AS label FROM raw""")
def label_normalise(spark, sf_dir):
    flags = F.array(*[F.lit(x) for x in ("T", " R ", "Attack Free", "attack_free", "DoS_attack", "weird", None, "Normal")])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(flags, F.col("l_quantity").cast("int") % 8 + 1).alias("flag"))
    return rows.select("l_orderkey", "l_linenumber", parsing.label(F.col("flag")).alias("label"))


@query("""WITH raw AS (SELECT o_orderkey, o_custkey % 5 AS capture, CASE WHEN o_custkey % 5 < 2 THEN printf('%04x', o_orderkey % 2048) WHEN o_custkey % 5 = 2 THEN 'zz' ELSE CAST(o_orderkey % 2048 AS VARCHAR) END AS id FROM orders),
hexed AS (SELECT *, max(CAST(regexp_matches(id, '[a-f]') AS INT)) OVER (PARTITION BY capture) AS hex FROM raw)
SELECT o_orderkey, capture, CASE WHEN capture = 2 THEN -1 WHEN hex = 1 THEN CAST('0x' || id AS BIGINT) ELSE CAST(id AS BIGINT) END AS can_id FROM hexed""")
def can_id_parse_hex(spark, sf_dir):
    key, capture = F.col("o_orderkey"), F.col("o_custkey") % 5
    text = F.when(capture < 2, F.lower(F.lpad(F.hex(key % 2048), 4, "0"))).when(capture == 2, F.lit("zz")).otherwise((key % 2048).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", capture.alias("capture"), text.alias("id"))
    based = rows.groupBy("capture").agg(F.max(parsing.looks_hex(F.col("id"))).alias("hexadecimal"))
    return rows.join(based, "capture").select("o_orderkey", "capture", parsing.can_id(F.col("id"), F.col("hexadecimal")).alias("can_id"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS ts, CAST(l_quantity::INT % 9 AS BIGINT) AS dlc, CASE WHEN l_suppkey % 2 = 0 THEN 'T' ELSE 'R' END AS flag FROM lineitem""")
def ragged_last_field(spark, sf_dir):
    n = F.col("l_quantity").cast("int") % 9
    line = F.concat_ws(",", F.col("l_extendedprice").cast("string"), F.lit("04f0"), n.cast("string"), F.array_repeat(F.lit("ff"), n), F.when(F.col("l_suppkey") % 2 == 0, "T").otherwise("R"), F.lit(" "))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.split(line, ",").alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.col("f")[0].try_cast("double").alias("ts"), F.col("f")[2].try_cast("long").alias("dlc"), parsing.last_field(F.col("f")).alias("flag"))


@query("""SELECT event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS timestamp, user_id % 2048 AS can_id, CAST(user_id % 9 AS INTEGER) AS dlc FROM events WHERE event_id % 10 <> 3""")
def otids_regex_parse(spark, sf_dir):
    t = F.floor(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")) / 1e6)
    line = F.format_string("Timestamp: %d.000000        ID: %04x    000    DLC: %d    00 ff", t, F.col("user_id") % 2048, F.col("user_id") % 9)
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, "comment").otherwise(line).alias("line"))
    p = parsing.LOG_LINE
    return rows.where(F.col("line").rlike(p["dlc"])).select(
        "event_id", parsing.found(F.col("line"), p["timestamp"]).cast("double").alias("timestamp"), F.conv(parsing.found(F.col("line"), p["can_id"]), 16, 10).cast("long").alias("can_id"), parsing.found(F.col("line"), p["dlc"]).cast("int").alias("dlc"))


def candump_lines(rows: DataFrame) -> DataFrame:
    """``line`` -> timestamp, id, dlc of the lines that are frames, other columns kept."""
    line = F.col("line")
    told = rows.where(line.rlike(parsing.CANDUMP_LINE)).select(
        *[c for c in rows.columns if c != "line"], F.regexp_extract(line, parsing.CANDUMP_LINE, 1).try_cast("double").alias("timestamp"),
        F.upper(F.regexp_extract(line, parsing.CANDUMP_LINE, 2)).alias("id"), F.regexp_extract(line, parsing.CANDUMP_LINE, 3).alias("payload"))
    return told.where((F.length("payload") % 2 == 0) & F.col("timestamp").isNotNull()).withColumn("dlc", F.floor(F.length("payload") / 2).cast("long")).drop("payload")


@query("""SELECT event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS timestamp, upper(printf('%03x', user_id % 2048)) AS id, user_id % 9 AS dlc FROM events WHERE event_id % 11 NOT IN (4, 5)""")
def candump_parse(spark, sf_dir):
    t = F.floor(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")) / 1e6)
    payload = F.repeat(F.lit("a0"), (F.col("user_id") % 9).cast("int"))
    line = F.concat(F.format_string("(%d.000000) can0 %03x#", t, F.col("user_id") % 2048), payload)
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 4, "# note").when(F.col("event_id") % 11 == 5, F.concat(line, F.lit("a"))).otherwise(line).alias("line"))
    return candump_lines(rows)


@query(f"""WITH {MESSAGES_SQL},
firsts AS (SELECT capture, arg_min(t_us, seq) AS first FROM messages GROUP BY capture),
intervals AS (SELECT * FROM (VALUES (0, 100000.0, 900000.0), (1, 0.0, 50000.0), (3, 500000.0, 2000000.0)) AS v(capture, start, stop))
SELECT m.capture, m.seq, CAST((m.t_us - first) / 1e6 BETWEEN start AND stop AS TINYINT) AS label FROM messages m JOIN firsts USING (capture) JOIN intervals USING (capture)""")
def interval_label_join(spark, sf_dir):
    rows = messages(spark, sf_dir)
    firsts = rows.groupBy("capture").agg(F.min_by("t_us", "seq").alias("first"))
    intervals = spark.createDataFrame([(0, 100000.0, 900000.0), (1, 0.0, 50000.0), (3, 500000.0, 2000000.0)], "capture long, start double, stop double")
    known = firsts.join(intervals, "capture")
    return rows.join(known, "capture").select("capture", "seq", parsing.between((F.col("t_us") - F.col("first")) / 1e6, F.col("start"), F.col("stop")).alias("label"))


@query("SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS timestamp_us, user_id AS can_id FROM events")
def column_alias_map(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumnsRenamed({"ts": "Arrival Time", "user_id": "Arbitration-ID"})
    time, ident = parsing.resolve(raw.columns, parsing.TIMESTAMP_NAMES), parsing.resolve(raw.columns, parsing.CAN_ID_NAMES)
    t_us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(f"`{time}`").cast("timestamp_ntz"))
    return raw.select("event_id", t_us.alias("timestamp_us"), F.col(f"`{ident}`").alias("can_id"))


@query(f"WITH {RUNS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS n FROM runs) SELECT l_orderkey AS run_id, l_linenumber, arm, round(l_extendedprice, 2) AS price FROM numbered WHERE n = 1")
def run_log_dedupe_last(spark, sf_dir):
    kept = reports.last_of(runs(spark, sf_dir), "l_orderkey", ["l_linenumber", "l_extendedprice", "l_quantity"])
    return kept.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "arm", F.round("l_extendedprice", 2).alias("price"))


# ------------------------------------------------------------------ metrics
CLASS_SQL = f"""WITH {SCORES_SQL},
cm AS (SELECT grp, count(*) FILTER (WHERE y=0 AND predicted=0) AS tn, count(*) FILTER (WHERE y=0 AND predicted=1) AS fp, count(*) FILTER (WHERE y=1 AND predicted=0) AS fn, count(*) FILTER (WHERE y=1 AND predicted=1) AS tp FROM scores GROUP BY grp)
"""


@query(CLASS_SQL + """SELECT grp, tn, fp, fn, tp, round((tp+tn)/(tn+fp+fn+tp), 6) AS accuracy, round(coalesce(tp/nullif(tp+fp,0),0), 6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0), 6) AS recall,
round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0), 6) AS f1, round((coalesce(tp/nullif(tp+fn,0),0) + coalesce(tn/nullif(tn+fp,0),0)) / (CAST(tp+fn>0 AS INT) + CAST(tn+fp>0 AS INT)), 6) AS balanced_accuracy, round(coalesce(fp/nullif(tn+fp,0),0), 6) AS false_positive_rate FROM cm""")
def classification_metrics(spark, sf_dir):
    return _rounded(metrics.classification(scores(spark, sf_dir), ["grp"]).drop("mcc"))


@query(CLASS_SQL + "SELECT grp, round(CASE WHEN tp+fn>0 AND tn+fp>0 THEN coalesce((CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn)/nullif(sqrt(CAST(tp+fp AS DOUBLE)*(tp+fn)*(tn+fp)*(tn+fn)),0),0) END, 6) AS mcc FROM cm")
def mcc_by_group(spark, sf_dir):
    return _rounded(metrics.classification(scores(spark, sf_dir), ["grp"]).select("grp", "mcc"))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS rk FROM scores)
SELECT grp, round((sum(rk) FILTER (WHERE y=1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc, CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) - sum(y) AS BIGINT) AS negatives FROM r GROUP BY grp""")
def roc_auc_exact(spark, sf_dir):
    return _rounded(metrics.roc_auc(scores(spark, sf_dir), ["grp"]))


@query(f"WITH {RUNS_SQL} SELECT arm, round(avg(f1) FILTER (WHERE dataset_test = 'O'), 6) AS same_f1, round(avg(f1) FILTER (WHERE dataset_test <> 'O'), 6) AS cross_f1, round(avg(f1) FILTER (WHERE dataset_test = 'O') - avg(f1) FILTER (WHERE dataset_test <> 'O'), 6) AS gap FROM runs GROUP BY arm")
def transfer_gap(spark, sf_dir):
    same, cross = F.avg(F.when(F.col("dataset_test") == "O", F.col("f1"))), F.avg(F.when(F.col("dataset_test") != "O", F.col("f1")))
    return _rounded(runs(spark, sf_dir).groupBy("arm").agg(same.alias("same_f1"), cross.alias("cross_f1"), (same - cross).alias("gap")))


def _pairs(spark, sf_dir):
    return metrics.fold_pairs(metrics.ranked(importances(spark, sf_dir)))


@query(f"WITH {RANKS_SQL} SELECT a, b, round(coalesce(corr(rank_a, rank_b), 0), 6) AS rho FROM pairs GROUP BY a, b")
def spearman_pairs(spark, sf_dir):
    return _rounded(metrics.spearman(_pairs(spark, sf_dir)))


@query(f"""WITH {RANKS_SQL} SELECT x.a, x.b, round(sum(sign(x.rank_a - z.rank_a) * sign(x.rank_b - z.rank_b)) / sqrt(sum(abs(sign(x.rank_a - z.rank_a))) * CAST(sum(abs(sign(x.rank_b - z.rank_b))) AS DOUBLE)), 6) AS tau
FROM pairs x JOIN pairs z ON x.a = z.a AND x.b = z.b GROUP BY x.a, x.b""")
def kendall_pairs(spark, sf_dir):
    return _rounded(metrics.kendall(_pairs(spark, sf_dir)))


@query(f"""WITH {RANKS_SQL}, tops AS (SELECT fold, list(feature) AS s FROM (SELECT fold, feature, row_number() OVER (PARTITION BY fold ORDER BY rank, feature) AS n FROM ranks) WHERE n <= 5 GROUP BY fold)
SELECT x.fold AS a, z.fold AS b, round(len(list_intersect(x.s, z.s)) / (10.0 - len(list_intersect(x.s, z.s))), 6) AS jaccard FROM tops x JOIN tops z ON x.fold < z.fold""")
def jaccard_topk(spark, sf_dir):
    return _rounded(metrics.jaccard_topk(metrics.ranked(importances(spark, sf_dir)), 5))


@query(f"""WITH {RANKS_SQL}, rhos AS (SELECT coalesce(corr(rank_a, rank_b), 0) AS rho FROM pairs GROUP BY a, b)
SELECT round(greatest(0, least(1, (avg(rho) + 1) / 2)), 6) AS score, round(avg(rho), 6) AS mean, round(stddev_pop(rho), 6) AS std, count(*) AS pairs FROM rhos""")
def consistency_score(spark, sf_dir):
    return _rounded(metrics.consistency(metrics.spearman(_pairs(spark, sf_dir))))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT arm, dataset_train, dataset_test, seed, avg(f1) AS f1, avg(accuracy) AS accuracy FROM runs GROUP BY ALL),
d AS (SELECT o.arm, unnest(['f1', 'accuracy']) AS metric, unnest([r.f1 - o.f1, r.accuracy - o.accuracy]) AS d FROM m r JOIN m o USING (dataset_train, dataset_test, seed) WHERE r.arm = 'A0' AND o.arm <> 'A0')
SELECT arm, metric, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) AS t, round(avg(d) / stddev_samp(d), 5) AS cohens_d, count(*) >= 5 AS sufficient_power FROM d GROUP BY arm, metric""")
def paired_ttest_stats(spark, sf_dir):
    on = ["dataset_train", "dataset_test", "seed"]
    mean = runs(spark, sf_dir).groupBy("arm", *on).agg(F.avg("f1").alias("f1"), F.avg("accuracy").alias("accuracy"))
    told = metrics.paired(mean.where("arm = 'A0'"), mean.where("arm <> 'A0'"), on, ["f1", "accuracy"], ["arm"])
    return told.select("arm", "metric", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 5).alias("t"), F.round("cohens_d", 5).alias("cohens_d"), "sufficient_power")


@query(f"""WITH {RUNS_SQL} SELECT dataset_train, dataset_test, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std,
count(*) AS n_runs, count(DISTINCT seed) AS n_seeds FROM runs GROUP BY ALL""")
def table_mean_std(spark, sf_dir):
    return _rounded(reports.mean_std(runs(spark, sf_dir), ["dataset_train", "dataset_test"], ["f1", "accuracy"]))


@query(f'WITH {RUNS_SQL} SELECT dataset_train, round(avg(f1) FILTER (WHERE dataset_test = \'F\'), 6) AS "F", round(avg(f1) FILTER (WHERE dataset_test = \'O\'), 6) AS "O" FROM runs GROUP BY dataset_train')
def pivot_f1_matrix(spark, sf_dir):
    return _rounded(reports.pivot(runs(spark, sf_dir), "dataset_train", "dataset_test", "f1", ["F", "O"]))


FAMILY_SQL = RUNS_SQL + ", c AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'rf' ELSE 'dnn' END AS family, l_orderkey % 6 + 1 AS round FROM runs)"


def _candidates(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("family", F.when(F.col("l_linenumber") % 3 == 0, "rf").otherwise("dnn")).withColumn("round", F.col("l_orderkey") % 6 + 1)


@query(f"""WITH {FAMILY_SQL}, k AS (SELECT seed, family, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT seed, family, row_number() OVER (PARTITION BY seed ORDER BY n DESC, family) AS r FROM k)
SELECT c.seed, round(avg(f1), 6) AS f1, round(avg(accuracy), 6) AS accuracy, any_value(b.family) AS family FROM c JOIN b ON c.seed = b.seed AND r = 1 GROUP BY c.seed""")
def sensitivity_mode(spark, sf_dir):
    return _rounded(reports.sensitivity(_candidates(spark, sf_dir), ["seed"], ["f1", "accuracy"]))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk_candidates(spark, sf_dir):
    return reports.top(runs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 25)


@query(f"WITH {FAMILY_SQL} SELECT round, count(*) FILTER (WHERE family = 'dnn') AS dnn, count(*) FILTER (WHERE family = 'rf') AS rf FROM c GROUP BY round")
def winner_family_counts(spark, sf_dir):
    return reports.family_counts(_candidates(spark, sf_dir), "round", "family", ["dnn", "rf"])


@query(f"""WITH {FAMILY_SQL}, long AS (SELECT family, f1, unnest(['seed', 'l_linenumber']) AS axis, unnest([CAST(seed AS VARCHAR), CAST(l_linenumber AS VARCHAR)]) AS value FROM c),
cells AS (SELECT family, axis, value, count(*) AS visits, round(avg(f1), 6) AS mean_fitness FROM long GROUP BY ALL)
SELECT family, axis, value, visits, mean_fitness FROM (SELECT *, row_number() OVER (PARTITION BY family, axis ORDER BY mean_fitness DESC, value) AS n FROM cells) WHERE n = 1""")
def qtable_argmax(spark, sf_dir):
    return reports.q_best(_rounded(reports.q_cells(_candidates(spark, sf_dir), ["seed", "l_linenumber"], fitness="f1")))


@query(f"""WITH {FAMILY_SQL}, e AS (SELECT round, max(f1) AS best, avg(f1) AS mean, stddev_pop(f1) AS std, min(f1) AS worst, count(*) AS population FROM c GROUP BY round)
SELECT round AS "round", round(best, 6) AS best, round(mean, 6) AS mean, round(std, 6) AS std, round(worst, 6) AS worst, population, round(max(best) OVER (ORDER BY "round"), 6) AS running_best FROM e""")
def search_progress(spark, sf_dir):
    return _rounded(reports.round_stats(_candidates(spark, sf_dir), fitness="f1"))


COMPLEXITY_SQL = RUNS_SQL + """, raw AS (SELECT l_orderkey, l_linenumber, f1, accuracy, CASE WHEN l_linenumber % 2 = 0 THEN 'rf' ELSE 'dnn' END AS family, l_extendedprice AS complexity FROM runs),
norm AS (SELECT *, greatest(0, least(1, CASE family WHEN 'rf' THEN (log10(greatest(complexity, 1)) - log10(650)) / (log10(4000000) - log10(650)) ELSE (log10(greatest(complexity, 1)) - log10(418)) / (log10(52866) - log10(418)) END)) AS cx FROM raw)"""


def _scored(spark, sf_dir):
    from ..functions.objective import complexity_norm as norm

    rows = runs(spark, sf_dir).select("l_orderkey", "l_linenumber", "f1", "accuracy", F.when(F.col("l_linenumber") % 2 == 0, "rf").otherwise("dnn").alias("family"), F.col("l_extendedprice").alias("complexity"))
    return rows.withColumn("cx", norm(F.col("complexity"), F.col("family"), {"rf": (650.0, 4_000_000.0), "dnn": (418.0, 52866.0)}))


@query(f"WITH {COMPLEXITY_SQL} SELECT l_orderkey, l_linenumber, family, round(cx, 6) AS complexity_norm FROM norm")
def complexity_norm(spark, sf_dir):
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "family", F.round("cx", 6).alias("complexity_norm"))


@query(f"WITH {COMPLEXITY_SQL} SELECT l_orderkey, l_linenumber, round(0.5*f1, 6) AS accuracy_term, round(0.3*accuracy, 6) AS shap_term, round(-0.2*cx, 6) AS complexity_term, round(0.5*f1 + 0.3*accuracy - 0.2*cx, 6) AS fitness FROM norm")
def fitness_breakdown(spark, sf_dir):
    from ..functions.objective import Objective

    terms = Objective().terms(F.col("f1"), F.col("accuracy"), F.col("cx"))
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in terms.items()])


@query(f"WITH {RANKS_SQL}, m AS (SELECT feature, avg(value) AS importance FROM importances GROUP BY feature) SELECT CAST(feature AS INTEGER) AS feature, round(importance, 6) AS importance, round(coalesce(importance / nullif(sum(importance) OVER (), 0), 0), 6) AS share FROM m")
def importance_share(spark, sf_dir):
    mean = importances(spark, sf_dir).groupBy("feature").agg(F.avg("value").alias("importance"))
    return _rounded(reports.importance_share(mean))


EVALUATED_SQL = RUNS_SQL + """, evaluated AS (SELECT *, 'name ' || arm AS arm_description, CASE l_linenumber % 3 WHEN 0 THEN 'same_dataset' WHEN 1 THEN 'cross_dataset' ELSE 'validation_holdout' END AS evaluation_type, CASE WHEN l_orderkey % 2 = 0 THEN 'rf' ELSE 'dnn' END AS model_family FROM runs)"""


def _evaluated(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "same_dataset").when(F.col("l_linenumber") % 3 == 1, "cross_dataset").otherwise("validation_holdout")
    return runs(spark, sf_dir).withColumns({"arm_description": F.concat(F.lit("name "), "arm"), "evaluation_type": kind, "model_family": F.when(F.col("l_orderkey") % 2 == 0, "rf").otherwise("dnn")})


_MEANS_SQL = "round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std, count(*) AS n_runs, count(DISTINCT seed) AS n_seeds"


@query(f"WITH {EVALUATED_SQL} SELECT arm, arm_description, evaluation_type, {_MEANS_SQL} FROM evaluated WHERE evaluation_type <> 'validation_holdout' GROUP BY ALL")
def ablation_table(spark, sf_dir):
    return _rounded(tables.ablation_table(_evaluated(spark, sf_dir)))


_PANEL_SQL = ", ".join(
    f"round(avg({m}) FILTER (WHERE evaluation_type = '{k}'), 6) AS {m}_mean, round(stddev_samp({m}) FILTER (WHERE evaluation_type = '{k}'), 6) AS {m}_std, count({m}) FILTER (WHERE evaluation_type = '{k}') AS {m}_count"
    for k, m in (("same_dataset", "f1"), ("cross_dataset", "accuracy"), ("same_dataset", "shap_consistency")))


@query(f"WITH {EVALUATED_SQL}, told AS (SELECT *, l_quantity / 50 AS shap_consistency FROM evaluated) SELECT arm, {_PANEL_SQL} FROM told WHERE arm IN {reports.PANEL_ARMS} GROUP BY arm")
def ablation_panel(spark, sf_dir):
    return _rounded(reports.ablation_panel(_evaluated(spark, sf_dir).withColumn("shap_consistency", F.col("l_quantity") / 50)))


@query(f"WITH {EVALUATED_SQL} SELECT count(*) AS n_runs, count(DISTINCT model_family || '-' || l_linenumber) AS n_distinct, count(DISTINCT model_family || '-' || l_linenumber) > 1 AS weights_matter FROM evaluated")
def distinct_configs(spark, sf_dir):
    return reports.distinct_configs(_evaluated(spark, sf_dir).withColumn("selected_config_id", F.concat_ws("-", "model_family", "l_linenumber")))


@query(f"WITH {EVALUATED_SQL} SELECT dataset_train, model_family, {_MEANS_SQL} FROM evaluated WHERE evaluation_type = 'same_dataset' AND arm = 'A0' GROUP BY ALL")
def family_table(spark, sf_dir):
    return _rounded(tables.family_table(_evaluated(spark, sf_dir)))


@query(f"WITH {EVALUATED_SQL} SELECT dataset_train, dataset_test, evaluation_type, {_MEANS_SQL} FROM evaluated WHERE evaluation_type <> 'validation_holdout' AND arm = 'A0' GROUP BY ALL")
def transfer_table(spark, sf_dir):
    return _rounded(tables.transfer_table(_evaluated(spark, sf_dir)))


@query(f"WITH {EVALUATED_SQL} SELECT dataset_train, arm, array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds FROM evaluated WHERE evaluation_type = 'validation_holdout' GROUP BY ALL")
def finished_seeds(spark, sf_dir):
    return tables.finished_seeds(_evaluated(spark, sf_dir)).select("dataset_train", "arm", F.array_join(F.col("seeds").cast("array<string>"), ",").alias("seeds"))


def statistical_tests(spark, sf_dir):
    """p-values are beyond SQL; the statistics are those of paired_ttest_stats."""
    return tables.statistical_tests(_evaluated(spark, sf_dir), metrics=("f1", "accuracy"))


QUERIES["statistical_tests"] = statistical_tests


# ------------------------------------------------------------------ streaming and search
@query(FEATURES_SQL + "SELECT capture, pos, round(window_duration, 6) AS window_duration, round(iat_mean, 6) AS iat_mean, round(iat_min, 6) AS iat_min, round(iat_max, 6) AS iat_max, n_unique_ids, y FROM told")
def streaming_count_windows(spark, sf_dir):
    from ..streaming.count_windows import drain
    from .inputs import message_columns

    schema = table(spark, sf_dir, "events").schema
    stream_ = message_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern: a stream reads folders or patterns, not a file
    return _rounded(drain(stream_.select("capture", "t_us", "can_id", "label", "seq")))


def _search_queries() -> None:
    from .search_queries import QUERIES as found

    QUERIES.update(found)


_search_queries()
