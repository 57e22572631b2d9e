import pytest

from framelark import config
from framelark.functions import parsing
from framelark.plans.catalog import candump_lines
from framelark.sources import logs, runlog, synthetic


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def told(rows):
    return [(r.capture, r.timestamp, r.can_id, r.dlc, r.label) for r in rows.orderBy("capture", "seq").collect()]


def test_ragged_headerless(spark, tmp_path):
    write(tmp_path / "a.csv", "1.0,0316,8,05,21,68,09,21,21,00,6f,R\n1.1,018f,2,fe,5b,T\n1.1,0002,0,R,,\nbad,1,1,R\n")
    write(tmp_path / "b" / "c.csv", "2.0,10,1,ff,T\n")
    write(tmp_path / "empty.csv", "")
    assert told(logs.read(spark, "car_hacking", str(tmp_path))) == [(0, 1.0, 0x316, 8, 0), (0, 1.1, 0x18F, 2, 1), (0, 1.1, 2, 0, 0), (1, 2.0, 10, 1, 1)]


def test_headers(spark, tmp_path):
    write(tmp_path / "x.csv", "Timestamp,Arbitration_ID,DLC,Data,Class,SubClass\n5.5,4f0,8,00,Attack,Flooding\n5.6,130,8,00,Normal,Normal\n")
    write(tmp_path / "y.csv", "Arbitration-ID,Time,Class\n12,7.0,r\n")
    assert told(logs.read(spark, "car_hacking", str(tmp_path))) == [(0, 5.5, 0x4F0, 8, 1), (0, 5.6, 0x130, 8, 0), (1, 7.0, 12, -1, 0)]
    assert told(logs.read(spark, "generic_csv", str(tmp_path))) == told(logs.read(spark, "sad", str(tmp_path)))


def test_text_logs(spark, tmp_path):
    write(tmp_path / "Attack_free.txt", "Timestamp: 1478198376.389427        ID: 0316    000    DLC: 8    05\nnoise\n")
    write(tmp_path / "DoS.log", "Timestamp: 1.5 ID: 00a0 000 DLC: 4 00\n")
    assert sorted(r[1:] for r in told(logs.read(spark, "can_ids", str(tmp_path)))) == [(1.5, 0xA0, 4, 1), (1478198376.389427, 0x316, 8, 0)]


def test_interval_labels(spark, tmp_path):
    write(tmp_path / "x.csv", "time,id\n1,10\n2,10\n3,10\n")
    assert [r[4] for r in told(logs.read(spark, "ornl", str(tmp_path), attack_start=2, attack_end=3))] == [0, 1, 1]
    with pytest.raises(ValueError):
        logs.read(spark, "ornl", str(tmp_path))


def test_candump(spark, tmp_path):
    write(tmp_path / "attacks" / "one.log", "(10.0) can0 0B4#0011\n# note\n(11.0) can0 0B4#001\n(12.5) can0 7FF#\nbroken\n(13.0) can0 0B4#00\n")
    write(tmp_path / "attacks" / "skip.log", "(1.0) can0 0B4#00\n")
    write(tmp_path / "ambient" / "calm.log", "(1.0) can0 0B4#00\n")
    meta = {"one": {"injection_interval": [2.0, 2.5]}, "skip": {"injection_interval": None}}
    assert told(logs.read(spark, "candump", str(tmp_path), metadata=meta)) == [(0, 1.0, 0xB4, 1, 0), (1, 10.0, 0xB4, 2, 0), (1, 12.5, 0x7FF, 0, 1), (1, 13.0, 0xB4, 1, 0)]
    assert candump_lines(spark.createDataFrame([("(1) x y 1#A",), ("(1)",), ("",)], "line string")).count() == 0


def test_parquet_and_cap(spark, tmp_path):
    spark.createDataFrame([(float(i), i % 7, 8, i % 2) for i in range(50)], "ts double, can_id long, dlc long, label int").coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert logs.read(spark, "generic_csv", str(tmp_path / "p.parquet")).count() == 50
    assert logs.read(spark, "generic_csv", str(tmp_path / "p.parquet"), max_messages=10).count() == 10


def test_unknown_adapter(spark):
    with pytest.raises(KeyError):
        logs.read(spark, "none", "/tmp")


def test_labels_and_ids(spark):
    flags = ["T", "R", "Attack Free", "attack_free", "DoS_attack", "weird", None]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, f string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.orderBy("i").select(parsing.label(F.col("f"))).collect()] == [1, 0, 1, 0, 1, 0, 0]
    ids = spark.createDataFrame([(0, "12"), (0, "0x1F"), (1, "12"), (1, "zz")], "c int, s string")
    got = ids.select("c", "s", parsing.can_id_by_capture(F.col("s"), F.col("c")).alias("v")).collect()
    assert {(r.c, r.s): r.v for r in got} == {(0, "12"): 0x12, (0, "0x1F"): 0x1F, (1, "12"): 12, (1, "zz"): -1}
    assert parsing.resolve(["Data Length", "Arrival-Time"], parsing.TIMESTAMP_NAMES) == "Arrival-Time"
    assert parsing.resolve(["x_timestamp_y"], parsing.TIMESTAMP_NAMES) == "x_timestamp_y" and parsing.resolve(["q"], parsing.LABEL_NAMES) is None


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    runlog.append(spark, [{"run_id": "a", "timestamp": "1", "f1": 0.5, "zz": 1}], path)
    runlog.append(spark, [{"run_id": "a", "timestamp": "2", "f1": 0.75, "zz": 2}], path)
    (tmp_path / "runs" / "x.txt").write_text("\n{broken\n")
    kept = runlog.table(runlog.history(spark, path))
    assert kept.columns == ["run_id", "timestamp", "f1", "zz"] and [tuple(r) for r in kept.where("run_id is not null").collect()] == [("a", "2", 0.75, 2)]
    assert "| 0.7500 |" in runlog.markdown(kept.where("run_id is not null"), "Runs")


def test_synthetic(spark):
    rows = synthetic.capture(spark, {1: 10, 2: 20}, 5, "flood", 0.25)
    n, bad = rows.count(), rows.where("label = 1").count()
    assert bad == pytest.approx(0.25 * n, rel=0.05) and rows.where("label = 1 and can_id <> 0").count() == 0
    with pytest.raises(ValueError):
        synthetic.capture(spark, {1: 10}, 1, "none")


def test_config(tmp_path):
    write(tmp_path / "base.yaml", "a: {b: 1, c: 2}\nd: [1]\n")
    write(tmp_path / "own.yaml", "inherits: base.yaml\na: {b: 5}\n")
    assert config.load(str(tmp_path / "own.yaml"), ["a.e=[1, x]", "d=7"]) == {"a": {"b": 5, "c": 2, "e": [1, "x"]}, "d": 7}
    with pytest.raises(ValueError):
        config.overrides(["a"])


def test_types_of_columns(spark, tmp_path):
    """Labels as numbers, quoted fields, other separators, and Parquet ids as numbers with gaps."""
    numbers = "timestamp,id,dlc,label\n" + "".join(f"{k}.0,10,8,{v}\n" for k, v in enumerate(["1.0", "0.0", "2", "0"]))
    words = 'timestamp,id,note,label\n1.0,10,"a, b",Attack\n2.0,11,c,Normal\n'
    for name, text in (("a.csv", numbers), ("b.csv", words)):
        (tmp_path / name).write_text(text)
    got = logs.read(spark, "generic_csv", str(tmp_path)).orderBy("capture", "timestamp").collect()
    assert [(r.capture, r.can_id, r.label) for r in got] == [(0, 10, 1), (0, 10, 0), (0, 10, 1), (0, 10, 0), (1, 10, 1), (1, 11, 0)]
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "c.csv").write_text("timestamp|id|label\n1.0|10|1\n")
    assert logs.read(spark, "generic_csv", str(tmp_path / "bars"), sep="|").count() == 1
    for kind in ("long", "double"):
        place = f"{tmp_path}/{kind}.parquet"
        spark.createDataFrame([(1.0, 10, 1), (2.0, None, 0), (3.0, 12, 2)], "timestamp double, id long, label long").selectExpr("timestamp", f"cast(id as {kind}) id", "label").coalesce(1).write.parquet(place)
        got = logs.read(spark, "generic_csv", place).orderBy("timestamp").collect()
        assert [(r.can_id, r.label) for r in got] == [(10, 1), (12, 1)]


def test_features_of_several_datasets_stay(spark, tmp_path):
    from framelark.sources import runlog

    for name in ("one", "two", "two"):
        runlog.save_features(spark.createDataFrame([(name, "train", 1.0)], "dataset string, split string, x double"), str(tmp_path / "f"))
    assert sorted(r.dataset for r in spark.read.parquet(str(tmp_path / "f")).collect()) == ["one", "two"]
