import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark import cli
from framelark.operators import quality, reports, tables
from framelark.search import arms
from framelark.search.space import DEFAULTS, SPACE
from framelark.sources import logs


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{a}{s}{e}{d}", a, f"name {a}", d, d if e == "same_dataset" else "z", e, s, "rf" if s else "dnn", float(rng.random()), 0.5, 0.25, 23) for a in ("A0", "A1", "A5") for s in range(3) for e in ("same_dataset", "cross_dataset", "validation_holdout") for d in ("x", "y")]
    return spark.createDataFrame(rows, "run_id string, arm string, arm_description string, dataset_train string, dataset_test string, evaluation_type string, seed int, model_family string, f1 double, accuracy double, shap_consistency double, n_features int")


def test_tables(spark, runs):
    assert [r.arm for r in tables.ablation_table(runs).collect()] == ["A0", "A0", "A1", "A1", "A5", "A5"]
    assert tables.family_table(runs).count() == 4 and tables.transfer_table(runs).count() == 4
    assert tables.transfer_matrix(runs, ["x", "y", "z"]).columns == ["dataset_train", "x", "y", "z"]
    assert all(r.comparable for r in tables.agreement_table(runs).collect())
    assert " ± " in tables.presented(tables.ablation_table(runs)).first().f1
    assert all(r.seeds == [0, 1, 2] for r in tables.finished_seeds(runs).collect())
    assert tables.feature_table(spark).count() == 26 and tables.space_table(spark, SPACE, DEFAULTS).count() == 12


def test_paired_tests(runs):
    got = {(r.evaluation_type, r.arm, r.metric): r for r in tables.statistical_tests(runs).collect()}
    assert len(got) == 2 * 2 * 3
    r = got["same_dataset", "A1", "f1"]
    own = {k: v for k, v in ((( x.arm, x.dataset_train, x.seed), x.f1) for x in runs.where("evaluation_type = 'same_dataset'").collect())}
    d = np.array([own["A0", k, s] - own["A1", k, s] for k in "xy" for s in range(3)])
    assert r.n == 6 and r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 6**0.5)) and 0 < r.p <= 1 and r.sufficient_power
    assert got["same_dataset", "A1", "accuracy"].t is None and got["same_dataset", "A1", "accuracy"].significant is None


def test_cache_follows_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("time,id,label\n1,2,0\n")
    args = (spark, str(tmp_path / "cache"), "n", "generic_csv", str(raw))
    assert logs.cached(*args).count() == logs.cached(*args).count() == 1
    (raw / "b.csv").write_text("time,id,label\n1,2,0\n2,2,1\n")
    assert logs.cached(*args).count() == 3


def test_command_line(spark, tmp_path):
    from framelark.sources import synthetic

    for name, ids in (("a", {1: 10, 2: 20}), ("b", {3: 8, 4: 30})):
        rows = synthetic.capture(spark, ids, 4, "flood", 0.3, seed=ids[next(iter(ids))])
        rows.select("timestamp", "can_id", "dlc", "label").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    space = {"rf": {"space": {**{k: v[:1] for k, v in SPACE["rf"].items()}, "n_estimators": [3], "max_depth": [3]}}, "dnn": {"space": {**{k: v[:1] for k, v in SPACE["dnn"].items()}, "epochs": [2]}}}
    cfg = {"data": {"max_windows": {"train": 200, "val": 60, "test": 60, "cross_target": 80}, "datasets": {n: {"adapter": "generic_csv", "path": str(tmp_path / f"{n}.parquet")} for n in "ab"}},
           "models": space, "meta": {"population": 2, "rounds": 1, "survivors": 1, "cv_folds": 2, "shap": {"max_explain_sample": 5, "max_background": 5, "dnn_max_evals": 60}}}
    (tmp_path / "c.yaml").write_text(json.dumps(cfg))
    out = tmp_path / "out"
    assert cli.main(["pipeline", "-c", str(tmp_path / "c.yaml"), "-o", str(out), "--save-features"]) == 0
    assert cli.main(["ablation", "-c", str(tmp_path / "c.yaml"), "-o", str(out), "--arms", "A0", "A5"]) == 0
    assert (out / "ablation.md").read_text().count("\n") > 4 and (out / "tests.md").exists() and (out / "features").exists()
    score, contract = __import__("framelark.search.bundle", fromlist=["load"]).load(str(next((out / "models").iterdir())))
    assert contract["window"] == 10 and 0 <= score(np.zeros((1, len(contract["features"]))))[0] <= 1
    assert len(arms.ARMS) == 9


def test_target_checks_fail(spark):
    target = spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, y int")
    scaler = quality.fit_scaler(target, ["a", "b"])
    told = lambda *args: {r[0]: r.passed for r in quality.target_checks(scaler, *args).collect()}
    assert told(scaler, ["a", "b"], target) == {"scaler_unchanged": True, "column_order": True, "target_non_empty": True}
    moved = quality.fit_scaler(target.withColumn("a", F.lit(3.0)), ["a", "b"])
    assert told(moved, ["a", "b"], target.select("b", "a", "y").limit(0)) == {"scaler_unchanged": False, "column_order": False, "target_non_empty": False}


def test_distinct_configs_of_nothing(spark):
    rows = spark.createDataFrame([], "selected_config_id string")
    assert tuple(reports.distinct_configs(rows).first()) == (0, 0, False)
