import json

import numpy as np
import pytest

from framelark import cli
from framelark.sources import runlog


def capture(path, seed, n=900):
    rng = np.random.default_rng(seed)
    bad = np.arange(n) // 30 % 3 == 2
    t = np.cumsum(np.where(bad, 0.001, 0.01) * rng.uniform(0.8, 1.2, n))
    ids = np.where(bad, 0, rng.integers(1, 6, n))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("timestamp,can_id,dlc,label\n" + "".join(f"{a:.6f},{i},8,{int(b)}\n" for a, i, b in zip(t, ids, bad)))


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("study")
    for k, name in enumerate(("one", "two")):
        capture(base / name / "a.csv", k)
    small = {"rf": {"n_estimators": [3, 5], "max_depth": [3, None], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]}}
    cfg = {
        "data": {"datasets": {n: {"adapter": "generic_csv", "path": str(base / n)} for n in ("one", "two")}, "max_windows": {"train": 200, "val": 60, "test": 60, "cross_target": 80}},
        "meta": {"cv_folds": 2, "population": 2, "rounds": 2, "survivors": 2, "families": ["rf"], "shap": {"max_explain_sample": 5, "max_background": 5, "dnn_max_evals": 60}},
        "models": {"rf": {"space": small["rf"]}}, "run": {"seeds": [0, 1]}, "sensitivity": {"grid": [[1.0, 0.0, 0.0], [0.5, 0.3, 0.2]]},
    }
    (base / "settings.yaml").write_text(json.dumps(cfg))
    for command, more in (("pipeline", ["--save-features"]), ("metalearning", []), ("metalearning", []), ("sensitivity", [])):
        assert cli.main([command, "-c", str(base / "settings.yaml"), "-o", str(base / "out"), *more]) == 0
    return base / "out"


def test_features_of_both_datasets(spark, out):
    rows = spark.read.parquet(str(out / "features"))
    assert {(r.dataset, r.split) for r in rows.select("dataset", "split").distinct().collect()} == {(d, s) for d in ("one", "two") for s in ("train", "val", "test")}
    assert rows.where("dataset = 'one' and split = 'train'").count() == 200 and "iat_mean" in rows.columns


def test_runs_of_all_seeds_and_sessions(spark, out):
    runs = runlog.table(runlog.history(spark, str(out / "runs"))).where("experiment = 'metalearning'").collect()
    kinds = [(r.seed, r.evaluation_type, r.dataset_test) for r in runs]
    assert len(kinds) == 12 and {(s, k, d) for s in (0, 1) for k, d in (("validation_holdout", "one"), ("same_dataset", "one"), ("cross_dataset", "two"))} == set(kinds)
    assert len({r.session for r in runs}) == 2 and len({r.run_id for r in runs}) == 12
    assert all(r.hp_n_estimators in ("3", "5") and 0 <= r.complexity_norm <= 1 and r.cv_accuracy > 0.5 and r.search_evaluations >= 1 for r in runs)


def test_traces_and_tables(spark, out):
    rounds = spark.read.json(str(out / "artifacts" / "metalearning_rounds"))
    assert {(r.seed, r.round) for r in rounds.collect()} == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert spark.read.json(str(out / "artifacts" / "metalearning_candidates")).count() == 8
    assert spark.read.json(str(out / "artifacts" / "environment")).first().seeds == [0, 1]
    assert (out / "sensitivity.md").read_text().count("\n| 0.5000 |") == 1 and (out / "configurations.md").read_text().count("| 4 |") == 1
    assert len(list((out / "models").iterdir())) == 2


def test_malformed_lines_are_counted(spark, tmp_path):
    runlog.append(spark, runlog.stamp([{"f1": float("nan")}, {"f1": 0.5}], "x", "s", 3), str(tmp_path / "runs"))
    (tmp_path / "runs" / "more.txt").write_text("\n{broken\n")
    with pytest.warns(UserWarning, match=": 1 malformed"):
        rows = runlog.history(spark, str(tmp_path / "runs"))
    assert sorted(r.run_id for r in rows.where("run_id is not null").collect()) == ["x-s-00003", "x-s-00004"]
    assert runlog.new_session() != runlog.new_session()
