"""Command line: prepare, search, ablation, transfer and sensitivity runs.

    python -m framelark.cli {pipeline,metalearning,ablation,crossdataset,sensitivity,all} -c settings.yaml [-s key=value ...] [-o folder]
"""

from __future__ import annotations

import argparse
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import functions as F

from . import config
from .functions.objective import Objective
from .operators import reports, tables
from .search import arms as experiments
from .search.evaluate import Budget
from .search.space import SPACE
from .session import session
from .sources import logs, runlog


def settings_of(cfg: dict) -> experiments.Settings:
    data, meta, models = cfg.get("data", {}), cfg.get("meta", {}), cfg.get("models", {})
    most, shap = data.get("max_windows", {}), meta.get("shap", {})
    made = experiments.Settings(window=data.get("window_size", 10), fractions=data.get("split", {"train": 0.6, "val": 0.2, "test": 0.2}))
    made.budget.update({k: v for k, v in most.items() if k in made.budget})
    made.cross_windows = most.get("cross_target", made.cross_windows)
    made.folds, made.population, made.rounds, made.survivors, made.epsilon = (meta.get(k, d) for k, d in (("cv_folds", 4), ("population", 12), ("rounds", 6), ("survivors", 6), ("epsilon", 0.3)))
    made.shap = Budget(shap.get("max_explain_sample", 300), shap.get("max_background", 100), shap.get("dnn_max_evals", 300), shap.get("topk", 5))
    made.space = {f: models.get(f, {}).get("space", SPACE[f]) for f in SPACE}
    made.families = tuple(meta.get("families", ("rf", "dnn")))
    made.refit_on = cfg.get("run", {}).get("refit_on", "train_val")
    return made


def sources_of(spark, cfg: dict) -> dict:
    made = {}
    for name, spec in cfg["data"]["datasets"].items():
        spec = dict(spec)
        made[name] = logs.read(spark, spec.pop("adapter"), spec.pop("path"), spec.pop("max_messages", None), **spec).persist()
    return made


def objective_of(cfg: dict) -> Objective:
    f = cfg.get("fitness", {})
    return Objective(f.get("alpha", 0.5), f.get("beta", 0.3), f.get("gamma", 0.2), f.get("use_shap_consistency", True), f.get("use_complexity", True), f.get("accuracy_metric", "balanced_accuracy"), f.get("consistency_metric", "spearman"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("pipeline", "metalearning", "ablation", "crossdataset", "sensitivity", "all"))
    parser.add_argument("--config", "-c", required=True)
    parser.add_argument("--set", "-s", nargs="*", action="extend", default=[])
    parser.add_argument("--output", "-o", default="results")
    parser.add_argument("--tag", default="")
    parser.add_argument("--arms", nargs="*")
    parser.add_argument("--arm", default="A0")
    parser.add_argument("--dataset")
    parser.add_argument("--save-features", action="store_true")
    parser.add_argument("--no-save-models", action="store_true")
    given = parser.parse_args(args)
    cfg = config.load(given.config, given.set)
    out = Path(given.output) / given.tag if given.tag else Path(given.output)
    out.mkdir(parents=True, exist_ok=True)
    config.snapshot(cfg, str(out / "settings.json"))
    spark, settings, goal = session(), settings_of(cfg), objective_of(cfg)
    sources = sources_of(spark, cfg)
    seeds, first = cfg.get("run", {}).get("seeds", [0]), given.dataset or next(iter(sources))
    stamp, logged, failed = runlog.new_session(), 0, 0
    runlog.save_records(spark, [runlog.environment() | {"session": stamp, "seeds": seeds}], str(out / "artifacts" / "environment"))
    for command in ("pipeline", "ablation", "sensitivity") if given.command == "all" else (given.command,):
        traces: list[dict] = []
        try:
            if command == "pipeline":
                features = []
                for name, rows in sources.items():
                    stats = reports.stream_statistics(rows)
                    (out / f"statistics_{name}.md").write_text(runlog.markdown(stats, name))
                    if given.save_features:
                        made = experiments.prepare(rows, settings)
                        features.append(made.scaled.select(F.lit(name).alias("dataset"), "split", "capture", "pos", *made.names, F.col("y").alias("label")))
                if features:
                    runlog.save_features(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), features), str(out / "features"))
                continue
            if command == "metalearning":
                models = None if given.no_save_models else str(out / "models")
                ready = experiments.prepare(sources[first], settings)
                records = [r for seed in seeds for r in experiments.run_arm(spark, experiments.ARMS["A0"], sources, first, settings, seed, goal, ready, keep=models, traces=traces)]
            elif command == "crossdataset":
                records = [r for s in sources for seed in seeds for r in experiments.run_arm(spark, experiments.ARMS[given.arm], sources, s, settings, seed, goal, traces=traces)]
            elif command == "ablation":
                records = experiments.ablation(spark, sources, settings, given.arms or cfg.get("ablation", {}).get("arms", list(experiments.ARMS)), seeds, None if given.no_save_models else str(out / "models"), traces)
            else:
                records = [{"evaluation_type": "sensitivity", "arm": "sensitivity", "dataset_train": first, "model_family": r["family"], **r} for r in experiments.sensitivity(spark, sources[first], settings, [tuple(g) for g in cfg.get("sensitivity", {}).get("grid", experiments.GRID)], seeds)]
            runlog.append(spark, runlog.stamp(records, command, stamp, logged), str(out / "runs"))
            logged += len(records)
            for kind in experiments.TRACES:
                runlog.save_records(spark, [r for t in traces for r in t[kind]], str(out / "artifacts" / f"{command}_{kind}"))
            table = runlog.table(runlog.history(spark, str(out / "runs")))
            runlog.save_table(table.select(*[c for c, t in table.dtypes if not t.startswith("array")]), str(out / "runs_csv"))
            table = table.where((F.col("session") == stamp) & (F.col("experiment") == command))  # the tables tell this session's runs
            if command == "sensitivity":
                told = reports.sensitivity(table, ["alpha", "beta", "gamma"], ["accuracy", "consistency", "complexity"])
                (out / "sensitivity.md").write_text(runlog.markdown(told.orderBy("alpha", "beta", "gamma"), "weights"))
                (out / "configurations.md").write_text(runlog.markdown(reports.distinct_configs(table, "config_id"), "distinct configurations"))
            if command == "ablation":
                for name, made in {"ablation": tables.ablation_table(table), "transfer": tables.transfer_table(table), "agreement": tables.agreement_table(table)}.items():
                    (out / f"{name}.md").write_text(runlog.markdown(tables.presented(made), name))
                (out / "tests.md").write_text(runlog.markdown(tables.statistical_tests(table), "paired tests"))
            print(json.dumps({"command": command, "records": len(records)}))
        except Exception as error:  # a failed experiment doesn't end those after it
            failed += 1
            print(json.dumps({"command": command, "error": str(error)[:500]}))
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
