"""The study's tables out of run records, search-space metadata and paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import GROUPS, feature_names
from ..functions.statistics import t_test_p, wilcoxon_p
from .metrics import paired
from .reports import arm_rank, mean_std, pivot, plus_minus

METRICS = ["accuracy", "balanced_accuracy", "f1", "roc_auc", "shap_consistency", "complexity", "training_time_s", "inference_time_per_window_ms"]
AGREEMENT = ["shap_consistency", "spearman", "kendall", "jaccard"]


def _known(runs: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in runs.columns]


def feature_table(spark: SparkSession, groups=tuple(GROUPS)) -> DataFrame:
    """position, feature, feature_group in canonical order."""
    group = {n: g for g, names in GROUPS.items() for n in names}
    return spark.createDataFrame([(i, n, group[n]) for i, n in enumerate(feature_names(groups))], "position int, feature string, feature_group string")


def space_table(spark: SparkSession, space: dict, defaults: dict) -> DataFrame:
    """family, axis, levels, default."""
    rows = [(f, a, ", ".join(map(str, levels)), str(defaults.get(f, {}).get(a))) for f, axes in space.items() for a, levels in axes.items()]
    return spark.createDataFrame(rows, "family string, axis string, levels string, default string")


def family_table(runs: DataFrame, arm: str = "A0") -> DataFrame:
    """One arm on its own datasets, by dataset and family."""
    return mean_std(runs.where((F.col("arm") == arm) & (F.col("evaluation_type") == "same_dataset")), ["dataset_train", "model_family"], _known(runs, METRICS))


def ablation_table(runs: DataFrame) -> DataFrame:
    """All arms, same and cross dataset, in the order of the arms."""
    rows = runs.where(F.col("evaluation_type").isin("same_dataset", "cross_dataset"))
    made = mean_std(rows, ["arm", "arm_description", "evaluation_type"], _known(runs, METRICS))
    return made.orderBy(arm_rank(F.col("arm")), "arm", "evaluation_type")


def transfer_table(runs: DataFrame, arm: str = "A0") -> DataFrame:
    """One arm by training and test dataset."""
    rows = runs.where((F.col("arm") == arm) & F.col("evaluation_type").isin("same_dataset", "cross_dataset"))
    return mean_std(rows, ["dataset_train", "dataset_test", "evaluation_type"], _known(runs, METRICS))


def transfer_matrix(runs: DataFrame, datasets: list[str], metric: str = "f1", arm: str = "A0") -> DataFrame:
    """Mean of a metric, a row for each training and a column for each test dataset."""
    rows = runs.where((F.col("arm") == arm) & F.col("evaluation_type").isin("same_dataset", "cross_dataset"))
    return pivot(rows, "dataset_train", "dataset_test", metric, datasets)


def agreement_table(runs: DataFrame) -> DataFrame:
    """Explanation stability by arm, dataset and family; comparable from 5 features on."""
    rows = runs.where(F.col("evaluation_type") == "same_dataset")
    made = mean_std(rows, ["arm", "arm_description", "dataset_train", "model_family"], _known(runs, AGREEMENT + ["n_features"]))
    return made.withColumn("comparable", F.col("n_features_mean").cast("int") >= 5).orderBy(arm_rank(F.col("arm")), "arm", "dataset_train", "model_family")


def presented(table: DataFrame) -> DataFrame:
    """Pairs of <metric>_mean and <metric>_std as one text column."""
    metrics = [c.removesuffix("_mean") for c in table.columns if c.endswith("_mean") and c.removesuffix("_mean") + "_std" in table.columns]
    hidden = {f"{m}_{k}" for m in metrics for k in ("mean", "std")}
    return table.select(*[c for c in table.columns if c not in hidden], *[plus_minus(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in metrics])


def finished_seeds(runs: DataFrame) -> DataFrame:
    """dataset_train, arm, seeds: which runs a resumed study can leave out."""
    return runs.where("evaluation_type = 'validation_holdout'").groupBy("dataset_train", "arm").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))


def statistical_tests(runs: DataFrame, reference: str = "A0", metrics: tuple[str, ...] = ("f1", "accuracy", "shap_consistency"), alpha: float = 0.05) -> DataFrame:
    """Each arm against the reference, paired by datasets and seed, for both kinds of
    evaluation.  Repeated runs of a pair are averaged first.  Verdicts need 5 pairs;
    n_seeds and n_dataset_pairs tell what the pairs are made of."""
    spark, on = runs.sparkSession, ["evaluation_type", "dataset_train", "dataset_test", "seed"]
    names = _known(runs, list(metrics))
    mean = runs.where(F.col("evaluation_type").isin("same_dataset", "cross_dataset")).groupBy("arm", *on).agg(*[F.avg(m).alias(m) for m in names])
    base, other = mean.where(F.col("arm") == reference), mean.where(F.col("arm") != reference)
    told = paired(base, other, on, names, ["evaluation_type", "arm"])
    long = lambda rows, value, keys: rows.unpivot(keys, names, "metric", value)
    pairs = long(base.drop("arm"), "x", on).join(long(other, "z", ["arm", *on]), [*on, "metric"]).where("x is not null and z is not null and not isnan(x) and not isnan(z)")
    lists = pairs.groupBy("evaluation_type", "arm", "metric").agg(
        F.sort_array(F.collect_list(F.col("x") - F.col("z"))).alias("d"), F.countDistinct("seed").alias("n_seeds"),
        F.countDistinct(F.struct("dataset_train", "dataset_test")).alias("n_dataset_pairs"),
    )
    made = []
    for r in told.join(lists, ["evaluation_type", "arm", "metric"]).collect():  # a row for each arm, kind and metric
        t_p = t_test_p(r.t, r.n - 1) if r.t is not None else None
        w_p = wilcoxon_p(list(r.d)) if r.n >= 5 and r.t is not None else None
        made.append((r.evaluation_type, r.arm, r.metric, r.n, r.mean_diff, r.t, t_p, r.cohens_d, w_p, r.sufficient_power, (t_p < alpha) if t_p is not None and r.n >= 5 else None, r.n_seeds, r.n_dataset_pairs))
    return spark.createDataFrame(made, "evaluation_type string, arm string, metric string, n long, mean_diff double, t double, p double, cohens_d double, wilcoxon_p double, sufficient_power boolean, significant boolean, n_seeds long, n_dataset_pairs long")
