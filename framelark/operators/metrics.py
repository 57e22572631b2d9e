"""Detection metrics, rank agreement and paired tests as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(rows: DataFrame, keys: list[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    count = lambda a, b, name: F.count_if((F.col(y) == a) & (F.col(predicted) == b)).alias(name)
    return rows.groupBy(*keys).agg(count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn"), count(1, 1, "tp"))


def classification(rows: DataFrame, keys: list[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and the metrics made of them; undefined ratios are 0, the
    correlation of a single class is null."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n, positive, negative = tn + fp + fn + tp, fn + tp, tn + fp
    recall, precision = _share(tp, positive), _share(tp, tp + fp)
    present = (positive > 0).cast("int") + (negative > 0).cast("int")
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when((positive > 0) & (negative > 0), F.coalesce(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(product)), F.lit(0.0)))
    return confusion(rows, keys, y, predicted).select(
        *keys, "tn", "fp", "fn", "tp", _share(tp + tn, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(recall + _share(tn, negative), present).alias("balanced_accuracy"), mcc.alias("mcc"), _share(fp, negative).alias("false_positive_rate"))


def roc_auc(rows: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the curve, ties averaged; null for a single class.  Rows are
    first counted for each distinct score, and only those counts are ranked."""
    held = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(0)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2.0)
    p, n = F.sum("p"), F.sum("n") - F.sum("p")
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2.0, (p * n).cast("double")).alias("roc_auc"), p.alias("positives"), n.alias("negatives"))


def ranked(long: DataFrame, fold: str = "fold", feature: str = "feature", value: str = "value") -> DataFrame:
    """Adds ``rank``: 1 for the largest of a fold, ties averaged."""
    order = Window.partitionBy(fold).orderBy(F.col(value).desc())
    ties = Window.partitionBy(fold, value)
    return long.withColumn("rank", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)


def fold_pairs(ranks: DataFrame, fold: str = "fold", feature: str = "feature") -> DataFrame:
    """feature, a, b, rank_a, rank_b for every two folds a < b."""
    one = ranks.select(F.col(feature).alias("feature"), F.col(fold).alias("a"), F.col("rank").alias("rank_a"))
    two = ranks.select(F.col(feature).alias("feature_b"), F.col(fold).alias("b"), F.col("rank").alias("rank_b"))
    return one.join(two, (F.col("feature") == F.col("feature_b")) & (F.col("a") < F.col("b"))).drop("feature_b")


def spearman(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.coalesce(F.nanvl(F.corr("rank_a", "rank_b"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def kendall(pairs: DataFrame) -> DataFrame:
    """Kendall's tau-b of every two folds; features of a pair of folds are compared in its group."""
    both = pairs.groupBy("a", "b").agg(F.collect_list(F.struct("rank_a", "rank_b")).alias("items"))
    signs = lambda of: F.aggregate("items", F.lit(0.0), lambda s, x: s + F.aggregate("items", F.lit(0.0), lambda r, z: r + of(x, z)))
    da, db = (lambda x, z: F.signum(x["rank_a"] - z["rank_a"])), (lambda x, z: F.signum(x["rank_b"] - z["rank_b"]))
    top, left, right = signs(lambda x, z: da(x, z) * db(x, z)), signs(lambda x, z: F.abs(da(x, z))), signs(lambda x, z: F.abs(db(x, z)))
    return both.select("a", "b", F.coalesce(F.try_divide(top, F.sqrt(left * right)), F.lit(0.0)).alias("tau"))


def jaccard_topk(ranks: DataFrame, k: int, fold: str = "fold", feature: str = "feature") -> DataFrame:
    """a, b, jaccard of the sets of the k first features of every two folds."""
    order = Window.partitionBy(fold).orderBy("rank", feature)
    tops = ranks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy(F.col(fold).alias("fold")).agg(F.collect_set(feature).alias("top"))
    a, b = tops.select(F.col("fold").alias("a"), F.col("top").alias("s")), tops.select(F.col("fold").alias("b"), F.col("top").alias("t"))
    both = a.join(b, F.col("a") < F.col("b"))
    return both.select("a", "b", (F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("jaccard"))


def consistency(agreement: DataFrame, column: str = "rho") -> DataFrame:
    """score, mean, std, pairs: (mean + 1) / 2 within 0 and 1; 0.5 without a pair."""
    return agreement.agg(F.when(F.count(column) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.avg(column) + 1) / 2))).otherwise(0.5).alias("score"),
                         F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count("*").alias("pairs"))


def paired(reference: DataFrame, other: DataFrame, on: list[str], metrics: list[str], keys: list[str]) -> DataFrame:
    """Paired differences reference - other: keys, metric, n, mean_diff, t, cohens_d,
    sufficient_power.  Unmatched and non-finite pairs are left out."""
    unpivot = lambda rows, name: rows.unpivot([*on, *[k for k in keys if k in rows.columns]], metrics, "metric", name)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    pairs = unpivot(reference.select(*on, *metrics), "x").join(unpivot(other, "z"), [*on, "metric"]).where(finite("x") & finite("z")).withColumn("d", F.col("x") - F.col("z"))
    told = pairs.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("largest"))
    sure = (F.col("n") >= 2) & (F.col("largest") > 1e-8)
    return told.select(*keys, "metric", "n", "mean_diff", F.when(sure, F.try_divide("mean_diff", F.col("sd") / F.sqrt("n"))).alias("t"),
                       F.when(sure, F.try_divide("mean_diff", "sd")).alias("cohens_d"), (F.col("n") >= 5).alias("sufficient_power"))
