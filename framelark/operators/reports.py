"""Tables over the run log and the search trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Arms of the ablation panel.
PANEL_ARMS = ("A0", "A1", "A2", "A3", "A4", "A6")
ARM_ORDER = {f"A{i}": i for i in range(9)}


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def mean_std(rows: DataFrame, keys: list[str], metrics: list[str], seed: str = "seed") -> DataFrame:
    """Mean and sample deviation of every metric, runs and seeds; not-a-number is skipped, null keys stay."""
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.groupBy(*keys).agg(*[f(value(c)).alias(f"{c}_{name}") for c in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp))],
                                   F.count("*").alias("n_runs"), F.countDistinct(seed).alias("n_seeds"))


def plus_minus(mean: Column, std: Column, digits: int = 4) -> Column:
    """'mean ± std'; without the second part where there is no deviation."""
    form = f"%.{digits}f"
    return F.when(mean.isNull(), "").when(std.isNull() | F.isnan(std), F.format_string(form, mean)).otherwise(F.format_string(f"{form} ± {form}", mean, std))


def pivot(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, columns).agg(F.avg(value))


def top(rows: DataFrame, by: str, ties: list[str], k: int = 25) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), *ties).limit(k)


def arm_rank(arm: Column) -> Column:
    """0 to 8 for A0 to A8, 99 for anything else."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ARM_ORDER.items() for x in kv]), arm), F.lit(99))


def family_counts(rows: DataFrame, row: str, family: str, families: list[str]) -> DataFrame:
    return rows.groupBy(row).pivot(family, families).count().na.fill(0)


def q_cells(candidates: DataFrame, axes: list[str], family: str = "family", fitness: str = "fitness") -> DataFrame:
    """family, axis, value, visits, mean_fitness over the candidates of finite fitness."""
    long = candidates.where(F.col(fitness).isNotNull() & ~F.isnan(fitness) & (F.abs(fitness) != float("inf"))).select(family, fitness, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot([family, fitness], axes, "axis", "value")
    return long.where("value is not null").groupBy(family, "axis", "value").agg(F.count("*").alias("visits"), F.avg(fitness).alias("mean_fitness"))


def q_best(cells: DataFrame, family: str = "family") -> DataFrame:
    """The value of the highest mean on every axis; the smaller value on ties."""
    order = Window.partitionBy(family, "axis").orderBy(F.col("mean_fitness").desc(), "value")
    return cells.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def round_stats(candidates: DataFrame, round_: str = "round", fitness: str = "fitness") -> DataFrame:
    """best, mean, std (population), worst of a round, and the best so far."""
    each = candidates.groupBy(round_).agg(F.max(fitness).alias("best"), F.avg(fitness).alias("mean"), F.stddev_pop(fitness).alias("std"), F.min(fitness).alias("worst"), F.count("*").alias("population"))
    return each.withColumn("running_best", F.max("best").over(Window.partitionBy(F.lit(0)).orderBy(round_).rowsBetween(Window.unboundedPreceding, 0)))


def sensitivity(rows: DataFrame, keys: list[str], metrics: list[str], family: str = "family") -> DataFrame:
    """Means, and the most frequent family (the smaller one on ties)."""
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in metrics], F.mode(family, True).alias(family))


def ablation_panel(rows: DataFrame, arms: tuple[str, ...] = PANEL_ARMS) -> DataFrame:
    """Per arm: mean, sample deviation and number of f1 and SHAP consistency within
    the dataset and of accuracy across datasets; not-a-number is skipped."""
    made = []
    for kind, metric in (("same_dataset", "f1"), ("cross_dataset", "accuracy"), ("same_dataset", "shap_consistency")):
        value = F.when((F.col("evaluation_type") == kind) & ~F.isnan(metric), F.col(metric))
        made += [f(value).alias(f"{metric}_{name}") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    return rows.where(F.col("arm").isin(*arms)).groupBy("arm").agg(*made)


def distinct_configs(rows: DataFrame, config: str = "selected_config_id") -> DataFrame:
    """One row: runs of a sweep, distinct configurations they selected, and whether
    the weights made a difference."""
    told = rows.agg(F.count("*").alias("n_runs"), F.countDistinct(config).alias("n_distinct"))
    return told.withColumn("weights_matter", F.col("n_distinct") > 1)


def importance_share(rows: DataFrame, value: str = "importance") -> DataFrame:
    """Adds ``share`` of the total, 0 if that is 0."""
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def stream_statistics(messages: DataFrame) -> DataFrame:
    """One row: messages, captures, ids, attack rate, duration, rate and the median of
    the captures' median gaps.  Gaps come from the order within slices of a capture."""
    from .stream import positions

    placed = positions(messages).select("capture", "pos", "t_us", "can_id", "label", "dlc")
    block = F.floor(F.col("pos") / 8192)
    shared = (F.col("pos") % 8192 == 0) & (block > 0)
    near = placed.withColumn("block", F.explode(F.when(shared, F.array(block, block - 1)).otherwise(F.array(block))))
    gaps = near.withColumn("gap", F.lead("t_us").over(Window.partitionBy("capture", "block").orderBy("pos")) - F.col("t_us")).where(F.floor(F.col("pos") / 8192) == F.col("block"))
    each = gaps.groupBy("capture").agg(F.count("*").alias("n"), (F.max("t_us") - F.min("t_us")).alias("duration"), F.median("gap").alias("gap"), F.sum(F.col("label").cast("long")).alias("attacks"), F.max("dlc").alias("dlc"))
    ids = messages.select("can_id").distinct().agg(F.count("*").alias("n_ids"))
    total = each.agg(F.sum("n").alias("n_messages"), F.count("*").alias("n_captures"), (F.sum("attacks") / F.sum("n")).alias("attack_rate"), (F.sum("duration") / 1e6).alias("duration_s"),
                     (F.median("gap") / 1e6).alias("median_gap_s"), F.try_divide(F.sum("n").cast("double"), F.sum("duration") / 1e6).alias("rate_hz"), (F.max("dlc") >= 0).alias("has_dlc"))
    return total.crossJoin(F.broadcast(ids))
