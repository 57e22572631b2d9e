"""Mixing sources to target weights: capped water-filling, then seeded
whole and fractional repetitions.  DataFrame functions only.

``plan_targets`` turns per-source sizes into per-source targets.  Weights
share the total; no target exceeds ``max_epochs`` times its source.  The level
of the water is found in closed form: with sources sorted by the level at
which they reach their cap, the running sums of caps and of weights give, for
every prefix, the level that the rest would have; the first source that stays
below its cap at that level fixes it.

``mix`` then repeats documents.  Every document is taken ``whole`` times, the
whole part of target / size.  The fractional part goes to the documents that
come first in the order of a seeded hash until the target is used up; the
last of them gives only the words still missing.  The place where a source's
fraction ends is found by the sums of hash-prefix buckets and then within the
one bucket that holds it, so no task ever orders a whole source.

Defined results: null source is a source of its own, last in order; null or
empty text has size 0 and is taken 0 times; rows that share an id share a hash
and split the last words evenly, rounded down; an empty table gives an empty
result; extra columns are ignored, names may clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, words

#: Sources that the plan may broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Hex digits of the hash that name a bucket: 4096 buckets in each source.
BUCKET_DIGITS = 3


def plan_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3) -> DataFrame:
    """(source, source_size) -> the same plus target.  One row per source; the
    sort over all sources is of that many rows, not of documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = (
        sizes.withColumn("_rank", F.row_number().over(order))
        .withColumn("_weight", F.element_at(listed, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_weight").over(onward))
        .withColumn("_free", F.col("_level") * F.col("_weight") < F.col("_cap"))
    )
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("_at", level).select(
        "source", "source_size",
        F.when(F.col("_at").isNull() | (F.col("_ratio") <= F.col("_at")), F.col("_cap").cast("double")).otherwise(F.col("_at") * F.col("_weight")).alias("target"),
    )


def _place(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan_repetitions(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """-> (narrow documents: doc_id, source, size, place), (sources: source,
    source_size, target, whole, last_place, last_words, last_size).

    A document gets one repetition beyond ``whole`` if its place is below
    ``last_place``; those at it share ``last_words`` of their ``last_size``.
    """
    narrow = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), _place(F.col("doc_id"), seed).alias("place")))
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    buckets = cut(narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held")))
    targets = plan_targets(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, max_epochs)
    targets = cut(
        targets.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
        .withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = bounded(targets, BROADCAST_SOURCES)
    edge = (
        buckets.withColumn("ahead", F.coalesce(F.sum("held").over(running), F.lit(0)))
        .join(small.select(F.col("source").alias("s"), "extra"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("ahead") <= F.col("extra")) & (F.col("extra") < F.col("ahead") + F.col("held")))
        .select("s", F.col("bucket").alias("b"), "ahead", "extra")
    )
    edge = bounded(cut(edge), BROADCAST_SOURCES)
    within = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        narrow.join(edge, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b")))
        .groupBy("s", "place", "ahead", "extra").agg(F.sum("size").alias("last_size"))
        .withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("last_size").over(within), F.lit(0)))
        .where((F.col("ahead") <= F.col("extra")) & (F.col("extra") < F.col("ahead") + F.col("last_size")))
        .select("s", F.col("place").alias("last_place"), (F.col("extra") - F.col("ahead")).alias("last_words"), "last_size")
    )
    sources = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "extra")
    return narrow, bounded(cut(sources), BROADCAST_SOURCES)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix") -> DataFrame:
    """One narrow row per document: doc_id, size, source_size, target, taken
    (words, repeats counted), copies (whole repetitions, the last partial one
    left out), partial (words of that one)."""
    narrow, sources = plan_repetitions(docs, weights, max_epochs, seed)
    joined = narrow.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    first = F.coalesce(F.col("place") < F.col("last_place"), F.lit(False))
    partial = F.when(F.col("place") == F.col("last_place"), F.floor(F.col("last_words") * F.col("size") / F.col("last_size"))).otherwise(0).cast("long")
    return joined.select(
        "doc_id", "size", "source_size", "target",
        (F.when(F.col("size") > 0, F.col("whole") + first.cast("long")).otherwise(0)).cast("long").alias("copies"), partial.alias("partial"),
    ).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.coalesce("partial", F.lit(0))).alias("taken"), "copies", F.coalesce("partial", F.lit(0)).alias("partial"))


def repeat(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: ``docs`` with each row as often as the mix takes it
    whole, under the same columns.  A last partial repetition counts as whole
    if it is at least half."""
    _, sources = plan_repetitions(docs, weights, max_epochs, seed)
    own, copy = fresh(docs, "mix_plan"), fresh(docs, "mix_copy")
    plan = sources.select(F.struct("source", "whole", "last_place", (2 * F.col("last_words") >= F.col("last_size")).alias("with_last")).alias(own))
    place = _place(docs["doc_id"], seed)
    joined = docs.join(plan, docs["source"].eqNullSafe(F.col(f"{own}.source")))
    more = F.coalesce((place < F.col(f"{own}.last_place")) | ((place == F.col(f"{own}.last_place")) & F.col(f"{own}.with_last")), F.lit(False))
    copies = F.when(words(docs["text"]) > 0, F.col(f"{own}.whole") + more.cast("long")).otherwise(0).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])
