"""The ordered message stream: positions, caps, splits, folds and window starts.

Positions count the messages of a capture in the order (t_us, seq).  A capture is
cut into time slices; messages are numbered within a slice and slices are
offset by the running count before them, so that no task has to order a whole
capture.  The same holds for gaps since the last message of the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default length of a time slice.
SLICE_US = 600_000_000

# How much of a capture a split takes, and what a window spans.
FRACTIONS = {"train": 0.6, "val": 0.2, "test": 0.2}
WINDOW = 10
#: Window starts of a block that are made together.
CHUNK = 16_384


def clean(raw: DataFrame) -> DataFrame:
    """timestamp, can_id, dlc, label, capture, seq of the rows that have a time, an id
    of 0 or more and a label; a missing dlc is -1, a missing capture 0."""
    rows = raw.select(
        F.col("timestamp").try_cast("double").alias("timestamp"), F.col("can_id").try_cast("long").alias("can_id"), F.coalesce(F.col("dlc").try_cast("long"), F.lit(-1)).alias("dlc"),
        F.col("label").try_cast("tinyint").alias("label"), F.coalesce(F.col("capture").try_cast("long"), F.lit(0)).alias("capture"), "seq",
    )
    return rows.where("timestamp is not null and not isnan(timestamp) and label is not null and can_id >= 0")


def _sliced(messages: DataFrame, slice_us: int) -> DataFrame:
    return messages.withColumn("slice", F.floor(F.col("t_us") / slice_us).cast("long"))


def slices(messages: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """capture, can_id, slice, held, last: all that placing and timing ask of other slices, in one pass."""
    return _sliced(messages, slice_us).groupBy("capture", "can_id", "slice").agg(F.count("*").alias("held"), F.max("t_us").alias("last"))


def positions(messages: DataFrame, slice_us: int = SLICE_US, order: str = "seq", counted: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Adds ``pos``, 0 for the first message of its capture.  ``counted``: a cheaper plan
    of the same messages to count slices with; ``known``: their ``slices``, if at hand."""
    rows = _sliced(messages, slice_us)
    running = Window.partitionBy("capture").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    if known is None:
        counts = (rows if counted is None else _sliced(counted, slice_us)).groupBy("capture", "slice").agg(F.count("*").alias("held"))
    else:
        counts = known.groupBy("capture", "slice").agg(F.sum("held").alias("held"))
    offsets = counts.where("slice is not null").select("capture", "slice", F.coalesce(F.sum("held").over(running), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("capture", "slice").orderBy("t_us", order)
    return rows.join(offsets, ["capture", "slice"]).withColumn("pos", F.col("ahead") + F.row_number().over(within) - 1).drop("ahead", "slice")


def recurrence(messages: DataFrame, slice_us: int = SLICE_US, order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """Adds ``dt_us``, the time since the capture's last message of the same id; null for the first.
    ``known``: the ``slices`` of the messages, if at hand."""
    rows = _sliced(messages, slice_us)
    ends = (slices(messages, slice_us) if known is None else known).select("capture", "can_id", "slice", "last")
    earlier = ends.select("capture", "can_id", "slice", F.lag("last").over(Window.partitionBy("capture", "can_id").orderBy("slice")).alias("before"))
    within = Window.partitionBy("capture", "can_id", "slice").orderBy("t_us", order)
    joined = rows.join(earlier, ["capture", "can_id", "slice"])
    return joined.withColumn("dt_us", F.col("t_us") - F.coalesce(F.lag("t_us").over(within), F.col("before"))).drop("before", "slice")


def sizes(placed: DataFrame) -> DataFrame:
    """capture, n: messages of each capture."""
    return placed.groupBy("capture").agg(F.count("*").alias("n"))


def cap(placed: DataFrame, most: int) -> DataFrame:
    """The central block of every capture, in proportion to its size, if the stream
    has more than ``most`` messages; at least one message of each capture."""
    whole = sizes(placed).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    quota = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(most) * F.col("n") / F.col("total"), 0).cast("long")))
    share = whole.withColumn("quota", F.when(F.col("total") > most, quota).otherwise(F.col("n"))).withColumn("start", F.floor((F.col("n") - F.col("quota")) / 2))
    kept = placed.join(share.select("capture", "quota", "start"), "capture")
    return kept.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("quota"))).withColumn("pos", F.col("pos") - F.col("start")).drop("quota", "start")


def blocks(ranges: DataFrame, window: int = WINDOW, train: float = 0.6, val: float = 0.2, test: float = 0.2) -> DataFrame:
    """capture, n -> capture, split, start, stop: chronological blocks with a purge of
    window - 1 messages between them.  Captures of under 3 windows are left out."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("the fractions of a split must add up to 1")
    purge = window - 1
    usable = F.col("n") - 2 * purge
    n_train, n_val = (usable * train).cast("long"), (usable * val).cast("long")
    spans = F.array(
        F.struct(F.lit("train").alias("split"), F.lit(0).cast("long").alias("start"), n_train.alias("stop")),
        F.struct(F.lit("val").alias("split"), (n_train + purge).alias("start"), (n_train + purge + n_val).alias("stop")),
        F.struct(F.lit("test").alias("split"), (n_train + 2 * purge + n_val).alias("start"), F.col("n").cast("long").alias("stop")),
    )
    return ranges.where(usable >= 3 * window).select("capture", F.explode(spans).alias("b")).select("capture", "b.split", "b.start", "b.stop")


def window_counts(spans: DataFrame, window: int = WINDOW, step: int = 1) -> DataFrame:
    """Adds ``windows``: how many full windows start in a block."""
    return spans.withColumn("windows", F.greatest(F.lit(0), F.floor((F.col("stop") - F.col("start") - window) / step) + 1).cast("long"))


def starts(spans: DataFrame, window: int = WINDOW, step: int = 1, most: Column | None = None) -> DataFrame:
    """capture, split, pos of every window start; with ``most`` (per row of ``spans``),
    that many at even distances, the first and the last included.  Starts of a block are
    made by many tasks: rows of ``CHUNK`` of them are spread before they are told."""
    counted = window_counts(spans.distinct(), window, step).where("windows > 0")
    n = F.col("windows")
    m = n if most is None else F.least(n, most)
    first = F.explode(F.sequence(F.lit(0).cast("long"), m - 1, F.lit(CHUNK).cast("long")))
    chunks = counted.withColumn("m", m).withColumn("first", first)
    if most is None:
        chunks = chunks.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "capture", "split", "start", "first")
    picked = chunks.withColumn("j", F.explode(F.sequence("first", F.least(F.col("first") + CHUNK, F.col("m")) - 1)))
    even = F.when(F.col("m") >= n, F.col("j")).when(F.col("j") == F.col("m") - 1, F.when(F.col("m") == 1, 0).otherwise(n - 1)).otherwise(F.floor(F.col("j") * F.try_divide(n - 1, F.col("m") - 1)))
    return picked.select("capture", "split", (F.col("start") + step * even.cast("long")).alias("pos"))  # none twice: m <= n


def split_starts(spans: DataFrame, budget: dict[str, int], window: int = WINDOW, step: int = 1) -> DataFrame:
    """Window starts with at most ``budget`` windows of a split, shared equally by its blocks."""
    number = F.count("*").over(Window.partitionBy("split"))
    limit = F.lit(None).cast("long")
    for split, most in budget.items():
        limit = F.when(F.col("split") == split, F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("blocks")))).otherwise(limit)
    return starts(spans.withColumn("blocks", number), window, step, F.coalesce(limit, F.col("windows")))


def folds(rows: DataFrame, order: list[str], k: int, purge: int) -> DataFrame:
    """fold, row, role ('train' or 'test') over rows ordered by ``order``: contiguous
    test folds, training rows ``purge`` away from them at least; empty folds left out."""
    numbered = rows.withColumn("row", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    low, high = (F.floor(F.col("fold") * (F.col("n") / k)), F.when(F.col("fold") == k - 1, F.col("n")).otherwise(F.floor((F.col("fold") + 1) * (F.col("n") / k))))
    placed = each.withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    role = F.when((F.col("row") >= F.col("low")) & (F.col("row") < F.col("high")), "test").when((F.col("row") < F.col("low") - purge) | (F.col("row") >= F.col("high") + purge), "train")
    return placed.where("high > low").withColumn("role", role).where("role is not null").drop("n", "low", "high")
