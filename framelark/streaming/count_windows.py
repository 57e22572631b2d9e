"""Windows of a fixed number of messages over a stream.

State of a capture: its last window - 1 messages and their positions, a table for each
micro-batch.  A micro-batch is ordered by (t_us, seq) within its capture; messages of
a later micro-batch follow those of an earlier one.  Windows of a micro-batch are those
of the batch operators, so that no task holds a whole capture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import helpers, moments
from ..operators.stream import SLICE_US, WINDOW, positions
from ..operators.windows import frames
from ..session import shared_dir

RESULT = "capture long, pos long, window_duration double, iat_mean double, iat_min double, iat_max double, n_unique_ids double, y int"
STATE = "capture long, t_us long, can_id long, label int, pos long"


def _placed(batch: DataFrame, held: DataFrame, place: DataFrame) -> DataFrame:
    """``place``d rows of a micro-batch behind what its captures had before."""
    before = held.groupBy("capture").agg((F.max("pos") + 1).alias("before"))
    return place.join(F.broadcast(before), "capture", "left").withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0)))


def count_windows(batch: DataFrame, held: DataFrame, window: int = WINDOW, slice_us: int = SLICE_US) -> DataFrame:
    """Messages of a micro-batch (capture, t_us, can_id, label, seq) and the state before it -> a row for each new window."""
    fields = ["capture", "t_us", "can_id", "label", "pos"]
    new = _placed(batch, held, positions(batch, slice_us)).select(*fields)
    framed = frames(held.select(*fields).unionByName(new), ["t_us", "can_id", "label"], window)
    told = helpers(F.col("frame"))
    framed = framed.select("capture", "pos", *[told[k].alias(k) for k in ("gaps", "counts", "duration", "y")])
    framed = framed.select("*", moments()["gaps_mean"].alias("mean"))
    ends = F.array_min, F.array_max
    made = framed.select("capture", "pos", F.col("duration").alias("window_duration"), F.col("mean").alias("iat_mean"), *[f("gaps").alias(k) for f, k in zip(ends, ("iat_min", "iat_max"))], F.size("counts").cast("double").alias("n_unique_ids"), "y")
    if window > 1:
        return made
    before = held.groupBy("capture").agg((F.max("pos") + 1).alias("before"))
    return made.join(F.broadcast(before), "capture", "left").where("before is null or pos >= before").drop("before")


def last_messages(batch: DataFrame, held: DataFrame, window: int = WINDOW) -> DataFrame:
    """The state after a micro-batch."""
    keep = max(window - 1, 1)
    late = Window.partitionBy("capture").orderBy(F.desc("t_us"), F.desc("seq"))
    counts = batch.groupBy("capture").agg(F.count("*").alias("n"))
    tail = batch.withColumn("back", F.row_number().over(late)).where(F.col("back") <= keep).join(F.broadcast(counts), "capture").withColumn("pos", F.col("n") - F.col("back"))
    both = held.unionByName(_placed(batch, held, tail).select(*held.columns))
    latest = Window.partitionBy("capture").orderBy(F.desc("pos"))
    return both.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= keep).drop("back")


def drain(messages: DataFrame, window: int = WINDOW, slice_us: int = SLICE_US, name: str = "windows") -> DataFrame:
    """The windows of all messages that a streaming frame has by now."""
    spark = messages.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    done = [-1]
    for kind, schema in (("out", RESULT), ("held", STATE)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{kind}/-1")

    def step(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes the same tables again.
        own = batch.sparkSession
        before = own.read.schema(STATE).parquet(f"{base}/held/{max(d for d in done if d < number)}")
        rows = batch.select(F.col("capture").cast("long").alias("capture"), "t_us", F.col("can_id").cast("long").alias("can_id"), F.col("label").cast("int").alias("label"), "seq")
        count_windows(rows, before, window, slice_us).write.mode("overwrite").parquet(f"{base}/out/{number}")
        last_messages(rows, before, window).write.mode("overwrite").parquet(f"{base}/held/{number}")
        if number not in done:
            done.append(number)

    messages.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(RESULT).parquet(*[f"{base}/out/{number}" for number in done])
