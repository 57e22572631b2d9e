"""What the training-data operators share: reading tables, cutting lineage,
size-checked broadcasts and the batching of Arrow rows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space and the five ASCII line/tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the remainder of '' for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Where that is unset, a
    local session uses a temporary folder and a cluster its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = tempfile.mkdtemp(prefix="framelark-")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framelark"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; lost executors re-read it from there.

    A checkpoint keeps the size that the optimizer guessed for its plan.  Guesses of
    joins are products, so that a loop of them soon has the driver multiply numbers of
    millions of digits; the frame returned has no guess, and AQE goes by real sizes.
    """
    spark = df.sparkSession
    shared_dir(spark)
    held = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle and checkpoint files of frames that
    are no longer referenced; without it they stay until the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, label: str) -> str:
    """Write ``df`` as a table in the shared folder, removed when the driver ends; return its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a materialised ``df`` if it has ``max_rows`` rows at
    most; otherwise leave the join to a shuffle that AQE splits where it is skewed."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def least_by_hash(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` rows of every group whose doc_id has the least hash, repeated ids once.
    Counts of distinct ids in 4096 ranges of the hash tell which ranges hold them; only
    those are ranked."""
    hashed = rows.dropDuplicates([group, "doc_id"]).withColumn("_hash", F.xxhash64("doc_id")).withColumn("_range", F.shiftrightunsigned("_hash", 52))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = bounded(cut(counts.where(F.col("_before") < k).select(F.col(group).alias("_of"), F.col("_range").alias("_in"))), 100_000)
    near = hashed.join(ranges, (F.col(group) == F.col("_of")) & (F.col("_range") == F.col("_in")))
    order = Window.partitionBy(group).orderBy("_range", "_hash", "doc_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(*rows.columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, text: str | None = None, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice has ``rows`` rows and about ``chars`` bytes of ``text`` at most."""
    for batch in batches:
        sizes = batch.column(text).nbytes / max(1, batch.num_rows) if text else 0
        step = max(1, min(rows, int(chars / sizes) if sizes else rows))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
