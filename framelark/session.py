"""A session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "framelark", **conf: str) -> SparkSession:
    """The active session, or a new one in UTC with adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is
    unset, a temporary folder for a local session and the warehouse for a cluster."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        folder = tempfile.mkdtemp(prefix="framelark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framelark"
    return folder.rstrip("/")
