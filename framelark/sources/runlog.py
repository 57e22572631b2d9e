"""The run log and the sinks: JSON lines, tables as CSV and Markdown, feature files."""

from __future__ import annotations

import json
import os
import platform
import uuid
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import last_of

# The columns that lead a run table.
LEADING = (
    "run_id", "timestamp", "experiment", "arm", "arm_description", "dataset_train", "dataset_test", "evaluation_type", "seed", "feature_groups", "n_features", "model_family", "config_id",
    "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "mcc", "shap_consistency", "complexity", "fitness", "training_time_s", "inference_time_per_window_ms",
)


def new_session() -> str:
    """A name for one process's runs: its start in UTC and a random part, so that no other session has it."""
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:6]}"


def stamp(records: list[dict], experiment: str, session: str, first: int = 0) -> list[dict]:
    """Records with a run_id that no other session makes, the time and their place in
    the session, counted from ``first``."""
    now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
    return [{**r, "run_id": f"{experiment}-{session}-{k:05d}", "experiment": experiment, "session": session, "timestamp": now, "place": k} for k, r in enumerate(records, first)]


def environment() -> dict:
    """What a run's times depend on."""
    return {"python": platform.python_version(), "platform": platform.platform(), "processor": platform.processor() or "unknown", "cpu_count": os.cpu_count()}


def _lines(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r, sort_keys=True, default=str),) for r in records], "value string").coalesce(1)


def append(spark: SparkSession, records: list[dict], path: str) -> None:
    """Add records to the log."""
    _lines(spark, records).write.mode("append").text(path)


def save_records(spark: SparkSession, records: list[dict], path: str) -> None:
    """Records whose keys may differ, such as search traces, as JSON lines; nothing is written without records."""
    if records:
        _lines(spark, records).write.mode("overwrite").text(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All records; blank lines are left out, and so are malformed ones, with a warning that counts them."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    malformed = lines.where(F.from_json("value", "map<string,string>").isNull()).count()
    if malformed:
        warnings.warn(f"{path}: {malformed} malformed lines left out", stacklevel=2)
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def table(rows: DataFrame) -> DataFrame:
    """The last record of each run by time and place, leading columns first, the others by name."""
    kept = last_of(rows, "run_id", [c for c in ("timestamp", "place") if c in rows.columns] or ["run_id"])
    lead = [c for c in LEADING if c in rows.columns]
    return kept.select(*lead, *sorted(c for c in rows.columns if c not in lead))


def markdown(rows: DataFrame, caption: str = "") -> str:
    """A report table (tens of rows) as Markdown, numbers with four digits."""
    shown = rows.select(*[F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]).collect()
    head = [f"**{caption}**", ""] if caption else []
    body = ["| " + " | ".join("" if v is None else v for v in r) + " |" for r in shown]
    return "\n".join([*head, "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *body]) + "\n"


def save_table(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def save_features(rows: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "split")) -> None:
    """Feature rows by dataset and split; only partitions that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[c for c in by if c in rows.columns]).parquet(path)
