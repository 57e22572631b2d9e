"""A synthetic capture: periodic senders with jitter, and bursts of injected frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BURSTS = 16


def capture(spark: SparkSession, periods_ms: dict[int, float], seconds: float, attack: str | None = None, share: float = 0.2, seed: int = 0, capture: int = 0, base_us: int = 1_478_198_000_000_000) -> DataFrame:
    """timestamp, t_us, can_id, dlc, label, capture, seq.  attack: flood (id 0), fuzz
    (any id) or spoof (the first sender's id), ``share`` of the frames in 16 bursts."""
    if attack not in (None, "flood", "fuzz", "spoof"):
        raise ValueError(f"unknown attack {attack!r}")
    parts = []
    noise = lambda k, *c: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *c), F.lit(1_000_000)) / 1e6
    for can_id, period in periods_ms.items():
        rows = spark.range(max(1, int(seconds * 1000 / period)))
        t = base_us + (F.col("id") * period + (noise(can_id, F.col("id")) - 0.5) * period * 0.1) * 1000
        parts.append(rows.select(t.cast("long").alias("t_us"), F.lit(can_id).cast("long").alias("can_id"), F.lit(can_id % 9).cast("long").alias("dlc"), F.lit(0).cast("tinyint").alias("label")))
    if attack:
        normal = sum(max(1, int(seconds * 1000 / p)) for p in periods_ms.values())
        count = int(normal * share / (1 - share))
        burst = F.col("id") % BURSTS
        t = base_us + ((burst + 0.25 + 0.5 * noise(-1, F.col("id"))) * (seconds / BURSTS)) * 1e6
        ident = {"flood": F.lit(0), "fuzz": F.floor(noise(-2, F.col("id")) * 2048), "spoof": F.lit(next(iter(periods_ms)))}[attack]
        parts.append(spark.range(count).select(t.cast("long").alias("t_us"), ident.cast("long").alias("can_id"), F.lit(8).cast("long").alias("dlc"), F.lit(1).cast("tinyint").alias("label")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.select((F.col("t_us") / 1e6).alias("timestamp"), "t_us", "can_id", "dlc", "label", F.lit(capture).cast("long").alias("capture"), F.xxhash64("t_us", "can_id", "label").alias("seq"))
