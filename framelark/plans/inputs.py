"""The engine's inputs, mapped from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices of the event stream: a day.
DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_columns(table(spark, sf_dir, "events"))


def message_columns(events: DataFrame) -> DataFrame:
    """events as a message stream: capture, can_id, t_us, dlc, label, seq.  Times
    without a zone are taken as UTC, whatever the session's zone."""
    t_us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return events.select(
        (F.col("user_id") % 4).alias("capture"), (F.floor(F.col("user_id") / 4) % 12).alias("can_id"), t_us.alias("t_us"),
        (F.get_json_object("props", "$.k").try_cast("int") % 9).alias("dlc"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("tinyint").alias("label"), F.col("event_id").alias("seq"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a run log."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("A"), (F.col("l_orderkey") % 9).cast("string")).alias("arm"), F.col("l_returnflag").alias("dataset_train"), F.col("l_linestatus").alias("dataset_test"),
        (F.col("l_suppkey") % 3).alias("seed"), (F.col("l_discount") * 10).alias("f1"), (F.col("l_tax") * 10).alias("accuracy"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scored windows: y, score with ties, predicted, a group."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.round("o_totalprice", -3).alias("score"),
        (F.col("o_totalprice") > 200000).cast("int").alias("predicted"), F.col("o_orderpriority").alias("grp"))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as importances: fold, feature, value."""
    long = table(spark, sf_dir, "embeddings").select(F.col("label").alias("fold"), F.posexplode("embedding").alias("feature", "v"))
    return long.groupBy("fold", "feature").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("value"))


MESSAGES_SQL = """messages AS (
  SELECT user_id % 4 AS capture, (user_id // 4) % 12 AS can_id, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS INTEGER) % 9 AS dlc,
         CAST(event_type = 'error' AND value > 100 AS TINYINT) AS label, event_id AS seq FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY t_us, seq) - 1 AS pos,
         t_us - lag(t_us) OVER (PARTITION BY capture, can_id ORDER BY t_us, seq) AS dt_us,
         (t_us - lag(t_us) OVER (PARTITION BY capture ORDER BY t_us, seq)) / 1e6 AS gap FROM messages)"""
RUNS_SQL = """runs AS (
  SELECT 'A' || CAST(l_orderkey % 9 AS VARCHAR) AS arm, l_returnflag AS dataset_train, l_linestatus AS dataset_test, l_suppkey % 3 AS seed,
         l_discount * 10 AS f1, l_tax * 10 AS accuracy, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)"""
SCORES_SQL = """scores AS (
  SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, round(o_totalprice, -3) AS score, CAST(o_totalprice > 200000 AS INTEGER) AS predicted, o_orderpriority AS grp FROM orders)"""
RANKS_SQL = """importances AS (
  SELECT label AS fold, feature, avg(abs(CAST(v AS DOUBLE))) AS value
  FROM (SELECT label, unnest(range(len(embedding))) AS feature, unnest(embedding) AS v FROM embeddings) GROUP BY label, feature),
ranks AS (
  SELECT fold, feature, rank() OVER (PARTITION BY fold ORDER BY value DESC) + (count(*) OVER (PARTITION BY fold, value) - 1) / 2.0 AS rank FROM importances),
pairs AS (
  SELECT a.fold AS a, b.fold AS b, a.feature, a.rank AS rank_a, b.rank AS rank_b FROM ranks a JOIN ranks b ON a.feature = b.feature AND a.fold < b.fold)"""
