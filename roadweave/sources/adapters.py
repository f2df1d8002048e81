"""Views of the given tables in the shapes that the operators expect, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a clip for each event type, seconds since 2024, three axes, a speed."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    cts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)
    return e.select("event_id", F.col("event_type").alias("clip_id"), cts.alias("cts"), F.col("value").alias("ax"), k.alias("ay"), (F.col("value") * k / 100).alias("az"), k.alias("speed_kmh"), "user_id")


TELEMETRY = """tele AS (SELECT event_id, event_type AS clip_id, epoch_us(ts) / 1e6 - 1704067200.0 AS cts, value AS ax,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ay, value * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS az,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS speed_kmh, user_id FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as video frames with a finding each."""
    t = telemetry(spark, sf_dir)
    zone = F.element_at(F.array(*map(F.lit, ("School", "Pedestrian Crossing", "Residential", "Highway", "Unknown"))), (F.col("user_id") % 5 + 1).cast("int"))
    return t.select(
        F.col("event_id").alias("frame_id"), "clip_id", F.col("cts").alias("frame_time"), (1 + F.col("user_id") % 4).cast("double").alias("severity"),
        ((F.col("ay") + 0.0317) / 100).alias("absence_confidence"), F.least(F.col("ax") / 200, F.lit(1.0)).alias("retrieval_score"), zone.alias("zone_type"),
    )


FRAMES = """frames AS (SELECT event_id AS frame_id, clip_id, cts AS frame_time, CAST(1 + user_id % 4 AS DOUBLE) AS severity, (ay + 0.0317) / 100 AS absence_confidence,
  least(ax / 200, 1.0) AS retrieval_score, ['School', 'Pedestrian Crossing', 'Residential', 'Highway', 'Unknown'][user_id % 5 + 1] AS zone_type FROM tele)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as verdicts with a cited clause."""
    line = table(spark, sf_dir, "lineitem")
    clause = F.concat(F.lit("IRC35_"), (F.col("l_suppkey") % 12).cast("string"), F.lit("."), (F.col("l_partkey") % 9).cast("string"))
    verdict = F.when(F.col("l_returnflag") == "R", "NON_COMPLIANT").when(F.col("l_returnflag") == "A", "COMPLIANT").otherwise("UNKNOWN")
    return line.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("long").alias("frame_id"), F.col("l_linestatus").alias("rule"), verdict.alias("verdict"), clause.alias("cited_clause"))


VERDICTS = """verdicts AS (SELECT l_orderkey AS event_id, CAST(l_linenumber AS BIGINT) AS frame_id, l_linestatus AS rule,
  CASE l_returnflag WHEN 'R' THEN 'NON_COMPLIANT' WHEN 'A' THEN 'COMPLIANT' ELSE 'UNKNOWN' END AS verdict,
  'IRC35_' || CAST(l_suppkey % 12 AS VARCHAR) || '.' || CAST(l_partkey % 9 AS VARCHAR) AS cited_clause FROM lineitem)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions: the status, shifted for every seventh order."""
    o = table(spark, sf_dir, "orders")
    shifted = F.when(F.col("o_orderstatus") == "F", "O").when(F.col("o_orderstatus") == "O", "P").otherwise("F")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 7 == 0, shifted).otherwise(F.col("o_orderstatus")).alias("pred"), F.col("o_orderpriority").alias("model"))


LABELS = """labelled AS (SELECT o_orderkey AS event_id, o_orderstatus AS gold, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus
  WHEN o_orderstatus = 'F' THEN 'O' WHEN o_orderstatus = 'O' THEN 'P' ELSE 'F' END AS pred, o_orderpriority AS model FROM orders)"""
