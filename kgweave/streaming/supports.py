"""Supports that follow a stream of facts, over Structured Streaming.

Facts (h, r, t, ts) arrive in any order; a watermark bounds how late they may be. Counts per relation and
window are incremental aggregations; facts that come again within the watermark count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = "h string, r string, t string, ts timestamp"


def event_facts(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A stream of (user, did, event type) facts from files of the events table."""
    events = spark.readStream.schema(schema).options(**options).parquet(path)
    return events.select(F.concat(F.lit("u:"), F.col("user_id")).alias("h"), F.lit("did").alias("r"), F.concat(F.lit("e:"), F.col("event_type")).alias("t"), "ts")


def distinct_facts(facts: DataFrame, late: str = "1 hour") -> DataFrame:
    return facts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["h", "r", "t"])


def relation_counts(facts: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """start, r, n, heads (approximate number of different heads) by window of event time."""
    grouped = facts.withWatermark("ts", late).groupBy(F.window("ts", window), "r")
    got = grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("heads"))
    return got.select(F.col("window.start").alias("start"), "r", "n", "heads")


def rule_hits(facts: DataFrame, rules: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """start, rule_id, n: facts that meet a unary rule's body (rules: rule_id, body_rel, body_const; a table), by window."""
    met = facts.withWatermark("ts", late).join(rules, (F.col("r") == F.col("body_rel")) & (F.col("t") == F.col("body_const")))
    got = met.groupBy(F.window("ts", window), "rule_id").agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), "rule_id", "n")
