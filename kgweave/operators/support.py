"""Supports and confidences of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import SMOOTH_APPLIED, confidence, evidence


def rule_metrics(instances: DataFrame, facts: DataFrame, unseen: float = SMOOTH_APPLIED) -> DataFrame:
    """rule_id, body_size, support, head_size, conf, smooth, evidence, coverage.

    instances: distinct rule_id, x, y; facts: distinct x, y of the head's relation. Rules without
    instances have no row; head_size counts the facts with the rule's answer for unary rules.
    """
    known = facts.select("x", "y").withColumn("hit", F.lit(1))
    return counted(instances.join(known, ["x", "y"], "left"), unseen)


def set_metrics(sets: DataFrame, unseen: float = SMOOTH_APPLIED) -> DataFrame:
    """rule_metrics() from x, y, hit, rules: nothing is joined."""
    each = sets.select(F.when(F.col("hit"), 1).alias("hit"), F.explode("rules").alias("rule_id"))
    return counted(each, unseen)


def counted(rows: DataFrame, unseen: float) -> DataFrame:
    m = rows.groupBy("rule_id").agg(F.count("*").alias("body_size"), F.count("hit").alias("support"))
    smooth = confidence(F.col("support"), F.col("body_size"), unseen)
    return m.select("rule_id", "body_size", "support", confidence(F.col("support"), F.col("body_size")).alias("conf"), smooth.alias("smooth"), evidence(smooth).alias("evidence"))


def empty_body_metrics(heads: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules without body: rule_id, head_const -> body_size (all facts) and support (those with the constant)."""
    total = facts.agg(F.count("*").alias("body_size"))
    own = facts.groupBy(F.col("y").alias("head_const")).agg(F.count("*").alias("support"))
    return heads.join(own, "head_const").crossJoin(F.broadcast(total)).select("rule_id", "body_size", "support")
