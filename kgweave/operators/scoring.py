"""Linear scores of candidates from rule and dependency weights, and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import sigmoid
from .dependencies import active


def rule_part(fired_rules: DataFrame, weights: DataFrame) -> DataFrame:
    """x, y, rule_logit = sum of w^2 * type weight, conf = largest of the fired rules. weights: rule_id, w, type_w, conf."""
    got = fired_rules.select("x", "y", "rule_id").join(weights.select("rule_id", "w", "type_w", "conf"), "rule_id")
    return got.groupBy("x", "y").agg(F.sum(F.col("w") * F.col("w") * F.col("type_w")).alias("rule_logit"), F.max("conf").alias("conf"))


def dynamic_norm(n: Column, mode: str = "sqrt") -> Column:
    root = {"none": F.lit(1.0), "sqrt": F.sqrt(n), "log": F.log1p(n)}[mode]
    return F.greatest(root, F.lit(1.0))


def dep_part(fired_rules: DataFrame, deps: DataFrame, norm: str = "sqrt") -> DataFrame:
    """x, y, dep_logit = sum of the active pairs' weights over the norm of their number. deps: a, b, lift (as weight w)."""
    got = active(fired_rules, deps.select("a", "b", F.col("w").alias("lift")))
    return got.groupBy("x", "y").agg((F.sum("lift") / dynamic_norm(F.count("*"), norm)).alias("dep_logit"))


def scale(raw: Column) -> Column:
    clamped = F.least(F.greatest(raw, F.lit(-7.0)), F.lit(7.0))
    return clamped * clamped


def linear_scores(fired_rules: DataFrame, weights: DataFrame, deps: DataFrame | None = None, bias: float = 0.0, norm: str = "sqrt", clip: float | None = 1.0, sets: DataFrame | None = None) -> DataFrame:
    """x, y, rule_logit, dep_logit, raw = sigmoid(logit), score = raw * conf.

    The dependency part stays within clip times the rule part's size (1e-6 at least). sets: the fired rules as x, y, rules,
    where they are at hand; rules without dependencies may be among them.
    """
    out = rule_part(fired_rules, weights)
    if deps is None:
        out = out.withColumn("dep_logit", F.lit(0.0))
    else:
        out = out.join(dep_part(fired_rules if sets is None else sets, deps, norm), ["x", "y"], "left").withColumn("dep_logit", F.coalesce("dep_logit", F.lit(0.0)))
        if clip is not None:
            bound = clip * F.greatest(F.abs("rule_logit"), F.lit(1e-6))
            out = out.withColumn("dep_logit", F.least(F.greatest(F.col("dep_logit"), -bound), bound))
    raw = sigmoid(F.col("rule_logit") + F.col("dep_logit") + bias)
    return out.select("x", "y", "rule_logit", "dep_logit", raw.alias("raw"), (raw * F.col("conf")).alias("score"))


def explain(fired_rules: DataFrame, weights: DataFrame, deps: DataFrame, bias: float = 0.0, sets: DataFrame | None = None) -> DataFrame:
    """x, y, part (bias, rule, dependency), a, b, value: the addends of a candidate's logit, before norm and clip. sets: as above."""
    rules = fired_rules.select("x", "y", "rule_id").join(weights, "rule_id").select("x", "y", F.lit("rule").alias("part"), F.col("rule_id").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("w") * F.col("w") * F.col("type_w")).alias("value"))
    pairs = active(fired_rules if sets is None else sets, deps.select("a", "b", F.col("w").alias("lift"))).select("x", "y", F.lit("dependency").alias("part"), "a", "b", F.col("lift").alias("value"))
    intercept = fired_rules.select("x", "y").distinct().select("x", "y", F.lit("bias").alias("part"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(float(bias)).alias("value"))
    return intercept.unionByName(rules).unionByName(pairs)
