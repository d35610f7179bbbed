"""Analytics of rules, queries and runs: histograms, percentiles, curves, tests, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy(column).agg(F.count("*").alias("n"))


def distribution(values: DataFrame, column: str, points: Sequence[float] = (0.5, 0.95, 0.99), *keys: str) -> DataFrame:
    """n, mean, each percentile (linear between neighbours) as pNN, most."""
    at = [F.percentile(column, F.lit(p)).alias(f"p{p * 100:g}".replace(".", "_")) for p in points]
    return values.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), *at, F.max(column).alias("most"))


def average_ranks(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """avg_rank: 1-based, ties at their mean; pct = (avg_rank - 1) / (n - 1).

    Equal values are counted first, so windows run over distinct values only.
    """
    each = values.groupBy(*keys, column).agg(F.count("*").alias("ties"))
    before = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    each = each.withColumn("less", F.coalesce(F.sum("ties").over(before), F.lit(0))).withColumn("all", F.sum("ties").over(whole))
    each = each.withColumn("avg_rank", F.col("less") + (F.col("ties") + 1) / 2)
    each = each.withColumn("pct", F.when(F.col("all") > 1, (F.col("avg_rank") - 1) / (F.col("all") - 1)).otherwise(F.lit(0.0)))
    return values.join(each.select(*keys, column, "avg_rank", "pct"), [*keys, column])


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row: spearman, the correlation of average ranks."""
    ranked = average_ranks(values.select(a, b), a).withColumnRenamed("avg_rank", "rank_a").drop("pct")
    ranked = average_ranks(ranked, b).withColumnRenamed("avg_rank", "rank_b")
    return ranked.agg(F.corr("rank_a", "rank_b").alias("spearman"))


def coverage_curve(values: DataFrame, order: str, value: str, key: str, steps: int = 50) -> DataFrame:
    """coverage, n, mean of `value` over the first n = max(1, round(N * coverage)) rows by descending order, then key.

    Rows take part in sums by their place; places come from counts of distinct order values.
    """
    total = values.agg(F.count("*").alias("total"))
    nth = Window.orderBy(F.col(order).desc(), key)
    placed = values.select(key, order, value).withColumn("nth", F.row_number().over(nth)).withColumn("sum", F.sum(value).over(nth.rowsBetween(Window.unboundedPreceding, 0)))
    spark = values.sparkSession
    grid = spark.range(1, steps + 1).select((F.col("id") / steps).alias("coverage")).crossJoin(F.broadcast(total))
    grid = grid.withColumn("n", F.greatest(F.lit(1), F.bround(F.col("total") * F.col("coverage"), 0)).cast("long"))
    return grid.join(placed, F.col("n") == F.col("nth")).select("coverage", "n", (F.col("sum") / F.col("n")).alias("mean"))


def top_stats(values: DataFrame, column: str, ks: Sequence[int], *keys: str) -> DataFrame:
    """Sums and means of the k largest values of each group."""
    v = F.sort_array(F.collect_list(column), False)
    got = values.groupBy(*keys).agg(v.alias("v"))
    cols = []
    for k in ks:
        part = F.slice("v", 1, k)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
        cols += [total.alias(f"sum_{k}"), (total / F.size(part)).alias(f"mean_{k}")]
    return got.select(*keys, *cols)


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """p_holm: step-down adjusted, at most 1. tests: name, p (few rows)."""
    order = Window.orderBy(p, "name")
    m = F.count("*").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = tests.withColumn("scaled", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return steps.withColumn("p_holm", F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def paired_summary(changes: DataFrame, *keys: str) -> DataFrame:
    """n, wins, ties, losses, mean_before, mean_after, mean_delta, t of rows with rr_before, rr_after, delta."""
    d = F.col("delta")
    return changes.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d == 0, 1)).alias("ties"), F.count(F.when(d < 0, 1)).alias("losses"),
        F.avg("rr_before").alias("mean_before"), F.avg("rr_after").alias("mean_after"), F.avg(d).alias("mean_delta"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"),
    )


def delta_counts(changes: DataFrame) -> DataFrame:
    """Distinct deltas (rounded to nine places) and how often they occur: what resampling needs."""
    return changes.groupBy(F.round("delta", 9).alias("delta")).agg(F.count("*").alias("n"))


def bootstrap_interval(changes: DataFrame, turns: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: low, high of the mean delta, by multinomial draws over distinct deltas (which the driver holds)."""
    rows = sorted((r["delta"], r["n"]) for r in delta_counts(changes).collect())
    values, counts = np.array([v for v, _ in rows]), np.array([n for _, n in rows])
    total = counts.sum() if len(rows) else 0
    draws = np.random.RandomState(seed).multinomial(total, counts / total, turns) @ values / total if total else np.zeros(turns)
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return changes.sparkSession.createDataFrame([(float(low), float(high))], "low double, high double")


def sign_flip_p(changes: DataFrame, turns: int = 2000, seed: int = 0) -> DataFrame:
    """One row: p = (flips at least as far from 0 + 1) / (turns + 1)."""
    rows = sorted((r["delta"], r["n"]) for r in delta_counts(changes).collect())
    random = np.random.RandomState(seed)
    sums = np.zeros(turns)
    for v, n in rows:
        sums += v * (2 * random.binomial(n, 0.5, turns) - n)
    seen = abs(sum(v * n for v, n in rows))
    p = (int((np.abs(sums) >= seen - 1e-12).sum()) + 1) / (turns + 1)
    return changes.sparkSession.createDataFrame([(float(p),)], "p double")


def best_by(runs: DataFrame, group: str, by: str, name: str = "config") -> DataFrame:
    """The run with the largest `by` of each group; ties by name."""
    order = Window.partitionBy(group).orderBy(F.col(by).desc(), name)
    return runs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")


def safe_best(runs: DataFrame, group: str, by: str, fallback: str, margin: float, name: str = "config") -> DataFrame:
    """best_by(), but the fallback config unless the best beats it by the margin."""
    base = runs.where(F.col(name) == fallback).select(group, F.col(by).alias("base"))
    top = best_by(runs, group, by, name).join(base, group, "left")
    safe = F.when(F.col(by) - F.coalesce("base", F.lit(0.0)) >= margin, F.col(name)).otherwise(F.lit(fallback))
    return top.select(group, safe.alias(name)).join(runs, [group, name])


def weighted_mean(value: str, weight: str) -> Column:
    """Nulls and weights that aren't positive count for nothing."""
    use = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(use, F.col(value) * F.col(weight))) / F.sum(F.when(use, F.col(weight)))


def weight_stats(weights: DataFrame, w: str, *keys: str) -> DataFrame:
    x = F.col(w)
    near = lambda d: F.avg(F.when(F.abs(x) < d, 1.0).otherwise(0.0))
    return weights.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg(F.abs(x)).alias("mean_abs"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("positive"), near(0.01).alias("near_01"), near(0.05).alias("near_05"),
    )


def entropy(counts: DataFrame, n: str, *keys: str) -> DataFrame:
    """Normalised entropy of the counts of each group, and how many there are."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    got = counts.where(F.col(n) > 0).withColumn("p", share).groupBy(*keys).agg(F.count("*").alias("kinds"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    return got.select(*keys, "kinds", F.when(F.col("kinds") > 1, F.col("h") / F.log(F.col("kinds").cast("double"))).otherwise(F.lit(0.0)).alias("entropy"))


def jaccard_top(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: both, either, jaccard of the items of two tables of distinct rows."""
    one, two = a.select(key, item).withColumn("a", F.lit(1)), b.select(key, item).withColumn("b", F.lit(1))
    got = one.join(two, [key, item], "full_outer").groupBy(key).agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count("*").alias("either"))
    return got.withColumn("jaccard", F.col("both") / F.col("either"))


def log2_bins(counts: DataFrame, n: str) -> DataFrame:
    """bin = floor(log2(n)), groups: how many counts lie in it."""
    return counts.where(F.col(n) > 0).groupBy(F.floor(F.log2(n)).alias("bin")).agg(F.count("*").alias("groups"))


def query_features(scores: DataFrame, fired_rules: DataFrame) -> DataFrame:
    """Per query: candidates, firings, rules, top and second score, margin, mean, entropy of the softmax, effective candidates."""
    order = Window.partitionBy("x").orderBy(F.col("score").desc(), "y")
    s = scores.withColumn("nth", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("x")))
    e = F.exp(F.col("score") - F.col("top"))
    s = s.withColumn("e", e).withColumn("z", F.sum("e").over(Window.partitionBy("x"))).withColumn("p", F.col("e") / F.col("z"))
    got = s.groupBy("x").agg(
        F.count("*").alias("candidates"), F.max("score").alias("top"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("second"), F.avg("score").alias("mean"), F.sum(-F.col("p") * F.log("p")).alias("entropy")
    )
    f = fired_rules.groupBy("x").agg(F.count("*").alias("firings"), F.countDistinct("rule_id").alias("rules"))
    got = got.join(f, "x", "left").withColumn("margin", F.col("top") - F.coalesce("second", F.lit(0.0))).withColumn("effective", F.exp("entropy"))
    return got.select("x", "candidates", "firings", "rules", "top", "margin", "mean", "entropy", "effective")


def calibrated(values: DataFrame, group: str, predicted: str, true_means: DataFrame) -> DataFrame:
    """predicted shifted so that each group's mean is the true one. true_means: group, true_mean."""
    own = F.avg(predicted).over(Window.partitionBy(group))
    return values.withColumn("own", own).join(true_means, group).withColumn("calibrated", F.col(predicted) + F.col("true_mean") - F.col("own")).drop("own", "true_mean")
