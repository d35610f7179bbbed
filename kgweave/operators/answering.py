"""From instances of rules to candidates, scores, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import combine, sigmoid


def fired(instances: DataFrame, known: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """rule_id, x, y of the queries' candidates, without known facts."""
    out = instances
    if queries is not None:
        out = out.join(queries.select("x").distinct(), "x", "left_semi")
    return out.join(known.select("x", "y"), ["x", "y"], "left_anti") if known is not None else out


def top_rules(fired_rules: DataFrame, most: int, by: str = "conf") -> DataFrame:
    """At most so many rules of each candidate: by value, then rule_id."""
    order = Window.partitionBy("x", "y").orderBy(F.col(by).desc(), "rule_id")
    return fired_rules.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def candidates(fired_rules: DataFrame) -> DataFrame:
    """x, y, rules (sorted array) of each candidate."""
    return fired_rules.groupBy("x", "y").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def labelled(cands: DataFrame, facts: DataFrame) -> DataFrame:
    """Training rows: candidates with rules, label 1 where they are facts."""
    gold = facts.select("x", "y").withColumn("gold", F.lit(1))
    return cands.where(F.size("rules") > 0).join(gold, ["x", "y"], "left").select("x", "y", "rules", F.coalesce("gold", F.lit(0)).alias("label"))


def scored(fired_rules: DataFrame, mode: str, value: str = "evidence") -> DataFrame:
    """x, y, score from rows rule_id, x, y, evidence. Sums and maxima need no array, so they are summed on the map side."""
    if mode in ("max", "noisyor"):
        return fired_rules.groupBy("x", "y").agg((F.max if mode == "max" else F.sum)(value).alias("score"))
    values = F.sort_array(F.collect_list(value), False)
    return fired_rules.groupBy("x", "y").agg(values.alias("v")).select("x", "y", combine(mode)(F.col("v")).alias("score"))


def noisy_or_products(fired_rules: DataFrame, weight: str = "w") -> DataFrame:
    """1 - prod(1 - sigmoid(w)), in log space."""
    p = F.least(F.greatest(sigmoid(F.col(weight)), F.lit(1e-7)), F.lit(1 - 1e-7))
    return fired_rules.groupBy("x", "y").agg((1 - F.exp(F.sum(F.log1p(-p)))).alias("score"))


def frequency(triples: DataFrame) -> DataFrame:
    """entity, n: how often an entity is head or tail."""
    return triples.select(F.col("h").alias("entity")).unionAll(triples.select("t")).groupBy("entity").agg(F.count("*").alias("n"))


def top_answers(scores: DataFrame, freq: DataFrame, k: int = 10) -> DataFrame:
    """The k best answers of each query: by score, then frequency, then name. freq: of possible answers (entity, n)."""
    ordered = Window.partitionBy("x").orderBy(F.col("score").desc(), F.col("n").desc(), "y")
    named = scores.join(freq.withColumnRenamed("entity", "y"), "y", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return named.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("x", "y", "score", "rank")


def filtered_ranks(scores: DataFrame, golds: DataFrame, masked: DataFrame, n_entities: int | Column) -> DataFrame:
    """x, y, rank of every gold: among all entities, other golds of the query left out, ties at their mean.

    All entities that aren't candidates score 0, as do masked ones. With s > 0 and `others` candidates
    at s: rank = higher + (others + 2) / 2; with s = 0: rank = positive + (zeros + 1) / 2.
    masked: x, y of all known answers (golds included). A query without any candidate has rank null
    (reciprocal 0).
    """
    n_entities = n_entities if isinstance(n_entities, Column) else F.lit(n_entities)
    positive = scores.where("score > 0")
    open_ = positive.join(masked.select("x", "y"), ["x", "y"], "left_anti").select("x", F.col("score").alias("other"))
    own = golds.select("x", "y").join(positive.select("x", "y", "score"), ["x", "y"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    # Golds never meet candidates: a query's candidates are counted by score, and summed up from the largest score down.
    levels = open_.groupBy("x", F.col("other").alias("score")).agg(F.count("*").alias("n"))
    levels = levels.unionByName(own.select("x", "score", F.lit(0).cast("long").alias("n"))).groupBy("x", "score").agg(F.sum("n").alias("others"))
    above = Window.partitionBy("x").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = own.join(levels.withColumn("higher", F.coalesce(F.sum("others").over(above), F.lit(0))), ["x", "score"])
    some = scores.select("x").distinct().withColumn("some", F.lit(True))
    rank = F.when(F.col("score") > 0, F.col("higher") + (F.col("others") + 2) / 2).otherwise(F.col("higher") + (n_entities - F.col("higher") + 1) / 2)
    return counts.join(some, "x", "left").select("x", "y", "score", F.when(F.col("some"), rank).alias("rank"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1 / rank, F.lit(0.0))


def rank_metrics(ranks: DataFrame, *keys: str) -> DataFrame:
    """n, mrr, hits_1, hits_3, hits_10 over all golds, those without candidates included."""
    hits = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits_{k}")
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(reciprocal(F.col("rank"))).alias("mrr"), hits(1), hits(3), hits(10))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """x, y, rr_before, rr_after, delta; golds that only one side has count with reciprocal 0 on the other."""
    b = before.select("x", "y", reciprocal(F.col("rank")).alias("rr_before"))
    a = after.select("x", "y", reciprocal(F.col("rank")).alias("rr_after"))
    both = b.join(a, ["x", "y"], "full_outer").na.fill(0.0, ["rr_before", "rr_after"])
    return both.withColumn("delta", F.col("rr_after") - F.col("rr_before"))
