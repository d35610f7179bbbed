"""Rules by candidate: one row holds all rules of a pair x, y, so that they meet without a join and are dealt out once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(rules: DataFrame, edges: DataFrame, whole: Mapping[str, DataFrame], facts: DataFrame) -> DataFrame:
    """x, y, hit (whether x, y is a fact), rules (sorted array) of every instance of a rule's body.

    rules: rule_id, kind, head_const, body_rel, body_inv, body_const; kinds const and exists have unary bodies of one
    step and a head's constant, each body and constant once. whole: by further kinds the x, ys (array) that their rules join.
    facts: x, y. Everything is put together by x; each x then meets the answers, of which a table holds the rule by body.
    """
    unary = rules.where("kind IN ('const', 'exists')")
    used = unary.select("body_rel", "body_inv").distinct().collect()
    among = reduce(Column.__or__, [(F.col("rel") == r["body_rel"]) & (F.col("inv") == r["body_inv"]) for r in used], F.lit(False))
    mine = edges.where(among & (F.col("src") != F.col("dst")))
    # Bodies and answers are of a catalogue's size.
    bodies = unary.select("kind", "body_rel", "body_inv", "body_const").distinct()
    bodies = bodies.withColumn("body", (F.row_number().over(Window.orderBy("kind", "body_rel", "body_inv", "body_const")) - 1))
    on = (F.col("body_rel") == F.col("rel")) & (F.col("body_inv") == F.col("inv"))
    const = mine.join(F.broadcast(bodies.where("kind = 'const'")), on & (F.col("body_const") == F.col("dst")))
    exists = mine.select("rel", "inv", "src").join(F.broadcast(bodies.where("kind = 'exists'")), on)
    none = F.lit(None).cast("array<string>")
    parts = [p.select(F.col("src").alias("x"), F.lit(-2).alias("of"), "body", none.alias("ys")) for p in (const, exists)]
    sources = [facts.select("x", F.array("y").alias("ys")), *whole.values()]
    parts += [p.select("x", F.lit(k - 1).alias("of"), F.lit(None).cast("int").alias("body"), "ys") for k, p in enumerate(sources)]
    ys = lambda k: F.flatten(F.collect_list(F.when(F.col("of") == k, F.col("ys")))).alias(f"ys{k + 1}")
    each = reduce(DataFrame.unionByName, parts).groupBy("x").agg(F.collect_set("body").alias("bodies"), *[ys(k - 1) for k in range(len(sources))])

    by_body = unary.withColumn("k", F.struct("kind", "body_rel", "body_inv", "body_const"))
    same = reduce(Column.__and__, [F.col(f"u.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("kind", "body_rel", "body_inv", "body_const")])
    table = by_body.alias("u").join(F.broadcast(bodies.alias("v")), same).select(F.col("u.head_const").alias("y"), "body", "rule_id")
    table = table.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("body", "rule_id"))).alias("m"), F.max("body").alias("last"))
    table = table.select("y", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.try_element_at("m", k)).alias("rule_of"))
    others = reduce(DataFrame.union, [p.select(F.explode("ys").alias("y")) for p in whole.values()], table.select("y").limit(0)).distinct()
    answers = table.join(others, "y", "full_outer")
    for k, kind in enumerate(whole):
        ids = rules.where(F.col("kind") == kind).agg(F.sort_array(F.collect_list("rule_id")).alias(f"ids{k + 1}"))
        answers = answers.crossJoin(F.broadcast(ids))
    found = [F.transform("bodies", lambda k: F.get("rule_of", k))]
    found += [F.when(F.array_contains(f"ys{k + 1}", F.col("y")), F.col(f"ids{k + 1}")).otherwise(F.array().cast("array<bigint>")) for k in range(len(whole))]
    found[0] = F.coalesce(F.array_compact(found[0]), F.array().cast("array<bigint>"))
    out = each.crossJoin(F.broadcast(answers)).select("x", "y", F.array_contains("ys0", F.col("y")).alias("hit"), F.sort_array(F.concat(*found)).alias("rules"))
    return out.where(F.size("rules") > 0)


def only(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows with only those rules (rule_id, of a catalogue's size and numbered from 1) that are given; rows with none are left out."""
    ids = {r["rule_id"] for r in rules.select("rule_id").collect()}
    among = F.lit([k in ids for k in range(max(ids, default=0) + 1)])
    return sets.withColumn("rules", F.filter("rules", lambda r: F.get(among, r.cast("int")))).where(F.size("rules") > 0)


def instances(sets: DataFrame) -> DataFrame:
    """rule_id, x, y."""
    return sets.select(F.explode("rules").alias("rule_id"), "x", "y")


def pairs(sets: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and a < b: each two rules of a row."""
    one = sets.select(*keep, "rules", F.posexplode("rules").alias("at", "a"))
    return one.select(*keep, "a", F.explode(F.slice("rules", F.col("at") + 2, F.size("rules"))).alias("b"))


def of_rows(fired_rules: DataFrame) -> DataFrame:
    """x, y, rules from distinct rows rule_id, x, y."""
    return fired_rules.groupBy("x", "y").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))
