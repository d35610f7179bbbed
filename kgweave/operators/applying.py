"""Applying rules of any parsed form to a graph: candidates with the rules that fire for them, in both directions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import SELF, Rule
from .paths import body_instances, path_pairs, step_pairs, witnesses


def rule_instances(edges: DataFrame, rules: Mapping[int, Rule]) -> DataFrame:
    """rule_id, x, y of all bodies: y is the head's constant for unary rules, x itself for heads of one variable.

    Rules whose single body has the same path and kind are one plan, with their constants as rows of a table: there
    are as many plans as shapes, not rules. Bodies of several parts, and loops, are plans of their own.
    """
    spark = edges.sparkSession
    shapes: dict[tuple, list[tuple]] = defaultdict(list)
    parts = []
    for rule_id, rule in sorted(rules.items()):
        if len(rule.body) == 1 and rule.body[0].kind != "loop":
            atom = rule.body[0]
            shapes[atom.path, atom.kind, rule.head.kind].append((rule_id, atom.constant, rule.head.constant))
        elif rule.body:
            parts.append(body_instances(edges, rule).select(F.lit(rule_id).cast("long").alias("rule_id"), "x", "y"))
    for (path, kind, head), rows in shapes.items():
        pairs = path_pairs(edges, path)
        table = spark.createDataFrame(rows, "rule_id long, body_const string, head_const string")
        answer = {"binary": F.col("y"), "const": F.col("head_const"), "loop": F.col("x")}[head]
        if kind == "const":
            got = pairs.join(table, F.col("y") == F.col("body_const"))
        elif kind == "exists":
            got = pairs.select("x", F.lit(None).cast("string").alias("y")).distinct().crossJoin(F.broadcast(table))
        else:
            got = pairs.crossJoin(F.broadcast(table))
        parts.append(got.select("rule_id", "x", answer.alias("y")))
    return reduce(DataFrame.unionByName, parts)


def applied(edges: DataFrame, rules: Mapping[int, Rule], direction: str, known: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """query, cand, rules (sorted array) of every candidate, for tail queries (who is y of x?) or head queries (who is x of y?).

    known (x, y): candidates that are facts are left out. queries (query): only these. A head that is walked backwards has its
    variable as answer's side, so its pairs are turned.
    """
    turned = {k: r.head.path[0].inverse for k, r in rules.items()}
    pairs = rule_instances(edges, rules)
    back = F.col("rule_id").isin([k for k, t in turned.items() if t])
    pairs = pairs.select("rule_id", F.when(back, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(back, F.col("x")).otherwise(F.col("y")).alias("y"))
    if known is not None:
        pairs = pairs.join(known.select("x", "y"), ["x", "y"], "left_anti")
    query, cand = ("x", "y") if direction == "tail" else ("y", "x")
    pairs = pairs.select("rule_id", F.col(query).alias("query"), F.col(cand).alias("cand"))
    if queries is not None:
        pairs = pairs.join(queries.select("query").distinct(), "query", "left_semi")
    return pairs.groupBy("query", "cand").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def itself(candidates: DataFrame) -> DataFrame:
    """Candidates named by the self marker become the query's own entity; rules found under both names are put together."""
    named = candidates.withColumn("cand", F.when(F.col("cand") == SELF, F.col("query")).otherwise(F.col("cand")))
    return named.groupBy("query", "cand").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))


def holds(pairs: DataFrame, edges: DataFrame, path) -> DataFrame:
    """The pairs (x, y) that a path of two or more steps joins: the ways from x meet the ways from y in the middle."""
    if len(path) == 3:
        # The last two steps are summed up by (middle node, y), so no walk is a row.
        wanted = pairs.select("x", "y").where("x <> y").distinct().join(step_pairs(edges, path[0], "x", "a").where("x <> a"), "x")
        met = wanted.join(witnesses(edges, path), ["a", "y"])
        return met.where("least <> x OR most <> x").select("x", "y").distinct()
    middle = len(path) // 2
    first = step_pairs(edges, path[0], "x", "m") if middle == 1 else path_pairs(edges, path[:middle]).withColumnRenamed("y", "m")
    last = path_pairs(edges, path[middle:]).withColumnRenamed("x", "m")
    ways = pairs.select("x", "y").where("x <> y").distinct().join(first, "x").where("m <> x AND m <> y")
    met = ways.join(last, ["m", "y"])
    if len(path) > 3:
        # Inner nodes of both halves may coincide; the pairs that are left are walked out.
        from .paths import path_nodes

        exact = path_nodes(edges, path, met.select(F.col("x").alias("n0")).distinct()).select(F.col("n0").alias("x"), F.col(f"n{len(path)}").alias("y"))
        return met.select("x", "y").distinct().join(exact, ["x", "y"], "left_semi")
    return met.select("x", "y").distinct()
