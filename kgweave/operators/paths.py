"""Instances of rule bodies: paths through the graph whose nodes all differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import Atom, Rule, Step


def step_pairs(edges: DataFrame, step: Step, a: str, b: str) -> DataFrame:
    return edges.where((F.col("rel") == step.relation) & (F.col("inv") == step.inverse)).select(F.col("src").alias(a), F.col("dst").alias(b))


def path_nodes(edges: DataFrame, path: Sequence[Step], start: DataFrame | None = None) -> DataFrame:
    """n0 ... nk of every instance of the path, pairwise distinct. start: the n0 to begin with."""
    found = step_pairs(edges, path[0], "n0", "n1").where("n0 <> n1")
    if start is not None:
        found = found.join(start, "n0", "left_semi")
    for k, step in enumerate(path[1:], 1):
        apart = reduce(lambda x, y: x & y, [F.col(f"n{k + 1}") != F.col(f"n{j}") for j in range(k + 1)])
        found = found.join(step_pairs(edges, step, f"n{k}", f"n{k + 1}"), f"n{k}").where(apart)
    return found


def path_pairs(edges: DataFrame, path: Sequence[Step], start: DataFrame | None = None) -> DataFrame:
    """Distinct x, y that the path joins."""
    if len(path) == 1:
        pairs = step_pairs(edges, path[0], "x", "y").where("x <> y")
        return (pairs.join(start.toDF("x"), "x", "left_semi") if start is not None else pairs).distinct()
    if len(path) == 3 and start is None:
        return witnessed_pairs(edges, path)
    return path_nodes(edges, path, start).select(F.col("n0").alias("x"), F.col(f"n{len(path)}").alias("y")).distinct()


def witnesses(edges: DataFrame, path: Sequence[Step]) -> DataFrame:
    """a, y, least, most: the last two steps a, b, y of a path of three, summed up by their least and greatest b."""
    tail = step_pairs(edges, path[1], "a", "b").join(step_pairs(edges, path[2], "b", "y"), "b").where("a <> b AND b <> y AND a <> y")
    return tail.groupBy("a", "y").agg(F.min("b").alias("least"), F.max("b").alias("most"))


def witnessed_lists(edges: DataFrame, path: Sequence[Step]) -> DataFrame:
    """x, ys (array): witnessed_pairs() with a row for each first step x, a, so that an x may have several rows."""
    ends = witnesses(edges, path).groupBy("a").agg(F.collect_list(F.struct("y", "least", "most")).alias("ends"))
    met = step_pairs(edges, path[0], "x", "a").where("x <> a").join(ends, "a")
    good = F.filter("ends", lambda e: (e["y"] != F.col("x")) & ((e["least"] != F.col("x")) | (e["most"] != F.col("x"))))
    return met.select("x", F.transform(good, lambda e: e["y"]).alias("ys"))


def witnessed_pairs(edges: DataFrame, path: Sequence[Step]) -> DataFrame:
    """path_pairs() of three steps x, a, b, y without a row for each walk.

    The last two steps are summed up per (a, y) by their least and greatest b. Some b other than x is
    there unless both are x; the nodes' other differences are checked on the rows themselves.
    """
    met = step_pairs(edges, path[0], "x", "a").where("x <> a").join(witnesses(edges, path), "a")
    return met.where("x <> y AND (least <> x OR most <> x)").select("x", "y").distinct()


def atom_instances(edges: DataFrame, atom: Atom) -> DataFrame:
    """x, y of a binary atom; x alone of the others."""
    if atom.kind == "binary":
        return path_pairs(edges, atom.path)
    if atom.kind == "loop":
        if len(atom.path) == 1:
            return step_pairs(edges, atom.path[0], "x", "y").where("x = y").select("x").distinct()
        there = path_pairs(edges, atom.path[:-1])
        return there.join(step_pairs(edges, atom.path[-1], "y", "x"), ["x", "y"], "left_semi").select("x").distinct()
    pairs = step_pairs(edges, atom.path[0], "x", "y").where("x <> y") if len(atom.path) == 1 else path_pairs(edges, atom.path)
    if atom.kind == "const":
        pairs = pairs.where(F.col("y") == atom.constant)
    return pairs.select("x").distinct()


def body_instances(edges: DataFrame, rule: Rule) -> DataFrame:
    """x, y (the head's constant for unary rules; x again for loops) where all bodies hold."""
    found = reduce(lambda a, b: a.intersect(b), [atom_instances(edges, atom) for atom in rule.body])
    if rule.head.kind == "binary":
        return found.select("x", "y")
    return found.select("x", (F.lit(rule.head.constant) if rule.head.kind == "const" else F.col("x")).alias("y"))


def head_instances(edges: DataFrame, rule: Rule) -> DataFrame:
    pairs = step_pairs(edges, rule.head.path[0], "x", "y")
    if rule.head.kind == "const":
        pairs = pairs.where(F.col("y") == rule.head.constant)
    return (pairs.where("x = y") if rule.head.kind == "loop" else pairs).distinct()


def unary_rule_instances(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """rule_id, x, y of all rules with one-step unary bodies at once, by joins on the rules' columns.

    rules: rule_id, head_const, body_rel, body_inv, kind (const or exists), body_const.
    """
    used = edges.where("src <> dst").join(F.broadcast(rules.select(F.col("body_rel").alias("rel"), F.col("body_inv").alias("inv")).distinct()), ["rel", "inv"], "left_semi")
    on = (F.col("body_rel") == F.col("rel")) & (F.col("body_inv") == F.col("inv"))
    const = rules.where("kind = 'const'").join(used, on & (F.col("body_const") == F.col("dst"))).select("rule_id", F.col("src").alias("x"), F.col("head_const").alias("y"))
    sources = used.select("rel", "inv", "src").distinct()
    exists = rules.where("kind = 'exists'").join(sources, on).select("rule_id", F.col("src").alias("x"), F.col("head_const").alias("y"))
    return const.distinct().unionByName(exists)


def sampled_walks(edges: DataFrame, path: Sequence[Step], most: int, seed: int = 0) -> DataFrame:
    """Approximate path_pairs(): of each node's steps at most `most` go on, chosen by a seeded hash."""
    from pyspark.sql import Window

    def some(k: int, step: Step) -> DataFrame:
        pairs = step_pairs(edges, step, f"n{k}", f"n{k + 1}")
        order = Window.partitionBy(f"n{k}").orderBy(F.xxhash64(F.lit(seed), F.col(f"n{k}"), F.col(f"n{k + 1}")), f"n{k + 1}")
        return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")

    found = some(0, path[0]).where("n0 <> n1")
    for k, step in enumerate(path[1:], 1):
        apart = reduce(lambda x, y: x & y, [F.col(f"n{k + 1}") != F.col(f"n{j}") for j in range(k + 1)])
        found = found.join(some(k, step), f"n{k}").where(apart)
    return found.select(F.col("n0").alias("x"), F.col(f"n{len(path)}").alias("y")).distinct()
