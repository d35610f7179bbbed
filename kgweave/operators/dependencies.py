"""Pairs of rules that fire together: supports, gains, log-odds, budgets, norms, greedy selections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import SMOOTH_MINED, confidence, evidence, gain, gain_legacy
from . import sets


def top_bodies(rules: DataFrame, k: int = 500, least_support: int = 5) -> DataFrame:
    """The k most confident rules of each head, of enough support."""
    order = Window.partitionBy("head").orderBy(F.col("conf").desc(), "rule_id")
    return rules.where(F.col("support") >= least_support).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def pair_counts(instances: DataFrame, facts: DataFrame, least: int = 1) -> DataFrame:
    """a < b, body (instances of both), support (those that are facts), from distinct rule_id, x, y.

    The self-join is on (x, y): one fact's or candidate's rules meet, never all instances of a rule.
    """
    hit = facts.select("x", "y").withColumn("hit", F.lit(1))
    left = instances.join(hit, ["x", "y"], "left").select("x", "y", F.col("rule_id").alias("a"), "hit")
    met = left.join(instances.select("x", "y", F.col("rule_id").alias("b")), ["x", "y"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("body"), F.count("hit").alias("support")).where(F.col("support") >= least)


def set_pair_counts(sets_: DataFrame, bodies: DataFrame, least: int = 1) -> DataFrame:
    """pair_counts() of the rules in bodies (rule_id, of a catalogue's size), from x, y, hit, rules."""
    # Equal sets of rules are counted before their pairs are made.
    equal = sets_.groupBy("rules", "hit").agg(F.count("*").alias("n"))
    got = sets.pairs(equal.select("rules", "n", F.when(F.col("hit"), F.col("n")).otherwise(0).alias("hits")), "n", "hits")
    counts = got.groupBy("a", "b").agg(F.sum("n").alias("body"), F.sum("hits").alias("support")).where(F.col("support") >= least)
    mine = bodies.select("rule_id")
    return counts.join(F.broadcast(mine.toDF("a")), "a", "left_semi").join(F.broadcast(mine.toDF("b")), "b", "left_semi").select("a", "b", "body", "support")


def pair_gains(pairs: DataFrame, metrics: DataFrame, formula: str = "unified", unseen: float = SMOOTH_MINED, cap: float = 7.0, least_gain: float = 0.0) -> DataFrame:
    """pairs with lift: the gain of both rules' evidence together. metrics: rule_id, body_size, support."""
    e = metrics.select("rule_id", evidence(confidence(F.col("support"), F.col("body_size"), unseen), cap).alias("e"), evidence(confidence(F.col("support"), F.col("body_size")), cap).alias("raw"))
    out = pairs.join(e.toDF("a", "e_a", "raw_a"), "a").join(e.toDF("b", "e_b", "raw_b"), "b")
    joint, raw = (evidence(confidence(F.col("support"), F.col("body"), u), cap) for u in (unseen, 0))
    a, b = F.col("e_a"), F.col("e_b")
    lift = gain(joint, a, b) if formula == "unified" else gain_legacy(joint, raw, a, b, F.col("raw_a"), F.col("raw_b"))
    return out.withColumn("lift", lift).where(F.abs("lift") >= least_gain).select("a", "b", "body", "support", "lift")


def split_kinds(deps: DataFrame, threshold: float = 0.0) -> DataFrame:
    """kind: synergy above the threshold, redundancy below its negative; others left out."""
    kind = F.when(F.col("lift") > threshold, "synergy").when(F.col("lift") < -threshold, "redundancy")
    return deps.withColumn("kind", kind).where("kind IS NOT NULL")


def pair_support(fired_rules: DataFrame, least: int = 1) -> DataFrame:
    """a < b, n: candidates in which both fire."""
    met = fired_rules.select("x", "y", F.col("rule_id").alias("a")).join(fired_rules.select("x", "y", F.col("rule_id").alias("b")), ["x", "y"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pair_log_odds(fired_rules: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, pos, neg, log_odds = ln((pos + 1) / (neg + 1)). labels: x, y, label."""
    left = fired_rules.join(labels.select("x", "y", "label"), ["x", "y"]).select("x", "y", "label", F.col("rule_id").alias("a"))
    met = left.join(fired_rules.select("x", "y", F.col("rule_id").alias("b")), ["x", "y"]).where("a < b")
    counts = met.groupBy("a", "b").agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    return counts.withColumn("log_odds", F.log((F.col("pos") + 1) / (F.col("neg") + 1)))


def ranked(deps: DataFrame, mode: str, group: str = "rel") -> DataFrame:
    """pos, the place within the group: by |lift|, by |log_odds|, or both in turn (mix), lift first."""
    by = lambda c: Window.partitionBy(group).orderBy(F.abs(c).desc(), "a", "b")
    if mode in ("lift", "log_odds"):
        return deps.withColumn("pos", F.row_number().over(by(mode)))
    places = deps.withColumn("p", 2 * F.row_number().over(by("lift")) - 1).withColumn("q", 2 * F.row_number().over(by("log_odds")))
    first = Window.partitionBy(group).orderBy(F.least("p", "q"), "a", "b")
    return places.withColumn("pos", F.row_number().over(first)).drop("p", "q")


def within_budget(ranked_deps: DataFrame, limits: DataFrame, group: str = "rel") -> DataFrame:
    """The first `limit` pairs of each group; limits: group, limit."""
    return ranked_deps.join(F.broadcast(limits), group).where("pos <= limit").drop("limit")


def top_per_rule(deps: DataFrame, k: int, *kinds: str) -> DataFrame:
    """Pairs among the k largest |lift| of either rule (of either rule and kind)."""
    ends = deps.select("*", F.explode(F.array("a", "b")).alias("end"))
    order = Window.partitionBy("end", *kinds).orderBy(F.abs("lift").desc(), "a", "b")
    return ends.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select(*deps.columns).distinct()


def degree_norms(deps: DataFrame) -> DataFrame:
    """norm = 1 / sqrt(degree of a * degree of b)."""
    degree = deps.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("d"))
    out = deps.join(degree.toDF("a", "d_a"), "a").join(degree.toDF("b", "d_b"), "b")
    return out.withColumn("norm", 1 / F.sqrt(F.col("d_a") * F.col("d_b"))).drop("d_a", "d_b")


def without_weak(deps: DataFrame, weights: DataFrame, part: float = 0.01) -> DataFrame:
    """Pairs of which neither rule's weight is under the part of the largest."""
    strong = weights.crossJoin(F.broadcast(weights.agg(F.max("w").alias("top")))).where(F.col("w") >= F.col("top") * part).select("rule_id")
    return deps.join(strong.toDF("a"), "a", "left_semi").join(strong.toDF("b"), "b", "left_semi")


#: Dependencies that are handed to every task; more are dealt out.
MOST_HANDED = 200_000


def active(fired_rules: DataFrame, deps: DataFrame) -> DataFrame:
    """x, y, a, b, lift: dependencies (a < b) of which both rules fire for a candidate.

    fired_rules: x, y, rule_id, or x, y, rules (sorted arrays). A candidate's rules meet in its row, and the pairs look up
    their dependency where they are made.
    """
    rows = fired_rules if "rules" in fired_rules.columns else sets.of_rows(fired_rules)
    met = sets.pairs(rows, "x", "y")
    few = len(deps.select("a").take(MOST_HANDED + 1)) <= MOST_HANDED
    return met.join(F.broadcast(deps) if few else deps, ["a", "b"]).select("x", "y", "a", "b", "lift")


def triples_of_rules(fired_rules: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """a < b < c, n (candidates in which all fire), pos (those labelled 1)."""
    r = lambda c: fired_rules.select("x", "y", F.col("rule_id").alias(c))
    met = r("a").join(r("b"), ["x", "y"]).where("a < b").join(r("c"), ["x", "y"]).where("b < c").join(labels.select("x", "y", "label"), ["x", "y"])
    return met.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).where(F.col("n") >= least)


#: Greedy ways in which dependencies change a noisy-or; each handles one candidate at a time.
GREEDY = ("noisyor+dep", "noisyor+match", "noisyor-dep", "noisyor-match")


def greedy_scores(fired_rules: DataFrame, deps: DataFrame, mode: str, most: int | None = None) -> DataFrame:
    """x, y, score. fired_rules: x, y, rule_id, evidence; deps: a, b, lift.

    +dep: rules by descending evidence each take the free partner of the largest positive lift, whose
    lift is added. +match: positive pairs by descending lift, disjoint. -dep: a rule is dropped if a stronger
    kept rule makes it redundant (negative lift). -match: of disjoint redundant pairs by ascending
    lift the weaker rule is dropped. most: pairs at most.
    """
    # Candidates' rules come as arrays, so that each row is solved alone in its batch; few dependencies go along with the code.
    r = fired_rules.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct((-F.col("evidence")).alias("e"), "rule_id"))).alias("r"))
    r = r.select("x", "y", F.col("r.rule_id").alias("r"), F.col("r.e").alias("e"))
    mine = deps.where(F.col("lift") > 0 if "+" in mode else F.col("lift") < 0).select("a", "b", "lift")
    handed = mine.take(MOST_HANDED + 1)
    table: dict[int, dict[int, float]] | None = None
    if len(handed) <= MOST_HANDED:
        table = {}
        for p in handed:
            table.setdefault(p["a"], {})[p["b"]] = p["lift"]
    else:
        d = active(fired_rules, mine).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("a", "b", "lift"))).alias("d"))
        r = r.join(d, ["x", "y"], "left")

    def met(rules: list[int]) -> list[dict]:
        own = sorted(rules)
        return [{"a": a, "b": b, "lift": mates[b]} for a in own if (mates := table.get(a)) for b in own if b in mates]

    def solve(rules: list[int], minus: list[float], pairs: list) -> float:
        strength = {k: -e for k, e in zip(rules, minus)}
        total = sum(strength.values())
        partners: dict[int, dict[int, float]] = {}
        for p in pairs:
            partners.setdefault(p["a"], {})[p["b"]] = partners.setdefault(p["b"], {})[p["a"]] = p["lift"]
        used: set[int] = set()
        taken = 0
        order = rules
        if mode.endswith("match"):
            for p in sorted(pairs, key=lambda p: (-abs(p["lift"]), p["a"], p["b"])):
                if (most is None or taken < most) and p["a"] not in used and p["b"] not in used:
                    used |= {p["a"], p["b"]}
                    taken += 1
                    total += p["lift"] if "+" in mode else -min(strength[p["a"]], strength[p["b"]])
            return total
        for k in order:
            if most is not None and taken >= most:
                break
            if "+" in mode:
                free = [(-v, j) for j, v in partners.get(k, {}).items() if j not in used]
                if k not in used and free:
                    v, j = min(free)
                    used |= {k, j}
                    taken += 1
                    total -= v
            elif any(j in used for j in partners.get(k, {})):
                total -= strength[k]
                taken += 1
            else:
                used.add(k)
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = []
            for k, (r, e) in enumerate(zip(b["r"], b["e"])):
                rules, minus = r.tolist(), e.tolist()
                pairs = met(rules) if table is not None else list(b["d"][k]) if b["d"][k] is not None else []
                score.append(solve(rules, minus, pairs))
            yield pd.DataFrame({"x": b["x"], "y": b["y"], "score": score})

    return r.mapInPandas(run, "x string, y string, score double")
