"""Inputs on which an earlier round's plans failed or differed from their SQL."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kgweave.functions.language import Step
from kgweave.operators import answering, applying, dependencies, paths, reports, scoring, sets, support
from kgweave.sources import graph

METRICS = "rule_id long, body_size long, support long, smooth double"


def test_no_pair_that_gains_is_no_error(spark):
    """0 of 0 pairs: the share is NaN, as in the SQL."""
    metrics = spark.createDataFrame([(1, 10, 9, 0.5), (2, 10, 9, 0.5)], METRICS)
    pairs = spark.createDataFrame([(1, 2, 10, 5)], "a long, b long, body long, support long")
    for some in (pairs, pairs.limit(0)):
        for row in reports.capped_stability(some, metrics, (0.2, 0.5)).collect():
            assert row["both"] == 0 and math.isnan(row["jaccard"])


def test_longer_prefix_of_equal_told_mean_is_left(spark):
    """The SQL orders by the mean of six places, then by length."""
    import duckdb

    rows = [(k, 100 - k, 0, v) for k, v in enumerate((0.5, 0.5000004, 0.5000006, 0.5000007, 0.1))]
    got = reports.dense_prefix(spark.createDataFrame(rows, METRICS), "body_size", "smooth", "rule_id").first()
    con = duckdb.connect()
    con.sql("CREATE TABLE metrics (rule_id BIGINT, body_size BIGINT, support BIGINT, smooth DOUBLE)")
    con.sql(f"INSERT INTO metrics VALUES {', '.join(map(str, rows))}")
    from kgweave.plans import queries

    sql = queries.ORACLES["dense_prefix"]
    con.sql("CREATE TABLE told AS " + "SELECT nth" + sql[sql.rindex("SELECT nth") + len("SELECT nth") :])
    assert [tuple(got)] == con.sql("SELECT n, mean FROM told").fetchall() == [(1, 0.5)]


def most_rows(df) -> int:
    """The most rows that a part of the plan made, once it has run."""

    def nodes(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from nodes(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from nodes(p.plan())
        else:
            yield p
            below = p.children()
            for k in range(below.size()):
                yield from nodes(below.apply(k))

    df.collect()
    found = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan())]
    return max(m.get().value() for m in found if m.isDefined())


def test_golds_of_a_large_query_do_not_meet_its_candidates(spark):
    r = random.Random(1)
    scores = {f"c{k}": r.choice([0.0, 0.25, 0.5, 1.0]) for k in range(1000)}
    golds = [f"c{k}" for k in range(0, 1200, 4)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    gold = frame([("q", g) for g in golds], "x string, y string")
    got = answering.filtered_ranks(frame([("q", y, s) for y, s in scores.items()], "x string, y string, score double"), gold, gold, 1200)
    assert most_rows(got) < 3000
    other = [s for y, s in scores.items() if y not in set(golds) and s > 0]
    for row in got.collect():
        own = scores.get(row["y"], 0.0)
        above, same = sum(s > own for s in other), sum(s == own for s in other)
        assert row["rank"] == (above + (same + 2) / 2 if own else above + (1200 - above + 1) / 2)


def test_probe_of_a_crowded_middle_makes_no_walks(spark):
    triples = [(f"x{k}", "in", "n") for k in range(200)] + [(f"x{k}", "has", f"y{k % 5}") for k in range(3, 200)] + [("x0", "has", "z")]
    edges = graph.edges(spark.createDataFrame(triples, graph.TRIPLE))
    pairs = spark.createDataFrame([(f"x{k}", y) for k in range(200) for y in ("y1", "z")], "x string, y string")
    got = applying.holds(pairs, edges, (Step("in"), Step("in", True), Step("has")))
    assert {tuple(r) for r in got.collect()} == {(f"x{k}", y) for k in range(200) for y in ("y1", "z") if (k, y) != (0, "z")}
    assert most_rows(got) < 2000


def crowd(spark):
    """Rules with very many dependencies, of which a candidate has one at most."""
    rules = [(f"q{k}", "c", a, 1.0 + a / 100) for k in range(100) for a in (1 + k % 99, 100)]
    deps = [(a, b, -0.1 if (a + b) % 2 else 0.1) for a, b in itertools.combinations(range(1, 101), 2)]
    return spark.createDataFrame(rules, "x string, y string, rule_id long, evidence double"), spark.createDataFrame(deps, "a long, b long, lift double")


@pytest.mark.parametrize("name", ["greedy", "explain", "ratio", "coverage", "scores"])
def test_only_pairs_that_fire_together_are_rows(spark, name):
    fired, deps = crowd(spark)
    ends = sets.of_rows(fired)
    weights = fired.select("rule_id").distinct().selectExpr("rule_id", "0.5D AS w", "1.0D AS type_w", "0.5D AS conf")
    w = deps.withColumnRenamed("lift", "w")
    lift = lambda k: -0.1 if k % 2 else 0.1
    each = {
        "greedy": lambda s: dependencies.greedy_scores(fired, deps, "noisyor-dep"),
        "explain": lambda s: scoring.explain(fired, weights, w, sets=s).where("part = 'dependency'").select("x", "value"),
        "ratio": lambda s: dependencies.active(fired if s is None else s, deps).select("x", "lift"),
        "coverage": lambda s: reports.query_coverage(fired, deps, s).select("x", "pairs"),
        "scores": lambda s: scoring.linear_scores(fired, weights, w, sets=s).select("x", "dep_logit"),
    }[name]
    for s in (None, ends):
        got = each(s)
        # No part makes more rows than the 4950 dependencies themselves; 198 rules and 99 partners each would be twice that.
        assert most_rows(got) <= 4950
        found = {r[0]: r[-1] for r in got.collect()}
        for k in range(100):
            a = 1 + k % 99
            want = {"greedy": 1 + a / 100 + 2.0 - (1 + a / 100) * (lift(a) < 0), "coverage": 1}.get(name, lift(a))
            assert math.isclose(found[f"q{k}"], want, abs_tol=1e-9)


def test_many_dependencies_are_dealt_out(spark, monkeypatch):
    fired, deps = crowd(spark)
    one = sorted(map(tuple, dependencies.greedy_scores(fired, deps, "noisyor+dep").collect()))
    two = sorted(map(tuple, dependencies.active(fired, deps).collect()))
    monkeypatch.setattr(dependencies, "MOST_HANDED", 10)
    assert one == sorted(map(tuple, dependencies.greedy_scores(fired, deps, "noisyor+dep").collect()))
    assert two == sorted(map(tuple, dependencies.active(fired, deps).collect()))


def test_rules_by_candidate_equal_instances_of_each_rule(spark):
    r = random.Random(7)
    triples = sorted({(r.choice("abcdefgh"), r.choice("pqr"), r.choice("abcdefgh")) for _ in range(45)})
    edges = graph.edges(spark.createDataFrame(triples, graph.TRIPLE))
    rules = [(k, "const", h, rel, False, c) for k, (h, rel, c) in enumerate(itertools.product("uvh", "pq", "abc"), 1)]
    rules += [(30, "exists", "u", "p", False, None), (31, "exists", "v", "r", False, None), (40, "binary", None, "r", False, None), (41, "path", None, "p", False, None)]
    rules = spark.createDataFrame(rules, "rule_id long, kind string, head_const string, body_rel string, body_inv boolean, body_const string")
    path = (Step("p"), Step("q", True), Step("r"))
    facts = spark.createDataFrame([("a", "u"), ("b", "v"), ("c", "d"), ("zz", "u")], "x string, y string")
    one = paths.path_pairs(edges, [Step("r")])
    got = sets.held(rules, edges, {"binary": one.select("x", F.array("y").alias("ys")), "path": paths.witnessed_lists(edges, path)}, facts)
    want = {tuple(r) for r in paths.unary_rule_instances(rules.where("kind IN ('const', 'exists')"), edges).collect()}
    want |= {(40, *r) for r in one.collect()} | {(41, *r) for r in paths.path_pairs(edges, path).collect()}
    rows = got.collect()
    assert sorted((k, r["x"], r["y"]) for r in rows for k in r["rules"]) == sorted(want) and all(r["rules"] == sorted(r["rules"]) for r in rows)
    known = {tuple(r) for r in facts.collect()}
    assert all(bool(r["hit"]) == ((r["x"], r["y"]) in known) and r["hit"] is not None for r in rows)
    inst = sets.instances(got)
    assert sorted(map(tuple, support.set_metrics(got).collect())) == sorted(map(tuple, support.rule_metrics(inst, facts).collect()))
    few = rules.where("rule_id % 3 > 0")
    mine = inst.join(few.select("rule_id"), "rule_id", "left_semi")
    for least in (0, 1):
        assert sorted(map(tuple, dependencies.set_pair_counts(got, few, least).collect())) == sorted(map(tuple, dependencies.pair_counts(mine, facts, least).collect()))
