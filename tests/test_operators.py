import itertools
import math
import random

from pyspark.sql import functions as F

from kgweave.functions import evidence as E
from kgweave.functions.language import Step, parse_rule
from kgweave.operators import analysis, answering, applying, dependencies, paths, support, training
from kgweave.sources import files, graph


def small_graph(seed=1):
    r = random.Random(seed)
    names = "abcdefgh"
    return sorted({(r.choice(names), r.choice("pqr"), r.choice(names)) for _ in range(40)})


def test_paths_of_three_steps_equal_brute_force(spark):
    triples = small_graph()
    edges = graph.edges(spark.createDataFrame(triples, graph.TRIPLE))
    has = {(h, x, t) for h, x, t in triples}
    path = (Step("p"), Step("q", True), Step("r"))
    walked = {(x, y) for x, a, b, y in itertools.product("abcdefgh", repeat=4) if len({x, a, b, y}) == 4 and (x, "p", a) in has and (b, "q", a) in has and (b, "r", y) in has}
    assert {tuple(r) for r in paths.path_pairs(edges, path).collect()} == walked
    start = spark.createDataFrame([("a",), ("b",)], "n0 string")
    assert {tuple(r) for r in paths.path_pairs(edges, path, start).collect()} == {p for p in walked if p[0] in "ab"}
    assert {tuple(r) for r in paths.sampled_walks(edges, path, 100).collect()} == walked


def test_body_instances_and_support(spark):
    triples = small_graph(2)
    edges = graph.edges(spark.createDataFrame(triples, graph.TRIPLE))
    has = set(triples)
    rule = parse_rule("p(X,Y) <= q(X,Y) && r(X,A), q(A,Y)")
    want = {(x, y) for x, y in itertools.product("abcdefgh", repeat=2) if x != y and (x, "q", y) in has and any((x, "r", a) in has and (a, "q", y) in has and len({x, a, y}) == 3 for a in "abcdefgh")}
    got = paths.body_instances(edges, rule)
    assert {tuple(r) for r in got.collect()} == want
    facts = paths.head_instances(edges, rule)
    m = support.rule_metrics(got.withColumn("rule_id", F.lit(1)), facts).collect()
    assert [(r["body_size"], r["support"]) for r in m] == ([(len(want), len({p for p in want if (p[0], "p", p[1]) in has}))] if want else [])
    loops = paths.atom_instances(edges, parse_rule("p(X,X) <= q(X,X)").body[0])
    assert {r["x"] for r in loops.collect()} == {h for h, x, t in triples if x == "q" and h == t}


def test_filtered_rank_equals_rank_over_all_entities(spark):
    r = random.Random(3)
    entities = [f"e{k}" for k in range(30)]
    scores, golds, masked = [], [], []
    for q in range(12):
        own = r.sample(entities, 6) if q else []
        scores += [(f"q{q}", e, r.choice([0.0, 0.25, 0.5, 0.5, 1.0])) for e in own]
        gold = r.sample(entities, 2)
        golds += [(f"q{q}", g) for g in gold]
        masked += [(f"q{q}", e) for e in {*gold, *r.sample(entities, 3)}]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = answering.filtered_ranks(frame(scores, "x string, y string, score double"), frame(golds, "x string, y string"), frame(masked, "x string, y string"), len(entities))
    table = {(x, y): s for x, y, s in scores}
    for row in got.collect():
        q, g = row["x"], row["y"]
        if not any(x == q for x, *_ in scores):
            assert row["rank"] is None
            continue
        own = table.get((q, g), 0.0)
        # All other golds and known answers fall to 0; ties share the mean of their places.
        values = [0.0 if (q, e) in masked else table.get((q, e), 0.0) for e in entities if e != g]
        assert row["rank"] == sum(v > own for v in values) + (sum(v == own for v in values) + 2) / 2


def test_evidence_and_buckets(spark):
    row = spark.range(1).select(E.evidence(F.lit(0.5)).alias("a"), E.evidence(F.lit(1.0)).alias("b"), E.confidence(F.lit(3), F.lit(0)).alias("c"), E.decayed(F.array(F.lit(2.0), F.lit(1.0)), 0.1).alias("d"), E.gain_bucket(F.lit(0.04)).alias("e"), E.count_band(F.lit(31)).alias("f"), E.quartile(F.lit(2), F.lit(1), F.lit(2), F.lit(3)).alias("g")).first()
    assert math.isclose(row["a"], math.log(2)) and row["b"] == 7.0 and row["c"] == 0.0 and math.isclose(row["d"], 2.1)
    assert (row["e"], row["f"], row["g"]) == ("positive", "<=60", "Q2")


def test_greedy_dependencies(spark):
    fired = spark.createDataFrame([("q", "c", k, e) for k, e in ((1, 3.0), (2, 2.0), (3, 1.0))], "x string, y string, rule_id long, evidence double")
    deps = spark.createDataFrame([(1, 2, 0.2), (2, 3, 0.5), (1, 3, -0.4)], "a long, b long, lift double")
    score = lambda mode: dependencies.greedy_scores(fired, deps, mode).first()["score"]
    assert math.isclose(score("noisyor+dep"), 6.2)  # rule 1 takes 2 first
    assert math.isclose(score("noisyor+match"), 6.5)  # the pair of 2 and 3 is larger
    assert math.isclose(score("noisyor-dep"), 5.0)
    assert math.isclose(score("noisyor-match"), 5.0)


def test_mixed_ranking_is_interleaving(spark):
    r = random.Random(5)
    rows = [("t", a, a + 1, round(r.uniform(-1, 1), 3), round(r.uniform(-1, 1), 3)) for a in range(20)]
    deps = spark.createDataFrame(rows, "rel string, a long, b long, lift double, log_odds double")
    got = [x["a"] for x in dependencies.ranked(deps, "mix").orderBy("pos").collect()]
    one = [x[1] for x in sorted(rows, key=lambda x: (-abs(x[3]), x[1]))]
    two = [x[1] for x in sorted(rows, key=lambda x: (-abs(x[4]), x[1]))]
    want = list(dict.fromkeys(k for pair in zip(one, two) for k in pair))
    assert got == want


def test_holm_spearman_and_average_ranks(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: round(r["p_holm"], 9) for r in analysis.holm(p).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    v = spark.createDataFrame([(1.0, 3.0), (1.0, 2.0), (2.0, 1.0)], "u double, v double")
    assert sorted(r["avg_rank"] for r in analysis.average_ranks(v, "u").collect()) == [1.5, 1.5, 3.0]
    assert math.isclose(analysis.spearman(v, "u", "v").first()["spearman"], -0.8660254037844387)


def test_training_lowers_the_loss_and_keeps_signs(spark):
    rows = spark.createDataFrame([("t", [1, 2], 1)] * 20 + [("t", [2], 0)] * 20, "rel string, rules array<long>, label int")
    start = spark.createDataFrame([("t", 1, 0.5), ("t", 2, 0.5)], "rel string, rule_id long, w double")
    got = {r["rule_id"]: r for r in training.train_rules(rows, start).collect()}
    assert got[1]["effective"] > got[2]["effective"] >= 0 and got[1]["loss_last"] < got[1]["loss_first"]


def test_resampling_is_seeded(spark):
    changes = spark.createDataFrame([("q", "g", 0.1, 0.1 + d, d) for d in (0.0, 0.5, 0.25, 0.0)], "x string, y string, rr_before double, rr_after double, delta double")
    assert analysis.bootstrap_interval(changes).first() == analysis.bootstrap_interval(changes).first()
    assert 0 < analysis.sign_flip_p(changes).first()["p"] <= 1


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "kg.txt").write_text("a\tr\tb\nbad line with four\nc r d\n")
    assert sorted(map(tuple, graph.read_triples(spark, str(tmp_path / "kg.txt")).collect())) == [("a", "r", "b"), ("c", "r", "d")]
    (tmp_path / "rules.txt").write_text("# note\n10\t5\t0.5\tr(X,Y) <= s(X,Y)\n\n4 1 0.25 r(X,c) <= s(X,A)\n")
    rules = {r["rule_id"]: r for r in files.read_rules(spark, str(tmp_path / "rules.txt")).collect()}
    assert sorted(rules) == [2, 4] and rules[4]["rule"] == "r(X,c) <= s(X,A)" and rules[2]["support"] == 5
    fired = spark.createDataFrame([("tail", "r", "a", "b", 2), ("tail", "r", "a", "c", 4), ("head", "r", "b", "a", 2)], files.FIRED)
    files.write_applied(fired, str(tmp_path / "applied"))
    assert sorted(map(tuple, files.read_applied(spark, str(tmp_path / "applied")).collect())) == sorted(map(tuple, fired.collect()))
    deps = spark.createDataFrame([(1, 2, 10, 5, 0.123456), (2, 3, 4, 2, -0.5)], "a long, b long, body long, support long, lift double")
    files.write_dependencies(deps, str(tmp_path / "deps"))
    back = {(r["a"], r["b"]): r["lift"] for k in ("synergy", "redundancy") for r in files.read_dependencies(spark, str(tmp_path / "deps" / k)).collect()}
    assert back == {(1, 2): 0.12346, (2, 3): -0.5}


def test_rules_of_every_form_equal_brute_force(spark):
    triples = small_graph(4)
    edges = graph.edges(spark.createDataFrame(triples, graph.TRIPLE))
    has, names = set(triples), "abcdefgh"
    texts = {1: "p(X,Y) <= q(X,A), r(A,Y)", 2: "p(X,a) <= q(X,A), r(A,X)", 3: "p(X,b) <= r(X,c)", 4: "p(X,X) <= r(X,A)", 5: "p(d,Y) <= q(A,Y)", 6: "p(X,Y) <= q(X,Y) && r(Y,X)"}
    want = {(1, x, y) for x, m, y in itertools.permutations(names, 3) if (x, "q", m) in has and (m, "r", y) in has}
    want |= {(2, x, "a") for x, m in itertools.permutations(names, 2) if (x, "q", m) in has and (m, "r", x) in has}
    want |= {(3, x, "b") for x in names if x != "c" and (x, "r", "c") in has}
    want |= {(4, x, x) for x, m in itertools.permutations(names, 2) if (x, "r", m) in has}
    want |= {(5, "d", y) for y, m in itertools.permutations(names, 2) if (m, "q", y) in has}
    want |= {(6, x, y) for x, y in itertools.permutations(names, 2) if (x, "q", y) in has and (y, "r", x) in has}
    rules = {k: parse_rule(t) for k, t in texts.items()}
    for direction in ("tail", "head"):
        got = applying.applied(edges, rules, direction).collect()
        found = {(k, *((r["query"], r["cand"]) if direction == "tail" else (r["cand"], r["query"]))) for r in got for k in r["rules"]}
        assert found == want
    queries = spark.createDataFrame([("a",)], "query string")
    assert {r["query"] for r in applying.applied(edges, rules, "tail", queries=queries).collect()} <= {"a"}


def test_pairs_that_a_path_joins(spark):
    edges = graph.edges(spark.createDataFrame(small_graph(5), graph.TRIPLE))
    every = spark.createDataFrame(list(itertools.product("abcdefgh", repeat=2)), "x string, y string")
    for path in ((Step("p"), Step("q")), (Step("p"), Step("q", True), Step("r"))):
        assert {tuple(r) for r in applying.holds(every, edges, path).collect()} == {tuple(r) for r in paths.path_pairs(edges, path).collect()}


def test_self_marker_becomes_the_query(spark):
    rows = spark.createDataFrame([("a", "me_myself_i", [2]), ("a", "a", [1]), ("b", "c", [3])], "query string, cand string, rules array<long>")
    assert sorted(map(tuple, applying.itself(rows).collect())) == [("a", "a", [1, 2]), ("b", "c", [3])]
