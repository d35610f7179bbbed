import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.operators import stages, training

ROWS = "rel string, direction string, query string, cand string, rules array<long>, label int, part string"


@pytest.mark.parametrize("signed", [True, False])
def test_slope_equals_differences(signed):
    r = np.random.RandomState(1)
    rows = [np.array(sorted(r.choice(5, r.randint(0, 4), False)), int) for _ in range(30)]
    y, weight, w = r.randint(0, 2, 30).astype(float), r.uniform(1, 2, 30), r.uniform(0.2, 0.9, 5)
    sign, l1 = np.array([1.0, 1, 1, -1, 1]), np.array([0, 0, 0, 0.01, 0.01])
    loss = lambda w, b: stages.loss_and_slope(rows, y, weight, w, b, sign, signed, l1)[0]
    _, slope, slope_bias = stages.loss_and_slope(rows, y, weight, w, 0.3, sign, signed, l1)
    d = 1e-6
    for k, unit in enumerate(np.eye(5) * d):
        assert math.isclose(slope[k], (loss(w + unit, 0.3) - loss(w - unit, 0.3)) / (2 * d), abs_tol=1e-6)
    assert math.isclose(slope_bias, (loss(w, 0.3 + d) - loss(w, 0.3 - d)) / (2 * d), abs_tol=1e-6)


def test_validation_rank_equals_brute_force():
    r = random.Random(2)
    rows = [(r.randrange(6), r.randrange(2), r.choice([0.0, 0.5, 1.0])) for _ in range(60)]
    want = []
    for q, label, s in rows:
        if label:
            other = [v for p, l, v in rows if p == q and not l]
            want.append(1 / (1 + (sum(v > s for v in other) + sum(v >= s for v in other)) / 2))
    got = stages.filtered_mrr(*(np.array(c) for c in zip(*rows)))
    assert math.isclose(got, sum(want) / len(want))
    assert stages.filtered_mrr(np.empty(0, int), np.empty(0), np.empty(0)) == 0.0
    assert max(stages.looks(20, stages.CADENCE)) == 20 and min(stages.looks(20, stages.CADENCE)) == 4


def redundant(spark, rel="t"):
    """Either rule alone tells a gold; both together don't."""
    rows = []
    for k in range(40):
        part = "valid" if k % 2 else "train"
        rows += [(rel, "tail", f"q{k}", c, rules, label, part) for c, rules, label in (("a", [1], 1), ("b", [2], 1), ("c", [1, 2], 0), ("d", [3], 0))]
    start = spark.createDataFrame([(rel, k, 0.5) for k in (1, 2, 3)], "rel string, rule_id long, w double")
    deps = spark.createDataFrame([(rel, 1, 2, -0.4), (rel, 1, 9, 0.3)], "rel string, a long, b long, lift double")
    return spark.createDataFrame(rows, ROWS), start, deps


PLAN = stages.Stages(epochs=60, batch=20, rate=0.3)


def test_second_stage_is_kept_where_it_ranks_better(spark):
    got = stages.train_stages(*redundant(spark), PLAN).collect()
    assert {r["stage"] for r in got} == {"dependencies"}
    assert got[0]["mrr_dependencies"] > got[0]["mrr_rules"]
    dep = [r for r in got if r["kind"] == "dependency"]
    assert [(r["a"], r["b"]) for r in dep] == [(1, 2)] and dep[0]["effective"] < 0
    assert sum(r["kind"] == "bias" for r in got) == 1 and all(r["effective"] >= 0 for r in got if r["kind"] == "rule")


def test_first_stage_stays_without_dependencies(spark):
    rows, start, deps = redundant(spark)
    got = stages.train_stages(rows, start, deps.where("a = 2"), PLAN).collect()
    assert {r["stage"] for r in got} == {"rules"} and {r["kind"] for r in got} == {"rule", "bias"}


def test_frozen_rules_keep_the_weights_of_the_first_stage(spark):
    rows, start, deps = redundant(spark)
    weights = lambda d, p: {r["a"]: r["raw"] for r in stages.train_stages(rows, start, d, p).collect() if r["kind"] == "rule"}
    frozen = stages.Stages(epochs=60, batch=20, rate=0.3, freeze=True)
    assert weights(deps, frozen) == weights(deps.where("a = 2"), PLAN)


def test_directions_and_empty_relations(spark):
    rows, start, deps = redundant(spark)
    each = stages.Stages(epochs=8, batch=20, rate=0.3, directional=True)
    turned = rows.withColumn("direction", F.lit("head"))
    got = stages.train_stages(rows.unionByName(turned), start, deps, each).collect()
    assert {r["direction"] for r in got} == {"head", "tail"}
    bare = stages.train_stages(rows.limit(0), start, deps).collect()
    assert {r["a"]: r["raw"] for r in bare if r["kind"] == "rule"} == {1: 0.5, 2: 0.5, 3: 0.5}
    assert stages.train_stages(rows, start.limit(0), deps.limit(0)).collect() == []


def test_acceptance_is_strict(spark):
    one = spark.createDataFrame([("r", 0.5), ("s", 0.5), ("t", 0.5)], "rel string, mrr double")
    two = spark.createDataFrame([("r", 0.6), ("s", 0.5)], "rel string, mrr double")
    assert {r["rel"]: r["final"] for r in training.accepted(one, two).collect()} == {"r": "dependencies", "s": "rules", "t": "rules"}
