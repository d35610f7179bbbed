"""Training rows in blocks: one block at a time is in memory, and what comes out does not depend on how rows are dealt."""

import itertools
import random
import tempfile
import tracemalloc

import numpy as np
import pytest

from kgweave.operators import sets, stages

ROWS = "rel string, direction string, query string, cand string, rules array<long>, label int, part string"


def many(spark, n=60):
    """Of n queries in both directions, some candidates with random rules (9 is unknown), unsorted and with copies."""
    r, rows = random.Random(3), []
    for k, c in itertools.product(range(n), "abcdef"):
        row = ([r.choice((1, 2, 3, 4, 9)) for _ in range(r.randrange(5))], int(r.random() < 0.4), "valid" if k % 2 else "train")
        rows += [("t", "tail", f"q{k}", c, *row), ("t", "head", c, f"q{k}", *row)]
    start = spark.createDataFrame([("t", k, 0.2 * k) for k in (1, 2, 3, 4)], "rel string, rule_id long, w double")
    deps = spark.createDataFrame([("t", 1, 2, 0.4), ("t", 2, 4, -0.3)], "rel string, a long, b long, lift double")
    return spark.createDataFrame(rows, ROWS), start, deps


@pytest.mark.parametrize("directional", [False, True])
def test_validation_rank_does_not_depend_on_blocks(spark, monkeypatch, directional):
    plan, found = stages.Stages(epochs=0, directional=directional), []
    for size in (1 << 18, 40, 1):
        monkeypatch.setattr(stages, "BLOCK", size)
        got = stages.train_stages(*many(spark), plan).collect()
        found.append(sorted((r["direction"], r["kind"], r["a"] or 0, round(r["raw"], 12), round(r["mrr_rules"], 12), round(r["mrr_dependencies"], 12)) for r in got))
    assert found[0] == found[1] == found[2] and found[0][0][4] > 0


def test_training_takes_blocks_not_rows(spark, monkeypatch):
    """The task that trains a relation is sent a row for each block; before, it was sent every row."""
    monkeypatch.setattr(stages, "BLOCK", 100)
    rows, start, deps = many(spark)
    got = stages.train_stages(rows, start, deps, stages.Stages(epochs=2, batch=64))
    assert len({(r["stage"], r["mrr_rules"]) for r in got.collect()}) == 1

    def nodes(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(k) for k in range(p.children().size())]
        yield kind, p
        for b in below:
            yield from nodes(b)

    last = next(p for kind, p in nodes(got._jdf.queryExecution().executedPlan()) if kind == "ShuffleExchangeExec")
    sent = last.metrics().get("shuffleRecordsWritten").get().value()
    assert rows.count() == 720 and sent <= 6 + 2 * 4


def test_every_row_is_in_one_batch_of_an_epoch():
    with tempfile.TemporaryFile() as file:
        blocks, n = stages.Blocks(file), 0
        for size in (7, 5, 9):
            each = stages.Rows.of([np.array([n + k]) for k in range(size)])
            blocks.put("train", each, each, [np.arange(size), np.zeros(size, np.int8), np.zeros(size, int), np.zeros(size, np.int8)])
            n += size
        got = [list(rows.idx) for rows, _ in blocks.batches(np.random.RandomState(0), 4, False)]
    assert [len(b) for b in got] == [4, 4, 4, 4, 4, 1] and sorted(sum(got, [])) == list(range(n))


def test_memory_does_not_grow_with_rows():
    r, peaks = np.random.RandomState(0), []
    for n_blocks in (4, 40):
        with tempfile.TemporaryFile() as file:
            blocks = stages.Blocks(file)
            for _ in range(n_blocks):
                each = stages.Rows(np.arange(2001) * 10, r.randint(0, 50, 20000).astype(np.uint16))
                rest = [np.arange(2000, dtype=np.int32), r.randint(0, 2, 2000).astype(np.int8), np.arange(2000, dtype=np.int32) // 20, np.ones(2000, np.int8)]
                for part in ("train", "valid"):
                    blocks.put(part, each, each, rest)
            tracemalloc.start()
            stages.descend(blocks, np.full(50, 0.1), 0.0, np.ones(50), np.ones(50, bool), np.zeros(50), stages.Stages(epochs=2, batch=256), False)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    # What grows is the list of the golds' reciprocal ranks: a number each.
    assert peaks[1] < peaks[0] + 36 * 2000 * 8 * 2


@pytest.mark.parametrize("tabled", [4096, 0])
@pytest.mark.parametrize("any_order", [False, True])
def test_dependencies_beside_rules_equal_brute_force(monkeypatch, tabled, any_order):
    monkeypatch.setattr(stages, "MOST_TABLED", tabled)
    monkeypatch.setattr(stages, "SLICE", 7)
    r = random.Random(4)
    pairs = sorted(p for p in itertools.product(range(9), repeat=2) if (any_order or p[0] < p[1]) and r.random() < 0.4)
    rows = [sorted(r.sample(range(9), r.randrange(7))) for _ in range(40)]
    a, b = (np.array(c) for c in zip(*pairs))
    got = stages.Dependencies(a, b, 9).beside(stages.Rows.of([np.array(x, int) for x in rows]))
    want = [x + [9 + k for k, (p, q) in enumerate(pairs) if p in x and q in x] for x in rows]
    assert [list(got.take(np.array([k])).idx) for k in range(len(got))] == want


def test_rows_with_only_some_rules(spark):
    held = spark.createDataFrame([("a", [1, 2, 5]), ("b", [2]), ("c", [7, 9])], "x string, rules array<long>")
    some = spark.createDataFrame([(1,), (5,), (7,)], "rule_id long")
    assert [tuple(r) for r in sets.only(held, some).orderBy("x").collect()] == [("a", [1, 5]), ("c", [7])]
    assert sets.only(held, some.limit(0)).collect() == []


def test_missing_values_are_no_error(spark):
    rows, start, deps = many(spark)
    odd = spark.createDataFrame([("t", d, q, c, rules, label, part) for part in ("train", "valid") for d, q, c, rules, label in ((None, "q", "a", [1, None], 1), ("tail", None, None, None, None))], ROWS)
    plan = stages.Stages(epochs=2, batch=64)
    got = stages.train_stages(rows.unionByName(odd), start, deps, plan).collect()
    assert len(got) >= 5 and all(np.isfinite(r["raw"]) and 0 < r["mrr_rules"] <= 1 for r in got)
