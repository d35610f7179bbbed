"""Training in two stages: rule weights first, then dependency weights beside them; epochs are chosen by validation rank.

Rows are dealt out in blocks that Spark sorts and packs side by side. The task that trains a relation keeps its blocks in a
file and holds one at a time, so that its memory does not grow with the rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import weight_of

SCHEMA = "rel string, direction string, stage string, kind string, a long, b long, raw double, effective double, mrr_rules double, mrr_dependencies double"
#: Epochs between looks at the validation rows, by third of a stage's course; a rule stage's shares of it.
CADENCE, SHARES = (4, 2, 1), (0.4, 0.8, 1.0)
#: Rows of a block, about. Relations of fewer training and validation rows have one block of each.
BLOCK = 1 << 18
#: Rows that are scored, or whose pairs are looked up, at once.
SLICE = 1 << 14
#: Up to so many rules a dependency's place is read from a table of all pairs, else searched for.
MOST_TABLED = 4096
PACKED = "rel string, what string, a long, b long, w double, block long, starts binary, rules binary, owner binary, label binary, query binary, side binary"


@dataclass(frozen=True)
class Stages:
    epochs: int = 20
    batch: int = 4096
    rate: float = 0.05
    l1: float = 1e-5
    positive: str | float = "auto_sqrt"
    patience: int = 3
    seed: int = 0
    #: Weights enter squared, dependencies with the sign of their lift; else as they are.
    signed: bool = True
    #: Whether rule weights stay as they are in the second stage.
    freeze: bool = False
    #: Where dependency weights start: "constant" (a tenth), "lift" (a tenth of it) or "zero".
    start: str = "constant"
    #: Whether head and tail queries may each keep an epoch of their own.
    directional: bool = False


@dataclass(frozen=True)
class Rows:
    """The places of each row, one row after the other: row k has idx[starts[k] : starts[k + 1]]."""

    starts: np.ndarray
    idx: np.ndarray

    @classmethod
    def of(cls, rows: Rows | list[np.ndarray]) -> Rows:
        if isinstance(rows, Rows):
            return rows
        starts = np.cumsum([0, *(len(r) for r in rows)])
        return cls(starts, np.concatenate(rows).astype(int) if rows else np.empty(0, int))

    @classmethod
    def join(cls, parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        sizes = np.concatenate([np.diff(p.starts) for p in parts])
        return cls(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.idx for p in parts]))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def take(self, pick: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[pick]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return Rows(starts, self.idx[np.repeat(self.starts[pick] - starts[:-1], sizes) + np.arange(starts[-1])])

    def slices(self) -> Iterator[Rows]:
        for lo in range(0, len(self), SLICE):
            starts = self.starts[lo : lo + SLICE + 1]
            yield Rows(starts - starts[0], self.idx[starts[0] : starts[-1]])


def loss_and_slope(rows: Rows | list[np.ndarray], y: np.ndarray, weight: np.ndarray, w: np.ndarray, bias: float, sign: np.ndarray, signed: bool, l1: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean weighted cross entropy and l1 times the sizes of the effective weights; its slope by w and by the bias."""
    rows = Rows.of(rows)
    owner, value = rows.owner(), effective(w, sign, signed)
    z = bias + np.bincount(owner, value[rows.idx], len(rows))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean() + (l1 * np.abs(value)).sum())
    error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
    slope = np.bincount(rows.idx, error[owner], len(w)) + l1 * np.sign(value)
    return loss, slope * (2 * sign * w if signed else 1.0), float(error.sum())


def effective(w: np.ndarray, sign: np.ndarray, signed: bool) -> np.ndarray:
    return sign * w * w if signed else w


def logits(rows: Rows, w: np.ndarray, bias: float, sign: np.ndarray, signed: bool) -> np.ndarray:
    value = effective(w, sign, signed)
    return np.concatenate([np.empty(0), *(bias + np.bincount(r.owner(), value[r.idx], len(r)) for r in rows.slices())])


def reciprocals(queries: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Of each gold, query by query, 1 / (1 + others above + half of the others that tie); others are the query's candidates without gold."""
    if not len(queries):
        return np.empty(0)
    values, place = np.unique(scores, return_inverse=True)
    key = queries.astype(np.int64) * len(values) + place
    gold = labels == 1
    other, own = np.sort(key[~gold]), key[gold][np.argsort(queries[gold], kind="stable")]
    end = np.searchsorted(other, (own // len(values) + 1) * len(values))
    above, least = end - np.searchsorted(other, own, "right"), end - np.searchsorted(other, own, "left")
    return 1 / (1 + (above + least) / 2)


def filtered_mrr(queries: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> float:
    """Mean of the reciprocals()."""
    found = reciprocals(queries, labels, scores)
    return float(np.mean(found)) if len(found) else 0.0


def looks(epochs: int, cadence: tuple[int, ...]) -> set[int]:
    """Epochs after which validation rows are scored: every CADENCE epochs of each phase, and the last."""
    ends = [round(epochs * s) for s in SHARES]
    begins = [0, *ends[:-1]]
    return {e for lo, hi, c in zip(begins, ends, cadence) for e in range(lo + c, hi + 1, c)} | {epochs}


class Dependencies:
    """Looks up the place of a dependency by the places of its rules; pairs are in ascending order, of equal ones the last counts."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        self.n, self.keys, self.any_order = n, a * n + b, bool((a >= b).any())
        self.table = None
        if len(a) and n <= MOST_TABLED:
            self.table = np.full(n * n, -1, np.int32)
            self.table[self.keys] = np.arange(len(a))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys, key, "right") - 1
        return np.where((at >= 0) & (self.keys[at] == key), at, -1)

    def beside(self, rules: Rows) -> Rows:
        """Of each row its rules, then (from n on) the dependencies both of whose rules it has."""
        if not len(self.keys):
            return rules
        kind = np.uint16 if self.n + len(self.keys) <= 1 << 16 else np.int32
        sizes, parts = [], []
        for r in rules.slices():
            owner, mine = r.owner(), r.idx.astype(np.int64)
            first = r.starts[owner] if self.any_order else np.arange(1, len(mine) + 1)
            many = r.starts[owner + 1] - first
            ends = np.cumsum(many)
            left = np.repeat(np.arange(len(mine)), many)
            right = np.arange(len(left)) + np.repeat(first - (ends - many), many)
            k = self.find(mine[left], mine[right])
            met = k >= 0
            k, of = k[met], owner[left[met]]
            more = np.bincount(of, minlength=len(r))
            out = np.empty(len(mine) + len(k), kind)
            out[np.arange(len(mine)) + (np.cumsum(more) - more)[owner]] = mine
            out[np.arange(len(k)) + r.starts[1:][of]] = self.n + k
            parts.append(out)
            sizes.append(np.diff(r.starts) + more)
        return Rows(np.cumsum(np.concatenate([[0], *sizes])), np.concatenate([np.empty(0, kind), *parts]))


@dataclass(frozen=True)
class Block:
    """Distinct sets of places, and of each row its set, label, query and direction (the place in SIDES)."""

    sets: Rows
    owner: np.ndarray
    label: np.ndarray
    query: np.ndarray
    side: np.ndarray


SIDES = ("both", "head", "tail")


class Blocks:
    """Blocks of training and validation rows in a file."""

    def __init__(self, file: IO[bytes]):
        self.file, self.at, self.n, self.ones = file, {"train": [], "valid": []}, 0, 0

    def put(self, part: str, rules: Rows, full: Rows, rest: list[np.ndarray]) -> None:
        starts = []
        for arrays in ([rules.starts, rules.idx], [full.starts, full.idx], rest):
            starts.append(self.file.seek(0, 2))
            for v in arrays:
                np.save(self.file, v)
        self.at[part].append(starts)
        if part == "train":
            self.n, self.ones = self.n + len(rest[1]), self.ones + int((rest[1] == 1).sum())

    def get(self, part: str, k: int, second: bool) -> Block:
        rules, full, rest = self.at[part][k]
        self.file.seek(full if second else rules)
        sets = Rows(np.load(self.file), np.load(self.file))
        self.file.seek(rest)
        return Block(sets, *(np.load(self.file) for _ in range(4)))

    def batches(self, random: np.random.RandomState, size: int, second: bool) -> Iterator[tuple[Rows, np.ndarray]]:
        """The training rows in batches: blocks in random order, the rows of each in random order. Batches run on across blocks."""
        held, n = [], 0
        for k in random.permutation(len(self.at["train"])):
            block = self.get("train", k, second)
            order, lo = random.permutation(len(block.owner)), 0
            while lo < len(order):
                pick = order[lo : lo + size - n]
                held.append((block.sets.take(block.owner[pick]), block.label[pick].astype(float)))
                lo, n = lo + len(pick), n + len(pick)
                if n == size:
                    yield Rows.join([r for r, _ in held]), np.concatenate([y for _, y in held])
                    held, n = [], 0
        if held:
            yield Rows.join([r for r, _ in held]), np.concatenate([y for _, y in held])


def descend(blocks: Blocks, w: np.ndarray, bias: float, sign: np.ndarray, free: np.ndarray, l1: np.ndarray, plan: Stages, second: bool) -> dict[str, tuple[float, np.ndarray, float]]:
    """One stage of mini-batch Adam. For each kind of queries the best (mrr, w, bias) over the looks, the start among them."""
    w, best, bad = w.copy(), {}, 0
    kinds = ("head", "tail") if plan.directional else ("both",)
    positive = weight_of(blocks.ones, blocks.n, plan.positive)
    at = looks(plan.epochs, (1, 1, 1) if second else CADENCE)
    patience, least = (max(3 * plan.patience, 9), max(2 * plan.patience, 6)) if second else (plan.patience, 0)

    def look() -> bool:
        found, better = {kind: [] for kind in kinds}, False
        for k in range(len(blocks.at["valid"])):
            v = blocks.get("valid", k, second)
            scores = logits(v.sets, w, bias, sign, plan.signed)[v.owner]
            for kind in kinds:
                use = slice(None) if kind == "both" else v.side == SIDES.index(kind)
                found[kind].append(reciprocals(v.query[use], v.label[use], scores[use]))
        for kind in kinds:
            each = np.concatenate([np.empty(0), *found[kind]])
            mrr = float(np.mean(each)) if len(each) else 0.0
            if kind not in best or mrr > best[kind][0]:
                best[kind], better = (mrr, w.copy(), bias), True
        return better

    look()
    random, step = np.random.RandomState(plan.seed), 0
    first, turn = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for epoch in range(1, plan.epochs + 1):
        phase = 2 if second else sum(epoch > round(plan.epochs * s) for s in SHARES[:2])
        for rows, y in blocks.batches(random, plan.batch, second):
            _, g, g_bias = loss_and_slope(rows, y, np.where(y == 1, positive, 1.0), w, bias, sign, plan.signed, l1)
            g = np.append(np.where(free, g, 0.0), g_bias)
            step += 1
            first += 0.1 * (g - first)
            turn += 0.001 * (g * g - turn)
            move = plan.rate / 3**phase * first / (1 - 0.9**step) / (np.sqrt(turn / (1 - 0.999**step)) + 1e-8)
            w, bias = w - np.where(free, move[:-1], 0.0), bias - float(move[-1])
        if epoch in at:
            bad = 0 if look() else bad + 1
            if bad > patience and epoch >= least:
                break
    return best


def train_relation(rel: str, raw: list[dict[str, np.ndarray]], params: pd.DataFrame, plan: Stages) -> pd.DataFrame:
    """Both stages of one relation; see train_stages()."""
    rule = params[params["kind"] == "rule"].sort_values("a")
    ids = rule["a"].to_numpy(np.int64)
    n = len(ids)
    dep = params[params["kind"] == "dependency"].sort_values(["a", "b"])
    dep = dep[dep["a"].isin(ids) & dep["b"].isin(ids)]
    place = lambda c: np.searchsorted(ids, dep[c].to_numpy(np.int64))
    lift, pairs = dep["w"].to_numpy(float), Dependencies(place("a"), place("b"), n)
    with tempfile.TemporaryFile() as file:
        blocks = Blocks(file)
        for r in raw:
            rules = placed(Rows(r["starts"](), r["rules"]()), ids)
            blocks.put(r["what"], rules, pairs.beside(rules), [r[c]() for c in ("owner", "label", "query", "side")])
        return both_stages(rel, blocks, rule, dep, lift, plan)


def placed(sets: Rows, ids: np.ndarray) -> Rows:
    """Rules by their places among the ids, ascending; those that are not among them are left out."""
    at = np.minimum(np.searchsorted(ids, sets.idx), len(ids) - 1)
    key = np.unique((sets.owner() * len(ids) + at)[ids[at] == sets.idx])
    sizes = np.bincount(key // len(ids), minlength=len(sets))
    return Rows(np.concatenate([[0], np.cumsum(sizes)]), (key % len(ids)).astype(np.uint16 if len(ids) <= 1 << 16 else np.int32))


def both_stages(rel: str, blocks: Blocks, rule: pd.DataFrame, dep: pd.DataFrame, lift: np.ndarray, plan: Stages) -> pd.DataFrame:
    n = len(rule)
    sign1, sign2 = np.ones(n), np.concatenate([np.ones(n), np.where(lift < 0, -1.0, 1.0)])
    start1 = rule["w"].to_numpy(float)
    start2 = {"constant": np.full(len(lift), 0.1), "lift": 0.1 * lift, "zero": np.zeros(len(lift))}[plan.start]
    one = descend(blocks, start1, 0.0, sign1, np.ones(n, bool), np.zeros(n), plan, False)
    out = []
    for kind, (mrr1, w1, bias1) in one.items():
        free = np.concatenate([np.full(n, not plan.freeze), np.ones(len(lift), bool)])
        l1 = np.concatenate([np.zeros(n), np.full(len(lift), plan.l1)])
        two = descend(blocks, np.concatenate([w1, start2]), bias1, sign2, free, l1, plan, True)
        mrr2, w2, bias2 = two[kind]
        keep = mrr2 > mrr1
        w, bias, sign = (w2, bias2, sign2) if keep else (w1, bias1, sign1)
        table = pd.DataFrame({"kind": ["rule"] * n + ["dependency"] * (len(w) - n), "a": [*rule["a"], *dep["a"]][: len(w)], "b": pd.array([None] * n + [*dep["b"]], "Int64")[: len(w)], "raw": w, "effective": effective(w, sign, plan.signed)})
        table = pd.concat([table, pd.DataFrame({"kind": ["bias"], "a": pd.array([None], "Int64"), "b": pd.array([None], "Int64"), "raw": [bias], "effective": [bias]})])
        out.append(table.assign(rel=rel, direction=kind, stage="dependencies" if keep else "rules", mrr_rules=mrr1, mrr_dependencies=mrr2))
    whole = pd.concat(out)
    whole["a"], whole["b"] = whole["a"].astype("Int64"), whole["b"].astype("Int64")
    return whole[[c.split()[0] for c in SCHEMA.split(", ")]]


def pack(table: pa.Table) -> pa.Table:
    """The rows of one block in one row: distinct sets of rules, and the rows in the order of direction, query and candidate."""
    table = table.sort_by([(c, "ascending") for c in ("direction", "query", "cand")])
    rules = table["rules"].combine_chunks()
    rules = pa.concat_arrays(rules.chunks) if isinstance(rules, pa.ChunkedArray) else rules
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rules), 0).to_numpy())]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(rules), [None, pa.py_buffer(starts * 8), pa.py_buffer(rules.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    known = whole.dictionary_encode()
    _, offsets, values = known.dictionary.buffers()
    starts = np.frombuffer(offsets, np.int64)[: len(known.dictionary) + 1] // 8
    values = np.frombuffer(values, np.int64)[: starts[-1]] if values is not None else np.empty(0, np.int64)
    place = lambda c: table[c].combine_chunks().dictionary_encode()
    direction, query = place("direction"), place("query")
    direction, query = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (direction, query))
    sides = np.array([SIDES.index(d) if d in SIDES else 0 for d in direction.dictionary.to_pylist()], np.int8)
    d, q = (x.indices.to_numpy(zero_copy_only=False) for x in (direction, query))
    new = np.concatenate([[False], (np.diff(d) != 0) | (np.diff(q) != 0)])
    arrays = {
        "starts": starts, "rules": values, "owner": known.indices.to_numpy(zero_copy_only=False).astype(np.int32),
        "label": (table["label"].to_numpy() == 1).astype(np.int8), "query": np.cumsum(new).astype(np.int32), "side": sides[d],
    }
    one = {"rel": table["rel"][0], "what": table["part"][0], "block": table["block"][0]} | {k: v.tobytes() for k, v in arrays.items()}
    kinds = {"a": pa.int64(), "b": pa.int64(), "w": pa.float64(), "block": pa.int64(), "rel": pa.string(), "what": pa.string()}
    return pa.table({c: pa.array([one[c].as_py() if isinstance(one.get(c), pa.Scalar) else one.get(c)], kinds.get(c, pa.binary())) for c in COLUMNS})


COLUMNS = [c.split()[0] for c in PACKED.split(", ")]
KINDS = {"starts": np.int64, "rules": np.int64, "owner": np.int32, "label": np.int8, "query": np.int32, "side": np.int8}


def train_stages(rows: DataFrame, weights: DataFrame, deps: DataFrame, plan: Stages = Stages()) -> DataFrame:
    """The parameters that each relation keeps: those of the second stage where its validation mrr is strictly larger, else the first's.

    rows: rel, direction (head or tail), query, cand, rules (array of ids), label, part (train or valid); computed twice,
    so hand in a table. weights: rel, rule_id, w: where rules start. deps: rel, a, b, lift. The second stage starts from the
    weights and the bias that the first kept. Relations train side by side, each in one task; a relation without training
    rows keeps its starting weights, and one without rules has no row.

    Rows are sorted and packed in blocks of about BLOCK rows by all tasks; both directions of a candidate are in one
    block, and so are a validation query's candidates, however many. An epoch goes through the training blocks in random
    order. A relation of one block is trained as if its rows were in memory. Missing rules or labels count as none, missing
    names as equal.
    """
    rule = weights.selectExpr("rel", "'rule' AS what", "rule_id AS a", "CAST(NULL AS BIGINT) AS b", "CAST(w AS DOUBLE) AS w")
    params = rule.unionByName(deps.selectExpr("rel", "'dependency' AS what", "a", "b", "CAST(lift AS DOUBLE) AS w"))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in ("direction", "query", "cand")]
    rules = F.array_compact(F.col("rules").cast("array<bigint>")).alias("rules")
    rows = rows.select("rel", *texts, rules, "label", "part").where("part IN ('train', 'valid')")
    many = rows.groupBy("rel", "part").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    pair = F.xxhash64(F.least("query", "cand"), F.greatest("query", "cand"))
    key = F.when(F.col("part") == "train", pair).otherwise(F.xxhash64("direction", "query"))
    # One row for each relation and part is handed to every task.
    dealt = rows.join(F.broadcast(many), ["rel", "part"]).withColumn("block", F.pmod(key, F.col("many")).cast("long")).drop("many")
    packed = dealt.groupBy("rel", "part", "block").applyInArrow(pack, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params_: dict[str, list[pa.RecordBatch]] = {}
        raw: dict[str, list[dict]] = {}
        with tempfile.TemporaryFile() as file:

            def kept(data: bytes, kind: type):
                at, size = file.seek(0, 2), len(data)
                file.write(data)

                def read() -> np.ndarray:
                    file.seek(at)
                    return np.frombuffer(file.read(size), kind)

                return read

            for batch in batches:
                few = batch.filter(pc.is_null(batch["block"])).select(["rel", "what", "a", "b", "w"])
                for rel in pc.unique(few["rel"]).to_pylist():
                    params_.setdefault(rel, []).append(few.filter(pc.equal(few["rel"], rel)))
                blocks = batch.filter(pc.is_valid(batch["block"]))
                for k in range(blocks.num_rows):
                    one = {c: blocks[c][k] for c in COLUMNS}
                    found = {c: kept(one[c].as_buffer().to_pybytes(), kind) for c, kind in KINDS.items()}
                    raw.setdefault(one["rel"].as_py(), []).append(found | {"what": one["what"].as_py(), "block": one["block"].as_py()})
            for rel in sorted(params_):
                mine = pa.Table.from_batches(params_[rel]).to_pandas().rename(columns={"what": "kind"})
                if (mine["kind"] == "rule").any():
                    done = train_relation(rel, sorted(raw.get(rel, []), key=lambda r: r["block"]), mine, plan)
                    yield pa.RecordBatch.from_pandas(done, schema=RESULT, preserve_index=False)

    whole = packed.unionByName(params, allowMissingColumns=True).select(*COLUMNS)
    return whole.repartition("rel").mapInArrow(run, SCHEMA)


RESULT = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])
