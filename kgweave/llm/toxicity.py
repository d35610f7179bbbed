"""Toxicity by a factorization machine over hashed terms.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The terms of a text are its distinct words, in lower case, and the starts of longer words, hashed to
2 ** BITS places. The pairwise term is half of |sum v|^2 - sum |v|^2, so it costs no more than the
linear one. Words on their own have weights; two words together (an insult and the mention of a
group) have the product of their factors, which a linear model can't learn.

It is trained in numpy by Adam, with an l2 penalty, on a bounded sample of labelled documents: at most
PER_LABEL of each label, those with the least hash of their id, weighted to the labels' shares
among all labelled rows. The sample's texts become terms on the executors. Trained are the terms that
tell the labels apart alone, and those that do so beside another: the statistic of a pair's interaction
finds words that say nothing by themselves. Scoring runs over whole texts in Arrow batches; the model has a fixed size
of 2 ** BITS * (FACTORS + 1) floats.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, discard, ship, stash, table

BITS, FACTORS = 18, 8
STARTS = (5, 6, 7)
PER_LABEL = 3000
EPOCHS, BATCH, RATE, PENALTY = 12, 128, 0.03, 1e-4
#: Small samples go round more often: factors near zero need so many steps to grow.
LEAST_STEPS = 400
#: How far factors stand from zero at first: at zero, products have no slope.
SPREAD = 0.01
#: A term is trained if LEAST_DOCUMENTS of the sample have it and its chi-square statistic against the label is
#: this, or if with another term the interaction's is LEAST_PAIR_CHI2 (higher, as there are millions of pairs).
LEAST_DOCUMENTS, LEAST_CHI2, LEAST_PAIR_CHI2 = 3, 8.0, 45.0
#: Pairs are looked at among the terms that tell alone and all that this part of the sample has.
PAIRED_SHARE = 0.05
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_WORD = re.compile(r"[^\W\d_]+")


class TermHashes(dict):
    """The places of a word's terms as bytes, remembered."""

    MOST = 50_000

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        terms = [f"w{word}", *(f"s{word[:k]}" for k in STARTS if len(word) > k)]
        self[word] = value = array("I", [xxhash.xxh3_64_intdigest(t) >> (64 - BITS) for t in terms]).tobytes()
        return value


_TERMS = TermHashes()


def terms(text: str | None) -> np.ndarray:
    """Distinct places of the text's terms, sorted."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.frombuffer(b"".join(map(_TERMS.__getitem__, words)), np.uint32))


@dataclass
class Machine:
    """bias; table: of each place the weight, then the factors."""

    bias: float
    table: np.ndarray

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        return 1 / (1 + np.exp(-self.forward(docs)[0]))

    def forward(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs])
        rows = self.table[np.concatenate(docs)] if sizes.sum() else np.empty((0, FACTORS + 1), np.float32)
        owner = np.repeat(np.arange(len(docs)), sizes)
        sums, squares = np.zeros((len(docs), FACTORS + 1)), np.zeros(len(docs))
        if len(rows):
            starts, some = (np.cumsum(sizes) - sizes)[sizes > 0], sizes > 0
            sums[some] = np.add.reduceat(rows, starts, dtype=np.float64)
            squares[some] = np.add.reduceat((rows[:, 1:] ** 2).sum(1), starts, dtype=np.float64)
        logit = self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
        return np.clip(logit, -30, 30), rows, sums, owner


def telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Places of the terms that tell the labels apart, alone or in a pair."""
    size, n, one = 1 << BITS, len(docs), labels.sum()
    both = np.bincount(np.concatenate(docs), minlength=size).astype(float)
    hit = np.bincount(np.concatenate([d for d, y in zip(docs, labels) if y]), minlength=size).astype(float)
    expected = both * one / n
    chi2 = (hit - expected) ** 2 / np.maximum(expected * (1 - one / n) * (1 - both / n), 1e-9)
    alone = (both >= LEAST_DOCUMENTS) & (chi2 >= LEAST_CHI2)
    met = np.flatnonzero(alone | (both >= max(LEAST_DOCUMENTS, PAIRED_SHARE * n)) & (both < n))
    alone[met[paired(docs, labels, met)]] = True
    return np.flatnonzero(alone)


def paired(docs: list[np.ndarray], labels: np.ndarray, met: np.ndarray, step: int = 512) -> np.ndarray:
    """Which of the places `met` interact with another: the label's shares in the four cells of a pair, p11 - p10 - p01 + p00,
    against their spread if both had nothing to do with the label. Blocks of step by step pairs at a time."""
    place = np.full(1 << BITS, -1, np.int32)
    place[met] = np.arange(len(met))
    has = np.zeros((len(docs), len(met)), bool)
    for k, d in enumerate(docs):
        own = place[d]
        has[k, own[own >= 0]] = True
    n, one, mark = np.float32(len(docs)), np.float32(labels.sum()), labels.astype(np.float32)
    share = one / n
    found = np.zeros(len(met), bool)
    for at in range(0, len(met), step):
        x = has[:, at : at + step].astype(np.float32)
        for beside in range(at, len(met), step):
            y = has[:, beside : beside + step].astype(np.float32)
            n11, t11 = x.T @ y, (x * mark[:, None]).T @ y
            n10, t10 = x.sum(0)[:, None] - n11, (mark @ x)[:, None] - t11
            n01, t01 = y.sum(0) - n11, mark @ y - t11
            n00, t00 = n - n11 - n10 - n01, one - t11 - t10 - t01
            enough = np.minimum(np.minimum(n11, n10), np.minimum(n01, n00)) >= 5
            contrast, spread = np.float32(0), np.float32(0)
            for sign, c, t in ((1, n11, t11), (-1, n10, t10), (-1, n01, t01), (1, n00, t00)):
                c = np.maximum(c, 1)
                contrast = contrast + sign * t / c
                spread = spread + share * (1 - share) / c
            good = enough & (contrast**2 >= LEAST_PAIR_CHI2 * spread)
            found[at : at + step] |= good.any(1)
            found[beside : beside + step] |= good.any(0)
    return found


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 0, products: bool = True) -> Machine:
    """Without both labels: a constant machine that gives the share of label 1. Without products: linear weights alone."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    size = 1 << BITS
    if share in (0.0, 1.0):
        return Machine(-30.0 if share == 0 else 30.0, np.zeros((size, FACTORS + 1), np.float32))
    random = np.random.RandomState(seed)
    used = telling(docs, labels)
    place = np.full(size, -1, np.int64)
    place[used] = np.arange(len(used))
    docs = [p[p >= 0] for p in (place[d] for d in docs)]
    m = Machine(float(np.log(share / (1 - share))), np.zeros((len(used), FACTORS + 1), np.float32))
    if products:
        m.table[:, 1:] = random.normal(0, SPREAD, (len(used), FACTORS))
    first, second, b1, b2, step = np.zeros_like(m.table), np.zeros_like(m.table), 0.9, 0.99, 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(docs)))):
        order = random.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            logit, rows, sums, owner = m.forward([docs[k] for k in pick])
            error = (1 / (1 + np.exp(-logit)) - labels[pick]) * weights[pick] / len(pick)
            grad = np.empty_like(rows)
            grad[:, 0] = error[owner]
            grad[:, 1:] = error[owner, None] * (sums[owner, 1:] - rows[:, 1:])
            idx = np.concatenate([docs[k] for k in pick])
            total = np.stack([np.bincount(idx, grad[:, c], len(used)) for c in range(FACTORS + 1)], 1) + PENALTY * m.table
            step += 1
            first += (1 - b1) * (total - first)
            second += (1 - b2) * (total**2 - second)
            m.table -= (RATE * first / (1 - b1**step) / (np.sqrt(second / (1 - b2**step)) + 1e-6)).astype(np.float32)
            m.bias -= RATE * float(error.sum())
    whole = np.zeros((size, FACTORS + 1), np.float32)
    whole[used] = m.table
    return Machine(m.bias, whole)


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list[tuple[np.ndarray, int]], dict[int, float]]:
    """(terms, label) of at most per_label documents of each label, and each label's weight."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_label) for k in (0, 1)]
    # 2 * per_label rows at most; an id may still have many documents, so the limit is set again behind them.
    mine = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("text", "toxic", order.alias("o"), F.xxhash64("text").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _TERMS.clear)
        for batch in batches:
            found = [terms(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], names=["terms", "toxic", "o", "c"])

    each = stash(mine.mapInArrow(run, "terms binary, toxic int, o long, c long"), "toxic")
    rows = [r for k in (0, 1) for r in each.where(F.col("toxic") == k).orderBy("o", "c").limit(per_label).collect()]
    discard(each)
    rows.sort(key=lambda r: (r["o"], r["toxic"], r["c"]))
    all_rows = sum(counts.values())
    weight = {k: (n / all_rows) / (min(n, per_label) / sum(min(x, per_label) for x in counts.values())) for k, n in counts.items()}
    return [(np.frombuffer(r["terms"], np.uint32), r["toxic"]) for r in rows], weight


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Machine:
    ship(docs.sparkSession)
    rows, weight = sample(docs, labels, per_label)
    y = np.array([k for _, k in rows], float)
    return train([t for t, _ in rows], y, np.array([weight[k] for _, k in rows]))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null or empty text: no terms, the score is the bias's. Null doc_id: held_out null. Repeated rows:
    rows of their own. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _TERMS.clear)
        m = Machine(*shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            score = np.concatenate([m.score([terms(t) for t in texts[k : k + 64]]) for k in range(0, len(texts), 64)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op1_toxicity_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, all columns as they are.

    Null or empty text: judged by the bias alone. Null doc_id and repeated rows: rows like any other. An
    empty table gives no rows; without labels of both kinds the machine is a constant.
    """
    machine = fit(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast((machine.bias, machine.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _TERMS.clear)
        m = Machine(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clean = [m.score([terms(t) for t in texts[k : k + 64]]) < 0.5 for k in range(0, len(texts), 64)]
            yield batch.filter(pa.array(np.concatenate(clean))) if clean else batch

    return docs.mapInArrow(run, docs.schema)
