"""Language of documents by a bidirectional gated recurrent network over bytes.

Each direction reads the UTF-8 bytes of a window and keeps HIDDEN gated units (update gate, reset
gate, candidate); what it knows at a position from both sides gives the probabilities of the
languages there. A document's probabilities are the mean over all its positions. Texts are cut into
windows of WINDOW bytes that are read side by side, so that each step is one small matrix product
for hundreds of windows. Windows overlap: each labels its inner positions, with MARGIN bytes of context on
either side, from which both directions' states come.

Trained in numpy by backpropagation through time with Adam, on a bounded sample: at most PER_LANGUAGE
documents of each language, WINDOWS random windows of each, which the executors cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stash, table

HIDDEN, WINDOW, MARGIN, BATCH = 8, 128, 16, 768
#: Positions that a window labels.
INNER = WINDOW - 2 * MARGIN
PER_LANGUAGE, WINDOWS = 500, 4
STEPS, TRAIN_BATCH, RATE = 260, 128, 0.02
#: Up to so many languages their counts are broadcast; beyond it, joined.
MOST_BROADCAST = 100_000
NONE = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Both directions' weights lie behind each other on the first axis.

    x: (2, 3 * HIDDEN, 256), what each byte adds to the gates; u: (2, 3 * HIDDEN, HIDDEN); out: (2, n, HIDDEN); bias: (n, 1).
    """

    NAMES = ("x", "u", "b", "out", "bias")

    def __init__(self, labels: list[str], seed: int = 0):
        random = np.random.RandomState(seed)
        n, h = len(labels), HIDDEN
        self.labels = labels
        self.x = random.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32)
        self.u = random.normal(0, 1 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32)
        self.b = np.zeros((2, 3 * h, 1), np.float32)
        self.b[:, :h] = 1.0
        self.out = random.normal(0, 1 / np.sqrt(h), (2, n, h)).astype(np.float32)
        self.bias = np.zeros((n, 1), np.float32)

    def states(self, data: np.ndarray, keep: bool = False):
        """States after each byte of data (WINDOW, B): (WINDOW, 2, HIDDEN, B); direction 1 reads from the end."""
        length, width, h = len(data), data.shape[1], HIDDEN
        state = np.zeros((2, h, width), np.float32)
        states = np.empty((length, 2, h, width), np.float32)
        saved = []
        # The gates' sigmoid is 0.5 + 0.5 * tanh(a / 2).
        scale = np.ones((1, 3 * h, 1), np.float32)
        scale[:, : 2 * h] = 0.5
        x, u = (self.x + self.b) * scale, self.u * scale
        a = np.empty((2, 3 * h, width), np.float32)
        for t in range(length):
            np.take(x[0], data[t], 1, a[0], "clip")
            np.take(x[1], data[length - 1 - t], 1, a[1], "clip")
            r = u @ state
            gates = a[:, : 2 * h] + r[:, : 2 * h]
            np.tanh(gates, gates)
            gates *= 0.5
            gates += 0.5
            z, reset, back = gates[:, :h], gates[:, h:], r[:, 2 * h :]
            new = reset * back
            new += a[:, 2 * h :]
            np.tanh(new, new)
            if keep:
                saved.append((state, gates, back.copy(), new))
            state = state - new
            state *= z
            state += new
            states[t, 0], states[length - 1 - t, 1] = state[0], state[1]
        return states, saved

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(WINDOW, n, B): of each language at each position."""
        logits = self.out[0] @ states[:, 0]
        logits += self.out[1] @ states[:, 1]
        logits += self.bias
        np.exp(np.minimum(logits, 60, logits), logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions; y: (B,) numbers of the languages."""
        length, width, h = len(data), data.shape[1], HIDDEN
        states, saved = self.states(data, keep=True)
        error = self.probabilities(states)
        error[:, y, np.arange(width)] -= 1
        error /= length * width
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        g["bias"] += error.sum((0, 2))[:, None]
        for d in (0, 1):
            g["out"][d] = np.einsum("tnb,thb->nh", error, states[:, d], optimize=True)
        from_out = np.stack([self.out[d].T @ error for d in (0, 1)], 1)
        below = np.zeros((2, h, width), np.float32)
        for t in range(length - 1, -1, -1):
            before, gates, back, new = saved[t]
            z, reset = gates[:, :h], gates[:, h:]
            below = below + np.stack([from_out[t, 0], from_out[length - 1 - t, 1]])
            d_new = below * (1 - z) * (1 - new**2)
            d_z = below * (before - new) * z * (1 - z)
            d_reset = d_new * back * reset * (1 - reset)
            inner = np.concatenate([d_z, d_reset, d_new * reset], 1)
            outer = np.concatenate([d_z, d_reset, d_new], 1)
            g["u"] += inner @ before.transpose(0, 2, 1)
            for d, byte in ((0, data[t]), (1, data[length - 1 - t])):
                one = np.zeros((width, 256), np.float32)
                one[np.arange(width), byte] = 1
                g["x"][d] += outer[d] @ one
            g["b"] += outer.sum(2, keepdims=True)
            below = below * z + self.u.transpose(0, 2, 1) @ inner
        return g


def windows(text: bytes) -> np.ndarray:
    """(number of windows, WINDOW), INNER bytes apart; before and after the text stand spaces."""
    n = -(-len(text) // INNER)
    whole = np.frombuffer(b" " * MARGIN + text.ljust(n * INNER + MARGIN), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, WINDOW)[::INNER]


def train(rows: list[tuple[np.ndarray, str]], seed: int = 0) -> Network | None:
    """rows: (windows, language). None without rows."""
    if not rows:
        return None
    labels = sorted({k for _, k in rows})
    network, random = Network(labels, seed), np.random.RandomState(seed)
    data = np.concatenate([w for w, _ in rows])
    y = np.repeat([labels.index(k) for _, k in rows], [len(w) for w, _ in rows])
    first = {k: np.zeros_like(getattr(network, k)) for k in Network.NAMES}
    second = {k: np.zeros_like(getattr(network, k)) for k in Network.NAMES}
    of = [np.flatnonzero(y == k) for k in range(len(labels))]
    for step in range(1, STEPS + 1):
        # As many windows of each language.
        pick = np.concatenate([random.choice(o, -(-TRAIN_BATCH // len(labels))) for o in of])
        g = network.gradients(np.ascontiguousarray(data[pick].T), y[pick])
        size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / max(size, 1e-12))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v**2 - second[k])
            setattr(network, k, (getattr(network, k) - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return network


def predict(network: Network, texts: list[bytes]) -> np.ndarray:
    """(len(texts), number of languages): mean probabilities over all positions; texts mustn't be empty."""
    sizes = [-(-len(t) // INNER) for t in texts]
    all_windows = np.concatenate([windows(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), sizes)
    # Inner positions of each window that belong to the text.
    used = np.full(len(doc), INNER)
    used[np.cumsum(sizes) - 1] -= np.array(sizes) * INNER - np.array([len(t) for t in texts])
    total = np.zeros((len(texts), len(network.labels)))
    inside = np.arange(INNER)[:, None, None]
    for at in range(0, len(doc), BATCH):
        data = np.ascontiguousarray(all_windows[at : at + BATCH].T)
        p = network.probabilities(network.states(data)[0][MARGIN : MARGIN + INNER])
        n = used[at : at + BATCH]
        if n.min() < INNER:
            p = p * (inside < n)
        np.add.at(total, doc[at : at + BATCH], p.sum(0).T)
    return total / np.array([len(t) for t in texts])[:, None]


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[np.ndarray, str]]:
    """(up to WINDOWS windows, language) of at most per_language documents of each language: those with the least hash of
    their id and text. Equal rows count once."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("place"))
    counts = stash(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # Texts aren't dealt by language, one of which may have most of them, while the languages are few.
    few = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    # Half as many again as are wanted stay under the threshold, so few rows are ranked.
    near = usable.join(few, "lang").where(F.col("place") / F.lit(float(1 << 63)) < F.lit(1.5 * per_language) / F.col("n")).dropDuplicates(["lang", "place"])
    order = Window.partitionBy("lang").orderBy("place")
    picked = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("lang", "place", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and _LETTER.search(text):
                    w = windows(text.encode("utf-8", "surrogatepass"))
                    pick = np.random.RandomState(place & 0x7FFFFFFF).choice(len(w), min(WINDOWS, len(w)), replace=False)
                    rows.append((lang, place, w[pick].tobytes()))
            kinds = [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=["lang", "place", "cut"])

    rows = sorted((r["lang"], r["place"], r["cut"]) for r in picked.mapInArrow(cut, "lang string, place long, cut binary").collect())
    return [(np.frombuffer(c, np.uint8).reshape(-1, WINDOW), lang) for lang, _, c in rows]


def identified(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text).

    Null text, or none of letters: und, score 0; likewise all rows if nothing could be learned. Null
    doc_id: held_out null. Repeated rows: rows of their own. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network and {"labels": network.labels} | {k: getattr(network, k) for k in Network.NAMES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        if shared.value:
            net = Network.__new__(Network)
            net.__dict__.update(shared.value)

        def flush(texts: list[bytes], at: list[int], langs: list[str], scores: list[float]) -> None:
            if texts:
                p = predict(net, texts)
                best = p.argmax(1)
                for k, b, v in zip(at, best, p.max(1)):
                    langs[k], scores[k] = net.labels[b], min(1.0, float(v))

        for batch in batches:
            langs, scores = [NONE] * len(batch), [0.0] * len(batch)
            texts, at, size = [], [], 0
            for k, t in enumerate(batch.column(2).to_pylist()):
                if net and t and _LETTER.search(t):
                    texts.append(t.encode("utf-8", "surrogatepass"))
                    at.append(k)
                    size += len(texts[-1])
                    if size > 2 * BATCH * INNER:
                        flush(texts, at, langs, scores)
                        texts, at, size = [], [], 0
            flush(texts, at, langs, scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op7_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return identified(docs, train(sample(docs)))
