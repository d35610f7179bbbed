"""Order-preserving packing by dynamic programming.

Documents stand in the order of the table and form one run of token ids. The run is cut into
windows of at most `window` ids. Cuts may stand at the end of a document (free), at the end of a
sentence (a small penalty) or within a long sentence (a larger one); the cost of a window is its
padding plus the penalty of the cut that ends it. With p the places and c the penalties,

    best(j) = window - p(j) + c(j) + min over i with p(j) - p(i) <= window of best(i) + p(i),

so the best start of each window is the minimum of a sliding range, kept in a monotone queue:
every place enters and leaves the queue once.

Rows are read where they lie, without a shuffle, as a stream. After each SEGMENT ids the ways to all
places that a next window may begin at are followed back to the cut where they part: up to it windows are
decided and go out, the rest waits. So windows are optimal over the whole partition, while memory
follows the segment and the longest document; if ways don't meet, more is read before the next try.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, ship, table

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY, HARD_PENALTY = 6, 32
#: In sentences of more than twice this many ids, places for hard cuts stand this far apart.
HARD_STEP = 32
SEGMENT = 1 << 20
#: Words whose ids each Python worker remembers (about 200 bytes each); the memory is emptied when it is full.
#: Among other stages, whose memory the executors hold as well, it is a fifth.
REMEMBERED, REMEMBERED_AMONG_OTHERS = 1_000_000, 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Marks that never join letters before them (an apostrophe may).
MARKS = ".,;:!?|$%&*#"
_LOADED: dict[str, "WordTokenizer"] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The tokenizer's ids for whole texts, as unsigned 16-bit integers.

    It never joins anything across a space or line feed, nor a letter or digit with a mark behind it,
    so a text's ids are those of the runs between them, and those of common runs are remembered.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        assert self.inner.get_vocab_size() <= 1 << 16
        self.known: dict[str, bytes] = {}
        #: Whether an id ends a sentence; a word.
        self.stops, self.ends = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for word, i in self.inner.get_vocab().items():
            self.stops[i] = word.removesuffix("</w>") in (".", "!", "?", "...")
            self.ends[i] = word.endswith("</w>")

    def learn(self, new: list[str]) -> None:
        """Remember the ids of runs. Letters with marks behind are two words; letters alone are one, which ends
        with a word-end id, so that all of those go through in one text."""
        known, joined, single = self.known, [], set()
        for w in new:
            word = w.rstrip(MARKS)
            if len(word) < len(w) and word.isalpha():
                mark = w[len(word) :]
                joined.append((w, word, mark))
                single.update(x for x in (word, mark) if x not in known)
            else:
                single.add(w)
        plain = [w for w in single if w.isalpha()]
        ids = np.array(self.inner.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint16)
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) == len(plain):
            raw, stop = ids.tobytes(), (after * 2).tolist()
            known.update(zip(plain, [raw[a:b] for a, b in zip([0, *stop], stop)]))
            single = [w for w in single if not w.isalpha()]
        single = list(single)
        known.update(zip(single, [array("H", e.ids).tobytes() for e in self.inner.encode_batch_fast(single, add_special_tokens=False)]))
        known.update((w, known[word] + known[mark]) for w, word, mark in joined)

    def encode(self, texts: list[str | None], remembered: int = REMEMBERED) -> list[np.ndarray]:
        runs = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > remembered:
            self.known.clear()
        known = self.known
        new = list(set(chain.from_iterable(runs)).difference(known))
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.uint16) for ws in runs]


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may stand (in ascending order, without 0) and what each costs."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    after = np.flatnonzero(stops[ids]) + 1
    cost[after] = SENTENCE_PENALTY
    cost[ends] = 0
    soft = np.concatenate([[0], np.flatnonzero(cost >= 0)])
    gaps = np.diff(soft)
    for k in np.flatnonzero(gaps > 2 * HARD_STEP):
        cost[soft[k] + HARD_STEP : soft[k + 1] : HARD_STEP] = HARD_PENALTY
    cost[0] = -1
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def search(at: Iterable[int], cost: Iterable[int], window: int = WINDOW) -> tuple[list[int], list[int], list[int]]:
    """The places with 0 in front, where the best window that ends at each begins, and all places (by number) at which
    a next window may begin.

    Neighbouring places must be at most `window` apart. Ties go to the longest window.
    """
    p, came = [0], [0]
    queue = deque([(0, 0)])  # (best(i) + p(i), i), rising
    for j, (x, c) in enumerate(zip(at, cost), 1):
        p.append(x)
        while p[queue[0][1]] < x - window:
            queue.popleft()
        value, i = queue[0]
        came.append(i)
        value += window + c  # best(j) + p(j)
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    return p, came, [i for _, i in queue]


def way(p: list[int], came: list[int], j: int) -> list[int]:
    """Ends of the windows on the best way to place j."""
    cuts = []
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


def best_cuts(at: Iterable[int], cost: Iterable[int], window: int = WINDOW) -> list[int]:
    """Ends of the windows, the last place included, at the least total of padding and penalties."""
    p, came, _ = search(at, cost, window)
    return way(p, came, len(p) - 1)


def parting(came: list[int], ends: list[int]) -> int:
    """The last place that lies on the best ways to all the ends."""
    open_ = set(ends)
    heap = [-j for j in open_]
    heapify(heap)
    while len(heap) > 1:
        j = -heappop(heap)
        open_.discard(j)
        if came[j] not in open_:
            open_.add(came[j])
            heappush(heap, -came[j])
    return -heap[0]


@dataclass
class Held:
    """A document, or what the decided windows leave of it: ids from place `start` on, of `size` with the end id."""

    doc_id: int | None
    start: int
    size: int
    ids: np.ndarray


def solve(docs: list[Held], stops: np.ndarray, first: int, last: bool = True) -> tuple[pa.RecordBatch | None, int, list[Held]]:
    """Pieces of the decided windows, the number of the next sequence, and what is left. first: the number of the first
    sequence. last: nothing comes behind, so all windows are decided."""
    ids = np.concatenate([x.ids for x in docs])
    ends = np.cumsum([len(x.ids) for x in docs])
    at, cost = places(ids, ends, stops)
    p, came, nexts = search(at.tolist(), cost.tolist())
    cuts = np.array(way(p, came, len(p) - 1 if last else parting(came, nexts)), np.int64)
    if not len(cuts):
        return None, first, docs
    whole = int(np.searchsorted(ends, cuts[-1], "right"))
    stop = np.union1d(ends[:whole], cuts)
    start = np.concatenate([[0], stop[:-1]])
    doc, seq = np.searchsorted(ends, start, "right"), np.searchsorted(cuts, start, "right")
    begins = np.concatenate([[0], ends[:-1]])
    wide = ids.astype("<u4")
    crc = [zlib.crc32(wide[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
    of = [docs[k] for k in doc.tolist()]
    columns = [
        [x.doc_id for x in of], start - begins[doc] + [x.start for x in of], stop - start, crc, [x.size for x in of],
        seq + first, start - np.concatenate([[0], cuts[:-1]])[seq],
    ]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    left = docs[whole:]
    if left and cuts[-1] > begins[whole]:
        x, done = left[0], int(cuts[-1] - begins[whole])
        left[0] = Held(x.doc_id, x.start + done, x.size, x.ids[done:])
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names), first + len(cuts), left


def pack(docs: DataFrame, path: str | None = None, segment: int = SEGMENT, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of every row of docs (doc_id, text), as SCHEMA has them.

    Null or empty text: the end id alone. Null doc_id: kept, null. Repeated rows: rows of their own.
    An empty table gives no pieces. Other columns are ignored. sequence_id is unique: the
    partition's number in the upper bits, the sequence's in the lower 33.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _LOADED.clear)
        tokenizer = load(path)
        number = TaskContext.get().partitionId() << 33
        held: list[Held] = []
        size, enough = 0, segment
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist(), remembered)):
                    held.append(Held(doc_id, 0, len(ids) + 1, np.append(ids, np.uint16(END_ID))))
                    size += len(ids) + 1
                    if size >= enough:
                        out, number, held = solve(held, tokenizer.stops, number, last=False)
                        size = sum(len(x.ids) for x in held)
                        # As much again as is left, so that no id is looked at often.
                        enough = size + max(segment, size)
                        if out is not None:
                            yield out
        if held:
            yield solve(held, tokenizer.stops, number)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of all documents that came through, in their order. Null and empty texts, null ids, repeated rows, an empty
    table: as pack() has them. Other columns are left out."""
    return pack(docs, remembered=REMEMBERED_AMONG_OTHERS)
