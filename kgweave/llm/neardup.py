"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature has VALUES values, of which the forest uses TREES * LEAST. Each tree is the list of all
signatures in its own order: tree t reads the values from place t * LEAST on, round the end. Documents that stand next to each other in
a tree share the longest prefixes; those sharing LEAST values or more are candidates. No depth is
fixed for all: where a prefix is shared by few documents it is used as it is, where it is shared by
many the order goes deeper, up to DEEPEST values.

Work goes in two rounds, so that a group of thousands of near copies costs a few comparisons for
each member instead of all pairs:

1. neighbours: all trees are sorted as one table over all partitions; each run of a shared prefix,
   in blocks of BLOCK rows, gives the pairs (block's least id, member) and (member, next member).
   Confirmed pairs make components.
2. rest: where a region still has several components, every document outside the region's largest
   one is compared with every document of the others. Documents of regions that would need more than
   MOST_PAIRS meet on their rare shingles instead (rare_shingles()), which leaves out no link.

Two documents at a Jaccard similarity of s share a region in some tree with probability
1 - (1 - s ** LEAST) ** TREES: 0.999998 at s = 0.75.

Candidates are confirmed on the full shingle sets. Documents with equal sets are one class from the
start. Components are found by alternating stars over tables; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, discard, ship, stash, table

SHINGLE = 5
TREES, LEAST, DEEPEST = 24, 3, 8
#: Values of a signature; the trees use the first TREES * LEAST, sketches and estimates all.
VALUES = 128
BLOCK = 256
MOST_PAIRS = 4096
#: In the first round, pairs whose signatures agree in less than this part are left to the second (off by 4.4 standard deviations).
LEAST_AGREEMENT = 0.58
#: Sketches hold four bits of each value. At 0.75, 30 of them differ on average; in the first round, pairs with
#: more than this (3.5 standard deviations) are left to the second, which goes by exact bounds alone.
MOST_UNLIKE = 46
SKETCH = [f"s{k}" for k in range(VALUES // 16)]
GROUPS, LEVELS = 128, 4
PROFILE = [f"p{k}" for k in range(GROUPS * LEVELS // 64)]
#: Places in which shingles are counted to put rare ones first, a byte each: 4 MB.
COUNTED = 1 << 22
#: Up to so many ids (8 bytes each) the list of documents to be compared is broadcast; beyond it, joined.
MOST_BROADCAST = 1_000_000

_RANDOM = np.random.RandomState(20240229)
_ODD = lambda n: _RANDOM.randint(0, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _SCALE, _SHIFT, _LENGTH = _ODD(SHINGLE), _ODD(VALUES), _ODD(VALUES), _ODD(1)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    if n < 1:
        return mixed((h * _PLACE[: len(h)]).sum(keepdims=True) + np.full(1, len(h), np.uint64) * _LENGTH)
    return np.unique(mixed(reduce(np.add, (h[k : k + n] * _PLACE[k] for k in range(SHINGLE)))))


def signature(shingles: np.ndarray) -> bytes:
    """VALUES minimums as big-endian 32-bit integers, so that bytes sort as the values do."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        np.minimum(least, (part * _SCALE + _SHIFT).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def sketch(sig: bytes) -> list[int]:
    """The lowest four bits of all values, in signed 64-bit integers."""
    low = np.frombuffer(sig, np.uint8)[3::4] & 15
    return (low[::2] << 4 | low[1::2]).view(np.int64).tolist()


def may_link(x: tuple, y: tuple) -> bool:
    """Whether two (node, n, *SKETCH) are worth a look in the first round."""
    if 75 * max(x[1], y[1]) > 100 * min(x[1], y[1]):
        return False
    unlike = 0
    for a, b in zip(x[2:], y[2:]):
        d = (a ^ b) & (2**64 - 1)
        unlike += ((d | d >> 1 | d >> 2 | d >> 3) & 0x1111111111111111).bit_count()
    return unlike <= MOST_UNLIKE


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (hex of the set's 128-bit hash; null if empty), sig, and the sketch's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            parts = [sketch(s) if s else [None] * len(SKETCH) for s in sigs]
            sketches = [pa.array([p[k] for p in parts], pa.int64()) for k in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.binary()), *sketches], names=["doc_id", "n_shingles", "set_key", "sig", *SKETCH])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key string, sig binary" + "".join(f", {k} long" for k in SKETCH))


def tree_rows(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: tree, path (the first DEEPEST values), node."""
    own = F.expr(f"substring(sig, 1, {4 * TREES * LEAST})")
    trees = classes.select("node", F.concat(own, own).alias("twice"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return trees.select("tree", F.expr(f"substring(twice, tree * {4 * LEAST} + 1, {4 * DEEPEST})").alias("path"), "node")


def region(depth: int) -> Column:
    return F.xxhash64("tree", F.expr(f"substring(path, 1, {4 * depth})"))


def crowded(rows: DataFrame) -> DataFrame:
    """Rows whose first LEAST values stand in another row of the tree, too."""
    keyed = rows.withColumn("region", region(LEAST))
    many = keyed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    return keyed.join(many, "region", "left_semi")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs a < b of the forest's sorted orders, over all trees, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        at, center, last = None, None, None

        def pairs() -> Iterator[tuple[tuple, tuple]]:
            nonlocal center, last
            least = min(block)
            if center is not None:
                yield center, least
                yield last, block[0]
            yield from ((least, x) for x in block)
            yield from zip(block, block[1:])
            center, last = least, block[-1]

        def out(found: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            kept = list({(min(x[0], y[0]), max(x[0], y[0])) for x, y in found if x[0] != y[0] and may_link(x, y)})
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found: list[tuple[tuple, tuple]] = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at or len(block) == BLOCK:
                    if block:
                        found += pairs()
                    if key != at:
                        at, center, last = key, None, None
                    block = []
                block.append(tuple(row))
            yield out(found)
        if block:
            yield out(list(pairs()))

    ordered = rows.repartitionByRange("region", "path", "node").sortWithinPartitions("region", "path", "node")
    return ordered.select("region", "node", "n", *SKETCH).mapInArrow(run, "a long, b long").distinct()


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the documents (doc_id, text) that are listed in nodes."""
    few = nodes.count() <= MOST_BROADCAST
    return docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def profiles(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, and what bounds its overlap with others of the nodes: PROFILE, rest.

    Shingles that no other of the nodes has count for nothing. The others are counted in GROUPS by their
    hash; a count of up to LEVELS is that many bits, so that the number of bits two profiles have in
    common is the sum of the lesser counts, which their sets' overlap can't exceed; rest counts what
    is above LEVELS.
    """

    def each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(node)], names=["h", "node"])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                shared = np.setdiff1d(shingle_set(text), np.array(own or [], np.int64).view(np.uint64), assume_unique=True)
                counts = np.bincount((shared & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
                bits = np.packbits(counts[:, None] > np.arange(LEVELS)).view(np.int64)
                rows.append((node, *bits.tolist(), int(np.maximum(counts - LEVELS, 0).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2 + len(PROFILE))], names=["node", *PROFILE, "rest"])

    texts = texts_of(nodes, docs)
    each = texts.mapInArrow(each_shingle, "h long, node long").groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    own = each.where("c = 1").groupBy("node").agg(F.collect_list("h").alias("own"))
    return texts.join(own, "node", "left").mapInArrow(profile, "node long" + "".join(f", {k} long" for k in (*PROFILE, "rest"))).dropDuplicates(["node"])


def rare_shingles(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """crowd's columns (node, n and other longs) with region (a shingle): of each set of n shingles the n // 4 + 1 that come first in
    one order of all shingles.

    A link takes 3 / 4 of either set in common, so that two linked sets have a shingle in common among so
    many of their first, whatever the order. Ours puts rare ones first: by how many shingles of the nodes
    fall into the same of COUNTED places (by halves of the count's logarithm), then by the hash itself. The
    counts are a table of bounded size, so each document picks its own shingles where it is read, and only those are
    dealt out. Of them, those that are alone in their place are left out: no other document has them.
    """

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            place, c = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(COUNTED), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(c.astype(np.int64))], names=["place", "c"])

    names = crowd.columns
    # Documents are joined, not shingles: what the comparison needs goes through with each text.
    few = crowd.count() <= MOST_BROADCAST // len(names)
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(crowd) if few else crowd, "node").select("node", "text", *[F.col(c).cast("long").alias(f"own_{c}") for c in names])
    # A crowd may stand in few parts of the table; its texts are dealt over all tasks.
    texts = texts.repartition("node")
    # COUNTED rows of five bytes at most.
    level = F.floor(F.log2(F.sum("c")) * 2).cast("tinyint")
    rows = texts.mapInArrow(counting, "place int, c long").groupBy("place").agg(level.alias("level")).where("level > 0").toArrow()
    counts = np.zeros(COUNTED, np.int8)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        often = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                kept, sizes = [], []
                for text, n in zip(part.column(1).to_pylist(), part.column(2 + names.index("n")).to_pylist()):
                    s = shingle_set(text)
                    level = often[(s % np.uint64(COUNTED)).astype(np.int64)]
                    # Rows with one id may have other texts.
                    order = np.lexsort((s, level))[: n // 4 + 1 if len(s) == n else 0]
                    own = s[order][level[order] > 0]
                    kept.append(own)
                    sizes.append(len(own))
                columns = [np.concatenate(kept).view(np.int64), *[np.repeat(c.to_numpy(), sizes) for c in part.columns[2:]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["region", *names])

    return texts.mapInArrow(first, ", ".join(f"{c} long" for c in ("region", *names))).dropDuplicates(["region", "node", "n"])


def unresolved(keyed: DataFrame) -> DataFrame:
    """Rows of the regions that hold several components: the region's largest component (top), and how many pairs it takes to compare all others with the whole region."""
    each = keyed.groupBy("region", "comp").agg(F.count("*").alias("m"))
    whole = each.groupBy("region").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"))
    whole = whole.where("m > top.m").select("region", F.col("top.comp").alias("top"), ((F.col("m") - F.col("top.m")) * F.col("m")).alias("pairs"))
    return keyed.join(whole, "region")


def between_components(rows: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of different components within the regions; where those would be too many, of documents with a rare shingle in common.

    Pairs whose profiles show that they have less in common than the 3 / 7 of both sizes that a link
    needs are left out.
    """
    rows = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = stash(unresolved(rows.withColumn("region", region(LEAST))), "regions")
    rows = stash(rows.join(profiles(stash(rows.select("node").distinct(), "ids"), docs), "node"), "regions")
    common = reduce(Column.__add__, [F.bit_count(F.col(f"x_{k}").bitwiseAND(F.col(f"y_{k}"))) for k in PROFILE]) + F.least("x_rest", "y_rest")

    def met(now: DataFrame) -> DataFrame:
        side = lambda df, c: df.select("region", F.col("node").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("comp", "n", "rest", *PROFILE)])
        pairs = side(now.where("comp <> top"), "x").join(side(now, "y"), "region").where("x_comp <> y_comp").where(common * 7 >= (F.col("x_n") + F.col("y_n")) * 3)
        return pairs.where(F.expr("75 * greatest(x_n, y_n) <= 100 * least(x_n, y_n)")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    found = met(rows.where(F.col("pairs") <= MOST_PAIRS))
    crowd = rows.where(F.col("pairs") > MOST_PAIRS).dropDuplicates(["node", "n"]).select("node", "n", "comp", "rest", *PROFILE)
    if crowd.isEmpty():
        return found
    return found.unionByName(met(unresolved(rare_shingles(stash(crowd, "crowd"), docs)))).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets. With classes, only pairs whose signatures agree enough are looked at."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(len(batch), VALUES) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        sets: dict[int, np.ndarray] = {}

        def of(doc: int, text: str) -> np.ndarray:
            if doc not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[doc] = shingle_set(text)
            return sets[doc]

        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            yield batch.select([0, 1]).filter(pa.array([linked(of(*p), of(*q)) for p, q in zip(zip(a, x), zip(b, y))], pa.bool_()))

    near = pairs
    if classes is not None:
        sig = classes.select("node", "sig")
        both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        near = stash(both.mapInArrow(agree, "a long, b long"), "near")
    ids = stash(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ids")
    texts = texts_of(ids, docs)
    both = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of the links, by alternating large and small stars.

    Each turn at least halves the longest path to the least node; a star's edges are rows, so a node
    with very many neighbours is spread like other rows by the adaptive skew join.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        new = stash(small, "edges")
        # Done when all edges are stars around nodes that are nobody's leaf.
        settled = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
        discard(edges)
        edges = new
        if settled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null or empty text, or blanks only: an empty set, linked with nothing. Equal texts: one class.
    Rows with one doc_id are one node: they share what any of them is linked with. A null doc_id is
    linked with nothing: component_id null, kept. An empty table gives no rows. Other columns are
    ignored.
    """
    ship(docs.sparkSession)
    rows = stash(signed(docs), "signed")
    full = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    least = full.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    member = full.join(least, "set_key")
    classes = stash(member.where("doc_id = node").select("node", "sig", *SKETCH, F.col("n_shingles").alias("n")).dropDuplicates(["node", "sig"]), "classes")
    # Rows with one doc_id and different texts are joined from the start, as classes are by their least id.
    same = member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    forest = stash(crowded(tree_rows(classes)).join(classes.drop("sig"), "node"), "forest")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    links = stash(confirmed(neighbours(forest), text, classes), "links")
    first = stash(components(links), "components")
    more = confirmed(stash(between_components(forest, first, text), "between"), text)
    labels = components(links.unionByName(more).unionByName(same))
    out = rows.join(labels, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_lsh_forest_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Of rows with that id, all stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
