"""K-d tree sharding, with DataFrame operations only.

Documents are points in a space of metadata (id, size, source, language). The tree splits a node
along its widest dimension at a weighted median, so that both sides hold bytes in proportion to
the shards they will become, until every leaf is one shard of about total / n_shards bytes.

A split is found without sorting: rows sum their bytes into 4,096 bins of the node's range, a
window over the bins finds the one where the wanted share is crossed, and that bin is divided again
until it holds less than a thousandth of a shard. Behind equal values of the dimension stand 32
bits of a hash, so that ties (one source with a third of all rows) are divided as finely as any
other rows. All nodes of one level share each job. The driver holds only the tree: n_shards - 1
cuts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, utf8

N_SHARDS = 24
DIMENSIONS = ("kd_id", "kd_size", "kd_source", "kd_lang")
BIN_BITS = 12
VALUE_BITS, TIE_BITS = 31, 32
#: Groups of equal texts stay together up to this part of a shard's bytes.
GROUP_PART = 8
#: Slots are counted in so many parts of each shard.
SLOT_PARTS = 1024
#: A cut is off by half of this part of a shard at most, unless one document is larger.
FINE = 0.001


@dataclass
class Node:
    """shards: the shards below. Keys at or under cut go left; dimension, low and width make the key."""

    shards: range
    dimension: int = 0
    low: float = 0.0
    width: float = 1.0
    cut: int = (1 << (VALUE_BITS + TIE_BITS)) - 1
    wanted: float = 0.0
    settled: int = 0
    left: float = 0.0


def of_node(nodes: list[Node], value, kind: str) -> Column:
    """value(node) of the row's node, from a literal array: a level has n_shards nodes at most."""
    return F.get(F.array(*[F.lit(value(x)).cast(kind) for x in nodes]), F.col("kd_node"))


def key_of(nodes: list[Node]) -> Column:
    """Place along the node's dimension: 31 bits of the value within the node, then 32 bits of a hash."""
    top = (1 << VALUE_BITS) - 1
    place = (F.get(F.array(*DIMENSIONS), of_node(nodes, lambda x: x.dimension, "int")) - of_node(nodes, lambda x: x.low, "double")) / of_node(nodes, lambda x: x.width, "double")
    value = F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)) * F.lit(float(top))).cast("long")
    return F.shiftleft(value, TIE_BITS).bitwiseOR(F.col("kd_tie"))


def measure(points: DataFrame, nodes: list[Node]) -> set[int]:
    """Choose each node's widest dimension and what its left side shall hold. Return the nodes to be split that have rows."""
    spans = points.groupBy("kd_node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))])
    live = set()
    for r in spans.collect():
        node, width = nodes[r["kd_node"]], [r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMENSIONS]
        if len(node.shards) > 1:
            node.dimension = width.index(max(width))
            node.low, node.width = float(r[f"lo_{DIMENSIONS[node.dimension]}"]), float(max(width)) or 1.0
            node.wanted = r["bytes"] * (len(node.shards) // 2) / len(node.shards)
            live.add(r["kd_node"])
    return live


def find_cuts(points: DataFrame, nodes: list[Node], live: set[int]) -> None:
    """Weighted medians of all live nodes at once, BIN_BITS bits of the key with each job."""
    bits = VALUE_BITS + TIE_BITS
    while live and bits:
        step = min(BIN_BITS, bits)
        bits -= step
        bins = (
            points.where(F.col("kd_node").isin(sorted(live)))
            .select("kd_node", "size", key_of(nodes).alias("kd_key"))
            .where(F.shiftright("kd_key", bits + step) == of_node(nodes, lambda x: x.settled, "long"))
            .groupBy("kd_node", F.shiftright("kd_key", bits).alias("kd_bin"))
            .agg(F.sum("size").alias("bytes"))
        )
        upto = Window.partitionBy("kd_node").orderBy("kd_bin").rowsBetween(Window.unboundedPreceding, 0)
        passed = bins.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") >= of_node(nodes, lambda x: x.wanted - x.left, "double"))
        for r in passed.groupBy("kd_node").agg(F.min(F.struct("upto", "kd_bin", "bytes")).alias("at")).collect():
            node, at = nodes[r["kd_node"]], r["at"]
            before = node.left + at["upto"] - at["bytes"]
            if bits == 0 or at["bytes"] <= FINE * node.wanted / (len(node.shards) // 2):
                nearer = node.wanted - before >= at["bytes"] / 2
                node.cut = ((at["kd_bin"] + nearer) << bits) - 1
                live.discard(r["kd_node"])
            else:
                node.settled, node.left = at["kd_bin"], before


def split_all(points: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Add kd_node, the shard, to points (kd_* columns and size). Each level is one more column value, written to the shared folder."""
    nodes = [Node(range(n_shards))]
    points = points.withColumn("kd_node", F.lit(0))
    while any(len(x.shards) > 1 for x in nodes):
        find_cuts(points, nodes, measure(points, nodes))
        below, left = [], []
        for x in nodes:
            left.append(len(below))
            half = len(x.shards) // 2
            below += [Node(x.shards[:half]), Node(x.shards[half:])] if half else [x]
        right = (key_of(nodes) > of_node(nodes, lambda x: x.cut, "long")).cast("int")
        chosen = F.get(F.array(*[F.lit(i) for i in left]), F.col("kd_node")) + right
        points, nodes = stash(points.withColumn("kd_node", chosen), "kd"), below
    return points


def points_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, kd_row (a number of its own), kd_text (the text's hash), and metadata. Null names stand at 0."""
    text = utf8(F.col("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8
    code = lambda c: (F.crc32(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")) / F.lit(4294967295.0)).alias(f"kd_{c}")
    return docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("kd_row"), F.xxhash64(text).alias("kd_text"), code("source"), code("lang"))


def grouped(base: DataFrame, n_shards: int) -> DataFrame:
    """base with kd_tie, and doc_id's place, source and language of the group: those of its least row.

    Groups with more than that part of the bytes or of the rows (many empty texts, say) are few, 2 * GROUP_PART * n_shards at most;
    their rows are points of their own.
    """
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = GROUP_PART * n_shards
    large = base.groupBy("kd_text").agg(F.sum("size").alias("kd_bytes"), F.count("*").alias("kd_rows")).where((F.col("kd_rows") > 1) & ((F.col("kd_bytes") > total // parts) | (F.col("kd_rows") > n // parts)))
    large = large.select("kd_text").withColumn("kd_large", F.lit(True))
    marked = base.join(F.broadcast(large), "kd_text", "left")
    marked = marked.withColumn("kd_key", F.when(F.col("kd_large"), F.xxhash64("kd_text", "kd_row")).otherwise(F.col("kd_text")))
    group = Window.partitionBy("kd_key")
    least = F.min(F.struct(F.col("doc_id").cast("double").alias("kd_id"), "kd_source", "kd_lang")).over(group)
    out = marked.withColumn("kd_least", least).withColumn("kd_tie", F.xxhash64("kd_key").bitwiseAND(F.lit((1 << TIE_BITS) - 1)))
    return out.select("doc_id", "size", "text_crc32", "kd_row", "kd_tie", "kd_least.*")


def scaled(base: DataFrame) -> DataFrame:
    """Id and log size brought to the range 0 to 1, as the hashed names are."""
    r = base.agg(F.min("kd_id"), F.max("kd_id"), F.max("size").cast("double")).first()
    low, high, largest = (float(x) if x is not None else 0.0 for x in r)
    kd_id = (F.coalesce(F.col("kd_id"), F.lit(low)) - F.lit(low)) / F.lit(high - low or 1.0)
    return base.withColumn("kd_id", kd_id).withColumn("kd_size", F.log2("size") / F.lit(math.log2(max(2.0, largest))))


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Return doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text, source, lang).

    Null text: size 8, equal to an empty one. Null doc_id, source or lang: a value of its own. Repeated rows are rows
    of their own. Equal texts are in one shard, unless they have more than 1 / GROUP_PART of a shard's
    bytes or rows. Empty tables give no rows. Fewer rows than shards: some shards stay empty. Other columns are
    ignored. Slots count from 0 without gaps within a shard, by part of the shard, then doc_id,
    checksum and the row's place in the table.
    """
    base = stash(points_of(docs), "kd")
    points = scaled(stash(grouped(base, n_shards), "kd"))
    part = F.pmod(F.xxhash64("kd_row"), F.lit(SLOT_PARTS)).cast("int")
    placed = split_all(points, n_shards).select("doc_id", "size", "text_crc32", "kd_row", F.col("kd_node").alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "kd_row")
    return placed.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))


def op6_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
