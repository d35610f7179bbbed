"""SimHash fingerprints, with DataFrame operations only.

A text's terms are its pairs of neighbouring words (the last word stands alone), each with a weight of
1 to 4 by its length. A term's 128 hash bits vote with its weight, once for each time it occurs;
a fingerprint bit is set where the votes for 1 outweigh the others.

All 128 counts come from one pass of sums: bits i, i + 16, i + 32 and i + 48 of a 64-bit hash are the
four 16-bit lanes of (hash >>> i) & 0x0001000100010001, so 32 sums of longs hold every count of a
chunk of CHUNK words, within generated code and map-side aggregation. Chunks of a text are added up
afterwards; all but very long texts have one.

Fingerprints within a Hamming radius r agree on one of r + 1 blocks at least; a table for each
block, the block's bits permuted to the front, finds all of them by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, stash, table, utf8

BITS = 128
LANES, LOW = 0x0001000100010001, 0xFFFF
#: 4 votes at most for each word: the topmost of four lanes stays under 2 ** 15, as the sums are signed.
CHUNK = 8_191
RADIUS = 3
#: Queries of the neighbour search: ids divisible by this, against all rows.
QUERY_STEP = 50
SEED = 7


def terms_of(text: Column) -> Column:
    """Array of longs, one for each word: the pair's hash, with weight - 1 in the last two bits."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.split(bare, f"[{BLANKS}]+")
    rest = F.slice(words, F.lit(2), F.size(words))
    size = lambda w: F.coalesce(F.octet_length(w), F.lit(0))
    weight = lambda a, b: F.least((size(a) + size(b)) / 5, F.lit(3)).cast("long")
    pairs = F.zip_with(words, rest, lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(-4)).bitwiseOR(weight(a, b)))
    return F.when(bare != "", pairs)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp_a, fp_b (longs; the 128 bits) for rows with a column text; keys must tell rows apart."""
    each = texts.select(*keys, F.posexplode_outer(terms_of(F.col("text"))).alias("at", "t"))
    each = each.select(*keys, F.coalesce(F.floor(F.col("at") / CHUNK), F.lit(0)).alias("chunk"), F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(SEED)).alias("b"), (F.col("t").bitwiseAND(F.lit(3)) + 1).alias("w"))
    lane = lambda h, i: F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w"))
    sums = each.groupBy(*keys, "chunk").agg(F.sum("w").alias("all"), *[lane(h, i).alias(f"{h}{i}") for h in ("a", "b") for i in range(16)])
    counts = lambda h: F.array(*[F.coalesce(F.col(f"{h}{i}"), F.lit(0)) for i in range(16)])
    whole = sums.groupBy(*keys).agg(F.coalesce(F.sum("all"), F.lit(0)).alias("all"), F.collect_list(counts("a")).alias("a"), F.collect_list(counts("b")).alias("b"))

    def bits(h: str) -> Column:
        def bit(place: Column) -> Column:
            lane_of = lambda c: F.call_function("shiftrightunsigned", F.get(c, F.pmod(place, F.lit(16))), F.floor(place / 16).cast("int") * 16).bitwiseAND(F.lit(LOW))
            on = F.aggregate(h, F.lit(0).cast("long"), lambda total, c: total + lane_of(c))
            return F.when(on * 2 > F.col("all"), F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return whole.select(*keys, bits("a").alias("fp_a"), bits("b").alias("fp_b"))


def as_text(a: Column, b: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (a, b)])


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.lit(1.0) - distance(a, b, c, d) / F.lit(float(BITS))


def permuted(fps: DataFrame, radius: int) -> DataFrame:
    """A row for each of the radius + 1 blocks: block number and bits."""
    bits = F.concat(*[F.lpad(F.bin(c), 64, "0") for c in ("fp_a", "fp_b")])
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    blocks = F.array(*[F.substring(bits, a + 1, b - a) for a, b in zip(edges, edges[1:])])
    return fps.select("*", F.posexplode(blocks).alias("block", "front"))


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (q_a, q_b, fp_a, fp_b) with distance <= radius between the distinct fingerprints of both (fp_a, fp_b)."""
    q = permuted(queries.select("fp_a", "fp_b").distinct(), radius).select(F.col("fp_a").alias("q_a"), F.col("fp_b").alias("q_b"), "block", "front")
    x = permuted(index.select("fp_a", "fp_b").distinct(), radius)
    near = q.join(x, ["block", "front"]).where(distance(F.col("q_a"), F.col("q_b"), F.col("fp_a"), F.col("fp_b")) <= radius)
    return near.select("q_a", "q_b", "fp_a", "fp_b").distinct()


KEY = ["k", "h", "g"]


def followers(ids: DataFrame) -> DataFrame:
    """KEY, and the next row's as next_k, next_h, next_g: by descending k, then h and g; after the last, the first. ids: distinct KEY.

    Rows are dealt by range; each looks ahead within its range, and a range's last row takes the
    first one of the next range, from a table of one row for each range.
    """
    order = [F.col("k").desc(), F.col("h").desc(), F.col("g").desc()]
    dealt = stash(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    ahead = Window.partitionBy("part").orderBy(*order)
    key = F.struct(*KEY)
    turn = Window.orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = dealt.groupBy("part").agg(F.max(key).alias("f"))
    after = first.select("part", F.coalesce(F.lead("f").over(turn), F.first("f").over(whole)).alias("f"))
    out = dealt.select("part", *KEY, F.lead(key).over(ahead).alias("n")).join(after, "part").withColumn("n", F.coalesce("n", "f"))
    return out.select(*KEY, *[F.col(f"n.{c}").alias(f"next_{c}") for c in KEY])


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in KEY})


def on_key(prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(c) == F.col(f"{prefix}_{c}") for c in KEY])


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of docs (doc_id, text).

    Null or empty text: no terms, all bits 0, likeness 1 to others of that kind. Null doc_id: last in
    descending order. Rows with one doc_id follow each other by their text's hashes; repeated rows (one id, one
    text) follow each other, so all but one of them have their own text next. A single row's next document
    is itself. An empty table gives no rows. Other columns are ignored.

    Work is done once for each id and text, so that an id or a repeated row that many rows share
    (null ids, say) is dealt like others.
    """
    lowest = -(1 << 63)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text")).withColumn("g", F.hash("text"))
    rows = stash(base.select(*KEY).withColumn("row", F.monotonically_increasing_id()), "rows")
    sets = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("row").alias("last"))
    links = stash(sets.join(named(followers(sets.select(*KEY)), "l"), on_key("l")).drop("l_k", "l_h", "l_g"), "links")
    # Both uses of the texts are one aggregate, so that they are dealt once.
    whole = base.groupBy(*KEY).agg(F.first("text").alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    this = whole.join(named(links.drop("last"), "l"), on_key("l")).select(*KEY, "copies", "next_k", "next_h", "next_g", F.length("text").alias("n"), half.alias("half"), "text")
    needs = this.select(*[F.col(c).alias(f"w_{c}") for c in KEY], F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("next_g").alias("g"), "half")
    given = needs.join(whole, KEY).select("w_k", "w_h", "w_g", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("tail"))
    start = F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("half"))
    copy = lambda which, text: F.struct(F.lit(which).alias("which"), text.alias("text"))
    copies = F.array(copy(0, F.col("text")), copy(1, F.concat(start, F.col("tail"))))
    # Repeated rows come before themselves.
    own = F.array(copy(2, F.concat(start, F.substring(F.col("text"), F.lit(1), F.col("half")))))
    both = this.join(given, on_key("w")).select(*KEY, "n", F.explode(F.when(F.col("copies") > 1, F.concat(copies, own)).otherwise(copies)).alias("v"))
    keys = [*KEY, "n", "which", "sha"]
    each = both.select(*KEY, "n", F.col("v.which").alias("which"), F.when(F.col("v.which") > 0, F.sha2(utf8(F.col("v.text")), 256)).alias("sha"), F.col("v.text").alias("text"))
    fps = stash(fingerprints(each, keys), "fps")
    mine = fps.where("which = 0").select(*KEY, "n", "fp_a", "fp_b")
    new = fps.where("which > 0").select(*KEY, "which", F.col("fp_a").alias("e_a"), F.col("fp_b").alias("e_b"), F.col("sha").alias("e_sha"))
    after = mine.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("fp_a").alias("n_a"), F.col("fp_b").alias("n_b"))
    searched = (F.col("k") % QUERY_STEP == 0) & (F.col("k") > lowest)
    found = within_radius(mine.where(searched), mine).where("q_a <> fp_a OR q_b <> fp_b")
    counts = found.groupBy(F.col("q_a").alias("fp_a"), F.col("q_b").alias("fp_b")).agg(F.count("*").alias("found"))
    known = mine.join(links, KEY).join(after, ["next_k", "next_h", "next_g"]).join(new, KEY)
    # Of each id and text two results: that of the last of its rows, and that of the others.
    known = known.withColumn("n_a", F.when(F.col("which") == 2, F.col("fp_a")).otherwise(F.col("n_a"))).withColumn("n_b", F.when(F.col("which") == 2, F.col("fp_b")).otherwise(F.col("n_b")))
    known = known.join(counts, ["fp_a", "fp_b"], "left")
    c = F.col
    known = known.select(
        *KEY, "which", "last", F.when(c("k") > lowest, c("k")).alias("doc_id"), c("n").cast("long").alias("n_chars"), c("e_sha").alias("edited_sha256"), as_text(c("fp_a"), c("fp_b")).alias("fingerprint"),
        as_text(c("e_a"), c("e_b")).alias("edited_fingerprint"), likeness(c("fp_a"), c("fp_b"), c("e_a"), c("e_b")).alias("near_edited"), likeness(c("fp_a"), c("fp_b"), c("n_a"), c("n_b")).alias("near_next"),
        F.when(searched, F.coalesce("found", F.lit(0))).alias("n_within_radius"),
    )
    of_row = F.when(F.col("row") == F.col("last"), 1).otherwise(2) == F.col("which")
    return rows.join(known, KEY).where(of_row).drop(*KEY, "row", "which", "last")


def op4_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
