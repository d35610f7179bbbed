"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source, documents stand in the order of their
keys; each source is cut exactly where the running sum of sizes meets its budget. Budgets over a
source's size take whole epochs first.

The running sum is distributed: the key's leading digits deal a source into even buckets, bucket
totals (a small table) are summed up in order, and only rows of one bucket are sorted together. So
a source with a third of all rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Leading hex digits of the key that make a bucket: 4,096 for each source.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Columns skey, source_size (long), target (double), from one row per source: source, skey, source_size.

    Sources in code-point order, null last, take the weights in turn. Water filling: a source whose
    share is above `most` times its size stops there, and the excess is shared by weight among the
    others. Sorted by the level at which a source is full, the first k are full for the least k
    whose level stays at or under the next source's.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn.cast("int") + 1).cast("long"))
    t = t.withColumn("full", F.col("source_size") * most).withColumn("level", F.col("full") / F.col("weight"))
    filling = Window.orderBy("level", F.col("source").isNull(), "source")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    t = t.withColumn("common", (F.col("all_size") * F.lit(float(share)) - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before")))
    t = t.withColumn("nth", F.row_number().over(filling))
    t = t.withColumn("first", F.min(F.when(F.col("common") <= F.col("level"), F.struct("nth", "common"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), F.col("full").cast("double")).otherwise(F.col("weight") * F.col("first.common"))
    return t.select("skey", "source_size", F.least(target, F.col("full").cast("double")).alias("target"))


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", tie: tuple[str, ...] = ()) -> DataFrame:
    """Add source_size, target, taken (all of size's unit) to rows that have doc_id, source, size (long).

    Null doc_id: a document like any other, with a key of its size and the columns in `tie`, so that
    many of them spread. Null source: a source of its own. Equal doc_ids have equal keys and stand by size, then
    by the columns in `tie`; repeated rows are rows of their own. An empty table gives an empty result; a
    source of size 0 has target 0. Other columns pass through, whatever their names, except for those
    of the result's names, which are replaced. The result is a function of the rows: it does not
    depend on partitions or reruns.
    """
    named = [c for c in sized.columns if c not in ("source_size", "target", "taken")]
    # All columns of the caller stand in one struct, so that no name of theirs can clash.
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", F.lit("null"), *[F.col(c).cast("string") for c in ("size", *tie)]))
    rows = sized.select(
        F.struct(*[F.col(c) for c in named]).alias("row"), "size", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        F.md5(F.encode(F.concat_ws(":", F.lit(seed), own), "UTF-8")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("row.source").alias("source"))
    sources = buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sources, weights, share, most)
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).select("skey", "bucket", "bucket_start").join(targets, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("key", "row.doc_id", "size", *[f"row.{c}" for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["skey", "bucket"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    start = F.col("bucket_start") + F.col("in_bucket")
    left = budget - epochs * F.col("source_size") - start
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return out.select(*[F.col("row")[c].alias(c) for c in named], "source_size", "target", taken.cast("long").alias("taken"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    sized = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), spread.alias("spread")), "mix")
    return mix(sized, tie=("spread",)).select("doc_id", "size", "source_size", "target", "taken")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each epoch that takes at least half of a document's words.

    Documents without words (null or empty texts) stay once: they cost no budget. Null doc_id or source: as
    mix() has them. Repeated rows: rows of their own. An empty table gives no rows. Other columns pass
    through, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"))
    mixed = mix(sized, tie=("text_md5",))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    again = mixed.select("doc", times.alias("times")).where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("again"))
    return again.select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources),
levels AS (SELECT *, 2 * source_size AS f, CAST(2 * source_size AS DOUBLE) / weight AS level FROM weighed),
filled AS (
  SELECT *, row_number() OVER w1 AS nth, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(f) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS common
  FROM levels
  WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w1 AS (ORDER BY level, source NULLS LAST)),
water AS (SELECT min(nth) AS first, arg_min(common, nth) AS water FROM filled WHERE common <= level),
targets AS (
  SELECT source, source_size,
         least(CASE WHEN first IS NULL OR nth < first THEN f::DOUBLE ELSE weight * water END, f::DOUBLE) AS target
  FROM filled, water),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
timed AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM timed
"""
