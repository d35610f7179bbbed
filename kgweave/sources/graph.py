"""Triples: reading, writing, dictionaries, and the graph that a star schema holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLE = "h string, r string, t string"
#: Candidate facts of the target relation: customers and the brands of which they returned large lots.
TARGET = "returned_brand"


def read_triples(spark: SparkSession, path: str, order: str = "hrt") -> DataFrame:
    """Triples from text, split at tabs or blanks; lines without exactly three fields are left out. order: of the columns, as 'htr'."""
    parts = F.split(F.trim("value"), r"\s+")
    found = spark.read.text(path).select(parts.alias("f")).where(F.size("f") == 3)
    return found.select(*[F.col("f")[order.index(c)].alias(c) for c in "hrt"])


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select("h", "r", "t").write.csv(path, sep="\t")


def safe_name(name: Column, prefix: str) -> Column:
    """Names of digits only get a prefix, so that they can't be taken for ids."""
    return F.when(name.rlike("^[0-9]+$"), F.concat(F.lit(prefix), name)).otherwise(name)


def safe_triples(triples: DataFrame, entity: str = "e", relation: str = "r") -> DataFrame:
    return triples.select(safe_name(F.col("h"), entity).alias("h"), safe_name(F.col("r"), relation).alias("r"), safe_name(F.col("t"), entity).alias("t"))


def edges(triples: DataFrame) -> DataFrame:
    """rel, inv, src, dst: each triple in both directions."""
    forward = triples.select(F.col("r").alias("rel"), F.lit(False).alias("inv"), F.col("h").alias("src"), F.col("t").alias("dst"))
    return forward.unionByName(triples.select(F.col("r").alias("rel"), F.lit(True).alias("inv"), F.col("t").alias("src"), F.col("h").alias("dst")))


def loops(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("h") == F.col("t"))


def dictionary(names: DataFrame, column: str) -> DataFrame:
    """id (0-based, dense, in the order of names), name. Numbered by range, without one task that holds all names."""
    distinct = names.select(F.col(column).alias("name")).distinct()
    dealt = distinct.repartitionByRange(F.col("name")).sortWithinPartitions("name").select("name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m"))
    dealt = dealt.withColumn("nth", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").select((F.col("start") + F.col("nth")).alias("id"), "name")


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("h").alias("name")).union(triples.select("t")).distinct()


def encode(triples: DataFrame, entity_ids: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """s, p, o: ids; triples with unknown names are left out."""
    named = lambda d, c: d.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    out = triples.join(named(entity_ids, "s"), F.col("h") == F.col("s_name")).join(named(relation_ids, "p"), F.col("r") == F.col("p_name"))
    return out.join(named(entity_ids, "o"), F.col("t") == F.col("o_name")).select("s", "p", "o")


def write_by_relation(triples: DataFrame, path: str) -> None:
    triples.write.partitionBy("r").parquet(path)


def purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """x, y of the two relations that come from line items: large returned lots, and brands bought three times or more."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    bought = bought.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("x"), F.concat(F.lit("b:"), "p_brand").alias("y"), "l_returnflag", "l_quantity")
    returned = bought.where("l_returnflag = 'R' AND l_quantity >= 40").select("x", "y").distinct()
    return returned, bought.groupBy("x", "y").agg(F.count("*").alias("n")).where("n >= 3").select("x", "y")


def star_graph(spark: SparkSession, sf_dir: str, returned: DataFrame, liked: DataFrame) -> DataFrame:
    """The graph of the star-schema tables and purchases(): distinct h, r, t."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    triple = lambda df, h, r, o: df.select(h.alias("h"), F.lit(r).alias("r"), o.alias("t"))
    nation, customer, supplier, part, orders, lineitem, events = map(t, ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    parts = [
        triple(nation, name("n:", "n_nationkey"), "in_region", name("r:", "n_regionkey")),
        triple(customer, name("c:", "c_custkey"), "c_nation", name("n:", "c_nationkey")),
        triple(customer, name("c:", "c_custkey"), "c_segment", name("seg:", "c_mktsegment")),
        triple(supplier, name("s:", "s_suppkey"), "s_nation", name("n:", "s_nationkey")),
        triple(part, name("p:", "p_partkey"), "p_brand", name("b:", "p_brand")),
        triple(part, name("p:", "p_partkey"), "p_type", name("ty:", "p_type")),
        triple(orders, name("o:", "o_orderkey"), "placed_by", name("c:", "o_custkey")),
        triple(lineitem, name("o:", "l_orderkey"), "has_part", name("p:", "l_partkey")).distinct(),
        triple(lineitem, name("s:", "l_suppkey"), "supplies", name("p:", "l_partkey")).distinct(),
        triple(events, name("u:", "user_id"), "did", name("e:", "event_type")).distinct(),
        triple(returned, F.col("x"), TARGET, F.col("y")),
        triple(liked, F.col("x"), "likes_brand", F.col("y")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation(triples: DataFrame, name: str) -> DataFrame:
    """x, y of one relation: the filter reaches the branch of the union that makes it."""
    return triples.where(F.col("r") == name).select(F.col("h").alias("x"), F.col("t").alias("y"))


def split_of(x: Column) -> Column:
    """train, valid or test by the number in an entity's name: 0 of 5 test, 1 of 5 valid."""
    fold = F.split(x, ":")[1].cast("long") % 5
    return F.when(fold == 0, "test").when(fold == 1, "valid").otherwise("train")
