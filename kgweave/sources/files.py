"""Readers and writers of rule files, applied rules, dependencies and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.evidence import head_relation

FIRED = "direction string, rel string, query string, cand string, rule_id long"
#: direction -> relation -> query -> candidate -> rules.
APPLIED = "map<string, map<string, map<string, map<string, array<bigint>>>>>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_id (line number from 1, blank lines and comments counted), body_size, support, conf, rule, head_rel.

    Lines are numbered by their place in the file, which needs each file read as one: rule files are
    small next to facts.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = whole.select((F.col("at") + 1).cast("long").alias("rule_id"), F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    f = F.when(F.col("line").contains("\t"), F.split("line", "\t", 4)).otherwise(F.split("line", r"\s+", 4))
    out = lines.select("rule_id", f.alias("f")).where(F.size("f") == 4)
    out = out.select("rule_id", F.col("f")[0].cast("long").alias("body_size"), F.col("f")[1].cast("long").alias("support"), F.col("f")[2].cast("double").alias("conf"), F.col("f")[3].alias("rule"))
    return out.withColumn("head_rel", head_relation(F.col("rule")))


def supported(rules: DataFrame, least: int) -> DataFrame:
    return rules.where(F.col("support") >= least)


def write_rules(rules: DataFrame, path: str) -> None:
    rules.select("body_size", "support", "conf", "rule").write.csv(path, sep="\t", quote="")


def write_applied(fired: DataFrame, path: str) -> None:
    """One JSON line for each direction, relation and query; rule ids that aren't positive are left out."""
    rules = fired.where("rule_id > 0").groupBy("direction", "rel", "query", "cand").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    cands = rules.groupBy("direction", "rel", "query").agg(F.map_from_entries(F.collect_list(F.struct("cand", "rules"))).alias("c"))
    nested = F.create_map("direction", F.create_map("rel", F.create_map("query", "c")))
    cands.select(F.to_json(nested).alias("value")).write.text(path)


def read_applied(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.text(path).select(F.from_json("value", APPLIED).alias("m"))
    for name in ("direction", "rel", "query", "cand"):
        keep = [c for c in got.columns if c != "m"]
        got = got.select(*keep, F.explode("m").alias(name, "v")).withColumnRenamed("v", "m")
    return got.select("direction", "rel", "query", "cand", F.explode("m").alias("rule_id")).where("rule_id > 0")


def write_dependencies(deps: DataFrame, path: str, threshold: float = 0.0) -> None:
    """synergy and redundancy, tab-separated: body, support, lift (five places), a, b."""
    columns = ["body", "support", F.round("lift", 5).alias("lift"), "a", "b"]
    deps.where(F.col("lift") > threshold).select(*columns).write.csv(f"{path}/synergy", sep="\t")
    deps.where(F.col("lift") < -threshold).select(*columns).write.csv(f"{path}/redundancy", sep="\t")


def read_dependencies(spark: SparkSession, path: str, rules: DataFrame | None = None) -> DataFrame:
    """a <= b, each pair once; with rules (rule_id, head_rel), only pairs of one relation."""
    raw = spark.read.csv(path, sep="\t", schema="body long, support long, lift double, id1 long, id2 long")
    got = raw.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "body", "support", "lift")
    if rules is not None:
        rel = rules.select("rule_id", "head_rel")
        got = got.join(rel.toDF("a", "rel"), "a").join(rel.toDF("b", "rel_b"), "b").where("rel = rel_b").drop("rel_b")
    first = Window.partitionBy("a", "b").orderBy(F.abs("lift").desc(), "support")
    return got.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def without_classes(deps: DataFrame, rules: DataFrame, classes: list[str]) -> DataFrame:
    """Pairs of which neither rule is of the classes. rules: rule_id, class."""
    off = rules.where(F.col("class").isin(classes)).select("rule_id")
    return deps.join(off.toDF("a"), "a", "left_anti").join(off.toDF("b"), "b", "left_anti")


def write_ranks(ranks: DataFrame, path: str) -> None:
    ranks.write.csv(path, header=True)


def scraped_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of `name: 0.123` or `name=0.123` in the lines of a log."""
    line = spark.read.text(path)
    found = F.regexp_extract("value", r"(?i)\b(mrr|hits@\d+|h@?\d+)\s*[:=]\s*([0-9.]+)", 1), F.regexp_extract("value", r"(?i)\b(mrr|hits@\d+|h@?\d+)\s*[:=]\s*([0-9.]+)", 2)
    return line.select(F.lower(found[0]).alias("metric"), found[1].cast("double").alias("value")).where("metric <> ''")
