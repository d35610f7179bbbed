"""The tables that the plans start from, as DataFrames; each twin of a table expression in sql.py."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.evidence import CAP, SMOOTH_APPLIED, SMOOTH_MINED, confidence, evidence, rule_class, type_weight
from ..functions.language import Step
from ..operators import answering, dependencies, paths, sets, support
from ..sources.graph import TARGET, edges, purchases, relation, split_of, star_graph
from ..sources.stash import stash

#: Bodies kept for each head when pairs are mined (the reference's TOP_K), and the supports that rules and pairs need.
TOP_BODIES, LEAST_SUPPORT, LEAST_PAIR = 500, 3, 2
WALK = (Step("c_nation"), Step("c_nation", True), Step(TARGET))


class shared(cached_property):
    """A table that several parts of a query read: written to the shared folder once, so that plans stay small."""

    def __init__(self, f):
        super().__init__(lambda self: stash(f(self), f.__name__))


class Base:
    """Tables of one directory. Those that are shared are computed when a query is planned that needs them, the rest with its result."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @shared
    def ret(self) -> DataFrame:
        return purchases(self.spark, self.sf_dir)[0]

    @shared
    def liked(self) -> DataFrame:
        return purchases(self.spark, self.sf_dir)[1]

    @cached_property
    def kg(self) -> DataFrame:
        return star_graph(self.spark, self.sf_dir, self.ret, self.liked)

    @cached_property
    def known(self) -> DataFrame:
        return self.ret.where(split_of(F.col("x")) == "train")

    @cached_property
    def gold(self) -> DataFrame:
        return self.ret.where(split_of(F.col("x")) == "test")

    @cached_property
    def graph(self) -> DataFrame:
        """Edges without the target's valid and test facts."""
        return edges(self.kg.where((F.col("r") != TARGET) | (split_of(F.col("h")) == "train")))

    @shared
    def catalog(self) -> DataFrame:
        """All rules: rule_id, rule, kind, body_rel, head_const, body_const. Numbered by a few thousand texts in order."""
        names = lambda rel: relation(self.kg, rel).select(F.col("y").alias("c")).distinct()
        brands = self.spark.read.parquet(f"{self.sf_dir}/part.parquet").select(F.concat(F.lit("b:"), "p_brand").alias("b")).distinct()
        text = lambda body: F.concat(F.lit(f"{TARGET}(X,"), "b", F.lit(") <= "), body)
        out = None
        for rel, consts in (("c_segment", names("c_segment")), ("c_nation", names("c_nation")), ("likes_brand", brands.toDF("c"))):
            part = brands.crossJoin(F.broadcast(consts)).select(text(F.concat(F.lit(f"{rel}(X,"), "c", F.lit(")"))).alias("rule"), F.lit("const").alias("kind"), F.lit(rel).alias("body_rel"), F.col("b").alias("head_const"), F.col("c").alias("body_const"))
            out = part if out is None else out.unionByName(part)
        none = F.lit(None).cast("string")
        exists = brands.select(text(F.lit("likes_brand(X,A)")).alias("rule"), F.lit("exists").alias("kind"), F.lit("likes_brand").alias("body_rel"), F.col("b").alias("head_const"), none.alias("body_const"))
        binary = self.spark.range(1).select(F.explode(F.array(
            F.struct(F.lit(f"{TARGET}(X,Y) <= likes_brand(X,Y)").alias("rule"), F.lit("binary").alias("kind"), F.lit("likes_brand").alias("body_rel")),
            F.struct(F.lit(f"{TARGET}(X,Y) <= c_nation(X,A), c_nation(B,A), {TARGET}(B,Y)").alias("rule"), F.lit("path").alias("kind"), F.lit("c_nation").alias("body_rel")),
        )).alias("s")).select("s.*", none.alias("head_const"), none.alias("body_const"))
        rules = out.unionByName(exists).unionByName(binary)
        return rules.select(F.row_number().over(Window.orderBy("rule")).cast("long").alias("rule_id"), "*")

    @shared
    def held(self) -> DataFrame:
        """x, y, hit, rules of all rules' bodies: a row for each x, y, not for each rule."""
        rules = self.catalog.withColumn("body_inv", F.lit(False))
        liked = paths.path_pairs(self.graph, [Step("likes_brand")]).select("x", F.array("y").alias("ys"))
        return sets.held(rules, self.graph, {"binary": liked, "path": paths.witnessed_lists(self.graph, WALK)}, self.known)

    @cached_property
    def inst(self) -> DataFrame:
        """rule_id, x, y of all rules' bodies."""
        return sets.instances(self.held)

    @shared
    def metrics(self) -> DataFrame:
        return support.set_metrics(self.held, SMOOTH_APPLIED)

    @shared
    def fired(self) -> DataFrame:
        """rule_id, x, y, evidence, conf of the test queries' candidates."""
        good = self.metrics.where("support > 0").select("rule_id", "evidence", "conf")
        return sets.instances(self.cands).join(F.broadcast(good), "rule_id")

    @cached_property
    def cands(self) -> DataFrame:
        """x, y, rules of the test queries' candidates, rules without support among them."""
        return self.held.where((split_of(F.col("x")) == "test") & ~F.col("hit")).select("x", "y", "rules")

    @shared
    def best(self) -> DataFrame:
        return answering.scored(self.fired, "max").withColumn("score", F.round("score", 9))

    @shared
    def noisy(self) -> DataFrame:
        return answering.scored(self.fired, "noisyor").withColumn("score", F.round("score", 9))

    @cached_property
    def freq(self) -> DataFrame:
        return self.known.groupBy(F.col("y").alias("entity")).agg(F.count("*").alias("n"))

    @shared
    def labels(self) -> DataFrame:
        return answering.labelled(answering.candidates(self.fired), self.gold).select("x", "y", "label")

    @shared
    def bodies(self) -> DataFrame:
        head = F.split("rule", " <= ")[0]
        rules = self.metrics.join(self.catalog, "rule_id").select("rule_id", head.alias("head"), "body_size", "support", "conf")
        return dependencies.top_bodies(rules, TOP_BODIES, LEAST_SUPPORT)

    @cached_property
    def mined(self) -> DataFrame:
        return self.inst.join(self.bodies.select("rule_id"), "rule_id", "left_semi")

    @shared
    def pairs(self) -> DataFrame:
        return dependencies.set_pair_counts(self.held, self.bodies, LEAST_PAIR)

    @shared
    def deps(self) -> DataFrame:
        got = dependencies.pair_gains(self.pairs, self.metrics, "unified", SMOOTH_MINED, CAP)
        return got.withColumn("lift", F.round("lift", 9))

    @cached_property
    def mfired(self) -> DataFrame:
        return self.fired.join(F.broadcast(self.bodies.select("rule_id")), "rule_id", "left_semi")

    @shared
    def odds(self) -> DataFrame:
        return dependencies.pair_log_odds(self.mfired, self.labels).withColumn("log_odds", F.round("log_odds", 9))

    @cached_property
    def paired(self) -> DataFrame:
        return self.deps.join(self.odds.select("a", "b", "log_odds"), ["a", "b"]).withColumn("rel", F.lit(TARGET))

    def ranks(self, scores: DataFrame) -> DataFrame:
        total = self.ret.select("x").union(self.ret.select("y")).distinct().agg(F.count("*").alias("e"))
        got = answering.filtered_ranks(scores, self.gold, self.ret, F.lit(0))
        # The number of entities is a one-row table, joined by broadcast.
        wide = got.crossJoin(F.broadcast(total))
        low = (F.col("score") == 0) & F.col("rank").isNotNull()
        return wide.withColumn("rank", F.when(low, F.col("rank") + F.col("e") / 2).otherwise(F.col("rank"))).select("x", "y", "score", "rank")

    @shared
    def ranks_best(self) -> DataFrame:
        return self.ranks(self.best)

    @shared
    def ranks_noisy(self) -> DataFrame:
        return self.ranks(self.noisy)

    @cached_property
    def changes(self) -> DataFrame:
        return answering.rank_changes(self.ranks_best, self.ranks_noisy)

    @cached_property
    def weights(self) -> DataFrame:
        """rule_id, w = sqrt(conf), type_w, conf."""
        got = self.metrics.join(self.catalog.select("rule_id", "rule"), "rule_id")
        return got.select("rule_id", F.sqrt("conf").alias("w"), type_weight(rule_class(F.col("rule"))).alias("type_w"), "conf")

    @cached_property
    def evidence3(self) -> DataFrame:
        e = lambda u: evidence(confidence(F.col("support"), F.col("body_size"), u), CAP)
        return self.metrics.select("rule_id", e(SMOOTH_MINED).alias("e"), e(0).alias("raw"))
