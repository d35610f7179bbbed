"""Queries by name: a DataFrame plan, and its SQL where SQL can say it.

Every plan runs over whole tables. Doubles are rounded to six places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions.language import Step, parse_rule
from ..operators import analysis, answering, dependencies, paths, reports, scoring, support, training
from ..sources import graph
from .base import TOP_BODIES, WALK, Base
from .sql import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def plan(sql: str | None = None):
    """Register a function of Base under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = query(sql)
        return f

    return register


def r6(name: str):
    return F.round(C(name), 6).alias(name)


# Graph


@plan("SELECT h, r, t FROM kg")
def kg_triples(b: Base):
    return b.kg


@plan("SELECT r, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM kg GROUP BY r")
def kg_relation_stats(b: Base):
    return b.kg.groupBy("r").agg(F.count("*").alias("n"), F.countDistinct("h").alias("heads"), F.countDistinct("t").alias("tails"))


@plan("SELECT entity, count(*) AS n FROM (SELECT h AS entity FROM kg UNION ALL SELECT t FROM kg) GROUP BY entity")
def entity_freq(b: Base):
    return answering.frequency(b.kg)


@plan("SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT h AS name FROM kg UNION SELECT t FROM kg)")
def entity_ids(b: Base):
    return graph.dictionary(graph.entities(b.kg), "name")


@plan("""SELECT h.id AS s, p.id AS p, t.id AS o FROM kg JOIN (SELECT row_number() OVER (ORDER BY n) - 1 AS id, n FROM (SELECT h AS n FROM kg UNION SELECT t FROM kg)) h ON h.n = kg.h
    JOIN (SELECT row_number() OVER (ORDER BY n) - 1 AS id, n FROM (SELECT DISTINCT r AS n FROM kg)) p ON p.n = kg.r
    JOIN (SELECT row_number() OVER (ORDER BY n) - 1 AS id, n FROM (SELECT h AS n FROM kg UNION SELECT t FROM kg)) t ON t.n = kg.t""")
def encoded_triples(b: Base):
    return graph.encode(b.kg, graph.dictionary(graph.entities(b.kg), "name"), graph.dictionary(b.kg, "r"))


@plan("SELECT rel, inv, count(*) AS n FROM (SELECT r AS rel, false AS inv FROM kg UNION ALL SELECT r, true FROM kg) GROUP BY rel, inv")
def edge_counts(b: Base):
    return graph.edges(b.kg).groupBy("rel", "inv").agg(F.count("*").alias("n"))


@plan("SELECT r, count(*) FILTER (h = t) AS loops FROM kg GROUP BY r")
def loops(b: Base):
    return b.kg.groupBy("r").agg(F.count(F.when(C("h") == C("t"), 1)).alias("loops"))


@plan("SELECT CASE WHEN regexp_matches(CAST(p_partkey AS VARCHAR), '^[0-9]+$') THEN 'e' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS h, 'sized' AS r, 'e' || p_size AS t FROM part")
def safe_names(b: Base):
    part = b.spark.read.parquet(f"{b.sf_dir}/part.parquet")
    return graph.safe_triples(part.select(C("p_partkey").cast("string").alias("h"), F.lit("sized").alias("r"), C("p_size").cast("string").alias("t")))


# Paths and supports


@plan("SELECT y AS const, count(*) AS n FROM nat GROUP BY y")
def unary_const_instances(b: Base):
    return paths.path_pairs(b.graph, [Step("c_nation")]).groupBy(C("y").alias("const")).agg(F.count("*").alias("n"))


@plan("SELECT r AS rel, count(DISTINCT h) AS n FROM kg GROUP BY r")
def unary_exists_instances(b: Base):
    return graph.edges(b.kg).where(~C("inv")).groupBy("rel").agg(F.countDistinct("src").alias("n"))


@plan("""SELECT y, count(*) AS n FROM (SELECT DISTINCT 'o:' || l_orderkey AS x, 'b:' || p_brand AS y FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY y""")
def path2_instances(b: Base):
    return paths.path_pairs(b.graph, [Step("has_part"), Step("p_brand")]).groupBy("y").agg(F.count("*").alias("n"))


@plan("SELECT y, count(*) AS n FROM walks GROUP BY y")
def path3_instances(b: Base):
    return paths.path_pairs(b.graph, WALK).groupBy("y").agg(F.count("*").alias("n"))


@plan("""SELECT DISTINCT a.x, b.x AS y FROM nat a JOIN nat b ON a.y = b.y AND a.x <> b.x JOIN seg s ON s.x = a.x AND s.y = 'seg:BUILDING' WHERE a.x = 'c:1'""")
def neighbours_of_one(b: Base):
    start = b.spark.createDataFrame([("c:1",)], "n0 string")
    got = paths.path_pairs(b.graph, WALK[:2], start)
    return got.join(graph.relation(b.kg, "c_segment").where("y = 'seg:BUILDING'").select("x"), "x", "left_semi")


@plan("SELECT rule_id, rule, kind, head_const, body_rel, body_const FROM catalog")
def rule_catalog(b: Base):
    return b.catalog.select("rule_id", "rule", "kind", "head_const", "body_rel", "body_const")


@plan("SELECT rule_id, body_size, support, round(conf, 6) AS conf, round(smooth, 6) AS smooth, round(evidence, 6) AS evidence FROM metrics")
def rule_conf_evidence(b: Base):
    return b.metrics.select("rule_id", "body_size", "support", r6("conf"), r6("smooth"), r6("evidence"))


@plan("SELECT count(*) AS rules, max(rule_id) AS last, count(*) FILTER (support >= 5) AS supported FROM metrics")
def rule_file_stats(b: Base):
    return b.metrics.agg(F.count("*").alias("rules"), F.max("rule_id").alias("last"), F.count(F.when(C("support") >= 5, 1)).alias("supported"))


@plan("SELECT b AS head_const, (SELECT count(*) FROM known) AS body_size, count(k.x) AS support FROM brands JOIN known k ON k.y = b GROUP BY b")
def u0_rule_support(b: Base):
    heads = b.known.select(C("y").alias("head_const")).distinct().withColumn("rule_id", F.xxhash64("head_const"))
    return support.empty_body_metrics(heads, b.known).join(heads, "rule_id").select("head_const", "body_size", "support")


@plan("""SELECT count(*) AS body_size, count(k.x) AS support FROM (SELECT x, y FROM likes INTERSECT SELECT x, y FROM walks) i LEFT JOIN known k ON i.x = k.x AND i.y = k.y""")
def complex_rule_support(b: Base):
    rule = parse_rule("returned_brand(X,Y) <= likes_brand(X,Y) && c_nation(X,A), c_nation(B,A), returned_brand(B,Y)")
    inst = paths.body_instances(b.graph, rule).withColumn("rule_id", F.lit(1))
    return support.rule_metrics(inst, b.known).select("body_size", "support")


@plan("""SELECT kind AS shape, CASE WHEN rule LIKE '%(X,Y) <=%' THEN 'B' WHEN kind = 'exists' THEN 'Ud' ELSE 'Uc' END AS class, count(*) AS n FROM catalog GROUP BY 1, 2""")
def rule_types(b: Base):
    return b.catalog.groupBy(C("kind").alias("shape"), E.rule_class(C("rule")).alias("class")).agg(F.count("*").alias("n"))


@plan("""SELECT body_rel, count(*) FILTER (kind = 'const') AS const, count(*) FILTER (kind = 'exists') AS "exists", count(*) FILTER (kind = 'binary') AS binary, count(*) FILTER (kind = 'path') AS path FROM catalog GROUP BY body_rel""")
def type_pivot(b: Base):
    return b.catalog.groupBy("body_rel").pivot("kind", ["const", "exists", "binary", "path"]).agg(F.count("rule_id")).na.fill(0)


@plan("""SELECT coalesce(kind, 'ALL') AS kind, coalesce(body_rel, 'ALL') AS body_rel, CAST(grouping_id(kind, body_rel) AS BIGINT) AS level, count(*) AS n FROM catalog GROUP BY ROLLUP (kind, body_rel)""")
def grouping_rollup(b: Base):
    got = b.catalog.rollup("kind", "body_rel").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return got.select(F.coalesce("kind", F.lit("ALL")).alias("kind"), F.coalesce("body_rel", F.lit("ALL")).alias("body_rel"), "level", "n")


@plan("SELECT CAST(floor(log2(n)) AS BIGINT) AS bin, count(*) AS groups FROM (SELECT head_const, count(*) AS n FROM catalog GROUP BY head_const) GROUP BY 1")
def head_rule_bins(b: Base):
    return analysis.log2_bins(b.catalog.groupBy("head_const").agg(F.count("*").alias("n")), "n")


@plan("""SELECT rule_id, CASE WHEN abs(conf - smooth) = 0 THEN 0 WHEN abs(conf - smooth) < 0.1 THEN 1 WHEN abs(conf - smooth) < 0.2 THEN 2 ELSE 3 END AS level FROM metrics""")
def match_levels(b: Base):
    return b.metrics.select("rule_id", E.match_level(C("conf"), C("smooth")).alias("level"))


# Answers


@plan("SELECT x, y, count(*) AS n, min(rule_id) AS first, max(rule_id) AS last, round(sum(evidence), 6) AS total FROM fired GROUP BY x, y")
def fired_rules(b: Base):
    return b.fired.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("rule_id").alias("first"), F.max("rule_id").alias("last"), F.round(F.sum("evidence"), 6).alias("total"))


@plan("SELECT x, count(*) AS n FROM (SELECT DISTINCT i.x, i.y FROM inst i WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.x = i.x AND k.y = i.y)) GROUP BY x")
def filtered_candidates(b: Base):
    return answering.fired(b.inst, b.known).select("x", "y").distinct().groupBy("x").agg(F.count("*").alias("n"))


@plan("SELECT x, y, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY conf DESC, rule_id) AS nth FROM fired) WHERE nth <= 3")
def top_rules(b: Base):
    return answering.top_rules(b.fired, 3).select("x", "y", "rule_id")


@plan("SELECT l.x, l.y, l.label, f.n FROM labels l JOIN (SELECT x, y, count(*) AS n FROM fired GROUP BY x, y) f ON l.x = f.x AND l.y = f.y")
def training_rows(b: Base):
    return answering.labelled(answering.candidates(b.fired), b.gold).select("x", "y", "label", F.size("rules").cast("long").alias("n"))


TOP10 = """SELECT x, y, round(score, 6) AS score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY x ORDER BY score DESC, coalesce(n, 0) DESC, y) AS rank
    FROM ({}) s LEFT JOIN freq ON entity = y) WHERE rank <= 10"""


def top10(b: Base, scores: DataFrame) -> DataFrame:
    got = answering.top_answers(scores.withColumn("score", F.round("score", 9)), b.freq, 10)
    return got.select("x", "y", r6("score"), C("rank").cast("long").alias("rank"))


@plan(TOP10.format("SELECT * FROM best"))
def agg_max(b: Base):
    return top10(b, b.best)


@plan(TOP10.format("SELECT * FROM noisy"))
def agg_noisyor(b: Base):
    return top10(b, b.noisy)


DECAY = "SELECT x, y, round(sum(evidence * power({rate}, nth - 1)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY evidence DESC) AS nth FROM fired) GROUP BY x, y"


@plan(TOP10.format(DECAY.format(rate="0.1::DOUBLE")))
def agg_maxplus(b: Base):
    return top10(b, answering.scored(b.fired, "maxplus"))


@plan(TOP10.format(DECAY.format(rate="0.5::DOUBLE")))
def agg_decay(b: Base):
    return top10(b, answering.scored(b.fired, "decay50"))


@plan("SELECT x, y, round(1 - exp(sum(ln(1 - least(greatest(1 / (1 + exp(-evidence)), 1e-7), 1 - 1e-7)))), 6) AS score FROM fired GROUP BY x, y")
def agg_noisy_product(b: Base):
    return answering.noisy_or_products(b.fired, "evidence").select("x", "y", r6("score"))


@plan("SELECT x, y, round(score, 6) AS score, rank FROM ranks_best")
def rank_filtered(b: Base):
    return b.ranks_best.select("x", "y", r6("score"), "rank")


METRICS = """count(*) AS n, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS hits_1,
    round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS hits_3, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hits_10"""


@plan(f"SELECT y, {METRICS} FROM ranks_best GROUP BY y")
def mrr_hits_by_answer(b: Base):
    return answering.rank_metrics(b.ranks_best, "y").select("y", "n", r6("mrr"), r6("hits_1"), r6("hits_3"), r6("hits_10"))


@plan(f"SELECT 'max' AS mode, {METRICS} FROM ranks_best UNION ALL SELECT 'noisyor', {METRICS} FROM ranks_noisy")
def mrr_hits(b: Base):
    both = b.ranks_best.withColumn("mode", F.lit("max")).unionByName(b.ranks_noisy.withColumn("mode", F.lit("noisyor")))
    return answering.rank_metrics(both, "mode").select("mode", "n", r6("mrr"), r6("hits_1"), r6("hits_3"), r6("hits_10"))


@plan("SELECT round(sum(m * n) / sum(n), 6) AS mrr FROM (SELECT y, count(*) AS n, avg(coalesce(1 / rank, 0)) AS m FROM ranks_best GROUP BY y)")
def mrr_weighted(b: Base):
    return answering.rank_metrics(b.ranks_best, "y").agg(F.round(analysis.weighted_mean("mrr", "n"), 6).alias("mrr"))


@plan("""SELECT CASE WHEN g > 0.03 THEN 'positive' WHEN g < 0 THEN 'negative' ELSE 'neutral' END AS bucket, count(*) AS n, round(avg(delta), 6) AS delta
    FROM (SELECT *, CASE WHEN rr_before > 0 THEN least(greatest(rr_after / rr_before - 1, -1), 1) ELSE 0 END AS g FROM changes) GROUP BY 1""")
def rank_change_buckets(b: Base):
    g = E.clipped_gain(C("rr_before"), C("rr_after"))
    return b.changes.groupBy(E.gain_bucket(g).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("delta"))


@plan("""SELECT x, n, firings, rules, round(top, 6) AS top, round(margin, 6) AS margin, round(mean, 6) AS mean, round(h, 6) AS entropy FROM (
    SELECT x, count(*) AS n, max(score) AS top, max(score) - coalesce(max(score) FILTER (nth = 2), 0) AS margin, avg(score) AS mean, sum(-p * ln(p)) AS h FROM (
      SELECT *, e / sum(e) OVER (PARTITION BY x) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY x)) AS e, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS nth FROM noisy)) GROUP BY x)
    JOIN (SELECT x, count(*) AS firings, count(DISTINCT rule_id) AS rules FROM fired GROUP BY x) USING (x)""")
def query_features(b: Base):
    got = analysis.query_features(b.noisy, b.fired)
    return got.select("x", C("candidates").alias("n"), "firings", "rules", r6("top"), r6("margin"), r6("mean"), r6("entropy"))


# Dependencies


@plan("SELECT rule_id, nth FROM top WHERE nth <= 500")
def dep_topk_bodies(b: Base):
    head = F.split("rule", " <= ")[0]
    rules = b.metrics.join(b.catalog, "rule_id").select("rule_id", head.alias("head"), "support", "conf").where("support >= 3")
    order = Window.partitionBy("head").orderBy(C("conf").desc(), "rule_id")
    return rules.withColumn("nth", F.row_number().over(order).cast("long")).where(C("nth") <= TOP_BODIES).select("rule_id", "nth")


@plan("SELECT a, b, body, support FROM pairs")
def dep_pair_counts(b: Base):
    return b.pairs


@plan("SELECT a, b, body, support, round(lift, 6) AS lift FROM deps")
def dep_gain_unified(b: Base):
    return b.deps.select("a", "b", "body", "support", r6("lift"))


@plan("""SELECT a, b, round(CASE WHEN up > 0 THEN up WHEN down < 0 THEN down ELSE 0 END, 6) AS lift FROM (
    SELECT p.a, p.b, least(-ln(1 - p.support / (p.body + 3)), 7.0) - u.e - v.e AS up,
      least(-ln(1 - least(p.support / p.body, 1 - 1.1102230246251565e-16)), 7.0) - (u.raw + v.raw) / 2 AS down
    FROM pairs p JOIN ev3 u ON p.a = u.rule_id JOIN ev3 v ON p.b = v.rule_id)""")
def dep_gain_legacy(b: Base):
    return dependencies.pair_gains(b.pairs, b.metrics, "legacy").select("a", "b", r6("lift"))


@plan("SELECT CASE WHEN lift > 0.01 THEN 'synergy' ELSE 'redundancy' END AS kind, count(*) AS n, round(sum(lift), 5) AS total FROM deps WHERE abs(lift) > 0.01 GROUP BY 1")
def dep_kinds(b: Base):
    return dependencies.split_kinds(b.deps, 0.01).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("lift"), 5).alias("total"))


@plan("SELECT p.rule_id AS a, q.rule_id AS b, count(*) AS n FROM mfired p JOIN mfired q ON p.x = q.x AND p.y = q.y AND p.rule_id < q.rule_id GROUP BY 1, 2 HAVING count(*) >= 2")
def pair_support(b: Base):
    return dependencies.pair_support(b.mfired, 2)


@plan("SELECT a, b, pos, neg, round(log_odds, 6) AS log_odds FROM odds")
def pair_log_odds(b: Base):
    return b.odds.select("a", "b", "pos", "neg", r6("log_odds"))


RANKED = "SELECT a, b, row_number() OVER (PARTITION BY rel ORDER BY {}, a, b) AS pos FROM {}"


#: A relation keeps so many pairs for each of its rules (the reference's default).
PAIRS_PER_RULE = 2


def budget(b: Base, mode: str) -> DataFrame:
    limits = b.catalog.groupBy(F.lit(graph.TARGET).alias("rel")).agg((F.count("*") * PAIRS_PER_RULE).alias("limit"))
    return dependencies.within_budget(dependencies.ranked(b.paired, mode), limits).select("a", "b", C("pos").cast("long").alias("pos"))


@plan(f"SELECT * FROM ({RANKED.format('abs(lift) DESC', 'paired')}) WHERE pos <= 2 * (SELECT count(*) FROM catalog)")
def dep_rank_lift(b: Base):
    return budget(b, "lift")


@plan(f"SELECT * FROM ({RANKED.format('abs(log_odds) DESC', 'paired')}) WHERE pos <= 2 * (SELECT count(*) FROM catalog)")
def dep_rank_ratio(b: Base):
    return budget(b, "log_odds")


@plan("""SELECT * FROM (SELECT a, b, row_number() OVER (ORDER BY least(p, q), a, b) AS pos FROM (
    SELECT a, b, 2 * row_number() OVER (ORDER BY abs(lift) DESC, a, b) - 1 AS p, 2 * row_number() OVER (ORDER BY abs(log_odds) DESC, a, b) AS q FROM paired)) WHERE pos <= 2 * (SELECT count(*) FROM catalog)""")
def dep_rank_mix(b: Base):
    return budget(b, "mix")


@plan("""SELECT DISTINCT a, b, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY abs(lift) DESC, a, b) AS nth
    FROM (SELECT a AS r, * FROM deps UNION ALL SELECT b, * FROM deps)) WHERE nth <= 3""")
def dep_topk_per_rule(b: Base):
    return dependencies.top_per_rule(b.deps, 3).select("a", "b", r6("lift"))


@plan("""SELECT a, b, round(1 / sqrt(u.d * v.d), 6) AS norm FROM deps JOIN (SELECT r, count(*) AS d FROM (SELECT a AS r FROM deps UNION ALL SELECT b FROM deps) GROUP BY r) u ON u.r = a
    JOIN (SELECT r, count(*) AS d FROM (SELECT a AS r FROM deps UNION ALL SELECT b FROM deps) GROUP BY r) v ON v.r = b""")
def dep_static_norm(b: Base):
    return dependencies.degree_norms(b.deps).select("a", "b", r6("norm"))


@plan("""SELECT a, b FROM deps JOIN metrics u ON u.rule_id = a JOIN metrics v ON v.rule_id = b
    WHERE sqrt(u.conf) >= 0.2 * (SELECT max(sqrt(conf)) FROM metrics) AND sqrt(v.conf) >= 0.2 * (SELECT max(sqrt(conf)) FROM metrics)""")
def dep_without_weak(b: Base):
    return dependencies.without_weak(b.deps, b.weights, 0.2).select("a", "b")


LOGITS = """SELECT f.x, f.y, sum(m.conf * CASE WHEN c.rule LIKE '%(X,Y) <=%' OR c.kind <> 'exists' THEN 1 ELSE 0.1 END) AS rule_logit, max(m.conf) AS conf
    FROM mfired f JOIN metrics m ON m.rule_id = f.rule_id JOIN catalog c ON c.rule_id = f.rule_id GROUP BY 1, 2"""
DEPS = """SELECT f.x, f.y, sum(0.1 * lift) / greatest(sqrt(count(*)), 1) AS dep_logit FROM mfired f JOIN deps d ON d.a = f.rule_id
    JOIN mfired g ON g.x = f.x AND g.y = f.y AND g.rule_id = d.b GROUP BY 1, 2"""


@plan(f"""SELECT x, y, round(rule_logit, 6) AS rule_logit, round(d, 6) AS dep_logit, round(conf / (1 + exp(-(rule_logit + d))), 6) AS score FROM (
    SELECT l.*, least(greatest(coalesce(dep_logit, 0), -greatest(abs(rule_logit), 1e-6)), greatest(abs(rule_logit), 1e-6)) AS d
    FROM ({LOGITS}) l LEFT JOIN ({DEPS}) e ON e.x = l.x AND e.y = l.y)""")
def score_with_deps(b: Base):
    deps = b.deps.withColumn("w", C("lift") * 0.1)
    return scoring.linear_scores(b.mfired, b.weights, deps, sets=b.cands).select("x", "y", r6("rule_logit"), r6("dep_logit"), r6("score"))


@plan("""SELECT part, count(*) AS n, round(sum(value), 4) AS total FROM (
    SELECT 'rule' AS part, m.conf * CASE WHEN c.rule LIKE '%(X,Y) <=%' OR c.kind <> 'exists' THEN 1 ELSE 0.1 END AS value FROM mfired f JOIN metrics m ON m.rule_id = f.rule_id JOIN catalog c ON c.rule_id = f.rule_id
    UNION ALL SELECT 'dependency', 0.1 * lift FROM mfired f JOIN deps d ON d.a = f.rule_id JOIN mfired g ON g.x = f.x AND g.y = f.y AND g.rule_id = d.b
    UNION ALL SELECT 'bias', 0 FROM (SELECT DISTINCT x, y FROM mfired)) GROUP BY part""")
def explain_parts(b: Base):
    got = scoring.explain(b.mfired, b.weights, b.deps.withColumn("w", C("lift") * 0.1), sets=b.cands)
    return got.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan()
def agg_noisyor_dep_greedy(b: Base):
    return dependencies.greedy_scores(b.mfired, b.deps, "noisyor+dep")


@plan()
def agg_noisyor_dep_match(b: Base):
    return dependencies.greedy_scores(b.mfired, b.deps, "noisyor+match")


@plan()
def agg_noisyor_without_redundant(b: Base):
    return dependencies.greedy_scores(b.mfired, b.deps, "noisyor-dep")


# Analytics


@plan("SELECT n AS rules, count(*) AS candidates FROM (SELECT x, y, count(*) AS n FROM fired GROUP BY x, y) GROUP BY n")
def cofire_histogram(b: Base):
    return analysis.histogram(b.fired.groupBy("x", "y").agg(F.count("*").alias("rules")), "rules").withColumnRenamed("n", "candidates")


@plan("""SELECT count(*) AS n, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS most FROM (SELECT x, y, count(*) AS n FROM fired GROUP BY x, y)""")
def cofire_distribution(b: Base):
    got = analysis.distribution(b.fired.groupBy("x", "y").agg(F.count("*").alias("v")), "v")
    return got.select("n", r6("mean"), "p50", "p95", "p99", "most")


@plan("""SELECT p.rule_id AS a, q.rule_id AS b, r.rule_id AS c, count(*) AS n, CAST(sum(l.label) AS BIGINT) AS pos FROM mfired p JOIN mfired q ON p.x = q.x AND p.y = q.y AND p.rule_id < q.rule_id
    JOIN mfired r ON r.x = p.x AND r.y = p.y AND q.rule_id < r.rule_id JOIN labels l ON l.x = p.x AND l.y = p.y GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def three_rule_support(b: Base):
    return dependencies.triples_of_rules(b.mfired, b.labels, 2)


@plan("""SELECT rule_id, round(greatest((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low,
    round(least((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high
    FROM (SELECT rule_id, support AS k, body_size AS n, 1.959963984540054::DOUBLE AS z FROM metrics)""")
def wilson_intervals(b: Base):
    low, high = E.wilson(C("support"), C("body_size"))
    return b.metrics.select("rule_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@plan("""SELECT rule_id, (rank() OVER (ORDER BY conf)) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS avg_rank,
    round(((rank() OVER (ORDER BY conf)) + (count(*) OVER (PARTITION BY conf) - 1) / 2 - 1) / (count(*) OVER () - 1), 6) AS pct FROM metrics""")
def percentile_ranks(b: Base):
    return analysis.average_ranks(b.metrics.select("rule_id", "conf"), "conf").select("rule_id", "avg_rank", r6("pct"))


@plan("""SELECT round(corr(u, v), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS u,
    rank() OVER (ORDER BY body_size) + (count(*) OVER (PARTITION BY body_size) - 1) / 2 AS v FROM metrics)""")
def spearman_conf_size(b: Base):
    return analysis.spearman(b.metrics.select("conf", C("body_size").cast("double").alias("body_size")), "conf", "body_size").select(r6("spearman"))


@plan("""SELECT g / 50 AS coverage, n, round(s / n, 6) AS mean FROM (SELECT g, greatest(1, CAST(round_even(t * (g / 50), 0) AS BIGINT)) AS n FROM range(1, 51) r(g), (SELECT count(*) AS t FROM metrics))
    JOIN (SELECT row_number() OVER o AS nth, sum(smooth) OVER (o ROWS UNBOUNDED PRECEDING) AS s FROM metrics WINDOW o AS (ORDER BY conf DESC, rule_id)) ON nth = n""")
def coverage_curve(b: Base):
    return analysis.coverage_curve(b.metrics, "conf", "smooth", "rule_id").select("coverage", "n", r6("mean"))


@plan("""SELECT x, round(sum(score) FILTER (nth <= 1), 6) AS sum_1, round(sum(score) FILTER (nth <= 3), 6) AS sum_3, round(avg(score) FILTER (nth <= 3), 6) AS mean_3
    FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC) AS nth FROM best) GROUP BY x""")
def topk_stats(b: Base):
    return analysis.top_stats(b.best, "score", (1, 3), "x").select("x", r6("sum_1"), r6("sum_3"), r6("mean_3"))


@plan("""SELECT name, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM (
    SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS s FROM (SELECT y AS name, 1 / (1 + count(*)) AS p FROM gold GROUP BY y))""")
def holm_adjusted(b: Base):
    tests = b.gold.groupBy(C("y").alias("name")).agg((1 / (1 + F.count("*"))).alias("p"))
    return analysis.holm(tests).select("name", r6("p"), r6("p_holm"))


@plan("""SELECT count(*) AS n, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses, round(avg(rr_before), 6) AS mean_before,
    round(avg(rr_after), 6) AS mean_after, round(avg(delta), 6) AS mean_delta, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 4) AS t FROM changes""")
def paired_summary(b: Base):
    got = analysis.paired_summary(b.changes)
    return got.select("n", "wins", "ties", "losses", r6("mean_before"), r6("mean_after"), r6("mean_delta"), F.round("t", 4).alias("t"))


@plan()
def bootstrap_ci(b: Base):
    return analysis.bootstrap_interval(b.changes)


@plan()
def sign_flip(b: Base):
    return analysis.sign_flip_p(b.changes)


RUNS = "SELECT y, 'max' AS config, avg(coalesce(1 / rank, 0)) AS mrr FROM ranks_best GROUP BY y UNION ALL SELECT y, 'noisyor', avg(coalesce(1 / rank, 0)) FROM ranks_noisy GROUP BY y"


def runs(b: Base) -> DataFrame:
    both = b.ranks_best.withColumn("config", F.lit("max")).unionByName(b.ranks_noisy.withColumn("config", F.lit("noisyor")))
    return answering.rank_metrics(both, "y", "config").select("y", "config", F.round("mrr", 9).alias("mrr"))


@plan(f"SELECT y, config, round(mrr, 6) AS mrr FROM (SELECT y, config, mrr, row_number() OVER (PARTITION BY y ORDER BY mrr DESC, config) AS nth FROM (SELECT y, config, round(mrr, 9) AS mrr FROM ({RUNS}))) WHERE nth = 1")
def ensemble_best(b: Base):
    return analysis.best_by(runs(b), "y", "mrr").select("y", "config", r6("mrr"))


@plan(f"""WITH_RUNS SELECT t.y, t.config, round(u.mrr, 6) AS mrr FROM (SELECT y, CASE WHEN max(mrr) - max(mrr) FILTER (config = 'max') >= 0.01 THEN arg_max(config, mrr) ELSE 'max' END AS config
    FROM runs GROUP BY y) t JOIN runs u ON u.y = t.y AND u.config = t.config""".replace("WITH_RUNS ", "").replace("runs", f"(SELECT y, config, round(mrr, 9) AS mrr FROM ({RUNS}))"))
def ensemble_safe(b: Base):
    return analysis.safe_best(runs(b), "y", "mrr", "max", 0.01).select("y", "config", r6("mrr"))


@plan("""SELECT kind, count(*) AS n, round(avg(w), 6) AS mean, round(avg(abs(w)), 6) AS mean_abs, round(min(w), 6) AS least, round(max(w), 6) AS most, round(avg(CASE WHEN w > 0 THEN 1 ELSE 0 END), 6) AS positive,
    round(avg(CASE WHEN abs(w) < 0.01 THEN 1 ELSE 0 END), 6) AS near_01, round(avg(CASE WHEN abs(w) < 0.05 THEN 1 ELSE 0 END), 6) AS near_05 FROM (SELECT kind, sqrt(conf) AS w FROM metrics JOIN catalog USING (rule_id)) GROUP BY kind""")
def weight_stats(b: Base):
    w = b.weights.join(b.catalog.select("rule_id", "kind"), "rule_id")
    return analysis.weight_stats(w, "w", "kind").select("kind", "n", *[r6(c) for c in ("mean", "mean_abs", "least", "most", "positive", "near_01", "near_05")])


@plan("""SELECT head_const, kinds, round(CASE WHEN kinds > 1 THEN h / ln(kinds) ELSE 0 END, 6) AS entropy FROM (SELECT head_const, count(*) AS kinds, sum(-p * ln(p)) AS h FROM (
    SELECT head_const, n / sum(n) OVER (PARTITION BY head_const) AS p FROM (SELECT head_const, body_rel, count(*) AS n FROM catalog WHERE head_const IS NOT NULL GROUP BY 1, 2)) GROUP BY 1)""")
def rule_entropy(b: Base):
    counts = b.catalog.where("head_const IS NOT NULL").groupBy("head_const", "body_rel").agg(F.count("*").alias("n"))
    return analysis.entropy(counts, "n", "head_const").select("head_const", "kinds", r6("entropy"))


@plan("""SELECT rule_id, CASE WHEN conf <= q1 THEN 'Q1' WHEN conf <= q2 THEN 'Q2' WHEN conf <= q3 THEN 'Q3' ELSE 'Q4' END AS bucket FROM metrics,
    (SELECT quantile_cont(conf, 0.25) AS q1, quantile_cont(conf, 0.5) AS q2, quantile_cont(conf, 0.75) AS q3 FROM metrics)""")
def quartile_buckets(b: Base):
    cuts = b.metrics.agg(*[F.percentile("conf", F.lit(k / 4)).alias(f"q{k}") for k in (1, 2, 3)])
    return b.metrics.crossJoin(F.broadcast(cuts)).select("rule_id", E.quartile(C("conf"), C("q1"), C("q2"), C("q3")).alias("bucket"))


TOP3 = "(SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS nth FROM {}) WHERE nth <= 3)"


@plan(f"""SELECT coalesce(a.x, b.x) AS x, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS "both", count(*) AS either, round(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) / count(*), 6) AS jaccard
    FROM {TOP3.format('best')} a FULL JOIN {TOP3.format('noisy')} b ON a.x = b.x AND a.y = b.y GROUP BY 1""")
def jaccard_topk(b: Base):
    order = Window.partitionBy("x").orderBy(C("score").desc(), "y")
    top = lambda s: s.withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    return analysis.jaccard_top(top(b.best), top(b.noisy), "x", "y").select("x", "both", "either", r6("jaccard"))


@plan("SELECT x, y, round(rr_before, 6) AS rr_before, round(rr_after, 6) AS rr_after FROM changes JOIN (SELECT x FROM gold GROUP BY x HAVING count(*) = 1) USING (x) WHERE rr_after > rr_before")
def improved_cases(b: Base):
    single = b.gold.groupBy("x").agg(F.count("*").alias("n")).where("n = 1").select("x")
    return b.changes.join(single, "x", "left_semi").where("rr_after > rr_before").select("x", "y", r6("rr_before"), r6("rr_after"))


# Learning


@plan()
def train_rule_weights(b: Base):
    rows = answering.labelled(answering.candidates(b.mfired), b.gold).withColumn("rel", F.lit(graph.TARGET))
    start = b.weights.join(b.bodies.select("rule_id"), "rule_id", "left_semi").select(F.lit(graph.TARGET).alias("rel"), "rule_id", "w")
    return training.train_rules(rows, start)


@plan()
def sampled_paths(b: Base):
    return paths.sampled_walks(b.graph, WALK, 20)


# Reports


@plan("""SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY v DESC, y) AS rank FROM (SELECT x, y, list_sort(list(evidence), 'DESC') AS v FROM fired GROUP BY x, y)""")
def rank_vectors(b: Base):
    return reports.vector_ranks(b.fired).select("x", "y", C("rank").cast("long").alias("rank"))


@plan("""SELECT x, y, round(top, 6) AS top, round(bonus, 6) AS bonus FROM (SELECT t.x, t.y, t.evidence AS top, coalesce(max(d.lift + g.evidence), 0) AS bonus
    FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY evidence DESC, rule_id) AS nth FROM mfired) t
    LEFT JOIN ((SELECT a, b, lift FROM deps WHERE lift > 0 UNION ALL SELECT b, a, lift FROM deps WHERE lift > 0) d JOIN mfired g ON g.rule_id = d.b) ON d.a = t.rule_id AND g.x = t.x AND g.y = t.y
    WHERE t.nth = 1 GROUP BY 1, 2, 3)""")
def agg_max_dep(b: Base):
    return reports.best_with_partners(b.mfired, b.deps, 1).select("x", "y", r6("top"), r6("bonus"))


@plan("""SELECT x, rules, coalesce(linked, 0) AS linked, coalesce(pairs, 0) AS pairs FROM (SELECT x, count(DISTINCT rule_id) AS rules FROM mfired GROUP BY x)
    LEFT JOIN (SELECT x, count(DISTINCT r) AS linked FROM (SELECT f.x, unnest([d.a, d.b]) AS r FROM mfired f JOIN deps d ON d.a = f.rule_id JOIN mfired g ON g.x = f.x AND g.y = f.y AND g.rule_id = d.b) GROUP BY x) USING (x)
    LEFT JOIN (SELECT x, count(*) AS pairs FROM (SELECT DISTINCT f.x, d.a, d.b FROM mfired f JOIN deps d ON d.a = f.rule_id JOIN mfired g ON g.x = f.x AND g.y = f.y AND g.rule_id = d.b) GROUP BY x) USING (x)""")
def query_coverage(b: Base):
    return reports.query_coverage(b.mfired, b.deps, b.cands)


@plan("SELECT x, y, round(rr_before, 6) AS max, round(rr_after, 6) AS noisyor FROM changes")
def stages_wide(b: Base):
    both = b.ranks_best.withColumn("stage", F.lit("max")).unionByName(b.ranks_noisy.withColumn("stage", F.lit("noisyor")))
    return reports.stages_wide(both, ["max", "noisyor"]).select("x", "y", r6("max"), r6("noisyor"))


@plan(f"SELECT config, round(avg(mrr), 6) AS macro, count(*) AS groups FROM ({RUNS}) GROUP BY config")
def macro_average(b: Base):
    both = b.ranks_best.withColumn("config", F.lit("max")).unionByName(b.ranks_noisy.withColumn("config", F.lit("noisyor")))
    return reports.macro(both.withColumn("rr", answering.reciprocal(C("rank"))), "rr", "y", "config").select("config", r6("macro"), "groups")


CAPPED = """SELECT {cap}::DOUBLE AS cap, round((SELECT avg(CASE WHEN -ln(1 - support / (body_size + 3)) >= {cap} THEN 1 ELSE 0 END) FROM metrics), 6) AS saturated,
    count(*) FILTER (n > 0 AND o > 0) AS "both", round(count(*) FILTER (n > 0 AND o > 0) / count(*) FILTER (n > 0 OR o > 0), 6) AS jaccard, count(*) FILTER (sign(n) <> sign(o)) AS flipped
    FROM (SELECT round(least(-ln(1 - p.support / (p.body + 3)), {cap}) - least(u.e, {cap}) - least(v.e, {cap}), 9) AS n, round(least(-ln(1 - p.support / (p.body + 3)), 7) - u.e - v.e, 9) AS o
      FROM pairs p JOIN ev3 u ON u.rule_id = p.a JOIN ev3 v ON v.rule_id = p.b)"""


@plan(f"{CAPPED.format(cap='0.2')} UNION ALL {CAPPED.format(cap='0.5')}")
def evidence_cap_stability(b: Base):
    return reports.capped_stability(b.pairs, b.metrics, (0.2, 0.5)).select("cap", r6("saturated"), "both", r6("jaccard"), "flipped")


@plan("SELECT rule_id, round((conf - (SELECT avg(conf) FROM metrics)) / (SELECT stddev_pop(conf) FROM metrics), 6) AS z FROM metrics")
def conf_z_scores(b: Base):
    return reports.z_scores(b.metrics.select("rule_id", "conf"), "conf").select("rule_id", r6("z"))


@plan("""SELECT nth AS n, round(mean, 6) AS mean FROM (SELECT row_number() OVER o AS nth, avg(smooth) OVER (o ROWS UNBOUNDED PRECEDING) AS mean FROM metrics WINDOW o AS (ORDER BY body_size DESC, rule_id))
    WHERE nth * 5 >= (SELECT count(*) FROM metrics) ORDER BY mean DESC, nth LIMIT 1""")
def dense_prefix(b: Base):
    return reports.dense_prefix(b.metrics, "body_size", "smooth", "rule_id").select("n", r6("mean"))


@plan(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}::DOUBLE, 0.05), 6) AS q05, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS q95 FROM metrics" for c in ("body_size", "support", "conf")))
def feature_ranges(b: Base):
    return reports.ranges(b.metrics, ("body_size", "support", "conf")).select("feature", r6("q05"), r6("q50"), r6("q95"))


@plan("""SELECT rule_id, round((u + v) / 2, 6) AS composite FROM (SELECT rule_id, (rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 - 1) / (count(*) OVER () - 1) AS u,
    (rank() OVER (ORDER BY support) + (count(*) OVER (PARTITION BY support) - 1) / 2 - 1) / (count(*) OVER () - 1) AS v FROM metrics)""")
def composite_percentiles(b: Base):
    return reports.composite(b.metrics, ("conf", "support"), "rule_id").select("rule_id", r6("composite"))


@plan("SELECT x, y, place FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS place FROM best) SEMI JOIN gold USING (x, y)")
def position_ranks(b: Base):
    return reports.position_ranks(b.best, b.gold).select("x", "y", C("place").cast("long").alias("place"))


@plan("""SELECT CASE WHEN nth IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS n FROM catalog LEFT JOIN bodies USING (rule_id) GROUP BY 1""")
def rule_set_diff(b: Base):
    return reports.rule_set_diff(b.catalog, b.catalog.join(b.bodies.select("rule_id"), "rule_id"))


@plan("SELECT CASE WHEN kind = 'path' THEN 3 ELSE 1 END AS length, count(*) AS n FROM catalog GROUP BY 1")
def rule_lengths(b: Base):
    return b.catalog.groupBy(reports.body_length(C("rule")).alias("length")).agg(F.count("*").alias("n"))


@plan("""SELECT kind, count(*) FILTER (l = 0) AS "0", count(*) FILTER (l = 1) AS "1", count(*) FILTER (l = 2) AS "2", count(*) FILTER (l = 3) AS "3" FROM (
    SELECT kind, CASE WHEN abs(conf - smooth) = 0 THEN 0 WHEN abs(conf - smooth) < 0.1 THEN 1 WHEN abs(conf - smooth) < 0.2 THEN 2 ELSE 3 END AS l FROM metrics JOIN catalog USING (rule_id)) GROUP BY kind""")
def match_matrix(b: Base):
    got = b.metrics.join(b.catalog.select("rule_id", "kind"), "rule_id").withColumn("level", E.match_level(C("conf"), C("smooth")))
    return got.groupBy("kind").pivot("level", [0, 1, 2, 3]).agg(F.count("rule_id")).na.fill(0)


@plan("SELECT grouping, pos, norm FROM (VALUES ('rd'), ('r2d3'), ('r3d6')) a(grouping), (VALUES ('auto_sqrt'), ('auto_ratio')) b(pos), (VALUES ('none'), ('sqrt')) c(norm)")
def config_grid(b: Base):
    return reports.config_grid(b.spark, grouping=("rd", "r2d3", "r3d6"), pos=("auto_sqrt", "auto_ratio"), norm=("none", "sqrt"))


def features(b: Base) -> DataFrame:
    rr = b.ranks_noisy.groupBy("x").agg(F.avg(answering.reciprocal(C("rank"))).alias("rr"))
    return analysis.query_features(b.noisy, b.fired).join(rr, "x")


@plan()
def forest_selector(b: Base):
    return reports.forest_selector(features(b), ("candidates", "firings", "top", "margin", "entropy"), "rr", "x", folds=3, trees=10)


@plan()
def ridge_selector(b: Base):
    return reports.ridge_selector(features(b), ("candidates", "firings", "top", "margin", "entropy"), "rr")


@plan(f"SELECT u.y, CASE WHEN v.mrr > u.mrr THEN 'dependencies' ELSE 'rules' END AS final FROM (SELECT * FROM ({RUNS}) WHERE config = 'max') u JOIN (SELECT * FROM ({RUNS}) WHERE config = 'noisyor') v ON u.y = v.y")
def stage_acceptance(b: Base):
    one = answering.rank_metrics(b.ranks_best, "y").select(C("y").alias("rel"), "mrr")
    two = answering.rank_metrics(b.ranks_noisy, "y").select(C("y").alias("rel"), "mrr")
    return training.accepted(one, two).select(C("rel").alias("y"), "final")


@plan("SELECT x, y, round(score + (SELECT avg(score) FROM best) - m, 6) AS calibrated FROM (SELECT *, avg(score) OVER (PARTITION BY y) AS m FROM noisy)")
def calibrated_scores(b: Base):
    mean = b.best.agg(F.avg("score").alias("true_mean"))
    true_means = b.noisy.select("y").distinct().crossJoin(F.broadcast(mean))
    return analysis.calibrated(b.noisy, "y", "score", true_means).select("x", "y", r6("calibrated"))
