"""Further queries by name: rule files, rule application, intervals, curves, directions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions.language import parse_rule
from ..operators import analysis, answering, applying, dependencies, reports, scoring, sets, stages, support
from ..sources import files
from ..sources.graph import split_of
from ..sources.stash import shared_dir, stash
from .base import TARGET, WALK, Base
from .queries import RUNS, C, features, plan, r6
from .sql import CTES

#: Rules of every form: binary, path, branches, constant, exists, two steps, loop, head walked backwards.
RULES = {
    1: f"{TARGET}(X,Y) <= likes_brand(X,Y)",
    2: f"{TARGET}(X,Y) <= c_nation(X,A), c_nation(B,A), {TARGET}(B,Y)",
    3: f"{TARGET}(X,Y) <= likes_brand(X,Y) && c_nation(X,A), c_nation(B,A), {TARGET}(B,Y)",
    4: f"{TARGET}(X,b:Brand#11) <= c_segment(X,seg:BUILDING)",
    5: f"{TARGET}(X,b:Brand#12) <= c_segment(X,seg:MACHINERY)",
    6: f"{TARGET}(X,b:Brand#13) <= likes_brand(X,A)",
    7: f"{TARGET}(X,b:Brand#14) <= c_nation(X,A), in_region(A,r:1)",
    8: f"{TARGET}(X,b:Brand#15) <= likes_brand(X,A), {TARGET}(X,A)",
    9: f"{TARGET}(c:20,Y) <= {TARGET}(B,Y), c_nation(B,n:3)",
}
CTES["applied"] = """SELECT 1 AS rule_id, x, y FROM likes UNION ALL SELECT 2, x, y FROM walks
    UNION ALL SELECT 3, x, y FROM (SELECT x, y FROM likes INTERSECT SELECT x, y FROM walks)
    UNION ALL SELECT 4, x, 'b:Brand#11' FROM seg WHERE y = 'seg:BUILDING' UNION ALL SELECT 5, x, 'b:Brand#12' FROM seg WHERE y = 'seg:MACHINERY'
    UNION ALL SELECT DISTINCT 6, x, 'b:Brand#13' FROM likes
    UNION ALL SELECT 7, x, 'b:Brand#14' FROM nat JOIN nation ON y = 'n:' || n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT DISTINCT 8, l.x, 'b:Brand#15' FROM likes l JOIN known k ON l.x = k.x AND l.y = k.y
    UNION ALL SELECT DISTINCT 9, 'c:20', k.y FROM known k JOIN nat n ON k.x = n.x WHERE n.y = 'n:3'"""
CTES["open"] = "SELECT * FROM applied a WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.x = a.x AND k.y = a.y)"


def rules() -> dict:
    return {k: parse_rule(t) for k, t in RULES.items()}


APPLY = """SELECT {q} AS query, {c} AS cand, count(*) AS n, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rules FROM open GROUP BY 1, 2"""


def apply_rules(b: Base, direction: str) -> DataFrame:
    got = applying.applied(b.graph, rules(), direction, b.known)
    return got.select("query", "cand", F.size("rules").cast("long").alias("n"), F.array_join(C("rules").cast("array<string>"), ",").alias("rules"))


@plan(APPLY.format(q="x", c="y"))
def apply_rules_tail(b: Base):
    return apply_rules(b, "tail")


@plan(APPLY.format(q="y", c="x"))
def apply_rules_head(b: Base):
    return apply_rules(b, "head")


@plan("""SELECT rule_id, count(*) AS body_size, count(k.x) AS support, round(count(k.x) / count(*), 6) AS conf FROM (SELECT * FROM applied WHERE rule_id <> 9) a LEFT JOIN known k ON a.x = k.x AND a.y = k.y GROUP BY rule_id""")
def rule_text_support(b: Base):
    some = {k: r for k, r in rules().items() if k != 9}
    m = support.rule_metrics(applying.rule_instances(b.graph, some), b.known)
    return m.select(C("rule_id").cast("int").alias("rule_id"), "body_size", "support", r6("conf"))


@plan("SELECT g.x, g.y FROM gold g SEMI JOIN walks w ON g.x = w.x AND g.y = w.y")
def path_probe(b: Base):
    """Which test facts the three-step path joins."""
    return applying.holds(b.gold, b.graph, WALK)


# Rule files and dependencies, written to the shared folder and read back


def own_path(b: Base, name: str) -> str:
    return f"{shared_dir(b.spark)}/kgweave-{name}-{uuid.uuid4().hex}"


@plan("SELECT c.rule, m.body_size, m.support, round(m.conf, 6) AS conf, 'returned_brand' AS head_rel FROM metrics m JOIN catalog c USING (rule_id) WHERE m.support >= 5")
def rule_file_round_trip(b: Base):
    path = own_path(b, "rules")
    files.write_rules(b.metrics.join(b.catalog.select("rule_id", "rule"), "rule_id"), path)
    got = files.supported(files.read_rules(b.spark, path), 5)
    return got.select("rule", "body_size", "support", r6("conf"), "head_rel")


@plan("SELECT x AS query, y AS cand, count(*) AS n, min(rule_id) AS first, max(rule_id) AS last FROM fired GROUP BY 1, 2")
def applied_file_round_trip(b: Base):
    path = own_path(b, "applied")
    rows = b.fired.select(F.lit("tail").alias("direction"), F.lit(TARGET).alias("rel"), C("x").alias("query"), C("y").alias("cand"), "rule_id")
    files.write_applied(rows, path)
    got = files.read_applied(b.spark, path)
    return got.groupBy("query", "cand").agg(F.count("*").alias("n"), F.min("rule_id").alias("first"), F.max("rule_id").alias("last"))


@plan("SELECT a, b, body, support, CASE WHEN lift > 0.01 THEN 'synergy' ELSE 'redundancy' END AS kind FROM deps WHERE abs(lift) > 0.01")
def dependency_file_round_trip(b: Base):
    path = own_path(b, "deps")
    files.write_dependencies(b.deps, path, 0.01)
    each = [files.read_dependencies(b.spark, f"{path}/{k}").withColumn("kind", F.lit(k)) for k in ("synergy", "redundancy")]
    return each[0].unionByName(each[1]).select("a", "b", "body", "support", "kind")


# Rules and pairs


CLASSES = "SELECT rule_id, CASE WHEN rule LIKE '%(X,Y) <=%' THEN 'B' WHEN kind = 'exists' THEN 'Ud' ELSE 'Uc' END AS c FROM catalog"


@plan(f"""SELECT list_aggregate(list_sort([u.c, v.c]), 'string_agg', '_') AS fine, list_aggregate(list_sort([CASE WHEN u.c = 'B' THEN 'B' ELSE 'U' END, CASE WHEN v.c = 'B' THEN 'B' ELSE 'U' END]), 'string_agg', '_') AS coarse,
    count(*) AS n, round(avg(lift), 6) AS lift FROM deps JOIN ({CLASSES}) u ON u.rule_id = a JOIN ({CLASSES}) v ON v.rule_id = b GROUP BY 1, 2""")
def pair_types(b: Base):
    kind = b.catalog.select("rule_id", E.rule_class(C("rule")).alias("c"))
    got = b.deps.join(kind.toDF("a", "ca"), "a").join(kind.toDF("b", "cb"), "b")
    fine, coarse = E.pair_class(C("ca"), C("cb")), E.pair_class(E.coarse_class(C("ca")), E.coarse_class(C("cb")))
    return got.groupBy(fine.alias("fine"), coarse.alias("coarse")).agg(F.count("*").alias("n"), F.round(F.avg("lift"), 6).alias("lift"))


@plan(f"SELECT count(*) AS n, round(sum(lift), 5) AS total FROM deps JOIN ({CLASSES}) u ON u.rule_id = a JOIN ({CLASSES}) v ON v.rule_id = b WHERE u.c <> 'Ud' AND v.c <> 'Ud'")
def dep_without_classes(b: Base):
    kind = b.catalog.select("rule_id", E.rule_class(C("rule")).alias("class"))
    return files.without_classes(b.deps, kind, ["Ud"]).agg(F.count("*").alias("n"), F.round(F.sum("lift"), 5).alias("total"))


@plan("SELECT rule_id, round(sqrt(conf), 6) AS by_conf, round(sqrt(-ln(1 - least(conf, 1 - 1.1102230246251565e-16))), 6) AS by_evidence, round(conf, 6) AS plain FROM metrics")
def initial_weights(b: Base):
    c = C("conf")
    by = {"by_conf": E.initial_weight(c), "by_evidence": E.initial_weight(c, "evidence"), "plain": E.initial_weight(c, "conf", False)}
    return b.metrics.select("rule_id", *[F.round(v, 6).alias(k) for k, v in by.items()])


@plan("SELECT a, b, round(sign(log_odds) * sqrt(abs(log_odds)), 6) AS axis, round(power(least(greatest(log_odds, -7), 7), 2), 6) AS scale FROM odds")
def axis_and_scale(b: Base):
    return b.odds.select("a", "b", F.round(E.signed_sqrt(C("log_odds")), 6).alias("axis"), F.round(scoring.scale(C("log_odds")), 6).alias("scale"))


@plan("SELECT rule_id, body_size > 0 AND support BETWEEN 0 AND body_size AS valid, body_size < 30 AS weak FROM metrics")
def metric_validity(b: Base):
    """Whether a rule's counts can be, and whether they are so few that the rule should be looked at again."""
    return b.metrics.select("rule_id", ((C("body_size") > 0) & C("support").between(0, C("body_size"))).alias("valid"), (C("body_size") < 30).alias("weak"))


WILSON = """(k / n + z * z / (2 * n) {s} z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)"""
EVIDENCE = "least(-ln(1 - least(greatest({p}, 0), 1 - 1.1102230246251565e-16)), 7.0)"
BOUNDS = f"{EVIDENCE.format(p=WILSON.format(s='-'))} AS low, {EVIDENCE.format(p='least(' + WILSON.format(s='+') + ', 1)')} AS high"


@plan(f"""WITH_BOUNDS SELECT p.a, p.b, round(p.low - u.high - v.high, 6) AS low, round(p.high - u.low - v.low, 6) AS high FROM (SELECT a, b, {BOUNDS} FROM (SELECT a, b, support AS k, body AS n, 1.959963984540054::DOUBLE AS z FROM pairs)) p
    JOIN (SELECT rule_id, {BOUNDS} FROM (SELECT rule_id, support AS k, body_size AS n, 1.959963984540054::DOUBLE AS z FROM metrics)) u ON u.rule_id = p.a
    JOIN (SELECT rule_id, {BOUNDS} FROM (SELECT rule_id, support AS k, body_size AS n, 1.959963984540054::DOUBLE AS z FROM metrics)) v ON v.rule_id = p.b""".replace("WITH_BOUNDS ", ""))
def gain_intervals(b: Base):
    """Wilson intervals of pairs and rules, as evidence, and the gain's interval between them."""
    bounds = lambda n: [E.evidence(x).alias(name) for x, name in zip(E.wilson(C("support"), C(n)), ("low", "high"))]
    own = b.metrics.select("rule_id", *bounds("body_size"))
    got = b.pairs.select("a", "b", *bounds("body")).join(own.toDF("a", "a_low", "a_high"), "a").join(own.toDF("b", "b_low", "b_high"), "b")
    return got.select("a", "b", F.round(C("low") - C("a_high") - C("b_high"), 6).alias("low"), F.round(C("high") - C("a_low") - C("b_low"), 6).alias("high"))


@plan("SELECT f.rule_id, count(*) AS n, CAST(sum(l.label) AS BIGINT) AS pos FROM fired f JOIN labels l ON l.x = f.x AND l.y = f.y GROUP BY 1")
def marginal_postings(b: Base):
    """How many candidates each rule fires for, and how many of them are gold: the marginals of pairs and triples."""
    return b.fired.join(b.labels, ["x", "y"]).groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))


ACTIVE = "mfired f JOIN deps d ON d.a = f.rule_id JOIN mfired g ON g.x = f.x AND g.y = f.y AND g.rule_id = d.b"


@plan(f"""SELECT x, y, count(*) AS deps, count(*) FILTER (v > 0.01) AS effective, round(sum(v) FILTER (nth <= 1) / sum(v), 6) AS top_1, round(sum(v) FILTER (nth <= 3) / sum(v), 6) AS top_3 FROM (
    SELECT f.x, f.y, abs(lift) AS v, row_number() OVER (PARTITION BY f.x, f.y ORDER BY abs(lift) DESC, d.a, d.b) AS nth FROM {ACTIVE} JOIN gold o ON o.x = f.x AND o.y = f.y) GROUP BY x, y HAVING sum(v) > 0""")
def gold_effective(b: Base):
    """Of each gold candidate: active dependencies, those that count, and the share of the largest in all."""
    mine = b.mfired.join(b.gold, ["x", "y"], "left_semi")
    order = Window.partitionBy("x", "y").orderBy(C("v").desc(), "a", "b")
    each = dependencies.active(mine, b.deps.select("a", "b", "lift")).withColumn("v", F.abs("lift")).withColumn("nth", F.row_number().over(order))
    share = lambda k: F.round(F.sum(F.when(C("nth") <= k, C("v"))) / F.sum("v"), 6).alias(f"top_{k}")
    got = each.groupBy("x", "y").agg(F.count("*").alias("deps"), F.count(F.when(C("v") > 0.01, 1)).alias("effective"), share(1), share(3), F.sum("v").alias("all"))
    return got.where("all > 0").drop("all")


@plan(f"""SELECT x, y, round(dep_logit / (rule_logit + 1e-9), 6) AS ratio FROM (SELECT f.x, f.y, sum(lift) AS dep_logit FROM {ACTIVE} GROUP BY 1, 2) JOIN (SELECT x, y, sum(evidence) AS rule_logit FROM mfired GROUP BY 1, 2) USING (x, y)""")
def ratio_selector(b: Base):
    """What dependencies add, against what the rules say."""
    comp = dependencies.active(b.cands, b.deps.select("a", "b", "lift")).groupBy("x", "y").agg(F.sum("lift").alias("comp"))
    rule = b.mfired.groupBy("x", "y").agg(F.sum("evidence").alias("rule"))
    return comp.join(rule, ["x", "y"]).select("x", "y", F.round(C("comp") / (C("rule") + 1e-9), 6).alias("ratio"))


# Curves and selectors


CURVE = """SELECT '{f}' AS feature, g / 50 AS coverage, round(s / n, 9) AS mean FROM (SELECT g, greatest(1, CAST(round_even(t * (g / 50), 0) AS BIGINT)) AS n FROM range(1, 51) r(g), (SELECT count(*) AS t FROM metrics))
    JOIN (SELECT row_number() OVER o AS nth, sum(smooth) OVER (o ROWS UNBOUNDED PRECEDING) AS s FROM metrics WINDOW o AS (ORDER BY {f} DESC, rule_id)) ON nth = n"""
FEATURES = ("conf", "support", "body_size")
CURVES = " UNION ALL ".join(CURVE.format(f=f) for f in FEATURES)


def curves(b: Base) -> DataFrame:
    each = [analysis.coverage_curve(b.metrics, f, "smooth", "rule_id").select(F.lit(f).alias("feature"), "coverage", F.round("mean", 9).alias("mean")) for f in FEATURES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@plan(f"SELECT feature, coverage, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY mean DESC, coverage DESC) AS nth FROM ({CURVES}) WHERE coverage >= 0.2) WHERE nth = 1")
def best_threshold(b: Base):
    """The coverage of a fifth or more at which each feature's curve is highest."""
    return reports.best_at(curves(b), "feature", 0.2).select("feature", "coverage", r6("mean"))


@plan(f"SELECT feature, round(mean, 6) AS mean, rank() OVER (ORDER BY mean DESC) AS rank FROM ({CURVES}) WHERE coverage = 0.5")
def feature_ranking(b: Base):
    return reports.ranked_at(curves(b), 0.5).select("feature", r6("mean"), C("rank").cast("long").alias("rank"))


CTES["feats"] = """SELECT x, round(margin, 7) AS margin, round(h, 7) AS entropy, rr FROM (SELECT x, max(score) - coalesce(max(score) FILTER (nth = 2), 0) AS margin, sum(-p * ln(p)) AS h FROM (
      SELECT *, e / sum(e) OVER (PARTITION BY x) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY x)) AS e, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS nth FROM noisy)) GROUP BY x)
    JOIN (SELECT x, avg(coalesce(1 / rank, 0)) AS rr FROM ranks_noisy GROUP BY x) USING (x)"""


@plan("""SELECT w_margin, w_entropy, count(*) AS n, round(avg(rr), 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY w_margin, w_entropy ORDER BY score DESC, x) AS nth, count(*) OVER (PARTITION BY w_margin, w_entropy) AS size FROM (
      SELECT x, rr, u AS w_margin, v AS w_entropy, round(margin * u + entropy * v, 9) AS score FROM feats, range(0, 3) a(u), range(0, 3) c(v) WHERE u + v > 0)) WHERE nth * 5 <= size GROUP BY 1, 2""")
def formula_table(b: Base):
    values = features(b).select("x", F.round("margin", 7).alias("margin"), F.round("entropy", 7).alias("entropy"), "rr")
    got = reports.formula_search(values, ("margin", "entropy"), "rr")
    return got.select(C("w_margin").cast("long").alias("w_margin"), C("w_entropy").cast("long").alias("w_entropy"), "n", r6("gain"))


# Metrics


@plan(f"SELECT y, CASE WHEN max(mrr) - min(mrr) < 0.001 THEN 'equal' WHEN arg_max(config, mrr) = 'max' THEN 'rules' ELSE 'together' END AS verdict FROM (SELECT y, config, round(mrr, 9) AS mrr FROM ({RUNS})) GROUP BY y")
def verdicts(b: Base):
    """Of each answer which way of putting evidence together ranks it better, if either."""
    one, two = (answering.rank_metrics(r, "y").select("y", F.round("mrr", 9).alias(n)) for r, n in ((b.ranks_best, "u"), (b.ranks_noisy, "v")))
    d = C("v") - C("u")
    return one.join(two, "y").select("y", F.when(F.abs(d) < 0.001, "equal").when(d < 0, "rules").otherwise("together").alias("verdict"))


@plan("SELECT x, y, round(coalesce(1 / rank, 0) / top, 6) AS scaled FROM ranks_noisy JOIN (SELECT y, max(coalesce(1 / rank, 0)) AS top FROM ranks_noisy GROUP BY y) USING (y) WHERE top > 0")
def scaled_reciprocals(b: Base):
    """Reciprocal ranks over the largest of their group."""
    rr = b.ranks_noisy.select("x", "y", answering.reciprocal(C("rank")).alias("rr"))
    top = rr.groupBy("y").agg(F.max("rr").alias("top")).where("top > 0")
    return rr.join(top, "y").select("x", "y", F.round(C("rr") / C("top"), 6).alias("scaled"))


@plan("SELECT y, round(found, 6) AS found FROM (SELECT y, avg(coalesce(1 / rank, 0)) AS found FROM ranks_best GROUP BY y) WHERE abs(found - (round(found, 2))) > 0.002")
def misreported_metrics(b: Base):
    """Answers whose reported rate (of two places) is further than 0.002 from what the exported ranks give."""
    told = answering.rank_metrics(b.ranks_best, "y").select("y", F.round("mrr", 2).alias("mrr"))
    return reports.inconsistent(b.ranks_best, told, "y", 0.002).select("y", r6("found"))


for old, new in (("best", "SELECT y AS x, x AS y, score FROM best"), ("gold", "SELECT y AS x, x AS y FROM gold"), ("ret", "SELECT y AS x, x AS y FROM ret")):
    CTES[f"{old}_h"] = new
CTES["ranks_head"] = CTES["ranks_best"].replace("best", "best_h").replace("FROM gold g", "FROM gold_h g").replace("FROM ret r", "FROM ret_h r")

DIRECTION = """SELECT '{d}' AS direction, count(*) AS n, sum(coalesce(1 / rank, 0)) AS s, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hits FROM {t}"""


@plan(f"""SELECT direction, n, round(s / n, 6) AS mrr, round(hits, 6) AS hits_10 FROM ({DIRECTION.format(d='tail', t='ranks_best')} UNION ALL {DIRECTION.format(d='head', t='ranks_head')}
    UNION ALL SELECT 'both', sum(n), sum(s), sum(hits * n) / sum(n) FROM ({DIRECTION.format(d='tail', t='ranks_best')} UNION ALL {DIRECTION.format(d='head', t='ranks_head')}))""")
def mrr_by_direction(b: Base):
    """Tail queries (which brand?), head queries (which customer?) and both together, each query counting alike."""
    turn = lambda df: df.select(C("y").alias("x"), C("x").alias("y"), *[c for c in df.columns if c not in "xy"])
    total = b.ret.select("x").union(b.ret.select("y")).distinct().agg(F.count("*").alias("e"))
    head = answering.filtered_ranks(turn(b.best), turn(b.gold), turn(b.ret), F.lit(0)).crossJoin(F.broadcast(total))
    low = (C("score") == 0) & C("rank").isNotNull()
    head = head.select("x", "y", F.when(low, C("rank") + C("e") / 2).otherwise(C("rank")).alias("rank"))
    each = b.ranks_best.select("x", "y", "rank", F.lit("tail").alias("direction")).unionByName(head.withColumn("direction", F.lit("head")))
    both = each.unionByName(each.withColumn("direction", F.lit("both")))
    return answering.rank_metrics(both, "direction").select("direction", "n", r6("mrr"), r6("hits_10"))


# Training


@plan()
def train_two_stages(b: Base):
    """Rule and dependency weights from the valid customers' facts, both directions; every other of them chooses the epochs."""
    valid = split_of(C("x")) == "valid"
    cands = sets.only(b.held.where(valid & ~C("hit")), b.bodies)
    part = F.when(F.floor(F.split("x", ":")[1].cast("long") / 5) % 2 == 0, "train").otherwise("valid")
    rows = stash(answering.labelled(cands, b.ret.where(valid)), "train_rows").withColumn("part", part).withColumn("rel", F.lit(TARGET))
    turn = lambda d, q, c: rows.select("rel", F.lit(d).alias("direction"), C(q).alias("query"), C(c).alias("cand"), "rules", "label", "part")
    start = b.weights.join(b.bodies.select("rule_id"), "rule_id", "left_semi").select(F.lit(TARGET).alias("rel"), "rule_id", "w")
    deps = b.deps.where("abs(lift) > 0.01").select(F.lit(TARGET).alias("rel"), "a", "b", "lift")
    return stages.train_stages(turn("tail", "x", "y").unionByName(turn("head", "y", "x")), start, deps)
