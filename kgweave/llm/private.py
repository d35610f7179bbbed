"""Personal data by weak supervision, with DataFrame operations only.

Base spans are found by fixed patterns and always stay. Wider patterns give candidates of further
kinds (numbers of local form, obscured addresses, account numbers, secrets). Labelers vote on every
span, base spans included: +1 (personal), -1 (not) or 0 (no opinion):

- form: what the characters themselves say, as check digits, the mix of digits and letters;
- gazetteer: lists of top-level domains, card issuers, number plans;
- context: words in the 48 characters before the span;
- place: whether the span stands alone between blanks, quotes or brackets.

Expectation-maximisation over the counts of vote patterns (at most 3 ** 4 for each kind, whatever the size
of the corpus) estimates how often each labeler is right and how likely each pattern is personal.
A logistic classifier learns those likelihoods from the votes and the span's shape, over all
spans of the corpus, and decides which candidates become spans. It is a column expression.

Positions come without Python: each match is put between two marks that the text can't contain, the
text is split there, and one pass over the pieces sums up their lengths and keeps the last
characters for the context.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, stash, table

OPEN, CLOSE, NEITHER = "\x01", "\x02", "\x03"
#: The contract's patterns. Possessive repeats and starts only where a run of the
#: first class starts (or the last match ended) give the same matches in linear time.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
WIDER = {
    "obscured_email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++ ?[\\[(](?:at|AT)[\\])] ?{_HOST}++(?: ?[\\[(](?:dot|DOT)[\\])] ?{_HOST}++)++",
    "local_phone": "(?<![0-9A-Za-z+.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "account": "(?<![0-9A-Za-z.-])(?:[0-9][ -]?){13,18}[0-9](?![0-9A-Za-z-])",
    "secret": "(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{32,128}+(?![0-9A-Za-z_-])",
}
#: A text without this has no match; checked before the pattern.
NEEDS = {"email": "@", "phone": "+", "obscured_email": ("(at", "[at", "(AT", "[AT")}
KINDS = [*BASE, *WIDER]
#: Word lists and number ranges of the labelers.
DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|at|ch|eu|us|ca|example"
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|mobile|fax|ruf|appel",
    "secret": "token|secret|key|passw|pwd|auth|credential",
    "account": "account|iban|konto|compte|cuenta|card",
}
CONTEXT |= {"obscured_email": CONTEXT["email"], "local_phone": CONTEXT["phone"]}
AGAINST = "version|licen[sc]e|isbn|issue|page|chapter|article|figure|section|commit|sha|md5|checksum|hash|build"
LABELERS = ("form", "gazetteer", "context", "place")
NEAR = 48
EM_TURNS, FIT_TURNS = 60, 400


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits_of(match)).between(14, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "account":
        return ~luhn(digits_of(match))
    return F.lit(True)


def marked(kind: str, text: Column) -> Column:
    """The text with marks round each match; null if it has none."""
    pattern = (BASE | WIDER)[kind]
    needs = NEEDS.get(kind, ())
    there = reduce(Column.__or__, [text.contains(x) for x in needs]) & text.rlike(pattern) if needs else text.rlike(pattern)
    return F.when(there, F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"))


def spans_of(kind: str, marks: Column) -> Column:
    """Array of (start, kind number, end, votes and shape) of the matches that pass."""
    n = KINDS.index(kind)
    piece_type = "struct<start: int, before: string, piece: string>"
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.array().cast(f"array<{piece_type}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        plain = F.replace(piece, F.lit(CLOSE), F.lit(""))
        out = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), acc["before"].alias("before"), piece.alias("piece"))))
        return F.struct((acc["at"] + F.length(plain)).alias("at"), F.substring(F.concat(acc["before"], plain), -NEAR, NEAR).alias("before"), out.alias("out"))

    pieces = F.filter(F.aggregate(F.split(marks, OPEN), begin, step, lambda acc: acc["out"]), lambda x: x["piece"].contains(CLOSE))
    # The match on its own, so that it is cut out once.
    each = F.transform(pieces, lambda x: F.struct(x["start"].alias("start"), x["before"].alias("before"), F.substring_index(x["piece"], CLOSE, 1).alias("m"), F.substring(F.substring_index(x["piece"], CLOSE, -1), 1, 1).alias("after")))
    good = F.filter(each, lambda x: passes(kind, x["m"]))

    def span(x: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        sides = F.concat(F.substring(x["before"], -1, 1), F.lit("|"), x["after"])
        votes = votes_of(kind, x["m"], F.lower(x["before"]), sides)
        shape = F.least(F.floor(F.log2(F.length(x["m"]))), F.lit(7)).cast("int")
        return F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), end.cast("int").alias("end"), *[v.cast("int").alias(k) for k, v in zip(LABELERS, votes)], shape.alias("shape"))

    kind_type = ", ".join(f"{c}: int" for c in ("start", "kind", "end", *LABELERS, "shape"))
    return F.coalesce(F.transform(good, span), F.array().cast(f"array<struct<{kind_type}>>"))


def votes_of(kind: str, match: Column, before: Column, sides: Column) -> list[Column]:
    digits = digits_of(match)
    yes = lambda c, other=0: F.when(c, 1).otherwise(other)
    same = digits.rlike("^(.)\\1*$")
    form = {
        "email": yes(~match.rlike("^[.-]|\\.\\.|[.-]@"), -1),
        "ip": yes(match.rlike("^[1-9][0-9]{1,2}\\."), 0),
        "card": yes(~same, -1),
        "phone": yes(F.length(digits) >= 11, 0),
        "obscured_email": yes(F.length(match) >= 10, 0),
        "local_phone": F.when(same, -1).when(match.rlike("\\(|^[0-9]{3}-[0-9]{3}-"), 1).otherwise(0),
        "account": F.when(same, -1).otherwise(0),
        "secret": F.when(match.rlike("^[0-9_-]+$|^[A-Za-z_-]+$"), -1).when(match.rlike("^[0-9A-Fa-f]+$|[0-9].*[0-9].*[0-9]"), 1).otherwise(0),
    }[kind]
    gazetteer = {
        "email": yes(F.lower(match).rlike(f"\\.({DOMAINS})$"), -1),
        "ip": F.when(match.rlike("^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\."), -1).otherwise(1),
        "card": yes(digits.rlike("^(4|5[1-5]|2[2-7]|3[4-8]|6)"), -1),
        "phone": yes(match.rlike("^\\+(1|33|34|49|44|39|31|41|43)"), 0),
        "obscured_email": yes(F.lower(match).rlike(f"({DOMAINS})$"), -1),
        "local_phone": F.when(digits.rlike("^[01]|^...[01]"), -1).otherwise(1),
        "account": F.when(digits.rlike("^(19|20)[0-9]{6}"), -1).otherwise(0),
        "secret": F.when(F.length(match).isin(32, 40, 48, 64, 96, 128), 1).otherwise(0),
    }[kind]
    context = F.when(before.rlike(f"({AGAINST})[^a-z]"), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
    place = F.when(sides.rlike(f"^[{BLANKS}\"'(\\[:=<]?\\|[{BLANKS}\"')\\].,;:!?>]?$"), 1).when(sides.rlike("[0-9A-Za-z/_]"), -1).otherwise(0)
    return [form, gazetteer, context, place]


def with_spans(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs, as one struct, so that no name of theirs can clash), base and more: arrays of spans with
    their votes. Candidates that touch a base span are left out."""
    clean = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE, NEITHER * 2)
    df = docs.select(F.struct("*").alias("doc"), clean.alias("clean"))
    df = df.select("doc", *[marked(k, F.col("clean")).alias(k) for k in KINDS])
    found = {k: spans_of(k, F.col(k)) for k in KINDS}
    df = df.select("doc", F.concat(*[found[k] for k in BASE]).alias("base"), F.concat(*[found[k] for k in WIDER]).alias("wide"))
    apart = lambda x, all_: ~F.exists(all_, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    return df.select("doc", "base", F.filter("wide", lambda x: apart(x, F.col("base"))).alias("more"))


def estimate(counts: list[dict], turns: int = EM_TURNS) -> dict[tuple, float]:
    """Likelihood that a span is personal, by (kind, votes): EM over the counts of vote patterns.

    Each kind has a share of personal spans; each labeler has, for personal spans and others, the chances of
    voting -1, 0, +1, shared by all kinds and smoothed so that each vote stays possible.
    """
    patterns: dict[tuple, float] = {}
    for r in counts:
        key = (r["kind"], *(r[k] for k in LABELERS))
        patterns[key] = patterns.get(key, 0) + r["n"]
    # At first, votes are right in four of five cases.
    chance = {(j, y, v): (0.8 if v == (1 if y else -1) else 0.2 if v else 0.5) for j in range(len(LABELERS)) for y in (0, 1) for v in (-1, 0, 1)}
    share = {k: 0.5 for k, *_ in patterns}
    likely: dict[tuple, float] = {}
    for _ in range(turns):
        for key in patterns:
            k, *votes = key
            side = [math.log(share[k] if y else 1 - share[k]) + sum(math.log(chance[j, y, v]) for j, v in enumerate(votes)) for y in (0, 1)]
            likely[key] = 1 / (1 + math.exp(max(-50.0, min(50.0, side[0] - side[1]))))
        for k in share:
            own = [(patterns[x], likely[x]) for x in patterns if x[0] == k]
            share[k] = (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                mass = {v: 1.0 + (v == (1 if y else -1)) for v in (-1, 0, 1)}
                for x, n in patterns.items():
                    mass[x[1 + j]] += n * (likely[x] if y else 1 - likely[x])
                chance |= {(j, y, v): m / sum(mass.values()) for v, m in mass.items()}
    return likely


def features(r: dict) -> list[str]:
    return [f"kind={r['kind']}", f"shape={r['shape']}", *(f"{k}={r[k]}" for k in LABELERS)]


def classifier(counts: list[dict], turns: int = FIT_TURNS) -> dict[str, float]:
    """Weights of a logistic classifier of spans, fitted to the estimated likelihoods of all of them."""
    likely = estimate(counts)
    rows = [(features(r), likely[(r["kind"], *(r[k] for k in LABELERS))], math.sqrt(r["n"])) for r in counts]
    weights = dict.fromkeys(sorted({f for fs, _, _ in rows for f in fs}), 0.0)
    squares = dict.fromkeys(weights, 1e-9)
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(turns):
        grad = {f: 1e-4 * w for f, w in weights.items()}
        for fs, p, n in rows:
            z = sum(weights[f] for f in fs)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for f in fs:
                grad[f] += error
        for f, g in grad.items():
            squares[f] += g * g
            weights[f] -= 0.3 * g / math.sqrt(squares[f])
    return weights


def train(spans: DataFrame) -> dict[str, float]:
    """From base and more of all documents. The groups are bounded: 8 kinds, 81 votes, 8 shapes."""
    each = spans.select(F.explode(F.concat("base", "more")).alias("s")).select("s.*")
    groups = each.groupBy("kind", *LABELERS, "shape").agg(F.count("*").alias("n")).collect()
    counts = sorted((r.asDict() for r in groups), key=lambda r: [r[k] for k in ("kind", *LABELERS, "shape")])
    return classifier(counts)


def chosen(weights: dict[str, float]) -> Column:
    """All spans, by start, then kind: base spans and the candidates that the classifier takes."""

    def taken(x: Column) -> Column:
        score = F.lit(0.0)
        for name in ("kind", "shape", *LABELERS):
            part = F.lit(0.0)
            for f, w in weights.items():
                if f.startswith(f"{name}="):
                    part = F.when(x[name] == int(f.split("=")[1]), F.lit(w)).otherwise(part)
            score = score + part
        return score > 0

    brief = lambda a: F.transform(a, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.array_sort(F.concat(brief(F.col("base")), brief(F.filter("more", taken))))


def said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans.

    Null or empty text: no spans, empty strings' hash. Null doc_id and repeated rows: rows like any
    other. No documents: no rows; without spans no candidate is taken. Other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = stash(with_spans(docs).select("doc.doc_id", "base", "more"), "pii")
    weights = train(spans)
    base = F.array_sort(F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"])))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    out = spans.select("doc_id", *[count(k) for k in BASE], F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), chosen(weights).alias("all"))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", said(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text where the text changes.

    Null or empty text: as it is. Null doc_id and repeated rows: rows like any other. An empty table
    gives no rows. Other columns pass through, whatever their names.
    """
    # Spans stand with their documents, so that the patterns run once.
    found = stash(with_spans(docs), "pii")
    weights = train(found)
    new = found.select("doc", chosen(weights).alias("all"))
    text = F.col("doc.text")
    new = new.select("doc", "all", F.when(F.size("all") > 0, redacted(text, F.col("all"))).otherwise(text).alias("text"))
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size("all") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return new.select(*[columns.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
