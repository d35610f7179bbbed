"""Column functions of rules: classes, confidences, evidence, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Evidence caps, smoothing of mined metrics and of applied rules.
CAP, SMOOTH_MINED, SMOOTH_APPLIED = 7.0, 3, 5


def head_relation(rule: Column) -> Column:
    return F.regexp_extract(rule, r"^\s*([^(]+)\(", 1)


def _body(rule: Column) -> Column:
    return F.trim(F.regexp_extract(rule, r"<=(.*)$", 1))


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)


def is_binary(rule: Column) -> Column:
    return F.trim(F.split(rule, "<=")[0]).contains("(X,Y)")


def is_empty(rule: Column) -> Column:
    return _body(rule) == ""


def is_dangling(rule: Column) -> Column:
    """One occurrence of the variable A in the body: it stands for anything."""
    return _count(_body(rule), "(A,") + _count(_body(rule), ",A)") == 1


def rule_class(rule: Column) -> Column:
    """B, Z, Ud or Uc."""
    return F.when(is_binary(rule), "B").when(is_empty(rule), "Z").when(is_dangling(rule), "Ud").otherwise("Uc")


def coarse_class(kind: Column) -> Column:
    return F.when(kind == "B", "B").otherwise("U")


def pair_class(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "_")


def plain_type(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[()\s]", ""))


def confidence(support: Column, body: Column, unseen: Column | float = 0) -> Column:
    unseen = unseen if isinstance(unseen, Column) else F.lit(unseen)
    return F.when(body + unseen > 0, support / (body + unseen)).otherwise(F.lit(0.0))


def evidence(conf: Column, cap: float = CAP) -> Column:
    """-ln(1 - conf), at most cap (0: no cap); a confidence of 1 counts as the largest double below."""
    below = F.least(conf, F.lit(1.0 - 2.0**-53))
    found = -F.log1p(-below)
    return F.least(found, F.lit(float(cap))) if cap > 0 else found


def gain(joint: Column, a: Column, b: Column) -> Column:
    """Unified second-order gain: positive where two rules together say more than the sum of both."""
    return joint - a - b


def gain_legacy(joint_smooth: Column, joint_raw: Column, a: Column, b: Column, a_raw: Column, b_raw: Column) -> Column:
    """Positive: smoothed joint over the sum; if that isn't positive: raw joint under the mean of the raw ones, or 0."""
    up, down = joint_smooth - a - b, joint_raw - (a_raw + b_raw) / 2
    return F.when(up > 0, up).when(down < 0, down).otherwise(F.lit(0.0))


def type_weight(kind: Column) -> Column:
    return F.when(kind == "Z", 0.01).when(kind == "Ud", 0.1).otherwise(1.0)


def initial_weight(conf: Column, mode: str = "conf", signed: bool = True) -> Column:
    value = conf if mode == "conf" else evidence(conf, 0)
    return F.sqrt(value) if signed else value


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def match_level(old: Column, new: Column) -> Column:
    d = F.abs(old - new)
    return F.when(d == 0, 0).when(d < 0.1, 1).when(d < 0.2, 2).otherwise(3)


def gain_bucket(g: Column) -> Column:
    return F.when(g > 0.03, "positive").when(g < 0, "negative").otherwise("neutral")


def count_band(n: Column) -> Column:
    out = F.lit("120+")
    for top in (120, 60, 30, 15, 5):
        out = F.when(n <= top, f"<={top}").otherwise(out)
    return out


def quartile(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(value <= q1, "Q1").when(value <= q2, "Q2").when(value <= q3, "Q3").otherwise("Q4")


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def clipped_gain(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.least(F.greatest(after / before - 1, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    middle, half, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return F.greatest((middle - half) / scale, F.lit(0.0)), F.least((middle + half) / scale, F.lit(1.0))


#: Names of the ways in which the evidence of a candidate's rules is put together; values: array of evidences, descending.
COMBINE = {
    "max": lambda v: F.get(v, F.lit(0)),
    "noisyor": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x),
    "maxplus": lambda v: decayed(v, 0.1),
}


def decayed(values: Column, rate: float) -> Column:
    """Sum of the values, descending, each weighed by one more power of the rate."""
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"))
    step = lambda a, x: F.struct((a["sum"] + x * a["w"]).alias("sum"), (a["w"] * rate).alias("w"))
    return F.aggregate(values, begin, step, lambda a: a["sum"])


def combine(name: str):
    """A function of COMBINE, or decayNN: a rate of NN hundredths."""
    if name.startswith("decay"):
        return lambda v: decayed(v, int(name[5:]) / 100)
    return COMBINE[name]
