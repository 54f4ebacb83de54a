"""Column functions: boxes, bits, logits, bins and keyed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str, key: Column | str) -> Column:
    """A value in [0, 1) fixed by salt and key: the first 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two (x, y, w, h) boxes with these column prefixes; 0 if the union is empty."""
    c = F.col
    wide = F.greatest(F.least(c(f"{a}x") + c(f"{a}w"), c(f"{b}x") + c(f"{b}w")) - F.greatest(c(f"{a}x"), c(f"{b}x")), F.lit(0.0))
    high = F.greatest(F.least(c(f"{a}y") + c(f"{a}h"), c(f"{b}y") + c(f"{b}h")) - F.greatest(c(f"{a}y"), c(f"{b}y")), F.lit(0.0))
    union = c(f"{a}w") * c(f"{a}h") + c(f"{b}w") * c(f"{b}h") - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def centre_to_corner(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre box to absolute top-left box, two decimals."""
    return [F.round((cx - w / 2) * width, 2).alias("x"), F.round((cy - h / 2) * height, 2).alias("y"), F.round(w * width, 2).alias("w"), F.round(h * height, 2).alias("h")]


def corners_to_box(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")]


def bits(values: Column, n: int) -> Column:
    """Sign bits of the first n elements of an array, as one long."""
    return F.aggregate(F.slice(values, 1, n), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > 0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def unsigned_hex(text: Column) -> Column:
    """16 hex digits as the signed long with the same bits."""
    return F.conv(text, 16, -10).cast("long")


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def entropy(p: Column) -> Column:
    """Of a Bernoulli variable, in nats."""
    part = lambda q: F.when(q > 0, -q * F.ln(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def bin_of(score: Column, bins: int) -> Column:
    """Bins [0, e1], (e1, e2], ...: how many edges k / bins lie below the score, at least 1. Compared with the edges themselves, as products round."""
    guess = F.ceil(score * bins).cast("int")
    edge = lambda k: k.cast("double") / bins
    exact = F.when(edge(guess - 1) >= score, guess - 1).when(edge(guess) < score, guess + 1).otherwise(guess)
    return F.least(F.greatest(exact, F.lit(1)), F.lit(bins))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def norm_split(name: Column) -> Column:
    return F.when(F.lower(name).isin("valid", "validation"), F.lit("val")).otherwise(F.lower(name))


def call_of(low: Column, high: Column) -> Column:
    """Three-way reading of an interval of differences."""
    return F.when(low > 0, F.lit("gain")).when(high < 0, F.lit("loss")).otherwise(F.lit("ns"))


def interval_text(point: Column, low: Column, high: Column) -> Column:
    """In percent: 2.6 [2.4, 3.6]."""
    return F.format_string("%.1f [%.1f, %.1f]", point * 100, low * 100, high * 100)
