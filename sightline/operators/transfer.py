"""Threshold transfer without labels, shift distances and mixtures."""

from __future__ import annotations

from math import exp, inf, lgamma, log, log1p

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.curves import places


def wasserstein(a: DataFrame, b: DataFrame, value: str = "score") -> DataFrame:
    """One-dimensional W1 between two samples: the area between their distribution functions.

    Equal values are added up first; the ordered pass is over distinct values.
    """
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("in_a")).unionAll(b.select(F.col(value).alias("x"), F.lit(0).alias("in_a")))
    by = both.groupBy("x").agg(F.sum("in_a").alias("a"), F.count("*").alias("n"))
    run, every = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    share = lambda c: F.sum(c).over(run) / F.sum(c).over(every)
    steps = by.withColumn("b", F.col("n") - F.col("a")).select("x", F.abs(share("a") - share("b")).alias("gap"), (F.lead("x").over(Window.orderBy("x")) - F.col("x")).alias("step"))
    return steps.agg(F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)).alias("w1"))


def quantile_match(source: DataFrame, target: DataFrame, t: float, value: str = "score") -> DataFrame:
    """The target's quantile at the share of source values below t."""
    share = source.agg(F.avg((F.col(value) < t).cast("double")).alias("share"))
    ranked = places(target.select(F.col(value).alias("v")), "v", F.asc("v"), [])
    at = F.col("share") * (F.col("n") - 1)
    spots = share.join(F.broadcast(target.agg(F.count("*").alias("n")))).select("share", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    holds = lambda spot: (F.col("first") <= F.col(spot) + 1) & (F.col(spot) + 1 <= F.col("last"))
    ends = ranked.join(F.broadcast(spots), holds("low") | holds("high"))
    return ends.groupBy("share").agg((F.max(F.when(holds("low"), F.col("v"))) * (1 - F.first("part")) + F.max(F.when(holds("high"), F.col("v"))) * F.first("part")).alias("t"))


def binned(rows: DataFrame, n: int = 500) -> DataFrame:
    """Scores by bin middle: the small table that likelihood searches run on."""
    return rows.groupBy(((F.floor(F.least(F.col("score"), F.lit(1 - 1e-12)) * n) + 0.5) / n).alias("x")).agg(F.count("*").alias("n"))


class Beta:
    """A Beta density by moments."""

    def __init__(self, mean: float, variance: float):
        k = max(mean * (1 - mean) / max(variance, 1e-9) - 1, 1e-3)
        self.a, self.b = mean * k, (1 - mean) * k

    def log_density(self, x: float) -> float:
        return lgamma(self.a + self.b) - lgamma(self.a) - lgamma(self.b) + (self.a - 1) * log(x) + (self.b - 1) * log1p(-x)


def em_share(bins: list[tuple[float, float]], tp: Beta, fp: Beta, start: float = 0.5, tolerance: float = 1e-8, most: int = 1000) -> tuple[float, int]:
    """Mixing share of true positives over binned scores (x, n), densities held fixed; and the number of steps."""
    ratio = [(exp(max(-700, min(700, fp.log_density(x) - tp.log_density(x)))), n) for x, n in bins]
    total, share = sum(n for _, n in ratio), start
    for step in range(1, most + 1):
        after = sum(n * share / (share + (1 - share) * r) for r, n in ratio) / total
        if abs(after - share) < tolerance:
            return after, step
        share = after
    return share, most


def mixture_threshold(share: float, tp: Beta, fp: Beta, grid: int = 2000) -> float:
    """The least grid point from which on the posterior of a true positive stays at one half or more."""
    points = [(k + 0.5) / grid for k in range(grid)]
    below = [k for k, x in enumerate(points) if log(max(share, 1e-300)) + tp.log_density(x) < log(max(1 - share, 1e-300)) + fp.log_density(x)]
    last = max(below, default=-1) + 1
    return points[last] if last < grid else inf
