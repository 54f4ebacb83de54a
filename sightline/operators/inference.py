"""Bootstrap over additive statistics, paired tests, multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import uniform

#: Upper ends of Poisson(1) probabilities: a weight is how many of them a uniform passes.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def weights(units: DataFrame, unit: str, reps: int, salt: str = "boot") -> DataFrame:
    """(unit, rep, w): Poisson(1) weights keyed by unit and replicate, so that every metric and cell shares them.

    Units are already aggregated, so the table is units x reps rows of three numbers; weighted sums
    combine on the map side to reps rows.
    """
    long = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    u = uniform(salt, F.concat_ws(":", F.col(unit).cast("string"), F.col("rep").cast("string")))
    return long.withColumn("w", sum((u >= p).cast("int") for p in POISSON))


def replicate_ratio(weighted: DataFrame, top: str, bottom: str, keys: list[str]) -> DataFrame:
    """Replicates of sum(w top) / sum(w bottom)."""
    return weighted.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(top)), F.sum(F.col("w") * F.col(bottom))).alias("value"))


def interval(replicates: DataFrame, keys: list[str], level: float = 0.95, value: str = "value") -> DataFrame:
    tail = (1 - level) / 2
    return replicates.groupBy(*keys).agg(F.avg(value).alias("boot_mean"), F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.count(value).alias("valid"))


def two_sided_p(replicates: DataFrame, keys: list[str], value: str = "diff") -> DataFrame:
    """2 min(P(d <= 0), P(d >= 0)), at most 1."""
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    return replicates.groupBy(*keys).agg(F.least(2 * F.least(below, above), F.lit(1.0)).alias("p"))


def holm(tests: DataFrame, p: str, key: str, keys: list[str] | None = None) -> DataFrame:
    """Holm's step-down adjusted p: the running maximum of p times what is left."""
    part = Window.partitionBy(*(keys or []))
    order = part.orderBy(p, key)
    scaled = F.col(p) * (F.count("*").over(part) - F.row_number().over(order) + 1)
    return tests.withColumn("s_", scaled).withColumn("p_holm", F.least(F.max("s_").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("s_")


def jackknife_ratio(units: DataFrame, top: str, bottom: str) -> DataFrame:
    """Leave-one-out values of a ratio of sums, by subtraction from the totals: one row, sent to where the units are."""
    totals = units.agg(F.sum(top).alias("t_"), F.sum(bottom).alias("b_"))
    return units.join(F.broadcast(totals)).withColumn("value", F.try_divide(F.col("t_") - F.col(top), F.col("b_") - F.col(bottom))).drop("t_", "b_")


def subsample(units: DataFrame, unit: str, n: int, draw: int) -> DataFrame:
    """n units without replacement, by a keyed order."""
    order = uniform(f"draw{draw}", unit)
    return units.withColumn("o_", order).orderBy("o_", unit).limit(n).drop("o_")


def halves(units: DataFrame, unit: str, salt: str = "half") -> DataFrame:
    """Adds ``half``: 0 for the first half in a keyed order, 1 for the rest."""
    order = Window.orderBy(uniform(salt, unit), unit)
    return units.withColumn("half", (F.row_number().over(order) > F.floor(F.count("*").over(Window.partitionBy()) / 2)).cast("int"))
