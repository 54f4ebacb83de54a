"""Calibration errors and maps of scored detections."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import bin_of, clip01, expit, logit


def bins(matched: DataFrame, n: int, keys: list[str], quality: str = "iou") -> DataFrame:
    """Counts, mean score and mean quality (0 where unmatched) by key and bin: additive, one shuffle of few rows."""
    worth = F.coalesce(F.col(quality).cast("double"), F.lit(0.0))
    return matched.groupBy(*keys, bin_of(F.col("score"), n).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), (F.sum(worth) / F.count("*")).alias("quality"))


def calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over bins of their share times abs(quality - mean score)."""
    gap = F.sum(F.col("n") * F.abs(F.col("quality") - F.col("mean_score")))
    return table.groupBy(*keys).agg((gap / F.sum("n")).alias("error"))


def laece(matched: DataFrame, n: int = 25, by: str = "category_id") -> DataFrame:
    """Localisation-aware calibration error by class; a class without any error is undefined and null."""
    error = calibration_error(bins(matched, n, [by]), [by])
    return error.select(by, F.when(F.col("error") > 0, F.col("error")).alias("laece"))


def lrp(at: DataFrame, tau: float = 0.0) -> DataFrame:
    """Localisation-recall-precision error from (tp, nd, n_gt, loss = sum of 1 - iou): total, localisation, false positives, false negatives."""
    fp, fn = F.col("nd") - F.col("tp"), F.col("n_gt") - F.col("tp")
    return at.withColumn("lrp", F.try_divide(F.col("loss") / (1 - tau) + fp + fn, F.col("tp") + fp + fn)).withColumn("lrp_loc", F.try_divide("loss", "tp")).withColumn("lrp_fp", F.try_divide(fp, F.col("nd"))).withColumn("lrp_fn", F.try_divide(fn, F.col("n_gt")))


def lrp_optimum(matched: DataFrame, n_gt: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of least LRP error of each key, over all distinct scores."""
    by = matched.groupBy(*keys, "score").agg(F.sum("is_tp").alias("t"), F.count("*").alias("n"), F.sum(F.when(F.col("is_tp") == 1, 1 - F.col("iou")).otherwise(0.0)).alias("l"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select(*keys, "score", F.sum("t").over(falling).alias("tp"), F.sum("n").over(falling).alias("nd"), F.sum("l").over(falling).alias("loss")).join(n_gt, keys)
    best = Window.partitionBy(*keys).orderBy("lrp", F.desc("score"))
    return lrp(run).withColumn("lrp", F.round("lrp", 9)).withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the best precision at recall r or more, over r = 0, 0.01, ..., 1."""
    # the best precision of each hundredth of recall: from there on at most 101 rows of a key
    level = F.floor(F.col("recall") * 100 + 1e-9)
    best = curve.where("recall IS NOT NULL").groupBy(*keys, level.alias("level")).agg(F.max("precision").alias("best"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("level"))
    points = F.col("level") - F.lead("level", 1, -1).over(falling)
    steps = best.select(*keys, points.alias("points"), F.max("best").over(falling.rowsBetween(Window.unboundedPreceding, 0)).alias("best"))
    return steps.groupBy(*keys).agg((F.sum(F.col("points") * F.col("best")) / 101).alias("ap"))


def platt(matched: DataFrame, grid: int = 1000, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of expit(a logit(s) + b) by Newton on scores binned to ``grid`` values: the driver sees at most that many rows."""
    s = F.least(F.greatest(F.round(F.col("score") * grid) / grid, F.lit(0.5 / grid)), F.lit(1 - 0.5 / grid))
    rows = [(r["x"], r["t"], r["n"]) for r in matched.groupBy(logit(s).alias("x")).agg(F.sum("is_tp").alias("t"), F.count("*").alias("n")).orderBy("x").collect()]
    a, b = 1.0, 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t, n in rows:
            p = 1 / (1 + exp(-max(-35.0, min(35.0, a * x + b))))
            g0, g1, w = g0 + (t - n * p) * x, g1 + (t - n * p), n * p * (1 - p)
            h00, h01, h11 = h00 + w * x * x, h01 + w * x, h11 + w
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return abs(a), b


def platt_map(rows: DataFrame, a: float, b: float) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumn("score", clip01(expit(a * logit(p) + b)))


def isotonic_knots(matched: DataFrame, grid: int = 200) -> list[tuple[float, float]]:
    """Knots (score, value) by pooling adjacent violators over scores binned to ``grid`` values."""
    x = F.round(F.col("score") * grid) / grid
    pools: list[list[float]] = []
    for r in matched.groupBy(x.alias("x")).agg(F.sum("is_tp").alias("t"), F.count("*").alias("n")).orderBy("x").collect():
        pools.append([r["x"], r["x"], r["t"], r["n"]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low, high = pools[-2], pools.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    return [(x, t / n) for a, b, t, n in pools for x in dict.fromkeys((a, b))]


def piecewise_map(rows: DataFrame, knots: Sequence[tuple[float, float]]) -> DataFrame:
    """Linear interpolation between the knots (at most a few hundred), held beyond their ends."""
    table = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in knots])
    low = F.filter(table, lambda k: k["x"] <= F.col("score"))
    high = F.filter(table, lambda k: k["x"] > F.col("score"))
    a, b = F.try_element_at(low, F.lit(-1)), F.try_element_at(high, F.lit(1))
    value = a["y"] + (b["y"] - a["y"]) * (F.col("score") - a["x"]) / (b["x"] - a["x"])
    return rows.withColumn("score", F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(value))
