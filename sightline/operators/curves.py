"""Precision/recall curves, thresholds and alarm rates.

Curves are cumulative sums over scores. Equal scores are added up first (one group-by with map-side
combine), so the ordered pass sees distinct scores only, and the rows of a curve key at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pr_curve(matched: DataFrame, n_gt: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 at each distinct score of each key; ``n_gt`` has (keys, n_gt)."""
    by_score = matched.groupBy(*keys, "score").agg(F.sum("is_tp").alias("t"), F.count("*").alias("n"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.select(*keys, "score", F.sum("t").over(falling).alias("tp"), F.sum("n").over(falling).alias("nd"))
    return run.join(n_gt, keys).select(*keys, "score", "tp", "nd", "n_gt", (F.col("tp") / F.col("nd")).alias("precision"), F.try_divide("tp", "n_gt").alias("recall"), (2 * F.col("tp") / (F.col("nd") + F.col("n_gt"))).alias("f1"))


def f1_optimum(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The row of greatest F1 of each key; of equal ones that of the greatest score."""
    order = ["f1", "score"]
    best = curve.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in curve.columns if c not in (*keys, *order)])).alias("b_"))
    return best.select(*[c if c in keys else F.col(f"b_.{c}") for c in curve.columns])


def at_threshold(matched: DataFrame, n_gt: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of the detections with score >= t, for each (key, t); thresholds are few and sent to where the detections are."""
    each = thresholds.select(*keys, "t").distinct()
    met = matched.join(F.broadcast(each), keys).where("score >= t").groupBy(*keys, "t").agg(F.sum("is_tp").alias("tp"), F.count("*").alias("nd"))
    cut = each.join(met, [*keys, "t"], "left").fillna(0, ["tp", "nd"])
    return cut.join(n_gt, keys).select(*keys, "t", "tp", "nd", "n_gt", F.try_divide("tp", "nd").alias("precision"), F.try_divide("tp", "n_gt").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("nd") + F.col("n_gt")).alias("f1"))


def alarm_rates(images: DataFrame, t, keys: list[str]) -> DataFrame:
    """Sensitivity, false-alarm rate and alarm precision of images with max_score >= t; null without a denominator."""
    alarm = (F.col("max_score") >= t).cast("int")
    pos, neg = F.col("is_pos"), ~F.col("is_pos")
    return images.groupBy(*keys).agg(
        F.sum(pos.cast("int")).alias("n_pos"),
        F.sum(neg.cast("int")).alias("n_neg"),
        F.avg(F.when(pos, alarm)).alias("sensitivity"),
        F.avg(F.when(neg, alarm)).alias("far"),
        F.try_divide(F.sum(F.when(pos, alarm).otherwise(0)), F.sum(alarm)).alias("alarm_precision"),
    )


def image_roc(images: DataFrame, steps: int = 100) -> DataFrame:
    """Alarm rates at 0, 1/steps, ..., 1: a histogram over the grid and a cumulative sum, not one pass per threshold."""
    # how many grid points are at most the score, by comparison with the points themselves
    guess = F.floor(F.col("max_score") * steps).cast("int")
    k = F.when((guess + 1) / F.lit(float(steps)) <= F.col("max_score"), guess + 1).when(guess / F.lit(float(steps)) > F.col("max_score"), guess - 1).otherwise(guess)
    counts = images.groupBy(F.least(k, F.lit(steps)).alias("k")).agg(F.sum(F.col("is_pos").cast("int")).alias("pos"), F.count("*").alias("n"))
    grid = images.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").fillna(0)
    above, every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    neg = F.col("n") - F.col("pos")
    return grid.select((F.col("k") / F.lit(float(steps))).alias("t"), F.try_divide(F.sum("pos").over(above), F.sum("pos").over(every)).alias("sensitivity"), F.try_divide(F.sum(neg).over(above), F.sum(neg).over(every)).alias("far"))


def nth_lowest(rows: DataFrame, value: str, k, keys: list[str]) -> DataFrame:
    """The k-th value (from 1, an expression over (n)) in ascending order of each key."""
    run = places(rows, value, F.col(value).asc(), keys)
    n = run.groupBy(*keys).agg(F.max("last").alias("n"))
    met = run.join(F.broadcast(n), keys).where((F.col("first") <= k) & (k <= F.col("last")))
    return met.select(*keys, F.col(value).alias("t"), "n")


def places(rows: DataFrame, value: str, order, keys: list[str]) -> DataFrame:
    """(keys, value, first, last): the places from 1 that each distinct value takes in its key's order; rows are counted, not sorted."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("c_"))
    run = counts.withColumn("last", F.sum("c_").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return run.select(*keys, value, (F.col("last") - F.col("c_") + 1).alias("first"), "last")


def kept_rate(scores: DataFrame, need: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold at which the cumulated increments come nearest to what is needed.

    ``scores``: (keys, score, incr); ``need``: (keys, need). Less than half the first step, or no
    score at all, gives 1; of equally near scores the greater one is taken.
    """
    steps = scores.groupBy(*keys, "score").agg(F.sum("incr").alias("incr"))
    falling = Window.partitionBy(*keys).orderBy(F.desc("score"))
    run = steps.withColumn("cum", F.sum("incr").over(falling.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(falling))
    near = Window.partitionBy(*keys).orderBy(F.abs(F.col("cum") - F.col("need")), "i")
    best = need.join(run, keys, "left").withColumn("r_", F.row_number().over(near)).withColumn("first", F.max(F.when(F.col("i") == 1, F.col("cum"))).over(Window.partitionBy(*keys)))
    return best.where("r_ = 1").select(*keys, "need", F.when(F.col("score").isNull() | (F.col("need") < F.col("first") / 2), 1.0).otherwise(F.col("score")).alias("t"))


def all_increments(ranked: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """The increments of several variants, added up by score: (variant, split, score, incr) of one pass over the ranks."""
    for v in variants:
        ranked = increments(ranked, v).withColumnRenamed("incr", f"of_{v}")
    sums = ranked.groupBy("split", "score").agg(*[F.sum(f"of_{v}").alias(f"of_{v}") for v in variants])
    return sums.select("split", "score", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"of_{v}").alias("incr")) for v in variants])).alias("x")).select("x.variant", "split", "score", "x.incr")


def increments(ranked: DataFrame, variant: str) -> DataFrame:
    """How much a detection counts: each 1; only the k best of an image; shares of the image; logarithmic in rank."""
    rank = F.col("rnk")
    if variant == "plain":
        value = F.lit(1.0)
    elif variant.startswith("top"):
        value = (rank <= int(variant[3:])).cast("double")
    elif variant == "share":
        value = 1.0 / F.count("*").over(Window.partitionBy("image_id"))
    elif variant == "log":
        value = F.ln(1.0 + rank) - F.ln(rank.cast("double"))
    else:
        raise ValueError(variant)
    return ranked.withColumn("incr", value)
