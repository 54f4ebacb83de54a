"""Roll-ups over cells: groups, wins and losses, seeds, rank statistics, cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIE = 1e-12


def group_summary(cells: DataFrame) -> DataFrame:
    """Regret of two methods over all cells, families, models, targets and family by target, in one pass of grouping sets; with wins, losses and both kinds of gap closed."""
    gain = F.col("regret_a") - F.col("regret_b")
    sets = [[], [F.col("family")], [F.col("model")], [F.col("target")], [F.col("family"), F.col("target")]]
    return cells.groupingSets(sets, F.col("family"), F.col("model"), F.col("target")).agg(
        F.count("*").alias("cells"),
        F.avg("regret_b").alias("mean"),
        F.percentile("regret_b", 0.5).alias("median"),
        F.max("regret_b").alias("worst"),
        F.stddev_samp("regret_b").alias("sd"),
        F.sum((gain > TIE).cast("int")).alias("wins"),
        F.sum((gain < -TIE).cast("int")).alias("losses"),
        (1 - F.avg("regret_b") / F.avg("regret_a")).alias("closed_of_means"),
        F.avg(1 - F.try_divide("regret_b", "regret_a")).alias("mean_closed"),
    )


def seed_pairs(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of two seeds side by side and their absolute difference."""
    wide = cells.groupBy(*keys).pivot("seed", [0, 1]).agg(F.first(value))
    return wide.select(*keys, F.col("0").alias("seed_0"), F.col("1").alias("seed_1"), F.abs(F.col("0") - F.col("1")).alias("difference"))


def mid_rank(value: str) -> F.Column:
    """Rank with ties in the middle."""
    return F.rank().over(Window.orderBy(value)) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area under the ROC curve, ties one half: from ranks of distinct values, no pairs."""
    by = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    worth = by.withColumn("neg", F.col("n") - F.col("pos")).withColumn("above", F.col("pos") * (below + F.col("neg") / 2))
    return worth.agg(F.try_divide(F.sum("above"), F.sum("pos") * F.sum("neg")).alias("auc"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.withColumn("ra", mid_rank(a)).withColumn("rb", mid_rank(b)).agg(F.corr("ra", "rb").alias("rho"))


def confusion(rows: DataFrame, flag, label, keys: list[str] | None = None) -> DataFrame:
    one = lambda c: F.sum(c.cast("int"))
    out = rows.groupBy(*(keys or [])).agg(one(flag & label).alias("tp"), one(flag & ~label).alias("fp"), one(~flag & label).alias("fn"), one(~flag & ~label).alias("tn"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    return out.withColumn("sensitivity", share("tp", "fn")).withColumn("specificity", share("tn", "fp")).withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2)


def cutoffs(rows: DataFrame, held_by: str, score: str, label: str) -> DataFrame:
    """Per held-out key the cut-off of best balanced accuracy on all other keys, ties to the lesser; candidates are the distinct scores.

    Counts at or above a cut-off are totals less those of the key held out, so candidates never meet the rows.
    """
    by = rows.groupBy(held_by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    every = by.groupBy(score).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    grid = rows.select(held_by).distinct().crossJoin(F.broadcast(every))
    filled = grid.join(by, [held_by, score], "left").select(held_by, score, (F.col("all_pos") - F.coalesce("pos", F.lit(0))).alias("p"), (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("m"))
    down, part = Window.partitionBy(held_by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(held_by)
    q = filled.withColumn("q", F.col("m") - F.col("p"))
    rate = q.select(held_by, score, F.try_divide(F.sum("p").over(down), F.sum("p").over(part)).alias("tpr"), F.try_divide(F.sum("q").over(down), F.sum("q").over(part)).alias("fpr"))
    best = Window.partitionBy(held_by).orderBy(F.desc("balanced"), score)
    return rate.withColumn("balanced", F.round((F.col("tpr") + 1 - F.col("fpr")) / 2, 9)).withColumn("r_", F.row_number().over(best)).where("r_ = 1").select(held_by, F.col(score).alias("cutoff"), "balanced")
