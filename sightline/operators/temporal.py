"""Time series of frames: sessions, smoothing, detection delays, conformal thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, gap: int, order: str = "t") -> DataFrame:
    """Adds ``session``: a new one begins where more than ``gap`` seconds have passed within a key."""
    w = Window.partitionBy(key).orderBy(order, "event_id")
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("new_", new).withColumn("session", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def nearest_positive(rows: DataFrame, key: str) -> DataFrame:
    """For each negative row the least distance in seconds to a positive row of its key, on either side: two windows, no join."""
    mark = F.when(F.col("visible"), F.col("t"))
    # both frames only grow; one that shrinks would be added up anew for every row
    so_far = lambda order: Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before, after = F.max(mark).over(so_far(F.asc("t"))), F.min(mark).over(so_far(F.desc("t")))
    gap = F.least(F.col("t") - before, after - F.col("t"))  # least() leaves nulls out
    return rows.withColumn("gap", gap).where(~F.col("visible"))


def ordered(rows: DataFrame) -> DataFrame:
    """Each sequence as an array of (offset, event, score), in order."""
    return rows.groupBy("sequence_id", "camera").agg(F.array_sort(F.collect_list(F.struct("offset_s", "event_id", "score"))).alias("xs"))


def ema(rows: DataFrame, half_life: float) -> DataFrame:
    """Exponential moving average by a fold over each sequence: s0 = e0, s = l s + (1 - l) e."""
    keep = 0.5 ** (1 / half_life)
    typed = "array<struct<event_id:bigint,offset_s:bigint,ema:double>>"
    first = lambda x: F.struct(x["event_id"].alias("event_id"), x["offset_s"].alias("offset_s"), x["score"].alias("ema"))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["event_id"].alias("event_id"), x["offset_s"].alias("offset_s"), (F.element_at(acc, -1)["ema"] * keep + x["score"] * (1 - keep)).alias("ema"))))
    head = F.array(first(F.element_at("xs", 1))).cast(typed)
    return ordered(rows).select("sequence_id", "camera", F.explode(F.aggregate(F.slice("xs", 2, F.size("xs")), head, step)).alias("e")).select("sequence_id", "camera", "e.*")


def k_of_n(rows: DataFrame, k: int, n: int) -> DataFrame:
    """The k-th largest of the last n scores, with zeros before the beginning."""
    w = Window.partitionBy("sequence_id").orderBy("offset_s", "event_id").rowsBetween(-(n - 1), 0)
    held = F.collect_list("score").over(w)
    return rows.withColumn("stat", F.element_at(F.sort_array(F.concat(held, F.array_repeat(F.lit(0.0), n)), False), k))


def delays(rows: DataFrame, t, score: str = "score") -> DataFrame:
    """Per sequence: minutes to the first alarm after onset (null if missed), whether any alarm came before, its rate, and frames before."""
    alarm = F.col(score) >= t
    return rows.groupBy("sequence_id", "camera").agg(
        (F.min(F.when(F.col("visible") & alarm, F.col("offset_s"))) / 60.0).alias("delay_min"),
        F.max((~F.col("visible") & alarm).cast("int")).alias("any_pre"),
        F.sum((~F.col("visible") & alarm).cast("int")).alias("pre_alarms"),
        F.sum((~F.col("visible")).cast("int")).alias("n_pre"),
        F.sum(F.col("visible").cast("int")).alias("n_post"),
    )


def delay_summary(per_sequence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    d = F.col("delay_min")
    return per_sequence.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.avg(d.isNull().cast("double")).alias("missed"),
        F.percentile(d, 0.5).alias("median"),
        F.avg(d).alias("mean"),
        F.percentile(d, 0.9).alias("p90"),
        F.avg(F.coalesce(d <= 10, F.lit(False)).cast("double")).alias("within_10"),
        F.avg("any_pre").alias("any_pre"),
        F.try_divide(F.sum("pre_alarms"), F.sum("n_pre")).alias("far"),
    )


def conformal_threshold(rows: DataFrame, value: str, alpha: float, keys: list[str]) -> DataFrame:
    """Split-conformal: the k-th smallest value, k = floor((n + 1) alpha), at least 1."""
    order, every = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    ranked = rows.select(*keys, value, F.row_number().over(order).alias("r_"), F.count("*").over(every).alias("n"))
    k = F.greatest(F.floor((F.col("n") + 1) * F.lit(alpha) + 1e-12), F.lit(1))
    return ranked.where(F.col("r_") == k).select(*keys, F.col(value).alias("t"), "n")


def folds(sizes: list[tuple[int, int]], n: int) -> list[list[int]]:
    """Balanced folds of cameras: the largest first into the fold that is smallest then. A few rows, on the driver."""
    out: list[list[int]] = [[] for _ in range(n)]
    load = [0] * n
    for camera, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = load.index(min(load))
        out[k].append(camera)
        load[k] += size
    return out
