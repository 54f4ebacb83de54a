"""Queries over frames: sessions, delays, smoothing, conformal alarms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions.special import clopper_pearson
from sightline.operators import temporal as T
from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.views import with_views

V = ("frames",)
SESSIONS = """marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY camera ORDER BY t, event_id) <= 43200 THEN 0 ELSE 1 END AS fresh FROM frames), s AS (SELECT *, sum(fresh) OVER (PARTITION BY camera ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)"""


@query(with_views(f"{SESSIONS} SELECT camera::BIGINT AS camera, session::BIGINT AS session, count(*) AS n, max(t) - min(t) AS seconds FROM s GROUP BY camera, session", *V))
def gap_sessions(spark, sf_dir):
    return T.sessions(S.frames(spark, sf_dir), "camera", 43_200).groupBy(n("camera"), n("session")).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))


@query(with_views("""marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY camera ORDER BY t, event_id) <= 600 THEN 0 ELSE 1 END AS fresh FROM frames) SELECT camera::BIGINT AS camera, sum(fresh)::BIGINT AS sessions FROM marked GROUP BY camera""", *V))
def gap_sessions_600(spark, sf_dir):
    return T.sessions(S.frames(spark, sf_dir), "camera", 600).groupBy(n("camera")).agg(F.max("session").alias("sessions"))


@query(with_views(f"""{SESSIONS}, e AS (SELECT *, min(CASE WHEN visible THEN t END) OVER w AS onset, max(CASE WHEN visible THEN t END) OVER w AS last_pos FROM s WINDOW w AS (PARTITION BY camera, session)),
    k AS (SELECT *, CASE WHEN onset IS NULL THEN 'no_event' WHEN t < onset THEN 'before' WHEN t = onset THEN 'onset' WHEN t <= last_pos AND visible THEN 'during' WHEN t <= last_pos THEN 'gap' ELSE 'after' END AS kind FROM e)
    SELECT kind, count(*) AS n, round(avg((score >= 0.6)::INT), 6) AS alarm_rate FROM k GROUP BY kind""", *V))  # fmt: skip
def event_timing(spark, sf_dir):
    """Alarm rates by where a frame lies in its session."""
    w = Window.partitionBy("camera", "session")
    at = F.when(F.col("visible"), F.col("t"))
    rows = T.sessions(S.frames(spark, sf_dir), "camera", 43_200).withColumn("onset", F.min(at).over(w)).withColumn("last_pos", F.max(at).over(w))
    t, onset, last = F.col("t"), F.col("onset"), F.col("last_pos")
    kind = F.when(onset.isNull(), "no_event").when(t < onset, "before").when(t == onset, "onset").when((t <= last) & F.col("visible"), "during").when(t <= last, "gap").otherwise("after")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), r6(F.avg((F.col("score") >= 0.6).cast("int")), "alarm_rate"))


@query(with_views(f"""{SESSIONS}, e AS (SELECT camera, session, min(CASE WHEN visible THEN t END) AS onset, min(CASE WHEN visible AND score >= 0.8 THEN t END) AS alarm FROM s GROUP BY ALL), d AS (SELECT (alarm - onset) / 60.0::DOUBLE AS lead FROM e WHERE onset IS NOT NULL)
    SELECT count(*) AS events, round(avg((lead IS NULL)::INT), 6) AS missed, round(quantile_cont(lead, 0.1), 6) AS p10, round(quantile_cont(lead, 0.5), 6) AS p50, round(quantile_cont(lead, 0.9), 6) AS p90 FROM d""", *V))  # fmt: skip
def event_lead(spark, sf_dir):
    events = T.sessions(S.frames(spark, sf_dir), "camera", 43_200).groupBy("camera", "session").agg(F.min(F.when(F.col("visible"), F.col("t"))).alias("onset"), F.min(F.when(F.col("visible") & (F.col("score") >= 0.8), F.col("t"))).alias("alarm"))
    lead = events.where("onset IS NOT NULL").withColumn("lead", (F.col("alarm") - F.col("onset")) / 60.0)
    return lead.agg(F.count("*").alias("events"), r6(F.avg(F.col("lead").isNull().cast("int")), "missed"), *[r6(F.percentile("lead", p), name) for p, name in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))])


@query(with_views("""g AS (SELECT a.event_id, a.camera, min(abs(a.t - b.t)) AS gap FROM frames a LEFT JOIN frames b ON a.camera = b.camera AND b.visible WHERE NOT a.visible GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY gap NULLS LAST, event_id) AS i, count(gap) OVER (PARTITION BY camera) AS m FROM g)
    SELECT camera::BIGINT AS camera, count(*) AS n, count(*) FILTER (WHERE gap <= 120) AS within_2, count(*) FILTER (WHERE gap > 120 AND gap <= 600) AS within_10, count(*) FILTER (WHERE gap > 600 AND gap <= 3600) AS within_60, count(*) FILTER (WHERE gap > 3600) AS more, max(CASE WHEN i = m // 2 + 1 AND m > 0 THEN gap END) AS median_gap FROM r GROUP BY camera""", *V))  # fmt: skip
def nearest_positive(spark, sf_dir):
    """Gaps of negatives to the nearest positive of their camera; the median is the upper middle element."""
    w = Window.partitionBy("camera")
    gaps = T.nearest_positive(S.frames(spark, sf_dir), "camera").withColumn("i", F.row_number().over(w.orderBy(F.col("gap").asc_nulls_last(), "event_id"))).withColumn("m", F.count("gap").over(w))
    g = F.col("gap")
    one = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    return gaps.groupBy(n("camera")).agg(F.count("*").alias("n"), one(g <= 120, "within_2"), one((g > 120) & (g <= 600), "within_10"), one((g > 600) & (g <= 3600), "within_60"), one(g > 3600, "more"), F.max(F.when((F.col("i") == F.floor(F.col("m") / 2) + 1) & (F.col("m") > 0), g)).alias("median_gap"))


@query(with_views("""p AS (SELECT DISTINCT camera, t // 3600 AS hour FROM frames WHERE visible) SELECT camera::BIGINT AS camera, count(*) AS negatives, count(*) FILTER (WHERE (camera, t // 3600) IN (SELECT camera, hour FROM p)) AS same_hour FROM frames WHERE NOT visible GROUP BY camera""", *V))
def same_hour_negatives(spark, sf_dir):
    rows = S.frames(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600))
    pos = rows.where("visible").select("camera", "hour").distinct().withColumn("hit", F.lit(1))
    return rows.where("NOT visible").join(pos, ["camera", "hour"], "left").groupBy(n("camera")).agg(F.count("*").alias("negatives"), F.count("hit").alias("same_hour"))


DELAYS = """d AS (SELECT sequence_id, camera, min(CASE WHEN visible AND score >= tau THEN offset_s END) / 60.0::DOUBLE AS delay, max((NOT visible AND score >= tau)::INT) AS any_pre, sum((NOT visible AND score >= tau)::INT) AS alarms, sum((NOT visible)::INT) AS pre FROM {} GROUP BY sequence_id, camera)"""
SUMMARY = """count(*) AS n, round(avg((delay IS NULL)::INT), 6) AS missed, round(quantile_cont(delay, 0.5), 6) AS median, round(avg(delay), 6) AS mean, round(quantile_cont(delay, 0.9), 6) AS p90, round(avg(coalesce(delay <= 10, false)::INT), 6) AS within_10, round(avg(any_pre), 6) AS any_pre, round(sum(alarms) / sum(pre), 6) AS far"""
NAMES = ("missed", "median", "mean", "p90", "within_10", "any_pre", "far")


@query(with_views(f"f AS (SELECT *, 0.8::DOUBLE AS tau FROM frames), {DELAYS.format('f')} SELECT {SUMMARY} FROM d", *V))
def time_to_detection(spark, sf_dir):
    return T.delay_summary(T.delays(S.frames(spark, sf_dir), 0.8)).select("n", *[r6(c) for c in NAMES])


@query(with_views(f"""q AS (SELECT a.fold, quantile_cont(score, 0.95) AS tau FROM range(4) a(fold) JOIN frames f ON f.camera % 4 <> a.fold WHERE NOT visible GROUP BY a.fold), f AS (SELECT frames.*, tau FROM frames JOIN q ON camera % 4 = fold), {DELAYS.format('f')} SELECT (camera % 4)::BIGINT AS fold, {SUMMARY} FROM d GROUP BY camera % 4""", *V))
def matched_far(spark, sf_dir):
    """Camera-disjoint folds: each fold's threshold is the 95 % quantile of the other folds' frames before onset."""
    rows = S.frames(spark, sf_dir).withColumn("fold", F.col("camera") % 4)
    others = rows.where("NOT visible").select("score", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("fold"))).alias("fold"))
    tau = others.groupBy("fold").agg(F.percentile("score", 0.95).alias("tau"))
    per = T.delays(rows.join(F.broadcast(tau), "fold"), F.col("tau")).withColumn("fold", F.col("camera") % 4)
    return T.delay_summary(per, ["fold"]).select(n("fold"), "n", *[r6(c) for c in NAMES])


@query(with_views(f"""m AS (SELECT sequence_id, camera, max(score) AS top FROM frames WHERE NOT visible GROUP BY ALL), q AS (SELECT fold, quantile_cont(top, 0.9) AS tau FROM range(4) a(fold) JOIN m ON m.camera % 4 <> a.fold GROUP BY fold), f AS (SELECT frames.*, tau FROM frames JOIN q ON camera % 4 = fold), {DELAYS.format('f')} SELECT (camera % 4)::BIGINT AS fold, {SUMMARY} FROM d GROUP BY camera % 4""", *V))
def matched_sequence_fa(spark, sf_dir):
    rows = S.frames(spark, sf_dir).withColumn("fold", F.col("camera") % 4)
    top = rows.where("NOT visible").groupBy("sequence_id", "fold").agg(F.max("score").alias("top"))
    tau = top.select("top", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("fold"))).alias("fold")).groupBy("fold").agg(F.percentile("top", 0.9).alias("tau"))
    per = T.delays(rows.join(F.broadcast(tau), "fold"), F.col("tau")).withColumn("fold", F.col("camera") % 4)
    return T.delay_summary(per, ["fold"]).select(n("fold"), "n", *[r6(c) for c in NAMES])


@query(with_views("""o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY offset_s, event_id) AS i FROM frames), l AS (SELECT sequence_id, list(score ORDER BY offset_s, event_id) AS xs FROM frames GROUP BY sequence_id),
    e AS (SELECT o.sequence_id, o.event_id, list_reduce(xs[1:i], lambda a, x: a * 0.5::DOUBLE + x * 0.5::DOUBLE) AS ema FROM o JOIN l USING (sequence_id)) SELECT sequence_id, event_id, round(ema, 6) AS ema FROM e""", *V))  # fmt: skip
def ema(spark, sf_dir):
    return T.ema(S.frames(spark, sf_dir), 1.0).select("sequence_id", "event_id", r6("ema"))


@query(with_views("""w AS (SELECT sequence_id, event_id, list(score) OVER (PARTITION BY sequence_id ORDER BY offset_s, event_id ROWS 2 PRECEDING) AS held FROM frames) SELECT sequence_id, event_id, round(list_reverse_sort(list_concat(held, [0.0, 0.0, 0.0]))[2], 6) AS stat FROM w""", *V))
def k_of_n(spark, sf_dir):
    return T.k_of_n(S.frames(spark, sf_dir), 2, 3).select("sequence_id", "event_id", r6("stat"))


@query(with_views("""p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY offset_s, event_id) AS j FROM frames WHERE visible) SELECT sequence_id, d::BIGINT AS d, round(max(score), 6) AS m FROM p JOIN (VALUES (0), (2), (5)) x(d) ON j <= d + 1 GROUP BY sequence_id, d""", *V))
def best_within(spark, sf_dir):
    """Best score of the first D + 1 frames from onset, for several D in one pass."""
    j = F.row_number().over(Window.partitionBy("sequence_id").orderBy("offset_s", "event_id"))
    rows = S.frames(spark, sf_dir).where("visible").withColumn("j", j).withColumn("d", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5)))).where("j <= d + 1")
    return rows.groupBy("sequence_id", n("d")).agg(r6(F.max("score"), "m"))


@query(with_views("""p AS (SELECT fold, alpha, score FROM frames JOIN range(4) a(fold) ON camera % 4 <> fold, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) x(alpha) WHERE visible), r AS (SELECT *, row_number() OVER (PARTITION BY fold, alpha ORDER BY score) AS i, count(*) OVER (PARTITION BY fold, alpha) AS n FROM p),
    t AS (SELECT fold, alpha, score AS tau FROM r WHERE i = greatest(floor((n + 1) * alpha + 1e-12), 1)) SELECT fold::BIGINT AS fold, alpha, round(tau, 6) AS t, round(avg((score >= tau)::INT) FILTER (WHERE visible), 6) AS sensitivity, round(avg((score >= tau)::INT) FILTER (WHERE NOT visible), 6) AS far FROM t JOIN frames ON camera % 4 = fold GROUP BY ALL""", *V))  # fmt: skip
def conformal_alarm(spark, sf_dir):
    """Split-conformal alarm thresholds on camera-disjoint folds, and their rates on the fold held out."""
    rows = S.frames(spark, sf_dir).withColumn("fold", F.col("camera") % 4)
    other = rows.where("visible").select("score", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("fold"))).alias("fold"))
    tau = None
    for alpha in (0.05, 0.1, 0.2):
        part = T.conformal_threshold(other, "score", alpha, ["fold"]).select("fold", F.lit(alpha).alias("alpha"), F.col("t").alias("tau"))
        tau = part if tau is None else tau.union(part)
    alarm = (F.col("score") >= F.col("tau")).cast("int")
    return rows.join(F.broadcast(tau), "fold").groupBy(n("fold"), "alpha", r6("tau", "t")).agg(r6(F.avg(F.when(F.col("visible"), alarm)), "sensitivity"), r6(F.avg(F.when(~F.col("visible"), alarm)), "far"))


@query(with_views("""p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY offset_s, event_id) AS j FROM frames WHERE visible), m AS (SELECT sequence_id, camera % 4 AS own, max(score) AS m FROM p WHERE j <= 3 GROUP BY ALL),
    r AS (SELECT fold, m, row_number() OVER (PARTITION BY fold ORDER BY m) AS i, count(*) OVER (PARTITION BY fold) AS n FROM m JOIN range(4) a(fold) ON own <> fold), t AS (SELECT fold, m AS t FROM r WHERE i = greatest(floor((n + 1) * 0.2::DOUBLE + 1e-12), 1))
    SELECT own::BIGINT AS fold, count(*) AS n, sum((m < t)::INT)::BIGINT AS missed FROM m JOIN t ON own = fold GROUP BY own""", *V))  # fmt: skip
def conformal_ttd(spark, sf_dir):
    """Conformal thresholds on the best score within three frames; sequences missed on the fold held out."""
    j = F.row_number().over(Window.partitionBy("sequence_id").orderBy("offset_s", "event_id"))
    m = S.frames(spark, sf_dir).where("visible").withColumn("j", j).where("j <= 3").groupBy("sequence_id", (F.col("camera") % 4).alias("own")).agg(F.max("score").alias("m"))
    other = m.select("m", F.explode(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("own"))).alias("fold"))
    tau = T.conformal_threshold(other, "m", 0.2, ["fold"]).select("fold", "t")
    return m.join(F.broadcast(tau), F.col("own") == F.col("fold")).groupBy(n("fold")).agg(F.count("*").alias("n"), F.sum((F.col("m") < F.col("t")).cast("long")).alias("missed"))


@query()
def conformal_miss_interval(spark, sf_dir):
    """Pooled miss of ``conformal_ttd`` with its exact interval."""
    total = conformal_ttd(spark, sf_dir).agg(F.sum("missed").alias("x"), F.sum("n").alias("n")).first()
    low, high = clopper_pearson(total["x"] or 0, total["n"] or 1)
    return spark.createDataFrame([(total["x"], total["n"], round(low, 6), round(high, 6))], "missed long, n long, low double, high double")


@query(with_views("s AS (SELECT camera, count(*) AS n FROM frames GROUP BY camera) SELECT camera::BIGINT AS camera, n FROM s", *V))
def camera_sizes(spark, sf_dir):
    return S.frames(spark, sf_dir).groupBy(n("camera")).agg(F.count("*").alias("n"))


@query()
def balanced_folds(spark, sf_dir):
    """Four folds of cameras, the largest camera first into the smallest fold."""
    sizes = [(r["camera"], r["n"]) for r in camera_sizes(spark, sf_dir).collect()]
    rows = [(c, k) for k, fold in enumerate(T.folds(sizes, 4)) for c in fold]
    return spark.createDataFrame(rows, "camera long, fold int")
