"""Queries that compose the others: grids, size curves, selection, joins of result tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions.columns import centre_to_corner, uniform
from sightline.operators import calibration as C
from sightline.operators import curves as V
from sightline.operators import inference as I
from sightline.operators import matching as M
from sightline.plans.detection import IMAGES, VIEWS, base, matched_sql
from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.views import _u, with_views


@query(with_views("r AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS i, score FROM detections) SELECT image_id, string_agg(det_id, ',' ORDER BY i) FILTER (WHERE i <= 3) AS top, count(*) AS n, round(max(score), 6) AS best FROM r GROUP BY image_id", *VIEWS))
def top3_by_image(spark, sf_dir):
    """The three best detections of an image as one array."""
    held = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "det_id"))), 1, 3)
    return S.detections(spark, sf_dir).groupBy("image_id").agg(F.array_join(F.transform(held, lambda x: x["det_id"].cast("string")), ",").alias("top"), F.count("*").alias("n"), r6(F.max("score"), "best"))


RANKED = "k AS (SELECT count(*) FILTER (WHERE score >= 0.5) / (SELECT count(*) FROM images WHERE split = 'src_cal') AS kappa FROM detections JOIN images USING (image_id) WHERE split = 'src_cal'), size AS (SELECT split, count(*) AS n FROM images WHERE split <> 'src_cal' GROUP BY split), r AS (SELECT split, score, row_number() OVER (PARTITION BY split ORDER BY score DESC, det_id) AS i FROM detections JOIN images USING (image_id))"


def nth_largest(spark, sf_dir, rule):
    images = S.images(spark, sf_dir)
    rows = S.detections(spark, sf_dir).join(images, "image_id").select("split", "score")
    size = images.groupBy("split").agg(F.count("*").alias("n"))
    kept = rows.where("split = 'src_cal'").agg(F.sum((F.col("score") >= 0.5).cast("int")).alias("kept"))
    kappa = kept.join(F.broadcast(size.where("split = 'src_cal'").select(F.col("n").alias("m")))).select((F.col("kept") / F.col("m")).alias("kappa"))
    need = size.where("split <> 'src_cal'").join(F.broadcast(kappa)).select("split", rule(F.col("kappa") * F.col("n")).cast("long").alias("k"))
    return V.places(rows, "score", F.desc("score"), ["split"]).join(F.broadcast(need), "split").where("k BETWEEN first AND last").select("split", "k", r6("score", "t"))


@query(with_views(f"{RANKED} SELECT r.split, i AS k, round(score, 6) AS t FROM r JOIN size USING (split), k WHERE i = ceil(kappa * n - 1e-9)", *VIEWS))
def kept_rate_ceil(spark, sf_dir):
    return nth_largest(spark, sf_dir, lambda x: F.ceil(x - 1e-9))


@query(with_views(f"{RANKED} SELECT r.split, i AS k, round(score, 6) AS t FROM r JOIN size USING (split), k WHERE i = round_even(kappa * n, 0)", *VIEWS))
def kept_rate_round(spark, sf_dir):
    """Rounded half to even, as in Python."""
    return nth_largest(spark, sf_dir, lambda x: F.bround(x, 0))


@query(with_views("c AS (SELECT i.split, i.image_id, count(d.det_id) AS c FROM images i LEFT JOIN (SELECT * FROM detections WHERE score >= 0.5) d USING (image_id) GROUP BY ALL) SELECT split, round(avg(c), 6) AS kappa, round(avg(least(c, 1)), 6) AS kappa_1, round(avg(least(c, 2)), 6) AS kappa_2 FROM c GROUP BY split", *VIEWS))
def capped_kappa(spark, sf_dir):
    """Kept detections per image, plain and capped."""
    kept = S.detections(spark, sf_dir).where("score >= 0.5").groupBy("image_id").agg(F.count("*").alias("c"))
    rows = S.images(spark, sf_dir).join(kept, "image_id", "left").fillna(0, ["c"])
    return rows.groupBy("split").agg(r6(F.avg("c"), "kappa"), r6(F.avg(F.least("c", F.lit(1))), "kappa_1"), r6(F.avg(F.least("c", F.lit(2))), "kappa_2"))


@query(with_views(f"{matched_sql(0.5)}, m AS (SELECT split, score FROM matched JOIN images USING (image_id) WHERE is_tp = 1), p AS (SELECT (k + 1) / 10.0::DOUBLE AS p, k FROM range(9) r(k)), q AS (SELECT split, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM m GROUP BY split) SELECT round(p, 6) AS p, round(max(CASE WHEN split = 'src_cal' THEN q[k + 1] END), 4) AS source, round(max(CASE WHEN split = 'tgt_cal' THEN q[k + 1] END), 4) AS target FROM p, q GROUP BY p", *VIEWS, recursive=True))
def qq_table(spark, sf_dir):
    """Deciles of true positives' scores on source and target."""
    levels = [k / 10 for k in range(1, 10)]
    m = base(spark, sf_dir)[3].where("is_tp = 1 AND split <> 'tgt_test'")
    q = m.groupBy("split").agg(F.percentile("score", F.array(*map(F.lit, levels))).alias("qs")).select("split", F.posexplode("qs").alias("k", "q"))
    one = lambda s: F.round(F.max(F.when(F.col("split") == s, F.col("q"))), 4)
    return q.groupBy(r6((F.col("k") + 1) / 10, "p")).agg(one("src_cal").alias("source"), one("tgt_cal").alias("target"))


@query()
def roc_at_quantiles(spark, sf_dir):
    """Alarm rates at quantiles of the negatives' scores."""
    im = M.image_max(S.images(spark, sf_dir), S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir)).select("max_score", "is_pos")
    t = im.where("NOT is_pos").agg(F.percentile("max_score", F.array(*map(F.lit, (0.5, 0.8, 0.9, 0.95)))).alias("ts")).select(F.explode("ts").alias("t"))
    alarm = (F.col("max_score") >= F.col("t")).cast("int")
    return im.join(F.broadcast(t)).groupBy("t").agg(r6(F.avg(F.when(F.col("is_pos"), alarm)), "sensitivity"), r6(F.avg(F.when(~F.col("is_pos"), alarm)), "far"))


@query(with_views(f"{IMAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {_u('draw', 'draw || chr(124) || image_id')}, image_id) AS i FROM im, range(3) r(draw) WHERE split = 'tgt_cal') SELECT size::BIGINT AS size, draw::BIGINT AS draw, count(*) AS n, round(avg(max_score), 6) AS mean FROM o, (VALUES (25), (50), (100)) x(size) WHERE i <= size GROUP BY ALL", *VIEWS))
def size_curve(spark, sf_dir):
    """Means of samples of several sizes and draws, all in one plan."""
    im = M.image_max(S.images(spark, sf_dir), S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir)).where("split = 'tgt_cal'")
    drawn = im.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2))))
    order = uniform("draw", F.concat_ws("|", F.col("draw").cast("string"), F.col("image_id").cast("string")))
    ranked = drawn.withColumn("i", F.row_number().over(Window.partitionBy("draw").orderBy(order, "image_id"))).where("i <= 100")
    sized = ranked.withColumn("size", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100)))).where("i <= size")
    return sized.groupBy(n("size"), n("draw")).agg(F.count("*").alias("n"), r6(F.avg("max_score"), "mean"))


@query(with_views(f"h AS (SELECT *, (row_number() OVER (ORDER BY {_u('half', 'image_id')}, image_id) > count(*) OVER () // 2)::INT AS half FROM images WHERE split = 'src_cal') SELECT half::BIGINT AS half, count(*) AS n, sum(image_id % 1000)::BIGINT AS ids FROM h GROUP BY half", "images"))
def seeded_halves(spark, sf_dir):
    return I.halves(S.images(spark, sf_dir).where("split = 'src_cal'"), "image_id").groupBy(n("half")).agg(F.count("*").alias("n"), F.sum(F.col("image_id") % 1000).alias("ids"))


@query(with_views(f"""{matched_sql(0.5)}, g AS (SELECT thr, map, category_id, score AS raw, CASE WHEN map = 'root' THEN sqrt(score) ELSE score END AS s, is_tp FROM matched JOIN images USING (image_id), (VALUES ('none', 0.0::DOUBLE), ('half', 0.5::DOUBLE)) t(thr, t), (VALUES ('identity'), ('root')) m(map) WHERE split = 'tgt_test' AND score >= t),
    b AS (SELECT thr, map, greatest(list_count([e FOR e IN [k / 10.0::DOUBLE FOR k IN range(10)] IF e < s]), 1) AS bin, count(*) AS n, avg(s) AS s, avg(is_tp) AS q FROM g GROUP BY ALL) SELECT thr, map, sum(n)::BIGINT AS n, round(sum(n * abs(q - s)) / sum(n), 6) AS error FROM b GROUP BY thr, map""", *VIEWS, recursive=True))  # fmt: skip
def decomposition(spark, sf_dir):
    """Calibration error on a grid of thresholds and maps that is joined in."""
    m = base(spark, sf_dir)[3].where("split = 'tgt_test'").select("score", "is_tp")
    grid = spark.createDataFrame([(thr, t, name) for thr, t in (("none", 0.0), ("half", 0.5)) for name in ("identity", "root")], "thr string, t double, map string")
    rows = m.join(F.broadcast(grid), F.col("score") >= F.col("t")).withColumn("score", F.when(F.col("map") == "root", F.sqrt("score")).otherwise(F.col("score")))
    table = C.bins(rows, 10, ["thr", "map"], "is_tp")
    return C.calibration_error(table, ["thr", "map"]).join(table.groupBy("thr", "map").agg(F.sum("n").alias("n")), ["thr", "map"]).select("thr", "map", "n", r6("error"))


@query(with_views("ci AS (SELECT family, model, target, avg(regret_a) AS point, stddev_samp(regret_a) AS sd FROM cells WHERE seed = 0 OR target <> 'A' GROUP BY ALL), r AS (SELECT family, count(*) AS runs FROM cells GROUP BY family) SELECT c.family, c.model, c.target, c.seed::BIGINT AS seed, round(c.regret_a, 6) AS value, round(ci.point, 6) AS point, runs, ci.point IS NOT NULL AS has_ci FROM cells c LEFT JOIN ci USING (family, model, target) LEFT JOIN r USING (family)", "cells"))
def cell_table(spark, sf_dir):
    """Cells with their intervals and run records, where there are any."""
    cells = S.cells(spark, sf_dir)
    keys = ["family", "model", "target"]
    ci = cells.where("seed = 0 OR target <> 'A'").groupBy(*keys).agg(F.avg("regret_a").alias("point"))
    runs = cells.groupBy("family").agg(F.count("*").alias("runs"))
    return cells.join(ci, keys, "left").join(runs, "family", "left").select(*keys, n("seed"), r6("regret_a", "value"), r6("point"), "runs", F.col("point").isNotNull().alias("has_ci"))


@query(with_views("SELECT count(*) AS n, count(*) FILTER (WHERE abs(a.regret_a - b.regret_a) > 1e-9) AS violations, (SELECT count(*) FROM cells c WHERE seed = 1 AND NOT EXISTS (SELECT 1 FROM cells d WHERE d.seed = 0 AND c.family = d.family AND c.model = d.model AND c.target = d.target)) AS missing FROM cells a JOIN cells b USING (family, model, target) WHERE a.seed = 1 AND b.seed = 0", "cells"))
def agreement(spark, sf_dir):
    """Cells of two runs side by side: how many differ, how many lack a partner."""
    cells, keys = S.cells(spark, sf_dir), ["family", "model", "target"]
    a, b = cells.where("seed = 1").select(*keys, "regret_a"), cells.where("seed = 0").select(*keys, F.col("regret_a").alias("other"))
    both = a.join(b, keys, "left")
    met = F.col("other").isNotNull()
    return both.agg(F.sum(met.cast("long")).alias("n"), F.sum((met & (F.abs(F.col("regret_a") - F.col("other")) > 1e-9)).cast("long")).alias("violations"), F.sum((~met).cast("long")).alias("missing"))


@query(with_views("k AS (SELECT *, CASE WHEN n < 5 THEN 'too few' WHEN target = 'N' AND seed = 1 THEN 'twin' WHEN f1 < 0.2 THEN 'floor' ELSE 'kept' END AS reason FROM cells) SELECT reason, count(*) AS cells, round(avg(f1), 6) AS f1 FROM k GROUP BY reason", "cells"))
def cell_selection(spark, sf_dir):
    """Which cells count, and why others do not."""
    reason = F.when(F.col("n") < 5, "too few").when((F.col("target") == "N") & (F.col("seed") == 1), "twin").when(F.col("f1") < 0.2, "floor").otherwise("kept")
    return S.cells(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("cells"), r6(F.avg("f1"), "f1"))


@query(with_views("z AS (SELECT max(shift) AS cut FROM cells WHERE target = 'N') SELECT shift > cut AS above, count(*) AS n, round(avg(regret_b), 6) AS mean, round(max(regret_b), 6) AS worst, round(avg((regret_b > 0.04)::INT), 6) AS share FROM cells, z WHERE target <> 'N' GROUP BY 1", "cells"))
def null_cutoff(spark, sf_dir):
    """Cells above and below the greatest shift of the null cells."""
    cells = S.cells(spark, sf_dir)
    cut = cells.where("target = 'N'").agg(F.max("shift").alias("cut"))
    return cells.where("target <> 'N'").join(F.broadcast(cut)).groupBy((F.col("shift") > F.col("cut")).alias("above")).agg(F.count("*").alias("n"), r6(F.avg("regret_b"), "mean"), r6(F.max("regret_b"), "worst"), r6(F.avg((F.col("regret_b") > 0.04).cast("int")), "share"))


@query("SELECT p_partkey, regexp_extract(p_type, '^([A-Z]+)', 1) AS family, regexp_extract(p_brand, '([0-9]+)$', 1) AS size, lower(p_brand) || '__to__' || lower(p_type) AS cell, CASE WHEN p_size <= 10 THEN 'n' WHEN p_size <= 30 THEN 's' ELSE 'x' END AS kind FROM part")
def run_names(spark, sf_dir):
    part = S.table(spark, sf_dir, "part")
    return part.select("p_partkey", F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("family"), F.regexp_extract("p_brand", "([0-9]+)$", 1).alias("size"), F.concat_ws("__to__", F.lower("p_brand"), F.lower("p_type")).alias("cell"), F.when(F.col("p_size") <= 10, "n").when(F.col("p_size") <= 30, "s").otherwise("x").alias("kind"))


@query(with_views("SELECT ann_id, x, y, round(w, 2) AS w, round(h, 2) AS h FROM gt_boxes", "gt_boxes"))
def normalised_boxes(spark, sf_dir):
    """Boxes to normalised centres and back."""
    g = S.gt_boxes(spark, sf_dir)
    cx, cy, w, h = (F.col("x") + F.col("w") / 2) / 1024, (F.col("y") + F.col("h") / 2) / 512, F.col("w") / 1024, F.col("h") / 512
    return g.select("ann_id", *centre_to_corner(cx, cy, w, h, F.lit(1024), F.lit(512)))


@query(with_views(f"""{IMAGES}, neg AS (SELECT max_score, row_number() OVER (ORDER BY max_score) - 1 AS i, count(*) OVER () AS m FROM im WHERE split = 'src_cal' AND NOT is_pos), t AS (SELECT max(CASE WHEN i = floor(0.9 * (m - 1)) THEN max_score END) * (1 - any_value(0.9::DOUBLE * (m - 1) - floor(0.9 * (m - 1)))) + max(CASE WHEN i = ceil(0.9 * (m - 1)) THEN max_score END) * any_value(0.9::DOUBLE * (m - 1) - floor(0.9 * (m - 1))) AS t FROM neg)
    SELECT split, round(t, 4) AS t, round(avg((max_score >= t)::INT) FILTER (WHERE NOT is_pos), 4) AS far, round(avg((max_score >= t)::INT) FILTER (WHERE is_pos), 4) AS sensitivity FROM im, t GROUP BY split, t""", *VIEWS))  # fmt: skip
def far_transfer(spark, sf_dir):
    """The source's threshold at a false-alarm rate of 0.1, and what it gives on every split."""
    im = M.image_max(S.images(spark, sf_dir), S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir))
    t = im.where("split = 'src_cal' AND NOT is_pos").agg(F.percentile("max_score", 0.9).alias("t"))
    alarm = (F.col("max_score") >= F.col("t")).cast("int")
    return im.join(F.broadcast(t)).groupBy("split", F.round("t", 4).alias("t")).agg(F.round(F.avg(F.when(~F.col("is_pos"), alarm)), 4).alias("far"), F.round(F.avg(F.when(F.col("is_pos"), alarm)), 4).alias("sensitivity"))


@query()
def bca_interval(spark, sf_dir):
    """Bias-corrected accelerated interval of an F1, from replicates and a jackknife by subtraction."""
    from sightline.functions.special import bca_levels
    from sightline.plans.detection import image_stats

    images, gt, _, m = base(spark, sf_dir)
    units = image_stats(images, gt, m).select("image_id", (2.0 * F.col("tp")).alias("top"), (F.col("nd") + F.col("ng")).alias("bottom"))
    point = units.agg(F.try_divide(F.sum("top"), F.sum("bottom")).alias("p")).first()["p"]
    reps = I.replicate_ratio(I.weights(units, "image_id", 200), "top", "bottom", [])
    below = reps.agg(F.avg((F.col("value") < point).cast("int")).alias("b")).first()["b"]
    j = I.jackknife_ratio(units, "top", "bottom").agg(F.avg("value").alias("m")).first()["m"]
    moments = I.jackknife_ratio(units, "top", "bottom").agg(F.sum(F.pow(j - F.col("value"), 3)).alias("c"), F.sum(F.pow(j - F.col("value"), 2)).alias("s")).first()
    a = moments["c"] / (6 * moments["s"] ** 1.5) if moments["s"] else 0.0
    low, high = bca_levels(below, [0.0, 0.0]) if not a else _levels(below, a)
    return reps.agg(F.lit(round(point, 6)).alias("point"), r6(F.percentile("value", low), "low"), r6(F.percentile("value", high), "high"))


def _levels(below: float, a: float) -> tuple[float, float]:
    from sightline.functions.special import normal_cdf, normal_quantile

    z0 = normal_quantile(min(max(below, 1e-9), 1 - 1e-9))
    level = lambda z: normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
    return level(normal_quantile(0.025)), level(normal_quantile(0.975))


@query(with_views("c AS (SELECT sequence_id, count(*) AS n, min(offset_s) AS first, max(offset_s) AS last, sum((NOT visible)::INT) AS pre, sum(visible::INT) AS post FROM frames GROUP BY sequence_id) SELECT sequence_id, n, first, last, pre::BIGINT AS pre, post::BIGINT AS post FROM c", "frames"))
def sequence_index(spark, sf_dir):
    v = F.col("visible").cast("long")
    return S.frames(spark, sf_dir).groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("offset_s").alias("first"), F.max("offset_s").alias("last"), F.sum(1 - v).alias("pre"), F.sum(v).alias("post"))


@query(with_views("s AS (SELECT *, lag(t) OVER (PARTITION BY camera ORDER BY t, event_id) AS before FROM frames) SELECT camera::BIGINT AS camera, count(before) AS gaps, min(t - before) AS least, max(t - before) AS most FROM s GROUP BY camera", "frames"))
def consecutive_gaps(spark, sf_dir):
    before = F.lag("t").over(Window.partitionBy("camera").orderBy("t", "event_id"))
    return S.frames(spark, sf_dir).withColumn("gap", F.col("t") - before).groupBy(n("camera")).agg(F.count("gap").alias("gaps"), F.min("gap").alias("least"), F.max("gap").alias("most"))
