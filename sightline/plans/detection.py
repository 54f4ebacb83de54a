"""Queries over images, boxes and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import calibration as C
from sightline.operators import curves as V
from sightline.operators import inference as I
from sightline.operators import matching as M
from sightline.operators import transfer as T
from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.views import with_views

IOU = """CASE WHEN d.w * d.h + g.w * g.h - greatest(least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x), 0) * greatest(least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y), 0) > 0
  THEN greatest(least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x), 0) * greatest(least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y), 0) / (d.w * d.h + g.w * g.h - greatest(least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x), 0) * greatest(least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y), 0)) ELSE 0 END"""


def matched_sql(tau: float) -> str:
    """CTEs up to ``matched``: a walk over each image's candidates in the order of the fold."""
    return f"""cand AS (SELECT d.image_id, d.category_id, det_id, ann_id, score, {IOU} AS iou FROM detections d JOIN gt_boxes g USING (image_id, category_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id, iou DESC, ann_id) AS rn FROM cand WHERE iou >= {tau}),
    walk(image_id, rn, dets, gts) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM ranked
      UNION ALL SELECT r.image_id, r.rn, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, ann_id) THEN dets ELSE list_append(dets, det_id) END, CASE WHEN list_contains(dets, det_id) OR list_contains(gts, ann_id) THEN gts ELSE list_append(gts, ann_id) END FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rn = w.rn + 1),
    pairs AS (SELECT unnest(dets) AS det_id, unnest(gts) AS ann_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) AS back FROM walk) WHERE back = 1),
    matched AS MATERIALIZED (SELECT d.det_id, d.image_id, d.category_id, d.score, p.ann_id, (p.ann_id IS NOT NULL)::INT AS is_tp, r.iou FROM detections d LEFT JOIN pairs p USING (det_id) LEFT JOIN ranked r ON r.det_id = p.det_id AND r.ann_id = p.ann_id)"""


VIEWS = ("images", "detections")
CURVE = """n_gt AS (SELECT split, count(*) AS n_gt FROM gt_boxes JOIN images USING (image_id) GROUP BY split),
    m AS (SELECT matched.*, split FROM matched JOIN images USING (image_id)),
    by_score AS (SELECT split, score, sum(is_tp) AS t, count(*) AS n FROM m GROUP BY split, score),
    curve AS (SELECT split, score, sum(t) OVER w AS tp, sum(n) OVER w AS nd, n_gt FROM by_score JOIN n_gt USING (split) WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    best AS (SELECT *, 2.0 * tp / (nd + n_gt) AS f1 FROM curve QUALIFY row_number() OVER (PARTITION BY split ORDER BY 2.0::DOUBLE * tp / (nd + n_gt) DESC, score DESC) = 1)"""
IMAGES = """im AS (SELECT i.image_id, i.camera, i.split, coalesce(best, 0.0)::DOUBLE AS max_score, coalesce(nd, 0) AS n_dets, coalesce(ng, 0) > 0 AS is_pos FROM images i LEFT JOIN (SELECT image_id, max(score) AS best, count(*) AS nd FROM detections GROUP BY image_id) d USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS ng FROM gt_boxes GROUP BY image_id) g USING (image_id))"""


def base(spark, sf_dir, tau=0.5):
    """Images, boxes, detections, and matches with their split; the matches are made once in a session."""
    images, gt, det = S.images(spark, sf_dir), S.gt_boxes(spark, sf_dir), S.detections(spark, sf_dir)
    return images, gt, det, S.by_image(spark, sf_dir, "matched", lambda: M.matched(det, gt, tau).join(images, "image_id"), tau)


def split_gt(images, gt):
    return gt.join(images, "image_id").groupBy("split").agg(F.count("*").alias("n_gt"))


@query(with_views(f"""{matched_sql(0.5)}, {CURVE}, {IMAGES}, src AS (SELECT score AS t FROM best WHERE split = 'src_cal'),
    cut AS (SELECT m.split, t, sum(is_tp) AS tp, count(*) AS nd FROM m, src WHERE score >= t GROUP BY m.split, t),
    rates AS (SELECT im.split, avg((max_score >= t)::INT) FILTER (WHERE is_pos) AS sensitivity, avg((max_score >= t)::INT) FILTER (WHERE NOT is_pos) AS far FROM im, src GROUP BY im.split)
    SELECT split, round(t, 6) AS t_src, tp::BIGINT AS tp, nd::BIGINT AS nd, n_gt::BIGINT AS n_gt, round(2.0::DOUBLE * tp / (nd + n_gt), 6) AS f1, round(sensitivity, 6) AS sensitivity, round(far, 6) AS far FROM cut JOIN n_gt USING (split) JOIN rates USING (split)""", *VIEWS, recursive=True))  # fmt: skip
def operating_point(spark, sf_dir):
    """F1-optimal threshold of the source split, and what it gives on every split."""
    images, gt, det, m = base(spark, sf_dir)
    m = m.select("split", "score", "is_tp")
    n_gt = split_gt(images, gt)
    best = V.f1_optimum(V.pr_curve(m.where("split = 'src_cal'"), n_gt, ["split"]), ["split"]).select(F.col("score").alias("t"))
    splits = n_gt.select("split").join(F.broadcast(best))
    at = V.at_threshold(m, n_gt, splits, ["split"])
    im = M.image_max(images, det, gt).join(F.broadcast(best))
    rates = V.alarm_rates(im, F.col("t"), ["split"])
    return at.join(rates, "split").select("split", r6("t", "t_src"), n("tp"), n("nd"), n("n_gt"), r6("f1"), r6("sensitivity"), r6("far"))


@query(with_views(f"{matched_sql(0.5)} SELECT split, is_tp::BIGINT AS is_tp, count(*) AS n, sum(det_id % 1000)::BIGINT AS id_sum, round(avg(coalesce(iou, 0)), 6) AS iou FROM matched JOIN images USING (image_id) GROUP BY split, is_tp", *VIEWS, recursive=True))
def greedy_matching(spark, sf_dir):
    m = base(spark, sf_dir)[3]
    return m.groupBy("split", n("is_tp")).agg(F.count("*").alias("n"), F.sum(F.col("det_id") % 1000).alias("id_sum"), r6(F.avg(F.coalesce("iou", F.lit(0.0))), "iou"))


@query(with_views(f"{matched_sql(0.5)}, {CURVE} SELECT split, round(score, 6) AS score, tp::BIGINT AS tp, nd::BIGINT AS nd, round(tp / nd, 6) AS precision, round(tp / n_gt, 6) AS recall, round(2.0::DOUBLE * tp / (nd + n_gt), 6) AS f1 FROM curve", *VIEWS, recursive=True))
def pr_curve(spark, sf_dir):
    """Each split's whole curve."""
    images, gt, _, m = base(spark, sf_dir)
    return V.pr_curve(m, split_gt(images, gt), ["split"]).select("split", r6("score"), n("tp"), n("nd"), r6("precision"), r6("recall"), r6("f1"))


@query(with_views(f"{matched_sql(0.5)}, {CURVE} SELECT split, round(score, 6) AS t, round(f1, 6) AS f1 FROM best", *VIEWS, recursive=True))
def f1_optimum(spark, sf_dir):
    images, gt, _, m = base(spark, sf_dir)
    return V.f1_optimum(V.pr_curve(m, split_gt(images, gt), ["split"]), ["split"]).select("split", r6("score", "t"), r6("f1"))


@query(with_views(f"""{IMAGES}, grid AS (SELECT k, k / 100.0::DOUBLE AS t FROM range(101) r(k)) SELECT round(t, 6) AS t, round(avg((max_score >= t)::INT) FILTER (WHERE is_pos), 6) AS sensitivity, round(avg((max_score >= t)::INT) FILTER (WHERE NOT is_pos), 6) AS far FROM im, grid GROUP BY t""", *VIEWS))
def image_roc(spark, sf_dir):
    images, gt, det = S.images(spark, sf_dir), S.gt_boxes(spark, sf_dir), S.detections(spark, sf_dir)
    return V.image_roc(M.image_max(images, det, gt)).select(r6("t"), r6("sensitivity"), r6("far"))


@query(with_views(f"""{IMAGES}, r AS (SELECT split, max_score, row_number() OVER (PARTITION BY split ORDER BY max_score) AS i, count(*) OVER (PARTITION BY split) AS n FROM im WHERE is_pos) SELECT split, round(max_score, 6) AS t, n FROM r WHERE i = floor(0.05::DOUBLE * n) + 1""", *VIEWS))
def threshold_sens95(spark, sf_dir):
    images, gt, det = S.images(spark, sf_dir), S.gt_boxes(spark, sf_dir), S.detections(spark, sf_dir)
    pos = M.image_max(images, det, gt).where("is_pos")
    return V.nth_lowest(pos, "max_score", F.floor(0.05 * F.col("n")) + 1, ["split"]).select("split", r6("t"), "n")


@query(with_views(f"""{IMAGES} SELECT camera::BIGINT AS camera, count(*) AS n, round(avg((max_score >= 0.5)::INT) FILTER (WHERE is_pos), 6) AS sensitivity, round(avg((max_score >= 0.5)::INT) FILTER (WHERE NOT is_pos), 6) AS far FROM im GROUP BY camera""", *VIEWS))
def camera_alarm_rates(spark, sf_dir):
    images, gt, det = S.images(spark, sf_dir), S.gt_boxes(spark, sf_dir), S.detections(spark, sf_dir)
    rates = V.alarm_rates(M.image_max(images, det, gt), F.lit(0.5), ["camera"])
    return rates.select(n("camera"), n(F.col("n_pos") + F.col("n_neg"), "n"), r6("sensitivity"), r6("far"))


@query(with_views("SELECT rnk::BIGINT AS rnk, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rnk FROM detections) GROUP BY rnk", *VIEWS))
def rank_in_image(spark, sf_dir):
    return M.rank_in_image(S.detections(spark, sf_dir)).groupBy(n("rnk")).agg(F.count("*").alias("n"), r6(F.avg("score"), "mean"))


@query(with_views("SELECT image_id, det_id, round(score, 6) AS score FROM detections QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) <= 3", *VIEWS))
def top_per_image(spark, sf_dir):
    return M.top_per_image(S.detections(spark, sf_dir), 3).select("image_id", "det_id", r6("score"))


@query(with_views("""known AS (SELECT DISTINCT category_id FROM gt_boxes WHERE category_id = 1), flag AS (SELECT det_id, category_id, category_id IN (SELECT category_id FROM known) AS kept FROM detections) SELECT kept, count(*) AS n FROM flag GROUP BY kept""", *VIEWS))
def offclass_guard(spark, sf_dir):
    """Detections kept and dropped when only class 1 is annotated."""
    kept, dropped = M.off_class(S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir).where("category_id = 1"))
    return kept.agg(F.count("*").alias("n")).select(F.lit(True).alias("kept"), "n").union(dropped.agg(F.sum("dropped").alias("n")).select(F.lit(False), "n")).where("n > 0")


@query(with_views("SELECT split, count(*) FILTER (WHERE image_id IN (SELECT image_id FROM gt_boxes)) AS positive, count(*) FILTER (WHERE image_id NOT IN (SELECT image_id FROM gt_boxes)) AS negative FROM images GROUP BY split", "images", "gt_boxes"))
def positive_negative_images(spark, sf_dir):
    images, gt = S.images(spark, sf_dir), S.gt_boxes(spark, sf_dir)
    pos = images.join(gt, "image_id", "left_semi").groupBy("split").agg(F.count("*").alias("positive"))
    neg = images.join(gt, "image_id", "left_anti").groupBy("split").agg(F.count("*").alias("negative"))
    return images.select("split").distinct().join(pos, "split", "left").join(neg, "split", "left").fillna(0)


@query(with_views(f"""{matched_sql(0.01)}, b AS (SELECT category_id, list_count([e FOR e IN [k / 25.0::DOUBLE FOR k IN range(25)] IF e < score]) AS bin, score, coalesce(iou, 0) AS q FROM matched),
    bins AS (SELECT category_id, greatest(bin, 1) AS bin, count(*) AS n, avg(score) AS s, avg(q) AS q FROM b GROUP BY ALL), e AS (SELECT category_id, sum(n * abs(q - s)) / sum(n) AS e FROM bins GROUP BY category_id)
    SELECT category_id::BIGINT AS category_id, round(CASE WHEN e > 0 THEN e END, 6) AS laece FROM e""", *VIEWS, recursive=True))  # fmt: skip
def laece(spark, sf_dir):
    m = base(spark, sf_dir, 0.01)[3]
    return C.laece(m).select(n("category_id"), r6("laece"))


@query(with_views(f"""{matched_sql(0.5)}, b AS (SELECT greatest(list_count([e FOR e IN [k / 10.0::DOUBLE FOR k IN range(10)] IF e < score]), 1) AS bin, score, is_tp, split FROM matched JOIN images USING (image_id)),
    bins AS (SELECT split, bin, count(*) AS n, avg(score) AS s, avg(is_tp) AS q FROM b GROUP BY ALL) SELECT split, round(sum(n * abs(q - s)) / sum(n), 6) AS dece FROM bins GROUP BY split""", *VIEWS, recursive=True))  # fmt: skip
def dece(spark, sf_dir):
    m = base(spark, sf_dir)[3]
    return C.calibration_error(C.bins(m, 10, ["split"], "is_tp"), ["split"]).select("split", r6("error", "dece"))


@query(with_views(f"""{matched_sql(0.01)}, b AS (SELECT category_id, greatest(list_count([e FOR e IN [k / 25.0::DOUBLE FOR k IN range(25)] IF e < score]), 1) AS bin, score, coalesce(iou, 0) AS q FROM matched)
    SELECT category_id::BIGINT AS category_id, bin::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(q), 6) AS quality FROM b GROUP BY ALL""", *VIEWS, recursive=True))  # fmt: skip
def reliability(spark, sf_dir):
    m = base(spark, sf_dir, 0.01)[3]
    return C.bins(m, 25, ["category_id"]).select(n("category_id"), n("bin"), "n", r6("mean_score"), r6("quality"))


@query(with_views(f"""{matched_sql(0.5)}, n_gt AS (SELECT category_id, count(*) AS n_gt FROM gt_boxes GROUP BY category_id), by_score AS (SELECT category_id, score, sum(is_tp) AS t, count(*) AS n, sum(CASE WHEN is_tp = 1 THEN 1 - iou ELSE 0 END) AS l FROM matched GROUP BY ALL),
    run AS (SELECT category_id, score, sum(t) OVER w AS tp, sum(n) OVER w AS nd, sum(l) OVER w AS loss FROM by_score WINDOW w AS (PARTITION BY category_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, round((loss + (nd - tp) + (n_gt - tp)) / (nd + n_gt - tp), 9) AS lrp FROM run JOIN n_gt USING (category_id))
    SELECT category_id::BIGINT AS category_id, round(score, 6) AS t, round(lrp, 6) AS lrp, round(loss / tp, 6) AS lrp_loc, round((nd - tp) / nd, 6) AS lrp_fp, round((n_gt - tp) / n_gt, 6) AS lrp_fn FROM e QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY lrp, score DESC) = 1""", *VIEWS, recursive=True))  # fmt: skip
def lrp_optimum(spark, sf_dir):
    _, gt, _, m = base(spark, sf_dir)
    n_gt = gt.groupBy("category_id").agg(F.count("*").alias("n_gt"))
    return C.lrp_optimum(m, n_gt, ["category_id"]).select(n("category_id"), r6("score", "t"), *[r6(c) for c in ("lrp", "lrp_loc", "lrp_fp", "lrp_fn")])


@query(with_views(f"""{matched_sql(0.5)}, {CURVE}, points AS (SELECT k / 100.0::DOUBLE AS r FROM range(101) x(k)), hull AS (SELECT split, r, max(tp / nd) AS p FROM curve JOIN points ON floor(tp / n_gt * 100 + 1e-9) >= round(r * 100) GROUP BY split, r) SELECT split, round(sum(p) / 101, 6) AS ap FROM hull GROUP BY split""", *VIEWS, recursive=True))
def average_precision(spark, sf_dir):
    images, gt, _, m = base(spark, sf_dir)
    return C.average_precision(V.pr_curve(m, split_gt(images, gt), ["split"]), ["split"]).select("split", r6("ap"))


KEPT = """src AS (SELECT 0.5::DOUBLE AS t), ranked AS (SELECT d.*, split, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rnk, count(*) OVER (PARTITION BY image_id) AS in_image FROM detections d JOIN images USING (image_id)),
    incr AS (SELECT split, score, CASE v WHEN 'plain' THEN 1.0::DOUBLE WHEN 'top1' THEN (rnk <= 1)::INT::DOUBLE WHEN 'share' THEN 1.0::DOUBLE / in_image ELSE ln(1.0::DOUBLE + rnk) - ln(rnk::DOUBLE) END AS incr, v FROM ranked, (VALUES ('plain'), ('top1'), ('share'), ('log')) x(v)),
    size AS (SELECT split, count(*) AS n FROM images GROUP BY split), kappa AS (SELECT v, sum(CASE WHEN score >= t THEN incr ELSE 0 END) / any_value(n) AS kappa FROM incr JOIN size USING (split), src WHERE split = 'src_cal' GROUP BY v),
    steps AS (SELECT v, split, score, sum(incr) AS incr FROM incr WHERE split <> 'src_cal' GROUP BY ALL), run AS (SELECT v, split, score, sum(incr) OVER w AS cum, row_number() OVER (PARTITION BY v, split ORDER BY score DESC) AS i FROM steps WINDOW w AS (PARTITION BY v, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    near AS (SELECT *, kappa * n AS need, max(CASE WHEN i = 1 THEN cum END) OVER (PARTITION BY v, split) AS head FROM run JOIN kappa USING (v) JOIN size USING (split))"""


@query(with_views(f"{KEPT} SELECT v AS variant, split, round(need, 4) AS need, round(CASE WHEN need < head / 2 THEN 1.0 ELSE score END, 6) AS t FROM near QUALIFY row_number() OVER (PARTITION BY v, split ORDER BY abs(cum - need), i) = 1", *VIEWS))
def kept_rate_variants(spark, sf_dir):
    """Thresholds on unlabelled splits that keep as much per image as 0.5 does on the source."""
    images = S.images(spark, sf_dir)
    ranked = M.rank_in_image(S.detections(spark, sf_dir)).join(images, "image_id")
    rows = V.all_increments(ranked, ("plain", "top1", "share", "log"))
    size = images.groupBy("split").agg(F.count("*").alias("n"))
    kept = rows.where("split = 'src_cal'").groupBy("variant").agg(F.sum(F.when(F.col("score") >= 0.5, F.col("incr")).otherwise(0.0)).alias("kept"))
    kappa = kept.join(F.broadcast(size.where("split = 'src_cal'").select(F.col("n").alias("n_src"))))
    need = size.where("split <> 'src_cal'").join(F.broadcast(kappa)).select("variant", "split", (F.col("kept") / F.col("n_src") * F.col("n")).alias("need"))
    got = V.kept_rate(rows.where("split <> 'src_cal'"), need, ["variant", "split"])
    return got.select("variant", "split", F.round("need", 4).alias("need"), r6("t"))


@query(with_views("""share AS (SELECT avg((score < 0.5)::INT) AS q FROM detections JOIN images USING (image_id) WHERE split = 'src_cal'), o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, (count(*) OVER () - 1) * q AS spot FROM detections JOIN images USING (image_id), share WHERE split = 'tgt_cal')
    SELECT 'tgt_cal' AS split, round(max(CASE WHEN i = floor(spot) THEN score END) * (1 - any_value(spot - floor(spot))) + max(CASE WHEN i = ceil(spot) THEN score END) * any_value(spot - floor(spot)), 6) AS t FROM o""", *VIEWS))
def quantile_match(spark, sf_dir):
    rows = S.detections(spark, sf_dir).join(S.images(spark, sf_dir), "image_id")
    return T.quantile_match(rows.where("split = 'src_cal'"), rows.where("split = 'tgt_cal'"), 0.5).select(F.lit("tgt_cal").alias("split"), r6("t"))


@query(with_views("""u AS (SELECT score AS x, (split = 'src_cal')::INT AS a FROM detections JOIN images USING (image_id) WHERE split IN ('src_cal', 'tgt_cal')), b AS (SELECT x, sum(a) AS a, count(*) - sum(a) AS b FROM u GROUP BY x),
    s AS (SELECT x, abs(sum(a) OVER w / (SELECT sum(a) FROM b) - sum(b) OVER w / (SELECT sum(b) FROM b)) AS gap, lead(x) OVER (ORDER BY x) - x AS step FROM b WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)) SELECT round(sum(gap * step), 6) AS w1 FROM s""", *VIEWS))  # fmt: skip
def wasserstein(spark, sf_dir):
    rows = S.detections(spark, sf_dir).join(S.images(spark, sf_dir), "image_id")
    return T.wasserstein(rows.where("split = 'src_cal'"), rows.where("split = 'tgt_cal'")).select(r6("w1"))


@query(with_views(f"""{matched_sql(0.5)} SELECT split, is_tp::BIGINT AS is_tp, round(quantile_cont(score, 0.05), 4) AS p05, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95 FROM matched JOIN images USING (image_id) GROUP BY split, is_tp""", *VIEWS, recursive=True))
def score_quantiles(spark, sf_dir):
    m = base(spark, sf_dir)[3]
    return m.groupBy("split", n("is_tp")).agg(*[F.round(F.percentile("score", p), 4).alias(name) for p, name in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])


WEIGHT = " + ".join(f"(u >= {p}::DOUBLE)::INT" for p in I.POISSON)
BOOT = f"""unit AS (SELECT image_id, sum(is_tp) AS tp, count(*) AS nd FROM matched GROUP BY image_id),
    stat AS (SELECT i.image_id, coalesce(tp, 0) AS tp, coalesce(nd, 0) AS nd, coalesce(ng, 0) AS ng FROM images i LEFT JOIN unit USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS ng FROM gt_boxes GROUP BY image_id) USING (image_id) WHERE split = 'tgt_cal'),
    w AS (SELECT *, {WEIGHT} AS w FROM (SELECT stat.*, rep, ('0x' || substr(md5('boot|' || image_id || ':' || rep), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM stat, range(50) r(rep)))"""


def image_stats(images, gt, m, split="tgt_cal"):
    """Additive statistics of each image of a split: aggregated before any resampling."""
    unit = m.where(F.col("split") == split).groupBy("image_id").agg(F.sum("is_tp").alias("tp"), F.count("*").alias("nd"))
    boxes = gt.groupBy("image_id").agg(F.count("*").alias("ng"))
    return images.where(F.col("split") == split).select("image_id").join(unit, "image_id", "left").join(boxes, "image_id", "left").fillna(0, ["tp", "nd", "ng"])


@query(with_views(f"{matched_sql(0.5)}, {BOOT}, reps AS (SELECT rep, 2.0::DOUBLE * sum(w * tp) / sum(w * (nd + ng)) AS value FROM w GROUP BY rep) SELECT round(avg(value), 6) AS boot_mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS valid FROM reps", *VIEWS, recursive=True))
def bootstrap_ci(spark, sf_dir):
    images, gt, _, m = base(spark, sf_dir)
    units = image_stats(images, gt, m).select("image_id", (2.0 * F.col("tp")).alias("top"), (F.col("nd") + F.col("ng")).alias("bottom"))
    return I.interval(I.replicate_ratio(I.weights(units, "image_id", 50), "top", "bottom", []), []).select(r6("boot_mean"), r6("low"), r6("high"), "valid")


@query(with_views(f"""{matched_sql(0.5)}, {BOOT}, reps AS (SELECT rep, sum(w * tp) / sum(w * nd) - sum(w * tp) / sum(w * ng) AS d FROM w GROUP BY rep) SELECT round(avg(d), 6) AS boot_mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(2.0::DOUBLE * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1), 6) AS p FROM reps""", *VIEWS, recursive=True))
def paired_bootstrap(spark, sf_dir):
    """Precision less recall on shared replicates."""
    images, gt, _, m = base(spark, sf_dir)
    w = I.weights(image_stats(images, gt, m), "image_id", 50)
    reps = w.groupBy("rep").agg((F.try_divide(F.sum(F.col("w") * F.col("tp")), F.sum(F.col("w") * F.col("nd"))) - F.try_divide(F.sum(F.col("w") * F.col("tp")), F.sum(F.col("w") * F.col("ng")))).alias("diff"))
    return I.interval(reps, [], value="diff").join(I.two_sided_p(reps, [])).select(r6("boot_mean"), r6("low"), r6("high"), r6("p"))


@query(with_views(f"{matched_sql(0.5)}, {BOOT}, j AS (SELECT 2.0::DOUBLE * (sum(tp) OVER () - tp) / (sum(nd + ng) OVER () - nd - ng) AS value FROM stat) SELECT count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM j", *VIEWS, recursive=True))
def jackknife(spark, sf_dir):
    images, gt, _, m = base(spark, sf_dir)
    units = image_stats(images, gt, m).select("image_id", (2.0 * F.col("tp")).alias("top"), (F.col("nd") + F.col("ng")).alias("bottom"))
    return I.jackknife_ratio(units, "top", "bottom").agg(F.count("*").alias("n"), r6(F.min("value"), "low"), r6(F.max("value"), "high"), r6(F.avg("value"), "mean"))


@query()
def platt_map(spark, sf_dir):
    """Calibration error of the source map on each split, before and after."""
    m = base(spark, sf_dir)[3].select("split", "score", "is_tp", "iou")
    a, b = C.platt(m.where("split = 'src_cal'"))
    error = lambda rows, name: C.calibration_error(C.bins(rows, 10, ["split"], "is_tp"), ["split"]).select("split", r6("error", name))
    return error(m, "before").join(error(C.platt_map(m, a, b), "after"), "split")


@query()
def isotonic_map(spark, sf_dir):
    m = base(spark, sf_dir)[3].select("split", "score", "is_tp", "iou")
    knots = C.isotonic_knots(m.where("split = 'src_cal'"))
    error = lambda rows, name: C.calibration_error(C.bins(rows, 10, ["split"], "is_tp"), ["split"]).select("split", r6("error", name))
    return error(m, "before").join(error(C.piecewise_map(m, knots), "after"), "split")


@query()
def em_mixture(spark, sf_dir):
    """Share of true positives on the unlabelled split by EM over binned scores, and the threshold of the mixture."""
    m = base(spark, sf_dir)[3].select("split", "score", "is_tp")
    moments = {r["is_tp"]: (r["m"], r["v"]) for r in m.where("split = 'src_cal'").groupBy("is_tp").agg(F.avg("score").alias("m"), F.var_pop("score").alias("v")).collect()}
    tp, fp = T.Beta(*moments[1]), T.Beta(*moments[0])
    bins = [(r["x"], r["n"]) for r in T.binned(m.where("split = 'tgt_cal'")).orderBy("x").collect()]
    share, steps = T.em_share(bins, tp, fp)
    return spark.createDataFrame([(round(share, 6), steps, round(min(T.mixture_threshold(share, tp, fp), 1.0), 6))], "share double, steps int, t double")
