"""Small hand-made cases: ties, empty sides, bin edges, closed forms, sources and sinks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import columns as K
from sightline.functions import special
from sightline.operators import calibration, curves, inference, matching, rollup, temporal, transfer
from sightline.sources import readers, sinks

BOX = "image_id long, category_id int, x double, y double, w double, h double"


def boxes(spark, rows, key, extra=""):
    return spark.createDataFrame(rows, f"{key} long, {BOX}{extra}")


def test_match_ties_and_steals(spark):
    gt = boxes(spark, [(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 1, 0.0, 0.0, 10.0, 10.0), (3, 2, 1, 0.0, 0.0, 10.0, 10.0)], "ann_id")
    det = boxes(spark, [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (3, 1, 1, 0.0, 0.0, 10.0, 9.0, 0.8), (4, 2, 1, 8.0, 8.0, 10.0, 10.0, 0.9), (5, 2, 1, 0.0, 0.0, 10.0, 6.0, 0.1), (6, 3, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], "det_id", ", score double")
    got = {r.det_id: r.ann_id for r in matching.matched(det, gt).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None, 5: 3, 6: None}


def test_match_equals_a_sequential_walk(spark):
    draw = random.Random(0)
    g = [(i, draw.randrange(30), draw.randrange(1, 3), draw.uniform(0, 30), draw.uniform(0, 30), 30.0, 30.0) for i in range(150)]
    d = [(i, draw.randrange(30), draw.randrange(1, 3), draw.uniform(0, 30), draw.uniform(0, 30), 30.0, 30.0, round(draw.random(), 1)) for i in range(200)]

    def over(a, b):
        w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (3, 4))
        return w * h / (1800 - w * h)

    want, used = {}, set()
    for x in sorted(d, key=lambda x: (-x[7], x[0])):
        best = max((y for y in g if y[1:3] == x[1:3] and y[0] not in used), key=lambda y: (over(x, y), -y[0]), default=None)
        want[x[0]] = best[0] if best and over(x, best) >= 0.5 else None
        used.add(want[x[0]])
    got = matching.matched(boxes(spark, d, "det_id", ", score double"), boxes(spark, g, "ann_id"))
    assert {r.det_id: r.ann_id for r in got.collect()} == want


def test_bins_at_edges(spark):
    scores = [0.0, 0.04, 0.28, 0.56, 1.0, 0.040001, 0.2800001]
    got = [r.b for r in spark.createDataFrame([(s,) for s in scores], "s double").select(K.bin_of(F.col("s"), 25).alias("b")).collect()]
    assert got == [1, 1, 7, 14, 25, 2, 8]


def test_perfect_class_is_undefined(spark):
    rows = [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.5, 1.0)]
    got = {r.category_id: r.laece for r in calibration.laece(spark.createDataFrame(rows, "category_id int, score double, iou double")).collect()}
    assert got == {1: None, 2: 0.5}


def test_curve_joins_ties(spark):
    m = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.5, 1)], "k string, score double, is_tp int")
    n_gt = spark.createDataFrame([("a", 4)], "k string, n_gt long")
    got = [(r.score, r.tp, r.nd) for r in curves.pr_curve(m, n_gt, ["k"]).orderBy(F.desc("score")).collect()]
    assert got == [(0.9, 1, 1), (0.5, 3, 4)]
    assert curves.f1_optimum(curves.pr_curve(m, n_gt, ["k"]), ["k"]).first().score == 0.5


@pytest.mark.parametrize("need,t", [(0.4, 1.0), (1.4, 0.9), (1.6, 0.5), (9.0, 0.1)])
def test_kept_rate(spark, need, t):
    rows = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.5, 1.0), ("a", 0.1, 1.0)], "k string, score double, incr double")
    assert curves.kept_rate(rows, spark.createDataFrame([("a", need)], "k string, need double"), ["k"]).first().t == t
    assert curves.kept_rate(rows.limit(0), spark.createDataFrame([("a", need)], "k string, need double"), ["k"]).first().t == 1.0


def test_sessions_keep_the_boundary(spark):
    times = [0, 599, 1199, 1800, 2401]  # gaps 599, 600, 601, 601
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "event_id long, camera int, t long")
    assert [r.session for r in temporal.sessions(rows, "camera", 600).orderBy("t").collect()] == [1, 1, 1, 2, 3]


def test_smoothing(spark):
    xs = [0.2, 0.8, 0.4, 1.0, 0.0]
    rows = spark.createDataFrame([(i, 1, 1, i, x, True) for i, x in enumerate(xs)], "event_id long, sequence_id long, camera int, offset_s long, score double, visible boolean")
    value, want = None, []
    for x in xs:
        value = x if value is None else 0.5**0.5 * value + (1 - 0.5**0.5) * x
        want.append(value)
    assert [r.ema for r in temporal.ema(rows, 2.0).orderBy("event_id").collect()] == pytest.approx(want)
    assert [r.stat for r in temporal.k_of_n(rows, 2, 5).orderBy("event_id").collect()] == [0.0, 0.2, 0.4, 0.8, 0.8]
    missed = temporal.delays(rows, 2.0).first()
    assert missed.delay_min is None and missed.n_pre == 0 and temporal.delay_summary(temporal.delays(rows, 2.0)).first().far is None


def test_conformal_rank_is_floored(spark):
    rows = spark.createDataFrame([("a", x) for x in (0.3, 0.1, 0.2)], "k string, v double")
    assert temporal.conformal_threshold(rows, "v", 0.05, ["k"]).first().t == 0.1
    assert temporal.conformal_threshold(rows, "v", 0.5, ["k"]).first().t == 0.2
    assert temporal.folds([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == [[1, 4], [2, 3]]


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.p_holm, 9) for r in inference.holm(rows, "p", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_wasserstein(spark):
    frame = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "score double")
    w = lambda a, b: transfer.wasserstein(frame(a), frame(b)).first().w1
    assert w([1, 2, 2], [1, 2, 2]) == 0 and w([0, 1], [0.5, 1.5]) == 0.5 and w([0, 0], [3]) == 3 and w([1, 2, 2], [5, 9]) == w([5, 9], [1, 2, 2])


def test_hamming(spark):
    values = [0, -1, -(2**63), 1, 3, 2**62]
    a = spark.createDataFrame(list(enumerate(values)), "id long, hash long")
    got = {r.id: (r.near_hash, r.distance) for r in matching.nearest_hash(a, a.select("hash"), 2).collect()}
    assert got == {i: (v, 0) for i, v in enumerate(values)}
    b = spark.createDataFrame([(7,)], "hash long")
    assert {r.id: r.distance for r in matching.nearest_hash(a, b, 2).collect()} == {3: 2, 4: 1}


def test_rank_statistics(spark):
    rows = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, y int")
    assert rollup.auc(rows, "s", "y").first().auc == 0.875
    assert rollup.spearman(rows, "s", "s").first().rho == pytest.approx(1)


def test_special_functions():
    assert special.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    low, high = special.clopper_pearson(3, 20)
    assert low == pytest.approx(0.03207, abs=1e-4) and high == pytest.approx(0.37893, abs=1e-4)
    assert special.clopper_pearson(0, 10)[0] == 0 and special.student_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert special.bca_levels(0.5, [1.0, 2.0, 3.0]) == pytest.approx((0.025, 0.975))


def test_maps(spark):
    draw = random.Random(1)
    rows = [(s, int(draw.random() < s * s), None) for s in (draw.random() for _ in range(3000))]
    m = spark.createDataFrame(rows, "score double, is_tp int, iou double")
    error = lambda df: calibration.calibration_error(calibration.bins(df.withColumn("k", F.lit(1)), 10, ["k"], "is_tp"), ["k"]).first().error
    before = error(m)
    assert error(calibration.platt_map(m, *calibration.platt(m))) < before / 2
    knots = calibration.isotonic_knots(m)
    assert [y for _, y in knots] == sorted(y for _, y in knots) and error(calibration.piecewise_map(m, knots)) < before / 3


def test_sources_and_sinks(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "area": 12.0, "iscrowd": 0}], "categories": [{"id": 2, "name": "smoke"}]}
    (tmp_path / "gt.json").write_text(json.dumps(doc, indent=1))
    images, ann, cats = readers.coco(spark, str(tmp_path / "gt.json"))
    assert ann.first().w == 3 and cats.first().name == "smoke"
    assert json.loads(sinks.coco_documents(images, ann).first().document)["annotations"][0]["bbox"] == [1, 2, 3, 4]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.txt").write_text("0 0.5 0.5 0.5 0.5\nbad line\n")
    assert [tuple(r)[1:] for r in readers.yolo_labels(spark, str(tmp_path / "l"), 100, 200).collect()] == [(0, 25.0, 50.0, 50.0, 100.0)]
    (tmp_path / "d.yaml").write_text("nc: 2\nnames: ['fire', \"smoke\"]\n")
    assert [(r[0], r[1]) for r in readers.yaml_names(spark, str(tmp_path / "d.yaml")).collect()] == [(0, "fire"), (1, "smoke")]
    (tmp_path / "b.csv").write_text("MinX,MinY,MaxX,MaxY,Filename\n1,2,4,8,s/x.jpg\n")
    assert tuple(readers.csv_boxes(spark, str(tmp_path / "b.csv")).first()) == ("s", "x.jpg", 1, 2, 3, 6)
    names = spark.createDataFrame([("/q/seq1/1500_+60.jpg",), ("/q/seq1/x.jpg",), ("/q/seq1/1440_-0.jpg",)], "path string")
    assert [tuple(r) for r in readers.frame_listing(names).orderBy("unix").collect()] == [("seq1", 1440, 0), ("seq1", 1500, 60)]
    assert readers.binary_files(spark, str(tmp_path), "*.csv").first().length > 10
    out = str(tmp_path / "cells")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.append_missing(rows, out, ["k"]).count() >= 0 and spark.read.parquet(out).count() == 2
    sinks.append_missing(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), out, ["k"])
    assert spark.read.parquet(out).count() == 3
    assert sinks.markdown(rows).splitlines()[2] == "| 1 | a |"


def test_drained_rows_stay_in_the_shared_folder(spark, tmp_path):
    from sightline.plans.streams import drained

    for k in range(3):
        spark.createDataFrame([(k, k), (9, k)], "a int, b int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows, sums = drained(spark, stream, "append"), drained(spark, stream.groupBy("a").agg(F.sum("b").alias("s")), "complete")
    assert sorted(map(tuple, rows.collect())) == [(0, 0), (1, 1), (2, 2), (9, 0), (9, 1), (9, 2)]
    assert sorted(map(tuple, sums.collect())) == [(0, 0), (1, 1), (2, 2), (9, 3)]
    assert rows.inputFiles() and sums.inputFiles()  # not a table in the driver's memory
    (tmp_path / "none").mkdir()
    assert drained(spark, spark.readStream.schema("a int, b int").parquet(str(tmp_path / "none")), "append").collect() == []


def test_pair_distances_of_many_blocks(spark):
    draw = random.Random(3)
    values = [draw.getrandbits(64) - (1 << 63) for _ in range(60)] + [5] * 4 + [-1] * 3
    want = {}
    for i, x in enumerate(values):
        for y in values[:i]:
            d = ((x ^ y) & ((1 << 64) - 1)).bit_count()
            want[d] = want.get(d, 0) + 1
    rows = spark.createDataFrame([(v,) for v in values], "hash long")
    for block, spread in ((1000, 1), (7, 2)):
        assert {r.distance: r.n for r in matching.pair_distances(rows, block, spread).collect()} == want
    assert matching.pair_distances(rows.limit(1)).collect() == matching.pair_distances(rows.limit(0)).collect() == []
    plan = matching.pair_distances(rows)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # few bytes, but not one task


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_nearest_narrow_hash_meets_no_pairs(spark, radius):
    draw = random.Random(radius)
    a, b = [draw.getrandbits(10) for _ in range(200)], [draw.getrandbits(10) for _ in range(8)]
    near = {i: min(((x ^ y).bit_count(), y) for y in b) for i, x in enumerate(a)}
    want = {i: d for i, d in near.items() if d[0] <= radius}
    rows, others = spark.createDataFrame(list(enumerate(a)), "id long, hash long"), spark.createDataFrame([(x,) for x in b], "hash long")
    for width in (10, 60):
        got = matching.nearest_hash(rows, others, radius, width)
        assert {r.id: (r.distance, r.near_hash) for r in got.collect()} == want
        if width == 10:
            assert "piece" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_tables_by_image_meet_without_a_shuffle(spark):
    from sightline.plans.detection import base, image_stats

    images, gt, det, m = base(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (det.join(images, "image_id"), matching.matched(det, gt), matching.image_max(images, det, gt), image_stats(images, gt, m), matching.rank_in_image(det)):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jackknife_gathers_no_units(spark):
    units = spark.range(5).select(F.col("id").alias("top"), (F.col("id") + 1).alias("bottom"))
    got = inference.jackknife_ratio(units, "top", "bottom")
    assert got.columns == ["top", "bottom", "value"] and {r.top: r.value for r in got.collect()} == {k: (10 - k) / (15 - k - 1) for k in range(5)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_nth_values_of_equal_scores_sort_no_rows(spark):
    rows = spark.createDataFrame([("a", s, k) for k, s in enumerate([0.5, 0.5, 0.5, 0.2, 0.9])] + [("b", 0.1, 9)], "k string, s double, id int")
    got = curves.places(rows, "s", F.desc("s"), ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", 0.9, 1, 1), ("a", 0.5, 2, 4), ("a", 0.2, 5, 5), ("b", 0.1, 1, 1)}
    for n, want in ((1, {"a": 0.2, "b": 0.1}), (2, {"a": 0.5}), (4, {"a": 0.5}), (5, {"a": 0.9}), (6, {}), (0, {})):
        low = curves.nth_lowest(rows, "s", F.lit(n), ["k"])
        assert {r.k: r.t for r in low.collect()} == want
    assert "row_number" not in low._jdf.queryExecution().optimizedPlan().toString()
    match = transfer.quantile_match(rows.where("k = 'a'"), rows.where("k = 'a'"), 0.9, "s")
    assert match.first().t == pytest.approx(0.5 * 0.8 + 0.9 * 0.2) and "row_number" not in match._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_go_to_the_detections(spark):
    m = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 0), ("a", 0.1, 1)], "k string, score double, is_tp int")
    n_gt = spark.createDataFrame([("a", 4), ("b", 2)], "k string, n_gt long")
    cuts = spark.createDataFrame([("a", 0.5), ("a", 0.95), ("b", 0.5)], "k string, t double")
    got = curves.at_threshold(m, n_gt, cuts, ["k"])
    assert {(r.k, r.t): (r.tp, r.nd, r.f1) for r in got.collect()} == {("a", 0.5): (1, 2, 2 / 6), ("a", 0.95): (0, 0, 0.0), ("b", 0.5): (0, 0, 0.0)}
    best = curves.f1_optimum(curves.pr_curve(m, n_gt, ["k"]), ["k"])
    assert best.columns == curves.pr_curve(m, n_gt, ["k"]).columns and [(r.k, r.score, r.tp, r.nd) for r in best.collect()] == [("a", 0.1, 2, 3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [k" in plan and "row_number" not in best._jdf.queryExecution().optimizedPlan().toString()
