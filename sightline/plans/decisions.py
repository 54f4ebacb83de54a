"""Queries on names, sets, diagnostics of intervals, and choices of the best."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import matching as M
from sightline.plans.detection import IMAGES, VIEWS
from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.views import with_views

#: Names of class ids, and the canonical ids of names that are kept.
CLASSES = {1: "smoke", 2: "fire", 3: "haze", 4: "Smoke ", 5: "cloud"}
CANONICAL = {"smoke": 1, "fire": 2}


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


@query(f"""SELECT coalesce(name, 'cls' || l_linenumber) AS label, canonical::BIGINT AS canonical, count(*) AS n FROM lineitem
    LEFT JOIN {values(CLASSES.items())} c(id, name) ON l_linenumber = id LEFT JOIN {values(CANONICAL.items())} k(known, canonical) ON lower(trim(name)) = known GROUP BY ALL""")
def class_names(spark, sf_dir):
    """Class ids to names, an id without a name to a label of its own, names to canonical ids; unknown names have none."""
    names = F.broadcast(spark.createDataFrame(list(CLASSES.items()), "id int, name string"))
    known = F.broadcast(spark.createDataFrame(list(CANONICAL.items()), "known string, canonical long"))
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    named = rows.join(names, "id", "left").join(known, F.lower(F.trim("name")) == F.col("known"), "left")
    return named.groupBy(F.coalesce("name", F.concat(F.lit("cls"), F.col("id").cast("string"))).alias("label"), "canonical").agg(F.sum("n").alias("n"))


@query("SELECT CASE WHEN p_type LIKE 'STANDARD%' THEN 'std' WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE 'ECONOMY%' THEN 'eco' ELSE 'other' END AS dataset, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def dataset_of_tag(spark, sf_dir):
    """Tags to datasets by prefix."""
    starts = lambda x: F.col("p_type").startswith(x)
    dataset = F.when(starts("STANDARD"), "std").when(starts("PROMO"), "promo").when(starts("ECONOMY"), "eco").otherwise("other")
    return S.table(spark, sf_dir, "part").groupBy(dataset.alias("dataset")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query(with_views("SELECT family, model, target, seed::BIGINT AS seed, round(CASE WHEN contains(model, '1') THEN regret_a ELSE regret_b END, 6) AS score FROM cells", "cells"))
def score_by_run(spark, sf_dir):
    """The score column that a run's name asks for."""
    return S.cells(spark, sf_dir).select("family", "model", "target", n("seed"), r6(F.when(F.col("model").contains("1"), F.col("regret_a")).otherwise(F.col("regret_b")), "score"))


@query("SELECT split_part(c_name, '#', 2) AS sequence, c_nationkey::BIGINT AS camera, substr(o_orderdate::VARCHAR, 1, 7) AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def sequence_cameras(spark, sf_dir):
    """Parts of sequence names and date prefixes."""
    names = S.table(spark, sf_dir, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("sequence"), n("c_nationkey", "camera"))
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"))
    return orders.join(names, "c_custkey").groupBy("sequence", "camera", "month").agg(F.count("*").alias("n"))


@query(with_views("SELECT split, category_id::BIGINT AS category_id, count(*) AS n, count(*) FILTER (WHERE score >= coalesce(t, 'inf'::DOUBLE)) AS kept FROM detections JOIN images USING (image_id) LEFT JOIN (VALUES (1, 0.6::DOUBLE), (3, 0.2::DOUBLE)) c(id, t) ON category_id = id GROUP BY ALL", *VIEWS))
def class_cuts(spark, sf_dir):
    """Detections above the threshold of their class; a class without one keeps none."""
    cuts = F.broadcast(spark.createDataFrame([(1, 0.6), (3, 0.2)], "category_id int, t double"))
    rows = S.detections(spark, sf_dir).join(S.images(spark, sf_dir).select("image_id", "split"), "image_id").join(cuts, "category_id", "left")
    kept = F.col("score") >= F.coalesce("t", F.lit(float("inf")))
    return rows.groupBy("split", n("category_id")).agg(F.count("*").alias("n"), F.sum(kept.cast("long")).alias("kept"))


@query(with_views("SELECT lang, count(*) FILTER (WHERE hash IS NULL) AS errors, count(hash) AS n, count(DISTINCT hash) AS different FROM docs GROUP BY lang", "docs"))
def hash_index(spark, sf_dir):
    """Rows of the hash index, without those that have no hash."""
    return S.docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.col("hash").isNull().cast("long")).alias("errors"), F.count("hash").alias("n"), F.countDistinct("hash").alias("different"))


@query(with_views("SELECT doc_id, min(doc_id) OVER (PARTITION BY hash) AS first_id, max(doc_id) OVER (PARTITION BY hash) AS last_id FROM docs WHERE hash IS NOT NULL", "docs"))
def representatives(spark, sf_dir):
    """The first and the last file of each hash, for every file of it."""
    docs = S.docs(spark, sf_dir).where("hash IS NOT NULL").select("doc_id", "hash")
    ends = docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return docs.join(ends, "hash").select("doc_id", "first_id", "last_id")


@query(with_views("r AS (SELECT DISTINCT hash AS h, min(doc_id) OVER (PARTITION BY hash) AS first_id FROM docs WHERE hash IS NOT NULL) SELECT first_id, doc_id AS other_id, camera FROM docs JOIN r ON hash = h WHERE doc_id > first_id ORDER BY first_id, other_id LIMIT 8", "docs"))
def sample_pairs(spark, sf_dir):
    """The first eight pairs of equal files, to look at."""
    docs = S.docs(spark, sf_dir).where("hash IS NOT NULL")
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "hash").where("doc_id > first_id").select("first_id", F.col("doc_id").alias("other_id"), "camera").orderBy("first_id", "other_id").limit(8)


@query("WITH t(target) AS (VALUES ('src'), ('near'), ('far')), r AS (SELECT DISTINCT p_brand FROM part) SELECT lower(p_brand) || '__to__' || target AS cell, p_brand AS run, target FROM r, t")
def run_targets(spark, sf_dir):
    """Every run with every target set of the configuration: two small lists."""
    targets = spark.createDataFrame([("src",), ("near",), ("far",)], "target string")
    runs = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("run")).distinct()
    return runs.join(F.broadcast(targets)).select(F.concat_ws("__to__", F.lower("run"), "target").alias("cell"), "run", "target")


@query(with_views("p AS (SELECT doc_id, camera FROM docs WHERE positive), l AS (SELECT doc_id, camera FROM docs WHERE labelled), c AS (SELECT camera FROM docs WHERE NOT labelled) SELECT (SELECT count(*) FROM (FROM p EXCEPT ALL FROM l)) = 0 AS ids_in, (SELECT count(*) FROM (FROM l EXCEPT ALL FROM p)) AS more, (SELECT count(*) FROM (SELECT DISTINCT camera FROM l EXCEPT SELECT camera FROM c)) AS cameras_apart", "docs"))
def containment(spark, sf_dir):
    """Whether one set of files lies within another, and how many are only in the other."""
    docs = S.docs(spark, sf_dir)
    p, held = docs.where("positive").select("doc_id", "camera"), docs.where("labelled").select("doc_id", "camera")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    apart = held.select("camera").distinct().exceptAll(docs.where("NOT labelled").select("camera").distinct())
    sizes = count(p.exceptAll(held), "out").join(F.broadcast(count(held.exceptAll(p), "more"))).join(F.broadcast(count(apart, "cameras_apart")))
    return sizes.select((F.col("out") == 0).alias("ids_in"), "more", "cameras_apart")


LEAKY = "test AS (SELECT DISTINCT hash16 AS hash FROM hashes WHERE split = 'test'), leaky AS (SELECT vec_id FROM hashes WHERE split <> 'test' AND EXISTS (SELECT 1 FROM test WHERE bit_count(xor(hash16, hash)) <= 1)), copies AS (SELECT vec_id, row_number() OVER (PARTITION BY split, hash16 ORDER BY vec_id) > 1 AS dup FROM hashes)"


def leaky(spark, sf_dir):
    h = S.hashes(spark, sf_dir)
    near = M.nearest_hash(h.where("split <> 'test'").select(F.col("vec_id").alias("id"), F.col("hash16").alias("hash")), h.where("split = 'test'").select(F.col("hash16").alias("hash")), 1, 16)
    return h, near.select(F.col("id").alias("vec_id"))


@query(with_views(f"{LEAKY} SELECT vec_id FROM leaky", "hashes"))
def leaky_ids(spark, sf_dir):
    """All files less the clean ones."""
    h, near = leaky(spark, sf_dir)
    every = h.where("split <> 'test'").select("vec_id")
    return every.exceptAll(every.join(near, "vec_id", "left_anti"))


@query(with_views(f"{LEAKY} SELECT split, count(*) AS original, count(*) FILTER (WHERE vec_id IN (FROM leaky)) AS dropped_near, count(*) FILTER (WHERE dup AND vec_id NOT IN (FROM leaky)) AS dropped_dup, count(*) FILTER (WHERE NOT dup AND vec_id NOT IN (FROM leaky)) AS kept FROM hashes JOIN copies USING (vec_id) GROUP BY split", "hashes"))
def split_accounting(spark, sf_dir):
    """What becomes of each split's files: dropped as near the test split, dropped as copies, kept."""
    h, near = leaky(spark, sf_dir)
    first = h.groupBy("split", "hash16").agg(F.min("vec_id").alias("first"))
    rows = h.join(first, ["split", "hash16"]).join(near.withColumn("near", F.lit(True)), "vec_id", "left").select("split", F.coalesce("near", F.lit(False)).alias("near"), (F.col("vec_id") > F.col("first")).alias("dup"))
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return rows.groupBy("split").agg(F.count("*").alias("original"), total(F.col("near"), "dropped_near"), total(F.col("dup") & ~F.col("near"), "dropped_dup"), total(~F.col("dup") & ~F.col("near"), "kept"))


@query(with_views("d AS (SELECT target, regret_a - regret_b AS d FROM cells) SELECT target, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(min(d), 6) AS low, round(max(d), 6) AS high, count(*) FILTER (WHERE d < 0) AS wins, count(*) FILTER (WHERE d > 0) AS losses FROM d GROUP BY target", "cells"))
def component_summary(spark, sf_dir):
    d = S.cells(spark, sf_dir).select("target", (F.col("regret_a") - F.col("regret_b")).alias("d"))
    return d.groupBy("target").agg(F.count("*").alias("n"), r6(F.avg("d"), "mean"), r6(F.median("d"), "median"), r6(F.min("d"), "low"), r6(F.max("d"), "high"), F.sum((F.col("d") < 0).cast("long")).alias("wins"), F.sum((F.col("d") > 0).cast("long")).alias("losses"))


@query(with_views("SELECT target, round(avg(abs(regret_a - regret_b)), 6) AS mae, round(avg(regret_a - regret_b), 6) AS signed, round(median(regret_a / nullif(regret_b, 0)), 6) AS ratio FROM cells GROUP BY target", "cells"))
def estimator_bias(spark, sf_dir):
    """Mean absolute and signed error of an estimate, and the median of its ratio."""
    e = F.col("regret_a") - F.col("regret_b")
    return S.cells(spark, sf_dir).groupBy("target").agg(r6(F.avg(F.abs(e)), "mae"), r6(F.avg(e), "signed"), r6(F.median(F.try_divide("regret_a", "regret_b")), "ratio"))


INTERVALS = "iv AS (SELECT family, target, min(regret_a - regret_b) AS low, max(regret_a - regret_b) AS high, median(regret_a - regret_b) AS mid, avg(regret_a - regret_b) AS point FROM cells WHERE seed = 0 GROUP BY family, target)"


def intervals(spark, sf_dir):
    d = F.col("regret_a") - F.col("regret_b")
    return S.cells(spark, sf_dir).where("seed = 0").groupBy("family", "target").agg(F.min(d).alias("low"), F.max(d).alias("high"), F.median(d).alias("mid"), F.avg(d).alias("point"))


@query(with_views(f"{INTERVALS} SELECT target, count(*) AS n, count(*) FILTER (WHERE low <= 0 AND high >= 0) AS crosses, count(*) FILTER (WHERE mid < low + (high - low) / 4 OR mid > high - (high - low) / 4) AS excludes, round(avg(high - low), 6) AS width, round(avg(mid - point), 6) AS moved FROM iv GROUP BY target", "cells"))
def interval_diagnostics(spark, sf_dir):
    """How many intervals cross zero or leave a point out, their widths, and how far their middles are moved."""
    width, quarter = F.col("high") - F.col("low"), (F.col("high") - F.col("low")) / 4
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    out = (F.col("mid") < F.col("low") + quarter) | (F.col("mid") > F.col("high") - quarter)
    return intervals(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), total((F.col("low") <= 0) & (F.col("high") >= 0), "crosses"), total(out, "excludes"), r6(F.avg(width), "width"), r6(F.avg(F.col("mid") - F.col("point")), "moved"))


@query(with_views("SELECT seed::BIGINT AS state, round(avg(shift), 6) AS mean, round(min(shift), 6) AS low, round(max(shift), 6) AS high FROM cells GROUP BY seed", "cells"))
def movement_by_state(spark, sf_dir):
    return S.cells(spark, sf_dir).groupBy(n("seed", "state")).agg(r6(F.avg("shift"), "mean"), r6(F.min("shift"), "low"), r6(F.max("shift"), "high"))


@query(with_views("v AS (SELECT family, target, min(regret_a - regret_b) AS low, max(regret_a - regret_b) AS high, count(*) FILTER (WHERE regret_a < regret_b) AS wins, count(*) FILTER (WHERE regret_a > regret_b) AS losses FROM cells GROUP BY family, target) SELECT family, target, wins, losses, (low > 0 OR high < 0) AND wins > 2 * losses AS better FROM v", "cells"))
def verdicts(spark, sf_dir):
    """A method is better if its interval leaves zero out and it wins more than twice as often as it loses."""
    d = F.col("regret_a") - F.col("regret_b")
    v = S.cells(spark, sf_dir).groupBy("family", "target").agg(F.min(d).alias("low"), F.max(d).alias("high"), F.sum((d < 0).cast("long")).alias("wins"), F.sum((d > 0).cast("long")).alias("losses"))
    return v.select("family", "target", "wins", "losses", (((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("wins") > 2 * F.col("losses"))).alias("better"))


@query(with_views("s AS (SELECT image_id, string_agg(score::VARCHAR, ',' ORDER BY score DESC) AS scores, count(*) AS n FROM detections WHERE category_id = 1 GROUP BY image_id), e AS (SELECT image_id, max(score) AS best FROM detections WHERE image_id NOT IN (SELECT image_id FROM gt_boxes) GROUP BY image_id) SELECT image_id, coalesce(n, 0) AS n, coalesce(best, -1.0)::DOUBLE AS unannotated_best FROM images LEFT JOIN s USING (image_id) LEFT JOIN e USING (image_id) WHERE split = 'src_cal'", "gt_boxes", *VIEWS))
def source_views(spark, sf_dir):
    """Of every source image: how many scores of one class it has, and the best score if it has no box."""
    det, gt = S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir).select("image_id").distinct().withColumn("held", F.lit(True))
    per = det.groupBy("image_id").agg(F.sum((F.col("category_id") == 1).cast("long")).alias("n"), F.max("score").alias("best"))
    rows = S.images(spark, sf_dir).where("split = 'src_cal'").select("image_id").join(per, "image_id", "left").join(gt, "image_id", "left")
    return rows.select("image_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.when(F.col("held").isNull(), F.col("best")), F.lit(-1.0)).alias("unannotated_best"))


@query(with_views("r AS (SELECT image_id, category_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS i FROM detections), h AS (SELECT image_id, bool_or(category_id = 1 AND i > 3) AS hides FROM r GROUP BY image_id), g AS (SELECT DISTINCT image_id AS held FROM gt_boxes) SELECT split, count(*) AS frames, count(*) FILTER (WHERE hides) AS hidden, count(*) FILTER (WHERE held IS NULL) AS negatives, count(*) FILTER (WHERE held IS NULL) * 0.01 < 10 AS few FROM images LEFT JOIN h USING (image_id) LEFT JOIN g ON image_id = held GROUP BY split", "gt_boxes", *VIEWS))
def truncated_views(spark, sf_dir):
    """Frames whose best three hide a detection of the class, and splits with too few negatives for a rate of 0.01."""
    ranked = M.rank_in_image(S.detections(spark, sf_dir)).groupBy("image_id").agg(F.bool_or((F.col("category_id") == 1) & (F.col("rnk") > 3)).alias("hides"))
    held = S.gt_boxes(spark, sf_dir).select("image_id").distinct().withColumn("held", F.lit(True))
    rows = S.images(spark, sf_dir).join(ranked, "image_id", "left").join(held, "image_id", "left")
    negatives = F.sum(F.col("held").isNull().cast("long"))
    return rows.groupBy("split").agg(F.count("*").alias("frames"), F.sum(F.coalesce("hides", F.lit(False)).cast("long")).alias("hidden"), negatives.alias("negatives"), (negatives * 0.01 < 10).alias("few"))


@query(with_views("SELECT target, count(*) AS n, count(*) FILTER (WHERE round(regret_a - regret_b, 3) = 0) AS zeros, round(1.0::DOUBLE / count(*), 6) AS resolution FROM cells GROUP BY target", "cells"))
def zero_replicates(spark, sf_dir):
    """Differences that are zero, and the least share that so many can tell."""
    return S.cells(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), F.sum((F.round(F.col("regret_a") - F.col("regret_b"), 3) == 0).cast("long")).alias("zeros"), r6(F.lit(1.0) / F.count("*"), "resolution"))


BEST = "SELECT {keys}, model, round({value}, 6) AS value FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


def best_of(rows, keys, *order):
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("i = 1")


@query(with_views(BEST.format(keys="target", value="v", rows="SELECT target, model, round(avg(regret_a), 4) AS v, sum(n) AS k FROM cells GROUP BY ALL", order="v, k DESC, model"), "cells"))
def best_variant(spark, sf_dir):
    """Of each target the variant of least regret; of equal ones that with the most behind it."""
    rows = S.cells(spark, sf_dir).groupBy("target", "model").agg(F.round(F.avg("regret_a"), 4).alias("v"), F.sum("n").alias("k"))
    return best_of(rows, ["target"], "v", F.desc("k"), "model").select("target", "model", r6("v", "value"))


@query(with_views(BEST.format(keys="family, target", value="regret_a", rows="SELECT * FROM cells WHERE shift <= 0.5 AND seed = 0", order="regret_a, regret_b, model"), "cells"))
def best_statistic(spark, sf_dir):
    """The best of those whose guarantee holds, for each family and target."""
    rows = S.cells(spark, sf_dir).where("shift <= 0.5 AND seed = 0")
    return best_of(rows, ["family", "target"], "regret_a", "regret_b", "model").select("family", "target", "model", r6("regret_a", "value"))


@query(with_views(BEST.format(keys="family", value="f1", rows="SELECT * FROM cells WHERE target = 'A' AND seed = 1", order="f1 DESC, model"), "cells"))
def best_epoch(spark, sf_dir):
    """The row of greatest score of each run; of equal ones the first."""
    rows = S.cells(spark, sf_dir).where("target = 'A' AND seed = 1")
    return best_of(rows, ["family"], F.desc("f1"), "model").select("family", "model", r6("f1", "value"))


@query(with_views("m AS (SELECT vec_id, hash16 % 7 AS fold, split, hash60 FROM hashes), a AS (SELECT 'split' AS kind, split AS of, avg(bit_count(hash60)) AS d FROM m GROUP BY split), b AS (SELECT 'fold', fold::VARCHAR, avg(bit_count(hash60)) FROM m GROUP BY fold) SELECT kind, of, round(d, 6) AS d FROM a UNION ALL SELECT * FROM (SELECT 'fold', fold::VARCHAR, round(avg(bit_count(hash60)), 6) FROM m GROUP BY fold)", "hashes"))
def null_distribution(spark, sf_dir):
    """Values by split and by fold in one table."""
    h = S.hashes(spark, sf_dir).select("split", (F.col("hash16") % 7).cast("string").alias("fold"), F.bit_count("hash60").alias("c"))
    part = lambda kind, key: h.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("of")).agg(r6(F.avg("c"), "d"))
    return part("split", "split").unionByName(part("fold", "fold"))


@query(with_views(f"{IMAGES} SELECT split, camera::BIGINT AS camera, round(avg((max_score >= 0.5)::INT) FILTER (WHERE is_pos), 6) AS sensitivity, round(avg((max_score >= 0.5)::INT) FILTER (WHERE NOT is_pos), 6) AS far, count(*) FILTER (WHERE is_pos) AS n_pos FROM im GROUP BY split, camera", "gt_boxes", *VIEWS))
def alarm_scatter(spark, sf_dir):
    """Sensitivity and false-alarm rate of each split and camera at the source's threshold."""
    im, alarm = M.image_max(S.images(spark, sf_dir), S.detections(spark, sf_dir), S.gt_boxes(spark, sf_dir)), (F.col("max_score") >= 0.5).cast("int")
    return im.groupBy("split", n("camera")).agg(r6(F.avg(F.when(F.col("is_pos"), alarm)), "sensitivity"), r6(F.avg(F.when(~F.col("is_pos"), alarm)), "far"), F.sum(F.col("is_pos").cast("long")).alias("n_pos"))


@query(with_views("w AS (SELECT family, " + ", ".join(f"round(avg(regret_a) FILTER (WHERE target = '{t}'), 6) AS on_{t.lower()}" for t in "ANR") + ", count(*) AS n FROM cells GROUP BY family) SELECT *, row_number() OVER (ORDER BY n DESC, family) AS place FROM w", "cells"))
def matrix_summary(spark, sf_dir):
    """A row for each family, a column for each target, and the place in the report's order."""
    wide = S.cells(spark, sf_dir).groupBy("family").agg(*[r6(F.avg(F.when(F.col("target") == t, F.col("regret_a"))), f"on_{t.lower()}") for t in "ANR"], F.count("*").alias("n"))
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "family")).cast("long"))  # one row for each family


@query(with_views("SELECT event_id, sequence_id, round(last_value(CASE WHEN score >= 0.4 THEN score END IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS held FROM frames", "frames"))
def carried_forward(spark, sf_dir):
    """The last supported value of a sequence, carried on."""
    order = Window.partitionBy("sequence_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return S.frames(spark, sf_dir).select("event_id", "sequence_id", r6(F.last(F.when(F.col("score") >= 0.4, F.col("score")), ignorenulls=True).over(order), "held"))


@query(with_views("b AS (SELECT split, least(greatest(floor((ln(s / (1 - s)) + 6) / 12 * 20), 0), 19)::BIGINT AS bin, count(*) AS n FROM (SELECT split, least(greatest(score, 1e-6), 1 - 1e-6) AS s FROM detections JOIN images USING (image_id)) GROUP BY ALL), t AS (SELECT split, sum(n) AS total FROM b GROUP BY split), g AS (SELECT split, k AS bin, total FROM t, range(20) r(k)) SELECT split, bin, coalesce(n, 0) AS n, round((coalesce(n, 0) + 0.5) / (total + 10), 6) AS density, round(sum((coalesce(n, 0) + 0.5) / (total + 10)) OVER (PARTITION BY split ORDER BY bin ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM g LEFT JOIN b USING (split, bin)", *VIEWS))
def histogram_component(spark, sf_dir):
    """Densities over twenty bins even in log odds, each with half a count added."""
    s = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    place = F.least(F.greatest(F.floor((F.ln(s / (1 - s)) + 6) / 12 * 20), F.lit(0)), F.lit(19))
    counts = S.detections(spark, sf_dir).join(S.images(spark, sf_dir), "image_id").groupBy("split", n(place, "bin")).agg(F.count("*").alias("n"))
    grid = counts.groupBy("split").agg(F.sum("n").alias("total")).select("split", "total", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")).alias("bin"))
    rows = grid.join(counts, ["split", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("density", (F.col("n") + 0.5) / (F.col("total") + 10))
    run = Window.partitionBy("split").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("split", "bin", "n", r6("density"), r6(F.sum("density").over(run), "cumulative"))
