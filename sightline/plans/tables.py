"""Queries over hashes, documents and cells: duplicates, sets, roll-ups, decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions.columns import call_of, unsigned_hex
from sightline.operators import inference as I
from sightline.operators import matching as M
from sightline.operators import rollup as R
from sightline.plans.registry import n, query, r6
from sightline.sources import views as S
from sightline.sources.views import with_views


@query(with_views("g AS (SELECT hash, count(*) AS c FROM docs GROUP BY hash) SELECT count(*) FILTER (WHERE c > 1) AS groups, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS members, count(*) AS distinct_texts FROM g", "docs"))
def exact_dup_groups(spark, sf_dir):
    g = S.docs(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("c"))
    many = F.col("c") > 1
    return g.agg(F.sum(many.cast("long")).alias("groups"), F.sum(F.when(many, F.col("c")).otherwise(0)).alias("members"), F.count("*").alias("distinct_texts"))


@query(with_views("SELECT doc_id, camera FROM docs QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1", "docs"))
def dedup_keep_first(spark, sf_dir):
    """The first row of each hash: by a minimum, which combines before the shuffle, not by ranking whole groups."""
    first = S.docs(spark, sf_dir).groupBy("hash").agg(F.min(F.struct("doc_id", "camera")).alias("f"))
    return first.select("f.doc_id", "f.camera")


NEAR = "near AS (SELECT a.vec_id, b.hash AS near_hash, bit_count(xor(a.hash16, b.hash))::BIGINT AS distance FROM hashes a, (SELECT DISTINCT hash16 AS hash FROM hashes WHERE split = 'test') b WHERE a.split <> 'test' AND bit_count(xor(a.hash16, b.hash)) <= 4 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, near_hash) = 1)"


def near_test(spark, sf_dir):
    h = S.hashes(spark, sf_dir)
    return h, M.nearest_hash(h.where("split <> 'test'").select(F.col("vec_id").alias("id"), F.col("hash16").alias("hash")), h.where("split = 'test'").select(F.col("hash16").alias("hash")), 4, 16)


@query(with_views(f"{NEAR} SELECT vec_id, near_hash, distance FROM near", "hashes"))
def hamming_nn(spark, sf_dir):
    return near_test(spark, sf_dir)[1].select(F.col("id").alias("vec_id"), "near_hash", n("distance"))


@query(with_views(f"{NEAR} SELECT split, count(*) AS n, count(*) FILTER (WHERE distance <= 0) AS at_0, count(*) FILTER (WHERE distance <= 2) AS at_2, count(*) FILTER (WHERE distance <= 4) AS at_4 FROM hashes LEFT JOIN near USING (vec_id) WHERE split <> 'test' GROUP BY split", "hashes"))
def hamming_counts(spark, sf_dir):
    h, near = near_test(spark, sf_dir)
    d = F.col("distance")
    rows = h.where("split <> 'test'").join(near, F.col("vec_id") == F.col("id"), "left")
    return rows.groupBy("split").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(d <= k, F.lit(False)).cast("long")).alias(f"at_{k}") for k in (0, 2, 4)])


@query(with_views("SELECT vec_id, split FROM hashes h WHERE split <> 'test' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT hash16 AS hash FROM hashes WHERE split = 'test') t WHERE bit_count(xor(h.hash16, t.hash)) <= 1)", "hashes"))
def clean_set(spark, sf_dir):
    """Files with no file of the test split within one of 16 bits."""
    h = S.hashes(spark, sf_dir)
    near = M.nearest_hash(h.where("split <> 'test'").select(F.col("vec_id").alias("id"), F.col("hash16").alias("hash")), h.where("split = 'test'").select(F.col("hash16").alias("hash")), 1, 16)
    return h.where("split <> 'test'").join(near, F.col("vec_id") == F.col("id"), "left_anti").select("vec_id", "split")


@query(with_views("x AS (SELECT bit_count(xor(a.hash60, b.hash60)) AS d FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id) SELECT d::BIGINT AS distance, count(*) AS n FROM x GROUP BY d", "hashes"))
def hash_distances(spark, sf_dir):
    """Distances of all pairs: equal hashes count once with their number, and the rest meets block by block."""
    return M.pair_distances(S.hashes(spark, sf_dir).select(F.col("hash60").alias("hash")))


@query(with_views("g AS (SELECT hash, camera, count(*) AS c, count(DISTINCT lang) AS langs FROM docs GROUP BY hash, camera), k AS (SELECT *, CASE WHEN c = 1 THEN 'single' WHEN langs > 1 THEN 'mixed' ELSE 'copies' END AS kind FROM g) SELECT kind, count(*) AS groups, sum(c)::BIGINT AS n FROM k GROUP BY kind", "docs"))
def duplicate_cascade(spark, sf_dir):
    g = S.docs(spark, sf_dir).groupBy("hash", "camera").agg(F.count("*").alias("c"), F.countDistinct("lang").alias("langs"))
    return g.groupBy(F.when(F.col("c") == 1, "single").when(F.col("langs") > 1, "mixed").otherwise("copies").alias("kind")).agg(F.count("*").alias("groups"), F.sum("c").alias("n"))


@query(with_views("SELECT lang AS split, CASE WHEN positive THEN 'pos' WHEN labelled THEN 'neg' ELSE 'none' END AS class, count(*) AS n, sum(n_chars)::BIGINT AS size FROM docs GROUP BY ALL", "docs"))
def split_class_counts(spark, sf_dir):
    kind = F.when(F.col("positive"), "pos").when(F.col("labelled"), "neg").otherwise("none")
    return S.docs(spark, sf_dir).groupBy(F.col("lang").alias("split"), kind.alias("class")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query(with_views("t AS (SELECT camera FROM docs WHERE positive), v AS (SELECT camera FROM docs WHERE labelled AND NOT positive) SELECT (SELECT count(DISTINCT camera) FROM t) AS in_train, (SELECT count(DISTINCT camera) FROM v) AS in_val, (SELECT count(*) FROM (SELECT camera FROM t INTERSECT SELECT camera FROM v)) AS shared, (SELECT count(*) FROM (SELECT camera FROM t EXCEPT SELECT camera FROM v)) AS only_train, round((SELECT avg((camera IN (SELECT camera FROM t))::INT) FROM v), 6) AS share", "docs"))
def camera_overlap(spark, sf_dir):
    d = S.docs(spark, sf_dir)
    per = d.where("labelled").groupBy("camera").agg(F.sum(F.col("positive").cast("long")).alias("t"), F.sum((~F.col("positive")).cast("long")).alias("v"))
    has = lambda c: F.sum(c.cast("long"))
    t, v = F.col("t") > 0, F.col("v") > 0
    return per.agg(has(t).alias("in_train"), has(v).alias("in_val"), has(t & v).alias("shared"), has(t & ~v).alias("only_train"), r6(F.try_divide(F.sum(F.when(t, F.col("v")).otherwise(0)), F.sum("v")), "share"))


@query("SELECT doc_id, 'documents' AS pool FROM documents UNION ALL SELECT page_id + (SELECT max(doc_id) + 1 FROM documents), 'pages' FROM pages")
def pooled_ids(spark, sf_dir):
    """Two whole tables pooled; the ids of the second are shifted beyond those of the first."""
    d, p = S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "pages")
    beyond = d.agg((F.max("doc_id") + 1).alias("beyond"))
    return d.select("doc_id", F.lit("documents").alias("pool")).unionByName(p.join(F.broadcast(beyond)).select((F.col("page_id") + F.col("beyond")).alias("doc_id"), F.lit("pages").alias("pool")))


@query("SELECT e.event_id, regexp_extract(event_type, '^([a-z]+)', 1) AS kind, coalesce(json_extract_string(props, '$.page'), 'none') AS page FROM events e")
def parsed_names(spark, sf_dir):
    """Regular expressions on names and safe gets in JSON."""
    return S.table(spark, sf_dir, "events").select("event_id", F.regexp_extract("event_type", "^([a-z]+)", 1).alias("kind"), F.coalesce(F.get_json_object("props", "$.page"), F.lit("none")).alias("page"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substr(md5(text), 1, 16) AS head FROM documents")
def digests(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.lower(F.lpad(F.hex(unsigned_hex(F.substring(F.md5("text"), 1, 16))), 16, "0")).alias("head"))


GROUPS = "count(*) AS cells, round(avg(regret_b), 6) AS mean, round(quantile_cont(regret_b, 0.5), 6) AS median, round(max(regret_b), 6) AS worst, round(stddev_samp(regret_b), 6) AS sd, sum((regret_a - regret_b > 1e-12)::INT)::BIGINT AS wins, sum((regret_a - regret_b < -1e-12)::INT)::BIGINT AS losses, round(1 - avg(regret_b) / avg(regret_a), 6) AS closed_of_means, round(avg(1 - CASE WHEN regret_a <> 0 THEN regret_b / regret_a END), 6) AS mean_closed"


@query(with_views(f"SELECT family, model, target, {GROUPS} FROM cells GROUP BY GROUPING SETS ((), (family), (model), (target), (family, target))", "cells"))
def group_summary(spark, sf_dir):
    return R.group_summary(S.cells(spark, sf_dir)).select("family", "model", "target", "cells", r6("mean"), r6("median"), r6("worst"), r6("sd"), n("wins"), n("losses"), r6("closed_of_means"), r6("mean_closed"))


@query(with_views("w AS (SELECT family, model, target, any_value(regret_b) FILTER (WHERE seed = 0) AS s0, any_value(regret_b) FILTER (WHERE seed = 1) AS s1 FROM cells GROUP BY ALL) SELECT family, count(*) AS n, round(quantile_cont(abs(s0 - s1), 0.5), 6) AS median, round(max(abs(s0 - s1)), 6) AS worst FROM w GROUP BY family", "cells"))
def seed_pairs(spark, sf_dir):
    pairs = R.seed_pairs(S.cells(spark, sf_dir), ["family", "model", "target"], "regret_b")
    return pairs.groupBy("family").agg(F.count("*").alias("n"), r6(F.percentile("difference", 0.5), "median"), r6(F.max("difference"), "worst"))


@query(with_views("SELECT target, sum((regret_a - regret_b > 1e-12)::INT)::BIGINT AS wins, sum((regret_a - regret_b < -1e-12)::INT)::BIGINT AS losses, sum((abs(regret_a - regret_b) <= 1e-12)::INT)::BIGINT AS ties FROM cells GROUP BY target", "cells"))
def win_loss(spark, sf_dir):
    gain = F.col("regret_a") - F.col("regret_b")
    one = lambda c, name: F.sum(c.cast("long")).alias(name)
    return S.cells(spark, sf_dir).groupBy("target").agg(one(gain > R.TIE, "wins"), one(gain < -R.TIE, "losses"), one(F.abs(gain) <= R.TIE, "ties"))


@query(with_views("d AS (SELECT *, CASE WHEN target = 'A' AND seed = 0 THEN 'forward' WHEN target = 'R' AND seed = 1 THEN 'back' ELSE 'other' END AS direction FROM cells WHERE f1 >= 0.25) SELECT direction, count(*) AS n, round(avg(regret_a), 6) AS mean_a, round(avg(regret_b), 6) AS mean_b, round(1 - avg(regret_b) / avg(regret_a), 6) AS closed FROM d GROUP BY direction", "cells"))
def direction_summary(spark, sf_dir):
    """Cells above a floor, by direction."""
    direction = F.when((F.col("target") == "A") & (F.col("seed") == 0), "forward").when((F.col("target") == "R") & (F.col("seed") == 1), "back").otherwise("other")
    return S.cells(spark, sf_dir).where("f1 >= 0.25").groupBy(direction.alias("direction")).agg(F.count("*").alias("n"), r6(F.avg("regret_a"), "mean_a"), r6(F.avg("regret_b"), "mean_b"), r6(1 - F.avg("regret_b") / F.avg("regret_a"), "closed"))


@query(with_views("SELECT family, model, target, seed::BIGINT AS seed, round((regret_a - regret_b) / nullif(regret_a, 0), 6) AS fraction, round(f1 - regret_a - regret_b, 6) AS interaction FROM cells", "cells"))
def removal_fractions(spark, sf_dir):
    return S.cells(spark, sf_dir).select("family", "model", "target", n("seed"), r6(F.try_divide(F.col("regret_a") - F.col("regret_b"), F.col("regret_a")), "fraction"), r6(F.col("f1") - F.col("regret_a") - F.col("regret_b"), "interaction"))


@query(with_views("r AS (SELECT shift, (regret_b > 0.04)::INT AS y FROM cells) SELECT round(sum(CASE WHEN a.shift > b.shift THEN 1.0::DOUBLE WHEN a.shift = b.shift THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auc FROM r a, r b WHERE a.y = 1 AND b.y = 0", "cells"))
def auc(spark, sf_dir):
    return R.auc(S.cells(spark, sf_dir).select("shift", (F.col("regret_b") > 0.04).cast("int").alias("y")), "shift", "y").select(r6("auc"))


@query(with_views("r AS (SELECT rank() OVER (ORDER BY shift) + (count(*) OVER (PARTITION BY shift) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY regret_b) + (count(*) OVER (PARTITION BY regret_b) - 1) / 2.0::DOUBLE AS b FROM cells) SELECT round(corr(a, b), 6) AS rho FROM r", "cells"))
def spearman(spark, sf_dir):
    return R.spearman(S.cells(spark, sf_dir), "shift", "regret_b").select(r6("rho"))


@query(with_views("SELECT target, sum((shift > 0.5 AND regret_b > 0.04)::INT)::BIGINT AS tp, sum((shift > 0.5 AND NOT regret_b > 0.04)::INT)::BIGINT AS fp, sum((NOT shift > 0.5 AND regret_b > 0.04)::INT)::BIGINT AS fn, sum((NOT shift > 0.5 AND NOT regret_b > 0.04)::INT)::BIGINT AS tn FROM cells GROUP BY target", "cells"))
def confusion(spark, sf_dir):
    out = R.confusion(S.cells(spark, sf_dir), F.col("shift") > 0.5, F.col("regret_b") > 0.04, ["target"])
    return out.select("target", *[n(c) for c in ("tp", "fp", "fn", "tn")])


@query(with_views("""h AS (SELECT DISTINCT target FROM cells), c AS (SELECT DISTINCT shift FROM cells), y AS (SELECT target, shift, (regret_b > 0.04)::INT AS y FROM cells),
    s AS (SELECT h.target, c.shift AS cutoff, round((avg((y.shift >= c.shift)::INT) FILTER (WHERE y = 1) + 1 - avg((y.shift >= c.shift)::INT) FILTER (WHERE y = 0)) / 2, 9) AS balanced FROM h, c, y WHERE y.target <> h.target GROUP BY ALL)
    SELECT target, round(cutoff, 6) AS cutoff, round(balanced, 6) AS balanced FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY balanced DESC, cutoff) = 1""", "cells"))  # fmt: skip
def fitted_cutoff_loto(spark, sf_dir):
    """Leave-one-target-out decision rule."""
    rows = S.cells(spark, sf_dir).select("target", "shift", (F.col("regret_b") > 0.04).cast("int").alias("y"))
    return R.cutoffs(rows, "target", "shift", "y").select("target", r6("cutoff"), r6("balanced"))


@query(with_views("p AS (SELECT family, model, target, seed, regret_b / 2 AS p FROM cells WHERE family = (SELECT min(family) FROM cells)), o AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model, target, seed) + 1) AS s, row_number() OVER (ORDER BY p, model, target, seed) AS i FROM p) SELECT model, target, seed::BIGINT AS seed, round(least(max(s) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 1), 6) AS p_holm FROM o", "cells"))
def holm(spark, sf_dir):
    cells = S.cells(spark, sf_dir)
    rows = cells.join(F.broadcast(cells.agg(F.min("family").alias("family"))), "family").select("model", "target", "seed", (F.col("regret_b") / 2).alias("p"), F.concat_ws("|", "model", "target", "seed").alias("key"))
    return I.holm(rows, "p", "key").select("model", "target", n("seed"), r6("p_holm"))


@query(with_views("SELECT family, target, round(avg(regret_a), 6) AS mean, round(stddev_samp(regret_a), 6) AS sd, round(min(regret_a), 6) AS low, round(max(regret_a), 6) AS high, round(quantile_cont(regret_a, 0.5), 6) AS median, CASE WHEN avg(regret_a) - stddev_samp(regret_a) > 0.04 THEN 'gain' WHEN avg(regret_a) + stddev_samp(regret_a) < 0.04 THEN 'loss' ELSE 'ns' END AS call FROM cells GROUP BY family, target", "cells"))
def fold_spread(spark, sf_dir):
    a = F.avg("regret_a") - 0.04
    s = F.stddev_samp("regret_a")
    return S.cells(spark, sf_dir).groupBy("family", "target").agg(r6(F.avg("regret_a"), "mean"), r6(s, "sd"), r6(F.min("regret_a"), "low"), r6(F.max("regret_a"), "high"), r6(F.percentile("regret_a", 0.5), "median"), call_of(a - s, a + s).alias("call"))


@query(with_views("r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY shift DESC, family, model, seed) AS rnk FROM cells) SELECT target, rnk::BIGINT AS rnk, family, model, seed::BIGINT AS seed, round(shift, 6) AS shift FROM r WHERE rnk <= 5", "cells"))
def ranked_cells(spark, sf_dir):
    order = Window.partitionBy("target").orderBy(F.desc("shift"), "family", "model", "seed")
    return S.cells(spark, sf_dir).withColumn("rnk", F.row_number().over(order)).where("rnk <= 5").select("target", n("rnk"), "family", "model", n("seed"), r6("shift"))
