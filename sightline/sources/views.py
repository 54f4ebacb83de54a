"""Views over the star-schema tables that stand for images, boxes, detections, frames, hashes and cells.

All randomness is keyed by MD5, so any engine builds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.columns import bits, uniform
from sightline.sources.shared import written_once

#: A first positive event must follow the first event by at least this many seconds.
RUN_IN = 864_000
#: Bytes of lineitem files for each bucket of images: about 220,000 lines, which a task sorts in memory.
BUCKET_BYTES = 4 << 20

_BUCKETS: dict[tuple, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts) -> F.Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def by_image(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], *key) -> DataFrame:
    """A table of this application in buckets of images; ``make`` must give a column image_id."""
    return written_once(spark, (name, sf_dir, *key), make, "image_id", buckets(spark, sf_dir))


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """How many buckets of images: one for each core, as far as shuffles have them, and more for large inputs; fixed once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUCKETS:
        size = int(str(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        _BUCKETS[key] = max(min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-size // BUCKET_BYTES))
    return _BUCKETS[key]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_image(spark, sf_dir, "images", lambda: _images(spark, sf_dir))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uniform("split", "o_orderkey")
    split = F.when(u < 0.25, "src_cal").when(u < 0.5, "tgt_cal").otherwise("tgt_test")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(buckets(spark, sf_dir), "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 24).alias("camera"), split.alias("split"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all lines with a unique key, as (order, line number) is not one; the only shuffle of lineitem."""
    return by_image(spark, sf_dir, "lines", lambda: _lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: c.cast("double")
    raw = table(spark, sf_dir, "lineitem").repartition(buckets(spark, sf_dir), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return raw.withColumn("line_id", F.col("l_orderkey") * 100 + F.row_number().over(order)).select(
        "line_id",
        F.col("l_orderkey").alias("image_id"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("category_id"),
        d(F.col("l_partkey") % 400).alias("x"),
        d(F.col("l_suppkey") % 300).alias("y"),
        (40 + 2 * F.col("l_quantity")).alias("w"),
        d(40 + 10 * F.col("l_linenumber")).alias("h"),
        F.col("l_linestatus").alias("status"),
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("status = 'F'").select(F.col("line_id").alias("ann_id"), "image_id", "category_id", "x", "y", "w", "h")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_image(spark, sf_dir, "detections", lambda: _detections(spark, sf_dir))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jittered boxes of most ground truth, and background boxes; scores are squared off the source split."""
    u = lambda salt: uniform(salt, "line_id")
    hit, background = F.col("status") == "F", F.col("status") == "O"
    either = lambda a, b: F.when(hit, a).otherwise(b)
    rows = lines(spark, sf_dir).where((hit & (u("hit") < 0.8)) | (background & (u("bg") < 0.6))).select(
        F.col("line_id").alias("det_id"), "image_id", "category_id",
        either(F.col("x") + 16 * (u("dx") - 0.5), 500 * u("bx")).alias("x"), either(F.col("y") + 16 * (u("dy") - 0.5), 380 * u("by")).alias("y"),
        either(F.col("w") * (0.85 + 0.3 * u("dw")), F.lit(60.0)).alias("w"), either(F.col("h") * (0.85 + 0.3 * u("dh")), F.lit(60.0)).alias("h"),
        either(1 - 0.5 * u("q") * u("q"), 0.3 + 0.5 * u("bs")).alias("score"),
    )
    split = images(spark, sf_dir).select("image_id", "split")
    score = F.when(F.col("split") == "src_cal", F.col("score")).otherwise(F.col("score") * F.col("score"))
    return rows.join(split, "image_id").withColumn("score", F.round(score, 6)).drop("split")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users with an onset: offsets in seconds from the first error after the run-in."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("t"))
    begin = events.groupBy("user_id").agg(F.min("t").alias("t0"))
    onset = events.join(begin, "user_id").where(f"event_type = 'error' AND t - t0 >= {RUN_IN}").groupBy("user_id").agg(F.min("t").alias("onset"))
    offset = F.col("t") - F.col("onset")
    return events.join(onset, "user_id").select("event_id", F.col("user_id").alias("sequence_id"), (F.col("user_id") % 24).alias("camera"), "t", offset.alias("offset_s"), (offset >= 0).alias("visible"), F.round(0.6 * uniform("f", "event_id") + F.when(offset >= 0, 0.35).otherwise(0.0), 6).alias("score"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("label") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", bits(F.col("embedding"), 16).alias("hash16"), bits(F.col("embedding"), 60).alias("hash60"), split.alias("split"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("camera"), "lang", "n_chars", F.md5("text").alias("hash"), (F.coalesce("quality", F.lit(0)) == 1).alias("positive"), F.col("quality").isNotNull().alias("labelled"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of lines with average metrics: regrets of two methods, a shift and a seed."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    grouped = joined.groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("model"), F.col("l_returnflag").alias("target"), (F.col("l_linenumber") % 2).alias("seed"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("regret_a"), F.round(F.avg("l_tax"), 9).alias("regret_b"), F.round(F.avg("l_quantity") / 50, 9).alias("shift"), F.round(F.avg("l_extendedprice") / 100000, 9).alias("f1"))


def _u(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: The same views as DuckDB common table expressions.
SQL = {
    "images": f"""SELECT o_orderkey AS image_id, o_custkey % 24 AS camera, CASE WHEN {_u('split', 'o_orderkey')} < 0.25 THEN 'src_cal' WHEN {_u('split', 'o_orderkey')} < 0.5 THEN 'tgt_cal' ELSE 'tgt_test' END AS split FROM orders""",
    "lines": """SELECT *, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_id FROM lineitem""",
    "gt_boxes": """SELECT line_id AS ann_id, l_orderkey AS image_id, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS category_id, (l_partkey % 400)::DOUBLE AS x, (l_suppkey % 300)::DOUBLE AS y, 40 + 2 * l_quantity AS w, (40 + 10 * l_linenumber)::DOUBLE AS h FROM lines WHERE l_linestatus = 'F'""",
    "detections": f"""SELECT det_id, image_id, category_id, x, y, w, h, round(CASE WHEN split = 'src_cal' THEN score ELSE score * score END, 6) AS score FROM (
      SELECT ann_id AS det_id, image_id, category_id, x + 16 * ({_u('dx', 'ann_id')} - 0.5::DOUBLE) AS x, y + 16 * ({_u('dy', 'ann_id')} - 0.5::DOUBLE) AS y, w * (0.85::DOUBLE + 0.3::DOUBLE * {_u('dw', 'ann_id')}) AS w, h * (0.85::DOUBLE + 0.3::DOUBLE * {_u('dh', 'ann_id')}) AS h, 1 - 0.5::DOUBLE * {_u('q', 'ann_id')} * {_u('q', 'ann_id')} AS score
      FROM gt_boxes WHERE {_u('hit', 'ann_id')} < 0.8
      UNION ALL SELECT line_id, l_orderkey, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 2 END, 500 * {_u('bx', 'line_id')}, 380 * {_u('by', 'line_id')}, 60.0::DOUBLE, 60.0::DOUBLE, 0.3::DOUBLE + 0.5::DOUBLE * {_u('bs', 'line_id')} FROM lines WHERE l_linestatus = 'O' AND {_u('bg', 'line_id')} < 0.6) JOIN images USING (image_id)""",
    "frames": f"""SELECT event_id, e.user_id AS sequence_id, e.user_id % 24 AS camera, t, t - onset AS offset_s, t >= onset AS visible, round(0.6::DOUBLE * {_u('f', 'event_id')} + CASE WHEN t >= onset THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score
      FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events) e JOIN (SELECT user_id, min(t) AS onset FROM (SELECT user_id, event_type, floor(epoch(ts))::BIGINT AS t, min(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE event_type = 'error' AND t - t0 >= {RUN_IN} GROUP BY user_id) o ON e.user_id = o.user_id""",
    "hashes": """SELECT vec_id, list_reduce(list_prepend(0::BIGINT, [(x > 0)::BIGINT FOR x IN embedding[1:16]]), lambda a, x: a * 2 + x) AS hash16, list_reduce(list_prepend(0::BIGINT, [(x > 0)::BIGINT FOR x IN embedding[1:60]]), lambda a, x: a * 2 + x) AS hash60, ['train', 'val', 'test'][label % 3 + 1] AS split FROM embeddings""",
    "docs": """SELECT doc_id, source AS camera, lang, n_chars, md5(text) AS hash, coalesce(quality, 0) = 1 AS positive, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)""",
    "cells": """SELECT p_type AS family, p_brand AS model, l_returnflag AS target, l_linenumber % 2 AS seed, count(*) AS n, round(avg(l_discount), 9) AS regret_a, round(avg(l_tax), 9) AS regret_b, round(avg(l_quantity) / 50, 9) AS shift, round(avg(l_extendedprice) / 100000, 9) AS f1 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
}
NEEDS = {"gt_boxes": ["lines"], "detections": ["images", "lines", "gt_boxes"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql``, which may begin with further CTEs ("name AS (...), ... SELECT"), after the named views."""
    order: list[str] = []
    for n in names:
        for m in (*NEEDS.get(n, []), n):
            if m not in order:
                order.append(m)
    order.sort(key=list(SQL).index)
    heads = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order]
    body = sql.strip()
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(heads) + ("\n" if body.upper().startswith("SELECT") else ",\n") + body
