"""Sinks: tables, annotation documents, Markdown, resumable outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, overwriting only the partitions that ``df`` has."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def coco_documents(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, document): one JSON document an image, so that no task holds a whole data set."""
    held = boxes.groupBy("image_id").agg(F.collect_list(F.struct("ann_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"))).alias("annotations"))
    joined = images.join(held, "image_id", "left")
    return joined.select("image_id", F.to_json(F.struct(*[c for c in images.columns], F.coalesce("annotations", F.array()).alias("annotations"))).alias("document"))


def append_missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys are not there yet, and return them."""
    spark = df.sparkSession
    known = None
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        known = spark.read.parquet(path).select(*keys).distinct()
    new = df if known is None else df.join(known, keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
