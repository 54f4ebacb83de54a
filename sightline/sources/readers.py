"""Sources of detector data: annotation documents, label lines, CSV boxes, run records, frame listings.

Schemas are explicit. Readers return flat DataFrames; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.columns import centre_to_corner, corners_to_box

COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string>>"
DETECTION = "image_id bigint, category_id int, bbox array<double>, score double"


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of one-document JSON files."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    boxes = doc.select(F.explode("annotations").alias("a")).select(F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", *[F.col("a.bbox")[k].alias(c) for k, c in enumerate("xywh")], "a.area", "a.iscrowd")
    return images, boxes, doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), "c.name")


def detections_json(spark: SparkSession, path: str) -> DataFrame:
    """Detection arrays in JSON files, with the file they come from."""
    rows = spark.read.schema(DETECTION).option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), "image_id", "category_id", *[F.col("bbox")[k].alias(c) for k, c in enumerate("xywh")], "score")


def yolo_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Label files of lines ``class cx cy w h``: (file, class, x, y, w, h); lines of other length are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.split("value", "\n")).alias("line"))
    parts = raw.select("file", F.split(F.trim("line"), r"\s+").alias("p")).where("size(p) = 5")
    d = lambda k: F.col("p")[k].try_cast("double")
    return parts.select("file", F.col("p")[0].try_cast("int").alias("class"), *centre_to_corner(d(1), d(2), d(3), d(4), F.lit(width), F.lit(height)))


def yaml_names(spark: SparkSession, path: str) -> DataFrame:
    """(index, name) of the list ``names: [...]`` in a YAML file."""
    names = F.split(F.regexp_extract("value", r"names:\s*\[([^\]]*)\]", 1), ",")
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.transform(names, lambda x: F.trim(F.regexp_replace(x, "['\"]", "")))).alias("index", "name"))


def csv_boxes(spark: SparkSession, path: str) -> DataFrame:
    """CSV of MinX, MinY, MaxX, MaxY, Filename: boxes by (sequence, file)."""
    rows = spark.read.option("header", True).schema("MinX double, MinY double, MaxX double, MaxY double, Filename string").csv(path)
    name = F.split("Filename", "/")
    return rows.select(F.when(F.size(name) > 1, F.get(name, F.size(name) - 2)).alias("sequence"), F.element_at(name, -1).alias("file"), *corners_to_box(F.col("MinX"), F.col("MinY"), F.col("MaxX"), F.col("MaxY")))


def frame_listing(files: DataFrame) -> DataFrame:
    """Names ``<unix>_<signed offset>.jpg`` in a column path: (sequence, unix, offset_s), others left out."""
    pattern = r"([^/]+)/(\d+)_([+-]\d+)\.jpg$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    return files.where(F.col("path").rlike(pattern)).select(part(1).alias("sequence"), part(2).cast("long").alias("unix"), part(3).cast("long").alias("offset_s"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, md5, sha256) of files, digested where they are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def cells_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a cell; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("cell", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch results with padded headers stripped; the best epoch is the first of greatest mAP50-95."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(F.col("epoch").cast("int").alias("epoch"), *[F.col(f"`{c}`").try_cast("double").alias(c.split("/")[-1]) for c in rows.columns if c.startswith("metrics/")])


def split_of_path(column: str = "path") -> F.Column:
    """train, val or test from a file name's prefix."""
    return F.regexp_extract(column, r"([a-z]+)-[^/]*\.parquet$", 1)
