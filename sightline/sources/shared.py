"""Tables that several queries of a session read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sightline-')}")
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def written_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], by: str, buckets: int) -> DataFrame:
    """What ``make`` gives, as a table of this application; inputs must not change while it runs.

    Rows lie in buckets by the hash of a column, so tables with equal ``by`` and ``buckets`` are joined and grouped
    by it without a shuffle. The catalog only names the files: they are in the shared folder.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        name = f"{key[1]}_{uuid.uuid4().hex}"
        make().write.bucketBy(buckets, by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        _WRITTEN[key] = f"`{spark.catalog.currentDatabase()}`.`{name}`"
    return spark.table(_WRITTEN[key])
