"""Streaming forms of gap sessions and of the smoothed alarm.

Watermarks and late-data rules are extensions: the batch forms have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.sources.sinks import append_missing


def sessions(frames: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Gap sessions per key: (key, begin, end of the last frame, n); rows later than ``late`` are dropped."""
    grouped = frames.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return grouped.select(key, F.col("w.start").alias("begin"), "end", "n")


def alarms(frames: DataFrame, half_life: float, threshold: float) -> DataFrame:
    """Causal moving average per sequence with its alarm flag; the state is one number a sequence."""
    keep = 0.5 ** (1 / half_life)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["offset_s", "event_id"])
        out = []
        for score in rows["score"]:
            value = score if value is None else keep * value + (1 - keep) * score
            out.append(value)
        state.update((float(value),))
        yield pd.DataFrame({"sequence_id": key[0], "event_id": rows["event_id"], "ema": out, "alarm": [v >= threshold for v in out]})

    return frames.groupBy("sequence_id").applyInPandasWithState(step, "sequence_id long, event_id long, ema double, alarm boolean", "value double", "append", GroupStateTimeout.NoTimeout)


def completed_cells(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A sink that writes each key once, however often it arrives."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_missing(batch.dropDuplicates(keys), path, keys) and None).option("checkpointLocation", checkpoint).start()
