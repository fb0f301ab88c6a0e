"""Event streams: windowed counts with watermarks, sessions, and a stateful gap fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, stamp: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a zoned stamp and a watermark; events later than ``late`` are dropped by windowed operators."""
    return events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)


def tumbling_counts(events: DataFrame, keys: list[str], size: str, slide: str | None = None, stamp: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum by key and window (sliding if ``slide`` is given); works on streams and tables alike."""
    window = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    counted = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, stamp: str = "ts") -> DataFrame:
    """Sessions of each key: windows that end once nothing came for ``gap``."""
    counted = events.groupBy(F.session_window(stamp, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_runs(events: DataFrame, key: str, value: str, stamp: str = "ts") -> DataFrame:
    """For each micro-batch and key: the value its events end on and the length of that run so far.

    State per key is the value and the run length; a batch's events are taken in the order of their
    stamps.  For streams with processing-time state only: nothing is ever timed out.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, length = state.get if state.exists else (None, 0)
        events = pd.concat(list(batches)).sort_values(stamp, kind="stable")
        for v in events[value]:
            length = length + 1 if v == last else 1
            last = v
        state.update((last, int(length)))
        yield pd.DataFrame({key: [group[0]], "last_value": [last], "run": [int(length)]})

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(follow, f"{key} {kinds[key]}, last_value {kinds[value]}, run long", f"last_value {kinds[value]}, run long", "update", GroupStateTimeout.NoTimeout)
