"""Streaming forms of batch operators: an extension, since the batch engine is what parity asks for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """A stream of Parquet event files; ts is cast to a timestamp with zone, as watermarks ask for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def new_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files as they arrive: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def gap_sessions(stream: DataFrame, seconds: float, late: str = "1 hour") -> DataFrame:
    """(user_id, session, n, first_ts, last_ts) of sessions as they close, in order of arrival within a batch.

    State per user: the session's number, count, first and last time. A session closes when an event
    comes more than `seconds` after its last one, or when the watermark passes that point.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = pd.Timedelta(seconds=seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, first, last = state.get if state.exists else (0, 0, None, None)
        out = []
        if state.hasTimedOut:
            yield pd.DataFrame({"user_id": [key[0]], "session": [number], "n": [n], "first_ts": [first], "last_ts": [last]})
            state.remove()
            return
        for ts in pd.concat([b["ts"] for b in batches]).sort_values():
            if n and ts - last > gap:
                out.append((key[0], number, n, first, last))
                number, n, first = number + 1, 0, None
            n, first, last = n + 1, first if first is not None else ts, ts
        state.update((number, n, first, last))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "session", "n", "first_ts", "last_ts"])

    row = "user_id long, session long, n long, first_ts timestamp, last_ts timestamp"
    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, row, "session long, n long, first_ts timestamp, last_ts timestamp", "append", GroupStateTimeout.EventTimeTimeout)
