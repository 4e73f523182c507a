"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(events: DataFrame, key: str, time: str, id_col: str, limit: int = 20, window: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """Sliding-window admission per key over a stream; state is the admitted times of the window, at most `limit`, and expires with it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([time, id_col])
        verdict = []
        for t in rows[time].astype("int64") / 1e3 if str(rows[time].dtype) == "datetime64[us]" else rows[time].astype("datetime64[us]").astype("int64"):
            kept = [x for x in kept if t - x <= window * 1e6]
            verdict.append(len(kept) < limit)
            if verdict[-1]:
                kept.append(int(t))
        state.update((kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((kept[-1] if kept else 0) / 1e3 + window * 1e3)))
        yield pd.DataFrame({key: k[0], id_col: rows[id_col].to_numpy(), "admitted": verdict})

    out = f"{key} {events.schema[key].dataType.simpleString()}, {id_col} {events.schema[id_col].dataType.simpleString()}, admitted boolean"
    return events.withWatermark(time, lateness).groupBy(key).applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; late events beyond the watermark are dropped by Spark."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def resumed(log: DataFrame, since: int) -> DataFrame:
    """The events of a log from a sequence number on; the checkpoint of the query that writes it is the place to resume."""
    return log.where(F.col("seq") >= since)


def merged_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Keeps a table of the latest row for each key up to date, a batch at a time; a batch that is replayed changes nothing.

    A batch goes into a folder of its own, and the state is the latest row over all folders (see `latest`).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark, path: str, keys: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("_batch", order)).alias("row")).select(*keys, "row.*").drop("_batch", "batch")
