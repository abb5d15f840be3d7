"""Structured Streaming over an append-only folder of event files: windows, first-seen dedup, sessions, resume.

Late rows beyond the watermark are dropped by the engine; state is bounded by the watermark. Checkpoints make a
stopped run resume where it was, which replaces append ledgers and periodic flushes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """Count and sum per user over all batches, as custom state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def append_new(events: DataFrame, path: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None):
    """Append each batch to a Parquet folder (`all`), and a filtered copy to `kept`; run until the input is used up."""

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        batch.write.mode("append").parquet(f"{path}/all")
        if keep:
            keep(batch).write.mode("append").parquet(f"{path}/kept")
        batch.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result: each batch overwrites a folder of its own beside the checkpoint,
    so a repeated batch counts once and nothing comes to the driver. In complete mode the last batch is the result.
    """
    path, done = f"{checkpoint}-{name}", []

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{i}")
        done.append(f"{path}/{i}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark, parts = stream.sparkSession, done[-1:] if mode == "complete" else done
    return spark.read.schema(stream.schema).parquet(*parts) if parts else spark.createDataFrame([], stream.schema)
