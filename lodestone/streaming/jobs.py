"""Structured Streaming jobs: upkeep of a snapshot's state from a stream of files, windowed counts with a watermark, last values by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.stores import TableStore


def files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(path, content_hash, updated_at) of the files that come into a folder, so many a batch."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    return found.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("updated_at"))


def keep_hashes(stream: DataFrame, store: TableStore, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Upserts (path, content_hash, updated_at) into a store, batch by batch, until the source is read; on_change gets (path, change) of each batch.

    A batch that is repeated after a failure puts the same rows again, so the store ends up the same.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy("path").agg(F.max(F.struct("updated_at", "content_hash")).alias("l")).select(F.col("path").alias("key"), F.col("l.content_hash").alias("value"), F.col("l.updated_at").alias("updated_at"))
        if on_change:
            known = store.read().select("key", F.col("value").alias("old"))
            change = F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("value"), "modified")
            on_change(rows.join(known, "key", "left").select(F.col("key").alias("path"), change.alias("change")).where("change is not null"))
        store.put(rows)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n): events by tumbling windows; events later than the watermark allows are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def changed_hashes(observations: DataFrame) -> DataFrame:
    """(path, ts, content_hash, changed, old_hash) of a stream (path, ts, content_hash): the last hash of every path is kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "content_hash"])
        out = []
        for ts, h in zip(rows["ts"], rows["content_hash"]):
            out.append((key[0], ts, h, old is None or old != h, old))
            old = h
        state.update((old,))
        yield pd.DataFrame(out, columns=["path", "ts", "content_hash", "changed", "old_hash"])

    return observations.groupBy("path").applyInPandasWithState(step, "path string, ts timestamp, content_hash string, changed boolean, old_hash string", "hash string", "append", GroupStateTimeout.NoTimeout)
