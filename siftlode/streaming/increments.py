"""Incremental work as streams: files that arrive are read once and put into a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlode.plans.runtime import cut
from siftlode.sources.store import Store


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read in one batch, once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_stream(stream: DataFrame, store: Store, table: str, key: list[str], order: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keep a table in step with a stream of records: the last row of a key by ``order`` holds.

    Runs over all that is there and ends. A batch that is repeated after a failure writes the same rows again,
    so the table is right whether or not its first try got through. A row older than the stored one does not
    replace it. Only the key buckets that a batch touches are read and rewritten.
    """

    def put(batch: DataFrame, _: int) -> None:
        b = change(batch) if change else batch
        rest = [c for c in b.columns if c not in key]
        last = b.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("m")).select(*key, "m.*")
        store.upsert(table, cut(last), key, newest=order)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of events per window of time, for a frame or a stream.

    ``late``: how long a stream waits for late rows; a batch needs none.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
