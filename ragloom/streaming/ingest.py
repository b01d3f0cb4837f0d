"""Structured Streaming jobs: incremental ingest and running meters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.functions.text import n_words, norm_ws
from ragloom.session import shared_dir


#: Keeps state on local disk of the executors and in the checkpoint, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id", least: int = 8, most: int = 200):
    """Append new texts to a table: normalised, of fitting length, and not there yet (first key of equal texts).

    The digests of stored texts are keyed state, so a micro-batch looks up the
    keys that it brings and never reads the table.  Rows are combined by text
    before they meet the state; a replayed batch finds the state of its start,
    and files of a batch that failed are not in the table's log.
    """
    rows = stream.withColumn("text", norm_ws(F.col("text"))).withColumn("_n", n_words(F.col("text")))
    rows = rows.where((F.col("_n") > least) & (F.col("_n") < most)).select(F.md5(F.lower("text")).alias("text_key"), F.col(key).cast("long").alias(key), "text")

    def first(text_key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if not state.exists and len(b):
                own = b.sort_values(key, kind="stable").iloc[[0]]
                best = own if best is None or own[key].iloc[0] < best[key].iloc[0] else best
        if best is not None:
            state.update((True,))
            yield best[["text_key", key, "text"]]

    new = rows.groupBy("text_key").applyInPandasWithState(first, f"text_key string, {key} long, text string", "there boolean", "append", GroupStateTimeout.NoTimeout)
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        return new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def meter(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Weighted mean of each meter by event-time window; rows later than the watermark are dropped."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("event_type").alias("meter"))
    return g.agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("n"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that a streaming frame gives for the input there is, as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")
