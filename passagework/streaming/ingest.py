"""Ingest and sessions as Structured Streaming; a checkpoint is the job's state."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scratch import kept

if TYPE_CHECKING:
    from ..api import KnowledgeBase


def first_seen(docs: DataFrame, namespace: str = "namespace", content: str = "content") -> DataFrame:
    """The first of equal contents in a namespace, whenever they come; on a stream the hashes are the state."""
    return docs.withColumn("content_hash", X.content_hash(F.col(content))).dropDuplicates([namespace, "content_hash"])


def sessions(calls: DataFrame, client: str = "client", ts: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after more than `idle` without a call; a session is given out once the watermark has passed it."""
    return calls.withWatermark(ts, late).groupBy(client, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")


def _append(df: DataFrame, path: str, batch: int) -> None:
    """Idempotent by batch: a repeated batch overwrites its own folder only."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest_stream(base: KnowledgeBase, incoming: DataFrame, checkpoint: str, now_ms: int, name: str = "stream"):
    """New documents go into a knowledge base batch by batch, as its own ingest writes them: one commit a batch, in all tables. Stops when nothing is left.

    incoming: namespace, uri, content and what else an ingest takes. A batch that is repeated after a failure finds its commit and adds
    nothing; equal contents of one batch and address are one, later ones are decided against what is there.
    """

    def step(batch: DataFrame, n: int) -> None:
        op = f"{name} {n}"
        if any(e.op == op for e in base.log.entries()):
            return
        with base.committing(op):
            base.ingest(batch, now_ms, actor=name, channel="worker")

    return incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_stream(base: KnowledgeBase, ticks: DataFrame, checkpoint: str, clock, worker: str = "worker", most: int = 1000):
    """Jobs are drained whenever the stream ticks (any rows). A batch that is repeated after a failure finds its commit and does nothing; what a killed one had claimed is free after its lease.

    clock: a function without arguments that gives milliseconds.
    """

    def step(batch: DataFrame, n: int) -> None:
        op = f"{worker} {n}"
        if not any(e.op == op for e in base.log.entries()):
            now_ms = clock()
            mine = kept(base.claim(worker, now_ms, most), "claimed")
            with base.committing(op):
                base._settled(mine, worker, now_ms)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill_stream(spark: SparkSession, passages: DataFrame, warehouse: str, checkpoint: str, model_id: str, embed, text: Column):
    """Vectors of a model for passages that lack one; repeated runs add nothing."""

    def step(batch: DataFrame, n: int) -> None:
        path = f"{warehouse}/vectors-{model_id}"
        todo = batch
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            have = spark.read.parquet(path).select("id")
            todo = batch.join(have, "id", "left_anti")
        _append(todo.select("id", F.lit(model_id).alias("model_id"), embed(text).alias("embedding")), path, n)

    return passages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
