"""Numbers that come with running plans equal a recount; gauges are read once in their time."""

import time

from pyspark.sql import functions as F

from passagework.api import KnowledgeBase
from passagework.functions import vectors as V
from passagework.observed import Gauges, Metrics, StreamMetrics

KIND = "namespace string, uri string, content string, title string"


def test_an_ingest_counts_what_it_embeds(spark, tmp_path):
    good = V.embedder(V.hash_encoder(64))
    base = KnowledgeBase(spark, f"file://{tmp_path}/base", model_id="m", embed=lambda text: F.when(~F.contains(text, F.lit("bad")), good(text)))
    base.ingest(spark.createDataFrame([("n", f"u{i}", f"# D{i}\n\n{'bad' if i % 3 == 0 else 'fine'} text {i}", f"D{i}") for i in range(7)], KIND), 1000)
    rows = base.table("vectors")
    labels = (("model", "m"), ("role", "document"))
    assert base.metrics.counters["embed_texts", labels] == rows.count() == 7
    assert base.metrics.counters["embed_failed", labels] == rows.where("embedding is null").count() == 3
    assert sum(base.metrics.latencies["embed_ms", labels][:-1]) == 1
    lines = [r.line for r in base.metrics.lines(spark).collect()]
    assert 'embed_texts{model="m",role="document"} 7' in lines and any(x.startswith("embed_ms_bucket") and 'le="+Inf"' in x for x in lines)
    read, own = [], base.status
    base.status = lambda: read.append(1) or own()
    first = sorted(r.line for r in base.gauges(10_000).collect())
    assert sorted(r.line for r in base.gauges(12_000).collect()) == first and len(read) == 1
    base.gauges(16_000)
    assert len(read) == 2


def test_a_stream_counts_its_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    metrics = Metrics()
    listener = StreamMetrics(metrics)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen = rows.observe("seen", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))
        seen.writeStream.queryName("numbers").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if metrics.counters["streams_ended", ()]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(f"{tmp_path}/out").agg(F.count(F.lit(1)), F.sum("id")).first()
    by = (("stream", "numbers"),)
    assert (metrics.counters["seen_rows", by], metrics.counters["seen_ids", by]) == tuple(out) == (30, 435)


def test_gauges_are_kept_for_their_time():
    read = []
    gauges = Gauges(lambda: read.append(1) or [len(read)], 100)
    assert [gauges.rows(t) for t in (0, 99, 100, 150, 90)] == [[1], [1], [2], [2], [3]]
