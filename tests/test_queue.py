"""The embedding queue: failures, killed workers, rival claims and repeated batches end with each passage embedded once."""

from pyspark.sql import functions as F

from passagework.api import KnowledgeBase
from passagework.functions import vectors as V
from passagework.operators import lsh, queue, resolve
from passagework.storage import CommitLog
from passagework.streaming import ingest

KIND = "namespace string, uri string, content string, title string"


def base_with(spark, path, n):
    plain = KnowledgeBase(spark, path, embed=None)
    plain.ingest(spark.createDataFrame([("n", f"u{i}", f"# D{i}\n\nWord{i} of text {i}.", f"D{i}") for i in range(n)], KIND), 1000)
    return plain


def test_every_third_fails_and_a_batch_is_killed(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    base_with(spark, path, 9)
    good = V.embedder(V.hash_encoder(64))
    bad = lambda text: F.when(F.pmod(F.regexp_extract(text, r"text (\d+)", 1).cast("int"), F.lit(3)) != 0, good(text))
    flaky, sound = KnowledgeBase(spark, path, embed=bad), KnowledgeBase(spark, path)
    assert flaky.claim("killed", 10_000, most=4).count() == 4  # its worker is never heard of again
    states = lambda now: {r.state: r["count"] for r in flaky.queue(now).groupBy("state").count().collect()}
    assert states(20_000) == {"claimed": 4, "queued": 5}
    done, failed = flaky.drain("w1", 20_000)
    assert done + failed == 5 and states(20_001).get("waiting", 0) == failed
    done2, failed2 = flaky.drain("w1", 10_000 + queue.LEASE + 1)  # the lease is over, and the failed ones' wait
    assert done + done2 == 6 and flaky.vectors().count() == 6
    assert {r.attempts for r in flaky.queue(200_000).where("state = 'queued'").collect()} == {2}
    assert sound.drain("w2", 1_000_000) == (3, 0)
    assert sound.queue(1_000_001).isEmpty() and sound.table("vectors").count() == sound.table("vectors").select("id").distinct().count() == 9


def test_attempts_end(spark):
    job = spark.createDataFrame([(1,)], "id long")
    events = spark.createDataFrame([(1, "m", e, "w", 0, 5 if e == "failed" else 1, i, 2 * i + (e == "failed")) for i in range(1, queue.ATTEMPTS + 1) for e in ("claimed", "failed")], queue.EVENTS + ", seq long")
    assert queue.state(job, events, 100).first().state == "given_up"
    assert queue.state(job, events.where(f"attempt < {queue.ATTEMPTS}"), 100).first().state == "queued"


def test_of_rival_claims_the_earlier_commit_holds(spark):
    row = lambda seq, worker, event="claimed", at=0, until=100: (7, "m", event, worker, at, until, 1, seq)
    frame = lambda *rows: spark.createDataFrame(list(rows), queue.EVENTS + ", seq long")
    both = frame(row(1, "a"), row(2, "b"))
    assert queue.held(both, 1).count() == 1 and queue.held(both, 2).count() == 0
    assert queue.held(frame(row(1, "a"), row(2, "a", "failed"), row(3, "b", at=50)), 3).count() == 1
    assert queue.held(frame(row(1, "a"), row(3, "b", at=100)), 3).count() == 1


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    base_with(spark, path, 3)
    base = KnowledgeBase(spark, path)
    spark.range(2).write.parquet(f"{tmp_path}/ticks")
    ticks = spark.readStream.schema("id long").parquet(f"{tmp_path}/ticks")
    ingest.drain_stream(base, ticks, f"{tmp_path}/one", lambda: 10_000).awaitTermination()
    assert base.vectors().count() == 3
    n = len(base.log.entries())
    ingest.drain_stream(base, ticks, f"{tmp_path}/two", lambda: 20_000).awaitTermination()
    assert len(base.log.entries()) == n and base.table("vectors").count() == 3


def test_names_in_batches_give_the_links_of_one(spark, tmp_path):
    rows = [(f"k{i:03d}", key) for i, key in enumerate(f"{stem}{tail}{i % 4}" for i, (stem, tail) in enumerate((s, t) for s in ("ledgerstore", "queuerunner", "diskpoolmanager", "networkrouter") for t in ("", "s", "x", "service", "services", "sx")))]
    entities = spark.createDataFrame(rows, "id string, key string")
    log = CommitLog(spark, f"file://{tmp_path}/names", lsh.tables("names"), partitioned=lsh.partitioned("names"))
    new = [lsh.add_names(log, "names", entities.where(F.pmod(F.substring("id", 2, 3).cast("int"), F.lit(4)) == i)).count() for i in range(4)]
    got = sorted((r.a, r.b, round(r.score, 6)) for r in log.table("names_links").collect())
    assert sum(new) == len(got) and got == sorted((r.a, r.b, round(r.score, 6)) for r in resolve.alike(entities).collect())
    assert lsh.add_names(log, "names", entities).isEmpty() and log.table("names_sets").count() == len(rows)


def test_recall_of_near_texts(spark):
    """Texts that share about 0.75 to 0.9 of their word 3-grams: at least nine in ten of those above the threshold are found."""
    import random

    rng, rows = random.Random(5), []
    for i in range(150):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        other = list(words)
        for _ in range(rng.randint(1, 3)):
            other[rng.randint(0, 59)] = "changed"
        rows += [(2 * i, 2 * i, " ".join(words)), (2 * i + 1, 2 * i + 1, " ".join(other))]
    frame = spark.createDataFrame(rows, "id long, document_id long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    true = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if len(grams(a[2]) & grams(b[2])) / len(grams(a[2]) | grams(b[2])) >= resolve.NEAR_TEXT}
    found = {(r.a, r.b) for r in resolve.duplicates(frame).collect()}
    assert found <= true and len(found) >= 0.9 * len(true) > 50
