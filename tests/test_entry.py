import __spark_entry__ as entry


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_streams_equal_batches(spark, tmp_path):

    from passagework.streaming import ingest

    from passagework.api import KnowledgeBase
    from passagework.operators import segments

    rows = [(1, "n", "u1", "t", None, "one two"), (2, "n", "u2", "t", None, "one two"), (3, "m", "u3", "t", None, "three")]
    docs = spark.createDataFrame(rows, "id long, namespace string, uri string, title string, context string, content string")
    docs.write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")).drop("id")
    base, other = (KnowledgeBase(spark, f"file://{tmp_path}/{x}", embed=None) for x in ("kb", "other"))
    ingest.ingest_stream(base, incoming, str(tmp_path / "state"), 1000).awaitTermination()
    other.ingest(docs.drop("id"), 1000)
    of = lambda b, t: sorted(map(str, b.table(t).drop("id", "document_id").collect()))
    assert base.documents().count() == 3 and ingest.first_seen(docs).count() == 2
    assert all(of(base, t) == of(other, t) for t in ("passages", "segments", "index_stats"))
    assert {r.term for r in base.postings().where("kind = 'exact'").collect()} == {"one", "two", "three"}
    n = len(base.log.entries())
    ingest.ingest_stream(base, incoming, str(tmp_path / "state2"), 2000).awaitTermination()  # the same batch again
    assert len(base.log.entries()) == n and base.documents().count() == 3
    assert segments.search(base.index(), "stem", spark.createDataFrame([(1, ["three"])], "query_id long, terms array<string>")).count() == 1
