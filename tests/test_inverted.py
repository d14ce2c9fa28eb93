"""Segments at larger tables: texts are inverted where they lie, and what is scored of them grows with the requests' results, not with texts times requests."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagework.functions import text as X
from passagework.operators import index, segments


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(17)
    words = ["walking", "walked", "größer", "v1.2/a", "common", "common", *(f"w{i}" for i in range(50))]
    rows = [(rng.randrange(1 << 62) * (-1) ** i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    return spark.createDataFrame([*rows, (7, None), (8, "")], "id long, text string").repartition(5).cache()


def test_inverted_blocks_hold_the_postings(spark, texts, monkeypatch):
    monkeypatch.setattr(segments, "AT_ONCE", 300)  # several inversions a task
    stored = index.stored(texts, "id", F.lit(""), F.col("text"))
    rows = lambda df: sorted(map(str, df.select("term", "id", "size", "tf", "positions").collect()))
    tokens = {"exact": index.tokenised(texts, "id", F.col("text"), True), "stem": index.tokenised(texts, "id", F.col("text"))}
    for kind, stems in (("exact", False), ("stem", True)):
        blocks = segments.inverted(tokens[kind], kind, stems, block=8).cache()
        assert rows(segments.postings(blocks)) == rows(stored.where(F.col("kind") == kind))
        told = blocks.select("n", F.size("ids").alias("ids"), "most_tf", F.array_max("tfs").alias("tf"), "least_size", F.array_min("sizes").alias("size"), "part", segments.part(F.col("term")).alias("own"), "kind")
        assert all(r.n == r.ids <= 8 and r.most_tf == r.tf and r.least_size == r.size and r.part == r.own and r.kind == kind for r in told.collect())
        per_term = blocks.groupBy("term").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))
        # pieces of a term are joined; each group of its full ones may leave one that is not full
        assert all(r.blocks <= r.n / 4 + 1 + segments.SPREAD for r in per_term.collect())


def test_a_task_gives_no_more_than_the_results(spark, monkeypatch):
    """300 texts have the word and 50 requests ask for it: not 15,000 rows are scored, but what can be among each request's best."""
    rows = [(i, "word " + "other " * (30 + i % 7)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, text string")
    blocks = segments.blocks(index.stored(frame, "id", F.lit(""), F.col("text")), block=16)
    there = segments.Index(blocks, segments.stats(frame, "id", F.lit(""), F.col("text")), spark.createDataFrame([], segments.REMOVALS), spark.createDataFrame([(0,), (299,)], segments.DEAD))
    asked = spark.createDataFrame([(q, ["word"]) for q in range(50)], "query_id long, terms array<string>")
    given, own = [], segments._scores

    def seen(*args):
        out = own(*args)
        given.append(out.count())
        return out

    monkeypatch.setattr(segments, "_scores", seen)
    got = {(r.query_id, r["rank"]): r.id for r in segments.search(there, "exact", asked, None, 3).collect()}
    assert got == {(q, n + 1): i for q in range(50) for n, i in enumerate((7, 14, 21))}
    assert max(given) <= 50 * 2 * 3


def test_groups_of_texts_do_not_change_results(spark, texts, monkeypatch):
    monkeypatch.setattr(segments, "GROUP", 50)
    tokens = index.tokenised(texts, "id", F.col("text"), True)
    there = segments.Index(segments.inverted(tokens, "exact", block=4).cache(), segments.counted(tokens, "exact"), spark.createDataFrame([], segments.REMOVALS), spark.createDataFrame([], segments.DEAD))
    queries = spark.createDataFrame([(1, ["common", "w3"]), (2, ["w7", "größer", "grosser", "v1.2/a"]), (3, ["nowhere"]), (4, [])], "query_id long, terms array<string>")
    allowed = texts.where("id > 0").select("id")
    key = lambda rows: sorted((r.query_id, r["rank"], r.id, round(r.raw, 6), tuple(r.terms)) for r in rows.collect())
    for some, depth in ((None, 5), (allowed, 5), (None, None)):
        assert key(segments.search(there, "exact", queries, some, depth)) == key(index.bm25(tokens, queries, some, depth))


def test_null_and_empty_texts_count_as_the_sql_counts_them(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 30)))) for i in range(1, 80)] + [(101, None), (102, ""), (103, "..."), (110, None), (120, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4"), (3, "elsewhere")], "item_id long, text string")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = index.tokenised(documents.where("doc_id % 10 <> 0"), "doc_id", F.col("text"), True)
    queries = asked.select(F.col("item_id").alias("query_id"), X.query_terms(F.col("text"), True).alias("terms"))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.raw, 6)) for r in df.collect())
    assert key(entry.queries()["segment_search"](spark, str(tmp_path))) == key(index.bm25(left, queries, None, 10))
