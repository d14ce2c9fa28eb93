"""Segments: a search over many commits, removals and merges gives what an index built anew gives, and reads only what it asks for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from passagework.api import KnowledgeBase
from passagework.operators import index, segments

def built(spark, texts, parts):
    """An index of texts in several commits' worth of blocks."""
    frames = [spark.createDataFrame(texts[i::parts], "id long, text string") for i in range(parts)]
    whole = lambda rows: rows[0] if len(rows) == 1 else rows[0].unionByName(whole(rows[1:]))
    blocks = whole([segments.blocks(index.stored(f, "id", F.lit(""), F.col("text")), block=4) for f in frames])
    return frames, blocks, whole([segments.stats(f, "id", F.lit(""), F.col("text")) for f in frames])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "common", "common", "common", *(f"w{i}" for i in range(40))]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(90)]


def test_search_equals_an_index_built_anew(spark, corpus):
    gone = [i for i, _ in corpus if i % 5 == 0]
    frames, blocks, stats = built(spark, corpus, 3)
    out = spark.createDataFrame([r for r in corpus if r[0] in gone], "id long, text string")
    post = index.stored(out, "id", F.lit(""), F.col("text"))
    there = segments.Index(blocks.cache(), stats.unionByName(segments.stats(out, "id", F.lit(""), F.col("text"), -1)), segments.removals(post), out.select("id"))
    left = spark.createDataFrame([r for r in corpus if r[0] not in gone], "id long, text string")
    queries = spark.createDataFrame([(1, ["alpha", "common"]), (2, ["w3", "w5", "beta"]), (3, ["nowhere"]), (4, ["common"])], "query_id long, terms array<string>")
    key = lambda rows: sorted((r.query_id, r.rank, r.id, round(r.raw, 6), tuple(r.terms)) for r in rows.collect())
    for depth, seeds in ((5, 1), (None, 4)):
        want = index.bm25(index.tokenised(left, "id", F.col("text"), True), queries, None, depth)
        assert key(segments.search(there, "exact", queries, None, depth, seeds=seeds)) == key(want)
    allowed = left.where("id % 2 = 1").select("id")
    assert key(segments.search(there, "exact", queries, allowed, 5)) == key(index.bm25(index.tokenised(left, "id", F.col("text"), True), queries, allowed, 5))
    phrases = spark.createDataFrame([(1, ["common common", "beta"])], "query_id long, terms array<string>")
    assert key(segments.search(there, "exact", phrases, None, 5)) == key(index.bm25(index.tokenised(left, "id", F.col("text"), True), phrases, None, 5))
    assert there.blocks.agg(F.max("n")).first()[0] < 30


def test_blocks_that_cannot_matter_are_not_read(spark):
    """One text repeats the word; its block alone reaches the threshold of the best."""
    texts = [(i, "word " + "other " * (30 + i % 7)) for i in range(300)] + [(1000 + i, "word " * 20) for i in range(3)]
    _, blocks, stats = built(spark, texts, 1)
    none = segments.Index(blocks, stats, spark.createDataFrame([], segments.REMOVALS), spark.createDataFrame([], segments.DEAD))
    asked = spark.createDataFrame([(1, ["word"])], "query_id long, terms array<string>")
    read = []
    own = segments._scores

    def seen(there, mine, chosen, met, allowed):
        read.append(chosen.count())
        return own(there, mine, chosen, met, allowed)

    segments._scores = seen
    try:
        got = [r.id for r in segments.search(none, "exact", asked, None, 3, seeds=3).orderBy("rank").collect()]
    finally:
        segments._scores = own
    assert got == [1000, 1001, 1002]
    assert read[1] <= 6 < blocks.where("kind = 'exact' and term = 'word'").count()


KIND = "namespace string, uri string, content string, title string"


def test_a_base_keeps_its_index_in_step(spark, tmp_path):
    base = KnowledgeBase(spark, f"file://{tmp_path}/base", embed=None)
    doc = lambda i, text: ("n", f"u{i}", f"# Doc {i}\n\n{text}", f"Doc {i}")
    base.ingest(spark.createDataFrame([doc(1, "alpha beta"), doc(2, "alpha gamma gamma"), doc(3, "delta")], KIND), 1000)
    base.ingest(spark.createDataFrame([doc(2, "alpha epsilon"), doc(4, "alpha alpha beta")], KIND), 2000)
    base.forget(f"memo://doc/{base.documents().where("uri = 'u1'").first().id}", "old", 3000)

    def same():
        passages = base.passages()
        anew = index.stored(passages, "id", F.coalesce("context_header", F.lit("")), F.col("text"))
        rows = lambda df: sorted(map(str, df.select("kind", "term", "id", "size", "tf", "positions").collect()))
        assert rows(base.postings()) == rows(anew)
        now = segments.stats(passages, "id", F.coalesce("context_header", F.lit("")), F.col("text"))
        total = base.table("index_stats").groupBy("kind").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
        assert sorted(map(tuple, total.collect())) == sorted(map(tuple, now.collect()))
        asked = spark.createDataFrame([("alpha",), ("beta",), ("gone",)], "term string")
        mine = segments.asked_blocks(base.index(), "exact", asked)
        df = {r.term: r.df for r in segments._frequencies(base.index(), "exact", mine).collect()}
        assert df == {r.term: float(r.n) for r in anew.where("kind = 'exact'").join(asked, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = mine._jdf.queryExecution().executedPlan().toString()
        return [r.uri for r in base.search(["alpha beta"], mode="keyword").join(base.documents().select(F.col("id").alias("document_id"), F.col("uri").alias("u")), "document_id").orderBy("position").select(F.col("u").alias("uri")).collect()], plan

    first, plan = same()
    assert first[0] == "u4" and "u1" not in first
    assert re.search(r"PartitionFilters: \[.*part#\d+ IN", plan) or re.search(r"PartitionFilters: \[.*\(part#\d+ = ", plan)
    n = base.table("segments").count()
    assert base.merge_index() <= n and base.table("removals").isEmpty() and base.table("dead").isEmpty()
    assert same()[0] == first
