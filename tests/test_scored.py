"""Requests scored beside the texts: as by shuffled postings, with copies, nulls, stems and filters; what contains a passage, against Python's own search."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import evaluation, feedback, index
from passagework.plans import fixtures, search
from passagework.plans.profiles import Profile


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["sail", "sails", "sailing", "été", "reef", "mast", "x9", "the", "of"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(150)] + [(i, "mast reef mast sails") for i in range(400, 430)] + [(900, None), (901, "")]
    asked = [(q, rng.sample(words, 5)) for q in range(12)] + [(50, ["nowhere"]), (51, [])]
    return spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, terms array<string>")


@pytest.mark.parametrize("stems", [False, True])
def test_requests_meet_texts_without_a_shuffle_of_postings(corpus, monkeypatch, stems):
    texts, queries = corpus
    tokens = index.tokenised(texts, "id", F.col("text"))
    queries = index.stem_terms(queries) if stems else queries
    key = lambda df: sorted((r.query_id, r.id, r["rank"], r.raw, tuple(r.terms), r.arm) for r in df.collect())
    for allowed, depth in ((None, 4), (None, None), (texts.where("id % 3 = 0"), 7)):
        got = index.bm25(tokens, queries, allowed, depth, "keyword", stems)
        assert key(got) == key(index._shuffled(tokens, queries, allowed, depth, "keyword", stems))
    plan = index.bm25(tokens, queries, None, 4, "keyword", stems)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(term" not in plan
    monkeypatch.setattr(index, "SCORES", 100)  # several parts a batch
    assert key(index.bm25(tokens, queries, None, 4, "keyword", stems)) == key(index._shuffled(tokens, queries, None, 4, "keyword", stems))


def test_of_equal_texts_the_smallest_ids_leave_a_task(corpus):
    texts, queries = corpus
    asked = index.Asked.of(queries.where("query_id < 12"))
    held = asked.held(index.tokenised(texts.where("id >= 400 and id < 430").coalesce(1), "id", F.col("text")), False)
    rows = asked.best(held, asked.counted(held)[0], 4).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).collect()
    assert rows and all(r.n == 4 and r.last == 403 for r in rows)


def test_prefixes_are_as_by_shuffled_postings(corpus):
    texts, queries = corpus
    tokens = index.tokenised(texts, "id", F.col("text")).withColumn("part", F.pmod("id", F.lit(4)).cast("int"))
    got, want = (f(tokens, queries, 4, 5) for f in (feedback.by_prefix, feedback._shuffled_by_prefix))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(term" not in plan


def test_texts_that_contain_a_passage(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "LOOK", 64)  # several looks a batch
    rng = random.Random(6)
    texts = [(i, "".join(rng.choices("abé ", k=rng.randint(0, 300)))) for i in range(200)] + [(500, None), (501, "")]
    passages = [(i, texts[i * 7][1][5 : 5 + rng.choice([1, 3, 7, 8, 9, 20, 60])]) for i in range(25)] + [(90, "abababab"), (91, ""), (92, None), (93, "aaaaaaaa"), (94, "never met in any text")]
    got = evaluation.containing(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), spark.createDataFrame(passages, "query_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, p in passages for i, t in texts if p is not None and t is not None and p in t)
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_for_the_first_places_alone(spark, monkeypatch):
    met, own = [], search.rerank
    monkeypatch.setattr(search, "rerank", lambda rows, *more: met.append(rows.agg(F.max("position")).first()[0]) or own(rows, *more))
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    rows = search.search(t.corpus(), t.asked(), ["exact"], Profile(rerank_top=3), limit=5).select("query_id", "position").collect()
    assert met == [5] and max(r.position for r in rows) == 5
