"""Products of matrices against brute force: nearest neighbours with ties and empty vectors, coverage of statements by pages."""

import random

import numpy as np
from pyspark.sql import functions as F

from passagework.operators import compact, index


def test_nearest_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).astype(np.float32)
    vectors = [(i, base[i % 40].tolist()) for i in range(200)] + [(500, [0.0] * 6), (501, None)]
    frame = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(3)
    queries = frame.where("id % 25 = 0 and id < 501").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(index, "SCORES", 60)  # several parts a batch
    size = lambda v: np.linalg.norm(v) or 1.0
    whole = {i: np.array(v if v else [0.0] * 6, float) for i, v in vectors}
    for depth, floor in ((7, None), (None, 0.3), (5, 0.5)):
        true = set()
        for q in [i for i in whole if i % 25 == 0]:
            scores = sorted((-round(float(whole[q] @ v / size(whole[q]) / size(v)), 9), i) for i, v in whole.items())
            scores = [x for x in scores if floor is None or -x[0] >= floor]
            true |= {(q, i, n + 1) for n, (_, i) in enumerate(scores[:depth])}
        assert {(r.query_id, r.id, r["rank"]) for r in index.nearest(frame, queries, depth, floor).collect()} == true
    plan = index.nearest(frame, queries, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_coverage_of_all_pages(spark):
    rng = random.Random(4)
    words = ["alpha", "alphabet", "bravo", "charlie", "delta", "echo,", "(foxtrot)", "of", "it"]
    pages = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for i in range(700)] + [(900, None)]
    said = [(i, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for i in range(20)] + [(30, "of it")]
    p, s = spark.createDataFrame(pages, "page_id long, content string"), spark.createDataFrame(said, "statement_id long, statement string")
    each = compact._missing(compact._stems(p).crossJoin(compact._content_words(s)))
    got = compact.omissions_of_all(p, s)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect()))
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
