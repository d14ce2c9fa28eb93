"""Merges in their order against one at a time."""

import random

from passagework.operators import merges


def one_at_a_time(decisions):
    parent = {}

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    for _, a, b, state in sorted((at, a, b, state) for a, b, state, at in decisions):
        if state == "merged" and b not in parent and find(a) != b:
            parent[b] = a
    return {b: find(b) for b in parent}


def check(spark, decisions):
    frame = spark.createDataFrame(decisions, "a long, b long, state string, decided_at long")
    got = merges.roots(frame).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.root for r in got} == one_at_a_time(decisions)
    return frame


def test_chains_circles_and_double_merges(spark):
    m = "merged"
    frame = check(spark, [(1, 2, m, 10), (3, 1, m, 20), (9, 2, m, 30), (2, 3, m, 40), (8, 3, m, 50), (4, 4, m, 60), (5, 6, "rejected", 1), (6, 5, m, 2), (7, 6, m, 3), (5, 7, m, 4), (1, 2, m, 10)])
    edges = spark.createDataFrame([(2, 1), (1, 9), (5, 2), (10, 11)], "src long, dst long")
    assert sorted(map(tuple, merges.renamed_edges(edges, merges.roots(frame)).collect())) == [(7, 8), (8, 9), (10, 11)]
    assert merges.renamed_edges(edges, None) is edges


def test_any_decisions(spark):
    rng = random.Random(2)
    check(spark, [(rng.randint(0, 40), rng.randint(0, 40), rng.choice(["merged", "merged", "rejected"]), rng.randint(0, 60)) for _ in range(120)])
    check(spark, [(i + 1, i, "merged", 1000 - i) for i in range(100)] + [(0, 100, "merged", 5000), (200, 100, "merged", 6000)])
    check(spark, [])
