"""Walks over the stored graph: same mass as a walk in memory, hubs in blocks, no shuffle of edges, keys by state."""

import random
import re
from collections import defaultdict

import pytest

from passagework.api import KnowledgeBase
from passagework.operators import adjacency


def walked(edges, seeds, alpha=0.85, rounds=10, cap=50):
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    out = {}
    for s in seeds:
        mass = {s: 1.0}
        for _ in range(rounds):
            new = defaultdict(float, {s: 1 - alpha})
            for n, m in mass.items():
                total, damp = sum(w for _, w in near[n]), min(1.0, cap / len(near[n])) if near[n] else 0
                for b, w in near[n]:
                    new[b] += alpha * m * w / total * damp
            mass = new
        out |= {(s, n): m for n, m in mass.items()}
    return out


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(6)
    return [("hub", f"n{i}", 1.0 + i % 3) for i in range(150)] + [(f"n{rng.randint(0, 149)}", f"m{rng.randint(0, 30)}", rng.random() + 0.1) for _ in range(200)]


def test_mass_is_that_of_a_walk_in_memory(spark, tmp_path, edges):
    frame = spark.createDataFrame(edges, "a string, b string, weight double")
    seeds = spark.createDataFrame([("hub",), ("m3",), ("nowhere",)], "seed string")
    there = adjacency.stored(frame, f"file://{tmp_path}/graphs", "k1", block=20, buckets=4)
    assert there.nodes.where("node = 'hub'").first().blocks == 8
    got = {(r.seed, r.node): r.mass for r in adjacency.walk(there, seeds).collect()}
    assert got == pytest.approx(walked(edges, ["hub", "m3", "nowhere"]))
    again = adjacency.stored(spark.createDataFrame([], frame.schema), f"file://{tmp_path}/graphs", "k1")
    assert again.steps.count() == there.steps.count() == 2 * len(edges)
    name = [t.name for t in spark.catalog.listTables() if t.name.startswith("adjacency_")]
    for n in name:  # as a session sees it that has not built it
        spark.sql(f"DROP TABLE {n}")
    reread = adjacency.stored(spark.createDataFrame([], frame.schema), f"file://{tmp_path}/graphs", "k1")
    assert {(r.seed, r.node): r.mass for r in adjacency.walk(reread, seeds).collect()} == pytest.approx(got)
    assert adjacency.stored(frame.limit(3), f"file://{tmp_path}/graphs", "k2").steps.count() == 6
    assert adjacency.stored(frame.limit(0), f"file://{tmp_path}/graphs", "k3").steps.count() == 0


def test_edges_are_not_shuffled(spark, tmp_path, edges):
    frame = spark.createDataFrame(edges, "a string, b string, weight double")
    there = adjacency.stored(frame, f"file://{tmp_path}/graphs", "plan", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = adjacency.walk(there, spark.createDataFrame([("hub",)], "seed string"), rounds=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Bucketed: true") == 3 and plan.count("SortMergeJoin") == 3
    assert not re.search(r"Exchange hashpartitioning\(_s#", plan)


def test_a_changed_base_gets_a_new_graph(spark, tmp_path):
    base = KnowledgeBase(spark, f"file://{tmp_path}/base", embed=None)
    kind = "namespace string, uri string, content string, title string"
    base.ingest(spark.createDataFrame([("n", "u1", "# One\n\nThe `LedgerStore` talks to `QueueRunner`.", "One"), ("n", "u2", "# Two\n\n`QueueRunner` feeds `DiskPool`.", "Two")], kind), 1000)
    first = base.graph()
    assert base.graph().key == first.key and first.steps.count() == 2 * base.live_mentions().count()
    base.search(["LedgerStore"], mode="auto")
    assert base.graph().key == first.key
    base.forget(f"memo://doc/{base.documents().where("uri = 'u2'").first().id}", "old", 2000)
    second = base.graph()
    assert second.key != first.key and second.steps.count() < first.steps.count()
    assert [g for g in base.vacuum(1 << 60) if g.startswith("_graphs")] == [f"_graphs/{first.key}"]


def test_seeds_of_a_group_meet_an_edge_once(spark, tmp_path, edges):
    frame = spark.createDataFrame(edges, "a string, b string, weight double")
    names = [f"n{i}" for i in range(0, 150, 3)] + ["hub", "nowhere", "m3"]  # more than a group
    there = adjacency.stored(frame, f"file://{tmp_path}/graphs", "wide", block=20, buckets=4)
    found = adjacency.walk(there, spark.createDataFrame([(n,) for n in names], "seed string"), rounds=3)
    assert {(r.seed, r.node): r.mass for r in found.collect()} == pytest.approx(walked(edges, names, rounds=3))
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        assert "sum(m31" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
