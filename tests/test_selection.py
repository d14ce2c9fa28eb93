"""Exact percentiles by narrowing and overlaps by cells, against brute force, with ties, skew, nulls and empty tables."""

import math
import random
import time

from pyspark.sql import functions as F

from passagework.operators import facts, intervals, logs


def test_percentiles_of_any_values(spark, monkeypatch):
    monkeypatch.setattr(logs, "FEW_VALUES", 10)
    monkeypatch.setattr(logs, "RANGES", 7)
    rng = random.Random(3)
    rows = [("even", rng.uniform(-5, 5)) for _ in range(900)] + [("skew", math.exp(rng.uniform(-60, 60))) for _ in range(700)] + [("tie", float(rng.randint(0, 3))) for _ in range(400)] + [("one", 7.0), ("far", -1.7e308), ("far", 1.7e308), ("none", None), (None, 2.0), (None, 4.0)]
    got = {r.tool: (r.calls, r.p50, r.p95, r.max) for r in logs.percentiles(spark.createDataFrame(rows, "tool string, v double"), ["tool"], "v").collect()}
    want = {}
    for tool in {t for t, v in rows if v is not None}:
        own = sorted(v for t, v in rows if t == tool and v is not None)
        want[tool] = (len(own), own[(len(own) - 1) * 50 // 100], own[(len(own) - 1) * 95 // 100], own[-1])
    assert got == want
    assert logs.percentiles(spark.createDataFrame([], "tool string, v long"), ["tool"], "v").count() == 0
    plan = logs.selected(spark.createDataFrame(rows, "tool string, v double"), ["tool"], "v", (50,))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1


def test_overlaps_of_any_intervals(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        f = rng.choice([None, rng.randint(-500, 500), rng.randint(-9, 9)])
        t = rng.choice([None, (f or 0) + rng.choice([-2, 0, 1, 2, 7, 64, 300])])
        rows.append((rng.choice("xy"), i, f, t))
    frame = spark.createDataFrame(rows, "k string, id long, f long, t long")
    far = 1 << 62
    met = intervals.overlapping(frame, "k", "id", F.coalesce("f", F.lit(-far)), F.coalesce("t", F.lit(far)))
    got = sorted(tuple(sorted((r.a.id, r.b.id))) for r in met.collect())
    low, high = (lambda r: -far if r[2] is None else r[2]), (lambda r: far if r[3] is None else r[3])
    want = sorted((p[1], q[1]) for i, p in enumerate(rows) for q in rows[i + 1 :] if p[0] == q[0] and low(p) < high(q) and low(q) < high(p))
    assert got == want
    assert intervals.overlapping(frame.limit(0), "k", "id", F.col("f"), F.col("t")).count() == 0


def test_one_subject_with_very_many_facts(spark):
    """100,000 facts of one subject in short intervals: pairs are those of neighbours, and no two far apart are compared."""
    n = 100_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.lit("hub")).alias("about"), F.concat(F.lit("fact "), F.col("id").cast("string")).alias("statement"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 15).alias("valid_to"), F.col("id").alias("recorded_at"), F.lit("user").alias("trust"))
    began = time.time()
    assert facts.conflicts(rows).count() == n - 1
    assert time.time() - began < 180
