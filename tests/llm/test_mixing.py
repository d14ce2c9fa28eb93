"""Sums that are hard to reach, and the defined cases of mixing."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies string, last string, row string"


def reachable(lengths, most):
    bits, mask = 1, (1 << (most + 1)) - 1
    for k, n in lengths.items():
        part = 1
        while n:
            part = min(part, n)
            bits |= (bits << (k * part)) & mask
            n -= part
            part *= 2
    return bits


@pytest.mark.parametrize("case", range(12))
def test_one_odd_length_among_even_ones(case):
    rng = random.Random(case)
    lengths = Counter(2 * rng.randint(50, 2000) for _ in range(4000))
    lengths[2 * rng.randint(50, 2000) + 1] = 1
    total = sum(k * n for k, n in lengths.items())
    budget = rng.randint(total // 4, 3 * total // 4)
    take = mixing.subset(dict(lengths), budget, case)
    assert all(0 <= take[k] <= n for k, n in lengths.items())
    got = sum(k * n for k, n in take.items())
    assert got == budget or not reachable(lengths, budget) >> budget & 1


def test_few_documents_of_many_words():
    rng = random.Random(1)
    for _ in range(10):
        lengths = dict(Counter(rng.randint(90_000, 130_000) for _ in range(25)))
        budget = sum(lengths) // 2
        bits = reachable(lengths, sum(lengths))
        nearest = min(abs(i - budget) for i in range(budget - 3000, budget + 3000) if bits >> i & 1)
        take = mixing.subset(lengths, budget)
        assert abs(sum(k * n for k, n in take.items()) - budget) == nearest


def test_words_are_counted_alike(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a b\tç\n\x0b\x0c\r 😀\x1c\u3000") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    import pyarrow as pa

    assert [r.n for r in rows] == mixing.counts(pa.array([r.text for r in rows], pa.string())).tolist()


@pytest.mark.parametrize("plan_rows", [mixing.PLAN_ROWS, 0])
def test_rows_pass_as_often_as_the_mix_says(spark, monkeypatch, plan_rows):
    monkeypatch.setattr(mixing, "PLAN_ROWS", plan_rows)
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(1, 9))), rng.choice(["a", "b", "ç", None])) for i in range(400)]
    rows += [(1000 + i, "same size of copies", "a") for i in range(300)] + [(2000, "two rows one id", "b")] * 7 + [(None, "no id at all", "ç")] * 5
    rows += [(3000, None, "a"), (3001, "", "a"), (3002, " \n", "only blanks"), (3003, "long " * 5000, "b")]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "k") for r in rows], SCHEMA).repartition(7)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    out = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    got = Counter()
    for (i, s, t), n in out.items():
        got[i, s] += n * len(t.split())
        assert n <= 3 * sum(x[:2] == (i, t) for x in rows)
    for key, n in want.items():
        assert got[key] == n, key


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
