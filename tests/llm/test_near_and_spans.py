"""Measured recall of the n-gram join near its threshold, and spans of short and of unspaced sentences."""

import random
from collections import defaultdict

import numpy as np
import pytest

from passagework.llm import importance_resampling, ngram_join, span_dedup


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def test_recall_of_borderline_pairs(spark):
    """Of all pairs with a similarity of 0.80 to 0.85, found by brute force, at least 0.9 are in one class."""
    rng = random.Random(12)
    texts = {}
    for i in range(400):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(120, 300))]
        other = list(words)
        for place in sorted(rng.sample(range(0, len(words), 12), max(1, round(len(words) * 0.021)))):
            other[place] = f"x{rng.randint(0, 10**6)}"
        texts[2 * i], texts[2 * i + 1] = words, other
    near = [i for i in range(0, 800, 2) if 0.8 <= similarity(texts[i], texts[i + 1]) <= 0.85]
    assert len(near) >= 100
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    found = sum(got[i].class_id == got[i + 1].class_id for i in near)
    assert found >= 0.9 * len(near), (found, len(near))
    for i in range(0, 800, 2):
        assert got[i].class_id == got[i + 1].class_id or i in near or similarity(texts[i], texts[i + 1]) < 0.8
        assert got[i].class_id != got[i + 1].class_id or similarity(texts[i], texts[i + 1]) >= 0.8


def test_links_inside_a_large_group_are_those_of_brute_force(spark):
    """A node of 120 texts around the threshold: some pairs of it are alike, some are not."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for place in rng.sample(range(40, 150), rng.choice([1, 2, 3])):
            words[place] = f"x{rng.randint(0, 10**6)}"
        texts[i] = words
    sets = {i: shingle_set(w) for i, w in texts.items()}
    like = {i: {j for j in texts if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in texts}
    got = {r.doc_id: r.n_links for r in ngram_join.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()}
    met = sum(got.values()) / sum(map(len, like.values()))
    assert met >= 0.97 and all(got[i] <= len(like[i]) for i in texts)


def brute_runs(rows):
    """Texts without sentences that a run of three not first of its kind covers; sentences end at a line feed or at .!? and 。！？."""
    import re

    first, cut = {}, {}
    for i, text in sorted(rows.items()):
        parts = [p for p in re.findall(r"[^\n。！？]*?(?:[.!?](?=\s|$)|[。！？]|\n|$)\s*", text) if p.strip()]
        cut[i] = parts
        for k in range(len(parts) - 2):
            first.setdefault(tuple(" ".join(p.split()) for p in parts[k : k + 3]), (i, k))
    out = {}
    for i, parts in cut.items():
        gone = set()
        for k in range(len(parts) - 2):
            if first[tuple(" ".join(p.split()) for p in parts[k : k + 3])] != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = [" ".join(p.split()) for k, p in enumerate(parts) if k not in gone]
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    pool = [f"{a} {b}." for a in ("Yes", "No", "It is", "So") for b in ("so", "it", "now", "then we go on")]
    rows = {i: " ".join(f"Own {i} {k}." if rng.random() < 0.3 else rng.choice(pool) for k in range(rng.randint(1, 12))) for i in range(150)}
    rows |= {1000 + i: rng.choice(["天", "地"]) + "".join(rng.choice("人口手足山水火") + rng.choice("。！？") for _ in range(60)) for i in range(3)}
    rows[1003] = rows[1000]
    rows[1004] = "Four short. Words in. It all. Here now."
    rows[1005] = "Other text here. Four short. Words in. It all. Here now."
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows.items()], "doc_id long, text string, twin string, place string, size string")
    got = {r.doc_id: r for r in span_dedup.without_repeats(docs).collect()}
    want = brute_runs(rows)
    import re

    for i in rows:
        left = [" ".join(p.split()) for p in re.findall(r"[^\n。！？]*?(?:[.!?](?=\s|$)|[。！？]|\n|$)\s*", got[i].text) if p.strip()]
        assert left == want[i], i
    assert got[1003].text == "" and got[1003].n_removed == got[1003].n_sentences == 60
    assert got[1005].text.strip() == "Other text here." and span_dedup.without_repeats(docs.limit(0)).count() == 0


def test_equal_rows_and_ties_of_spans(spark):
    text = "One two. Three four. Five six. Seven."
    rows = [(1, text), (1, text), (2, text + " " + text), (3, "long " * 40_000), (None, text)]
    got = defaultdict(list)
    for r in span_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    assert {r.text for r in got[1]} == {text} and len(got[1]) == 2
    assert got[2][0].text == "" and got[2][0].n_removed == 8 and got[3][0].n_removed == 0 and got[None][0].text == text


@pytest.mark.parametrize("temperature", [1.0, 50.0])
def test_importance_weights_against_brute_force(spark, temperature):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("a bb ccc dd ee ff gg".split()) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(300, None), (301, "long " * 50_000), rows[0], rows[0], (None, "a bb")]
    target = [(i,) for i in range(0, 60)] + [(0,), (None,), (9999,)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, key string, kept string, n_grams string")
    got = importance_resampling.resample(docs, spark.createDataFrame(target, "doc_id long"), keep=0.5, temperature=temperature).collect()

    def buckets(text):
        import pyarrow as pa

        return importance_resampling.grams(pa.array([text], pa.string()))[0]

    n = importance_resampling.BUCKETS
    raw, wanted = np.ones(n), np.ones(n)
    for i, t in rows:
        raw += np.bincount(buckets(t), minlength=n)
        wanted += np.bincount(buckets(t), minlength=n) * (i is not None and i < 60)
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())
    weights = {(i, t): ratio[buckets(t)].sum() for i, t in rows}
    by_id = {i: w for (i, _), w in weights.items()}
    assert all(r.log_weight is None if not r.n_grams else r.log_weight == pytest.approx(by_id[r.doc_id], abs=1e-6) for r in got)
    keys = sorted((r.key for r in got if r.key is not None), reverse=True)
    least = keys[round(0.5 * len(rows)) - 1]
    assert all(r.kept == (r.key is not None and r.key >= least) for r in got)
    assert len({r.key for r in got if r.doc_id == 0}) == 1 and not any(r.kept for r in got if r.doc_id == 300)
    assert importance_resampling.resample(docs.limit(0), spark.createDataFrame(target, "doc_id long")).count() == 0
