"""Long texts in chunks, stretches drawn over whole texts, and the defined cases of language ID."""

import random

import numpy as np

from passagework.llm import language_id

POOLS = {"de": "und der über schaft größe nicht keit".split(), "en": "the and thing with from shing ward".split(), "fr": "le réeau eaux où très dans ment".split()}


def field():
    rng = random.Random(1)
    texts = [(" ".join(rng.choices(POOLS[x], k=60)), x) for x in POOLS for _ in range(30)]
    return language_id.fit([t for t, _ in texts], [x for _, x in texts])


def test_a_long_text_in_chunks_is_the_whole_text():
    own, rng = field(), random.Random(2)
    text = " ".join(rng.choice(POOLS[rng.choice("de en fr".split())]) + rng.choice(["", ".", " 12 "]) for _ in range(4000))
    raw = np.frombuffer(text.encode(), np.uint8)
    data, starts, ends, rows = language_id._found(raw, np.array([0, len(raw)]))
    post, _ = language_id.posteriors(own.scores(data, starts, ends), rows, own.transitions)
    for size in (1, 100, 3000, 1 << 20):
        mass, sure, n = language_id.long_text(own, raw, size)
        assert n == len(post) and np.allclose(mass, post.sum(axis=0), rtol=1e-3) and np.isclose(sure, post.max(axis=1).sum(), rtol=1e-3)


def test_stretches_come_from_the_whole_text():
    import pyarrow as pa

    text = " ".join(f"word{'x' * (i % 5)} {i}" for i in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["en"] * 3), pa.array([text, "short one", "語" * 5000])], names=["doc_id", "lang", "text"])
    got = [x for b in language_id._drawn(5)(iter([batch])) for x in b.to_pylist()]
    places = [x["place"] for x in got if x["doc_id"] == 7]
    assert len(places) == language_id.STRETCHES and max(places) > 0.8 * len(text)
    assert [x["text"] for x in got if x["doc_id"] == 8] == ["short one"]
    assert all(len(x["text"].encode()) <= 3 * language_id.STRETCH for x in got)
    assert all(x["text"] in text for x in got if x["doc_id"] == 7)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LONG", 2000)
    monkeypatch.setattr(language_id, "CHUNK", 1000)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(POOLS[x], k=60)), x, "s") for i in range(150) for x in [("en", "fr", "de")[i % 3]]]
    rows += [(1000, " ".join(rng.choices(POOLS["fr"], k=5000)), None, "s"), (1001, None, "en", "s"), (1002, "12 … 。", None, "s"), (None, rows[1][1], None, "s"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {}
    for r in language_id.identify(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 3 and len({x.lang_pred for x in got[0]}) == 1
    assert got[1000][0].lang_pred == "fr" and got[1001][0].lang_pred == got[1002][0].lang_pred == "und" and got[None][0].lang_pred == "fr"
    assert language_id.with_language(docs).columns == ["doc_id", "text", "lang", "lang_pred", "score", "certainty"]
