"""Token ids against the tokenizers file, and the defined cases of packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import packing
from passagework.llm.queries import tokenizer_files

SIGNS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "don't", "é", "Ž", "語", "—", "…", "\xa0", "\x0b", "\x1c", "1", "23", "<|endoftext|>", "!", "?!", "’", "\r\n", "😀", "́", "ﬁ", " \n ", "¡", "ª", "µ", "ǅ", "ʰ"]


@pytest.mark.parametrize("part", [packing.Encoder.PART, 7])
def test_ids_are_those_of_the_tokenizers_file(part, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing.Encoder, "PART", part)
    encoder, exact, rng = packing.Encoder(*tokenizer_files()), Tokenizer.from_file(tokenizer_files()[0]), random.Random(part)
    for _ in range(1500):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_runs_of_white_space_and_letters():
    encoder = packing.Encoder(*tokenizer_files())
    for text in (" " * 200_000, "ab" * 100_000, "x\n" * 100_000):
        assert len(encoder.ids(text)) // 4 == len(encoder.exact.encode(text, add_special_tokens=False).ids)


def test_pieces_and_numbers_against_a_loop():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 200)
    row, piece, start, length = packing._pieces(sizes, 8)
    want = []
    for i, size in enumerate(sizes.tolist()):
        at, n = 0, 0
        while at < size:
            own = (size - 1) % 8 + 1 if not at else 8
            want.append((i, n, at, own))
            at, n = at + own, n + 1
    assert list(zip(row.tolist(), piece.tolist(), start.tolist(), length.tolist())) == want
    seen, counted = np.zeros(9, np.int64), {}
    for a, z in ((0, 50), (50, len(length))):
        got = packing._numbered(length[a:z], seen)
        for k, n in zip(length[a:z].tolist(), got.tolist()):
            assert n == counted.get(k, 0)
            counted[k] = n + 1


def test_empty_table_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string, length string, piece string")
    assert packing.pack(none, *tokenizer_files()).count() == 0
    rows = [(1, "same words here", "x", "y"), (1, "same words here", "x", "y"), (1, None, "x", "y"), (None, "no id", "x", "y"), (2, "long words " * 3000, "x", "y")]
    docs = spark.createDataFrame(rows, none.schema)
    packed = packing.pack(docs, *tokenizer_files(), room=16)
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count_if(F.col("piece") == 0).alias("rows")).collect()
    encoder = packing.Encoder(*tokenizer_files())
    for r in got:
        own = [t for i, t, *_ in rows if i == r.doc_id]
        assert r.rows == len(own) and r.tokens == sum(len(encoder.ids(t or "")) // 4 + 1 for t in own)
    slots = sorted((r.sequence_id, r.offset, r.length) for r in packed.collect())
    for (s, o, n), (t, p, _) in zip(slots, slots[1:]):
        assert p == (o + n if s == t else 0)
