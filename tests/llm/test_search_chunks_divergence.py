"""Ranked search, chunked encoding and the divergence audit against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passagework.llm import bpe_chunks, divergence, ranked_search
from passagework.llm.packing import Encoder

TERM, LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, block string, term string, score string, digest string, n long, lang_ string"


def terms(text, pattern=TERM):
    return pattern.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [rng.choice(["Éa", "ñu", "ka", "lo", "x9", "TH", "é", "语"]) + rng.choice(["", "ra", "st", "42", "ŌO"]) for _ in range(70)]
    shared = " ".join(rng.choice(words) for _ in range(400))
    out = []
    for i in range(420):
        text = " ".join(rng.choice(words[: 10 + i % 60]) + rng.choice(["", ".", ",", "!\n", "  "]) for _ in range(rng.randint(0, 90)))
        if i % 9 == 0:
            text += rng.choice([" ", "", "x"]) + shared + rng.choice([" tail", "", "<|endoftext|>"])
        out.append((i, text, ("en", "fr", None)[i % 3], f"s{i % 7}" if i % 11 else None))
    out += [(500 + i, shared, "en", "s1") for i in range(60)]
    out += [(600, None, None, None), (601, "", "en", "s0"), (602, " \n12 !", "de", "s9"), (603, "wort " * 40_000 + "语" * 30_000, "de", "s8"), (604, "same text", "fr", "s3"), (604, "same text", "fr", "s3"), (605, "same text", "fr", "s3"), (None, shared[:300], "en", "s0"), (None, "same text", None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "b", "t", "s", "d", 1, "l") for r in rows], SCHEMA).repartition(5).cache()


# ranked search


def best(rows, items, k):
    own = [(d, Counter(terms(t))) for d, t, *_ in rows]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, q in asked.items():
        scores = []
        for d, c, size in own:
            m = 75 + (25 * size * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search_is_that_of_all_documents(spark, docs, rows):
    items = [(i, rows[i * 7][1][:150]) for i in range(40)] + [(50, None), (51, "nowhere"), (None, "same text"), (3, "ka ka lo"), (60, "语 " * 3000 + "wort")]
    asked = spark.createDataFrame([(*x, "r", 1) for x in items], "item_id long, text string, block string, weight int")
    there = ranked_search.index(docs)
    want = best(rows, items, 5)
    for seeds, most in ((1, 4 << 20), (3, 4000)):
        got = ranked_search.search(there, asked, k=5, seeds=seeds, batch_bytes=most).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(ranked_search.index(docs), none).count() == 0
    assert ranked_search.search(ranked_search.index(docs.limit(0)), spark.createDataFrame([(1, "ka")], "item_id long, text string")).count() == 0


def test_blocks_hold_what_their_documents_can_reach(docs, rows):
    there = ranked_search.index(docs)
    assert there.documents == sum(bool(terms(t)) for _, t, *_ in rows)
    assert there.occurrences == sum(len(terms(t)) for _, t, *_ in rows)
    for r in there.blocks.collect():
        _, part = ranked_search._parts(*(ranked_search._wide(bytes(x)) for x in (r.sizes, r.ends, r.counts)), there.documents, there.occurrences)
        most = np.zeros(len(r.cuts) // 4 - 1, int)
        np.maximum.at(most, ranked_search._wide(bytes(r.terms)), part)
        assert (most == ranked_search._wide(bytes(r.best))).all()


# encoding by chunks


def test_encoding_is_that_of_the_library(spark, docs, rows):
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(path)
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    whole = bpe_chunks.encode(docs, path, ranks)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in whole.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = Counter((r.doc_id, r.text) for r in bpe_chunks.decode(whole, path).collect())
    assert back == Counter((d, t or "") for d, t, *_ in rows)
    assert bpe_chunks.encode(docs.limit(0), path, ranks).count() == 0


def test_joins_of_any_texts_agree_with_the_whole():
    path, ranks, rng = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(3)
    library, encoder = Tokenizer.from_file(path), Encoder(path, ranks)
    signs = ["a", "'", "s", "re", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "9", "é", "语", "<|endoftext|>", "<|", "!", "I'll", "é", "🙂", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        at = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        parts = [text[a:z] for a, z in zip([0, *at], [*at, len(text)])]
        ids = np.frombuffer(bpe_chunks.joined((bpe_chunks._split(p, encoder) for p in parts), encoder), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_cuts_follow_content_and_spare_signs():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé语 ") for _ in range(6000)).encode()
    texts = [passage, b"other beginning " * 7 + passage, b"", b"x" * 30_000]
    data, rows = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ends = bpe_chunks.cuts(data, rows)
    pieces = []
    for a, e, text in zip(rows, ends, texts):
        z = [0, *(e - a).tolist()]
        own = [text[i:j] for i, j in zip(z, z[1:])]
        assert b"".join(own) == text and all(0 < len(p) <= bpe_chunks.MOST + 3 for p in own)
        [p.decode() for p in own]
        pieces.append(own)
    assert len(set(pieces[0]) & set(pieces[1])) >= len(pieces[0]) - 2
    assert not len(ends[2])


# divergence audit


def audited(rows, least_docs, top):
    seen, docs_of, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = terms(text, LETTERS)
        seen[lang or "", source or ""].update(own)
        docs_of[lang or ""].update(set(own))
        total[lang or ""].update(own)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in seen}:
        kept = [t for t, n in docs_of[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for (x, s), c in seen.items() if x == lang}
        q = share(total[lang])
        for s in p:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            high = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if seen[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(high)[:top])]
    return sorted(out)


def test_audit_is_that_of_all_pairs(docs, rows):
    want = audited(rows, 10, 10)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    assert sorted(map(tuple, divergence.audit(docs, part_bytes=40).collect())) == want
    assert sorted(map(tuple, divergence.audit(docs, least_docs=2, top=3).collect())) == audited(rows, 2, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_light_and_heavy_terms_add_up_to_all():
    rng = np.random.default_rng(1)
    n_groups, n_terms = 23, 400
    none = rng.integers(1, 50, n_groups)
    wide = rng.integers(1, n_groups + 1, n_terms) // rng.choice([1, 4, 9], n_terms)
    own = [np.sort(rng.choice(n_groups, max(1, w), replace=False)) for w in wide]
    term, g = np.repeat(np.arange(n_terms), [len(x) for x in own]), np.concatenate(own)
    p = rng.integers(1, 10**9, len(g))
    whole = np.repeat(none[:, None], n_terms, axis=1)
    whole[g, term] = p
    want = np.array([[((whole[a] - whole[b]) ** 2 // (whole[a] + whole[b])).sum() for b in range(n_groups)] for a in range(n_groups)])
    above = np.triu(np.ones((n_groups, n_groups), bool), 1)
    got = divergence.pair_sums(term, g, p, none, 0, n_groups)
    assert (got[above] == want[above]).all()
    parts = np.vstack([divergence.pair_sums(term, g, p, none, a, min(a + 5, n_groups)) for a in range(0, n_groups, 5)])
    assert (parts[above] == want[above]).all()


def test_shares_of_very_large_counts_are_exact():
    counts, base = np.array([3, 5 * 10**12]), np.array([7, 9 * 10**12])
    assert divergence.shares(counts, base).tolist() == [1 + 10**9 * 5 // 7, 1 + 10**9 * (5 * 10**12 + 2) // (9 * 10**12)]
