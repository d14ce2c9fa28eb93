"""Each operator against a brute-force version on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from passagework.llm import chat_format, components, exact_dedup, html_extract, importance_resampling, language_id, mixing, ngram_join, packing, quality_rules, span_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, sha string, id long, row string, key string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = {"en": ["the", "and", "thing", "with", "from", "ofthe", "shing", "ward"], "fr": ["le", "réeau", "eaux", "où", "très", "dans", "ment", "çela"], "de": ["und", "der", "über", "schaft", "größe", "nicht", "keit", "ung"]}
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        text = ". ".join(" ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "er", "a", "on"]) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 14)))
        rows.append((i, text, lang, f"s{i % 4}" if i % 7 else None))
    for i in range(60):  # exact copies up to white space, near copies
        base = rows[i * 3]
        w = base[1].split(" ")
        rows.append((240 + 2 * i, "\t".join(w) if i % 2 else base[1] + " ", base[2], base[3]))
        if len(w) > 80:
            w[len(w) // 2] = "changed"
        rows.append((241 + 2 * i, " ".join(w), base[2], base[3]))
    hot = "same copy everywhere. " * 4
    rows += [(1000 + i, hot, "en", "s1") for i in range(90)]
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, " \n\t ", "en", "s0"), (2003, "12 34 !!", "en", "s0"), (2004, "long " * 30_000, "en", "s2"), (2005, "a b", "fr", "s3"), (2006, "a b", "fr", "s3"), (None, "no id here", "en", "s0")]
    rows += [rows[5], rows[5]]
    return [(*r, len(r[1] or ""), "x", "y", 7, "z", "k") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, corpus):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    by = defaultdict(list)
    for r in corpus:
        by[norm(r[1])].append(r[0])
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(corpus)
    first = {hashlib.sha256(t.encode()).hexdigest(): (min((x for x in ids if x is not None), default=None), len(ids)) for t, ids in by.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == first[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter(norm(r.text) for r in left.collect()) == Counter(dict.fromkeys(by, 1))


def test_rice_code_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        values = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        k, code, unary = exact_dedup.rice_encode(values, 0)
        assert (exact_dedup.rice_decode(code, k, unary, len(values), 0) == values).all()
    assert len(code) < 8 * n


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, links


def test_ngram_join(docs, corpus):
    rows = {r[0]: r[1] for r in corpus}
    root, links = brute_classes(rows.items())
    got = {r.doc_id: r for r in ngram_join.classes(docs.where("doc_id is null or doc_id <> 5")).collect()}
    for i, r in got.items():
        if i is not None:
            assert r.class_id == root[i], i
            assert r.n_links == links[i] - (rows[i] == rows[5]) or i == 5 or links[i] - r.n_links <= 1, i
    left = ngram_join.one_of_each(docs)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and None in kept
    assert {root[i] for i in kept if i is not None} == set(root.values()) and len(kept) == len(set(root.values())) + 1


def test_ngram_join_of_a_large_group(spark):
    """Near copies by the hundred meet in blocks; links and classes are those of brute force."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(200)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    root, links = brute_classes(rows)
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].class_id == root[i] for i in root)
    found = sum(r.n_links for r in got.values())
    assert found <= sum(links.values()) and found >= 0.99 * sum(links.values())


def test_ngram_join_of_borderline_pairs_beside_a_large_group(spark):
    """A large group of near copies does not shorten the reach of pairs that are just above the threshold."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    hot, rows = prose(300), []
    for i in range(600):
        w = list(hot)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(150):  # 176 of 216 shingles are common
        w = prose(200)
        rows.append((1000 + 2 * i, " ".join(w)))
        for place in (25, 75, 125, 175):
            w[place] = f"y{i}"
        rows.append((1001 + 2 * i, " ".join(w)))
    got = {r.doc_id: r for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[1001 + 2 * i].class_id == 1000 + 2 * i and got[1001 + 2 * i].n_links == 1 for i in range(150))
    assert all(got[i].class_id == 0 for i in range(600))
    for threshold in (0.7, 0.8, 0.9):
        assert ngram_join.met(threshold, ngram_join.prefix_length(threshold, 0.995)) >= 0.995


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == 100


def test_mixing(docs, corpus):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None]
    goals = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    assert sum(goals.values()) == pytest.approx(sum(sizes.values())) and all(goals[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    source = {r[0]: r[3] for r in corpus}
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        rest, reach = goals[s] - goals[s] // sizes[s] * sizes[s], 1
        for r in corpus:
            if r[3] == s:
                reach |= reach << len(words(r[1]))
        nearest = min(abs(rest - i) for i in range(reach.bit_length()) if reach >> i & 1)
        assert abs(goals[s] - taken[s]) <= nearest + 1, (s, goals[s], taken[s])
    out = Counter()
    for r in mixing.mixed(docs).collect():
        out[r.source] += len(words(r.text))
    assert out == Counter({k: v for k, v in taken.items() if v})


def test_subset_sums_are_exact_where_they_can_be():
    rng = random.Random(3)
    for _ in range(40):
        lengths = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(1, 8))}
        budget = rng.randint(0, 150)
        reach = {0}
        for k, n in lengths.items():
            reach = {a + k * j for a in reach for j in range(n + 1)}
        take = mixing.subset(lengths, budget)
        assert all(0 <= take[k] <= lengths[k] for k in lengths)
        total = sum(k * n for k, n in take.items())
        assert abs(total - budget) == min(abs(x - budget) for x in reach)
    assert mixing.targets([10, 0, 100]) == [pytest.approx(27.5), 0.0, pytest.approx(82.5)]  # the second's share goes to the others as 1 to 3


def test_subset_does_not_prefer_short_or_long_documents():
    rng = random.Random(5)
    for seed in range(3):
        sizes = sorted(int(rng.lognormvariate(5.5, 1)) + 1 for _ in range(3000))
        lengths = Counter(sizes)
        take = mixing.subset(lengths, sum(sizes) // 2, seed)
        assert sum(k * n for k, n in take.items()) == sum(sizes) // 2
        for low, high in ((0, 25), (25, 50), (50, 75), (75, 90), (90, 100)):
            part = [k for k in lengths if sizes[30 * low] < k <= sizes[30 * high - 1]]
            assert 0.4 < sum(take[k] for k in part) / sum(lengths[k] for k in part) < 0.6, (seed, low)


def test_packing(docs, corpus):
    from passagework.llm.queries import tokenizer_files
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_files()[0])
    odd = docs.sparkSession.createDataFrame([(3000, "a  b\n\n c <|endoftext|> 語 don't \t x "), (3001, " lead"), (3002, "tail\n"), (3003, " x \x1c y z")], "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(odd)
    packed = packing.pack(whole, *tokenizer_files(), room=64).cache()
    rows = packed.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in whole.collect():
        texts[r.doc_id].append(r.text or "")
    for i, ts in texts.items():
        if len(ts) > 1 or i is None:
            continue
        pieces = sorted(by[i], key=lambda r: r.piece)
        raw = b"".join(bytes(r.ids) for r in pieces)
        ids = [int.from_bytes(raw[j : j + 4], "little") for j in range(0, len(raw), 4)]
        assert ids == exact.encode(ts[0], add_special_tokens=False).ids + [0], i
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:j]) for j in range(len(pieces))]
        assert all(r.length == 64 for r in pieces[1:]) and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in pieces)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 64 + 2
    assert packing.sequences(packed).agg(F.sum("length")).first()[0] == sum(r.length for r in rows)


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
        free, used = [], 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((f for f in free if f >= length), default=None)
                if fit is None:
                    used, fit = used + 1, 40
                else:
                    free.remove(fit)
                free.append(fit - length)
        plan = packing.best_fit(counts, 40)
        assert len({first + j // each for _, _, each, first, _, n in plan for j in range(n)}) == used
        assert Counter({k: sum(p[5] for p in plan if p[0] == k) for k in counts}) == Counter(counts)


def test_quality_statistics(docs, corpus):
    got = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    for r in corpus:
        text, w = r[1] or "", words(r[1])
        g = got[r[0]]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = set()
        for i, t in enumerate(zip(w, w[1:], w[2:])):
            if seen[t] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if words(x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), r[0]


def test_quality_rules_keep_their_promise(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        text = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" + ("" if good and rng.random() < 0.999 else "###$$$%%%") for _ in range(60))
        rows.append((i, text, "en" if i % 2 else None))
        labels.append((i, int(good)))
    out, chosen = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert sum(not kept[i] for i, q in labels if q) <= 0.02 * sum(q for _, q in labels)
    assert sum(kept[i] for i, q in labels if not q) == 0
    assert quality_rules.at_most(0, 100, 0.05) == pytest.approx(0.95**100)
    none, _ = quality_rules.judge(spark.createDataFrame(rows[:50], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.where("kept").count() == 50


def test_quality_cutoffs_are_those_of_brute_force():
    """Walks every stratum's family with exact fractions; strata of few labels, of none lost, of some lost at each step."""
    from fractions import Fraction
    from math import comb

    import pandas as pd

    rng, rows = random.Random(12), []
    for stratum, n, lossy in (("en", 900, 0.03), ("de", 400, 0.0), ("fr", 216, 0.0), (None, 260, 0.01)):
        rows += [(stratum, rng.randrange(quality_rules.STEPS) if rng.random() < lossy else quality_rules.STEPS) for _ in range(n)]
    good = pd.DataFrame(rows, columns=["stratum", "step"]).value_counts(dropna=False).reset_index(name="n")
    got = {None if r.stratum != r.stratum else r.stratum: (r.n_good, r.step, r.lost) for r in quality_rules.chosen_steps(good, 0.02, 0.05).itertuples()}
    p, want = Fraction(2, 100), {}
    for stratum in ("en", "de", "fr", None):
        own = [s for x, s in rows if x == stratum]
        step = -1
        for j in range(quality_rules.STEPS):
            k = sum(s <= j for s in own)
            if sum(comb(len(own), i) * p**i * (1 - p) ** (len(own) - i) for i in range(k + 1)) > Fraction(5, 400):
                break
            step = j
        want[stratum] = (len(own), step, sum(s <= step for s in own))
    assert got == want and want["fr"][1] == -1 and want["de"][1] == quality_rules.STEPS - 1 and 0 < want["en"][1] < quality_rules.STEPS - 1


def test_quality_labels_of_a_repeated_id_agree_on_reruns(spark):
    """Two texts of one doc_id: the one that is lost first stands for it, whatever the order of rows."""
    fine, bad = " ".join(f"word{i}" for i in range(60)), " ".join(f"w##{i}" for i in range(60))
    docs = [(i, t, "en") for i in range(300) for t in (fine, bad)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    steps = [quality_rules.judge(spark.createDataFrame(d, "doc_id long, text string, lang string"), labels)[1].step.tolist() for d in (docs, docs[::-1])]
    assert steps[0] == steps[1] and 0 <= steps[0][0] < quality_rules.STEPS - 1


def test_language_id(docs, corpus):
    got = language_id.identify(docs).collect()
    lang = {r[0]: r[2] for r in corpus}
    texts = {r[0]: r[1] for r in corpus}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert r.lang_pred == "und"
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_each_word():
    import numpy as np

    en, fr = "the and thing with from shing ward ".split(), "le réeau eaux où très dans ment ".split()
    rng = random.Random(1)
    field = language_id.fit([" ".join(rng.choices(en, k=60)) for _ in range(40)] + [" ".join(rng.choices(fr, k=60)) for _ in range(40)], ["en"] * 40 + ["fr"] * 40)
    mixed = " ".join(rng.choices(en, k=40) + rng.choices(fr, k=40))
    labels = [x[1] for x in language_id.label_words(mixed, field)]
    assert labels.count("en") == 40 and labels[:40].count("en") >= 39
    scores, t = rng_scores(np), np.array([[0.5, -1.0], [-0.3, 0.2]])
    post, _ = language_id.posteriors(scores, np.array([0, 7, 7, 100]), t)
    for a, z in ((0, 7), (7, 100)):
        assert np.allclose(post[a:z], forward_backward(np, scores[a:z], t), atol=1e-4)


def test_pipeline_keeps_texts_in_several_languages(spark):
    import corpus_pipeline

    rng = random.Random(4)
    pools = {"en": "the and thing with from shing ward".split(), "fr": "le réeau eaux où très dans ment".split(), "de": "und der über schaft größe nicht keit".split()}
    rows = [(i, " ".join(rng.choices(pools[x], k=60)), x) for i in range(120) for x in [("en", "fr", "de")[i % 3]]]
    rows += [(1000 + i, " ".join(w for x in pools for w in rng.choices(pools[x], k=40)), "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.by_language(spark, docs, "").where("doc_id >= 1000").count() == 5


def rng_scores(np):
    return np.random.default_rng(0).normal(size=(100, 2)).astype(np.float32)


def forward_backward(np, s, t):
    a, b = np.zeros((len(s), 2)), np.ones((len(s), 2))
    v = np.full(2, 0.5)
    for i in range(len(s)):
        v = (v @ np.exp(t)) * np.exp(s[i])
        v /= v.sum()
        a[i] = v
    for i in range(len(s) - 2, -1, -1):
        b[i] = np.exp(t) @ (np.exp(s[i + 1]) * b[i + 1])
        b[i] /= b[i].sum()
    g = a * b
    return g / g.sum(axis=1, keepdims=True)


def test_span_dedup(spark):
    passage = "This passage has many words in its first sentence to count. The second sentence also has quite a few words inside it. And here the third one ends the whole passage now."
    rows = [(1, f"Own start. {passage} Own end of one."), (2, f"Other start here.\n{passage}\nOther end."), (3, "A clean text with nothing. Nothing is shared. At all."), (4, None), (5, ""), (None, passage), (6, passage)]
    got = {r.doc_id: r for r in span_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1))).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "Other start here.\nOther end." and got[2].n_removed == 3
    assert got[3].text == rows[2][1] and got[4].text == "" and got[None].text == passage and got[6].text == ""


def test_span_dedup_of_passages_inside_sentences(spark):
    """Passages of 51 to 60 words, with few sentence ends or none, in the middle of a host's sentence."""
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows, wanted = [], {}
    for i, n in enumerate(range(51, 61)):
        w = prose(n).split(" ")
        for end in ([], [22], [4, 50], [10, 25, 40])[i % 4]:
            w[end] += "."
        passage = " ".join(w)
        rows.append((i, f"{prose(30)} {passage} {prose(9)}. {prose(20)}."))
        before, after = f"{prose(7)}. {prose(12)}", f"{prose(40)}. {prose(5)}."
        rows.append((100 + i, f"{before} {passage} {after}"))
        wanted[i], wanted[100 + i] = rows[-2][1], f"{before} {after}"
    short = prose(40)
    rows += [(300 + i, f"{prose(9)} {short} {prose(9)}") for i in range(2)] + [(400, "same " * 300)]
    got = {r.doc_id: r for r in span_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].text for i in wanted} == wanted
    assert all((got[i].n_removed > 0) == (i >= 100) for i in wanted) and all(got[i].text == t and got[i].n_removed == 0 for i, t in rows if i >= 300)


def test_sentences_end_at_closing_quotes():
    import numpy as np

    text = "He said (so it is.) Then \u201cno!\u201d and \u00abyes?\u00bb or 'x.') but not) \u201d end".encode()
    data = np.frombuffer(text, np.uint8)
    first = span_dedup.sentences(data, np.array([0, len(text)]))[3]
    assert first.tolist() == [0, 5, 7, 9, 11, 15]


def test_importance_resampling(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["good", "fine", "prose", "text"] if i % 2 else ["###", "$$$", "%%%"], k=50))) for i in range(400)]
    frame = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    out = {r.doc_id: r for r in importance_resampling.resample(frame, target, keep=0.5).collect()}
    assert sum(r.kept for r in out.values()) == 201 and not out[900].kept and sum(out[i].kept for i in range(1, 400, 2)) == 200
    values = spark.createDataFrame([(float(v),) for v in (5, 3, 3, 3, 1)], "v double")
    assert [importance_resampling.kth_largest(values, "v", k) for k in (1, 2, 4, 5)] == [5, 3, 3, 1]
    assert importance_resampling.kth_largest(spark.range(20000).select(F.col("id").cast("double").alias("v")), "v", 777) == 19223


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <!-- c --><div class="ad">Buy</div><article><h1>Head</h1><p>One &amp; two<b>three</b>
    four<br>five<p>Next &eacute; &#8364;</p><div class="comments"><p>nice</p></div><script>var t="</p>";</script><form>x</form></article><aside>side</aside><footer>&copy; me</footer><p unclosed"""
    assert html_extract.main_text(page) == "Head\n\nOne & twothree four five\n\nNext é €"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    prose = "This is the text of a page that has no article element, and it is long enough with the words that are in it to be the main text of the page for the reader. " * 2
    plain = f"<div>{prose}</div><p>Short but inside.</p><div>{prose}</div><p><a href=x>link one</a> <a>link two</a></p><p>After</p>"
    assert html_extract.main_text(plain).split("\n\n") == [prose.strip(), "Short but inside.", prose.strip()]
    assert html_extract.main_text("<p>a <" * 3 + "<b") is not None


def test_chat(spark):
    own = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", own), (-7, 1, "assistant", own), (1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x: <y> #\\"), (2, 1, "assistant", ""), (None, 0, "assistant", "z")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i} ###") for i in range(400)]
    formatted = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()


def test_templates_that_rewrite_history_are_found():
    counted = lambda turns: f"{len(turns)} turns\n" + "".join(f"{r}>{t}\n" for r, t in turns)
    only_last = lambda turns: "".join(f"{r}>{t if i == len(turns) - 1 else t.split('#')[-1]}\n" for i, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "think#b"), ("user", "c")]
    assert chat_format.spans(turns, counted)[1] is None and chat_format.spans(turns, only_last)[1] is None
    plain = lambda turns: "".join(f"<{r}>{t}</>" for r, t in turns)
    text, found = chat_format.spans(turns * 100, plain, window=16)
    assert text == plain(turns * 100) and [text[a:z] for _, _, a, z in found] == [t for _, t in turns] * 100


def test_templates_that_look_back_beyond_the_window():
    plain = lambda turns: "".join(f"<{r}>{t}</>" for r, t in turns)
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    recent = lambda turns: plain(turns[-200:])
    assert chat_format.spans(turns, recent) == (recent(turns), None)
    numbered = lambda turns: "".join(f"{i}<{r}>{t}</>" for i, (r, t) in enumerate(turns))

    def opened(turns):
        if turns and turns[0][1] not in ("t0", ""):
            raise ValueError("the first turn is missing")
        return plain(turns)

    for render in (numbered, opened):
        text, found = chat_format.spans(turns, render)
        assert text == render(turns) and [text[a:z] for _, _, a, z in found] == [t for _, t in turns]


@pytest.mark.parametrize("run", [
    exact_dedup.groups, exact_dedup.deduplicated, ngram_join.classes, ngram_join.one_of_each, mixing.mix, mixing.mixed, quality_rules.statistics, language_id.identify, language_id.with_language, span_dedup.without_repeats,
    lambda d: importance_resampling.resample(d, d.select("doc_id")), lambda d: html_extract.extract(d.selectExpr("doc_id as page_id", "text as html")), lambda d: chat_format.format_chats(d),
])
def test_empty_tables(run, empty):
    assert run(empty).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {name: [r.doc_id for r in spark.read.parquet(str(tmp_path / name)).collect()] for name, _ in corpus_pipeline.STAGES[:-1]}
    lettered = [r for r in corpus if any(c.isalpha() for c in r[1] or "")]
    assert len(ids["language"]) >= 0.98 * len(lettered) and not set(ids["language"]) & {2000, 2001, 2002, 2003}
    norm = {re.sub("[\x20\x09-\x0d]+", " ", r[1]) for r in lettered if r[0] in set(ids["language"])}
    assert len(ids["exact_dedup"]) == len(norm)
    rows = {r[0]: r[1] for r in corpus if r[0] in set(ids["exact_dedup"]) and r[0] is not None}
    assert {i for i in ids["near_dedup"] if i is not None} == set(brute_classes(rows.items())[0].values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] > 0
