"""Language of each word by a linear-chain conditional random field, and of each document by its words.

Words are runs of letters (ASCII letters and all non-ASCII bytes). A word's score for a language is the sum
of learned weights of its affixes (one to three bytes at either end), its byte 2- and 3-grams and, for the
words that are frequent in the sample, the word itself (the lexicon); learned transitions tie neighbours. Forward-
backward gives each word's posterior, so a text that switches languages is labelled word by word; a
document's language is the one with the largest sum of posteriors, its score that sum's mean.

The field is fitted on at most `per_lang` labelled documents of a language, drawn by a hash of doc_id over all
training rows, and on at most `STRETCHES` stretches of each, drawn over its whole text and cut out where the text is;
they are spliced into sequences that switch language every few dozen words. Forward-backward runs on
segments of all documents of a batch at once: segment products first, then along each document, then inside.
A very long text goes through in chunks: one pass carries the chunks' products along, a second gives the posteriors
between the messages from both sides, so memory is a chunk's and the result that of the whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows (an empty table among them)
every other document is `und` too; ties go to the language that sorts first; repeated rows are labelled each for itself; `identify`
ignores extra columns, and `with_language` keeps all but those that bear the name of one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import columns_apart, frugal
from .words import hashed, slices, utf8

BITS = 16
SEGMENT = 32
#: Labelled documents of a language that the field is fitted on at most, stretches of each, and a stretch's bytes, about.
PER_LANG, STRETCHES, STRETCH = 150, 32, 400
#: Bytes of text labelled at once, about, and beyond which one text goes through in such chunks.
CHUNK, LONG = 1 << 18, 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and each row's first word (one more than rows)."""
    return _found(*utf8(column))


def _found(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = _LOWER[raw]
    if len(data) > 1:  # Latin-1 capitals
        data[1:] += np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97), 32, 0).astype(np.uint8)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(rows), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    solid = _LETTER[raw]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    stop[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return data, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, rows, side="left")


def _slot(kind: int, h: np.ndarray) -> np.ndarray:
    """A place in the weights."""
    return ((h * np.uint32(0x9E3779B1) + np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)).astype(np.int32)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One place a word for each affix kind and the lexicon; places of n-grams of all words in a row, and where each word's start."""
    size = ends - starts
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    single = []
    for k in (1, 2, 3):
        head, tail = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
        for j in range(k):
            there = size > j
            head = head * np.uint32(257) + np.where(there, wide[starts + j], 0).astype(np.uint32)
            tail = tail * np.uint32(257) + np.where(there, wide[np.maximum(ends - 1 - j, 0)], 0).astype(np.uint32)
        single += [_slot(2 * k, head), _slot(2 * k + 1, tail)]
    h = hashed(data, starts, ends)
    at = np.minimum(np.searchsorted(lexicon, h), max(0, len(lexicon) - 1))
    known = lexicon[at] == h if len(lexicon) else np.zeros(len(h), bool)
    single.append(np.where(known, (1 << BITS) + at, (1 << BITS) + len(lexicon)).astype(np.int32))
    # from each byte of a word: it and the next, and the two after; a word's end counts as a letter
    first = np.concatenate([[0], np.cumsum(size)])
    byte = np.repeat((starts - first[:-1]).astype(np.int32), size) + np.arange(int(first[-1]), dtype=np.int32)
    left = np.repeat(ends.astype(np.int32), size) - byte
    a = wide[byte]
    b = np.where(left > 1, wide[byte + 1], 0).astype(np.uint32)
    c = np.where(left > 2, wide[byte + 2], 0).astype(np.uint32)
    two = _slot(8, a * np.uint32(257) + b)
    three = _slot(9, (a * np.uint32(257) + b) * np.uint32(257) + c)
    return single, np.stack([two, three], axis=1), first


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # places x languages
    transitions: np.ndarray  # log scores, from x to
    lexicon: np.ndarray  # sorted hashes

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        single, grams, first = features(data, starts, ends, self.lexicon)
        k = len(self.languages)
        out = np.zeros((len(starts), k), np.float32)
        for s in single:
            out += self.weights[s]
        if len(starts):
            both = self.weights[grams[:, 0]] + self.weights[grams[:, 1]]
            out += np.add.reduceat(both, first[:-1], axis=0)
        return out


def _products(scores: np.ndarray, rows: np.ndarray, transitions: np.ndarray):
    """Segments of `SEGMENT` words of each row: emissions, which steps are real, each row's first segment (one more), each word's place, moves, and products of each segment."""
    n, k = scores.shape
    counts = np.diff(rows)
    parts = -(-counts // SEGMENT)
    part_at = np.concatenate([[0], np.cumsum(parts)])
    total = int(part_at[-1])
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n) - rows[row]
    part, step = part_at[row] + inside // SEGMENT, inside % SEGMENT
    emit = np.ones((SEGMENT, total, k), np.float32)
    emit[step, part] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    real = np.zeros((SEGMENT, total), bool)
    real[step, part] = True
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    for t in range(SEGMENT):
        new = (product.reshape(-1, k) @ move).reshape(total, k, k) * emit[t][:, None, :]
        product = _held(real[t], new / new.sum(axis=(1, 2), keepdims=True), product)
    return emit, real, part_at, (part, step), move, product


def _held(real: np.ndarray, new: np.ndarray, old: np.ndarray) -> np.ndarray:
    return new if real.all() else np.where(real.reshape(-1, *[1] * (new.ndim - 1)), new, old)


def posteriors(scores: np.ndarray, rows: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each word's posterior, and expected transitions of all (from x to; first words of rows come from a uniform state).

    before, after: the messages into the first and out of the last word, where the rows are one chunk of a longer text.
    """
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k), np.float32), np.zeros((k, k))
    emit, real, part_at, (part, step), move, product = _products(scores, rows, transitions)
    total, parts = len(product), np.diff(part_at)
    into, out_of = np.full((total, k), 1 / k, np.float32), np.ones((total, k), np.float32)
    if before is not None:
        into[0], out_of[-1] = before, after
    for j in range(1, int(parts.max())):
        p = part_at[:-1][parts > j] + j
        a = np.einsum("ij,ijk->ik", into[p - 1], product[p - 1])
        into[p] = a / a.sum(axis=1, keepdims=True)
        q = part_at[1:][parts > j] - 1 - j
        b = np.einsum("ijk,ik->ij", product[q + 1], out_of[q + 1])
        out_of[q] = b / b.sum(axis=1, keepdims=True)
    forward = np.empty((SEGMENT + 1, total, k), np.float32)
    forward[0] = into
    for t in range(SEGMENT):
        new = (forward[t] @ move) * emit[t]
        forward[t + 1] = _held(real[t], new / new.sum(axis=1, keepdims=True), forward[t])
    gamma = np.empty((SEGMENT, total, k), np.float32)
    expected, back = np.zeros((k, k)), out_of
    for t in range(SEGMENT - 1, -1, -1):
        g = forward[t + 1] * back
        gamma[t] = g / g.sum(axis=1, keepdims=True)
        ahead = emit[t] * back
        joint = forward[t][:, :, None] * move * ahead[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True))[real[t]].sum(axis=0)
        new = ahead @ move.T
        back = _held(real[t], new / new.sum(axis=1, keepdims=True), back)
    return gamma[step, part], expected


def _chunks(raw: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Cuts of a text between words, at the first sign that is no letter from every `size` bytes on."""
    out, at = [], 0
    while at < len(raw):
        to = at + size
        while to < len(raw) and _LETTER[raw[to]]:
            gap = np.flatnonzero(~_LETTER[raw[to : to + size]])
            to += int(gap[0]) if len(gap) else size
        out.append((at, min(to, len(raw))))
        at = to
    return out


def long_text(field: Field, raw: np.ndarray, size: int) -> tuple[np.ndarray, float, int]:
    """Sums over all words of the posteriors and of the best of each, and the number of words, of one text in chunks of about `size` bytes."""
    k = len(field.languages)

    def scored(a: int, z: int) -> np.ndarray:
        data, starts, ends, _ = _found(raw[a:z], np.array([0, z - a]))
        return field.scores(data, starts, ends)

    cuts, steps = _chunks(raw, size), []
    for a, z in cuts:
        scores, whole = scored(a, z), np.eye(k)
        if len(scores):
            for m in _products(scores, np.array([0, len(scores)]), field.transitions)[-1]:
                whole = whole @ m
                whole /= whole.sum()
        steps.append(whole)
    after = [np.ones(k)]
    for m in reversed(steps):
        b = m @ after[-1]
        after.append(b / b.sum())
    mass, sure, n, before = np.zeros(k), 0.0, 0, np.full(k, 1 / k)
    for j, (a, z) in enumerate(cuts):
        scores = scored(a, z)
        post, _ = posteriors(scores, np.array([0, len(scores)]), field.transitions, before, after[len(cuts) - 1 - j])
        mass += post.sum(axis=0, dtype=np.float64)
        sure += float(post.max(axis=1).sum(dtype=np.float64)) if len(post) else 0.0
        n += len(post)
        before = before @ steps[j]
        before /= before.sum()
    return mass, sure, n


def fit(texts: list[str], langs: list[str], epochs: int = 5, seed: int = 3) -> Field:
    """The field that maximises the conditional likelihood of spliced sequences, by Adam on small batches."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    k = len(languages)
    data, starts, ends, rows = words(pa.array(texts, pa.string()))
    label = np.repeat(np.array([languages.index(x) for x in langs], np.int64), np.diff(rows)) if len(texts) else np.zeros(0, np.int64)
    h = hashed(data, starts, ends)
    seen, n = np.unique(h, return_counts=True)
    lexicon = np.sort(seen[n >= 20])
    # runs of one document's words, shuffled: neighbours are mostly of different languages
    runs = []
    for a, z in zip(rows[:-1], rows[1:]):
        while a < z:
            e = min(z, a + int(rng.integers(5, 80)))
            runs.append((a, e))
            a = e
    order = rng.permutation(len(runs))
    field = Field(languages, np.zeros(((1 << BITS) + len(lexicon) + 1, k), np.float32), np.zeros((k, k)), lexicon)
    if k < 2 or not runs:
        return field
    single, grams, first = features(data, starts, ends, lexicon)
    places = len(field.weights)
    m, v = np.zeros_like(field.weights), np.zeros_like(field.weights)
    tm, tv, clock = np.zeros((k, k)), np.zeros((k, k)), 0
    batches = np.array_split(order, max(1, len(order) // 400))
    for _ in range(epochs):
        for batch in batches:
            pick = np.concatenate([np.arange(*runs[i]) for i in batch])
            size = np.diff(first)[pick]
            row = np.repeat(np.arange(len(pick)), size)
            ahead = np.concatenate([[0], np.cumsum(size)])
            g = grams[first[pick][row] + (np.arange(int(ahead[-1])) - ahead[row])]
            scores = sum(field.weights[s[pick]] for s in single) + np.add.reduceat(field.weights[g[:, 0]] + field.weights[g[:, 1]], ahead[:-1], axis=0)
            post, expected = posteriors(scores, np.array([0, len(pick)]), field.transitions)
            truth = label[pick]
            error = -post
            error[np.arange(len(pick)), truth] += 1
            observed = np.zeros((k, k))
            np.add.at(observed, (truth[:-1], truth[1:]), 1)
            observed[:, truth[0]] += 1 / k
            grad = np.empty_like(field.weights)
            for j in range(k):
                e = error[:, j]
                grad[:, j] = sum(np.bincount(s[pick], e, places) for s in single)
                spread = e[row]
                grad[:, j] += np.bincount(g[:, 0], spread, places) + np.bincount(g[:, 1], spread, places)
            clock += 1
            rate = 0.05
            for x, d, mean, square in ((field.weights, grad / len(pick) - 1e-6 * field.weights, m, v), (field.transitions, (observed - expected) / len(pick), tm, tv)):
                mean *= 0.9
                mean += 0.1 * d
                square *= 0.99
                square += 0.01 * d * d
                x += rate * (mean / (1 - 0.9**clock)) / (np.sqrt(square / (1 - 0.99**clock)) + 1e-8)
    return field


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _drawn(seed: int):
    """Stretches of each text between signs that are no letters: all of a short text, else `STRETCHES` drawn from the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text")):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                n = -(-len(raw) // STRETCH)
                picked = range(n) if n <= STRETCHES else sorted(np.random.default_rng([seed, doc_id & (1 << 64) - 1]).choice(n, STRETCHES, replace=False).tolist())
                for j in picked:
                    a, z = (_gap(raw, x * STRETCH) for x in (j, j + 1))
                    if a < z:
                        rows.append((doc_id, lang, a, raw[a:z].tobytes().decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["doc_id", "lang", "place", "text"])

    return run


def _gap(raw: np.ndarray, at: int) -> int:
    """The first sign that is no letter from here on; at most two stretches further, as a text may have none."""
    if not at or at >= len(raw):
        return min(at, len(raw))
    found = np.flatnonzero(~_LETTER[raw[at : at + 2 * STRETCH]])
    return min(at + (int(found[0]) if len(found) else 2 * STRETCH), len(raw))


def sample(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 5) -> tuple[list[str], list[str]]:
    """Stretches of text and their languages to learn from: of at most `per_lang` documents of each, by a hash over all that may be used.

    What reaches the driver is at most `per_lang` times `STRETCHES` stretches of three times `STRETCH` bytes a language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.select("doc_id", "lang", (F.xxhash64(F.lit(seed), "doc_id") / F.lit(2.0**64) + 0.5).alias("u"))
    counts = ids.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    few = ids.join(F.broadcast(counts), F.col("lang") == F.col("l"))  # a row a language, as the field has a column for each
    few = few.where(F.col("u") * F.col("n") <= 2 * per_lang)
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("r") <= per_lang)
    wanted = sorted({r.doc_id for r in chosen.select("doc_id").collect()})
    if not wanted:
        return [], []
    cut = usable.where(F.col("doc_id").isin(wanted)).select("doc_id", "lang", "text").mapInArrow(frugal(_drawn(seed)), "doc_id bigint, lang string, place bigint, text string")
    rows = sorted(cut.distinct().collect(), key=lambda r: (r.doc_id, r.lang, r.place, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def _predicted(field: Field):
    k = max(1, len(field.languages))

    def sums(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sums of its words' posteriors, and of the best of each, number of words, whether it has an ASCII letter."""
        raw, at = utf8(texts)
        if len(texts) == 1 and len(raw) > LONG and field.languages:
            mass, sure, n = long_text(field, raw, CHUNK)
            return mass[None, :], np.array([sure]), np.array([n]), np.array([bool((_LETTER[raw] & (raw < 128)).any())])
        data, starts, ends, rows = _found(raw, at)
        post = posteriors(field.scores(data, starts, ends), rows, field.transitions)[0] if field.languages else np.zeros((len(starts), 1), np.float32)
        total = np.concatenate([np.zeros((1, k)), np.cumsum(post, axis=0, dtype=np.float64)])
        sure = np.concatenate([[0], np.cumsum(post.max(axis=1), dtype=np.float64)])
        letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        return total[rows[1:]] - total[rows[:-1]], sure[rows[1:]] - sure[rows[:-1]], np.diff(rows), letter[at[1:]] > letter[at[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", CHUNK):
                texts = b.column("text")
                mass, sure, n, ascii_letter = sums(texts)
                best = mass.argmax(axis=1)
                score = np.clip(mass[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
                sure = np.clip(sure / np.maximum(n, 1), 0, 1)
                none = n == 0
                for i in np.flatnonzero(~none & ~ascii_letter):  # its runs may be signs outside ASCII only
                    none[i] = not any(c.isalpha() for c in texts[int(i)].as_py())
                none |= np.array(not field.languages)
                lang = [("und" if x else field.languages[j]) for x, j in zip(none, best)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, 0.0, sure))], names=["doc_id", "lang_pred", "score", "certainty"])

    return run


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score; only rows that are not held out were learned from."""
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "lang": ("lang", "string"), "text": ("text", "string")})
    field = fit(*sample(docs, per_lang))
    out = docs.select("doc_id", "text").mapInArrow(frugal(_predicted(field)), "doc_id bigint, lang_pred string, score double, certainty double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def label_words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and the posterior of that."""
    data, starts, ends, rows = words(pa.array([text], pa.string()))
    post, _ = posteriors(field.scores(data, starts, ends), rows, field.transitions)
    best = post.argmax(axis=1)
    return [(data[a:z].tobytes().decode("utf-8", "replace"), field.languages[j], float(p[j])) for a, z, j, p in zip(starts, ends, best, post)]


def _labelled(field: Field, at: int):
    """at: which part of the row is its text."""
    predict = _predicted(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = rows.flatten()[at].cast(pa.string())
            own = pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), texts], names=["doc_id", "text"])
            first = 0
            for p in predict(iter([own])):
                yield pa.RecordBatch.from_arrays([rows.slice(first, p.num_rows), p.column("lang_pred"), p.column("score"), p.column("certainty")], names=["row", "lang_pred", "score", "certainty"])
                first += p.num_rows

    return run


def with_language(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """`docs`, all columns, and of each row lang_pred, score (that language's share) and certainty (the mean of each word's best posterior): the rows pass through the labelling, so nothing is joined."""
    own = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "lang": ("lang", "string"), "text": ("text", "string")})
    field = fit(*sample(own, per_lang))
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "certainty")]
    body = docs.select(F.struct(*(docs[c] for c in rest)).alias("row"))
    schema = T.StructType([*body.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())])
    return body.mapInArrow(frugal(_labelled(field, [c.lower() for c in rest].index("text"))), schema).select("row.*", "lang_pred", "score", "certainty")
