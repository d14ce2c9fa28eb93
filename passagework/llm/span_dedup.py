"""Removal of passages that other documents have too: runs of consecutive sentences, and runs of words wherever they sit.

Words are `[^\\x20\\x09-\\x0D]+`, parted also after `。`, `！` and `？`; a sentence ends there, with a word that ends in `.`, `!` or `?`
(closing quotes and brackets may follow), or at a line feed. From every sentence starts a run of `SENTENCES` consecutive ones, however
short. Runs are joined by their hash over all documents; of equal runs the first, by doc_id and place, stays, and a
sentence goes if any run that covers it is another.

A passage that sits inside a host's sentences, or is one or two long ones, has no such run. So of any `LONG` words in a row that a document
with a smaller doc_id has too, all words go, whatever the sentences. Windows of `LONG` words are compared only about anchors, runs of
`ANCHOR` words with the least hash of all in some window: equal windows have equal anchors. Anchors that two documents share,
and about which one that is not the first has words left, tell which windows of all documents are compared.

What is removed goes by 128 bits of hash. Only hashes are shuffled: runs are aggregated to their first place, and only runs that pass
a Bloom filter of the repeated hashes (of bounded size; what it lets through by mistake finds no partner) are joined with it. Texts of
documents without a repeated run or anchor are never shuffled.

Defined cases: a null text is empty; rows without doc_id pass unchanged and are no one's first; rows that repeat a doc_id are one document
and each loses the same words; a text shorter than a run passes unchanged; a very long text is one row; of equal runs in one document (ties) the first
place stays; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import _bloom, _passing
from .scratch import columns_apart, frugal, written
from .words import find, hashed, mix, slices, utf8

SENTENCES = 3
LONG, ANCHOR = 50, 25
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[list(b"\"')]}")] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _ending(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word the last byte before up to three closing quotes or brackets."""
    at = ends - 1
    for _ in range(3):
        x, y, z = data[at], data[np.maximum(at - 1, starts)], data[np.maximum(at - 2, starts)]
        size = np.where(_CLOSERS[x], 1, np.where((x == 0xBB) & (y == 0xC2), 2, np.where((z == 0xE2) & (y == 0x80) & np.isin(x, (0x99, 0x9C, 0x9D, 0xBA)), 3, 0)))  # » ’ “ ” ›
        at = np.where(at - size >= starts, at - size, at)
    return data[at]


def _wide_stops(data: np.ndarray) -> np.ndarray:
    """Places after `。`, `！` and `？`."""
    if len(data) < 3 or not (data >= 0xE3).any():
        return np.zeros(0, np.int64)
    x, y, z = data[:-2], data[1:-1], data[2:]
    return np.flatnonzero(((x == 0xE3) & (y == 0x80) & (z == 0x82)) | ((x == 0xEF) & (y == 0xBC) & ((z == 0x81) | (z == 0x9F)))) + 3


def sentences(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, each row's first word, each sentence's first word (one more), each row's first sentence (one more)."""
    wide = _wide_stops(data)
    starts, ends, at = find(data, rows, wide)
    n = len(starts)
    if not n:
        return starts, ends, at, np.zeros(1, np.int64), np.zeros(len(rows), np.int64)
    feeds = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last = _STOPS[_ending(data, starts, ends)]
    last[:-1] |= feeds[starts[1:]] > feeds[ends[:-1]]
    if len(wide):
        last |= np.isin(ends, wide)
    whole = at[1:][np.diff(at) > 0] - 1
    last[whole] = True
    first = np.concatenate([[0], np.flatnonzero(last) + 1])
    return starts, ends, at, first, np.searchsorted(first, at, side="left")


_TWIN = np.uint64(0xA0761D6478BD642F)


def _hashes(words: np.ndarray, base: int = 0x9E3779B97F4A7C15):
    """The hash of words from `a` to `z`: a polynomial of the words, from prefix sums of word * base ** place."""
    inverse = pow(base, -1, 1 << 64)
    powers = np.cumprod(np.full(len(words) + 1, base, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(words) + 1, inverse, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)])
    return lambda a, z: mix((sums[z] - sums[a]) * back[a] + (z - a).astype(np.uint64))


def _both(words: np.ndarray):
    """Two hashes, 128 bits in all, of the words from `a` to `z`."""
    return _hashes(words), _hashes(mix(words ^ _TWIN), 0xE7037ED1A0B428DB)


def runs(at: np.ndarray, first: np.ndarray, s_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, and word after the last, of every run of `SENTENCES` sentences."""
    s = np.arange(max(0, len(first) - SENTENCES))
    row = np.repeat(np.arange(len(at) - 1), np.diff(s_at))[: len(s)]
    s = s[s + SENTENCES <= s_at[row + 1]] if len(s) else s
    row = row[s]
    return row, first[s], first[s + SENTENCES]


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """The best of each `n` neighbours."""
    wide = 1
    while 2 * wide <= n:
        x, wide = best(x[:-wide], x[wide:]), 2 * wide
    return best(x[: len(x) - (n - wide)], x[n - wide :])


def anchors(at: np.ndarray, hash_of) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every run of `ANCHOR` words that has the least hash in some window of `LONG` words."""
    total, span = int(at[-1]), LONG - ANCHOR + 1
    if total < LONG:
        none = np.zeros(0, np.int64)
        return none, none
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin = np.arange(total - ANCHOR + 1)
    h = mix(hash_of(begin, begin + ANCHOR) ^ _SALT)
    least = _sliding(h, span, np.minimum)
    least[at[row[: len(least)] + 1] < np.arange(len(least)) + LONG] = 0  # windows that leave their row
    edge = np.zeros(span - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == h)
    return row[chosen], chosen


_SPANS = "doc_id bigint, twin bigint, owner bigint, place int, size int, words int"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sentences, and anchors, which have size 0."""
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, ends, at, first, s_at = sentences(data, rows)
            one, two = _both(hashed(data, starts, ends))
            owner, a, z = runs(at, first, s_at)
            row, begin = anchors(at, one)
            h = np.append(one(a, z), mix(one(begin, begin + ANCHOR) ^ _SALT)).view(np.int64)
            twin = np.append(two(a, z), np.zeros(len(row), np.uint64)).view(np.int64)
            owner, place, size = np.append(owner, row), np.append(a, begin), np.append(z - a, np.zeros(len(row), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(twin), b.column("doc_id").take(pa.array(owner)), pa.array(place - at[owner], pa.int32()), pa.array(size, pa.int32()), pa.array(np.diff(at)[owner], pa.int32())],
                names=["doc_id", "twin", "owner", "place", "size", "words"],
            )


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of anchors, not the first of theirs, with words in a window about them that no run of sentences takes away."""
    for b in batches:
        found = b.column("found")
        at, x = found.offsets.to_numpy(), found.values
        place, size, words, later, h = (x.field(c).to_numpy(zero_copy_only=False) for c in ("place", "size", "words", "later", "hash"))
        out = []
        for a, z in zip(at[:-1], at[1:]):
            mine = np.flatnonzero((size[a:z] == 0) & later[a:z]) + a
            if not len(mine):
                continue
            # rows that repeat a doc_id may have texts of other lengths
            n = int(words[a:z].max())
            run = np.flatnonzero(size[a:z] > 0) + a
            change = np.bincount(place[run], minlength=n + 1) - np.bincount(place[run] + size[run], minlength=n + 1)
            left = np.concatenate([[0], np.cumsum(np.cumsum(change)[:n] == 0)])
            low, high = np.maximum(place[mine] - (LONG - ANCHOR), 0), np.minimum(place[mine], words[mine] - LONG) + LONG
            out.append(h[mine[left[high] > left[low]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["doc_id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of `LONG` words about the places of a row."""
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, ends, at = find(data, rows, _wide_stops(data))
            near = b.column("near")
            places = near.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(near.offsets.to_numpy()))
            wanted = np.zeros(len(starts) + 1, bool)
            for j in range(LONG - ANCHOR + 1):
                begin = places.astype(np.int64) - j
                ok = (begin >= 0) & (begin + LONG <= at[row + 1] - at[row])
                wanted[at[row[ok]] + begin[ok]] = True
            begin = np.flatnonzero(wanted)
            owner = np.searchsorted(at, begin, side="right") - 1
            h, twin = (hash_of(begin, begin + LONG).view(np.int64) for hash_of in _both(hashed(data, starts, ends)))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(twin), b.column("doc_id").take(pa.array(owner)), pa.array(begin - at[owner], pa.int32())], names=["doc_id", "twin", "owner", "place"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, _, at, first, s_at = sentences(data, rows)
            texts, removed = [], []
            for i, gone in enumerate(b.column("gone").to_pylist()):
                keep = np.ones(int(at[i + 1] - at[i]), bool)
                for g in gone or ():
                    keep[g["place"] : g["place"] + g["size"]] = False
                if keep.all():
                    texts.append(data[rows[i] : rows[i + 1]].tobytes().decode())
                    removed.append(0)
                    continue
                begin = np.append(starts[at[i] : at[i + 1]], rows[i + 1])
                begin[0] = rows[i]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                texts.append(b"".join(data[begin[j] : begin[k]].tobytes() for j, k in edge.reshape(-1, 2)).decode())
                removed.append(int(np.logical_or.reduceat(~keep, first[s_at[i] : s_at[i + 1]] - at[i]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(np.diff(s_at)), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed"])


def _repeated(spans: DataFrame, name: str) -> DataFrame:
    """Spans whose hash (named doc_id, the name that the filter goes by) is another's too, with the first of them and the last owner."""
    firsts = spans.groupBy("doc_id", "twin").agg(F.min(F.struct("owner", "place")).alias("first"), F.max("owner").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").drop("n"), name)
    return spans.where(_passing(spans.sparkSession, *_bloom(firsts.select("doc_id")))).join(firsts, ["doc_id", "twin"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, text without repeated passages, n_sentences (before), n_removed (sentences that lost words, mostly all)."""
    spark = docs.sparkSession
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    spans = written(docs.where("doc_id is not null").mapInArrow(frugal(_spans), _SPANS), "spans")
    other = (F.col("owner") != F.col("first.owner")) | (F.col("place") != F.col("first.place"))
    found = _repeated(spans, "firsts").where(F.when(F.col("size") > 0, other).otherwise(F.col("last") != F.col("first.owner")))
    found = found.select("owner", "place", "size", "words", (F.col("owner") != F.col("first.owner")).alias("later"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(0).alias("hash")).distinct()
    found = written(found.groupBy("owner").agg(F.collect_list(F.struct("place", "size", "words", "later", "hash")).alias("found")), "found")

    hashes = written(found.mapInArrow(frugal(_open), "doc_id bigint").distinct(), "open")
    places = found.select("owner", F.explode(F.filter("found", lambda x: x["size"] == 0)).alias("x")).select("owner", F.col("x.place").alias("place"), F.col("x.hash").alias("doc_id"))
    places = places.where(_passing(spark, *_bloom(hashes))).join(hashes, "doc_id")
    near = written(places.groupBy(F.col("owner").alias("id")).agg(F.collect_list("place").alias("near")), "near")
    about = docs.where(F.col("doc_id").isNotNull() & _passing(spark, *_bloom(near.select(F.col("id").alias("doc_id")))))
    about = about.join(near, about["doc_id"] == near["id"]).select("doc_id", "text", "near")
    windows = written(about.mapInArrow(frugal(_windows), "doc_id bigint, twin bigint, owner bigint, place int"), "windows")
    long = _repeated(windows, "first-windows").where(F.col("owner") != F.col("first.owner")).select("owner", "place", F.lit(LONG).alias("size")).distinct()

    taken = found.select("owner", F.explode(F.filter("found", lambda x: x["size"] > 0)).alias("x")).select("owner", "x.place", "x.size").union(long)
    gone = written(taken.groupBy(F.col("owner").alias("id")).agg(F.collect_list(F.struct("place", "size")).alias("gone")), "gone")
    passes = _passing(spark, *_bloom(gone.select(F.col("id").alias("doc_id"))))
    touched = docs.where(F.col("doc_id").isNotNull() & passes)
    touched = touched.join(gone, touched["doc_id"] == gone["id"], "left").select("doc_id", "text", "gone")
    whole = docs.where(F.col("doc_id").isNull() | ~passes).select("doc_id", "text", F.lit(None).cast("array<struct<place:int,size:int>>").alias("gone"))
    out = "doc_id bigint, text string, n_sentences bigint, n_removed bigint"
    return touched.mapInArrow(frugal(_without), out).unionByName(whole.mapInArrow(frugal(_without), out))
