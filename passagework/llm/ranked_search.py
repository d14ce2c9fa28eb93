"""Ranked lexical search with block-max pruning over an index that is written once.

The index: runs of consecutive documents are blocks, one row each, with a forward index (each document's terms
and their counts) and, for each term of the block, the largest part of a score that any of its documents gives it.

1. One pass over the text writes the forward blocks; the counts over all documents follow from those, and a pass over
   the blocks adds the maxima, which need them.
2. Requests come in batches of bounded size. A pass over the blocks sums the document frequencies of the batch's terms.
3. A block's bound for a request is the sum of weight times maximum over the request's terms. The `SEEDS` blocks with the
   highest bounds of each request are scored; the score of the k-th document there is the request's threshold.
4. Each task sorts its blocks by bound, per request, and scores them until the bound drops below the threshold, which
   rises as better documents are met. A block that may hold an equal score is scored. What reaches a threshold is ranked.

All scores are 64-bit integers, so bounds are exact and pruning loses nothing.

Defined cases: a null text has no terms and, like any text without terms, does not count; each row is a document, also where doc_id
is null (ranked last among equal scores) or repeats; requests that share an id are one request of all their terms, null
being an id like others; a request without a term that occurs has no rows; empty tables give no rows. A very long text is a
block by itself, whole. Equal scores go by ascending doc_id. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import part_of, parts_within
from .scratch import columns_apart, frugal, written
from .terms import WITH_DIGITS, found
from .words import slices

#: Documents and bytes of text of a block, at most; a longer text has its own.
BLOCK_DOCS, BLOCK_BYTES = 32, 1 << 20
#: Bytes of postings that a task has open at once, about.
READ_BYTES = 1 << 20
#: Blocks scored for each request before the others, to find its threshold.
SEEDS = 8
#: Bytes of terms of a batch of requests, at most (or one request); the batch is collected and sent to every task.
BATCH_BYTES = 4 << 20

_FORWARD = "block bigint, n_docs bigint, n_terms bigint, ids binary, absent binary, sizes binary, ends binary, terms binary, counts binary, spelled binary, cuts binary"
_BLOCK = _FORWARD + ", best binary, df binary"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


@dataclass(frozen=True)
class Index:
    """blocks: one row a block; documents: those with a term; occurrences: all their terms, with repeats."""

    blocks: DataFrame
    documents: int
    occurrences: int


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _wide(raw: pa.Scalar | bytes) -> np.ndarray:
    raw = raw if isinstance(raw, bytes) else raw.as_buffer()
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            for b in slices(batch.slice(at, BLOCK_DOCS), "text", BLOCK_BYTES):
                spelled, numbers, first = found(b.column("text"), WITH_DIGITS)
                sizes = np.diff(first)
                have = np.flatnonzero(sizes)
                if not len(have):
                    continue
                key, counts = np.unique(np.repeat(np.arange(len(have)), sizes[have]) * len(spelled) + numbers, return_counts=True)
                ends = np.searchsorted(key, (np.arange(len(have)) + 1) * len(spelled))
                ids = b.column("doc_id").take(pa.array(have))
                flat = pa.concat_arrays([spelled]).cast(pa.string())
                cuts = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1]
                row = [task | seq, len(have), int(sizes.sum()), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.asarray(ids.is_null()), _narrow(sizes[have]), _narrow(ends), _narrow(key % len(spelled)), _narrow(counts), flat.buffers()[2].to_pybytes()[: cuts[-1]], cuts]
                yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, (int, bytes)) else x.tobytes()], pa.int64() if i < 3 else pa.binary()) for i, x in enumerate(row)], names=_names(_FORWARD))
                seq += 1


def _parts(sizes: np.ndarray, ends: np.ndarray, counts: np.ndarray, documents: int, occurrences: int) -> tuple[np.ndarray, np.ndarray]:
    """For each posting its document in the block, and the part of a score that its term's weight is multiplied with."""
    doc = np.repeat(np.arange(len(sizes)), np.diff(ends, prepend=0))
    m = 75 + (25 * sizes * documents) // occurrences
    return doc, (1_000_000_000 * counts) // (1000 * counts + 12 * m[doc])


def _with_maxima(documents: int, occurrences: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "terms", READ_BYTES):
                best, df = [], []
                for sizes, ends, terms, counts, cuts in zip(*(b.column(c) for c in ("sizes", "ends", "terms", "counts", "cuts"))):
                    terms, n = _wide(terms), cuts.as_buffer().size // 4 - 1
                    _, part = _parts(_wide(sizes), _wide(ends), _wide(counts), documents, occurrences)
                    most = np.zeros(n, np.int64)
                    np.maximum.at(most, terms, part)
                    best.append(_narrow(most))
                    df.append(_narrow(np.bincount(terms, minlength=n)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.binary()), pa.array(df, pa.binary())], names=_names(_BLOCK))

    return run


def index(docs: DataFrame) -> Index:
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    forward = written(docs.mapInArrow(frugal(_forward), _FORWARD), "forward")
    documents, occurrences = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Index(written(forward.mapInArrow(frugal(_with_maxima(documents, occurrences)), _BLOCK), "blocks"), documents, occurrences)


@dataclass(frozen=True)
class _Batch:
    """Requests, by number: `of` and `term` name each entry's request and term, `weight` is the term's weight times its repeats there."""

    terms: pa.Array
    starts: np.ndarray
    of: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def places(self, spelled: bytes, cuts: bytes) -> np.ndarray:
        """Each term's number in a block, or -1."""
        at = np.frombuffer(cuts, np.int32)
        there = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(cuts), pa.py_buffer(spelled))
        return pc.fill_null(pc.index_in(self.terms, value_set=there), -1).to_numpy(zero_copy_only=False)

    def bounds(self, place: np.ndarray, best: np.ndarray) -> np.ndarray:
        most = np.where(place >= 0, best[place], 0).astype(np.int64)
        return np.add.reduceat(self.weight * most[self.term], self.starts)


def _frequencies(batch: _Batch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(batch.terms), np.int64)
        for b in batches:
            for spelled, cuts, df in zip(*(b.column(c) for c in ("spelled", "cuts", "df"))):
                place = batch.places(spelled.as_py(), cuts.as_py())
                total += np.where(place >= 0, _wide(df)[place], 0)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], names=["term", "df"])

    return run


def _highest_bounds(batch: _Batch, most: int):
    """For each request the blocks of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = len(batch.starts), None
        for b in batches:
            names = b.column("block").to_numpy(zero_copy_only=False)
            rows = [batch.bounds(batch.places(s.as_py(), c.as_py()), _wide(x)) for s, c, x in zip(*(b.column(c) for c in ("spelled", "cuts", "best")))]
            for at in range(0, len(rows), 64):
                bounds, blocks = np.array(rows[at : at + 64]).T, np.broadcast_to(names[at : at + 64], (n, len(rows[at : at + 64])))
                if held:
                    bounds, blocks = np.hstack([held[0], bounds]), np.hstack([held[1], blocks])
                keep = np.argsort(-bounds, axis=1, kind="stable")[:, :most]
                held = np.take_along_axis(bounds, keep, 1), np.take_along_axis(blocks, keep, 1)
        if held:
            of, rank = np.nonzero(held[0])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(held[1][of, rank]), pa.array(held[0][of, rank])], names=["request", "block", "bound"])

    return run


class _Best:
    """The k highest scores of a request in a task, and the threshold that these and earlier blocks give."""

    def __init__(self, least: int, k: int) -> None:
        self.least, self.k = least, k
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        have = np.flatnonzero(scores >= self.least)
        if len(have):
            self.rows += zip((-scores[have]).tolist(), absent[have].tolist(), ids[have].tolist())
            self.rows = sorted(self.rows)[: self.k]
            if len(self.rows) == self.k:
                self.least = max(self.least, -self.rows[-1][0])


def _scored(batch: _Batch, least: np.ndarray, k: int, documents: int, occurrences: int):
    """The best documents of a task's blocks. least: for each request the lowest score that may still be in its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = len(batch.starts), {}
        stops = np.append(batch.starts[1:], len(batch.of))
        dense = np.zeros(len(batch.terms), np.int64)
        for b in batches:
            for part in slices(b, "terms", READ_BYTES):
                places = [batch.places(s.as_py(), c.as_py()) for s, c in zip(part.column("spelled"), part.column("cuts"))]
                bounds = np.array([batch.bounds(p, _wide(x)) for p, x in zip(places, part.column("best"))])
                raw = [[x.as_py() for x in part.column(c)] for c in ("ids", "absent", "sizes", "ends", "terms", "counts", "cuts")]
                opened: dict[int, tuple] = {}
                for r in np.flatnonzero((bounds >= least).any(axis=0)):
                    own = best.setdefault(int(r), _Best(int(least[r]), k))
                    dense[batch.term[batch.starts[r] : stops[r]]] = batch.weight[batch.starts[r] : stops[r]]
                    for i in np.argsort(-bounds[:, r], kind="stable"):
                        if bounds[i, r] < own.least:
                            break
                        if i not in opened:
                            ids, absent = np.frombuffer(raw[0][i], "<i8"), np.frombuffer(raw[1][i], bool)
                            sizes, ends, terms, counts = (_wide(x[i]) for x in raw[2:6])
                            number = np.full(len(raw[6][i]) // 4 - 1, -1, np.int64)
                            here = np.flatnonzero(places[i] >= 0)
                            number[places[i][here]] = here
                            doc, value = _parts(sizes, ends, counts, documents, occurrences)
                            asked = np.flatnonzero(number[terms] >= 0)
                            opened[i] = ids, absent, doc[asked], number[terms[asked]], value[asked]
                        ids, absent, doc, term, value = opened[i]
                        sums = np.zeros(len(ids), np.int64)
                        np.add.at(sums, doc, dense[term] * value)
                        own.add(sums, absent, ids)
                    dense[batch.term[batch.starts[r] : stops[r]]] = 0
        rows = [(r, None if absent else doc, -score) for r, own in best.items() for score, absent, doc in own.rows]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["request", "doc_id", "score"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            spelled, numbers, first = found(b.column("text"), WITH_DIGITS)
            key, n = np.unique(np.repeat(np.arange(b.num_rows), np.diff(first)) * max(1, len(spelled)) + numbers, return_counts=True)
            row, term = np.divmod(key, max(1, len(spelled)))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), spelled.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64())], names=["item_id", "term", "n"])


def search(there: Index, items: DataFrame, k: int = 20, seeds: int = SEEDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """For each item its `k` best documents: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    items = columns_apart(items, {"item_id": ("item_id", "bigint"), "text": ("text", "string")})
    asked = written(items.mapInArrow(frugal(_asked), "item_id bigint, term string, n bigint").groupBy("item_id", "term").agg(F.sum("n").alias("n")), "asked")
    if not there.documents or asked.isEmpty():
        return empty
    parts, out = parts_within(asked.groupBy("item_id").agg(F.sum(F.octet_length("term") + 24).alias("bytes")), "item_id", batch_bytes), []
    for part in range(parts):
        rows = asked.where(part_of("item_id", parts) == part).toArrow()  # `batch_bytes` at most, or one request
        if rows.num_rows:
            out.append(_answered(there, rows, k, seeds))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _answered(there: Index, rows: pa.Table, k: int, seeds: int) -> DataFrame:
    spark, best_first = there.blocks.sparkSession, [F.desc("score"), F.asc_nulls_last("doc_id")]
    coded = rows.column("term").combine_chunks().dictionary_encode()
    items = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    of = items.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    of, term = of[order], coded.indices.to_numpy(zero_copy_only=False)[order]
    repeats = rows.column("n").to_numpy()[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    batch = _Batch(coded.dictionary, starts, of, term, repeats)
    df = np.zeros(len(batch.terms), np.int64)
    for r in there.blocks.select("spelled", "cuts", "df").mapInArrow(frugal(_frequencies(batch)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the batch
        df[r.term] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * there.documents + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    batch = _Batch(coded.dictionary, starts, of, term, weight[term] * repeats)
    of_bound = Window.partitionBy("request").orderBy(F.desc("bound"), "block")
    highest = there.blocks.select("block", "spelled", "cuts", "best").mapInArrow(frugal(_highest_bounds(batch, seeds)), "request int, block bigint, bound bigint")
    first = written(highest.withColumn("at", F.row_number().over(of_bound)).where(F.col("at") <= seeds).select("block").distinct(), "seeds")  # `seeds` for each request of the batch at most
    of_score = Window.partitionBy("request").orderBy(*best_first)
    kinds = "request int, doc_id bigint, score bigint"
    least = np.ones(len(starts), np.int64)
    seeded = there.blocks.join(F.broadcast(first), "block", "left_semi").mapInArrow(frugal(_scored(batch, least, k, there.documents, there.occurrences)), kinds)
    for r in seeded.withColumn("rank", F.row_number().over(of_score)).where(F.col("rank") == k).collect():  # a row for each request of the batch
        least[r.request] = max(1, r.score)
    ranked = there.blocks.mapInArrow(frugal(_scored(batch, least, k, there.documents, there.occurrences)), kinds).withColumn("rank", F.row_number().over(of_score)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.dictionary.to_pylist())), "request int, item_id bigint")  # the batch's requests
    return ranked.join(F.broadcast(names), "request").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
