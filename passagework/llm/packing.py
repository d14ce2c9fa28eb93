"""Best-fit packing of tokenised documents by planning over the histogram of lengths.

A document is its token ids and an end id; only one longer than `room` is cut, into pieces of `room` of
which the first may be shorter. Pieces are counted by length, best-fit-decreasing runs over those at most
`room` counts (never over documents), and a piece then takes the slot of its rank within its length.
The rank is the piece's number within its task and length plus the counts of the tasks before, so no
length, however common, is ranked in one task. The plan's size depends on `room` alone.

Defined cases: a null or empty text is the end id alone; an empty table gives no rows; rows that repeat a
doc_id are packed each for itself; any null doc_id is carried along. A very long text is tokenised in parts that no
token crosses; ties (pieces of one length) take that length's slots in the order of their tasks. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal, written
from .words import slices

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sender int, seq bigint, ids binary"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]

#: Signs on which the rank form's pattern and the tokenizers file's agree: printable ASCII, tab, line ends, Latin letters and common marks.
_PLAIN = re.compile(r"[\x20-\x7e\t\n\r\u00a1-\u024f\u2010-\u2027]*").fullmatch
#: Longer runs of white space go to the tokenizers file, as the rank form's pattern steps back over a run.
_WIDE_GAP = re.compile(r"\s{1000}").search
#: A text is cut only where no token of this vocabulary crosses: before a blank that follows a sign and stands before one.
_CUT = re.compile(r"(?<=\S)(?= \S)").search


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


class Encoder:
    """Token ids of the byte-level BPE in a tokenizers file, as little-endian 32-bit bytes.

    Whole texts of plain signs go to the same vocabulary in rank form, which is several times as fast. Of all
    others, and of those that spell a special token, the tokenizers file itself gives the ids. Long texts are
    encoded in parts of about `PART` characters that no token crosses.
    """

    PART = 1_000_000

    def __init__(self, path: str, ranks_path: str | None = None, special: list[str] | None = None) -> None:
        """special: the file's special tokens, if they are known; the file is then read only when a text needs it."""
        self.path = path
        self.special = special_tokens(path) if special is None else special
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._part, self.parts(text))) if len(text) > self.PART else self._part(text)

    def _part(self, text: str) -> bytes:
        if self.fast and _PLAIN(text) and not _WIDE_GAP(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @classmethod
    def parts(cls, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = _CUT(text, at + cls.PART)
            yield text[at : cut.start() if cut else len(text)]
            at = cut.start() if cut else len(text)


def _pieces(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of these sizes: each piece's document, number, start and length."""
    n = -(-sizes // room)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (sizes - 1) % room + 1
    start = np.where(piece > 0, first[row] + (piece - 1) * room, 0)
    return row, piece, start, np.where(piece > 0, room, first[row])


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length, after those in `seen`, which is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    own = lengths[order]
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own)))) + seen[own]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def _tokenised(path: str, ranks_path: str | None, room: int, end_id: int, keep_ids: bool):
    special = special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sender = Encoder(path, ranks_path, special), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(room + 1, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                parts = [encoder.ids(t.as_py() or "") + end for t in b.column("text")]
                sizes = np.array([len(x) for x in parts], np.int64) // 4
                row, piece, start, length = _pieces(sizes, room)
                whole = memoryview(b"".join(parts))
                del parts
                at = 4 * (np.cumsum(sizes) - sizes)[row] + 4 * start
                cuts = [whole[a:z] for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                crc = np.fromiter(map(zlib.crc32, cuts), np.int64, len(cuts))
                ids = pa.array([bytes(c) for c in cuts] if keep_ids else [None] * len(cuts), pa.binary())
                columns = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), sender), pa.int32()), pa.array(_numbered(length, seen)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


def best_fit(histogram: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts.

    Rows (length, first rank, pieces in a bin, first bin, offset in the bin, ranks): the j-th of those ranks goes to bin
    `first bin + j // pieces` at `offset + j % pieces * length`. Of bins with equal room those that got it last are taken.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    plan, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fit = next((r for r in range(length, room + 1) if free.get(r)), None)
            if fit is None:
                fit, (first, n) = room, (bins, -(-left // (room // length)))
                bins += n
            else:
                first, n = free[fit].pop()
            each = fit // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            plan.append((length, rank, each, first, room - fit, placed))
            full = placed // each
            if full:
                free.setdefault(fit - each * length, []).append((first, full))
            if placed % each:
                free.setdefault(fit - placed % each * length, []).append((first + full, 1))
            if n > used:
                free.setdefault(fit, []).append((first + used, n - used))
            left -= placed
            rank += placed
    return plan


def _placed(plan: np.ndarray):
    """plan: as of best_fit, ordered by length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] * (1 << 48) + plan[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            p = plan[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            j = rank - p[:, 1]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(p[:, 3] + j // p[:, 2]), pa.array(p[:, 4] + j % p[:, 2] * length), b.column("ids")],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, room: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """For each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless kept)."""
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    pieces = written(docs.mapInArrow(frugal(_tokenised(tokenizer, ranks, room, end_id, keep_ids)), _PIECE), "pieces")
    by_task = pieces.groupBy("sender", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `room` rows at most
    plan = np.array(sorted(best_fit(histogram, room)) or np.zeros((0, 6)), np.int64)
    before = Window.partitionBy("length").orderBy("sender").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("sender", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["sender", "length"]).withColumn("rank", F.col("base") + F.col("seq"))
    return ranked.mapInArrow(frugal(_placed(plan)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: whole sequences as little-endian 32-bit ids; `pack` must have kept them."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # of `room` tokens at most
    return parts.select("sequence_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("length"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
