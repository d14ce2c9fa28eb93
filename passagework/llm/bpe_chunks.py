"""Byte-level BPE of whole texts in which chunks that texts share are encoded once, and decoding.

A rolling hash over the last 32 bytes cuts each text where its content says so, so equal passages give equal chunks wherever they stand.

1. One pass counts chunks by hash; those met twice or more, in any texts, set bits of a Bloom filter of bounded size.
2. A second pass encodes at once what lies between such chunks (whole texts, where none is shared), and sends
   each shared chunk once for each bundle of texts (about 4 MB of one task) that has it.
3. Each distinct shared chunk is encoded once, and its ids go back to the bundles. Chunks that very many bundles
   have are broadcast (fewer than 1,000 can hold a thousandth of all requests); the others are joined.
4. A bundle's texts are put together. Every encoding is cut between a sign that is not white space and the white
   space after it, whatever stands around; a chunk's ids are taken only between the first and the last such place.
   At a join the window from the last of the left chunk on is re-encoded, and widened until it reaches one of the right
   chunk, over whole chunks if they have none: there both sides agree exactly, and so does the whole.

What the filter lets through by mistake is encoded in another place, with the same result; when the filter is full (some
4 million shared chunks), all chunks are treated so.

Defined cases: a null text is empty and has no ids; rows that repeat an id are texts each; any doc_id is carried along; a text
that spells a special token has that token's id, also across chunks; a very long text is a bundle by itself; texts without white
space have no such places and are encoded whole at assembly; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import _BLOCK, FILTER_BITS, _one_block
from .packing import Encoder, special_tokens
from .scratch import columns_apart, frugal, written
from .words import mix, slices, utf8

#: Bytes that the rolling hash sees, a chunk's bytes at least and at most, and bytes between cuts about.
WINDOW, LEAST, MOST, ABOUT = 32, 64, 8192, 512
#: Bytes of text of a bundle, about.
BUNDLE = 4 << 20
#: Bundles that a chunk may have in a join, as a share of all requests; chunks with more are broadcast.
HOT = 1000
#: A cut of every encoding: white space after a sign that is none.
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")

_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_FACTOR = np.uint64(0x5851F42D4C957F2D)


def cuts(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Of texts in UTF-8, one after the other, each text's chunk ends; rows: where each text starts (one more than texts)."""
    h, factor = _BYTE[data], _FACTOR
    with np.errstate(over="ignore"):
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] * factor
            factor, step = factor * factor, 2 * step
    hits = np.flatnonzero(mix(h) % np.uint64(ABOUT) == 0) + 1
    out = []
    for a, z in zip(rows[:-1].tolist(), rows[1:].tolist()):
        ends, at = [], a
        if z > a:
            i, j = np.searchsorted(hits, (a + WINDOW, z))
            for hit in [*hits[i:j].tolist(), z]:
                while hit - at > MOST:
                    at = _sign(data, at + MOST, z)
                    ends.append(at)
                hit = _sign(data, hit, z)
                if hit - at >= LEAST and hit < z:
                    ends.append(hit)
                    at = hit
            if not ends or ends[-1] < z:
                ends.append(z)
        out.append(np.array(ends, np.int64))
    return out


def _sign(data: np.ndarray, at: int, end: int) -> int:
    """The first place from `at` on where a sign starts."""
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _digests(raw: memoryview, a: int, ends: np.ndarray) -> list[bytes]:
    out = []
    for z in ends.tolist():
        out.append(hashlib.blake2b(raw[a:z], digest_size=16).digest())
        a = z
    return out


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, memoryview, int, np.ndarray, list[bytes]]]:
    """For each text: row, all bytes, its first byte, its chunks' ends and their digests."""
    data, rows = utf8(b.column("text"))
    raw = memoryview(data)
    for i, ends in enumerate(cuts(data, rows)):
        yield i, raw, int(rows[i]), ends, _digests(raw, int(rows[i]), ends)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent() -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], names=["hash", "n"])

    held, size = [], 0
    for batch in batches:
        for b in slices(batch, "text"):
            for *_, digests in _chunks(b):
                held.append(np.frombuffer(b"".join(digests), "<i8")[::2])
                size += len(digests)
            if size > 2_000_000:
                yield sent()
                held, size = [], 0
    if size:
        yield sent()


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of 64-bit hashes, which are their own probes; at most `FILTER_BITS`, gathered in blocks of 64 KB."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << math.ceil(math.log2(16 * max(1, hashes.count())))))
    probes = [F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 17, 34)]
    words = hashes.select(F.explode(F.array(*probes)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("m"))
    out = np.zeros(max(bits // 64, 1 << _BLOCK), np.int64)
    for r in words.groupBy(F.shiftright("w", _BLOCK).alias("block")).applyInPandas(_one_block, "block bigint, raw binary").collect():
        out[r.block << _BLOCK : (r.block + 1) << _BLOCK] = np.frombuffer(r.raw, np.int64)
    return np.append(out.view(np.uint64), np.uint64(bits))


def _may_be(bloom: np.ndarray, digests: list[bytes]) -> np.ndarray:
    h, mask, ok = np.frombuffer(b"".join(digests), "<u8")[::2], bloom[-1] - np.uint64(1), True
    for s in (0, 17, 34):
        p = (h >> np.uint64(s)) & mask
        ok = ok & ((bloom[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def _packed(ids: bytes) -> bytes:
    """Ids in two bytes each where all of them fit, else in four; the first byte says which. For tables between stages."""
    own = np.frombuffer(ids, "<u4")
    return b"\x02" + own.astype("<u2").tobytes() if own.max(initial=0) < 1 << 16 else b"\x04" + ids


def _unpacked(raw: bytes) -> bytes:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4").tobytes()


def _split(text: str, encoder: Encoder) -> tuple[str, bytes | None, str]:
    """Text before the first cut of every encoding, packed ids up to the last (None: there is no such place), text after it."""
    first = _CUT.search(text)
    if not first:
        return text, None, ""
    a = z = first.start()
    reach = 256
    while True:  # the last, without looking through the whole
        begin = max(a, len(text) - reach)
        late = [m.start() for m in _CUT.finditer(text, begin)]
        if late or begin == a:
            z = late[-1] if late else a
            break
        reach *= 8
    return text[:a], _packed(encoder.ids(text[a:z])) if z > a else b"\x02", text[z:]


class Vocabulary:
    """Each id's bytes, from a tokenizers file with a byte-level decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        # bytes that print stand for themselves, the others are numbered from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ids = {i: bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode() for token, i in whole["model"]["vocab"].items()}
        ids |= {t["id"]: t["content"].encode() for t in whole.get("added_tokens", [])}
        self.bytes = [ids.get(i, b"") for i in range(max(ids) + 1)]
        self.spelled = [str(i) for i in range(max(ids) + 1)]

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, and of the decoded text."""
        own = np.frombuffer(ids, "<u4").tolist()
        listed = hashlib.sha256(",".join(map(self.spelled.__getitem__, own)).encode()).hexdigest()
        return len(own), listed, hashlib.sha256(b"".join(map(self.bytes.__getitem__, own)).decode("utf-8", "replace").encode()).hexdigest()


#: kind 0: a text's result; 1: a segment of a text (a run's own ids, or a shared chunk's digest); 2: a shared chunk's text
_ROW = "kind int, bundle bigint, row int, seq int, doc_id bigint, digest binary, text string, head string, core binary, tail string, chunks int, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary"
_RESULT = "doc_id bigint, chunks int, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=_names(schema))


def _first_pass(path: str, ranks_path: str | None, bloom: np.ndarray, keep_ids: bool):
    special = special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = Encoder(path, ranks_path, special), Vocabulary(path)
        task, bundles = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for bundle in slices(batch, "text", BUNDLE):
                name, row, sent = task | bundles, 0, set()
                bundles += 1
                for b in slices(bundle, "text"):
                    rows, ids_of = [], b.column("doc_id").to_pylist()
                    for i, raw, a, ends, digests in _chunks(b):
                        row += 1
                        shared = _may_be(bloom, digests) if digests else np.zeros(0, bool)
                        if not shared.any():
                            ids = encoder.ids(str(raw[a : ends[-1]], "utf-8")) if digests else b""
                            rows.append((0, None, None, None, ids_of[i], None, None, None, None, None, len(digests), *words.digests(ids), ids if keep_ids else None))
                            continue
                        starts, seq, j = [a, *ends[:-1].tolist()], 0, 0
                        while j < len(digests):
                            k = j + 1
                            if shared[j]:
                                if digests[j] not in sent:
                                    sent.add(digests[j])
                                    rows.append((2, name, None, None, None, digests[j], str(raw[starts[j] : ends[j]], "utf-8"), *[None] * 8))
                                rows.append((1, name, row, seq, ids_of[i], digests[j], None, None, None, None, len(digests), *[None] * 4))
                            else:
                                while k < len(digests) and not shared[k]:
                                    k += 1
                                rows.append((1, name, row, seq, ids_of[i], None, None, *_split(str(raw[starts[j] : ends[k - 1]], "utf-8"), encoder), len(digests), *[None] * 4))
                            j, seq = k, seq + 1
                    if rows:
                        yield _batch(rows, _ROW)

    return run


def _encoded(path: str, ranks_path: str | None):
    special = special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks_path, special)
        for batch in batches:
            for b in slices(batch, "text"):
                head, core, tail = zip(*(_split(t, encoder) for t in b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(head, pa.string()), pa.array(core, pa.binary()), pa.array(tail, pa.string())], names=["digest", "n", "head", "core", "tail"])

    return run


def joined(parts: Iterator[tuple[str, bytes | None, str]], encoder: Encoder) -> bytes:
    """The ids of a text from its segments; windows between them are re-encoded."""
    out, window = [], []
    for head, core, tail in parts:
        window.append(head)
        if core is not None:
            out += [encoder.ids("".join(window)), _unpacked(core)]
            window = [tail]
    out.append(encoder.ids("".join(window)))
    return b"".join(out)


_PUT = "bundle bigint, row int, seq int, doc_id bigint, chunks int, digest binary, head string, core binary, tail string"


def _put_together(path: str, ranks_path: str | None, keep_ids: bool):
    """Rows come in the order of (bundle, row, seq), a bundle's shared chunks first, as row 0."""
    special = special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = Encoder(path, ranks_path, special), Vocabulary(path)
        bundle, row, doc, chunks, known, parts = None, None, None, 0, {}, []

        def closed() -> tuple:
            ids = joined(iter(parts), encoder)
            return doc, chunks, *words.digests(ids), ids if keep_ids else None

        for batch in batches:
            for b in slices(batch, "core"):
                out = []
                for r in zip(*(b.column(c).to_pylist() for c in _names(_PUT))):
                    if (r[0], r[1]) != (bundle, row):
                        if parts:
                            out.append(closed())
                            parts = []
                        if r[0] != bundle:
                            known = {}
                        bundle, row, doc, chunks = r[0], r[1], r[3], r[4]
                    if row == 0:
                        known[r[5]] = r[6:]
                    else:
                        parts.append(known[r[5]] if r[5] is not None else r[6:])
                if out:
                    yield _batch(out, _RESULT)
        if parts:
            yield _batch([closed()], _RESULT)

    return run


def encode(docs: DataFrame, tokenizer: str, ranks: str | None = None, keep_ids: bool = True) -> DataFrame:
    """For each row: doc_id, chunks, n_tokens, ids_sha256, decoded_sha256, ids (little-endian 32-bit, null unless kept).

    tokenizer: a tokenizers file of byte-level BPE; ranks: the same vocabulary in rank form, which is faster for plain texts.
    """
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    counts = docs.select("text").mapInArrow(frugal(_counted), "hash bigint, n bigint")
    bloom = _filter(written(counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"), "repeated"))
    rows = written(docs.mapInArrow(frugal(_first_pass(tokenizer, ranks, bloom, keep_ids)), _ROW), "encoded")
    asked = rows.where("kind = 2").select("bundle", "digest", "text")
    once = asked.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    chunks = written(once.mapInArrow(frugal(_encoded(tokenizer, ranks)), "digest binary, n bigint, head string, core binary, tail string"), "chunks")
    requests = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answer, hot = ["bundle", "digest", "head", "core", "tail"], F.col("n") > math.ceil(requests / HOT)
    wanted = asked.select("bundle", "digest")
    often = F.broadcast(chunks.where(hot))  # fewer than HOT chunks of at most MOST bytes
    told = wanted.join(often, "digest").select(*answer)
    told = told.unionByName(wanted.join(F.broadcast(chunks.where(hot).select("digest")), "digest", "left_anti").join(chunks.where(~hot), "digest").select(*answer))
    names = _names(_PUT)
    told = told.select("bundle", F.lit(0).alias("row"), F.lit(0).alias("seq"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("chunks"), "digest", "head", "core", "tail")
    whole = rows.where("kind = 1").select(*names).unionByName(told.select(*names)).repartition("bundle").sortWithinPartitions("bundle", "row", "seq")
    put = whole.mapInArrow(frugal(_put_together(tokenizer, ranks, keep_ids)), _RESULT)
    return rows.where("kind = 0").select(*_names(_RESULT)).unionByName(put)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: of rows with doc_id and ids (little-endian 32-bit); special tokens are spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(tokenizer)
        for b in batches:
            texts = [words.text(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id bigint, text string")
