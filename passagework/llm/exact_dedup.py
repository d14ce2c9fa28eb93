"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after each run of `[\\x20\\x09-\\x0D]` has become one space; a null text
is the empty one. Of equal texts the row with the smallest doc_id stays.

1. One pass over the text gives each row its 64-bit fingerprint, SHA-256 and length, written once.
2. A partition sorts its distinct fingerprints, cuts them by owner (ranges of the 64-bit space) and sends
   each owner the Golomb-Rice code of the gaps.
3. An owner decodes what it got and answers each sender with a bitmap of those seen elsewhere too.
4. A sender adds what repeats inside itself; that names the suspects. A Bloom filter of bounded size over
   their ids keeps all other texts from being shuffled, and the suspects' bytes are then compared by
   grouping on the normalised text itself (with partial aggregation: a hot text is one row a task).
   What the filter lets through by mistake is compared as well, so it changes no result.

Defined cases: a row without doc_id is always compared; in a group, rows without doc_id stay only if no
row has one. Rows that repeat the smallest doc_id with an equal text are all `kept` in `groups` (doc_id
is the only handle to a row there); `deduplicated` returns one of them. An empty table gives no rows. A very long
text is compared like others, its bytes read in one row; extra columns are ignored by `groups` and kept by `deduplicated`, whatever their names.
Two different texts of equal SHA-256, fingerprint and length would stop the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal, shuffle_partitions, written

_SPACES = r"[\x20\x09-\x0D]+"
#: Fingerprints an owner decodes at once, about; 8 bytes each.
OWNED = 2_000_000
#: Bits of the Bloom filter at most (8 MB), however many suspects there are.
FILTER_BITS = 1 << 26


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def rice_encode(sorted_values: np.ndarray, low: int) -> tuple[int, bytes, int]:
    """Golomb-Rice code of ascending distinct uint64 from `low` on: parameter, bytes, bytes of the unary part."""
    gaps = np.diff(sorted_values, prepend=np.uint64(low))
    mean = max(1.0, float(gaps.astype(np.float64).mean()))
    k = min(63, max(0, math.floor(math.log2(mean * math.log(2))) if mean > 1.5 else 0))
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    first = np.packbits(unary).tobytes()
    if not k:
        return k, first, len(first)
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, first + np.packbits(rest).tobytes(), len(first)


def rice_decode(code: bytes, k: int, unary_bytes: int, n: int, low: int) -> np.ndarray:
    raw = np.frombuffer(code, np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[:unary_bytes]))[:n]
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(raw[unary_bytes:])[: n * k].reshape(n, k)
        rest = np.zeros(n, np.uint64)
        for j in range(k):
            rest = (rest << np.uint64(1)) | bits[:, j]
        gaps += rest
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _low(owner: int, owners: int) -> int:
    return -(-(owner << 32) // owners) << 32


_PACKET = "sender int, owner int, n int, k int, unary int, code binary, again binary, ids binary"


def _packets(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, ids = [], []
        for b in batches:
            prints.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            ids.append(b.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not prints or not sum(map(len, prints)):
            return
        prints, ids = np.concatenate(prints), np.concatenate(ids)
        order = np.argsort(prints, kind="stable")
        prints, ids = prints[order], ids[order]
        distinct, first, n = np.unique(prints, return_index=True, return_counts=True)
        cuts = np.searchsorted(_owner_of(distinct, owners), np.arange(owners + 1))
        bound = np.append(first, len(prints))
        sender, rows = TaskContext.get().partitionId(), []
        for o in np.flatnonzero(np.diff(cuts)):
            a, z = cuts[o], cuts[o + 1]
            k, code, unary = rice_encode(distinct[a:z], _low(int(o), owners))
            # ids keep a row for each fingerprint and the number of rows of each, to be cut apart again
            own = ids[bound[a] : bound[z]]
            rows.append((sender, int(o), int(z - a), k, unary, code, n[a:z].astype(np.uint32).tobytes(), own.tobytes()))
        names = [x.split()[0] for x in _PACKET.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 5 else pa.binary()) for i in range(8)], names=names)

    return send


def _answer(owners: int):
    def answer(got: pd.DataFrame) -> pd.DataFrame:
        values = [rice_decode(c, k, u, n, _low(int(o), owners)) for c, k, u, n, o in zip(got.code, got.k, got.unary, got.n, got.owner)]
        whole = np.concatenate(values)
        _, back, n = np.unique(whole, return_inverse=True, return_counts=True)
        elsewhere, at, out = n[back] > 1, 0, []
        for v in values:
            out.append(np.packbits(elsewhere[at : at + len(v)]).tobytes())
            at += len(v)
        return pd.DataFrame({"sender": got.sender, "owner": got.owner, "seen": out})

    return answer


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, again, ids, seen in zip(*(b.column(i).to_pylist() for i in range(4))):
            many = np.frombuffer(again, np.uint32)
            flag = (many > 1) | np.unpackbits(np.frombuffer(seen, np.uint8))[:n].astype(bool)
            out = np.unique(np.frombuffer(ids, np.int64)[np.repeat(flag, many)])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["doc_id"])


def _probes(bits: int, column: str = "doc_id"):
    h = F.xxhash64(column)
    return [F.pmod(F.shiftright(h, s), F.lit(bits)) for s in (0, 17, 34)]


def _bloom(suspects: DataFrame) -> tuple[np.ndarray, int]:
    bits = min(FILTER_BITS, max(1 << 10, 1 << math.ceil(math.log2(16 * max(1, suspects.count())))))
    words = suspects.select(F.explode(F.array(*_probes(bits))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("m"))
    # the driver gets blocks of 64 KB, 8 MB in all at most, not a row a word
    blocks = words.groupBy(F.shiftright("w", _BLOCK).alias("block")).applyInPandas(_one_block, "block bigint, raw binary").collect()
    out = np.zeros(max(bits // 64, 1 << _BLOCK), np.int64)
    for r in blocks:
        out[r.block << _BLOCK : (r.block + 1) << _BLOCK] = np.frombuffer(r.raw, np.int64)
    return out.view(np.uint64), bits


_BLOCK = 13


def _one_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    raw = np.zeros(1 << _BLOCK, np.int64)
    raw[rows.w.to_numpy(np.int64) & (1 << _BLOCK) - 1] = rows.m.to_numpy(np.int64)
    return pd.DataFrame({"block": [key[0]], "raw": [raw.tobytes()]})


def _passing(spark, bloom: np.ndarray, bits: int, column: str = "doc_id"):
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        table, ok = shared.value, np.ones(len(a), bool)
        for p in (a, b, c):
            p = p.to_numpy(np.int64)
            ok &= ((table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pd.Series(ok)

    return passes(*_probes(bits, column))


def groups(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    key = ["sha", "print", "size"]
    digests = [F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("print"), F.length("norm").alias("size")]
    prints = written(norm.select("doc_id", *digests), "prints")
    owners = max(shuffle_partitions(spark), math.ceil(prints.count() / OWNED))
    sent = written(prints.select("print", "doc_id").mapInArrow(frugal(_packets(owners)), _PACKET), "packets")
    answers = sent.select("sender", "owner", "n", "k", "unary", "code").groupBy("owner").applyInPandas(_answer(owners), "sender int, owner int, seen binary")
    suspects = written(
        sent.select("sender", "owner", "n", "again", "ids")
        .join(answers, ["sender", "owner"])
        .select("n", "again", "ids", "seen")
        .mapInArrow(frugal(_suspects), "doc_id bigint"),
        "suspects",
    )
    bloom, bits = _bloom(suspects)
    compared = (
        docs.where(F.col("doc_id").isNull() | _passing(spark, bloom, bits))
        .select("doc_id", normalised(F.col("text")).alias("norm"))
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(*digests, "keep_id", "group_size")
        .groupBy(*key)
        .agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .select(*key, "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share SHA-256, fingerprint and length")).cast("bigint")).alias("group_size"))
    )
    found = prints.join(compared, key, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


#: Ids that are broadcast, at most; more go into a Bloom filter.
FEW_IDS = 200_000


def apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` (with a column `id`) in two: rows that may be among `ids` (doc_id), or have none; and rows that surely are not, which need no join."""
    if ids.count() <= FEW_IDS:
        few = F.broadcast(ids.where("doc_id is not null").select(F.col("doc_id").alias("_few")).distinct())
        inside = F.col("id") == F.col("_few")
        return docs.join(few, inside, "left_semi").unionByName(docs.where("id is null")), docs.where("id is not null").join(few, inside, "left_anti")
    passes = _passing(docs.sparkSession, *_bloom(ids), column="id")
    return docs.where(F.col("id").isNull() | passes), docs.where(F.col("id").isNotNull() & ~passes)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one for each different text.

    Rows go by doc_id; among rows that share both doc_id and text (or have no doc_id), one of each text stays. Only
    rows that may have to go are shuffled.
    """
    decided = written(groups(docs), "decided")
    gone = written(decided.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct(), "gone")
    again = written(decided.where("kept and group_size > 1 and doc_id is not null").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id"), "again")
    body = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("bigint").alias("id"), docs["text"].cast("string").alias("own"))
    asked, rest = apart(body, gone.select(F.col("gone_id").alias("doc_id")).union(again))
    asked = asked.withColumn("own", F.sha2(normalised(F.col("own")), 256))
    left = asked.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("own") == F.col("gone_sha")), "left_anti")
    if not again.isEmpty() or not decided.where("doc_id is null").isEmpty():
        # rows that doc_id cannot tell apart; equal ones meet after partial aggregation
        known = decided.where("keep_id is not null and group_size > 1").select(F.col("text_sha256").alias("known_sha")).distinct()
        left = left.join(known, F.col("id").isNull() & (F.col("own") == F.col("known_sha")), "left_anti").dropDuplicates(["id", "own"])
    return left.select("row.*").unionByName(rest.select("row.*"))
