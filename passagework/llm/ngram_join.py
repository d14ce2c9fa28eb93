"""Near-duplicate documents by Jaccard similarity of five-word shingles: an LSH forest, then exact verification.

Words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words has one shingle, all its words. Documents with the same words in
the same order are one text from the start. Each text gets `TRIES` labels of `DEPTH` minimum hashes; a label's
prefixes are the nodes of a sorted trie. Two texts meet in a trie if their labels share a prefix of the matched
length, and that length is shortened from `DEPTH` on until a pair at the threshold itself meets with a chance of `recall`;
every more similar pair meets with a greater one, whatever else the corpus holds. Every pair that meets is then
verified on its whole shingle sets.

Small nodes give pairs, which are joined with their texts' shingles. Large nodes (near copies by the thousand)
never give pairs: their texts meet in blocks of bounded size that count links and give local components. A pair
in several nodes is counted in one of them.

Defined cases: a null text or one without words has no links and a class of its own; rows without doc_id are in the
class of an equal text that has one, else have none; rows that repeat a doc_id share its class; an empty table gives no rows.
A very long text is one row with all its shingles; ties do not arise, as a class goes by its smallest doc_id; extra columns are ignored
by `classes` and kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import _bloom, _passing, apart
from .scratch import columns_apart, frugal, written
from .words import find, hashed, mix, shingles, slices, utf8

WIDTH, TRIES, DEPTH = 5, 16, 8
#: Texts in a node that are still compared as pairs.
SMALL = 32
#: Texts of a block of a large node, least and most (a quarter of the node in between), and shingles, about.
LEAST_BLOCK, BLOCK_TEXTS, BLOCK_SHINGLES = 256, 2048, 1_000_000
_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 2**32, TRIES * DEPTH, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, TRIES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes (16 bits of each) of every row that has shingles."""
    some = at[:-1][np.diff(at) > 0]
    h = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(some), TRIES * DEPTH), np.uint16)
    for i in range(TRIES * DEPTH):
        x = (h ^ _FLIP[i]) * _TIMES[i]
        low = np.minimum.reduceat(x ^ (x >> np.uint32(15)), some) if len(some) else np.zeros(0, np.uint32)
        out[:, i] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


_SIGNED = "doc_id bigint, c1 bigint, c2 bigint, n bigint, sig binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, ends, at = find(data, rows)
            words = hashed(data, starts, ends)
            runs, run_at = shingles(words, at, WIDTH)
            count = np.diff(at)
            place = (np.arange(len(words)) - at[np.repeat(np.arange(len(count)), count)]).astype(np.uint64)
            ids = []
            for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place + salt)), dtype=np.uint64)])
                ids.append(mix(total[at[1:]] - total[at[:-1]] + salt).view(np.int64))
            n = np.diff(run_at)
            sig, k = [None] * len(n), 0
            signed = signatures(runs, run_at)
            for i in np.flatnonzero(n):
                sig[i] = signed[k].tobytes()
                k += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids[0]), pa.array(ids[1]), pa.array(n), pa.array(sig, pa.binary())], names=["doc_id", "c1", "c2", "n", "sig"])


def met(similarity: np.ndarray, depth: int) -> np.ndarray:
    """The chance that a pair shares a prefix of this length in one trie at least."""
    return 1 - (1 - similarity**depth) ** TRIES


def prefix_length(threshold: float, recall: float) -> int:
    """The longest prefix with which pairs at the threshold, and so all above it, meet the recall target."""
    depth = DEPTH
    while depth > 1 and met(np.array(threshold), depth) < recall:
        depth -= 1
    return depth


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, ends, at = find(data, rows)
            runs, run_at = shingles(hashed(data, starts, ends), at, WIDTH)
            sets = [np.unique(runs[a:z]).tobytes() for a, z in zip(run_at[:-1], run_at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "set"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    common = len(a) + len(b) - len(np.union1d(a, b))
    return common / (len(a) + len(b) - common)


def _close(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            columns = [x.column(c).to_pylist() for c in ("set_a", "set_b")]
            keep = []
            for sa, sb in zip(*columns):
                n, m = sorted((len(sa), len(sb)))
                keep.append(n >= threshold * m and jaccard(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)) >= threshold)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bitsets(sets: list[np.ndarray]) -> np.ndarray | None:
    """A row of bits for each set, over what two or more of them share; None if that is too large."""
    value, back, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    wide = -(-max(1, int((n > 1).sum())) // 64)
    if wide * len(sets) > 8_000_000:
        return None
    bits, at = np.zeros((len(sets), wide), np.uint64), 0
    for i, s in enumerate(sets):
        p = back[at : at + len(s)]
        p = place[p[n[p] > 1]]
        np.bitwise_or.at(bits[i], p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        at += len(s)
    return bits


def _block(threshold: float):
    """All pairs of one block, or between two blocks, of a large node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, trie, first, second = key
        ids, block, copies = rows.id.to_numpy(), rows.block.to_numpy(), rows.copies.to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
        size = np.array([len(s) for s in sets])
        large = np.zeros((len(ids), TRIES), np.int64)
        for i, pairs in enumerate(rows.large):
            for p in pairs:
                large[i, p["trie"]] = p["key"]
        bits, links, root = _bitsets(sets), np.zeros(len(ids), np.int64), np.arange(len(ids))
        whole = np.arange(len(ids))
        for i in whole:
            others = whole[i + 1 :] if first == second else whole[block == second] if block[i] == first else whole[:0]
            low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            others = others[low >= threshold * high]
            if not len(others):
                continue
            if bits is not None:
                common = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
                like = common / (size[others] + size[i] - common)
            else:
                like = np.array([jaccard(sets[i], sets[j]) for j in others])
            others = others[like >= threshold]
            if not len(others):
                continue
            shared = (large[others] == large[i]) & (large[i] != 0)
            here = others[shared.argmax(axis=1) == trie]
            links[i] += copies[here].sum()
            links[here] += copies[i]
            joined = np.unique(np.append(root[others], root[i]))
            root[np.isin(root, joined)] = joined[0]
        return pd.DataFrame({"id": ids, "root": ids[root], "links": links})

    return run


def classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """For each row: doc_id, class_id (smallest doc_id of its connected class), n_links (other rows it is linked with), group_size (rows with its very words)."""
    spark = docs.sparkSession
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    signed = written(docs.mapInArrow(frugal(_signed), _SIGNED), "signed")
    by_text = signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    texts = written(by_text, "texts")
    whole = texts.where("sig is not null and id is not null")
    depth = prefix_length(threshold, recall)
    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: F.struct(t.alias("trie"), F.xxhash64(t, F.col("sig").substr(t * (2 * DEPTH) + 1, F.lit(2 * depth))).alias("key")))
    nodes = whole.select("id", "n", F.explode(tries).alias("x")).select("id", "n", "x.trie", "x.key")
    met_in = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles")).where("texts > 1")
    members = written(nodes.join(met_in, "key").select("key", "trie", "id", "texts", "shingles"), "members")

    few = members.where(F.col("texts") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    two = F.expr("explode(flatten(transform(ids, (a, i) -> transform(slice(ids, i + 2, size(ids)), b -> struct(a, b)))))")
    pairs = written(few.select(two.alias("p")).select("p.a", "p.b").where("a < b").distinct(), "pairs")
    many = members.where(F.col("texts") > SMALL)
    large = many.groupBy("id").agg(F.collect_list(F.struct("trie", "key")).alias("large"))

    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(many.select("id")).distinct(), "wanted")
    passing = docs.where("doc_id is not null and text is not null").where(_passing(spark, *_bloom(wanted)))
    sets = passing.mapInArrow(frugal(_shingle_sets), "id bigint, set binary")
    facts = whole.select("id", "copies").join(large, "id", "left")
    sets = sets.join(wanted, sets["id"] == wanted["doc_id"]).drop("doc_id").dropDuplicates(["id"])
    sets = written(sets.join(facts, "id"), "sets")

    side = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"set_{s}"), F.transform(F.coalesce("large", F.array()), lambda x: x["key"]).alias(f"large_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("large_a", "large_b"))
    close = written(both.select("a", "b", "set_a", "set_b").mapInArrow(frugal(_close(threshold)), "a bigint, b bigint"), "close")

    own = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK_TEXTS), F.col("texts") / 4))
    n_blocks = F.greatest(F.ceil(F.col("texts") / own), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = many.select("key", "trie", "id", n_blocks.alias("k")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = blocks.select("key", "trie", "id", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    counted = blocks.join(sets, "id").groupBy("key", "trie", "first", "second").applyInPandas(_block(threshold), "id bigint, root bigint, links bigint")
    counted = written(counted, "counted")

    copies = sets.select(F.col("id").alias("of"), "copies")
    linked = close.select("a", F.col("b").alias("of")).union(close.select("b", "a")).join(copies, "of").select(F.col("a").alias("id"), F.col("copies").alias("links"))
    links = linked.union(counted.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(close.union(counted.select("id", "root")))
    named = texts.select("c1", "c2", "id", "copies", "sig").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    named = named.select("c1", "c2", "copies", F.col("sig").isNull().alias("empty"), F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "c1", "c2").join(named, ["c1", "c2"])
    return out.select(
        "doc_id",
        F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("empty"), F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(F.col("empty"), F.lit(1)).otherwise(F.col("copies")).cast("bigint").alias("group_size"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """The rows of `docs`, all columns, whose document is the first of its class; rows without doc_id stay."""
    found = classes(docs, threshold, recall)
    gone = written(found.where("doc_id <> class_id").select("doc_id").distinct(), "gone")
    body = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("bigint").alias("id"))
    asked, rest = apart(body, gone)
    left = asked.join(gone, F.col("id") == F.col("doc_id"), "left_anti")
    return left.select("row.*").unionByName(rest.select("row.*"))
