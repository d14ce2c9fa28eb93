"""The inverted index as a log of segments that API and streams write alike, and ranked search over it.

A commit adds blocks of postings, partitioned by a hash of the term; nothing of earlier commits is read or changed. Numbers of texts, their lengths and
document frequencies are sums of what commits have added and removals have taken away, so they are those of an index built anew. A search
reads the partitions of the terms that it asks for and, of those, first only what blocks say about themselves: their highest
count and shortest text bound what any of their texts can score. Blocks that cannot reach any request's threshold are not read; the postings
of the others are dealt by text, and each group of texts is scored against all requests at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import kept
from ..functions.stem import stem
from . import index
from .index import B, K1, LEAST_IDF, REMEMBERED

#: Partitions of the term space, and postings of a block, about.
PARTS, BLOCK = 64, 128
#: Blocks of each asked term that are scored first, to find the requests' thresholds.
SEEDS = 4
#: Bytes of text that a task inverts at once, about; groups that a term's full blocks are dealt to; postings of a group of texts that is scored at once, about.
AT_ONCE, SPREAD, GROUP = 16_000_000, 4, 1_000_000

BLOCKS = "kind string, term string, n int, most_tf long, least_size int, ids array<long>, sizes array<int>, tfs array<long>, positions array<array<int>>, part int"
STATS = "kind string, docs long, words long"
REMOVALS = "kind string, term string, part int, n long"
DEAD = "id long"


@dataclass(frozen=True)
class Index:
    """Rows as above, of a committed state; dead: texts that were removed, whose postings still lie in blocks until those are merged."""

    blocks: DataFrame
    stats: DataFrame
    removals: DataFrame
    dead: DataFrame


def part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def blocks(post: DataFrame, block: int = BLOCK) -> DataFrame:
    """post: kind, term, id, size, tf, positions. A term's postings are dealt to blocks by a hash of their ids, so a common term is never in one task."""
    pieces = post.groupBy(F.col("kind").alias("_k"), F.col("term").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    dealt = post.join(pieces, (F.col("kind") == F.col("_k")) & (F.col("term") == F.col("_t"))).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    own = F.array_sort(F.collect_list(F.struct("id", "size", "tf", "positions")))  # about `block` rows
    held = dealt.groupBy("kind", "term", "_b").agg(own.alias("p"))
    return held.select(
        "kind", "term", F.size("p").alias("n"), F.array_max("p.tf").alias("most_tf"), F.array_min("p.size").alias("least_size"),
        F.col("p.id").alias("ids"), F.col("p.size").alias("sizes"), F.col("p.tf").alias("tfs"), F.col("p.positions").alias("positions"), part(F.col("term")).alias("part"),
    )


_PACKED = "term string, n int, ids binary, sizes binary, tfs binary, positions binary"
_MERGED = "term string, n int, most_tf long, least_size int, ids array<long>, sizes array<int>, tfs array<long>, positions array<array<int>>, part int"


def inverted(tokens: DataFrame, kind: str, stems: bool = False, block: int = BLOCK) -> DataFrame:
    """Blocks of tokens (id, tokens), as `blocks` gives them of their postings.

    A text's tokens lie in one row, so tasks invert their own texts and no token is shuffled; what a task has of a term is sent packed to the term's
    partition, where pieces of a block or less are joined. Full ones are dealt to `SPREAD` groups. stems: the tokens' stems are the terms.
    """
    packed = tokens.where("size > 0").select("id", F.array_join("tokens", " ").alias("tokens")).mapInArrow(_inverted(stems, block), _PACKED).withColumn("part", part(F.col("term")))
    full = F.when(F.col("n") >= block, F.pmod(F.xxhash64("ids"), F.lit(SPREAD)) + 1).otherwise(0)
    merged = packed.repartition("part", full).sortWithinPartitions("part", "term").mapInArrow(_merged(block), _MERGED)
    return merged.select(F.lit(kind).alias("kind"), *merged.columns)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, which begin and end at `ends`, as binary."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a binary column, row after row."""
    runs = [np.zeros(0, np.uint8)]
    for chunk in column.cast(pa.binary()).chunks if isinstance(column, pa.ChunkedArray) else [column.cast(pa.binary())]:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else [0, 0]
        if offsets[-1] > offsets[0]:
            runs.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(runs).view(kind)


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _cut(code: np.ndarray, block: int) -> np.ndarray:
    """Where blocks of sorted codes begin and end: even cuts of each code's run."""
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    n = np.diff(starts, append=len(code))
    pieces = -(-n // block)
    at = np.arange(len(code)) - np.repeat(starts, n)
    piece = at * np.repeat(pieces, n) // np.repeat(n, n)
    return np.append(np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0)), len(code))


def _inverted(stems: bool, block: int):
    def run(batches):
        known: dict[str, str] = {}
        for batch in batches:
            bytes_ = _ends(pc.binary_length(batch.column(1)).to_numpy())
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bytes_, bytes_[first] + AT_ONCE, "right")) - 1)
                part = batch.slice(first, last - first)
                first = last
                part = part.take(pc.array_sort_indices(part.column(0)))
                lists = pc.split_pattern(part.column(1), " ")
                own = lists.flatten().dictionary_encode()
                size = pc.list_value_length(lists).to_numpy().astype(np.int64)
                code, terms = own.indices.to_numpy().astype(np.int64), own.dictionary
                if stems:  # each distinct word is stemmed once while it is remembered
                    if len(known) > REMEMBERED:
                        known.clear()
                    for w in terms.to_pylist():
                        if w not in known:
                            known[w] = stem(w)
                    stemmed = pa.array([known[w] for w in terms.to_pylist()], pa.string()).dictionary_encode()
                    code, terms = stemmed.indices.to_numpy().astype(np.int64)[code], stemmed.dictionary
                text = np.repeat(np.arange(len(size)), size)
                place = (np.arange(len(text)) - np.repeat(_ends(size)[:-1], size)).astype(np.int32)
                pair = code * len(size) + text
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
                starts = np.flatnonzero(np.diff(pair, prepend=-1))
                tf = np.diff(starts, append=len(pair)).astype(np.int32)
                code, text = np.divmod(pair[starts], len(size))
                cuts = _cut(code, block)
                ids, sizes = part.column(0).to_numpy()[text], size[text].astype(np.int32)
                packed = [_packed(ids, cuts), _packed(sizes, cuts), _packed(tf, cuts), _packed(place[order], np.append(starts, len(pair))[cuts])]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[cuts[:-1]])), pa.array(np.diff(cuts), pa.int32()), *packed], ["term", "n", "ids", "sizes", "tfs", "positions"])

    return run


def _merged(block: int):
    """Rows sorted by term to blocks; the last term's rows wait for the next batch, unless a batch has no other."""

    def joined(rows: pa.Table):
        term = rows["term"].combine_chunks().dictionary_encode()
        n = rows["n"].to_numpy()
        code = np.repeat(term.indices.to_numpy().astype(np.int64), n)
        ids, sizes, tfs, positions = (_unpacked(rows[c], kind) for c, kind in (("ids", np.int64), ("sizes", np.int32), ("tfs", np.int32), ("positions", np.int32)))
        order = np.lexsort([ids, code])
        starts = _ends(tfs)[:-1][order]
        ids, sizes, tfs, code = ids[order], sizes[order], tfs[order], code[order]
        ends = _ends(tfs)
        positions = positions[np.repeat(starts - ends[:-1], tfs) + np.arange(ends[-1])]
        cuts = _cut(code, block)
        first = cuts[:-1]
        part = np.empty(len(term.dictionary), np.int32)
        part[term.indices.to_numpy()] = rows["part"].to_numpy()
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions))
        arrays = [term.dictionary.take(pa.array(code[first])), pa.array(np.diff(cuts), pa.int32()), pa.array(np.maximum.reduceat(tfs, first), pa.int64()), pa.array(np.minimum.reduceat(sizes, first))]
        arrays += [lists(pa.array(ids)), lists(pa.array(sizes)), lists(pa.array(tfs, pa.int64())), lists(places), pa.array(part[code[first]])]
        return pa.RecordBatch.from_arrays(arrays, ["term", "n", "most_tf", "least_size", "ids", "sizes", "tfs", "positions", "part"])

    def run(batches):
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            last = pc.index(rows["term"], rows["term"][-1]).as_py() if rows.num_rows else 0
            waiting = rows.slice(last) if last else None
            if rows.num_rows:
                yield joined(rows.slice(0, last) if last else rows)
        if waiting is not None:
            yield joined(waiting)

    return run


def counted(tokens: DataFrame, kind: str, sign: int = 1) -> DataFrame:
    """What texts (tokens, size) add to the statistics, or with sign -1 take away. Null texts have a row whose words are null, so that they count but have no part in the average."""
    return tokens.groupBy(F.lit(kind).alias("kind"), F.col("tokens").isNull().alias("_null")).agg((F.count(F.lit(1)) * sign).alias("docs"), (F.sum(F.when(F.col("tokens").isNotNull(), F.col("size"))) * sign).alias("words")).drop("_null")


def stats(texts: DataFrame, id_: str, header: Column, body: Column, sign: int = 1) -> DataFrame:
    """What texts with words add to the statistics of both kinds, or with sign -1 take away."""
    whole = F.concat_ws("\n", F.nullif(header, F.lit("")), body)
    each = {"stem": index.tokenised(texts, id_, whole), "exact": index.tokenised(texts, id_, body, True)}
    return counted(each["stem"].where("size > 0"), "stem", sign).unionByName(counted(each["exact"].where("size > 0"), "exact", sign))


def removals(post: DataFrame) -> DataFrame:
    """What postings that go take from the document frequencies."""
    return post.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n")).select("kind", "term", part(F.col("term")).alias("part"), "n")


def postings(blocks_: DataFrame) -> DataFrame:
    """kind, term, id, size, tf, positions of blocks."""
    each = F.arrays_zip("ids", "sizes", "tfs", "positions")
    return blocks_.select("kind", "term", F.explode(each).alias("p")).select("kind", "term", F.col("p.ids").alias("id"), F.col("p.sizes").alias("size"), F.col("p.tfs").alias("tf"), F.col("p.positions").alias("positions"))


def asked_blocks(there: Index, kind: str, words: DataFrame) -> DataFrame:
    """Blocks of words (column term), from their partitions alone."""
    parts = [r.part for r in words.select(part(F.col("term")).alias("part")).distinct().collect()]  # PARTS at most
    return there.blocks.where((F.col("kind") == kind) & F.col("part").isin(parts)).join(index._few(words), "term")


def _share(tf: Column, size: Column, average: float) -> Column:
    """What a term's idf is multiplied with."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def search(there: Index, kind: str, queries: DataFrame, allowed: DataFrame | None = None, depth: int | None = 100, arm: str = "keyword", seeds: int = SEEDS) -> DataFrame:
    """Okapi BM25 as `index.bm25` gives it over all texts that are there. queries: query_id, terms (stems or exact tokens; with blanks: phrases)."""
    totals = there.stats.where(F.col("kind") == kind).agg(F.sum("docs").cast("double").alias("n_docs"), (F.sum("words") / F.sum(F.when(F.col("words").isNotNull(), F.col("docs")))).alias("avg_size"))
    asked = index.Asked.of(queries)
    if asked is None:
        asked, phrases = index._asked(queries)
        mine = asked_blocks(there, kind, asked.select(F.explode(F.split("term", " ")).alias("term")).distinct())
        return index._scored(postings(mine).join(there.dead, "id", "left_anti"), totals, asked, phrases, allowed, depth, arm)
    spark, word = queries.sparkSession, pa.array(np.arange(len(asked.words)), pa.int32())
    n_docs, average = totals.first()
    average = average or 1.0
    mine = asked_blocks(there, kind, spark.createDataFrame(pa.table({"term": asked.words, "word": word}))).withColumn("share", _share(F.col("most_tf"), F.col("least_size"), average))
    mine = kept(mine.select("term", "word", "n", "share", F.col("ids")[0].alias("first"), "ids", "sizes", "tfs"), "asked")
    place, df = {w: i for i, w in enumerate(asked.words.to_pylist())}, np.zeros(len(asked.words))
    for r in _frequencies(there, kind, mine).collect():  # a row for each asked word
        df[place[r.term]] = r.df
    with np.errstate(invalid="ignore"):
        weighed = Weighed(np.fmax(LEAST_IDF, np.log(((n_docs or 0.0) - df + 0.5) / (df + 0.5))), average, depth)
    if depth is None:
        return index.ranked(_scores(there, weighed, mine, asked, allowed), arm, depth)
    best = mine.select("word", "first", "share").withColumn("_n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("share"), "first"))).where(F.col("_n") <= seeds)
    seeded = mine.join(index._few(best.select("word", "first")), ["word", "first"], "left_semi")
    partial = index.ranked(_scores(there, weighed, seeded, asked, allowed), arm, depth)
    kth = {r.query_id: r.raw for r in partial.where(F.col("rank") == depth).select("query_id", "raw").collect()}  # a row for each request
    most = np.zeros(len(asked.words))
    for r in mine.groupBy("word").agg(F.max("share").alias("share")).collect():  # a row for each asked word
        most[r.word] = r.share * weighed.idf[r.word]
    # the least bound with which a block of the word can reach a request's threshold, whatever the request's other words give
    needed = np.full(len(asked.words), np.inf)
    for query, own in zip(asked.query_ids.to_pylist(), asked.places, strict=True):
        needed[own] = np.minimum(needed[own], kth.get(query, -np.inf) - 1e-6 - (most[own].sum() - most[own]))
    bounds = spark.createDataFrame(pa.table({"word": word, "needed": needed / weighed.idf}))
    chosen = mine.join(index._few(bounds), "word").where(F.col("share") >= F.col("needed"))
    return index.ranked(_scores(there, weighed, chosen, asked, allowed), arm, depth)


@dataclass(frozen=True)
class Weighed:
    """idf of each asked word, the texts' average size, and the number of results that a request gets (None: all)."""

    idf: np.ndarray
    average: float
    depth: int | None


def _frequencies(there: Index, kind: str, mine: DataFrame) -> DataFrame:
    """term, df: what commits have added less what removals took; terms that nothing has any more are not there."""
    gone = there.removals.where(F.col("kind") == kind).select("term", (-F.col("n")).alias("n"))
    held = mine.select("term", F.col("n").cast("long").alias("n"))
    known = held.select("term").distinct()
    return held.unionByName(gone.join(known, "term", "left_semi")).groupBy("term").agg(F.sum("n").cast("double").alias("df")).where("df > 0")


def _scores(there: Index, weighed: Weighed, chosen: DataFrame, asked: index.Asked, allowed: DataFrame | None) -> DataFrame:
    """query_id, id, raw, terms of all texts in chosen blocks (word, n, ids, sizes, tfs) that can be among the best.

    Postings are sent packed to groups of texts, as are the ids that are dead or, if some are, those allowed; a group has about `GROUP` postings.
    """
    groups = 1 + (chosen.agg(F.sum("n")).first()[0] or 0) // GROUP
    rows = chosen.select("word", "ids", "sizes", "tfs").mapInArrow(_dealt(groups), "g int, ids binary, words binary, sizes binary, tfs binary")
    ids = (there.dead if allowed is None else allowed).select("id").mapInArrow(_dealt_ids(groups), "g int, ids binary")
    return rows.groupBy("g").cogroup(ids.groupBy("g")).applyInArrow(_best(asked, weighed, allowed is not None), asked.kinds("long"))


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each id, by a multiplicative hash."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % groups


def _by_group(columns: dict[str, np.ndarray], groups: int) -> pa.RecordBatch:
    """A row for each group that has ids, with what is its own packed."""
    group = _group(columns["ids"], groups)
    order = np.argsort(group, kind="stable")
    n = np.bincount(group, minlength=groups)
    ends = np.append(0, np.cumsum(n[n > 0]))
    return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), *(_packed(v[order], ends) for v in columns.values())], ["g", *columns])


def _dealt(groups: int):
    def run(batches):
        for batch in batches:
            words, ids, sizes, tfs = (batch.column(i) for i in range(4))
            n = pc.list_value_length(ids).to_numpy()
            own = {"ids": ids.flatten().to_numpy(), "words": np.repeat(words.to_numpy(), n), "sizes": sizes.flatten().to_numpy(), "tfs": tfs.flatten().to_numpy().astype(np.int32)}
            yield _by_group(own, groups)

    return run


def _dealt_ids(groups: int):
    def run(batches):
        for batch in batches:
            yield _by_group({"ids": batch.column(0).drop_null().to_numpy()}, groups)

    return run


def _best(asked: index.Asked, weighed: Weighed, allowed: bool):
    """A group's postings and its ids that are allowed, or else dead, to what can be among the best of each request."""
    scores = index._scores(asked, weighed.idf, weighed.average, weighed.depth)
    empty = pa.schema([("query_id", asked.query_ids.type), ("id", pa.int64()), ("raw", pa.float64()), ("terms", pa.list_(pa.string()))]).empty_table()

    def run(posted: pa.Table, listed: pa.Table) -> pa.Table:
        ids, words, sizes, tfs = (_unpacked(posted[c], kind) for c, kind in (("ids", np.int64), ("words", np.int32), ("sizes", np.int32), ("tfs", np.int32)))
        there = np.isin(ids, _unpacked(listed["ids"], np.int64)) == allowed
        ids, words, sizes, tfs = ids[there], words[there], sizes[there], tfs[there]
        order = np.lexsort([words, ids])
        ids, words, sizes, tfs = ids[order], words[order], sizes[order], tfs[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(ids)), pa.int32())
        texts = [pa.array(ids[first]), pa.array(sizes[first]), pa.ListArray.from_arrays(ends, pa.array(words)), pa.ListArray.from_arrays(ends, pa.array(tfs))]
        found = list(scores([pa.RecordBatch.from_arrays(texts, ["id", "size", "words", "tfs"])])) if len(ids) else []
        return pa.Table.from_batches(found) if found else empty

    return run
