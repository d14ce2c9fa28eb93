"""How far each source's words are from those of other sources of its language, exactly, by a heavy-light split.

With c a term's count in a group (lang, source), N the group's counts of kept terms and V the language's kept terms,
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two shares p, q of a term differ by f = floor((p - q)^2 / (p + q)).

1. Tasks count terms by group and send one row for each (lang, term) they have met, with all its counts packed. Rows of a term
   meet in order in one task's stream and are added up; terms in fewer than `least_docs` documents go.
2. Terms that occur in more than a quarter of a language's groups are heavy: their shares fill dense tiles, terms by groups,
   and every pair of columns is summed.
3. Others are light. Where neither group has the term, f is the same for all of them, so it is multiplied by their number; a
   posting corrects its group's pairs with all groups, equal shares of a group together; and two postings of a term
   correct their pair again. Both parts are sums of integers, so their sum is exact.
4. Each posting above its language's share is a candidate of the `term` part; tasks send the ten highest of each group.

The groups' numbers, totals and names are known to every task: languages are dealt into parts of `PART_BYTES` of names at most (or
one language, whose result is the square of its groups).

Defined cases: null text, lang and source are empty texts; a group without terms has pairs all the same; a language without kept
terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows are documents each; very long
texts are counted whole; an empty table gives no rows; ties go by the item's UTF-8 bytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import part_of, parts_within
from .scratch import columns_apart, frugal, written
from .terms import LETTERS, found
from .words import slices

#: Bytes of the names of groups that are sent to every task, at most (or one language).
PART_BYTES = 8 << 20
#: Counts that a task holds before it sends them.
HELD = 2_000_000
#: Cells of a dense tile, and of a matrix of pairs that a task holds.
TILE, MATRIX = 1 << 18, 1 << 22

_POSTING = np.dtype([("g", "<i4"), ("n", "<i8")])
_SCALE = 1_000_000_000


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each row's bytes of a flat array; ends: of each row, in items."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * flat.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat).view(np.uint8))]).cast(pa.binary())


def _added(codes: np.ndarray, groups: np.ndarray, n_groups: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values added up by (code, group), in that order: codes, groups and sums."""
    key = codes.astype(np.int64) * n_groups + groups
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n_groups, key[first] % n_groups, *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


@dataclass(frozen=True)
class _Groups:
    """The groups of a part, those of a language in a row. first: each language's first group (one more than languages)."""

    names: dict[tuple[str, str], int]
    lang: np.ndarray
    first: np.ndarray


def _counted(groups: _Groups):
    n_groups = len(groups.lang)

    def sent(held: list[tuple]) -> pa.RecordBatch:
        spelled = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
        codes, g, n, docs = _added(spelled.indices.to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]), n_groups, *(np.concatenate([h[i] for h in held]) for i in (2, 3)))
        lang = groups.lang[g]
        first = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
        flat = np.empty(len(g), _POSTING)
        flat["g"], flat["n"] = g, n
        terms = spelled.dictionary.take(pa.array(codes[first])).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang[first].astype(np.int32)), terms, pa.array(np.add.reduceat(docs, first)), _binary(flat, np.append(first[1:], len(g)))], names=["lang", "term", "docs", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            of = np.array([groups.names[x] for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            at = 0
            for b in slices(batch, "text", 1 << 22):
                spelled, numbers, first = found(b.column("text"), LETTERS)
                own, at = of[at : at + b.num_rows], at + b.num_rows
                if not len(numbers):
                    continue
                key, n = np.unique(numbers.astype(np.int64) * b.num_rows + np.repeat(np.arange(b.num_rows), np.diff(first)), return_counts=True)
                codes, g, n, docs = _added(key // b.num_rows, own[key % b.num_rows], n_groups, n, np.ones(len(key), np.int64))
                held.append((spelled.take(pa.array(codes)), g, n, docs))
                size += len(g)
                if size > HELD:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    return run


def _merged(n_groups: int, least_docs: int):
    """Rows come in the order of (lang, term); those of a term are added up, across batches too, and terms of few documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None

        def runs(batch: pa.RecordBatch, closed: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
            lang, term = batch.column("lang").to_numpy(zero_copy_only=False), batch.column("term")
            new = np.ones(batch.num_rows, bool)
            new[1:] = (np.diff(lang) != 0) | pc.not_equal(term.slice(1), term.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            sizes = pc.binary_length(batch.column("postings")).to_numpy(zero_copy_only=False) // _POSTING.itemsize
            flat = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("postings")), _POSTING)
            code, g, n = _added(np.repeat(np.cumsum(new) - 1, sizes), flat["g"], n_groups, flat["n"])
            out = np.empty(len(g), _POSTING)
            out["g"], out["n"] = g, n
            picked = pa.array(first)
            docs = np.add.reduceat(batch.column("docs").to_numpy(zero_copy_only=False), first)
            whole = pa.RecordBatch.from_arrays([batch.column("lang").take(picked), term.take(picked), pa.array(docs), _binary(out, np.searchsorted(code, np.arange(len(first)), side="right"))], names=["lang", "term", "docs", "postings"])
            done, rest = (whole, None) if closed else (whole.slice(0, len(first) - 1), whole.slice(len(first) - 1))
            return done.filter(pc.greater_equal(done.column("docs"), least_docs)), rest

        for batch in batches:
            if batch.num_rows:
                if last is not None:
                    batch = pa.Table.from_batches([last, batch.cast(last.schema)]).combine_chunks().to_batches()[0]
                done, last = runs(batch, False)
                yield done
        if last is not None:
            yield runs(last, True)[0]

    return run


def _totals(n_groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_groups, np.int64)
        for b in batches:
            for x in b.column("postings"):
                own = np.frombuffer(x.as_buffer(), _POSTING)
                n[own["g"]] += own["n"]
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(n[have])], names=["g", "n"])

    return run


def shares(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / base), exactly however large a count is."""
    if len(counts) and int(counts.max()) > 9_000_000_000:
        return np.array([1 + _SCALE * (c + 2) // b for c, b in zip(counts.tolist(), np.broadcast_to(base, counts.shape).tolist())], np.int64)
    return 1 + (_SCALE * (counts + 2)) // base


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(term: np.ndarray, g: np.ndarray, p: np.ndarray, none: np.ndarray, a: int, z: int) -> np.ndarray:
    """Sums of f over terms, for groups a to z - 1 (rows) and those after each of them (columns).

    term, g, p: postings by term and group, terms numbered from 0 without gaps; none: each group's share of a term that it does not have.
    """
    n_groups, n_terms = len(none), int(term[-1]) + 1
    wide = np.bincount(term, minlength=n_terms)
    out = np.zeros((z - a, n_groups), np.int64)
    heavy = np.flatnonzero(4 * wide > n_groups)
    row = np.full(n_terms, -1)
    row[heavy] = np.arange(len(heavy))
    dense = row[term] >= 0
    hr, hg, hp = row[term[dense]], g[dense], p[dense]
    step = max(1, TILE // n_groups)
    for at in range(0, len(heavy), step):
        tile = np.repeat(none[:, None], min(step, len(heavy) - at), axis=1)
        i, j = np.searchsorted(hr, (at, at + step))
        tile[hg[i:j], hr[i:j] - at] = hp[i:j]
        for r in range(a, min(z, n_groups - 1)):
            out[r - a, r + 1 :] += _apart(tile[r + 1 :], tile[r]).sum(axis=1)
    light = n_terms - len(heavy)
    if not light:
        return out
    out += light * _apart(none[a:z, None], none[None, :])
    lt, lg, lp = term[~dense], g[~dense], p[~dense]
    key, n = np.unique(lg.astype(np.int64) << 31 | lp, return_counts=True)
    ug, up = key >> 31, key & (1 << 31) - 1
    step = max(1, TILE // n_groups)
    for at in range(0, len(key), step):
        own, share, times = ug[at : at + step], up[at : at + step], n[at : at + step, None]
        more = times * (_apart(share[:, None], none[None, :]) - _apart(none[own][:, None], none[None, :]))
        inside = (own >= a) & (own < z)
        np.add.at(out, own[inside] - a, more[inside])
        np.add.at(out.T, own, more[:, a:z])
    start = np.flatnonzero(np.diff(lt, prepend=-1))
    size = np.diff(np.append(start, len(lt)))
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(k, 1)
        own = start[size == k]
        step = max(1, TILE // len(i))
        for at in range(0, len(own), step):
            place = own[at : at + step, None] + np.arange(k)
            x, y, px, py = (v[place][:, w] for v, w in ((lg, i), (lg, j), (lp, i), (lp, j)))
            more = _apart(px, py) - _apart(px, none[y]) - _apart(none[x], py) + _apart(none[x], none[y])
            inside = (x >= a) & (x < z)
            np.add.at(out, (x[inside] - a, y[inside]), more[inside])
    return out


_PART = "lang int, g int, h int, term string, value bigint"


def _compared(groups: _Groups, totals: np.ndarray, kept: np.ndarray, top: int):
    """Partial sums of pairs (g < h), and of each group the terms that may be among its highest (h null)."""
    base = totals + 2 * kept[groups.lang]
    none = shares(np.zeros(len(base), np.int64), np.maximum(base, 1))
    whole = np.add.reduceat(totals, groups.first[:-1]) + 2 * kept if len(kept) else kept

    def rows(lang: int, g: np.ndarray, h: np.ndarray | None, term: pa.Array | None, value: np.ndarray) -> pa.RecordBatch:
        n = len(g)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, lang, np.int32)), pa.array(g, pa.int32()), pa.nulls(n, pa.int32()) if h is None else pa.array(h, pa.int32()), pa.nulls(n, pa.string()) if term is None else term, pa.array(value, pa.int64())], names=["lang", "g", "h", "term", "value"])

    def pairs(lang: int, sums: np.ndarray, a: int) -> pa.RecordBatch:
        r, h = np.nonzero(np.arange(sums.shape[1])[None, :] > np.arange(a, a + len(sums))[:, None])
        return rows(lang, groups.first[lang] + a + r, groups.first[lang] + h, None, sums[r, h])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in np.unique(langs).tolist():
                b = batch.filter(pa.array(langs == lang))
                flat = np.frombuffer(b"".join(x.as_buffer() for x in b.column("postings")), _POSTING)
                term = np.repeat(np.arange(b.num_rows), pc.binary_length(b.column("postings")).to_numpy(zero_copy_only=False) // _POSTING.itemsize)
                first, n_groups = int(groups.first[lang]), int(groups.first[lang + 1] - groups.first[lang])
                p = shares(flat["n"], base[flat["g"]])
                # the highest terms of each group
                of_lang = shares(np.add.reduceat(flat["n"], np.flatnonzero(np.diff(term, prepend=-1))), whole[lang])
                above = np.flatnonzero(p > of_lang[term])
                value = _apart(p[above], of_lang[term[above]])
                alphabetical = np.empty(b.num_rows, np.int64)
                alphabetical[pc.sort_indices(b.column("term")).to_numpy()] = np.arange(b.num_rows)
                order = np.lexsort((alphabetical[term[above]], -value, flat["g"][above]))
                g = flat["g"][above][order]
                at = np.arange(len(g)) - np.searchsorted(g, g)
                best = order[at < top]
                yield rows(lang, flat["g"][above[best]], None, b.column("term").take(pa.array(term[above[best]])), value[best])
                # all pairs of groups
                local, absent = flat["g"].astype(np.int64) - first, none[first : first + n_groups]
                if n_groups * n_groups > MATRIX:
                    step = max(1, MATRIX // n_groups)
                    for a in range(0, n_groups, step):
                        yield pairs(lang, pair_sums(term, local, p, absent, a, min(a + step, n_groups)), a)
                    continue
                held[lang] = held.get(lang, 0) + pair_sums(term, local, p, absent, 0, n_groups)
                if sum(x.size for x in held.values()) > MATRIX:
                    for done, sums in held.items():
                        yield pairs(done, sums, 0)
                    held = {}
        for lang, sums in held.items():
            yield pairs(lang, sums, 0)

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    docs = columns_apart(docs, {"text": ("text", "string"), "lang": ("lang", "string"), "source": ("source", "string")}).fillna("", ["text", "lang", "source"])
    named = written(docs.select("lang", "source").distinct(), "groups")
    parts = parts_within(named.groupBy("lang").agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 32).alias("bytes")), "lang", part_bytes)
    out = [_audited(docs.where(part_of("lang", parts) == i), named.where(part_of("lang", parts) == i), least_docs, top) for i in range(parts)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def _audited(docs: DataFrame, named: DataFrame, least_docs: int, top: int) -> DataFrame:
    spark = docs.sparkSession
    found_groups = sorted((r.lang, r.source) for r in named.collect())  # `part_bytes` at most, or one language
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in found_groups))}
    lang = np.array([langs[x] for x, _ in found_groups], np.int64)
    groups = _Groups({x: i for i, x in enumerate(found_groups)}, lang, np.searchsorted(lang, np.arange(len(langs) + 1)))
    n_groups = len(found_groups)
    counted = docs.mapInArrow(frugal(_counted(groups)), "lang int, term string, docs bigint, postings binary")
    merged = counted.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(frugal(_merged(n_groups, least_docs)), "lang int, term string, docs bigint, postings binary")
    merged = written(merged, "postings")
    totals, kept = np.zeros(n_groups, np.int64), np.zeros(len(langs), np.int64)
    for r in merged.select("postings").mapInArrow(frugal(_totals(n_groups)), "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        totals[r.g] = r.n
    for r in merged.groupBy("lang").count().collect():
        kept[r.lang] = r["count"]
    compared = written(merged.select("lang", "term", "postings").mapInArrow(frugal(_compared(groups, totals, kept, top)), _PART), "compared")
    names = spark.createDataFrame([(i, int(lang[i]), *x) for i, x in enumerate(found_groups)], "g int, l int, lang string, source string")
    other = names.select(F.col("g").alias("h"), F.col("l").alias("m"), F.col("source").alias("item"))
    sums = compared.where("h is not null").groupBy("g", "h").agg(F.sum("value").alias("value")).select(F.col("g").alias("low"), F.col("h").alias("high"), "value")
    pairs = (
        names.join(F.broadcast(other), (F.col("l") == F.col("m")) & (F.col("g") != F.col("h")))
        .join(sums, (F.least("g", "h") == F.col("low")) & (F.greatest("g", "h") == F.col("high")), "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    )
    terms = compared.where("h is null").select("g", F.col("term").alias("item"), "value").join(F.broadcast(names), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    ranked = [x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
