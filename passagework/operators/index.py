"""Inverted index and vector tables as DataFrames, and ranked scans over them.

Rankings have one schema: query_id, arm, id, rank, raw. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.scratch import kept
from ..functions.stem import stem, stem_phrases, stem_words

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Asked words up to which they are sent to the tokens; a larger batch is joined by shuffling.
FEW_WORDS = 200_000
#: Words whose stems a task remembers.
REMEMBERED = 500_000
#: Query vectors that are broadcast at once.
FEW_QUERIES = 10_000

def tokenised(texts: DataFrame, id_: str, body: Column, exact: bool = False) -> DataFrame:
    """id, tokens (folded), size of each text."""
    body = X.fold(body)
    return texts.select(F.col(id_).alias("id"), (X.exact_tokens(body) if exact else X.word_tokens(body)).alias("tokens")).withColumn("size", F.size("tokens"))


def postings(tokens: DataFrame, only: list[str] | None = None) -> DataFrame:
    """term, id, size, tf, positions (from 0). only: words beside which none is shuffled."""
    spread = tokens.select("id", "size", F.posexplode("tokens").alias("pos", "term"))
    spread = spread if only is None else spread.where(F.col("term").isin(only))
    return spread.groupBy("term", "id", "size").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """term, stem: each distinct term is stemmed once."""
    return tokens.select(F.explode("tokens").alias("term")).distinct().select("term", stem_words("term").alias("stem"))


def stemmed(tokens: DataFrame) -> DataFrame:
    """Postings of stems: terms of one stem in a text are one, with all their positions."""
    spelled = postings(tokens).join(vocabulary(tokens).withColumnRenamed("term", "_t"), F.col("term") == F.col("_t"))
    merged = spelled.groupBy(F.col("stem").alias("term"), "id", "size").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged


def stored(texts: DataFrame, id_: str, header: Column, body: Column) -> DataFrame:
    """What an ingest writes: postings of both kinds, `stem` over header and text, `exact` over the text alone."""
    whole = F.concat_ws("\n", F.nullif(header, F.lit("")), body)
    stems = stemmed(tokenised(texts, id_, whole)).select(F.lit("stem").alias("kind"), "*")
    return stems.unionByName(postings(tokenised(texts, id_, body, True)).select(F.lit("exact").alias("kind"), "*"))


def stem_terms(queries: DataFrame, terms: str = "terms") -> DataFrame:
    """Query words as the stemmed index has them: folded and stemmed, a word with `_` as the phrase of its parts (joined by blanks)."""
    return queries.withColumn(terms, stem_phrases(F.transform(terms, lambda w: X.fold(w))))


def idf(n_docs: Column, n: Column) -> Column:
    return F.greatest(F.lit(LEAST_IDF), F.log((n_docs - n + 0.5) / (n + 0.5)))


def _few(words: DataFrame) -> DataFrame:
    """A frame of words as the side to broadcast, if its checked size allows."""
    return F.broadcast(words) if words.count() <= FEW_WORDS else words


def _asked(queries: DataFrame) -> tuple[DataFrame, bool]:
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    return asked, not asked.where(F.contains("term", F.lit(" "))).isEmpty()


def bm25(tokens: DataFrame, queries: DataFrame, allowed: DataFrame | None = None, depth: int | None = 100, arm: str = "keyword", stems: bool = False) -> DataFrame:
    """Okapi BM25 of every query over one tokenised table; statistics are of the whole table, `allowed` (id) only filters.

    queries: query_id, terms; a term with blanks is a phrase. stems: the terms are stems (see stem_terms). A batch of requests of up to `FEW_WORDS`
    words is sent to the texts (see `Asked`); phrases and larger batches shuffle the postings of their words.
    """
    asked = Asked.of(queries)
    if asked is None:
        return _shuffled(tokens, queries, allowed, depth, arm, stems)
    held = kept(asked.held(tokens, stems), "held")
    counts = asked.counted(held).get(0)
    if allowed is not None:
        held = held.join(allowed.select("id"), "id", "left_semi")
    return ranked(asked.best(held, counts, depth), arm, depth)


def _shuffled(tokens: DataFrame, queries: DataFrame, allowed: DataFrame | None, depth: int | None, arm: str, stems: bool) -> DataFrame:
    """Words that no query has are dropped before they are shuffled, and an empty word of each text carries its size to the statistics; with stems, the
    table's distinct words are stemmed first, and those with an asked stem looked up."""
    asked, phrases = _asked(queries)
    words = asked.select(F.explode(F.split("term", " ")).alias("asked")).distinct()
    words = vocabulary(tokens).join(words, F.col("stem") == F.col("asked")).select("term", "stem") if stems else words.select(F.col("asked").alias("term"), F.col("asked").alias("stem"))
    words = words.union(queries.sparkSession.createDataFrame([("", "")], "term string, stem string"))
    spread = tokens.select("id", "size", F.posexplode(F.concat(F.coalesce("tokens", F.array()), F.array(F.lit("")))).alias("pos", "word"))
    spread = spread.join(_few(words), F.col("word") == F.col("term")).select("id", "size", "pos", F.col("stem").alias("term"))
    places = [F.collect_list("pos").alias("positions")] if phrases else []
    post = spread.groupBy("term", "id", "size").agg(F.count(F.lit(1)).alias("tf"), *places)
    totals = post.where("term = ''").agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("size").alias("avg_size"))
    return _scored(post.where("term <> ''"), totals, asked, phrases, allowed, depth, arm)


@dataclass(frozen=True)
class Counts:
    """Texts, those that are not null, all their tokens, and of each asked word the texts that have it."""

    docs: int
    known: int
    tokens: int
    df: np.ndarray

    def __add__(self, other: Counts) -> Counts:
        return Counts(self.docs + other.docs, self.known + other.known, self.tokens + other.tokens, self.df + other.df)


@dataclass(frozen=True)
class Asked:
    """A batch of requests in the tasks: its distinct words in order, and of each request the places of its words there.

    A text's tokens lie in one row, so its counts of asked words need no shuffle: they are written once as numbers, counted, and scored batch by batch
    against all requests; a task gives what can be among the best of each request, as `nearest` does.
    """

    query_ids: pa.Array
    words: pa.Array
    places: tuple[np.ndarray, ...]

    @staticmethod
    def of(queries: DataFrame) -> Asked | None:
        """None for a batch with phrases or of more than `FEW_WORDS` words."""
        rows = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).limit(FEW_WORDS + 1).toArrow()
        if rows.num_rows > FEW_WORDS or pc.any(pc.match_substring(rows["term"], " ")).as_py():
            return None
        rows = rows.cast(pa.schema([rows.schema.field("query_id"), ("term", pa.string())])).sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
        words = pc.unique(rows["term"]).sort()
        own = rows["query_id"].combine_chunks().dictionary_encode() if rows.num_rows else None
        if own is None:
            return Asked(pa.array([], rows.schema.field("query_id").type), words, ())
        place, of = pc.index_in(rows["term"], value_set=words).to_numpy(), own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(of)) + 1
        first = np.concatenate([[0], cuts])
        return Asked(rows["query_id"].combine_chunks().take(pa.array(first)), words, tuple(np.split(place, cuts)))

    def held(self, tokens: DataFrame, stems: bool) -> DataFrame:
        """id, size, part (0 if tokens has none), words (places of asked words that the text has) and tfs."""
        joined = F.array_join("tokens", " ").alias("tokens")  # one string goes to Python faster than its words
        rows = tokens.select("id", "size", joined, (F.col("part") if "part" in tokens.columns else F.lit(0)).cast("int").alias("part"))
        return rows.mapInArrow(_held(self.words, stems), f"id {dict(tokens.dtypes)['id']}, size int, part int, words array<int>, tfs array<int>")

    def counted(self, held: DataFrame) -> dict[int, Counts]:
        """By part; what reaches the driver is a number a part and asked word."""
        size = len(self.words) + 3
        rows = held.select("part", "size", "words").mapInArrow(_counted(size), "part int, word int, n long").groupBy("part", "word").agg(F.sum("n").alias("n")).collect()
        out: dict[int, np.ndarray] = {}
        for r in rows:
            out.setdefault(r.part, np.zeros(size, np.int64))[r.word] = r.n
        return {part: Counts(*map(int, n[-3:]), n[:-3]) for part, n in out.items()}

    def best(self, held: DataFrame, counts: Counts | None, depth: int | None) -> DataFrame:
        """query_id, id, raw, terms of all that can be among the best."""
        counts = counts or Counts(0, 0, 0, np.zeros(len(self.words), np.int64))
        weights = np.maximum(LEAST_IDF, np.log((counts.docs - counts.df + 0.5) / (counts.df + 0.5)))
        average = counts.tokens / counts.known if counts.tokens else 1.0
        return held.select("id", "size", "words", "tfs").mapInArrow(_scores(self, weights, average, depth), self.kinds(dict(held.dtypes)["id"]))

    def kinds(self, id_: str) -> str:
        """The columns of what can be among the best, for ids of a type."""
        from pyspark.sql.pandas.types import from_arrow_type

        return f"query_id {from_arrow_type(self.query_ids.type).simpleString()}, id {id_}, raw double, terms array<string>"


def _held(words: pa.Array, stems: bool):
    def run(batches):
        known: dict[str, int] = {}
        place = {w: i for i, w in enumerate(words.to_pylist())} if stems else {}
        for batch in batches:
            lists = pc.split_pattern(batch.column(2), " ")
            flat = lists.flatten()
            if stems:  # each distinct word of a batch is looked up, and stemmed once while it is remembered
                own = flat.dictionary_encode()
                if len(known) > REMEMBERED:
                    known.clear()
                spelled = own.dictionary.to_pylist()
                for w in spelled:
                    if w not in known:
                        known[w] = place.get(stem(w), -1)
                code = np.array([known[w] for w in spelled], np.int64)[own.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
            else:
                code = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            met = code >= 0
            pairs, tfs = np.unique(text[met] * max(1, len(words)) + code[met], return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(words)), minlength=batch.num_rows))]), pa.int32())
            places = pa.ListArray.from_arrays(ends, pa.array(pairs % max(1, len(words)), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), places, pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["id", "size", "part", "words", "tfs"])

    return run


def _counted(size: int):
    """The last three places hold the texts, those that are not null, and their tokens."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for part in np.unique(parts).tolist():
                own = batch.filter(pa.array(parts == part))
                n = sums.setdefault(part, np.zeros(size, np.int64))
                n += np.bincount(own.column(2).flatten().to_numpy(), minlength=size)
                n[-3] += own.num_rows
                n[-2] += own.num_rows - own.column(1).null_count
                n[-1] += pc.sum(own.column(1)).as_py() or 0
        for part, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], ["part", "word", "n"])

    return run


def _scores(asked: Asked, weights: np.ndarray, average: float, depth: int | None):
    """Batches of id, size, words, tfs to what can be among the best of each request; of texts of one and the same score the `depth` smallest ids stay."""
    query_ids, words, places = asked.query_ids, asked.words, asked.places

    def run(batches):
        step = max(1, SCORES // max(1, len(places)))
        best = np.full((len(places), depth or 0), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows if places else 0, step):
                part = batch.slice(start, step)
                n, ids = part.num_rows, part.column(0)
                text = np.repeat(np.arange(n), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
                word, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.float64)
                size = part.column(1).fill_null(0).to_numpy()[text]
                score = weights[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
                order = np.argsort(word, kind="stable")
                word, text, score = word[order], text[order], score[order]
                cuts = np.searchsorted(word, np.arange(len(words) + 1))
                met = [np.concatenate([np.arange(cuts[w], cuts[w + 1]) for w in own]) for own in places]
                raw = np.stack([np.bincount(text[m], score[m], minlength=n) for m in met])
                keep = raw > 0
                if depth:
                    best = np.partition(np.hstack([best, raw]), -depth, axis=1)[:, -depth:]
                    keep &= raw >= best.min(axis=1, keepdims=True) - 2e-9
                place = np.empty(n, np.int64)
                place[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
                for q in np.flatnonzero(keep.any(axis=1)):
                    found = np.flatnonzero(keep[q])
                    if depth and len(found) > depth:
                        by = np.lexsort([place[found], -raw[q, found]])
                        same = raw[q, found[by]]
                        first = np.searchsorted(-same, -same)
                        found = np.sort(found[by[np.arange(len(by)) - first < depth]])
                    mine = np.zeros(n, bool)
                    mine[found] = True
                    at = met[q][mine[text[met[q]]]]
                    at = at[np.argsort(text[at], kind="stable")]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=n)[found])])
                    terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(word[at])))
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(np.full(len(found), q))), ids.take(pa.array(found)), pa.array(raw[q, found]), terms], ["query_id", "id", "raw", "terms"])

    return run


def phrase_hits(post: DataFrame, phrases: DataFrame) -> DataFrame:
    """term, id, size, tf of phrases (column term, words joined by blanks): how often the words follow each other, by positions alone."""
    parts = phrases.select(F.col("term").alias("phrase"), F.posexplode(F.split("term", " ")).alias("k", "word"), F.size(F.split("term", " ")).alias("n"))
    met = post.join(parts, F.col("term") == F.col("word")).select("phrase", "n", "id", "size", "k", F.explode("positions").alias("pos"))
    whole = met.groupBy("phrase", "n", "id", "size", (F.col("pos") - F.col("k")).alias("start")).agg(F.countDistinct("k").alias("got")).where("got = n")
    return whole.groupBy(F.col("phrase").alias("term"), "id", "size").agg(F.count(F.lit(1)).alias("tf"))


def _scored(post: DataFrame, totals: DataFrame, asked: DataFrame, phrases: bool, allowed: DataFrame | None, depth: int | None, arm: str) -> DataFrame:
    columns = ["term", "id", "size", "tf"]
    hits = post.select(*columns)
    if phrases:
        several = asked.select("term").where(F.contains("term", F.lit(" "))).distinct()
        hits = hits.unionByName(phrase_hits(post, several).select(*columns))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weighed = hits.join(df, "term").crossJoin(F.broadcast(totals))  # one row
    score = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    weighed = weighed.select("id", "term", score.alias("score"))
    if allowed is not None:
        weighed = weighed.join(allowed.select("id"), "id", "left_semi")
    scored = asked.join(weighed, "term").groupBy("query_id", "id").agg(F.sum("score").alias("raw"), F.array_sort(F.collect_set("term")).alias("terms"))
    return ranked(scored, arm, depth)


def ranked(scored: DataFrame, arm: str, depth: int | None) -> DataFrame:
    """rank by raw, descending; `raw` is rounded first so that equal scores are equal."""
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    out = scored.withColumn("raw", F.round("raw", 9)).withColumn("rank", F.row_number().over(w)).withColumn("arm", F.lit(arm))
    return out.where(F.col("rank") <= depth) if depth else out


def phrase(post: DataFrame, words: list[str]) -> DataFrame:
    """id and how often the words follow each other."""
    asked = post.sparkSession.createDataFrame([(" ".join(words),)], "term string")
    return phrase_hits(post, asked).select("id", F.col("tf").alias("n"))


def nearest(vectors: DataFrame, queries: DataFrame, depth: int | None = 100, floor: float | None = None, arm: str = "semantic") -> DataFrame:
    """Exact nearest neighbours by cosine. queries: query_id, vector; vectors: id, embedding.

    Every query is compared with every vector: the queries are the stated side (a batch of requests) and are broadcast up to `FEW_QUERIES`;
    a larger batch goes through in blocks of that many, each block with all vectors.
    """
    blocks = -(-queries.count() // FEW_QUERIES)
    if blocks > 1:  # by a hash, so blocks are about even
        each = [_nearest(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), depth, floor, arm) for i in range(blocks)]
        return reduce(DataFrame.unionByName, each)
    return _nearest(vectors, queries, depth, floor, arm)


def _nearest(vectors: DataFrame, queries: DataFrame, depth: int | None, floor: float | None, arm: str) -> DataFrame:
    """Each batch of vectors is multiplied with all queries at once and gives its own best `depth` for each; these are ranked."""
    asked = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("q")).toArrow()
    id_, key = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    scored = vectors.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).mapInArrow(_best(asked, depth, floor), f"query_id {key}, id {id_}, raw double")
    return ranked(scored, arm, depth)


#: Scores that a task holds at once.
SCORES = 4_000_000


def _rows(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix; null, empty ones and those of nulls are zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(1, int(sizes.max(initial=0)))))
    whole = sizes == out.shape[1]
    values = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    if (whole | (sizes == 0)).all():
        out[whole] = values.reshape(-1, out.shape[1]) if whole.any() else 0
        return out
    raise ValueError("vectors of different lengths")


def _best(asked: pa.Table, depth: int | None, floor: float | None):
    """Batches of id, v to what can be among the best of each query, by the best that the task has met so far; scores that round to that of the last place all stay, so that the ranking sees them."""
    ids = asked["query_id"].combine_chunks()

    def run(batches):
        q = _rows(asked["q"])
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), np.finfo(float).tiny)
        step = max(1, SCORES // max(1, len(q)))
        best = np.full((len(q), depth or 0), -np.inf)
        for batch in batches:
            for first in range(0, batch.num_rows if len(q) else 0, step):
                part = batch.slice(first, step)
                v = _rows(part.column(1))
                if v.shape[1] != q.shape[1]:
                    if v.any() and q.any():
                        raise ValueError("vectors of different lengths")
                    v = np.zeros((len(v), q.shape[1]))
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
                raw = q @ v.T
                keep = np.ones(raw.shape, bool)
                if depth:
                    best = np.partition(np.hstack([best, raw]), -depth, axis=1)[:, -depth:]
                    keep = raw >= best.min(axis=1, keepdims=True) - 2e-9
                if floor is not None:
                    keep &= raw >= floor
                a, b = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), part.column(0).take(pa.array(b)), pa.array(raw[a, b])], ["query_id", "id", "raw"])

    return run
