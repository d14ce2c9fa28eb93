"""A query for each operator over the test tables, and SQL that says the same where SQL can.

The tables have no revisions, validity, trust or tags; `plans.fixtures` derives those by fixed rules, in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import vectors as V
from .functions.scratch import kept, shared_dir
from .functions.stem import stem_words
from .operators import adjacency, compact, evaluation, fusion, graph, index, ingest, logs, resolve, scope
from .operators import facts as facts_
from .plans import fixtures as T
from .plans import search as S
from .plans.profiles import PROFILES
from .sources import markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Ranks as SQL numbers them: 64 bits."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == "int" and c in ("rank", "position")})


def query(sql: str | None = None, needs: list[str] = []):
    """needs: views that the SQL reads by the names of their parts."""

    def add(f: Callable[[T.Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: _wide(f(T.Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[f.__name__] = T.with_views(sql, needs)
        return f

    return add


R = lambda c, n=6: F.round(c, n)


# --- ranked scans ---------------------------------------------------------------------------------------------------


def _bm25(t: T.Tables, exact: bool, depth: int | None = 10) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), X.query_terms(F.col("text"), exact).alias("terms"))
    return index.bm25(index.tokenised(t.documents, "doc_id", F.col("text"), exact), queries, None, depth, "exact" if exact else "keyword")


@query("SELECT query_id, id, rank, round(raw, 6) AS raw FROM exact_hits WHERE rank <= 10")
def exact_bm25_topk(t):
    return _bm25(t, True).select("query_id", "id", "rank", R("raw").alias("raw"))


@query("SELECT query_id, id, rank, round(raw, 6) AS raw FROM keyword_hits WHERE rank <= 10")
def keyword_bm25_topk(t):
    return _bm25(t, False).select("query_id", "id", "rank", R("raw").alias("raw"))


@query("SELECT query_id, id, rank, round(raw, 6) AS raw FROM stem_hits WHERE rank <= 10")
def keyword_bm25_stemmed_topk(t):
    tokens = index.tokenised(t.documents, "doc_id", F.col("text"))
    return index.bm25(tokens, t.asked(), None, 10, stems=True).select("query_id", "id", "rank", R("raw").alias("raw"))


@query("SELECT query_id, string_agg(stem, ' ' ORDER BY stem) AS stems FROM stem_asked GROUP BY query_id", needs=["stem_hits"])
def stemmed_query_terms(t):
    return t.asked().select("query_id", F.array_join(F.array_sort("terms"), " ").alias("stems"))


@query("SELECT term, stem FROM stems", needs=["stem_hits"])
def stem_vocabulary(t):
    asked = t.benchmark.select(F.explode(X.query_terms(F.col("text"))).alias("term"))
    spread = index.tokenised(t.documents, "doc_id", F.col("text")).select(F.explode("tokens").alias("term"))
    return spread.union(asked).distinct().select("term", stem_words("term").alias("stem"))


@query("SELECT stem AS term, id, tf::BIGINT AS tf FROM stem_tf", needs=["stem_hits"])
def stored_postings(t):
    """The postings that an ingest writes, of stems that the requests ask for."""
    post = index.stored(t.documents.select("doc_id", "text"), "doc_id", F.lit(""), F.col("text")).where("kind = 'stem'")
    asked = t.asked().select(F.explode("terms").alias("term")).distinct()
    return post.join(asked, "term", "left_semi").select("term", "id", "tf")


@query("SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM exact_tokens) GROUP BY term")
def term_stats(t):
    post = index.postings(index.tokenised(t.documents, "doc_id", F.col("text"), True))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avg_size, sum(len(tokens))::BIGINT AS tokens FROM exact_tokens")
def collection_stats(t):
    tokens = index.tokenised(t.documents, "doc_id", F.col("text"), True)
    return tokens.agg(F.count(F.lit(1)).alias("n_docs"), R(F.avg("size")).alias("avg_size"), F.sum("size").alias("tokens"))


@query("SELECT id, n FROM (SELECT id, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'and' AND tokens[i + 1] = 'the')) AS n FROM word_tokens) WHERE n > 0")
def phrase_match(t):
    words = ["and", "the"]
    post = index.postings(index.tokenised(t.documents, "doc_id", F.col("text")), words)
    return index.phrase(post, words).select("id", F.col("n").cast("bigint").alias("n"))


_COSINE = """
    SELECT query_id, id, rank, raw FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS raw
            FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""


def _near(t, depth=10, asked="vec_id % 50 = 0"):
    queries = t.embeddings.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.nearest(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), queries, depth)


@query(f"SELECT query_id, id, rank, round(raw, 6) AS raw FROM ({_COSINE})")
def semantic_topk_batch(t):
    return _near(t).select("query_id", "id", "rank", R("raw").alias("raw"))


@query("SELECT vec_id, round(list_sum(list_transform(h, lambda x: x * x)), 6) AS size2, round(h[1] / sqrt(list_sum(list_transform(h, lambda x: x * x))), 6) AS first FROM (SELECT vec_id, (embedding::DOUBLE[])[1:16] AS h FROM embeddings)")
def truncate_normalize(t):
    head = F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", R(V.dot(head, head)).alias("size2"), R(V.truncate_normalize(F.col("embedding"), 16)[0]).alias("first"))


# --- fusion and ranking ---------------------------------------------------------------------------------------------

_WEIGHTS = {"keyword": 0.5, "exact": 0.3}
_LISTS = "SELECT query_id, 'keyword' AS arm, id, rank, raw, 5e-1 AS w FROM keyword_hits WHERE rank <= 100 UNION ALL SELECT query_id, 'exact', id, rank, raw, 3e-1 FROM exact_hits WHERE rank <= 100"
_FUSED = f"SELECT query_id, id, sum(w / (60e0 + rank)) AS fused FROM ({_LISTS}) GROUP BY ALL"


def _lists(t):
    columns = ["query_id", "arm", "id", "rank", "raw"]
    return _bm25(t, False, 100).select(*columns).unionByName(_bm25(t, True, 100).select(*columns))


def _positions(fused: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS position FROM ({fused})"


def _numbered(fused: DataFrame) -> DataFrame:
    return fusion.numbered(fused.withColumn("final", F.round("fused", 9)))


@query(f"SELECT query_id, id, position, round(fused, 6) AS fused FROM ({_positions(_FUSED)}) WHERE position <= 10")
def rrf_fusion(t):
    return fusion.limit(_numbered(fusion.rrf(_lists(t), _WEIGHTS))).select("query_id", "id", "position", R("fused").alias("fused"))


_SCALED = f"SELECT query_id, id, sum(w * CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1e0 END) AS fused FROM (SELECT *, min(raw) OVER p AS lo, max(raw) OVER p AS hi FROM ({_LISTS}) WINDOW p AS (PARTITION BY query_id, arm)) GROUP BY ALL"


@query(f"SELECT query_id, id, position, round(fused, 6) AS fused FROM ({_positions(_SCALED)}) WHERE position <= 10")
def minmax_fusion(t):
    return fusion.limit(_numbered(fusion.min_max(_lists(t), _WEIGHTS))).select("query_id", "id", "position", R("fused").alias("fused"))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, id) AS position FROM (SELECT query_id % 4 AS query_id, id, sum(5e-1 / nq / (60e0 + rank)) AS fused FROM (SELECT *, count(DISTINCT query_id) OVER (PARTITION BY query_id % 4) AS nq FROM keyword_hits WHERE rank <= 100) GROUP BY query_id % 4, id)) WHERE position <= 10".replace("SELECT * FROM", "SELECT query_id, id, position, round(fused, 6) AS fused FROM", 1))
def multi_query_rrf(t):
    lists = _bm25(t, False, 100).withColumn("one", F.col("query_id")).withColumn("query_id", F.col("query_id") % 4)
    n = lists.groupBy("query_id").agg(F.countDistinct("one").cast("double").alias("n_queries"))
    return fusion.limit(_numbered(fusion.rrf(lists.join(n, "query_id"), {"keyword": 0.5}))).select("query_id", "id", "position", R("fused").alias("fused"))


@query(f"SELECT query_id, id, arm, rank, round(w / (60e0 + rank), 6) AS contribution FROM ({_LISTS})")
def explain_contributions(t):
    fused = fusion.rrf(_lists(t), _WEIGHTS)
    return fused.select("query_id", "id", F.explode("arms").alias("a")).select("query_id", "id", "a.arm", "a.rank", R("a.contribution").alias("contribution"))


@query("SELECT id, round(CASE WHEN kind = 'note' THEN 8e-1 + 2e-1 * pow(5e-1, greatest(0e0, (1800000000000 - updated_at) / 86400000e0) / 90e0) ELSE 1e0 END, 6) AS recency FROM docs")
def recency_rerank(t):
    return t.docs.select("id", R(fusion.recency(F.col("kind"), F.col("updated_at"), T.NOW, ["note", "conversation"], 0.8, 90.0)).alias("recency"))


@query("SELECT doc_id AS query_id, ord AS id, tokens AS final FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, ord) AS n FROM (SELECT doc_id, ord, length(line)::DOUBLE AS tokens FROM lines)) WHERE n = 1")
def doc_max_passage(t):
    rows = t.lines.select(F.col("doc_id").alias("query_id"), F.col("ord").alias("id"), F.lit(1).alias("document_id"), F.length("line").cast("double").alias("final"))
    return fusion.best_passage(rows).select("query_id", "id", "final")


_GAPPED = f"""
    SELECT query_id, id, position FROM (
        SELECT *, max(fall) OVER (PARTITION BY query_id ORDER BY position) AS cut FROM (
            SELECT *, CASE WHEN position > 3 AND round(fused, 9) < lag(round(fused, 9)) OVER (PARTITION BY query_id ORDER BY position) * (1 - 1e-1) THEN 1 ELSE 0 END AS fall
            FROM ({_positions(_FUSED)}) WHERE position <= 10)) WHERE cut = 0"""


@query(_GAPPED)
def gap_cutoff(t):
    rows = fusion.limit(_numbered(fusion.rrf(_lists(t), _WEIGHTS)))
    return fusion.gap_cut(rows, 0.1, 3).select("query_id", "id", "position")


@query(f"SELECT query_id, id, position, spent::BIGINT AS spent FROM (SELECT p.*, sum(tokens + 24) OVER (PARTITION BY query_id ORDER BY position) AS spent FROM ({_positions(_FUSED)}) p JOIN token_counts USING (id) WHERE position <= 10) WHERE position = 1 OR spent <= 2000")
def token_budget(t):
    rows = fusion.limit(_numbered(fusion.rrf(_lists(t), _WEIGHTS)))
    sized = rows.join(t.documents.select(F.col("doc_id").alias("id"), X.estimate_tokens(F.col("text")).alias("tokens")), "id")
    return fusion.budget(sized, F.col("tokens"), 2000).select("query_id", "id", "position", F.col("spent").cast("bigint").alias("spent"))


@query(f"SELECT query_id, id FROM ({_COSINE}) WHERE raw >= 3e-1")
def semantic_floor(t):
    fused = fusion.rrf(_near(t), {"semantic": 0.5})
    return fusion.semantic_floor(fused, 0.3).select("query_id", "id")


@query(f"SELECT query_id, id, CASE WHEN raw >= 6e-1 THEN 'strong' WHEN raw >= 45e-2 THEN 'moderate' WHEN raw >= 3e-1 THEN 'weak' ELSE 'very-weak' END AS band FROM ({_COSINE})")
def relevance_band(t):
    return _near(t).select("query_id", "id", fusion.relevance(F.col("raw"), PROFILES["default"].bands).alias("band"))


@query("SELECT query_id, id, rank FROM exact_hits WHERE rank <= 10 AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_seen(t):
    seen = t.labels.where("toxic = 1").select(X.address("chunk", F.col("doc_id")).alias("address"))
    return fusion.unseen(_bm25(t, True), seen).select("query_id", "id", "rank")


@query("""SELECT query_id, id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, rank) AS position FROM (
    SELECT query_id, id, rank, CASE WHEN len(q.terms) > 0 THEN len(list_filter(q.terms, lambda x: list_contains(w.tokens, x)))::DOUBLE / len(q.terms) ELSE 0 END AS hit
    FROM exact_hits h JOIN keyword_queries q USING (query_id) JOIN word_tokens w USING (id) WHERE rank <= 10))""")
def rerank_overlap(t):
    rows = _bm25(t, True).join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id").join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return S.rerank(rows.withColumn("position", F.col("rank")), 10).select("query_id", "id", "position")


def _searched(lists: str, gap: str, least: int, rerank: bool = False) -> str:
    """A whole search in SQL: lists (query_id, arm, id, rank, raw, w) to results."""
    order = "CASE arm WHEN 'semantic' THEN 1 WHEN 'keyword' THEN 2 ELSE 3 END"
    ranked = """SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(q.terms) > 0 THEN len(list_filter(q.terms, lambda x: list_contains(w.tokens, x)))::DOUBLE / len(q.terms) ELSE 0 END DESC, position) AS place
        FROM (SELECT * FROM numbered WHERE position <= 30) r JOIN keyword_queries q USING (query_id) JOIN word_tokens w USING (id)"""
    kept = f"SELECT * EXCLUDE (position, place), place AS position FROM ({ranked}) WHERE place <= 10" if rerank else f"""SELECT * FROM (SELECT *, max(fall) OVER (PARTITION BY query_id ORDER BY position) AS cut FROM (
        SELECT *, CASE WHEN position > {least} AND final < lag(final) OVER (PARTITION BY query_id ORDER BY position) * (1 - {gap}) THEN 1 ELSE 0 END AS fall FROM numbered WHERE position <= 10)) WHERE cut = 0"""
    return f"""WITH lists AS ({lists}),
    fused AS (SELECT query_id, id, sum(w / (60e0 + rank)) AS fused, string_agg(arm, ' ' ORDER BY {order}) AS arms, max(raw) FILTER (WHERE arm = 'semantic') AS cosine FROM lists GROUP BY ALL),
    aged AS (SELECT f.*, fused * CASE WHEN kind = 'note' THEN 8e-1 + 2e-1 * pow(5e-1, greatest(0e0, ({T.NOW} - updated_at) / 86400000e0) / 90e0) ELSE 1e0 END AS final FROM fused f JOIN docs USING (id) WHERE NOT (arms = 'semantic' AND cosine < 3e-1)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS position FROM aged), kept AS ({kept})
    SELECT query_id, position, id, round(final, 6) AS final, arms, CASE WHEN cosine IS NULL THEN 'keyword-only' WHEN cosine >= 6e-1 THEN 'strong' WHEN cosine >= 45e-2 THEN 'moderate' WHEN cosine >= 3e-1 THEN 'weak' ELSE 'very-weak' END AS band
    FROM (SELECT k.*, sum(tokens + 24) OVER (PARTITION BY query_id ORDER BY position) AS spent FROM kept k JOIN token_counts USING (id)) WHERE position = 1 OR spent <= 4000"""


def _list(view: str, arm: str, weight: str, depth: int = 100) -> str:
    return f"SELECT query_id, '{arm}' AS arm, id, rank, raw, {weight} AS w FROM {view} WHERE rank <= {depth}"


@query(_searched(" UNION ALL ".join([_list("semantic_hits", "semantic", "5e-1"), _list("stem_hits", "keyword", "5e-1"), _list("exact_hits", "exact", "3e-1")]), "5e-1", 3))
def hybrid_search(t):
    return t.search("default", ["semantic", "keyword", "exact"])


@query(_searched(" UNION ALL ".join([_list("stem_hits", "keyword", "5e-1", 200), _list("exact_hits", "exact", "3e-1", 200)]), "6e-1", 2, True), needs=["word_tokens", "keyword_queries"])
def precise_search(t):
    return t.search("precise", ["keyword", "exact"])


# scores are those of ranks: the first group of near-equal ones is ranks 1 to 7, the second 8 to 15
@query(rf"""WITH fact_tokens AS (SELECT id, regexp_extract_all(lower(statement), '[\p{{L}}\p{{N}}]+') AS tokens FROM facts),
    fact_queries AS (SELECT min(id) AS query_id, [w FOR w IN regexp_extract_all(lower(statement), '[\p{{L}}\p{{N}}]+') IF length(w) > 1 AND w NOT IN ('not')] AS terms FROM facts GROUP BY statement),
    {T._stem_hits("fact", "fact_tokens", "fact_queries")},
    live AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS place FROM (SELECT h.query_id, h.id, h.raw, trust FROM fact_hits h JOIN facts USING (id) WHERE deleted_at IS NULL AND invalidated_at IS NULL))
    SELECT query_id, position, id, round(5e-1 / (60e0 + place), 6) AS fused, trust FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 7 THEN 1 ELSE 2 END, CASE trust WHEN 'curated' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, place) AS position FROM live WHERE place <= 15) WHERE position <= 10""")
def fact_search(t):
    queries = index.stem_terms(t.priorities.select(F.col("id").alias("query_id"), X.query_terms(F.col("statement")).alias("terms")))
    return S.search_facts(t.facts, queries).select("query_id", "position", "id", R("fused").alias("fused"), "trust")


@query(rf"""WITH page_tokens AS (SELECT id, regexp_extract_all(strip_accents(lower(title || chr(10) || text)), '[\p{{L}}\p{{N}}]+') AS tokens FROM docs), {T._stem_hits("page", "page_tokens", "keyword_queries")}
    SELECT query_id, rank AS position, id, round(5e-1 / (60e0 + rank), 6) AS fused, id % 4 = 0 AS stale FROM page_hits WHERE rank <= 10""", needs=["keyword_queries"])
def page_search(t):
    return S.search_pages(t.pages_written, t.asked()).select("query_id", "position", "id", R("fused").alias("fused"), "stale")


# --- query text -----------------------------------------------------------------------------------------------------


@query("SELECT query_id, array_to_string(terms, ' ') AS terms FROM keyword_queries")
def stopword_filter(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query("SELECT query_id, array_to_string(terms, ' ') AS terms FROM exact_queries")
def exact_query_terms(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(X.query_terms(F.col("text"), True), " ").alias("terms"))


@query(rf"""SELECT conv_id, turn, regexp_matches(text, '{X.IDENTIFIER}') AS identifier, regexp_matches(text, '{X.RELATIONAL}') AS relational,
    CASE WHEN regexp_matches(text, '{X.IDENTIFIER}') THEN 'semantic keyword exact fact' ELSE 'semantic keyword fact' END AS arms FROM conversations""")
def query_router(t):
    ident = X.looks_like_identifier(F.col("text"))
    return t.conversations.select("conv_id", "turn", ident.alias("identifier"), X.is_relational(F.col("text")).alias("relational"), F.when(ident, "semantic keyword exact fact").otherwise("semantic keyword fact").alias("arms"))


@query("SELECT doc_id, len(tokens)::BIGINT AS n, len(list_distinct(tokens))::BIGINT AS n_distinct FROM (SELECT id AS doc_id, tokens FROM word_tokens)")
def word_tokens(t):
    tokens = X.word_tokens(X.fold(F.col("text")))
    return t.documents.select("doc_id", F.size(tokens).cast("bigint").alias("n"), F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct"))


@query("SELECT doc_id, md5(strip_accents(regexp_replace(text, '[^a-zA-ZàâäáéèêëîïíôöóùûüúçñÀÂÄÁÉÈÊËÎÏÍÔÖÓÙÛÜÚÇÑ ]', '', 'g'))) AS folded FROM documents")
def fold_diacritics(t):
    return t.documents.select("doc_id", F.md5(X.fold(F.regexp_replace("text", "[^a-zA-ZàâäáéèêëîïíôöóùûüúçñÀÂÄÁÉÈÊËÎÏÍÔÖÓÙÛÜÚÇÑ ]", "")).cast("binary")).alias("folded"))


# --- ingest ---------------------------------------------------------------------------------------------------------


@query("SELECT id AS doc_id, tokens::BIGINT AS tokens FROM token_counts")
def token_estimate(t):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query("SELECT doc_id, hash FROM hashed")
def normalise_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("SELECT source, hash, min(doc_id) AS doc_id, count(*) AS n FROM hashed JOIN documents USING (doc_id) GROUP BY source, hash")
def dedup_by_hash(t):
    return t.documents.withColumn("hash", X.content_hash(F.col("text"))).groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


_DECIDED = """
    SELECT o_orderkey AS id, CASE WHEN prev IS NULL THEN 'new' WHEN prev = o_orderpriority AND prev_v = o_orderstatus THEN 'unchanged' ELSE 'revision' END AS outcome
    FROM (SELECT *, lag(o_orderpriority) OVER w AS prev, lag(o_orderstatus) OVER w AS prev_v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(_DECIDED)
def ingest_decision(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("ns").alias("namespace"), F.col("o_orderkey").cast("string").alias("uri"), F.col("o_orderpriority").alias("content_hash"), F.col("o_orderstatus").alias("version"), F.lag("o_orderpriority").over(w).alias("ph"), F.lag("o_orderstatus").over(w).alias("pv"))
    current = rows.where("ph is not null").select("namespace", "uri", F.col("ph").alias("content_hash"), F.col("pv").alias("version"), F.lit(1).alias("revision"))
    return ingest.decide(rows.drop("ph", "pv"), current).select("id", "outcome")


@query("SELECT o_orderkey AS id, row_number() OVER w AS revision, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def revision_chain(t):
    out = ingest.chain(t.orders, "o_custkey", "o_orderdate", ["o_orderkey"], "o_orderkey")
    return out.select(F.col("o_orderkey").alias("id"), F.col("revision").cast("bigint").alias("revision"), "superseded_by")


@query("SELECT doc_id, ord, md5(line) AS line FROM lines")
def line_chunks(t):
    return t.lines.select("doc_id", "ord", F.md5(F.col("line").cast("binary")).alias("line"))


@query("SELECT conv_id, turn, md5(lag(text) OVER w) AS before, md5(lead(text) OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(t):
    out = ingest.neighbours(t.conversations, "conv_id", "turn")
    return out.select("conv_id", "turn", F.md5(F.col("before").cast("binary")).alias("before"), F.md5(F.col("after").cast("binary")).alias("after"))


@query("SELECT conv_id, role, md5('## ' || role || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS section FROM conversations GROUP BY conv_id, role")
def section_rollup(t):
    chunks = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("role").alias("section_path"), F.col("turn").alias("ord"), "text")
    return ingest.sections(chunks).select(F.col("document_id").alias("conv_id"), F.col("section_path").alias("role"), F.md5(F.col("text").cast("binary")).alias("section"))


@query(r"""SELECT doc_id, CASE WHEN stop > 41 AND stop <= 200 THEN t[1:stop] WHEN length(t) > 160 THEN t[1:160] || '…' ELSE t END AS line
    FROM (SELECT doc_id, t, length(regexp_extract(t, '^[^.!?]*[.!?]')) AS stop FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents))""")
def one_liner(t):
    return t.documents.select("doc_id", X.one_liner(F.col("text")).alias("line"))


@query("SELECT id, CASE WHEN namespace = title OR starts_with(namespace, title || ' > ') THEN namespace ELSE title || ' > ' || namespace END || ' — ' || tag AS header FROM docs")
def context_header(t):
    return t.docs.select("id", X.context_header(F.col("title"), F.col("namespace"), F.col("tag")).alias("header"))


@query()
def markdown_chunks(t):
    docs = t.docs.select("id", "title", F.lit(None).cast("string").alias("context"), F.concat(F.lit("# "), "title", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n")).alias("content"))
    return ingest.passages(docs).select("document_id", "ord", "section_path", "est_tokens", F.length("text").alias("chars"), "context_header")


@query(r"SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS sentences FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split(t):
    s = X.sentences(F.col("text"), r".!?\n")
    return t.documents.select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences"))


@query("SELECT id AS doc_id FROM docs WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t):
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.lit("m").alias("model_id"))
    return ingest.missing_vectors(t.docs, vectors, "m").select(F.col("id").alias("doc_id"))


@query("""SELECT run_id AS id, count(*) AS done, count(*) FILTER (WHERE event_type = 'click') AS revised, count(*) FILTER (WHERE event_type = 'error') AS failed,
    CASE WHEN run_id % 3 = 0 THEN 'done' WHEN 1800000000000 - max(ms) > 600000 THEN 'stalled' ELSE 'running' END AS state
    FROM (SELECT user_id AS run_id, event_type, epoch_ms(ts) AS ms FROM events) GROUP BY run_id""")
def ingest_run_rollup(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    outcome = F.when(F.col("event_type") == "click", "revision").when(F.col("event_type") == "error", "error").otherwise("new")
    items = t.events.select(F.col("user_id").alias("run_id"), outcome.alias("outcome"), F.lit(1).alias("chunks"), F.lit(1).alias("bytes"), ms.alias("ts"))
    runs = items.groupBy(F.col("run_id").alias("id")).agg(F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("total")).select("id", "started_at", "total", F.when(F.col("id") % 3 == 0, F.col("started_at")).alias("finished_at"), F.lit("").alias("error"))
    return ingest.run_rollup(items, runs, T.NOW).select("id", "done", "revised", "failed", "state")


# --- scope and time -------------------------------------------------------------------------------------------------


@query("SELECT id FROM revisions WHERE deleted_at IS NULL AND superseded_by IS NULL")
def live_filter(t):
    return t.revisions.where(scope.live_documents()).select("id")


@query(f"SELECT id FROM revisions WHERE deleted_at IS NULL AND created_at <= {T.AS_OF} AND (superseded_by IS NULL OR updated_at > {T.AS_OF})")
def as_of_docs(t):
    return t.revisions.where(scope.documents(scope.Scope(as_of=T.AS_OF))).select("id")


@query("SELECT id FROM revisions WHERE deleted_at IS NULL AND version = '1-URGENT'")
def version_scope(t):
    return t.revisions.where(scope.documents(scope.Scope(version="1-URGENT", as_of=T.AS_OF))).select("id")


@query("SELECT id FROM docs WHERE tag = 'fr'")
def tag_scope(t):
    return t.docs.withColumn("tags", F.array("tag", "kind")).where(scope.has_tags(["fr"])).select("id")


@query("SELECT id FROM docs WHERE trust IN ('user', 'curated')")
def min_trust_scope(t):
    return t.docs.where(scope.trusted("user")).select("id")


@query(f"SELECT id FROM docs WHERE updated_at BETWEEN {T.EPOCH + 3600000 * 100} AND {T.EPOCH + 3600000 * 500} AND namespace IN ('src1', 'src2') AND kind = 'note'")
def date_scope(t):
    s = scope.Scope(namespaces=["src1", "src2"], kinds=["note"], date_from=T.EPOCH + 3600000 * 100, date_to=T.EPOCH + 3600000 * 500)
    return t.docs.where(scope.only(s)).select("id")


@query("""SELECT count(*) FILTER (WHERE deleted_at IS NULL AND superseded_by IS NULL AND namespace = 'c1') AS live_docs,
    count(*) FILTER (WHERE (deleted_at IS NOT NULL OR superseded_by IS NOT NULL) AND namespace = 'c1') AS by_revocation, 0 AS by_min_trust FROM revisions""")
def scope_counts(t):
    return scope.counts(t.revisions, scope.Scope(namespaces=["c1"])).withColumn("by_min_trust", F.col("by_min_trust").cast("int"))


@query(f"SELECT id FROM facts WHERE deleted_at IS NULL AND recorded_at <= {T.AS_OF} AND (invalidated_at IS NULL OR invalidated_at > {T.AS_OF})")
def as_of_facts(t):
    return t.facts.where(scope.facts(scope.Scope(as_of=T.AS_OF))).select("id")


# --- facts ----------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE c(id, root, place) AS (SELECT id, id, 0 FROM chained WHERE supersedes IS NULL UNION ALL SELECT n.id, c.root, c.place + 1 FROM chained n JOIN c ON n.supersedes = c.id)
    SELECT id, root, place FROM c""")
def fact_history(t):
    return facts_.history(t.chained).select("id", "root", F.col("place").cast("int").alias("place"))


@query("""SELECT a.id AS a_id, b.id AS b_id, CASE WHEN ra > rb OR (ra = rb AND NOT b.recorded_at > a.recorded_at) THEN a.id ELSE b.id END AS keep_id
    FROM (SELECT *, CASE trust WHEN 'agent' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS ra FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL) a
    JOIN (SELECT *, CASE trust WHEN 'agent' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rb FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL) b
    ON a.subject = b.subject AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to AND a.statement <> b.statement
    AND (a.recorded_at < b.recorded_at OR (a.recorded_at = b.recorded_at AND a.id < b.id))""")
def fact_conflicts(t):
    return facts_.conflicts(t.facts.where(scope.live_facts())).select("a_id", "b_id", "keep_id")


@query("SELECT x.trust, (SELECT count(*) FROM docs d WHERE d.trust = x.trust) AS docs, (SELECT count(*) FROM facts f WHERE f.trust = x.trust AND deleted_at IS NULL AND invalidated_at IS NULL) AS facts FROM (VALUES ('agent'), ('user'), ('curated')) x(trust)")
def trust_summary(t):
    return facts_.trust_summary(t.docs, t.facts.where(scope.live_facts()))


@query(f"SELECT id FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL AND valid_to < {T.AS_OF}")
def expired_facts(t):
    return facts_.expired(t.facts, T.AS_OF).select("id")


@query("SELECT id, recorded_at FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL ORDER BY recorded_at DESC, id LIMIT 100")
def list_facts(t):
    return facts_.listed(t.facts, scope.live_facts()).select("id", "recorded_at")


@query("""SELECT id, lead_at AS invalidated_at, lead_id AS superseded_by, CASE WHEN id % 11 = 0 THEN '[redacted]' ELSE statement END AS statement
    FROM (SELECT *, lead(recorded_at) OVER w AS lead_at, lead(id) OVER w AS lead_id FROM chained WINDOW w AS (PARTITION BY subject ORDER BY recorded_at, id))""")
def fact_state(t):
    gone = t.chained.where("id % 11 = 0").select("id", F.lit(T.NOW).alias("at"), F.lit("asked").alias("reason"), F.lit(True).alias("redact"))
    return facts_.state(t.chained, gone).select("id", "invalidated_at", "superseded_by", "statement")


# --- entities and graph ---------------------------------------------------------------------------------------------


@query(rf"SELECT page_id, len(m)::BIGINT AS n, array_to_string(m[1:5], '|') AS first FROM (SELECT page_id, regexp_extract_all(html, '{graph.IDENTIFIER}') AS m FROM pages)")
def mention_extract_ident(t):
    found = F.regexp_extract_all("html", F.lit(graph.IDENTIFIER), F.lit(0))
    return t.pages.select("page_id", F.size(found).cast("bigint").alias("n"), F.array_join(F.slice(found, 1, 5), "|").alias("first"))


@query(rf"SELECT doc_id, len(m)::BIGINT AS n, array_to_string(m[1:5], '|') AS first FROM (SELECT doc_id, regexp_extract_all(text, '{graph.CAPITALISED}') AS m FROM documents)")
def mention_extract_caps(t):
    found = F.regexp_extract_all("text", F.lit(graph.CAPITALISED), F.lit(0))
    return t.documents.select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(F.slice(found, 1, 5), "|").alias("first"))


@query()
def mention_extract(t):
    chunks = t.docs.select("id", "title", "text")
    return graph.mentions(chunks, F.col("title"), F.col("text")).select("chunk_id", "key", "name", "type", R("weight").alias("weight"))


@query("SELECT entity_id, round(1 / log2(2 + count(*)), 6) AS selectivity FROM mentions GROUP BY entity_id")
def entity_selectivity(t):
    return graph.selectivity(t.mentions).select("entity_id", R("selectivity").alias("selectivity"))


_ENTITY = """SELECT n AS query_id, id, rank, raw FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY raw DESC, id) AS rank FROM (
    SELECT n, chunk_id AS id, round(sum(weight * sel), 9) AS raw FROM (SELECT s_nationkey AS n, s_suppkey AS entity_id FROM supplier) JOIN mentions USING (entity_id)
    JOIN (SELECT entity_id, 1 / log2(2e0 + count(*)) AS sel FROM mentions GROUP BY entity_id) USING (entity_id) GROUP BY n, chunk_id)) WHERE rank <= 20"""


@query(f"SELECT query_id, id, rank, round(raw, 5) AS raw FROM ({_ENTITY})")
def entity_arm(t):
    wanted = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("entity_id"))
    return graph.entity_arm(t.mentions, wanted, 20).select("query_id", "id", "rank", R("raw", 5).alias("raw"))


_SHARED = "SELECT node, neighbour, shared, position FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY shared DESC, neighbour) AS position FROM (SELECT a.entity_id AS node, b.entity_id AS neighbour, count(*) AS shared FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.entity_id <> b.entity_id GROUP BY ALL)) WHERE position <= 15"


@query(_SHARED)
def cooccurrence_neighbours(t):
    return graph.shared(t.mentions, t.mentions.select("entity_id").distinct()).select("node", "neighbour", "shared", "position")


@query(f"""WITH s AS ({_SHARED}), one AS (SELECT neighbour AS entity_id, 1 AS hops, node AS via, shared FROM s WHERE node % 50 = 0),
    two AS (SELECT neighbour AS entity_id, 2 AS hops, node AS via, shared FROM s WHERE node IN (SELECT entity_id FROM one) AND neighbour % 50 <> 0 AND neighbour NOT IN (SELECT entity_id FROM one))
    SELECT entity_id, hops, via, shared FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY hops, shared DESC, via) AS n FROM (FROM one UNION ALL FROM two)) WHERE n = 1 ORDER BY hops, shared DESC, entity_id LIMIT 60""")
def explore_two_hop(t):
    start = t.supplier.where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("entity_id"))
    return graph.explore(t.mentions, start)


def _ppr_sql(rounds: int) -> str:
    parts = [f"m0 AS (SELECT 'e' || s_suppkey AS seed, 'e' || s_suppkey AS node, 1e0 AS mass FROM supplier WHERE s_suppkey % 50 = 0)"]
    for i in range(rounds):
        parts.append(f"m{i + 1} AS (SELECT seed, node, sum(mass) AS mass FROM (SELECT seed, dst AS node, mass * p AS mass FROM m{i} JOIN steps ON node = src UNION ALL SELECT seed, seed, 1 - 85e-2 FROM m0) GROUP BY seed, node)")
    return ", ".join(parts)


_STEPS = """e AS (SELECT 'e' || entity_id AS a, 'c' || chunk_id AS b, weight FROM mentions), both_ways AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e),
    outs AS (SELECT a, sum(weight) AS total, count(*) AS degree FROM both_ways GROUP BY a),
    steps AS (SELECT a AS src, b AS dst, 85e-2 * weight / total * CASE WHEN degree > 50 THEN 50e0 / degree ELSE 1e0 END AS p FROM both_ways JOIN outs USING (a))"""


def _sides(t):
    """The mentions of the rows that are there now, packed, and every supplier whose key is divisible by 50 as seeds."""
    seeds = t.supplier.where("s_suppkey % 50 = 0").select(F.col("s_suppkey").alias("seed"))
    live = t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("l_orderkey", "l_linenumber").cast("decimal(38,0)")).alias("rows")).first()
    return adjacency.sides(t.mentions, f"{shared_dir(t.spark)}/graphs", f"{live.n}-{live.rows}".replace("--", "-")), seeds


@query(f"WITH {_STEPS}, {_ppr_sql(10)} SELECT seed, node, round(mass, 9) AS mass FROM m10")
def ppr_mass(t):
    mass = adjacency.between(*_sides(t))
    return mass.select(F.concat(F.lit("e"), F.col("seed").cast("string")).alias("seed"), F.concat("side", F.col("node").cast("string")).alias("node"), R("mass", 9).alias("mass"))


@query(f"""WITH {_STEPS}, {_ppr_sql(10)}, n AS (SELECT 1e-6 / (count(*) + 1) AS eps FROM outs),
    k AS (SELECT count(*) AS k FROM m0),
    s AS (SELECT node, sum(ln(mass + eps)) + (max(k) - count(*)) * ln(max(eps)) AS logs, max(eps) AS eps, max(k) AS k FROM m10, n, k WHERE node LIKE 'c%' GROUP BY node),
    d AS (SELECT 'c' || chunk_id AS node, count(DISTINCT entity_id) AS direct FROM mentions WHERE entity_id % 50 = 0 GROUP BY chunk_id)
    SELECT substr(node, 2)::BIGINT AS id, round(logs, 3) AS raw, CASE WHEN coalesce(direct, 0) > 0 THEN 1 ELSE 2 END AS hops FROM s LEFT JOIN d USING (node)
    WHERE logs > k * ln(eps) + ln(10001e-4) AND coalesce(direct, 0) < k""")
def graph_arm(t):
    return graph.graph_arm_between(*_sides(t), None).select("id", R("raw", 3).alias("raw"), "hops")


@query("""WITH q AS (SELECT s_suppkey AS query_id, string_split('what is ' || s_name || ' for alias' || s_suppkey || ' now', ' ') AS w FROM supplier),
    r AS (SELECT query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2]))) AS run FROM q),
    a AS (SELECT DISTINCT query_id, regexp_replace(lower(regexp_replace(run, '#', '#', 'g')), '[ _-]', '', 'g') AS key FROM r),
    e AS (SELECT regexp_replace(lower(s_name), '[ _-]', '', 'g') AS key, s_suppkey::VARCHAR AS entity_id FROM supplier UNION ALL SELECT 'alias' || s_suppkey, (s_suppkey + 1)::VARCHAR FROM supplier),
    f AS (SELECT DISTINCT query_id, entity_id FROM a JOIN e USING (key))
    SELECT query_id, f.entity_id, s_name AS canonical, row_number() OVER (PARTITION BY query_id ORDER BY length(s_name) DESC, s_name, f.entity_id) AS position FROM f JOIN supplier ON s_suppkey::VARCHAR = f.entity_id""")
def find_entities(t):
    entities = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("canonical"), X.entity_key(F.col("s_name")).alias("key"))
    aliases = t.supplier.select(F.concat(F.lit("alias"), F.col("s_suppkey").cast("string")).alias("key"), (F.col("s_suppkey") + 1).cast("string").alias("entity_id"))
    asked = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("what is "), "s_name", F.lit(" for alias"), F.col("s_suppkey").cast("string"), F.lit(" now")).alias("query"))
    return graph.find_entities(entities, aliases, asked).withColumn("position", F.col("position").cast("bigint"))


@query("SELECT p_partkey, len(g)::BIGINT AS n, array_to_string(g[1:4], '|') AS first FROM (SELECT p_partkey, list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) AS g FROM (SELECT p_partkey, '  ' || regexp_replace(lower(p_name), '[ _-]', '', 'g') || ' ' AS s FROM part))")
def trigrams(t):
    key = X.entity_key(F.col("p_name"))
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    every = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3)))
    return t.part.select("p_partkey", F.size(every).cast("bigint").alias("n"), F.array_join(F.slice(X.trigrams(key), 1, 4), "|").alias("first"))


@query("""WITH k AS (SELECT p_partkey, regexp_replace(lower(p_name), '[ _-]', '', 'g') AS key FROM part), c AS (SELECT p_partkey, key, unnest(string_split(key, '')) AS x FROM k),
    f AS (SELECT p_partkey, key, x, count(*)::DOUBLE / length(key) AS p FROM c GROUP BY p_partkey, key, x)
    SELECT p_partkey, round(-sum(p * log2(p)), 6) AS bits, length(any_value(key)) < 5 OR -sum(p * log2(p)) < 15e-1 AS ambiguous FROM f GROUP BY p_partkey""")
def entropy_gate(t):
    key = X.entity_key(F.col("p_name"))
    return t.part.select("p_partkey", R(X.entropy(key)).alias("bits"), X.ambiguous(key).alias("ambiguous"))


_SETS = "g AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM (SELECT p_partkey, '  ' || regexp_replace(lower(p_name), '[ _-]', '', 'g') || ' ' AS s FROM part))"


@query(f"""WITH {_SETS}, x AS (SELECT id, unnest(g) AS y FROM g), n AS (SELECT id, len(g) AS n FROM g),
    c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM x a JOIN x b ON a.y = b.y AND a.id < b.id GROUP BY ALL)
    SELECT a, b, round(c::DOUBLE / (na.n + nb.n - c), 6) AS jaccard FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 999e-3""")
def same_trigram_names(t):
    sets = t.part.select(F.col("p_partkey").alias("id"), X.trigrams(X.entity_key(F.col("p_name"))).alias("grams"))
    return resolve.similar(sets, 0.999, digits=6).select("a", "b", "jaccard")


@query()
def near_duplicates_lsh(t):
    chunks = t.lines.select((F.col("doc_id") * 100000 + F.col("ord")).alias("id"), F.col("doc_id").alias("document_id"), F.col("line").alias("text"))
    return resolve.duplicates(chunks, 6).select("a", "b", "jaccard")


@query(f"""WITH {_SETS}, h AS (SELECT id, list_transform(g, lambda s: list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ord(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)) AS h FROM g)
    SELECT id AS p_partkey, array_to_string(list_transform(range(0, 32), lambda i: list_min(list_transform(h, lambda x: (x * (2 * i + 1) + i * 2654435769) & 4294967295))), ' ') AS signature FROM h""")
def minhash_signature(t):
    return t.part.select("p_partkey", F.array_join(F.transform(resolve.signature(X.trigrams(X.entity_key(F.col("p_name")))), lambda x: x.cast("string")), " ").alias("signature"))


@query()
def resolve_names(t):
    entities = t.part.select(F.col("p_partkey").cast("string").alias("id"), X.entity_key(F.col("p_name")).alias("key"))
    names = t.part.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("name")).union(t.supplier.select("s_name"))
    return resolve.resolve(names, entities).select("name", "how", R("score").alias("score"))


# --- compaction -----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT entity_id FROM mentions) AND c_custkey NOT IN (SELECT subject FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL)")
def orphan_entities(t):
    facts = t.facts.where(scope.live_facts()).select(F.col("subject").alias("subject_entity_id"))
    return graph.orphans(t.customer.select(F.col("c_custkey").alias("id")), t.mentions, facts).select("id")


@query("SELECT kind, subject, reason FROM (SELECT CASE WHEN entity_id % 2 = 1 THEN 'page' ELSE 'stale' END AS kind, entity_id AS subject, CASE WHEN entity_id % 2 = 1 THEN 'missing' WHEN entity_id % 4 = 0 THEN 'stale' WHEN n >= 3 THEN 'grown' END AS reason FROM (SELECT entity_id, count(DISTINCT chunk_id) AS n FROM mentions GROUP BY entity_id HAVING count(DISTINCT chunk_id) >= 3)) WHERE reason IS NOT NULL")
def page_items(t):
    return compact.page_items(t.mentions, t.entity_pages).select("kind", "subject", "reason")


@query("SELECT kind, subject FROM (SELECT CASE WHEN entity_id % 2 = 1 THEN 'page' ELSE 'stale' END AS kind, entity_id AS subject, entity_id % 2 AS odd FROM (SELECT DISTINCT entity_id FROM mentions)) WHERE NOT (kind = 'page' AND subject % 3 = 0) AND subject IN (SELECT entity_id FROM mentions GROUP BY entity_id HAVING count(DISTINCT chunk_id) >= 3)")
def work_item_upsert(t):
    new = compact.page_items(t.mentions, t.entity_pages).select("kind", "subject")
    open_ = t.supplier.where("s_suppkey % 3 = 0").select(F.lit("page").alias("kind"), F.col("s_suppkey").alias("subject"), F.lit("open").alias("state"))
    return compact.upsert_items(new, open_)


_STEM = r"""regexp_replace(w, '^[.,;:()"''`*_-]+|[.,;:()"''`*_-]+$', '', 'g')[1:5]"""
_FIELDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"


@query(rf"""WITH p AS (SELECT doc_id AS page_id, list_distinct(list_transform({_FIELDS.format('text')}, lambda w: {_STEM})) AS have FROM documents WHERE doc_id < 1000000000),
    m AS (SELECT item_id AS statement_id, list_filter(list_transform({_FIELDS.format('text')}, lambda w: regexp_replace(w, '^[.,;:()"'']+|[.,;:()"'']+$', '', 'g')), lambda w: length(w) >= 4) AS words FROM benchmark)
    SELECT page_id, statement_id, round(c, 6) AS coverage FROM (SELECT page_id, statement_id, len(list_filter(words, lambda w: list_contains(have, {_STEM})))::DOUBLE / len(words) AS c FROM p, m WHERE len(words) > 0) WHERE c < 75e-2""")
def omission_check(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("content"))
    must = t.benchmark.select(F.col("item_id").alias("statement_id"), F.col("text").alias("statement"))
    return compact.omissions_of_all(pages, must).select("page_id", "statement_id", R("coverage").alias("coverage"))


@query(rf"""WITH s AS (SELECT conv_id, n, sentence, list_filter(list_transform({_FIELDS.format('sentence')}, lambda w: {_STEM}), lambda w: length(w) >= 4 AND NOT starts_with(w, 'memo:')) AS words FROM
        (SELECT conv_id, unnest(s) AS sentence, unnest(range(len(s))) AS n FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(string_agg(text, chr(10) ORDER BY turn), '[.!?\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations WHERE role = 'assistant' GROUP BY conv_id))),
    h AS (SELECT conv_id, list_distinct(list_transform({_FIELDS.format('text')}, lambda w: {_STEM})) AS have FROM conversations WHERE role = 'user')
    SELECT conv_id, md5(sentence) AS sentence, round(max(r), 6) AS support FROM (SELECT s.conv_id, n, sentence, coalesce(len(list_filter(words, lambda w: list_contains(have, w)))::DOUBLE / len(words), 0) AS r FROM s LEFT JOIN h USING (conv_id) WHERE len(words) >= 8) GROUP BY conv_id, n, sentence HAVING max(r) < 5e-1""")
def unsupported_sentences(t):
    said = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    sources = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("page_id"), "text")
    out = compact.unsupported(said.withColumnRenamed("conv_id", "page_id"), sources)
    return out.select(F.col("page_id").alias("conv_id"), F.md5(F.col("sentence").cast("binary")).alias("sentence"), R("support").alias("support"))


@query("""WITH live AS (SELECT * FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL), n AS (SELECT entity_id, count(DISTINCT chunk_id) AS n FROM mentions GROUP BY entity_id)
    SELECT 'contradiction' AS kind, 'memo://fact/' || a.id AS uri, 'disagrees with memo://fact/' || b.id AS message FROM live a JOIN live b ON a.subject = b.subject AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to AND a.statement <> b.statement
        AND (a.recorded_at < b.recorded_at OR (a.recorded_at = b.recorded_at AND a.id < b.id))
    UNION ALL SELECT 'orphan-entity', 'memo://entity/' || s_suppkey, s_name || ' has no live passage mentioning it' FROM supplier WHERE s_suppkey NOT IN (SELECT entity_id FROM mentions) AND s_suppkey NOT IN (SELECT subject FROM live)
    UNION ALL SELECT 'missing-page', 'memo://entity/' || entity_id, 'mentioned in ' || n || ' live passages and has no page' FROM n WHERE n >= 3 AND entity_id % 2 = 1
    UNION ALL SELECT 'stale-page', 'memo://page/p' || s_suppkey, s_name || ': revised' FROM supplier WHERE s_suppkey % 4 = 0
    UNION ALL SELECT 'expired-fact', 'memo://fact/' || id, 'valid_to has passed and nothing supersedes it: ' || statement FROM live WHERE valid_to < AS_OF""".replace("AS_OF", str(T.AS_OF)))
def lint_union(t):
    entities = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical"))
    facts = t.facts.withColumn("subject_entity_id", F.col("subject"))
    return compact.lint(facts, entities, t.mentions, t.entity_pages, T.AS_OF)


@query("""SELECT 'documents without passages' AS problem, 0::BIGINT AS n UNION ALL SELECT 'vectors without passage', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id * 100000 + ord FROM lines)
    UNION ALL SELECT 'facts without evidence', count(*) FROM facts WHERE id NOT IN (SELECT doc_id * 100000 + ord FROM lines) UNION ALL SELECT 'passages without vector', count(*) FROM lines WHERE doc_id * 100000 + ord NOT IN (SELECT vec_id FROM embeddings)""")
def integrity(t):
    chunks = t.lines.select((F.col("doc_id") * 100000 + F.col("ord")).alias("id"), F.col("doc_id").alias("document_id"))
    vectors = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.lit("m").alias("model_id"))
    return compact.verify(t.docs.withColumn("deleted_at", F.lit(None).cast("bigint")), chunks, vectors, t.facts.withColumn("evidence_chunk_id", F.col("id")), "m")


@query()
def line_diff(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", compact.line_diff(F.lag("text").over(w), F.col("text")).alias("diff"))


# --- evaluation -----------------------------------------------------------------------------------------------------

_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = f"""{_QRELS}, r AS (SELECT query_id, id AS doc_id, rank FROM exact_hits WHERE rank <= 10),
    h AS (SELECT q.query_id, count(*) AS n, count(*) FILTER (WHERE rank <= 1) AS a1, count(*) FILTER (WHERE rank <= 5) AS a5, count(*) FILTER (WHERE rank <= 10) AS a10, min(rank) AS best,
        sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1e0) ELSE 0 END) AS dcg FROM qrels q LEFT JOIN r USING (query_id, doc_id) GROUP BY q.query_id),
    k AS (SELECT query_id, count(*) AS n_results FROM r GROUP BY query_id),
    m AS (SELECT query_id, coalesce(n, 0) AS n_relevant, coalesce(n_results, 0) AS n_results, coalesce(a1 / n, 0) AS recall_at_1, coalesce(a5 / n, 0) AS recall_at_5, coalesce(a10 / n, 0) AS recall_at_10,
        coalesce(1e0 / best, 0) AS mrr, coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1e0))), 0) AS ndcg FROM h FULL JOIN k USING (query_id))"""


def _metrics(t):
    results = _bm25(t, True).select("query_id", F.col("id").alias("doc_id"), "rank")
    return evaluation.metrics(results, t.qrels)


@query(f"WITH {_METRICS} SELECT query_id, n_relevant, n_results, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def recall_mrr_ndcg(t):
    return _metrics(t).select("query_id", "n_relevant", "n_results", *(R(c).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg")))


@query(f"WITH {_METRICS} SELECT q.query_id, round(avg(coalesce(rank, greatest(10, coalesce(n_results, 0)) + 1)::DOUBLE), 6) AS mean_rank FROM qrels q LEFT JOIN r USING (query_id, doc_id) LEFT JOIN k ON k.query_id = q.query_id GROUP BY q.query_id")
def mean_rank_miss(t):
    results = _bm25(t, True).select("query_id", F.col("id").alias("doc_id"), "rank")
    return evaluation.mean_rank(results, t.qrels).select("query_id", R("mean_rank").alias("mean_rank"))


@query(f"WITH {_METRICS} SELECT category, count(*) FILTER (WHERE n_relevant > 0) AS queries, round(avg(mrr) FILTER (WHERE n_relevant > 0), 6) AS mrr, round(avg(ndcg) FILTER (WHERE n_relevant > 0), 6) AS ndcg, round(avg((n_results = 0)::INT) FILTER (WHERE n_relevant = 0), 6) AS abstention FROM (SELECT *, CASE query_id % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'exact' ELSE 'long' END AS category FROM m) GROUP BY ROLLUP (category)")
def category_means(t):
    c = F.when(F.col("query_id") % 3 == 0, "lookup").when(F.col("query_id") % 3 == 1, "exact").otherwise("long")
    out = evaluation.category_means(_metrics(t).withColumn("category", c), ["mrr", "ndcg"])
    return out.select("category", "queries", *(R(x).alias(x) for x in ("mrr", "ndcg", "abstention")))


_GATE = f"""WITH qrels AS (SELECT item_id AS query_id, doc_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)),
    before_top AS (SELECT query_id, id, rank FROM exact_hits WHERE rank <= 10), after_top AS (SELECT query_id, id, rank FROM {{after}}),
    ideal AS (SELECT query_id, sum(1e0 / log2(i + 1)) AS best FROM (SELECT query_id, unnest(range(1, least(10, count(*)) + 1)) AS i FROM qrels GROUP BY query_id) GROUP BY query_id),
    scored AS (SELECT query_id, any_value(best) AS best, coalesce(sum(1e0 / log2(b.rank + 1)), 0) / any_value(best) AS ndcg_0, coalesce(sum(1e0 / log2(a.rank + 1)), 0) / any_value(best) AS ndcg_1, coalesce(max(1e0 / b.rank), 0) AS mrr_0, coalesce(max(1e0 / a.rank), 0) AS mrr_1
        FROM qrels q JOIN ideal USING (query_id) LEFT JOIN before_top b ON b.query_id = q.query_id AND b.id = q.doc_id LEFT JOIN after_top a ON a.query_id = q.query_id AND a.id = q.doc_id GROUP BY q.query_id)
    SELECT 'ndcg drop' AS reason, query_id FROM scored WHERE ndcg_0 - ndcg_1 > 25e-2 UNION ALL SELECT 'hit lost', query_id FROM scored WHERE mrr_0 > 0 AND mrr_1 = 0
    UNION ALL SELECT 'mean ndcg drop', NULL FROM scored HAVING avg(ndcg_0) - avg(ndcg_1) > 2e-2""".replace("q.query_id, any_value", "q.query_id, any_value").replace("SELECT query_id, any_value(best) AS best,", "SELECT q.query_id, any_value(best) AS best,")


def _gated(t, before, after):
    wanted = kept(t.qrels, "qrels")
    of = lambda df: kept(evaluation.metrics(df.select("query_id", F.col("id").alias("doc_id"), "rank"), wanted), "metrics")
    return evaluation.paired_gate(of(before), of(after)).select("reason", "query_id")


@query(_GATE.format(after="exact_hits WHERE rank = 10 OR (rank = 1 AND id % 2 = 0)"))
def paired_gate(t):
    """Against a search that has lost most of its ranks: what the gate has to say of it."""
    found = kept(_bm25(t, True).select("query_id", "id", "rank"), "found")
    return _gated(t, found, found.where("rank = 10 or (rank = 1 and id % 2 = 0)"))


# --- logs -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS tool, len(v) AS calls, v[floor((len(v) - 1) * 50 / 100)::INT + 1] AS p50, v[floor((len(v) - 1) * 95 / 100)::INT + 1] AS p95, v[-1] AS max FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def call_stats_percentiles(t):
    return logs.percentiles(t.events.withColumnRenamed("event_type", "tool"), ["tool"], "value")


_BOUNDS = ", ".join(f"({float(b)!r}e0)" if "e" not in repr(float(b)) else f"({b})" for b in logs.LATENCY_MS)


@query(f"SELECT event_type AS tool, le, count(*) FILTER (WHERE value <= coalesce(le, 1e300)) AS n FROM events, (SELECT le FROM (VALUES {_BOUNDS}, (NULL)) b(le)) GROUP BY event_type, le")
def latency_histogram(t):
    return logs.histogram(t.events.withColumnRenamed("event_type", "tool"), ["tool"], "value").select("tool", "le", "n")


@query(f"""WITH b AS (SELECT event_type AS tool, le, count(*) FILTER (WHERE value <= coalesce(le, 1e300))::DOUBLE AS n FROM events, (SELECT le FROM (VALUES {_BOUNDS}, (NULL)) b(le)) GROUP BY event_type, le),
    w AS (SELECT *, coalesce(lag(le) OVER p, 0) AS low, coalesce(lag(n) OVER p, 0) AS below, max(n) OVER (PARTITION BY tool) AS total FROM b WINDOW p AS (PARTITION BY tool ORDER BY le NULLS LAST))
    SELECT tool, round(CASE WHEN le IS NULL THEN low WHEN n > below THEN low + (le - low) * (95e-2 * total - below) / (n - below) ELSE le END, 6) AS p95
    FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY le NULLS LAST) AS k FROM w WHERE n >= 95e-2 * total AND total > 0) WHERE k = 1""")
def histogram_quantile(t):
    buckets = logs.histogram(t.events.withColumnRenamed("event_type", "tool"), ["tool"], "value")
    return logs.histogram_quantile(buckets, ["tool"], 0.95).select("tool", R("quantile").alias("p95"))


@query("SELECT count(*) AS queries, count(*) FILTER (WHERE event_id % 7 = 0) AS abstained, round(avg(value), 6) AS mean_latency, round(avg(event_id % 7), 6) AS mean_results FROM events")
def query_log_stats(t):
    log = t.events.select((F.col("event_id") % 7).alias("n_results"), F.col("value").alias("latency_ms"))
    return logs.query_log_stats(log).select("queries", "abstained", R("mean_latency").alias("mean_latency"), R("mean_results").alias("mean_results"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5000 AND ts >= TIMESTAMP '2024-01-10'")
def prune_log(t):
    return logs.prune(t.events, "event_id", "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 5000).select("event_id")


@query("SELECT 'documents' AS gauge, count(*) AS n FROM documents UNION ALL SELECT 'facts_live', count(*) FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'vectors', count(*) FROM embeddings")
def status_counts(t):
    return logs.status({"documents": (t.documents, None), "facts_live": (t.facts, scope.live_facts()), "events": (t.events, None), "vectors": (t.embeddings, None)})


@query("""SELECT user_id AS client, count(*) AS calls, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def live_sessions(t):
    return logs.sessions(t.events.select(F.col("user_id").alias("client"), "ts"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND event_id + 1 NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def in_flight(t):
    begun = t.events.where("event_type = 'view'").select("event_id", (F.col("event_id") + 1).alias("call_id"))
    return logs.in_flight(begun, t.events.where("event_type = 'click'").select(F.col("event_id").alias("call_id"))).select("event_id")


@query("SELECT event_id, sha256(user_id::VARCHAR)[1:12] AS handle FROM events")
def session_handle(t):
    return t.events.select("event_id", X.session_handle(F.col("user_id").cast("string")).alias("handle"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def log_tail(t):
    return logs.tail(t.events, "event_id", 50).select("event_id")


_SAYS = ("was Forgotten on", "Not Found", "needs a human, not found", "uri IS REQUIRED", "disk full", "Context Canceled", "must be one of", "deadline exceeded, was forgotten", "bad date", "Malformed", "not a memo:// address", "must name", "usage:", "needs rest")
#: A message: the text with its k-th word replaced by what such messages say; k and which go by the text's length.
_MESSAGE = f"""said AS (SELECT id, text, string_split(text, ' ') AS w, {list(_SAYS)}[length(text) % 14 + 1] AS says FROM messages),
    full_message AS (SELECT id, lower(array_to_string(list_concat(w[1:length(text) % len(w)], [says], w[length(text) % len(w) + 2:]), ' ')) AS m FROM said)"""
_CLASS = """CASE WHEN contains(m, 'was forgotten') THEN 'forgotten' WHEN contains(m, 'not found') THEN 'not_found' WHEN contains(m, 'needs a human') THEN 'needs_human'
    WHEN contains(m, 'context canceled') OR contains(m, 'deadline exceeded') THEN 'canceled'
    WHEN regexp_matches(m, 'is required|must be one of|must name|usage:|needs |bad |malformed|not a memo://') THEN 'invalid_args' ELSE 'internal' END"""


def _message(text):
    w, n = F.split(text, " "), F.length(text)
    k = F.pmod(n, F.size(w))
    says = F.element_at(F.array(*map(F.lit, _SAYS)), (F.pmod(n, F.lit(len(_SAYS))) + 1).cast("int"))
    return F.array_join(F.concat(F.slice(w, F.lit(1), k), F.array(says), F.slice(w, k + 2, F.greatest(F.lit(0), F.size(w) - k - 1))), " ")


@query(f"WITH messages AS (SELECT doc_id AS id, text FROM documents), {_MESSAGE} SELECT id AS doc_id, {_CLASS} AS class FROM full_message")
def error_classes(t):
    return t.documents.select("doc_id", X.error_class(_message(F.col("text"))).alias("class"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"max_tokens":' || event_id || ',"query":"' || event_type || '"}' ELSE '{"content_len":' || (length(event_type) + 2) || ',"namespace":"n"}' END AS summary FROM events""")
def argument_summary(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("query"), F.col("event_id").alias("max_tokens"), F.lit("x").alias("secret")))).otherwise(F.to_json(F.struct(F.lit("n").alias("namespace"), F.col("event_type").alias("content"), F.lit("x").alias("mode"))))
    return t.events.select("event_id", logs.argument_summary(F.when(F.col("event_id") % 2 == 0, "search").otherwise("ingest"), raw).alias("summary"))


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query(r"""SELECT id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60], '-+$', '') AS s FROM docs)""")
def slugify(t):
    return t.docs.select("id", X.slug(F.substring("text", 1, 80)).alias("slug"))


@query("""SELECT position, line FROM (SELECT row_number() OVER w AS position, line, sum(strlen(line) + 1) OVER w AS spent FROM (SELECT namespace, title, uri, '- ' || title || ' · ' || uri || ' · ' || kind || ' · ' || trust AS line FROM docs) WINDOW w AS (ORDER BY namespace, title, uri ROWS UNBOUNDED PRECEDING)) WHERE spent <= 8192 - 8 - 80""")
def export_index_budget(t):
    return markdown.bounded_index(t.docs.withColumn("version", F.lit(""))).select(F.col("position").cast("bigint").alias("position"), "line")


@query("SELECT id, title, namespace, md5(text) AS body FROM docs")
def front_matter_round_trip(t):
    docs = t.docs.select("id", "title", "namespace", "kind", F.col("text").alias("content"))
    back = docs.select(F.inline(F.array(X.front_matter(markdown.rendered(docs)))))
    return back.select(F.col("meta.id").cast("bigint").alias("id"), F.col("meta.title").alias("title"), F.col("meta.namespace").alias("namespace"), F.md5(F.col("body").cast("binary")).alias("body"))


@query("""SELECT '{"id":"log-' || event_id || '","query":"' || event_type || '","category":"replay","relevant":[]}' AS value FROM events""")
def log_replay_jsonl(t):
    return markdown.replay_lines(t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("query")))


@query("""SELECT '# HELP calls_total Calls by tool.' AS line UNION ALL SELECT '# TYPE calls_total counter' UNION ALL SELECT 'calls_total{tool="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type""")
def prometheus_text(t):
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    families = n.select(F.lit("calls_total").alias("name"), F.lit("Calls by tool.").alias("help"), F.lit("counter").alias("type"), F.create_map(F.lit("tool"), "event_type").alias("labels"), F.lit("").alias("suffix"), "value")
    return markdown.prometheus_lines(families)


@query("SELECT id, 'chunk' AS kind, id::VARCHAR AS key FROM docs")
def address_parse(t):
    return t.docs.select("id", F.inline(F.array(X.parse_address(X.address("chunk", F.col("id"))))))


@query("SELECT doc_id, coalesce(len(regexp_extract_all(text, '\\n')), 0)::BIGINT AS cited FROM documents".replace("'\\n'", "chr(10)"))
def cited_chunks(t):
    marked = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), lambda i: F.concat(F.lit("(memo://chunk/"), i.cast("string"), F.lit(")"))))
    return t.documents.select("doc_id", (F.size(X.cited_chunks(marked)) - 1).cast("bigint").alias("cited"))


# --- streams --------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT source AS namespace, hash AS content_hash FROM hashed JOIN documents USING (doc_id)")
def stream_ingest_dedup(t):
    return t.streamed_first_seen()


@query("""WITH s AS (SELECT user_id AS client, count(*) AS calls, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s)
    SELECT client, calls, first_ts, last_ts FROM s WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(t):
    return t.streamed_sessions().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


from . import more_queries, state_queries  # noqa: E402, F401  register the rest
