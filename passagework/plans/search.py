"""One plan for a whole batch of requests: arms, fusion, recency, cut-offs, and why each result is where it is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stem import stem_words
from ..operators import adjacency, fusion, graph, index, scope as scope_, segments
from .profiles import Profile


@dataclass
class Corpus:
    """What a search reads. passages: id, document_id, ord, text, est_tokens, context_header; documents: id, kind, title, uri, updated_at and the scope's fields.

    index: segments of the passages, over which statistics are taken; without it the passages are tokenised for the request batch.
    """

    passages: DataFrame
    documents: DataFrame
    vectors: DataFrame | None = None  # id, embedding
    facts: DataFrame | None = None  # id, statement, evidence_chunk_id and the scope's fields
    fact_vectors: DataFrame | None = None
    mentions: DataFrame | None = None  # entity_id, chunk_id, weight
    wanted: DataFrame | None = None  # query_id, entity_id
    index: segments.Index | None = None
    graph: Callable[[], adjacency.Graph] | None = None  # the mentions' graph as stored, if it is


def visible(corpus: Corpus, scope: scope_.Scope) -> DataFrame:
    """Passages whose document is in scope."""
    docs = corpus.documents.where(scope_.documents(scope)).select(F.col("id").alias("_doc"))
    return corpus.passages.join(docs, F.col("document_id") == F.col("_doc"), "left_semi")


def fact_arm(corpus: Corpus, queries: DataFrame, scope: scope_.Scope, profile: Profile) -> DataFrame:
    """Passages that back a matching fact. A fact's rank is the better of its keyword and its semantic one; a passage votes once, with its best fact.

    A fact that only words found must have half of the query's terms; one that only meaning found must reach the floor.
    """
    facts = corpus.facts.where(scope_.facts(scope) & F.col("evidence_chunk_id").isNotNull())
    words = index.bm25(index.tokenised(corpus.facts, "id", F.col("statement")), queries, facts, None, "fact", True).withColumnRenamed("rank", "k_rank")
    words = words.join(queries.select("query_id", F.size("terms").alias("n_terms")), "query_id").withColumn("half", F.size(F.col("terms")) * 2 >= F.col("n_terms"))
    words = words.select("query_id", "id", "k_rank", "half")
    if corpus.fact_vectors is not None and "vector" in queries.columns:
        near = index.nearest(corpus.fact_vectors.join(facts.select("id"), "id", "left_semi"), queries, profile.depth, profile.semantic_floor, "fact").select("query_id", "id", F.col("rank").alias("s_rank"))
        words = words.join(near, ["query_id", "id"], "full")
    else:
        words = words.withColumn("s_rank", F.lit(None).cast("int"))
    found = words.where(F.col("half") | F.col("s_rank").isNotNull()).withColumn("best", F.least(F.when(F.col("half"), F.col("k_rank")), "s_rank"))
    backed = found.join(facts.select("id", "evidence_chunk_id"), "id").groupBy("query_id", F.col("evidence_chunk_id").alias("id")).agg(F.min("best").alias("best"))
    return index.ranked(backed.select("query_id", "id", (-F.col("best")).cast("double").alias("raw")), "fact", profile.depth)


def _keyword_arms(corpus: Corpus, queries: DataFrame, names: list[str], inside: DataFrame, depth: int, of) -> list[DataFrame]:
    """The keyword arm over stems of header and text, and the exact arm over the text's own tokens, both from postings."""
    header = F.coalesce("context_header", F.lit(""))
    out = []
    for arm, kind, terms in (("keyword", "stem", "terms"), ("exact", "exact", "exact_terms")):
        if arm not in names:
            continue
        asked = of(arm).select("query_id", F.col(terms).alias("terms"))
        if corpus.index is not None:
            out.append(segments.search(corpus.index, kind, asked, inside, depth, arm))
        elif kind == "exact":
            out.append(index.bm25(index.tokenised(corpus.passages, "id", F.col("text"), True), asked, inside, depth, arm))
        else:
            whole = F.concat_ws("\n", F.nullif(header, F.lit("")), "text")
            out.append(index.bm25(index.tokenised(corpus.passages, "id", whole), asked, inside, depth, arm, True))
    return out


def arms(corpus: Corpus, queries: DataFrame, names: list[str], scope: scope_.Scope, profile: Profile) -> DataFrame:
    """All ranked lists in one schema. queries: query_id, terms (stems), exact_terms, vector (as the arms need) and, if they differ, the arms of each."""
    inside = visible(corpus, scope).select("id")
    of = lambda arm: queries.where(F.array_contains("arms", arm)) if "arms" in queries.columns else queries
    lists = _keyword_arms(corpus, queries, names, inside, profile.depth, of)
    if "semantic" in names and corpus.vectors is not None:
        lists.append(index.nearest(corpus.vectors.join(inside, "id", "left_semi"), of("semantic").where("vector is not null"), profile.depth))
    if "fact" in names and corpus.facts is not None:
        lists.append(fact_arm(corpus, of("fact"), scope, profile).join(inside, "id", "left_semi"))
    if "arms" in queries.columns and corpus.wanted is not None:
        named = queries.where(F.array_contains("arms", "graph") | F.array_contains("arms", "entity")).select("query_id")
        corpus = replace(corpus, wanted=corpus.wanted.join(named, "query_id", "left_semi"))
    if "entity" in names and corpus.mentions is not None:
        seen = corpus.mentions.join(inside.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        lists.append(graph.entity_arm(seen, corpus.wanted, profile.depth))
    if "graph" in names and corpus.mentions is not None:
        lists.append(walk(corpus, profile).join(inside, "id", "left_semi"))
    common = ["query_id", "arm", "id", "rank", "raw"]
    whole = [x.select(*common, (F.col("hops") if "hops" in x.columns else F.lit(None)).cast("int").alias("hops")) for x in lists]
    out = whole[0]
    for x in whole[1:]:
        out = out.unionByName(x)
    if "request_id" in queries.columns:  # several queries of one request: each list votes with its share
        asked = queries.select("query_id", "request_id", F.count(F.lit(1)).over(Window.partitionBy("request_id")).cast("double").alias("n_queries"))
        alone = F.col("arm").isin("entity", "graph")
        out = out.join(asked, "query_id").select(F.col("request_id").alias("query_id"), "arm", "id", "rank", "raw", "hops", F.when(alone, 1.0).otherwise(F.col("n_queries")).alias("n_queries"))
    return out


def mention_edges(mentions: DataFrame) -> DataFrame:
    """Entities and passages as nodes `e…` and `c…` of one graph: a, b, weight."""
    return mentions.select(F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("b"), "weight")


def walk(corpus: Corpus, profile: Profile) -> DataFrame:
    """The graph arm, walked from each named entity; over the stored graph where there is one."""
    node_e, edges = F.concat(F.lit("e"), F.col("entity_id").cast("string")), mention_edges(corpus.mentions)
    seeds = corpus.wanted.select("query_id", F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("seed"))
    if corpus.graph is not None:
        there = corpus.graph()
        mass, n = adjacency.walk(there, seeds), there.nodes.count()
    else:
        mass = graph.pagerank(edges, seeds.select("seed").distinct())
        n = edges.select("a").distinct().count() + edges.select("b").distinct().count()
    chunk = F.when(F.col("node").startswith("c"), F.substring("node", 2, 30)).cast("bigint")
    own = corpus.mentions.select(node_e.alias("entity_id"), "chunk_id")
    return graph.graph_arm(mass, own, seeds, n, chunk, 2 * profile.depth)


Scorer = Callable[[Column, Column], Column]


def overlap_score(query: Column, text: Column) -> Column:
    """The reranker at hand: the share of the query's terms that a text has. Any function of two columns may stand in, a pandas UDF with a model too."""
    terms = X.query_terms(query)
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, X.word_tokens(X.fold(text)))) / F.size(terms)).otherwise(0.0)


def rerank(rows: DataFrame, top: int, scorer: Scorer = overlap_score) -> DataFrame:
    """The first `top` of each query in the order of the scorer; the rest after them as they were."""
    score = F.when(F.col("position") <= top, scorer(F.col("query"), F.col("text"))).otherwise(F.lit(-1.0))
    scored = rows.withColumn("rerank", score)
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "position")))


def search(
    corpus: Corpus, queries: DataFrame, names: list[str], profile: Profile = Profile(), scope: scope_.Scope = scope_.Scope(), now_ms: int = 0, token_budget: int | None = None,
    form: str = "detailed", seen: DataFrame | None = None, per_document: bool = True, limit: int | None = None, scorer: Scorer | None = None,
) -> DataFrame:
    """Results of all queries: query_id, position, id, document_id, fused, recency, final, arms (rank, raw, contribution, hops each), band, content, provenance and matched.

    The sum of contributions is fused; final is fused times recency. form: concise, detailed or explain; with explain, `matched` has the words of the
    text that the request's words found, as they are written there, else it is empty.
    """
    lists = arms(corpus, queries, names, scope, profile)
    fused = fusion.min_max(lists, profile.weights) if profile.fusion == "minmax" else fusion.rrf(lists, profile.weights, profile.k)
    fused = fusion.semantic_floor(fused, profile.semantic_floor)
    reranks = bool(profile.rerank_top or scorer is not None)
    places = corpus.passages.select("id", "document_id", "ord", "est_tokens")
    fresh = [c for c in ("fetched_at", "ttl_s") if c in corpus.documents.columns]
    docs = corpus.documents.select(F.col("id").alias("document_id"), "kind", "title", "uri", "trust", "updated_at", *fresh)
    rows = fused.join(places, "id").join(docs, "document_id")
    kinds = None if profile.recency_kinds is None else list(profile.recency_kinds)
    rows = rows.withColumn("recency", fusion.recency(F.col("kind"), F.col("updated_at"), now_ms, kinds, profile.recency_floor, profile.half_life_days)).withColumn("final", F.col("fused") * F.col("recency"))
    if per_document:
        rows = fusion.best_passage(rows)
    if seen is not None:
        rows = fusion.unseen(rows, seen)
    rows = fusion.numbered(rows)
    if reranks:
        asked = queries.select(F.col("request_id" if "request_id" in queries.columns else "query_id").alias("query_id"), "query", F.col("query_id").alias("_q")).groupBy("query_id").agg(F.min_by("query", "_q").alias("query"))
        top = profile.rerank_top or 30
        rows = rows.where(F.col("position") <= max(top, limit or profile.limit))  # what stands after them stays after them; texts are read for these alone
        rows = rerank(rows.join(asked, "query_id").join(corpus.passages.select("id", "text"), "id"), top, scorer or overlap_score).drop("query", "text")
    rows = fusion.limit(rows, limit or profile.limit)
    if not reranks:
        rows = fusion.gap_cut(rows, profile.gap, profile.min_results)
    if token_budget:
        rows = fusion.budget(rows, F.col("est_tokens"), token_budget)
    rows = with_texts(corpus.passages, rows, form != "concise")
    rows = with_matched(rows, queries) if form == "explain" else rows.withColumn("matched", F.array().cast("array<string>"))
    cosine = F.when(F.exists("arms", lambda a: a["arm"] == "semantic"), F.array_max(F.transform(F.filter("arms", lambda a: a["arm"] == "semantic"), lambda a: a["raw"])))
    stale = fusion.stale(F.col("fetched_at"), F.col("ttl_s"), now_ms) if len(fresh) == 2 else F.lit(False)
    return rows.select(
        "query_id", "position", "id", "document_id", "fused", "recency", "final", "arms", fusion.relevance(cosine, profile.bands).alias("band"),
        fusion.rendered(F.col("text"), F.col("before"), F.col("after"), form).alias("content"), F.struct("uri", "title", "kind", "trust", "updated_at", stale.alias("stale")).alias("provenance"), "matched",
    )


def with_matched(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Results (query_id, id, text) with `matched`: in the order of the text, its distinct words, in lower case, whose stem or exact form the request asks for."""
    request = "request_id" if "request_id" in queries.columns else "query_id"
    asked = lambda column: queries.select(F.col(request).alias("query_id"), F.explode(F.flatten(F.transform(column, lambda w: F.split(w, " ")))).alias("_asked")).distinct()
    words = lambda tokens: rows.select("query_id", "id", F.posexplode(tokens).alias("_at", "_word"))
    found = []
    if "terms" in queries.columns:
        spread = words(X.word_tokens(F.col("text")))
        stems = spread.select("_word").distinct().select("_word", stem_words(X.fold(F.col("_word"))).alias("_asked"))
        found.append(spread.join(stems, "_word").join(asked("terms"), ["query_id", "_asked"], "left_semi").select("query_id", "id", "_at", "_word"))
    if "exact_terms" in queries.columns:
        spread = words(X.exact_tokens(F.col("text"))).withColumn("_asked", X.fold(F.col("_word")))
        found.append(spread.join(asked("exact_terms"), ["query_id", "_asked"], "left_semi").select("query_id", "id", "_at", "_word"))
    if not found:
        return rows.withColumn("matched", F.array().cast("array<string>"))
    every = reduce(DataFrame.unionByName, found).groupBy("query_id", "id", "_word").agg(F.min("_at").alias("_at"))
    told = every.groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]).alias("matched"))
    return rows.join(told, ["query_id", "id"], "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def with_texts(passages: DataFrame, rows: DataFrame, neighbours: bool = True) -> DataFrame:
    """The text of each result and of the passages before and after it: read for results only, by (document, place)."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)) if neighbours else F.array(F.lit(0))
    wanted = rows.select("document_id", "ord").distinct().select("document_id", F.col("ord").alias("at"), F.explode(near).alias("step")).withColumn("ord", F.col("at") + F.col("step"))
    found = passages.select("document_id", "ord", "text").join(wanted, ["document_id", "ord"])
    one = lambda step: F.max(F.when(F.col("step") == step, F.col("text")))
    texts = found.groupBy("document_id", F.col("at").alias("ord")).agg(one(0).alias("text"), one(-1).alias("before"), one(1).alias("after"))
    return rows.join(texts, ["document_id", "ord"])


def abstained(queries: DataFrame, found: DataFrame, scope: scope_.Scope, profile: Profile, unfloored: DataFrame | None = None) -> DataFrame:
    """Requests without a result: query_id, reason, hint. unfloored: query_id, below (passages that only the semantic floor kept out)."""
    none = queries.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    reason = F.lit("no arm matched")
    if unfloored is not None:
        none = none.join(unfloored, "query_id", "left")
        text = F.concat(F.lit("nothing matched by keyword and the "), F.col("below").cast("string"), F.lit(f" nearest passages are below the similarity floor ({profile.semantic_floor:.2f})"))
        reason = F.when(F.col("below") > 0, text).otherwise(reason)
    return none.select("query_id", reason.alias("reason"), F.lit(scope_.hint(scope)).alias("hint"))


def search_facts(facts: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, profile: Profile = Profile(), scope: scope_.Scope = scope_.Scope()) -> DataFrame:
    """Facts themselves: reciprocal-rank fusion of words and meaning; trust decides among scores within a tenth of a group's best."""
    seen = facts.where(scope_.facts(scope))
    lists = index.bm25(index.tokenised(facts, "id", F.col("statement")), queries, seen, profile.depth, "keyword", True).select("query_id", "arm", "id", "rank", "raw")
    if vectors is not None:
        lists = lists.unionByName(index.nearest(vectors.join(seen.select("id"), "id", "left_semi"), queries, profile.depth, profile.semantic_floor).select(*lists.columns))
    fused = fusion.rrf(lists, profile.weights, profile.k).join(seen.select("id", "statement", "trust", "evidence_chunk_id"), "id")
    return fusion.limit(fusion.by_trust_within(fused), profile.limit)


def search_pages(pages: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, profile: Profile = Profile(), scope: scope_.Scope = scope_.Scope()) -> DataFrame:
    """Written pages by title and content, with their staleness."""
    seen = pages.where(scope_.pages(scope))
    lists = index.bm25(index.tokenised(pages, "id", F.concat_ws("\n", "title", "content")), queries, seen, profile.depth, "keyword", True).select("query_id", "arm", "id", "rank", "raw")
    if vectors is not None:
        lists = lists.unionByName(index.nearest(vectors.join(seen.select("id"), "id", "left_semi"), queries, profile.depth, profile.semantic_floor).select(*lists.columns))
    fused = fusion.rrf(lists, profile.weights, profile.k).join(seen.select("id", "title", "stale", "is_inference"), "id").withColumn("final", F.col("fused"))
    return fusion.limit(fusion.numbered(fused), profile.limit)
