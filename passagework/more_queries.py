"""More queries over the test tables, for the smaller operators, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import compact, evaluation, facts, fusion, graph, index, ingest, logs, resolve, scope
from .plans import fixtures as T
from .plans import search as S
from .plans.profiles import PROFILES
from .queries import _CLASS, _GATE, _MESSAGE, R, _bm25, _gated, _message, _near, query
from .sources import markdown
from .streaming import ingest as stream

md5 = lambda c: F.md5(c.cast("binary"))

# --- sources and ingest ---------------------------------------------------------------------------------------------


@query(r"SELECT id, md5(CASE WHEN id % 3 = 0 THEN text ELSE '```go' || chr(10) || regexp_replace(text, '\n+\z', '') || chr(10) || '```' || chr(10) END) AS body FROM docs")
def code_fencing(t):
    name = F.concat(F.lit("file"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, ".md").otherwise(".go"))
    return t.docs.select("id", md5(X.fence_code(name, F.col("text"))).alias("body"))


@query("SELECT id, md5(title || ' > ' || namespace || chr(10) || text) AS embedded, md5('query: ' || text) AS prefixed FROM docs")
def embedded_text(t):
    header = X.context_header(F.col("title"), F.col("namespace"))
    return t.docs.select("id", md5(X.embed_text(header, F.col("text"))).alias("embedded"), md5(X.role_prefix(F.col("text"), "query: ")).alias("prefixed"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '(untitled)' ELSE title END AS title FROM docs")
def title_default(t):
    content = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("intro\n# "), "title", F.lit(" \n# second")))
    return t.docs.select("id", X.first_heading(content).alias("title"))


@query("""SELECT updated_at AS ts, 'cli' AS actor, 'cli' AS channel, CASE WHEN id % 2 = 0 THEN 'ingest' ELSE 'revise' END AS op, 'memo://doc/' || id AS target_uri, '{"namespace":"' || namespace || '","kind":"' || kind || '"}' AS detail FROM docs""")
def audit_rows(t):
    op = F.when(F.col("id") % 2 == 0, "ingest").otherwise("revise")
    return t.docs.select(*ingest.audit_row(F.col("updated_at"), op, X.address("doc", F.col("id")), F.struct("namespace", "kind"), F.lit("cli")))


@query("SELECT op, channel, count(*) AS n, max(ts) AS last FROM (SELECT updated_at AS ts, CASE trust WHEN 'curated' THEN 'promote' WHEN 'agent' THEN 'forget' ELSE 'ingest' END AS op, CASE WHEN kind = 'note' THEN 'tool' ELSE 'cli' END AS channel FROM docs) GROUP BY ALL")
def audit_trail(t):
    op = F.when(F.col("trust") == "curated", "promote").when(F.col("trust") == "agent", "forget").otherwise("ingest")
    rows = t.docs.select(*ingest.audit_row(F.col("updated_at"), op, F.col("uri"), F.struct("kind"), F.when(F.col("kind") == "note", "tool").otherwise("cli")))
    return rows.groupBy("op", "channel").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("SELECT 'm' || label AS id, count(*) AS n_vectors, label = 3 AS is_default FROM embeddings GROUP BY label")
def model_registry(t):
    vectors = t.embeddings.select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model_id"))
    known = vectors.select(F.col("model_id").alias("id"), F.lit(0).alias("installed_at")).distinct()
    return ingest.models(known, vectors, "m3").select("id", "n_vectors", "is_default")


@query("SELECT id % 100 AS page_id, min(CASE WHEN deleted_at IS NOT NULL THEN 'forgotten' ELSE 'revised' END) AS stale_reason FROM revisions WHERE deleted_at IS NOT NULL OR superseded_by IS NOT NULL GROUP BY id % 100")
def stale_pages(t):
    retired = t.revisions.where("deleted_at is not null or superseded_by is not null").select(F.col("id").alias("document_id"), F.when(F.col("deleted_at").isNotNull(), "forgotten").otherwise("revised").alias("reason"))
    cited = t.revisions.select((F.col("id") % 100).alias("page_id"), F.col("id").alias("chunk_id"))
    return ingest.stale_pages(cited, t.revisions.select("id", F.col("id").alias("document_id")), retired).select("page_id", "stale_reason")


@query(r"SELECT conv_id, turn, regexp_matches(text, '^[A-Za-z0-9._-]{1,64}$') AND text NOT IN ('.', '..') AS valid, regexp_matches(role, '^[A-Za-z0-9._-]{1,64}$') AS role_valid, regexp_matches(text, '^[0-9._-]+$') AS number FROM conversations")
def input_validation(t):
    return t.conversations.select("conv_id", "turn", X.valid_name(F.col("text")).alias("valid"), X.valid_name(F.col("role")).alias("role_valid"), X.is_number(F.col("text")).alias("number"))


@query("SELECT id, namespace, updated_at, passages FROM (SELECT d.*, (SELECT count(*) FROM lines l WHERE l.doc_id = d.id) AS passages FROM docs d WHERE kind = 'note' AND updated_at >= 1700360000000) ORDER BY updated_at DESC, id DESC LIMIT 50")
def live_listing(t):
    chunks = t.lines.select(F.col("doc_id").alias("document_id"))
    return ingest.listing(t.docs, chunks, kind="note", since_ms=1_700_360_000_000).select("id", "namespace", "updated_at", "passages")


@query("SELECT document_id, text FROM (SELECT namespace AS document_id, first_value(text) OVER (PARTITION BY namespace ORDER BY id) AS text, row_number() OVER (PARTITION BY namespace ORDER BY id) AS n FROM docs) WHERE n = 1".replace("SELECT document_id, text", "SELECT document_id, md5(text) AS text", 1))
def first_passages(t):
    w = Window.partitionBy("namespace").orderBy("id")
    chunks = t.docs.select(F.col("namespace").alias("document_id"), (F.row_number().over(w) - 1).alias("ord"), "text")
    wanted = chunks.where("ord = 0").select("document_id", "ord")
    return S.with_texts(chunks, wanted, False).select("document_id", md5(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, md5(text) AS text, md5(before) AS before, md5(after) AS after FROM (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn % 2 = 1")
def late_texts(t):
    passages = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), "text")
    out = S.with_texts(passages, passages.where("ord % 2 = 1").select("document_id", "ord"))
    return out.select(F.col("document_id").alias("conv_id"), F.col("ord").alias("turn"), *(md5(F.col(c)).alias(c) for c in ("text", "before", "after")))


# --- scope ----------------------------------------------------------------------------------------------------------


@query("SELECT id FROM docs WHERE namespace = 'src1' OR uri = 'doc://src2/20'")
def source_scope(t):
    return t.docs.withColumn("source_id", F.col("namespace")).where(scope.only(scope.Scope(sources=["src1", "doc://src2/20"]))).select("id")


@query("SELECT id FROM docs WHERE tag = 'de' AND kind = 'note'")
def library_scope(t):
    return t.docs.withColumn("library", F.col("tag")).where(scope.only(scope.Scope(library="de", kinds=["note"]))).select("id")


@query("SELECT id FROM docs WHERE tag = 'fr' AND kind = 'note'")
def several_tags_scope(t):
    return t.docs.withColumn("tags", F.array("tag", "kind")).where(scope.has_tags(["fr", "note"])).select("id")


@query("SELECT id FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL AND trust IN ('user', 'curated')")
def fact_scope(t):
    return t.facts.where(scope.facts(scope.Scope(namespaces=["ns"], min_trust="user", tags=["ignored"]))).select("id")


@query("SELECT id FROM docs WHERE namespace IN ('src0', 'src3')")
def page_scope(t):
    return t.pages_written.where(scope.pages(scope.Scope(namespaces=["src0", "src3"]))).select("id")


@query("SELECT count(*) FILTER (WHERE trust = 'curated' AND namespace = 'src1') AS live_docs, 0::BIGINT AS by_revocation, count(*) FILTER (WHERE trust <> 'curated') AS by_min_trust FROM docs")
def trust_counts(t):
    rows = t.docs.withColumn("deleted_at", F.lit(None).cast("bigint")).withColumn("superseded_by", F.lit(None).cast("bigint"))
    return scope.counts(rows, scope.Scope(namespaces=["src1"], min_trust="curated"))


# --- text -----------------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, ord, line, sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) + 1) OVER (PARTITION BY doc_id ORDER BY ord) AS spent FROM lines)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY ord)) AS cut FROM l WHERE ord = 0 OR spent <= 60 GROUP BY doc_id""")
def line_budget(t):
    return t.documents.select("doc_id", md5(X.cut_lines(F.col("text"), 60)).alias("cut"))


@query("SELECT p_partkey, regexp_replace(p_brand || p_name, '[^0-9]', '', 'g') AS digits FROM part")
def digit_signatures(t):
    return t.part.select("p_partkey", X.digit_signature(F.concat("p_brand", "p_name")).alias("digits"))


_GRAMS = r"""w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT id, CASE WHEN len(w) >= 8 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE [] END AS g FROM w)"""


@query(f"WITH {_GRAMS} SELECT id AS doc_id, len(g)::BIGINT AS n, md5(array_to_string(list_sort(g), '|')) AS grams FROM g")
def word_gram_sets(t):
    grams = X.word_grams(F.col("text"))
    return t.documents.select("doc_id", F.size(grams).cast("bigint").alias("n"), md5(F.array_join(F.array_sort(grams), "|")).alias("grams"))


@query("SELECT doc_id, substr(text, 1, 80) AS summary FROM documents")
def history_summary(t):
    return t.documents.select("doc_id", F.substring("text", 1, 80).alias("summary"))


@query(r"""WITH o AS (SELECT conv_id, turn, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT conv_id, turn, text, unnest(['text', 'before', 'after']) AS k, unnest([text, b, a]) AS x FROM o), s AS (SELECT *, trim(regexp_replace(x, '\s+', ' ', 'g')) AS t FROM c),
    l AS (SELECT *, length(regexp_extract(t, '^[^.!?]*[.!?]')) AS stop FROM s), one AS (SELECT conv_id, turn, text, k, CASE WHEN stop > 41 AND stop <= 200 THEN t[1:stop] WHEN length(t) > 160 THEN t[1:160] || '…' ELSE t END AS line FROM l),
    p AS (SELECT conv_id, turn, any_value(text) AS text, max(line) FILTER (WHERE k = 'text') AS own, max(line) FILTER (WHERE k = 'before') AS b, max(line) FILTER (WHERE k = 'after') AS a FROM one GROUP BY conv_id, turn)
    SELECT conv_id, turn, own AS concise, md5(coalesce('[…before: ' || b || ']' || chr(10), '') || text || coalesce(chr(10) || '[…after: ' || a || ']', '')) AS detailed FROM p""")
def response_formats(t):
    rows = ingest.neighbours(t.conversations, "conv_id", "turn")
    return rows.select("conv_id", "turn", fusion.rendered(F.col("text"), form="concise").alias("concise"), md5(fusion.rendered(F.col("text"), F.col("before"), F.col("after"))).alias("detailed"))


# --- ranking and answers --------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN id % 5 = 0 THEN FALSE ELSE updated_at + (id % 1000) * 86400 * 1000 < 1750000000000 END AS stale FROM docs")
def ttl_freshness(t):
    ttl = F.when(F.col("id") % 5 != 0, (F.col("id") % 1000) * 86400)
    return t.docs.select("id", fusion.stale(F.col("updated_at"), ttl, 1_750_000_000_000).alias("stale"))


@query("""SELECT q.query_id, CASE WHEN count(h.id) > 0 THEN 'nothing matched by keyword and the ' || count(h.id) || ' nearest passages are below the similarity floor (0.30)' ELSE 'no arm matched' END AS reason, 'narrow with scope.version, or rephrase' AS hint
    FROM exact_queries q LEFT JOIN exact_hits h ON h.query_id = q.query_id AND rank <= 20 GROUP BY q.query_id HAVING coalesce(max(raw), 0) < 60""", needs=["exact_queries", "exact_hits"])
def abstentions(t):
    """The benchmark's requests against all documents; of those that no document answers with a score of 60, how many came near."""
    hits = _bm25(t, True, 20)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"))
    below = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("below"))
    return S.abstained(asked, hits.where("raw >= 60"), scope.Scope(namespaces=["a"]), PROFILES["default"], below)


@query("SELECT query_id, id, array_to_string(list_sort(list_filter(q.terms, lambda x: list_contains(w.tokens, x))), ' ') AS terms FROM keyword_hits h JOIN keyword_queries q USING (query_id) JOIN word_tokens w USING (id) WHERE rank <= 10", needs=["keyword_queries", "word_tokens"])
def matched_terms(t):
    return _bm25(t, False).select("query_id", "id", F.array_join("terms", " ").alias("terms"))


# scores follow ranks; a passage is backed by one fact here, so its rank is the fact's among those with half of the terms
@query(rf"""WITH fact_tokens AS (SELECT id, regexp_extract_all(lower(statement), '[\p{{L}}\p{{N}}]+') AS tokens FROM facts),
    fact_queries AS (SELECT min(id) AS query_id, [w FOR w IN regexp_extract_all(lower(statement), '[\p{{L}}\p{{N}}]+') IF length(w) > 1 AND w NOT IN ('not')] AS terms FROM facts GROUP BY statement),
    {T._stem_hits("fact", "fact_tokens", "fact_queries")}
    SELECT query_id, id, place AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS place FROM fact_hits JOIN facts USING (id) WHERE deleted_at IS NULL AND invalidated_at IS NULL) WHERE place <= 100""")
def fact_arm(t):
    queries = index.stem_terms(t.priorities.select(F.col("id").alias("query_id"), X.query_terms(F.col("statement")).alias("terms")))
    return S.fact_arm(S.Corpus(t.docs, t.docs, facts=t.facts), queries, scope.Scope(), PROFILES["default"]).select("query_id", "id", "rank")


# --- facts, entities and graph ---------------------------------------------------------------------------------------


@query("SELECT id, trust FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 'curated' WHEN id % 5 = 0 THEN 'user' ELSE trust END AS trust FROM facts)")
def promoted_trust(t):
    rows = t.facts.select("id", "statement", "recorded_at", "trust", F.lit(None).cast("bigint").alias("supersedes"))
    events = t.facts.where("id % 5 = 0").select("id", F.lit(1).alias("at"), F.lit("user").alias("trust")).union(t.facts.where("id % 10 = 0").select("id", F.lit(2), F.lit("curated")))
    return facts.state(rows, None, events).select("id", "trust")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN least(coalesce(lead_at, 4000000000000), recorded_at + 5) ELSE lead_at END AS invalidated_at FROM (SELECT *, lead(recorded_at) OVER (PARTITION BY subject ORDER BY recorded_at, id) AS lead_at FROM chained)")
def invalidated_facts(t):
    lost = t.chained.where("id % 6 = 0").select("id", (F.col("recorded_at") + 5).alias("at"), F.lit(0).cast("bigint").alias("by"))
    return facts.state(t.chained, None, None, lost).select("id", "invalidated_at")


@query("SELECT subject::VARCHAR AS subject, count(*) AS n FROM facts WHERE deleted_at IS NULL AND invalidated_at IS NULL GROUP BY subject")
def facts_by_subject(t):
    own = t.facts.where(scope.live_facts()).withColumn("about", F.concat(F.array(F.lit(" ")), "about"))
    return own.select(facts.subject(F.col("about")).alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS a, l_partkey + 1000000 AS b, 'r' || rel AS rel FROM (SELECT l_suppkey, l_partkey, l_linenumber AS rel, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1")
def typed_edges(t):
    odd, far = F.col("l_orderkey") % 2 == 0, F.col("l_partkey") + 1_000_000
    edges = t.lineitem.select(
        F.when(odd, F.col("l_suppkey")).otherwise(far).alias("src"), F.when(odd, far).otherwise(F.col("l_suppkey")).alias("dst"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rel"), F.lit(1.0).alias("weight"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("recorded_at"), F.when(F.col("l_returnflag") == "R", 1).alias("invalidated_at"),
    )
    return graph.typed_edges(edges).select("a", "b", "rel")


@query("SELECT chunk_id, entity, max(weight) AS weight FROM (SELECT chunk_id, CASE WHEN entity_id % 4 = 1 THEN entity_id - 1 ELSE entity_id END AS entity, weight FROM mentions) GROUP BY ALL")
def merged_mentions(t):
    told = t.supplier.where("s_suppkey % 4 = 1").select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.lit("merged").alias("state"))
    kept = t.supplier.where("s_suppkey % 4 = 2").select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.lit("rejected").alias("state"))
    moved = graph.merged(t.mentions, told.union(kept), "entity_id")
    return moved.groupBy("chunk_id", F.col("entity_id").alias("entity")).agg(F.max("weight").alias("weight"))


@query("SELECT doc_id AS chunk_id, key, CASE WHEN contains(lower(text), key) THEN 1e0 ELSE 3e-1 END AS weight FROM documents, (VALUES ('the'), ('und'), ('dans')) v(key)")
def client_mentions(t):
    names = t.spark.createDataFrame([("The",), ("und",), ("Dans",)], "name string")
    bare = t.documents.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), "text")
    given = bare.select(F.col("id").alias("chunk_id")).crossJoin(F.broadcast(names))  # three names
    return graph.mentions(bare, F.col("title"), F.col("text"), given).where("type = 'client'").select("chunk_id", "key", "weight")


@query("""SELECT chunk_id, entity_id, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, entity_id) AS position FROM mentions""")
def passage_entities(t):
    w = Window.partitionBy("chunk_id").orderBy(F.desc("weight"), "entity_id")
    return t.mentions.select("chunk_id", "entity_id", F.row_number().over(w).alias("position"))


@query("SELECT l.chunk_id, l.entity_id FROM mentions l JOIN revisions r ON r.id = l.chunk_id WHERE r.deleted_at IS NULL AND r.superseded_by IS NULL")
def live_mention_graph(t):
    live = t.revisions.where(scope.live_documents()).select(F.col("id").alias("chunk_id"))
    return t.mentions.join(live, "chunk_id", "left_semi").select("chunk_id", "entity_id")


@query("SELECT id, statement, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY recorded_at DESC, id DESC) AS n FROM facts) WHERE n = 1 UNION ALL SELECT -subject, 'none', 0 FROM (SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT subject FROM facts))")
def last_write_wins(t):
    newest = facts.latest(t.facts, ["subject"], [F.desc("recorded_at"), F.desc("id")]).select("subject", "id", "statement", "recorded_at")
    bare = t.customer.select(F.col("c_custkey").alias("subject"), (-F.col("c_custkey")).alias("id"), F.lit("none").alias("statement"), F.lit(0).cast("bigint").alias("recorded_at"))
    return newest.unionByName(facts.insert_absent(bare, newest, ["subject"]).select(*newest.columns)).select("id", "statement", "recorded_at")


# --- logs, classes and sinks -----------------------------------------------------------------------------------------


@query("""SELECT event_type AS tool, len(v) AS calls, v[floor((len(v) - 1) * 50 / 100)::INT + 1] AS p50, v[floor((len(v) - 1) * 95 / 100)::INT + 1] AS p95, v[-1] AS max, errors FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) FILTER (WHERE event_id % 9 = 0) AS errors FROM events GROUP BY event_type)""")
def live_tool_stats(t):
    return logs.tool_stats(t.events.select(F.col("event_type").alias("tool"), (F.col("event_id") % 9 != 0).alias("ok"), F.col("value").alias("latency_ms")))


@query("SELECT event_type AS tool, event_id % 3 AS outcome, count(*) AS calls, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM events GROUP BY ALL")
def labelled_counters(t):
    return t.events.groupBy(F.col("event_type").alias("tool"), (F.col("event_id") % 3).alias("outcome")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT 'ingest' AS source, max(updated_at) AS last FROM docs UNION ALL SELECT 'facts', max(recorded_at) FROM facts UNION ALL SELECT 'none', 0")
def last_writes(t):
    one = lambda name, df, c: df.agg(F.lit(name).alias("source"), F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias("last"))
    return one("ingest", t.docs, "updated_at").union(one("facts", t.facts, "recorded_at")).union(one("none", t.docs.where("id < 0"), "updated_at"))


@query(f"WITH messages AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {_MESSAGE} SELECT id AS turn_id, {_CLASS} AS class FROM full_message")
def error_message_classes(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), X.error_class(_message(F.col("text"))).alias("class"))


_REASONS = ("no embedding model available", "query embedding failed: ", "reranker failed: ", "", "no retrieval arm could run", "no fact matched", "no page matched", "no arm matched", "nothing matched by keyword and ", "nothing")


@query(f"""WITH r AS (SELECT doc_id, {list(_REASONS)}[length(text) % 10 + 1] || text AS m FROM documents)
    SELECT doc_id, CASE WHEN starts_with(m, 'no embedding model') THEN 'no_embedder' WHEN starts_with(m, 'query embedding failed') THEN 'query_embed_failed' WHEN starts_with(m, 'reranker failed') THEN 'reranker_failed' ELSE 'other' END AS degraded,
    CASE WHEN starts_with(m, 'no retrieval arm') THEN 'no_arm' WHEN starts_with(m, 'no fact') THEN 'no_fact' WHEN starts_with(m, 'no page') THEN 'no_page' WHEN starts_with(m, 'no arm matched') OR starts_with(m, 'nothing matched') THEN 'no_match' ELSE 'other' END AS abstained FROM r""")
def reason_classes(t):
    reason = F.concat(F.element_at(F.array(*map(F.lit, _REASONS)), (F.pmod(F.length("text"), F.lit(10)) + 1).cast("int")), F.col("text"))
    return t.documents.select("doc_id", logs.degraded_class(reason).alias("degraded"), logs.abstain_class(reason).alias("abstained"))


@query(r"""WITH u AS (SELECT id, ['memo://index', 'memo://ns/' || namespace || '/index', 'memo://doc/' || id, 'memo://' || tag || '/' || id, namespace || '/' || id, 'memo://doc', 'memo://entity/' || tag, 'memo://ns/' || namespace][length(text) % 8 + 1] AS uri FROM docs)
    SELECT id, CASE WHEN uri = 'memo://index' THEN 'index' WHEN regexp_matches(uri, '^memo://ns/[^/]+/index$') THEN 'ns_index' WHEN regexp_matches(uri, '^memo://[^/]+/.') THEN regexp_extract(uri, '^memo://([^/]+)/', 1) ELSE 'unknown' END AS kind,
    CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS tags FROM u""")
def resource_kinds(t):
    key, ns = F.col("id").cast("string"), F.col("namespace")
    all_ = [F.lit("memo://index"), F.concat(F.lit("memo://ns/"), ns, F.lit("/index")), X.address("doc", key), F.concat(F.lit("memo://"), "tag", F.lit("/"), key), F.concat(ns, F.lit("/"), key), F.lit("memo://doc"), F.concat(F.lit("memo://entity/"), "tag"), F.concat(F.lit("memo://ns/"), ns)]
    uri = F.element_at(F.array(*all_), (F.pmod(F.length("text"), F.lit(8)) + 1).cast("int"))
    return t.docs.select("id", logs.resource_kind(uri).alias("kind"), F.size(compact.page_provenance(F.col("id") % 4 == 0)["tags"]).alias("tags"))


@query("""SELECT '# HELP calls_total Calls by tool.' AS line UNION ALL SELECT '# TYPE calls_total counter' UNION ALL SELECT 'calls_total{tool="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type""")
def prometheus_counters(t):
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    families = n.select(F.lit("calls_total").alias("name"), F.lit("Calls by tool.").alias("help"), F.lit("counter").alias("type"), F.create_map(F.lit("tool"), "event_type").alias("labels"), F.lit("").alias("suffix"), "value")
    return markdown.prometheus_lines(families)


@query("SELECT namespace, count(*) AS docs, '_' || (count(*) - 5) || ' more line(s) omitted to fit 8192 bytes; search or list for the rest._' AS footer FROM docs GROUP BY namespace")
def index_footer(t):
    n = t.docs.groupBy("namespace").agg(F.count(F.lit(1)).alias("docs"))
    return n.select("namespace", "docs", markdown.omitted(F.col("docs") - 5, 8192).alias("footer"))


@query("""SELECT event_id AS ts, '{"query":"' || event_type || '","queries":[]}' AS args, CASE WHEN event_id % 2 = 0 THEN 'keyword' ELSE 'auto' END AS mode FROM events""")
def query_log_rows(t):
    args = F.to_json(F.struct(F.col("event_type").alias("query"), F.array().cast("array<string>").alias("queries")))
    return t.events.select(F.col("event_id").alias("ts"), args.alias("args"), F.when(F.col("event_id") % 2 == 0, "keyword").otherwise("auto").alias("mode"))


# --- evaluation, streams ---------------------------------------------------------------------------------------------


@query(_GATE.format(after="keyword_hits WHERE rank <= 2 AND query_id % 2 = 0").replace("exact_hits WHERE rank <= 10", "exact_hits WHERE rank <= 10"), needs=["keyword_hits"])
def regression_gate(t):
    """The exact search against a keyword search that answers every other request, and that with two results."""
    return _gated(t, _bm25(t, True), _bm25(t, False, 2).where("query_id % 2 = 0"))


@query("SELECT q.vec_id AS query_id, round(avg((v.label = q.label)::INT), 6) AS hit_rate FROM (SELECT query_id AS vec_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS raw FROM embeddings a, embeddings b)) WHERE rank <= 10) h JOIN embeddings q USING (vec_id) JOIN embeddings v ON v.vec_id = h.id GROUP BY q.vec_id")
def label_agreement(t):
    """Of every vector, compared with all; `nearest` takes them in blocks of its size."""
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("mine"))
    other = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return _near(t, asked="true").join(own, "query_id").join(other, "id").groupBy("query_id").agg(R(F.avg((F.col("label") == F.col("mine")).cast("double"))).alias("hit_rate"))


@query("SELECT id FROM (SELECT id, lag(id) OVER (PARTITION BY hash ORDER BY id) AS before FROM (SELECT doc_id AS id, source || hash AS hash FROM hashed JOIN documents USING (doc_id))) WHERE before IS NULL".replace("SELECT id FROM", "SELECT count(*) AS n FROM", 1))
def first_seen_batch(t):
    rows = t.documents.select("doc_id", F.col("source").alias("namespace"), F.col("text").alias("content"))
    return stream.first_seen(rows).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a, b, round(jaccard, 6) AS score FROM (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) AS jaccard FROM k a JOIN k b ON a.id < b.id AND a.digits = b.digits) WHERE jaccard >= 8e-1".replace("SELECT a, b, round", "WITH n AS (SELECT 'k' || p_partkey AS id, regexp_replace(lower(p_name), '[ _-]', '', 'g') AS key FROM part), k AS (SELECT id, regexp_replace(key, '[^0-9]', '', 'g') AS digits, list_distinct(list_transform(range(1, length(key) + 2), lambda i: substr('  ' || key || ' ', i, 3))) AS g FROM n WHERE length(key) >= 5) SELECT a, b, round", 1))
def alike_names(t):
    own = t.part.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), X.entity_key(F.col("p_name")).alias("key"))
    return resolve.alike(own, 6).select("a", "b", "score")
