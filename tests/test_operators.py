import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions import vectors as V
from passagework.operators import compact, evaluation, facts, fusion, graph, index, ingest, logs, resolve, scope, segments
from passagework.plans import profiles, router, search
from passagework.sources import markdown


def test_bm25_prefers_rare_terms(spark):
    texts = spark.createDataFrame([(i, "common words here" + (" rare" if i == 3 else "")) for i in range(10)], "id int, text string")
    q = spark.createDataFrame([(1, ["rare", "common"])], "query_id int, terms array<string>")
    rows = index.bm25(index.tokenised(texts, "id", F.col("text")), q).orderBy("rank").collect()
    assert rows[0].id == 3 and [r.rank for r in rows] == list(range(1, 11)) and [r.id for r in rows[1:4]] == [0, 1, 2]


def test_scope_does_not_change_statistics(spark):
    texts = spark.createDataFrame([(i, f"w{i} shared") for i in range(6)], "id int, text string")
    tokens = index.tokenised(texts, "id", F.col("text"))
    q = spark.createDataFrame([(1, ["w1"])], "query_id int, terms array<string>")
    alone = index.bm25(tokens, q, texts.where("id = 1")).first().raw
    assert alone == index.bm25(tokens, q).first().raw


def test_phrase(spark):
    texts = spark.createDataFrame([(1, "err conn reset"), (2, "conn err reset")], "id int, text string")
    post = index.postings(index.tokenised(texts, "id", F.col("text")))
    assert [r.id for r in index.phrase(post, ["err", "conn", "reset"]).collect()] == [1]


def test_contributions_sum_to_fused(spark):
    lists = spark.createDataFrame([(1, "keyword", 5, 1, 3.0), (1, "semantic", 5, 2, 0.9), (1, "keyword", 6, 2, 2.0), (1, "semantic", 7, 1, 0.95)], "query_id int, arm string, id int, rank int, raw double")
    rows = {r.id: r for r in fusion.rrf(lists, {"keyword": 0.5, "semantic": 0.5}).collect()}
    assert rows[5].fused == pytest.approx(0.5 / 61 + 0.5 / 62) and [a.arm for a in rows[5].arms] == ["semantic", "keyword"]
    assert all(r.fused == pytest.approx(sum(a.contribution for a in r.arms)) for r in rows.values())
    scaled = {r.id: r.fused for r in fusion.min_max(lists, {"keyword": 0.5, "semantic": 0.5}).collect()}
    assert scaled == {5: 0.5, 6: 0.0, 7: 0.5}


def test_cutoffs(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.9, 0.8, 0.2, 0.19])], "query_id int, id int, final double")
    ranked = fusion.numbered(rows)
    assert fusion.gap_cut(ranked, 0.5, 3).count() == 3
    assert fusion.gap_cut(ranked, 0.5, 4).count() == 5
    assert fusion.budget(ranked, F.lit(100), 250).count() == 2
    assert fusion.budget(ranked, F.lit(100), 10).count() == 1
    assert fusion.limit(ranked, 1000).count() == 5


def test_trust_decides_near_ties(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, "agent"), (1, 2, 0.95, "curated"), (1, 3, 0.5, "curated")], "query_id int, id int, fused double, trust string")
    assert [r.id for r in fusion.by_trust_within(rows).orderBy("position").collect()] == [2, 1, 3]


def test_scope_as_of_and_version(spark):
    rows = spark.createDataFrame([("a", 10, 20, None, "b", "1"), ("b", 20, 20, None, None, "2"), ("c", 5, 5, 30, None, "1")], "id string, created_at long, updated_at long, deleted_at long, superseded_by string, version string")
    seen = lambda s: [r.id for r in rows.where(scope.documents(s)).orderBy("id").collect()]
    assert seen(scope.Scope()) == ["b"]
    assert seen(scope.Scope(as_of=15)) == ["a"]
    assert seen(scope.Scope(version="1")) == ["a"]


def test_ingest_is_idempotent(spark):
    docs = ingest.with_hash(spark.createDataFrame([("n", "u", "x \r\n", None)], "namespace string, uri string, content string, version string"))
    current = docs.select("namespace", "uri", "content_hash", "version", F.lit(1).alias("revision"))
    assert ingest.decide(docs, current).first().outcome == "unchanged"
    assert ingest.decide(docs, current.withColumn("version", F.lit("2"))).first().revision == 2
    assert ingest.decide(docs, current.limit(0)).first().outcome == "new"


def test_chain_skips_repeats(spark):
    events = spark.createDataFrame([("s", 1, "a", "h1"), ("s", 2, "b", "h1"), ("s", 3, "c", "h2")], "src string, at long, id string, hash string")
    rows = ingest.chain(events, "src", "at", [], "id", "hash").orderBy("at").collect()
    assert [(r.id, r.revision, r.superseded_by) for r in rows] == [("a", 1, "c"), ("c", 2, None)]


def test_facts(spark):
    rows = spark.createDataFrame([("a", ["X"], "one", 0, 10, 1, "user", None), ("b", ["x"], "two", 5, None, 2, "agent", None), ("c", ["x"], "three", 20, None, 3, "user", "a")], "id string, about array<string>, statement string, valid_from long, valid_to long, recorded_at long, trust string, supersedes string")
    state = {r.id: r for r in facts.state(rows, spark.createDataFrame([("b", 9, "why", True)], "id string, at long, reason string, redact boolean")).collect()}
    assert state["a"].superseded_by == "c" and state["a"].invalidated_at == 3 and state["b"].statement == "[redacted]"
    clash = facts.conflicts(rows).collect()
    assert {(r.a_id, r.b_id, r.keep_id) for r in clash} == {("a", "b", "a"), ("b", "c", "c")}
    assert {(r.id, r.root, r.place) for r in facts.history(rows).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "a", 1)}
    with pytest.raises(Exception, match="needs a human"):
        rows.select(facts.capped(F.lit("curated"), "tool")).collect()


def test_extract(spark):
    text = "# Setup guide\n\nUse `Client.Connect` with the Quorum Broker. ERR_CONN_RESET is 1.7 bad. The Quorum Broker again. Monday came; Broker `a b c d` and `do it(x)` `Foo Bar` stay."
    rows = spark.createDataFrame([(1, "Ledger Store", text), (2, None, None), (3, "", "lower only"), (4, "The", "Ledger. store Ledger")], "id long, title string, text string")
    found = {(r.chunk_id, r.name): (r.type, r.weight) for r in graph.extracted(rows, F.col("title"), F.col("text")).collect()}
    assert found[1, "Ledger Store"] == ("heading", 1.0) and found[1, "Setup guide"][1] == 0.9
    assert found[1, "Client.Connect"] == ("identifier", 0.8) and found[1, "ERR_CONN_RESET"] == ("identifier", 0.6)
    assert found[1, "Quorum Broker"] == ("name", 0.5) and (1, "1.7") not in found and (1, "Broker") not in found and found[1, "Foo Bar"][1] == 0.6
    assert not [k for k in found if k[0] in (2, 3)] and [k[1] for k in found if k[0] == 4] == ["Ledger"]


def test_pagerank_hub_cap_loses_mass(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 0, 1.0), (3, 1, 1.0), (3, 2, 1.0), (3, 4, 1.0)], "a long, b long, weight double")
    seeds = spark.createDataFrame([(0,)], "seed long")
    whole = graph.pagerank(edges, seeds, rounds=6, hub_cap=100).agg(F.sum("mass")).first()[0]
    capped = graph.pagerank(edges, seeds, rounds=6, hub_cap=2).agg(F.sum("mass")).first()[0]
    assert whole == pytest.approx(1.0) and capped < whole


def test_resolution(spark):
    entities = spark.createDataFrame([("e1", "pipelinescheduler"), ("e2", "node12")], "id string, key string")
    names = spark.createDataFrame([("Pipeline Scheduler",), ("Pipeline Schedulers",), ("Node 13",), ("Quorum",)], "name string")
    rows = {r.name: (r.how, r.entity_id) for r in resolve.resolve(names, entities).collect()}
    assert rows["Pipeline Scheduler"] == ("same", "e1") and rows["Pipeline Schedulers"] == ("near", "e1") and rows["Node 13"][0] == "new" and rows["Quorum"][0] == "new"


def test_fnv(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    rows = spark.createDataFrame([("abc",), ("é  x",), ("",)], "s string").select("s", resolve.fnv32(F.col("s")).alias("h")).collect()
    assert all(r.h == fnv(r.s) for r in rows)


def test_duplicates(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, 1, " ".join(words)), (2, 2, " ".join(words[:-2] + ["x", "y"])), (3, 3, " ".join(reversed(words))), (4, 1, " ".join(words))]
    pairs = resolve.duplicates(spark.createDataFrame(rows, "id long, document_id long, text string")).collect()
    assert {(r.a, r.b) for r in pairs} == {(1, 2), (2, 4)} and all(r.jaccard >= 0.75 for r in pairs)


def test_diff_and_checks(spark):
    assert compact.diff("a\nb\nc", "a\nx\nc") == "  a\n- b\n+ x\n  c\n" and compact.diff("", "a\n") == "+ a\n"
    pages = spark.createDataFrame([(1, "Ledgers balance accounts daily.")], "page_id int, content string")
    must = spark.createDataFrame([(1, 1, "ledger balances account"), (1, 2, "rockets launch yearly")], "page_id int, statement_id int, statement string")
    assert [r.statement_id for r in compact.omissions(pages, must).collect()] == [2]


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 1)], "query_id int, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c")], "query_id int, doc_id string")
    rows = {r.query_id: r for r in evaluation.metrics(results, relevant).collect()}
    assert rows[1].recall_at_1 == 0 and rows[1].recall_at_5 == 0.5 and rows[1].mrr == 0.5
    assert rows[1].ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3))) and rows[2].ndcg == 0
    assert evaluation.mean_rank(results, relevant).first().mean_rank == 6.5
    gate = evaluation.paired_gate(evaluation.metrics(results, relevant), evaluation.metrics(results.where("rank = 1"), relevant))
    assert {r.reason for r in gate.collect()} == {"hit lost", "ndcg drop", "mean ndcg drop"}


def test_percentiles_by_floor_index(spark):
    rows = spark.createDataFrame([("t", float(i)) for i in range(10)], "tool string, v double")
    r = logs.percentiles(rows, ["tool"], "v").first()
    assert (r.calls, r.p50, r.p95, r.max) == (10, 4.0, 8.0, 9.0)


def test_argument_summary_keeps_the_allowed(spark):
    calls = [("search", json.dumps({"query": "q", "max_tokens": 5, "scope": {"kinds": ["doc"]}, "secret": "x", "content": "abc"})), ("search", "nope"), ("ingest", json.dumps({"namespace": "n", "content": "abc"})), ("status", "{}")]
    rows = [r[0] for r in spark.createDataFrame(calls, "tool string, raw string").select(logs.argument_summary(F.col("tool"), F.col("raw"))).collect()]
    assert rows == ['{"max_tokens":5,"query":"q","scope":{"kinds":["doc"]}}', "{}", '{"content_len":5,"namespace":"n"}', "{}"]


def test_stems_phrases_and_folding(spark):
    """What one form of a word finds, all its forms do; a word with `_` is a phrase; accents make no difference."""
    texts = ["Reviewing the change before release", "a review of the change", "reviewers met in a café", "err then conn and reset", "it says ERR_CONN_RESET here", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = index.tokenised(docs, "id", F.col("text"))
    asked = spark.createDataFrame([(1, "reviewed"), (2, "ERR_CONN_RESET"), (3, "CAFE"), (4, "cafés")], "query_id long, q string")
    asked = index.stem_terms(asked.select("query_id", X.query_terms(F.col("q")).alias("terms")))
    stored = segments.blocks(index.stored(docs, "id", F.lit(""), F.col("text")))
    none = [spark.createDataFrame([], kind) for kind in (segments.REMOVALS, segments.DEAD)]
    there = segments.Index(stored, segments.stats(docs, "id", F.lit(""), F.col("text")), *none)
    ways = [index.bm25(tokens, asked, stems=True), segments.search(there, "stem", asked)]
    found = [{(r.query_id, r.id): (r.raw, r.rank) for r in w.collect()} for w in ways]
    assert found[0] == found[1] and set(found[0]) == {(1, 0), (1, 1), (1, 2), (2, 4), (3, 2), (4, 2)}
    exact = index.bm25(index.tokenised(docs, "id", F.col("text"), True), spark.createDataFrame([(1, ["err_conn_reset"])], "query_id long, terms array<string>")).collect()
    assert [r.id for r in exact] == [4]


def test_batches_do_not_change_results(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "id long, embedding array<float>")
    queries = vectors.where("id < 9").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, index.nearest(vectors, queries, 5).collect()))
    was, index.FEW_QUERIES = index.FEW_QUERIES, 5
    try:
        assert sorted(map(tuple, index.nearest(vectors, queries, 5).collect())) == whole
    finally:
        index.FEW_QUERIES = was


def test_texts_are_read_for_results_only(spark):
    """The plan of a search has no window over passages and joins texts after the cut."""
    passages = spark.createDataFrame([(i, i // 3, i % 3, f"text {i}", 5, "") for i in range(9)], "id long, document_id long, ord int, text string, est_tokens int, context_header string")
    rows = spark.createDataFrame([(1, 1, 0), (2, 0, 2)], "query_id long, document_id long, ord int")
    got = {r.query_id: (r.before, r.text, r.after) for r in search.with_texts(passages, rows).collect()}
    assert got == {1: (None, "text 3", "text 4"), 2: ("text 1", "text 2", None)}


def test_profiles_and_routes():
    assert router.arms("auto", ["plain words"], profiles.PROFILES["default"])[0] == ["semantic", "keyword", "fact"]
    assert router.arms("auto", ["see ERR_CONN_RESET"], profiles.PROFILES["default"], 2)[0] == ["semantic", "keyword", "exact", "fact", "entity", "graph"]
    assert router.arms("hybrid", ["x"], profiles.PROFILES["keyword-only"])[0] == ["keyword"]
    assert "semantic" not in router.arms("auto", ["x"], profiles.PROFILES["default"], has_vectors=False)[0]
    assert profiles.with_overrides('{"default": {"gap": 0.9}}')["default"].gap == 0.9
    with pytest.raises(ValueError):
        profiles.with_overrides('{"default": {"nope": 1}}')
    assert profiles.for_model(profiles.PROFILES["default"], "granite").semantic_floor == 0.65


def test_vectors(spark):
    v = V.hash_embed("alpha beta alpha")
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-5) and np.array_equal(v, V.hash_embed("Beta, alpha ALPHA"))
    assert V.hash_embed("alpha") @ V.hash_embed("alpha gamma") > V.hash_embed("alpha") @ V.hash_embed("delta gamma")
    assert np.array_equal(V.decode_vector(V.encode_vector(v)), v)
    enc = V.StaticEncoder(np.eye(4, dtype=np.float32), {"un": 0, "##do": 1, "[UNK]": 2})
    assert enc.ids("undo zzz") == [0, 1, 2]
    rows = spark.createDataFrame([("a b",), (None,)], "t string").select(V.embedder(V.hash_encoder(8))("t").alias("e")).collect()
    assert len(rows[0].e) == 8 and sum(x * x for x in rows[1].e) == 0


def test_search_end_to_end(spark):
    docs = spark.createDataFrame([(i, "n", "doc", t, f"u{i}", "user", 0, None, None, None, []) for i, t in enumerate(["alpha", "beta", "gamma"])], "id long, namespace string, kind string, title string, uri string, trust string, updated_at long, deleted_at long, superseded_by string, version string, tags array<string>").withColumn("created_at", F.lit(0))
    passages = spark.createDataFrame([(10, 0, 0, "ledger keeps accounts", 5, ""), (11, 1, 0, "quorum broker talks", 5, ""), (12, 2, 0, "nothing here", 5, "")], "id long, document_id long, ord int, text string, est_tokens int, context_header string")
    corpus = search.Corpus(passages, docs)
    q = spark.createDataFrame([(1, "ledger accounts", ["ledger", "accounts"], ["ledger"])], "query_id int, query string, terms array<string>, exact_terms array<string>")
    r = search.search(corpus, q, ["keyword", "exact"]).first()
    assert r.id == 10 and r.final == pytest.approx(r.fused * r.recency) and r.band == "keyword-only" and r.fused == pytest.approx(sum(a.contribution for a in r.arms))


def test_markdown_tree_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X\n\nbody\n")
    (tmp_path / "a" / ".hidden.md").write_text("no")
    (tmp_path / "a" / "_index.md").write_text("no")
    (tmp_path / "a" / "m.go").write_text("package m\n")
    assert [r.name for r in markdown.read_tree(spark, str(tmp_path)).collect()] == ["x.md"]
    code = {r.name: r.content for r in markdown.read_tree(spark, str(tmp_path), "code").collect()}
    assert code["m.go"] == "```go\npackage m\n```\n"
    docs = spark.createDataFrame([("id1", "ns", "doc", 'He said: "hi"', "line one\n")], "id string, namespace string, kind string, title string, content string")
    markdown.export_tree(docs, str(tmp_path / "out"))
    (file,) = [p for p in (tmp_path / "out").rglob("part-*")]
    assert file.parent.name == "file=he-said-hi-id1.md" and file.read_text().startswith("---\nid: id1\n") and file.read_text().endswith("\n---\n\nline one\n")
    back = spark.createDataFrame([(file.read_text(),)], "c string").select(F.inline(F.array(X.front_matter(F.col("c"))))).first()
    assert back.body == "line one\n" and back.meta["id"] == "id1" and back.meta["kind"] == "doc"


def test_prometheus(spark):
    rows = spark.createDataFrame([("c", "Help.", "counter", {"t": 'a"b'}, "", 2.0)], "name string, help string, type string, labels map<string,string>, suffix string, value double")
    assert [r.line for r in markdown.prometheus_lines(rows).collect()] == ["# HELP c Help.", "# TYPE c counter", 'c{t="a\\"b"} 2']
