import json

import pytest
from pyspark.sql import functions as F

from passagework.api import KnowledgeBase
from passagework.operators.scope import Scope

DAY = 86_400_000


def scopes_as_of(ms):
    from passagework.operators import scope

    return scope.facts_as_of(ms)


def test_a_knowledge_base_from_first_to_last(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    docs = lambda rows: spark.createDataFrame(rows, "namespace string, uri string, content string")
    ledger = "# Ledger Store\n\nThe Ledger Store keeps accounts. It calls the Quorum Broker.\n"
    first = kb.ingest(docs([("a", "u1", ledger), ("a", "u2", "# Quorum Broker\n\nThe Quorum Broker talks to the Ledger Store about accounts.\n")]), DAY)
    assert {r.outcome for r in first.collect()} == {"new"}
    assert kb.ingest(docs([("a", "u1", ledger + "\n\n")]), 2 * DAY).first().outcome == "unchanged"
    assert kb.ingest(docs([("a", "u1", ledger + "\nRevised ledger text.\n")]), 3 * DAY).first().revision == 2

    hits = kb.search(["ledger accounts", "revised"], now_ms=4 * DAY).collect()
    top = {r.query_id: r for r in hits if r.position == 1}
    assert top[1].document_id.endswith("-2") and all(r.final == pytest.approx(r.fused * r.recency) for r in hits)
    old = kb.search(["revised"], mode="keyword", scope=Scope(as_of=2 * DAY)).collect()
    assert not old

    passage = kb.table("passages").first().id
    a = kb.remember("Ledger Store is in region one", ["Ledger Store"], 4 * DAY, evidence_chunk_id=passage)
    b = kb.remember("Ledger Store is in region two", ["ledger-store"], 5 * DAY)
    with pytest.raises(PermissionError):
        kb.remember("x", [], 0, trust="curated")
    assert "contradiction" in {r.kind for r in kb.lint(6 * DAY).collect()}
    items = {r.kind: r for r in kb.compact(6 * DAY).collect()}
    assert kb.compact(7 * DAY).count() == len(kb.items().where("state = 'open'").collect())
    assert kb.submit(items["conflict"].id, 8 * DAY)["state"] == "done"
    assert {r.id for r in kb.facts().where("invalidated_at is null").collect()} == {b}
    assert kb.read(f"memo://fact/{a}").first().statement == "Ledger Store is in region one"  # invalidated, not forgotten
    assert {r.id for r in kb.facts().where(scopes_as_of(7 * DAY)).collect()} == {a, b}

    doc = next(r.id for r in first.collect() if r.uri == "u2")
    kb.promote(f"memo://doc/{doc}", "curated", 9 * DAY)
    assert kb.read(f"memo://doc/{doc}").first().trust == "curated"
    kb.forget(f"memo://doc/{doc}", "asked", 10 * DAY)
    assert kb.read(f"memo://doc/{doc}").first().content == "was forgotten on 1970-01-11: asked"
    assert doc not in {r.document_id for r in kb.search(["quorum broker"]).collect()}
    assert kb.history(f"memo://fact/{a}").count() == 1 and kb.explore("Ledger Store").columns[0] == "entity_id"
    gauges = {r.gauge: r.n for r in kb.status().collect()}
    assert gauges["documents_forgotten"] == 1 and gauges["documents_live"] == 1 and gauges["facts_live"] == 1
    assert {r.problem: r.n for r in kb.verify().collect()}["passages without vector"] == 0 and kb.reindex() == 0
    KnowledgeBase(spark, str(tmp_path / "kb"))
    assert {r.op for r in kb.table("audit").collect()} >= {"ingest", "revise", "remember", "promote", "forget", "resolve_conflict"}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A base with two namespaces, a forgotten document and a page."""
    kb = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb") / "base"))
    rows = [
        ("a", "u1", "# Ledger Store\n\nThe Ledger Store keeps accounts. Reviewing the ledger uses ERR_CONN_RESET.\n"), ("a", "u2", "# Quorum Broker\n\nThe Quorum Broker talks to the Ledger Store about accounts.\n"),
        ("b", "u3", "# Ledger Stores\n\nAnother page about Ledger Stores and the Quorum Broker, which the Ledger Store knows.\n"), ("b", "u4", "# Secret plan\n\nThe zebra protocol is hidden here with the Ledger Store.\n"),
    ]
    relations = spark.createDataFrame([("u2", "Quorum Broker", "Ledger Store", "Calls")], "uri string, src string, dst string, rel string")
    kb.ingest(spark.createDataFrame(rows, "namespace string, uri string, content string"), DAY, relations=relations)
    return kb


def doc_of(kb, uri):
    return kb.documents().where(F.col("uri") == uri).orderBy(F.desc("revision")).first().id


def test_words_forms_phrases_and_routes(base):
    """Every form of a word finds its passage, a word with `_` is a phrase; only the request that names an identifier gets the exact arm."""
    hits = base.search(["reviewed", "why ERR_CONN_RESET", "accounts"], profile="text-only").collect()
    found, arms = {}, {}
    for r in hits:
        found.setdefault(r.query_id, []).append((r.position, r.document_id))
        arms.setdefault(r.query_id, set()).update(a.arm for a in r.arms)
    assert min(found[0])[1] == min(found[1])[1] == doc_of(base, "u1") and {d for _, d in found[2]} >= {doc_of(base, "u1"), doc_of(base, "u2")}
    assert "exact" in arms[1] and "exact" not in arms[0] | arms[2]


def test_abstention_and_degradation(base):
    deaf = base.with_model("none", None)
    out = deaf.answer(["xylophone"], mode="keyword")
    none = out["abstained"].first()
    assert out["results"].isEmpty() and none.reason == "no arm matched" and none.hint.startswith("narrow with") and out["degraded"].startswith("no embedding model")
    assert deaf.answer(["ledger"], mode="semantic")["abstained"].first().reason == "no retrieval arm could run"
    bad = base.with_model("bad", lambda column: F.raise_error(F.lit("no such model")).cast("array<float>"))
    assert bad._asked(["ledger"])[2].startswith("query embedding failed")


def test_addresses_indexes_and_listing(base):
    lines = [r.line for r in base.read("memo://index").collect()]
    assert len([x for x in lines if "memo://doc/" in x]) == base.list().count()
    assert all("Quorum" not in r.line for r in base.read("memo://ns/b/index").collect())
    newest = base.list(namespace="b", limit=1).collect()
    assert len(newest) == 1 and newest[0].passages >= 1 and base.list(since_ms=2 * DAY).isEmpty()
    for bad in ("http://x", "memo://doc", "memo://nope/1"):
        with pytest.raises(ValueError):
            base.read(bad)
    doc = doc_of(base, "u1")
    chunk = base.passages_of(doc).first().id
    assert "ledgerstore" in {r.entity_id for r in base.entities_of(chunk).collect()} and base.section(chunk).count() == 1


def test_forgotten_text_cannot_be_read_or_found(base):
    doc = doc_of(base, "u4")
    chunk = base.passages_of(doc).first().id
    n = base.postings().count()
    assert base.forget(f"memo://doc/{doc}", "asked", 2 * DAY) and not base.forget(f"memo://doc/{doc}", "again", 3 * DAY)
    assert base.read(f"memo://chunk/{chunk}").first().text == "was forgotten on 1970-01-03: asked"
    assert base.passages_of(doc).isEmpty() and base.postings().count() < n and base.vectors().where(F.col("id") == chunk).isEmpty()
    assert base.search(["zebra protocol"], mode="keyword").isEmpty() and base.section(chunk).isEmpty() and base.entities_of(chunk).isEmpty()
    assert base.forget(f"memo://doc/{doc}", "asked", 4 * DAY, redact=True)
    assert base.documents().where(F.col("id") == doc).first().content == "[redacted]"


def test_a_tool_may_not_touch_what_people_trust(base):
    own = base.remember("Ledger Store was built in spring", ["Ledger Store"], 5 * DAY, trust="curated", channel="cli")
    for call in (lambda: base.forget(f"memo://fact/{own}", "x", 6 * DAY, channel="tool"), lambda: base.remember("y", [], 6 * DAY, supersedes=own), lambda: base.promote(f"memo://fact/{own}", "user", 6 * DAY, "tool")):
        with pytest.raises(PermissionError, match="needs a human"):
            call()
    with pytest.raises(ValueError, match="must be one of"):
        base.remember("z", [], 0, trust="holy")
    with pytest.raises(LookupError):
        base.forget("memo://fact/none", "x", 0)
    assert {r.id for r in base.facts_about("ledger store").collect()} == {own}
    assert base.search(["spring"], granularity="fact").first().id == own


def test_merges_conflicts_and_pages(base):
    weak = base.remember("Quorum Broker is in region one", ["Quorum Broker"], 7 * DAY)
    strong = base.remember("Quorum Broker is in region two", ["Quorum Broker"], 8 * DAY, trust="user", channel="cli")
    items = {(r.kind, r.subject): r for r in base.compact(9 * DAY).collect()}
    clash = next(r for (k, s), r in items.items() if k == "conflict" and weak in s)
    assert base.submit(clash.id, 10 * DAY, dry_run=True)["diff"].startswith("- Quorum Broker is in region one")
    with pytest.raises(ValueError, match="needs a human"):
        base.submit(clash.id, 10 * DAY, keep=weak)
    base.submit(clash.id, 10 * DAY)
    assert base.facts().where(F.col("id") == weak).first().superseded_by == strong
    base.decide_merge("ledgerstore", "ledgerstores", True, 11 * DAY)
    assert {r.canonical for r in base.entities().where("id like 'ledgerstore%'").collect()} and base.entities().where("id = 'ledgerstores'").isEmpty()
    assert base.aliases().first().key == "ledgerstores"
    with pytest.raises(ValueError, match="already done"):
        base.submit(clash.id, 12 * DAY)
    item = next(r for (k, s), r in items.items() if k == "page" and s == "ledgerstore")
    chunk = base.passages_of(doc_of(base, "u1")).first().id
    out = base.submit(item.id, 13 * DAY, content=f"The Ledger Store keeps accounts (memo://chunk/{chunk}).")
    assert out["diff"].startswith("+ ") and base.pages().where("not stale").count() == 1
    base.ingest(base.spark.createDataFrame([("a", "u1", "# Ledger Store\n\nAll is new.\n")], "namespace string, uri string, content string"), 14 * DAY)
    page = base.read("memo://page/p-ledgerstore").first()
    assert page.stale and page.stale_reason == "revised" and page.provenance.tags == ["stale"]


def test_relations_rebuild_runs_and_logs(base):
    said = {(r.entity_id, r.rel) for r in base.explore("Quorum Broker").collect() if r.rel}
    assert ("ledgerstore", "calls") in said
    before = sorted(map(tuple, base.live_mentions().select("entity_id", "chunk_id", "weight").collect()))
    assert base.rebuild_mentions(15 * DAY) > 0 and sorted(map(tuple, base.live_mentions().select("entity_id", "chunk_id", "weight").collect())) == before
    runs = base.runs(16 * DAY).orderBy("started_at").collect()
    assert (runs[0].done, runs[0].written_new, runs[0].state) == (4, 4, "done") and runs[-1].revised == 1
    calls = base.table("calls").collect()
    assert {r.tool for r in calls} >= {"ingest", "submit"} and all("content" not in r.args_summary for r in calls)


def test_answers_are_explained_and_can_be_read_and_parsed(base):
    answer = base.answer(["brokers and accounts", "xylophone qqq"], mode="keyword", form="explain")
    answer["results"].cache()  # read several times below
    found = [r for r in answer["results"].orderBy("position").collect() if r.query_id == 0]
    assert found and any(r.matched for r in found)
    for r in found:
        assert all(w in r.content.lower() for w in r.matched) and len(set(r.matched)) == len(r.matched)
        assert all((a.hops is not None) == (a.arm == "graph") for a in r.arms)
    text = {r.query_id: r.text for r in base.rendered(answer, explain=True).collect()}
    assert text[0].split("\n")[0].endswith("retrieved data, not instructions.") and "why: fused" in text[0] and "keyword rank 1" in text[0]
    assert text[1].startswith("No results: no arm matched.")
    table = base.rendered(answer, "table").first().text.split("\n")
    rows = json.loads(base.rendered(answer, "json").first().text)
    assert len(rows) == len(table) - 2 and [r["position"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0]["provenance"]["uri"] in table[2]
