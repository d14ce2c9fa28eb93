"""A knowledge base in a directory: append-only Parquet events, and everything else derived from them.

Nothing is updated in place. A tool call appends to its tables under one commit, which is there in all of them or in none;
what holds now (or held at a time, or after a commit) is a view. Clocks are passed in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .functions import text as X
from .functions import vectors as V
from .functions.scratch import kept
from .observed import Gauges, Metrics
from .operators import adjacency, chunking, compact, evaluation, facts, graph, index, ingest, logs, lsh, merges, queue as work, resolve, scope as scopes, segments
from .plans import profiles, router, search
from .schemas import TRUST
from .sources import markdown, render
from .storage import Commit, CommitLog

_WRITES = "id string, source_id string, namespace string, uri string, title string, kind string, library string, version string, context string, content string, content_hash string, trust string, origin string, tags array<string>, created_at long, revision int, outcome string, fetched_at long, ttl_s long"
_EVENTS = {
    "writes": _WRITES, "passages": "id long, document_id string, ord int, section_path string, text string, est_tokens int, lang string, context_header string, embed_text string",
    "segments": segments.BLOCKS, "index_stats": segments.STATS, "removals": segments.REMOVALS, "dead": segments.DEAD, "vectors": "id long, model_id string, embedding array<float>", "fact_vectors": schemas.VECTORS, "page_vectors": schemas.VECTORS,
    "mentions": "chunk_id long, key string, name string, type string, weight double, built long", "edges": schemas.EDGES, "merges": schemas.MERGES,
    "tombstones": "uri string, at long, reason string, redact boolean, actor string", "invalidations": "id string, at long, by string, reason string",
    "facts": "id string, namespace string, statement string, about array<string>, valid_from long, valid_to long, recorded_at long, evidence_chunk_id long, trust string, origin string, supersedes string",
    "trusts": "uri string, at long, trust string", "pages": schemas.PAGES, "items": schemas.WORK_ITEMS, "audit": schemas.AUDIT, "queries": schemas.QUERY_LOG, "calls": schemas.CALL_LOG,
    **lsh.tables("names"), "job_events": work.EVENTS, "runs": schemas.INGEST_RUNS, "run_items": schemas.INGEST_ITEMS, "models": schemas.MODELS,
}


def _committed(op: str) -> Callable:
    """All that a method writes becomes one commit, also what methods write that it calls; an error on the way leaves nothing to be seen."""

    def of(method: Callable) -> Callable:
        @wraps(method)
        def call(self, *args, **options):
            with self.committing(op):
                return method(self, *args, **options)

        return call

    return of


class KnowledgeBase:
    """The ten tools as methods. `embed`: a function of a text column that gives vectors; "hash" is the built-in one, None a base without meaning.

    upto: the number of the last commit that is seen; such a view cannot be written to.
    """

    def __init__(self, spark: SparkSession, path: str, model_id: str = "hash", embed="hash", query_prefix: str = "", doc_prefix: str = "", upto: int | None = None) -> None:
        self.spark, self.path, self.model_id = spark, path.rstrip("/"), model_id
        self.embed = V.embedder(V.hash_encoder(64)) if embed == "hash" else embed
        self.query_prefix, self.doc_prefix = query_prefix, doc_prefix
        self.log = CommitLog(spark, self.path, _EVENTS, schemas.VERSION, upto, {"segments": "part", **lsh.partitioned("names")})
        self._open: Commit | None = None
        self.metrics = Metrics()
        self._gauges = Gauges(lambda: self.status().collect())
        self._roots: tuple[tuple[str, ...], DataFrame | None] = (), None
        self._claim()

    # --- storage

    def _claim(self) -> None:
        """The log marks a base. A version later than this code knows is refused, an earlier one is brought up step by step."""
        found = max((e.version for e in self.log.entries()), default=None)
        if found is None and "manifest" in self.log.listed():
            found = json.loads(self.spark.read.text(f"{self.path}/manifest").first().value)["version"]
        if found is None:
            if self.log.upto is None:
                self.log.publish("create", "create", 0, {})
            return
        if found > schemas.VERSION:
            raise ValueError(f"version {found} is newer than {schemas.VERSION}")
        for version in range(found, schemas.VERSION):
            _UPGRADES[version](self)

    def _adopt(self) -> None:
        """Version 1 had no log and other postings: what lies in its tables becomes the first commit, nothing is moved, and the passages are indexed anew."""
        self.log.publish("adopted", "upgrade", 0, {t: files for t in _EVENTS if (files := [f"{t}/{n}" for n in self.log.listed(t) if n.endswith(".parquet")])})
        self._reindexed(self.passages())

    @_committed("index")
    def _reindexed(self, passages: DataFrame) -> None:
        self._index(passages)

    @contextmanager
    def committing(self, op: str) -> Iterator[None]:
        """What is written inside is one commit; inside another, it is part of that."""
        if self._open is not None:
            yield
            return
        with self.log.commit(op) as own:
            self._open = own
            try:
                yield
            finally:
                self._open = None

    def _append(self, table: str, df: DataFrame) -> None:
        if self._open is not None:
            return self._open.append(table, df)
        with self.log.commit("append") as own:
            own.append(table, df)

    def _rows(self, table: str, rows: list[tuple]) -> None:
        self._append(table, self.spark.createDataFrame(rows, _EVENTS[table]))

    def table(self, name: str) -> DataFrame:
        """Committed rows, and inside a call also its own."""
        return self.log.rows(name, [*self.log.paths(name), *(self._open.adds.get(name, []) if self._open else [])])

    def after(self, seq: int) -> KnowledgeBase:
        """The base as it was after a commit."""
        return KnowledgeBase(self.spark, self.path, self.model_id, self.embed, self.query_prefix, self.doc_prefix, upto=seq)

    def commits(self) -> DataFrame:
        """seq, op, tables of every commit, in order."""
        return self.spark.createDataFrame([(e.seq, e.op, sorted(e.adds)) for e in self.log.entries()], "seq long, op string, tables array<string>")

    def optimise(self, now_ms: int = 0) -> list[str]:
        """Tables whose folders were merged; blocks of the index are merged by `merge_index`."""
        return [t for t in _EVENTS if t not in ("segments", "job_events") and self.log.optimise(t, now_ms)]

    def vacuum(self, older_than_ms: int) -> list[str]:
        """Removes what no commit names and stored graphs of earlier states, if last written before a time; gives their paths."""
        gone, now = self.log.vacuum(older_than_ms), self.graph().key
        for key in self.log.listed("_graphs"):
            fs, there = self.log.fs("_graphs", key)
            if key != now and fs.getFileStatus(there).getModificationTime() < older_than_ms:
                fs.delete(there, True)
                gone.append(f"_graphs/{key}")
        return gone

    # --- views

    def documents(self) -> DataFrame:
        """Every revision with when it was superseded and whether it was forgotten."""
        w = Window.partitionBy("source_id").orderBy("revision")
        gone = self.table("tombstones").groupBy(F.col("uri").alias("_uri")).agg(F.min("at").alias("deleted_at"), F.min_by("reason", "at").alias("deleted_reason"), F.max("redact").alias("_redact"))
        trust = self.table("trusts").groupBy(F.col("uri").alias("_t")).agg(F.max_by("trust", "at").alias("_trust"))
        rows = self.table("writes").where("outcome <> 'unchanged'").withColumn("superseded_by", F.lead("id").over(w)).withColumn("updated_at", F.coalesce(F.lead("created_at").over(w), "created_at"))
        rows = rows.join(gone, X.address("doc", F.col("id")) == F.col("_uri"), "left").join(trust, X.address("doc", F.col("id")) == F.col("_t"), "left")
        return rows.withColumn("content", F.when(F.coalesce("_redact", F.lit(False)), "[redacted]").otherwise(F.col("content"))).withColumn("trust", F.coalesce("_trust", "trust")).drop("_uri", "_redact", "_t", "_trust")

    def _kept(self, rows: DataFrame, document: str = "document_id") -> DataFrame:
        """Rows of documents that are not forgotten: passages, vectors, postings and mentions go with their document."""
        gone = self.table("tombstones").where(F.col("uri").startswith(X.ADDRESS + "doc/")).select(F.regexp_extract("uri", "doc/(.+)$", 1).alias("_gone")).distinct()
        return rows.join(gone, rows[document] == gone["_gone"], "left_anti")

    def passages(self) -> DataFrame:
        return self._kept(self.table("passages"))

    def live_passages(self) -> DataFrame:
        live = self.documents().where(scopes.live_documents()).select(F.col("id").alias("document_id"))
        return self.table("passages").join(live, "document_id", "left_semi")

    def facts(self) -> DataFrame:
        by_id = lambda df: df.where(F.col("uri").startswith("memo://fact/")).withColumn("id", F.regexp_extract("uri", "fact/(.+)$", 1))
        own = facts.state(self.table("facts"), by_id(self.table("tombstones")), by_id(self.table("trusts")), self.table("invalidations"))
        return merges.renamed(own.withColumn("subject_entity_id", facts.subject(F.col("about"))), self.roots(), "subject_entity_id")

    def pages(self) -> DataFrame:
        """The latest version of each page; stale, with the reason, once a document it cites was revised or forgotten."""
        last = facts.latest(self.table("pages"), ["namespace", "kind", "subject_id"], [F.desc("built_from_rev"), F.desc("built_at")])
        docs = self.documents()
        retired = docs.where("deleted_at is not null or superseded_by is not null").select(F.col("id").alias("document_id"), F.when(F.col("deleted_at").isNotNull(), "forgotten").otherwise("revised").alias("reason"))
        cited = last.select(F.col("id").alias("page_id"), F.explode("chunk_ids").alias("chunk_id"))
        stale = ingest.stale_pages(cited, self.table("passages"), retired).select(F.col("page_id").alias("_page"), F.col("stale").alias("_stale"), F.col("stale_reason").alias("_reason"))
        gone = self.table("tombstones").where(F.col("uri").startswith("memo://page/")).groupBy(F.regexp_extract("uri", "page/(.+)$", 1).alias("_gone")).agg(F.min("at").alias("_at"), F.min_by("reason", "at").alias("_why"))
        out = last.join(stale, F.col("id") == F.col("_page"), "left").join(gone, F.col("id") == F.col("_gone"), "left")
        return out.withColumns({"stale": F.coalesce("_stale", "stale"), "stale_reason": F.coalesce("_reason", "stale_reason"), "deleted_at": F.col("_at"), "deleted_reason": F.col("_why")}).drop("_page", "_stale", "_reason", "_gone", "_at", "_why")

    def items(self) -> DataFrame:
        return facts.latest(self.table("items"), ["id"], [F.desc(F.coalesce("decided_at", "created_at")), F.desc("state")])

    def decided_merges(self) -> DataFrame:
        """The latest decision on each pair of entities."""
        return facts.latest(self.table("merges"), ["a", "b"], [F.desc("decided_at")])

    def live_mentions(self) -> DataFrame:
        """entity_id, chunk_id, weight, name of passages that are live, as last extracted and after accepted merges."""
        seen = self.live_passages().select(F.col("id").alias("chunk_id"))
        own = self.table("mentions").join(seen, "chunk_id", "left_semi")
        newest = own.groupBy("chunk_id").agg(F.max("built").alias("built"))
        rows = own.join(newest, ["chunk_id", "built"]).where("key <> ''").select(F.col("key").alias("entity_id"), "chunk_id", "weight", "name")
        moved = merges.renamed(rows, self.roots(), "entity_id")
        return moved.groupBy("entity_id", "chunk_id").agg(F.max("weight").alias("weight"), F.max_by("name", "weight").alias("name"))

    def entities(self) -> DataFrame:
        """id, key, canonical of what live passages mention."""
        return self.live_mentions().groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("canonical")).withColumn("key", F.col("id"))

    def aliases(self) -> DataFrame:
        """key, entity_id: names that accepted merges made others' aliases."""
        found = self.roots()
        return self.spark.createDataFrame([], "key string, entity_id string") if found is None else found.select(F.col("id").alias("key"), F.col("root").alias("entity_id"))

    def roots(self) -> DataFrame | None:
        """id, root: what each merged entity has become; None before any merge. Found anew only when decisions have come."""
        now = (*self.log.paths("merges"), *(self._open.adds.get("merges", []) if self._open else []))
        if not now:
            return None
        if self._roots[0] != now:
            self._roots = now, merges.roots(self.decided_merges())
        return self._roots[1]

    def graph(self) -> adjacency.Graph:
        """The stored graph of live mentions; built anew once documents, mentions, merges or what was forgotten have changed."""
        paths = [p for t in ("writes", "passages", "tombstones", "mentions", "merges") for p in self.log.paths(t)]
        key = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
        return adjacency.stored(search.mention_edges(self.live_mentions()), f"{self.path}/_graphs", key)

    def alike(self) -> DataFrame:
        """Pairs of entities with near names: a < b, score. Names that have come since the last call are signed and added; no other is signed again."""
        now = self.entities()
        if self.log.upto is None:
            with self.committing("index names"):
                lsh.add(self.table, self._append, "names", lsh.names(now), resolve.NEAR_NAME, F.expr(lsh.SAME_DIGITS))
        live = now.select(F.col("id").alias("_id"))
        return self.table("names_links").join(live, F.col("a") == F.col("_id"), "left_semi").join(live, F.col("b") == F.col("_id"), "left_semi")

    def relations(self) -> DataFrame:
        """The latest live relation of each pair of entities, after accepted merges."""
        return graph.typed_edges(merges.renamed_edges(self.table("edges"), self.roots()))

    def jobs(self) -> DataFrame:
        """Passages that still lack a vector of this model: id, state (`failed` if an embedding was tried and gave none, else `queued`)."""
        mine = self.table("vectors").where(F.col("model_id") == self.model_id)
        done = mine.where("embedding is not null").select(F.col("id").alias("_done"))
        tried = mine.where("embedding is null").select(F.col("id").alias("_tried")).distinct()
        todo = self.live_passages().join(done, F.col("id") == F.col("_done"), "left_anti").join(tried, F.col("id") == F.col("_tried"), "left")
        return todo.select("id", "embed_text", F.when(F.col("_tried").isNotNull(), "failed").otherwise("queued").alias("state"))

    def queue(self, now_ms: int) -> DataFrame:
        """Passages that lack a vector of this model, as jobs at a time: id, embed_text, state, attempts, until."""
        events = self.log.numbered("job_events").where(F.col("model_id") == self.model_id)
        return work.state(self.jobs().drop("state"), events, now_ms)

    def claim(self, worker: str, now_ms: int, most: int = 1000, lease_ms: int = work.LEASE) -> DataFrame:
        """id, attempt of the jobs that a worker has claimed; its claim lasts for the lease."""
        with self.log.commit(f"claim {worker}", now_ms) as own:
            own.append("job_events", work.claims(self.queue(now_ms), worker, self.model_id, now_ms, most, lease_ms))
        seq = next(e.seq for e in reversed(self.log.entries()) if e.id == own.id)
        return work.held(self.log.numbered("job_events").where(F.col("model_id") == self.model_id), seq)

    def drain(self, worker: str, now_ms: int, most: int = 1000, lease_ms: int = work.LEASE) -> tuple[int, int]:
        """Claims jobs, embeds their passages and commits vectors and outcomes together; how many were done and how many failed."""
        mine = kept(self.claim(worker, now_ms, most, lease_ms), "claimed")
        return self._settled(mine, worker, now_ms)

    def _settled(self, mine: DataFrame, worker: str, now_ms: int) -> tuple[int, int]:
        text = X.role_prefix(F.col("embed_text"), self.doc_prefix)
        tried = kept(self.jobs().drop("state").join(mine, "id").select("id", "attempt", self.embed(text).alias("embedding")), "tried")
        with self.committing("embed"):
            self._append("vectors", tried.where("embedding is not null").select("id", F.lit(self.model_id).alias("model_id"), "embedding"))
            self._append("job_events", work.outcome(tried, worker, self.model_id, now_ms))
        n = {r.ok: r["count"] for r in tried.groupBy(F.col("embedding").isNotNull().alias("ok")).count().collect()}
        return n.get(True, 0), n.get(False, 0)

    def vectors(self) -> DataFrame:
        own = self.table("vectors").where((F.col("model_id") == self.model_id) & F.col("embedding").isNotNull())
        return self._kept(own.join(self.table("passages").select("id", "document_id"), "id")).select("id", "embedding").dropDuplicates(["id"])

    def postings(self) -> DataFrame:
        return segments.postings(self.table("segments")).join(self.table("dead"), "id", "left_anti")

    def index(self) -> segments.Index:
        return segments.Index(*(self.table(t) for t in ("segments", "index_stats", "removals", "dead")))

    def corpus(self, mentions: DataFrame | None = None, wanted: DataFrame | None = None) -> search.Corpus:
        by_model = lambda name: self.table(name).where(F.col("model_id") == self.model_id).select("id", "embedding")
        return search.Corpus(self.passages(), self.documents(), self.vectors(), self.facts(), by_model("fact_vectors"), mentions, wanted, self.index(), self.graph if self.log.upto is None else None)

    # --- tools

    @_committed("ingest")
    def ingest(self, docs: DataFrame, now_ms: int, actor: str = "cli", channel: str = "cli", sizes: chunking.Sizes = chunking.Sizes(), relations: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
        """docs: namespace, uri, content and, as they have them, title, kind, library, version, context, trust, origin, tags, fetched_at, ttl_s. Gives uri, outcome, revision.

        relations: uri, src, dst, rel that a client states of a document; named: uri, name of entities it names.
        """
        asked = {"title": "string", "kind": "string", "library": "string", "version": "string", "context": "string", "trust": "string", "origin": "string", "tags": "array<string>", "fetched_at": "long", "ttl_s": "long"}
        for c, kind in asked.items():
            if c not in docs.columns:
                docs = docs.withColumn(c, F.lit(None).cast(kind))
        docs = ingest.checked(docs.withColumn("kind", F.coalesce("kind", F.lit("doc"))).withColumn("origin", F.coalesce("origin", F.lit("web"))))
        docs = ingest.with_hash(docs).withColumn("title", F.coalesce("title", X.first_heading(F.col("content"))))
        docs = docs.withColumn("trust", facts.capped(F.coalesce("trust", F.lit("agent" if channel == "tool" else "user")), channel)).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        live = facts.latest(self.table("writes"), ["source_id"], [F.desc("revision")]).select("namespace", "uri", "content_hash", "version", "revision")
        decided = ingest.decide(docs.dropDuplicates(["namespace", "uri"]), live)
        source = F.sha2(F.concat_ws("\x1f", "namespace", "uri"), 256).substr(1, 32)
        rows = decided.withColumn("source_id", source).withColumn("id", F.concat("source_id", F.lit("-"), F.col("revision").cast("string"))).withColumn("created_at", F.lit(now_ms).cast("long"))
        self._append("writes", rows)
        new = self._open.read("writes")
        changed = new.where("outcome <> 'unchanged'")
        cut = ingest.passages(changed.select("id", "title", "context", "content"), sizes).withColumn("id", F.xxhash64("document_id", "ord"))
        self._append("passages", cut)
        kept = self._open.read("passages")
        self._index(kept)
        self._embed(kept)
        self._mention(kept, new, now_ms, named)
        if relations is not None:
            self._append("edges", self._edges(relations, new, kept, now_ms))
        self._append("audit", changed.select(*ingest.audit_row(F.lit(now_ms).cast("long"), F.when(F.col("outcome") == "new", "ingest").otherwise("revise"), X.address("doc", F.col("id")), F.struct("outcome", "revision"), F.lit(channel), F.lit(actor))))
        self._run(new, kept, now_ms, actor, channel)
        self._call(now_ms, channel, "ingest", "{}")
        return new.select("namespace", "uri", "id", "outcome", "revision")

    def _index(self, passages: DataFrame) -> None:
        header, text = F.coalesce("context_header", F.lit("")), F.col("text")
        self._append("segments", segments.blocks(index.stored(passages, "id", header, text)))
        self._append("index_stats", segments.stats(passages, "id", header, text))

    def _unindex(self, passages: DataFrame) -> None:
        """Passages that go leave their blocks alone and take themselves out of the statistics."""
        header, text = F.coalesce("context_header", F.lit("")), F.col("text")
        self._append("removals", segments.removals(index.stored(passages, "id", header, text)))
        self._append("index_stats", segments.stats(passages, "id", header, text, -1))
        self._append("dead", passages.select("id"))

    def merge_index(self, now_ms: int = 0) -> int:
        """Blocks of all commits merged, without what was removed; the number of blocks. Readers see the old ones until the new ones are there."""
        own = Commit(self.log, "merge index", now_ms)
        drops = {t: self.log.paths(t) for t in ("segments", "index_stats", "removals", "dead")}
        own.append("segments", segments.blocks(self.postings()))
        own.append("index_stats", self.table("index_stats").groupBy("kind").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")))
        self.log.publish(own.id, own.op, now_ms, own.adds, drops)
        return self.table("segments").count()

    def _embed(self, passages: DataFrame) -> None:
        if self.embed is not None:
            text = X.role_prefix(F.col("embed_text"), self.doc_prefix)
            rows = passages.select("id", F.lit(self.model_id).alias("model_id"), self.embed(text).alias("embedding"))
            counts = {"texts": F.count(F.lit(1)), "failed": F.count_if(F.col("embedding").isNull())}
            self.metrics.write(rows, lambda df: self._append("vectors", df), "embed", counts, model=self.model_id, role="document")

    def _mention(self, passages: DataFrame, docs: DataFrame, now_ms: int, named: DataFrame | None = None) -> None:
        titled = passages.join(docs.select(F.col("id").alias("document_id"), "title", "uri"), "document_id")
        given = None if named is None else titled.join(named, "uri").select(F.col("id").alias("chunk_id"), "name")
        found = graph.mentions(titled, F.col("title"), F.col("text"), given)
        # a passage without mentions leaves an empty one, so that an extraction made anew replaces an older one
        bare = titled.select(F.col("id").alias("chunk_id")).join(found.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.lit("").alias("key"), F.lit("").alias("name"), F.lit("").alias("type"), F.lit(0.0).alias("weight"))
        self._append("mentions", found.select("chunk_id", "key", "name", "type", "weight").unionByName(bare).withColumn("built", F.lit(now_ms).cast("long")))

    def _edges(self, relations: DataFrame, docs: DataFrame, passages: DataFrame, now_ms: int) -> DataFrame:
        first = passages.where("ord = 0").select("document_id", F.col("id").alias("evidence_chunk_id"))
        none = lambda: F.lit(None).cast("long")
        own = relations.join(docs.select("uri", F.col("id").alias("document_id")), "uri").join(first, "document_id", "left")
        return own.select(X.entity_key(F.col("src")).alias("src"), X.entity_key(F.col("dst")).alias("dst"), F.lower(F.trim("rel")).alias("rel"), F.lit(1.0).alias("weight"), none().alias("valid_from"), none().alias("valid_to"), F.lit(now_ms).cast("long").alias("recorded_at"), none().alias("invalidated_at"), "evidence_chunk_id")

    def _run(self, new: DataFrame, kept: DataFrame, now_ms: int, actor: str, channel: str) -> None:
        run = F.lit(hashlib.sha256(f"{channel}\x1f{actor}\x1f{now_ms}".encode()).hexdigest()[:16])
        per = kept.groupBy(F.col("document_id").alias("_d")).agg(F.count(F.lit(1)).cast("int").alias("chunks"))
        ms = F.lit(now_ms).cast("long")
        rows = new.join(per, F.col("id") == F.col("_d"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        done = F.col("chunks") if self.embed is not None else F.lit(0)
        self._append("run_items", rows.select(run.alias("run_id"), F.lit(0).alias("seq"), "title", F.col("title").alias("name"), "uri", "outcome", "revision", "chunks", done.alias("embedded"), (F.col("chunks") - done).alias("pending"), F.octet_length("content").cast("long").alias("bytes"), F.lit(0).cast("long").alias("ms"), F.lit("").alias("error"), ms.alias("ts")))
        total = new.agg(F.count(F.lit(1)).cast("int").alias("total"), F.min("namespace").alias("namespace"))
        self._append("runs", total.select(run.alias("id"), F.lit(channel).alias("channel"), F.lit(actor).alias("actor"), "namespace", ms.alias("started_at"), ms.alias("finished_at"), "total", F.lit("").alias("error")))

    def runs(self, now_ms: int) -> DataFrame:
        """Ingest runs with counters folded from their items, state, percent and rate."""
        return ingest.run_rollup(self.table("run_items"), self.table("runs"), now_ms)

    def _asked(self, queries: Iterable[str | list[str]]) -> tuple[DataFrame, list[list[str]], str]:
        """The request batch as rows (query_id, request_id, query, terms, exact_terms, vector), its texts, and why there are no vectors if so."""
        requests = [[q] if isinstance(q, str) else list(q) for q in queries]
        flat = [(i, r, q) for i, (r, q) in enumerate((r, q) for r, texts in enumerate(requests) for q in texts)]
        text = F.col("query")
        q = self.spark.createDataFrame(flat, "query_id long, request_id long, query string")
        q = index.stem_terms(q.select("*", X.query_terms(text).alias("terms"), X.query_terms(text, True).alias("exact_terms")))
        kind = q.schema
        bare = q.withColumn("vector", F.lit(None).cast("array<float>"))
        if self.embed is None:
            return bare, requests, router.NO_MODEL
        try:
            rows = q.withColumn("vector", self.embed(X.role_prefix(text, self.query_prefix))).collect()  # a request batch
        except Exception as e:
            return bare, requests, f"query embedding failed: {str(e).splitlines()[0][:200]}"
        return self.spark.createDataFrame(rows, T.StructType([*kind.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])), requests, ""

    @_committed("search")
    def search(self, queries: Iterable[str | list[str]], mode: str = "auto", profile: str = "default", scope: scopes.Scope = scopes.Scope(), now_ms: int = 0, granularity: str = "document", **options) -> DataFrame:
        """All requests in one plan; see plans.search.search for columns and options. A request is a query, or a list of a query and its alternates.

        granularity: chunk, document, fact or page. Which arms a request runs follows from that request alone.
        """
        return self._searched(queries, mode, profile, scope, now_ms, granularity, options)[0]

    @_committed("search")
    def answer(self, queries: Iterable[str | list[str]], mode: str = "auto", profile: str = "default", scope: scopes.Scope = scopes.Scope(), now_ms: int = 0, granularity: str = "document", **options) -> dict:
        """Results, and for each request without one the reason and a hint; whether meaning was left out, and why; how many documents the scope has and hides."""
        found, q, chosen, degraded, arms = self._searched(queries, mode, profile, scope, now_ms, granularity, options)
        requests = q.select(F.col("request_id").alias("query_id")).distinct()
        none = search.abstained(requests, found, scope, chosen)
        if granularity in ("fact", "page"):
            none = none.withColumn("reason", F.lit(f"no {granularity} matched"))
        elif not arms:
            none = none.withColumn("reason", F.lit("no retrieval arm could run")).withColumn("hint", F.lit("configure an embedding model or use mode=keyword"))
        elif "semantic" in arms:
            near = index.nearest(self.vectors(), q, chosen.depth).join(q.select("query_id", "request_id"), "query_id")
            below = near.where(F.col("raw") < chosen.semantic_floor).groupBy(F.col("request_id").alias("query_id")).agg(F.countDistinct("id").alias("below"))
            none = search.abstained(requests, found, scope, chosen, below)
        return {"results": found, "abstained": none, "degraded": degraded, "filtered": scopes.counts(self.documents(), scope), "scope": scopes.describe(scope)}

    @staticmethod
    def rendered(answer: dict, form: str = "text", explain: bool = False) -> DataFrame:
        """query_id, text of what `answer` gave: as text, table or json."""
        if form == "text":
            return render.as_text(answer["results"], answer["abstained"], explain, answer["degraded"])
        return render.as_table(answer["results"]) if form == "table" else render.as_json(answer["results"])

    def _searched(self, queries, mode, profile, scope, now_ms, granularity, options):
        chosen = profiles.for_model(profiles.PROFILES[profile], self.model_id)
        q, requests, degraded = self._asked(queries)
        by_model = lambda name: self.table(name).where(F.col("model_id") == self.model_id).select("id", "embedding")
        if granularity in ("fact", "page"):
            first = q.join(q.groupBy("request_id").agg(F.min("query_id").alias("query_id")), ["request_id", "query_id"]).withColumn("query_id", F.col("request_id"))
            vectors = None if degraded else by_model(f"{granularity}_vectors")
            found = search.search_facts(self.facts(), first, vectors, chosen, scope) if granularity == "fact" else search.search_pages(self.pages(), first, vectors, chosen, scope)
            self._log(now_ms, requests, mode, profile, granularity)
            return found, q, chosen, degraded, ["keyword"]
        mentions = self.live_mentions()
        wanted = graph.find_entities(self.entities(), self.aliases(), q.select("query_id", "query")).join(q.select("query_id", "request_id"), "query_id")
        lead = {r.request_id: r.query_id for r in q.groupBy("request_id").agg(F.min("query_id").alias("query_id")).collect()}
        n_entities = {r.query_id: r.n for r in wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a query of the batch
        per = {r: router.arms(mode, texts, chosen, n_entities.get(lead[r], 0), not degraded)[0] for r, texts in enumerate(requests)}
        names = [a for a in ("semantic", "keyword", "exact", "fact", "entity", "graph") if any(a in x for x in per.values())]
        if not names:
            empty = self.spark.createDataFrame([], "query_id long, position int, id long, document_id string")
            return empty, q, chosen, degraded, names
        # structural arms go by a request's first query
        own = [(lead[r] if i == 0 else lead[r] + i, [a for a in x if i == 0 or a not in ("entity", "graph")]) for r, x in per.items() for i in range(len(requests[r]))]
        q = q.join(F.broadcast(self.spark.createDataFrame(own, "query_id long, arms array<string>")), "query_id")  # a request batch
        found = search.search(self.corpus(mentions, wanted.select("query_id", "entity_id")), q, names, chosen, scope, now_ms, per_document=granularity == "document", **options)
        self._log(now_ms, requests, ",".join(names), profile, mode)
        return found, q, chosen, degraded, names

    def _log(self, now_ms: int, requests: list[list[str]], mode: str, profile: str, trace: str) -> None:
        if self.log.upto is not None:  # a view of an earlier state keeps no log
            return
        self._rows("queries", [(now_ms, json.dumps({"query": x[0], "queries": x[1:]}), mode, profile, self.model_id, None, None, None, trace) for x in requests])
        self._call(now_ms, "tool", "search", json.dumps({"query": requests[0][0]} if requests else {}))

    def _call(self, now_ms: int, client: str, tool: str, arguments: str, ok: bool = True, error: str = "") -> None:
        row = self.spark.createDataFrame([(now_ms, client, "tools/call", tool, None, ok, error, None, None, arguments)], _EVENTS["calls"])
        self._append("calls", row.withColumn("args_summary", logs.argument_summary(F.col("tool"), F.col("args_summary"))))

    def read(self, uri: str) -> DataFrame:
        """The record at an address; of what was forgotten, only when and why. `memo://index` and `memo://ns/<namespace>/index` give index lines."""
        rest = uri.removeprefix(X.ADDRESS)
        if rest == uri:
            raise ValueError(f"{uri} is not a memo:// address")
        live = self.documents().where(scopes.live_documents()).withColumn("uri", X.address("doc", F.col("id")))
        if rest == "index":
            return markdown.bounded_index(live, self.facts().where(scopes.live_facts()))
        if rest.startswith("ns/") and rest.endswith("/index"):
            mine = F.col("namespace") == rest[3:-6]
            return markdown.bounded_index(live.where(mine), self.facts().where(scopes.live_facts() & mine))
        kind, _, key = rest.partition("/")
        if not key:
            raise ValueError(f"malformed address {uri}")
        message = facts.tombstone_message(F.col("deleted_at"), F.col("deleted_reason"))
        if kind in ("doc", "source"):
            rows = self.documents().where((F.col("id") == key) if kind == "doc" else (F.col("source_id") == key) & F.col("superseded_by").isNull())
            return rows.select("id", "title", F.when(F.col("deleted_at").isNotNull(), message).otherwise(F.col("content")).alias("content"), "revision", "trust")
        if kind == "chunk":
            own = self.table("passages").where(F.col("id") == int(key))
            near = ingest.neighbours(self.table("passages").join(own.select("document_id"), "document_id", "left_semi")).where(F.col("id") == int(key))
            gone = self.documents().where("deleted_at is not null").select(F.col("id").alias("_d"), message.alias("_message"))
            rows = near.join(gone, F.col("document_id") == F.col("_d"), "left")
            hidden = {c: F.when(F.col("_message").isNull(), F.col(c)) for c in ("before", "after", "context_header", "embed_text")}
            return rows.withColumns({"text": F.coalesce("_message", "text"), **hidden}).drop("_d", "_message")
        if kind == "fact":
            return self.facts().where(F.col("id") == key).withColumn("statement", F.when(F.col("deleted_at").isNotNull(), message).otherwise(F.col("statement")))
        if kind == "page":
            rows = self.pages().where(F.col("id") == key).withColumn("content", F.when(F.col("deleted_at").isNotNull(), message).otherwise(F.col("content")))
            return rows.withColumn("provenance", compact.page_provenance(F.col("stale")))
        if kind == "entity":
            return self.live_mentions().where(F.col("entity_id") == key)
        raise ValueError(f"address must name doc, chunk, source, fact, page or entity: {uri}")

    def list(self, namespace: str | None = None, kind: str | None = None, since_ms: int | None = None, limit: int = 50) -> DataFrame:
        """Live documents, newest first, with their number of passages."""
        return ingest.listing(self.documents().where(scopes.live_documents()), self.passages(), namespace, kind, since_ms, limit)

    def section(self, chunk_id: int) -> DataFrame:
        kept = self.passages()
        own = kept.where(F.col("id") == chunk_id).select("document_id", "section_path")
        return ingest.sections(kept.join(own, ["document_id", "section_path"]))

    def passages_of(self, document_id: str) -> DataFrame:
        return self.passages().where(F.col("document_id") == document_id).orderBy("ord")

    def entities_of(self, chunk_id: int) -> DataFrame:
        return self.live_mentions().where(F.col("chunk_id") == chunk_id).orderBy(F.desc("weight"), "entity_id")

    def history(self, uri: str) -> DataFrame:
        kind, key = uri.removeprefix(X.ADDRESS).split("/", 1)
        if kind == "fact":
            chained = facts.history(self.table("facts"))
            return chained.join(chained.where(F.col("id") == key).select("root"), "root").orderBy("place")
        rows = self.documents()
        return rows.join(rows.where(F.col("id") == key).select("source_id"), "source_id").orderBy("revision").select("id", "revision", "created_at", "superseded_by", F.substring("content", 1, 80).alias("summary"))

    def _guard(self, op: str, uri: str, channel: str) -> None:
        """A channel may act on records up to the trust it may claim; more trusted ones need a human."""
        kind, key = uri.removeprefix(X.ADDRESS).split("/", 1)
        views = {"doc": self.documents, "fact": self.facts, "page": self.pages}
        if kind not in views:
            raise ValueError(f"{op} must name a doc, fact or page: {uri}")
        row = views[kind]().where(F.col("id") == key).select("trust").first()
        if row is None:
            raise LookupError(f"{uri} not found")
        cap = schemas.CHANNEL_CAP.get(channel, TRUST[-1])
        if TRUST.index(row.trust or TRUST[0]) > TRUST.index(cap):
            raise PermissionError(f"{op} on {uri} needs a human: the record is trust={row.trust} and {channel} may act on trust={cap} at most")

    @_committed("remember")
    def remember(self, statement: str, about: list[str], now_ms: int, namespace: str = "default", trust: str = "agent", channel: str = "tool", evidence_chunk_id: int | None = None, supersedes: str | None = None, valid_from: int | None = None, valid_to: int | None = None) -> str:
        if not statement.strip():
            raise ValueError("statement is required")
        if trust not in TRUST:
            raise ValueError(f"trust must be one of {', '.join(TRUST)}")
        if TRUST.index(trust) > TRUST.index(schemas.CHANNEL_CAP.get(channel, TRUST[-1])):
            raise PermissionError(f"needs a human: {channel} may not claim {trust}")
        if evidence_chunk_id is not None and self.passages().where(F.col("id") == evidence_chunk_id).isEmpty():
            raise ValueError("evidence not found")
        if supersedes is not None:
            self._guard("supersede", f"memo://fact/{supersedes}", channel)
        id_ = hashlib.sha256(f"{namespace}\x1f{statement}\x1f{now_ms}".encode()).hexdigest()[:32]
        self._rows("facts", [(id_, namespace, statement, about, valid_from, valid_to, now_ms, evidence_chunk_id, trust, "agent-derived" if channel == "tool" else "user-said", supersedes)])
        self._vector("fact_vectors", id_, statement)
        self._audit(now_ms, "supersede" if supersedes else "remember", f"memo://fact/{id_}", channel)
        self._call(now_ms, channel, "remember", json.dumps({"namespace": namespace, "about": about}))
        return id_

    def _vector(self, table: str, id_: str, text: str) -> None:
        if self.embed is not None:
            row = self.spark.createDataFrame([(id_, self.model_id, text)], "id string, model_id string, text string")
            self._append(table, row.select("id", "model_id", self.embed(X.role_prefix(F.col("text"), self.doc_prefix)).alias("embedding")))

    @_committed("forget")
    def forget(self, uri: str, reason: str, now_ms: int, redact: bool = False, actor: str = "cli", channel: str = "cli") -> bool:
        """Whether something changed: what is forgotten already changes only if it is redacted now."""
        if not reason.strip():
            raise ValueError("reason is required")
        self._guard("forget", uri, channel)
        before = self.table("tombstones").where(F.col("uri") == uri).agg(F.count(F.lit(1)).alias("n"), F.max("redact").alias("r")).first()
        if before.n and (before.r or not redact):
            return False
        self._rows("tombstones", [(uri, now_ms, reason, redact, actor)])
        if uri.startswith(f"{X.ADDRESS}doc/") and not before.n:
            self._unindex(self.table("passages").where(F.col("document_id") == uri.removeprefix(f"{X.ADDRESS}doc/")))
        self._audit(now_ms, "redact" if redact else "forget", uri, channel)
        self._call(now_ms, channel, "forget", json.dumps({"uri": uri, "redact": redact}))
        return True

    @_committed("promote")
    def promote(self, uri: str, trust: str, now_ms: int, channel: str = "cli") -> None:
        if trust not in TRUST:
            raise ValueError(f"trust must be one of {', '.join(TRUST)}")
        if channel == "tool":
            raise PermissionError(f"promote on {uri} needs a human")
        self._rows("trusts", [(uri, now_ms, trust)])
        self._audit(now_ms, "promote", uri, channel)

    def facts_about(self, entity: str) -> DataFrame:
        """Live facts whose subject is an entity, by any of its names."""
        key = self.spark.createDataFrame([(entity,)], "name string").select(X.entity_key(F.col("name")).alias("subject_entity_id"))
        key = merges.renamed(key, self.roots(), "subject_entity_id")
        return self.facts().where(scopes.live_facts()).join(F.broadcast(key), "subject_entity_id")  # one row

    def explore(self, entity: str) -> DataFrame:
        """Entities within two hops by shared passages, with the latest stated relation to the one they were reached from."""
        start = self.spark.createDataFrame([(entity,)], "name string").select(X.entity_key(F.col("name")).alias("entity_id"))
        found = graph.explore(self.live_mentions(), merges.renamed(start, self.roots(), "entity_id"))
        said = self.relations().select(F.col("a").alias("_a"), F.col("b").alias("_b"), "rel")
        return found.join(said, (F.least("entity_id", "via") == F.col("_a")) & (F.greatest("entity_id", "via") == F.col("_b")), "left").drop("_a", "_b")

    def strongest_passages(self, entity: str, most: int = 20) -> DataFrame:
        key = self.spark.createDataFrame([(entity,)], "name string").select(X.entity_key(F.col("name")).alias("entity_id"))
        return self.live_mentions().join(merges.renamed(key, self.roots(), "entity_id"), "entity_id").orderBy(F.desc("weight"), "chunk_id").limit(most)

    @_committed("rebuild")
    def rebuild_mentions(self, now_ms: int) -> int:
        """Mentions of all live passages extracted anew; the number of passages."""
        live = self.live_passages()
        self._mention(live, self.documents(), now_ms)
        return live.count()

    @_committed("merge")
    def decide_merge(self, a: str, b: str, accept: bool, now_ms: int, channel: str = "cli", score: float = 0.0) -> None:
        """Accepted: `b` becomes an alias of `a`, and its mentions and facts count as `a`'s."""
        state = "merged" if accept else "rejected"
        self._rows("merges", [(a, b, score, "names are alike", state, now_ms, now_ms)])
        self._audit(now_ms, f"merge_{state}", f"memo://entity/{b}", channel)

    @_committed("compact")
    def compact(self, now_ms: int) -> DataFrame:
        """Open work: pages to write or refresh, conflicting facts, alike names and near-identical passages, one open item of a kind and subject; new ones are appended."""
        pages = compact.page_items(self.live_mentions(), self.pages()).select("kind", "subject", F.to_json(F.struct("reason", "mentions")).alias("payload"))
        clash = facts.conflicts(self.facts().where(scopes.live_facts())).select(F.lit("conflict").alias("kind"), F.concat_ws("|", "a_id", "b_id").alias("subject"), F.to_json(F.struct("keep_id", "rule")).alias("payload"))
        told = self.decided_merges().select("a", "b")
        alike = self.alike().join(told, ["a", "b"], "left_anti").select(F.lit("merge").alias("kind"), F.concat_ws("|", "a", "b").alias("subject"), F.to_json(F.struct("score")).alias("payload"))
        copies = resolve.duplicates(self.live_passages()).select(F.lit("duplicate").alias("kind"), F.concat_ws("|", "a", "b").alias("subject"), F.to_json(F.struct("jaccard")).alias("payload"))
        new = compact.upsert_items(pages.unionByName(clash).unionByName(alike).unionByName(copies), self.items())
        key = F.substring(F.sha2(F.concat_ws("\x1f", "kind", "subject", F.lit(str(now_ms))), 256), 1, 32)
        none = lambda kind: F.lit(None).cast(kind)
        self._append("items", new.select(key.alias("id"), F.lit("default").alias("namespace"), "kind", "subject", "payload", F.lit("open").alias("state"), F.lit(now_ms).cast("long").alias("created_at"), none("long").alias("decided_at"), none("string").alias("result"), none("string").alias("actor")))
        return self.items().where("state = 'open'")

    @_committed("submit")
    def submit(self, item_id: str, now_ms: int, content: str | None = None, keep: str | None = None, accept: bool | None = None, skip: bool = False, actor: str = "agent", channel: str = "tool", dry_run: bool = False) -> dict:
        """Closes a work item, or with dry_run says what that would do: a page is written with the passages it cites, a conflict invalidates the loser, a merge is accepted or rejected, a duplicate is only recorded."""
        item = self.items().where(F.col("id") == item_id).first()
        if item is None:
            raise LookupError("work item not found")
        if item.state != "open":
            raise ValueError(f"work item {item_id} is already {item.state}")
        out: dict = {"kind": item.kind, "subject": item.subject, "state": "skipped" if skip else "done"}
        if not skip and item.kind in ("page", "stale"):
            out |= self._page(item, content, now_ms, actor, dry_run)
        elif not skip and item.kind == "conflict":
            out |= self._resolved(item, keep, now_ms, actor, channel, dry_run)
        elif not skip and item.kind == "merge":
            if accept is None:
                raise ValueError("a merge item needs accept")
            a, b = item.subject.split("|")
            out["diff"] = f"- {b}\n+ {a} (alias: {b})\n" if accept else "(kept apart)\n"
            if not dry_run:
                self.decide_merge(a, b, accept, now_ms, channel, json.loads(item.payload)["score"])
        if not dry_run:
            self._rows("items", [(item.id, item.namespace, item.kind, item.subject, item.payload, out["state"], item.created_at, now_ms, json.dumps(out), actor)])
            self._call(now_ms, channel, "submit", json.dumps({"item_id": item_id, "keep": keep, "accept": accept, "skip": skip, "dry_run": dry_run}))
        return out

    def _page(self, item, content: str | None, now_ms: int, actor: str, dry_run: bool) -> dict:
        """A page with what it omits of the facts about its subject, what no source backs, and how it differs from the one before."""
        if not (content or "").strip():
            raise ValueError("a page item needs content")
        cited = self.spark.createDataFrame([(content,)], "c string").select(X.cited_chunks(F.col("c"))).first()[0]
        own = self.live_mentions().where(F.col("entity_id") == item.subject).select(F.col("chunk_id").alias("id"))
        sources = self.passages().join(own.union(self.spark.createDataFrame([(c,) for c in cited], "id long")).distinct(), "id")
        must = self.facts().where(scopes.live_facts() & (F.col("subject_entity_id") == item.subject)).select(F.lit(1).alias("page_id"), F.col("id").alias("statement_id"), "statement")
        page = self.spark.createDataFrame([(1, content)], "page_id int, content string")
        backing = sources.select(F.lit(1).alias("page_id"), "text").union(must.select("page_id", "statement"))
        old = self.pages().where(F.col("subject_id") == item.subject).first()
        out = {
            "omitted": sorted(r.statement_id for r in compact.omissions(page, must).collect()), "unsupported": [r.sentence for r in compact.unsupported(page, backing).collect()],
            "diff": compact.diff(old.content if old else "", content), "warnings": [] if cited else ["the page cites no passage; its sources are those of the work item"],
        }
        if not dry_run:
            ids = sorted(r.id for r in sources.select("id").limit(1000).collect()) if not cited else cited
            self._rows("pages", [(f"p-{item.subject}", item.namespace, "entity", item.subject, item.subject, content, now_ms, (old.built_from_rev if old else 0) + 1, False, None, True, "agent", actor, None, None, ids)])
            self._vector("page_vectors", f"p-{item.subject}", f"{item.subject}\n{content}")
            self._audit(now_ms, "page_rebuild" if old else "page_write", f"memo://page/p-{item.subject}", "tool")
        return out

    def _resolved(self, item, keep: str | None, now_ms: int, actor: str, channel: str, dry_run: bool) -> dict:
        """The loser of a conflict is invalidated, never forgotten: it stays readable as of earlier times."""
        rule = json.loads(item.payload)
        winner_id = (keep or rule["keep_id"]).removeprefix("memo://fact/")
        ids = item.subject.split("|")
        if winner_id not in ids:
            raise ValueError(f"keep must name one of {' or '.join(ids)}")
        loser_id = next(x for x in ids if x != winner_id)
        both = {r.id: r for r in self.facts().where(F.col("id").isin(ids)).collect()}
        winner, loser = both[winner_id], both[loser_id]
        out = {"diff": f"- {loser.statement}  ({loser.trust})\n+ {winner.statement}  ({winner.trust})\n", "warnings": [] if winner_id == rule["keep_id"] else [f"this choice goes against the rule: {rule['rule']}"]}
        if dry_run:
            return out
        if TRUST.index(loser.trust) > TRUST.index(winner.trust):
            raise ValueError(f"the losing fact ({loser.trust}) is more trusted than the winner ({winner.trust}); it needs a human")
        self._guard("invalidate", f"memo://fact/{loser_id}", channel)
        self._rows("invalidations", [(loser_id, now_ms, winner_id, f"conflict: {rule['rule']}")])
        self._audit(now_ms, "resolve_conflict", f"memo://fact/{loser_id}", channel)
        return out

    def lint(self, now_ms: int) -> DataFrame:
        entities = self.table("mentions").where("key <> ''").groupBy(F.col("key").alias("id")).agg(F.min("name").alias("canonical"))
        entities = entities.join(self.aliases().select(F.col("key").alias("id")), "id", "left_anti")
        return compact.lint(self.facts(), entities, self.live_mentions(), self.pages(), now_ms)

    @_committed("repair")
    def verify(self, repair: bool = False) -> DataFrame:
        """Integrity problems and their numbers; repair embeds what lacks a vector and indexes what lacks postings first."""
        if repair:
            self.reindex()
            # a base of version 1 may hold documents whose ingest was stopped before their passages were written
            uncut = self.documents().where(scopes.live_documents() & (F.trim("content") != "")).join(self.table("passages").select(F.col("document_id").alias("_d")).distinct(), F.col("id") == F.col("_d"), "left_anti")
            cut = ingest.passages(uncut.select("id", "title", "context", "content")).withColumn("id", F.xxhash64("document_id", "ord"))
            if not uncut.isEmpty():
                self._append("passages", cut)
                kept = self._open.read("passages")
                self._embed(kept)
                self._mention(kept, uncut, 0)
            known = self.table("segments").select(F.explode("ids").alias("id")).distinct()
            words = F.size(X.word_tokens(X.fold(F.col("text")))) > 0
            bare = self.live_passages().where(words).join(known, "id", "left_anti")
            if not bare.isEmpty():
                self._index(bare)
        vectors = self.vectors().select(F.col("id").cast("string").alias("id"), F.lit(self.model_id).alias("model_id"))
        return compact.verify(self.documents(), self.passages(), vectors, self.facts().where("deleted_at is null"), self.model_id)

    def status(self) -> DataFrame:
        """gauge, n: rows of everything, in one small frame."""
        docs, own, jobs, pages, items, merges = self.documents(), self.facts(), self.jobs(), self.pages(), self.items(), self.decided_merges()
        live = scopes.live_documents()
        return logs.status({
            "namespaces": (docs.where(live).select("namespace").distinct(), None), "sources": (docs.select("source_id").distinct(), None), "documents_live": (docs, live), "documents_superseded": (docs, F.col("superseded_by").isNotNull()),
            "documents_forgotten": (docs, F.col("deleted_at").isNotNull()), "passages": (self.passages(), None), "vectors": (self.vectors(), None), "pending": (jobs, F.col("state") == "queued"), "failed": (jobs, F.col("state") == "failed"),
            "facts_live": (own, scopes.live_facts()), "facts_invalidated": (own, F.col("invalidated_at").isNotNull()), "entities": (self.entities(), None), "mentions": (self.live_mentions(), None), "merges_decided": (merges, None),
            "pages": (pages, F.col("deleted_at").isNull()), "pages_stale": (pages, F.col("stale") & F.col("deleted_at").isNull()), "items_open": (items, F.col("state") == "open"), "queries": (self.table("queries"), None),
        })

    def gauges(self, now_ms: int = 0) -> DataFrame:
        """The status as exposition text; the rows are found by one job and kept for the gauges' time to live."""
        now = self.spark.createDataFrame([tuple(r) for r in self._gauges.rows(now_ms)], "gauge string, n long")
        return markdown.prometheus_lines(now.select(F.lit("memo_rows").alias("name"), F.lit("Rows by kind.").alias("help"), F.lit("gauge").alias("type"), F.create_map(F.lit("of"), "gauge").alias("labels"), F.lit("").alias("suffix"), F.col("n").cast("double").alias("value")))

    def export(self, path: str) -> None:
        """Live documents and pages as one text file each, and an index of every namespace."""
        docs = self.documents().where(scopes.live_documents())
        markdown.export_tree(docs, f"{path.rstrip('/')}/documents")
        pages = self.pages().where("deleted_at is null").select("id", "namespace", F.lit("page").alias("kind"), "title", "content", "trust")
        markdown.export_tree(pages, f"{path.rstrip('/')}/pages")
        markdown.export_indexes(docs.withColumn("uri", X.address("doc", F.col("id"))), f"{path.rstrip('/')}/indexes")

    def evaluate(self, queries: DataFrame, relevant: DataFrame, now_ms: int = 0, **options) -> DataFrame:
        """Metrics of each query: searches all in one plan. queries: query_id, query; relevant: query_id, doc_id."""
        rows = sorted((r.query_id, r.query) for r in queries.select("query_id", "query").collect())  # a request batch
        ids = self.spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "n long, query_id " + dict(queries.dtypes)["query_id"])
        found = self.search([q for _, q in rows], now_ms=now_ms, **options)
        results = found.join(ids, found["query_id"] == ids["n"]).select(ids["query_id"], F.col("document_id").alias("doc_id"), F.col("position").alias("rank"))
        return evaluation.metrics(results, relevant)

    def models(self, default: str | None = None) -> DataFrame:
        """Models with vectors here, their counts, and which is the default."""
        counts = self.table("vectors").where("embedding is not null")
        installed = counts.groupBy(F.col("model_id").alias("id")).agg(F.lit(0).cast("long").alias("installed_at"))
        return ingest.models(installed, counts, default)

    def with_model(self, model_id: str, embed, query_prefix: str = "", doc_prefix: str = "") -> KnowledgeBase:
        """The same base searched by another model; `reindex` fills what it lacks."""
        return KnowledgeBase(self.spark, self.path, model_id, embed, query_prefix, doc_prefix)

    @_committed("reindex")
    def reindex(self) -> int:
        """Vectors for live passages that lack one of this model, also those that failed; how many were missing."""
        todo = self.jobs()
        n = todo.count()
        if n:
            self._embed(todo)
        return n

    def _audit(self, now_ms: int, op: str, uri: str, channel: str) -> None:
        self._rows("audit", [(now_ms, channel, channel, op, uri, "{}")])


#: What brings a base of a version to the next.
_UPGRADES: dict[int, Callable[[KnowledgeBase], None]] = {1: KnowledgeBase._adopt}
