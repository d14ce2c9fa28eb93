"""Ingest as plans over append-only tables: revisions are derived, never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import KINDS, ORIGINS
from . import chunking

STALLED_AFTER_MS = 10 * 60 * 1000


def with_hash(incoming: DataFrame) -> DataFrame:
    return incoming.withColumn("content", X.normalise(F.col("content"))).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))


def decide(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome new, revision or unchanged of each incoming document against the live one of its source.

    incoming: namespace, uri, content_hash, version and more; current: namespace, uri, content_hash, version, revision (one row a source).
    """
    was = current.select(F.col("namespace").alias("_ns"), F.col("uri").alias("_uri"), F.col("content_hash").alias("_hash"), F.col("version").alias("_version"), F.col("revision").alias("_revision"))
    both = incoming.join(was, (F.col("namespace") == F.col("_ns")) & (F.col("uri") == F.col("_uri")), "left")
    same = (F.col("_hash") == F.col("content_hash")) & F.col("_version").eqNullSafe(F.col("version"))
    outcome = F.when(F.col("_revision").isNull(), "new").when(same, "unchanged").otherwise("revision")
    revision = F.when(outcome == "new", 1).when(outcome == "unchanged", F.col("_revision")).otherwise(F.col("_revision") + 1)
    return both.withColumn("outcome", outcome).withColumn("revision", revision.cast("int")).drop("_ns", "_uri", "_hash", "_version", "_revision")


def chain(events: DataFrame, source: str, at: str, order: list[str], id_: str, hash_: str | None = None, version: str | None = None) -> DataFrame:
    """Revisions of each source from its writes in order; a write with the hash and version of the one before is none.

    Adds revision, superseded_by and superseded_at (when the next revision came).
    """
    w = Window.partitionBy(source).orderBy(at, *order)
    if hash_:
        same = F.col(hash_).eqNullSafe(F.lag(hash_).over(w))
        if version:
            same = same & F.col(version).eqNullSafe(F.lag(version).over(w))
        events = events.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")
    return events.select("*", F.row_number().over(w).alias("revision"), F.lead(id_).over(w).alias("superseded_by"), F.lead(at).over(w).alias("superseded_at"))


def passages(documents: DataFrame, sizes: chunking.Sizes = chunking.Sizes()) -> DataFrame:
    """documents: id, title, context, content -> passages with context_header and the text that is embedded."""
    out = chunking.chunk(documents.select(F.col("id").alias("document_id"), "title", "context", "content"), F.col("content"), sizes).drop("content")
    header = X.context_header(F.col("title"), F.col("section_path"), F.col("context"))
    return out.withColumn("context_header", header).withColumn("embed_text", X.embed_text(F.col("context_header"), F.col("text"))).drop("title", "context")


def sections(chunks: DataFrame) -> DataFrame:
    """All passages of a section as one text under its heading: document_id, section_path, text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    out = chunks.groupBy("document_id", "section_path").agg(body.alias("text"))
    return out.withColumn("text", F.when(F.col("section_path") == "", F.col("text")).otherwise(F.concat(F.lit("## "), "section_path", F.lit("\n\n"), "text")))


def neighbours(chunks: DataFrame, document: str = "document_id", order: str = "ord", text: str = "text") -> DataFrame:
    w = Window.partitionBy(document).orderBy(order)
    return chunks.select("*", F.lag(text).over(w).alias("before"), F.lead(text).over(w).alias("after"))


def listing(docs: DataFrame, chunks: DataFrame, namespace: str | None = None, kind: str | None = None, since_ms: int | None = None, limit: int = 50) -> DataFrame:
    """Documents, newest first, with their number of passages. docs: id, namespace, kind, updated_at and more."""
    seen = docs
    for column, value in (("namespace", namespace), ("kind", kind)):
        seen = seen if value is None else seen.where(F.col(column) == value)
    seen = seen if since_ms is None else seen.where(F.col("updated_at") >= since_ms)
    first = seen.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
    n = chunks.join(first.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy(F.col("document_id").alias("_d")).agg(F.count(F.lit(1)).alias("passages"))
    return first.join(n, F.col("id") == F.col("_d"), "left").withColumn("passages", F.coalesce("passages", F.lit(0))).drop("_d").orderBy(F.desc("updated_at"), F.desc("id"))


def checked(docs: DataFrame) -> DataFrame:
    """The documents; an error for a namespace that is no name, or a kind or origin that is none of the known."""
    one_of = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} must be one of {', '.join(values)}, not "), F.coalesce(c, F.lit("null")))))
    name = F.when(X.valid_name(F.col("namespace")), F.col("namespace")).otherwise(F.raise_error(F.concat(F.lit("malformed namespace "), F.coalesce("namespace", F.lit("null")))))
    return docs.withColumns({"namespace": name, "kind": one_of("kind", KINDS), "origin": one_of("origin", ORIGINS)})


def stale_pages(page_sources: DataFrame, chunks: DataFrame, retired: DataFrame) -> DataFrame:
    """Pages that cite a passage of a document that was revised or forgotten. retired: document_id, reason."""
    return page_sources.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").join(retired, "document_id").groupBy("page_id").agg(F.lit(True).alias("stale"), F.min("reason").alias("stale_reason"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """Passages that have no vector of a model."""
    have = vectors.where(F.col("model_id") == model_id).select(F.col("id").cast("bigint").alias("have"))
    return chunks.join(have, chunks["id"] == have["have"], "left_anti")


def backfill(chunks: DataFrame, vectors: DataFrame, model_id: str, embed) -> DataFrame:
    """New vector rows for passages without one; at least once and idempotent by (id, model_id)."""
    todo = missing_vectors(chunks, vectors, model_id)
    return todo.select(F.col("id").cast("string").alias("id"), F.lit(model_id).alias("model_id"), embed(X.embed_text(F.col("context_header"), F.col("text"))).alias("embedding"))


def models(models: DataFrame, vectors: DataFrame, default: str | None = None) -> DataFrame:
    """Installed models with vector counts; exactly one is the default, the first installed unless named."""
    counts = vectors.groupBy(F.col("model_id").alias("id")).agg(F.count(F.lit(1)).alias("n_vectors"))
    first = F.row_number().over(Window.orderBy("installed_at", "id")) == 1
    return models.join(counts, "id", "left").withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0))).withColumn("is_default", F.col("id") == default if default else first)


def audit_row(ts: Column, op: str | Column, target: Column, detail: Column, channel: Column, actor: Column | None = None) -> list[Column]:
    return [ts.alias("ts"), F.coalesce(actor, channel).alias("actor") if actor is not None else channel.alias("actor"), channel.alias("channel"), (F.lit(op) if isinstance(op, str) else op).alias("op"), target.alias("target_uri"), F.to_json(detail).alias("detail")]


def run_rollup(items: DataFrame, runs: DataFrame, now_ms: int) -> DataFrame:
    """Counters of each ingest run folded from its items, with derived state, percent and rate."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    folded = items.groupBy(F.col("run_id").alias("id")).agg(
        F.count(F.lit(1)).alias("done"), count("new").alias("written_new"), count("revision").alias("revised"), count("unchanged").alias("unchanged"), count("error").alias("failed"),
        F.sum("chunks").alias("chunks"), F.sum("bytes").alias("bytes"), F.max("ts").alias("updated_at"),
    )
    both = runs.join(folded, "id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    updated = F.coalesce("updated_at", "started_at")
    state = F.when(F.col("finished_at").isNotNull(), F.when(F.col("error") != "", "failed").otherwise("done")).when(F.lit(now_ms) - updated > STALLED_AFTER_MS, "stalled").otherwise("running")
    elapsed = (F.coalesce("finished_at", F.lit(now_ms)) - F.col("started_at")) / 1000.0
    return both.select(
        "*", state.alias("state"), elapsed.alias("elapsed_s"), F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * F.col("done") / F.col("total"))).otherwise(0.0).alias("percent"),
        F.when(elapsed > 0, F.col("done") / elapsed).otherwise(0.0).alias("docs_per_s"),
    )
