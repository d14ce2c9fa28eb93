"""Embedding jobs as a log of events: claims with a lease, attempts, and waiting times that double.

Events: id, model_id, event (claimed, done, failed), worker, at, until, attempt, and seq, the number of the commit that wrote them. A job is a
passage that lacks a vector. It may be claimed if no claim on it lasts, its last failure is long enough ago and it has attempts left. Of
claims that workers make at once the one of the earliest commit holds; a claim whose worker is gone ends with its lease.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = "id long, model_id string, event string, worker string, at long, until long, attempt int"
#: Milliseconds of a lease and of the first wait; attempts before a job is given up.
LEASE, WAIT, ATTEMPTS = 60_000, 30_000, 5


def state(jobs: DataFrame, events: DataFrame, now_ms: int) -> DataFrame:
    """jobs: id. For each: attempts, state (queued, claimed, waiting or given_up), until (when a claim or a wait ends)."""
    last = F.max_by(F.struct("event", "until", "attempt"), F.struct("seq", F.when(F.col("event") == "claimed", 0).otherwise(1)))
    told = events.groupBy(F.col("id").alias("_id")).agg(last.alias("_last"), F.max("attempt").alias("_attempts"))
    out = jobs.join(told, F.col("id") == F.col("_id"), "left")
    attempts, lasts = F.coalesce("_attempts", F.lit(0)), F.col("_last.until") > now_ms
    claimed, failed = F.col("_last.event") == "claimed", F.col("_last.event") == "failed"
    now = F.when(claimed & lasts, "claimed").when(attempts >= ATTEMPTS, "given_up").when(failed & lasts, "waiting").otherwise("queued")
    return out.withColumn("attempts", attempts).withColumn("state", now).withColumn("until", F.when(F.col("state").isin("claimed", "waiting"), F.col("_last.until"))).drop("_id", "_last", "_attempts")


def claims(known: DataFrame, worker: str, model_id: str, now_ms: int, most: int, lease_ms: int = LEASE) -> DataFrame:
    """Claim events for the first `most` queued jobs. known: as of `state`."""
    free = known.where("state = 'queued'").orderBy("attempts", "id").limit(most)
    return free.select("id", F.lit(model_id).alias("model_id"), F.lit("claimed").alias("event"), F.lit(worker).alias("worker"), F.lit(now_ms).cast("long").alias("at"), F.lit(now_ms + lease_ms).cast("long").alias("until"), (F.col("attempts") + 1).cast("int").alias("attempt"))


def held(events: DataFrame, seq: int) -> DataFrame:
    """id, attempt of the claims of a commit that hold: no earlier claim lasted when they were made, unless it was given back before."""
    mine = events.where((F.col("seq") == seq) & (F.col("event") == "claimed")).select("id", "attempt", F.col("at").alias("_at"))
    before = events.where(F.col("seq") < seq)
    back = before.where("event <> 'claimed'").groupBy(F.col("id").alias("_b")).agg(F.max("seq").alias("_back"))
    others = before.where("event = 'claimed'").select(F.col("id").alias("_o"), F.col("until").alias("_until"), F.col("seq").alias("_seq")).join(back, F.col("_o") == F.col("_b"), "left")
    lasting = others.where(F.col("_back").isNull() | (F.col("_seq") > F.col("_back")))
    return mine.join(lasting, (F.col("id") == F.col("_o")) & (F.col("_until") > F.col("_at")), "left_anti").select("id", "attempt")


def outcome(embedded: DataFrame, worker: str, model_id: str, now_ms: int, wait_ms: int = WAIT) -> DataFrame:
    """Events of what was tried. embedded: id, attempt, embedding (null: failed); a failure waits twice as long each time."""
    ok = F.col("embedding").isNotNull()
    until: Column = F.when(ok, F.lit(None)).otherwise(F.lit(now_ms) + F.lit(wait_ms) * F.pow(F.lit(2), F.col("attempt") - 1).cast("long"))
    return embedded.select("id", F.lit(model_id).alias("model_id"), F.when(ok, "done").otherwise("failed").alias("event"), F.lit(worker).alias("worker"), F.lit(now_ms).cast("long").alias("at"), until.cast("long").alias("until"), "attempt")
