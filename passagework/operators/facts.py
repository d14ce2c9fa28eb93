"""Facts and lifecycle as event logs; what holds now is a view over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import intervals
from ..schemas import CHANNEL_CAP, TRUST


def rank_of(trust: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TRUST)), trust)


def capped(trust: Column, channel: str) -> Column:
    """The trust asked for; an error if the channel may not claim it."""
    cap = CHANNEL_CAP.get(channel, TRUST[-1])
    return F.when(rank_of(trust) <= TRUST.index(cap) + 1, trust).otherwise(F.raise_error(F.lit(f"needs a human: {channel} may claim {cap} at most")))


def state(remembered: DataFrame, tombstones: DataFrame | None = None, trusts: DataFrame | None = None, invalidated: DataFrame | None = None) -> DataFrame:
    """Facts as they stand after all events.

    remembered: facts with supersedes (id of an earlier fact or null); tombstones: id, at, reason, redact; trusts: id, at, trust; invalidated: id, at, by.
    """
    later = remembered.where("supersedes is not null").groupBy(F.col("supersedes").alias("_old")).agg(F.min_by(F.struct(F.col("recorded_at").alias("at"), F.col("id").alias("by")), "recorded_at").alias("_next"))
    out = remembered.join(later, F.col("id") == F.col("_old"), "left")
    ended, by = F.col("_next.at"), F.col("_next.by")
    if invalidated is not None:
        lost = invalidated.groupBy(F.col("id").alias("_lost")).agg(F.min_by(F.struct("at", "by"), "at").alias("_loss"))
        out = out.join(lost, F.col("id") == F.col("_lost"), "left")
        ended, by = F.least(ended, F.col("_loss.at")), F.coalesce(by, F.col("_loss.by"))
    out = out.withColumn("invalidated_at", ended).withColumn("superseded_by", by)
    if trusts is not None:
        newest = trusts.groupBy(F.col("id").alias("_t")).agg(F.max_by("trust", "at").alias("_trust"))
        out = out.join(newest, F.col("id") == F.col("_t"), "left").withColumn("trust", F.coalesce("_trust", "trust"))
    if tombstones is not None:
        first = tombstones.groupBy(F.col("id").alias("_g")).agg(F.min("at").alias("_at"), F.min_by("reason", "at").alias("_reason"), F.max("redact").alias("_redact"))
        out = out.join(first, F.col("id") == F.col("_g"), "left").withColumn("deleted_at", F.col("_at")).withColumn("deleted_reason", F.col("_reason"))
        out = out.withColumn("statement", F.when(F.coalesce("_redact", F.lit(False)), "[redacted]").otherwise(F.col("statement")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def subject(about: Column) -> Column:
    """The key of the first name that a fact is about."""
    return X.entity_key(F.try_element_at(F.filter(about, lambda a: F.trim(a) != ""), F.lit(1)))


def tombstone_message(deleted_at_ms: Column, reason: Column) -> Column:
    return F.concat(F.lit("was forgotten on "), F.date_format(F.timestamp_millis(deleted_at_ms), "yyyy-MM-dd"), F.lit(": "), reason)


def listed(facts: DataFrame, seen: Column, limit: int = 100) -> DataFrame:
    return facts.where(seen).orderBy(F.desc("recorded_at"), "id").limit(limit)


def history(facts: DataFrame, previous: str = "supersedes") -> DataFrame:
    """Each fact with the root of its supersession chain and its place in it (0 first). Chains are walked by doubling, so rounds grow with log of their length."""
    spark = facts.sparkSession
    up = facts.select(F.col("id").alias("node"), F.coalesce(previous, "id").alias("root"), F.when(F.col(previous).isNull(), 0).otherwise(1).alias("place"))
    for _ in range(64):
        above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("place").alias("_p"))
        up = up.join(above, up["root"] == above["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"), (F.col("place") + F.coalesce("_p", F.lit(0))).alias("place"), (F.coalesce("_r", "root") != F.col("root")).alias("moved"))
        up = up.checkpoint() if spark.sparkContext.getCheckpointDir() else up.cache()
        if up.where("moved").isEmpty():
            break
    return facts.join(up.drop("moved"), facts["id"] == up["node"]).drop("node")


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs of live facts on one subject whose validity overlaps and whose statements differ, with the one the rule keeps.

    facts: id, about, statement, valid_from, valid_to, recorded_at, trust. The rule: more trust, else recorded later.
    """
    spread = facts.select("id", "statement", "recorded_at", "trust", F.coalesce("valid_from", F.lit(-intervals.FAR)).alias("f"), F.coalesce("valid_to", F.lit(intervals.FAR)).alias("t"), X.entity_key(F.col("statement")).alias("key"), F.explode(F.array_distinct(F.transform("about", X.entity_key))).alias("subject"))
    met = intervals.overlapping(spread, "subject", "id", F.col("f"), F.col("t"))
    swap = (F.col("a.recorded_at") > F.col("b.recorded_at")) | ((F.col("a.recorded_at") == F.col("b.recorded_at")) & (F.col("a.id") > F.col("b.id")))
    pairs = met.where(F.col("a.key") != F.col("b.key")).select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    ra, rb = rank_of(F.col("a.trust")), rank_of(F.col("b.trust"))
    keep_a = (ra > rb) | ((ra == rb) & ~(F.col("b.recorded_at") > F.col("a.recorded_at")))
    out = pairs.groupBy(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).agg(F.min("a.subject").alias("subject"), F.first(F.when(keep_a, F.col("a.id")).otherwise(F.col("b.id"))).alias("keep_id"), F.first(F.when(ra != rb, "more trusted").otherwise("recorded later")).alias("rule"))
    return out


def expired(facts: DataFrame, now_ms: int) -> DataFrame:
    """Live facts past their validity."""
    return facts.where(F.col("deleted_at").isNull() & F.col("invalidated_at").isNull() & (F.col("valid_to") < now_ms))


def trust_summary(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Live documents and facts of every tier, also of those without any."""
    tiers = docs.sparkSession.createDataFrame([(t,) for t in TRUST], "trust string")
    n = lambda df, name: df.groupBy("trust").agg(F.count(F.lit(1)).alias(name))
    return tiers.join(n(docs, "docs"), "trust", "left").join(n(facts, "facts"), "trust", "left").na.fill(0, ["docs", "facts"])


def latest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(new: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """First write wins: only rows whose keys are not there yet."""
    return new.join(there.select(*keys), keys, "left_anti")
