"""Which rows a query may see: liveness, points in time, versions, trust and the other scope fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TRUST


@dataclass(frozen=True)
class Scope:
    namespaces: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    library: str | None = None
    version: str | None = None
    tags: list[str] = field(default_factory=list)
    date_from: int | None = None
    date_to: int | None = None
    min_trust: str | None = None
    as_of: int | None = None


def live_documents() -> Column:
    return F.col("deleted_at").isNull() & F.col("superseded_by").isNull()


def documents_as_of(ms: int) -> Column:
    """`updated_at` of a superseded revision is when it was superseded; what was forgotten is never seen."""
    return F.col("deleted_at").isNull() & (F.col("created_at") <= ms) & (F.col("superseded_by").isNull() | (F.col("updated_at") > ms))


def version_is(version: str) -> Column:
    return F.col("deleted_at").isNull() & (F.col("version") == version)


def live_facts() -> Column:
    return F.col("deleted_at").isNull() & F.col("invalidated_at").isNull()


def facts_as_of(ms: int) -> Column:
    """Recorded time only; validity is not looked at."""
    return F.col("deleted_at").isNull() & (F.col("recorded_at") <= ms) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > ms))


def trusted(least: str, c: str = "trust") -> Column:
    return F.col(c).isin(*TRUST[TRUST.index(least) :])


def has_tags(tags: list[str], c: str = "tags") -> Column:
    out = F.lit(True)
    for t in tags:
        out = out & F.array_contains(c, t)
    return out


def only(scope: Scope) -> Column:
    """The scope fields proper, without liveness."""
    out = F.lit(True)
    if scope.namespaces:
        out = out & F.col("namespace").isin(scope.namespaces)
    if scope.kinds:
        out = out & F.col("kind").isin(scope.kinds)
    if scope.sources:
        out = out & (F.col("source_id").isin(scope.sources) | F.col("uri").isin(scope.sources))
    if scope.library:
        out = out & (F.col("library") == scope.library)
    if scope.tags:
        out = out & has_tags(scope.tags)
    if scope.date_from is not None:
        out = out & (F.col("updated_at") >= scope.date_from)
    if scope.date_to is not None:
        out = out & (F.col("updated_at") <= scope.date_to)
    if scope.min_trust:
        out = out & trusted(scope.min_trust)
    return out


def documents(scope: Scope) -> Column:
    """A version wins over a point in time."""
    if scope.version:
        seen = version_is(scope.version)
    elif scope.as_of is not None:
        seen = documents_as_of(scope.as_of)
    else:
        seen = live_documents()
    return seen & only(scope)


def facts(scope: Scope) -> Column:
    """Facts know namespaces, trust and time only."""
    seen = facts_as_of(scope.as_of) if scope.as_of is not None else live_facts()
    if scope.namespaces:
        seen = seen & F.col("namespace").isin(scope.namespaces)
    return seen & trusted(scope.min_trust) if scope.min_trust else seen


def pages(scope: Scope) -> Column:
    seen = F.col("deleted_at").isNull()
    return seen & F.col("namespace").isin(scope.namespaces) if scope.namespaces else seen


def counts(docs: DataFrame, scope: Scope) -> DataFrame:
    """One row: documents in scope, hidden by revocation, and below the trust asked for (the last over all documents)."""
    inside = only(scope)
    below = ~trusted(scope.min_trust) & live_documents() if scope.min_trust else F.lit(False)
    return docs.agg(
        F.count_if(documents(scope)).alias("live_docs"), F.count_if(inside & (F.col("deleted_at").isNotNull() | F.col("superseded_by").isNotNull())).alias("by_revocation"), F.count_if(below).alias("by_min_trust")
    )


def describe(scope: Scope) -> str:
    parts = [f"{name}={','.join(values)}" for name, values in (("namespaces", scope.namespaces), ("kinds", scope.kinds)) if values]
    parts += [f"sources={len(scope.sources)}"] if scope.sources else []
    parts += [f"{name}={value}" for name, value in (("library", scope.library), ("version", scope.version)) if value]
    parts += [f"tags={','.join(scope.tags)}"] if scope.tags else []
    parts += ["date range"] if scope.date_from is not None or scope.date_to is not None else []
    parts += [f"min_trust={scope.min_trust}"] if scope.min_trust else []
    return "; ".join(parts) or "all namespaces, live documents"


def hint(scope: Scope) -> str:
    """What to change when nothing was found."""
    if not scope.namespaces:
        return "narrow with scope.namespaces or scope.library; or rephrase with the terms the source uses"
    return "rephrase the query or widen the scope" if scope.version else "narrow with scope.version, or rephrase"
