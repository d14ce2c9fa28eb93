"""From ranked lists to an answer: fusion, recency, one passage a document, cut-offs, packing and the explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ARMS = ("semantic", "keyword", "exact", "fact", "entity", "graph")
DAY_MS = 86_400_000.0


def _weight(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("arm")]


def rrf(lists: DataFrame, weights: dict[str, float], k: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion. lists: query_id, arm, id, rank, raw and n_queries (lists of that arm; 1 if absent).

    Gives fused and, for each id, its arms in fixed order with rank, raw, contribution and hops (null but for the graph arm); a contribution is the sum over lists, the rank the best.
    """
    n = F.col("n_queries") if "n_queries" in lists.columns else F.lit(1.0)
    share = lists.withColumn("share", _weight(weights) / n / (F.lit(k) + F.col("rank")))
    by_arm = share.groupBy("query_id", "id", "arm").agg(F.min("rank").alias("rank"), F.min_by("raw", "rank").alias("raw"), F.sum("share").alias("contribution"), _hops(lists))
    return _with_arms(by_arm)


def min_max(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores scaled to 0..1 in each arm (1 if all are equal), weighed and summed; of several lists an arm's best rank counts."""
    best = lists.groupBy("query_id", "id", "arm").agg(F.min("rank").alias("rank"), F.min_by("raw", "rank").alias("raw"), _hops(lists))
    w = Window.partitionBy("query_id", "arm")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    scaled = F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(1.0)
    return _with_arms(best.withColumn("contribution", _weight(weights) * scaled))


def _hops(lists: DataFrame) -> Column:
    return (F.min("hops") if "hops" in lists.columns else F.min(F.lit(None).cast("int"))).alias("hops")


def _with_arms(by_arm: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ARMS)), F.col("arm"))
    arms = F.array_sort(F.collect_list(F.struct(place.alias("place"), "arm", "rank", "raw", "contribution", "hops")))
    return by_arm.groupBy("query_id", "id").agg(arms.alias("arms")).withColumn("fused", F.aggregate("arms", F.lit(0.0), lambda a, x: a + x["contribution"]))


def semantic_floor(fused: DataFrame, floor: float) -> DataFrame:
    """Drops what only the semantic arm found, below the floor."""
    lone = (F.size("arms") == 1) & (F.col("arms")[0]["arm"] == "semantic") & (F.col("arms")[0]["raw"] < floor)
    return fused.where(~lone)


def recency(kind: Column, updated_ms: Column, now_ms: int, kinds: list[str] | None, floor: float, half_life_days: float) -> Column:
    """floor + (1 - floor) * 0.5 ** (age / half-life); 1 for kinds that do not age (None: all age)."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - updated_ms) / DAY_MS)
    value = F.lit(floor) + (1 - floor) * F.pow(F.lit(0.5), age / half_life_days)
    return value if kinds is None else F.when(kind.isin(kinds), value).otherwise(1.0)


def best_passage(rows: DataFrame, document: str = "document_id", score: str = "final") -> DataFrame:
    """The best passage of each document; of equals the one with the smaller id."""
    w = Window.partitionBy("query_id", document).orderBy(F.desc(score), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, score: str = "final") -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id")))


def limit(rows: DataFrame, n: int | None = None, default: int = 10, most: int = 100) -> DataFrame:
    n = default if not n or n < 0 else min(n, most)
    return rows.where(F.col("position") <= n)


def gap_cut(rows: DataFrame, gap: float, min_results: int, score: str = "final") -> DataFrame:
    """Cuts before the first result after `min_results` that falls by more than the gap against the one before."""
    w = Window.partitionBy("query_id").orderBy("position")
    falls = (F.col("position") > min_results) & (F.col(score) < F.lag(score).over(w) * (1 - gap))
    flagged = rows.withColumn("_fall", F.coalesce(falls, F.lit(False)).cast("int"))
    return flagged.withColumn("_cut", F.max("_fall").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_fall", "_cut")


def budget(rows: DataFrame, tokens: Column, most: int, overhead: int = 24) -> DataFrame:
    """A prefix whose costs fit; the first result always stays."""
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("spent", F.sum(tokens + overhead).over(w))
    return spent.where((F.col("position") == 1) | (F.col("spent") <= most))


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """seen: address of passages or documents that the caller has."""
    out = rows.join(seen, X.address("chunk", rows["id"]) == seen["address"], "left_anti")
    return out.join(seen, X.address("doc", out["document_id"]) == seen["address"], "left_anti") if "document_id" in rows.columns else out


def relevance(best_cosine: Column, bands: tuple[float, float, float]) -> Column:
    return F.when(best_cosine.isNull(), "keyword-only").otherwise(X.band(best_cosine, bands))


def stale(fetched_ms: Column, ttl_s: Column, now_ms: int) -> Column:
    return F.coalesce(fetched_ms + ttl_s * 1000 < F.lit(now_ms), F.lit(False))


def rendered(text: Column, before: Column | None = None, after: Column | None = None, form: str = "detailed") -> Column:
    """concise: one line; detailed and explain: the text between one-liners of its neighbours."""
    if form == "concise":
        return X.one_liner(text)
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"[…{name}: "), X.one_liner(c), F.lit("]"))) for name, c in (("before", before), ("after", after)) if c is not None]
    return F.concat_ws("\n", *(parts[:1] + [text] + parts[1:])) if parts else text


def by_trust_within(rows: DataFrame, within: float = 0.1, score: str = "fused") -> DataFrame:
    """Order in which trust decides among near-equal scores: a leader and all within `within` of it form a group, the next best leads the next.

    Groups are found by one pass over each query's scores (bounded by its depth). Adds position.
    """
    trust = F.array_position(F.array(F.lit("agent"), F.lit("user"), F.lit("curated")), F.col("trust"))
    w = Window.partitionBy("query_id")
    scores = F.array_sort(F.collect_list(score).over(w), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    leaders = F.aggregate(scores, F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x < F.element_at(a, -1) * (1 - within)), F.concat(a, F.array(x))).otherwise(a))
    group = F.size(F.filter(leaders, lambda x: x >= F.col(score)))
    out = rows.withColumn("_group", group)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_group", F.desc(trust), F.desc(score), "id"))).drop("_group")
