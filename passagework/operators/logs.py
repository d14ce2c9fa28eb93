"""Call and query logs: percentiles, histograms, pruning, sessions, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scratch import kept

#: Bucket bounds in milliseconds and in results.
LATENCY_MS = (1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
RESULTS = (0, 1, 2, 5, 10, 20, 50, 100)


def at_floor_index(sorted_values: Column, p: float) -> Column:
    """The value at index floor(p * (n - 1)); null if there is none."""
    hundredths = round(p * 100)
    return F.try_element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) * hundredths / 100) + 1).cast("int"))


#: Distinct values of a group among which a percentile is at last picked, and ranges into which more are cut.
FEW_VALUES, RANGES = 1000, 256


def selected(calls: DataFrame, by: list[str], value: str, hundredths: tuple[int, ...]) -> DataFrame:
    """by, total, p, picked: for each group and percentile the value at index floor(p (n - 1)) of its values in order, exactly.

    The range that holds the index is cut into `RANGES`, its counts say in which of those it is, and so on until few distinct values are
    left; a range is set to its own least and highest value, so each round cuts. Counting is partial in every task, so no group meets in one.
    """
    counted = kept(calls.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "counted")
    about = counted.groupBy(*by).agg(F.sum("n").alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("values"))
    targets = about.withColumn("p", F.explode(F.array(*map(F.lit, hundredths)))).withColumn("index", F.floor((F.col("total") - 1) * F.col("p") / 100))
    targets = kept(targets, "targets")
    columns, own = targets.columns, [F.col(c).alias(f"_{c}") for c in by]

    def met(some: DataFrame) -> DataFrame:
        """Counts in the ranges of some targets: a row or few for each group, so it is they that are broadcast where their number allows."""
        some = some.select(*own, "total", "low", "high", "values", "p", "index")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return counted.join(F.broadcast(some) if some.count() <= 10_000 else some, same & F.col(value).between(F.col("low"), F.col("high"))).drop(*(f"_{c}" for c in by))

    while True:
        wide = targets.where(F.col("values") > FEW_VALUES)
        if wide.isEmpty():
            break
        x, low, high = (F.col(c).cast("double") for c in (value, "low", "high"))
        ranged = met(wide).withColumn("range", F.least(F.lit(RANGES - 1), F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * RANGES)))
        each = ranged.groupBy(*by, "p", "range").agg(F.first("total").alias("total"), F.first("index").alias("index"), F.sum("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("values"))
        upto = F.sum("n").over(Window.partitionBy(*by, "p").orderBy("range"))  # RANGES rows at most
        there = each.withColumn("upto", upto).where((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("n") <= F.col("index")))
        targets = kept(targets.where(F.col("values") <= FEW_VALUES).unionByName(there.withColumn("index", F.col("index") - (F.col("upto") - F.col("n"))).select(*columns)), "targets")
    upto = F.sum("n").over(Window.partitionBy(*by, "p").orderBy(value))  # FEW_VALUES rows at most
    return met(targets).withColumn("upto", upto).where(F.col("upto") > F.col("index")).groupBy(*by, "p").agg(F.first("total").alias("total"), F.min(value).alias("picked"))


def percentiles(calls: DataFrame, by: list[str], value: str) -> DataFrame:
    """calls, p50, p95, max by group."""
    found = selected(calls, by, value, (50, 95, 100))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("picked")))
    return found.groupBy(*by).agg(F.max("total").alias("calls"), at(50).alias("p50"), at(95).alias("p95"), at(100).alias("max"))


def histogram(calls: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = LATENCY_MS) -> DataFrame:
    """Cumulative buckets: le (null for infinity), n; and sum and count of the series. One pass: every row adds to all its buckets in one aggregate."""
    n = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = calls.groupBy(*by).agg(*n, F.count(value).alias("inf"), F.sum(value).alias("sum"))
    each = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("inf").alias("n")))
    return wide.select(*by, F.inline(each), F.col("sum"), F.col("inf").alias("count"))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """The q-quantile of cumulative buckets, linear inside a bucket; the last bound for what lies beyond it."""
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    rows = buckets.select(*by, "le", F.col("n").cast("double").alias("n"), F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.coalesce(F.lag("n").over(w), F.lit(0)).cast("double").alias("below"), F.max("n").over(Window.partitionBy(*by)).cast("double").alias("total"))
    rank = q * F.col("total")
    inside = rows.where((F.col("n") >= rank) & (F.col("total") > 0))
    value = F.when(F.col("le").isNull(), F.col("low")).when(F.col("n") > F.col("below"), F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))).otherwise(F.col("le"))
    first = F.row_number().over(w)
    return inside.withColumn("v", value).withColumn("_n", first).where("_n = 1").select(*by, F.col("v").alias("quantile"))


def prune(log: DataFrame, id_: str, ts: str, cutoff: Column, newest: int) -> DataFrame:
    """What stays: rows not older than the cutoff that are among the newest."""
    kept = log.where(F.col(ts) >= cutoff)
    last = log.select(F.col(id_).alias("_id")).orderBy(F.desc("_id")).limit(newest)
    return kept.join(last, kept[id_] == last["_id"], "left_semi")


def sessions(calls: DataFrame, client: str = "client", ts: str = "ts", idle: str = "30 minutes") -> DataFrame:
    """Sessions of each client: a new one starts after more than `idle` without a call."""
    out = calls.groupBy(client, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.drop("w")


def in_flight(begun: DataFrame, ended: DataFrame) -> DataFrame:
    """Calls that began and have not ended."""
    return begun.join(ended.select(F.col("call_id").alias("_e")), F.col("call_id") == F.col("_e"), "left_anti")


def tail(log: DataFrame, id_: str, n: int) -> DataFrame:
    return log.orderBy(F.desc(id_)).limit(n)


def status(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """gauge, n: rows of each table that meet a condition, as one small frame."""
    out = None
    for name, (df, only) in tables.items():
        row = (df if only is None else df.where(only)).agg(F.lit(name).alias("gauge"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


def query_log_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n_results") == 0).alias("abstained"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency"), F.coalesce(F.avg("n_results"), F.lit(0.0)).alias("mean_results")
    )


def tool_stats(calls: DataFrame, tool: str = "tool", ok: str = "ok", latency: str = "latency_ms") -> DataFrame:
    n = calls.groupBy(tool).agg(F.count_if(~F.col(ok)).alias("errors"))
    return percentiles(calls, [tool], latency).join(n, tool)


#: Arguments that the log may keep, by tool.
KEPT_ARGUMENTS = {
    "search": ["query", "queries", "mode", "scope", "granularity", "response_format", "max_tokens", "as_of", "exclude_ids"],
    "ingest": ["namespace", "source"],
    "read": ["uri", "granularity", "max_tokens"],
    "remember": ["namespace", "about", "evidence_uri", "supersedes", "valid_from", "valid_to"],
    "forget": ["uri", "redact"],
    "promote": ["uri", "to"],
    "explore": ["entity", "namespace", "hops", "as_of"],
    "compact": ["namespace", "kinds", "limit", "lint"],
    "submit": ["item_id", "keep", "accept", "skip", "dry_run"],
    "status": [],
}


def argument_summary(tool: Column, raw: Column) -> Column:
    """JSON of the arguments that may be kept, keys in order, and for an ingest the bytes of the content's JSON; `{}` for what is no object."""
    args = F.from_json(raw, "map<string,variant>")
    allowed = F.create_map(*[x for k, v in KEPT_ARGUMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])[tool]
    kept = F.filter(F.array_sort(F.map_keys(args)), lambda k: F.array_contains(allowed, k))
    parts = F.transform(kept, lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.coalesce(F.to_json(args[k]), F.lit("null"))))
    content = args["content"]
    length = F.when((tool == "ingest") & content.isNotNull(), F.array(F.concat(F.lit('"content_len":'), F.octet_length(F.to_json(content)).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.array_sort(F.concat(parts, length)), ","), F.lit("}")), F.lit("{}"))


def degraded_class(reason: Column) -> Column:
    return (
        F.when(reason.startswith("no embedding model"), "no_embedder").when(reason.startswith("query embedding failed"), "query_embed_failed").when(reason.startswith("reranker failed"), "reranker_failed").otherwise("other")
    )


def abstain_class(reason: Column) -> Column:
    return (
        F.when(reason.startswith("no retrieval arm"), "no_arm").when(reason.startswith("no fact"), "no_fact").when(reason.startswith("no page"), "no_page")
        .when(reason.startswith("no arm matched") | reason.startswith("nothing matched"), "no_match").otherwise("other")
    )


def resource_kind(uri: Column) -> Column:
    return F.coalesce(X.parse_address(uri)["kind"], F.lit("unknown"))
