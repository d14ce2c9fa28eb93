"""Retrieval quality over whole batches: one plan for all queries.

results: query_id, doc_id, rank (from 1); relevant: query_id, doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes by which passages are looked up, and bytes of texts that are looked at together.
WINDOW, LOOK = 8, 1 << 22


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id of all texts that contain a passage. texts: doc_id, text; passages, the stated side: query_id, passage.

    Every place of a text is looked up once among one window of each passage, whatever their number; where a window stands the whole passage is compared.
    """
    key, id_ = dict(passages.dtypes)["query_id"], dict(texts.dtypes)["doc_id"]
    asked = passages.where("passage is not null").select("query_id", F.col("passage").cast("binary").alias("passage")).toArrow()
    return texts.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_containing(asked), f"query_id {key}, doc_id {id_}")


def _slot(windows: np.ndarray) -> np.ndarray:
    return (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def _containing(asked: pa.Table):
    passages = asked["passage"].to_pylist()
    short = [j for j, p in enumerate(passages) if len(p) < WINDOW]
    long_: dict[int, list[tuple[int, int]]] = {}  # window: passage and where in it
    for j, p in enumerate(passages):
        if len(p) >= WINDOW:
            at = max(range(len(p) - WINDOW + 1), key=lambda i: len(set(p[i : i + WINDOW])))
            long_.setdefault(int.from_bytes(p[at : at + WINDOW], "little"), []).append((j, at))

    def run(batches):
        query_ids = asked["query_id"].combine_chunks()
        keys = np.array(sorted(long_), np.uint64)
        marked = np.zeros(1 << 18, bool)
        marked[_slot(keys)] = True
        for batch in batches:
            each = batch.column(1).to_pylist()
            ends, whole = np.cumsum([len(x) for x in each], dtype=np.int64), b"".join(each)
            found = {(j, i) for j in short for i, x in enumerate(each) if passages[j] in x}
            for start in range(0, max(0, len(whole) - WINDOW + 1), LOOK):
                for shift in range(WINDOW):
                    n = (min(LOOK + WINDOW, len(whole) - start) - shift) // WINDOW
                    windows = np.frombuffer(whole, "<u8", n, start + shift) if n > 0 else keys[:0]
                    near = np.flatnonzero(marked[_slot(windows)])
                    near = near[np.isin(windows[near], keys)]
                    for place, w in zip((near * WINDOW + start + shift).tolist(), windows[near].tolist()):
                        i = int(np.searchsorted(ends, place, "right"))
                        low = int(ends[i - 1]) if i else 0
                        for j, at in long_[w]:
                            if place - at >= low and place - at + len(passages[j]) <= ends[i] and whole.startswith(passages[j], place - at):
                                found.add((j, i))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array([j for j, _ in pairs], pa.int64())), batch.column(0).take(pa.array([i for _, i in pairs], pa.int64()))], ["query_id", "doc_id"])

    return run


def metrics(results: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), k: int = 10) -> DataFrame:
    """recall_at_*, mrr, ndcg, n_relevant, n_results of each query in either frame. Queries without a right answer have 0 and are left out of means."""
    best = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = relevant.distinct().join(best, ["query_id", "doc_id"], "left")
    found = [F.count_if(F.col("rank") <= c).alias(f"_at_{c}") for c in cutoffs]
    gain = F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), *found, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), gain.alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    n = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    both = per.join(n, "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        *(zero(F.col(f"_at_{c}") / F.col("n_relevant")).alias(f"recall_at_{c}") for c in cutoffs), zero(F.col("mrr")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def mean_rank(results: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """Mean rank of the wanted documents; one that is absent has rank max(k, results) + 1."""
    best = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    n = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = wanted.distinct().join(best, ["query_id", "doc_id"], "left").join(n, "query_id", "left")
    miss = F.greatest(F.lit(k), F.coalesce("n", F.lit(0))) + 1
    return rows.groupBy("query_id").agg(F.avg(F.coalesce("rank", miss).cast("double")).alias("mean_rank"))


def category_means(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """Means by category and overall (null category), over queries that have a right answer; and the share of the others that were answered with nothing."""
    answerable = F.col("n_relevant") > 0
    means = [F.avg(F.when(answerable, F.col(c))).alias(c) for c in columns]
    rest = F.when(~answerable, (F.col("n_results") == 0).cast("double"))
    return per_query.rollup("category").agg(F.count_if(answerable).alias("queries"), *means, F.avg(rest).alias("abstention"))


def paired_gate(before: DataFrame, after: DataFrame, tolerance: float = 0.02, drop: float = 0.25) -> DataFrame:
    """What got worse: query_id (null for the whole), reason."""
    both = before.select("query_id", *(F.col(c).alias(f"{c}_0") for c in ("ndcg", "mrr", "n_relevant", "n_results"))).join(after.select("query_id", "ndcg", "mrr", "n_results"), "query_id")
    answerable = F.col("n_relevant_0") > 0
    reasons = F.array_compact(
        F.array(
            F.when(answerable & (F.col("ndcg_0") - F.col("ndcg") > drop), "ndcg drop"), F.when(answerable & (F.col("mrr_0") > 0) & (F.col("mrr") == 0), "hit lost"),
            F.when(~answerable & (F.col("n_results_0") == 0) & (F.col("n_results") > 0), "abstention lost"),
        )
    )
    single = both.select("query_id", F.explode(reasons).alias("reason"))
    fell = both.where(answerable).agg((F.avg("ndcg_0") - F.avg("ndcg")).alias("d")).where(F.col("d") > tolerance)
    return single.unionByName(fell.select(F.lit(None).cast(single.schema["query_id"].dataType).alias("query_id"), F.lit("mean ndcg drop").alias("reason")))


def report(means: DataFrame, columns: list[str]) -> str:
    """Means as a markdown table; a frame of categories is small."""
    rows = sorted(means.collect(), key=lambda r: (r.category is not None, r.category or ""))
    head = "| category | queries | " + " | ".join(columns) + " | abstention |"
    show = lambda x: "" if x is None else f"{x:.3f}"
    return "\n".join([head, "|" + "---|" * (len(columns) + 3), *(f"| {r.category or 'all'} | {r.queries} | " + " | ".join(show(r[c]) for c in columns) + f" | {show(r.abstention)} |" for r in rows)])
