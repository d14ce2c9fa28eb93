"""Importance resampling of raw text towards a target by hashed n-gram models.

One- and two-word grams (words `[^\\x20\\x09-\\x0D]+`) are hashed into `BUCKETS` buckets; two bags of buckets, one of
the target and one of all raw text, are the generative models (add-one smoothed). A document's log weight is the log of its
probability under the target's model over that under the raw one: the sum over all its grams of their log ratios. Gumbel noise, from a
seeded hash of doc_id, is added to log weight / `temperature` and the k largest are the sample without replacement. At
temperature 1 these are importance weights, which long texts spread far: among them the noise decides little. A higher one flattens them.

The target's model is fitted on at most `TARGET_DOCS` target documents, drawn by a hash over all of them; the
raw model counts every document. The k-th largest key is found by narrowing histograms, so no sort is global.

Defined cases: a text without words (or null) has no weight and is never taken; without target documents all weights are 0;
repeated rows share their noise, and all rows equal to the k-th key are taken (ties); a very long text is weighed whole, in one row; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal, written
from .words import find, hashed, mix, slices, utf8

BUCKETS = 10_000
TARGET_DOCS = 20_000


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one- and two-word grams of each row, and each row's first (one more than rows)."""
    data, rows = utf8(column)
    starts, ends, at = find(data, rows)
    words = hashed(data, starts, ends)
    n = np.diff(at)
    first = np.concatenate([[0], np.cumsum(np.maximum(0, 2 * n - 1))])
    row = np.repeat(np.arange(len(n)), n)
    place = first[row] + 2 * (np.arange(len(words)) - at[row])
    out = np.empty(int(first[-1]), np.uint64)
    out[place] = words
    two = np.flatnonzero(row[1:] == row[:-1])
    out[place[two] + 1] = mix(words[two] * np.uint64(0x9E3779B97F4A7C15) + words[two + 1])
    return (out % np.uint64(BUCKETS)).astype(np.int64), first


def _counted(target: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                buckets, first = grams(b.column("text"))
                raw += np.bincount(buckets, minlength=BUCKETS)
                chosen = np.isin(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), target) & ~np.asarray(b.column("doc_id").is_null())
                wanted += np.bincount(buckets[np.repeat(chosen, np.diff(first))], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(wanted)], names=["bucket", "raw", "target"])

    return run


def _weighed(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                buckets, first = grams(b.column("text"))
                n = np.diff(first)
                weight = np.zeros(len(n))
                if len(buckets):
                    weight[n > 0] = np.add.reduceat(ratio[buckets], first[:-1][n > 0])  # each row by itself, so equal texts weigh the same
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(weight, mask=n == 0)], names=["doc_id", "n_grams", "log_weight"])

    return run


def log_ratios(docs: DataFrame, target_ids: np.ndarray) -> np.ndarray:
    counts = docs.mapInArrow(frugal(_counted(np.sort(target_ids))), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts.bucket] += counts.raw
    target[counts.bucket] += counts.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if len(target_ids) else np.zeros(BUCKETS)


def kth_largest(df: DataFrame, column: str, k: int, few: int = 5_000) -> float | None:
    """The k-th largest value (null ignored) by histograms that narrow down to a few rows; None if there are fewer."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if n <= k or k < 1:
        return low if n and n <= k else None
    above = 0
    while True:
        inside = values.where(F.col("v").between(low, high))
        width = (high - low) / 1000
        if n <= few or width <= 0 or low + width == low:
            top = [r.v for r in inside.orderBy(F.desc("v")).limit(max(1, min(few, k - above))).collect()]
            return top[min(len(top), k - above) - 1]
        bins = inside.groupBy(F.least(F.lit(999), F.floor((F.col("v") - low) / width)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r.b):  # 1000 rows at most
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n


def resample(docs: DataFrame, target: DataFrame, keep: float = 0.85, seed: int = 23, target_docs: int = TARGET_DOCS, temperature: float = 1.0) -> DataFrame:
    """For each row: doc_id, n_grams, log_weight, key (log weight / temperature plus noise), kept. target: doc_id of the target's documents, which are among `docs`."""
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "text": ("text", "string")})
    drawn = columns_apart(target, {"doc_id": ("doc_id", "bigint")}).where("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(target_docs)
    ids = np.array([r.doc_id for r in drawn.collect()], np.int64)
    ratio = log_ratios(docs, ids)
    uniform = (F.xxhash64(F.lit(seed + 1), "doc_id") / F.lit(2.0**64)) + F.lit(0.5)
    noise = -F.log(-F.log(F.greatest(F.lit(1e-300), F.least(uniform, F.lit(1 - 2.0**-53)))))
    scored = docs.mapInArrow(frugal(_weighed(ratio)), "doc_id bigint, n_grams bigint, log_weight double").withColumn("key", F.col("log_weight") / temperature + noise)
    scored = written(scored, "scored")
    least = kth_largest(scored, "key", round(keep * scored.count()))
    kept = F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return scored.withColumn("kept", kept)
