"""Rules on text statistics whose cutoffs carry a risk guarantee.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Besides a fixed base rule, each of `RULES` rejects documents whose ratio is above (or
below) a cutoff. All cutoffs move together, in `STEPS` equal steps from the loosest to the strictest: one nested family, fixed before any
label is seen. For every stratum (language), the labelled documents of good quality are a holdout. Its family is walked from the
loosest end, and a step stands as long as the exact binomial test rejects "the rules together lose at least alpha of the good ones"
at level delta / strata. The walk ends at the first step that fails, so fixed-sequence testing holds in a stratum and Bonferroni across
strata: with probability 1 - delta, no stratum loses more than alpha of its good documents to these rules. With 4 strata,
alpha 0.02 and delta 0.05, 217 good labels do if no step loses one of them; a stratum with too few gets no cutoffs.

Defined cases: null text has no words and fails the base rule, as do empty and short texts; a null language is a stratum of its own;
labels of an unknown document are ignored, null labels too, and one bad label outweighs good ones; without labels only the base rule
works. Repeated rows are judged each for itself; of rows that repeat a doc_id the one that is lost first counts as its label's.
Ties do not arise: a ratio at the cutoff is kept. Very long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal, written
from .words import find, hashed, shingles, slices, utf8

#: Steps of the family.
STEPS = 48
#: Fixed values. rule: (ratio's numerator, denominator, 1 if large values are rejected else -1, loosest cutoff, strictest cutoff)
RULES = {
    "symbols": ("n_symbols", "word_chars", 1, 0.50, 0.02),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 0.98, 0.30),
    "repeats": ("n_repeat_words", "n_words", 1, 0.50, 0.20),
    "long_words": ("word_chars", "n_words", 1, 30.0, 10.0),
    "short_words": ("word_chars", "n_words", -1, 1.0, 3.0),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STATS = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
_BLANK = " \t\n\r\x0b\x0c"


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def _repeat_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words inside three-word windows that a row has twice or more."""
    n = np.diff(at)
    windows, w_at = shingles(words, at, 3)
    row = np.repeat(np.arange(len(n)), np.diff(w_at))
    real = n[row] >= 3
    place = at[row] + (np.arange(len(windows)) - w_at[row])
    windows, row, place = windows[real], row[real], place[real]
    key = windows ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    sorted_key, sorted_row = key[order], row[order]
    same = (sorted_key[1:] == sorted_key[:-1]) & (sorted_row[1:] == sorted_row[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[place[order[twice]] + j] = True
    return _per_row(covered, at)


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            data, rows = utf8(b.column("text"))
            starts, ends, at = find(data, rows)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            solid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
            lines = [_lines(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("lang"),
                    pa.array(np.diff(at)),
                    pa.array(_per_row(solid & ((data & 0xC0) != 0x80), rows)),
                    pa.array(_per_row(_SYMBOL[data], rows)),
                    pa.array([x[1] for x in lines], pa.int64()),
                    pa.array(_repeat_words(hashed(data, starts, ends), at)),
                    pa.array([x[0] for x in lines], pa.int64()),
                ],
                names=[x.split()[0] for x in _STATS.split(", ")],
            )


def statistics(docs: DataFrame) -> DataFrame:
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "lang": ("lang", "string"), "text": ("text", "string")})
    return docs.mapInArrow(frugal(_statistics), _STATS)


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial (n, p): the exact p-value of "the rate is at least p" after k in n."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def cutoff(rule: str, step: int) -> float:
    loose, strict = RULES[rule][3:]
    return loose + (strict - loose) * step / (STEPS - 1)


def chosen_steps(good: pd.DataFrame, alpha: float, delta: float) -> pd.DataFrame:
    """good: counts n by stratum and step (the first that loses the document, `STEPS` if none does). For each stratum: n_good, step (-1: none stands), lost there."""
    level = delta / max(1, good.stratum.nunique(dropna=False))
    out = []
    for stratum, rows in good.groupby("stratum", dropna=False):
        lost = np.cumsum(np.bincount(rows.step, weights=rows.n, minlength=STEPS + 1)).astype(int)
        total, step = int(rows.n.sum()), -1
        while step + 1 < STEPS and at_most(int(lost[step + 1]), total, alpha) <= level:
            step += 1
        out.append((stratum, total, step, int(lost[step]) if step >= 0 else 0))
    return pd.DataFrame(out, columns=["stratum", "n_good", "step", "lost"])


def _ratio(rule: str):
    top, bottom = RULES[rule][:2]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _first_lost():
    """The first step of the family at which one of the rules rejects a document; `STEPS` if none does."""
    each = []
    for rule, (*_, sign, _, _) in RULES.items():
        lost = F.filter(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(cutoff(rule, j)).alias("c")) for j in range(STEPS))), lambda x: (_ratio(rule) - x["c"]) * sign > 0)
        each.append(F.coalesce(F.try_element_at(lost, F.lit(1))["j"], F.lit(STEPS)))
    return F.least(*each)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> tuple[DataFrame, pd.DataFrame]:
    """One row a document with its statistics, base_failed and kept; and each stratum's step, with the good labels there are and those lost."""
    spark = docs.sparkSession
    stats = written(statistics(docs), "statistics")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    labels = columns_apart(labels, {"doc_id": ("doc_id", "bigint"), "quality": ("quality", "int")})
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stats = stats.withColumn("first_lost", _first_lost())
    # of documents that the base rule fails nothing is left for these rules to lose
    good = stats.where(~base).groupBy("doc_id").agg(F.min(F.struct("first_lost", "lang")).alias("x")).join(labels.where("quality = 1"), "doc_id")
    counted = good.groupBy(F.col("x.lang").alias("stratum"), F.col("x.first_lost").alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # strata x steps at most
    chosen = chosen_steps(counted, alpha, delta)
    steps = [(None if s != s else s, int(k)) for s, k in zip(chosen.stratum, chosen.step)]
    table = spark.createDataFrame(steps, "stratum string, step int")
    rejected = F.col("first_lost") <= F.coalesce("step", F.lit(-1))
    out = stats.join(F.broadcast(table), stats["lang"].eqNullSafe(table["stratum"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected).alias("kept"), "n_lines", "lang"
    )
    return out, chosen
