"""Mixing sources to target weights by subset sums over document lengths.

Sources in code point order (null last) weigh 1, 2, 3, 1, ...; the budget is all words there are. A target
stops at `most` times its source's size and the excess goes to the others by weight until none is above.
Of a source with target T and size S, every document is taken floor(T / S) times; for the rest R the
documents are counted by exact length, each length first gives its proportional share, and a bounded
knapsack over the lengths (a bitset of reachable sums, lengths in seeded order) closes the remaining budget. Where that
misses the sum, the shares give documents back, of more and more lengths and then more of each, until the sum is met or all are back;
only a search that would pass `BITS` of bitsets ends earlier, with the nearest sum found. Shares are rounded at random from a seed,
but so that short and long lengths round up alike (systematic sampling along the lengths), which leaves at most about the longest
document to the knapsack. Which documents of a length are taken follows from a seeded hash of doc_id, so reruns agree.

A plan has a row for each (source, length). The rows of one are dealt over `salts` ranges of that hash and a running sum over those
tells which are taken whole; only one range of each is ranked, so no group of copies meets in one task. What is
taken of a (source, length) are the rows up to a place in the order of hash and doc_id, so `mixed` needs no join with its texts' rows.

Defined cases: null text has size 0; a source of size 0 has target 0; an empty table gives no rows; a very long text is one document
like others; repeated rows count once each and share the hash, so which of them is taken is open but not how many; extra columns are ignored by
`mix` and kept by `mixed`, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import columns_apart, frugal, written
from .words import counts, slices

#: What the lengths' shares leave above this (only if there are documents of about as many words) is filled with the longest that fit.
LARGEST = 1 << 22
#: Bits of all bitsets of one search (a sixteenth of a GB).
BITS = 1 << 29
#: Rows of the plan that may be broadcast; beyond, rows and plan are joined by shuffling.
PLAN_ROWS = 200_000


def targets(sizes: list[int], most: int = 3) -> list[float]:
    """The target of each source, in order."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.remove(i)
        left -= sum(out[i] for i in over)
    return out


def shares(lengths: dict[int, int], budget: int, rng: random.Random) -> dict[int, int]:
    """Documents of each length by their share of the budget; a fraction f gives one more with chance f."""
    total = sum(k * n for k, n in lengths.items())
    take, rest = {}, rng.randrange(total)
    for k in sorted(lengths):
        whole, part = divmod(lengths[k] * budget, total)
        up, rest = divmod(rest + part, total)
        take[k] = whole + up
    return take


def subset(lengths: dict[int, int], budget: int, seed: int = 17) -> dict[int, int]:
    """Documents to take of each length (given: how many there are), with a sum as near `budget` as can be."""
    lengths = {k: n for k, n in lengths.items() if k > 0}
    if budget >= sum(k * n for k, n in lengths.items()):
        return dict(lengths)
    rng, goal, left = random.Random(seed), budget, -1
    while left < 0:
        take = shares(lengths, goal, rng)
        left = budget - sum(k * n for k, n in take.items())
        goal = max(0, goal + min(left, 0))
    if left > LARGEST:
        for k in sorted(lengths, reverse=True):
            n = min(lengths[k] - take[k], left // k)
            take[k] += n
            left -= k * n
    order = _order(lengths, rng)
    best, off = take, left
    many, each = 0, 1
    while off:
        # of the first `many` lengths, `each` documents of their shares are open again
        back = {k: min(take[k], each) for k in order[:many]}
        base = {k: n - back.get(k, 0) for k, n in take.items()}
        goal = budget - sum(k * n for k, n in base.items())
        if goal >= BITS:
            break
        got = _close(lengths, base, goal, order)
        miss = abs(budget - sum(k * n for k, n in got.items()))
        if miss < off:
            best, off = got, miss
        if many < len(order):
            many = min(len(order), max(4, 4 * many))
        elif all(back[k] == n for k, n in take.items()):
            break
        else:
            each *= 4
    return best


def _order(lengths: dict[int, int], rng: random.Random) -> list[int]:
    """Lengths in seeded order, but first those that lower the common divisor of the ones before: without them some sums are out of reach."""
    order = sorted(lengths)
    rng.shuffle(order)
    first, divisor = [], 0
    for k in order:
        if math.gcd(divisor, k) != divisor:
            divisor = math.gcd(divisor, k)
            first.append(k)
    return first + [k for k in order if k not in set(first)] if len(first) > 1 else order


def _close(lengths: dict[int, int], take: dict[int, int], left: int, order: list[int]) -> dict[int, int]:
    """`take` and as many more documents as bring it `left` words further, or as near as is found on either side."""
    take = dict(take)
    wide = left + max(lengths) + 1
    mask, reached, steps, room = (1 << wide) - 1, 1, [], BITS
    for k in order:
        n, part = min(lengths[k] - take[k], wide // k), 1
        while n and room > 0:
            part = min(part, n)
            after = reached | (reached << (k * part)) & mask
            if after != reached:
                steps.append((k, part, reached))
                room -= reached.bit_length()
                reached = after
            n -= part
            part *= 2
        if reached >> left & 1 or room <= 0:
            break
    below = (reached & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reached >> left
    over = left + (above & -above).bit_length() - 1 if above else None
    at = over if over is not None and over - left < left - below else below
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            take[k] += part
            at -= k * part
    return take


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(counts(b.column("text")), pa.int64()), b.column("u")], names=["doc_id", "source", "size", "u"])


def _planned(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """How many rows of each length of one source are taken once more."""
    size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    times = int(target // size) if size else 0
    take = subset(dict(zip(rows["size"].tolist(), rows.n.tolist())), round(target - times * size), seed) if size else {}
    rows["times"] = times
    rows["extra"] = rows["size"].map(take).fillna(0).astype("int64")
    return rows[["source", "size", "source_size", "target", "times", "extra"]]


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> list:
    return [a[c].eqNullSafe(b[c]) if c == "source" else a[c] == b[c] for c in names]


def _ranked(docs: DataFrame, seed: int, most: int) -> DataFrame:
    """For each row: doc_id, u (its hash), source, size, source_size, target, times, more (whether it is taken once more), split (whether it was ranked)."""
    spark = docs.sparkSession
    docs = columns_apart(docs, {"doc_id": ("doc_id", "bigint"), "source": ("source", "string"), "text": ("text", "string")})
    sized = written(docs.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")).mapInArrow(frugal(_sized), "doc_id bigint, source string, size bigint, u bigint"), "sized")
    bits = max(4, math.ceil(math.log2(max(1, sized.count()) / 50_000)))
    sized = sized.withColumn("salt", F.shiftright("u", 64 - bits))
    by_source = {r.source: r.s for r in sized.groupBy("source").agg(F.sum("size").alias("s")).collect()}  # one row a source
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    goals = spark.createDataFrame(
        list(zip(order, [by_source[s] for s in order], targets([by_source[s] for s in order], most))), "source string, source_size bigint, target double"
    )
    salted = written(sized.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "salted")
    hist = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    hist = hist.join(goals, _same(hist, goals, ["source"])).drop(goals["source"])
    plan = hist.groupBy("source").applyInPandas(lambda rows: _planned(rows, seed), "source string, size bigint, source_size bigint, target double, times bigint, extra bigint")
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # a row a salt
    counted = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = counted.join(plan, _same(counted, plan, ["source", "size"])).select(*(counted[c] for c in ("source", "size", "salt", "n")), "source_size", "target", "times", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("extra"))
    key = ["source", "size", "salt"]
    rows = sized.join(found, _same(sized, found, key)).select("doc_id", "u", *(sized[c] for c in key), *(found[c] for c in ("n", "source_size", "target", "times", "extra")))
    rows = rows.withColumn("split", (F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    loose = rows.where(~F.col("split")).withColumn("more", F.col("extra") > 0)
    tight = rows.where("split").withColumn("more", F.row_number().over(Window.partitionBy(*key).orderBy("u", "doc_id")) <= F.col("extra"))
    return loose.unionByName(tight).select("doc_id", "u", "source", "size", "source_size", "target", "times", "more", "split")


def mix(docs: DataFrame, seed: int = 17, most: int = 3) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, copies (times taken), taken (words taken)."""
    copies = F.col("times") + F.col("more").cast("int")
    return _ranked(docs, seed, most).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def word_count(text):
    """As `counts`, in the JVM and without an array of words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")) - F.length(text) + F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def mixed(docs: DataFrame, seed: int = 17, most: int = 3) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Documents without words weigh nothing in the mix and are not taken. Of rows that share doc_id, source and size as many are
    taken as the mix says. Rows meet only the plan, which has one row for each (source, size) and is broadcast up to `PLAN_ROWS`; texts
    are not shuffled for it unless it is larger.
    """
    ranked = written(_ranked(docs, seed, most), "ranked")
    place = F.struct("u", "doc_id")
    plan = ranked.groupBy("source", "size").agg(F.max("times").alias("times"), F.max(F.when(F.col("more"), place)).alias("last"))
    equal = ranked.where("split").groupBy("source", "size", "u", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("more").alias("some")).where("some > 0 and some < n")
    equal = written(equal.select("source", "size", "some"), "equal")  # at most one a (source, size): rows that share doc_id at its last place
    plan = plan.join(equal.select(F.col("source").alias("s"), F.col("size").alias("z"), "some"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    plan = written(plan.where("size > 0").select(F.col("source").alias("of"), F.col("size").alias("at"), "times", "last", "some"), "plan")
    names = {c.lower(): c for c in docs.columns}
    own = lambda c, kind: docs[names[c]].cast(kind) if c in names else F.lit(None).cast(kind)
    body = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own("doc_id", "bigint").alias("doc_id"), own("source", "string").alias("source"), word_count(own("text", "string")).cast("bigint").alias("size"))
    body = body.withColumn("u", F.xxhash64(F.lit(seed), "doc_id"))
    out = body.join(F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")))
    more = F.coalesce(place <= F.col("last"), F.lit(False))
    if not equal.isEmpty():
        tied = F.col("some").isNotNull() & place.eqNullSafe(F.col("last"))
        nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("u"))
        chosen = out.where(tied).withColumn("copies", F.col("times") + (nth <= F.col("some")).cast("int"))
        out = out.where(~tied).withColumn("copies", F.col("times") + more.cast("int")).unionByName(chosen)
    else:
        out = out.withColumn("copies", F.col("times") + more.cast("int"))
    return out.where("copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies").cast("bigint")))).select("row.*")
