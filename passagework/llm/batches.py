"""Dealing keys into parts of bounded size, so that what is known of one part can be sent to every task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def parts_within(sizes: DataFrame, key: str, most: int) -> int:
    """sizes: key, bytes. Into how many parts the keys are dealt by hash, so that none has more than `most` bytes unless it is one key."""
    total, keys = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, math.ceil(total / most))
    while parts > 1 and parts < 64 * keys:
        dealt = sizes.groupBy(part_of(key, parts).alias("part")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        if dealt.where((F.col("bytes") > most) & (F.col("n") > 1)).isEmpty():
            break
        parts *= 2
    return parts
