"""Pairs of rows of one key whose time intervals overlap, without comparing all rows of a key.

An interval lies in at most two cells of its level, the power of two that its length fits in. It is compared with what lies in the same cells at its own
level and, at each coarser level that occurs, in the cells around it. So a key with very many short intervals is split by time, a
long interval is stored twice at most, and rows grow with the number of levels, which is that of a time's bits at most. A pair is
given once, in the cell where its overlap starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times beyond are as good as endless; lengths stay within 64 bits.
FAR = 1 << 61


def overlapping(rows: DataFrame, key: str, id_: str, start: Column, end: Column) -> DataFrame:
    """a, b: structs of all columns of both rows, each pair of different ids once, in one order or the other. Intervals are half open; an empty one overlaps what holds its time strictly inside."""
    begin, stop = (F.least(F.greatest(x, F.lit(-FAR)), F.lit(FAR)) for x in (start, end))
    whole = rows.select(F.col(key).alias("_key"), begin.alias("_f"), stop.alias("_t"), F.col(id_).alias("_n"), F.struct(*rows.columns).alias("_row"))
    level = F.ceil(F.log2(F.greatest(F.col("_t") - F.col("_f"), F.lit(1)).cast("double"))).cast("int")
    last = F.greatest(F.col("_t") - 1, F.col("_f"))
    held = whole.withColumn("_level", level).withColumn("_last", last)
    cells = lambda at: F.array_distinct(F.array(F.expr(f"shiftright(_f, {at})"), F.expr(f"shiftright(_last, {at})")))
    own = held.withColumn("_cell", F.explode(cells("_level")))
    levels = sorted(r._level for r in held.select("_level").distinct().collect())  # one a bit of a time at most
    coarser = held.withColumn("_at", F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("_level")))).withColumn("_cell", F.explode(cells("_at")))
    a = coarser.select("_key", F.col("_at").alias("_level"), "_cell", F.col("_level").alias("_la"), F.col("_f").alias("_fa"), F.col("_t").alias("_ta"), F.col("_n").alias("_na"), F.col("_row").alias("a"))
    b = own.select(F.col("_key").alias("_k"), F.col("_level").alias("_l"), F.col("_cell").alias("_c"), F.col("_f").alias("_fb"), F.col("_t").alias("_tb"), F.col("_n").alias("_nb"), F.col("_row").alias("b"))
    once = ((F.col("_la") < F.col("_l")) & (F.col("_na") != F.col("_nb"))) | (F.col("_na") < F.col("_nb"))
    first = F.expr("shiftright(greatest(_fa, _fb), _level)") == F.col("_cell")
    return a.join(b, (F.col("_key") == F.col("_k")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c")) & once & first & (F.col("_fa") < F.col("_tb")) & (F.col("_fb") < F.col("_ta"))).select("a", "b")
