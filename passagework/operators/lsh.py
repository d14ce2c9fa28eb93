"""A stored MinHash index that grows by batches: new rows are signed, look for partners in what is stored and among themselves, and are added.

Rows that are there are never signed again, and a batch reads only the bands that it hits: bands are partitioned by a part of their key. Links
are those of one batch with all rows, since each pair is met when the later of the two is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scratch import kept
from ..storage import CommitLog, Opened
from . import resolve

#: Folders of the band table.
PARTS = 16
SETS = "id string, grams array<string>, tag string"
BANDS = "band int, key long, id string, part int"
LINKS = "a string, b string, score double"
#: Links lie as pairs of blocks of ids and are expanded where the table is read; rows of earlier versions have a, b alone.
LINKED = Opened(f"{LINKS}, xs array<string>, ys array<string>", lambda df: _opened(df))
#: Tables of an index, by what follows its name; partitioned ones and their columns.
TABLES = {"sets": SETS, "bands": BANDS, "links": LINKED}


def tables(name: str) -> dict[str, str]:
    return {f"{name}_{t}": ddl for t, ddl in TABLES.items()}


def partitioned(name: str) -> dict[str, str]:
    return {f"{name}_bands": "part"}


def _bands(sets: DataFrame) -> DataFrame:
    each = sets.select("id", F.explode(resolve.bands(resolve.signature(F.col("grams"), resolve._fast32))).alias("x"))
    return each.select("x.band", "x.key", "id", F.pmod("x.key", F.lit(PARTS)).cast("int").alias("part"))


def add(read, append, name: str, rows: DataFrame, least: float, alike: Column | None = None) -> DataFrame:
    """rows: id, grams, tag; those whose id is there already, or that have no grams, are left out. Gives the new links: a < b, score (exact Jaccard).

    read, append: of a table (a commit's, or a base's). alike: a further condition over the tags `x.tag` and `y.tag`.
    Rows of equal grams and tag are one class: it is signed when its first row comes, compared once a batch, and what is found is expanded.
    """
    known = read(f"{name}_sets")
    new = kept(rows.select("id", "grams", "tag").where(F.size("grams") > 0).dropDuplicates(["id"]).join(known.select(F.col("id").alias("_known")).hint("merge"), F.col("id") == F.col("_known"), "left_anti"), "sets")
    if new.isEmpty():
        return rows.sparkSession.createDataFrame([], LINKS)
    every = known.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True))).withColumn("_own", F.struct(F.array_sort("grams").alias("grams"), "tag"))
    least_id = F.coalesce(F.min(F.when(~F.col("new"), F.col("id"))), F.min("id")).alias("class")
    reps = kept(every.groupBy("_own").agg(least_id, F.count(F.lit(1)).alias("n"), F.count_if("new").alias("come"), F.bool_or("new").alias("grown"), F.bool_and("new").alias("fresh")), "classes")
    members = kept(every.join(reps.select("_own", "class", "n", "come").hint("merge"), "_own").select("id", "new", "class", F.when(F.col("new"), F.col("come")).otherwise(F.col("n") - F.col("come")).alias("n")), "members")
    sets = reps.select("class", "n", "grown", "fresh", "_own.*")
    signed = kept(_bands(sets.where("grown").select(F.col("class").alias("id"), "grams")), "bands")
    fresh = signed.join(sets.where("fresh").select(F.col("class").alias("id")).hint("merge"), "id", "left_semi").select(*signed.columns)
    parts = [r.part for r in signed.select("part").distinct().collect()]  # PARTS at most
    there = read(f"{name}_bands").where(F.col("part").isin(parts)).join(members.select("id", "class").hint("merge"), "id").select("band", "key", F.col("class").alias("other"))
    met = signed.join(there.unionByName(fresh.select("band", "key", F.col("id").alias("other"))).distinct().hint("merge"), ["band", "key"]).where(F.col("id") != F.col("other"))
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    side = lambda x: sets.select(F.struct(F.col("class").alias("id"), "grams", "tag").alias(x)).hint("merge")
    both = pairs.join(side("x"), F.col("a") == F.col("x.id")).join(side("y"), F.col("b") == F.col("y.id"))
    both = both if alike is None else both.where(alike)
    near = kept(both.select("a", "b", X.jaccard(F.col("x.grams"), F.col("y.grams")).alias("score")).where(F.col("score") >= least), "near")
    equal = sets.where("grown and n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("score"))
    # New rows of a class with the other's old ones, from either side, and with its new ones; every link is found once.
    listed = lambda new: resolve.blocks(members.where(F.col("new") == new))
    young, old, back = kept(listed(True), "young"), kept(listed(False), "old"), near.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")
    found = resolve.products(near.unionByName(equal), young, young)
    crossed = resolve.products(near.unionByName(back).unionByName(equal), young, old, True)
    links = kept(found.unionByName(crossed).select("score", "xs", "ys"), "links")
    append(f"{name}_sets", new)
    append(f"{name}_bands", fresh)
    append(f"{name}_links", links.select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "score", "xs", "ys"))
    return resolve.opened(links)


def _opened(links: DataFrame, digits: int | None = None) -> DataFrame:
    pairs = links.select(F.coalesce("xs", F.array("a")).alias("xs"), F.when(F.col("xs").isNull(), F.array("b")).otherwise(F.col("ys")).alias("ys"), "score")
    return resolve.opened(resolve.rounded(pairs, "score", digits)).select("a", "b", "score")


def links(log: CommitLog, name: str, digits: int | None = None) -> DataFrame:
    """All links of an index; scores are rounded before the blocks are expanded, not once a pair."""
    return _opened(log.stored(f"{name}_links"), digits)


def names(entities: DataFrame) -> DataFrame:
    """Rows of an index of names: entities (id, key) whose key is not ambiguous; the tag is the key's digits."""
    return entities.where(~X.ambiguous(F.col("key"))).select(F.col("id").cast("string").alias("id"), X.trigrams(F.col("key")).alias("grams"), X.digit_signature(F.col("key")).alias("tag"))


SAME_DIGITS = "x.tag = y.tag"


def add_names(log: CommitLog, name: str, entities: DataFrame, least: float = resolve.NEAR_NAME) -> DataFrame:
    """A batch of names as one commit."""
    with log.commit(f"add to {name}") as c:
        return add(log.table, c.append, name, names(entities), least, F.expr(SAME_DIGITS))
