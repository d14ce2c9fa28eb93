"""Markdown trees in and out, bounded indexes, and line and metric sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def read_tree(spark: SparkSession, path: str, kind: str = "doc") -> DataFrame:
    """uri, name, content of every file below a path; only `*.md` unless the kind is code; no dot files, no indexes. Code is fenced."""
    reader = spark.read.option("recursiveFileLookup", True)
    if kind != "code":
        reader = reader.option("pathGlobFilter", "*.md")
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    raw = raw.where(~F.col("name").startswith(".") & (F.col("name") != "_index.md") & ~F.col("uri").rlike(r"/\.[^/]+/"))
    return raw.withColumn("content", X.fence_code(F.col("name"), F.col("content"))) if kind == "code" else raw


def import_tree(spark: SparkSession, path: str) -> DataFrame:
    """As read_tree, with the front matter that an export wrote taken off: meta, body."""
    return read_tree(spark, path).select("uri", "name", F.inline(F.array(X.front_matter(F.col("content")))))


META = ("id", "source_id", "uri", "namespace", "kind", "title", "version", "trust", "origin", "revision")


def rendered(docs: DataFrame) -> Column:
    """A document with its front matter; fields without a value are left out."""
    lines = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), X.yaml_quoted(F.col(c).cast("string")))) for c in META if c in docs.columns]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col("content"))


def file_name(title: Column, id_: Column) -> Column:
    return F.concat(X.slug(title), F.lit("-"), F.substring(F.regexp_replace(id_.cast("string"), "[^A-Za-z0-9]", ""), 1, 8), F.lit(".md"))


def export_tree(docs: DataFrame, path: str) -> None:
    """One text file a document in `namespace=/kind=/file=` folders, so that writers need no coordination."""
    out = docs.select("namespace", "kind", file_name(F.col("title"), F.col("id")).alias("file"), F.regexp_replace(rendered(docs), r"\n\z", "").alias("value"))
    out.write.mode("overwrite").partitionBy("namespace", "kind", "file").text(path)  # the writer ends the last line


def bounded_index(docs: DataFrame, facts: DataFrame | None = None, most: int = 8192, header: str = "# Index\n") -> DataFrame:
    """Lines of an index that fit in bytes, in order: position, line, spent. Documents by namespace and title, then facts; it stops at the first that does not fit.

    A prefix sum over everything would need one task; since at most `most` lines can fit, only so many first ones are taken before.
    """
    line = F.concat(F.lit("- "), X.one_liner(F.col("title")), F.lit(" · "), F.col("uri"), F.lit(" · "), F.col("kind"), F.when(F.coalesce("version", F.lit("")) != "", F.concat(F.lit(" · "), F.col("version"))).otherwise(""), F.lit(" · "), F.col("trust"))
    rows = docs.select(F.lit(0).alias("part"), F.col("namespace").alias("k1"), F.col("title").alias("k2"), F.col("uri").alias("k3"), line.alias("line"))
    if facts is not None:
        own = F.concat(F.lit("- "), X.one_liner(F.col("statement")), F.lit(" · "), X.address("fact", F.col("id")), F.lit(" · "), F.col("trust"))
        rows = rows.unionByName(facts.select(F.lit(1).alias("part"), F.col("namespace").alias("k1"), F.col("statement").alias("k2"), F.col("id").cast("string").alias("k3"), own.alias("line")))
    order = ["part", "k1", "k2", "k3"]
    first = rows.orderBy(*order).limit(most)
    w = Window.orderBy(*order)
    spent = F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    room = most - len(header.encode()) - 80
    return first.select(F.row_number().over(w).alias("position"), "line", spent.alias("spent")).where(F.col("spent") <= room)


def export_indexes(docs: DataFrame, path: str, most: int = 8192) -> None:
    """An index of each namespace as text under `namespace=`, cut to `most` bytes, with how many lines that left out."""
    line = F.concat(F.lit("- "), X.one_liner(F.col("title")), F.lit(" · "), F.col("uri"), F.lit(" · "), F.col("kind"), F.lit(" · "), F.col("trust"))
    w = Window.partitionBy("namespace").orderBy("title", "uri")
    first = docs.select("namespace", "title", "uri", line.alias("line"), F.row_number().over(w).alias("n")).where(F.col("n") <= most)  # no more can fit
    spent = F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("spent", spent).where(F.col("spent") <= most - 88).select("namespace", "n", F.col("line").alias("value"))
    counts = docs.groupBy("namespace").agg(F.count(F.lit(1)).alias("all")).join(kept.groupBy("namespace").agg(F.count(F.lit(1)).alias("in")), "namespace", "left")
    left = F.col("all") - F.coalesce("in", F.lit(0))
    heads = counts.select("namespace", F.lit(0).alias("n"), F.concat(F.lit("# "), "namespace", F.lit(" ("), F.col("all").cast("string"), F.lit(" documents)")).alias("value"))
    tails = counts.where(left > 0).select("namespace", F.lit(1 << 30).alias("n"), omitted(left, most).alias("value"))
    rows = heads.unionByName(kept).unionByName(tails).repartition("namespace").sortWithinPartitions("namespace", "n")
    rows.select("namespace", "value").write.mode("overwrite").partitionBy("namespace").text(path)


def omitted(n: Column, most: int) -> Column:
    return F.concat(F.lit("_"), n.cast("string"), F.lit(f" more line(s) omitted to fit {most} bytes; search or list for the rest._"))


def replay_lines(log: DataFrame) -> DataFrame:
    """Logged searches as candidates for evaluation, a JSON object a line."""
    return log.select(F.to_json(F.struct(F.concat(F.lit("log-"), F.col("id").cast("string")).alias("id"), "query", F.lit("replay").alias("category"), F.array().cast("array<string>").alias("relevant"))).alias("value"))


def prometheus_lines(families: DataFrame) -> DataFrame:
    """Exposition text: one row a line, in order. families: name, help, type, labels (map), suffix, value."""
    quote = lambda v: F.regexp_replace(F.regexp_replace(v, r'(["\\])', r"\\$1"), "\n", r"\\n")
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), quote(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    series = families.select("name", F.lit(2).alias("part"), F.concat("name", "suffix", labels).alias("key"), F.concat(F.concat("name", "suffix", labels), F.lit(" "), number).alias("line"))
    names = families.select("name", "help", "type").distinct()
    heads = names.select("name", F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line"))
    types = names.select("name", F.lit(1).alias("part"), F.lit("").alias("key"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line"))
    return heads.unionByName(types).unionByName(series).orderBy("name", "part", "key").select("line")
