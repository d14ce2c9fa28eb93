"""The test tables as a knowledge base, by fixed rules that SQL views say again."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluation, index
from ..streaming import ingest as stream
from . import search as S
from .profiles import PROFILES

EPOCH, NOW = 1_700_000_000_000, 1_800_000_000_000
DAY = 86_400_000
AS_OF = 1_709_251_200_000  # 2024-03-01

_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_EDGE = "'^[.:/-]+|[.:/-]+$'"


def _hits(name: str) -> str:
    return f"""{name}_spread AS (SELECT id, len(tokens) AS size, unnest(tokens) AS term FROM {'exact' if name == 'exact' else 'word'}_tokens),
    {name}_tf AS (SELECT id, size, term, count(*)::DOUBLE AS tf FROM {name}_spread WHERE term IN (SELECT unnest(terms) FROM {name}_queries) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY term),
    {name}_all AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avg_size FROM {'exact' if name == 'exact' else 'word'}_tokens),
    {name}_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM (
        SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 5e-1) / (df + 5e-1))) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * size / avg_size))), 9) AS raw
        FROM (SELECT query_id, unnest(terms) AS term FROM {name}_queries) JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_all GROUP BY query_id, id))"""


def _asked(name: str, pattern: str, trim: bool) -> str:
    words = f"regexp_extract_all(text, '{pattern}')"
    kept = f"list_filter(w, lambda x: NOT list_contains({_STOPS}, lower(x)))"
    one = f"list_transform(k, lambda x: regexp_replace(x, {_EDGE}, '', 'g'))" if trim else "k"
    return f"""{name}_queries AS (SELECT query_id, list_transform(range(1, len(d) + 1), lambda i: d[i]) AS terms FROM (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM (
        SELECT query_id, list_transform(list_filter({one}, lambda x: length(x) > 1), lambda x: strip_accents(lower(x))) AS l FROM (SELECT query_id, CASE WHEN len({kept}) = 0 THEN w ELSE {kept} END AS k FROM (SELECT item_id AS query_id, {words} AS w FROM benchmark)))))"""


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _porter(source: str) -> str:
    """The stem of each term of a view, by Porter's published steps as one view a step: measures are patterns over runs of consonants and vowels; a first y is a consonant."""
    at_least = lambda x, n: f"regexp_matches({x}, '^({_C})?{(_V + _C) * n}')"
    one = lambda x: f"regexp_matches({x}, '^({_C})?{_V}{_C}({_V})?$')"
    vowel = lambda x: f"regexp_matches({x}, '^({_C})?[aeiouy]')"
    short = lambda x: f"({one(x)} AND regexp_matches({x}, '^{_C}[aeiouy][^aeiouwxy]$'))"
    cut = lambda n: f"left(w, -{n})"
    mended = lambda x: f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN right({x}, 1) = left(right({x}, 2), 1) AND length({x}) > 1 AND regexp_matches({x}, '[^aeiouylsz]$') THEN left({x}, -1) WHEN {short(x)} THEN {x} || 'e' ELSE {x} END"

    def swapped(rules: list[tuple[str, str]], n: int, more: str = "TRUE") -> str:
        return "CASE " + " ".join(f"WHEN w LIKE '%{old}' THEN CASE WHEN {at_least(cut(len(old)), n)} AND {more if old == 'ion' else 'TRUE'} THEN {cut(len(old))} || '{new}' ELSE w END" for old, new in rules) + " ELSE w END"

    steps = [
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {at_least(cut(3), 1)} THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' AND {vowel(cut(2))} THEN {mended(cut(2))} WHEN w LIKE '%ing' AND {vowel(cut(3))} THEN {mended(cut(3))} ELSE w END",
        f"CASE WHEN w LIKE '%y' AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END",
        swapped(stem.TWO, 1),
        swapped(stem.THREE, 1),
        swapped([(x, "") for x in stem.FOUR], 2, f"regexp_matches({cut(3)}, '[st]$')"),
        f"CASE WHEN w LIKE '%e' AND ({at_least(cut(1), 2)} OR ({one(cut(1))} AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {at_least('w', 2)} THEN {cut(1)} ELSE w END",
    ]
    views = [f"stem_0 AS (SELECT DISTINCT term, CASE WHEN term LIKE 'y%' THEN 'Y' || substr(term, 2) ELSE term END AS w, regexp_matches(term, '^[a-z]{{3,}}$') AS plain FROM {source})"]
    views += [f"stem_{i + 1} AS (SELECT term, CASE WHEN plain THEN {x} ELSE w END AS w, plain FROM stem_{i})" for i, x in enumerate(steps)]
    return ",\n".join([*views, f"stems AS (SELECT term, CASE WHEN plain THEN lower(w) ELSE term END AS stem FROM stem_{len(steps)})"])


def _stem_hits(name: str, tokens: str, queries: str) -> str:
    """BM25 over stems of a view with id, tokens, for a view with query_id, terms."""
    return f"""{name}_spread AS (SELECT id, len(tokens) AS size, unnest(tokens) AS term FROM {tokens}),
    {name}_words AS (SELECT term FROM {name}_spread UNION SELECT unnest(terms) FROM {queries}),
    {_porter(f'{name}_words')},
    {name}_asked AS (SELECT DISTINCT query_id, stem FROM (SELECT query_id, unnest(terms) AS term FROM {queries}) JOIN stems USING (term)),
    {name}_tf AS (SELECT id, size, stem, count(*)::DOUBLE AS tf FROM {name}_spread JOIN stems USING (term) WHERE stem IN (SELECT stem FROM {name}_asked) GROUP BY ALL),
    {name}_df AS (SELECT stem, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY stem),
    {name}_all AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avg_size FROM {tokens}),
    {name}_scored AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 5e-1) / (df + 5e-1))) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * size / avg_size))), 9) AS raw
        FROM {name}_asked JOIN {name}_tf USING (stem) JOIN {name}_df USING (stem), {name}_all GROUP BY query_id, id),
    {name}_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM {name}_scored)"""


def _hashed_vectors(name: str, rows: str) -> str:
    """Unit vectors of 64 dimensions as rows (id, d, x) of a query that gives id, text: each word takes 8 signed steps by its MD5."""
    byte = lambda place: f"('0x' || substr(md5(term), 4 * k + {place}, 2))::INT"
    return rf"""{name}_terms AS (SELECT id, term, 1 + ln(count(*)) AS w FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM ({rows})) GROUP BY ALL),
    {name}_steps AS (SELECT term, {byte(1)} % 64 AS d, CASE WHEN {byte(3)} < 128 THEN 1 ELSE -1 END AS s FROM (SELECT DISTINCT term FROM {name}_terms), range(8) r(k)),
    {name}_sums AS (SELECT id, d, sum(w * s) AS x FROM {name}_terms JOIN {name}_steps USING (term) GROUP BY ALL),
    {name} AS (SELECT id, d, (x / size)::FLOAT::DOUBLE AS x FROM {name}_sums JOIN (SELECT id, sqrt(sum(x * x)) AS size FROM {name}_sums GROUP BY id) USING (id) WHERE size > 0)"""


#: Views in order; a query gets those that it names, and those that these name.
VIEWS = {
    "docs": f"""docs AS (SELECT doc_id AS id, source AS namespace, CASE WHEN doc_id % 2 = 1 THEN 'note' ELSE 'doc' END AS kind, lang AS tag, text, 'Document ' || doc_id AS title,
        'doc://' || source || '/' || doc_id AS uri, {EPOCH} + doc_id * 3600000 AS updated_at,
        CASE WHEN toxic = 1 THEN 'agent' WHEN quality = 1 THEN 'curated' ELSE 'user' END AS trust FROM documents LEFT JOIN labels USING (doc_id))""",
    "lines": "lines AS (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "exact_tokens": rf"exact_tokens AS (SELECT doc_id AS id, list_filter(list_transform(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}_.:/-]+'), lambda x: regexp_replace(x, {_EDGE}, '', 'g')), lambda x: x <> '') AS tokens FROM documents)",
    "word_tokens": r"word_tokens AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS tokens FROM documents)",
    "keyword_queries": _asked("keyword", r"[\p{L}\p{N}_]+", False),
    "exact_queries": _asked("exact", r"[\p{L}\p{N}_.:/-]+", True),
    "exact_hits": _hits("exact"),
    "keyword_hits": _hits("keyword"),
    "stem_hits": _stem_hits("stem", "word_tokens", "keyword_queries"),
    "semantic_hits": f"""{_hashed_vectors("doc_vectors", "SELECT doc_id AS id, text FROM documents")},
    {_hashed_vectors("query_vectors", "SELECT item_id AS id, text FROM benchmark")},
    pair_dots AS (SELECT q.id AS query_id, v.id, sum(q.x * v.x) AS dot FROM query_vectors q JOIN doc_vectors v USING (d) GROUP BY ALL),
    semantic_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM (
        SELECT query_id, p.id, round(dot / (nq * nv), 9) AS raw FROM pair_dots p JOIN (SELECT id AS query_id, sqrt(sum(x * x)) AS nq FROM query_vectors GROUP BY id) USING (query_id) JOIN (SELECT id, sqrt(sum(x * x)) AS nv FROM doc_vectors GROUP BY id) n ON n.id = p.id))""",
    "token_counts": r"""token_counts AS (SELECT doc_id AS id, floor((list_sum(list_transform(list_concat(['a'], regexp_extract_all(text, '[A-Za-z0-9]+')), lambda w: greatest(14, 2 * length(w)))) - 14
        + 12 * length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + 5 * len(regexp_extract_all(text, '[^A-Za-z0-9\x09-\x0D \x{80}-\x{10FFFF}]+')) + 5) / 10) AS tokens FROM documents)""",
    "hashed": r"""hashed AS (SELECT doc_id, 'sha256:' || sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n+\z', '') || chr(10)) AS hash FROM documents)""",
    "revisions": f"""revisions AS (SELECT o_orderkey AS id, 'c' || o_custkey % 10 AS namespace, o_orderpriority AS version, epoch_ms(o_orderdate) AS created_at, lead(o_orderkey) OVER w AS superseded_by,
        coalesce(epoch_ms(lead(o_orderdate) OVER w), epoch_ms(o_orderdate)) AS updated_at, CASE WHEN o_orderstatus = 'P' THEN {NOW} END AS deleted_at
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
    "facts": f"""facts AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS statement, epoch_ms(o_orderdate) AS recorded_at, epoch_ms(o_orderdate) AS valid_from,
        epoch_ms(o_orderdate) + (o_orderkey % 90 + 1) * {DAY} AS valid_to, CASE o_orderstatus WHEN 'F' THEN 'curated' WHEN 'O' THEN 'user' ELSE 'agent' END AS trust,
        CASE WHEN o_orderkey % 7 = 0 THEN epoch_ms(o_orderdate) + 10 * {DAY} END AS invalidated_at, CASE WHEN o_orderkey % 13 = 0 THEN {NOW} END AS deleted_at FROM orders)""",
    "chained": "chained AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS statement, epoch_ms(o_orderdate) AS recorded_at, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders)",
    "mentions": "mentions AS (SELECT l_suppkey AS entity_id, l_partkey AS chunk_id, max(l_quantity) / 50e0 AS weight FROM lineitem GROUP BY ALL)",
}
_NEEDS = {"exact_hits": ["exact_tokens", "exact_queries"], "keyword_hits": ["word_tokens", "keyword_queries"], "stem_hits": ["word_tokens", "keyword_queries"]}


def with_views(sql: str, needs: list[str] = []) -> str:
    """The SQL with the views that it names, or needs, in front."""
    import re

    wanted = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)} | set(needs)
    for v in list(wanted):
        wanted |= set(_NEEDS.get(v, []))
    heads = [VIEWS[v] for v in VIEWS if v in wanted]
    sql = sql.strip()
    if not heads:
        return sql
    recursive = sql.startswith("WITH RECURSIVE ")
    if sql.startswith("WITH "):
        sql = sql[len("WITH RECURSIVE ") if recursive else len("WITH ") :]
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(heads) + ",\n" + sql
    return "WITH " + ",\n".join(heads) + "\n" + sql


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        trust = F.when(F.col("toxic") == 1, "agent").when(F.col("quality") == 1, "curated").otherwise("user")
        rows = self.documents.join(self.labels, "doc_id", "left")
        return rows.select(
            F.col("doc_id").alias("id"), F.col("source").alias("namespace"), F.when(F.col("doc_id") % 2 == 1, "note").otherwise("doc").alias("kind"), F.col("lang").alias("tag"), "text",
            F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"),
            (F.lit(EPOCH) + F.col("doc_id") * 3600000).alias("updated_at"), trust.alias("trust"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("ord", F.col("ord").cast("bigint"))

    def _ms(self, c):
        return F.unix_millis(c.cast("timestamp"))

    @cached_property
    def revisions(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        made = self._ms(F.col("o_orderdate"))
        return self.orders.select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("namespace"), F.col("o_orderpriority").alias("version"), made.alias("created_at"),
            F.lead("o_orderkey").over(w).alias("superseded_by"), F.coalesce(self._ms(F.lead("o_orderdate").over(w)), made).alias("updated_at"), F.when(F.col("o_orderstatus") == "P", F.lit(NOW)).alias("deleted_at"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        made, key = self._ms(F.col("o_orderdate")), F.col("o_orderkey")
        trust = F.when(F.col("o_orderstatus") == "F", "curated").when(F.col("o_orderstatus") == "O", "user").otherwise("agent")
        return self.orders.select(
            key.alias("id"), F.lit("ns").alias("namespace"), F.col("o_custkey").alias("subject"), F.array(F.col("o_custkey").cast("string")).alias("about"), F.col("o_orderpriority").alias("statement"),
            made.alias("recorded_at"), made.alias("valid_from"), (made + (key % 90 + 1) * DAY).alias("valid_to"), trust.alias("trust"), F.when(key % 7 == 0, made + 10 * DAY).alias("invalidated_at"),
            F.when(key % 13 == 0, F.lit(NOW)).alias("deleted_at"), key.alias("evidence_chunk_id"),
        )

    @cached_property
    def chained(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("statement"), self._ms(F.col("o_orderdate")).alias("recorded_at"), F.lag("o_orderkey").over(w).alias("supersedes"))

    @cached_property
    def priorities(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_orderpriority").alias("statement")).agg(F.min("o_orderkey").alias("id"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("chunk_id")).agg((F.max("l_quantity") / 50.0).alias("weight"))

    @cached_property
    def entity_pages(self) -> DataFrame:
        return self.supplier.where("s_suppkey % 2 = 0").select(
            F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("entity").alias("kind"), F.col("s_suppkey").alias("subject_id"), F.col("s_name").alias("title"), (F.col("s_suppkey") % 4 == 0).alias("stale"),
            F.lit("revised").alias("stale_reason"), F.array(F.lit(1).cast("bigint")).alias("chunk_ids"), F.lit(None).cast("bigint").alias("deleted_at"),
        )

    @cached_property
    def pages_written(self) -> DataFrame:
        return self.docs.select("id", "namespace", "title", F.col("text").alias("content"), (F.col("id") % 4 == 0).alias("stale"), F.lit(True).alias("is_inference"), F.lit(None).cast("bigint").alias("deleted_at"))

    @cached_property
    def qrels(self) -> DataFrame:
        """Documents that contain a passage; the passages are the stated queries, so they alone are sent to all tasks."""
        return evaluation.containing(self.documents.select("doc_id", "text"), self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")))

    def corpus(self) -> S.Corpus:
        docs = self.docs.withColumn("deleted_at", F.lit(None).cast("bigint")).withColumn("superseded_by", F.lit(None).cast("bigint"))
        passages = self.docs.select("id", F.col("id").alias("document_id"), F.lit(0).alias("ord"), "text", X.estimate_tokens(F.col("text")).alias("est_tokens"), F.lit("").alias("context_header"))
        return S.Corpus(passages, docs, self.docs.select("id", V.embedder(V.hash_encoder(64))(F.col("text")).alias("embedding")))

    def asked(self) -> DataFrame:
        """The benchmark's passages as requests: query_id, query, terms (stems), exact_terms."""
        text = F.col("text")
        return index.stem_terms(self.benchmark.select(F.col("item_id").alias("query_id"), text.alias("query"), X.query_terms(text).alias("terms"), X.query_terms(text, True).alias("exact_terms")))

    def search(self, profile: str, arms: list[str]) -> DataFrame:
        queries = self.asked().withColumn("vector", V.embedder(V.hash_encoder(64))(F.col("query")))
        found = S.search(self.corpus(), queries, arms, PROFILES[profile], now_ms=NOW, token_budget=4000)
        return found.select("query_id", "position", "id", F.round("final", 6).alias("final"), "band", F.array_join(F.transform("arms", lambda a: a["arm"]), " ").alias("arms"))

    def _streamed(self, df: DataFrame, name: str, mode: str) -> DataFrame:
        """A stream run to its end, its result read again."""
        import uuid

        base = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.conf.get("spark.sql.warehouse.dir")
        path = f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
        df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.schema(df.schema).parquet(f"{path}/out")

    def _stream(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory()
        reader = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
        return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)

    def streamed_first_seen(self) -> DataFrame:
        rows = self._stream("documents").select("doc_id", F.col("source").alias("namespace"), F.col("text").alias("content"))
        return self._streamed(stream.first_seen(rows).select("namespace", "content_hash"), "first", "append")

    def streamed_sessions(self) -> DataFrame:
        rows = self._stream("events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
        return self._streamed(stream.sessions(rows), "sessions", "append")
