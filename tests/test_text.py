import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.functions.stem import stem
from passagework.operators import chunking


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_normalise(spark):
    assert one(spark, "a \t\r\nb  \n\n\n", X.normalise) == "a\nb\n"
    assert one(spark, "", X.normalise) == "\n"


@pytest.mark.parametrize("text", ["", "hello world", "naïve — test!!", "a" * 40, "x.y.z ... 語語", "tab\tand\nline"])
def test_token_estimates_agree(spark, text):
    assert one(spark, text, X.estimate_tokens) == chunking.estimate(text)


def test_headers(spark):
    rows = spark.createDataFrame([("T", "T > S", None), ("T", "S", "c"), ("T", "", None), ("", "", "c")], "t string, s string, c string")
    assert [r[0] for r in rows.select(X.context_header(F.col("t"), F.col("s"), F.col("c"))).collect()] == ["T > S", "T > S — c", "T", "c"]


def test_query_terms(spark):
    assert one(spark, "The state of ERR_CONN_RESET", X.query_terms) == ["state", "err_conn_reset"]
    assert one(spark, "to be or not", X.query_terms) == ["to", "be", "or", "not"]
    assert one(spark, "call net/http. now", lambda c: X.query_terms(c, True)) == ["call", "net/http", "now"]


@pytest.mark.parametrize("q, yes", [("why ERR_CONN_RESET", True), ("useCallback", True), ("net/http usage", True), ("QRM-1000", True), ("plain words here", False)])
def test_identifier_router(spark, q, yes):
    assert one(spark, q, X.looks_like_identifier) is yes


def test_names(spark):
    assert one(spark, " 'Client Connect' ", X.entity_key) == "clientconnect"
    assert one(spark, "ab", X.trigrams) == ["  a", " ab", "ab "]
    assert one(spark, "aaaaaa", X.ambiguous) is True
    assert one(spark, "pipelinescheduler", X.ambiguous) is False
    assert "ledgerstore" in one(spark, "What is the Ledger Store?", X.candidate_keys)


def test_slug_and_lines(spark):
    assert one(spark, "Hello, World!  Again", X.slug) == "hello-world-again"
    assert one(spark, "§§", X.slug) == "untitled"
    assert one(spark, "a b\nc d\ne f", lambda c: X.cut_lines(c, 6)) == "a b\nc d"
    assert one(spark, "a b c d e f g h", lambda c: X.cut_lines(c, 2)) == "a b c d e f g h"


def test_one_liner(spark):
    long = "word " * 60
    assert one(spark, long, X.one_liner) == (long.strip()[:160] + "…")
    s = "This is the first sentence, long enough to count. And more."
    assert one(spark, s, X.one_liner) == "This is the first sentence, long enough to count."


def test_addresses(spark):
    rows = [one(spark, u, X.parse_address) for u in ("memo://index", "memo://ns/a/index", "memo://chunk/7", "http://x")]
    assert [tuple(r) for r in rows] == [("index", None), ("ns_index", "a"), ("chunk", "7"), (None, None)]
    assert one(spark, "see (memo://chunk/12) and memo://chunk/12, memo://chunk/3", X.cited_chunks) == [12, 3]


@pytest.mark.parametrize("w, s", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("electricity", "electr"), ("reviewers", "review"), ("adjustable", "adjust"), ("controll", "control"), ("sky", "sky")])
def test_stem(w, s):
    assert stem(w) == s


def test_chunks_keep_fences_and_sections():
    text = "# T\n\nintro words\n\n## S\n\n" + "A sentence here. " * 200 + "\n\n```go\nfunc main() {}\n\n# not a heading\n```\ntail"
    out = chunking.split(text)
    assert [c["ord"] for c in out] == list(range(len(out)))
    assert out[0]["section_path"] == "T" and out[-1]["section_path"] == "T > S"
    fence = next(c for c in out if c["lang"] == "go")
    assert "# not a heading" in fence["text"]
    assert all(c["est_tokens"] <= 400 for c in out)
    assert out[1]["text"].split()[-3:] == out[2]["text"].split()[:3] or "A sentence here." in out[2]["text"]


def test_open_fence_runs_to_the_end():
    assert chunking.split("a\n\n~~~\nb\n\nc")[-1]["text"] == "~~~\nb\n\nc"
    assert chunking.split("") == [] and chunking.split(None) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n#`é", max_size=300))
def test_chunks_lose_no_letters(text):
    joined = "".join(c["text"] for c in chunking.split(text, chunking.Sizes(5, 8, 0))) + "".join(c["section_path"] for c in chunking.split(text, chunking.Sizes(5, 8, 0)))
    for ch in set(text) & set("abé"):
        prose = "\n".join(line for line in text.split("\n") if not line.strip().startswith("#"))
        assert joined.count(ch) >= prose.count(ch)


def test_duckdb_says_the_same_of_tokens(spark):
    text = "Ünïcode_words and net/http: v1.2-x"
    ours = one(spark, text, X.exact_tokens)
    theirs = duckdb.execute(r"SELECT list_filter(list_transform(regexp_extract_all(lower(?), '[\p{L}\p{N}_.:/-]+'), lambda x: regexp_replace(x, '^[.:/-]+|[.:/-]+$', '', 'g')), lambda x: x <> '')", [text]).fetchone()[0]
    assert ours == theirs
