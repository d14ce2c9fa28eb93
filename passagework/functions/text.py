"""Text functions as Column expressions: nothing here leaves the JVM.

Lengths are in characters, never bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword query drops while others remain.
STOP_WORDS = (
    "a an the and or but if then so of to in on at by for from with without into onto over under about as is are was were be been being am do does did done "
    "have has had having it its this that these those there here he she they them his her their we you your i me my our us what which who whom whose when where "
    "why how not no yes can could may might will would shall should must also than too very just only"
).split()

#: Patterns that route a query.
IDENTIFIER = r"(^|\s)([A-Za-z]+[_./:]+[A-Za-z0-9_./:-]*|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][A-Z0-9]+_[A-Z0-9_]+|[A-Z]{2,}-?\d+)(\s|$)"
RELATIONAL = r"(?i)\b(between|relate[sd]?|relation|depend[s]?|connect(ed|s|ion)? (to|with)|differ|compare|changed? (between|from|since)|uses?|calls?|interact|how .+ (and|with) )"

#: Address form.
ADDRESS = "memo://"

_WORD = r"[\p{L}\p{N}_]+"
_EXACT = r"[\p{L}\p{N}_.:/-]+"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f's lambdas use it."""
    return F.transform(F.array(value), f)[0]


def normalise(c: Column) -> Column:
    """CRLF to LF, no blanks at line ends, exactly one final line feed."""
    c = F.regexp_replace(c, "\r\n", "\n")
    c = F.regexp_replace(c, r"[ \t]+(\n|\z)", "$1")
    return F.concat(F.regexp_replace(c, r"\n+\z", ""), F.lit("\n"))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(normalise(c), 256))


def estimate_tokens(c: Column) -> Column:
    """1.4 for an ASCII word or its length / 5 if that is more, 1.2 for a non-ASCII character, 0.5 for a run of punctuation; rounded.

    Counted in tenths, so the sum is exact and independent of order.
    """
    words = F.aggregate(F.transform(_all(c, "[A-Za-z0-9]+"), lambda w: F.greatest(F.lit(14), F.length(w) * 2)), F.lit(0), lambda a, x: a + x)
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    marks = F.size(_all(c, r"[^A-Za-z0-9\x09-\x0D \x{80}-\x{10FFFF}]+"))
    return F.floor((words + wide * 12 + marks * 5 + 5) / 10).cast("int")


def context_header(title: Column, section: Column, context: Column | None = None) -> Column:
    """`title > section — context`; a title that the section already starts with is left out."""
    t, s = F.trim(F.coalesce(title, F.lit(""))), F.coalesce(section, F.lit(""))
    t = F.when((s == t) | s.startswith(F.concat(t, F.lit(" > "))), F.lit("")).otherwise(t)
    head = F.concat_ws(" > ", F.nullif(t, F.lit("")), F.nullif(s, F.lit("")))
    if context is None:
        return head
    return F.concat_ws(" — ", F.nullif(head, F.lit("")), F.nullif(F.trim(context), F.lit("")))


def embed_text(header: Column, text: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) == "", text).otherwise(F.concat(header, F.lit("\n"), text))


def role_prefix(text: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text


def first_heading(c: Column) -> Column:
    found = F.trim(F.regexp_extract(c, r"(?m)^\s*# (.*)$", 1))
    return F.when(found == "", F.lit("(untitled)")).otherwise(found)


def one_liner(c: Column) -> Column:
    """The first sentence if that ends after 41 to 200 characters, else 160 characters and an ellipsis."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    stop = F.length(F.regexp_extract(t, r"^[^.!?]*[.!?]", 0))
    cut = F.when(F.length(t) > 160, F.concat(F.substring(t, 1, 160), F.lit("…"))).otherwise(t)
    return F.when((stop > 41) & (stop <= 200), t.substr(F.lit(1), stop)).otherwise(cut)


def exact_tokens(c: Column) -> Column:
    """Identifiers whole; the marks `.:/-` are trimmed at both ends, in texts and queries alike."""
    return _all(F.lower(c), r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.:/-]*[\p{L}\p{N}_])?")


def word_tokens(c: Column) -> Column:
    """Letters and digits only, lower case; `_` splits."""
    return _all(F.lower(c), r"[\p{L}\p{N}]+")


def without_stop_words(words: Column) -> Column:
    kept = F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def query_terms(q: Column, exact: bool = False) -> Column:
    """Distinct terms of a query, folded as the index is: stop words dropped unless nothing is left, then one-character words."""
    words = without_stop_words(_all(q, _EXACT if exact else _WORD))
    if exact:
        words = F.transform(words, lambda t: F.regexp_replace(t, "^[.:/-]+|[.:/-]+$", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), lambda w: fold(F.lower(w))))


def looks_like_identifier(q: Column) -> Column:
    return q.rlike(IDENTIFIER)


def is_relational(q: Column) -> Column:
    return q.rlike(RELATIONAL)


def wants_graph(q: Column, n_entities: Column) -> Column:
    return (n_entities >= 2) | ((n_entities == 1) & is_relational(q))


def _plain() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    pairs = [(a, b) for a, b in pairs if b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, *_plain())


def tidy_name(c: Column) -> Column:
    """White space collapsed, punctuation but `_` trimmed."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[\p{P}\s&&[^_]]+|[\p{P}\s&&[^_]]+$", "")


def entity_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(tidy_name(c)), "[ _-]", "")


def trigrams(key: Column) -> Column:
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def digit_signature(key: Column) -> Column:
    return F.regexp_replace(key, "[^0-9]", "")


def entropy(key: Column) -> Column:
    """Bits a character."""

    def of(letters: Column) -> Column:
        n = F.size(letters).cast("double")
        shares = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
        return F.aggregate(F.array_sort(shares), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return bound(F.filter(F.split(key, ""), lambda x: x != ""), of)


def ambiguous(key: Column) -> Column:
    return (F.length(key) < 5) | (entropy(key) < 1.5)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def candidate_keys(q: Column) -> Column:
    """Keys of every run of one to three words, two characters at least."""
    return bound(F.filter(F.split(F.trim(F.regexp_replace(q, r"\s+", " ")), " "), lambda w: w != ""), _run_keys)


def _run_keys(words: Column) -> Column:
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + n - 1 <= F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return F.array_distinct(F.filter(F.transform(runs, entity_key), lambda k: F.length(k) >= 2))


def stem5(w: Column) -> Column:
    return F.substring(F.regexp_replace(w, r"""^[.,;:()"'`*_-]+|[.,;:()"'`*_-]+$""", ""), 1, 5)


def fields(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_grams(c: Column, n: int = 3, least_words: int = 8) -> Column:
    """Distinct lower-case word n-grams; none for a text of fewer than `least_words` words."""

    def of(words: Column) -> Column:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))
        return F.when(F.size(words) >= max(least_words, n), grams).otherwise(F.array().cast("array<string>"))

    return bound(fields(F.lower(c)), of)


def cited_chunks(c: Column) -> Column:
    return F.array_distinct(F.transform(_all(c, ADDRESS + r"chunk/(\d+)", 1), lambda x: x.cast("bigint")))


def sentences(c: Column, marks: str = ".!?\n") -> Column:
    """Non-empty parts between any of the marks, trimmed."""
    return F.filter(F.transform(F.split(c, f"[{marks}]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def spoken_sentences(c: Column) -> Column:
    """Sentences that keep their mark: `.`, `!` or `?` before white space or the end."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 60), "-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def yaml_quoted(c: Column) -> Column:
    risky = c.rlike(r"""[:#\[\]{}"'\n]|^\s|\s$|^[-?*&!|>%@`]""") | (c == "")
    return F.when(risky, F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))).otherwise(c)


def cut_lines(c: Column, budget: int) -> Column:
    """Whole lines while their words, and one more a line, stay within the budget; the first line always."""
    kept = F.aggregate(
        F.split(c, "\n"), F.struct(F.lit("").alias("text"), F.lit(0).alias("lines"), F.lit(0).alias("spent")),
        lambda a, x: bound(a["spent"] + F.size(fields(x)) + 1, lambda spent: F.when((a["lines"] == 0) | (spent <= budget), F.struct(F.when(a["lines"] == 0, x).otherwise(F.concat(a["text"], F.lit("\n"), x)).alias("text"), (a["lines"] + 1).alias("lines"), spent.alias("spent")))
                         .otherwise(F.struct(a["text"].alias("text"), a["lines"].alias("lines"), F.greatest(spent, F.lit(budget + 1)).alias("spent")))),
    )
    return kept["text"]


def is_number(c: Column) -> Column:
    return c.rlike(r"^[0-9._-]+$")


def address(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{ADDRESS}{kind}/"), key.cast("string"))


def parse_address(c: Column) -> Column:
    """struct(kind, key); kind is `index`, `ns_index` or the first part, null if it is no address."""
    kind = F.regexp_extract(c, "^" + ADDRESS + "([^/]+)(?:/.+)?$", 1)
    key = F.regexp_extract(c, "^" + ADDRESS + "[^/]+/(.+)$", 1)
    ns = F.regexp_extract(c, "^" + ADDRESS + "ns/(.+)/index$", 1)
    return F.struct(
        F.when(c == ADDRESS + "index", F.lit("index")).when(ns != "", F.lit("ns_index")).when((kind != "") & (key != ""), kind).alias("kind"),
        F.when(ns != "", ns).when(key != "", key).alias("key"),
    )


def fence_code(name: Column, body: Column) -> Column:
    """A source file as one fenced block with its extension as language; markdown stays."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    fenced = F.concat(F.lit("```"), ext, F.lit("\n"), F.regexp_replace(body, r"\n+\z", ""), F.lit("\n```\n"))
    return F.when(ext == "md", body).otherwise(fenced)


def front_matter(c: Column) -> Column:
    """struct(meta map, body) of a text whose header stands between `---` lines; without one, all is body."""
    head = F.regexp_extract(c, r"^---\n((?s).*?)\n---\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[a-z_]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([a-z_]+):", 1), F.regexp_replace(F.trim(F.regexp_replace(x, "^[a-z_]+:", "")), r'^"(.*)"$', "$1")))
    body = F.regexp_replace(c, r"^---\n(?s).*?\n---\n\n?", "")
    return F.struct(F.when(head == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs)).alias("meta"), F.when(head == "", c).otherwise(body).alias("body"))


def session_handle(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 12)


def valid_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{1,64}$") & ~c.isin(".", "..")


#: What a message says when arguments were wrong.
ARGUMENT_HINTS = ("is required", "must be one of", "must name", "usage:", "needs ", "bad ", "malformed", "not a memo://")


def error_class(message: Column) -> Column:
    m = F.lower(message)
    any_of = m.contains(ARGUMENT_HINTS[0])
    for hint in ARGUMENT_HINTS[1:]:
        any_of = any_of | m.contains(hint)
    return (
        F.when(m.contains("was forgotten"), "forgotten")
        .when(m.contains("not found"), "not_found")
        .when(m.contains("needs a human"), "needs_human")
        .when(m.contains("context canceled") | m.contains("deadline exceeded"), "canceled")
        .when(any_of, "invalid_args")
        .otherwise("internal")
    )


def band(score: Column, bands: tuple[float, float, float]) -> Column:
    strong, moderate, weak = bands
    return F.when(score >= strong, "strong").when(score >= moderate, "moderate").when(score >= weak, "weak").otherwise("very-weak")
