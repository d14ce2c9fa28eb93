"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, by three densities: a block with many characters inside
links is bad, a long one with many stop words good, one with some near good, a long one without bad, and a short one undecided.
Stop words are the page's own: words that come back in several of its blocks, whatever the language; a page too short to
tell, or on which no block has many of them, goes by length and links alone. Second pass: near-good and undecided blocks take
the label of the nearest decided blocks before and after (near-good ones need one good neighbour, short ones two, headings the next).

Markup decides before the densities where it is plain. Menus, headers, footers, sidebars, forms, adverts, notices, comments
and hidden elements, by element, role or a whole class token, are bad with all inside them, block or inline; an
outer one is not undone by what stands inside, but that a main element always counts, and an article inside a form.
Inside an article, a main element or one with a class that says so, the container itself is the nearest decided neighbour, and good;
but three blocks or more in a row there that are nothing but links are a list of other pages, and bad. Where class tokens leave no
text at all, an element that they call bad and that holds most of the page's words is taken as a layout, and the page is read again.

Good blocks are joined in page order by two line feeds; character references are decoded and white space inside a
block becomes one space. `template` and `svg` are taken as markup; `noscript`, `object` and `math` are read as text.

Defined cases: null or empty html gives an empty text; an unclosed tag, comment or element ends with the page; a
very long page is one row and takes time in proportion to its length; of neighbours equally near none comes first, as both are asked;
repeated rows are extracted each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import columns_apart, frugal

#: Element names.
_BREAKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD = frozenset("nav footer aside menu dialog search".split())
_FORMS = frozenset("form fieldset select button".split())
_BAD_ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Class and id tokens that name what is no article, alone or with one common word before or after.
_AROUND = "area|bar|block|body|bottom|box|buttons?|container|content|email|form|global|google|inner|item|left|links?|list|main|mobile|page|primary|reader|right|secondary|section|site|slot|text|thread|top|unit|user|web|wrapper"
_BAD_TOKEN = re.compile(
    rf"(?:(?:{_AROUND})[-_])?(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|consent|cookies?|cookie[-_](?:notice|banner|consent)|disqus|footer|menu|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|promoted|related|replies|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:[-_](?:{_AROUND}|\d+))?",
    re.I,
).fullmatch
_HEAD_TOKEN = re.compile(r"(?:(?:site|page|global|top|main)[-_])?header|masthead", re.I).fullmatch
_GOOD_TOKEN = re.compile(r"(?:article|post|entry|story|page|main)(?:[-_](?:body|content|text))|article|post|entry|story|content", re.I).fullmatch
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|svg|iframe|title|noembed|noframes|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+", re.S)
_TELLING = re.compile(r"class|id|role|hidden|style", re.I).search
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
_WORDS = re.compile(r"[⺀-鿿가-힯぀-ヿ]|[^\W\d_]+")
_WIDE = re.compile(r"[⺀-鿿가-힯぀-ヿ]")

SHORT, LONG = 70, 200
SOME_STOPS, MANY_STOPS, MANY_LINKS = 0.15, 0.25, 0.33
#: Words of a page with which its own stop words can be told, and the longest that such a word is.
TELLING_WORDS, STOP_LETTERS = 150, 7
#: Blocks in a row that are links, and the share of their signs inside links, that make a list of other pages.
LIST, ALL_LINKS = 3, 0.9
#: How bad: forms, which an article inside undoes, and all else.
_FORM, _OUT = 1, 2


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] and len(value) > 1 else value)
    return out


def _place(name: str, rest: str, bad: int, good: bool, forgiven: bool = False) -> tuple[int, bool]:
    """How bad an element is and whether it is a good container, from its own tag and what it stands in. forgiven: its class and id tokens name no junk."""
    own = _attributes(rest) if rest and _TELLING(rest) else {}
    role = own.get("role", "").lower()
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or ("style" in own and _UNSEEN(own["style"])):
        return _OUT, good
    if name == "main" or role == "main":
        return 0, True
    tokens = () if name in ("html", "body") else (own.get("class", "") + " " + own.get("id", "")).split()
    if name in _BAD or role in _BAD_ROLES or (not forgiven and any(map(_BAD_TOKEN, tokens))):
        return _OUT, good
    if not good and (name == "header" or (not forgiven and any(map(_HEAD_TOKEN, tokens)))):
        return _OUT, good
    if name in _FORMS:
        return max(bad, _FORM), good
    if name == "article" or role == "article":
        return (0, True) if bad <= _FORM else (bad, good)
    if not good and not bad and name != "a" and any(map(_GOOD_TOKEN, tokens)):
        return 0, True
    return bad, good


def blocks(page: str, forgiven: frozenset[int] = frozenset(), said: list[int] | None = None) -> list[tuple[str, int, str, bool]]:
    """Text, characters inside links, place ('bad', 'good' or '') and whether a heading, of each block in order.

    forgiven: places in the page of tags whose tokens name no junk. said: gets for each block the place of the outermost tag that is bad by its tokens alone, or -1.
    """
    out: list[tuple[str, int, str, bool]] = []
    parts: list[str] = []
    # open block elements: name, how bad, good, the tag whose tokens said so; open inline elements of each, from a bad one on
    frames: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]
    inline: list[list[str]] = [[]]
    open_: Counter[str] = Counter()
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            name, bad, good, by = frames[-1]
            if said is not None:
                said.append(by)
            out.append((text, links, "bad" if bad else "good" if good else "", len(name) == 2 and name[0] == "h" and name[1].isdigit()))
        parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal linked
        while len(frames) > to:
            open_[frames.pop()[0]] -= 1
            inline.pop()
        if linked > len(frames):
            linked = 0

    def text_until(end: int) -> None:
        nonlocal links
        if end > at and not inline[-1]:
            piece = page[at:end]
            parts.append(piece)
            if linked:
                links += len(piece.strip())

    for m in _TAG.finditer(page):
        text_until(m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        ends, rest = bool(m["end"]), m["rest"]
        if name in _BREAKS:
            flush()
            if ends:
                if open_[name]:
                    to = len(frames) - 1
                    while frames[to][0] != name:
                        to -= 1
                    close(to)
                continue
            while frames[-1][0] in _CLOSED_BY.get(name, _PARAGRAPH):
                close(len(frames) - 1)
            if not rest.endswith("/"):
                _, bad, good, by = frames[-1]
                if inline[-1]:
                    frames.append((name, _OUT, good, by))
                else:
                    own = _place(name, rest, bad, good, m.start() in forgiven)
                    if said is not None and own[0] == _OUT and bad < _OUT:
                        by = m.start() if _place(name, rest, bad, good, True)[0] < _OUT else -1
                    frames.append((name, *own, by if own[0] else -1))
                inline.append([])
                open_[name] += 1
        elif name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
        elif ends:
            own = inline[-1]
            if own:
                if name in own:
                    while own.pop() != name:
                        pass
            elif name == "a":
                linked = 0
        elif not rest.endswith("/"):
            if name == "a":
                linked = len(frames)
            _, bad, good, _ = frames[-1]
            if inline[-1] or (not bad and _place(name, rest, 0, good)[0]):
                inline[-1].append(name)
    text_until(len(page))
    flush()
    return out


_PARAGRAPH = frozenset(["p"])
_CELLS = frozenset(["p", "td", "th"])
#: Elements that the start of another ends, where they are the innermost.
_CLOSED_BY = {"li": frozenset(["p", "li"]), "dt": frozenset(["p", "dt", "dd"]), "dd": frozenset(["p", "dt", "dd"]), "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr"}, "option": frozenset(["option"]), "body": frozenset(["p", "head"])}


def stop_words(found: list[tuple[str, int, str, bool]]) -> frozenset[str] | None:
    """The page's short words that come back in several blocks which neither markup nor links call bad; None if it is too short to tell."""
    times, blocks_with = Counter(), Counter()
    for text, links, place, _ in found:
        if place != "bad" and links <= MANY_LINKS * len(text):
            words = _WORDS.findall(text.lower())
            times.update(words)
            blocks_with.update(set(words))
    total = times.total()
    if total < TELLING_WORDS:
        return None
    return frozenset(w for w, n in times.items() if len(w) <= STOP_LETTERS and blocks_with[w] >= 2 and n >= max(3, 0.004 * total))


def first_pass(text: str, links: int, place: str, stops: frozenset[str] | None) -> str:
    if place == "bad":
        return "bad"
    size = len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))
    if place == "good":
        return "good" if size >= SHORT and links <= MANY_LINKS * len(text) else "inside"
    if links > MANY_LINKS * len(text) or text.startswith("©") or "copyright" in text[:40].lower():
        return "bad"
    if size < SHORT:
        return "short"
    share = MANY_STOPS
    if stops:
        words = _WORDS.findall(text.lower())
        share = sum(w in stops for w in words) / max(1, len(words))
    if share >= MANY_STOPS:
        return "good" if size > LONG else "near"
    return "near" if share >= SOME_STOPS else "bad"


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    decided = {"good": "good", "inside": "good", "bad": "bad"}
    before, after, last = [], [], "bad"
    for x in labels:
        before.append(last)
        last = decided.get(x, last)
    last = "bad"
    for x in reversed(labels):
        after.append(last)
        last = decided.get(x, last)
    after.reverse()
    none_good = not {"good", "inside"} & set(labels)
    out = []
    for i, x in enumerate(labels):
        if x == "near":
            out.append(none_good or "good" in (before[i], after[i]))
        elif x == "short":
            out.append((after[i] if headings[i] else "good" if before[i] == after[i] == "good" else "bad") == "good")
        else:
            out.append(x != "bad")
    return out


def link_lists(found: list[tuple[str, int, str, bool]]) -> list[tuple[str, int, str, bool]]:
    """Blocks in an article that are nothing but links, `LIST` or more in a row, are a list of other pages and bad."""
    bare = [place == "good" and not heading and links >= ALL_LINKS * len(text) > 0 for text, links, place, heading in found]
    out, at = list(found), 0
    while at < len(found):
        end = at
        while end < len(found) and bare[end]:
            end += 1
        if end - at >= LIST:
            out[at:end] = [(text, links, "bad", heading) for text, links, _, heading in found[at:end]]
        at = max(end, at + 1)
    return out


def _read(found: list[tuple[str, int, str, bool]]) -> str:
    """Both passes over a page's blocks."""
    found = link_lists(found)
    stops = stop_words(found) if any(not p for _, _, p, _ in found) else None
    labels = [first_pass(t, n, p, stops) for t, n, p, _ in found]
    if stops is not None and not {"good", "inside"} & set(labels):  # no block has many of the page's words: they tell nothing here
        labels = [first_pass(t, n, p, None) for t, n, p, _ in found]
    kept = second_pass(labels, [h for *_, h in found])
    return "\n\n".join(b[0] for b, k in zip(found, kept) if k)


def main_text(page: str | None) -> str:
    said: list[int] = []
    found = blocks(page, said=said) if page else []
    text, forgiven = _read(found), frozenset()
    # a page whose tokens leave nothing: one that holds most of its words names a layout, not junk
    while not text and any(x >= 0 for x in said):
        sizes: Counter[int] = Counter()
        for (own, links, _, _), by in zip(found, said):
            sizes[by] += max(0, len(own) - links)
        most, size = max(((b, n) for b, n in sizes.items() if b >= 0), key=lambda x: (x[1], -x[0]))
        if 2 * size <= sizes.total():
            break
        forgiven, said = forgiven | {most}, []
        found = blocks(page, forgiven, said)
        text = _read(found)
    return text


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            b = batch.slice(at, 100)
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """For each page: page_id, url, text, n_chars."""
    pages = columns_apart(pages, {"page_id": ("page_id", "bigint"), "url": ("url", "string"), "html": ("html", "string")})
    return pages.mapInArrow(frugal(_extracted), "page_id bigint, url string, text string, n_chars bigint")
