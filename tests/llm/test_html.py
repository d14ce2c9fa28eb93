"""Page shapes with the text that a reader would call theirs, and pages built around a known text."""

import random
import re
import time
from collections import Counter

import pytest

from passagework.llm.html_extract import extract, main_text

LONG = "The committee met on the bank of the river and it said that the water of the river was high, and that the people of the town were to wait for the word of the committee before they went to the other bank."
RU = "Комитет собрался на берегу реки и сказал, что вода в реке высокая и что люди города должны ждать слова комитета, прежде чем они пойдут на другой берег реки, где их ждут друзья и где стоит старый мост."
ZH = "委员会在河边开会,说河水很高,城里的人们要等委员会的话才能到对岸去。" * 4

SHAPES = [
    (None, ""),
    ("", ""),
    ("plain words only", ""),
    (f"<p>{LONG}</p>", LONG),
    (f"<p>{RU}</p>", RU),
    (f"<p>{ZH}</p>", ZH),
    (f"<h1>Title</h1><p>{LONG}</p>", f"Title\n\n{LONG}"),
    (f"<article><h1>Title</h1><p>One.</p><p>{LONG}</p></article>", f"Title\n\nOne.\n\n{LONG}"),
    ("<article><p>A</p><p>B</p></article>", "A\n\nB"),
    (f'<div class="overflow-hidden"><p>{LONG}</p></div>', LONG),
    (f'<div class="layout with-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<body class="sidebar ads"><p>{LONG}</p></body>', LONG),
    (f'<div hidden><p>{LONG}</p></div><article>a</article>', "a"),
    (f"<div style='display : none'>{LONG}</div><article>a</article>", "a"),
    ('<article>one<p class="notice">Site notice.</p>two</article>', "one\n\ntwo"),
    ('<article><p>one <span class="ad">Buy now</span>two</p></article>', "one two"),
    ('<article><p>one <span class="ad">Buy <span>this</span> now</span> two</p></article>', "one two"),
    ('<article><ul><li class="advert">x<li>kept</ul></article>', "kept"),
    ('<article>a</article><section id="comments"><h2>Comments</h2><article class="comment-body">me too</article></section>', "a"),
    ('<article>a</article><article class="comment">me too</article>', "a"),
    ("<aside><article>side</article></aside><article>a</article>", "a"),
    ("<nav><article>side</article></nav><article>a</article>", "a"),
    ("<article>a<aside>side</aside>b</article>", "a\n\nb"),
    ("<article><p title=it's>First</p><p>It's second</article>", "First\n\nIt's second"),
    ('<article><p data-x="a > b">First</p></article>', "First"),
    ("<article><p a=b=c d=\"e>f\" g='h>i'>x</p></article>", "x"),
    ("<article>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</article>", "a x=1 b"),
    ("<article><noscript>shown</noscript><object>fallback</object></article>", "shown\n\nfallback"),
    ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->b</article>", "ab"),
    ("<article>x &amp; y &lt;z&gt; &#233;&eacute;&nbsp;w</article>", "x & y <z> éé w"),
    ("<article>a\n\t b<br>c</article>", "a b c"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>", "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"),
    ("<article><p><b>a<br><p>b<i>c</p></article>", "a\n\nbc"),
    ("<main><form><p>name</p></form><p>kept</p></main>", "kept"),
    ("<form id=page><article>kept</article></form>", "kept"),
    ('<div class="content with-ads"><main class="sidebar-right">kept</main></div>', "kept"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header>text<footer>by</footer></article><footer>©</footer>", "Title\n\ntext"),
    ('<div role="navigation">menu</div><div role="main">kept</div>', "kept"),
    ("<article>a</article><ul><li><a href=x>One</a><li><a href=y>Two</a></ul>", "a"),
    ("<article>a<!-- open", "a"),
    ("<article>a<p class=", "a"),
    ("<head><title>T</title><body><article>a</article>", "a"),
    (f"<p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>All rights reserved</p>", f"{LONG}\n\nYes.\n\n{LONG}"),
    (f"<div><a href=x>{LONG}</a></div><p>{LONG}</p>", LONG),
    ('<article>a<div aria-hidden="true">x</div><dialog>d</dialog><button>b</button></article>', "a"),
    ("<article></span></i></div></p>a</article>", "a"),
    (f'<div class="content sidebar-left"><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div class="menu"><a href=x>m</a></div>', f"{LONG}\n\nShort one.\n\n{LONG}"),
    (f'<article class="post share-text"><h1>Head</h1><p>{LONG}</p></article><div class=ad>buy this</div>', f"Head\n\n{LONG}"),
    (f'<div class="page share"><nav>n</nav><article><p>{LONG}</p><div class="share">tell</div></article></div>', LONG),
    (f'<div class="page share"><div class="content sidebar-left"><p>{LONG}</p></div></div>', LONG),
    (f'<article><p>{LONG}</p></article><div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', LONG),
    (f"<article><p>{LONG}</p><ul>" + "".join(f"<li><a href=x>Another story number {i}</a></li>" for i in range(6)) + f"</ul><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>Source</a> says so<li><a href=x>Two</a></ul></article>", f"{LONG}\n\nSource says so\n\nTwo"),
]


@pytest.mark.parametrize("page,want", SHAPES)
def test_shapes(page, want):
    assert main_text(page) == want


def test_pages_built_around_a_known_text():
    rng = random.Random(6)
    words = "the of and to in water town river bridge people met word high old stone road".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    junk = ["<nav><ul><li><a>Home</a><li><a>News</a></ul></nav>", '<div class="ad">Buy the best of the best.</div>', "<!-- note -->", "<script>if (a<b) {}</script>", '<section class="comments"><p>{}</p></section>', '<div id="sidebar"><p>{}</p></div>', "<form><p>{}</p></form>", "<footer>{}</footer>"]
    for _ in range(200):
        paragraphs = [sentence(rng.randint(30, 80)) for _ in range(rng.randint(3, 8))]
        body = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<p class=lead>{}", "<blockquote>{}</blockquote>"]).format(p) for p in paragraphs)
        page = "<body>" + "".join(rng.choice(junk).format(sentence(40)) for _ in range(3)) + rng.choice(["<div>{}</div>", "<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>']).format(body)
        page += "".join(rng.choice(junk).format(sentence(40)) for _ in range(3)) + rng.choice(["</body>", ""])
        assert main_text(page) == "\n\n".join(paragraphs), page


def test_bare_pages_go_by_densities_and_neighbours():
    """Pages of `div` and `p` without a container, a role or a class: labels and text are those of the two passes done one block at a time."""
    rng = random.Random(13)
    words = "the of and to in water town river bridge people met word high old stone road".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(150):
        kinds = [rng.choice(["long", "long", "long", "short", "links", "near", "head"]) for _ in range(rng.randint(4, 14))]
        page, own = "", []
        for k in kinds:
            text = sentence({"long": 60, "short": 4, "links": 9, "near": 20, "head": 3}[k])
            page += {"links": "<div><a href=x>{}</a></div>", "head": "<h2>{}</h2>"}.get(k, rng.choice(["<p>{}</p>", "<div>{}</div>"])).format(text)
            own.append((text, len(text) if k == "links" else 0, k == "head"))
        times, blocks_with = Counter(), Counter()
        for text, links, _ in own:
            if not links:
                found = re.findall(r"[a-z]+", text.lower())
                times.update(found)
                blocks_with.update(set(found))
        total = sum(times.values())
        stops = {w for w, n in times.items() if len(w) <= 7 and blocks_with[w] >= 2 and n >= max(3, 0.004 * total)} if total >= 150 else None

        def label(text, links, stops):
            if links:
                return "bad"
            if len(text) < 70:
                return "short"
            found = re.findall(r"[a-z]+", text.lower())
            share = sum(w in stops for w in found) / len(found) if stops else 0.25
            return ("good" if len(text) > 200 else "near") if share >= 0.25 else "near" if share >= 0.15 else "bad"

        labels = [label(t, n, stops) for t, n, _ in own]
        if stops is not None and "good" not in labels:
            labels = [label(t, n, None) for t, n, _ in own]
        want = []
        for i, (text, _, head) in enumerate(own):
            sides = [next((x for x in side if x in ("good", "bad")), "bad") for side in (labels[:i][::-1], labels[i + 1 :])]
            keep = {"good": True, "bad": False, "near": "good" not in labels or "good" in sides, "short": sides[1] == "good" if head else sides == ["good", "good"]}[labels[i]]
            want += [text] * keep
        assert main_text(page) == "\n\n".join(want), page


def test_time_grows_with_the_length():
    for piece in ("<a>", "<b>x", "<div>", "<p>x<span class=ad>", "<i class=ad>", "</div>", '<a href="', "<p a='", "<!--", "<li>x", "&amp", "<div class='ad"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            main_text(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, piece


def test_table_cases(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", "y"), (1, "u", f"<p>{LONG}</p>", "x", "y"), (2, None, None, "x", "y"), (None, "v", "", "x", "y"), (3, "w", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in extract(pages).collect())
    n = 5000 * len(LONG) + 4999 * 2
    assert got == [(0, "v", 0, 0), (1, "u", len(LONG), len(LONG)), (1, "u", len(LONG), len(LONG)), (2, "", 0, 0), (3, "w", n, n)]
    assert extract(pages.limit(0)).count() == 0
