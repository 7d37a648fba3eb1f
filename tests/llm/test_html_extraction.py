import html as entities
import re

import pytest
from llm.conftest import documents
from muster.llm.html_extraction import extract, main_text, smoothed, threshold

LONG = "This is a paragraph of the article with a fair number of words, so that it weighs more than any menu."

CASES = {
    "article": (f"<body><nav><a href=x>Home</a></nav><header>Site</header><article><header><h1>Title</h1></header><p>{LONG}"
                f"<p>Of.<p>{LONG}<aside>See also</aside><footer>By me</footer><div class=comments><p>{LONG} I agree</div>"
                f"</article><footer>&copy; me</footer>", ["Title", LONG, "Of.", LONG]),
    "main": (f"<div id=top-menu>Menu {LONG}</div><main><h2>T</h2><p>{LONG}</p><form><p>{LONG}</p></form></main>", ["T", LONG]),
    "div": (f"<body class='has-sidebar'><div class='menu'><ul><li><a>a</a><li><a>b</a></ul></div><div class=content><h1>T</h1>"
            f"<p>{LONG}</p><p>x</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></body>", ["T", LONG, "x", LONG]),
    "entities": ("<article><p>a &amp; b&nbsp;&lt;c&gt; &#233;\n\t d <br> e<script>if (a<b) x('</p>')</script></article>",
                 ["a & b <c> é d e"]),
    "inline": ("<article><p>one<b>two</b> <i>three</i><!-- no --><a href=x> four</a></p></article>", ["onetwo three four"]),
    "cut": (f"<html><body><article><p><b>{LONG}<br><p>end", [LONG, "end"]),
    "cookie": (f"<body><div class='cookie-notice'><p>{LONG}</p></div><article><p>{LONG}</p><div class='ad-slot'>Buy</div></article>", [LONG]),
    "hidden": (f"<article><p hidden>no</p><p>{LONG}</p><p style='display:none'>no</p></article>", [LONG]),
    "teasers": (f"<main><article><p>{LONG} {LONG}</p></article><article><p>short one</p></article></main>", [f"{LONG} {LONG}"]),
    "comments": (f"<article><p>{LONG}</p></article><section id=comments><article><p>{LONG} {LONG}</p></article></section>", [LONG]),
    "sidebar": (f"<main><p>{LONG}</p></main><div class='site-sidebar'><article><p>{LONG} {LONG}</p></article></div>", [LONG]),
    "menu never closed": (f"<nav>menu<article><p>{LONG}</p></article>", [LONG]),
    "wrapped middle": (f"<body><div class=menu><a href=x>a</a></div><div id=content><p>Intro of it.</p><div class=wrap>{f'<p>{LONG}</p>' * 9}"
                       "</div><p>Closing of it.</p></div></body>", ["Intro of it.", *[LONG] * 9, "Closing of it."]),
    "wrapped section": (f"<div id=content><h1>T</h1><p>Intro.</p><section>{f'<p>{LONG}</p>' * 5}</section><p>Closing.</p></div>",
                        ["T", "Intro.", *[LONG] * 5, "Closing."]),
    "sections": (f"<body><nav>n</nav><section><p>{LONG}</p></section><section>{f'<p>{LONG}</p>' * 8}</section><section><p>{LONG}</p></section></body>",
                 [LONG] * 10),
    "closing with a link": (f"<div id=content><h1>T</h1>{f'<p>{LONG}</p>' * 3}<p>See <a href=x>there</a> for more of this.</p><p>The end.</p></div>",
                            ["T", *[LONG] * 3, "See there for more of this.", "The end."]),
    "links end it": (f"<body><div>{f'<p>{LONG}</p>' * 3}<ul><li><a href=x>one thing</a></li><li><a href=y>other</a></li></ul></div></body>", [LONG] * 3),
    "discussion": (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG} {LONG}</p></section></article>",
                   [LONG, f"{LONG} {LONG}"]),
    "search": (f"<article><p>{LONG}</p><div id=search><p>{LONG}</p></div></article>", [LONG, LONG]),
    "compounds": (f"<article><p>{LONG}</p><div class=related-work><h2>Related work</h2><p>{LONG}</p></div><div class='social-history'>"
                  f"<p>{LONG}</p></div><div class=related-posts><p>{LONG}</p></div><div class='td-related'><p>{LONG}</p></div>"
                  f"<div class='acme-sidebar-x'><p>{LONG}</p></div><section id=ad-hoc><p>{LONG}</p></section></article>",
                  [LONG, "Related work", LONG, LONG, LONG]),
    "advert paragraph": (f"<article><p>{LONG}</p><p class=advert>{LONG}</p><p class='sponsored'>Buy!</p><p>a <span class=ad>Buy <b>it</b></span> b</p></article>",
                         [LONG, "a b"]),
    "advert never closed": (f"<article><p>{LONG} <span class=ad>Buy</p><p>{LONG}</p></article>", [LONG, LONG]),
    "slogan": (f"<body><div class=top><p>Our little site</p></div><div class=a><ul><li><a>x</a><li><a>y</a></ul></div><div class=body><p>{LONG}</p><p>{LONG}</p></div></body>",
               [LONG, LONG]),
    "list items": (f"<ul><li>{LONG}<li>{LONG}</ul>", [LONG, LONG]),
    "only menu": ("<nav><a>x</a></nav>", []),
    "empty": ("", []),
    "blank": (" \n ", []),
    "plain": ("just text", ["just text"]),
    "broken": ("<<p <a href='><article", None),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, blocks = CASES[name]
    text = main_text(page)
    if blocks is not None:
        assert text == "\n\n".join(blocks)


def test_rows(spark):
    pages = [p for p, _ in CASES.values()] + [None, f"<article><p>{'long ' * 50_000}</p></article>"]
    df = documents(spark, pages, [None if k == 2 else 1 for k in range(len(pages))])
    df = df.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "'clash' AS text", "3 AS n_chars")
    rows = extract(df.repartition(3)).collect()
    assert len(rows) == len(pages) and all(row.n_chars == len(row.text) for row in rows)
    assert sorted(row.text for row in rows) == sorted(main_text(page or "") for page in pages)
    assert extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The given pages have one article each; its blocks read with patterns must be the text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {}
    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", re.sub(r"<br>", " ", inner)))
        blocks = [" ".join(entities.unescape(block).split()) for block in blocks]
        expected[row.page_id] = "\n\n".join(block for block in blocks if block)
    found = {row.page_id: row.text for row in extract(pages).collect()}
    assert found == expected


def test_deep_and_broken_nesting_is_linear():
    import time

    started = time.perf_counter()
    for page in (
        "<div>" * 100_000 + LONG,
        "<div>" * 50_000 + "</section>" * 50_000 + LONG,
        "<ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000 + LONG,
        f"<p>{LONG}" * 20_000,
        "<span class=ad>" * 50_000 + "<p>" + LONG,
    ):
        assert LONG in main_text(page)
    assert time.perf_counter() - started < 40


def generated(rng):
    """A page without an article element, and the blocks of its text."""
    words = "so it was that of the old house no one knew when they had come by day and left again for good".split()

    def sentence(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    def links(n):
        return "<ul>" + "".join(f"<li><a href=/{k}>{' '.join(rng.choices(words, k=2))}</a></li>" for k in range(n)) + "</ul>"

    blocks, parts = [sentence(5)], []
    parts.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(3, 9)):
        if rng.random() < 0.3:
            text = sentence(rng.randint(2, 4))
            blocks.append(text)
            parts.append(f"<p>{text}</p>")
        if rng.random() < 0.2:
            parts.append(f"<p class='{rng.choice(['ad', 'sponsored', 'ad-slot'])}'>{sentence(9)}</p>")
        text = sentence(rng.randint(30, 60))
        blocks.append(text)
        at = text.index(" ", 20)
        linked = text[:at] + f"<a href=x>{text[at : at + 9]}</a>" + text[at + 9 :] if rng.random() < 0.3 else text
        parts.append(f"<p>{linked}</p>")
    text = sentence(6)
    blocks.append(text)
    parts.append(f"<p>{text}</p>")
    if rng.random() < 0.5:
        low, high = sorted(rng.sample(range(len(parts) + 1), 2))
        parts[low:high] = [f"<{tag}>{''.join(parts[low:high])}</{tag}>" for tag in [rng.choice(["div", "section", "blockquote"])]]
    content = f"<div class={rng.choice(['content', 'post', 'entry-text'])}>{''.join(parts)}</div>"
    before = rng.choice(["<nav>%s</nav>", "<div class=top-menu>%s</div>", "<div>%s</div>"]) % links(6)
    after = rng.choice(["<footer>%s</footer>", "<div id=footer>%s</div>", "<div class='related-posts'>%s</div>", "<div class=comments>%s</div>"])
    after %= rng.choice([links(5), f"<p>{sentence(40)}</p>"])
    return f"<html><body>{before}{content}{after}</body></html>", blocks


def test_pages_without_an_article():
    import random

    rng = random.Random(12)
    pages = [generated(rng) for _ in range(300)]
    wrong = [page for page, blocks in pages if main_text(page) != "\n\n".join(blocks)]
    assert not wrong, (len(wrong), wrong[0])


def test_clusters():
    assert threshold([1.0, 1.0, 9.0, 11.0]) == pytest.approx(5.5)
    assert threshold([3.0, 3.0]) == 3.0
    assert smoothed([4.0]) == [4.0] and smoothed([0.0, 9.0, 0.0])[1] < 9
