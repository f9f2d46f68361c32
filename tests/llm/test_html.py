from __future__ import annotations

import html
import random
import re
import time

import pytest

from lexigrain.llm import html_text, queries

DIR = "/root/testdata/sf0.01"
TIMES = "It was the best of times, and it was the worst of times for all of us. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three<p>Four</article><footer>&copy; x</footer>", "T & U\nOne two three\nFour"),
        ('<script>var t="</p>";</script><style>p{}</style><article><p>Text<!-- no --></p><div class="ad">Buy</div><aside>More</aside></article>', "Text"),
        ("<p>Only short", "Only short"),
        ("<div class=sidebar><p>This is a long text of the kind that is in the way of the reader, and it is not for the article at all.</p></div><p>It was the best of times, it was the worst of times.</p>", "It was the best of times, it was the worst of times."),
        ("<form><p>The name of the user and the rest of it, which is to be put in here</p></form><p>The article is in here and it has to be found.</p><p>Yes.</p><div id='comments'><p>I think that this is the best of all.</p></div>", "The article is in here and it has to be found.\nYes."),
        ("<div class='post has-sidebar'><p>It was the best of times, and it was the worst of times for all of us.</p></div><div class='post-comments'><p>That is what it was, and it is of no use to me.</p></div>", "It was the best of times, and it was the worst of times for all of us."),
        ("<article><p>a < b &lt;c&gt; &#233;&nbsp;x</p><p title='a>b'>q</article>", "a < b <c> é x\nq"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class=post><p>{TIMES}</div><article class=teaser><p>Read the other story.", [TIMES.strip()]),
        ('<p data-grid="share">Some text.', ["Some text."]),
        (f'<p title="class=ad">{TIMES}<p data-class="menu">It is.', [TIMES.strip(), "It is."]),
        (f"<div class=notice-board><p>We close.</div><div>We close at noon.</div><article><p>{TIMES}<p>Yes.</article>", [TIMES.strip(), "Yes."]),
        (f"<article><p>{TIMES}</article><div>{'This is what the site says to all of its readers. ' * 3}</div>", [TIMES.strip()]),
        (f"<article><h1>Title</h1><p>{TIMES}</p><section class=comments><p>{TIMES}</section></article>", ["Title", TIMES.strip()]),
        ("<nav><a href=/>x</a></nav><h2>About</h2><p>It is the page of the people who are at the mill.<p>Tom<p>Ann</p><footer>f</footer>", ["About", "It is the page of the people who are at the mill.", "Tom", "Ann"]),
        ("a<title>t</title><p>b <svg><text>no</text></svg>c<svg>d", ["a", "b c d"]),
        ("x<!-- > --> y <![CDATA[z]]> <3 </> w <b", ["x y <3 w <b"]),
    ],
)
def test_by_density_and_neighbours(page, want):
    assert html_text.main_text(page).split("\n") == want


def page_of(rng):
    """A random page without odd markup, as (markup, blocks as (text, linked characters, heading, article, boilerplate))."""
    words = "the of and it is was to in cat mill stone river paints seven quick old tower".split()
    out, want = ["<html><body>"], []
    article = False
    for _ in range(rng.randint(0, 14)):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 9, 40])))
        kind = rng.choice(["p", "p", "p", "h2", "nav", "footer", "link", "edge"])
        if kind == "edge":
            out.append("</article>" if article else "<article>")
            article = not article
            continue
        tag, linked = ("p", len(text)) if kind == "link" else (kind, 0)
        out.append(f"<{tag}><a href='/x'>{text}</a></{tag}>" if linked else f"<{tag}>{text}</{tag}>")
        want.append((text, linked, tag == "h2", article, tag in ("nav", "footer")))
    return "".join(out), want


def labelled_by_looking_at_all(found):
    """The rules written out: every block looks at every other."""
    first = []
    for text, linked, _, _, boiler in found:
        words = re.findall(r"[a-z]+", text)
        share = sum(w in html_text.STOP_WORDS for w in words) / len(words)
        long = len(text) >= 140
        first.append(False if boiler or linked > 0.4 * len(text) else True if (long and share >= 0.08) or (len(words) >= 8 and share >= 0.2) else None)
    size = lambda side: sum(len(b[0]) for b, x in zip(found, first, strict=True) if x and b[3] is side)
    if size(True) > size(False):
        first = [x if b[3] else False for b, x in zip(found, first, strict=True)]
    out = []
    for k, b in enumerate(found):
        near = sorted((abs(j - k), j) for j, x in enumerate(first) if x is not None and found[j][3] is b[3])
        near = [x for x in near if not found[x[1]][4]] or near
        if first[k] is not None:
            out.append(first[k])
        elif not near:
            out.append(None)
        elif b[2] and any(j > k for _, j in near):
            out.append(first[min(j for _, j in near if j > k)])
        else:
            out.append(any(first[j] for d, j in near if d == near[0][0]))
    some = any(out)
    out = [(b[3] or not some) if x is None else x for b, x in zip(found, out, strict=True)]
    return out if any(out) else [not b[4] and b[1] <= 0.4 * len(b[0]) for b in found]


def test_rules_as_written_out():
    rng, by_pass = random.Random(2), [0, 0]
    for _ in range(1500):
        page, want = page_of(rng)
        found = html_text.blocks(page)
        assert [(b.text, b.link_chars, b.heading, b.article, b.boilerplate) for b in found] == want
        first = [html_text.decide(b) for b in found]
        assert [b.label for b in html_text.classify(found)] == labelled_by_looking_at_all(want), page
        by_pass[0] += sum(x is not None and not b.boilerplate for x, b in zip(first, found, strict=True))
        by_pass[1] += first.count(None)
    assert min(by_pass) > 1000


@pytest.mark.parametrize(
    "page",
    ["<a " + '"a" ' * 100_000, '<a x=">" ' * 100_000, "<![CDATA[" * 100_000, "<svg>" * 100_000, "<p title=a" + "'" * 100_000 + ">", "<a " * 100_000 + ">", "<div>" * 50_000 + "</p>" * 50_000, '<p class="' + "a-" * 100_000 + '">x', "<!--" * 100_000],
    ids=range(9),
)
def test_no_markup_is_slow(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 2


def test_query_against_the_articles(spark):
    """The tables' pages have one article each, whose every block is main text: cut out plainly, it is what the query gives."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()

    def plainly(page):
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        found = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        return "\n".join(x for x in found if x)

    want = {r.page_id: (r.url, plainly(r.html)) for r in pages}
    got = {r.page_id: (r.url, r.text) for r in queries.op8_html_text(spark, DIR).collect()}
    assert got == want
    labels = [html_text.decide(b) for r in pages for b in html_text.blocks(r.html) if not b.boilerplate]
    assert labels.count(True) > 100 and labels.count(None) > 100


def test_extract(spark):
    rows = [(1, "u", None), (1, "u", "<p>hi"), (None, None, "<article><p>" + "x y " * 50_000)]
    got = html_text.extract(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(((r.page_id, r.text[:5], r.n_chars) for r in got), key=repr) == sorted([(1, "", 0), (1, "hi", 2), (None, "x y x", 199_999)], key=repr)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
