import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from loresift.llm import html
from loresift.llm.html import AROUND, ARTICLE, DEPTH, LOOSE, PAGES, blocks, main_text, suffix_runs

NOTICE = "this site is run by the same people who wrote this very notice for every page"


def kept(page):
    return [t for t, sort in blocks(page) if sort != AROUND]


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x(0<1);</script></head><body>
    <nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head &lt;1&gt;</h1>
    <p><b>First
    para</b>graph.<br><p>Caf&eacute;&nbsp;&#8364; <a href="#">link</a> text.</p><aside>Side</aside><div class="comments"><article><p>Nice!</p></article></div>
    <form><p>Mail</p></form></article><footer>&copy; host</footer>"""
    assert kept(page) == ["Head <1>", "First paragraph.", "Café € link text."]
    assert [t for t, sort in blocks(page) if sort == AROUND] == ["Menu", "Buy", "Side", "Nice!", "Mail", "© host"]


def test_article_headings_and_sections_stay_whatever_their_ids():
    page = """<article class="post"><div class="post-header"><h1>Title</h1></div><h2 id="search-history">History of search</h2>
    <section id="legal-notice-law"><p>On the law.</p></section><p class="alert-level">Level</p><table class="widget"><tr><td>cell</td></tr></table>
    <div class="banner"><h1>Also a title</h1></div><div class="comment-list"><p>I disagree</p></div><div class="ad">Buy</div></article>"""
    assert kept(page) == ["Title", "History of search", "On the law.", "Level", "cell", "Also a title"]
    assert dict(blocks(page))["Title"] == LOOSE and dict(blocks(page))["Level"] == ARTICLE


def test_open_page_and_missing_end_tags():
    page = "<body class='has-sidebar'><div class=cookie-notice>Cookies?<div class='content'><p>Text one<p>Text two<div role=navigation>go</div><ul class=menu><li>m</ul>"
    assert kept(page) == ["Text one", "Text two"]
    assert blocks("") == []
    assert blocks("plain < text & more") == [("plain < text & more", LOOSE)]
    assert kept("<p>cut <script>never ends") == ["cut"]
    assert kept("<p>a<main><p>b</main>c") == ["b"]


@given(st.lists(st.text("ab", max_size=30), max_size=6), st.integers(1, 5))
def test_suffix_runs_by_definition(texts, depth):
    expected = sorted(len({k for k, t in enumerate(texts) if g in t}) for g in {t[i : i + depth] for t in texts for i in range(len(t) - depth + 1)})
    tokens = np.array([ord(c) for t in texts for c in t], np.uint64)
    hashes, pages = suffix_runs(tokens, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]), depth)
    assert sorted(pages.tolist()) == expected and len(set(hashes.tolist())) == len(expected)


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    rows = [(i, "http://a.example/%d" % i, f"<div><p>own words of page {i}</p><p>{NOTICE}</p></div>", 1) for i in range(6)]
    rows += [(10, "http://b.example/1", f"<p>{NOTICE}</p>", 1), (11, None, None, 1), (12, "http://a.example/9", "", 1), (None, "x", "<p>y</p>", 1)]
    rows += [(20 + i, "http://c.example/", f"<article><p>{NOTICE}</p><p>{i}</p></article>", 1) for i in range(6)]
    rows += [(30 + i, "http://d.example/", f"<article><p>page {i}</p><div class='tail'>{NOTICE} {i}</div></article>", 1) for i in range(6)]
    rows += [(40 + i, "http://e.example/", f"<main><p>page {i}</p><p>{NOTICE}</p></main>", 1) for i in range(6)]
    rows += rows[:1]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(6):
        assert got[i][0] == f"own words of page {i}"
        assert got[20 + i][0] == f"{NOTICE}\n{i}"
        assert got[30 + i][0] == f"page {i}\n{i}"
        assert got[40 + i][0] == f"page {i}"
    assert got[10] == (NOTICE, len(NOTICE)) and got[11] == ("", 0) and got[12] == ("", 0) and got[None] == ("y", 1)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("shard", [html.SHARD, 2_000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(html, "SHARD", shard)
    rng = random.Random(5)
    shared = [" ".join(f"s{k}w{j}" for j in range(rng.randrange(8, 30))) for k in range(8)]
    pages = []
    for i in range(120):
        parts = [" ".join(f"p{i}w{j}" for j in range(rng.randrange(1, 40)))] + rng.sample(shared, rng.randrange(4)) + [shared[rng.randrange(3)][:40]]
        rng.shuffle(parts)
        pages.append((i, f"http://h{rng.choice('aaaab')}.example/{i}", parts))
    pages += [(200 + i, *pages[0][1:]) for i in range(10)]
    counts = Counter()
    for host, parts in {(p[1][8], tuple(p[2])) for p in pages}:
        words = " ".join(parts).split()
        counts.update({(host, *words[i : i + DEPTH]) for i in range(len(words) - DEPTH + 1)})
    expected = {}
    for page_id, url, parts in pages:
        words, covered = " ".join(parts).split(), set()
        for i in range(len(words) - DEPTH + 1):
            if counts[(url[8], *words[i : i + DEPTH])] >= PAGES:
                covered.update(range(i, i + DEPTH))
        at, out = 0, []
        for p in parts:
            n = len(p.split())
            out.append(" ".join(w for k, w in enumerate(p.split(), at) if k not in covered))
            at += n
        expected[page_id] = "\n".join(x for x in out if x) or "\n".join(parts)
    rows = [(i, url, "".join(f"<p>{p}</p>" for p in parts)) for i, url, parts in pages]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_copies_of_an_open_page_keep_their_text(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(i, f"http://a.example/{i}", f"<p>{text}</p>") for i in range(5)] + [(5 + i, None, f"<p>{text}</p>") for i in range(5)]
    rows += [(20 + i, f"http://b.example/{i}", f"<p>{f'own{i}' if i else ''}</p><p>{NOTICE}</p>") for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [text] * 10
    assert got[20] == NOTICE and got[22] == "own2"


def test_long_page():
    assert len(blocks("<article>" + "<p>some words &amp; more</p>" * 20_000 + "</article>")) == 20_000
