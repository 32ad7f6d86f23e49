from __future__ import annotations

import hashlib
import html
import itertools
import random
import re

import pytest

from causal_panel.llm import htmltext, urlrules, warc
from causal_panel.llm.queries import SQL, URL_RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def odd_pages(spark):
    same, small = "<p>" + "same payload " * 20 + "</p>", "<p>small</p>"
    rows = [(5, "http://A.COM/x", same, 1), (3, None, same, 2), (3, "no scheme", same, 2), (7, "https://b.net/es/?q", None, 3), (8, "x://", "", 4), (9, "h://a\r\nb/", small, 5), (10, "", small, 6), (None, None, same, 7)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_minimum_cut_is_minimal():
    draw = random.Random(4)
    for _ in range(150):
        n = draw.randrange(1, 8)
        scores = [draw.randrange(-50, 51) / 10 for _ in range(n)]
        edges = [(a, b, draw.randrange(0, 30) / 10) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(side, scores=scores, edges=edges):
            return sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert abs(cost(htmltext.minimum_cut(scores, edges)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-9


def test_articles(pages):
    found = {r.page_id: r for r in htmltext.extract_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert found[r.page_id].text == "\n".join(x for x in blocks if x)
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


PAGE = """<html><head><title>T</title><script>if (a < b) { document.write("<p>no</p>") }</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href="/b>c">News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to all of them now.</div>
<main><article><h1>A  title &amp; more</h1><p>First paragraph with a <b>bold</b> word&hellip;<br>and a line.
<div class="ad">Buy this now, a very long advertisement text that goes on and on for a while.</div>
<p>Short.<p>Second &lt;paragraph&gt; of the text which is long enough.<ul><li>One item<li>Another item</ul>
<form><input name=q><button>Send</button> Leave your address here</form></article>
<section id="comments"><p>Great article, thank you so much for writing all of this down for us!</p></section></main>
<aside>Other stories that you may want to read today</aside><footer>&copy; 2020 Site, all rights reserved.</footer></body>"""


def test_boilerplate():
    assert htmltext.main_text(PAGE) == (
        "A title & more\nFirst paragraph with a bold word… and a line.\nShort.\nSecond <paragraph> of the text which is long enough.\nOne item\nAnother item")


LONG = "A sentence of the article which is long enough to be told as such. " * 4


@pytest.mark.parametrize(("page", "wanted"), [
    ("<div>Hi all</div>", "Hi all"),
    (f'<div class="article-header"><h1>Title</h1></div><article><p>{LONG}</p></article>', f"Title\n{LONG.strip()}"),
    (f'<header class="entry-header"><h1>Title</h1></header><article><p>{LONG}</p></article>', f"Title\n{LONG.strip()}"),
    (f'<body><form id="form1"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></form></body>', f"Title\n{LONG.strip()}\n{LONG.strip()}"),
    (f'<body class="no-sidebar single-post"><article><p>{LONG}</p></article></body>', LONG.strip()),
    (f'<body class="with-header has-comments"><article><p>{LONG}</p></article></body>', LONG.strip()),
    (f'<body class="sidebar"><p>{LONG}</p></body>', LONG.strip()),
    (f'<div class="social-science"><p>{LONG}</p></div>', LONG.strip()),
    (f'<article><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', f"{LONG.strip()}\nRelated work\n{LONG.strip()}"),
    (f'<div class="site-sidebar-wrapper"><main><p>{LONG}</p></main><div class="sidebar">Other stories of today that are here</div></div>', LONG.strip()),
    (f'<main><p>{LONG}</p></main><div class="related-posts"><article><p>A teaser of another story</p></article></div><div class="social links">Follow us</div>', LONG.strip()),
    (f'<main><p>{LONG}</p><form class="search-form">Search the site for it</form><div class="post-comments"><p>What a fine text this is, thank you</p></div></main>', LONG.strip()),
])
def test_names_are_weighed_by_element(page, wanted):
    assert htmltext.main_text(page) == wanted


def test_odd_html(odd_pages, spark):
    found = htmltext.extract_text(odd_pages).collect()
    assert len(found) == 8 and sorted(r.n_chars for r in found)[:2] == [0, 0]
    assert htmltext.extract_text(odd_pages.filter("false")).collect() == []
    for broken in ("<", "<p", "<p class='", "<p><p><", "<!--", "<script>", "a<b>c", "</p></div>x", "<div " + "a" * 10_000 + "'", "<b" * 5_000, "<p>" * 3_000 + "deep"):
        assert isinstance(htmltext.main_text(broken), str)
    assert len(htmltext.main_text("<article>" + "<p>A sentence that is part of it.</p>" * 3000).split("\n")) == 3000


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m[1].lower(), m[2]
    fits = [(h.count("."), len(p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else ("allow", None)))


def test_urls(pages, odd_pages, spark):
    more = spark.createDataFrame([(k, u) for k, u in enumerate((
        "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/1", "http://www.example.com/en/x?/y", "http://com/", "http://com", "http://a.b.NET/fr/", "http://net/frx",
        "http://www.example.com/fr/#/en/", "http://.com/a", "http://www.www.example.com/en/a://b", "http://u@example.com:80/en/"))], "page_id long, url string")
    for frame in (pages, odd_pages, more):
        found = sorted((str(r.page_id), r.host, r.path, r.verdict, r.rule) for r in urlrules.judge_urls(frame, URL_RULES).collect())
        assert list(map(str, found)) == sorted(map(str, ((str(r.page_id), *slow_verdict(r.url)) for r in frame.collect())))
    assert urlrules.judge_urls(odd_pages.filter("false"), URL_RULES).collect() == []
    trie = urlrules.build_trie([("allow", "a.org", "/x"), ("block", "a.org", "/xy/z"), ("block", "a.org", "/x"), ("allow", "org", "/x/y/")])
    assert [urlrules.longest(trie, "b.a.org", p) for p in ("/xyz", "/xy/zz", "/y")] == [("block", "a.org/x"), ("block", "a.org/xy/z"), (None, None)]
    assert urlrules.longest(trie, "c.org", "/x/y/z") == ("allow", "org/x/y/")


def test_joined_rules_decide_like_the_trie(pages, odd_pages, spark):
    rules = URL_RULES + [("block", "COM", "/a"), ("allow", "com", "/a"), ("block", "com", "/a/b/"), ("allow", "b.com", ""), ("block", "", "/x"), ("allow", "net", "/fr/page"), ("block", "example.com", "/en/a")]
    more = spark.createDataFrame([(k, u) for k, u in enumerate((
        "http://b.com/a/b/c", "http://c.b.com", "http://b.com/a/", "http://q.com/ab", "http://net/fr/page-1", "http://x./xy", "http:///x", "http://www.example.com/en/abc", "http://example.com/en/abc", "http://q.com/a/b", None, ""))], "page_id long, url string")
    for frame in (pages, odd_pages, more):
        one, two = (sorted(map(str, urlrules.judge_urls(frame, rules, most_rules=n).collect())) for n in (100, 0))
        assert one == two
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted(map(str, urlrules.judge_urls(more, table).collect())) == two


def test_archive_round_trip(spark, pages, odd_pages):
    for frame in (pages.unionByName(pages.selectExpr("page_id + 5000 AS page_id", "url", "html")), odd_pages, odd_pages.filter("false")):
        archive = warc.write_archive(frame)
        rows = frame.collect()
        records = warc.read_archive(spark, archive).collect()
        assert sorted((str(r.page_id), bytes(r.payload)) for r in records) == sorted((str(r.page_id), (r.html or "").encode()) for r in rows)
        for r in records:
            head, block = bytes(r.record).split(b"\r\n\r\n", 1)
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and block == (b"" if b"WARC-Type: revisit" in head else bytes(r.payload)) + b"\r\n\r\n" and len(block) == length + 4
        stored = spark.read.parquet(archive.payloads).collect()
        assert len({r.digest for r in stored}) == len(stored) == len({r.html or "" for r in rows})
        assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest for r in stored)
    first = {}
    for r in odd_pages.collect():
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    for r in warc.read_index(spark, warc.write_archive(odd_pages)).collect():
        if r.payload_bytes >= 100:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == 3 else ("revisit", 3))
        else:
            assert (r.record_type, r.refers_to) == ("response", None)


def test_damaged_payload_fails(spark, pages):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from causal_panel.llm.common import scratch
    archive = warc.write_archive(pages)
    other = scratch(spark, "damaged")
    spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(other)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_index(spark, replace(archive, payloads=other)).collect()


@pytest.mark.parametrize("key", ["op6_urls", "op10_warc"])
def test_sql_twins(spark, key):
    import duckdb

    from causal_panel.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    frame = QUERIES[key](spark, SF)
    found = con.execute(SQL[key])
    names = [d[0] for d in found.description]
    assert sorted(map(str, map(tuple, frame.select(*names).collect()))) == sorted(map(str, found.fetchall())) and len(names) == len(frame.columns)


@pytest.mark.parametrize("tag", ["<svg viewBox='0 0 1 1' />", '<svg class="i"/>', "<svg/>", "<svg hidden/>", "<svg>", "<object>", "<canvas>", "<noscript>", "<iframe>", "<template>", "<math/>", "<svg width=1/><path/></svg>"])
def test_skipped_elements_end(tag):
    page = "<body><article><p>The first paragraph of an article, long enough to count.</p>{}<p>The second paragraph of it, which is as long.</p></article></body>"
    assert htmltext.main_text(page.format(tag)) == htmltext.main_text(page.format(""))


def test_skipped_text():
    page = "<body><article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> in this paragraph of an article, <svg><text>icon</text></svg>as is well known.</p></article>"
    assert htmltext.main_text(page) == "Energy is E=mc in this paragraph of an article, as is well known."
    assert "no" not in htmltext.main_text("<article><p>A paragraph that is part of it all.</p><script>no text")
    assert len(htmltext.main_text("<article>" + "<canvas><p>A sentence that is part of it.</p>" * 3000).split("\n")) == 3000
