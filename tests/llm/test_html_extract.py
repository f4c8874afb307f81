"""Extraction by the site style tree, on pages made here: what repeats on a site goes, articles stay whole."""

import math
import random
from collections import Counter

import pytest

from tessera.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, low int, n_chars string"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, 4, "old") for i, u, h in rows], SCHEMA)
    got = he.extract(df).collect()
    assert all(r["low"] == 4 for r in got)
    return sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got)


def test_boilerplate_without_telling_names_goes(spark):
    rng = random.Random(8)
    body = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60))
    texts = [[body(), body()] for _ in range(40)]
    page = lambda t: f"<html><head><title>x</title></head><body><div class=top><div>Home</div><div>Contact us today</div></div><div class=text><p>{t[0]}</p><p>{t[1]}</p></div><div class=end>All rights reserved</div></body></html>"
    got = run(spark, [(i, f"https://one.example/{i}", page(t)) for i, t in enumerate(texts)])
    assert got == sorted((str(i), "\n".join(t), len("\n".join(t))) for i, t in enumerate(texts))


CASES = [
    ("<article><h1>A&amp;B</h1><p>x  \n y<br>z &#233;&hellip;</p></article>", "A&B\nx y z é…"),
    ("<main><p>one<p>two<ul><li>a<li>b</ul></main>", "one\ntwo\na\nb"),
    ("<nav>menu</nav><p>text</p><footer>foot</footer><aside>side</aside>", "text"),
    ("<p>a<b>bold</b> <i>it</i>alic</p><!-- no --><script>var x='<p>no</p>'</script><style>p{}</style>", "abold italic"),
    ("<form><p>no</p></form><div class='comments'><p>no</p></div><div id=cookie-notice>no</div><p>yes</p>", "yes"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("plain &lt;text&gt; < 3", "plain <text> < 3"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<body class='page has-sidebar'><div class='page no-comments'><p>a</p></div><div class='ad-free'>b</div></body>", "a\nb"),
    ("<article class='post share-enabled'><div class='post-header'><h1>Head</h1></div><p>text</p><footer>f</footer></article>", "Head\ntext"),
    ("<div class='site-footer'>no</div><div class='left-sidebar'>no</div><ul class=main_nav><li>no</ul><p>yes</p>", "yes"),
    ("<article><p>a <svg/> b <svg><text>no</text></svg>c</p><p>x <math><mi>y</mi></math></p></article>", "a b c\nx y"),
    ("<p>before</p><select><p>after", "before\nafter"),
    ("<p>a<script>unclosed <p>b", "a"),
    ("", ""),
    (None, ""),
    ("<div><div><div></div>", ""),
    ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()),
]


def test_pages_of_hosts_seen_once(spark):
    rows = [(i, f"http://h{i}.example/a", h) for i, (h, _) in enumerate(CASES)]
    assert run(spark, rows) == sorted((str(i), t, len(t)) for i, (_, t) in enumerate(CASES))


def test_null_and_odd_urls_repeated_rows(spark):
    rows = [(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "not a url", "<p>b</p>"), (2, "", "<p>c</p>")]
    assert run(spark, rows) == [("1", "a", 1), ("1", "a", 1), ("2", "c", 1), ("None", "b", 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_importance_is_entropy(spark):
    rng = random.Random(2)
    rows = [("h", rng.randrange(3), 0, rng.randrange(4)) for _ in range(200)]
    counts = Counter(rows)
    df = spark.createDataFrame([(*r, n) for r, n in counts.items()], "host string, path long, kind int, feature long, n long")
    got = {r["path"]: r["importance"] for r in he.importance(df, ["path"]).collect()}
    for p in range(3):
        c = [n for r, n in counts.items() if r[1] == p]
        m = sum(c)
        assert got[p] == pytest.approx(-sum(n / m * math.log(n / m) for n in c) / math.log(m))


def test_deep_nesting_is_linear():
    import time

    began = time.time()
    page = he.read_page("<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>end" + "</b>" * 100_000)
    assert [w for _, w in page.blocks] == ["deep", "end"] and time.time() - began < 20


def test_repeated_box_in_an_article_goes_by_entropy(spark):
    page = lambda k: f"<article><h1>Title {k}</h1><p>story number {k} is told here</p><div class=author-box>Written by our editors.</div></article>"
    got = run(spark, [(k, f"https://two.example/{k}", page(k)) for k in range(30)])
    assert got == sorted((str(k), t, len(t)) for k in range(30) for t in [f"Title {k}\nstory number {k} is told here"])
