import pytest

from sightline.llm import htmltext as H

ART = "<h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;text, and then some more words here.<p>Second<br>one\n is here as well, with a <a href='/x'>link</a>.</p><ul><li>Item<li>Other</ul>"
WANT = "Title & more First bold text, and then some more words here. Second one is here as well, with a link. Item Other"

PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article>{ART}</article><footer>f</footer></body></html>", WANT),
    (f"<body><header class=site><h1>Site</h1></header><main><div class='content'>{ART}<form><p>Your name</p></form></div><aside>side</aside><section id=comments><p>nice post, really good</p></section></main></body>", WANT),
    (f"<div id='cookie-notice'>We use cookies on this page</div><div class='page'><div class='sidebar'><p>links and more links</p></div><div class='text'>{ART}</div></div>", WANT),
    (f"<article>{ART}<div class='related'><p>Read this too</p></div><div role=complementary>x</div><!-- <p>no</p> -->", WANT),
    ("", ""),
    ("<html><body><nav>only a menu</nav></body></html>", ""),
    ("just &lt;text&gt;", "just <text>"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    (f"<nav>m</nav><div id='main' class='has-sidebar'>{ART}</div>", WANT),
    (f"<nav>m</nav><article class='post tag-search'>{ART}</article>", WANT),
    (f"<body><form action=/><div>{ART}</div><input name=state></form></body>", WANT),
    ("<p>The firm has a large <span class='share'>market share</span> in this country, as all know.</p>", "The firm has a large market share in this country, as all know."),
    (f"<article>{ART}<p><span class='share'>Share <b>this</b></span></p></article><section class=comments>" + "<article class=comment><p>a long reader comment that says much more than the text itself does</p></article>" * 9 + "</section>", WANT),
    (f"<div class='page-banner'><main>{ART}</main></div>", WANT),
    ("<p hidden>no</p><p>yes there is a line</p></div></div>", "yes there is a line"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert H.main_text(html) == want


def test_ratio_picks_the_text_region_without_marks():
    links = "".join(f"<div><a href=/{i}>l{i}</a> <a href=/>m</a> <a href=/>n</a></div>" for i in range(12))
    text = "".join(f"<p>{'words of the story go on and on here ' * 4}{i}</p>" for i in range(6))
    got = H.main_text(f"<body><div>{links}</div><div><h2>Head</h2>{text}</div><div>{links}</div></body>")
    assert got.startswith("Head words") and got.endswith("5") and "l3" not in got


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(H.smoothed(np.full(7, 3.0)), 3) and len(H.smoothed(np.array([1.0]))) == 1


def test_query_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>" + "long text " * 50000, "x"), (3, "u", "<div>" * 20000 + "deep", "x"), (4, "u", "<" * 3000, "x")]
    got = [tuple(r) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert [(r[0], r[3]) for r in got[:4]] == [(1, 0), (2, 0), (3, 499999), (3, 4)] and all(len(r[2]) == r[3] for r in got)
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
