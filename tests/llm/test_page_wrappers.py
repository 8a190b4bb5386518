import pytest

from factloom.llm import html_extract

PARTS = [f"Sentence {i} of the article says something at length, so that it is a usual paragraph of a page." for i in range(4)]
ARTICLE = "<article>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</article>"
NAV = '<ul class="navbar"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul>'
RELATED = '<div class="related"><article><p>A teaser of another page.</p></article></div>'
WRAPPED = [
    f'<html><body class="has-sidebar">{NAV}{ARTICLE}{RELATED}</body></html>',
    f'<html class="cookie-consent"><body><div class="page with-navbar">{NAV}{ARTICLE}{RELATED}</div></body></html>',
    f'<body><div class="comments-open"><main class="has-sidebar">{ARTICLE}</main></div>{RELATED}</body>',
]


@pytest.mark.parametrize("page", WRAPPED)
def test_names_of_wrappers_do_not_hide_the_article(page):
    found = html_extract.blocks(page)
    assert [b.text for b, label in zip(found, html_extract.taught(found)) if label] == PARTS
    assert html_extract.main_text(page, html_extract.Chain()) == " ".join(PARTS)


def test_only_pages_that_teach_count_for_the_sample(spark):
    plain = "<div class='zzz'><p>No part is named here.</p></div>"
    pages = spark.createDataFrame([(i, "u", WRAPPED[1] if i % 40 == 0 else plain if i % 3 else None) for i in range(400)], "page_id long, url string, html string")
    few = html_extract.fit(pages.filter("page_id % 40 = 0"), most=10)
    assert html_extract.fit(pages, most=10) == few and few != html_extract.EXPECT


BODY = "".join(f"<p>{p}</p>" for p in PARTS)
MENU = '<ul class="nav"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>'
FOOT = '<div class="footer"><p>Imprint and contact of the paper.</p></div>'
SIDE = '<div class="sidebar"><p>Read more in the archive of the paper.</p></div>'
TALK = '<div class="comments"><p>A reader says that this is quite wrong, and says it at some length.</p></div>'
#: Pages by hand: what stands round the article's paragraphs (%s) in usual templates.
SHAPES = [
    "%s",
    f"<body>{MENU}<div>%s</div>{FOOT}</body>",
    f'<body class="has-sidebar"><div class="page with-sidebar">{MENU}<div class="post">%s</div></div></body>',
    f'<main><div class="widget-body">%s</div></main>{FOOT}',
    f'<article><div class="widget-body">%s</div></article>{TALK}',
    f'<div id="page" class="no-sidebar"><div class="entry-content">%s</div>{TALK}</div>',
    f'<body class="single modal-open">{MENU}<div id="content">%s</div>{SIDE}</body>',
    f'<body><nav>{MENU}</nav><div class="layout sidebar-right"><div class="text">%s</div>{SIDE}</div></body>',
    f'<body><header><p>The Daily Paper of the town</p></header><section>%s</section><footer><p>Imprint and contact.</p></footer></body>',
    f'<main class="with-ads">%s<div class="ads"><p>Buy this thing now, it is cheap.</p></div></main>',
    f'<div role="navigation">{MENU}</div><div role="main">%s</div><div role="banner"><p>Town news of today.</p></div>',
    f'<div class="page-with-comments"><article>%s</article>{TALK}</div>',
    f'<main><article>%s</article><div class="comment-list">{TALK * 9}</div></main>',
    f'<main><article>%s</article><div class="related-posts"><p>Another teaser of a page.</p></div></main>',
    f'<div class="nav-wrapper">{MENU}</div><div class="story">%s</div><form><p>Your mail address please.</p></form>',
    f'<table><tr><td class="nav">{MENU}</td><td class="body">%s</td></tr></table>',
    f'<div class="cookie-notice"><p>This site sets cookies on your machine.</p></div><div class="post">%s</div>',
    f'<div class="post">%s</div><div>(c) 2024 All rights reserved</div>',
    f'<div class="post">%s</div><div>Copyright 2024 by the paper</div>',
    f'<script>var x = "<p>no</p>";</script><style>p {{}}</style><div>%s</div><noscript><p>Please turn it on.</p></noscript>',
    f'<body><aside><p>Some words aside from it.</p></aside><div class="article-body">%s</div></body>',
    f'<div class="site-with-toolbar"><div class="toolbar"><p>Print this page, or save it.</p></div><div>%s</div></div>',
]


@pytest.fixture(scope="module")
def learned(spark):
    """A model taught by pages that name their parts."""
    pages = spark.createDataFrame([(i, "u", w + " " * i) for i, w in enumerate(WRAPPED * 5)], "page_id long, url string, html string")
    return html_extract.fit(pages)


@pytest.mark.parametrize("shape", SHAPES)
def test_page_shapes_give_their_article(shape, learned):
    for weights in (None, learned):
        assert html_extract.main_text(shape % BODY, html_extract.Chain(weights)) == " ".join(PARTS)


def test_a_thread_longer_than_the_article_stays_out():
    for name in ("comments", "comments-area", "comment-list"):
        page = f'<div class="story">{BODY}</div><div class="{name}">{BODY * 3}</div>'
        assert html_extract.main_text(page, html_extract.Chain()) == " ".join(PARTS)
