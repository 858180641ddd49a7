"""Pages written by hand, after layouts that the trainer's generator does not make, and odd markup."""

import time

import pytest

from krigstone.llm import html_extract

S = "A long enough sentence of the text, with a comma. And another one that goes on for a while, as they do."
T = "It was in the autumn of that year that the three of them met again, by chance, on the old bridge."
U = "Nothing came of it for a long time; then a letter arrived, and everything had to be thought over."

#: (html, main text by blocks)
PAGES = [
    (f"<body><p>{S}</p><p>{T}</p></body>", [S, T]),
    (f"<body>{S}</body>", [S]),
    (f"<body>{S}<br><br>{T}</body>", [f"{S} {T}"]),
    (f"{S} <b>x</b><br>more", [f"{S} x more"]),
    (f'<main><div class="comment-free-zone"><p>{S}</p></div></main>', [S]),
    (f"<article><p>{S}</p></article></body></html><p>{T}</p>", [S, T]),
    (f"<html><body class=post><h1>Title here</h1><p>{S}<p>{T}<hr><p>{U}</body>", ["Title here", S, T, U]),
    (f"<body><header><a href=/>Site</a></header><p>{S}</p><p>{T}</p><footer>&copy; 2020 me</footer></body>", [S, T]),
    (f"<body><h1>Notes</h1>{S}<p>{T}</body>", ["Notes", S, T]),
    # a web log
    (
        f'<!doctype html><html><head><title>b</title><body><div id="masthead"><h1><a href="/">My log</a></h1><p>Words about things</p></div><div id="topnav"><a href="/a">About</a> | <a href="/b">Archive</a></div>'
        f'<div class="hentry"><h2 class="entry-title">The bridge</h2><div class="entry-content"><p>{S}</p><blockquote><p>{T}</p></blockquote><p>{U}</p></div></div>'
        f'<ol id="comments"><li><p>Great post! {S}</p></li></ol><div id="footer">Powered by a machine</div></body></html>',
        ["The bridge", S, T, U],
    ),
    # news with related links and an advert within the text
    (
        f'<html><body><div class="cookie-banner" role="dialog">We use cookies. <button>OK</button></div><nav class="main-menu"><ul><li><a href=1>World</a><li><a href=2>Sport</a></ul></nav><main role="main"><article class="story">'
        f'<h1>Three meet on bridge</h1><p>{T}</p><div class="advert">Buy two, get one.</div><p>{U}</p><aside class="related"><h3>More</h3><ul><li><a href=3>Other story</a></ul></aside><p>{S}</p></article></main>'
        f'<section class="newsletter"><form><label>Mail</label><input><button>Go</button></form></section><footer><ul><li><a href=5>Imprint</a></ul></footer></body></html>',
        ["Three meet on bridge", T, U, S],
    ),
    # tables for the layout, font elements, upper case
    (
        f'<HTML><BODY BGCOLOR=white><TABLE><TR><TD CLASS="menu"><A HREF=a>Home</A><BR><A HREF=b>Links</A></TD><TD CLASS="content"><P><FONT SIZE=2>{S}</FONT><P>{T}</TD></TR></TABLE></BODY></HTML>',
        [S, T],
    ),
    # manual: lists and code
    (
        f'<body><nav aria-label="breadcrumb"><ol><li><a href=/>Docs</a></li><li><a href=/x>X</a></li></ol></nav><div class="document"><div class="body" role="main"><section id="install"><h1>Install</h1><p>{S}</p>'
        f'<ul><li>{T}</li><li>{U}</li></ul><pre>make all</pre></section></div></div><div class="sphinxsidebar" role="navigation"><h3><a href=i>Contents</a></h3><ul><li><a href=1>One</a></li></ul></div></body>',
        ["Install", S, T, U, "make all"],
    ),
    # deep wrappers without names
    (f"<body><div><div><div><div><h1>Old bridge</h1><div><p>{S}</p></div><div><p>{T}</p><p>{U}</p></div></div></div></div></div></body>", ["Old bridge", S, T, U]),
    # a comment thread after the text, share buttons before it
    (
        f'<body><div id="page"><div id="main"><ul class="share-buttons"><li><a href=1>Tweet</a></li></ul><p>{S}</p><p>{T}</p></div><div id="disqus_thread"><div class="reply"><p>I think so too, {U}</p></div></div></div></body>',
        [S, T],
    ),
    # an encyclopedia
    (
        f'<body class="skin"><div id="siteNotice"><p>Please give.</p></div><h1 id="firstHeading">Old bridge</h1><div id="bodyContent"><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href=1>1 History</a></li><li><a href=2>2 Use</a></li></ul></div>'
        f'<p>{S}</p><h2>History</h2><p>{T}</p><p>{U}</p></div><div id="p-navigation" class="portlet"><ul><li><a href=3>Main page</a></li><li><a href=4>Random</a></li></ul></div><div id="footer"><ul><li>Last edited in May.</li></ul></div></body>',
        ["Old bridge", S, "History", T, U],
    ),
    # a shop's article with a long legal footer
    (
        f'<body><div class="topbar"><a href=1>Cart</a> <a href=2>Login</a></div><div class="grid"><div class="col-8"><h1>How to choose</h1><p>{S}</p><h3>Size</h3><p>{T}</p></div><div class="col-4 widget-area"><h4>Popular</h4><ul><li><a href=3>One</a></li><li><a href=4>Two</a></li></ul></div></div>'
        f'<footer class="site-footer"><p>All prices include tax. {U}</p><p>{T}</p></footer></body>',
        ["How to choose", S, "Size", T],
    ),
    # a mail list archive: text in pre
    (f'<body><ul class="nav"><li><a href=1>prev</a></li><li><a href=2>next</a></li></ul><h1>[list] bridge</h1><pre>{S}\n{T}</pre><hr><ul><li><a href=3>thread</a></li></ul></body>', ["[list] bridge", f"{S} {T}"]),
    # headings and lists only
    (f'<body><div class="wrap"><section class="content"><h1>Steps</h1><ol><li>{S}</li><li>{T}</li></ol><dl><dt>Term</dt><dd>{U}</dd></dl></section><section class="ad sponsored"><a href=x>Buy</a></section></div></body>', ["Steps", S, T, "Term", U]),
    # hidden parts and templates
    (f'<body><article><h1>Bridge</h1><p>{S}</p><template><p>no</p></template><noscript><p>no</p></noscript><p>{T}</p></article><div style="display:none"><p>Hidden words, {U}</p></div></body>', ["Bridge", S, T]),
]


#: Written after the trainer was last changed, and not used to change it.
FRESH = [
    (f'<body><div class="wrapper"><div class="sidebar-left"><h4>Topics</h4><a href=1>One</a><br><a href=2>Two</a></div><div class="story-body"><h1>The old bridge</h1><p>{S}</p><p>{T}</p></div></div></body>', ["The old bridge", S, T]),
    (f'<body><p><a href=1>Home</a> &gt; <a href=2>Bridges</a></p><h2>The old bridge</h2><p>{S}</p><p>{U}</p><p><a href=3>Next</a></p></body>', ["The old bridge", S, U]),
    (f'<div id="app"><header role="banner"><a href=/>Site</a></header><main><article><header><h1>The old bridge</h1><p class="byline">By me</p></header><p>{S}</p><p>{T}</p></article></main></div>', ["The old bridge", S, T]),
    (f'<body><center><h1>Old bridge</h1></center><p>{S}<p>{T}<p>{U}<hr><address>me at home</address></body>', ["Old bridge", S, T, U]),
    (f'<body><form action=search><input><button>Search</button></form><div class="article-text"><p>{S}</p><ul><li>{T}</li><li>{U}</li></ul></div><div class="social-icons"><a href=1>a</a></div></body>', [S, T, U]),
    (f'<body><article class="recipe"><h1>Soup</h1><p>{S}</p><h2>What you need</h2><ul><li>Water</li><li>Salt</li></ul><p>{T}</p></article><div class="comments-area"><h3>2 replies</h3><p>{U}</p></div></body>', ["Soup", S, "What you need", "Water", "Salt", T]),
    (f'<body><div class="page"><div class="breadcrumbs"><a href=1>Home</a></div><div class="text"><div>{S}</div><div>{T}</div></div><div class="cookie-consent">We store things. <a href=2>More</a></div></div></body>', [S, T]),
    (f'<table width=100%><tr><td colspan=2><a href=1>Home</a> | <a href=2>Map</a></td></tr><tr><td><a href=3>One</a><br><a href=4>Two</a></td><td><h1>Old bridge</h1>{S}<br>{T}</td></tr></table>', ["Old bridge", f"{S} {T}"]),
    (f'<body><section id="post-17"><h1>Old bridge</h1><p>{S}</p><figure><img src=x><figcaption>The bridge.</figcaption></figure><p>{T}</p></section><nav class="pagination"><a href=1>Older</a></nav></body>', ["Old bridge", S, "The bridge.", T]),
    (f'<body><div><h1>Old bridge</h1></div><div><p>{S}</p></div><div><p>{T}</p></div><div><p><a href=1>Imprint</a> <a href=2>Contact</a></p></div></body>', ["Old bridge", S, T]),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(html_extract.labelled_pages(spark))


@pytest.mark.parametrize("pages", [PAGES, FRESH])
def test_accuracy_on_other_layouts(model, pages):
    wrong = []
    hit = found = there = 0
    for html, want in pages:
        got = html_extract.main_text(html, model)
        blocks = got.split("\n\n") if got else []
        hit, found, there = hit + len(set(blocks) & set(want)), found + len(blocks), there + len(want)
        if blocks != want:
            wrong.append((html, blocks))
    print(f"{len(pages) - len(wrong)} of {len(pages)} pages, precision {hit / found:.3f}, recall {hit / there:.3f}")
    for w in wrong:
        print(w)
    assert len(wrong) <= 4 and hit / found > 0.9 and hit / there > 0.9


def test_the_first_nine_are_whole(model):
    for html, want in PAGES[:9]:
        assert html_extract.main_text(html, model) == "\n\n".join(want)


def test_deep_and_badly_nested(model):
    """Time grows with the markup, not with its square, and no text is lost."""
    for n in (2000, 20000):
        began = time.time()
        assert S in html_extract.main_text("<article>" + "<div>" * n + f"<p>{S}</p>" + "</section>" * n, model)
        took = time.time() - began
    assert took < 20
    assert html_extract.main_text(f"<article><p><b><i>{S}</b></i><p>{T}</div></span></article>", model) == f"{S}\n\n{T}"
    assert html_extract.main_text(f"<article><ul><li>{S}<li>{T}</ul><table><tr><td>{U}<td>x<tr><td>y</table></article>", model).startswith(f"{S}\n\n{T}\n\n{U}")
