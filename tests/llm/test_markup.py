"""Markup that is cut off or odd: none of it comes out as text, and time grows with the page."""

import time

import pytest

from krigstone.llm import html_extract

S = "A long enough sentence of the text, with a comma."
T = "It was in the autumn of that year that the three of them met again, by chance."


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(html_extract.labelled_pages(spark))


@pytest.mark.parametrize(("html", "want"), [
    (f'<article><p>{S}</p><p>{T}</p></article', f"{S}\n\n{T}"),
    (f'<article><p>{S}</p><p>{T}</p><a href="http://x.y/zz', f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><p>{T}</p><a href='http://x.y/zz>more <b>here</b>", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><p>{T}</p><!-- hidden words never closed <p>bla", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><!-- x --!><p>{T}</p></article>", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><!-- a > b -- <p>no</p> --><p>{T}</p></article>", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><!--><p>{T}</p><!---></article>", f"{S}\n\n{T}"),
    (f"<!DOCTYPE html><?xml version='1'?><article><![CDATA[no]]><p>{S}</p></><p>{T}</p></ x></article>", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><p>{T}</p><!doctype", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><script>if (a<b) document.write('<p>no</p><!-- no')</script ><p>{T}</p></article>", f"{S}\n\n{T}"),
    (f"<article><p>{S}</p><p>{T}</p><script>var a = 1; </scr", f"{S}\n\n{T}"),
    (f"<html><title>a <b> c</title><body><article><p>{S}</p><p>{T}</p></article>", f"{S}\n\n{T}"),
    (f'<article><p title="a > b">{S}</p><p data-x=\'<p>\'>{T}</p></article>', f"{S}\n\n{T}"),
    (f"<article><p>{S} 1 < 2 &lt; 3 &amp;amp; <3</p></article>", f"{S} 1 < 2 < 3 &amp; <3"),
    (f"<article><P CLASS=x/>{S}</P><svg/><p>{T}</p></article>", f"{S}\n\n{T}"),
    ("<p", ""), ("<", "<"), ("</", "</"), ("<!--", ""), ("</p", ""),
])
def test_no_markup_in_the_text(model, html, want):
    assert html_extract.main_text(html, model) == want


@pytest.mark.parametrize("html", [
    "<i><div>" + "<span>" * 8000 + "</i>" * 8000, "<p><div>" + "<span>" * 8000 + "<hr>" * 8000, "<ul><li><ul>" + "<div>" * 8000 + "<li></li>" * 4000,
    "<a b='" * 8000, "<!--" * 8000, "<script>" * 8000, "<a '>" * 8001, "<" * 80000,
])
def test_time_grows_with_the_page(html):
    began = time.time()
    html_extract.Page(html)
    assert time.time() - began < 2  # half a second here; with the square of the page it was half a minute


def test_divs_without_names(model):
    menu = "".join(f"<div><a href=/{i}>Part {i}</a></div>" for i in range(6))
    assert html_extract.main_text(f"<body><div>{menu}</div><div><div>{S}</div><div>{T}</div></div></body>", model) == f"{S}\n\n{T}"
    assert html_extract.main_text(f"<body><div><div><a href=/>Home</a> <a href=/n>News</a></div></div><div><div>{S}</div><div>{T}</div></div>", model) == f"{S}\n\n{T}"
