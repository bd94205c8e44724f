"""Rendering against hand-written expectations, and of randomly broken pages against a plain recursive renderer."""

import random
import time

import plain_html
import pytest

from inkwell.llm.html_text import MAX_INDENT, extract, render

CASES = {
    "": "",
    "plain  text\n here": "plain text here",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>": "a\nb",
    "<div>a</div><article><h1>b</h1></article>c": "a\n\nb\n\nc",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a<li>b</ol>": "9. a\n10. b",
    "<table><tr><th>n<th>value<tr><td>long<td>1</table>": "n     value\nlong  1",
    "<table><tbody><tr><td colspan=2>a<td>b</tr><tr><td>c<td>d<td>e</table>": "a     b\nc  d  e",
    "<pre> a\n   b</pre>": " a\n   b",
    "x<script>no()</script>y<style>p{}</style>z": "xyz",
    "<p hidden>no</p>yes<!-- no -->": "yes",
    "<p style='display:none'>no<b>no</b></p>yes": "yes",
    "<p style='visibility: hidden'>no<b style='visibility:visible'>yes</b></p>": "yes",
    "<template>no</template><noscript>no</noscript>&lt;a&gt; &amp; &eacute;": "<a> & é",
    "<input type=hidden value=no><input type=submit value=Go>": "Go",
    "<p>a<div>b</div>c</p>d": "a\n\nb\nc\n\nd",
    "</div></p>a<b>b<i>c</b>d</i>": "abcd",
    "<dl><dt>t<dd>d1<dd>d2</dl>": "t\n  d1\n  d2",
    "<img alt='A picture' src=x>": "A picture",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>": "a  b\n   c\nd",
    "<table><tr><td colspan='\u00b2'>a<td>b</table>": "a  b",
    f"<table><tr><td colspan={'9' * 5000}>a<td>b</table>": "a  b",
    "a<![foo[x]]>b<![CDATA[c]]>d": "abd",
    f"a&#{'0' * 5000}66;&#{'7' * 5000};": "aB\ufffd",
}


@pytest.mark.parametrize("html", CASES)
def test_render(html):
    assert render(html) == CASES[html]


TAGS = "p div span b li ul ol dl dt dd table tr td th tbody thead caption pre h1 h2 br hr blockquote select option a img input title script button".split()
ATTRIBUTES = ["", "", "", "", " hidden", " style='visibility:hidden'", " style='display:none'", " style='visibility:visible'", " colspan=2", " rowspan=2", " rowspan=0", " colspan=x", " start=3", " value=v", " alt='an image'", " type=hidden"]


def broken(rng):
    out = []
    for _ in range(rng.randint(1, 60)):
        tag = rng.choice(TAGS)
        out.append(
            rng.choice(
                [f"<{tag}{rng.choice(ATTRIBUTES)}>"] * 5
                + [f"</{tag}>"] * 3
                + [rng.choice(["word", " two words ", "\n", " a\n b", "<", "&", "&lt;", "é"])] * 5
                + [rng.choice(["<!-- x -->", "<!-- ", "<![x[y]]>", "<!", "</", "<?x>", "<a b='", "&#99999999999;", "</>", "<!doctype html>"])]
            )
        )
    return "".join(out)


def test_broken_pages():
    rng = random.Random(12)
    for _ in range(10_000):
        html = broken(rng)
        plain = html.replace("&#99999999999;", "\ufffd")
        assert render(html) == plain_html.render(plain), html


def test_deep_pages_are_linear():
    n = 50_000
    assert render("<p>" + "<div>" * n + "x") == "x"
    assert render("<p><button>" + "<div>" * n + "x" + "</div>" * n) == "x"
    assert render("<b>" * n + "<table>" * 2000 + "<tr><td>x") == "x"


def test_long_and_deep_pages():
    assert render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(render("<p>word" * 20_000).split("\n\n")) == 20_000


MEGABYTE = {
    "unclosed": "<a " * 333_000,
    "one tag": "<a " * 333_000 + ">",
    "quotes": '<a x="' * 160_000 + ">",
    "comments": "<!-- > " * 140_000,
    "lists": "<ul><li>x" * 110_000,
    "blocks": "<div>x" * 160_000,
    "quoted": "<blockquote>x" * 75_000,
    "terms": "<dl><dd>x" * 110_000,
    "spans": "<table>" + "<tr><td rowspan=99999 colspan=1000>x" * 28_000,
    "tables": "<table><tr><td>x" * 60_000,
    "cells": "<table><tr>" + "<td>x" * 200_000,
}


@pytest.mark.parametrize("kind", MEGABYTE)
def test_a_megabyte_takes_seconds(kind):
    page = MEGABYTE[kind]
    began = time.time()
    text = render(page)
    assert time.time() - began < 40 and len(text) < 12 * len(page)
    shown = page.split(">")[1:] if kind not in ("unclosed", "one tag", "quotes", "comments") else []
    assert text.count("x") >= sum(x.startswith("x") for x in shown)


def test_bounds_of_white_space():
    deep = render("<ul><li>x" * 40).split("\n")
    assert deep[:3] == ["- x", "  - x", "    - x"] and deep[39] == " " * MAX_INDENT + "- x" and deep[34] == " " * MAX_INDENT + "- x"
    wide = render("<table>" + "".join(f"<tr><td colspan={k * 900}>{'y' * 50}<td>z" for k in range(1, 60)) + "</table>").split("\n")
    assert all(line.split() == ["y" * 50, "z"] for line in wide)
    steps = render("<table>" + "<tr><td rowspan=999>x" * 3000 + "</table>").split("\n")
    assert steps == ["x"] * 3000


def test_what_looks_like_a_tag_at_the_end_is_text():
    assert render("<p>a</p> b <i c") == "a\n\nb <i c"


def test_extract_edges(spark):
    rows = [(1, "<p>a", "z"), (1, "<p>a", "z"), (None, "<b>b", "z"), (2, None, None), (3, "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(extract(pages).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "a"), (1, "a"), (2, ""), (3, ""), (None, "b")]
    assert extract(pages.where("false")).count() == 0
