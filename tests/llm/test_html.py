"""HTML extraction: fixed pages, and generated trees with and without the tags that may be left out."""

import random
import time

import pytest

from lodewright.llm import html_extraction
from lodewright.llm.html_layout import extract


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a  b\n c<p>d", "a b c\n\nd"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a<b>b</b> <i> c</i>", "ab c"),
        ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "- x\n- y\n  1. 1\n  2. 2"),
        ("<ol start=9 reversed><li>a<li>b</ol>", "9. a\n8. b"),
        ("<ol type=I><li value=4>a</ol>", "IV. a"),
        ("<table><tr><th>k<th>value<tr><td>long name<td>1</table>", "k          value\nlong name  1"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td>only</table>after", "only\n\nafter"),
        ("<table>stray<tr><td>a<td>b</table>", "stray\n\na  b"),
        ("<pre>\n x\n   y</pre>", " x\n   y"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("a<script>if (1 < 2) '</p>'</script>b", "ab"),
        ("<style>.g, #i {display: none}</style><p class='f g'>no<p id=i>no<p>yes", "yes"),
        ("<p style='visibility:hidden'>no<p hidden>no<p>yes<template>no</template><!-- no --><noscript>no</noscript>", "yes"),
        ("<head><title>T</title></head>x &lt;b&gt; &amp; &eacute;&#x41;", "x <b> & éA"),
        ("<select><option>a<option selected>b</select><input value=v><input type=hidden value=h>", "b v"),
        ("1 < 2 <3 </ p> <a href='x>y'>z</a>", "1 < 2 <3 z"),
        ("<blockquote>q</blockquote>", "  q"),
        ("x&nbsp;&nbsp;y", "x  y"),
        ("<p>open <b", "open"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, text):
    assert extract(page)[1] == text


def generated(rng, depth, optional):
    """The same random page with all tags, or without those that may be left out."""
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6)))
    end = lambda name: "" if optional else f"</{name}>"
    kind = rng.choice(["p", "ul", "table", "dl", "div"]) if depth else "p"
    if kind == "p":
        return f"<p>{word()} {word()}{end('p')}"
    if kind == "ul":
        return "<ul>" + "".join(f"<li>{word()}{generated(rng, depth - 1, optional) if rng.random() < 0.4 else ''}{end('li')}" for _ in range(rng.randrange(1, 4))) + "</ul>"
    if kind == "table":
        rows = "".join("<tr>" + "".join(f"<td>{word()}{end('td')}" for _ in range(3)) + end("tr") for _ in range(rng.randrange(1, 4)))
        return f"<table>{'' if optional else '<tbody>'}{rows}{'' if optional else '</tbody>'}</table>"
    if kind == "dl":
        return "<dl>" + "".join(f"<dt>{word()}{end('dt')}<dd>{word()}{end('dd')}" for _ in range(2)) + "</dl>"
    return "<div>" + "".join(generated(rng, depth - 1, optional) for _ in range(rng.randrange(1, 4))) + "</div>"


@pytest.mark.parametrize("seed", range(40))
def test_implied_tags(seed):
    whole, bare = (extract(generated(random.Random(seed), 4, o))[1] for o in (False, True))
    assert whole == bare


@pytest.mark.parametrize("bad", ["<b>" * 50000 + "x", "<table>" * 20000, "<td" * 50000, "<a b='" * 50000, "<ul><li>" * 20000 + "x", "<!--" * 50000, "<script>" * 50000, "<table><tr>" + "<td rowspan=65000 colspan=1000>x" * 2000 + "<tr><td>y" * 2000])
def test_broken_pages_take_linear_time(bad):
    began = time.time()
    extract(bad)
    assert time.time() - began < 20


def test_frame(spark):
    rows = [(1, "<p>a<p>b"), (1, "<p>a<p>b"), (2, None), (None, ""), (3, "<i>" + "x " * 200000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'clash' as text", "1 as other")
    got = html_extraction.visible_text(df).collect()
    assert sorted((r.page_id or 0, r.text[:4], r.n_lines, r.other) for r in got) == [(0, "", 0, 1), (1, "a\n\nb", 3, 1), (1, "a\n\nb", 3, 1), (2, "", 0, 1), (3, "x x ", 1, 1)]
    assert html_extraction.visible_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("a<svg><title>t</title><defs><text>no</text></defs><g>no<text>see<tspan>n</tspan></text></g></svg>b", "a seen b"),
    ("<svg><foreignObject><p>x</p></foreignObject><text style='display:none'>no</text></svg>", "x"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><i>no</i></div>z", "yes\nz"),
    ("<style>.v{visibility:hidden}#w{visibility:visible}</style><p class=v>no<span id=w>yes<i class=v>no</i></span></p>", "yes"),
    ("<style>p{visibility:hidden}</style><p>no</p><p style='visibility:visible'>yes</p>", "yes"),
    ("<details><summary>s</summary>no<summary>no</summary></details>z", "s\nz"),
    ("<details>no</details>z", "z"),
    ("<details open><summary>s</summary><p>in</p></details>z", "s\n\nin\n\nz"),
])
def test_drawings_visibility_and_details(page, want):
    assert extract(page)[1] == want


def test_hidden_cells_keep_their_columns():
    page = "<table><tr><td>a</td><td style='visibility:hidden'>no</td><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr></table>"
    first, second = extract(page)[1].split("\n")
    assert "no" not in first and first.index("c") == second.index("f")


def test_deep_hidden_tree():
    deep = "<div style='visibility:hidden'>" + "<div>no" * 400 + "<b style='visibility:visible'>yes</b>"
    assert extract(deep)[1] == "yes"
