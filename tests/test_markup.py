"""HTML to Markdown: known cases, every page against the plain reader's words, broken and hostile markup."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mnemolith.functions.markup import markdown
from mnemolith.operators import documents

DATA = "/root/testdata/sf0.001"

CASES = {
    "<h1>A &amp; B</h1><p>one <b>two </b>three<br>four<p>five": "# A & B\n\none **two** three  \nfour\n\nfive",
    "<ul><li>a<li>b<ul><li>c</li></ul></li></ul><ol><li>x<li>y</ol>": "* a\n* b\n  * c\n\n1. x\n2. y",
    "<ol><li><p>a</p><p>b</p></li><li>c</ol>": "1. a\n\n   b\n2. c",
    "<a href='/x?a=1&amp;b=2'> go <i>on</i></a> end": "[go _on_](/x?a=1&b=2) end",
    "<a>no target</a>, <a href=x></a>nothing": "no target, nothing",
    '<p>a<a href="x>y">q</a> <img src=i.png alt="A b"><b></b> <code>x_y</code>': "a[q](x>y) ![A b](i.png) `x_y`",
    "<code>a`b</code>": "``a`b``",
    "<pre>a\n\n\n  b</pre><p>x": "```\na\n\n\n  b\n```\n\nx",
    "<li><pre>a\nb</pre>": "* ```\n  a\n  b\n  ```",
    "<table><tr><th>a<th>b<tr><td>1|2<td>3</table>": "| a | b |\n| --- | --- |\n| 1\\|2 | 3 |",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "| \\| in \\| \\| --- \\| | out |\n| --- | --- |",
    "<blockquote><p>a<p>b</blockquote>c": "> a\n> \n> b\n\nc",
    "<p>1. x</p><p># y *z* [k]</p>": "1\\. x\n\n\\# y \\*z\\* \\[k\\]",
    "</p></b>text<script>if (a<b) '</p>'</script>z": "textz",
    "<head><title>t</title></head><body>x</body>": "x",
    "<b>one<p>two</p></b>": "**one**\n\n**two**",
    "a < b & c &lt;d&gt;": "a < b & c <d>",
    "<p>a<hr>b": "a\n\n---\n\nb",
    "<!-- x --><!doctype html>y<!-- open": "y",
    "<svg><p>no</svg>yes": "yes",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_known_cases(page):
    assert markdown(page) == CASES[page]


def test_null_stays_null():
    assert markdown(None) is None


def test_any_markup_keeps_its_words_in_order():
    """Tags at random, open, closed, crossed: no word is lost, doubled or moved."""
    tags = ["p", "b", "i", "ul", "ol", "li", "div", "a href=x", "table", "tr", "td", "th", "pre", "code", "h2", "blockquote", "span", "dl", "dt", "dd", "br", "hr"]
    for seed in range(400):
        rnd = random.Random(seed)
        page, said = "", []
        for i in range(rnd.randint(1, 30)):
            t = rnd.choice(tags)
            page += f"</{t.split()[0]}>" if rnd.random() < 0.4 else f"<{t}>"
            if rnd.random() < 0.7:
                said.append(f"word{i}")
                page += f" word{i} "
        assert re.findall(r"word\d+", markdown(page)) == said, page


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x " * 100_000, '<a href="x' * 50_000, "<ul><li>x" * 50_000, "<!--" * 100_000, "<![" * 100_000, "<" * 300_000, "<p>" * 200_000, "<b>" * 1000 + "x" + "</b>" * 1000])
def test_hostile_pages_end(page):
    t = time.time()
    markdown(page)
    assert time.time() - t < 20


def test_pages_say_what_the_plain_reader_says(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    both = documents.page_markdown(pages).withColumn("plain", documents.page_text(F.regexp_replace("html", "(?is)<title>.*?</title>", ""))).collect()
    # Without escapes and links' targets; the plain reader leaves rarer entities as they are.
    words = lambda t: re.findall(r"\w+", re.sub(r"\\(.)", r"\1", re.sub(r"\]\([^)]*\)", "]", t)))
    assert len(both) >= 20
    for r in both:
        if r.html is not None:
            assert words(r.markdown) == words(html.unescape(r.plain)), r.page_id


def test_pages_that_cannot_be_read(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>é" * 5, "x"), (4, "<p>ok", "x")], "page_id int, html string, problem_before string")
    got = {r.page_id: (r.markdown, r.problem) for r in documents.page_markdown(df, most=20).collect()}
    assert got == {1: (None, "no text"), 2: ("", "no text"), 3: (None, "too large"), 4: ("ok", None)}
    assert documents.page_markdown(df.limit(0)).count() == 0
