"""op8 on pages that break HTML's rules, and on pages made to be slow."""

import time

import pytest

from depthlane.llm import htmltext as H

ARTICLE = "word " * 60


@pytest.mark.parametrize("page, text", [
    ("<p data-x=it's>Hello there</p><p>I don't know</p><p>tail</p>", "Hello there\n\nI don't know\n\ntail"),
    ('<p title="5" tall">text one</p>', "text one"),
    ('<p title="a > b">one</p><p title=\'x"y\'>two</p>', "one\n\ntwo"),
    ("<p>1 < 2 and a<b>old</b></p>", "1 < 2 and aold"),
    ("<!--><p>shown</p><!-- > --><p>too</p><!-- hidden --!><p>end</p>", "shown\n\ntoo\n\nend"),
    ("<p>AT&am<b>p;</b> &amp; &lt;b&gt; &eacute;</p>", "AT&amp; & <b> é"),
    ("<p>one</p><script>var a='</p><p>x';</script ><p>two</p>", "one\n\ntwo"),
    ("<p>kept</p><p class='x", "kept"),
    ("<p>kept</p><script>never closed <p>x</p>", "kept"),
    ("<P CLASS=a class=ad>one</P></x></p><?php echo ?><p>two", "one\n\ntwo"),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"),
])
def test_syntax(page, text):
    assert H.extract(page) == text


def test_siblings_and_titles_stay():
    page = f"<body><div class='post-header'><h1>The title</h1></div><div class=sec><p>{'long ' * 168}</p></div><div class=sec><p>{'more ' * 62}</p></div></body>"
    wanted = H.path(H.best_container(H.parse(page)))
    for path in (None, wanted, "body/div.sec"):
        text = H.extract(page, path)
        assert text.count("long") == 168 and text.count("more") == 62
    assert H.extract(f"<article><div class='post-header'><h1>The title</h1></div><p>{ARTICLE}</p></article>").startswith("The title")


N = 1 << 20
SLOW = {
    "open": "<a" * (N // 2), "quotes": '<a "' * (N // 4), "values": "<a b='" * (N // 6), "nested": "<div>x" * (N // 6), "closed": "<div>" * (N // 10) + "</p>" * (N // 8), "inline": "<b>" * (N // 8) + "<p>x</p>" * (N // 16),
    "ends": "<b>" * (N // 6) + "</section>" * (N // 20), "crossed": "<a><div>" + "<b>" * (N // 8) + "</a>" * (N // 8), "scripts": "</script" * (N // 8) + "<script>" + "</script" * (N // 8), "comments": "<!--" * (N // 4),
    "bogus": "<!" * (N // 2), "items": "<ul><li>" * (N // 8), "cells": "<td>x" * (N // 5), "mains": "<main class=nav>x" * (N // 17), "articles": "<article class=has-ad>x" * (N // 23), "spaces": "<a" + " " * N + "x" + " " * N, "less": "<" * N,
    "entities": "&amp" * (N // 4), "named": "<div class=menu>x" * (N // 17), "tables": "<table><tr><td>" * (N // 15), "attributes": "<p " + "a=b " * (N // 4) + ">x",
}


@pytest.mark.parametrize("kind", SLOW)
def test_time_is_linear(kind):
    began = time.process_time()
    H.extract(SLOW[kind])
    assert time.process_time() - began < 10  # two seconds or so; a step for each pair of tags would take hours
