"""Main text of pages written by hand, of shapes the training pages do not have, and of hostile ones."""

import time

import pytest

from gridloom.llm import html_main

L = "The committee met on Tuesday to review the proposal, which had been under discussion for several months."
M = "Members raised questions about cost, timing and the effect on nearby residents; most were answered in writing."
PAGES = {
    "old table layout": (
        f"<html><body><table><tr><td class=leftnav><a href=/>Home</a><br><a href=/a>Products</a><br><a href=/b>Support</a></td><td><h2>Annual report</h2><p>{L}<p>{M} {M}"
        "<table><tr><th>Year<th>Total<tr><td>2019<td>14</table></td></tr></table><div class=copyright>Copyright 2020 All rights reserved</div></body></html>",
        ["Annual report", L, f"{M} {M}", "Year", "Total", "2019", "14"],
    ),
    "blog": (
        "<!doctype html><body class=single><div id=top><div id=branding><a href=/>Site name</a></div><div id=access><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div></div>"
        f"<div id=wrap><div class=col-8><div class=hentry><h1 class=entry-title>Walking the old road</h1><div class=entry-content><p>{L} {M}</p><h3>Second day</h3><p>{M}</p>"
        f"<ul><li>{M}</li><li>Short item.</li></ul><blockquote><p>{L}</p></blockquote></div></div></div><div class='col-4 sidebar'><h4>Recent posts</h4><ul><li><a href=x>Post one</a></li>"
        "<li><a href=y>Post two</a></li></ul></div></div><div id=colophon class=site-footer>Powered by software</div>",
        ["Walking the old road", f"{L} {M}", "Second day", M, M, "Short item.", L],
    ),
    "news": (
        "<html lang=en><head><meta charset=utf-8><title>News</title></head><body><header role=banner><p>The Daily</p><nav><ul><li><a href=#>World</a><li><a href=#>Sport</a></ul></nav></header>"
        f"<main><article><header><h1>Council approves plan</h1></header><section><p>{L} {L}</p><p>{M}</p></section><aside class=related><h3>Related</h3><ul><li><a href=#>Other story</a></ul></aside>"
        f"<section><h2>Background</h2><p>{L}</p></section></article><section id=comments><h2>2 comments</h2><div class=comment><p>I disagree with this entirely, it is far too expensive for us.</p></div>"
        "</section></main><footer><p>Contact us</p></footer></body></html>",
        ["Council approves plan", f"{L} {L}", M, "Background", L],
    ),
    "bare": (f"<h1>Notes</h1><p>{L}</p><p>{M}</p>", ["Notes", L, M]),
    "manual": (
        f"<body><div class=content><h1>API</h1><dl><dt>open</dt><dd>{L}</dd><dt>close</dt><dd>{M}</dd></dl><pre>x = open(1)\n  close(x)</pre><figure><img src=a><figcaption>A diagram of the call.</figcaption>"
        "</figure></div><div class='cookie banner'>We use cookies. <button>OK</button></div></body>",
        ["API", "open", L, "close", M, "x = open(1) close(x)", "A diagram of the call."],
    ),
}


@pytest.fixture(scope="module")
def trees():
    return html_main.train()


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(trees, name):
    source, want = PAGES[name]
    assert html_main.main_texts([source], trees)[0].split("\n\n") == want


def segments(source):
    return [t for _, t in html_main.parse(source).segments]


def test_quotes_in_tags():
    assert segments('<a href="x>y">link</a> <p title=\'a>b\'>t</p>') == ["link", "t"]
    assert segments('<p a="unclosed>text</p><p>more') == ["text", "more"]
    assert segments("<p don't>hi</p><p>it's</p>") == ["hi", "it's"]
    assert segments("a < b <p>1 <3 x") == ["a < b", "1 <3 x"] and segments("<!-->x<p>y<!-- z") == ["x", "y"]
    assert segments("<script>if (a</script x>b") == ["b"]


HOSTILE = {
    "open": "<a" * 50000, "one end": "<a" * 50000 + ">", "quotes": '<a ="> "' * 20000, "apostrophes": "<a b='" * 50000 + ">", "scripts": "<script>" + "</script" * 50000,
    "areas": "<textarea>" * 20000, "comments": "<!--" * 50000, "bang": "<!" * 50000 + ">", "deep": "<div>" * 20000, "ends": "</div>" * 50000, "mixed": "<button><svg><div>" * 10000,
    "heads": "<head><title>" * 20000, "equals": "<a " + "= " * 100000 + ">", "classes": "<p " + 'class="x ' * 20000 + ">z", "amps": "&" * 100000, "lists": "<ul><li>a" * 5000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.time()
    page = html_main.parse(HOSTILE[name])
    assert time.time() - began < 1
    assert not page.tag or len(html_main.features(page)) == len(page.tag)


def test_rows_of_all_kinds(spark, trees):
    rows = [(1, "u", PAGES["bare"][0], "k", 3), (1, "u", PAGES["bare"][0], "k", 3), (None, None, None, None, None), (4, "v", "x " * 2_000_000, "t", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    out = html_main.extract(spark.createDataFrame(rows, schema), trees).collect()
    want = "\n\n".join(PAGES["bare"][1])
    assert sorted((r.page_id or 0, r.text if r.page_id != 4 else "", r.n_chars == len(r.text)) for r in out) == [(0, "", True), (1, want, True), (1, want, True), (4, "", True)]
    assert html_main.extract(spark.createDataFrame([], schema), trees).count() == 0
