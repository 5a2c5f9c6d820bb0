"""Articles inside elements whose names speak of menus, forms or comments because they hold the whole page; the expected text is written out by hand."""

import pytest

from gridloom.llm import html_main

PARAGRAPHS = [
    "The harbour council met on Tuesday evening to decide the future of the old ferry landing, which has stood empty since the winter storm.",
    "Members of the public filled the hall, and more than forty people spoke during a debate that lasted well past ten at night.",
    "A report by two engineers found that the wooden piles could be saved, though the work would cost almost twice what was planned.",
    "Shop owners near the quay said that the ferry brought visitors who would otherwise drive straight through to the next town.",
    "The vote was postponed until the end of the month, when a second estimate should be ready for the councillors to read.",
]
WANT = "\n\n".join(["Ferry landing", *PARAGRAPHS])
STORY = "<h1>Ferry landing</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(6)) + "</ul></nav>"
REST = (
    "<aside class='sidebar'><h3>Most read</h3><ul><li><a href=/1>One thing</a></li><li><a href=/2>Other thing</a></li></ul></aside>"
    "<section class='comments'><h3>Comments</h3><div class='comment'><p>Ann</p><p>I do not agree at all with this plan.</p></div><div class='comment'><p>Bob</p><p>Good that somebody asked.</p></div></section>"
    "<footer><p>Copyright of the paper</p></footer>"
)
BODIES = ["class='single-post has-sidebar comments-open'", "class='has-sidebar'", "class='comments-open'", "id='menu-open'", "class='header-fixed footer-dark'", "class='no-ads'"]
HOLDERS = ["main class='post with-sidebar'", "div class='page-header-fixed'", "div class='ad-free-content'", "form action='/x'", "div class='no-header'", "article", "section class='nav-top'", "div"]


@pytest.fixture(scope="module")
def trees():
    return html_main.train()


def text(trees, page):
    return html_main.main_texts([page], trees)[0]


@pytest.mark.parametrize("body", BODIES)
def test_a_body_named_for_its_parts(trees, body):
    assert text(trees, f"<html><body {body}>{MENU}<article>{STORY}</article>{REST}</body></html>") == WANT


@pytest.mark.parametrize("holder", HOLDERS)
def test_a_holder_named_for_its_parts(trees, holder):
    end = f"</{holder.split()[0]}>"
    assert text(trees, f"<html><body>{MENU}<{holder}>{STORY}{end}{REST}</body></html>") == WANT
    assert text(trees, f"<html><body><{holder}>{MENU}<div>{STORY}</div>{REST}{end}</body></html>") == WANT
    assert text(trees, f"<html><body><{holder}>{STORY}{end}</body></html>") == WANT


@pytest.mark.parametrize("spans", [((3, 4), (9, 10)), ((0, 6), (12, 18)), ((1, 2), (5, 6), (11, 12), (15, 16))])
def test_paragraphs_with_links(trees, spans):
    def linked(p):
        words = p.split()
        for a, b in spans:
            words[a] = "<a href='/x'>" + words[a]
            words[b - 1] += "</a>"
        return f"<p>{' '.join(words)}</p>"

    story = "<h1>Ferry landing</h1>" + "".join(map(linked, PARAGRAPHS))
    assert text(trees, f"<html><body>{MENU}<article>{story}</article>{REST}</body></html>") == WANT


def test_more_comments_than_article(trees):
    said = "".join(f"<div class='comment'><p>Reader {k}</p><p>{PARAGRAPHS[k % 5]}</p></div>" for k in range(12))
    page = f"<html><body class='comments-open'>{MENU}<article><h1>Ferry landing</h1><p>{PARAGRAPHS[0]}</p></article><section class='comments'><h3>Comments</h3>{said}</section></body></html>"
    assert text(trees, page) == f"Ferry landing\n\n{PARAGRAPHS[0]}"
