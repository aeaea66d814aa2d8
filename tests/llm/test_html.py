"""Pages whose wrappers carry words that elsewhere name a sidebar or comments."""

import pytest

from cardflow.llm.html_text import main_text

FIRST = "Some long article text, with commas, and words. " * 6
SECOND = "A second paragraph, also long, follows it. " * 5
TEXT = f"Head\n{FIRST.strip()}\n{SECOND.strip()}"
BODY = f"<h1>Head</h1><p>{FIRST}</p><p>{SECOND}</p>"
LINKS = "<ul><li><a href=/1>A first source of it</a></li><li><a href=/2>A second source</a></li></ul>"
MENU = "<nav><a href=/>home</a> <a href=/a>about</a></nav>"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("names", ["page", "page has-sidebar", "elementor-widget", "no-comments", "header-sticky layout", "social-enabled", "sidebar-right", "banner"])
def test_wrapper(tag, names):
    assert main_text(f"<body>{MENU}<div class='{names}'><{tag}>{BODY}</{tag}></div><footer>f, f</footer>") == TEXT
    assert main_text(f"<body>{MENU}<div id='{names}'><{tag}>{BODY}</{tag}><div class=sidebar><p>Aside, to it.</p></div></div>") == TEXT


def test_page_wide_form():
    assert main_text(f"<form action=/>{MENU}<div>{BODY}</div><form class=newsletter><p>Mail, please.</p></form></form>") == TEXT


@pytest.mark.parametrize("wrapper", ["div", "article"])
def test_long_comments_are_no_article(wrapper):
    comment = "<article class='comment-body'><p>" + "I, too, think so, and at length. " * 20 + "</p></article>"
    page = f"<div class='page no-sidebar'><{wrapper}>{BODY}</{wrapper}><div class=comments>{comment * 2}</div></div>"
    assert main_text(page) == TEXT


def test_widget_beside_long_comments():
    comments = "<ol class=comment-list><li><p>" + "I, too, think so, and at length. " * 30 + "</p></ol>"
    assert main_text(f"<div class='elementor-widget'>{BODY}</div>{comments}") == TEXT


def test_links_within_the_article_stay():
    assert main_text(f"<article>{LINKS}{BODY}{LINKS}</article>") == TEXT + "\nA first source of it\nA second source"
    assert main_text(f"<article>{BODY}<div class=related>{LINKS}</div></article>") == TEXT


def test_articles_side_by_side():
    card = "<article><a href=/x><h2>Other</h2><p>Teaser, short.</p></a></article>"
    assert main_text(f"<main><article>{BODY}</article><article>{BODY}</article>{card}</main>") == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("names", ["sidebar", "comments", "ad", "widget", "cookie-consent", "site-footer"])
def test_small_suspects_go(names):
    assert main_text(f"<div>{BODY}</div><div class='{names}'><p>Not of it, and short, with commas, many, many.</p></div>") == TEXT
    assert main_text(f"<div class='{names}'></div><article>{BODY}<div class='{names}'><p>Inside, too.</p></div></article>") == TEXT
