"""Readers' comments under other names, topics outside marked articles, and the sums once more."""

import random

import pytest

from waymark.llm import html_text

P = "A long paragraph of the story goes on and on with many plain words, so that the windows over its lines are dense enough to count. "
COMMENT = "I read this with care and must say that I disagree with nearly all of it, as would anyone who has seen the place with their own eyes. "


def page(body):
    return f"<html><body><ul class='nav'><li><a href='/'>Home</a></li></ul>{body}<footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("name", ["userComments", "commentSection", "readerComments", "comments-area", "usercomments", "commentbox", "post_comments", "UserComments"])
@pytest.mark.parametrize("mark", ["div", "article"])
def test_comments_by_name(name, mark):
    block = f"<div class='{name}'><p>{COMMENT}</p><p>{COMMENT}</p></div>"
    assert html_text.main_text(page(f"<{mark}><h1>Title</h1><p>{P}</p></{mark}>{block}")) == ("Title " + P).strip()
    assert html_text.main_text(page(f"<{mark}><h1>Title</h1><p>{P}</p>{block}</{mark}>")) == ("Title " + P).strip()


@pytest.mark.parametrize("heading", ["Comments", "3 comments", "Comments (12)", "Replies", "Reader comments:", "12 Responses", "Responses"])
def test_comments_by_heading(heading):
    block = f"<section id='readers'><h2>{heading}</h2><p>{COMMENT}</p><div><p>{COMMENT}</p></div></section>"
    assert html_text.main_text(page(f"<div><h1>Title</h1><p>{P}</p></div>{block}")) == ("Title " + P).strip()
    if heading != "Responses":
        assert html_text.main_text(page(f"<article><h1>Title</h1><p>{P}</p>{block}</article>")) == ("Title " + P).strip()


def test_a_heading_over_comments_ends_with_the_next_heading():
    body = f"<div><h1>Title</h1><p>{P}</p><h3>Comments</h3><p>{COMMENT}</p><h2>Part two</h2><p>{P}</p></div>"
    got = html_text.main_text(page(body))
    assert COMMENT.strip() not in got and P.strip() in got
    # a section of an article that only says responses is a section
    body = f"<article><h1>Title</h1><p>{P}</p><h2>Responses</h2><p>{P}</p></article>"
    assert html_text.main_text(page(body)).count(P.strip()) == 2
    assert html_text.main_text("<h2>Comments</h2>") == "Comments"  # nothing around it to end
    assert html_text.main_text("<div><h2>Comments</h2><p>x</div></div>") == ""


@pytest.mark.parametrize("name", ["social-history", "searchTheory", "related-work", "navigation_at-sea"])
def test_topics_outside_marks(name):
    body = f"<div><h1>Title</h1><p>{P}</p><div class='{name}'><p>{P}</p><p>{P}</p></div></div>"
    assert html_text.main_text(page(body)).count(P.strip()) == 3
    sparse = f"<div><h1>Title</h1><p>{P}</p><div class='{name}'><p>Two words</p></div></div>"
    assert "Two words" not in html_text.main_text(page(sparse))


@pytest.mark.parametrize("name", ["related", "related-posts", "socialButtons", "social", "search-results", "share social-links"])
def test_furniture_outside_marks(name):
    body = f"<div><h1>Title</h1><p>{P}</p></div><div class='{name}'><p>{COMMENT}</p><p>{COMMENT}</p></div>"
    assert COMMENT.strip() not in html_text.main_text(page(body))


def plain_stretch(sizes):
    """The rule from the start: blocks between empty lines, dense if some window in them is; a block that is dense at once goes on over one empty line."""
    blocks, at = [], None
    for i, s in enumerate([*sizes, 0]):
        if s and at is None:
            at = i
        elif not s and at is not None:
            blocks.append((at, i))
            at = None
    window = lambda i, end: sum(sizes[i : min(i + 3, end)])
    joined = []
    for start, end in blocks:
        dense = max(window(i, end) for i in range(start, end)) >= 90
        if joined and joined[-1][1] + 1 == start and joined[-1][2] and window(start, end) >= 90:
            joined[-1] = (joined[-1][0], end, True)
        else:
            joined.append((start, end, dense))
    found = [j for j in joined if j[2]] or [(s, e, False) for s, e in blocks] or [(0, 0, False)]
    return max(found, key=lambda j: (sum(sizes[j[0] : j[1]]), -j[0]))[:2]


def test_sums_against_plain():
    rng = random.Random(12)
    for _ in range(3000):
        sizes = [rng.choice([0, 0, 5, 30, 31, 60, 89, 90, 200]) for _ in range(rng.randrange(0, 14))]
        assert html_text.surge_and_dive(sizes) == plain_stretch(sizes), sizes
