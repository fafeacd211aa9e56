"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to one line a block element. The text length summed over a
sliding window of lines surges where the article starts and dives where it ends;
the text between the surge point and the dive point is the article. Elements
that are never article text (scripts, menus, forms, comments of readers, ...)
leave empty lines, so that they pull the sums down. The sums decide on every
page: on the given pages they alone find the whole article, with its marks
(``article``, ``main``, ...) or without. Marks are a second feature for pages
whose lines aren't so well apart: where the stretch found is an article that the
page marks, its ends are moved to the marks, but marks never displace a stretch
with more text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import append_from_text

#: Lines in a window, and the window sum from which text counts as dense.
WINDOW, DENSE = 3, 90

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr del nobr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
_NEVER = frozenset("head nav aside footer form button select dialog menu audio video canvas map datalist fieldset".split())
_CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_NAMES = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label|aria-hidden|hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|advertorial|banner|sponsor|sponsored|promo|promoted|promotion|sidebar|side-bar|aside|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|crumbs|topbar|footer|bottombar|cookie|cookies|consent|gdpr|"
    r"notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchbox|comment|comments|commentlist|disqus|"
    r"replies|reply|respond|responses|discussion|related|recommended|recommendations|share|sharing|social|tags|pagination|pager|"
    r"widget|toolbar|skip|copyright|complementary|contentinfo|paywall)(?:$|[\s_-])",
    re.I,
)
#: Of these, the ones that are also topics: inside the article a block so named goes only if its own text isn't dense.
_TOPIC = re.compile(
    r"(?<![^\s_-])(?:discussion|related|search|notice|notices|alert|recommendations|responses|navigation|advertising|promotion|social|sharing)(?![^\s_-])", re.I
)
#: Words beside a topic word that make a block furniture of the page: related-posts, social-buttons.
_FURNITURE = frozenset(
    "post posts article articles story stories link links item items list lists box bar block blocks button buttons icon icons media content contents section sections widget "
    "widgets form forms result results wrapper wrap container inner outer area panel row col group top bottom left right header head title text more".split()
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Names of readers' comments that are written in one word.
_COMPOUND = re.compile(
    r"(?:^|[\s_-])(?:(?:users?|readers?|visitors?|guests?|post|article|page)comments?|comments?(?:section|area|box|block|thread|threads|wrapper|wrap|container|form|feed|body|text|author|meta))(?:$|[\s_-])",
    re.I,
)
#: A heading over what readers wrote; the others need a number, or a place outside a marked article.
_READERS = re.compile(r"\W*(?:\d+\s+)?(?:(?:all|latest|recent|your|reader|readers'?|reader's|user|visitor)\s+)?(?:comments?|replies)(?:\s*\(?\d+\)?)?\W*", re.I)
_RESPONSES = re.compile(r"\W*(?:(\d+)\s+)?(?:reader\s+|user\s+)?(?:responses|reactions|thoughts)(?:\s*\(?(\d+)\)?)?\W*", re.I)
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Outside the article these head the page, inside they head the article.
_HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Of these, the ones that stand in the middle of articles: no end of the text is near.
_WITHIN = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|share|sharing|social|newsletter|subscribe|subscription|widget|related|paywall)(?:$|[\s_-])", re.I)
_KEPT = re.compile(r"(?:^|[\s_-])(?:article|article-body|articlebody|post-content|entry-content|story|story-body|main-content|maincontent)(?:$|[\s_-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named_away(value: str) -> bool:
    return bool(_AWAY.search(value) or _COMPOUND.search(value))


def _may_be_topic(value: str, in_article: bool) -> bool:
    """Whether names of furniture may name a topic. Outside a marked article only together with a word that is none of furniture."""
    if _named_away(_TOPIC.sub(" ", value)):
        return False
    if in_article:
        return True
    return all(any(w and w not in _FURNITURE and not _TOPIC.fullmatch(w) for w in re.split(r"[_-]+", name.lower())) for name in value.split() if _TOPIC.search(name))


def _heads_comments(text: str, in_article: bool) -> bool:
    """Whether a heading stands over what readers wrote."""
    if _READERS.fullmatch(text):
        return True
    found = _RESPONSES.fullmatch(text)
    return bool(found and (found[1] or found[2] or not in_article))


def _judge(name: str, attributes: str, in_article: bool) -> tuple[bool, int, bool]:
    """Whether the element is never article text; how surely it marks the article (0 to 2); whether its own text is still to decide."""
    doubt = False
    away = name in _NEVER or name == "header" and not in_article
    mark = 2 if name == "article" else 1 if name == "main" else 0
    if "=" in attributes or "hidden" in attributes:
        for found in _NAMES.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
                away = True
            elif key in ("class", "id", "role", "aria-label"):
                value = _CAMEL.sub("-", value)
                if key != "role" and name not in _INLINE and name not in ("html", "body") and _AWAY.search(value) and _may_be_topic(value, in_article):
                    doubt = True
                elif name not in ("html", "body") and (_named_away(value) or not in_article and not mark and _HEADS.search(value)):
                    away = True
                elif key == "role" and value == "article":
                    mark = 2
                elif key == "role" and value == "main" or key != "aria-label" and _KEPT.search(value):
                    mark = max(mark, 1)
            elif key == "itemprop":
                if value.lower() == "articlebody":
                    mark = 2
                elif value.lower() == "comment":
                    away = True
    return away, 0 if away else mark, doubt and not away


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, surest mark of the article around it, characters in links) for each block; blocks that are never text are empty."""
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, never text, surest mark around, first line if its text is to decide (or -1)
    away = links = linked = 0
    silenced: list[tuple[int, int]] = []  # depth of an element that a heading over comments has ended, and the heading's rank
    marked = lambda: stack[-1][2] if stack else 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            lines.append((text, marked(), min(linked, len(text))))
        linked = 0

    def leave() -> None:
        nonlocal away, links
        if stack[-1][3] >= 0:
            flush()
        name, was_away, _, first = stack.pop()
        if silenced and silenced[-1][0] == len(stack):
            silenced.pop()
        if first >= 0 and max(window_sums(plain_sizes(lines[first:])), default=0) < DENSE:
            del lines[first:]
        away -= was_away
        links -= name == "a"

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at and not away:
            text = page[at : tag.start()]
            parts.append(text)
            if links:
                linked += len(text.strip())
        at = tag.end()
        if not tag[3]:
            if tag[1]:
                parts.append(" ")
            elif tag[0][:9] == "<![CDATA[" and not away:
                parts.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        name = tag[3].lower()
        if name not in _INLINE:
            flush()
        if tag[2]:
            if any(x[0] == name for x in reversed(stack)):
                while stack[-1][0] != name:
                    leave()
                leave()
                # what follows a heading over comments, up to the end of the element or a heading of its rank, is no text
                if name in _HEADINGS and stack and not away and lines and _heads_comments(lines[-1][0], marked() > 0):
                    lines[-1] = ("", marked(), 0)
                    silenced.append((len(stack) - 1, _HEADINGS[name]))
                    stack[-1] = (stack[-1][0], True, *stack[-1][2:])
                    away += 1
        elif name not in _VOID and not tag[4].endswith("/"):
            while stack and stack[-1][0] in _CLOSED_BY_NEXT.get(name, ()):
                leave()
            if silenced and silenced[-1][0] == len(stack) - 1 and _HEADINGS.get(name, 9) <= silenced[-1][1]:
                silenced.pop()
                stack[-1] = (stack[-1][0], False, *stack[-1][2:])
                away -= 1
            is_away, mark, doubt = _judge(name, tag[4], marked() > 0)
            if is_away and lines and lines[-1][0] and not _WITHIN.search(" ".join(re.findall(r"[\"'=]([^\"'=]+)", tag[4]))):
                lines.append(("", marked(), 0))
            stack.append((name, is_away, max(mark, marked()), len(lines) if doubt and not away else -1))
            away += is_away
            links += name == "a"
    if at < len(page) and not away:
        parts.append(page[at:])
    flush()
    while stack:
        leave()
    return lines


def plain_sizes(lines: list[tuple[str, int, int]]) -> list[int]:
    """Text length of each line; lines that are mostly links have none."""
    return [0 if linked * 2 > len(text) else len(text) for text, _, linked in lines]


def window_sums(sizes: list[int], window: int = WINDOW) -> list[int]:
    """Text in the window that starts at each line; it ends early at an empty line."""
    sums = [0] * len(sizes)
    for i in range(len(sizes)):
        for s in sizes[i : i + window]:
            if not s:
                break
            sums[i] += s
    return sums


def surge_and_dive(sizes: list[int], window: int = WINDOW, dense: int = DENSE) -> tuple[int, int]:
    """First and last line (exclusive) of the stretch with the most text whose sliding window sums are dense.

    A window ends early at an empty line. Text surges where the window sum
    reaches ``dense``; the lines that touch it from above (headings, bylines)
    belong to it. The dive point is the next empty line, unless the line right
    behind that one is dense at once. With no dense window the longest stretch
    without an empty line is taken; of equal stretches the first.
    """
    n = len(sizes)
    sums = window_sums(sizes, window)
    stretches: list[list[int]] = []  # start, end, text
    at = 0
    while at < n:
        if not sizes[at]:
            at += 1
            continue
        end = at
        while end < n and sizes[end]:
            end += 1
        if sums[at] >= dense and stretches and stretches[-1][1] + 1 == at:
            stretches[-1][1:] = [end, stretches[-1][2] + sum(sizes[at:end])]
        elif max(sums[at:end]) >= dense:
            stretches.append([at, end, sum(sizes[at:end])])
        at = end
    if not stretches:
        at = 0
        while at < n:
            end = at
            while end < n and sizes[end]:
                end += 1
            stretches.append([at, end, sum(sizes[at:end])])
            at = end + 1
    best = max(stretches, key=lambda x: (x[2], -x[0]), default=[0, 0, 0])
    return best[0], best[1]


def main_text(page: str | None) -> str:
    """Text between the surge and the dive point; empty if the page has no text.

    No line inside a marked article is a dive. The marks that hold most of the
    stretch found, or all of it that is dense, bound it: the lines so marked are
    the article. A stretch outside the marks stands for itself, with the marked
    lines beside it if they hold at least as much text altogether.
    """
    lines = [x for x in lines_of(page or "") if x[0] or not x[1]]
    sizes = [len(x[0]) if x[1] else size for x, size in zip(lines, plain_sizes(lines), strict=True)]
    start, end = surge_and_dive(sizes)
    found, whole = range(start, end), sum(sizes[start:end])
    for mark in (2, 1):
        own = [i for i, x in enumerate(lines) if x[1] == mark]
        # a surer mark counts within this one or the stretch, not elsewhere
        inside = [i for i in range(min([start, *own]), max([end - 1, *own]) + 1) if lines[i][1] >= mark]
        held = sum(sizes[i] for i in found if lines[i][1] >= mark)
        outside = [0 if lines[i][1] >= mark else sizes[i] for i in found]
        if held and (held * 2 >= whole or max(window_sums(outside)) < DENSE):
            found = inside
            break
        if not held and inside and sum(sizes[i] for i in inside) >= whole:
            found = sorted({*found, *inside})
            break
    return " ".join(lines[i][0] for i in found if lines[i][0])


def extract_text(df: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append text (empty if none) and n_chars (code points) of each page.

    Null and empty pages have an empty text; pages of any length are read whole
    and nothing of the article is capped.
    """
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def work(pages: list) -> list[pa.Array]:
            texts = [main_text(p) for p in pages]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

        return work

    return append_from_text(df, page, fields, make, keep)
