"""A forgiving HTML reader: block nodes with their text, in page order.

Raw-text elements (scripts, styles and the like) are skipped to their end tag, or the end of the page, as in
browsers. Controls, drawings and templates (``SKIPPED``) are skipped only if their own end tag follows; without
one, only the start tag is left out. All other elements are read: the contents of math, object, noscript,
canvas, audio and video are text of the block around them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

# Fixed values of HTML: elements by kind.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
#: Elements that show no running text, skipped if they are closed.
SKIPPED = {"button", "select", "svg", "template"}
#: Elements whose contents stand apart from the words around them.
APART = SKIPPED | {"br", "object", "noscript", "canvas", "audio", "video"}
_ARTICLE = {"body", "article", "main"}
VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form",
          "fieldset", "figure", "figcaption", "blockquote", "pre", "p", "h1", "h2", "h3", "h4", "h5", "h6",
          "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption",
          "address", "details", "summary", "dialog", "menu", "center", "hgroup", "search", "legend"}
#: Blocks whose text is theirs; text straight inside other blocks gets a node of its own.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption",
               "pre", "summary", "legend", "address"}
#: A start tag of the key closes an open element of the values, up to the nearest of the last set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "body": ({"head"}, set())}
_LIMITS = {"div", "article", "section", "main", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|!--(?:.*?-->|.*+)|[!?][^>]*+>?|/?[a-zA-Z][^>]*+(?:>|$))""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Parallel lists, one entry a node; parents come before children."""

    tag: list = field(default_factory=list)
    parent: list = field(default_factory=list)
    names: list = field(default_factory=list)  # words of class, id and role
    text: list = field(default_factory=list)  # a text run, or None
    linked: list = field(default_factory=list)  # characters inside links
    links: list = field(default_factory=list)


def _raw_end(source: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(source, at)
    return end.end() if end else len(source)


def _closed(source: str) -> dict[int, int]:
    """Ends of the skipped elements that have their own end tag, by the end of their start tag.

    An element is open until its end tag, unless a block around it ends first; but for templates, also unless
    an article begins in it. A button or select ends where another begins.
    """
    out: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    least: Counter[str] = Counter()  # elements that start before this are taken as unclosed
    at, size = 0, len(source)
    while 0 <= (lt := source.find("<", at)) < size:
        m = _TAG.match(source, lt)
        if not m:
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        alone = m[3].endswith("/")
        if tag in RAW and not ends and not alone:
            at = _raw_end(source, tag, at)
        elif tag in SKIPPED or tag in BLOCKS:
            if not ends:
                if tag in _ARTICLE:
                    least["button"] = least["select"] = least["svg"] = at
                if tag in BLOCKS or not alone:
                    if tag in ("button", "select"):
                        least[tag] = at
                    opened.append((tag, at))
                    count[tag] += 1
            elif count[tag]:
                while True:
                    last, start = opened.pop()
                    count[last] -= 1
                    if last == tag:
                        break
                if tag in SKIPPED and start >= least[tag]:
                    out[start] = at
    return out


def parse(source: str) -> Page:
    page = Page()
    closed = None
    tags, stack = page.tag, []
    places = defaultdict(list)  # places in the stack by tag, so that no tag walks the whole stack
    run: list[str] = []
    state = {"linked": 0, "links": 0, "in_link": False}

    def add(tag, names, text=None, linked=0, links=0):
        tags.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.names.append(names)
        page.text.append(text)
        page.linked.append(linked)
        page.links.append(links)
        return len(tags) - 1

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                top = stack[-1] if stack else -1
                if top >= 0 and tags[top] in TEXT_BLOCKS and page.text[top] is None:
                    page.text[top], page.linked[top], page.links[top] = text, state["linked"], state["links"]
                else:
                    add("#text", (), text, state["linked"], state["links"])
        state["linked"] = state["links"] = 0

    def say(text):
        if "&" in text:
            text = html.unescape(text)
        run.append(text)
        if state["in_link"]:
            state["linked"] += len(text.strip())

    def close(i):
        flush()
        while len(stack) > i:
            places[tags[stack.pop()]].pop()

    stack.append(add("#page", ()))
    places["#page"].append(0)
    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        if lt > at:
            say(source[at:lt])
        m = _TAG.match(source, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag == "a":
            state["in_link"] = not ends
            state["links"] += not ends
        elif tag == "hr":
            flush()
        elif tag == "head":
            flush()
        elif tag in RAW and not ends and not m[3].endswith("/"):
            at = _raw_end(source, tag, at)
        elif tag in APART:
            run.append(" ")
            if tag in SKIPPED and not ends:
                if closed is None:
                    closed = _closed(source)
                at = closed.get(at, at)
        elif tag in BLOCKS:
            if ends:
                if places[tag]:
                    close(places[tag][-1])
                    state["in_link"] = False
                continue
            shut, limit = CLOSES.get(tag, ({"p"}, {"table", "li", "td", "th"}))
            shut = shut | {"p"} | (_HEADINGS if tag in _HEADINGS else set())
            # what the tag closes above the nearest element that holds it in
            nearest = max((places[t][-1] for t in (limit | _LIMITS) - shut if places[t]), default=0)
            above = [at_t[i] for t in shut if (i := bisect_right(at_t := places[t], nearest)) < len(at_t)]
            if above:
                close(min(above))
            flush()
            words = ()
            if m[3] and (found := _NAMES.findall(m[3])):
                words = tuple(_WORD.findall(" ".join(found).lower()))
            node = add(tag, words)
            places[tag].append(len(stack))
            stack.append(node)
    flush()
    return page
