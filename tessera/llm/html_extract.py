"""Main text of web pages: boosted trees over DOM nodes and a decoding along the tree.

A page becomes a tree of block nodes (``html_dom``). Each node is described by its tag, the words of
its class, id and role, its depth, the density of text, links and blocks in its subtree, its share
and place in the page, its siblings and its ancestors. Boosted trees give each node log-odds of
belonging to the main text. Decoding maximises their sum over the tree with one constraint: a
node is kept only if its parent is kept, so no ancestor and descendant contradict each other.

The trees are fitted on at most ``SAMPLE_PAGES`` pages (smallest id hashes) and ``SAMPLE_NODES`` nodes
of each. Labels are weak: pages that mark their article, less marked boilerplate inside it. Each
sampled page is also shown with the marking replaced by neutral elements, with and without telling
class names, and with added boilerplate of its own words, so the trees learn from the other features too.

Pages are parsed where they lie, one pass, no shuffle. Nulls: null html is an empty page, whose text
is empty; null ids and urls are returned as they are, repeated rows each. Without usable labels a
node counts as main text unless its tag or names say otherwise. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import boosting
from tessera.llm.common import prepare
from tessera.llm.html_dom import Page, parse

SAMPLE_PAGES = 300
SAMPLE_NODES = 300

# The words by which pages name their parts.
GOOD_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text", "prose"}
BAD_WORDS = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
             "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "dialog",
             "discussion", "feedback", "foot", "footer", "form", "gdpr", "head", "header", "legal", "links", "login",
             "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager",
             "pagination", "popup", "promo", "recommended", "related", "replies", "reply", "respond", "search",
             "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags",
             "toolbar", "topbar", "widget"}
BAD_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "search", "fieldset"}
GOOD_TAGS = {"article", "main"}
_TAG_GROUPS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"},
               {"div", "section"}, {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"},
               {"form", "fieldset"}, {"td", "th", "tr", "table"}, {"#text"}, {"body", "html", "#page"},
               {"pre", "blockquote", "figure", "figcaption"}]
_GROUP = {tag: i for i, tags in enumerate(_TAG_GROUPS) for tag in tags}
_NO_GROUP = len(_TAG_GROUPS)
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights|cookie", re.I)


def _bad(tag: str, names) -> bool:
    return tag in BAD_TAGS or any(w in BAD_WORDS for w in names)


class Nodes:
    """The nodes of many pages as arrays."""

    def __init__(self, pages: list[Page]):
        self.pages = pages
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        offset = np.repeat(self.first, sizes)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        self.parent = np.where(parent >= 0, parent + offset, -1)
        self.depth = np.zeros(len(parent), np.int64)
        depths = []
        for p in pages:
            own: list[int] = []
            for up in p.parent:
                own.append(own[up] + 1 if up >= 0 else 0)
            depths += own
        self.depth = np.array(depths, np.int64)
        order = np.argsort(self.depth, kind="stable")
        ends = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def down(self, values: np.ndarray) -> np.ndarray:
        """Sums over proper ancestors."""
        out = np.zeros(len(values))
        for level in self.levels[1:]:
            up = self.parent[level]
            out[level] = out[up] + values[up]
        return out


def describe(nodes: Nodes) -> np.ndarray:
    """The feature matrix of the nodes."""
    pages = nodes.pages
    tags = [t for p in pages for t in p.tag]
    names = [n for p in pages for n in p.names]
    texts = [t or "" for p in pages for t in p.text]
    n = len(tags)

    def numbers(values):
        return np.fromiter(values, np.float64, n)

    chars = numbers(map(len, texts))
    linked = np.minimum(chars, numbers(x for p in pages for x in p.linked))
    links = numbers(x for p in pages for x in p.links)
    words = numbers(t.count(" ") + 1 if t else 0 for t in texts)
    stops = numbers(t.count(".") + t.count(",") for t in texts)
    legal = numbers(bool(len(t) < 500 and _LEGAL.search(t)) for t in texts)
    group = np.fromiter((_GROUP.get(t, _NO_GROUP) for t in tags), np.int64, n)
    good = numbers(t in GOOD_TAGS or any(w in GOOD_WORDS for w in ws) for t, ws in zip(tags, names))
    bad = numbers(_bad(t, ws) for t, ws in zip(tags, names))

    all_chars, all_linked, blocks = nodes.up(chars), nodes.up(linked), nodes.up(np.ones(n))
    page_chars = all_chars[nodes.first][nodes.page]
    before = np.cumsum(chars) - chars
    before -= before[nodes.first][nodes.page]
    up = np.maximum(nodes.parent, 0)
    own_density = linked / np.maximum(chars, 1)
    density = all_linked / np.maximum(all_chars, 1)
    # siblings: nodes with one parent, in page order
    order = np.lexsort((np.arange(n), nodes.parent))
    same = nodes.parent[order][1:] == nodes.parent[order][:-1]
    previous, following = np.full(n, -1), np.full(n, -1)
    previous[order[1:][same]] = order[:-1][same]
    following[order[:-1][same]] = order[1:][same]
    siblings = np.bincount(up, minlength=n)[up]
    rank = np.zeros(n)
    starts = np.r_[0, np.flatnonzero(~same) + 1] if n else np.zeros(0, np.int64)
    rank[order] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))

    def of(index, values):
        return np.where(index >= 0, values[index], -1.0)

    columns = [
        np.log1p(chars), np.log1p(all_chars), own_density, density, links, words, chars / np.maximum(words, 1),
        stops / np.maximum(words, 1), legal, nodes.up(legal), good, bad, nodes.down(good), nodes.down(bad),
        nodes.up(good) - good, nodes.up(bad) - bad,
        nodes.depth, np.log1p(blocks), all_chars / np.maximum(blocks, 1), all_chars / np.maximum(page_chars, 1),
        before / np.maximum(page_chars, 1), (before + all_chars) / np.maximum(page_chars, 1),
        siblings, rank, rank / np.maximum(siblings, 1), of(previous, np.log1p(all_chars)), of(previous, density),
        of(following, np.log1p(all_chars)), of(following, density), density[up],
        all_chars / np.maximum(all_chars[up], 1), *[(group == g) for g in range(_NO_GROUP + 1)],
        *[(group[up] == g) for g in (4, 5, 6, 8)],
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1) if n else np.zeros((0, len(columns)))


def weak_labels(page: Page) -> list[int] | None:
    """1 for nodes of, or around, the marked article without marked boilerplate; None if unmarked."""
    inside, label = [], [0] * len(page.tag)
    for i, (tag, up, names) in enumerate(zip(page.tag, page.parent, page.names)):
        above = inside[up] if up >= 0 else 0  # 0 outside, 1 in the article, -1 in boilerplate
        own = above
        if above >= 0 and tag not in GOOD_TAGS and _bad(tag, names):
            own = -1
        elif above == 0 and tag in GOOD_TAGS:
            own = 1
        inside.append(own)
        label[i] = int(own == 1)
    if not any(label):
        return None
    for i in range(len(label) - 1, 0, -1):
        if label[i] and page.parent[i] >= 0:
            label[page.parent[i]] = 1
    return label


def _variants(source: str, seed: int) -> list[tuple[Page, list[int]]]:
    """A labelled page as it is, and with its marking hidden in neutral elements."""
    page = parse(source)
    if weak_labels(page) is None:
        return []
    rng = random.Random(seed)
    words = [w for t in page.text if t for w in t.split()][:400] or ["x"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    def items(n):
        return "".join(f'<li><a href="#">{prose(rng.randint(1, 4))}</a></li>' for _ in range(n))

    extra = [
        lambda: f'<div class="{rng.choice(["comments", "comment-list", "discussion"])}">' + "".join(
            f'<div class="comment"><p>{prose(rng.randint(5, 60))}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>",
        lambda: f"<aside><h3>{prose(2)}</h3><ul>{items(rng.randint(2, 8))}</ul></aside>",
        lambda: f'<div class="{rng.choice(["cookie-notice", "consent", "notice", "banner"])}"><p>{prose(rng.randint(5, 30))}</p></div>',
        lambda: f'<form><label>{prose(3)}</label><input name="q"></form>',
        lambda: f'<div class="{rng.choice(["related", "share", "newsletter", "sidebar", "ads", "sponsored"])}"><p>{prose(rng.randint(3, 40))}</p><ul>{items(3)}</ul></div>',
        lambda: f"<header><p>{prose(rng.randint(2, 10))}</p></header>",
    ]
    def reshaped():
        """The page with or without its menu, a shorter article, lists, headings and quotes in it."""
        text = re.sub(r"<nav.*?</nav>", "", source, flags=re.S | re.I) if rng.random() < 0.5 else source
        head, mark, rest = text.partition("<article")
        own, end, tail = rest.partition("</article>")
        first, *parts = own.split("<p>")
        if parts and rng.random() < 0.4:
            parts = parts[:rng.randint(1, len(parts))]
        made = [first]
        for part in parts:
            kind = rng.random()
            if kind < 0.08:
                made.append(f"<h2>{prose(rng.randint(2, 8))}</h2>")
            elif kind < 0.16:
                made.append("<ul>" + "".join(f"<li>{prose(rng.randint(3, 25))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.2:
                made.append(f"<blockquote><p>{prose(rng.randint(5, 30))}</p></blockquote>")
            made.append("<p>" + part)
        return head + mark + "".join(made) + end + tail

    richer = reshaped()
    for make in rng.sample(extra, 3):
        place = rng.choice(["<article", "</article>", "<footer"])
        at = richer.lower().find(place)
        if at >= 0:
            richer = richer[:at] + make() + richer[at:]
    out = [(page, weak_labels(page))]
    for source_, named in ((richer, None), (richer, True), (reshaped(), False), (reshaped(), True)):
        other = parse(source_)
        label = weak_labels(other)
        if label is None:
            continue
        for i, tag in enumerate(other.tag):
            if named is None or tag not in GOOD_TAGS | BAD_TAGS:
                continue
            word = rng.choice(sorted(GOOD_WORDS)) if tag in GOOD_TAGS else tag
            other.tag[i] = "div"
            other.names[i] = (word,) if named else ()
        out.append((other, label))
    return out


def _training_rows(batches):
    for batch in batches:
        keys, xs, ys = [], [], []
        for key, source in zip(batch.column("_order").to_pylist(), batch.column("_html").to_pylist()):
            found = _variants(source or "", key)
            if not found:
                continue
            x = describe(Nodes([p for p, _ in found]))
            y = np.array([v for _, label in found for v in label])
            step = max(1, -(-len(y) // (SAMPLE_NODES * len(found))))
            for i in range(0, len(y), step):
                keys.append(key)
                xs.append(x[i].astype(np.float32))
                ys.append(int(y[i]))
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(xs, pa.list_(pa.float32())),
                               pa.array(ys, pa.int32())], names=["_order", "x", "y"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *,
        sample_pages: int = SAMPLE_PAGES) -> boosting.Boosted | None:
    """Boosted trees from a bounded sample; None if it has no two classes."""
    prepare(pages.sparkSession)
    order = F.xxhash64(F.col("_id").cast("string"))
    ids = (pages.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
           .orderBy(order, "_id").limit(sample_pages))
    sample = (pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
              .join(F.broadcast(ids), "_id").select(order.alias("_order"), "_html"))
    rows = sample.mapInArrow(_training_rows, "_order long, x array<float>, y int").toArrow()
    y = rows.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows.column("x").combine_chunks().values.to_numpy(), np.float64).reshape(len(y), -1)
    by = np.lexsort((*x.T[:4], y, rows.column("_order").to_numpy()))  # the order of tasks doesn't matter
    return boosting.fit(x[by], y[by].astype(np.float64))


def decode(nodes: Nodes, log_odds: np.ndarray) -> np.ndarray:
    """The best set of kept nodes in which every kept node's parent is kept."""
    total = log_odds.astype(np.float64).copy()
    for level in nodes.levels[:0:-1]:
        np.add.at(total, nodes.parent[level], np.maximum(total[level], 0))
    kept = total > 0
    for level in nodes.levels[1:]:
        kept[level] &= kept[nodes.parent[level]]
    return kept


def main_texts(sources: list[str | None], model: boosting.Boosted | None) -> list[str]:
    nodes = Nodes([parse(s or "") for s in sources])
    if not len(nodes.page):
        return []
    if model is None:
        flags = [_bad(t, ws) for p in nodes.pages for t, ws in zip(p.tag, p.names)]
        log_odds = np.where(flags, -1e6, 1.0)
    else:
        log_odds = model.log_odds(describe(nodes))
    kept = decode(nodes, log_odds)
    out = []
    for page, first in zip(nodes.pages, nodes.first.tolist()):
        own = kept[first:first + len(page.tag)].tolist()
        out.append("\n".join(t for t, k in zip(page.text, own) if t and k))
    return out


def _extract(model):
    def run(batches):
        for batch in batches:
            texts = main_texts(batch.column("_html").to_pylist(), model)
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    model = fit(pages, id_col, html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    types = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extract(model), f"page_id {types[0]}, url {types[1]}, text string, n_chars long")
