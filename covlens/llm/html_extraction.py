"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of inline text in them; each is content
or not. A node's own evidence (tag, class and id words, text length, link
density, place) gives unary potentials, and every parent-child edge a potential
that depends on the child's kind. Sum-product messages go up the tree and down
again, for all pages of a batch level by level, and give exact marginals; text
runs whose marginal is at least one half are the page's text.

The weights are fitted by maximum likelihood on labelled pages: a bounded
sample of pages that mark their article by an element of its own, labelled by
that markup, each also in variants whose element names are replaced by plain
ones with telling class names and to which boilerplate blocks and content
of other kinds (lists, quotes, tables) are added, so
the model does not hang on one way of writing pages.

Defined results: null or empty html, or a page without content, gives the empty
string; a page that stops anywhere is read to its end; a skipped element that is
never closed hides nothing after it; repeated rows give equal
results; without any labelled page in the table the weights come from a fixed
example page; an empty table gives an empty result; only page_id, url and html
are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Bound of the fit: pages of the labelled sample, and its gradient steps.
SAMPLE = 60
STEPS = 120
#: Characters of the pages that are solved together.
BATCH_CHARS = 1 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN_ATTRIBUTE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)

#: Elements whose content is not markup: without an end tag they go on to the end of the page.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements whose content is not text of the page: without an end tag of their own they are read on like inline ones.
SKIPPED = ("noscript", "template", "svg", "select", "button", "object", "video", "audio", "canvas")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)|<body\b" if t == "head" else rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in (*RAW, "head")}
_NO_MARKUP = rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\b|\Z)"
_PAIR = {t: re.compile(rf"{_NO_MARKUP}|<(/?){t}(?![^\s/>])((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.I | re.S) for t in SKIPPED}
VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"])
#: Kinds of block elements; every other element is inline.
KINDS = {
    "body": ["body", "html"], "article": ["article", "main"], "section": ["section", "div", "center"], "paragraph": ["p", "blockquote", "pre", "address"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"], "list": ["ul", "ol", "dl", "menu"], "item": ["li", "dt", "dd"],
    "nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "form": ["form", "fieldset", "dialog", "label", "option"],
    "table": ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"], "figure": ["figure", "figcaption", "details", "summary"], "text": [],
}
NAMES = list(KINDS)
KIND_OF = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags}
TEXT, _PARAGRAPH = NAMES.index("text"), NAMES.index("paragraph")
#: Class and id words that tell what an element is for.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner",
    "side": "sidebar side aside widget rail related recommended trending popular more complementary",
    "comment": "comment comments reply replies respond discussion disqus feedback reviews",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding site",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall",
    "share": "share sharing social follow buttons toolbar print search",
    "content": "content article post entry story text body main prose page",
}
_CUE = {word: i for i, words in enumerate(CUES.values()) for word in words.split()}
BLOCK = frozenset(KIND_OF)
#: An opening tag that closes the open element of its own kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SHUT_IN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


@dataclass
class Page:
    """Nodes of a page in page order; node 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    cues: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, cues: int = 0, text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.cues.append(cues)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _cues(attributes: str) -> int:
    out = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for word in _WORD.findall(m[1] or m[2] or m[3] or ""):
            at = _CUE.get(word.lower())
            if at is not None:
                out |= 1 << at
    return out


def _pairs(source: str, tag: str) -> dict[int, int]:
    """Where each element of a kind starts, and the place after its own end tag; elements without one are left out."""
    out, opened = {}, []
    for m in _PAIR[tag].finditer(source):
        if m[2] == "/" and opened:
            out[opened.pop()] = m.end()
        elif m[2] == "":
            if tag == "svg" and m[3].endswith("/"):
                out[m.start()] = m.end()
            else:
                opened.append(m.start())
    return out


def parse(source: str) -> Page:
    """The block tree of a page with its inline text runs as leaves."""
    page, stack = Page(), [(0, "body")]
    open_tags: Counter[str] = Counter()  # of the stack above the body
    run: list[str] = []
    linked, in_link = 0, 0
    pairs: dict[str, dict[int, int]] = {}

    def close_run() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            page.add("", stack[-1][0], 0, text, min(linked, len(text)))
        run.clear()
        linked = 0

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None or m.start() > at:
            piece = html.unescape(source[at:m.start() if m else n])
            run.append(piece)
            if in_link:
                linked += len(piece)
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                if open_tags[tag]:
                    close_run()
                    in_link = 0
                    while (left := stack.pop()[1]) != tag:
                        open_tags[left] -= 1
                    open_tags[tag] -= 1
        elif tag in _RAW_END:
            end = _RAW_END[tag].search(source, at)
            if end is not None:
                at = end.start() if end[0][1] != "/" else end.end()
            elif tag in RAW:
                break
        elif tag in SKIPPED:
            if tag not in pairs:
                pairs[tag] = _pairs(source, tag)
            at = pairs[tag].get(m.start(), at)
        elif tag == "a":
            in_link += 1
        elif tag in BLOCK:
            if tag in ("body", "html"):
                continue
            close_run()
            in_link = 0
            closes, limits = _CLOSES.get(tag, ()), _SHUT_IN.get(tag, ())
            if KIND_OF[tag] != _PARAGRAPH:
                closes = (*closes, "p")  # a block element ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in closes:
                    open_tags.subtract(t for _, t in stack[i:])
                    del stack[i:]
                    break
                if stack[i][1] in limits or stack[i][1] not in ("p", *closes) and not limits:
                    break
            if not m[3].endswith("/"):
                cues = _cues(m[3])
                if _HIDDEN_ATTRIBUTE.search(m[3]):
                    cues |= 1 << _CUE["notice"]
                stack.append((page.add(tag, stack[-1][0], cues), tag))
                open_tags[tag] += 1
        elif tag == "br" or tag == "hr" or tag == "img":
            run.append(" ")
    close_run()
    return page


FEATURES = len(NAMES) + len(CUES) + 8
#: Kinds that are judged by what they are marked as and by their links alone.
INNER = [NAMES.index(k) for k in ("paragraph", "heading", "list", "item", "table", "figure", "text")]


class Forest:
    """The nodes of several pages with their features, level by level."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.tag) for p in pages])
        self.first = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        shift = np.repeat(self.first, sizes)
        self.parent = np.concatenate([np.array(p.parent) for p in pages]) + shift
        depth = np.concatenate([np.array(p.depth) for p in pages])
        self.parent[depth == 0] = -1
        self.kind = np.array([KIND_OF.get(t, TEXT) for p in pages for t in p.tag])
        cues = np.array([c for p in pages for c in p.cues])
        own = np.array([len(t) for p in pages for t in p.text], float)
        linked = np.array([x for p in pages for x in p.linked], float)
        stops = np.array([sum(map(t.count, ".!?,")) if t else 0 for p in pages for t in p.text], float)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        self.levels = np.split(by_depth, cuts)[1:-1]
        size = own.copy()
        for level in reversed(self.levels):
            for x in (size, linked, stops):
                np.add.at(x, self.parent[level], x[level])
        place = (np.arange(len(depth)) - shift) / np.repeat(sizes, sizes)
        share = size / np.maximum(1, size[self.first])[self.page]
        density = linked / np.maximum(1, size)
        container = ~np.isin(self.kind, INNER)
        outer = np.stack([
            np.ones(len(depth)), np.log1p(size) / 8, share, np.minimum(stops / np.maximum(1, size / 100), 10) / 10, place, place > 0.9,
        ], axis=1)
        self.features = np.hstack([
            np.eye(len(NAMES))[self.kind] * container[:, None], (cues[:, None] >> np.arange(len(CUES)) & 1).astype(float),
            np.stack([density, density > 0.5], axis=1), outer * container[:, None],
        ])

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Sum-product: the log potentials ``unary`` of being content and ``pair`` [kind, parent, child] give
        each node's probability of being content."""
        n = len(unary)
        belief = np.zeros((n, 2))
        belief[:, 1] = unary
        up = np.zeros((n, 2))  # message to the parent, by the parent's state
        for level in reversed(self.levels):
            joint = pair[self.kind[level]] + belief[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            for state in (0, 1):
                np.add.at(belief[:, state], self.parent[level], up[level, state])
        total = belief.copy()  # belief: evidence at and below a node
        for level in self.levels:
            above = total[self.parent[level]] - up[level]
            joint = above[:, :, None] + pair[self.kind[level]] + belief[level][:, None, :]
            total[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))


@dataclass
class TreeModel:
    weights: np.ndarray
    pair: np.ndarray

    def texts(self, sources: list[str | None]) -> list[str]:
        """The main text of each page."""
        pages = [parse(s or "") for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        content = forest.marginals(forest.features @ self.weights, self.pair)
        out = []
        for page, first in zip(pages, forest.first, strict=True):
            keep = content[first:first + len(page.tag)] >= 0.5
            out.append("\n".join(t for t, k in zip(page.text, keep, strict=True) if t and k))
        return out


_BOILERPLATE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "fieldset", "dialog"])
_CONTENT_CUE = 1 << list(CUES).index("content")


def labels(page: Page) -> np.ndarray | None:
    """Content by the page's own markup: inside an article or main element and in nothing marked as something else."""
    state: list[int] = []  # 0 outside, 1 inside, 2 boilerplate
    for tag, parent, cues in zip(page.tag, page.parent, page.cues, strict=True):
        up = state[parent] if parent >= 0 else 0
        boilerplate = up == 2 or tag in _BOILERPLATE_TAGS or cues & ~_CONTENT_CUE
        state.append(2 if boilerplate else 1 if up == 1 or tag in ("article", "main") else 0)
    out = np.array([s == 1 for s in state], float)
    return out if out.any() else None


#: Ways to write the parts of a page: what an element may become in a training variant.
_AS = {
    "article": ["<article{}>", "<main{}>", '<div class="content"{}>', '<div id="post-body"{}>', '<section class="story"{}>'],
    "nav": ["<nav{}>", '<div class="menu"{}>', '<div id="navigation"{}>', '<ul class="breadcrumb"{}>', "<header{}>"],
    "footer": ["<footer{}>", '<div class="footer"{}>', '<div id="copyright"{}>', '<div class="foot"{}>', "<footer{}>"],
}
_PART = re.compile(r"<(/?)(article|nav|footer)\b([^>]*)>", re.I)
_EXTRA = [
    '<div class="comments"><h3>{0}</h3><p>{1}</p><div class="comment"><p>{2}</p></div></div>', "<aside><h3>{0}</h3><p>{1}</p></aside>",
    '<div class="sidebar"><ul><li><a href="/a">{0}</a></li><li>{1}</li></ul></div>', '<form action="/s"><label>{0}</label><p>{1}</p></form>',
    '<div class="cookie-notice"><p>{0}</p></div>', '<div class="ad"><p>{1}</p></div>', '<section id="comments"><p>{2}</p><p>{1}</p></section>',
    "<header><h2>{0}</h2><p>{1}</p></header>", '<div class="related"><h4>{0}</h4><a href="/b">{1}</a></div>',
    '<div class="newsletter subscribe"><p>{2}</p></div>', '<div class="share"><a href="/c">{0}</a></div>',
]
#: Content of other kinds than paragraphs, added inside the article.
_CONTENT = [
    "<ul><li>{0}</li><li>{1}</li></ul>", "<ol><li>{0}</li><li>{1}</li><li>{2}</li></ol>", "<blockquote><p>{1}</p></blockquote>",
    "<table><tr><th>{0}</th><td>{1}</td></tr></table>", "<dl><dt>{0}</dt><dd>{2}</dd></dl>", "<h2>{0}</h2><pre>{1}</pre>",
    "<figure><figcaption>{2}</figcaption></figure>", "<section><h3>{0}</h3><p>{1}</p></section>", "<div><p>{2}</p></div>",
]


def variants(source: str, rng: np.random.Generator) -> list[tuple[Page, np.ndarray]]:
    """The page as it is, and rewritten: other elements for its parts, boilerplate of other kinds added."""
    plain = parse(source)
    marked = labels(plain)
    if marked is None:
        return []
    out = [(plain, marked)]
    texts = [t for t in plain.text if t]
    for nth in range(1, 5):
        extra = [x.format(*(html.escape(texts[i]) for i in rng.integers(0, len(texts), 3))) for x in rng.choice(_EXTRA, 3, replace=False)]
        inner, outer, after = extra
        more = "".join(x.format(*(html.escape(texts[i]) for i in rng.integers(0, len(texts), 3))) for x in rng.choice(_CONTENT, 2, replace=False))
        inner = more + inner if rng.random() < 0.5 else inner + more

        def rewrite(m, nth=nth, inner=inner, outer=outer, after=after):
            new = _AS[m[2].lower()][nth]
            mark = f' data-part="{m[2].lower()}"'
            if m[1]:
                end = f"</{new[1:].split('{')[0].split()[0]}>"
                return (inner if m[2].lower() == "article" else "") + end + (after if m[2].lower() == "article" else "")
            return (outer if m[2].lower() == "article" else "") + new.format(mark)

        # Labels come from the same places: parse with the original names first, both trees have equal shape.
        def keep_names(m, inner=inner, outer=outer, after=after):
            if m[2].lower() != "article":
                return m[0]
            return inner + m[0] + after if m[1] else outer + m[0]

        truth = labels(parse(_PART.sub(keep_names, source)))
        page = parse(_PART.sub(rewrite, source))
        if truth is not None and len(truth) == len(page.tag):
            out.append((page, truth))
    return out


def fit(sources: list[str], steps: int = STEPS) -> TreeModel:
    """Weights by maximum likelihood on the labelled variants of pages."""
    rng = np.random.default_rng(5)
    known = [v for s in sources for v in variants(s, rng)] or variants(_EXAMPLE, rng)
    forest, y = Forest([p for p, _ in known]), np.concatenate([t for _, t in known])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(NAMES), 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    seen += 0.5 + 0.5 * np.eye(2)
    model = TreeModel(np.zeros(FEATURES), np.log(seen / seen.sum(2, keepdims=True)))
    mean, square = np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, steps + 1):
        p = forest.marginals(forest.features @ model.weights, model.pair)
        g = forest.features.T @ (y - p) / len(known) - 1e-3 * model.weights
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        model.weights += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model


_EXAMPLE = (
    '<html><body><nav><ul><li><a href="/a">Start</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, today only.</div>'
    "<article><h1>A walk by the sea</h1><p>We left the house in the morning, and the wind was cold.</p><p>Later the sun came out over the water, "
    "and we sat on the stones for an hour. Nobody spoke.</p><ul><li>Take a coat, a hat and some bread.</li></ul></article>"
    "<footer>&copy; example &middot; All rights.</footer></body></html>"
)


def train(pages: DataFrame, sample: int = SAMPLE) -> TreeModel:
    """A model of about ``sample`` pages that mark their article, drawn by a hash of page_id."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)\\b"))
    rate = sample / max(sample, marked.count())
    unit = F.xxhash64(F.lit(13), "page_id") / F.lit(float(1 << 64)) + F.lit(0.5)
    rows = marked.filter(unit < rate).select("page_id", "html").collect() if rate < 1 else marked.select("page_id", "html").collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["html"]))])


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            sources, texts, first, size = batch.column("html").to_pylist(), [], 0, 0
            for i, s in enumerate(sources):
                size += len(s or "")
                if size > BATCH_CHARS or i == len(sources) - 1:
                    texts += model.texts(sources[first:i + 1])
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(sliced(run), "page_id long, url string, text string, n_chars long")
