"""HTML extraction (operator 8) by minimum-cut labelling of text blocks.

A page is cut into text blocks, each with its chain of open elements. A logistic classifier over what surrounds a block and
what it looks like gives the cost of calling it content or boilerplate; these become the capacities from the source and to
the sink. Neighbouring blocks, the more the nearer they are in the element tree, are joined by smoothness edges of the same
order. A maximum flow then finds the cut of least cost: blocks on the source's side are the article.

The classifier is fitted on a bounded sample of the pages that are extracted. Pages whose markup says where the article
is (elements of articles, navigation, footers and so on) label their own blocks; each block is learned from with and without that
markup, so that pages that lack it are judged by the rest. A Gaussian prior holds the weights that the sample says
nothing about.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches, rare_gc, same_dtype, slices

# Element names of HTML by what they mean for text.
_RAW = frozenset("script style template noscript iframe canvas video audio select option datalist annotation annotation-xml defs desc metadata symbol".split())
_OPAQUE = frozenset("script style title textarea xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr mspace mprescripts".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics tspan".split()
)
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())}
_SAME = frozenset("li dt dd tr td th option p".split())
# Elements, roles and words of class and id that mark furniture or content.
_FURNITURE = frozenset("nav footer aside form head button dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal overlay share sharing social related recommended widget comment comments disqus respond replies reply pagination pager login search skip tags copyright legal disclaimer".split()
)
_GOOD_WORDS = frozenset("article content post entry story main body text blog page".split())
_SOFT = frozenset("header banner".split())
_COMMENTS = frozenset("comment comments".split())
_MODIFIERS = frozenset("has no with without is not".split())  # has-sidebar tells of the page, not of the element
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STEP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[A-Z]?[a-z\d]+|[A-Z\d]+")  # digits stay with their letters
_READ = frozenset("class id role hidden style aria-hidden".split())
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_STOPS = re.compile(r"[.!?;:,](?:\s|$)")
_OPAQUE_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_OPAQUE, "iframe", "noscript")}

SCALE = 100  # capacities are whole numbers
NEAR, SAME = 2.5, 0.75  # smoothness of two blocks side by side, and of the next block of the same parent's parent
CAP = 8.0  # log odds are kept within it
TRAIN_PAGES, TRAIN_BLOCKS = 400, 40  # pages that the fit reads, and blocks of each: the bound of the sample
EVIDENCE = 50.0  # how many blocks the sample counts as, against the prior
# The features of a block and the prior of their weights (log odds of content). Those before the bias are the page's own markup.
PRIOR = {
    "in_article": 1.2,
    "out_of_article": -4.0,
    "furniture": -5.5,
    "page_header": -5.0,
    "article_links": -1.0,
    "bias": -2.0,
    "role": -5.5,
    "bad_name": -5.0,
    "comment_name": -8.0,
    "bad_text_name": -0.7,
    "good_name": 1.5,
    "length": 4.0,
    "links": -3.5,
    "stops": 0.6,
    "heading": 0.5,
    "link_item": -1.5,
}
FEATURES = list(PRIOR)
_MARKUP, _LINKS = FEATURES.index("bias"), FEATURES.index("links")


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    block: int  # place in the stack of the nearest element that is not inline, itself included
    furniture: bool = False
    header: bool = False  # a header outside an article
    role: bool = False
    bad: float = 0.0  # names that the element or one around it has
    comments: float = 0.0
    good: float = 0.0
    bad_text: float = 0.0
    article: bool = False
    hidden: bool = False
    inline: Counter = field(default_factory=Counter)  # open inline elements directly above a block element


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters inside links


def _element(name: str, attributes: str, parent: Element, place: int) -> Element:
    names: list[str] = []
    e = Element(name, parent, parent.depth + 1, parent.block if name in _INLINE else place, parent.furniture, parent.header, parent.role, parent.bad, parent.comments, parent.good, 0.0, parent.article, parent.hidden or name in _RAW)
    if name in _FURNITURE:
        e.furniture = True
    elif name in ("article", "main"):
        e.article = True
    elif name == "header" and not parent.article:
        e.header = True
    if attributes and not attributes.isspace():
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key not in _READ:
                continue
            value = value.strip("\"'")
            if key == "role":
                e.role |= value.lower() in _ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDES.search(value.lower()):
                e.hidden = True
            elif key in ("class", "id"):
                names += value.split()
    if names and name not in ("html", "body"):
        bad, good, comments = _named(names)
        if name in ("article", "main"):
            bad = 0.0  # an article's names tell of its theme or of the page
        if name in _TEXTUAL or name in _INLINE:
            e.bad_text = float(bad or comments)
        elif comments:
            e.comments, e.good = 1.0, 0.0
        elif bad and not good:
            e.bad, e.good = 1.0, 0.0
        elif good:
            e.good = max(e.good, good)
    return e


def _named(names: list[str]) -> tuple[float, float, float]:
    """What the names of an element's class and id say for furniture, for content and for reader comments. A name that
    holds words of both kinds is one of furniture, except for an article's own header."""
    bad = good = comments = 0.0
    for token in names:
        parts = [w.lower() for w in _PART.findall(token)]
        if not parts or len(parts) > 1 and parts[0] in _MODIFIERS:
            continue
        words = set(parts)
        worse = words & _BAD_WORDS
        if worse and not (words & _GOOD_WORDS and worse <= _SOFT):
            bad = 1.0
            if worse <= _COMMENTS and (len(parts) == 1 or not words & _GOOD_WORDS):
                comments = 1.0
        elif words & _GOOD_WORDS:
            good = max(good, 1.0 if len(parts) == 1 else 0.7)
    return bad, good, comments


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends the tag whose attributes begin at this place; those inside quoted values do not count. -1
    if there is none. last: the last places of > and quotes in the page, so that no search runs to its end in vain."""
    while at <= last[">"]:
        m = _STEP.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at, quote = m.end(), m[0][-1]
        if at <= last[quote]:
            end = page.find(quote, at)
            if end <= last[">"]:  # a quote that would swallow the rest of the page is none
                at = end + 1
    return -1


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, in time that grows with its length. Character references are decoded, white space
    is one space; scripts, styles, hidden elements, comments and the head give none. Tags that are never closed end with
    what they stand in; what begins like a tag and never ends is text."""
    out: list[Block] = []
    stack = [Element("", None, 0, 0)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = links = at = 0
    last = {c: page.rfind(c) for c in ">\"'"}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            top = stack[-1]
            if text and not top.hidden:
                holder = stack[top.block]
                if top.bad_text and top is not holder:
                    holder.bad_text = 1.0
                out.append(Block(text, holder, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].hidden:
            parts.append(text)
            if links:
                linked += len(text)

    def push(e: Element) -> None:
        nonlocal links
        stack.append(e)
        opened[e.name] += 1
        if e.name in _INLINE:
            stack[e.block].inline[e.name] += 1
        links += e.name == "a"

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            e = stack.pop()
            opened[e.name] -= 1
            if e.name in _INLINE:
                stack[e.block].inline[e.name] -= 1
            links -= e.name == "a"

    n = len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last[">"]:
            add(page[at:])
            break
        add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            at = page.find(">", begin) + 1
            continue
        ends = page[begin + 1 : begin + 2] == "/"
        m = _NAME.match(page, begin + 1 + ends)
        stop = _tag_end(page, m.end(), last) if m else -1
        if stop < 0:
            add("<")
            at = begin + 1
            continue
        name, attributes = m[0].lower(), page[m.end() : stop]
        at = stop + 1
        if ends:
            if name == "br" or name == "p" and not opened["p"]:
                flush()
            elif name in _INLINE:
                # An inline end tag closes nothing across a block.
                if stack[stack[-1].block].inline[name]:
                    k = len(stack) - 1
                    while stack[k].name != name:
                        k -= 1
                    close(k)
            elif opened[name]:
                flush()
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name not in _INLINE:
            flush()
            k = stack[-1].block
            other = stack[k].name
            if k and (other == "p" and name in _CLOSES["p"] or other == name and name in _SAME):
                close(k)
        if name in _OPAQUE_END:
            end = _OPAQUE_END[name].search(page, at)
            at = end.end() if end else n
        elif not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
            push(_element(name, attributes, stack[-1], len(stack)))
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    rows = np.zeros((len(blocks), len(FEATURES)))
    has_article = any(b.element.article and not _out(b.element) for b in blocks)
    for row, b in zip(rows, blocks, strict=True):
        e, length = b.element, len(b.text)
        share = min(1.0, b.linked / max(1, length))
        links = share if share > 0.3 else 0.0
        rough = e.name in ("li", "td", "dd", "dt")
        row[:] = (
            e.article,
            has_article and not e.article,
            e.furniture,
            e.header,
            links * e.article,
            1.0,
            e.role,
            e.bad,
            e.comments,
            e.bad_text,
            e.good,
            min(1.0, length / 160),
            links * (not e.article),
            _STOPS.search(b.text) is not None,
            len(e.name) == 2 and e.name[0] == "h" and e.name[1].isdigit(),
            rough and share > 0.6 and not e.article,
        )
    return rows


def _out(e: Element) -> bool:
    return e.furniture or e.role or e.header or e.bad > 0 or e.comments > 0


class Classifier:
    """Log odds that a block is content."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.array(list(PRIOR.values())) if weights is None else weights

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(rows @ self.weights, -CAP, CAP)


def fit(rows: np.ndarray, content: np.ndarray) -> Classifier:
    """The most likely weights under a Gaussian prior of variance 1 around PRIOR, by Newton's steps. Rows are used with and
    without the page's markup, each class of label weighing the same; together they count as EVIDENCE rows."""
    prior = Classifier().weights
    content = content.astype(bool)
    if not content.any() or content.all():
        return Classifier()
    bare = rows.copy()
    bare[:, _LINKS] += bare[:, _MARKUP - 1]  # links count as elsewhere
    bare[:, :_MARKUP] = 0
    x, y = np.concatenate([rows, bare]), np.concatenate([content, content]).astype(float)
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * EVIDENCE
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + (w - prior)
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(w)


def sample_rows(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of blocks of a page that says where its article is, evenly from all of it; none of other pages."""
    blocks = blocks_of(page)
    marked = [i for i, b in enumerate(blocks) if b.element.article or b.element.furniture or b.element.header or b.element.role]
    if not any(blocks[i].element.article for i in marked):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    chosen = marked[:: -(-len(marked) // TRAIN_BLOCKS)]
    rows = features(blocks)[chosen]
    return rows, np.array([blocks[i].element.article and not _out(blocks[i].element) for i in chosen], float)


def train(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Classifier:
    """Fit on at most about train_pages pages, those of the least hashes of their html, and TRAIN_BLOCKS blocks of each. Only
    features come to the driver. Pages without html and tables without marked pages leave the prior."""
    bound_batches(pages.sparkSession)
    source = pages.select(F.col(html_col).alias("__html")).filter("__html is not null")
    n = source.count()
    share = min(1.0, train_pages / max(1, n))
    sample = source.filter(F.pmod(F.xxhash64("__html"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            for page in batch.column(0).to_pylist():
                rows, content = sample_rows(page)
                if len(content):
                    yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([rows, content]).tobytes()], pa.binary())], ["rows"])

    found = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "rows binary").limit(2 * train_pages).collect())
    if not found:
        return Classifier()
    table = np.concatenate([np.frombuffer(x).reshape(-1, len(FEATURES) + 1) for x in found])
    return fit(table[:, :-1], table[:, -1])


def proximity(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut. source and sink: terminal capacities of each node; edges:
    (node, node, capacity both ways). Shortest augmenting paths in levels; of several minimum cuts the one with the fewest
    nodes on the source's side."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]  # what passes a node from source to sink directly is gone
    graph: list[list[list]] = [[] for _ in range(n)]
    for i, j, c in edges:
        if c > 0 and i != j:
            forth, back = [j, c, None], [i, c, None]
            forth[2], back[2] = back, forth
            graph[i].append(forth)
            graph[j].append(back)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= excess[i] < 0
            for j, c, _ in graph[i]:
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in range(n):
            while excess[start] > 0 and level[start] == 0:
                path, i = [], start  # walk down the levels
                while excess[i] >= 0 or i == start:
                    while place[i] < len(graph[i]):
                        j, c, _ = graph[i][place[i]]
                        if c > 0 and level[j] == level[i] + 1:
                            break
                        place[i] += 1
                    else:
                        if not path:
                            i = -1
                            break
                        i = path.pop()[2][0]
                        place[i] += 1
                        continue
                    path.append(graph[i][place[i]])
                    i = path[-1][0]
                if i < 0:
                    break
                flow = min(excess[start], -excess[i], *(e[1] for e in path))
                excess[start] -= flow
                excess[i] += flow
                for e in path:
                    e[1] -= flow
                    e[2][1] += flow


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """The edges: each block and the next, by their distance in the tree; and each block and the last one before it whose
    element has the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(SCALE * NEAR / (1 + proximity(blocks[i - 1].element, b.element) / 2))))
        parent = id(b.element.parent)
        if parent in last:
            edges.append((last[parent], i, round(SCALE * SAME)))
        last[parent] = i
    return edges


def label(blocks: list[Block], classifier: Classifier | None = None) -> list[bool]:
    if not blocks:
        return []
    odds = (classifier or Classifier())(features(blocks))
    source = [round(SCALE * max(0.0, x)) for x in odds.tolist()]
    sink = [round(SCALE * max(0.0, -x)) for x in odds.tolist()]
    return min_cut(source, sink, smoothness(blocks))


def main_text(page: str, classifier: Classifier | None = None) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, label(blocks, classifier), strict=True) if keep)


def extract_text(pages: DataFrame, classifier: Classifier | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (empty if none), n_chars (its code points). Without a classifier one is
    trained on the pages.

    Null and empty html give an empty text. Null ids and urls, repeated rows and pages stay; pages are read whole; equal
    costs go to boilerplate; an empty table gives an empty table; other columns are not read.
    """
    bound_batches(pages.sparkSession)
    weights = (classifier or train(pages, html_col)).weights
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_gc()
        classifier = Classifier(weights)
        for batch in slices(batches, 4 << 20):
            texts = [main_text(h, classifier) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["__id", "__url", "text", "n_chars"])

    schema = f"__id {same_dtype(rows, '__id')}, __url {same_dtype(rows, '__url')}, text string, n_chars bigint"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"__id": id_col, "__url": url_col})
