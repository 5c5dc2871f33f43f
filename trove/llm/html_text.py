"""HTML extraction by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A block's log-odds of being content have two parts:

* markup: is it inside the page's main element (the <main> or article that holds most text), and do tags and names on its
  way to the root speak for menus, notices, comments and the like; a name counts by whole words of one class or id, names
  of layout states (has-sidebar, no-comments) don't count, and nothing that holds the main element or most of the page's
  text is boilerplate for its name;
* text: a logistic classifier over length, links, punctuation and the block's tag. It is fitted on a bounded sample of
  pages (SAMPLE_PAGES, those of least hash) whose markup labels their blocks, from a prior that is used as it is where no
  page is so labelled. The strength of smoothing is fitted on the same sample with the markup's evidence withheld.

Their logistic costs are the capacities of a block's edges to the two terminals. Edges between neighbours in page order,
weaker with distance in the DOM, and between the children of one element make labels smooth. A maximum flow separates
content from boilerplate at least total cost. Blocks whose evidence outweighs all their edges are decided first, which is
exact; the flow runs over the others.

Defined cases: null or empty html gives empty text; any markup is read, closed or not; very long pages are read whole, in
time that grows with their length; text before any tag is a block like others; ties in the cut go to boilerplate;
repeated rows give repeated results; an empty table an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_PAGES = 300

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_RAW = frozenset("script style textarea title xmp".split())  # their text is never prose; to the end if not closed
_HIDDEN = frozenset("noscript template noembed noframes svg iframe object select button canvas audio video datalist".split())  # the same, if they are closed
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BREAKS = frozenset(["hr"])
#: an open element that the start of another one ends
_ENDS = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# evidence of markup, as log-odds
INSIDE, OUTSIDE, STRONG, WEAK, GOOD = 5.0, -4.5, -13.0, -7.0, 1.5
TEXT_LIMIT = 2.5  # the text's evidence stays within this
_BAD_TAGS = {"nav": STRONG, "footer": STRONG, "aside": STRONG, "menu": STRONG, "dialog": STRONG, "form": WEAK, "fieldset": WEAK, "option": WEAK, "header": WEAK}
_STRONG_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr popup
    sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs crumbs footer contentinfo copyright comment comments commentlist disqus reply replies respond discussion
    share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets skip""".split()
)
_WEAK_NAMES = frozenset("notice notices notification notifications alert alerts banner banners modal overlay side search searchbox form feedback toolbar topbar masthead header tags tag complementary teaser".split())
_GOOD_NAMES = frozenset("article articlebody content post entry story main body text maintext prose".split())
_STATES = frozenset("has no with without is not hide show enabled disabled open closed".split())
_KINDS = frozenset("category tag type status format".split())  # tag-news: what a post is about
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def name_evidence(names: str) -> float:
    """The evidence of an element's class, id and role: that of the worst of them."""
    worst = best = 0.0
    for name in names.split():
        words = _WORDS.findall(_CAMEL.sub("-", name).lower())
        if not _STATES.isdisjoint(words) or (len(words) > 1 and words[0] in _KINDS):
            continue
        good = not _GOOD_NAMES.isdisjoint(words)
        if not _STRONG_NAMES.isdisjoint(words):
            worst = STRONG
        elif not _WEAK_NAMES.isdisjoint(words if not good else [w for w in words[-1:] if w != "header"]):
            worst = min(worst, WEAK)
        elif good:
            best = GOOD
    return worst or best


class Element:
    __slots__ = ("bad", "chars", "depth", "good", "inside", "main", "parent", "tag")

    def __init__(self, tag: str, parent: Element | None, names: str) -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        found = name_evidence(names) if names else 0.0
        self.main = tag in ("main", "article") or "articlebody" in names.lower() or "main" in names.split()
        self.bad = min(found, _BAD_TAGS.get(tag, 0.0)) if tag not in ("html", "body", "main") else 0.0
        self.good = max(found, 0.0)
        self.chars, self.inside = 0, False


class Block(NamedTuple):
    text: str
    element: Element
    linked: float  # the part of its characters that are links


def _skip(page: str, tag: str, at: int) -> int:
    """Where an element that began before `at` ends; len(page) if it is not closed."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """All elements, parents first, and the blocks in page order. Each character is looked at a bounded number of times."""
    root = Element("", None, "")
    stack, elements, out = [root], [root], []
    open_tags: Counter[str] = Counter()
    closed_last: dict[str, int] = {}
    parts: list[str] = []
    linked = link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1], min(1.0, linked / len(text))))
                stack[-1].chars += len(text)
            parts.clear()
        linked = 0

    def text(lo: int, hi: int) -> None:
        nonlocal linked
        if hi > lo:
            parts.append(page[lo:hi])
            linked += link * (hi - lo)

    at, last = 0, page.rfind(">")
    while 0 <= (lt := page.find("<", at)) < last:
        if page.startswith("<!--", lt):
            text(at, lt)
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            text(at, lt)
            at = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag in _RAW:
            if not closing:
                at = _skip(page, tag, at)
        elif tag in _HIDDEN:
            if not closing:
                if tag not in closed_last:
                    ends = list(re.compile(rf"</{tag}(?=[\s/>])", re.I).finditer(page, at))
                    closed_last[tag] = ends[-1].start() if ends else -1
                if at <= closed_last[tag]:
                    at = _skip(page, tag, at)
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BREAKS:
            flush()
        elif tag in _BLOCK:
            flush()
            link = 0
            if closing:
                if open_tags[tag]:
                    while True:
                        gone = stack.pop().tag
                        open_tags[gone] -= 1
                        if gone == tag:
                            break
            else:
                while tag in _ENDS.get(stack[-1].tag, ()):
                    open_tags[stack.pop().tag] -= 1
                names = " ".join(next(filter(None, x), "") for x in _NAMES.findall(m[3])) if "=" in m[3] else ""
                stack.append(Element(tag, stack[-1], names))
                elements.append(stack[-1])
                open_tags[tag] += 1
    text(at, len(page))
    flush()
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
    return elements, out


def markup_evidence(elements: list[Element]) -> dict[int, float]:
    """The log-odds that markup gives to the text of each element, by the element's id()."""
    total = elements[0].chars
    beside = {id(elements[0]): False}  # is it in strong boilerplate?
    for e in elements[1:]:
        beside[id(e)] = beside[id(e.parent)] or (e.bad <= STRONG and 2 * e.chars <= total)
    mains = [e for e in elements if e.main and e.chars and e.bad > STRONG and not beside[id(e)]]
    whole = [e for e in mains if e.tag == "main"] or mains
    anchor = max(whole, key=lambda e: e.chars, default=None)
    if anchor is not None and anchor.tag == "main":  # the article in it, if that is most of it
        anchor = max((e for e in mains if e.tag != "main" and 2 * e.chars > anchor.chars), key=lambda e: e.depth, default=anchor)
    above = set()
    e = anchor
    while e is not None:
        above.add(id(e))
        e = e.parent
    out: dict[int, float] = {}
    for e in elements:
        p = e.parent
        e.inside = e is anchor or (p is not None and p.inside)
        if e is anchor:
            out[id(e)] = INSIDE
        elif p is None or id(e) in above:
            out[id(e)] = OUTSIDE if anchor is not None else 0.0
        else:
            bad = e.bad
            if e.tag == "header" and e.inside and bad == WEAK and name_is_plain(e):
                bad = 0.0  # an article's own heading
            elif e.chars * (2.0 if bad > STRONG else 1.2) > (anchor.chars if e.inside else total) and not (e.inside and bad <= STRONG):
                bad = 0.0  # what holds most of the text is no part beside it
            was = out[id(p)]
            out[id(e)] = max(was + bad, 3 * STRONG) if bad else was + (e.good if was > WEAK and not e.inside and not p.good else 0.0)
    return out


def name_is_plain(e: Element) -> bool:
    return e.good >= 0.0 and e.bad == _BAD_TAGS.get(e.tag, 0.0)


# --- the text's evidence ---------------------------------------------------------------------------------------

#: constant, length, links, ends like a sentence, heading, paragraph, list or table part, at most three words
PRIOR = np.array([-0.9, 0.7, -2.5, 0.6, 0.4, 0.8, -0.3, -0.6])
PRIOR_ROWS = 50.0  # labelled blocks that weigh as much as the prior
SMOOTHING = 1.0
_SCALES = (0.25, 0.5, 1.0, 2.0)


def text_features(b: Block) -> list[float]:
    tag = b.element.tag
    return [
        1.0, min(3.0, math.log1p(len(b.text) / 40)), b.linked, float(b.text[-1] in ".!?…:;\"”»。)"), float(tag in _HEADINGS), float(tag in ("p", "blockquote", "pre", "figcaption")),
        float(tag in ("li", "td", "th", "dt", "dd")), float(b.text.count(" ") < 3),
    ]


class Costs(NamedTuple):
    """What the cut is made with: the weights of text_features and the strength of edges."""

    weights: tuple[float, ...] = tuple(PRIOR)
    smoothing: float = SMOOTHING


def text_evidence(found: list[Block], weights: tuple[float, ...]) -> np.ndarray:
    return np.clip(np.array([text_features(b) for b in found]).reshape(-1, len(PRIOR)) @ np.array(weights), -TEXT_LIMIT, TEXT_LIMIT)


def fit(pages: list[str]) -> Costs:
    """Costs from pages: blocks inside a main element are content, those in strongly marked boilerplate are not."""
    parsed = [(found, np.array([markup[id(b.element)] for b in found])) for elements, found in map(parse, pages) if found for markup in [markup_evidence(elements)]]
    labelled = [(found, m, np.where(m >= INSIDE, 1, np.where(m <= OUTSIDE + STRONG / 2, 0, -1))) for found, m in parsed]
    labelled = [x for x in labelled if (x[2] == 1).any() and (x[2] == 0).any()]
    if not labelled:
        return Costs()
    x = np.array([text_features(b) for found, _, y in labelled for b, k in zip(found, y, strict=True) if k >= 0])
    y = np.concatenate([k[k >= 0] for _, _, k in labelled]).astype(float)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh alike
    share *= min(1.0, 4000 / len(y))
    w = PRIOR.copy()
    for _ in range(25):  # Newton steps of the posterior
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (share * (p - y)) + PRIOR_ROWS * (w - PRIOR)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    weights = tuple(np.round(w, 6).tolist())
    wrong = dict.fromkeys(_SCALES, 0)
    for found, _, k in labelled:
        odds = text_evidence(found, weights)
        for s in _SCALES:
            kept = np.array(min_cut(odds.tolist(), edges_of(found, s)))
            wrong[s] += int((kept[k >= 0] != (k[k >= 0] == 1)).sum())
    return Costs(weights, min(_SCALES, key=lambda s: (wrong[s], abs(s - SMOOTHING))))


# --- the cut ---------------------------------------------------------------------------------------------------


def _near(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent  # type: ignore[assignment]
        else:
            b = b.parent  # type: ignore[assignment]
        steps += 1
    return steps


def edges_of(found: list[Block], strength: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and one child of an element with the child before it."""
    edges: list[tuple[int, int, float]] = []
    last_child: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, strength * 2.0 / (1 + _near(found[i - 1].element, b.element))))
        twin = last_child.get(id(b.element.parent))
        if twin is not None:
            edges.append((twin, i, strength * 0.4))
        last_child[id(b.element.parent)] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the content terminal at the least cut.

    A node's two terminal edges cancel but for their difference, its excess or its lack. A node whose difference is no
    less than the sum of its edges is on that side in some least cut; it is taken out, and its edges become differences of
    its neighbours. Over what is left flow is sent by Dinic's algorithm: phases of shortest residual paths.
    """
    n, tiny = len(odds), 1e-9
    give = list(odds)  # log(1 + e**x), the cost of labelling it boilerplate, less log(1 + e**-x), that of content
    rest: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        rest[a][b] = rest[a].get(b, 0.0) + w
        rest[b][a] = rest[b].get(a, 0.0) + w
    kept: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        a = queue.popleft()
        if kept[a] is None and abs(give[a]) >= sum(rest[a].values()) - tiny:
            kept[a] = give[a] > 0
            for b, w in rest[a].items():
                del rest[b][a]
                give[b] += w if kept[a] else -w
                queue.append(b)
            rest[a].clear()
    live = [i for i in range(n) if kept[i] is None]
    while live:
        level = {i: 0 for i in live if give[i] > tiny}
        order = deque(level)
        reached = False
        while order:
            a = order.popleft()
            reached |= give[a] < -tiny
            for b, w in rest[a].items():
                if w > tiny and b not in level:
                    level[b] = level[a] + 1
                    order.append(b)
        if not reached:
            for i in live:
                kept[i] = i in level
            break
        arcs, used = {a: list(rest[a]) for a in level}, dict.fromkeys(level, 0)
        for start in [i for i in live if give[i] > tiny]:
            path = [start]
            while path and give[start] > tiny:
                a = path[-1]
                if give[a] < -tiny:
                    flow = min(give[start], -give[a], *(rest[u][v] for u, v in zip(path, path[1:], strict=False)))
                    give[start] -= flow
                    give[a] += flow
                    cut = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        u, v = path[k], path[k + 1]
                        rest[u][v] -= flow
                        rest[v][u] += flow
                        if rest[u][v] <= tiny:
                            cut = k + 1
                    del path[cut:]
                    continue
                ways = arcs[a]
                while used[a] < len(ways) and not (rest[a][ways[used[a]]] > tiny and level.get(ways[used[a]], -1) == level[a] + 1):
                    used[a] += 1
                if used[a] < len(ways):
                    path.append(ways[used[a]])
                else:  # nothing more goes through a
                    path.pop()
                    if path:
                        used[path[-1]] += 1
    return [bool(k) for k in kept]


def label(page: str, costs: Costs) -> tuple[list[Block], np.ndarray, list[bool]]:
    """The blocks of a page, their log-odds and the cut's labels."""
    elements, found = parse(page)
    markup = markup_evidence(elements)
    odds = np.array([markup[id(b.element)] for b in found]) + text_evidence(found, costs.weights)
    odds = np.round(odds * 64) / 64
    return found, odds, min_cut(odds.tolist(), edges_of(found, costs.smoothing))


def extract(page: str | None, costs: Costs | None = None) -> str:
    """The main text of a page, a line a block."""
    if not page:
        return ""
    found, _, keep = label(page, costs or Costs())
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def fit_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Costs:
    """Costs fitted on the pages of least hash; at most `sample` pages come to the driver. Ids are chosen before any html is read."""
    ids = [r[0] for r in pages.filter("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    rows = pages.filter(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id", "html"]).orderBy(F.xxhash64("page_id"), "html").limit(sample).collect() if ids else []
    return fit([r.html for r in rows if r.html])


def extract_pages(pages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; costs are fitted on a sample of the pages if none are given."""
    costs = costs or fit_pages(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a bounded number of pages at a time
                part = b.slice(at, 256)
                texts = [extract(x.as_py(), costs) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
