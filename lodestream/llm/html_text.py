"""Main text of web pages by a minimum cut between content and boilerplate."""

import functools
import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import arrow, table

#: Bounds of the training sample: pages, and characters of one of them.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 200_000
#: Most that one block's evidence can weigh, and the smoothness of neighbours and of close places in the tree.
LIMIT, NEXT, NEAR = 8.0, 0.4, 0.6

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button".split())
#: Of these, what goes to the page's end without an end tag, and what may hold itself. Any other but a title that is
#: opened again before its end tag was not closed.
TO_END, NESTS = frozenset("script style textarea".split()), frozenset("svg math template".split())
#: An open element of the first kind ends where one of the second starts, but for these bounds between them.
CLOSES = {
    "p": (BLOCK, frozenset("td th li dd dt div article section aside".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr".split()), frozenset(["table"])),
    "th": (frozenset("td th tr".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
}
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav aside footer header form menu dialog".split())
MAIN_ROLES = frozenset("main article".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright discussion disqus footer footnav form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification pager pagination popup promo promotion recommended related replies "
    "reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar "
    "widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A whole attribute, its name and its value with the quote signs.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)?+)?+""")
#: Attributes up to a tag's end, in order: a quote sign matters only where a value starts, one never closed is a letter.
_INSIDE = re.compile(r"""(?:\s++|(/)(?=>)|/|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)?+)*+""")
_WORD = re.compile(r"[a-z]+")
_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in TO_END}
_EITHER = {tag: re.compile(f"<!--|<(/?){tag}(?=[\\s/>])", re.I) for tag in RAW - TO_END}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

MAIN, SIDE, SOFT = 1, 2, 4


def _closed(page: str, tag: str, at: int) -> dict[int, int]:
    """Places from at on where an element of RAW starts that is closed, and where its end tag starts."""
    found, opened, comments = {}, [], tag not in ("title", "iframe")
    while m := _EITHER[tag].search(page, at):
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at) if comments else -1
            comments = stop >= 0
            at = max(at, stop)
        elif not m[1]:
            inside = _INSIDE.match(page, at)
            at = inside.end()
            if (tag in NESTS and inside[1]) or (tag == "title" and opened):
                continue
            if tag not in NESTS:
                opened.clear()
            opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.start()
    return found


def _tags(page: str):
    """(text before, tag, whether it ends, attributes) from start to end; the last has no tag.

    What stands in a closed element of RAW is left out. Of one without an end
    tag only its start tag is, but script, style and textarea go to the end.
    """
    at, size, held, closed = 0, len(page), 0, {}
    while True:
        start = page.find("<", at)
        if start < 0:
            yield page[held:], None, False, ""
            return
        head = page[start + 1 : start + 2]
        ends = head == "/"
        if head.isascii() and (head.isalpha() or ends):
            name = _NAME.match(page, start + 1 + ends)
            # an end tag without a name is a comment
            inside = _INSIDE.match(page, name.end()) if name else None
            stop = inside.end() if name else page.find(">", start)
            if stop < 0 or stop == size:  # the page breaks off in a tag
                yield page[held:start], None, False, ""
                return
            if name is None:
                yield page[held:start], "!", False, ""
                at = held = stop + 1
                continue
            tag = name.group().lower()
            yield page[held:start], tag, ends, page[name.end() : stop]
            at = held = stop + 1
            if ends or tag not in RAW:
                continue
            if tag in TO_END:
                found = _END[tag].search(page, at)
                at = held = found.start() if found else size
            elif not (tag in NESTS and inside[1]):
                if tag not in closed:
                    closed[tag] = _closed(page, tag, start)
                at = held = closed[tag].get(start, at)
        elif head in ("!", "?"):
            comment = page.startswith("<!--", start)
            stop = page.find("-->" if comment else ">", start)
            yield page[held:start], "!", False, ""
            if stop < 0:
                return
            at = held = stop + (3 if comment else 1)
        else:  # a bare bracket is text
            at = start + 1


@functools.lru_cache(maxsize=65536)
def _marks(tag: str, attributes: str) -> tuple[int, bool]:
    """(MAIN, SIDE or SOFT if the element says so, whether it is hidden)."""
    words, role, hidden = set(), "", False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "itemprop"):
            words |= set(_WORD.findall(value))
        elif key == "role":
            role = value
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "style" and _HIDDEN_STYLE.search(value):
            hidden = True
    if tag in MAIN_TAGS or role in MAIN_ROLES or "articlebody" in words:
        return MAIN, hidden
    if tag in SIDE_TAGS or role in SIDE_ROLES:
        return SIDE, hidden
    if tag in ("html", "body"):
        return 0, False
    if words & SIDE_WORDS:
        return SIDE, hidden
    return (SOFT if words & MAIN_WORDS else 0), hidden


class Block:
    """Text between two block boundaries, and where it stands."""

    __slots__ = ("text", "linked", "path", "mark", "tag")

    def __init__(self, text, linked, path, mark, tag):
        self.text, self.linked, self.path, self.mark, self.tag = text, linked, path, mark, tag


def blocks(page: str) -> list[Block]:
    """The visible blocks of a page in order, white space within each turned into one space."""
    out, parts, linked = [], [], 0
    # open elements: tag, number, mark, hidden, in a link, innermost block's tag
    stack, number = [("", 0, 0, False, False, "")], 0
    where = None

    def flush():
        nonlocal parts, linked, where
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(1.0, linked / len(text)), *where))
            parts, linked, where = [], 0, None

    for text, tag, ends, attributes in _tags(page):
        top = stack[-1]
        if text and not top[3]:
            chunk = html.unescape(text) if "&" in text else text
            if where is None and not chunk.isspace():
                where = tuple(e[1] for e in stack), top[2], top[5]
                parts.append(chunk)
            elif where is not None:
                parts.append(chunk)
            if top[4]:
                linked += len(chunk)
        if tag is None:
            break
        if tag in BLOCK:
            flush()
        elif tag == "br" and where is not None:
            parts.append(" ")
        if tag == "!" or tag in VOID:
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            continue
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k][0]
            if open_tag in CLOSES and tag in CLOSES[open_tag][0]:
                del stack[k:]
            elif open_tag in BLOCK:
                break
        top = stack[-1]
        mark, hidden = _marks(tag, attributes)
        if tag == "header" and top[2] == MAIN:
            mark = 0  # the heading of an article, not of the page
        number += 1
        stack.append((
            tag, number, mark if mark in (MAIN, SIDE) or not top[2] else top[2], top[3] or hidden, top[4] or tag == "a",
            tag if tag in BLOCK else top[5],
        ))
    flush()
    return out


FEATURES = (
    "constant", "main", "side", "soft main", "log words", "links", "stops", "heading", "paragraph", "item", "first", "last"
)
#: Weights before training, to which training returns where the sample says nothing.
PRIOR = np.array([-1.0, 4.0, -6.0, 1.5, 0.5, -3.0, 0.8, 0.2, 0.6, -0.6, -0.3, -0.5])
_STOPS = re.compile(r"[.,;:!?](?:\s|$)")


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    last = max(1, len(found) - 1)
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag != "hr"
        out[k] = (
            1.0, b.mark == MAIN, b.mark == SIDE, b.mark == SOFT, math.log(words), b.linked,
            min(1.0, len(_STOPS.findall(b.text)) / words * 4), heading, b.tag in ("p", "pre", "blockquote"),
            b.tag in ("li", "td", "th", "dd", "dt", "option"), k < 0.1 * last, k > 0.9 * last,
        )
    return out


def train(pages: list[str], rounds: int = 200, pull: float = 0.05) -> tuple[float, ...]:
    """Weights of a logistic classifier.

    Blocks inside elements that name their role (article, nav, a sidebar class)
    are the examples; the regression starts at, and is held to, the prior.
    """
    parts = [(features(found), np.array([b.mark for b in found])) for found in map(blocks, pages) if found]
    weights = PRIOR.copy()
    if parts:
        x = np.concatenate([f for f, _ in parts])
        mark = np.concatenate([m for _, m in parts])
        told = (mark == MAIN) | (mark == SIDE)
        x, y = x[told], (mark[told] == MAIN).astype(float)
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            weights -= 0.5 * (x.T @ (p - y) / len(y) + pull * (weights - PRIOR))
    return tuple(weights)


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Side of each node in a minimum cut: true on the source's.

    terminal is the capacity from the source (positive) or to the sink
    (negative); an edge has its capacity both ways. Flow runs along shortest
    paths, found level by level, until none is left; the source's side is what
    it still reaches, so ties fall to the sink.
    """
    n = len(terminal)
    links = [[] for _ in range(n)]
    for a, b, c in edges:
        links[a].append([b, c, len(links[b])])
        links[b].append([a, c, len(links[a]) - 1])
    left = list(terminal)
    tiny = 1e-9
    while True:
        level = [0 if t > tiny else -1 for t in left]
        queue, reached = deque(k for k in range(n) if level[k] == 0), False
        while queue:
            a = queue.popleft()
            reached = reached or left[a] < -tiny
            for b, c, _ in links[a]:
                if c > tiny and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if not reached:
            return [k >= 0 for k in level]
        turn = [0] * n
        for start in range(n):
            while level[start] == 0 and left[start] > tiny:
                path, a = [], start
                while left[a] >= -tiny:
                    while turn[a] < len(links[a]):
                        edge = links[a][turn[a]]
                        if edge[1] > tiny and level[edge[0]] == level[a] + 1:
                            break
                        turn[a] += 1
                    else:
                        if not path:
                            break
                        a, edge = path.pop()
                        turn[a] += 1
                        continue
                    path.append((a, edge))
                    a = edge[0]
                if left[a] >= -tiny:
                    break
                flow = min(left[start], -left[a], *(e[1] for _, e in path))
                left[start] -= flow
                left[a] += flow
                for _, e in path:
                    e[1] -= flow
                for p, e in path:
                    links[e[0]][e[2]][1] += flow


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, stronger the more of the tree they share, and between children of one parent."""
    edges, child = [], {}
    for k, b in enumerate(found):
        parent = b.path[:-1]
        if k:
            other = found[k - 1].path
            deep = max(len(other), len(b.path))
            shared = 0
            for p, q in zip(other, b.path):
                if p != q:
                    break
                shared += 1
            edges.append((k - 1, k, NEXT + NEAR * shared / deep))
        before = child.get(parent)
        if before is not None and before != k - 1:
            edges.append((before, k, NEAR))
        child[parent] = k
    return edges


def main_text(page: str | None, weights) -> str:
    """The blocks on the content side of the cut, one to a line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    odds = np.clip(features(found) @ np.array(weights), -LIMIT, LIMIT)
    keep = min_cut(odds.tolist(), smoothness(found)) if (odds > 0).any() else [False] * len(found)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, weights, page: str = "html", text_out: str = "text") -> DataFrame:
    """pages with the text of each, its html left out; null and empty pages have an empty text.

    A column named like the new one is replaced. Text that a page breaks off in
    counts; a tag that it breaks off in does not.
    """
    kept = [f for f in pages.schema.fields if f.name not in (page, text_out)]
    schema = type(pages.schema)([*kept]).add(text_out, "string")

    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column("__page").to_pylist()]
            yield {**{f.name: batch.column(f.name) for f in kept}, text_out: pa.array(texts, pa.string())}

    return arrow(pages.select(*[f.name for f in kept], F.col(page).alias("__page")), run, schema)


def sample(pages: DataFrame, page: str = "html", most: int = SAMPLE_PAGES) -> list[str]:
    """A bounded sample of pages for training, drawn by a hash of their text."""
    rate = min(1 << 30, (most << 30) // max(1, pages.count()) + 1)
    short = pages.filter(F.length(page) <= SAMPLE_CHARS).select(F.col(page).alias("p"), F.xxhash64(page).alias("h"))
    drawn = short.filter(F.pmod("h", F.lit(1 << 30)) < rate).groupBy("h").agg(F.min("p").alias("p"))
    return [r.p for r in drawn.orderBy("h").limit(2 * most).collect()]


def op5_html_text(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    out = extract(pages.select("page_id", "url", "html"), train(sample(pages)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
