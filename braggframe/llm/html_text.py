"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text of their own blocks; a container inside an article stands for the whole of
it; every container with a score gives its generalised tag-class path votes in proportion. Spark sums the votes of a host and
path (a partial aggregate) and keeps the host's winner. Then every page is read again: the elements at its host's winning path
are the main text; a page that has none takes its own best container.

Pages are read in one scan, in time in proportion to their length however they are nested or broken off. A path is a chained
hash of its steps, so that a node of any depth holds one number.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column, small, stored

_TOKEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: The end of a tag, or a quoted value.
_STOP = re.compile(r""">|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Element names of the HTML standard, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Lists and tables are parts of an article, not its container.
INNER = set("ul ol li dl dt dd table thead tbody tfoot tr td th".split())
PARAGRAPH_ENDS = BLOCK - {"html", "body"}
OUTSIDE = set("head nav header footer aside form script style noscript template textarea title button select option input label iframe object embed svg canvas audio video menu dialog noembed noframes xmp datalist".split())
#: Words in a class or id, or a role, that mark what is not the article.
NOT_MAIN = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side rail aside widget "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login share sharing social related recommended recommendations pagination pager tags toolbar search".split()
)
#: Of these, what stands beside a word for the article may be part of it.
WEAK = set("bottom side widget search rail tags toolbar alert reply replies respond".split())
MAIN = set("article main content post entry story".split())
#: A class that says that a page has or lacks something is no sign of it.
ABOUT = {"has", "with", "no", "without", "is", "not"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}


def path_of(steps: list[str]) -> int:
    """The hash of a path, chained from its root."""
    path = 0
    for step in ["", *steps]:
        path = _step(path, step)
    return path


def _step(path: int, step: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}/{step}".encode(), digest_size=8).digest(), "big", signed=True)


class _Node:
    """An element. own: link text of the blocks that it contains itself; linked: link text right in it; box: its nearest block;
    outer: its nearest element that is no part of a list or table."""

    __slots__ = ("tag", "path", "parent", "out", "own", "linked", "inside", "depth", "box", "outer", "order")

    def __init__(self, tag: str, step: str, parent: _Node | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.path = _step(parent.path if parent else 0, step)
        self.own = self.linked = self.order = 0
        self.inside = parent.inside if parent else False
        self.depth = parent.depth + 1 if parent else 0
        self.box = self if tag in BLOCK or parent is None else parent.box
        self.outer = parent.outer if parent and tag in INNER else self


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _made(tag: str, attributes: str, parent: _Node | None) -> _Node:
    names, marks, out, hidden = [], [], tag in OUTSIDE, False
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key in ("class", "id"):
                for token in value.split():
                    words = _words(token)
                    marks += words if words and words[0] not in ABOUT else []
                if key == "class":
                    names += value.lower().split()
            elif key == "role":
                hidden |= value.lower() in ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    if tag not in ("html", "body", "main", "article"):
        signs = NOT_MAIN.intersection(marks)
        out = out or hidden or bool(signs - WEAK) or bool(signs and MAIN.isdisjoint(marks))
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
    return _Node(tag, step, parent, out or (parent.out if parent else False))


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place after the ">" that ends a tag; one in a quoted value does not, unless the quote is never closed. -1: none."""
    begin = at
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.end()
        if m.end() > last[m[1]]:
            return page.find(">", begin) + 1 or -1
        at = page.index(m[1], m.end()) + 1
    return page.find(">", begin) + 1 or -1


class _Page:
    """The elements of a page, parents first, and its blocks of text in page order, each with its container; what stands in an
    outside element is left out."""

    def __init__(self, page: str):
        self.root = self.top = _Node("#", "", None, False)
        self.nodes = [self.root]
        self.blocks: list[tuple[_Node, str]] = []
        self.held: list[str] = []
        self.open: dict[str, list[_Node]] = {}
        last = {q: page.rfind(q) for q in "\"'"}
        at, n = 0, len(page)
        while m := _TOKEN.search(page, at):
            self.add(page[at : m.start()])
            at = m.end()
            if m[2]:
                end = _tag_end(page, at, last)
                if end < 0:
                    at = m.start()
                    break
                at = self.tag(page, bool(m[1]), m[2].lower(), page[at : end - 1], end)
            elif m[0] == "<!--":
                end = page.find("-->", at)
                at = end + 3 if end >= 0 else n
            elif m[0] == "<![CDATA[":
                end = page.find("]]>", at)
                self.add(html.escape(page[at : end if end >= 0 else n]))
                at = end + 3 if end >= 0 else n
            else:
                at = page.find(">", at) + 1 or n
        self.add(page[at:])
        self.flush()

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.held)).split())
        self.held.clear()
        if text:
            self.blocks.append((self.top.box, text))

    def add(self, raw: str) -> None:
        if raw and not self.top.out:
            self.held.append(raw)
            if self.top.inside and raw.strip():
                self.top.linked += len(raw)
                self.top.box.own += len(raw)

    def close(self, tag: str, upto: set[str]) -> None:
        """Closes the nearest open element of that name, unless one of upto stands before it."""
        found = self.open.get(tag)
        if not found or any((o := self.open.get(u)) and o[-1].depth > found[-1].depth for u in upto if u != tag):
            return
        if tag in BLOCK:
            self.flush()
        self.leave(found[-1].parent)

    def leave(self, to: _Node) -> None:
        while self.top is not to:
            self.open[self.top.tag].pop()
            self.top = self.top.parent

    def tag(self, page: str, slash: bool, tag: str, attributes: str, at: int) -> int:
        if slash:
            if tag == "br":
                self.add(" ")
            self.close(tag, {"table"} if tag not in ("table", "html", "body") else set())
            return at
        if tag in ("br", "hr", "wbr", "img"):
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.add(" ")
            return at
        if tag in VOID:
            return at
        if tag in PARAGRAPH_ENDS:
            self.close("p", {"table", "button"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for same in {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,)):
                self.close(same, {"ul", "ol", "dl", "table", "select"} | ({"tr"} if tag in ("td", "th") else set()))
        if tag in BLOCK:
            self.flush()
        if tag == "body":
            roots = self.open.get("html")
            self.leave(roots[-1] if roots else self.root)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            return end.end() if end else len(page)
        if not attributes.endswith("/") or tag in BLOCK:
            node = _made(tag, attributes, self.top)
            node.inside = node.inside or tag == "a"
            node.order = len(self.nodes)
            self.nodes.append(node)
            self.open.setdefault(tag, []).append(node)
            self.top = node
        return at

    def scores(self) -> dict[int, float]:
        """Scores of the containers, by node: a paragraph's text counts for its parent, half for the one above; link text counts against."""
        scores: dict[int, float] = {}
        for box, text in self.blocks:
            if box.out:
                continue
            weight = (len(text) - 2 * min(len(text), box.linked)) * (1.0 if box.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "td", "dd") else 0.8)
            x = box.parent if box.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li") and box.parent else box
            x = x.outer
            for share in (1.0, 0.5, 0.25):
                if x is None or x.tag in ("#", "html"):
                    break
                scores[x.order] = scores.get(x.order, 0.0) + share * weight * {"article": 1.5, "main": 1.3, "body": 0.7}.get(x.tag, 1.0)
                x = x.parent
        return scores

    def wholes(self) -> list[int]:
        """For each node the container of the whole article that it would be the densest part of.

        That is the article or main around it, or a main around that; without one, the ancestors below the body. Of these,
        one is taken as long as what it adds is text, and not mostly links. Parents come first, so each node has the answer
        from the next container above it.
        """
        text, links = [0] * len(self.nodes), [0] * len(self.nodes)
        for box, t in self.blocks:
            if not box.out:
                text[box.order] += len(t)
        for x in reversed(self.nodes):
            if text[x.order]:
                links[x.order] += min(text[x.order], x.own)
            if x.parent:
                text[x.parent.order] += text[x.order]
                links[x.parent.order] += links[x.order]
        # The nearest node from here up that may stand for more: any, or an article or main.
        above: dict[bool, list[int]] = {True: [-1] * len(self.nodes), False: [-1] * len(self.nodes)}
        climbed: dict[bool, list[int]] = {True: [0] * len(self.nodes), False: [0] * len(self.nodes)}
        for x in self.nodes:
            i, up = x.order, x.parent.order if x.parent else -1
            end = x.tag in ("#", "html", "body")
            for marked in (True, False):
                fits = not end and (x.tag in ("article", "main") if marked else x.tag not in INNER)
                above[marked][i] = i if fits else -1 if end or up < 0 else above[marked][up]
                y = -1 if end or up < 0 else above[marked][up]
                adds = y >= 0 and 2 * (links[y] - links[i]) <= text[y] - text[i]
                climbed[marked][i] = climbed[marked][y] if adds else i
        return [climbed[True][above[True][i]] if above[True][i] >= 0 else climbed[False][i] for i in range(len(self.nodes))]

    def below(self, picked: Callable[[_Node], bool]) -> list[str]:
        """Text of the blocks in picked elements."""
        inside = [False] * len(self.nodes)
        for x in self.nodes:
            inside[x.order] = picked(x) or (x.parent is not None and inside[x.parent.order])
        return [text for box, text in self.blocks if inside[box.order] and not box.out]


def blocks_of(page: str) -> list[tuple[_Node, str]]:
    return _Page(page).blocks


def best_paths(page: str) -> list[tuple[int, int]]:
    """The paths of a page's containers with votes: 1000 for the best, in proportion for the others, to those that stand for the whole."""
    p = _Page(page)
    by_path: dict[int, float] = {}
    first: dict[int, tuple[float, _Node]] = {}
    for i, score in p.scores().items():
        node = p.nodes[i]
        by_path[node.path] = by_path.get(node.path, 0.0) + score
        if node.path not in first or score > first[node.path][0]:
            first[node.path] = (score, node)
    top = sorted(((s, path) for path, s in by_path.items() if s > 0), key=lambda x: (-x[0], x[1]))
    wholes = p.wholes() if top else []
    votes: dict[int, int] = {}
    for s, path in top:
        votes.setdefault(p.nodes[wholes[first[path][1].order]].path, int(1000 * s / top[0][0]))
    return list(votes.items())


def main_text(page: str, path: int | None) -> str:
    """Blocks below the elements at path, joined by one space; of a page without such an element, below its best container."""
    p = _Page(page)
    found = p.below(lambda x: x.path == path) if path is not None else []
    if not found and (scores := p.scores()):
        best = p.wholes()[max(scores.items(), key=lambda s: (s[1], -p.nodes[s[0]].depth, -s[0]))[0]]
        found = p.below(lambda x: x.order == best)
    if not found:
        found = [text for box, text in p.blocks if not box.out]
    return " ".join(found)


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, p, v) for h, page in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist(), strict=True) for p, v in best_paths(page or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "path", "votes"])


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", path) for page, path in zip(column(batch, "html").to_pylist(), column(batch, "path").to_pylist(), strict=True)]
        keys = [c for c in batch.schema.names if c not in ("html", "path")]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keys), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path (a hash): the path with the most votes of the host's pages, the smallest among equals."""
    bounded_batches(pages.sparkSession)
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_voting, "host string, path long, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extracted_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns of pages, text (empty if none) and n_chars.

    A null or empty html has an empty text. A null url is a host of its own kind, the empty one. Rows that repeat stay, and vote
    each. A very long page is read in one task, in time and memory in proportion to its length. Other columns of pages are
    ignored, whatever their names. An empty table gives an empty one.
    """
    winners = stored(host_paths(pages), "host-paths")
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    both = rows.join(small(winners, 128), "host", "left").drop("host")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in ("html", "path"))
    out = both.mapInArrow(_extracting, f"{schema}, text string, n_chars long")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "text", "n_chars")
