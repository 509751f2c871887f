"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block two costs, of calling it boilerplate
and of calling it content; they are the capacities from the source and to the sink. Neighbouring blocks,
and successive blocks of the same container, are tied by smoothness edges. The minimum cut, found by
maximum flow, splits the blocks; those on the source's side are the main text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<name>[a-zA-Z][^\s>/]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>?|<[!?][^>]*+>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT_NAMES = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?,;:…。]")

#: Elements by what they do to blocks.
DROPPED = frozenset("script style noscript template textarea title select svg math iframe object canvas audio video head button".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot blockquote figure fieldset details dialog menu center".split())
BREAKS = frozenset("p li h1 h2 h3 h4 h5 h6 tr td th dt dd pre hr caption figcaption address summary legend option".split())
INLINE = frozenset("span b i em strong small u s a mark font abbr cite q label ins del sub sup code".split())
#: Elements, roles and name parts that speak for boilerplate or for content.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies related recommended widget pagination pager toolbar masthead login signup copyright disclaimer topbar sitemap".split()
)
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article articlebody post entry story content main maintext".split())

#: Capacities of smoothness edges: between neighbours, and between successive blocks of one container.
ADJACENT, PROXIMATE = 3, 4
_CLEAR = 400


@dataclass
class Block:
    text: str
    linked: int
    container: int
    boilerplate: bool
    content: bool
    heading: bool


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}


def blocks(page: str) -> list[Block]:
    """The text blocks in page order, with what their ancestors say of them."""
    out: list[Block] = []
    # (element, number, inside boilerplate, inside content); the first stands for the page.
    stack = [("", 0, False, False)]
    parts: list[str] = []
    linked = link = containers = 0
    heading = leaf = False

    def close() -> None:
        nonlocal linked, heading, leaf
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, number, bad, good = stack[-1]
                out.append(Block(text, min(linked, len(text)), number, bad or leaf, good, heading))
            parts.clear()
        linked, heading, leaf = 0, False, False

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            parts.append(page[at:stop])
            if link:
                linked += stop - at
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and not m["end"] and m["rest"] and _unseen(m["rest"]):
            at = _end_of(page, name, at)
        elif name in DROPPED:
            if not m["end"] and not m["rest"].endswith("/"):
                ends = re.compile(f"</{re.escape(name)}(?=[\\s>/]|$)[^>]*>?", re.I)
                if name == "head":  # it may be left open: the body ends it
                    ends = re.compile(r"</head[^>]*>|(?=<body)", re.I)
                found = ends.search(page, at)
                if found:
                    at = found.end()
                elif name != "head":
                    at = len(page)
            parts.append(" ")
        elif name == "a":
            link = 0 if m["end"] else 1
        elif name == "br" or name in ("img", "wbr"):
            parts.append("" if name == "wbr" else " ")
        elif name in BREAKS:
            close()
            heading = name[0] == "h" and name != "hr" and not m["end"]
            leaf = not m["end"] and bool(m["rest"]) and _judged(name, m["rest"], False, True)[0]
        elif name in CONTAINERS:
            close()
            if m["end"]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        link = 0
                        break
            elif not m["rest"].endswith("/"):
                containers += 1
                stack.append((name, containers, *_judged(name, m["rest"], stack[-1][2], stack[-1][3])))
    close()
    return out


def _names(a: dict[str, str]) -> set[str]:
    return set(_SPLIT_NAMES.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}").lower())) if a else set()


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _unseen(rest: str) -> bool:
    """Whether what an inline element holds is no text of its block: it is hidden or an advert."""
    a = _attributes(rest)
    return _hidden(a) or bool(_names(a) & ADVERT_NAMES)


def _end_of(page: str, name: str, at: int) -> int:
    """Where the inline element that was opened just before ``at`` ends: behind its end tag, or where a block tag stands if it has none before that."""
    depth = 1
    for m in _TOKEN.finditer(page, at):
        tag = (m["name"] or "").lower()
        if tag == name:
            depth += -1 if m["end"] else 1
            if not depth:
                return m.end()
        elif tag in CONTAINERS or tag in BREAKS:
            return m.start()
    return len(page)


def _judged(name: str, rest: str, bad: bool, good: bool) -> tuple[bool, bool]:
    """Whether a container is inside boilerplate and inside content, given its parent."""
    a = _attributes(rest) if rest else {}
    names = _names(a)
    role = a.get("role", "").lower()
    hidden = _hidden(a)
    whole = name in ("html", "body")
    says_content = name in CONTENT_TAGS or role in ("main", "article") or bool(names & CONTENT_NAMES) and not names & BOILERPLATE_NAMES and not whole
    says_boilerplate = name in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or hidden or bool(names & BOILERPLATE_NAMES) and not whole
    # The header of an article holds its title; any other is the site's.
    says_boilerplate |= (name == "header" or "header" in names) and not good and not says_content
    if name in CONTENT_TAGS and not hidden and not names & {"comment", "comments"}:
        says_boilerplate = False
    return bad or says_boilerplate, good or says_content


def costs(block: Block, marked: bool) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content); ``marked``: the page says where its content is."""
    words = len(block.text.split())
    share = block.linked / len(block.text)
    keep = 3 * min(words, 40) + 4 * min(len(_STOP.findall(block.text)), 5)
    drop = 8 + int(100 * share)
    if block.heading:
        keep += 10
    if block.content:
        keep += 80
    elif marked:
        drop += 150
    if block.boilerplate:
        drop += _CLEAR
    return keep, drop


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut with the fewest nodes there.

    ``edges`` are (node, node, capacity both ways). What source and sink can send straight through a node
    goes first. Then come phases: one search from all nodes with supply gives each its distance, and all paths
    of the least length to nodes with demand are filled. Supply seldom goes further than a few blocks, so the
    phases are few and a page costs little more than its length.
    """
    n = len(source)
    spare = [a - b for a, b in zip(source, sink, strict=True)]
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, capacity in edges:
        for x, y in ((a, b), (b, a)):
            out[x].append(len(to))
            to.append(y)
            room.append(capacity)
    while True:
        supply = [i for i, s in enumerate(spare) if s > 0]
        far, queue, met = [-1] * n, deque(supply), False
        for i in supply:
            far[i] = 0
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[a] + 1
                    met |= spare[to[e]] < 0
                    queue.append(to[e])
        if not met:
            return [d >= 0 for d in far]
        tried = [0] * n
        for i in supply:
            path: list[int] = []
            while spare[i] > 0:
                a = to[path[-1]] if path else i
                if spare[a] < 0:
                    flow = min(spare[i], -spare[a], *(room[e] for e in path))
                    spare[i] -= flow
                    spare[a] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path = []
                    continue
                while tried[a] < len(out[a]) and not (room[e := out[a][tried[a]]] and far[to[e]] == far[a] + 1):
                    tried[a] += 1
                if tried[a] < len(out[a]):
                    path.append(out[a][tried[a]])
                elif path:
                    path.pop()
                    tried[to[path[-1]] if path else i] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks in order, one to a line."""
    found = blocks(page or "")
    marked = any(b.content and not b.boilerplate for b in found)
    caps = [costs(b, marked) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.container in last:
            edges.append((last[b.container], i, PROXIMATE))
        last[b.container] = i
    kept = minimum_cut([c[0] for c in caps], [c[1] for c in caps], edges)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, in no order.

    Null and empty pages have an empty text; so have pages that are all boilerplate. A page without
    markup is one block. Ids and urls may be null; repeated rows each come back; an empty table gives an
    empty result.
    """
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return x.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
