"""HTML extraction: consensus host paths.

1. Each container path of a page is worth all text below it, link text counted against. From the outside in, a page follows a
   path that keeps nearly all of the worth and the main headings, or the only ``article`` or ``main`` if it keeps most and no container
   beside it has a like amount; it votes for the path where it ends. An article is not entered further, so sections and tables of any
   class stay together.
2. Spark adds up the votes by host and path. A path is the chain of container tags with their classes, digits
   generalised, so that ``post-17`` and ``post-18`` are one path. Votes are summed within tasks first: a host with a
   third of all pages is a few rows of the shuffle. The path with most votes wins its host, then the higher score, then the shorter one.
3. Pages are extracted again: the blocks in the containers of the winning path, without menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles and comments. A page that has no container of that path, or has less than half of its text there,
   uses its own best.

What is left out is told by tag, or by a word of a class, id or role. An element that holds most of the page's text is not left out
for its name or for being a form if the main heading is in it, or if next to nothing would be left.

Cases: null or empty pages have an empty text; a null url is the host ''. Pages without any container are read as a whole. Tags that
are never closed end where their container does; a script or comment that is never closed takes the rest of the page.
Repeated rows are pages of their own; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, freeing, small_side, stored

_OPENS = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACES = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_ARTICLE = re.compile(r">(?:article|main)(?:\.|$)")

CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no text; the parser skips to the end tag.
RAW = frozenset("script style noscript template textarea svg iframe title select annotation annotation-xml".split())
DROPPED = frozenset("nav aside footer button dialog menu head".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply search share sharing shares sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget complementary contentinfo alert discussion respond".split()
)
#: Marks of what readers wrote: never the article, however long.
READERS = frozenset("comment comments disqus discussion replies reply respond".split())
#: Words before a mark that make another thing of it: a layout, a topic, a state.
NOT_MARKED = frozenset("author category format has hentry is no not status tag tags topic type with without".split())
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Share of a container's worth that a path inside must keep to be followed; the only article or main needs ``MOST``.
NEARLY_ALL, MOST = 0.95, 0.5
#: Share of an article's worth from which a container beside it is a part of the text.
ALIKE = 0.5
#: Share of a page's worth that must be left without an element that is told by its name.
LEFT = 0.25
#: Elements within elements; what opens beyond counts as text of the deepest one, as in browsers.
DEPTH = 512
#: Opening one of these ends an open one of the same family.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
}


@dataclass(slots=True)
class Out:
    """An element that may be left out."""

    sure: bool  # by its tag, or hidden
    readers: bool = False
    heading: bool = False
    worth: float = 0.0


@dataclass(slots=True)
class Element:
    tag: str
    path: str | None  # of a container
    outs: tuple[int, ...]  # what around it may be left out
    up: list[int]  # containers around, from the outside in
    linked: bool = False


@dataclass(slots=True)
class Block:
    up: list[int]
    outs: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False

    def text(self) -> str:
        return _SPACES.sub(" ", entities.unescape("".join(self.parts))).strip()

    def worth(self) -> float:
        """Its length; link text counts against it."""
        return max(0.0, sum(map(len, self.parts)) - 2.0 * self.linked)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _marks(own: dict[str, str]) -> set[str]:
    """The marks among the names of an element: a name is one if it is a mark, or two words one of which is, or ends with one."""
    found: set[str] = set()
    for name in " ".join(own.get(k, "") for k in ("class", "id", "role")).split():
        parts = _PART.findall(_CAMEL.sub(r"\1 \2", name).lower())
        if parts and parts[0] not in NOT_MARKED and len(parts) <= 4:
            found |= MARKS.intersection(parts if len(parts) <= 2 else parts[-1:])
    return found


def _out(tag: str, own: dict[str, str], inside_article: bool) -> Out | None:
    if tag in DROPPED or tag == "header" and not inside_article or "hidden" in own or "display:none" in own.get("style", "").replace(" ", "").lower():
        return Out(tag not in ("header", "body", "html"))
    if tag in ("html", "body"):
        return None
    marks = _marks(own) if own else set()
    return Out(False, not marks.isdisjoint(READERS)) if marks or tag == "form" else None


class _Tags:
    """Begin, end, slash, name and rest of the next tag from a place on; of comments and declarations the name is empty.

    A tag ends at the first > outside of quoted values. Once quotes have hidden all that come, the page's later tags end at any >, and where none comes
    there are no tags, so no part of a page is read more than a few times.
    """
    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        m = _OPENS.search(page, at)
        if m is None:
            return None
        if m[1]:
            end = page.find("-->", m.end())
            return m.start(), len(page) if end < 0 else end + 3, "", "", ""
        close = _REST.match(page, m.end()).end() if self.quotes and m[3] else len(page)
        if close == len(page):
            self.quotes = self.quotes and not m[3]
            close = page.find(">", m.end())
            if close < 0:
                return None
        return m.start(), close + 1, m[2] or "", m[3] or "", page[m.end():close] if m[3] else ""


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the content of a raw element ends, its end tag included."""
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    close = page.find(">", end.end()) if end else -1
    return len(page) if close < 0 else close + 1


def parse(page: str) -> tuple[list[str], list[Block]]:
    """Paths of the page's containers, and its blocks of kept text in order."""
    paths: list[str] = [""]
    stack = [Element("", "", (), [0])]
    blocks: list[Block] = []
    outs: list[Out] = []
    now: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal now
        top = stack[-1]
        if now is None and not text.isspace():
            blocks.append(now := Block(top.up, top.outs, heading=any(e.tag == "h1" for e in stack)))
        if now is not None:
            now.parts.append(text)
            now.linked += len(text) if top.linked else 0

    tags = _Tags(page)
    while found := tags.after(at):
        begin, end, slash, name, rest = found
        if begin > at:
            add(page[at:begin])
        at = end
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCKS:
            now = None
        if slash:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k].outs != stack[k - 1].outs:
                        now = None
                    del stack[max(1, k) :]
                    break
                if stack[k].path is not None and tag not in CONTAINERS and tag not in BLOCKS:
                    break  # a stray end tag of an inline element ends no container
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):  # all up to the end tag, whatever stands in it
                at = _raw_end(page, tag, at)
            continue
        if tag in BLOCKS:  # an open paragraph ends where a block begins, with what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].path is not None or stack[k].outs != stack[k - 1].outs:
                    break
                if stack[k].tag == "p":
                    del stack[k:]
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select") or stack[k].tag in ("div", "section", "article"):
                    break
        if len(stack) > DEPTH:
            continue
        top = stack[-1]
        own = _attributes(rest)
        around = top.outs
        if out := _out(tag, own, any(e.tag in ("article", "main") for e in stack)):
            around = (*around, len(outs))
            outs.append(out)
            now = None
        if tag in ("h1", "main"):
            for k in around:
                outs[k].heading = True
        path, up = None, top.up
        if tag in CONTAINERS:
            named = ".".join(sorted(_DIGITS.sub("N", own.get("class", "")).split()))
            path = f"{paths[top.up[-1]]}>{tag}" + (f".{named}" if named else "")
            paths.append(path)
            up = [*top.up, len(paths) - 1]
        stack.append(Element(tag, path, around, up, top.linked or tag == "a"))
    tail = page[at:]
    cut = tail.rfind("<")
    if cut >= 0 and re.match(r"</?[a-zA-Z!]", tail[cut:]):  # a tag that the end of the page cuts off
        tail = tail[:cut]
    if tail.strip():
        add(tail)
    return paths, _kept(blocks, outs)


def _kept(blocks: list[Block], outs: list[Out]) -> list[Block]:
    """The blocks that nothing around them leaves out."""
    if not outs:
        return blocks
    total = 0.0
    for b in blocks:
        if not any(outs[k].sure for k in b.outs):
            worth = b.worth()
            total += worth
            for k in b.outs:
                outs[k].worth += worth
    stays = [not o.sure and o.worth > MOST * total and (o.heading or not o.readers and total - o.worth < LEFT * total) for o in outs]
    return [b for b in blocks if all(stays[k] for k in b.outs)]


def _worths(paths: list[str], blocks: list[Block]) -> tuple[dict[str, float], Counter[str], dict[str, set[str]]]:
    """Of each path the worth of all text below it, its main headings, and the paths inside."""
    worth: dict[str, float] = defaultdict(float)
    headings: Counter[str] = Counter()
    inside: dict[str, set[str]] = defaultdict(set)
    for b in blocks:
        if own := b.worth():
            around = ""
            for k in b.up:
                path = paths[k]
                worth[path] += own
                headings[path] += b.heading
                if path != around:
                    inside[around].add(path)
                around = path
    return worth, headings, inside


def _best(worth: dict[str, float], headings: Counter[str], inside: dict[str, set[str]]) -> str:
    at, entered = "", False
    while inside[at] and not entered:
        articles = [p for p in inside[at] if _ARTICLE.match(p, len(at))]
        best = min(inside[at], key=lambda p: (-worth[p], len(p), p))
        beside = max((worth[p] for p in inside[at] if p not in articles), default=0.0)
        if len(articles) == 1 and worth[articles[0]] > MOST * worth[at] and beside < ALIKE * worth[articles[0]]:
            at, entered = articles[0], True
        elif worth[best] >= NEARLY_ALL * worth[at] and headings[best] == headings[at]:
            at, entered = best, best in articles
        else:
            break
    return at


def best_path(paths: list[str], blocks: list[Block]) -> tuple[str, float]:
    """The path that holds a page's text, and the worth of all text below it."""
    worth, headings, inside = _worths(paths, blocks)
    at = _best(worth, headings, inside)
    return at, worth[at]


def text_of(page: str, winner: str | None) -> str:
    paths, blocks = parse(page)
    if not blocks:
        return ""
    worth, headings, inside = _worths(paths, blocks)
    own = _best(worth, headings, inside)
    if winner != own and (winner not in worth or worth[winner] < MOST * worth[own]):
        winner = own
    chosen = {k for k, p in enumerate(paths) if p == winner}
    texts = (b.text() for b in blocks if not chosen.isdisjoint(b.up))
    return "\n\n".join(t for t in texts if t)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter[tuple[str, str]] = Counter()
        worth: dict[tuple[str, str], float] = defaultdict(float)
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            path, score = best_path(*parse(page or ""))
            if score > 0:
                votes[host, path] += 1
                worth[host, path] += score
        keys = list(votes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                pa.array([votes[k] for k in keys], pa.int64()), pa.array([worth[k] for k in keys], pa.float64())
            ],
            ["host", "path", "votes", "score"],
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of(page or "", path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("path"), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"]
        )


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: host, path, votes, score."""
    own = bounded_batches(pages).select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = own.mapInArrow(
        freeing(_votes), "host string, path string, votes bigint, score double"
    ).groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    rank = F.struct("votes", F.round("score").alias("worth"), (-F.length("path")).alias("shorter"), "path")
    return votes.groupBy("host").agg(F.max(rank).alias("best")).select("host", "best.path", "best.votes")


def extracted(pages: DataFrame) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, url, path (its host's winner), text."""
    own = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")
    )
    winners = stored(host_paths(pages).select("host", "path"))
    joined = own.join(small_side(winners), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(freeing(_extracted), f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, path string, text string")
