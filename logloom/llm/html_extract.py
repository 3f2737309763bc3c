"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the text of their blocks (links count against them), and the page
votes for the generalised path (tags and classes, without numbers) of the whole that holds its best container: the
article or main part around it, else the outermost container inside body. Spark adds the votes up per
(host, path), with partial sums before the shuffle, and keeps each host's winning path. Second pass: each page's text
is taken from the containers on its host's winning path, or from its own best container where it has none on it.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles, comments in the markup and comments of
readers are left out. Character references are decoded; white space inside a block becomes one space; blocks are
trimmed and joined by one line feed, in page order; nothing else is dropped.

Defined cases: null or empty html gives an empty text; a null url or one without host belongs to the host ''; repeated
rows are extracted each; ties between paths go to the larger text, then to the path that is last by name; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_lib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Markup: a comment, or a tag whose quoted attribute values may hold anything (a quote starts a value only after =), or a declaration.
_tag = re.compile(r"<!--(?:.*?-->|.*)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^>]*>", re.DOTALL)
_attr = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_space = re.compile(r"\s+")
_number = re.compile(r"[0-9]+")
_part = re.compile(r"[a-z]+")

#: Elements by their part in a page.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math object canvas select".split())
#: Those of them that hold markup, so that one may stand in another.
NESTED = frozenset("template svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div td center fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption header footer nav aside form address details summary hgroup head menu dialog hr option".split())
LEFT_OUT = frozenset("nav footer aside form head dialog menu button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id or role names that tell of something else than the article.
OTHER_NAMES = frozenset(
    "nav navbar navigation menu menubar sidebar side aside footer foot masthead ad ads advert adverts advertisement adbox adslot banner promo promotion sponsor sponsored"
    " cookie cookies consent notice notices alert gdpr comment comments commentlist disqus reply replies respond discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager"
    " newsletter subscribe subscription signup login popup modal overlay toolbar widget skip contentinfo complementary search hidden".split()
)
HEADER_NAMES = frozenset("header banner".split())
#: Parts of a name that tells how the page is laid out (no-sidebar, with-sidebar), not what the element is.
LAYOUT_WORDS = frozenset("no not with without has have off on hide show disabled enabled".split())
#: Elements that no name leaves out.
NEVER_BY_NAME = frozenset("html body article main".split())
_closes_p = BLOCKS - {"option"}


@functools.cache
def _raw_tag(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.IGNORECASE)


def generalised(tag: str, names: list[str]) -> str:
    """A step of a path: the tag and its classes, in order of name, numbers as *."""
    return ".".join([tag, *sorted({_number.sub("*", x) for x in names})])


class Page:
    """Blocks and containers of a page. node: (tag, path, parent, kind); kind 0 plain, 1 left out, 2 a header."""

    def __init__(self, source: str):
        self.nodes: list[tuple[str, str, int, int]] = [("", "", -1, 0)]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.by_name: set[int] = set()  # nodes left out by a name or as hidden
        stack = [0]
        text: list[str] = []
        linked, in_link, at, n = 0, False, 0, len(source)

        def flush() -> None:
            nonlocal linked, in_link
            if text:
                t = _space.sub(" ", html_lib.unescape("".join(text))).strip()
                if t:
                    self.blocks.append((stack[-1], t, linked))
                text.clear()
            linked, in_link = 0, False

        while at < n:
            m = _tag.search(source, at)
            end = m.start() if m else n
            if end > at:
                piece = source[at:end]
                text.append(piece)
                if in_link:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["close"]:
                if name == "a":
                    in_link = False
                elif name in BLOCKS:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if self.nodes[stack[k]][0] == name:
                            del stack[k:]
                            break
                        if name == "p" and self.nodes[stack[k]][0] in CONTAINERS:
                            break
                continue
            if name in RAW:
                at = self._end_of(name, source, at)
                continue
            if name == "br":
                text.append(" ")
            elif name == "a":
                in_link = True
            elif name in BLOCKS or name == "button":
                flush()
                attrs = m["attrs"] or ""
                if name in _closes_p:
                    self._close(stack, ("p",))
                if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    self._close(stack, ("dt", "dd") if name in ("dt", "dd") else ("td", "th", "tr") if name == "tr" else ("td", "th") if name in ("td", "th") else (name,))
                if name in VOID:
                    continue
                self._open(stack, name, attrs)
        flush()
        if self.by_name and self.blocks and all(self._wanted(b[0], None) is None for b in self.blocks):
            self._way_back()

    @staticmethod
    def _end_of(name: str, source: str, at: int) -> int:
        """Where an element of ``RAW`` ends that starts before ``at``; those that hold markup may hold their like."""
        depth = 1
        for m in _raw_tag(name).finditer(source, at):
            if m[1]:
                depth -= 1
            elif name in NESTED and not m[0].endswith("/>"):
                depth += 1
            if not depth:
                return m.end()
        return len(source)

    def _way_back(self) -> None:
        """Where everything was left out: articles, the main part and the page, with all around them, count in spite of names."""
        for i, (tag, *_) in enumerate(self.nodes):
            if tag in NEVER_BY_NAME:
                x = i
                while x > 0:
                    if x in self.by_name:
                        self.by_name.discard(x)
                        self.nodes[x] = (*self.nodes[x][:3], 0)
                    x = self.nodes[x][2]

    def _close(self, stack: list[int], names: tuple[str, ...]) -> None:
        """Ends open elements of these names up to the nearest container or list."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.nodes[stack[k]][0]
            if tag in names:
                del stack[k:]
            elif tag in CONTAINERS or tag in ("ul", "ol", "dl", "table"):
                return

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        classes, parts, hidden = [], set(), False
        if attrs:
            for key, value in _attr.findall(attrs):
                key, value = key.lower(), value.strip("\"'").lower()
                hidden |= key == "hidden"
                if key in ("class", "id", "role"):
                    if key == "class":
                        classes = value.split()
                    for x in value.split():
                        of_name = _part.findall(x)
                        if LAYOUT_WORDS.isdisjoint(of_name):
                            parts.update(of_name)
        parent = stack[-1]
        kind = 0
        if name in NEVER_BY_NAME:
            parts = set()
        if name == "header" or (name in CONTAINERS and parts & HEADER_NAMES and not parts & (OTHER_NAMES - HEADER_NAMES)):
            kind = 2
        elif name in LEFT_OUT or hidden or parts & OTHER_NAMES:
            kind = 1
        if kind and name != "header" and name not in LEFT_OUT:
            self.by_name.add(len(self.nodes))
        up = self.nodes[parent][1]
        step = generalised(name, classes if name not in ("html", "body") else [])
        self.nodes.append((name, f"{up}>{step}" if up else step, parent, kind))
        stack.append(len(self.nodes) - 1)

    def _wanted(self, node: int, top: int | None) -> int | None:
        """The topmost container to which a block belongs if nothing between them is left out; ``top``: that one only."""
        heading, x = self.nodes[node][0] in HEADINGS, node
        while x != top:
            _, _, parent, kind = self.nodes[x]
            if kind == 1 or kind == 2 and not (heading and self._inside_article(parent)):
                return None
            if parent < 0:
                return x if top is None else None
            x = parent
        return x

    def _inside_article(self, x: int) -> bool:
        while x > 0:
            if self.nodes[x][0] in ("article", "main"):
                return True
            x = self.nodes[x][2]
        return False

    def scores(self) -> dict[int, float]:
        """Containers' scores: all of a block's text for the nearest container, half for the next above it."""
        out: dict[int, float] = {}
        for node, text, linked in self.blocks:
            if self._wanted(node, None) is None:
                continue
            weight, share, x = max(0, len(text) - 2 * linked), 1.0, node
            while x >= 0 and share > 0.3:
                tag = self.nodes[x][0]
                if x == 0 or tag in CONTAINERS:
                    out[x] = out.get(x, 0.0) + weight * share * (1.25 if tag in ("article", "main") else 1.0)
                    share /= 2
                x = self.nodes[x][2]
        return out

    def best(self) -> tuple[int, float]:
        """The whole of the best container (the first of the best), and its score; the page itself if it has no text."""
        s = self.scores()
        if not s:
            return 0, 0.0
        x, score = max(s.items(), key=lambda kv: (kv[1], -kv[0]))
        return self._whole(x), score

    def _whole(self, x: int) -> int:
        """The outermost article (else main part) around a container, or else the outermost container inside body, as
        far as nothing between them is left out."""
        way = [x]
        while x > 0 and self.nodes[x][3] == 0:
            x = self.nodes[x][2]
            way.append(x)
        if self.nodes[x][3]:
            way.pop()
        for tags in (("article",), ("main",), CONTAINERS - {"html", "body", "td"}):
            of_tag = [y for y in way if self.nodes[y][0] in tags]
            if of_tag:
                return of_tag[-1]
        return way[0]

    def text(self, path: str | None) -> str:
        """The text of the containers on ``path``, else of the best one."""
        tops = {i for i, x in enumerate(self.nodes) if x[1] == path and (i == 0 or x[0] in CONTAINERS)} if path is not None else set()
        out = self._collect(tops) if tops else []
        return "\n".join(out or self._collect({self.best()[0]}))

    def _collect(self, tops: set[int]) -> list[str]:
        out = []
        for node, text, _ in self.blocks:
            x = node
            while x >= 0 and x not in tops:
                x = self.nodes[x][2]
            if x >= 0 and self._wanted(node, x) is not None:
                out.append(text)
        return out


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score): what the pages vote for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                node, score = page.best()
                if score > 0:
                    rows.append((host, page.nodes[node][1], score))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "score"])

    one = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, score double")
    return one.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, winner): each host's path with most votes."""
    return votes(pages).groupBy("host").agg(F.max(F.struct("votes", F.round("score", 3).alias("score"), "path")).alias("best")).select("host", F.col("best.path").alias("winner"))


#: Hosts whose winners may be broadcast (about a hundred bytes each); more are joined by a shuffle, whose hot hosts AQE splits.
BROADCAST_HOSTS = 200_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and host of every page."""
    won = materialize(winners(pages), "host-paths")
    side = F.broadcast(won) if won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else won
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(source or "").text(path) for source, path in zip(b.column("html").to_pylist(), b.column("winner").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), b.column("host")], names=["page_id", "url", "text", "n_chars", "host"])

    return joined.select("page_id", "url", "html", "host", "winner").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, host string")
