"""Main text of web pages by consensus host paths.

Pass 1 parses each page into a tree, scores its containers (text mass outside boilerplate, less links, by
kind of tag) and writes its best three as votes on generalised tag-class paths: tags with their class names,
digits folded, positions and ids left out. Spark sums the votes by host and path (pre-aggregated, so a hot
host costs no more than its distinct paths) and ranks each host's paths, first within salted parts of a host. Pass 2 parses the pages again
and takes the text under the host's best path that the page has, less boilerplate; a page that has none
of them falls back on its own best container.

A block is the text between two block-level tags; character references are decoded, white space (also
no-break spaces and <br>) becomes one space, blank blocks go, and blocks are joined by a newline.

Defined results: null and empty html, and pages without text, give an empty text; a null url is the host ''; a
broken page is read as far as its tags make sense (unclosed tags close with their parent, stray
closing tags are ignored; once a quote in a tag isn't closed before the page ends, quotes no longer hide a
'>'); a page is read in time linear in its length; repeated rows vote and are extracted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._components import spread_join
from barloom.llm._store import lean, text_batches

VOTES = 3
PATHS = 5
SALT = 32

#: Groups: slash, name, attributes. With quotes that hide '>', and without.
TOKEN, PLAIN = (
    re.compile(rf"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>|[^<]++|<""", re.S) for attributes in (r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""", "[^>]*+")
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr img br".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
CONTAINERS = {"article": 130, "main": 125, "section": 100, "div": 100, "td": 90, "body": 60, "center": 90, "blockquote": 40}
#: Words of class names and ids that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommended respond reply replies search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("table ul ol dl body article section div main select".split())


class Page:
    """Nodes in page order (parents first) and the blocks of text under them."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.path, self.drop = ["#"], [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._read(html)
        self._lift()

    def _open(self, tag: str, attributes: str, stack: list[int]) -> int:
        names, words, drop = "", (), tag in DROPPED
        if attributes:
            found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
            names = found.get("class", "")
            words = [w.lower() for w in WORD.findall(f"{names} {found.get('id', '')}")]
            style = found.get("style", "").replace(" ", "").lower()
            drop = drop or found.get("role", "").lower() in ROLES or "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true"
        if tag not in ("html", "body", "article", "main"):
            drop = drop or any(w in BOILERPLATE for w in words)
        elif tag in ("html", "body"):
            drop = False
        up = stack[-1]
        label = tag + "".join("." + DIGITS.sub("#", c) for c in sorted(names.split())[:3])
        path = f"{self.path[up]}/{label}"
        if len(path) > 600:
            path = f"~{crc32(path.encode()):08x}/{label[:200]}"
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(path)
        self.drop.append(drop)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, links = [0], 0
        where: dict[str, list[int]] = defaultdict(list)  # places on the stack by tag
        blocks, scopes = [0], [0]  # places of tags that aren't inline, and of those that end the search for siblings
        unclosed: set[str] = set()
        held: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    self.blocks.append((stack[blocks[-1]], text, min(len(text), linked)))
                held, linked = [], 0

        def close(place: int) -> None:
            """Takes all from this place on off the stack."""
            nonlocal links
            while len(stack) > place:
                gone = self.tag[stack.pop()]
                where[gone].pop()
                links -= gone == "a"
            while blocks[-1] >= place:
                blocks.pop()
            while scopes[-1] >= place:
                scopes.pop()

        at, end, last, token = 0, len(html), html.rfind(">"), TOKEN
        while at < end:
            if at > last:  # no tag can follow
                text = html[at:].partition("<!--")[0]
                held.append(text)
                if links:
                    linked += len(text.strip())
                break
            m = token.match(html, at)
            if m[0] == "<" and token is TOKEN and html[at + 1 : at + 2].isascii() and html[at + 1 : at + 2].isalpha():
                token = PLAIN
                m = token.match(html, at)
            at = m.end()
            name = m[2]
            if name is None:
                text = m[0]
                if not text.startswith(("<!", "<?")):
                    held.append(text)
                    if links:
                        linked += len(text.strip())
                continue
            tag = name.lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/") and tag not in unclosed:
                    shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if not shut:
                        unclosed.add(tag)
                    at = shut.end() if shut else end if tag in ("script", "style") else at
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if tag in VOID:
                continue
            if m[1]:
                if where[tag] and (tag not in INLINE or where[tag][-1] > blocks[-1]):  # an inline tag doesn't close blocks
                    close(where[tag][-1])
                continue
            if tag not in INLINE:
                ends = CLOSES.get(tag)
                if ends:  # siblings such as li before li, up to the list or table they belong to
                    least = [w[k] for w in (where[t] for t in (*ends, "p")) if (k := bisect_right(w, scopes[-1])) < len(w)]
                    if least:
                        close(min(least))
                elif self.tag[stack[blocks[-1]]] == "p":
                    close(blocks[-1])
            place = len(stack)
            stack.append(self._open(tag, m[3], stack))
            where[tag].append(place)
            if tag not in INLINE:
                blocks.append(place)
                if tag in SCOPES:
                    scopes.append(place)
            links += tag == "a"
        flush()

    def _lift(self) -> None:
        """Boilerplate is what lies under a dropped node, unless an article or main lies inside that; then masses by node."""
        n = len(self.tag)
        core, title = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            core[k] = core[k] or self.tag[k] in ("article", "main")
            title[k] = title[k] or self.tag[k] == "h1"
            core[self.parent[k]] |= core[k]
            title[self.parent[k]] |= title[k]
        inside = [False] * n
        for k in range(1, n):
            up = self.parent[k]
            inside[k] = inside[up] or self.tag[k] == "article"
            own = self.drop[k] and not core[k]
            if own and self.tag[k] == "header" and inside[up] and title[k]:
                own = False  # an article's own heading
            self.drop[k] = self.drop[up] or own
        self.mass, self.link = [0] * n, [0] * n
        for node, text, linked in self.blocks:
            if not self.drop[node]:
                self.mass[node] += len(text)
                self.link[node] += linked
        for k in range(n - 1, 0, -1):
            self.mass[self.parent[k]] += self.mass[k]
            self.link[self.parent[k]] += self.link[k]

    def scores(self) -> list[tuple[int, int]]:
        """(score, node) of the containers, best first; scores in thousandths of the page's text, by kind of tag."""
        total = self.mass[0]
        if not total:
            return []
        out = [(1000 * (self.mass[k] - self.link[k]) // total * CONTAINERS[t] // 100, k) for k, t in enumerate(self.tag) if t in CONTAINERS and self.mass[k] and not self.drop[k]]
        return sorted(out, key=lambda x: (-x[0], -x[1]))

    def text(self, paths: list[str]) -> tuple[str, str]:
        """(text, path) under the first of the paths that the page has, or under its own best container."""
        for path in paths:
            roots = {k for k, p in enumerate(self.path) if p == path and self.mass[k] and not self.drop[k]}
            if roots:
                return self._under(roots), path
        best = self.scores()
        if best:
            return self._under({best[0][1]}), self.path[best[0][1]]
        return self._under({0}), ""

    def _under(self, roots: set[int]) -> str:
        inside = [k in roots for k in range(len(self.tag))]
        for k in range(1, len(self.tag)):
            inside[k] = inside[k] or inside[self.parent[k]]
        return "\n".join(text for node, text, _ in self.blocks if inside[node] and not self.drop[node])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("__host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(__host, paths): each host's paths by votes, PATHS at most, those with a tenth of the first one's votes at least."""

    @lean
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for host, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                page = Page(html.as_py() or "")
                rows += [(host, page.path[node], score) for score, node in page.scores()[:VOTES] if score > 0]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["__host", "path", "vote"])

    votes = _hosted(pages).select("__host", "html").mapInArrow(vote, "__host string, path string, vote long").groupBy("__host", "path").agg(F.sum("vote").alias("votes"))
    order = [F.desc("votes"), F.desc(F.length("path")), "path"]
    part = Window.partitionBy("__host", F.pmod(F.hash("path"), F.lit(SALT))).orderBy(*order)  # of a hot host's paths the best of each part
    some = votes.withColumn("rank", F.row_number().over(part)).filter(f"rank <= {PATHS}")
    w = Window.partitionBy("__host").orderBy(*order)
    ranked = some.withColumn("rank", F.row_number().over(w)).withColumn("most", F.max("votes").over(Window.partitionBy("__host")))
    good = ranked.filter(f"rank <= {PATHS} AND 10 * votes >= most")
    return good.groupBy("__host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [Page(html.as_py() or "").text(paths.as_py() or []) for html, paths in zip(part.column(2), part.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    text_batches(pages.sparkSession)
    hosted = _hosted(pages)
    hosts = hosted.groupBy("__host").agg(F.count(F.lit(1)).alias("pages")).join(host_paths(pages), "__host", "left")
    kinds = dict(pages.dtypes)
    joined = spread_join(hosted, hosts, "__host", "pages").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, path string")
