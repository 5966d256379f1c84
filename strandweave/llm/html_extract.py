"""Main text of web pages by consensus host paths.

1. Every page scores its containers: letters outside links in paragraphs and headings speak for a
   container, links and snippets against it; menus, notices, adverts, forms, sidebars and reader
   comments are left out wherever they lie. The highest score wins, or an inner container that holds
   nearly all of it and misses no title before it.
2. The page votes for the *generalised path* of its best container: the tags from the body down with
   their class names or ids, page numbers replaced, so that ``post-1017`` and ``post-1018`` are one. Spark adds
   the votes up per host.
3. Each page is extracted again. Among its own containers the path is taken whose share of the host's
   votes, times the root of the page's own score of it, is highest: a page with a short article and a long
   sidebar follows its host; one without any winning path keeps its own best container.

A host's winners are the paths with at least one vote in ``LEAST_SHARE``: at most that many, whatever
the host's size. Hosts with at least one page in ``HOT_SHARE`` (so at most that many hosts) are
looked up in a broadcast table; pages of all others meet their winners in a join by host.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one line feed. A line break element is white space.

Defined results: null and empty pages have empty text. Pages whose URL names no host follow their own
best container. A page without tags is one block. Repeated rows and page ids are extracted each for
itself; a page cut off anywhere is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import write_stage

LEAST_SHARE = 100
HOT_SHARE = 2000
SHORT_TEXT = 30
NEARLY_ALL = 0.85
LONGEST_PATH = 256

_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>?))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|([^\s=/\"'>]++)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Numbers that tell pages apart: any in an id, long ones in a class ("col-8" stays).
_DIGITS = re.compile(r"\d+")
_LONG_DIGITS = re.compile(r"\d{3,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Fixed lists of the markup language and of names that sites give their page parts.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav object ol option p pre "
    "search section select summary svg table tbody td tfoot th thead tr ul video audio canvas map".split())
CONTAINERS = frozenset("body main article section div td blockquote center form dd figure table tbody tr ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset("h1 h2 h3".split())
BOILERPLATE = frozenset(
    "nav footer aside form menu button select dialog svg object video audio canvas map search dir".split())
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored promo "
    "promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar comment comments commentlist disqus "
    "respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations pagination "
    "pager toolbar widget widgets skip disclaimer copyright legal tracking feedback".split())
#: Names of reader comments, and words that turn a class into a remark on the whole page ("comments-open").
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
REMARKS = frozenset("has no with without open closed hide show enabled disabled is".split())
GOOD_NAMES = frozenset("article content entry main post story text body".split())
CLOSES_P = BLOCKS - {"button", "object", "option", "svg", "video", "audio", "canvas", "map", "select", "legend", "caption"}
CLOSED_BY_KIN = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table div section article main body aside nav form select".split())

_VOTE = "host string, path string"
_TEXT = "page_id long, url string, text string, path string"


class Page:
    """Blocks and elements of one page, in page order.

    Elements are tuples ``(parent, tag, path, state, names, depth, in_header)``, where ``state`` is "out"
    for what is never main text, "named" where only a name says so, "comments", or empty; blocks are
    ``(element, text, linked)`` with the letters of the block that lie in links.
    """

    def __init__(self, source: str):
        self.elements: list[tuple] = [(-1, "body", "body", "", frozenset(), 0, False)]
        self.blocks: list[tuple] = []
        self._open = [0]
        self._tally: dict[str, int] = {}
        self._pieces: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(source)
        self._flush()
        self._weigh()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TAG.search(source, at)
            if found is None:
                self._say(source[at:])
                return
            self._say(source[at:found.start()])
            at = found.end()
            name = found.group(2)
            if name is None or not found.group(4):
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            name = name.lower()
            if found.group(1):
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                at = len(source) if end is None else end.end()
            else:
                self._start(name, found.group(3))

    def _say(self, text: str) -> None:
        if text:
            if self._links:
                self._linked += len(text) - text.count(" ")
            self._pieces.append(text)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((self._open[-1], text, self._linked))
            self._pieces = []
        self._linked = 0

    def _start(self, name: str, raw: str) -> None:
        if name == "br":
            self._say(" ")
        if name == "a":
            self._links = 1
        if name not in BLOCKS:
            return
        self._flush()
        if name in CLOSES_P:
            self._close_within("p")
        if name in CLOSED_BY_KIN:
            for kin in CLOSED_BY_KIN[name]:
                self._close_within(kin)
        if name in VOID or name in ("body", "html"):
            return
        attributes = {}
        for key, double, single, bare, alone in _ATTRIBUTE.findall(raw):
            attributes.setdefault((key or alone).lower(), double or single or bare)
        classes = html.unescape(attributes.get("class", "")).split()
        identity = html.unescape(attributes.get("id", "")).strip()
        parts = [frozenset(p.lower() for p in _PARTS.findall(c)) for c in (*classes, identity)]
        names = frozenset().union(*(p for p in parts if not p & REMARKS))
        parent = self._open[-1]
        above = self.elements[parent]
        labels = sorted({_LONG_DIGITS.sub("#", c) for c in classes}) or ([f"#{_DIGITS.sub('#', identity)}"] if identity else [])
        path = f"{above[2]}>{name}{''.join('.' + x for x in labels)}"
        if len(path) > LONGEST_PATH:
            path = "~" + hashlib.blake2b(path.encode("utf-8", "replace"), digest_size=12).hexdigest()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(
            _HIDDEN.search(attributes.get("style", "")))
        out = name in BOILERPLATE or hidden or attributes.get("role", "").lower() in BAD_ROLES
        named = bool(names & BAD_NAMES) and name != "main" and name not in HEADINGS
        if name == "header":
            # A page's header goes; one inside an article keeps its headings.
            out = out or not (self._tally.get("article") or self._tally.get("main"))
        if attributes.get("itemprop", "").lower() == "articlebody":
            names = names | {"article"}
        state = "out" if out else "comments" if named and names & COMMENT_NAMES else "named" if named else ""
        in_header = name == "header" or (above[6] and name not in HEADINGS)
        self.elements.append((parent, name, path, state, names, above[5] + 1, in_header))
        self._open.append(len(self.elements) - 1)
        self._tally[name] = self._tally.get(name, 0) + 1

    def _drop_open(self, depth: int) -> None:
        for e in self._open[depth:]:
            self._tally[self.elements[e][1]] -= 1
        del self._open[depth:]

    def _close_within(self, name: str) -> None:
        """Close an open ``name``, unless a container that bounds it was opened since."""
        if not self._tally.get(name):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.elements[self._open[depth]][1]
            if tag == name:
                self._flush()
                self._drop_open(depth)
                return
            if tag in SCOPES:
                return

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = 0
            return
        if name not in BLOCKS or name in ("body", "html"):
            if name == "br":
                self._say(" ")
            return
        self._flush()
        if self._tally.get(name):
            depth = next(d for d in range(len(self._open) - 1, 0, -1) if self.elements[self._open[d]][1] == name)
            self._drop_open(depth)
            self._links = 0

    def _weigh(self) -> None:
        """Decide what is left out, and add the blocks' values up to every container."""
        count = len(self.elements)
        letters, linked, plain_article = [0] * count, [0] * count, [False] * count
        for element, text, links in self.blocks:
            letters[element] += len(text) - text.count(" ")
            linked[element] += links
        for e in range(count - 1, 0, -1):
            parent, tag, _, state = self.elements[e][:4]
            letters[parent] += letters[e]
            linked[parent] += linked[e]
            plain_article[parent] |= plain_article[e] or (tag in ("article", "main") and not state)
        self._cut = [False] * count
        for e in range(1, count):
            parent, tag, _, state = self.elements[e][:4]
            # A telling name says nothing on a wrapper of the article or of most of the page.
            wraps = plain_article[e] or (letters[e] - linked[e]) * 2 > letters[0]
            list_of_links = tag in ("ul", "ol", "dl") and 0 < letters[e] <= linked[e] * 1.1
            self._cut[e] = (self._cut[parent] or state in ("out", "comments") or (state == "named" and not wraps)
                            or list_of_links)
        value, kept = [0.0] * count, [False] * count
        for element, text, links in self.blocks:
            if self._dropped(element):
                continue
            size = len(text) - text.count(" ")
            kept[element] = True
            if self.elements[element][1] in HEADINGS:
                value[element] += size - links
            elif size >= SHORT_TEXT or text[-1] in ".!?:;…。":
                value[element] += size - 2 * links
            else:
                value[element] -= 0.5 * size
        for e in range(count - 1, 0, -1):
            value[self.elements[e][0]] += value[e]
            kept[self.elements[e][0]] |= kept[e]
        self.scores: dict[str, float] = {}
        self._depth: dict[str, int] = {}
        for e in range(count):
            _, tag, path, _, names, depth, _ = self.elements[e]
            if tag in CONTAINERS and kept[e] and not self._cut[e]:
                gain = 1.2 if value[e] > 0 and (tag in ("article", "main") or names & GOOD_NAMES) else 1.0
                self.scores[path] = self.scores.get(path, 0.0) + value[e] * gain
                self._depth[path] = depth

    def _dropped(self, element: int) -> bool:
        """In what is left out, or in an article's header and no heading."""
        return self._cut[element] or self.elements[element][6]

    def best(self) -> str:
        """Path of the container with the highest score, narrowed as far as nothing but asides is lost."""
        found = max(self.scores, key=lambda p: (self.scores[p], self._depth[p], p), default="body")
        while True:
            inner = [p for p in self.scores if self._depth[p] > self._depth.get(found, 0)
                     and self.scores[p] >= NEARLY_ALL * self.scores[found] > 0 and not self._titled(found, p)]
            if not inner:
                return found
            found = max(inner, key=lambda p: (self.scores[p], self._depth[p], p))

    def _titled(self, outer: str, inner: str) -> bool:
        """Whether a title of ``outer`` comes before the first block of ``inner``."""
        around, within = self._inside(outer), self._inside(inner)
        for element, _, _ in self.blocks:
            if within[element]:
                return False
            if around[element] and self.elements[element][1] in TITLES and not self._dropped(element):
                return True
        return True

    def agreed(self, votes: dict[str, int]) -> str:
        """Path by the host's votes and the page's own scores."""
        shared = [p for p in self.scores if votes.get(p)]
        if not shared:
            return self.best()
        return max(shared, key=lambda p: (votes[p] * math.sqrt(max(self.scores[p], 0.0) + 1), self._depth[p], p))

    def _inside(self, path: str) -> list[bool]:
        """Which elements lie in a container on ``path``."""
        inside = [False] * len(self.elements)
        for e, (parent, _, own, *_) in enumerate(self.elements):
            inside[e] = own == path or (parent >= 0 and inside[parent])
        return inside

    def text(self, path: str) -> str:
        """Blocks of all containers on ``path``."""
        inside = self._inside(path)
        return "\n".join(text for e, text, _ in self.blocks if inside[e] and not self._dropped(e))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [Page(source.as_py()).best() for source in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string())], ["host", "path"])


def host_votes(pages: DataFrame) -> DataFrame:
    """``(host, path, votes)``: one vote of every page with text and a host; map-side combine."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    rows = rows.where((F.col("host") != "") & (F.length("html") > 0))
    return rows.mapInArrow(_vote, _VOTE).groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(votes: DataFrame) -> DataFrame:
    """``(host, pages, paths)``: the host's pages and its winning paths as a map to their votes.

    A host's distinct paths are not gathered: only those with enough votes, at most ``LEAST_SHARE``.
    """
    pages = votes.groupBy("host").agg(F.sum("votes").alias("pages"))
    return (votes.join(pages, "host").where(F.col("votes") * LEAST_SHARE >= F.col("pages"))
            .groupBy("host").agg(F.max("pages").alias("pages"),
                                 F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("paths")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, paths = [], []
        for source, votes in zip(batch.column(2), batch.column(3), strict=True):
            page = Page(source.as_py() or "")
            path = page.agreed(dict(votes.as_py() or ()))
            texts.append(page.text(path))
            paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(paths, pa.string())],
            ["page_id", "url", "text", "path"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, path)`` of every row of ``pages(page_id, url, html)``."""
    agreed = write_stage(winners(write_stage(host_votes(pages), "votes")), "winners")
    total = agreed.agg(F.sum("pages")).first()[0] or 0
    hot = agreed.where(F.col("pages") * HOT_SHARE >= total)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").alias("html"), host_of(F.col("url")).alias("host"))
    # At most HOT_SHARE hosts with LEAST_SHARE short paths each.
    known = F.broadcast(hot.select("host", "paths"))
    common = rows.join(known, "host")
    rest = rows.join(known, "host", "left_anti").join(
        agreed.where(F.col("pages") * HOT_SHARE < total).select("host", "paths"), "host", "left")
    columns = ("page_id", "url", "html", "paths")
    both = [part.select(*columns).mapInArrow(_extract, _TEXT) for part in (common, rest)]
    return both[0].unionByName(both[1]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
