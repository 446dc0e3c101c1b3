"""Main text of web pages: page structure, and suffix arrays over the token streams of a host's pages.

Every page becomes a list of text blocks in page order. Each block lies in the ``content`` zone (article or main
element), in the ``open`` zone (elsewhere in the body), or in none, if markup says that it is a menu, header, footer,
sidebar, notice, advert, form or reader comment. Class and id names say so as whole names (``sidebar``) or compounds of
known words (``share-buttons``, ``topnav``); ``no-sidebar`` or ``with-sidebar`` say nothing. The titles (``h1``) that
stand in a main element before its first article belong to the text. A menu or other such part without its end tag ends
where an article or main element starts, a menu also at a title, section or paragraph. A wrapper whose name rules it out
does not rule out a main element in it, nor, on pages without other articles, an article, unless the name says that the
articles are other people's or teasers.

The pages of a host are concatenated into one stream of tokens (words, and the tag that starts a block), and a suffix
array of it, sorted to ``DEPTH`` tokens by prefix doubling, shows the substrings of that length or longer that several
distinct pages share. Covered blocks are boilerplate; the unique runs are kept:

* on a page without article or main element, open blocks covered by substrings of at least ``least`` pages and a
  ``share`` of the host's pages go;
* inside an article, where shared passages are text, only blocks on nearly all pages (``most``) of a host with many
  pages go. An article on a host with few pages is decided by its markup alone.

Pages without any article or main element, whose hosts may be small, also meet the others of the whole crawl, dealt by
a hash into parts of about ``crawl_pages``: suffix arrays show the passages on at least ``least`` pages and a
``crawl_share`` of all of them, and the text is what lies between the first and the last block not covered by them. Runs of
``long_run`` tokens that pages share are copied articles and stay.

Pages with the same stream count as one page, so that copies do not erase each other. Counts are those of the whole
host or crawl at any size. A host with more than ``block_pages`` pages or ``block_bytes`` of html is dealt by a hash of
the stream into parts of about that size, each with its own suffix array, so that no task holds a whole large host. A
part names its substrings that are frequent enough for the whole to reach the limit, given what the other parts may
hold without naming it; all parts then count what is still possible (``_frequent``). Substrings are told apart by
64-bit hashes between parts. The parts do not change the result.

Null, empty and text-free pages give the empty text. A null url is a host of its own. Repeated rows each get a row.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark.llm import arrays as A
from gleanmark.plans.ranks import null_safe_join
from gleanmark.session import materialize

DEPTH = 8
CONTENT, OPEN = 1, 0
#: White space between the blocks of a stream; the texts of blocks hold no white space but single spaces.
_MARK = "\x1e"

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_SILENT = set(
    "script style noscript template head title svg math iframe object canvas audio video select textarea button "
    "datalist map".split()
)
_OUTSIDE = set("nav footer aside form menu dialog search".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_MARKS = set(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist respond disqus reply replies breadcrumb breadcrumbs pagination pager "
    "widget toolbar skip form".split()
)
#: Marks of parts that hold articles other than the page's own.
_OTHERS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended "
    "recommendations comment comments commentlist respond disqus reply replies".split()
)
#: Words that leave a mark in the same name as it is.
_BESIDE = set(
    "area bar block bottom box btn button buttons container element group holder icon icons inner item items link links "
    "list main module outer page panel post posts row section site slot text title top unit wrap wrapper "
    "desktop global left local mobile primary right secondary sub user".split()
)
#: Words that leave a mark of other people's parts in the same name as it is.
_BESIDE_OTHERS = _BESIDE | set(
    "all article articles blog customer customers entry facebook guest latest new news product reader readers recent story "
    "thread users view viewer viewers visitor visitors your".split()
)
_IN_HEAD = set("base basefont bgsound link meta title style script noscript template head".split())
#: How surely something is outside: by a name, by a name of other articles, by its tag, role or style.
_NAMED, _NAMED_OTHERS, _SURELY = 1, 2, 3
#: End of the container of an article in a part that its name rules out.
_HELD = " held"
#: Elements beside article and main that end a menu without its end tag.
_ENDS_MENU = set("h1 section p".split())
#: What the html of a page holds if its markup may say where its article is.
_ARTICLE_TAG = r"(?i)<(?:article|main)[\s>/]|role\s*=\s*[\"']?\s*(?:main|article)"
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _words_of(part: str) -> set[str]:
    """A part of a name, or the known word and the mark that it is written together from."""
    if part not in _MARKS and part not in _BESIDE_OTHERS:
        for i in range(3, len(part) - 2):
            a, b = part[:i], part[i:]
            if (a in _BESIDE_OTHERS and b in _MARKS) or (a in _MARKS and b in _BESIDE_OTHERS):
                return {a, b}
    return {part}


@lru_cache(maxsize=1 << 14)
def _named(names: str, inside: bool) -> int:
    """What class and id names say of an element, ``inside`` an article or main element or not."""
    found = 0
    for name in names.split():
        words = (_words_of(p.lower()) for p in _NAME_PARTS.split(name) if p and not p.isdigit())
        parts = set().union(*words)
        marks = parts & _MARKS
        others = bool(marks & _OTHERS)
        if marks - ({"header"} if inside else set()) and parts <= _MARKS | (_BESIDE_OTHERS if others else _BESIDE):
            found = max(found, _NAMED_OTHERS if others else _NAMED)
    return found


class _Page(HTMLParser):
    """Collects the blocks of one page.

    ``endless`` are the numbers, among the elements outside the text by their tag, of those without an end tag.
    """

    def __init__(self, endless: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.endless = endless
        self.n_outside = 0
        self.ended: set[int] = set()                        # numbers still open at the end of the page
        self.unended: dict[int, int] = {}                   # place in the stack of open elements: number
        self.open: list[tuple[str, bool, int, str]] = []    # tag, silent, outside, container
        self.blocks: list[tuple[str, str, str]] = []        # text, container, tag
        self.parts: list[str] = []
        self.tag = ""

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not counted."""
        return j

    def state(self) -> tuple[bool, int, str]:
        return self.open[-1][1:] if self.open else (False, 0, "")

    def flush(self, tag: str) -> None:
        container = self.state()[2]
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.blocks.append((text, container, self.tag))
        self.tag = tag

    def outside(self, tag: str, attributes: dict[str, str | None], role: str, container: str) -> int:
        if tag in _OUTSIDE or (tag == "header" and not container):
            return _SURELY
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN_STYLE.search(
                attributes.get("style") or ""):
            return _SURELY
        if role in _ROLES:
            return _SURELY
        if tag in ("html", "body", "article", "main") or role == "main":
            return 0
        return _named(f"{attributes.get('class') or ''} {attributes.get('id') or ''}", bool(container))

    def close_head(self, tag: str) -> None:
        """Closes a head, whose end tag may be left out, before what cannot stand in it."""
        tags = [o[0] for o in self.open]
        if "head" in tags and (tags[-1] == "head" or (tag == "body" and "template" not in tags)):
            self.cut(tags.index("head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open and tag not in _IN_HEAD:
            self.close_head(tag)
        if tag == "head" and any(o[0] != "html" for o in self.open):
            return
        if tag in _VOID:
            if tag == "hr":
                self.flush(tag)
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush(tag)
            self.close_paragraph()
        if self.endless and self.unended:
            self.end_endless(tag, attrs)
        silent, outside, container = self.state()
        attributes = dict(attrs)
        role = (attributes.get("role") or "").lower()
        if tag in _SILENT:
            silent = True
        elif outside < _SURELY:
            found = self.outside(tag, attributes, role, container)
            if tag == "main" or role == "main":
                outside = found
            elif outside == _NAMED and not found and (tag == "article" or role == "article"):
                outside, container = 0, f"{container.removesuffix(_HELD)}{_HELD}"
            else:
                outside = max(outside, found)
        if not outside and not container.endswith(_HELD) and (
                tag == "article" or tag == "main" or role in ("main", "article")):
            container = "article" if tag == "article" or role == "article" or container == "article" else "main"
        self.open.append((tag, silent, outside, container))
        if tag in _OUTSIDE and not silent:
            self.unended[len(self.open) - 1] = self.n_outside
            self.n_outside += 1

    def end_endless(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Ends the parts without end tag that cannot hold the element that starts."""
        text = tag in ("article", "main") or (dict(attrs).get("role") or "").lower() in ("article", "main")
        if not text and tag not in _ENDS_MENU:
            return
        for place, number in sorted(self.unended.items()):
            if place >= len(self.open):
                return
            if number in self.endless and (text or self.open[place][0] == "nav"):
                self.cut(place)
                return

    def cut(self, place: int) -> None:
        """Closes the open elements from ``place`` on."""
        del self.open[place:]
        if self.unended:
            self.unended = {p: n for p, n in self.unended.items() if p < place}

    def close_paragraph(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                self.cut(i)
                return
            if self.open[i][0] in _BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush("")
        if tag in ("body", "html"):
            self.ended = self.ended or set(self.unended.values())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.cut(i)
                return
            if tag not in _BLOCK and self.open[i][0] in _BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.close_head("")
        silent, outside, _container = self.state()
        if not silent and not outside:
            self.parts.append(data)


def _parsed(html: str, endless: frozenset[int]) -> _Page:
    page = _Page(endless)
    page.feed(html)
    page.close()
    page.flush("")
    return page


def page_blocks(html: str | None) -> list[tuple[str, int, str]]:
    """Text, zone and tag of the blocks in page order, without those that markup rules out.

    Only the article is left if there is one, with the titles before it in main, else main if there is one, else all of
    the body.
    """
    page = _parsed(html or "", frozenset())
    endless = page.ended | set(page.unended.values())
    if endless:
        page = _parsed(html or "", frozenset(endless))
    containers = {c for _text, c, _tag in page.blocks}
    wanted = {"article"} if "article" in containers else {"main", f"main{_HELD}"} if "main" in containers else containers
    zone = CONTENT if containers & {"article", "main"} else OPEN
    first = next((i for i, b in enumerate(page.blocks) if b[1] in wanted), 0)
    return [(text, zone, tag) for i, (text, c, tag) in enumerate(page.blocks)
            if c in wanted or (i < first and c == "main" and tag == "h1")]


def shared_prefixes(tokens: np.ndarray, page: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For every suffix of the stream: on how many pages its first ``depth`` tokens occur.

    Prefix doubling sorts the suffixes by 1, 2, 4, ... tokens; suffixes with equal ranks share that many. A suffix that
    leaves its page before has no such prefix and gets 0.
    """
    n = len(tokens)
    _values, rank = np.unique(tokens, return_inverse=True)
    step = 1
    while step < depth:
        after = np.full(n, -1, np.int64)
        after[: n - step] = np.where(page[: n - step] == page[step:], rank[step:], -1)
        order = np.lexsort((after, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
    whole = np.zeros(n, bool)
    whole[: n - depth + 1] = page[: n - depth + 1] == page[depth - 1 :]
    n_pages = int(page.max(initial=-1)) + 1
    pairs = np.unique(rank[whole] * n_pages + page[whole])
    counts = np.bincount(pairs // max(n_pages, 1), minlength=n + 1)
    return np.where(whole, counts[rank], 0)


def _stream(blocks: list[tuple[str, int, str]]) -> str:
    """The blocks of a page as one text: the tag that starts a block, its words, and a mark that no text holds."""
    return _MARK.join(f"<{tag}> {text}" for text, _zone, tag in blocks)


def _text(stream: str, kept: np.ndarray | None = None) -> str:
    found = [b.partition(" ")[2] for b in stream.split(_MARK)] if stream else []
    return "\n".join(found if kept is None else [t for t, k in zip(found, kept, strict=True) if k])


class _Streams:
    """The distinct token streams of some pages: one token for the tag that starts a block, then its words."""

    def __init__(self, pages: list[str]) -> None:
        numbers: dict[str, int] = {}
        self.of_page = [numbers.setdefault(p, len(numbers)) for p in pages]
        listed = [s.split(_MARK) if s else [] for s in numbers]
        self.n = len(listed)
        self.ends = np.cumsum([len(s) for s in listed], dtype=np.int64)
        self.tokens, self.page = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        if any(listed):
            (piece,) = A.pieces(pa.array([b for s in listed for b in s], pa.large_string()), 1 << 62)
            w = A.words(piece)
            self.tokens = A.span_hashes(piece.data, w.starts, w.ends)
            self.first = w.first
            self.page = np.repeat(np.arange(self.n), [len(s) for s in listed])[w.text_of]

    def runs(self, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``depth`` tokens that do not leave their page, and where they start."""
        n = max(0, len(self.tokens) - depth + 1)
        at = np.flatnonzero(self.page[:n] == self.page[len(self.page) - n :])
        return A.window_hashes(self.tokens, depth)[at].view(np.int64), at

    def on_pages(self, names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of the runs that start at ``at``, and on how many pages each occurs."""
        order = np.lexsort((self.page[at], names))
        names, page = names[order], self.page[at][order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (page[1:] != page[:-1])
        return np.unique(names[new], return_counts=True)

    def covered(self, hit: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Share of each block's tokens that lie in the runs of ``depth`` tokens that start at ``hit``."""
        cover = np.zeros(len(self.tokens) + depth, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + depth, -1)
        return A.per_text(np.cumsum(cover[: len(self.tokens)]) > 0, self.first) / np.diff(self.first)

    def touching(self, at: np.ndarray, flags: np.ndarray, depth: int) -> np.ndarray:
        """Which of the runs that start at ``at`` touch a block with a flag."""
        inside = np.repeat(flags, np.diff(self.first))
        sums = np.concatenate([[0], np.cumsum(inside)])
        return sums[at + depth] > sums[at]

    def per_page(self, flags: np.ndarray) -> list[np.ndarray]:
        """A value for every block, as one array for each of the pages."""
        cut = np.split(flags, self.ends[:-1]) if self.n else []
        return [cut[number] for number in self.of_page]


def _among(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``names`` that are ``wanted`` (ascending), and which one each is."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
    found = np.flatnonzero(wanted[place] == names)
    return found, place[found]


def _regions(crawl: _Streams, unique: np.ndarray) -> list[np.ndarray]:
    """For each page, which blocks lie between its first and its last unique one; all, if it has none."""
    kept = []
    for flags in crawl.per_page(unique):
        at = np.flatnonzero(flags)
        region = np.ones(len(flags), bool)
        if len(at):
            region[: at[0]] = region[at[-1] + 1 :] = False
        kept.append(region)
    return kept


def unique_region(pages: list[list[tuple[str, int, str]]], least: int, share: float, long_run: int) -> list[np.ndarray]:
    """For each page of a small crawl, which of its blocks lie between its first and its last unique run.

    A block is shared if substrings on so many pages cover 0.7 of it, unless half of it lies in runs of ``long_run``
    tokens on two pages or more: those are copies of articles, not menus or notices. A page without unique run is kept.
    """
    crawl = _Streams([_stream(p) for p in pages])
    if crawl.n < least or not len(crawl.tokens):
        return [np.ones(len(p), bool) for p in pages]
    often = np.flatnonzero(shared_prefixes(crawl.tokens, crawl.page) >= max(least, share * crawl.n))
    copied = np.flatnonzero(shared_prefixes(crawl.tokens, crawl.page, long_run) >= 2)
    return _regions(crawl, (crawl.covered(often) < 0.7) | (crawl.covered(copied, long_run) >= 0.5))


def host(url: Column) -> Column:
    """Host of a url in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _dealt(batches: Iterator[pa.RecordBatch], streams_of: Callable[[pa.RecordBatch], Iterator[tuple[str, int]]]
           ) -> Iterator[pa.RecordBatch]:
    """Rows with their stream, packed, and the number of their part: ``parts`` of them by the stream.

    Of the copies of a stream in a task the first is counted; the others go to parts of their own, below zero, by their
    row, so that many copies do not meet in one task.
    """
    seen: set[bytes] = set()
    codec = pa.Codec("zstd")
    for batch in batches:
        streams, zones, numbers, sizes = [], [], [], []
        scopes = zip(*(batch.column(c).to_pylist() for c in ("host", "bare", "parts", "copy")), strict=True)
        for (name, bare, parts, copy), (stream, zone) in zip(scopes, streams_of(batch), strict=True):
            data = stream.encode()
            digest = blake2b(data, digest_size=16).digest()
            key = blake2b(f"{name is None}{bare}{zone}{name}".encode() + digest, digest_size=16).digest()
            numbers.append(-1 - copy % parts if key in seen else int.from_bytes(digest[:6], "big") % parts)
            seen.add(key)
            streams.append(codec.compress(data, asbytes=True))
            sizes.append(len(data))
            zones.append(zone)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "url", "host", "bare")), pa.array(numbers, pa.int64()),
             pa.array(zones, pa.int32()), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())],
            ["page_id", "url", "host", "bare", "part", "zone", "size", "stream"],
        )


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def streams(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        for html in batch.column("html"):
            found = page_blocks(html.as_py())
            yield _stream(found), found[0][1] if found else CONTENT

    return _dealt(batches, streams)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _dealt(batches, lambda batch: ((s, OPEN) for s in batch.column("stream").to_pylist()))


def _pack(group: pa.Table) -> pa.Table:
    """One row for a part: its number of distinct streams, how many pages are open, and its pages in one value."""
    codec = pa.Codec("zstd")
    sizes, zones = group.column("size").to_pylist(), group.column("zone")
    streams = [codec.decompress(s.as_py(), n, asbytes=True).decode() if n else ""
               for s, n in zip(group.column("stream"), sizes, strict=True)]
    part = group.column("part")[0]
    pages = pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "zone": zones,
                      "stream": pa.array(streams, pa.large_string())}).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pages.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pages)
    return pa.table({
        **{c: group.column(c).slice(0, 1) for c in ("host", "bare", "part")},
        "n": pa.array([len(set(streams)) if part.as_py() >= 0 else 0], pa.int64()),
        "n_open": pa.array([zones.to_pylist().count(OPEN)], pa.int64()),
        "pages": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    })


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table]]:
    """The rows of packed parts, each with its pages."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield row, pa.ipc.open_stream(row["pages"].as_buffer()).read_all()


def _counted(row: dict, names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    host_, bare = (pa.array([row[c].as_py()] * len(names), t) for c, t in (("host", pa.string()), ("bare", pa.bool_())))
    return pa.RecordBatch.from_arrays(
        [host_, bare, pa.array(names, pa.int64()), pa.array(n, pa.int64())], ["host", "bare", "gram", "n"])


def _named_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings on at least ``own`` pages of their part, with the number of pages above ``own`` - 1."""
    for row, pages in _parts(batches):
        streams, own = _Streams(pages.column("stream").to_pylist()), row["own"].as_py()
        runs, at = streams.runs()
        often = shared_prefixes(streams.tokens, streams.page)[at] >= own
        names, n = streams.on_pages(runs[often], at[often])
        yield _counted(row, names, n - (own - 1))


def _counted_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages of their part the ``grams`` of the host occur."""
    for row, pages in _parts(batches):
        streams, wanted = _Streams(pages.column("stream").to_pylist()), np.sort(row["grams"].values.to_numpy())
        runs, at = streams.runs()
        found, which = _among(runs, wanted)
        yield _counted(row, *streams.on_pages(wanted[which], at[found]))


_COUNTED = "host string, bare boolean, gram bigint, n bigint"
_SCOPE = ["host", "bare"]


def _frequent(packed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Host, bare and ``grams``: all substrings on at least ``limit`` pages of a scope, each with its pages ``n``.

    ``scopes`` has the pages, the parts and the limit of a scope. A part names what occurs on at least ``own`` of its
    pages: half the share of the limit, or the limit where the scope is one part. What a part does not name it holds on
    at most ``own`` - 1 pages, so the pages of a substring are at most those named and the sum of these. What can reach
    the limit, at most two times the tokens of a mean page divided by the limit's share, is counted in all parts.
    """
    own = F.when(F.col("n_parts") == 1, F.col("limit")).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("limit") * F.col("n") / F.col("n_pages") / 2)))
    counted = null_safe_join(
        packed.where("part >= 0"), scopes.where("limit <= n_pages"), _SCOPE).withColumn("own", own)
    unnamed = counted.groupBy(*_SCOPE, "limit", "n_parts").agg(F.sum(F.col("own") - 1).alias("unnamed"))
    named = counted.mapInArrow(_named_in_part, _COUNTED).groupBy(*_SCOPE, "gram").agg(F.sum("n").alias("n"))
    possible = materialize(
        null_safe_join(named, unnamed, _SCOPE).withColumn("n", F.col("n") + F.col("unnamed")).where("n >= limit")
        .select(*_SCOPE, "gram", "n", "limit", "n_parts"), "possible",
    )
    lists = possible.where("n_parts > 1").groupBy(*_SCOPE, "limit").agg(F.collect_list("gram").alias("grams"))
    whole = null_safe_join(packed.where("part >= 0"), lists, _SCOPE)
    limits = lists.select(*_SCOPE, "limit")
    sums = whole.drop("limit").mapInArrow(_counted_in_part, _COUNTED).groupBy(*_SCOPE, "gram").agg(F.sum("n").alias("n"))
    exact = null_safe_join(sums, limits, _SCOPE).where("n >= limit")
    found = possible.where("n_parts = 1").select(*_SCOPE, "gram", "n").unionByName(exact.select(*_SCOPE, "gram", "n"))
    return materialize(found.groupBy(*_SCOPE).agg(F.collect_list(F.struct("gram", "n")).alias("grams")), "frequent")


def _grams(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Frequent substrings of the row's scope in ascending order, and on how many pages each occurs."""
    listed = row["grams"].values if row["grams"].is_valid else pa.array([], pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
    names, n = (listed.field(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(names)
    return names[order], n[order]


def _occurrences(streams: _Streams, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where frequent substrings start, and on how many pages of the scope each occurs."""
    names, n = _grams(row)
    if not len(names):
        return np.zeros(0, np.int64), n
    runs, at = streams.runs()
    found, which = _among(runs, names)
    return at[found], n[which]


def extract(pages: DataFrame, least: int = 3, share: float = 0.1, most: float = 0.8, many: int = 20,
            block_pages: int = 256, crawl_pages: int = 1024, crawl_share: float = 0.005,
            long_run: int = 64, block_bytes: int = 1 << 24) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(
        "page_id", "url", "html", host(F.col("url")).alias("host"),
        (~F.coalesce(F.col("html").rlike(_ARTICLE_TAG), F.lit(False))).alias("bare"),
        F.xxhash64("page_id", "url").alias("copy"),
    )
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    hosts = materialize(
        rows.select(*_SCOPE, size.alias("size")).groupBy(*_SCOPE).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")),
        "hosts",
    )

    def parts_of(n: Column, n_bytes: Column, n_pages: int) -> Column:
        return F.greatest(F.ceil(n / n_pages), F.ceil(n_bytes / block_bytes), F.lit(1))

    large = hosts.select(*_SCOPE, parts_of(F.col("n"), F.col("bytes"), block_pages).alias("parts")).where("parts > 1")
    n_bare, crawl_parts = hosts.where("bare").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).select("n", parts_of(F.col("n"), F.col("bytes"), crawl_pages)).first()
    key = rows.schema["page_id"].dataType.simpleString()
    result = f"page_id {key}, url string, text string, n_chars bigint"
    in_parts = (f"page_id {key}, url string, host string, bare boolean, part bigint, zone int, size bigint, stream binary")

    def packed(dealt: DataFrame) -> DataFrame:
        return materialize(
            dealt.groupBy(*_SCOPE, "part").applyInArrow(
                _pack, "host string, bare boolean, part bigint, n bigint, n_open bigint, pages binary"), "packed")

    def scopes(parts: DataFrame, content: Column, open_: Column) -> DataFrame:
        return parts.groupBy(*_SCOPE).agg(
            F.sum("n").alias("n_pages"), F.sum("n_open").alias("n_open"), F.count_if(F.col("part") >= 0).alias("n_parts"),
        ).select(
            *_SCOPE, "n_pages", "n_parts", content.alias("in_content"), open_.alias("in_open"),
            F.ceil(F.when(F.col("n_open") > 0, F.least(content, open_)).otherwise(content)).alias("limit"),
        )

    def known(parts: DataFrame, limits: DataFrame) -> DataFrame:
        """The parts with the limits and the frequent substrings of their scope."""
        found = _frequent(parts, limits)
        return null_safe_join(
            null_safe_join(parts, limits.select(*_SCOPE, "in_content", "in_open"), _SCOPE), found, _SCOPE, "left")

    def host_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[str], list | None]]:
        for row, listed in _parts(batches):
            pages_ = listed.column("stream").to_pylist()
            if not row["grams"].is_valid:
                yield listed, pages_, None
                continue
            streams = _Streams(pages_)
            at, n = _occurrences(streams, row)
            covered = {zone: streams.per_page(streams.covered(at[n >= row[limit].as_py()]) < 0.8)
                       for zone, limit in ((CONTENT, "in_content"), (OPEN, "in_open"))}
            yield listed, pages_, [covered[zone][i] for i, zone in enumerate(listed.column("zone").to_pylist())]

    def batch_of(listed: pa.Table, **columns: pa.Array) -> pa.RecordBatch:
        ids = listed.select(["page_id", "url"]).combine_chunks()
        (batch,) = pa.table({"page_id": ids.column("page_id"), "url": ids.column("url"), **columns}).combine_chunks().to_batches()
        return batch

    def texts(listed: pa.Table, pages_: list[str], kept: list | None) -> pa.RecordBatch:
        out = [_text(p) for p in pages_] if kept is None else [_text(p, k) for p, k in zip(pages_, kept, strict=True)]
        return batch_of(listed, text=pa.array(out, pa.string()), n_chars=pa.array([len(t) for t in out], pa.int64()))

    def host_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in host_streams(batches):
            yield texts(*found)

    def kept_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed, pages_, kept in host_streams(batches):
            if kept is not None:
                pages_ = [_MARK.join(b for b, k in zip(p.split(_MARK) if p else [], f, strict=True) if k)
                          for p, f in zip(pages_, kept, strict=True)]
            yield batch_of(listed, stream=pa.array(pages_, pa.string()))

    def long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ``long_run`` tokens: on how many pages of the part, and whether they touch a shared block."""
        for row, listed in _parts(batches):
            streams = _Streams(listed.column("stream").to_pylist())
            at, _n = _occurrences(streams, row)
            runs, starts = streams.runs(long_run)
            names, n = streams.on_pages(runs, starts)
            touching = streams.touching(starts, streams.covered(at) >= 0.7, long_run)
            part = row["part"].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(n if part >= 0 else np.zeros(len(n), np.int64), pa.int64()),
                 pa.array([part] * len(names), pa.int64(), mask=~np.isin(names, runs[touching]))],
                ["run", "n", "part"])

    def crawl_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, listed in _parts(batches):
            pages_ = listed.column("stream").to_pylist()
            streams = _Streams(pages_)
            at, _n = _occurrences(streams, row)
            copied = np.zeros(0, np.int64)
            if row["runs"].is_valid:
                runs, starts = streams.runs(long_run)
                copied = starts[np.isin(runs, row["runs"].values.to_numpy())]
            unique = (streams.covered(at) < 0.7) | (streams.covered(copied, long_run) >= 0.5)
            yield texts(listed, pages_, _regions(streams, unique))

    dealt = null_safe_join(rows, large, _SCOPE, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = packed(dealt.mapInArrow(_parsed_rows, in_parts))
    n_pages = F.col("n_pages")
    known_parts = known(parts, scopes(parts, F.greatest(F.lit(float(many)), F.lit(most) * n_pages),
                                      F.greatest(F.lit(float(least)), F.lit(share) * n_pages)))
    marked = known_parts.where("not bare").mapInArrow(host_texts, result)
    if not n_bare:
        return marked
    left = known_parts.where("bare").mapInArrow(kept_streams, f"page_id {key}, url string, stream string").select(
        "*", F.lit(None).cast("string").alias("host"), F.lit(True).alias("bare"), F.lit(crawl_parts).alias("parts"),
        F.xxhash64("page_id", "url").alias("copy"),
    )
    crawl = packed(left.mapInArrow(_kept_rows, in_parts))
    in_crawl = F.greatest(F.lit(float(least)), F.lit(crawl_share) * n_pages)
    known_crawl = known(crawl, scopes(crawl, in_crawl, in_crawl))
    copied_runs = (
        known_crawl.where("grams is not null").mapInArrow(long_runs, "run bigint, n bigint, part bigint")
        .groupBy("run").agg(F.sum("n").alias("n"), F.collect_set("part").alias("parts")).where("n >= 2")
        .select(F.explode("parts").alias("part"), "run").groupBy("part").agg(F.collect_list("run").alias("runs"))
    )
    return marked.unionByName(known_crawl.join(copied_runs, "part", "left").mapInArrow(crawl_texts, result))
