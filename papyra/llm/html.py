"""Main text of web pages: block zones by markup, and host suffix arrays for what markup leaves open.

Each page becomes a list of text blocks in the zones main (inside an article or main container), chrome (menus, headers, footers,
adverts, forms, comments ...) and open (everything else). The pages of a host that lie in one batch are a token stream with a suffix array, whose
common prefixes give every substring of LEAST_TOKENS tokens or more with the pages that hold it; the batches' counts are added up over the whole host. What is on
LEAST_PAGES pages or more is boilerplate. Every page keeps its main zone whole and the unique runs of its open blocks.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Tokens of the shortest repeat that counts, and the distinct pages of the host it must be on, whatever the host's size.
LEAST_TOKENS, LEAST_PAGES = 8, 3
#: Bits of the map that spares windows no open block holds the shuffle.
MAP_BITS = 1 << 24

_SKIP = frozenset("script style noscript template head title svg canvas iframe object math audio video".split())
_CHROME = frozenset("nav footer aside form button select option textarea dialog menu label fieldset input datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark chrome, and of roles.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies reply respond share sharing social related recommended recommendations widget pagination pager login search toolbar skip alert disclaimer copyright".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_CONTENT = frozenset("article articlebody main content post entry story".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tags that don't end an open head.
_IN_HEAD = frozenset("base link meta noscript script style template title head".split())
#: INNER: an article in a chrome container; NAMED: content by class or id only. blocks() settles both by page.
MAIN, OPEN, CHROME, INNER, NAMED = 0, 1, 2, 3, 4


class Blocks(HTMLParser):
    """The blocks (zone, text) of a page, in order; tags may be unclosed, crossed or cut off."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, zone, skipped
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.zone = OPEN

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.zone, text))
            self.parts = []

    def _at(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, False)

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        zone, skipped = self._at()
        if tag in _BLOCK:
            self.flush()
        if tag in _VOID:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
            zone, skipped = self._at()
        if tag in _SKIP:
            skipped = True
        elif tag in _CHROME:
            zone = CHROME
        elif tag not in ("html", "body"):
            names, role = (), ""
            for k, v in attrs:
                if k in ("class", "id", "itemprop"):
                    names = (*names, *re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", v or "").lower()))
                elif k == "role":
                    role = (v or "").lower()
                elif k == "hidden" or k == "aria-hidden" and v == "true":
                    skipped = True
            named = not _HINTS.isdisjoint(names)
            if tag == "main" or tag == "article" and role not in _ROLES or role in ("main", "article"):
                zone = INNER if zone in (CHROME, INNER) or named and tag != "main" else MAIN
            elif role in _ROLES or named and tag not in _HEADINGS:
                zone = CHROME
            elif tag == "header":
                zone = CHROME
            elif zone == CHROME and tag in _HEADINGS and any(s[0] == "header" for s in self.stack) and self._main_outside() is not None:
                zone = self._main_outside()
            elif zone == OPEN and not _CONTENT.isdisjoint(names):
                zone = NAMED
        self.stack.append((tag, zone, skipped))
        self.zone = zone

    def _main_outside(self) -> int | None:
        """The main, inner or named zone of which the innermost header, and nothing else, hides a heading."""
        at = max(i for i, s in enumerate(self.stack) if s[0] == "header")
        zone = self.stack[at - 1][1] if at > 0 else CHROME
        return zone if zone in (MAIN, INNER, NAMED) else None

    def _end_head(self, tag: str) -> None:
        """Ends an open head at body, or at a tag or text right in it that no head holds."""
        tags = [s[0] for s in self.stack]
        if "head" in tags and (tag == "body" or tags[-1] == "head" and tag not in _IN_HEAD):
            del self.stack[tags.index("head") :]
            self.zone = self._at()[0]

    def handle_startendtag(self, tag, attrs):
        self._end_head(tag)
        if tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        self.zone = self._at()[0]

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head("")
        if not self._at()[1]:
            self.parts.append(data)


def blocks(html: str) -> list[tuple[int, str]]:
    """(MAIN, OPEN or CHROME, text). An article inside chrome is main if the page has no other; content by class is main
    if there is no article and it holds the larger part of the text that is not chrome, and open otherwise.
    """
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    size = [0] * 5
    for zone, text in parser.blocks:
        size[zone] += len(text)
    inner = CHROME if size[MAIN] else MAIN
    named = MAIN if not size[MAIN] + size[INNER] and size[NAMED] > size[OPEN] else OPEN
    return [({INNER: inner, NAMED: named}.get(z, z), t) for z, t in parser.blocks]


def windows(tokens: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where substrings of LEAST_TOKENS tokens begin that don't run into the next page, and their hashes."""
    n = len(tokens) - LEAST_TOKENS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words, h = tokens.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(LEAST_TOKENS):
        h = C.mix(h * C._GOLD + words[k : k + n])
    at = np.flatnonzero(page[:n] == page[LEAST_TOKENS - 1 :])
    return at, h[at]


def covered_by(at: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in a window that begins at one of `at`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + LEAST_TOKENS, n), -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a token stream in the order of what begins there, and how many tokens each shares with the one before it (0 for the first).

    Ranks of 1, 2, 4 ... tokens are made from one another until all differ; common prefixes are read off the same ranks, longest first.
    """
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while n and levels[-1].max() < n - 1 and width < n:
        follow = np.zeros(n, np.int64)
        follow[:-width] = levels[-1][width:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + follow, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        # a rank of fewer tokens than its width ends at the stream's end and is equal to no other
        shared[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, shared


def repeated(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, group) of every place of the pages' streams where LEAST_TOKENS tokens begin; places of equal ones are of one group."""
    ends = np.cumsum([len(t) + 1 for t in streams])
    values, ids = np.unique(np.concatenate(streams), return_inverse=True) if len(streams) else (np.zeros(0), np.zeros(0, int))
    joined = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    page = np.repeat(np.arange(len(streams)), [len(t) + 1 for t in streams])
    last = np.zeros(len(joined), bool)
    last[ends - 1] = True
    joined[~last] = ids
    joined[last] = len(values) + np.arange(len(streams))  # an end of its own for each page: nothing runs on into the next
    order, shared = suffix_array(joined)
    group = np.cumsum(shared < LEAST_TOKENS)
    place = order - (ends - [len(t) + 1 for t in streams])[page[order]]
    whole = place + LEAST_TOKENS <= np.array([len(t) for t in streams])[page[order]]
    return page[order][whole], place[whole], group[whole]


def repeats(streams: list[np.ndarray]) -> list[np.ndarray]:
    """Which tokens of each page lie in a substring of LEAST_TOKENS or more that is on enough distinct ones of these pages."""
    page, place, group = repeated(streams)
    pages_of = np.bincount(np.unique(group * len(streams) + page) // max(len(streams), 1), minlength=int(group.max(initial=0)) + 1)
    often = pages_of[group] >= LEAST_PAGES
    return [covered_by(place[often & (page == k)], len(t)) for k, t in enumerate(streams)]


class Stream:
    """The tokens of a page's blocks in a row, and the hashes of their windows, which `host` sets apart from other hosts'."""

    def __init__(self, zones: list[int], texts: list[str], host: int):
        self.zones, self.words = zones, [t.split(" ") for t in texts]
        raw = " ".join(texts).encode()
        self.tokens = tokens = C.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        self.block = np.repeat(np.arange(len(zones)), [len(w) for w in self.words])
        self.at, h = windows(tokens, np.zeros(len(tokens), np.int8))
        self.hashes = C.mix(h ^ np.uint64(host & (1 << 64) - 1)).view(np.int64)
        is_open = np.concatenate(([0], np.cumsum(np.array(zones, int)[self.block] == OPEN)))
        self.open = is_open[self.at + LEAST_TOKENS] > is_open[self.at]  # windows with a token of an open block

    def text(self, often: np.ndarray) -> str:
        """Main blocks whole; of open blocks, what no window of the hashes `often` covers.

        A window over several blocks counts for those that windows cover whole. A page of nothing but repeats keeps them.
        """
        at = self.at[np.isin(self.hashes, often)]
        n = len(self.block)
        whole = covered_by(at, n)
        inside = covered_by(at[self.block[at] == self.block[at + LEAST_TOKENS - 1]], n)
        kept, candidates, first = [], [], 0
        for zone, words in zip(self.zones, self.words):
            last = first + len(words)
            if zone == MAIN:
                kept += words
            elif zone == OPEN:
                candidates += words
                if not whole[first:last].all():
                    kept += [w for w, gone in zip(words, inside[first:last].tolist()) if not gone]
            first = last
        return " ".join(kept or candidates)


def extracted(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page: page_id, url, text, n_chars. Null and empty html give an empty text; null urls are one host; repeated rows each come back, and
    count as pages of their own. Other columns are ignored. An empty table gives an empty result.

    Pages are parsed once into a stored table. Windows that touch an open block are counted over the whole host, with the pages on which other
    blocks hold them; pages without open blocks are not shuffled.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"), F.monotonically_increasing_id().alias("place"))

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                lists = [pa.array([[b[k] for b in f] for f in found], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), *lists], names=["page_id", "url", "host", "place", "zones", "texts"])

    parsed = C.stored(rows.mapInArrow(C.frugal(parse), "page_id long, url string, host long, place long, zones array<int>, texts array<string>"))
    is_open = F.array_contains("zones", OPEN)
    main = F.array_join(F.transform(F.filter(F.arrays_zip("zones", "texts"), lambda b: b["zones"] == MAIN), lambda b: b["texts"]), " ")
    done = lambda df, text: df.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    closed = done(parsed.where(~is_open), main)
    if not parsed.where(is_open).limit(1).count():
        return closed

    def held(which: str, bits=None):
        """(hash, places) of the substrings that a batch's pages of one host have in open blocks, or in other blocks if the map knows them."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for i in range(0, len(batch), 200):
                    hashes, places = [], []
                    by_host: dict[int, list] = {}
                    for place, host, zones, texts in zip(*(c.to_pylist() for c in batch.slice(i, 200).columns)):
                        by_host.setdefault(host, []).append((place, Stream(zones, texts, host)))
                    for pages_ in by_host.values():
                        streams = [p for _, p in pages_]
                        page, at, group = repeated([p.tokens for p in streams])
                        first = np.cumsum([0, *[len(p.hashes) for p in streams]])
                        window = first[page] + at  # one window a place, in order
                        is_open_ = np.concatenate([p.open for p in streams])[window]
                        hash_ = np.concatenate([p.hashes for p in streams])[window]
                        pairs, back = np.unique(group * len(streams) + page, return_index=True)
                        of_open = np.zeros(len(pairs), bool)
                        np.logical_or.at(of_open, np.searchsorted(pairs, group * len(streams) + page), is_open_)
                        keep = of_open
                        if which == "others":
                            slot = hash_[back] & (MAP_BITS - 1)
                            keep = ~of_open & (bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1)
                        own = np.array([p for p, _ in pages_])[(pairs % len(streams))[keep]]
                        starts = np.flatnonzero(np.diff(pairs[keep] // len(streams), prepend=-1))
                        hashes.append(hash_[back][keep][starts])
                        places += np.split(own, starts[1:]) if len(starts) else []
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])), pa.array(places, pa.list_(pa.int64()))], names=["hash", "places"])

        return run

    shape = parsed.select("place", "host", "zones", "texts")
    opens = C.stored(shape.where(is_open).mapInArrow(C.frugal(held("opens")), "hash long, places array<long>"))
    slots = opens.select(F.col("hash").bitwiseAND(MAP_BITS - 1).alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(slot & 7 as int)))").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS >> 3, np.uint8)
    bits[slots["byte"].to_numpy()] = slots["bits"].to_numpy()  # MAP_BITS / 8 rows at most
    others = shape.mapInArrow(C.frugal(held("others", pages.sparkSession.sparkContext.broadcast(bits))), "hash long, places array<long>")
    counted = opens.select("hash", F.size("places").alias("n"), F.lit(1).alias("open")).union(others.select("hash", F.size("places"), F.lit(0))).groupBy("hash").agg(F.sum("n").alias("n"), F.max("open").alias("open"))
    often = counted.where((F.col("n") >= LEAST_PAGES) & (F.col("open") == 1)).select("hash")
    by_page = opens.join(often, "hash").select("hash", F.explode("places").alias("place")).groupBy("place").agg(F.collect_list("hash").alias("often"))
    joined = parsed.where(is_open).join(by_page, "place", "left").select("page_id", "url", "host", "zones", "texts", "often")

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            found = [Stream(z, t, h).text(np.array(o or [], np.int64)) for h, z, t, o in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return closed.union(done(joined.mapInArrow(C.frugal(finish), "page_id long, url string, text string"), F.col("text")))
