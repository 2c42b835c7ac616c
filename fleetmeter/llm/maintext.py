"""Main text of web pages: markup says what it can, repeats on the host's other pages say the rest.

A page is read once into blocks. A block is *body* (inside an ``article`` element), *named* (inside an element whose tag, role
or class says what it is: navigation, footer, advert, form, comments ...), or *open*. Body stays, named goes.

Open blocks are judged by their host. The words outside the article of all pages of a host are streams, put together into
one text. Its suffixes, cut at RUN words, are sorted into a suffix array by doubling ranks; suffixes that share RUN words with a
neighbour from another page are repeated, and the words that they cover are boilerplate. What is left of an open block, its
unique runs, stays.

Suffix arrays are built over slices of pages, inside tasks. A run of a slice becomes one row with the least and the greatest page
that has it, and rows of equal runs are merged by a grouped sum, so a host with a third of all pages, or a line on all of them,
is no large group anywhere. Runs are compared as text. Only pages with open blocks are met with them again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, slices
from .urls import host_and_path

#: Words of a repeated run.
RUN = 6
BODY, NAMED, OPEN = 0, 1, 2
#: Between words of a run; no word has white space.
GAP = "\n"

# --- fixed values: elements of HTML, and common names of page parts -----------------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup html legend li main menu nav ol option optgroup p pre search section summary table tbody tfoot "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of the article.
PARTS = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noembed noframes noscript object "
    "script search select style svg template textarea title video xmp".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
)
#: Words of class names and ids.
NAMES = frozenset(
    "ad adbox ads adsbygoogle adslot adv advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu menubar menus modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promotion recommendations recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar tracking widget widgets".split()
)
#: First words of names that say what a page has or is about, not what an element is.
ABOUT = frozenset("category format has is no not status tag type with without".split())
#: In an article these are the article's own.
OWN = frozenset(["header", "banner", "masthead"])
#: Names whose articles are no articles of the page.
ASIDE = frozenset("comment comments disqus recommendations recommended related replies reply respond sidebar".split())
# -------------------------------------------------------------------------------------------------------------------------

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]{0,20000}\"|'[^']{0,20000}')*+>|[^>]*>?)|<[!?/][^>]*>?", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _named(tag: str, attributes: str, inside: bool) -> set[str]:
    """The names by which an element with attributes is a part of the page and not of its article."""
    found: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.add("hidden")
        elif name == "role":
            found |= ROLES & set(value.lower().split())
        elif name in ("class", "id") and tag not in ("html", "body", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
            for one in value.split():
                if tag == "article":  # its classes are full of topics
                    found |= NAMES & {one.lower().split("-")[0]} if one.count("-") < 2 else set()
                elif (words := [w.lower() for w in WORD.findall(one)]) and words[0] not in ABOUT:
                    hit = NAMES & {words[0], words[-1]}
                    # "sidebar-left" can be a layout, see push()
                    found |= {f"{n}-" if n == "sidebar" and len(words) > 1 else n for n in hit}
    return found - OWN if inside else found


class _Page:
    """Blocks of one page, in order."""

    def __init__(self, wanted: frozenset[int]):
        self.out: list[tuple[int, str]] = []
        #: Pieces of text between tags, with their character references: only wanted ones are decoded.
        self.wanted, self.parts, self.stash = wanted, [], None
        self.open: list[tuple[str, int, bool, set[str]]] = []  # tag, kind, inline, names
        self.named = self.body = 0
        self.read = False  # whether the page had a body block

    def flush(self) -> None:
        if self.parts:
            zone = NAMED if self.named else BODY if self.body else OPEN
            if zone in self.wanted and (text := " ".join("".join(map(unescape, self.parts)).split())):
                self.out.append((zone, text))
                self.read |= zone == BODY
            elif zone == BODY and not self.read:
                self.read = any(map(str.strip, self.parts))
            self.parts = []

    def pop(self) -> None:
        tag, kind, inline, _ = self.open.pop()
        if kind == NAMED:
            if self.named == 1:
                self.flush()
                if inline and self.stash is not None:
                    self.parts, self.stash = self.stash, None
            self.named -= 1
        elif kind == BODY:
            self.flush()
            self.body -= 1

    def push(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.open and self.open[-1][0] == "p" or tag in ("li", "tr", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
                self.pop()
        names = _named(tag, attributes, self.body > 0) if len(attributes) > 5 else set()
        if tag in PARTS or tag == "header" and not self.body:
            names = names | {tag}
        body = (tag == "article" or tag in BLOCKS and "articlebody" in attributes.lower()) and not names
        if body and self.named and not self.read and all(k != NAMED or not (n & (ASIDE | PARTS - {"form"})) for _, k, _, n in self.open):
            # the first article of a page, in something like "container sidebar-left" or a form around the page
            self.open = [(t, OPEN if k == NAMED else k, i, n) for t, k, i, n in self.open]
            self.named, self.stash = 0, None
        kind = NAMED if names else BODY if body else OPEN
        if kind == NAMED:
            if not self.named and not block:
                self.stash, self.parts = self.parts, []
            self.named += 1
        elif kind == BODY:
            self.flush()
            self.body += 1
        if block or kind != OPEN:
            self.open.append((tag, kind, not block, names))

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    self.pop()
                return

    def feed(self, html: str) -> list[tuple[int, str]]:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            end = m.start() if m else n
            if end > at:
                self.parts.append(html[at:end])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            elif tag == "br":
                self.parts.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
            elif tag in RAW:
                ends = ENDS[tag].search(html, at)
                at = ends.start() if ends else n
                at = n if not ends else (html.find(">", at) + 1 or n)
            else:
                if tag in ("td", "th"):
                    self.parts.append(" ")
                self.push(tag, m[3])
        while self.open:
            self.pop()
        self.flush()
        return self.out


def blocks(html: str | None, wanted: frozenset[int] = frozenset((BODY, NAMED, OPEN))) -> list[tuple[int, str]]:
    """Zone and text of each block of a page, in order; those of the wanted zones. Null has none."""
    return _Page(wanted).feed(html) if html else []


def repeated_runs(streams: list[list[str]], hosts: list[str], pages: list[int]) -> dict[tuple[str, str], tuple[int, int]]:
    """By host and run of RUN words, the least and the greatest page that has it: groups of neighbours in a suffix array."""
    sizes = np.array([len(s) for s in streams], np.int64)
    if not len(sizes) or sizes.max() < RUN:
        return {}
    flat = [w for s in streams for w in s]
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(streams)), sizes)
    width = 1
    while width < RUN:  # rank of the suffix's first words, twice as many each time
        step = min(width, RUN - width)
        both = rank[:-step] * (rank.max() + 1) + rank[step:]
        rank = np.unique(both, return_inverse=True)[1]
        width += step
    whole = np.flatnonzero(owner[: len(rank)] == owner[RUN - 1 :])  # suffixes that don't run into the next page
    host_number: dict[str, int] = {}
    host = np.fromiter((host_number.setdefault(h, len(host_number)) for h in hosts), np.int64, len(hosts))
    page = np.array(pages, np.int64)
    array = whole[np.lexsort((page[owner[whole]], rank[whole], host[owner[whole]]))]
    own_host, own_rank, own_page = host[owner[array]], rank[array], page[owner[array]]
    turns = np.flatnonzero((own_rank[1:] != own_rank[:-1]) | (own_host[1:] != own_host[:-1])) + 1
    starts = np.concatenate(([0], turns)) if len(array) else turns
    ends = np.concatenate((turns, [len(array)]))[: len(starts)]
    at = array[starts].tolist()
    return {
        (hosts[owner[a]], GAP.join(flat[a : a + RUN])): (lo, hi)
        for a, lo, hi in zip(at, own_page[starts].tolist(), own_page[ends - 1].tolist(), strict=True)
    }


def _outside(found: list[tuple[int, str]]) -> list[str]:
    """Words of the blocks that are no body."""
    return [w for zone, text in found if zone != BODY for w in text.split(" ")]


def unique_text(found: list[tuple[int, str]], repeated: set[str]) -> str:
    """The text of a page's blocks: body, and of open blocks the words that no repeated run covers."""
    stream = _outside(found)
    covered = np.zeros(len(stream) + 1, np.int64)
    for i in range(len(stream) - RUN + 1):
        if GAP.join(stream[i : i + RUN]) in repeated:
            covered[i] += 1
            covered[i + RUN if i + RUN < len(stream) else len(stream)] -= 1
    gone, at, out = np.cumsum(covered) > 0, 0, []
    for zone, text in found:
        if zone == BODY:
            out.append(text)
            continue
        words = text.split(" ")
        if zone == OPEN:
            out.append(" ".join(w for i, w in enumerate(words) if not gone[at + i]))
        at += len(words)
    return "\n\n".join(t for t in out if t)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: ``page_id``, ``url``, ``text`` (blocks in order, two newlines between them) and ``n_chars``.

    Null and empty pages have an empty text; pages without a host (null or odd URLs) are one host. Rows that are alike in all
    three columns are one page to the search for repeats, and each keeps its row.
    """
    host, _ = host_and_path(F.col(quoted(url)))
    named = pages.select(
        F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).alias("url"), F.col(quoted(html)).alias("html"), host.alias("host"),
    ).withColumn("page", F.xxhash64("page_id", "url", "html"))
    id_type = named.schema["page_id"].dataType.simpleString()
    kept = f"page_id {id_type}, url string, host string, page long, zones array<tinyint>, texts array<string>, settled boolean"

    def per_slice(df: DataFrame, columns: list[str], text: str, work, schema: str) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    out = work(part)
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in fields], schema=fields
                    )

        return df.select(*columns).mapInArrow(run, schema)

    def read(part: pa.RecordBatch) -> dict:
        found = []
        for page in part.column("html").to_pylist():
            some = blocks(page, frozenset((NAMED, OPEN)))
            found.append(blocks(page) if any(z == OPEN for z, _ in some) else some)
        return {c: part.column(c) for c in ("page_id", "url", "host", "page")} | {
            "zones": [[z for z, _ in f] for f in found], "texts": [[t for _, t in f] for f in found],
            "settled": [all(z != OPEN for z, _ in f) for f in found],
        }

    def settle(part: pa.RecordBatch) -> dict:
        found = [blocks(page, frozenset((BODY, OPEN))) for page in part.column("html").to_pylist()]
        which = [i for i, f in enumerate(found) if all(z == BODY for z, _ in f)]
        texts = ["\n\n".join(t for _, t in found[i]) for i in which]
        at = pa.array(which, pa.int64())
        return {"page_id": part.column("page_id").take(at), "url": part.column("url").take(at), "text": texts, "n_chars": [len(t) for t in texts]}

    pairs = lambda part: [list(zip(z, t, strict=True)) for z, t in zip(part["zones"].to_pylist(), part["texts"].to_pylist(), strict=True)]

    def arrays(part: pa.RecordBatch) -> dict:
        runs = repeated_runs([_outside(p) for p in pairs(part)], part["host"].to_pylist(), part["page"].to_pylist())
        return {"host": [h for h, _ in runs], "run": [r for _, r in runs], "lo": [x for x, _ in runs.values()], "hi": [x for _, x in runs.values()]}

    def runs_of(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"page": [], "host": [], "run": []}
        for page, host, found in zip(part["page"].to_pylist(), part["host"].to_pylist(), pairs(part), strict=True):
            stream = _outside(found)
            for run in {GAP.join(stream[i : i + RUN]) for i in range(len(stream) - RUN + 1)}:
                for name, value in (("page", page), ("host", host), ("run", run)):
                    out[name].append(value)
        return out

    def judge(part: pa.RecordBatch) -> dict:
        texts = [unique_text(f, set(r or ())) for f, r in zip(pairs(part), part["runs"].to_pylist(), strict=True)]
        return {"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    seen = checkpointed(per_slice(named, ["page_id", "url", "host", "page", "html"], "html", read, kept))
    groups = per_slice(seen, ["host", "page", "zones", "texts"], "texts", arrays, "host string, run string, lo long, hi long")
    repeated = groups.groupBy("host", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("host", "run")
    unsettled = seen.where("NOT settled")
    own = per_slice(unsettled, ["host", "page", "zones", "texts"], "texts", runs_of, "page long, host string, run string").distinct()
    met = own.join(repeated, ["host", "run"]).groupBy("page").agg(F.collect_set("run").alias("runs"))
    last = f"page_id {id_type}, url string, text string, n_chars long"
    judged = per_slice(unsettled.join(met, "page", "left"), ["page_id", "url", "zones", "texts", "runs"], "texts", judge, last)
    return per_slice(named, ["page_id", "url", "html"], "html", settle, last).union(judged)
