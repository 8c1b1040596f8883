"""Main text of web pages by differencing each page with its nearest pages by URL path in its host.

A page becomes a list of blocks, each with the part of the page that it is in: the article (or main element), what the
markup names as something else (menu, advert, form, ...), or neither. Pages are ordered by host and path, so that the pages
before and after one share the longest beginnings of its path; the blocks of neighbours are aligned by a longest common
subsequence, and shared ones outside the article are deleted. What the markup names as something else goes even if
neighbours don't share it. Passages of an article that occur on other pages are kept: the article is wanted whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, partitions
from .urls import parts

#: Fixed values of the HTML standard: elements without content, with raw text, and that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one: an open p by a new block, the others by one of their own kind.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that aren't the article, and words of class, id or role that say the same of an element.
OTHER = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math nav aside footer form button select dialog menu search".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo sidebar aside complementary widget cookie cookies consent notice notices"
    " alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond discussion disqus form search pagination pager skip".split()
)
#: Class names that begin so describe a layout (`no-sidebar`), not the element.
WITHOUT = frozenset("no not has with without".split())
#: These aren't the article only outside it: an article's own header has its title.
OUTSIDE = frozenset({"header"})

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

PLAIN, ARTICLE, NAMED = 0, 1, 2


def _is_other(name: str, attributes: str, inside: bool) -> bool:
    if name in OTHER or (name in OUTSIDE and not inside):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for what, *values in _NAMED.findall(attributes):
        if what.lower() == "hidden":
            return True
        for group in "".join(values).lower().split():
            words = _WORDS.findall(group)
            if words and words[0] in WITHOUT:
                continue
            if not OTHER_WORDS.isdisjoint(words) or ("header" in words and not inside):
                return True
    return False


def page_blocks(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page in order, not empty ones, and of each PLAIN, ARTICLE or NAMED (something else than the article).

    Character references are decoded, white space is one space. Unclosed and misnested elements end with what encloses them,
    an unclosed tag or comment at the end of the page is dropped. A null page has no blocks.
    """
    page = page or ""
    found, kinds, chunks = [], [], []
    stack: list[tuple[str, int, int]] = []  # name, and the depths of named and article elements before it
    opened: dict[str, int] = {}
    named = article = 0

    def end_block() -> None:
        if chunks:
            text = " ".join("".join(chunks).split())
            chunks.clear()
            if text:
                found.append(text)
                kinds.append(NAMED if named else ARTICLE if article else PLAIN)

    def close(name: str) -> None:
        nonlocal named, article
        while True:
            top, named_before, article_before = stack.pop()
            opened[top] -= 1
            if top in BLOCKS or named != named_before:
                end_block()
            named, article = named_before, article_before
            if top == name:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            chunks.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            chunks.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                close(name)
            elif name in BLOCKS:
                end_block()
            continue
        if name in RAW:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else n
                closing = _TAG.match(page, at)
                at = closing.end() if closing else n
            continue
        if name in VOID:
            if name in BLOCKS:
                end_block()
            elif name == "br":
                chunks.append(" ")
            continue
        if name in BLOCKS:
            if opened.get("p"):
                for top, *_ in reversed(stack):  # a p is ended by a block, unless another block is open in it
                    if top in BLOCKS:
                        if top == "p":
                            close("p")
                        break
            for same in ENDED.get(name, ()):
                if opened.get(same):
                    for top, *_ in reversed(stack):
                        if top == same:
                            close(same)
                            break
                        if top in ("ul", "ol", "dl", "table", "select", "div", "section"):
                            break
            end_block()
        stack.append((name, named, article))
        opened[name] = opened.get(name, 0) + 1
        if _is_other(name, m[3], article > 0):
            end_block()
            named += 1
        elif name in ("article", "main"):
            article += 1
    end_block()
    return found, kinds


def _profile(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of b and each beginning of a, len(a) + 1 of them; one row of bits for each of b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places in a and in b of a longest common subsequence: b is halved, a cut where both halves together give the most."""
    here, there = set(b), set(a)
    pa_, pb_ = [i for i, x in enumerate(a) if x in here], [i for i, x in enumerate(b) if x in there]
    out: tuple[list[int], list[int]] = ([], [])
    todo = [(pa_, pb_)]
    while todo:
        i, j = todo.pop()
        if not i or not j:
            continue
        if len(j) == 1:
            hit = next((k for k in i if a[k] == b[j[0]]), None)
            if hit is not None:
                out[0].append(hit)
                out[1].append(j[0])
            continue
        half = len(j) // 2
        x = [a[k] for k in i]
        head = _profile(x, [b[k] for k in j[:half]])
        tail = _profile(x[::-1], [b[k] for k in j[half:]][::-1])[::-1]
        cut = int((head + tail).argmax())
        todo += [(i[cut:], j[half:]), (i[:cut], j[:half])]
    return out


def _packed(found: list[str], kinds: list[int]) -> bytes:
    return (bytes(kinds) + b"\n" + "\n".join(found).encode()) if found else b""


def _unpacked(data: bytes) -> tuple[list[str], bytes]:
    if not data:
        return [], b""
    lines = data.split(b"\n")
    return [x.decode() for x in lines[1:]], lines[0]


def _bounds(keys: DataFrame, n: int) -> list[tuple]:
    """Up to n - 1 keys that cut the pages into ranges of about equal size, from a sample of at most about 64 n of them.

    The sample only decides which task gets a page, not what comes out.
    """
    rows = keys.count()
    every = max(1, rows // (64 * n))
    sample = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("url", "page_id", "h"), F.lit(every)) == 0).collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def main_text(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_blocks) of each row of pages (page_id, url, html, ...).

    n_blocks counts a page's blocks, n_shared those deleted because a neighbour has them too. Pages of one host are ordered
    by path, then by the whole url, page_id and a hash of the html; a page with the same blocks as its neighbour isn't
    compared with it (copies tell nothing: a page whose both neighbours are its copies is left to its markup). A null url or one without `://` belongs to the host without a name, a null html
    gives an empty text, rows that repeat give repeated results. A page alone in its host is left to its markup.
    """
    spark = pages.sparkSession
    n = ranges or partitions(spark)
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("page_id"),
        F.xxhash64("html").alias("h"), F.col("page_id").isNull().alias("no_id"), F.col("url").isNull().alias("no_url"), F.col("html").cast("string").alias("html"),
    )
    names = ["host", "path", "url", "page_id", "h"]
    keys = rows.select(*names)
    cuts = _bounds(keys, n)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last key of each range, of a task's keys."""
        ends: dict[int, list[tuple]] = {}
        for b in batches:
            for key in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                at = bisect_right(cuts, key)
                own = ends.setdefault(at, [key, key])
                own[0], own[1] = min(own[0], key), max(own[1], key)
        out = [(at, *key) for at, own in ends.items() for key in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["range", *names])

    schema = "range int, host string, path string, url string, page_id long, h long"
    key = F.struct(*names)
    ends = sorted((r["range"], tuple(r.low), tuple(r.high)) for r in keys.mapInArrow(ranged, schema).groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())  # a row for each range
    ghosts: dict[tuple, list[int]] = {}  # key: the ranges that it is a neighbour of
    for (a, _, high), (b, low, _) in zip(ends, ends[1:], strict=False):
        if high[0] == low[0]:
            ghosts.setdefault(high, []).append(b)
            ghosts.setdefault(low, []).append(a)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in blocks(batches, text="html", most=BLOCK_BYTES // 2):
            key = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
            blob = [pack.compress(_packed(*page_blocks(x))) for x in b.column("html").to_pylist()]
            index, to, ghost = list(range(len(key))), [bisect_right(cuts, k) for k in key], [False] * len(key)
            for i, k in enumerate(key):
                for r in ghosts.get(k, ()):
                    index.append(i)
                    to.append(r)
                    ghost.append(True)
            took = b.drop_columns(["html"]).take(pa.array(index))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(to, pa.int32()), pa.array(ghost), pa.array([blob[i] for i in index], pa.binary())], [*took.schema.names, "range", "ghost", "blob"])

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of a range in order; two neighbours are held at a time."""
        unpack = zstandard.ZstdDecompressor()
        before: dict | None = None
        out: list[tuple] = []
        held = 0

        def done(x: dict) -> None:
            if not x["ghost"]:
                keep = [kind == ARTICLE or (kind == PLAIN and i not in x["shared"]) for i, kind in enumerate(x["kinds"])]
                text = "\n".join(t for t, k in zip(x["blocks"], keep, strict=True) if k)
                out.append((None if x["no_id"] else x["page_id"], None if x["no_url"] else x["url"], text, len(text), sum(x["kinds"][i] != ARTICLE for i in x["shared"]), len(keep)))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["page_id", "url", "text", "n_chars", "n_shared", "n_blocks"])
            out.clear()
            return made

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("host", "url", "page_id", "no_id", "no_url", "range", "ghost", "blob")}
                row["blocks"], row["kinds"] = _unpacked(unpack.decompress(row.pop("blob")))
                row["shared"] = set()
                if before is not None:
                    if before["host"] == row["host"] and before["range"] == row["range"] and before["blocks"] != row["blocks"]:
                        code: dict[str, int] = {}
                        x, y = common(*([code.setdefault(t, len(code)) for t in side] for side in (before["blocks"], row["blocks"])))
                        before["shared"].update(x)
                        row["shared"].update(y)
                    done(before)
                before = row
                held += sum(map(len, row["blocks"]))
                if len(out) >= 1000 or held > BLOCK_BYTES:
                    held = 0
                    yield batch()
        if before is not None:
            done(before)
        yield batch()

    dealt = rows.mapInArrow(parsed, "host string, path string, url string, page_id long, h long, no_id boolean, no_url boolean, range int, ghost boolean, blob binary")
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("range")).sortWithinPartitions("range", *names, "no_id", "no_url")
    return dealt.mapInArrow(differenced, "page_id long, url string, text string, n_chars long, n_shared long, n_blocks long")
