"""Main text of web pages by nearest-URL page differencing.

Pages of one host are ordered by URL path; each is paired with the nearest pages in that order whose lines differ from
its own.  All text lines of a pair, menus and footers among them, are aligned by longest common subsequence, and the shared
lines, which belong to the template, are deleted.

What differencing can't know is settled by structure.  A paragraph inside an explicit article (an article or main element,
or one that is named so) stays although a neighbour shares it, for articles do share passages.  A line that no neighbour shares goes
where its element says that it is navigation, an advert, a form, a comment and the like, for templates rotate adverts
and print dates; on a page with an explicit article what is outside of it goes as well.  Names that also fit articles ("search",
"notice", "related") count only where the element holds less text than the rest of the page.  A neighbour that shares most of a page
is a copy of it, not a sample of the template; then further ones are taken, SIDE on either side, and of nothing but such
neighbours the one that shares least.

Scale: pages of a host with equal lines are one entry in the order.  Entries carry hashes of their lines and are
range-sorted, so one host may span many tasks, each of which aligns its own entries; only entries at the edges of a
task are aligned again with those of the next.  Results travel to the rows by a hash of host and lines, and the
kept text of each row is shuffled once, compressed.

Edge cases: null or empty html and pages without text give empty text; null and relative urls share the empty
host; equal urls tie by the hash of their lines; rows that repeat a page_id, or have none, are extracted each; a
page alone on its host is only filtered by structure; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .workspace import Workspace, partitions

# Element names by their part in a page, and the words that name template parts in class, id and role.
RAW = frozenset("script style title textarea xmp noembed noframes".split())
#: Without text of the page, and template parts by their kind.
HIDDEN = frozenset("head select option iframe noscript svg canvas template object audio video datalist".split())
TEMPLATE = frozenset("nav aside form button dialog menu fieldset label footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
TEMPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts adsense sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments disqus pagination pager contentinfo".split()
)
#: Words that an article's own element may have in its name as well.
DOUBTFUL_WORDS = frozenset("promo promotion banner widget widgets related recommended recommendations share sharing social notice alert popup modal overlay reply replies toolbar skip copyright complementary search".split())
#: Class and id values of elements that hold an article where there is no article element.
CONTENT_NAMES = frozenset(
    "content main article post entry hentry story main-content maincontent page-content post-content entry-content article-content story-content "
    "article-body articlebody post-body entry-body story-body content-body article-text post-text".split()
)
#: Header parts are a page's own outside an article and the article's title inside.
HEADER_WORDS = frozenset(["header", "banner"])

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What an element says of itself.
NOTHING, DOUBTFUL, CERTAIN, UNSEEN = range(4)


def _says(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is a part of the template or isn't shown at all, by what it says it is."""
    if name in HIDDEN:
        return UNSEEN
    found = NOTHING
    if name in TEMPLATE or (name == "header" and not in_article):
        found = CERTAIN
    if not attributes or name in ("html", "body", "article", "main") and "comment" not in attributes:
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        if m[5]:
            return UNSEEN
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & HEADER_WORDS:
                if not in_article:
                    found = CERTAIN
            elif words & TEMPLATE_WORDS:
                found = CERTAIN
            elif words & DOUBTFUL_WORDS:
                found = max(found, DOUBTFUL)
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return UNSEEN
        elif key == "hidden":
            return UNSEEN
    return found


def _holds_content(name: str, attributes: str) -> bool:
    """Whether an element is an article's by its kind, class, id or property."""
    if name in ("article", "main"):
        return True
    if name not in ("div", "section", "td") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, values = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower().split()
        if key in ("class", "id") and not CONTENT_NAMES.isdisjoint(values) or key == "role" and "main" in values or key == "itemprop" and "articlebody" in values:
            return True
    return False


class Line:
    """A block's text, and whether structure calls it a part of the template, inside an article's element and inside a paragraph."""

    __slots__ = ("article", "doubt", "paragraph", "template", "text")

    def __init__(self, text: str, template: bool, doubt: int, article: bool, paragraph: bool) -> None:
        self.text, self.template, self.doubt, self.article, self.paragraph = text, template, doubt, article, paragraph


def lines_of(page: str | None) -> list[Line]:
    """All lines of a page in page order."""
    page = page or ""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # open elements, what they say, whether as a block, whether they hold an article
    hidden = template = main = article = paragraph = 0
    doubtful: list[int] = []  # open doubtful elements, by a number
    count, at_, end = 0, 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Line(text, template > 0, doubtful[0] if doubtful else 0, main > 0, paragraph > 0))

    def close(depth: int) -> None:
        nonlocal hidden, template, main, article, paragraph
        while len(stack) > depth:
            name, says, block, holds = stack.pop()
            if says == UNSEEN or says and not block:
                hidden -= 1
            elif says == CERTAIN:
                template -= 1
            elif says == DOUBTFUL:
                doubtful.pop()
            main -= holds
            article -= name in ("article", "main")
            paragraph -= name in PARAGRAPH

    for m in _TAG.finditer(page):
        if m.start() < at_:
            continue
        if m.start() > at_ and not hidden:
            parts.append(page[at_ : m.start()])
        at_ = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in BLOCK:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ("article", "main", "body", "table", "td") and name not in BLOCK:
                    break
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at_)
            at_ = stop.start() if stop else end
            shut = page.find(">", at_)
            at_ = end if shut < 0 or not stop else shut + 1
            continue
        if name == "br":
            if not hidden:
                parts.append(" ")
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK:  # an open paragraph or list item ends where the next block starts
            for depth in range(len(stack) - 1, -1, -1):
                other = stack[depth][0]
                if other == "p" or other == name == "li" or (other in ("dd", "dt") and name in ("dd", "dt")) or (other in ("td", "th") and name in ("td", "th", "tr")) or other == name == "option":
                    close(depth)
                    break
                if other in BLOCK:
                    break
        says, holds = _says(name, attributes, article > 0), _holds_content(name, attributes)
        block = name in BLOCK
        stack.append((name, says, block, holds))
        if says == UNSEEN or says and not block:  # a part of a line, or nothing
            hidden += 1
        elif says == CERTAIN:
            template += 1
        elif says == DOUBTFUL:
            count += 1
            doubtful.append(count)
        main += holds
        article += name in ("article", "main")
        paragraph += name in PARAGRAPH
    if not hidden and at_ < end:
        parts.append(page[at_:])
    flush()
    _settle_doubts(out)
    return out


def _settle_doubts(lines: list[Line]) -> None:
    """A doubtful element is the template's unless it holds more text than the rest of the page."""
    size: dict[int, int] = {}
    for x in lines:
        if not x.template:
            size[x.doubt] = size.get(x.doubt, 0) + len(x.text)
    total = sum(size.values())
    for x in lines:
        if x.doubt and 2 * size.get(x.doubt, 0) <= total:
            x.template = True


def kept_lines(lines: list[Line]) -> list[tuple[int, str, bool]]:
    """(index, text, protected) of the lines that structure has nothing against: of an article's element, if there is one with text."""
    own = [(i, x) for i, x in enumerate(lines) if not x.template]
    if any(x.article for _, x in own):
        return [(i, x.text, x.paragraph) for i, x in own if x.article]
    return [(i, x.text, False) for i, x in own]


def line_hashes(lines: list[str]) -> list[int]:
    return [int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in lines]


def shared_lines(mine: list[int], other: list[int]) -> set[int]:
    """Indices of my lines in a longest common subsequence (Hunt and Szymanski: matches in order, longest increasing run)."""
    places: dict[int, list[int]] = {}
    for j in range(len(other) - 1, -1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i, h in enumerate(mine):
        for j in places.get(h, ()):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    out, node = set(), nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


#: Pages on either side that a page may be compared with.
SIDE = 2
#: A neighbour that shares more of a page's characters than this is a copy of it; one that shares more than MOST tells nothing.
COPY_SHARE, MOST = 0.6, 0.9


def template_lines(hashes: list[int], sizes: list[int], neighbours: list[list[int]]) -> set[int]:
    """Indices of the lines that the nearest neighbour that isn't a copy shares (neighbours come nearest first)."""
    total, best = sum(sizes), (MOST, set())
    for other in neighbours:
        shared = shared_lines(hashes, other)
        share = sum(sizes[i] for i in shared) / max(total, 1)
        if share <= COPY_SHARE:
            return shared
        if share <= best[0]:
            best = (share, shared)
    return best[1]


def main_text(page: str | None, neighbours: list[list[int]]) -> str:
    """A page's text, given the line hashes of its neighbours."""
    lines = lines_of(page)
    gone = template_lines(line_hashes([x.text for x in lines]), [len(x.text) for x in lines], neighbours) if neighbours else ()
    return "\n".join(t for i, t, protected in kept_lines(lines) if protected or i not in gone)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased host without port (empty for relative and broken urls), and path with query."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "", parts.path + (f"?{parts.query}" if parts.query else ""))
    except ValueError:
        return "", url or ""


def _entry(host: str, hashes: list[int]) -> int:
    """A hash of a host and a page's lines: pages of a host with equal lines are one entry."""
    packed = np.array(hashes, np.uint64).tobytes()
    return int.from_bytes(blake2b(host.encode("utf-8", "surrogatepass") + b"\0" + packed, digest_size=8).digest(), "little", signed=True)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with text as (entry, host, path, line hashes, line sizes)."""
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            lines = [x.text for x in lines_of(page.as_py())]
            if lines:
                host, path = host_and_path(url.as_py())
                hashes = line_hashes(lines)
                rows.append((_entry(host, hashes), host, path, np.array(hashes, np.uint64).tobytes(), at.pack(np.array([len(t) for t in lines], np.uint64))))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["entry", "host", "path", "lines", "sizes"])


ENTRY = "entry long, host string, path string, lines binary, sizes binary"


def _nearest(keys: list[tuple[str, str]], i: int, start: int = 0) -> list[int]:
    """Positions of the pages around i on its host (keys are sorted host and path), nearest path first: most segments in common, then least distance."""
    host, own = keys[i][0], keys[i][1].split("/")
    found = []
    for j in range(max(start, i - SIDE), min(len(keys), i + SIDE + 1)):
        if j != i and keys[j][0] == host:
            alike = sum(x == y for x, y in zip(own, keys[j][1].split("/"), strict=False))
            found.append((-alike, abs(j - i), j))
    return [j for _, _, j in sorted(found)]


def _gone(hashes: bytes, sizes: bytes, others: list[bytes]) -> bytes | None:
    """The indices of a page's template lines, packed; None if there are none."""
    read = lambda x: np.frombuffer(x, np.uint64).tolist()
    found = template_lines(read(hashes), at.unpack(sizes).tolist(), [read(x) for x in others]) if others else ()
    return at.pack_sorted(np.array(sorted(found), np.uint64)) if found else None


#: Rows at either end of a task that leave it with their lines: an edge's neighbours are among them.
REACH = 2 * SIDE
DECIDED = f"part int, place int, left int, gone binary, {ENTRY}"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted task's entries with their template lines.

    Entries within SIDE of an end are undecided, and those within REACH come with their keys and lines.  Only the
    rows around the current one are held.
    """
    part, held, first, total = TaskContext.get().partitionId(), [], 0, 0
    names = [x.split()[0] for x in DECIDED.split(", ")]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def row(place: int, left: int) -> tuple:
        entry, host, path, lines, sizes = held[place - first]
        if place < SIDE or left < SIDE:
            return (part, place, left, None, entry, host, path, lines, sizes)
        keys = [(x[1], x[2]) for x in held[place - first - SIDE : place - first + SIDE + 1]]
        gone = _gone(lines, sizes, [held[place - first - SIDE + j][3] for j in _nearest(keys, SIDE)])
        if place < REACH or left < REACH:
            return (part, place, left, gone, entry, host, path, lines, sizes)
        return (part, place, left, gone, entry, None, None, None, None)

    ready, done = [], 0
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(values)
            total += 1
            if total - done > REACH:  # so many follow: whatever comes, this one isn't at the end
                ready.append(row(done, REACH))
                done += 1
                while first < done - SIDE:
                    held.pop(0)
                    first += 1
            if len(ready) >= 1000:
                yield out(ready)
                ready = []
    ready += [row(place, total - 1 - place) for place in range(done, total)]
    if ready:
        yield out(ready)


def decisions(ws: Workspace, entries: DataFrame) -> DataFrame:
    """(entry, gone) of the entries that have template lines.

    The order is (host, path, entry) over the whole table and doesn't depend on how rows are dealt.
    """
    spark = entries.sparkSession
    order = ["host", "path", "entry"]
    once = entries.groupBy("entry").agg(F.min(F.struct("host", "path", "lines", "sizes")).alias("m")).select("entry", "m.host", "m.path", "m.lines", "m.sizes")
    ordered = once.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    found = ws.save(ordered.mapInArrow(_decide, DECIDED), "order")
    near = found.where(f"place < {REACH} or left < {REACH}")
    ends = near.select(*order, "part", "place", "left").orderBy(*order).collect()  # 2 * REACH rows a task at most
    keys, again = [(r["host"], r["path"]) for r in ends], []
    for i, r in enumerate(ends):
        if r["place"] < SIDE or r["left"] < SIDE:
            again += [(r["entry"], n, ends[j]["entry"]) for n, j in enumerate(_nearest(keys, i))]
    pairs = spark.createDataFrame(again, "entry long, n int, other long")
    lines = near.select("entry", "lines", "sizes")
    others = pairs.join(lines.select(F.col("entry").alias("other"), F.col("lines").alias("o")), "other").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("n", "o"))).alias("others"))
    edge = lines.join(others, "entry").select("entry", "lines", "sizes", F.col("others.o").alias("others")).mapInArrow(_decide_edges, "entry long, gone binary")
    return found.where("gone is not null").select("entry", "gone").unionByName(edge.where("gone is not null"))


def _decide_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [_gone(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.binary())], names=["entry", "gone"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their entry and, compressed, the lines that structure has nothing against: indices, protection and texts."""
    for batch in batches:
        entries, blobs = [], []
        for url, page in zip(batch.column(1), batch.column(2), strict=True):
            lines = lines_of(page.as_py())
            kept = kept_lines(lines)
            entries.append(_entry(host_and_path(url.as_py())[0], line_hashes([x.text for x in lines])) if lines else None)
            index = at.pack_sorted(np.array([i for i, _, _ in kept], np.uint64))
            shield = np.array([p for _, _, p in kept], bool).tobytes()
            blobs.append(at.join_blobs([index, shield, zstandard.compress("\n".join(t for _, t, _ in kept).encode("utf-8", "surrogatepass"), 3)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64()), pa.array(blobs, pa.binary())], names=["page_id", "url", "entry", "kept"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blob, gone in zip(batch.column(2), batch.column(3), strict=True):
            index, shield, data = at.split_blobs(blob.as_py())
            text = zstandard.decompress(data).decode("utf-8", "surrogatepass") if data else ""
            if gone.is_valid:
                out, protected = np.isin(at.unpack_sorted(index), at.unpack_sorted(gone.as_py())), np.frombuffer(shield, bool)
                text = "\n".join(t for t, o, p in zip(text.split("\n"), out, protected, strict=True) if p or not o) if len(out) else ""
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page row."""
    ws = Workspace(pages.sparkSession, "html")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    decided = decisions(ws, rows.select("url", "html").mapInArrow(_entries, ENTRY))
    kept = rows.mapInArrow(_kept, f"page_id {kind}, url string, entry long, kept binary")
    return kept.join(decided, "entry", "left").select("page_id", "url", "kept", "gone").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
