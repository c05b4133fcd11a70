"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one for each block of text. Pages with lines stand in the
order of host and URL path, where neighbours of one host with the same lines are one
run, however many they are. A run is held against the nearest of the runs around it (two
before, two after, of the same host, by the length of the common path of the pages that face each other) that has
other lines. The longest common subsequence of the two pages' lines is what
the site's template put there, and is deleted from all pages of the run. A neighbour is a near copy
if what it shares with the page beyond what the next
neighbour shares is most of what is left of the page.

Markup decides first where it speaks: what stands in navigation, footers, forms,
adverts, reader comments and the like goes in any case; on a page with articles
only these are main text, and text in their own blocks (paragraphs, headings,
items, cells) stays even if a neighbour repeats it, as reprints do.

Only hashes of lines are sorted, numbered through and held against each other,
in groups of a fixed number of runs that carry their neighbours' ends. So a
host of any size is spread over tasks, and the result does not depend on how
the pages are partitioned. The html itself is joined with the numbers of the
lines to delete, of pages that have any.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm import textops as X

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role|aria-hidden|style|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: elements that hold no main text wherever they stand
DROPPED = frozenset("head script style title textarea noscript template svg math canvas iframe object nav aside form footer button select option menu dialog label input audio video map search noembed noframes xmp".split())
#: a main text's own blocks
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: words in a class, id or role that mark what is not main text
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager comment comments commentlist disqus reply replies respond discussion related recommended recommendations trending share sharing social follow login signin signup search searchbox skip copyright complementary contentinfo toc tagcloud masthead".split())
#: marks that an article's own parts may bear
OUTER_MARKS = frozenset("header footer head foot top bottom topbar".split())
#: marks that drop one of an article's own blocks; any other mark may just say what the paragraph is about
OWN_MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices comment comments commentlist newsletter subscribe paywall hidden".split())
#: elements within which a paragraph, an item or a cell is not ended by the next one outside
HOLDERS = frozenset("article main div section ul ol table dl select body blockquote".split())
COPY_SHARE = 0.5
NEIGHBOURS = 2
GROUP = 512
#: bytes of the rows that a longest common subsequence may keep at once
ROWS_BYTES = 32 << 20


@dataclass(frozen=True)
class Line:
    text: str
    #: in an article or main element, and in one of its own blocks
    inside: bool
    own: bool
    #: markup says that this is no main text
    dropped: bool


def _marked(attributes: str, in_article: bool, own: bool) -> bool:
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            continue
        words = set(re.split(r"[\s_\-.:/]+", value))
        if words & (OWN_MARKS if in_article and own else MARKS) or not in_article and words & OUTER_MARKS:
            return True
    return False


def lines(html: str) -> list[Line]:
    """The page's blocks of text in order, with what markup says of each; every character outside tags is in one."""
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []  # element, drops its content
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each element stands
    holders: list[int] = []
    part: list[str] = []
    dropping = in_article = own = 0
    at, n = 0, len(html)

    def flush() -> None:
        if part:
            text = " ".join(unescape("".join(part)).split())
            part.clear()
            if text:
                out.append(Line(text, in_article > 0, own > 0, dropping > 0))

    def leave(k: int) -> None:
        nonlocal dropping, in_article, own
        while len(stack) > k:
            name, drops = stack.pop()
            places[name].pop()
            if name in HOLDERS:
                holders.pop()
            dropping -= drops
            in_article -= name in ("article", "main")
            own -= name in OWN

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            part.append(html[at:])
            break
        part.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):  # a tag that the page's end cuts off
                break
            part.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if name in BLOCKS:
            flush()
        if closing:
            if places[name]:
                leave(places[name][-1])
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = n if end is None else end.end()
            continue
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and attributes[-1:] != "/":
            # such an element ends where the next one of its kind begins in the same holder
            if places[name] and places[name][-1] > (holders[-1] if holders else -1):
                leave(places[name][-1])
        drops = name in DROPPED or name == "header" and not in_article or _marked(attributes, in_article > 0, name in OWN)
        places[name].append(len(stack))
        if name in HOLDERS:
            holders.append(len(stack))
        stack.append((name, drops))
        dropping += drops
        own += name in OWN
        in_article += name in ("article", "main")
    flush()
    return out


def common(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Rows of the length table are held as whole numbers, a bit for each line of
    b (Hyyrö's form). Where all rows would weigh too much, a is halved where
    the two halves' lengths add up best (Hirschberg).
    """
    out: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        at, x, y = todo.pop()
        low = 0
        while low < min(len(x), len(y)) and x[low] == y[low]:
            out.add(at + low)
            low += 1
        high = 0
        while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
            out.add(at + len(x) - 1 - high)
            high += 1
        there = set(y[low : len(y) - high])
        rows = [i for i in range(low, len(x) - high) if x[i] in there]
        part = [x[i] for i in rows]
        there = set(part)
        y = [v for v in y[low : len(y) - high] if v in there]
        if not part:
            continue
        if len(part) * len(y) <= 8 * ROWS_BYTES or len(part) == 1:
            out.update(at + rows[i] for i in _traced(part, y))
            continue
        half = len(part) // 2
        first = _lengths(_rows(part[:half], y)[-1], len(y))
        last = _lengths(_rows(part[half:][::-1], y[::-1])[-1], len(y))
        cut = int(np.argmax(first + last[::-1]))
        for lo, hi, other in ((0, half, y[:cut]), (half, len(part), y[cut:])):
            # rows of a half need not be neighbours in a: each keeps its own place
            sub = common(part[lo:hi], other)
            out.update(at + rows[lo + i] for i in sub)
    return out


def _rows(a: list, b: list, every: bool = False) -> list[int]:
    """For the last beginning of a (or every one), the places in b where the common length grows, as zero bits."""
    bits: dict = defaultdict(int)
    for j, v in enumerate(b):
        bits[v] |= 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & bits.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            out.append(v)
    return out if every else [v]


def _lengths(row: int, n: int) -> np.ndarray:
    """Common length with each beginning of b, from no line to all n."""
    raw = np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8)
    grows = 1 - np.unpackbits(raw, bitorder="little")[:n].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grows)])


def _traced(a: list, b: list) -> list[int]:
    rows = [(1 << len(b)) - 1, *_rows(a, b, True)]
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out


def fixed(x: Line, articles: bool) -> bool:
    """Whether markup alone decides on a line of a page with or without articles."""
    return x.dropped or articles and (not x.inside or x.own)


def has_articles(page: list[Line]) -> bool:
    return any(x.inside and not x.dropped for x in page)


def main_text(page: list[Line], shared: set[int]) -> str:
    """The page's text without the shared lines and without what its markup drops."""
    articles = has_articles(page)
    return " ".join(x.text for i, x in enumerate(page) if not x.dropped and (x.inside or not articles) and (fixed(x, articles) or i not in shared))


@dataclass(frozen=True)
class Page:
    """The page of a run."""

    host: str
    #: paths of the run's first and last page
    first: str
    last: str
    #: of the lines that markup does not drop: hash, number of characters, place, whether markup alone decides
    hashes: list[int]
    sizes: list[int]
    places: list[int]
    settled: list[bool]


def template(page: Page, before: list[Page], after: list[Page]) -> list[int]:
    """Places of the lines of a page that its nearest neighbour shares; the neighbours in page order, of any host."""
    if all(page.settled):
        return []
    near = [(-len(os.path.commonprefix([page.first, x.last])), x) for x in before] + [(-len(os.path.commonprefix([page.last, x.first])), x) for x in after]
    near = [(n, x) for n, x in near if x.hashes and x.host == page.host and x.hashes != page.hashes]
    near.sort(key=lambda x: x[0])  # stable: the earlier page first
    if not near:
        return []
    shared = common(page.hashes, near[0][1].hashes)
    for _, other in near[1:]:
        usual = common(page.hashes, other.hashes)
        rest = sum(n for i, n in enumerate(page.sizes) if i not in usual)
        if sum(page.sizes[i] for i in shared - usual) <= COPY_SHARE * rest:
            break
        shared = usual  # that neighbour was a copy
    return sorted(page.places[i] for i in shared if not page.settled[i])


_PRINT = "k1 long, k2 long, host string, path string, page_id string, hashes array<long>, sizes array<int>, places array<int>, settled array<boolean>"


def _printed(batches):
    for b in batches:
        cols = [[] for _ in range(4)]
        for page in b.column(5).to_pylist():
            got = lines(page or "")
            articles = has_articles(got)
            live = [(i, x) for i, x in enumerate(got) if not x.dropped]
            raw = [x.text.encode("utf-8", "surrogatepass") for _, x in live]
            off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            h = X.range_hash(X.prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), off[:-1], off[1:]).view(np.int64)
            for c, v in zip(cols, (h.tolist(), [len(x.text) for _, x in live], [i for i, _ in live], [fixed(x, articles) for _, x in live]), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True))], names=["k1", "k2", "host", "path", "page_id", "hashes", "sizes", "places", "settled"])


def _compared(table: pa.Table, group: int) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["run"])
    pages = [Page(r["host"], r["first"], r["last"], r["hashes"], r["sizes"], r["places"], r["settled"]) for r in rows]
    out = []
    for i, r in enumerate(rows):
        if r["grp"] == r["run"] // group:
            gone = template(pages[i], pages[max(0, i - NEIGHBOURS) : i], pages[i + 1 : i + 1 + NEIGHBOURS])
            if gone:
                out.append((r["run"], gone))
    cols = list(zip(*out, strict=True)) or [()] * 2
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32()))], names=["run", "gone"])


def _in_runs(batches):
    """Adds the number of the run in its partition: it grows where the signature changes."""
    run, last = -1, None
    for b in batches:
        signs = np.asarray(b.column(b.schema.get_field_index("sign")), np.int64)
        if not len(signs):
            continue
        new = np.ones(len(signs), bool)
        new[1:] = signs[1:] != signs[:-1]
        new[0] = last is None or signs[0] != last
        runs = run + np.cumsum(new)
        run, last = int(runs[-1]), signs[-1]
        yield b.append_column("inner", pa.array(runs, pa.int64()))


def template_lines(pages: DataFrame, scratch: X.Scratch, group: int = GROUP) -> DataFrame:
    """(k1, k2, gone): numbers of the lines that differencing deletes, for pages (k1, k2, host, path, page_id, html) that have any."""
    spark = pages.sparkSession
    prints = pages.select("k1", "k2", "host", "path", "page_id", "html").mapInArrow(X.lean(_printed), _PRINT).where("size(hashes) > 0")
    order = ["host", "path", "page_id", "k1", "k2"]
    ranged = prints.withColumn("sign", F.xxhash64("host", "hashes")).repartitionByRange(X.parallelism(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.mapInArrow(_in_runs, T.StructType([*ranged.schema.fields, T.StructField("inner", T.LongType())]))
    ranged = scratch.saved(ranged.withColumn("part", F.spark_partition_id()))
    # a row a partition reaches the driver: its number of runs, and its first and last signature
    ends = ranged.groupBy("part").agg(F.max("inner").alias("n"), F.max(F.when(F.col("inner") == 0, F.col("sign"))).alias("first"), F.max_by("sign", "inner").alias("last"))
    starts, total, last = [], 0, None
    for r in sorted(ends.collect()):
        start = total - (r["first"] == last)  # the run goes on over the bound
        starts.append((r["part"], start))
        total, last = start + r["n"] + 1, r["last"]
    starts = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    placed = ranged.join(starts, "part").withColumn("run", F.col("inner") + F.col("start"))
    own = F.struct("hashes", "sizes", "places", "settled")
    runs = placed.groupBy("run").agg(F.min("host").alias("host"), F.min("path").alias("first"), F.max("path").alias("last"), F.first(own).alias("own")).select("run", "host", "first", "last", "own.*")
    reach = [F.floor((F.col("run") + d) / group) for d in (-NEIGHBOURS, 0, NEIGHBOURS)]
    grouped = runs.withColumn("grp", F.explode(F.array_distinct(F.array(*reach))))
    found = scratch.saved(grouped.groupBy("grp").applyInArrow(lambda t: _compared(t, group), "run long, gone array<int>"))
    gone = placed.select("k1", "k2", "run").join(found, "run")
    return scratch.saved(gone.groupBy("k1", "k2").agg(F.min("gone").alias("gone")))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """One row per page row: page_id, url, text (empty if none), n_chars.

    Null and empty html gives the empty text. A null url is a host of its own;
    the path is compared without query and fragment. Repeated rows, and copies
    that stand beside each other, are extracted alike. Other columns are ignored; an empty table gives no
    rows.
    """
    spark = pages.sparkSession
    X.small_batches(spark)
    scratch = X.Scratch(spark)
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    # a row is known by two hashes of all it holds: equal rows are extracted alike
    keys = [F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64("html", "url", "page_id", F.lit(1)).alias("k2")]
    rows = pages.select("page_id", "url", "html", *keys, F.lower(F.substring_index(bare, "/", 1)).alias("host"), bare.alias("path"))
    # page_id as text, padded so that whole numbers sort by size
    gone = template_lines(rows.withColumn("page_id", F.lpad(F.col("page_id").cast("string"), 20, "0")), scratch, group)
    scratch.done(last=1)
    joined = rows.select("page_id", "url", "html", "k1", "k2").join(gone, ["k1", "k2"], "left").select("page_id", "url", "html", "gone")

    def task(batches):
        for b in batches:
            texts = [main_text(lines(page or ""), set(shared or ())) for page, shared in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(X.lean(task), f"page_id {kind}, url string, text string, n_chars long")
