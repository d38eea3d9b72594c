"""Main text of web pages by differencing with the page of the nearest URL on the same host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, shuffle_cleanup

# Fixed values of HTML: elements that end a line of text, elements without content, elements whose
# content is raw text.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and words of class, id or role that say so of others.
APART = frozenset("nav footer aside form script style noscript template svg iframe object button select textarea head menu dialog canvas audio video title search".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these words, those that decide as a whole class or id; the others need a name made up of such
#: words and of neutral ones.
SURE_WORDS = frozenset("ad ads adv advert adverts advertisement breadcrumb breadcrumbs comments cookie cookies disqus footer menu nav navbar navigation newsletter pagination sidebar sponsored".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box btn button buttons container content footer group header icons inner item items left links list outer panel right row section slot top unit wrap wrapper".split())
#: Elements of running text, which a name that is not sure does not set apart.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dl dt dd table td th tr b i em strong span a".split())
MAIN_WORDS = frozenset(["main", "article", "articlebody"])
#: Of these words, those that say nothing inside of the main text.
ARTICLE_WORDS = frozenset(["alert", "byline"])

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*+))>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_WORD = re.compile(r"[a-z0-9]+")

#: Lines that stay, that are judged by differencing, and that go.
MAIN, OPEN = 2, 1


def _named(tag: str, names: list[str], inside: bool) -> tuple[bool, bool]:
    """Whether class, id or role set an element apart, and whether they leave it in doubt.

    A sure word decides by itself, and so does a name of nothing but such words on an element that
    is no running text.  Of other elements with such a word, those outside of the main text
    stand apart unless they are running text; the rest is left to differencing.
    """
    usual = APART_WORDS - ARTICLE_WORDS if inside else APART_WORDS
    doubt = False
    for name in names:
        tokens = name.lower().split()
        words = {x for t in tokens for x in _WORD.findall(t)}
        if not words & usual:
            continue
        doubt = True
        if SURE_WORDS & set(tokens) or tag not in TEXT and (not inside or all(x in usual or x in NEUTRAL_WORDS or x.isdigit() for x in words)):
            return True, False
    return False, doubt


def _flags(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element (inside of the main text or not) stands apart from it, whether it is the main
    text, and whether its name leaves that in doubt."""
    apart, main, doubt = tag in APART, tag in ("article", "main"), False
    if attributes.strip():
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        if tag not in ("html", "body", "main"):
            named, doubt = _named(tag, [at[x] for x in ("class", "id", "role") if x in at], inside)
            apart = apart or named or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        main = main or at.get("itemprop", "").lower() == "articlebody" or bool(set(at.get("role", "").lower().split()) & MAIN_WORDS)
    return apart, main, doubt


def page_lines(page: str) -> list[tuple[str, int]]:
    """Lines of text outside of parts that stand apart, in page order, as (text, MAIN or OPEN)."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements that matter: tag, apart, main, in doubt
    apart = main = doubt = 0
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((text, MAIN if main and not doubt else OPEN))

    def leave(depth: int) -> None:
        nonlocal apart, main, doubt
        for _, a, m, d in stack[depth:]:
            apart -= a
            main -= m
            doubt -= d
        del stack[depth:]

    while True:
        tag = _TAG.search(page, at)
        if not apart:
            held.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br" and not apart:
            held.append(" ")
        if tag[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
            continue
        if name in VOID:
            continue
        a, m, d = _flags(name, tag[3], main > 0)
        a = a or (name == "header" and not main)
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if not (a or apart):
                held.append(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
            continue
        if stack and stack[-1][0] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            leave(len(stack) - 1)  # the next one ends it
        elif stack and stack[-1][0] == "p" and name in BLOCKS:
            leave(len(stack) - 1)
        if tag[3].endswith("/") and name not in BLOCKS:
            continue
        if a or m or d or any(x[0] == name for x in stack) or name in ("div", "section", "header", "ul", "ol", "table", "article"):
            stack.append((name, a, m, d))
            apart += a
            main += m
            doubt += d
    flush()
    return lines


def _lcs_row(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and every prefix of b, by bit vectors."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions of a in one longest common subsequence with b, by halving a (Hirschberg)."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.append(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                out.append(i)
            continue
        h = (i + j) // 2
        total = _lcs_row(a[i:h], b[k:m]) + _lcs_row(a[h:j][::-1], b[k:m][::-1])[::-1]
        if total.max() > 0:
            c = k + int(np.argmax(total))
            todo += [(i, h, k, c), (h, j, c, m)]
    return sorted(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            lines = [page_lines(h) for h in part.column("html").to_pylist()]
            rows = [[{"text": t, "kind": k} for t, k in x] for x in lines]
            cols = [part.column(c) for c in part.schema.names if c != "html"]
            yield pa.record_batch([*cols, pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())])))], names=[*(c for c in part.schema.names if c != "html"), "lines"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, near = b.column("hashes").to_pylist(), b.column("near").to_pylist()
        yield pa.record_batch([b.column("page_id"), b.column("version"), pa.array([shared_lines(x, y) for x, y in zip(own, near)], pa.list_(pa.int32()))], names=["page_id", "version", "shared"])


def nearest_pairs(keys: DataFrame) -> DataFrame:
    """Each page with the lines of the page next to it by path on its host: the one before it or
    the one after it, whichever path begins alike for longer.

    The pages are range-partitioned by (host, path) and paired inside a partition, to which its
    neighbours' edge rows are added, so that a host of any size is spread over many tasks.
    """
    order = ["host", "path", "page_id", "version"]
    table = Table(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    rows = table.df.withColumn("extra", F.lit(False))
    edge = F.struct(*order, "hashes")
    ends = rows.groupBy("part").agg(F.min(edge).alias("head"), F.max(edge).alias("tail"))
    by = W.orderBy("part")  # one row a partition
    after = ends.select(F.lead("part").over(by).alias("part"), F.col("tail").alias("e"))
    before = ends.select(F.lag("part").over(by).alias("part"), F.col("head").alias("e"))
    extra = after.unionByName(before).where("part is not null").select("part", "e.*", F.lit(True).alias("extra"))
    w = W.partitionBy("part").orderBy(*order)
    both = rows.unionByName(extra).select("*", F.lag(F.struct("host", "path", "hashes")).over(w).alias("p"), F.lead(F.struct("host", "path", "hashes")).over(w).alias("n")).where("not extra")

    def common(x: str):
        """Characters with which both paths begin."""
        same = F.zip_with(F.split("path", ""), F.split(x, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
        first = F.array_position(same, F.lit(False))
        return F.when(first > 0, first - 1).otherwise(F.size(same))

    here = {x: F.coalesce(F.col(f"{x}.host") == F.col("host"), F.lit(False)) for x in "pn"}
    near = F.when(here["p"] & (~here["n"] | (common("p.path") >= common("n.path"))), F.col("p.hashes")).when(here["n"], F.col("n.hashes"))
    return both.select("page_id", "version", "hashes", near.alias("near")).where("near is not null")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars (code points of the text).

    pages: page_id long, url, html string (null: empty); other columns are ignored.  A page becomes
    lines, one for each block of text, without parts that stand apart by element, role or position, or
    by a class or id that says so as a whole (menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, comments).  Pages are
    paired by URL path within each host (`nearest_pairs`), the pair's lines aligned by longest
    common subsequence, and shared lines deleted.  Lines of an element marked as the article are
    not deleted, since an article may be a copy of its neighbour's, unless their class or id leaves
    them in doubt; these and all other lines of a page are judged alike.  A page all of whose lines are shared is a copy and keeps them.
    Lines are joined by two line ends.

    Null url or a URL without a host: the page is paired within the empty host.  Null page_id and
    repeated rows are pages like others; of equal paths those next in page_id are paired.  Long
    pages are read whole, and their lines aligned in memory that grows with their length.  An empty
    table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("version", F.xxhash64("url", "html"))
    line = "array<struct<text string, kind int>>"
    parsed = Table(pages.select("page_id", "url", "version", "html").mapInArrow(_parse, f"page_id long, url string, version long, lines {line}")).df
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    keys = parsed.select("page_id", "version", host.alias("host"), path.alias("path"), F.transform("lines", lambda x: F.xxhash64(x.text)).alias("hashes"))
    with shuffle_cleanup(pages.sparkSession):
        masks = Table(nearest_pairs(keys).mapInArrow(_shared, "page_id long, version long, shared array<int>").where("size(shared) > 0").dropDuplicates(["page_id", "version"]))
    same = (F.col("l.version") == F.col("r.version")) & F.col("l.page_id").eqNullSafe(F.col("r.page_id"))
    rows = parsed.alias("l").join(masks.df.alias("r"), same, "left").select("l.page_id", "l.url", "l.lines", "r.shared")
    kept = F.filter("lines", lambda x, i: (x.kind == MAIN) | ~F.array_contains(F.coalesce("shared", F.array().cast("array<int>")), i.cast("int")))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.col("lines"))
    text = F.array_join(F.transform(chosen, lambda x: x.text), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
