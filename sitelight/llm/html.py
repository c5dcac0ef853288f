"""Main text of web pages by nearest-URL page differencing.

Pages are put in the order of host and path; a page's nearest is the one before
or after it, of the same host, that shares the longer beginning of the path.
Both pages' lines (texts of blocks) are aligned by their longest common
subsequence, and the lines a page shares with its nearest are deleted, unless
its own markup puts them into its article. Since a host may use several
templates, lines that markup declares to be menus, headers, footers, sidebars,
notices, adverts, forms or comments are deleted as well. Other lines outside the
article stay when the alignment does not find them on the nearest page.

A host's order is split over any number of tasks: neighbours across a border
come from a table of the tasks' first and last pages. Pages are read twice:
once for hashes of their lines, which decide what goes, and once to write the
text; html is dealt out once, to meet its deletions. Alignment needs memory in
proportion to the lines, not to their product.

Defined results: null html counts as empty and gives an empty text; a page
without host, or alone on its host, is judged by its markup; an element that is
never closed ends with the page, and a hidden one at the next article at the
latest; a cut-off tag at the end is dropped; repeated pages delete nothing from
their articles; pages keep their columns, ``text`` and ``n_chars`` are added or
replaced; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitelight.llm.common import Scratch
from sitelight.llm.urlfilter import host_of, path_of
from sitelight.llm.words import slices

ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|iframe|svg|xmp)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split()
)
APART = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
HIDDEN = frozenset("aside audio button canvas datalist dialog fieldset footer form head label menu nav object select video".split())
#: Words of class, id and role that say what an element is.
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)


def labelled(attributes: str) -> bool:
    """Class, id or role declare boilerplate."""
    if "=" not in attributes:
        return False
    for match in NAMED.finditer(attributes):
        words = re.split(r"[\s_\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", match[2] or match[3] or match[4] or "").lower())
        if not LABELS.isdisjoint(words):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, declared boilerplate) of every block in page order."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    content: list[str] = []
    hidden, depth = "", 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, bool(content), bool(hidden)))

    at = 0
    for token in TOKEN.finditer(html):
        if token.start() > at:
            parts.append(unescape(html[at : token.start()]))
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(token[2] or token[5]), token[4] or token[7] or ""
        if name in APART:
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if closing:
            if hidden and name == hidden:
                depth -= 1
                if not depth:
                    flush()
                    hidden = ""
            elif name in CONTENT and name in content and not hidden:
                flush()
                while content.pop() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        boilerplate = name in HIDDEN or name == "header" and not content or labelled(attributes) and name not in ("html", "body")
        if hidden:
            if name in CONTENT and not boilerplate and not content:
                flush()
                hidden, depth = "", 0
            else:
                depth += name == hidden
                continue
        if boilerplate:
            flush()
            hidden, depth = name, 1
        elif name in CONTENT:
            flush()
            content.append(name)
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    return out


# --- alignment --------------------------------------------------------------------
def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of ``a`` and every beginning of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def _common(a: np.ndarray, b: np.ndarray, start: int, out: list[int]) -> None:
    """Positions in ``a`` of a longest common subsequence, by halving ``a``."""
    keep = np.isin(a, b)
    places = np.flatnonzero(keep)
    a, b = a[keep], b[np.isin(b, a)]
    if not len(a):
        return
    if len(a) == 1:
        out.append(start + int(places[0]))
        return
    if len(a) == len(b) and (a == b).all():
        out.extend((start + places).tolist())
        return
    half = len(a) // 2
    ahead, behind = _last_row(a[:half], b), _last_row(a[half:][::-1], b[::-1])[::-1]
    cut = int((ahead + behind).argmax())
    first: list[int] = []
    _common(a[:half], b[:cut], 0, first)
    out.extend(start + int(places[i]) for i in first)
    second: list[int] = []
    _common(a[half:], b[cut:], 0, second)
    out.extend(start + int(places[half + i]) for i in second)


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the own lines the longest common subsequence holds."""
    out: list[int] = []
    _common(own, other, 0, out)
    flags = np.zeros(len(own), dtype=bool)
    flags[out] = True
    return flags


# --- the operator -------------------------------------------------------------------
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page the hash of every line, and whether it lies in an article."""
    for batch in slices(batches, "html"):
        pages = [lines_of(html) for html in batch.column(2).to_pylist()]
        lines = pa.array([[xxhash.xxh3_64_intdigest(line[0].encode()) - 2**63 for line in page] for page in pages], pa.list_(pa.int64()))
        inside = pa.array([[line[1] for line in page] for page in pages], pa.list_(pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, inside], names=["key", "url", "lines", "inside"])


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the lines that a page shares with its nearest, outside articles."""
    for batch in batches:
        key, lines, inside, other = (batch.column(batch.schema.names.index(c)) for c in ("key", "lines", "inside", "other"))
        gone = []
        for i in range(batch.num_rows):
            shared = shared_lines(lines[i].values.to_numpy(), other[i].values.to_numpy()) & ~np.array(inside[i].as_py(), dtype=bool)
            gone.append(np.flatnonzero(shared).astype(np.int32))
        yield pa.RecordBatch.from_arrays([key, pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """html compressed, to be dealt out."""
    pack = zstandard.ZstdCompressor()
    for batch in slices(batches, "html"):
        html = pa.array([pack.compress(x.encode()) for x in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), html, batch.column(2)], names=["page", "html", "key"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = []
            for packed, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, gone = lines_of(unpack.decompress(packed).decode()), set(gone or ())
                texts.append("\n\n".join(text for i, (text, _, declared) in enumerate(lines) if i not in gone and not declared))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page", "text"])


def nearest(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, nearest) of (key, host, path), for pages that have a neighbour on their host."""
    dealt = keys.where("host <> ''").repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    dealt = scratch.write(dealt.withColumn("part", F.spark_partition_id()), "pages-ordered")
    row = F.struct("host", "path", "key")
    borders = dealt.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    around = Window.orderBy("part")  # one row per task
    borders = borders.select("part", F.lag("last").over(around).alias("before_part"), F.lead("first").over(around).alias("after_part"))
    order = Window.partitionBy("part").orderBy("host", "path", "key")
    sides = dealt.withColumns({"before": F.lag(row).over(order), "after": F.lead(row).over(order)}).join(borders, "part")
    sides = sides.withColumns({"before": F.coalesce("before", "before_part"), "after": F.coalesce("after", "after_part")})

    def like(side: str):
        parts, other = F.split("path", ""), F.split(F.col(f"{side}.path"), "")
        same = F.transform(F.arrays_zip(parts.alias("x"), other.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
        first = F.array_position(same, False)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(first > 0, first).otherwise(F.size(same) + 1))

    scored = sides.select("key", like("before").alias("b"), like("after").alias("a"), F.col("before.key").alias("before"), F.col("after.key").alias("after"))
    pick = F.when(F.col("a").isNull() | (F.col("b") >= F.col("a")), F.when(F.col("b").isNotNull(), F.col("before"))).otherwise(F.col("after"))
    return scored.select("key", pick.alias("nearest")).where("nearest IS NOT NULL")


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The pages, without their html, with ``text`` and ``n_chars``."""
    scratch = Scratch(pages.sparkSession)
    own = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    url, html = F.col(url_column), F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    # equal pages have one key, and are one page to their neighbours
    key = F.struct(F.xxhash64(url, html).alias("a"), F.xxhash64(F.lit(1), html, url).alias("b"))
    read = pages.select(key.alias("key"), url.alias("url"), html.alias("html")).mapInArrow(_hashes, "key struct<a:long,b:long>, url string, lines array<long>, inside array<boolean>")
    lines = scratch.write(read.dropDuplicates(["key"]), "pages-lines")
    pairs = nearest(lines.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), scratch)
    others = pairs.join(lines.select(F.col("key").alias("nearest"), F.col("lines").alias("other")), "nearest").select("key", "other")
    gone = lines.join(others, "key").mapInArrow(_deleted, "key struct<a:long,b:long>, gone array<int>").where(F.size("gone") > 0)
    gone = scratch.write(gone, "pages-gone")
    whole = pages.select(F.struct(*own).alias("page"), html.alias("html"), key.alias("key"))
    layout = T.StructType([whole.schema["page"], T.StructField("html", T.BinaryType()), whole.schema["key"]])
    beside = whole.mapInArrow(_packed, layout).join(gone, "key", "left").select("page", "html", "gone")
    layout = T.StructType([whole.schema["page"], T.StructField("text", T.StringType())])
    return beside.mapInArrow(_extract, layout).select("page.*", "text").withColumn("n_chars", F.length("text").cast("long"))
