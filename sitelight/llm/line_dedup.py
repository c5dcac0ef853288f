"""Removal of repeated lines by content-defined line chunks.

A window of two line hashes rolls over the lines that show anything, and marks
the smaller one; so of any two neighbouring lines one is marked, and whether a
line is depends on its two neighbours alone (of equal lines in a row, which count
as one, on those around them). Marked lines are boundaries: chunks
run from a marked line up to the next one, and from after a marked line through
the next one, and a marked line is one by itself. A run of two or more lines that
texts share therefore holds a common chunk, whatever stands around it. Chunks of
several lines, and lines of ``least_words`` words or more, are counted by hash
over all texts, as are whole texts.

Every repetition of a chunk is compared, byte by byte, with the first occurrence
(by id, then row, then place). From there the match is extended line by line in
both directions over the up to ``REACH`` lines next to the first occurrence,
whose 128-bit digests travel with it. A match of two or more visible lines is
removed, and so is a line of ``long_words`` words or more. A text that equals an
earlier one is removed as a whole. Each removed line is held by an earlier text,
or earlier in the same one.

Only hashes are counted over all chunks. Bytes travel for chunks whose hash
repeats only, whole texts only for rows that lose something; the join with the
first occurrences may have hot keys, which adaptive execution splits.

Defined results: null texts stay null, empty ones empty; texts without any
visible character are left as they are; a chunk whose hash equals a first one's
but whose bytes differ stays; a text that loses everything becomes empty, and of
repeated rows all but the first are empty; rows with a null id come last. All
columns are kept, ``text`` is changed, ``n_removed`` (lines) added or replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight.llm.common import Scratch, may_hold, may_hold_all, member_bits
from sitelight.llm.words import slices

OCCURRENCE = "uid long, place int, hash long, size long"
#: Lines on either side of a first occurrence over which a match may be extended.
REACH = 4
#: Bytes of a line's digest.
DIGEST = 16
#: The place of a whole text among its chunks.
WHOLE = -1


def has_words(line: bytes, n: int) -> bool:
    return len(line) >= 2 * n - 1 and len(line.split(None, n)) >= n


def chunks_of(lines: list[bytes], least_words: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, in order."""
    starts, stops, h = [], [], []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if starts and line == lines[stops[-1] - 1]:  # equal neighbours count as one
            stops[-1] = i + 1
        else:
            starts.append(i)
            stops.append(i + 1)
            h.append(xxhash.xxh3_64_intdigest(line))
    if not h:
        return []
    last = len(h) - 1
    marked = [j for j, x in enumerate(h) if (j > 0 and x <= h[j - 1]) or (j < last and x <= h[j + 1]) or last == 0]
    out = {(starts[a], stops[b - 1]) for a, b in zip(marked, [*marked[1:], last + 1], strict=True)}
    out |= {(starts[a + 1], stops[b]) for a, b in zip([-1, *marked[:-1]], marked, strict=True)}
    out |= {(starts[j], stops[j]) for j in marked}
    return sorted((a, b) for a, b in out if b - a > 1 or has_words(lines[a], least_words))


def digests(lines: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh3_128_digest, lines))


def extended(lines: list[bytes], start: int, stop: int, before: bytes, after: bytes) -> tuple[int, int]:
    """The match, as far as the lines around it equal those around the first occurrence."""
    while start > 0 and before and xxhash.xxh3_128_digest(lines[start - 1]) == before[-DIGEST:]:
        start, before = start - 1, before[:-DIGEST]
    while stop < len(lines) and after and xxhash.xxh3_128_digest(lines[stop]) == after[:DIGEST]:
        stop, after = stop + 1, after[DIGEST:]
    return start, stop


def _key(text: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text), "little", signed=True)


def _spot(uid: int, place: int) -> int:
    """A key of an occurrence; the same bits as in _spot_column."""
    return uid ^ ((place + 1) << 40)


def _spot_column() -> Column:
    return F.expr("uid ^ shiftleft(cast(place + 1 as bigint), 40)")


def _occurrences(least_words: int, bits=None, first: bool = False):
    """Occurrences of chunks, whole texts with their size below zero. Through
    ``bits`` only those whose hash may be wanted, with their bytes; or, as first
    occurrences, those whose spot may be, with the digests around them too."""
    kinds = {"uid": pa.int64(), "place": pa.int32(), "hash": pa.int64(), "size": pa.int64()}
    kinds |= {} if bits is None else {"chunk": pa.binary()}
    kinds |= {"before": pa.binary(), "after": pa.binary()} if first else {}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text is None or not text.strip():
                    continue
                lines = text.split(b"\n")
                for place, (start, stop) in enumerate([(0, len(lines)), *chunks_of(lines, least_words)], start=WHOLE):
                    chunk = text if place == WHOLE else b"\n".join(lines[start:stop])
                    key = _key(chunk)
                    if bits is not None and not may_hold(bits.value, _spot(uid, place) if first else key):
                        continue
                    row = (uid, place, key, -len(chunk) if place == WHOLE else len(chunk))
                    around = (digests(lines[max(0, start - REACH) : start]), digests(lines[stop : stop + REACH])) if first else ()
                    held.append(row if bits is None else (*row, chunk, *around))
                    size += 100 if bits is None else 250 + len(chunk)
                if size > 2_000_000:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return run


def _rows_where(bits, held: bool):
    """The rows whose uid the filter holds, or those it does not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold_all(bits.value, batch.column(0).to_numpy()) == held))

    return run


def _without(least_words: int, long_words: int):
    def kept(text: bytes, gone: list[dict]) -> tuple[bytes, int]:
        lines = text.split(b"\n")
        if any(g["place"] == WHOLE for g in gone):
            return b"", len(lines)
        chunks, lost = chunks_of(lines, least_words), set()
        for g in gone:
            start, stop = chunks[g["place"]]
            long_line = stop - start == 1 and has_words(lines[start], long_words)
            start, stop = extended(lines, start, stop, g["before"], g["after"])
            if long_line or sum(bool(line.strip()) for line in lines[start:stop]) > 1:
                lost.update(range(start, stop))
        return b"\n".join(line for i, line in enumerate(lines) if i not in lost), len(lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pairs = [(text.as_py(), 0) if not gone.is_valid else kept(text.as_py(), gone.as_py()) for text, gone in zip(batch.column(1), batch.column(2), strict=True)]
            texts = pa.array([p[0] for p in pairs], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([p[1] for p in pairs], pa.int64())], names=["row", "text", "n_removed"])

    return run


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 8, long_words: int = 50) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = [c for c in docs.columns if c not in (text_column, "n_removed")]
    text = F.col(text_column).cast("string").cast("binary")
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*own).alias("row"), text.alias("text")), "lines-rows")
    texts = rows.select("uid", "text")

    # the first occurrence of every hash that repeats
    ids = rows.select("uid", F.col("row")[id_column].alias("id"))
    found = texts.mapInArrow(_occurrences(least_words), OCCURRENCE)
    seen = found.groupBy("hash", "size").agg(F.count("*").alias("n")).where("n > 1").select("hash", "size")
    repeated = scratch.write(seen, "lines-repeated")
    bits = spark.sparkContext.broadcast(member_bits(repeated, "hash", per_key=64))
    again = texts.mapInArrow(_occurrences(least_words, bits), f"{OCCURRENCE}, chunk binary")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "uid", "place")
    first = again.select("uid", "place", "hash", "size").join(ids.hint("merge"), "uid").groupBy("hash", "size").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("hash", "size", F.col("first.uid").alias("uid"), F.col("first.place").alias("place"))
    first = scratch.write(first, "lines-first")

    # its bytes, and the other occurrences beside them
    spots = spark.sparkContext.broadcast(member_bits(first.select(_spot_column().alias("spot")), "spot", per_key=64))
    held = texts.mapInArrow(_occurrences(least_words, spots, first=True), f"{OCCURRENCE}, chunk binary, before binary, after binary")
    # merge joins: these tables grow with the input, so the plan is the same at every size
    model = held.join(first.hint("merge"), ["hash", "size", "uid", "place"]).withColumnsRenamed({"uid": "first_uid", "place": "first_place", "chunk": "bytes"})
    model = scratch.write(model, "lines-models")
    same = again.join(model.hint("merge"), ["hash", "size"]).where("chunk = bytes AND NOT (uid = first_uid AND place = first_place)")
    gone = scratch.write(same.groupBy("uid").agg(F.collect_list(F.struct("place", "before", "after")).alias("gone")), "lines-gone")
    scratch.drop("lines-first", "lines-repeated", "lines-models")
    bits.unpersist()
    spots.unpersist()

    # only rows that lose something are dealt out to meet what they lose
    losers = spark.sparkContext.broadcast(member_bits(gone, "uid", per_key=64))
    layout = T.StructType([rows.schema["row"], *T.StructType().add("text", "string").add("n_removed", "long")])
    whole = rows.mapInArrow(_rows_where(losers, False), rows.schema).select("row", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_removed"))
    cut = rows.mapInArrow(_rows_where(losers, True), rows.schema).join(gone.hint("merge"), "uid", "left").select("row", "text", "gone")
    result = whole.unionByName(cut.mapInArrow(_without(least_words, long_words), layout))
    return result.select(*[F.col("text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns if c != "n_removed"], "n_removed")
