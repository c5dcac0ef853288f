"""Words and shingles of texts as 64-bit hashes, inside tasks.

Words are split and told apart by Arrow, a slice of texts at a time; each
distinct word of a slice is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from sitelight.llm.common import list_values

#: Bytes of text that are worked on at a time; a longer text is a slice by itself.
TOGETHER = 4_000_000
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def slices(batches: Iterable[pa.RecordBatch], column: str, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``together`` bytes of text, never split texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy().astype(np.int64)
        part = (np.cumsum(size) - size) // together
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for at, end in zip(first, np.r_[first[1:], len(part)], strict=True):
            yield batch.slice(at, end - at)


def told_apart(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of the distinct string per string, offsets per text, distinct strings)."""
    offsets, flat = list_values(parts)
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), offsets.astype(np.int64), encoded.dictionary


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets per text). Words are the runs outside space
    and U+0009 to U+000D, with A-Z lower-cased."""
    number, offsets, distinct = told_apart(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    names = distinct.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    there = np.fromiter(map(bool, names), dtype=bool, count=len(names))
    if there.all():
        return hashes[number], offsets
    keep = there[number]
    return hashes[number[keep]], np.r_[0, np.cumsum(keep)][offsets]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[2]
    h = (h ^ (h >> np.uint64(29))) * ODD[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``width`` words;
    with fewer words the whole sequence is one; without words there are none."""
    words, offsets = word_hashes(texts)
    total = np.full(max(0, len(words) - width + 1), np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total = mixed(total * ODD[0] + words[i : i + len(total)])
    for at, end in zip(offsets[:-1], offsets[1:], strict=True):
        n = end - at
        if n >= width:
            yield np.unique(total[at : end - width + 1])
        else:
            value = np.full(min(n, 1), np.uint64(n), dtype=np.uint64)
            for i in range(n):
                value = mixed(value * ODD[0] + words[at + i])
            yield value
