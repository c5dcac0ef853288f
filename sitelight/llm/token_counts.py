"""Token counts of whole texts by a two-tier lookup on the map side.

A text is cut into pre-tokens at places that no piece of the vocabulary spans:
before a run of spaces and before a line break. The pieces of a text are then
those of its pre-tokens, so a count is a sum of pre-token lengths. First tier:
a compact open-addressing hash table of the lengths of frequent pre-tokens,
broadcast to the workers. Second tier: what the table lacks is encoded, and
remembered by the worker. No pre-token is shuffled; a task's texts never leave
it.

Which pre-tokens are frequent is found over all texts: every task keeps at most
``most`` counters (Misra and Gries), and the tasks' whole lists are merged as a
tree, ``fan`` at a time. Whatever the size of the input, the table has at most
``most`` entries of at most ``LONGEST`` bytes, and a list holds every pre-token
whose share is above 1 / ``most``. The table only spares work: counts are the
same with any table, or none.

Defined results: null and empty texts have no bytes and no tokens; null and
repeated ids keep their rows; a text of any length is counted whole; strings of
special tokens are ordinary text; an empty table gives an empty result. Other
columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight.llm.common import Scratch
from sitelight.llm.words import slices

#: Longer pre-tokens are neither in the table nor remembered.
LONGEST = 64
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 2**18
#: Missing pre-tokens that are encoded at a time.
AT_ONCE = 20_000
SPACE, BREAK = 0x20, 0x0A
MARK = "▁"  # how the vocabulary writes a space


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_cuts(path: str) -> None:
    """The pre-tokens are independent only in a model of this kind: no piece goes
    on with a space after something else, none holds a line break, spaces are
    kept, and a text starts as if after a space."""
    model = processor(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spanning = [p for p in pieces if MARK in p.lstrip(MARK) or "\n" in p]
    space = model.piece_to_id(MARK)
    as_expected = model.encode("\n")[:1] == [space] and model.encode("\n  a\n") == [space, *model.encode("\n")[1:], *model.encode(" a"), *model.encode("\n")[1:]]
    if spanning or not as_expected:
        raise ValueError(f"texts cannot be cut into pre-tokens for {path}")


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all texts, offsets per text). Each begins with a space, the
    one before the text included, or with a line break."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)).cast(pa.large_string())
    ends = np.frombuffer(spaced.buffers()[1], dtype=np.int64, count=len(spaced) + 1, offset=8 * spaced.offset)
    data = np.frombuffer(spaced.buffers()[2], dtype=np.uint8, count=int(ends[-1]))
    space = data == SPACE
    cut = data == BREAK
    cut[1:] |= space[1:] & ~space[:-1]
    cut[ends[:-1]] = True
    start = np.flatnonzero(cut)
    offsets = np.append(start, ends[-1]).astype(np.int64)
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), spaced.buffers()[2]])
    return tokens, np.searchsorted(start, ends)


class Encoder:
    """Lengths of pre-tokens, with a memory. One per worker process."""

    def __init__(self, path: str):
        self.model = processor(path)
        self.known: dict[bytes, int] = {}

    def encoded(self, tokens: list[bytes]) -> list[int]:
        # a space in front is implied; a line break comes after one that counts as a piece
        texts = [(t[1:] if t[0] == SPACE else t).decode() for t in tokens]
        sizes = map(len, self.model.encode(texts, num_threads=1))
        return [1 if t == b" " else n - (t[0] == BREAK) for t, n in zip(tokens, sizes, strict=True)]

    def lengths(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = np.fromiter((self.known.get(t, -1) for t in tokens), dtype=np.int64, count=len(tokens))
        missing = np.flatnonzero(out < 0)
        for at in range(0, len(missing), AT_ONCE):
            part = missing[at : at + AT_ONCE]
            names = [tokens[i] for i in part]
            out[part] = sizes = self.encoded(names)
            self.known.update((t, n) for t, n in zip(names, sizes, strict=True) if len(t) <= LONGEST)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.to_pylist()), dtype=np.uint64, count=len(tokens))


class LengthTable:
    """Open addressing with linear probing; a slot holds the 64-bit hash and the
    number of an entry, whose bytes are compared before its length counts."""

    def __init__(self, tokens: pa.Array, lengths: np.ndarray):
        self.tokens, self.length = tokens, lengths.astype(np.int32)
        self.mask = np.uint64(2 ** max(4, math.ceil(math.log2(max(1, 2 * len(tokens))))) - 1)
        self.hash = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.entry = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        for i, h in enumerate(_hashes(tokens)):
            at = int(h & self.mask)
            while self.entry[at] >= 0:
                at = (at + 1) & int(self.mask)
            self.hash[at], self.entry[at] = h, i

    def lookup(self, tokens: pa.Array) -> np.ndarray:
        """Lengths; -1 where the table has none."""
        h = _hashes(tokens)
        found = np.full(len(h), -1, dtype=np.int64)
        row, at = np.arange(len(h)), h & self.mask
        while len(row):
            entry = self.entry[at]
            hit = (entry >= 0) & (self.hash[at] == h[row])
            found[row[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            row, at = row[go], (at[go] + np.uint64(1)) & self.mask
        row = np.flatnonzero(found >= 0)
        same = pc.equal(tokens.take(pa.array(row)), self.tokens.take(pa.array(found[row]))).to_numpy(zero_copy_only=False)
        out = np.full(len(h), -1, dtype=np.int64)
        out[row[same]] = self.length[found[row[same]]]
        return out


def _trimmed(parts: list[pa.Table], most: int) -> pa.Table:
    """The lists as one of at most ``most`` counters; what is dropped lowers the rest alike."""
    whole = pa.concat_tables(parts).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
    n = whole["n"].to_numpy()
    if len(n) > most:
        whole = whole.set_column(1, "n", pa.array(n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]))
        whole = whole.filter(pc.greater(whole["n"], 0))
    return whole


def _list_row(counters: pa.Table) -> pa.RecordBatch:
    one = lambda column: pa.ListArray.from_arrays([0, len(counters)], column.combine_chunks())
    return pa.RecordBatch.from_arrays([one(counters["token"].cast(pa.binary())), one(counters["n"])], names=["token", "n"])


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in slices(batches, "text"):
            tokens, _ = pretokens(batch.column(0))
            counts = tokens.dictionary_encode()
            part = pa.table({"token": counts.dictionary, "n": np.bincount(counts.indices.to_numpy(), minlength=len(counts.dictionary))})
            held.append(part.filter(pc.less_equal(pc.binary_length(part["token"]), LONGEST)))
            rows += len(held[-1])
            if rows > 8 * most:
                held = [_trimmed(held, most)]
                rows = len(held[0])
        if held:
            yield _list_row(_trimmed(held, most))

    return run


def _merge(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = pa.table({"token": batch.column(0)[i].values.cast(pa.large_binary()), "n": batch.column(1)[i].values})
                held = _trimmed([held, part] if held else [part], most)
        if held:
            yield _list_row(held)

    return run


def frequent(docs: DataFrame, text_column: str = "text", most: int = 2**15, fan: int = 32) -> pa.Array:
    """The pre-tokens that are frequent in all texts, at most ``most``."""
    layout = "token array<binary>, n array<long>"
    scratch = Scratch(docs.sparkSession)
    lists = scratch.write(docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_count(most), layout), "token-lists")
    n, merged = lists.count(), lists
    while n > 1:
        n = math.ceil(n / fan)
        merged = merged.repartition(n).mapInArrow(_merge(most), layout)
    rows = merged.toArrow()
    scratch.drop("token-lists")
    return rows["token"][0].values.cast(pa.large_binary()) if rows.num_rows else pa.array([], pa.large_binary())


def _counted(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column(1), "")
            tokens, offsets = pretokens(texts)
            encoded = tokens.dictionary_encode()
            length = table.value.lookup(encoded.dictionary)
            missing = np.flatnonzero(length < 0)
            length[missing] = encoder(path).lengths(encoded.dictionary.take(pa.array(missing)).to_pylist())
            total = np.r_[0, np.cumsum(length[encoded.indices.to_numpy()])]
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            n = np.where(size > 0, total[offsets[1:]] - total[offsets[:-1]], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text", most: int = 2**15) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    check_cuts(path)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    tokens = frequent(rows, most=most)
    names = tokens.to_pylist()
    table = LengthTable(tokens, np.array(Encoder(path).encoded(names) if names else [], dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return rows.mapInArrow(_counted(path, shared, limit), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
