"""Token ids of texts, by a public tokenizer file."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight.llm.words import slices, told_apart


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Distinct words whose ids a worker remembers before it starts afresh.
REMEMBERED = 2**19
#: Words that are encoded at a time: what the tokenizer returns is far larger than the ids.
TOGETHER = 2**12
#: Marks at a word's end that the tokenizer splits off; they are no letters, digits or spaces.
TAIL = ".,;:!?%#$&*|"


class WordIds:
    """Ids of whole texts, put together from the ids of their space-separated
    parts. The tokenizer splits at white space, and letters from marks, before
    it looks for tokens, so both are the same; each distinct word is encoded
    once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            codes = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            size = [len(code) for code in codes]
            flat = np.fromiter(chain.from_iterable(code.ids for code in codes), dtype="<u4", count=sum(size)).tobytes()
            ends = [4 * end for end in accumulate(size)]
            self.known.update(zip(some, map(flat.__getitem__, map(slice, [0, *ends], ends))))

    def codes(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = b""
        out = list(map(known.get, words))
        split, wanted = [], {}
        for i, code in enumerate(out):
            if code is None:
                word = words[i]
                body, tail = word.rstrip(TAIL), ""
                if body.isalpha() and "\u03a3" not in body and "\u0130" not in body:
                    tail, body = word[len(body) :], body.lower()
                else:
                    body = word
                split.append((i, word, body, tail))
                if body not in known:
                    wanted[body] = None
                if tail not in known:
                    wanted[tail] = None
        if wanted:
            self._encode(list(wanted))
        for i, word, body, tail in split:
            out[i] = known[word] = known[body] + known[tail]
        return out

    def encode(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; offsets per text)."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        number, offsets, distinct = told_apart(parts)
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        codes = [*self.codes(words), end]
        number = np.insert(number, offsets[1:], len(words))
        size = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
        flat, first = np.frombuffer(b"".join(codes), dtype="<u4"), np.cumsum(size) - size
        length = size[number]
        before = np.cumsum(length) - length
        ids = flat[np.repeat(first[number] - before, length) + np.arange(length.sum())]
        ends = offsets[1:] + np.arange(len(texts))
        return ids, np.r_[0, (before + length)[ends]]


@functools.cache
def remembering(path: str) -> WordIds:
    """One per worker process, so that its tasks share what it remembers."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and one end id, cut
    into pieces of ``capacity`` where there are more. ``ids`` holds
    little-endian unsigned 32-bit numbers. Null texts count as empty, null and
    repeated document ids are kept as they are, other columns are left out."""
    kind = dict(docs.select(id_column).dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, offsets = remembering(path).encode(batch.column(1), end)
            count = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            first = offsets[row] + start
            stop = np.minimum(first + capacity, offsets[row + 1])
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            cuts = pa.array(np.append(first, len(ids)) * 4, pa.int32()).buffers()[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(stop - first, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, cuts, raw])],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")
