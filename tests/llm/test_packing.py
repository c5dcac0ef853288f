"""Tokens against the tokenizer itself; packing against its invariants and the lower bound."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelight.llm import packing, tokens

ODD = [
    "", " ", "\n\n", "It's we'll THE They're", "naïve CAFÉ e\u0301a A\u030a", "ΟΔΟΣ Σ", "İstanbul", "a\u00a0b\u2003c\td\r\ne", "x" * 5000,
    "<|endoftext|> a<|startoftext|>b", "end. of, line!? 100%%% a|b", "日本語 テキスト", "👍🏽 ok\x1c\x85", "don't.'s 's 'S", "12a3 ٣٤",
]


def direct(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def encoded(texts):
    ids, offsets = tokens.WordIds(tokens.tokenizer_path()).encode(pa.array(texts, pa.string()), b"\0\0\0\0")
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_are_the_tokenizers():
    assert encoded(ODD) == direct(ODD)


def test_many_words_are_encoded_in_parts():
    """What the tokenizer returns for a word is far larger than its ids."""
    words, sizes = tokens.WordIds(tokens.tokenizer_path()), []
    plain = words.tokenizer

    class Counting:
        def encode_batch_fast(self, some, **options):
            sizes.append(len(some))
            return plain.encode_batch_fast(some, **options)

    words.tokenizer = Counting()
    texts = [f"word{i}x" for i in range(10_000)]
    codes = words.codes(texts)
    assert max(sizes) <= 4096 and sum(sizes) == 10_000
    some = [0, 4095, 4096, 9999]
    assert [np.frombuffer(codes[i], "<u4").tolist() + [0] for i in some] == direct([texts[i] for i in some])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    assert encoded(texts) == direct(texts)


def test_pieces_and_places(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "word " * 3000, "same text", "same text"])] + [(None, "no id", "y"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    cut = tokens.pieces(docs, tokens.tokenizer_path(), 64).withColumn("ids_crc32", F.crc32("ids"))
    got = packing.pack(cut.withColumn("offset", F.lit("old")), 64).toPandas()
    want = []
    for doc, text, _ in rows:
        ids = direct([text or ""])[0]
        for p, s in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[s : s + 64], dtype="<u4")
            want.append((-1 if doc is None else doc, p, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == [0, *group.length.cumsum()[:-1]] and group.length.sum() <= 64
    whole = packing.sequences(packing.pack(cut, 64)).toPandas()
    assert sum(map(len, whole.ids)) == 4 * got.length.sum()


def test_packs_close_to_the_bound(spark):
    draw = random.Random(3)
    sizes = [draw.randint(1, 99) for _ in range(3000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, length int")
    got = packing.pack(items, 100, shard_items=400).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 100
    single = len(packing.best_fit(sizes, sorted(range(3000), key=lambda i: -sizes[i]), [], 100))
    assert math.ceil(sum(sizes) / 100) <= got.sequence_id.nunique() <= single + 3 * 8  # what the first level's eight shards may waste


def test_crossover_keeps_every_item_once():
    draw = random.Random(5)
    sizes = [draw.randint(5, 60) for _ in range(200)]
    one = packing.best_fit(sizes, list(range(200)), [], 100)
    other = packing.best_fit(sizes, list(range(199, -1, -1)), [], 100)
    child = packing.crossover(sizes, one, other, 100, draw)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert max(sum(sizes[i] for i in b) for b in child) <= 100


def test_edges(spark):
    assert packing.pack(spark.createDataFrame([], "id long, length int"), 10).count() == 0
    only_full = packing.pack(spark.createDataFrame([(1, 10), (1, 10)], "id long, length int"), 10).toPandas()
    assert only_full.sequence_id.nunique() == 2 and (only_full.offset == 0).all()
    for bad in (None, 0, 11):
        with pytest.raises(Exception, match="length outside"):
            packing.pack(spark.createDataFrame([(1, bad)], "id long, length int"), 10).collect()


def test_known_words_do_not_ask_the_tokenizer():
    """Parts of words are encoded together, each once, and remembered words not at all."""
    ids, calls = tokens.WordIds(tokens.tokenizer_path()), []

    class Asked:
        def encode_batch_fast(self, texts, inner=ids.tokenizer, **options):
            calls.append(sorted(texts))
            return inner.encode_batch_fast(texts, **options)

    ids.tokenizer = Asked()
    first = ids.codes(["Cat,", "cat", "CAT!", "...", ""])
    assert ids.codes(["Cat,", "cat", "CAT!", "...", ""]) == first
    assert calls == [["!", ",", "...", "cat"]]
