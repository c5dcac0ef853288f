"""Counts by pre-tokens against the tokenizer on whole texts."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelight.llm import token_counts as tc

PATH = tc.model_path()
ODD = [
    None, "", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  b", "a\nb", "a \n\n b", "▁", "▁▁a", "a▁b", "<s>", "</s> <unk>", "<0x0A>", "\t\ta", "\r\n", "x\0y", "😀 ñ", "　a",
    "word" * 20_000, "the " * 20_000, " " * 5000, "\n" * 300, "é", "A-B_c", "1234567890 12",
]


def whole(texts):
    return [len(ids) for ids in tc.processor(PATH).encode([t or "" for t in texts])]


def by_parts(texts):
    tokens, offsets = tc.pretokens(pa.array(texts, pa.string()))
    total = np.r_[0, np.cumsum(tc.encoder(PATH).lengths(tokens.to_pylist()))]
    return [int(b - a) if t else 0 for t, a, b in zip(texts, total[offsets[:-1]], total[offsets[1:]], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abTheé<s>/0x"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8))
def test_parts_add_up_to_the_whole(texts):
    assert by_parts(texts) == whole(texts)


def test_odd_texts(spark):
    rows = [(i, t, "x", 9, "y") for i, t in enumerate(ODD)] + [(None, "a b", "x", 9, "y"), (1, "twice", "x", 9, "y"), (1, "twice", "x", 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens long, token string").repartition(3)
    for most in (1, 8, 2**15):
        got = tc.count_tokens(docs, PATH, limit=4096, most=most)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        want = [(r[0], len((r[1] or "").encode()), n, n > 4096) for r, n in zip(rows, whole([r[1] for r in rows]), strict=True)]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = dict(zip(texts, whole(texts.values()), strict=True))
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, PATH, 4096).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert tc.count_tokens(docs, PATH, 4096).count() == 0


def test_frequent_pretokens_are_found_whatever_the_partitions(spark):
    texts = ["the of the and " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(37)
    found = tc.frequent(docs, most=64, fan=3).to_pylist()
    assert {b" the", b" of", b" and"} <= set(found) and len(found) <= 64


def test_lookup_compares_bytes(monkeypatch):
    names = [f" w{i}".encode() for i in range(50)]
    monkeypatch.setattr(tc, "_hashes", lambda tokens: np.array([len(t) for t in tokens.to_pylist()], dtype=np.uint64))
    table = tc.LengthTable(pa.array(names, pa.large_binary()), np.arange(50))
    got = table.lookup(pa.array(names + [b" zz", b"?"], pa.large_binary()))
    # under one hash only the first entry is found, and nothing is mistaken for it
    assert [int(n) for n in got] == [0 if i == 0 else 10 if i == 10 else -1 for i in range(50)] + [-1, -1]


def test_a_model_whose_pieces_span_words_is_refused(monkeypatch):
    class Spanning:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

        def piece_to_id(self, piece):
            return 0

        def encode(self, text):
            return [0]

    monkeypatch.setattr(tc, "processor", lambda path: Spanning())
    try:
        tc.check_cuts("any")
    except ValueError:
        return
    raise AssertionError("accepted")
