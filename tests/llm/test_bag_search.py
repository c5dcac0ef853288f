"""Search by classes against a plain loop over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelight.llm import bag_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            tf, m = Counter(bag), 75 + (25 * len(bag) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], start=1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, "s") for i, t in docs], "doc_id long, text string, score long, item_id string").repartition(4)
    return d, spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, rank string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("aB9 .\n~é漢\0/:@[`{\x7f\x80"), st.characters(exclude_categories=["Cs"])), max_size=25)), max_size=6))
def test_terms(texts):
    array = pa.array([None, *texts], pa.string()).slice(1)
    found, offsets = bag_search.terms_of(array)
    words = [t.decode() for t in found.to_pylist()]
    assert [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [terms(t) for t in texts]


DOCS = [
    (1, "The cat sat on the mat"), (2, "the CAT"), (3, "cat the"), (2, "cat, the!"), (None, "the cat"), (4, ""), (5, None), (6, "?! --"), (7, "dog " * 3000), (8, "ñandú 漢字"),
    (9, "dog cat dog"), (10, "nothing here"), (11, "x" * 50_000 + " cat"), (12, "the the the"), (13, "cat the"),
]
ITEMS = [(1, "cat the the"), (1, "cat the the"), (2, "DOG ñandú"), (3, None), (4, ""), (5, "unheard"), (None, "漢字 mat"), (6, "the " * 500)]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_awkward_rows(spark, k):
    got = bag_search.search(*frames(spark, DOCS, ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, ITEMS, k)


def test_many_copies_ties_blocks_and_small_tiles(spark, monkeypatch):
    for name, value in (("ITEMS", 8), ("CELLS", 40), ("PRODUCTS", 64), ("FAN", 2)):
        monkeypatch.setattr(bag_search, name, value)
    draw = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{i}" for i in draw.zipf(1.3, n) % 60)
    texts = [word(int(n)) for n in draw.integers(1, 30, 60)]
    docs = [(int(i), texts[0] if i % 3 == 0 else texts[int(draw.integers(0, 60))]) for i in draw.permutation(400)]
    items = [(i, word(6)) for i in range(21)]
    assert len(list(bag_search.blocks_of_items(frames(spark, docs, items)[1], "item_id", "text"))) > 1
    got = bag_search.search(*frames(spark, docs, items), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 5)


def test_classes_hold_equal_bags_of_equal_penalty_only(spark):
    bags = spark.createDataFrame([(i, n, bytes([b] * 8)) for i, n, b in [(3, 2, 1), (1, 2, 1), (2, 2, 1), (4, 9, 1), (5, 2, 2), (None, 2, 1)]] + [(6, 1, b"")], "doc_id long, n long, bag binary")
    found = bag_search.classes(bags, 6, 12, 2).withColumn("bag", F.hex("bag"))
    assert sorted(map(tuple, found.collect())) == [(100, "01" * 8, [1, 2]), (100, "02" * 8, [5]), (187, "01" * 8, [4])]


def test_sums_beyond_doubles_are_added_as_longs():
    lists = [np.array([0, 1]), np.array([1])]
    block = bag_search.Items(lists, np.array([2**40, 2**40 + 1]))
    assert block.reach >= 2**53
    pairs = np.array([(0, 5), (1, 7), (1, 1)], dtype=bag_search.PAIR)
    value = lambda w, tf, m: w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    got = block.scores(np.array([0, 0, 1]), pairs, np.array([80, 100]), 2)
    assert got.tolist() == [[value(2**40, 5, 80) + value(2**40 + 1, 7, 80), value(2**40 + 1, 7, 80)], [value(2**40 + 1, 1, 100)] * 2]


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([], []), ([(1, None)], ITEMS)])
def test_empty_tables(spark, docs, items):
    assert bag_search.search(*frames(spark, docs, items), 20).count() == 0
