"""Exact search against all pairs; graph search by recall; both on awkward vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelight.llm import ann, topk

LAYOUT = "vec_id long, embedding array<float>, score string, shard string, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "t", 7) for i, v in rows], LAYOUT)


AWKWARD = [
    (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0]),
    (None, [1.0, 1.0]), (8, [1.0]), (9, []), (2, [0.5, 0.25]), (10, [-1.0, 0.5]), (11, [0.25, 0.5]), (12, [3e38, 1.0]), (13, [-3e38, 2.0]),
]


def brute(vectors, asked, k, scale):
    """Of every row whose id is asked for: all other rows, by score and id."""
    rows = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, [max(-(2**63), min(2**63 - 1, math.floor(float(np.float32(x)) * scale))) for x in v]))
    out = []
    for at, (q, own) in enumerate(rows):
        if q in asked:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=True)))), i) for n, (i, v) in enumerate(rows) if n != at and len(v) == len(own)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_exact_on_awkward_vectors(spark):
    got = topk.exact_top_k(frame(spark, AWKWARD), frame(spark, AWKWARD), 3, 1024, shard_rows=3, query_rows=2, fan=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(AWKWARD, [1, 2, 7, 8, 9, 10, 11, 12, 13], 3, 1024))


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(7, [1.0, 0.0])] * 40 + [(7, [0.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [2.0, -1.0]), (9, [1.0])]
    for k in (1, 3, 60):
        got = topk.exact_top_k(frame(spark, rows), frame(spark, rows), k, 4, shard_rows=4, query_rows=8, fan=2).collect()
        assert sorted(map(tuple, got)) == sorted(brute(rows, {7, 8, 9}, k, 4))


def test_exact_with_ties_and_many_tiles(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(150)]
    got = topk.exact_top_k(frame(spark, rows), frame(spark, rows[::7]), 5, 2, shard_rows=16, query_rows=8, fan=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, [i for i, _ in rows[::7]], 5, 2))


@pytest.mark.parametrize("operator", [lambda v, q: topk.exact_top_k(v, q, 3, 8), lambda v, q: ann.search(v, q, 3)])
def test_empty_tables(spark, operator):
    full, empty = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 0.0])]), frame(spark, [])
    assert operator(empty, empty).count() == 0 and operator(full, empty).count() == 0
    assert [r.vec_id for r in operator(full, full.where("vec_id = 1")).collect()] == [2]


def test_graph_search_recall_and_scores(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    x = (centres[draw.integers(0, 12, 1500)] + 0.4 * draw.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.search(frame(spark, rows), frame(spark, rows[::25]), 10, shard_rows=400, fan=2).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:10]
        hits += len(set(order) & set(part.vec_id))
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, 11))
        assert np.allclose(part.score, scores[part.vec_id], rtol=0, atol=1e-12)
    assert hits >= 0.9 * 600


def test_graph_search_on_copies_and_awkward_vectors(spark):
    copies = [(100 + i, [1.0, 2.0]) for i in range(50)]
    got = ann.search(frame(spark, AWKWARD[:12] + copies), frame(spark, [(120, [1.0, 2.0]), (3, None), (7, [0.0, 0.0])]), 4).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(120, 1, 100, 5.0), (120, 2, 101, 5.0), (120, 3, 102, 5.0), (120, 4, 103, 5.0)]
    alone = ann.search(frame(spark, [(1, [2.0])]), frame(spark, [(1, [2.0])]), 4)
    assert alone.count() == 0


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [5, 0]], dtype=np.float32)
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 1, 0]]), 3, 1.2)[0]
    assert kept.tolist() == [1, 3, 5]  # 2 and 4 lie behind 1 or 3; 5 marks an empty place
