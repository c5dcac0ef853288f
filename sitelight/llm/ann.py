"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards of about ``shard_rows``. Each shard gets a
directed graph: from random edges on, greedy beam searches propose neighbours
for batches of vectors, and pruning keeps a proposal only while no kept, nearer
neighbour is ``alpha`` times closer to it than the vector itself, so edges stay
diverse. Back edges are added and pruned alike. A query block is then searched
in every shard by a beam over its graph; the shard's best are scored again in
double precision and merged as a tree.

The inner product is made a distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm of the shard, and zero in queries.
Equal vectors are one node, so copies neither crowd a graph nor its answers:
a node keeps its ``k + 1`` smallest ids, all that any query can be given.

Defined results: rows with a null id, and vectors that are null, zero, empty
or hold null or non-finite components take no part; rows that repeat an id and
a vector count once, rows that repeat an id with another vector are candidates
of their own and searched for on their own; only vectors of equal length are
compared; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitelight.llm.common import Scratch, record
from sitelight.llm.topk import best, blocks_of, merged, met, usable

FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
])
ARROW_FOUND = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


# --- one shard's graph ---------------------------------------------------------
def _gaps(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, up to the query's own norm, of each query to its ids."""
    return norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, width: int) -> np.ndarray:
    """Ids of the nearest nodes met, nearest first, for all queries in step;
    -1 where fewer were met."""
    n, rows = len(x), np.arange(len(q))
    width = min(width, n)
    seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column stands for absent edges
    seen[:, [entry, n]] = True
    beam = np.full((len(q), width), n, dtype=np.int32)
    gap = np.full((len(q), width), np.inf, dtype=np.float32)
    done = np.zeros((len(q), width), dtype=bool)
    beam[:, 0] = entry
    gap[:, 0] = _gaps(x, norms, q, np.full((len(q), 1), entry))[:, 0]
    active = rows
    while len(active):
        todo = np.where(done[active] | (beam[active] == n), np.inf, gap[active])
        pick = todo.argmin(axis=1)
        going = np.isfinite(todo[np.arange(len(active)), pick])
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        near = edges[beam[active, pick]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        ids = np.where(fresh, near, 0)
        new = np.where(fresh, _gaps(x, norms, q[active], ids), np.inf).astype(np.float32)
        all_ids = np.concatenate([beam[active], np.where(fresh, near, n)], axis=1)
        all_gaps = np.concatenate([gap[active], new], axis=1)
        all_done = np.concatenate([done[active], np.zeros_like(fresh)], axis=1)
        keep = np.argpartition(all_gaps, width - 1, axis=1)[:, :width]
        beam[active] = np.take_along_axis(all_ids, keep, 1)
        gap[active] = np.take_along_axis(all_gaps, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(gap, axis=1, kind="stable")
    out = np.take_along_axis(beam, order, 1)
    return np.where(out == n, -1, out)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours per point, the absent ones as len(x)."""
    n = len(x)
    cand = np.sort(np.where(cand < 0, n, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    cand[cand == points[:, None]] = n
    vectors = x[np.minimum(cand, n - 1)]
    gap = ((vectors - x[points][:, None, :]) ** 2).sum(axis=2)
    gap[cand == n] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    cand, gap = np.take_along_axis(cand, order, 1), np.take_along_axis(gap, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    norms = (vectors**2).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive, rows = np.isfinite(gap), np.arange(len(points))
    out = np.full((len(points), degree), n, dtype=np.int32)
    for slot in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, slot] = cand[some, pick[some]]
        alive &= ~(alpha * alpha * between[rows, pick] <= gap) | ~some[:, None]
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, degree: int, width: int, alpha: float, batch: int = 512) -> tuple[np.ndarray, int]:
    """(edges, entry): edges hold len(x) where a node has fewer neighbours."""
    n, draw = len(x), np.random.default_rng(len(x))
    norms = (x**2).sum(axis=1)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n + 1, degree), n, dtype=np.int32)
    if n > 1:
        edges[:n, : degree // 2] = (np.arange(n)[:, None] + draw.integers(1, n, (n, degree // 2))) % n
    order = draw.permutation(n)
    for at in range(0, n, batch):
        points = order[at : at + batch]
        met_ = beam_search(x, norms, edges, entry, x[points], width)
        now = edges[points]
        edges[points] = robust_prune(x, points, np.concatenate([met_, now], axis=1), degree, alpha)
        source, slot = np.nonzero(edges[points] < n)
        target, back = edges[points][source, slot], points[source]
        by = np.argsort(target, kind="stable")
        target, back = target[by], back[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        size = np.argsort(count, kind="stable")
        nodes, first, count = nodes[size], first[size], count[size]
        start = 0
        while start < len(nodes):  # nodes with like numbers of new edges together, in bounded memory
            stop = start + 1
            while stop < len(nodes) and (stop + 1 - start) * (degree + count[stop]) ** 2 < 4_000_000:
                stop += 1
            most = int(count[stop - 1])
            place = first[start:stop, None] + np.arange(most)
            new = np.where(np.arange(most) < count[start:stop, None], back[np.minimum(place, len(back) - 1)], n)
            edges[nodes[start:stop]] = robust_prune(x, nodes[start:stop], np.concatenate([edges[nodes[start:stop]], new], axis=1), degree, alpha)
            start = stop
    return edges[:n], entry


def lifted(x: np.ndarray) -> np.ndarray:
    """The vectors with the component that makes inner products distances."""
    squares = (x**2).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], axis=1).astype(np.float32)


# --- the operator ----------------------------------------------------------------
def distinct_vectors(vectors: DataFrame, id_column: str, vector_column: str, k: int) -> DataFrame:
    """(vec_id, vector, members): each distinct vector under its smallest id,
    with its k + 1 smallest ids."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("members"))


def build_index(nodes: DataFrame, n_shards: int, degree: int = 24, width: int = 48, alpha: float = 1.2) -> DataFrame:
    """(dim, shard, ids, flat, edges, entry): one graph per shard."""
    layout = "dim int, shard int, ids array<long>, flat array<double>, edges array<int>, entry int"
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32())), ("entry", pa.int32())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, shard, ids, flat = (batch.column(batch.schema.names.index(c))[i] for c in ("dim", "shard", "ids", "flat"))
                x = flat.values.to_numpy().reshape(-1, dim.as_py())
                edges, entry = build_graph(lifted(x), degree, width, alpha)
                yield record(schema, dim=[dim.as_py()], shard=[shard.as_py()], ids=[ids.values.to_numpy()], flat=[x.ravel()], edges=[edges.ravel()], entry=[entry])

    return blocks_of(nodes, n_shards, "shard", "ids", "flat").mapInArrow(link, layout)


def _search(k: int, degree: int, width: int):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim, shard, entry = (column[c][i].as_py() for c in ("dim", "shard", "entry"))
                qid, ids = (column[c][i].values.to_numpy() for c in ("query_ids", "ids"))
                q = column["query_flat"][i].values.to_numpy().reshape(-1, dim)
                x = column["flat"][i].values.to_numpy().reshape(-1, dim)
                edges = column["edges"][i].values.to_numpy().reshape(-1, degree)
                up = lifted(x)
                scale = np.sqrt((q**2).sum(axis=1, keepdims=True))
                asked = np.concatenate([q / scale, np.zeros((len(q), 1))], axis=1).astype(np.float32)
                nodes = beam_search(up, (up**2).sum(axis=1), edges, entry, asked, width)[:, : 2 * k + 2]
                scores = np.where(nodes >= 0, (x[nodes] * q[:, None, :]).sum(axis=2), -np.inf)
                order = np.lexsort((ids[nodes], -scores))[:, : k + 1]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                node, score = nodes[row, order.ravel()], scores[row, order.ravel()]
                fine = node >= 0
                yield record(ARROW_FOUND, query_id=qid[row[fine]], shard=np.full(fine.sum(), shard, np.int32), vec_id=ids[node[fine]], score=score[fine])

    return tiles


def search(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
    shard_rows: int = 4096, query_rows: int = 256, degree: int = 24, build_width: int = 48, width: int = 96, alpha: float = 1.2, fan: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found, the query's own
    row left out."""
    scratch = Scratch(vectors.sparkSession)
    nodes = scratch.write(distinct_vectors(vectors, id_column, vector_column, k), "ann-nodes")
    n_shards = max(1, math.ceil(nodes.count() / shard_rows))
    index = scratch.write(build_index(nodes, n_shards, degree, build_width, alpha), "ann-index")
    asked = queries.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0)).distinct()
    n_blocks = max(1, math.ceil(asked.count() / query_rows))
    blocks = blocks_of(asked, n_blocks, "block", "query_ids", "query_flat")
    found = met(blocks, index, n_shards).mapInArrow(_search(k, degree, width), FOUND)
    top = merged(found, k + 1, n_shards, fan).drop("rank", "shard")
    members = nodes.select("vec_id", "members")
    spread = top.join(members, "vec_id").select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    return best(spread, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
