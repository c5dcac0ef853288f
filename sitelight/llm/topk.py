"""Exact top-k search by tiled matrix products.

Candidates are dealt to shards of about ``shard_rows`` vectors by a hash of
their id, queries to blocks of ``query_rows``. Every block meets every shard
once, as one matrix product (a tile); a partial selection keeps the k best of
each query and tile, and the short lists are merged as a tree, ``fan`` shards
at a time. Nothing but query blocks is repeated per shard.

Defined results: rows with a null id, a null vector or null or non-finite
components take no part; rows that repeat an id are candidates and queries of
their own, and a query leaves out one row of its id and vector only, its own;
only vectors of equal length are compared; a component
outside the range of a long becomes its nearest end, and so does a score; no
rows or no queries give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitelight.llm.common import Scratch, list_values, record

TOP = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()),
])
ARROW_TOP = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~broken


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, vector) with each component floored to a whole number after scaling."""
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable("vector"))
        .select("vec_id", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vector"))
    )


def blocks_of(vectors: DataFrame, n: int, key: str, ids: str, flat: str, *more: str, by: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    rows = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias(key), "vec_id", "vector", *more)
    return (
        rows.groupBy("dim", key).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector", *more))).alias("rows"))
        .select("dim", key, F.col("rows.vec_id").alias(ids), F.flatten("rows.vector").alias(flat), *[F.col(f"rows.{c}").alias(c) for c in more])
    )


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in doubles while no sum can reach 2^53,
    else in unbounded integers, cut to the range of a long at the end."""
    reach = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    if reach < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, LONG_MIN, LONG_MAX).astype(np.int64)


def _select(k: int):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim, shard = columns["dim"][i].as_py(), columns["shard"][i].as_py()
                qid = columns["query_ids"][i].values.to_numpy()
                cid = columns["ids"][i].values.to_numpy()
                q = columns["query_flat"][i].values.to_numpy().reshape(len(qid), dim)
                x = columns["flat"][i].values.to_numpy().reshape(len(cid), dim)
                scores = _scores(q, x)
                own = qid[:, None] == cid[None, :]
                for a in np.flatnonzero(own.any(axis=1)):
                    at = np.flatnonzero(own[a])
                    own[a] = False
                    own[a, at[(x[at] == q[a]).all(axis=1)][:1]] = True
                # ids ascend within a shard, so a stable order by score breaks ties by id
                kept = min(k + 1, len(cid))
                edge = ~np.partition(~scores, kept - 1, axis=1)[:, kept - 1]  # ~ turns the order of all longs
                row, col = np.nonzero(scores >= edge[:, None])
                fine = ~own[row, col]
                row, col = row[fine], col[fine]
                order = np.lexsort((col, ~scores[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                if len(row):
                    yield record(ARROW_TOP, query=columns["query"][i].values.to_numpy()[row], query_id=qid[row], shard=np.full(len(row), shard, np.int32), vec_id=cid[col], score=scores[row, col])

    return tiles


def best(lists: DataFrame, k: int, *keys: str, score: str = "score") -> DataFrame:
    """The k best of each key, ties to the smaller id; Spark keeps k per task
    and key before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(lists: DataFrame, k: int, shards: int, fan: int, query: str = "query_id") -> DataFrame:
    """Merge the per-shard lists of each query, ``fan`` lists at a time."""
    while shards > fan:
        lists = best(lists.withColumn("shard", F.expr(f"shard div {fan}").cast("int")), k, query, "shard").drop("rank")
        shards = math.ceil(shards / fan)
    return best(lists, k, query)


def met(blocks: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """Each query block beside each shard of its dimension."""
    spread = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    return shards.join(spread, ["dim", "shard"])


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding",
    shard_rows: int = 1024, query_rows: int = 256, fan: int = 8,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k candidates with the highest
    whole-number inner product, the query's own row left out."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    # of rows that are alike in all, k and the query's own are all that can be needed
    alike = Window.partitionBy("vec_id", "vector").orderBy("vec_id")
    candidates = quantized(vectors, id_column, vector_column, scale).withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1)
    candidates = scratch.write(candidates.drop("copy"), "topk-vectors")
    asked = scratch.write(quantized(queries, id_column, vector_column, scale).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    n_shards = max(1, math.ceil(candidates.count() / shard_rows))
    n_blocks = max(1, math.ceil(asked.count() / query_rows))
    shards = blocks_of(candidates, n_shards, "shard", "ids", "flat", by=("vec_id", "vector"))
    blocks = blocks_of(asked, n_blocks, "block", "query_ids", "query_flat", "query", by=("query",))
    # merged, not broadcast: a block is repeated for every shard, which no estimate knows
    lists = met(blocks.hint("merge"), shards, n_shards).mapInArrow(_select(k), TOP)
    return merged(lists, k, n_shards, fan, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
