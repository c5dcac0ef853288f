"""Helpers shared by the corpus operators: tables, scratch tables, vectors in Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight.session import scratch_table, shuffles_dropped

#: The characters that separate words: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on this session's rows travel to Python workers in batches of at
    most ``rows``. A batch is held several times at once (as it is built, sent and
    received, in each task), and Spark's 10,000 rows are a lot of whole texts. A
    smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Intermediate tables in the shared folder, deleted as soon as no later
    step reads them."""

    #: Lists that note the paths of all tables written meanwhile.
    noted: list[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = scratch_table(self.spark, name)
        for paths in self.noted:
            paths.append(path)
        with shuffles_dropped(self.spark):
            df.write.options(**options).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.paths.pop(name))


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """The paths of scratch tables written inside are added to the list."""
    Scratch.noted.append(paths)
    try:
        yield
    finally:
        Scratch.noted.remove(paths)


def reads(df: DataFrame) -> set[str] | None:
    """The folders that a table's plan scans; None if it reads anything else."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(j).toString() for j in range(roots.size())}
        elif kind not in ("LocalRelation", "OneRowRelation", "Range"):
            return None
    return found


def drop_unread(df: DataFrame, paths: list[str]) -> None:
    """Delete the scratch tables that ``df`` does not read, and forget them."""
    scanned = reads(df)
    if scanned is None:
        return
    named = [path.rsplit("/", 1)[-1] for path in paths]  # names are unique
    for path, name in zip(list(paths), named, strict=True):
        if not any(name in folder.split("/") for folder in scanned):
            drop_path(df.sparkSession, path)
            paths.remove(path)


def fold_of(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


def list_values(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column, whatever slice it is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def member_bits(keys: DataFrame, column: str, per_key: int = 16, most: int = 2**27) -> np.ndarray:
    """A filter of bounded size with one bit per 64-bit key, ``per_key`` bits of
    room each, up to ``most`` in all. It only spares work; whoever reads through
    it joins as well."""
    words = max(1, min(most, per_key * keys.count()) // 64)
    at = F.pmod(F.col(column), F.lit(64 * words))
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {64 * words}) % 64 as int))")
    rows = keys.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()
    out = np.zeros(words, dtype=np.uint64)
    for batch in rows.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    del rows
    pa.default_memory_pool().release_unused()
    return out


def may_hold(bits: np.ndarray, key: int) -> bool:
    at = key % (64 * len(bits))
    return bool((int(bits[at >> 6]) >> (at & 63)) & 1)


def may_hold_all(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, 64 * len(bits)).astype(np.uint64)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
