"""Text documents read from files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight.functions.joins import measured
from sitelight.session import local_folder
from sitelight.sources.project_files import PORTFOLIO_IN_PATH

def write_text_files(rows: DataFrame, path: str, by: str) -> None:
    """The other column of ``rows``, a text, in one file for every value of ``by``, a
    whole number: ``<by>=<value>`` is the file's name or its folder's, and a line end
    follows every row, as Spark's text writer has it.

    On a local or mounted folder (``file:``) Hadoop sets the permissions of every
    folder, file and checksum file it makes by a process of its own, which costs more
    than the file. There the tasks write the files themselves, each task in a folder
    of its own, and a file is in place once it is whole; only values that come more
    than once shuffle. Elsewhere Spark writes them, and each task puts its own files
    in place.
    """
    text = next(c for c in rows.columns if c != by)
    folder = local_folder(rows.sparkSession, path)
    # a file takes its time whatever its size, so the number of Spark's writers does
    # not follow the bytes of the table
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if folder is None:
        rows.repartition(tasks, by).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).text(path)
        return
    os.makedirs(folder, exist_ok=True)
    raw = rows.select(F.col(by).cast("long").alias("value"), F.col(text).cast("binary").alias("text"))
    several = measured(raw.groupBy(F.col("value").alias("_value")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_value"))
    found = F.col("value").eqNullSafe(F.col("_value"))
    single, joined = raw.join(several, found, "left_anti"), raw.join(several, found, "left_semi").repartition(tasks, "value")
    for part, name in ((single, "single"), (joined.sortWithinPartitions("value"), "joined")):
        part.mapInArrow(_each_to_its_file(f"{folder}/{name}", by), "files long").agg(F.sum("files")).collect()
    several.unpersist()


def _each_to_its_file(folder: str, by: str):
    """Task side: rows of one value follow each other, maybe over several batches."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}-{TaskContext.get().partitionId()}"
        os.makedirs(own, exist_ok=True)
        rows = ((v, t) for batch in batches for v, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        n = 0
        for n, (value, of_value) in enumerate(groupby(rows, key=itemgetter(0)), 1):
            unfinished = f"{own}/.{uuid.uuid4().hex}"
            with open(unfinished, "wb") as out:
                for _, text in of_value:
                    out.write((text.as_py() or b"") + b"\n")
            os.replace(unfinished, f"{own}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}.txt")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return write


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What is computed inside reads many small files a task: Spark counts each as
    megabytes by default, and starts a task for a few."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_document_files(
    spark: SparkSession, path: str | list[str], portfolio_pattern: str = PORTFOLIO_IN_PATH, below: str | None = None
) -> DataFrame:
    """document_id, portfolio_id, filename, text, uploaded_at; one row per file.
    With ``below``, every file under the path whose name fits that pattern: many
    folders are then listed by tasks, where a pattern for folders in the path
    itself is followed by the driver alone."""
    reader = spark.read.format("binaryFile")
    if below is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", below)
    return from_binary(reader.load(path), portfolio_pattern)


def from_binary(files: DataFrame, portfolio_pattern: str = PORTFOLIO_IN_PATH) -> DataFrame:
    return files.select(
        F.md5("path").alias("document_id"),
        F.regexp_extract("path", portfolio_pattern, 1).alias("portfolio_id"),
        F.substring_index("path", "/", -1).alias("filename"),
        F.decode("content", "UTF-8").alias("text"),
        F.col("modificationTime").alias("uploaded_at"),
    )
