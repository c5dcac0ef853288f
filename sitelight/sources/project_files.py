"""Project CSV files, one or many portfolios per read."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight import schema as S

PORTFOLIO_IN_PATH = r"portfolios/([^/]+)/"


def read_project_files(
    spark: SparkSession,
    path: str | list[str],
    portfolio_pattern: str = PORTFOLIO_IN_PATH,
    multiline: bool = False,
) -> DataFrame:
    """Required columns as text, plus ``portfolio_id`` (taken from the file
    path) and ``_ord`` (file order of the row).

    Columns are found by name: files may order them differently and have more.
    Files with the same header are read together. ``multiline`` allows line
    breaks inside quotes and reads a file as one split, which suits many capped
    uploads; without it large files are split.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    parts = []
    for header, files in headers(spark, path).items():
        columns = [c.removeprefix("\ufeff") for c in next(csv.reader([header]), [])]
        missing = [c for c in S.REQUIRED_COLUMNS if c not in columns]
        if missing:
            raise ValueError(f"Missing required columns: {', '.join(missing)}")
        layout = T.StructType([T.StructField(c if c in S.REQUIRED_COLUMNS else f"_extra{i}", T.StringType()) for i, c in enumerate(columns)])
        rows = reader.schema(layout).csv(files)
        parts.append(rows.select(
            F.regexp_extract("_metadata.file_path", portfolio_pattern, 1).alias("portfolio_id"),
            file_order().alias("_ord"),
            *[null_token(F.col(c)).alias(c) for c in S.REQUIRED_COLUMNS],
        ))
    if not parts:
        raise ValueError(f"Missing required columns: {', '.join(S.REQUIRED_COLUMNS)}")
    return functools.reduce(DataFrame.unionByName, parts)


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Header line to the files that begin with it."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0")
    first = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("n"))
    heads = first.groupBy("file").agg(F.min_by("value", "n").alias("header"))
    grouped = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return {row.header: row.files for row in grouped.collect()}


def null_token(text: Column) -> Column:
    return F.when(~text.isin(S.NULL_TOKENS), text)


def file_order() -> Column:
    """Total order of rows as they stand in the files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
