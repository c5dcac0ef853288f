"""Stored project tables: reading, integer-safe writing, replace by portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight import schema as S
from sitelight.functions.columns import null_nan, to_whole
from sitelight.functions.joins import measured
from sitelight.session import materialize, path_exists

STORED_TYPES = {
    "portfolio_id": T.StringType(),
    "project_id": T.StringType(),
    **S.PROJECT_TYPES,
    "source": T.StringType(),
}


def read_projects(spark: SparkSession, path: str, portfolio_ids: list[str] | None = None) -> DataFrame:
    """Stored projects with the full column list; a portfolio filter prunes
    partitions, absent columns arrive as null.

    The schema is given, so no footers are merged and portfolio ids, which are
    folder names, stay text whatever they look like ('007' is not 7)."""
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    kinds = {name: found.get(name, kind) for name, kind in STORED_TYPES.items()} | {"portfolio_id": T.StringType()}
    df = spark.read.schema(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])).parquet(path)
    if portfolio_ids is not None:
        df = df.where(F.col("portfolio_id").isin(portfolio_ids))
    return conform(df)


def conform(df: DataFrame) -> DataFrame:
    """Fixed column list and types; unreadable values and NaN become null."""
    columns = []
    for name, kind in STORED_TYPES.items():
        if name not in df.columns:
            columns.append(F.lit(None).cast(kind).alias(name))
        elif isinstance(kind, T.DoubleType):
            columns.append(null_nan(F.col(name).try_cast("double")).alias(name))
        else:
            columns.append(F.col(name).try_cast(kind).alias(name))
    return df.select(*columns)


def integer_safe(df: DataFrame) -> DataFrame:
    """Write projection: whole-number columns rounded half-even to int, NaN to
    null, dates as dates."""
    whole = {c: to_whole(F.col(c)) for c in S.INTEGER_COLUMNS if c in df.columns}
    real = {
        c: null_nan(F.col(c).cast("double"))
        for c in S.NUMERIC_COLUMNS
        if c in df.columns and c not in whole
    }
    dates = {c: F.col(c).cast("date") for c in S.DATE_COLUMNS if c in df.columns}
    return df.withColumns({**whole, **real, **dates})


def replace_portfolios(df: DataFrame, path: str, touched: DataFrame) -> None:
    """Replace the rows of every portfolio in ``touched`` by those in ``df``.

    Idempotent: partitions present in ``df`` are overwritten, partitions of
    touched portfolios without rows are dropped (an overwrite cannot write an
    empty partition), all others stay as they are.
    """
    touched = measured(touched.select("portfolio_id").distinct())
    # Written out: a cached table would be refreshed together with the path.
    old = materialize(_files(df.sparkSession, path, touched), "files-before")
    rows = df.join(touched, "portfolio_id", "left_semi")
    # Few files per portfolio, and more than one writer for a large one.
    (
        rows.hint("rebalance", F.col("portfolio_id"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("portfolio_id")
        .parquet(path)
    )
    # An overwritten partition has lost all its old files; whoever still has
    # them got no rows. Listing them costs no second run of the plan behind df.
    df.sparkSession.catalog.refreshByPath(path)
    emptied = _files(df.sparkSession, path, touched).join(old, ["portfolio_id", "file"], "left_semi").select("portfolio_id").distinct()
    _drop_partitions(df.sparkSession, path, emptied)
    df.sparkSession.catalog.refreshByPath(path)
    touched.unpersist()


def _files(spark: SparkSession, path: str, touched: DataFrame) -> DataFrame:
    """(portfolio_id, file) of the stored files of some portfolios."""
    layout = "portfolio_id string, file string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], layout)
    stored = spark.read.schema("portfolio_id string").option("basePath", path).parquet(path)
    return stored.select("portfolio_id", F.col("_metadata.file_name").alias("file")).distinct().join(touched, "portfolio_id", "left_semi")


def _drop_partitions(spark: SparkSession, path: str, emptied: DataFrame) -> None:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in emptied.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(root, "portfolio_id=" + escape(row.portfolio_id))
        if fs.exists(folder):
            fs.delete(folder, True)
