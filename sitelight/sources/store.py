"""A versioned store: several tables that change together, and at once.

Rows of a table lie in units: projects by portfolio and by a hash of their
external id, the places of ids by a hash of the id, derived tables by portfolio.
A commit writes the units it replaces under a folder of its own
(``<table>/token=<token>/<unit columns>/``), beside all that is stored already,
and then a manifest that says which token holds each unit now. A manifest counts
from the moment its writer marks it complete; until then, and after a failure
for good, readers see the version before, in all tables alike. Repeating a
commit under its token does nothing once it is complete, and else overwrites
only its own folder.

Reading some units opens their files alone. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight.functions.joins import measured
from sitelight.session import path_exists, remove_path

#: Units of a portfolio's projects, and of all ids.
BUCKETS, SLOTS = 16, 64
#: Units that are read by their folders; more are read by their tokens.
MOST_FOLDERS = 10_000
#: Table to its unit columns.
UNITS = {"projects": ["portfolio_id", "bucket"], "places": ["slot"], "rejected": ["slot"]}
DERIVED = ["portfolio_id"]
KINDS = {"portfolio_id": "string", "bucket": "int", "slot": "int"}
MANIFEST = "name string, portfolio_id string, bucket int, slot int, token string, layout string"


def units_of(name: str) -> list[str]:
    return UNITS.get(name, DERIVED)


def bucket_of(external_id: str | Column) -> Column:
    """The part of its portfolio that holds a project: by its external id."""
    return F.pmod(F.xxhash64(F.coalesce(external_id, F.lit(""))), F.lit(BUCKETS)).cast("int")


def slot_of(project_id: str | Column) -> Column:
    """The part of the id table that holds an id."""
    return F.pmod(F.xxhash64(project_id), F.lit(SLOTS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- versions -----------------------------------------------------------------
    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/version=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(s.getPath().getParent().getName().removeprefix("version=")) for s in found or [])

    def manifest(self, version: int | None = None) -> DataFrame:
        """Which token holds each unit, in the given or the last complete version."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}")

    def tables(self) -> list[str]:
        return sorted(r.name for r in self.manifest().where("name <> ''").select("name").distinct().collect())

    def committed(self, token: str) -> bool:
        """The last commit had this token."""
        return not self.manifest().where((F.col("name") == "") & (F.col("token") == token)).isEmpty()

    # --- reading ------------------------------------------------------------------
    def read(self, name: str, units: DataFrame | None = None, version: int | None = None) -> DataFrame | None:
        """The table's rows, of some units if given (by all or some of the unit
        columns); None if the table was never written."""
        entries = self.manifest(version).where(F.col("name") == name)
        layout = entries.agg(F.max("layout")).first()[0]
        if layout is None:
            return None
        schema, by = T.StructType.fromJson(json.loads(layout)), units_of(name)
        if units is not None:
            entries = entries.join(units.distinct(), units.columns, "left_semi")
        entries = measured(entries.where("token <> ''").select("token", *by))
        # the unit columns are folder names; their types are given, not guessed
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(["token string", *(f"{c} {KINDS[c]}" for c in by)])).fields])
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        if entries.limit(MOST_FOLDERS + 1).count() <= MOST_FOLDERS:
            folders = [self._folder(name, by, r) for r in entries.collect()]
            rows = reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        else:
            tokens = [f"{self.root}/{name}/token={r.token}" for r in entries.select("token").distinct().collect()]
            rows = reader.parquet(*tokens).join(entries, ["token", *by], "left_semi")
        entries.unpersist()
        return rows.drop("token")

    def _folder(self, name: str, by: list[str], unit) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        parts = [f"{c}={escape(str(unit[c])) if unit[c] is not None else '__HIVE_DEFAULT_PARTITION__'}" for c in by]
        return "/".join([self.root, name, f"token={unit.token}", *parts])

    # --- writing ------------------------------------------------------------------
    def commit(self, token: str, changes: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """Replace, in each table, the units named (by all or some of the unit
        columns) by the given rows, all tables at once. Units without rows are gone
        afterwards; rows of other units are not written."""
        if self.committed(token):
            return
        before = max(self.versions(), default=0)
        entries, held = self.manifest().where("name <> ''"), []
        for name, (rows, units) in changes.items():
            by, units = units_of(name), measured(units.distinct())
            held.append(units)
            path = f"{self.root}/{name}/token={token}"
            mine = rows.join(units, units.columns, "left_semi")
            # few files a unit, and more than one writer for a large one
            mine.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)
            layout = json.dumps(T.StructType([f for f in rows.schema if f.name not in by]).jsonValue())
            # an entry without a token keeps the layout of a table that has no rows
            written = self.spark.read.schema(", ".join(f"{c} {KINDS[c]}" for c in by)).parquet(path).distinct()
            fresh = written.withColumns({"name": F.lit(name), "token": F.lit(token), "layout": F.lit(layout)})
            empty = self.spark.createDataFrame([(name, "", layout)], "name string, token string, layout string")
            old = entries.where(F.col("name") == name).join(units, units.columns, "left_anti").where("token <> ''").withColumn("layout", F.lit(layout))
            entries = self._conform(entries.where(F.col("name") != name)).unionByName(self._conform(old)).unionByName(self._conform(fresh)).unionByName(self._conform(empty))
        mark = self._conform(self.spark.createDataFrame([("", token, "")], "name string, token string, layout string"))
        target = f"{self.root}/manifest/version={before + 1}"
        self._conform(entries).unionByName(mark).coalesce(1).write.mode("overwrite").parquet(target)
        for units in held:
            units.unpersist()

    def _conform(self, entries: DataFrame) -> DataFrame:
        columns = T.StructType.fromDDL(MANIFEST).fields
        return entries.select(*[(F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep``, and the folders that no kept
        version refers to."""
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        live = {(r.name, r.token) for v in kept for r in self.manifest(v).select("name", "token").distinct().collect()}
        for version in old:
            remove_path(self.spark, f"{self.root}/manifest/version={version}")
        jvm = self.spark.sparkContext._jvm
        for name in {n for n, _ in live if n}:
            pattern = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/token=*")
            for status in pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []:
                token = status.getPath().getName().removeprefix("token=")
                if (name, token) not in live and path_exists(self.spark, str(status.getPath())):
                    remove_path(self.spark, str(status.getPath()))
