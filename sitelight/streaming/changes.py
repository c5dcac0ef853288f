"""Project changes that keep arriving: merge each micro-batch, then refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelight.functions.joins import measured, released
from sitelight.operators.mutations import apply_mutations
from sitelight.plans.analyze import derived, project_changes, stored_projects
from sitelight.session import materialize, remove_path, written_once
from sitelight.sources.store import Store, bucket_of, slot_of
from sitelight.sources.tables import integer_safe


def addressed_units(store: Store, changes: DataFrame) -> DataFrame:
    """(portfolio_id, bucket) of every row that the changes may touch: by external
    id where they say, by id where the store's id table says. Only the slots of
    the ids are read."""
    named = changes.where("project_id_external is not null").select("portfolio_id", bucket_of("project_id_external").alias("bucket"))
    ids = changes.where("project_id is not null").select("project_id").distinct()
    places = store.read("places", ids.select(slot_of("project_id").alias("slot")))
    if places is None:
        return named.distinct()
    found = places.join(ids, "project_id", "left_semi").select("portfolio_id", F.col("home").alias("bucket"))
    return named.unionByName(found).distinct()


def start_changes(
    mutations: DataFrame, store: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Apply a stream of mutations to the store and keep the derived tables of the
    touched portfolios current.

    A batch reads the units it addresses, and replaces those of touched
    portfolios, the places of moved ids, the derived tables and its rejections in
    one version of the store. A batch repeated after a failure either finds its
    version committed and does nothing, or finds the store as it was before.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        with released():
            apply(batch, batch_id)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, target = batch.sparkSession, Store(batch.sparkSession, store)
        # This batch began, so the one before is committed and not repeated.
        remove_path(spark, f"{checkpoint}/staged/{batch_id - 1}")
        staged = f"{checkpoint}/staged/{batch_id}"
        token = written_once(spark.createDataFrame([(uuid.uuid4().hex,)], "token string"), f"{staged}/token").first().token
        if target.committed(token):
            return
        changes = written_once(batch, f"{staged}/changes")
        units = measured(addressed_units(target, changes))
        applied = apply_mutations(stored_projects(spark, store, units), changes)
        touched = materialize(applied.touched, "touched")
        replaced = measured(units.join(touched, "portfolio_id", "left_semi"))
        merged = materialize(integer_safe(applied.projects.join(touched, "portfolio_id", "left_semi")), "merged")
        # what the derived tables of touched portfolios are computed from
        stored = target.read("projects", touched)
        projects = merged if stored is None else merged.unionByName(stored.join(replaced, ["portfolio_id", "bucket"], "left_anti").select(*merged.columns))
        number = F.lit(batch_id).cast("int")
        rejected = applied.rejected.withColumn("slot", number)
        target.commit(token, {
            **project_changes(target, merged, replaced),
            **derived(materialize(projects, "touched-projects"), touched),
            "rejected": (rejected, spark.range(1).select(number.alias("slot"))),
        })

    writer = mutations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
