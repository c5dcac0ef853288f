import shutil

from conftest import project_frame
from pyspark.sql import functions as F

from sitelight import schema as S
from sitelight.operators import mutations
from sitelight.plans import analyze
from sitelight.sources import tables
from sitelight.sources.store import Store
from sitelight.streaming import changes, intake

LAYOUT = ("seq int, op string, portfolio_id string, project_id string, project_id_external string, project_name string, "
          "contract_value_usd double, start_date date, end_date date, actual_duration_days int")


def stored(spark, rows):
    return tables.conform(project_frame(spark, rows).withColumn("source", F.lit("csv")))


def batch(spark, rows):
    df = spark.createDataFrame([(*x, *([None] * (7 - len(x))), None, None, 9) for x in rows], LAYOUT)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in S.PROJECT_TYPES.items() if c not in df.columns})


def outcome(applied):
    rows = {r.project_id_external: r for r in applied.projects.collect()}
    return rows, {r.seq: r.error for r in applied.rejected.collect()}


def test_upsert_rules(spark):
    table = stored(spark, [{}, {"portfolio_id": "q"}, {"subcontractor_count": 4}])
    rows, errors = outcome(mutations.apply_mutations(table, batch(spark, [
        (1, "upsert", "p", "id000", "x000", "by id", 1.0), (2, "upsert", "p", None, "x002", "by key", 2.0),
        (3, "upsert", "p", None, "new", "first", 3.0), (4, "upsert", "p", None, "new", "second", 4.0),
        (5, "upsert", "p", "id001", "x001", "wrong place", 5.0), (6, "upsert", "p", "ghost", "x9", "nobody", 6.0),
        (7, "upsert", "p", None, "x001", "same key elsewhere", 7.0),
    ])))
    assert errors == {5: "project belongs to a different portfolio", 6: "project not found"}
    assert rows["x000"].source == "csv" and rows["x000"].project_name == "by id"
    assert rows["x002"].subcontractor_count is None and rows["x002"].project_id == "id002"
    assert rows["new"].source == "manual" and rows["new"].project_name == "second" and rows["new"].actual_duration_days == 9
    table_rows = mutations.apply_mutations(table, batch(spark, [(7, "upsert", "p", None, "x001", "n", 7.0)])).projects
    assert table_rows.where("project_id_external = 'x001'").count() == 2


def test_delete_rules(spark):
    table = stored(spark, [{}, {"portfolio_id": "q"}, {}])
    applied = mutations.apply_mutations(table, batch(spark, [
        (1, "upsert", "p", "id000", "x000", "changed", 1.0), (2, "delete", "p", "id000"), (3, "upsert", "p", "id000", "x000", "too late", 2.0),
        (4, "delete", "p", "id000"), (5, "upsert", "p", None, "x000", "back again", 3.0), (6, "delete", "p", "id001"), (7, "delete", "p", "id002"),
        (8, "delete", "p", None, "x001"),
    ]))
    rows, errors = outcome(applied)
    assert errors == {3: "project not found", 4: "project not found", 6: "project belongs to a different portfolio", 8: "project not found"}
    assert set(rows) == {"x000", "x001"} and rows["x000"].source == "manual" and rows["x000"].project_name == "back again"
    assert rows["x000"].project_id != "id000"
    assert [r.portfolio_id for r in applied.touched.collect()] == ["p"]
    scores = spark.createDataFrame([("p", "id000"), ("q", "id001")], "portfolio_id string, project_id string")
    assert [r.project_id for r in mutations.cascade(scores, applied.deleted, ["portfolio_id", "project_id"]).collect()] == ["id001"]


def test_unknown_portfolio(spark):
    table = stored(spark, [{}])
    known = spark.createDataFrame([("p",)], "portfolio_id string")
    _, errors = outcome(mutations.apply_mutations(table, batch(spark, [(1, "upsert", "z", None, "k", "n", 1.0)]), known))
    assert errors == {1: "portfolio not found"}


def test_a_repeated_external_id_changes_one_row(spark):
    table = stored(spark, [{"project_id_external": "same"}, {"project_id_external": "same"}, {"portfolio_id": "q", "project_id_external": "same"}])
    applied = mutations.apply_mutations(table, batch(spark, [(1, "upsert", "p", None, "same", "edited", 5.0)]))
    assert {r.project_id: r.project_name for r in applied.projects.collect()} == {"id000": "edited", "id001": "n1", "id002": "n2"}


def counts(store, name, version=None):
    return {r.portfolio_id: r["count"] for r in store.read(name, version=version).groupBy("portfolio_id").count().collect()}


def test_replace_and_refresh(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    table = stored(spark, [{"portfolio_id": p, "project_id": f"{p}{i}"} for p in ("a", "b", "c d") for i in range(4)])
    everyone = table.select("portfolio_id").distinct()
    for _ in range(2):
        analyze.store_projects(table, path)
        analyze.refresh(spark, path, everyone)
    assert counts(store, "projects") == counts(store, "scores") == counts(store, "segments") == {"a": 4, "b": 4, "c d": 4}
    before, version = counts(store, "rules"), store.versions()[-1]
    gone = spark.createDataFrame([("c d",), ("b",)], "portfolio_id string")
    analyze.store_projects(table.where("project_id = 'b1'"), path, gone, derive=True)
    assert counts(store, "projects") == counts(store, "scores") == counts(store, "segments") == {"a": 4, "b": 1}
    assert counts(store, "rules")["a"] == before["a"] and "c d" not in counts(store, "rules")
    assert counts(store, "places") == {"a": 4, "b": 1} and store.versions()[-1] == version + 1
    assert counts(store, "scores", version) == {"a": 4, "b": 4, "c d": 4}


def test_a_killed_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    table = stored(spark, [{"portfolio_id": p, "project_id": f"{p}{i}"} for p in ("a", "b") for i in range(4)])
    analyze.store_projects(table, path, derive=True)
    version = store.versions()
    touched = spark.createDataFrame([("a",)], "portfolio_id string")
    changed = stored(spark, [{"portfolio_id": "a", "project_id": "a9"}])

    class Killed(Exception):
        pass

    # the projects are written, and the process dies before the manifest
    real = Store._conform
    calls = []

    def dies(self, entries):
        calls.append(1)
        if len(calls) > 5:
            raise Killed
        return real(self, entries)

    monkeypatch.setattr(Store, "_conform", dies)
    try:
        analyze.store_projects(changed, path, touched, derive=True)
    except Killed:
        pass
    else:
        raise AssertionError("went through")
    monkeypatch.undo()
    assert store.versions() == version and counts(store, "projects") == counts(store, "scores") == {"a": 4, "b": 4}
    # a manifest that was begun but not finished does not count, and is written over
    unfinished = tmp_path / "store" / "manifest" / f"version={version[-1] + 1}"
    unfinished.mkdir()
    (unfinished / "part-0.parquet").write_bytes(b"half")
    assert counts(store, "projects") == {"a": 4, "b": 4}
    analyze.store_projects(changed, path, touched, derive=True)
    assert counts(store, "projects") == counts(store, "scores") == counts(store, "places") == {"a": 1, "b": 4}
    # a repeated token is not applied twice, and old folders can go
    store.commit("once", {"segments": (store.read("segments").limit(0), touched)})
    count = len(store.versions())
    store.commit("once", {"segments": (store.read("segments").limit(0), spark.createDataFrame([("b",)], "portfolio_id string"))})
    assert len(store.versions()) == count and set(counts(store, "segments")) == {"b"}
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and counts(store, "projects") == {"a": 1, "b": 4}
    assert len(list((tmp_path / "store" / "scores").glob("token=*"))) == 2


def test_reading_units_opens_their_files_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    table = stored(spark, [{"portfolio_id": p, "project_id": f"{p}{i}"} for p in ("007", "7") for i in range(40)])
    analyze.store_projects(table, path)
    units = store.read("projects").where("project_id = '0073'").select("portfolio_id", "bucket")
    some = store.read("projects", units)
    assert some.count() < 20 and all("portfolio_id=007/" in f for f in some.inputFiles()) and len(some.inputFiles()) == 1
    places = store.read("places", spark.createDataFrame([("0073",)], "id string").select(changes.slot_of("id").alias("slot")))
    assert len(places.inputFiles()) == 1 and {r.portfolio_id for r in places.where("project_id = '0073'").collect()} == {"007"}
    asked = batch(spark, [(1, "upsert", "7", "0073", "x000", "elsewhere", 1.0), (2, "delete", "7", "75"), (3, "upsert", "7", None, "brand new", "n", 1.0)])
    found = {tuple(r) for r in changes.addressed_units(store, asked).collect()}
    homes = {(r.portfolio_id, r.bucket) for r in store.read("projects").where("project_id in ('0073', '75')").collect()}
    assert homes <= found and len(found) <= 4


def test_runs_are_replaced_on_retraining(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [{"portfolio_id": p, "project_id": f"{p}{i}", "payment_disputes": i % 2, "contract_value_usd": 1e6 * (i + 1)} for p in ("a", "b") for i in range(8)]
    table = stored(spark, rows)
    analyze.store_projects(table, path)
    analyze.train(spark, path, table)
    runs = lambda: {(r.portfolio_id, r.model_type): r.n_training_samples for r in Store(spark, path).read("model_runs").collect()}
    first = runs()
    assert len(first) == 4 and set(first.values()) == {8}
    analyze.store_projects(table.where("project_id <> 'a7' and portfolio_id = 'a'"), path, table.where("portfolio_id = 'a'"))
    analyze.train(spark, path, table.where("portfolio_id = 'a'"))
    assert {k: n for k, n in runs().items() if k[0] == "a"} == {k: 7 for k in first if k[0] == "a"} and len(runs()) == 4
    analyze.store_projects(table.where("project_id = 'a1'"), path, table.where("portfolio_id = 'a'"))
    analyze.train(spark, path, table.where("portfolio_id = 'a'"))
    assert {k[0] for k in runs()} == {"b"}


def test_document_intake_takes_each_file_once(spark, tmp_path):
    inbox, store = tmp_path / "in" / "portfolios" / "p1", str(tmp_path / "out")
    inbox.mkdir(parents=True)
    (inbox / "one.txt").write_text("alpha " * 450)
    (inbox / "two.pdf").write_text("alpha " * 450)

    def run():
        stream = intake.document_stream(spark, str(tmp_path / "in"))
        intake.start_intake(stream, store, str(tmp_path / "progress"), dims=16).awaitTermination()
        chunks = spark.read.parquet(f"{store}/chunks")
        return chunks.count(), {r.filename: r.embedding_status for r in spark.read.parquet(f"{store}/documents").collect()}

    assert run() == (2, {"one.txt": "complete", "two.pdf": "failed:unsupported_extension:pdf"})
    assert run()[0] == 2
    (inbox / "three.txt").write_text("beta " * 20)
    assert run() == (3, {"one.txt": "complete", "two.pdf": "failed:unsupported_extension:pdf", "three.txt": "complete"})


def test_streamed_changes_survive_a_repeat(spark, tmp_path):
    store, log, progress = str(tmp_path / "store"), tmp_path / "log", tmp_path / "progress"
    analyze.store_projects(stored(spark, [{}, {}, {"portfolio_id": "q"}]), store)
    first = batch(spark, [(1, "upsert", "p", None, "x000", "edited", 5.0), (2, "delete", "p", "id000"), (3, "upsert", "p", None, "new", "n", 1.0)])
    first.coalesce(1).write.parquet(str(log))

    def run():
        stream = spark.readStream.schema(first.schema).parquet(str(log))
        changes.start_changes(stream, store, str(progress)).awaitTermination()
        rows = analyze.stored_projects(spark, store).collect()
        return sorted((r.portfolio_id, r.project_id_external, r.source) for r in rows)

    expected = [("p", "new", "manual"), ("p", "x001", "csv"), ("q", "x002", "csv")]
    assert run() == expected
    # The driver died before the batch was committed: Spark repeats it.
    shutil.rmtree(progress / "commits")
    assert run() == expected
    assert Store(spark, store).read("scores").select("portfolio_id").distinct().count() == 1
    # The next batch releases what the one before had staged.
    batch(spark, [(4, "upsert", "q", None, "x002", "again", 2.0)]).coalesce(1).write.mode("append").parquet(str(log))
    run()
    assert [folder.name for folder in (progress / "staged").iterdir()] == ["1"]
