"""Portfolio ids are text, whatever they look like; refreshes keep every derived column."""

import pyarrow as pa
from conftest import project_frame
from pyspark.sql import functions as F

from sitelight.operators.dashboard import natural_key
from sitelight.plans import analyze, catalog_more
from sitelight.session import wide_rows
from sitelight.sources import document_files, marts, tables
from sitelight.sources.store import Store

IDS = ["007", "7", "1e3", "2024-01-01", "north"]


def stored(spark, tmp_path):
    rows = [{"portfolio_id": p, "project_id": f"{p}/{i}", "contract_value_usd": 1e6 * (i + 1) ** 2} for p in IDS for i in range(6)]
    store = str(tmp_path / "store")
    projects = project_frame(spark, rows).withColumn("start_date", F.lit(None).cast("date"))
    analyze.store_projects(projects, store)
    return store, projects.select("portfolio_id").distinct()


def test_ids_survive_write_read_and_refresh(spark, tmp_path):
    store, touched = stored(spark, tmp_path)
    assert sorted({r.portfolio_id for r in analyze.stored_projects(spark, store).collect()}) == sorted(IDS)
    assert analyze.stored_projects(spark, store, touched.where("portfolio_id = '007'")).count() == 6
    analyze.refresh(spark, store, touched)
    for name in ("scores", "segments"):
        read = Store(spark, store).read(name)
        assert {(r.portfolio_id, r.n) for r in read.groupBy("portfolio_id").agg(F.count("*").alias("n")).collect()} == {(p, 6) for p in IDS}
    assert Store(spark, store).read("segments").where("cluster_id IS NULL").isEmpty()


def test_replacing_drops_only_what_became_empty(spark, tmp_path):
    store, touched = stored(spark, tmp_path)
    path = f"{store}/plain"
    tables.replace_portfolios(tables.integer_safe(analyze.stored_projects(spark, store)), path, touched)
    assert tables.read_projects(spark, path, ["007"]).count() == 6
    rows = tables.integer_safe(tables.read_projects(spark, path).where("portfolio_id = '7'")).withColumn("delay_days", F.lit(1.0))
    tables.replace_portfolios(spark.createDataFrame(rows.collect(), rows.schema), path, touched.where("portfolio_id IN ('7', '007', 'absent')"))
    left = {r.portfolio_id: r.d for r in tables.read_projects(spark, path).groupBy("portfolio_id").agg(F.avg("delay_days").alias("d")).collect()}
    assert set(left) == set(IDS) - {"007"} and left["7"] == 1.0 and left["north"] == 14.0


def test_long_numbers_sort_by_value(spark):
    texts = ["a" + "9" * 21, "a1" + "0" * 22, "a2", "a10", "a010x", "b1", "a" + "1" * 300, "a" + "2" * 299]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").orderBy(natural_key(F.col("t")), "t").collect()]
    assert got == ["a2", "a10", "a010x", texts[0], texts[1], texts[7], texts[6], "b1"]


def test_long_keys_stay_apart(spark):
    keys = spark.createDataFrame([(1,), (1234567890123,), (1234567890124,)], "k long").select(marts.external_id(F.col("k")).alias("id"))
    assert [r.id for r in keys.collect()] == ["PRJ000000001", "PRJ1234567890123", "PRJ1234567890124"]


def test_a_table_streams_as_one_file_and_as_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, "en", "word " * 30) for i in range(40)], "doc_id long, lang string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        found = catalog_more.s5_document_intake(spark, str(tmp_path / kind))
        assert sorted(r.document_id for r in found.collect()) == list(range(40))


def test_wide_rows_travel_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with wide_rows(spark, 8):
        got = [r.n for r in spark.range(100, numPartitions=1).mapInArrow(sizes, "n long").collect()]
    assert max(got) == 8 and sum(got) == 100 and spark.conf.get(name) == before


def test_wide_rows_are_read_a_few_at_a_time(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    with wide_rows(spark, 8):
        assert int(spark.conf.get(name)) <= 64
    assert spark.conf.get(name) == before


def test_files_in_many_folders_are_read_from_their_root(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(None, "no id")], "doc_id long, text string")
    rows.repartition(4, "doc_id").write.partitionBy("doc_id").text(str(tmp_path / "all"))
    (tmp_path / "all" / "doc_id=1" / "other.csv").write_text("not asked for")
    found = document_files.read_document_files(spark, str(tmp_path / "all"), r"doc_id=(\d+)/", below="*.txt")
    assert sorted((r.portfolio_id, r.text) for r in found.collect()) == sorted([(str(i), f"text {i}\n") for i in range(40)] + [("", "no id\n")])


def test_texts_are_written_to_files_without_a_process_each(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}\nsecond line") for i in range(60)] + [(7, "again"), (None, "no id"), (61, None), (62, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    lines = {str(i): [f"text {i}\nsecond line\n"] for i in range(60)} | {"": ["no id\n"], "61": ["\n"], "62": ["\n"]}
    lines["7"].append("again\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    for place in ("tasks", "spark"):
        if place == "spark":
            monkeypatch.setattr(document_files, "local_folder", lambda *_: None)
        path = f"file://{tmp_path}/{place}"
        document_files.write_text_files(texts, path, "doc_id")
        # Hadoop's local writer makes a checksum file, and starts a process for the permissions of either
        assert place == "spark" or not list((tmp_path / place).rglob(".*"))
        found = document_files.read_document_files(spark, path, r"doc_id=(\d+)[./]", below="*.txt")
        with document_files.small_files(spark):
            assert found.select("*").rdd.getNumPartitions() <= 8  # one for each file before
        got = {r.portfolio_id: r.text for r in found.collect()}
        assert len(got) == found.count() == len(lines)
        assert all(got[k] in ("".join(v), "".join(v[::-1])) for k, v in lines.items())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
