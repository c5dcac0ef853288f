"""The pipeline stage by stage on the smallest tables, and the registry."""

import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitelight.llm import common, langid, line_dedup, ngram_join

SF = "/root/testdata/sf0.001"
OPERATORS = list(range(1, 14))


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == OPERATORS
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op9_url_filter", "op10_exact_top_k", "op11_laesa_clusters", "op13_bag_search"])
def test_query_equals_sql(spark, name):
    verdict, _, fine = compare.compare(spark, compare.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert fine, verdict


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (902, "123", "en", "s", 3), (None, "the text of the and", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 0"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns
        kept.append((docs.cache(), after.cache()))
        docs = after

    before, after = kept[0]
    known = before.where("doc_id IS NOT NULL")
    assert {r.doc_id for r in known.join(after, "doc_id", "left_anti").collect()} == {900, 901, 902} and after.where("doc_id IS NULL").count() == 1
    before, after = kept[1]
    lost = {r.doc_id for r in before.where("doc_id IS NOT NULL").join(after, "doc_id", "left_anti").collect()}
    emptied = {r.doc_id for r in line_dedup.dedup(before).where("n_removed > 0 AND trim(text) = ''").collect()}
    assert lost <= emptied and after.where("n_chars <> length(text)").isEmpty()
    before, after = kept[2]
    groups = ngram_join.groups(before, 5, 80).collect()
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted({r.component_id for r in groups if r.component_id is not None})
    before, after = kept[3]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert after.count() > 0.6 * before.count()
    before, after = kept[4]
    assert after.where("piece = 0").count() == before.count()
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n <> end OR n > 2048").isEmpty()


def test_texts_with_clashing_ids_are_judged_one_by_one(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e")), (4, text("e")), (4, text("e", 41)), (5, "!"), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (4, text("e", 41)), (5, "!"), (None, text("a"))]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(d), t) for d, t in want)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, langid.vocabulary_path())
    scored = langid.identify(docs, model)
    rejected = scored.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < corpus_pipeline.SURE)).count()
    assert corpus_pipeline.identify_languages(spark, docs, SF).count() == docs.count() - rejected


def test_tables_that_a_result_reads_are_kept(spark, tmp_path):
    scratch, paths = common.Scratch(spark), []
    with common.noting(paths):
        a = scratch.write(spark.range(5), "kept-a")
        b = scratch.write(spark.range(7), "kept-b")
    scratch.write(spark.range(3), "unnoted")
    assert len(paths) == 2
    common.drop_unread(a.join(spark.range(3), "id"), paths)
    assert len(paths) == 1 and a.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(b.inputFiles()[0]).count()
    common.drop_unread(spark.createDataFrame(a.rdd), paths)  # who knows what that reads
    assert len(paths) == 1 and a.count() == 5
    common.drop_unread(spark.read.parquet(f"{SF}/documents.parquet"), paths)
    assert paths == []
