"""The corpus pipeline: each stage takes all that the one before it kept.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``, but for
the last, which returns the pieces packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelight.llm import langid, line_dedup, mixing, ngram_join, packing, tokens
from sitelight.llm.common import Scratch, drop_unread, noting, small_batches, table
from sitelight.llm.queries import MIXTURE, SEQUENCE_LENGTH, domains

#: Scratch tables that stages have left, since their results read them.
LEFT: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """What earlier stages left goes when a stage begins, as their results have
    been written by then; but for tables that ``docs`` reads itself."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(docs, LEFT)
        with noting(LEFT):
            return work(spark, docs, sf_dir)

    return run


#: A text stays if its best language has at least this posterior.
SURE = 0.5


@stage
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a language that is likelier than all others, go.
    Whole texts travel to Python workers from here on, in small batches."""
    small_batches(spark)
    model = langid.fit(docs, langid.vocabulary_path())
    scored = langid.identify(docs, model)
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(docs.columns)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated line chunks; those that lose every visible
    character go, since all they had is kept elsewhere."""
    result = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return result.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row
    with the smallest id stays, and of several such rows the longest text. Rows
    are told apart by a key of their own, so texts with clashing ids are judged
    one by one; rows with a null id stay."""
    scratch = Scratch(spark)
    row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    keyed = scratch.write(docs.select(row.alias("__row"), F.struct(*docs.columns).alias("doc")), "pipeline-rows")
    texts = keyed.select("__row", F.col("doc.text").alias("text"))
    found = scratch.write(ngram_join.groups(texts, width=5, percent=80, id_column="__row"), "pipeline-groups")
    found = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__row"), "n_shingles", "component_id")
    # texts without words are near copies of nothing but of their own repeated rows
    group = F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("id"), F.lit(None).cast("string").alias("text")))
    group = group.otherwise(F.struct(F.lit(None).cast("long").alias("component_id"), F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text")))
    order = F.struct(F.col("doc.doc_id"), -F.length(F.coalesce("doc.text", F.lit(""))), F.xxhash64("doc.text"), F.col("__row").alias("row"))
    chosen = keyed.join(found, "__row").groupBy(group.alias("group")).agg(F.min(order)["row"].alias("__row"))
    kept = keyed.join(chosen, "__row", "left_semi").unionByName(keyed.where("__row IS NULL"))
    return kept.select("doc.*").select(docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says."""
    rated, _, _ = mixing.mix(docs, domains(spark, sf_dir), MIXTURE, keep_text=True)
    return rated.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of at most SEQUENCE_LENGTH tokens."""
    cut = tokens.pieces(docs, tokens.tokenizer_path(), SEQUENCE_LENGTH)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), SEQUENCE_LENGTH)


STAGES = [
    ("language identification", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Models, chunking by rolling hashes and the genetic search have no SQL form;
#: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage-{i}")
        if 0 < i < len(STAGES) - 1:  # the stage before last has been read
            scratch.drop(f"stage-{i - 1}")
    return docs
