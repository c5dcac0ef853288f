"""Document chunks and similarity retrieval for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight import schema as S
from sitelight.functions.joins import measured
from sitelight.functions.text import chunk_words, is_blank, trim_all, words

# Rows of a block of questions and of chunks: one meeting of two blocks is one
# matrix product.
QUESTION_ROWS, CHUNK_ROWS = 256, 1024
# Fixed value: the text formats that are read.
TEXT_EXTENSIONS = ["txt"]


# --- intake ---------------------------------------------------------------------
def extension(filename: Column) -> Column:
    """Lower-cased part after the last dot; the whole name without a dot."""
    return F.lower(F.substring_index(filename, ".", -1))


def chunked(documents: DataFrame) -> DataFrame:
    """Adds ``chunks``, ``embedding_status`` and ``chunk_count``."""
    kind = extension(F.col("filename"))
    reason = F.concat(F.lit("unsupported_extension:"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("none")))
    readable = kind.isin(TEXT_EXTENSIONS)
    text = F.coalesce("text", F.lit(""))
    found = F.size("chunks")
    return (
        documents.withColumn("chunks", F.when(readable, chunk_words(text)).otherwise(F.array().cast("array<string>")))
        .withColumn(
            "embedding_status",
            F.when(~readable, F.concat(F.lit("failed:"), F.left(reason, F.lit(S.MAX_REASON_CHARS))))
            .when(is_blank(text), "failed:empty_text")
            .when(found == 0, "failed:no_usable_chunks")
            .otherwise("complete"),
        )
        .withColumn("chunk_count", found)
    )


def document_status(documents: DataFrame) -> DataFrame:
    return chunked(documents).drop("chunks", "text")


def chunk_table(documents: DataFrame) -> DataFrame:
    """document_id, portfolio_id, chunk_index, chunk_text; the first two and the
    index identify a chunk."""
    return chunked(documents).select(
        "document_id", "portfolio_id", F.posexplode("chunks").alias("chunk_index", "chunk_text")
    )


def hashed_terms(df: DataFrame, text: str, dims: int = 384) -> DataFrame:
    """Default encoder: unit-length hashed term counts in ``embedding``."""
    tokens = df.withColumn("_words", words(F.lower(text)))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def encode(df: DataFrame, text: str, encoder: Callable[[Column], Column] | None = None, dims: int = 384) -> DataFrame:
    """Adds ``embedding``; ``encoder`` may be any Column function, for example a
    pandas UDF around a model. Chunks and questions must share one."""
    if encoder is None:
        return hashed_terms(df, text, dims)
    return df.withColumn("embedding", encoder(F.col(text)))


# --- retrieval ------------------------------------------------------------------------
def checked_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Text and portfolio must be given, the portfolio as a
    UUID; ``top_k`` and ``threshold`` arrive as text, fall back to the defaults
    and are clamped."""
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    portfolio = trim_all(F.coalesce("portfolio_id", F.lit("")))
    question = trim_all(F.coalesce("question", F.lit("")))
    error = F.when(~portfolio.rlike(uuid), "portfolio_id must be a UUID").when(
        F.length(question) == 0, "question must be a non-empty string"
    )
    rows = questions.withColumns({"portfolio_id": portfolio, "question": question, "error": error})
    valid = rows.where("error is null").drop("error").withColumns(
        {
            "top_k": top_k_of(F.col("top_k")),
            "threshold": threshold_of(F.col("threshold")),
        }
    )
    return valid, rows.where("error is not null")


def _finite(text: Column, default: float) -> Column:
    number = F.trim(text.cast("string")).try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(usable, number).otherwise(float(default))


def top_k_of(text: Column) -> Column:
    bounded = F.least(F.lit(float(S.MAX_TOP_K)), F.greatest(F.lit(1.0), _finite(text, S.DEFAULT_TOP_K)))
    return F.floor(bounded + 0.5).cast("int")


def threshold_of(text: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _finite(text, S.DEFAULT_THRESHOLD)))


def top_matches(
    questions: DataFrame, chunks: DataFrame, key: str = "chunk_id",
    top_k: int = S.DEFAULT_TOP_K, threshold: float = S.DEFAULT_THRESHOLD,
    question_rows: int = QUESTION_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """question_id, portfolio_id, <key>, similarity, position: for every
    question the ``top_k`` most similar chunks of its portfolio at or above the
    threshold (applied before the limit). ``top_k`` and ``threshold`` columns of
    the questions override the arguments. Exact.

    Questions and chunks are packed into blocks within their portfolio, and
    every question block meets every chunk block of its portfolio once, as one
    matrix product. A meeting passes on the best ``top_k`` of each question, so
    k rows per question and block are shuffled; neither side goes through the
    driver or is broadcast, and a large portfolio is many meetings.
    """
    asked = questions.select(
        F.col("question_id"),
        F.col("portfolio_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("top_k") if "top_k" in questions.columns else F.lit(top_k)).cast("int").alias("top_k"),
        (F.col("threshold") if "threshold" in questions.columns else F.lit(threshold)).cast("double").alias("threshold"),
    ).where("embedding is not null")
    pool = chunks.select(F.col(key).alias("key"), "portfolio_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    met = _blocks(pool, "key", ["embedding"], chunk_rows, "chunks").join(
        _blocks(asked, "question_id", ["embedding", "top_k", "threshold"], question_rows, "questions"), "portfolio_id"
    )
    partial = T.StructType([
        T.StructField("question_id", asked.schema["question_id"].dataType), met.schema["portfolio_id"], T.StructField(key, chunks.schema[key].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("graded", T.DoubleType()), T.StructField("top_k", T.IntegerType()),
    ])
    found = met.select("portfolio_id", "questions", "chunks").mapInArrow(_best_per_question(key), partial)
    order = W.partitionBy("question_id").orderBy(F.col("graded").desc(), key)
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col("top_k")).drop("top_k", "graded")


def _blocks(rows: DataFrame, by: str, columns: list[str], size: int, name: str) -> DataFrame:
    """(portfolio_id, <name>): rows of a portfolio in blocks of about ``size``,
    sorted by their key."""
    counts = measured(rows.groupBy("portfolio_id").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n")))
    block = F.pmod(F.xxhash64(by), F.col("_n")).alias("_block")
    packed = rows.join(counts, "portfolio_id").groupBy("portfolio_id", block)
    return packed.agg(F.sort_array(F.collect_list(F.struct(by, *columns))).alias(name)).drop("_block")


def _unit(vectors: pa.Array) -> np.ndarray:
    matrix = np.array(vectors.to_pylist(), dtype=np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _best_per_question(key: str):
    """Task side: the best k per question of one question block in one chunk block."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, pool = batch.column(1)[i].values, batch.column(2)[i].values
                scores = _unit(asked.field("embedding")) @ _unit(pool.field("embedding")).T
                limit, wanted = asked.field("threshold").to_numpy(zero_copy_only=False), asked.field("top_k").to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore"):
                    question, column = np.nonzero(scores >= limit[:, None])
                similarity = scores[question, column]
                graded = np.round(similarity, 12)
                # columns follow the key, so a stable order breaks ties by key
                order = np.lexsort((column, -graded, question))
                question, column, similarity, graded = question[order], column[order], similarity[order], graded[order]
                stay = np.arange(len(question)) - np.searchsorted(question, question) < wanted[question]
                question, column = pa.array(question[stay]), pa.array(column[stay])
                yield pa.RecordBatch.from_arrays(
                    [asked.field("question_id").take(question), batch.column(0).take(pa.array(np.full(len(question), i))), pool.field("key").take(column),
                     pa.array(similarity[stay]), pa.array(graded[stay]), asked.field("top_k").take(question)],
                    names=["question_id", "portfolio_id", key, "similarity", "graded", "top_k"],
                )

    return score


# --- answers ----------------------------------------------------------------------------
def confidence(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """low without a match, high from 0.7 on, medium between."""
    best = matches.groupBy("question_id").agg(F.max("similarity").alias("top_similarity"))
    return questions.select("question_id").join(best, "question_id", "left").withColumn(
        "confidence",
        F.when(F.col("top_similarity").isNull(), "low")
        .when(F.col("top_similarity") >= S.HIGH_SIMILARITY, "high")
        .otherwise("medium"),
    )


def source_rows(matches: DataFrame, chunks: DataFrame, documents: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Matches with file name and a preview of the passage. Matches are few next
    to chunks; with their size known the texts are looked up without a shuffle."""
    texts = chunks.select(key, "document_id", "chunk_text")
    names = documents.select("document_id", F.col("filename").alias("document_filename"))
    return (
        measured(matches).join(texts, key)
        .join(names, "document_id", "left")
        .select(
            "question_id", "position", key, "similarity",
            F.coalesce("document_filename", F.lit("unknown")).alias("document_filename"),
            F.left("chunk_text", F.lit(S.PREVIEW_CHARS)).alias("preview"),
        )
    )


def context_text(questions: DataFrame, matches: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Numbered excerpts in rank order followed by the question (at most 20
    passages per question)."""
    texts = measured(matches).join(chunks.select(key, "chunk_text"), key)
    ordered = F.array_sort(F.collect_list(F.struct("position", "chunk_text")))
    excerpts = F.array_join(
        F.transform(ordered, lambda m: F.concat(F.lit("[C"), m["position"].cast("string"), F.lit("] "), m["chunk_text"])), "\n\n"
    )
    gathered = texts.groupBy("question_id").agg(excerpts.alias("excerpts"))
    return questions.select("question_id", "question").join(gathered, "question_id").select(
        "question_id",
        F.concat(F.lit("Excerpts:\n"), F.col("excerpts"), F.lit("\n\nQuestion: "), F.col("question")).alias("context"),
    )


def citations(answers: DataFrame, n_sources: Column) -> DataFrame:
    """One row per valid [C<n>] mark of an answer, in order of appearance; marks
    without a source stay plain text."""
    marks = F.regexp_extract_all("answer", F.lit(r"\[C(\d+)\]"), F.lit(1))
    return (
        answers.withColumn("n_sources", n_sources)
        .select("*", F.posexplode(marks).alias("mark", "_cited"))
        .withColumn("cited", F.col("_cited").try_cast("int"))
        .where((F.col("cited") >= 1) & (F.col("cited") <= F.col("n_sources")))
        .drop("_cited", "n_sources")
    )


def normalized_status(raw: Column) -> tuple[Column, Column]:
    """(status, reason): complete, pending or failed; unknown text is pending."""
    status = F.when(raw.isin("complete", "pending"), raw).when(raw.startswith("failed"), "failed").otherwise("pending")
    reason = F.when(raw.startswith("failed:"), F.nullif(F.substring(raw, 8, 2**31 - 1), F.lit("")))
    return status, reason


def index_ready(documents: DataFrame) -> DataFrame:
    return documents.groupBy("portfolio_id").agg(
        F.coalesce(F.bool_or(F.col("embedding_status") == "complete"), F.lit(False)).alias("ready")
    )


def reindex(chunks: DataFrame, documents: DataFrame, encoder: Callable[[Column], Column] | None = None, dims: int = 384) -> DataFrame:
    """Chunks after chunking ``documents`` again: their old chunks leave first,
    so running it twice changes nothing."""
    fresh = encode(chunk_table(documents), "chunk_text", encoder, dims)
    others = chunks.join(documents.select("document_id"), "document_id", "left_anti")
    return others.unionByName(fresh.select(*others.columns))


def reset_status(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"embedding_status": F.lit("pending"), "chunk_count": F.lit(0)})
