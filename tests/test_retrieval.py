import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelight.functions.text import chunk_words
from sitelight.operators import retrieval


def loop_chunks(text, size=400, step=350):
    tokens, out, start = text.split(), [], 0
    while start < len(tokens):
        out.append(" ".join(tokens[start:start + size]))
        if start + size >= len(tokens):
            break
        start += step
    return [c for c in out if len(c) >= 20]


def test_chunks_equal_a_loop(spark):
    texts = ["", "   \n", "short", "w " * 9 + "x"] + [" ".join(f"word{i}" for i in range(n)) for n in (1, 399, 400, 401, 750, 751, 1100, 2000)]
    texts.append("a b c﻿d " * 30)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunk_words(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == loop_chunks(t.replace("﻿", " ")), i
    with pytest.raises(ValueError):
        chunk_words(F.col("t"), 10, 10)


def test_status(spark):
    long = "word " * 30
    rows = [("a.txt", long), ("A.TXT", long), ("a.tar.pdf", long), ("noext", long), ("dot.", long), ("b.txt", " \n "), ("c.txt", "tiny"), ("d.txt", None)]
    df = spark.createDataFrame([(str(i), "p", f, t) for i, (f, t) in enumerate(rows)], "document_id string, portfolio_id string, filename string, text string")
    got = {r.filename: (r.embedding_status, r.chunk_count) for r in retrieval.document_status(df).collect()}
    assert got["a.txt"] == got["A.TXT"] == ("complete", 1)
    assert got["a.tar.pdf"][0] == "failed:unsupported_extension:pdf" and got["noext"][0] == "failed:unsupported_extension:noext"
    assert got["dot."][0] == "failed:unsupported_extension:none" and got["b.txt"][0] == got["d.txt"][0] == "failed:empty_text"
    assert got["c.txt"] == ("failed:no_usable_chunks", 0)
    ready = retrieval.index_ready(retrieval.document_status(df)).first()
    assert ready.ready


@pytest.mark.parametrize("limit", [1000, 16])
def test_matches_equal_brute_force(spark, limit):
    random = np.random.default_rng(2)
    chunks = random.normal(size=(700, 8))
    chunks[100:200] = chunks[100]  # equal vectors: the key decides
    home = np.where(np.arange(700) % 3 == 0, 1, 0)
    asked = np.r_[random.normal(size=(60, 8)), chunks[100:101], np.zeros((1, 8))]
    k, threshold = random.integers(1, 21, len(asked)), random.uniform(0, 0.6, len(asked))
    q = spark.createDataFrame([(i, int(i % 3 == 0), [float(x) for x in v], int(k[i]), float(threshold[i])) for i, v in enumerate(asked)],
                              "question_id int, portfolio_id int, embedding array<double>, top_k int, threshold double")
    c = spark.createDataFrame([(i, int(home[i]), [float(x) for x in v]) for i, v in enumerate(chunks)],
                              "chunk_id int, portfolio_id int, embedding array<double>").repartition(5)
    got = {}
    for r in retrieval.top_matches(q, c, question_rows=limit, chunk_rows=2 * limit).collect():
        got.setdefault(r.question_id, []).append((r.position, r.chunk_id))
    for i, v in enumerate(asked):
        if not v.any():
            assert i not in got
            continue
        sims = [(-round(float(v @ chunks[j] / np.linalg.norm(v) / np.linalg.norm(chunks[j])), 12), j) for j in range(700) if home[j] == int(i % 3 == 0)]
        best = [j for s, j in sorted(sims) if -s >= threshold[i]][: k[i]]
        assert [j for _, j in sorted(got.get(i, []))] == best, i


def test_no_questions(spark):
    empty = spark.createDataFrame([], "question_id int, portfolio_id int, embedding array<double>")
    chunks = spark.createDataFrame([(1, 1, [1.0])], "chunk_id int, portfolio_id int, embedding array<double>")
    assert retrieval.top_matches(empty, chunks).count() == 0


def test_questions(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [("a", f" {uuid.upper()} ", "why?", None, None), ("b", uuid, "why?", "2.5", "0.9"), ("c", uuid, "why?", "99", "-1"),
            ("d", uuid, "why?", "x", "NaN"), ("e", "nope", "why?", "1", "1"), ("f", uuid, " \n", "1", "1"), ("g", uuid, None, "1", "1")]
    df = spark.createDataFrame(rows, "id string, portfolio_id string, question string, top_k string, threshold string")
    valid, rejected = retrieval.checked_questions(df)
    assert {r.id: (r.top_k, r.threshold) for r in valid.collect()} == {"a": (3, 0.5), "b": (3, 0.9), "c": (20, 0.0), "d": (3, 0.5)}
    assert {r.id: r.error.split()[0] for r in rejected.collect()} == {"e": "portfolio_id", "f": "question", "g": "question"}


def test_answer_parts(spark):
    df = spark.createDataFrame([("see [C2], [C0], [C9] and [C1] [Cx] [C99999999999]",)], "answer string")
    assert [r.cited for r in retrieval.citations(df, F.lit(3)).collect()] == [2, 1]
    raw = spark.createDataFrame([("complete",), ("failed",), ("failed:x:y",), ("failed:",), ("odd",), ("pending",)], "s string")
    got = [tuple(r) for r in raw.select(*retrieval.normalized_status(F.col("s"))).collect()]
    assert got == [("complete", None), ("failed", None), ("failed", "x:y"), ("failed", None), ("pending", None), ("pending", None)]


def test_search_by_text(spark):
    documents = spark.createDataFrame(
        [("d1", "p", "crane.txt", "crane inspection schedule for the northern tower site"), ("d2", "p", "food.txt", "lunch menu with soup and bread for everybody today"),
         ("d3", "other", "x.txt", "crane inspection schedule for the northern tower site")],
        "document_id string, portfolio_id string, filename string, text string")
    chunks = retrieval.encode(retrieval.chunk_table(documents), "chunk_text").withColumn("chunk_id", F.concat_ws("-", "document_id", "chunk_index"))
    questions = retrieval.encode(spark.createDataFrame([("q", "p", "crane inspection schedule"), ("z", "p", "unrelated words")],
                                 "question_id string, portfolio_id string, question string"), "question")
    matches = retrieval.top_matches(questions, chunks, threshold=0.3)
    assert [(r.question_id, r.chunk_id) for r in matches.collect()] == [("q", "d1-0")]
    row = retrieval.source_rows(matches, chunks, documents).first()
    assert row.document_filename == "crane.txt" and row.preview.startswith("crane")
    context = retrieval.context_text(questions, matches, chunks).first().context
    assert context == "Excerpts:\n[C1] crane inspection schedule for the northern tower site\n\nQuestion: crane inspection schedule"
    assert {r.question_id: r.confidence for r in retrieval.confidence(questions, matches).collect()} == {"q": "medium", "z": "low"}
    again = retrieval.reindex(chunks.drop("chunk_id"), documents.where("document_id = 'd1'"))
    assert again.count() == 3
