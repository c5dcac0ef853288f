"""Language identification by segmentation-marginalised unigrams.

For every language the pieces of a fixed public vocabulary get probabilities.
A word's probability is the sum over all ways to segment it into pieces, by the
forward algorithm; a text's is the product over its words (runs of letters,
lower-cased) and the language's share of the training rows. Words are scored in
batches, all words of one length at a time, each distinct word once.

Fitting is expectation maximisation: forward and backward sums give the
expected use of every piece, tasks add up their words, and only the table of
pieces by languages reaches the driver, whose size the vocabulary bounds.
Piece probabilities are fitted on about ``sample`` rows per language, chosen by
a hash of id and text; language shares count all rows.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and whenever nothing was learned; rows without language or text are not learned
from; a run of over 32 letters is scored in parts of 32; ties go to the first
language in text order; empty tables give empty results. All columns are kept,
``lang_pred`` and ``score`` are added or replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight.llm.common import Scratch
from sitelight.llm.words import slices

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
#: What a single character outside the vocabulary is worth in every language.
STRANGE = 1e-7
REMEMBERED = 200_000
#: Words that are scored, and words of texts that are split, at a time.
WORDS_AT_ONCE, BYTES_AT_ONCE = 20_000, 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[str]:
    """The vocabulary's lower-case pieces of letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in names if p == p.lower() and (body := p.removeprefix("▁")) and body.isalpha() and len(p) <= LONGEST})


def words_of(text: str) -> list[str]:
    found = LETTERS.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def has_letter(text: str | None, words: list[str]) -> bool:
    return text is not None and (any(w.isalpha() for w in words) or any(c.isalpha() for c in text))


def _key(text: str) -> np.uint64:
    value = 0
    for c in text:
        value = (value * int(MULTIPLIER) + ord(c) + 1) % 2**64
    return np.uint64(value)


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes of the pieces
    longest: int

    @staticmethod
    def of(pieces: list[str]) -> Vocabulary:
        keys = np.sort(np.array([_key(p) for p in pieces], dtype=np.uint64))
        if len(np.unique(keys)) != len(pieces):
            raise ValueError("two pieces share a hash")
        return Vocabulary(keys, max(map(len, pieces)))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers; the number of pieces where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys))


def spans(vocabulary: Vocabulary, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
    """Piece number of every stretch of the marked words, all of ``n`` letters."""
    codes = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n + 1).astype(np.uint64) + np.uint64(1)
    found = {}
    for i in range(n + 1):
        key = np.zeros(len(words), dtype=np.uint64)
        for j in range(i + 1, min(n + 1, i + vocabulary.longest) + 1):
            key = key * MULTIPLIER + codes[:, j - 1]
            found[i, j] = vocabulary.lookup(key)
    return found


def worth(table: np.ndarray, numbers: np.ndarray, width: int) -> np.ndarray:
    """Probabilities by language; a lone character is never worth less than STRANGE."""
    values = table[numbers]
    return np.maximum(values, STRANGE) if width == 1 else values


def forward(table: np.ndarray, found: dict, n: int, rows: int) -> list[np.ndarray]:
    sums = [np.ones((rows, table.shape[1]))] + [np.zeros((rows, table.shape[1])) for _ in range(n + 1)]
    for (i, j), numbers in sorted(found.items(), key=lambda x: x[0][1]):
        sums[j] += sums[i] * worth(table, numbers, j - i)
    return sums


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def log_words(vocabulary: Vocabulary, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]), dtype=np.float32)
    for n, at in by_length(words):
        for some in np.array_split(at, -(-len(at) * (n + 1) // WORDS_AT_ONCE)):
            group = [words[i] for i in some]
            out[some] = np.log(forward(table, spans(vocabulary, group, n), n, len(group))[n + 1])
    return out


def expected(vocabulary: Vocabulary, table: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in every language."""
    total = np.zeros_like(table)
    for n, at in by_length(words):
        group = [words[i] for i in at]
        found = spans(vocabulary, group, n)
        ahead = forward(table, found, n, len(group))
        behind = [np.zeros_like(ahead[0]) for _ in range(n + 2)]
        behind[n + 1] += counts[at] / ahead[n + 1]
        for (i, j), numbers in sorted(found.items(), key=lambda x: -x[0][0]):
            through = worth(table, numbers, j - i) * behind[j]
            behind[i] += through
            use = ahead[i] * through
            for lang in range(table.shape[1]):
                total[:, lang] += np.bincount(numbers, use[:, lang], len(table))
    return total


@dataclass
class Model:
    languages: list[str]
    shares: np.ndarray
    pieces: list[str]
    table: np.ndarray  # probability by piece (and one row of zeros for none) and language


def fit(labelled: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = 1000, rounds: int = 3, smoothing: float = 0.1) -> Model:
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, pieces = sorted(shares), read_pieces(path)
    share = np.array([shares[lang] for lang in languages], dtype=float)
    table = np.vstack([np.full((len(pieces), len(languages)), 1 / len(pieces)), np.zeros((1, len(languages)))])
    if not languages:
        return Model([], share, pieces, table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    # rows with a small hash, so many as give the sample on average; no rows meet for it
    portion = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / shares[lang])))])
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(2**31)) < portion[F.col("lang")] * 2**31)
    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    per_language = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("double") for lang in languages]
    scratch = Scratch(labelled.sparkSession)
    words = scratch.write(counted.groupBy("word").agg(F.array(*per_language).alias("counts")), "lang-words")
    spark, width = labelled.sparkSession, len(languages)
    layout = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("uses", T.ArrayType(T.DoubleType()))])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, table))

        def tally(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, now = shared.value
            vocabulary, total = Vocabulary.of(names), np.zeros_like(now)
            now = _ordered(vocabulary, names, now)
            for batch in batches:
                if batch.num_rows:
                    n = np.array(batch.column(1).values.to_numpy()).reshape(-1, width)
                    total += expected(vocabulary, now, batch.column(0).to_pylist(), n)
            total = _unordered(vocabulary, names, total)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["piece", "uses"])

        uses = words.repartition(max(2, spark.sparkContext.defaultParallelism)).mapInArrow(tally, layout)
        sums = uses.groupBy("piece").agg(*[F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(width)]).toPandas()
        total = np.zeros_like(table)
        total[sums["piece"].to_numpy()] = sums[[f"u{i}" for i in range(width)]].to_numpy()
        total[:-1] += smoothing
        total[-1] = 0
        table = total / total.sum(axis=0)
        shared.unpersist()
    scratch.drop("lang-words")
    return Model(languages, share / share.sum(), pieces, table)


def _ordered(vocabulary: Vocabulary, pieces: list[str], table: np.ndarray) -> np.ndarray:
    """Rows in the order of the sorted hashes."""
    return np.vstack([table[:-1][np.argsort(np.array([_key(p) for p in pieces], dtype=np.uint64))], table[-1:]])


def _unordered(vocabulary: Vocabulary, pieces: list[str], table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(table)
    out[np.argsort(np.array([_key(p) for p in pieces], dtype=np.uint64))] = table[:-1]
    return out


class Scorer:
    """Texts to (language, posterior), with a bounded memory of words."""

    def __init__(self, model: Model):
        self.model = model
        self.vocabulary = Vocabulary.of(model.pieces)
        self.table = _ordered(self.vocabulary, model.pieces, model.table)
        self.prior = np.log(model.shares)
        self.number: dict[str, int] = {}
        self.logs = np.zeros((REMEMBERED, len(model.languages)), dtype=np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        words = [[] if t is None else words_of(t) for t in texts]
        needed = set().union(*words)
        missing = sorted(needed.difference(self.number))
        if len(self.number) + len(missing) > REMEMBERED:
            self.number.clear()
            missing = sorted(needed)
        if len(missing) > len(self.logs):
            self.logs = np.zeros((len(missing), self.logs.shape[1]), dtype=np.float32)
        if missing:
            known = len(self.number)
            self.logs[known : known + len(missing)] = log_words(self.vocabulary, self.table, missing)
            self.number.update(zip(missing, range(known, known + len(missing)), strict=True))
        langs, scores = [], []
        for text, row in zip(texts, words, strict=True):
            if not has_letter(text, row):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.prior + self.logs[[self.number[w] for w in row]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predicted(model: Model, text: Column, spark) -> Column:
    """Struct column (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:
            langs, scores = [], []
            for some in slices([pa.record_batch([part], names=["text"])], "text", BYTES_AT_ONCE):
                found = scorer(some.column(0).to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
        del scorer
        pa.default_memory_pool().release_unused()

    return score(text)


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    scored = docs.withColumn("__lang", predicted(model, F.col(text_column).cast("string"), docs.sparkSession))
    return scored.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")
