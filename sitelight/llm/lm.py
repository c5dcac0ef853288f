"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to levels of half powers of
two, and an n-gram enters the filter once per level up to its own. A lookup
probes level after level until one is missing; the last one found gives the
count. The filter is split by key hash into slices, as many as the n-grams need;
each is filled in the task that looks up what the texts ask of it, and is not
gathered anywhere.

p(w | h) = max(0, c(h w) - D) / c(h) + g(h) * p(w): absolute discounting over
the unigram p(w) = (c(w) + 1/2) / (N + (V + 1) / 2). The mass g(h) that h's
known pairs leave is exact for the frequent words, whose counts are broadcast,
and the mean of h's count level for the others.

Size bounds, whatever the corpus: ``frequent`` words at most in the exact list;
about ``entries`` in a slice of the filter (11.6 bits each, error rate 1/256).
The number of slices follows from the exact histogram of all levels and from the
texts to be scored, so every n-gram that was counted is held, those that occur
once too. Texts ask in batches of about 4 MB, one packed row per batch and slice,
and the answers meet the batch again, so no key is hot. Words are compared by
64-bit hashes, words inside pairs by 32 bits, n-grams inside a slice by 40.

The exact unigram score is made from the frequent list inside the pass, and
from a join of the rarer words with all exact counts; a rarer word has few rows
by definition, so no join key is hot.

Defined results: null texts are empty and consist of the end alone; without
training rows every count is 0, N is 0 and V is 0; null ids count as the empty
text for the fold; repeated rows are trained on and scored as often as they
occur; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight.llm.common import Scratch
from sitelight.llm.words import ODD, mixed, slices, word_hashes

#: The end of a text: its hash stands for a word that no text can hold.
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))
PROBES, BLOCK_BITS, BITS_PER_ENTRY = 8, 2**16, 8 / math.log(2)
DISCOUNT = 0.75
COUNTED = 2_000_000
# N-grams and questions meet in so many parts, one after the other: what they
# shuffle is most of what lies on disk then.
ANSWER_PARTS = 2
# Keys that are looked up together.
LOOKED_UP = 2**18
WORD_SALT, PAIR_SALT = np.uint64(0x51ED270B35AE4F8D), np.uint64(0xA24BAED4963EE407)


def level_of(count: str) -> Column:
    """1, 3, 4, 5, 5, 6 ... for the counts 1, 2, 3, 4, 5, 6 ..."""
    return (F.floor(2 * F.log2(F.col(count)) + 1e-9) + 1).cast("int")


def count_of(level: np.ndarray) -> np.ndarray:
    """What an n-gram of that level counts as; 0 for level 0."""
    level = np.asarray(level, dtype=float)
    middle = 2 ** ((level - 0.5) / 2)
    return np.select([level < 1, level < 3, level < 4, level < 5], [0.0, 1.0, 2.0, 3.0], middle)


# --- the filter -------------------------------------------------------------------
def word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words ^ WORD_SALT)


def pair_keys(pairs: np.ndarray) -> np.ndarray:
    return mixed(pairs ^ PAIR_SALT)


def blocks_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def probes(keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bit position inside the key's block, and the step to the next one.
    A block has 2^16 bits, so that both are taken modulo its size by their type."""
    h = mixed(keys * ODD[0] + level.astype(np.uint64) * ODD[1])
    return h.astype(np.uint16), (h >> np.uint64(32)).astype(np.uint16) | np.uint16(1)


def places(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Bit positions inside the key's block, one row per key."""
    first, step = probes(keys, level)
    return first[:, None] + np.arange(PROBES, dtype=np.uint16) * step[:, None]


@dataclass
class LogFrequencyFilter:
    blocks: int
    least: int  # the level that level 1 of the filter stands for
    words: np.ndarray  # blocks x words of 64 bits, flat

    def holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        """A key leaves at its first bit that is not set: half of those not held do at once."""
        at, step = probes(keys, np.full(len(keys), level))
        octets = self.words.view(np.uint8)
        block = blocks_of(keys, self.blocks).astype(np.int64) * (BLOCK_BITS // 8)
        alive = np.arange(len(keys))
        for _ in range(PROBES):
            there = (octets[block + (at >> np.uint16(3))] >> (at & np.uint16(7)).astype(np.uint8)) & np.uint8(1) > 0
            if not there.all():
                alive, at, step, block = alive[there], at[there], step[there], block[there]
            at = at + step
        out = np.zeros(len(keys), dtype=bool)
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised level of each n-gram, 0 for those not held."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive, level = np.arange(len(keys)), 1
        while self.blocks and len(alive):
            alive = alive[self.holds(keys[alive], level)]
            out[alive] = self.least + level - 1
            level += 1
        return out


def build_filter(ngrams: DataFrame, least: int, entries: int) -> LogFrequencyFilter:
    """From (kind, item, level): blocks are filled in parallel, one group each."""
    blocks = math.ceil(entries * BITS_PER_ENTRY / BLOCK_BITS)
    if not blocks:
        return LogFrequencyFilter(0, least, np.zeros(0, dtype=np.uint64))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, item = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            keys = np.where(kind == 1, word_keys(item), pair_keys(item))
            block = blocks_of(keys, blocks).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(keys.view(np.int64)), batch.column(2)], names=["block", "item", "level"])

    def fill(group: pa.Table) -> pa.Table:
        keys = group["item"].to_numpy().view(np.uint64)
        n = group["level"].to_numpy() - least + 1
        row = np.repeat(np.arange(len(keys)), n)
        level = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
        bits = np.zeros(BLOCK_BITS, dtype=bool)
        bits[places(keys[row], level).ravel()] = True
        return pa.table({"block": group["block"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = ngrams.mapInArrow(keyed, "block int, item long, level int").groupBy("block").applyInArrow(fill, "block int, bits binary").toArrow()
    words = np.zeros((blocks, BLOCK_BITS // 64), dtype=np.uint64)
    for block, bits in zip(rows["block"].to_pylist(), rows["bits"], strict=True):
        words[block] = np.frombuffer(bits.as_buffer(), dtype="<u8")
    return LogFrequencyFilter(blocks, least, words.ravel())


def filter_of(keys: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
    """The filter of n-grams that are at hand."""
    blocks = math.ceil(int(levels.sum()) * BITS_PER_ENTRY / BLOCK_BITS)
    bits = np.zeros(blocks * BLOCK_BITS, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = keys[levels >= level]
        block = blocks_of(some, blocks).astype(np.int64) * BLOCK_BITS
        at, step = probes(some, np.full(len(some), level))
        for _ in range(PROBES):
            bits[block + at] = True
            at = at + step
    return LogFrequencyFilter(blocks, 1, np.packbits(bits, bitorder="little").view("<u8"))


# --- slices of the filter -----------------------------------------------------------
def dealt(keys: np.ndarray, slices_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys by slice, the slices that occur, where each begins and the end)."""
    number = ((keys >> np.uint64(40)) * np.uint64(slices_)) >> np.uint64(24)
    if slices_ <= 2**16:  # short numbers are sorted by their digits
        number = number.astype(np.uint16)
    order = np.argsort(number, kind="stable")
    found, first = np.unique(number[order], return_index=True)
    return order, found.astype(np.int32), np.append(first, len(keys))


def packed(values: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """The low bytes of the values, one binary per stretch between bounds."""
    flat = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return pa.array([flat[width * a : width * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def slice_keys(data: bytes) -> np.ndarray:
    """Keys inside a slice, from their low five bytes."""
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return mixed(out.view("<u8").ravel())


def _dealt_counts(slices_: int):
    """(slice, keys, levels) packed, of (kind, item, level)."""
    names = ["slice", "keys", "levels"]

    def packed_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, levels = (np.concatenate(x) for x in zip(*held, strict=True))
        order, found, bounds = dealt(keys, slices_)
        return pa.RecordBatch.from_arrays([pa.array(found), packed(keys[order], 5, bounds), packed(levels[order], 1, bounds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            kind, item = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            held.append((np.where(kind == 1, word_keys(item), pair_keys(item)), batch.column(2).to_numpy()))
            if sum(len(x[0]) for x in held) > COUNTED:
                yield packed_rows(held)
                held.clear()
        if held:
            yield packed_rows(held)

    return run


def _answered(counts: pa.Table, asked_: pa.Table) -> pa.Table:
    """(batch, slice, levels) of what batches ask of one slice."""
    keys = slice_keys(b"".join(counts["keys"].to_pylist()))
    levels = np.frombuffer(b"".join(counts["levels"].to_pylist()), dtype=np.uint8)
    filter_ = filter_of(keys, levels.astype(np.int64)) if asked_.num_rows else None
    questions, found = asked_["keys"].to_pylist(), []
    # a batch asks few keys of a slice: many batches are looked up at a time
    ends = np.cumsum([len(x) // 5 for x in questions])
    for part in np.split(np.arange(len(questions)), np.flatnonzero(np.diff(ends // LOOKED_UP)) + 1):
        together = filter_.levels(slice_keys(b"".join(questions[i] for i in part))).astype(np.uint8).tobytes() if len(part) else b""
        begin = ends[part[0]] - len(questions[part[0]]) // 5 if len(part) else 0
        found += [together[ends[i] - len(questions[i]) // 5 - begin : ends[i] - begin] for i in part]
    return pa.table({"batch": asked_["batch"], "slice": asked_["slice"], "levels": pa.array(found, pa.binary())})


# --- counting ------------------------------------------------------------------------
def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words with an end after each text, start of each text)."""
    words, offsets = word_hashes(texts)
    return np.insert(words, offsets[1:], END), offsets[:-1] + np.arange(len(texts))


def pairs_of(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (before << np.uint64(32)) | (words & np.uint64(0xFFFFFFFF))


def preceding(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; the end, where a text starts."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = END
    return before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counts() -> Iterator[pa.RecordBatch]:
        for kind in (1, 2):
            item, n = np.unique(np.concatenate([x[kind - 1] for x in held]), return_counts=True)
            for at in range(0, len(item), 500_000):
                some = slice(at, at + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(item[some]), kind, np.int32)), pa.array(item[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["kind", "item", "n"]
                )

    for batch in slices(batches, "text"):
        words, starts = sequences(batch.column(0))
        held.append((words, pairs_of(words, preceding(words, starts))))
        if sum(len(x[0]) for x in held) > COUNTED:
            yield from counts()
            held.clear()
    if held:
        yield from counts()


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    filter: LogFrequencyFilter | None  # whole, where it is at hand
    words: np.ndarray  # frequent words: sorted hashes, counts, left mass
    counts: np.ndarray
    left: np.ndarray
    left_by_level: np.ndarray
    entries: int  # of the whole filter
    slices: int = 1

    @property
    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def measure(train: DataFrame, scratch: Scratch, text_column: str, frequent: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model without its filter, the exact counts (word, n) of the words that
    are not listed, and the filter's n-grams (kind, item, level)."""
    texts = train.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count, "kind int, item long, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    stored = scratch.write(counted.withColumn("level", level_of("n")), "lm-counts")
    words, pairs = stored.where("kind = 1"), stored.where("kind = 2")
    shape = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = shape.n or 0, shape.v

    by_level = {(r.kind, r.level): r.rows for r in stored.groupBy("kind", "level").agg(F.count("*").alias("rows")).collect()}
    top = max((level for _, level in by_level), default=0)
    word_rows = {level: by_level.get((1, level), 0) for level in range(1, top + 1)}
    common, listed = top + 1, 0  # words of this level and above are listed with exact counts
    while common > 1 and listed + word_rows[common - 1] <= frequent:
        common -= 1
        listed += word_rows[common]

    entries = sum(rows * level for (kind, level), rows in by_level.items() if kind == 2 or level < common)
    held = stored.where((F.col("kind") == 2) | (F.col("level") < common)).select("kind", "item", "level")

    # the mass that the pairs of each word take
    midpoints = F.array(*[F.lit(float(c)) for c in count_of(np.arange(top + 1))])
    taken = pairs.groupBy(F.shiftrightunsigned("item", 32).alias("short")).agg(F.sum(midpoints[F.col("level")] - DISCOUNT).alias("taken"))
    heads = words.select(F.col("item").alias("word"), "n", "level", F.expr("item & 4294967295L").alias("short")).join(taken, "short", "left")
    heads = scratch.write(heads.withColumn("taken", F.least(F.coalesce("taken", F.lit(0.0)), F.col("n") - DISCOUNT)), "lm-heads")
    list_ = heads.where(F.col("level") >= common).select("word", "n", (1 - F.col("taken") / F.col("n")).alias("left")).toPandas()
    means = heads.groupBy("level").agg((1 - F.sum("taken") / F.sum("n")).alias("left")).collect()
    left_by_level = np.ones(top + 2)
    for row in means:
        left_by_level[row.level] = row.left
    hashes = list_["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(tokens, distinct, None, hashes[order], list_["n"].to_numpy(np.int64)[order], list_["left"].to_numpy(float)[order], left_by_level, entries)
    return model, heads.where(F.col("level") < common).select("word", "n"), held


def fit(train: DataFrame, scratch: Scratch, text_column: str = "text", frequent: int = 2**19) -> tuple[Model, DataFrame]:
    """The model with its filter in one piece, where that fits into memory, and
    the exact counts (word, n) of the words that are not listed."""
    model, rarer, ngrams = measure(train, scratch, text_column, frequent)
    model.filter = build_filter(ngrams, 1, model.entries)
    scratch.drop("lm-counts")
    return model, rarer


def _tokens(texts: DataFrame) -> int:
    """An upper bound of the number of words: every second byte, and the ends."""
    return texts.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2) + 1).alias("n")).first().n or 0


# --- scoring ----------------------------------------------------------------------------
@dataclass
class Asked:
    """What a batch of texts asks of the model."""

    distinct: np.ndarray  # words, and the end
    own: np.ndarray  # number of each token among them, and of the token before it
    before: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray  # number of each token's pair
    listed: np.ndarray  # of the distinct words, and their places in the list
    at: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate([word_keys(self.distinct[~self.listed]), pair_keys(self.pairs)])


def asked(model: Model, words: np.ndarray, starts: np.ndarray) -> Asked:
    distinct, back = np.unique(np.append(words, END), return_inverse=True)
    before = np.empty(len(words), dtype=np.int64)
    before[1:] = back[: len(words) - 1]
    before[starts] = back[-1]
    pairs, pair = np.unique(pairs_of(words, distinct[before]), return_inverse=True)
    at = np.minimum(np.searchsorted(model.words, distinct), max(len(model.words) - 1, 0))
    listed = model.words[at] == distinct if len(model.words) else np.zeros(len(distinct), bool)
    return Asked(distinct, back[: len(words)], before, pairs, pair, listed, at)


def log_probabilities(model: Model, words: np.ndarray, starts: np.ndarray, levels: np.ndarray | None = None, ask: Asked | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: model's log10 probability, whether its word is listed, its
    looked-up count. ``levels`` are those of the keys that the texts ask for,
    ``ask`` what they ask, where it is known already."""
    ask = asked(model, words, starts) if ask is None else ask
    levels = model.filter.levels(ask.keys) if levels is None else levels
    word_levels, pair_levels = np.split(levels.astype(np.int64), [int((~ask.listed).sum())])
    count, left = np.zeros(len(ask.distinct)), np.ones(len(ask.distinct))
    count[ask.listed], left[ask.listed] = model.counts[ask.at[ask.listed]], model.left[ask.at[ask.listed]]
    count[~ask.listed] = count_of(word_levels)
    left[~ask.listed] = np.where(word_levels > 0, model.left_by_level[np.minimum(word_levels, len(model.left_by_level) - 1)], 1.0)
    pair_count, known = count_of(pair_levels)[ask.pair], count[ask.before]
    direct = np.where((pair_count > 0) & (known > 0), np.maximum(0, np.minimum(pair_count, known) - DISCOUNT) / np.maximum(known, 1), 0)
    base = (count[ask.own] + 0.5) / model.scale
    return np.log10(np.minimum(1, direct + left[ask.before] * base)), ask.listed[ask.own], count[ask.own]


def _asked(shared):
    """The texts in numbered batches, and per batch and slice the keys it asks for."""
    names = ["batch", "uid", "row", "text", "slice", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, batch_id = shared.value, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            words, starts = sequences(batch.column(2))
            keys = asked(model, words, starts).keys
            order, found, bounds = dealt(keys, model.slices)
            n, m = batch.num_rows, len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch_id)), *batch.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            none = [pa.nulls(m, column.type) for column in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, batch_id)), *none, pa.array(found), packed(keys[order], 5, bounds)], names=names)
            batch_id += 1

    return run


def _score(shared):
    names = ["uid", "row", "n_tokens", "n_known", "base", "score", "word", "times"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        rows, answers = rows.sort_by("uid").combine_chunks(), answers.sort_by("slice")
        uid, own, text = (rows[c].combine_chunks() for c in ("uid", "row", "text"))
        words, starts = sequences(text)
        sizes = np.diff(np.append(starts, len(words)))
        ask = asked(model, words, starts)
        order, _, _ = dealt(ask.keys, model.slices)
        levels = np.empty(len(order), dtype=np.uint8)
        levels[order] = np.frombuffer(b"".join(answers["levels"].to_pylist()), dtype=np.uint8)
        logs, listed, count = log_probabilities(model, words, starts, levels, ask)
        base = np.where(listed, np.log10((count + 0.5) / model.scale), 0)
        sums = [np.add.reduceat(x, starts) for x in (listed.astype(np.int64), base, logs)]
        none = pa.nulls(len(sizes), pa.int64())
        whole = pa.table([uid, own, pa.array(sizes), *map(pa.array, sums), none, none], names=names)
        row = np.repeat(np.arange(len(sizes)), sizes)[~listed]
        order = np.lexsort((words[~listed], row))
        row, rare = row[order], words[~listed][order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])]) if len(row) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(row)])
        n, f = pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.float64())
        rest = pa.table([uid.take(pa.array(row[new])), pa.nulls(len(new), own.type), n, n, f, f, pa.array(rare[new].view(np.int64)), pa.array(times.astype(np.int64))], names=names)
        return pa.concat_tables([whole, rest])

    return run


def score(docs: DataFrame, train: DataFrame, text_column: str = "text", frequent: int = 2**19, entries: int = 2**20) -> DataFrame:
    """``docs`` without their text, with n_tokens, n_known, train_tokens,
    base_score and score. A slice of the filter has about ``entries``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    model, rarer, ngrams = measure(train, scratch, text_column, frequent)
    own = [c for c in docs.columns if c not in (text_column, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*own).alias("row"), text)
    model.slices = max(1, math.ceil(model.entries / entries), math.ceil(_tokens(rows) / (4 * entries)))
    shared = spark.sparkContext.broadcast(model)
    kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    layout = T.StructType([T.StructField("batch", T.LongType()), *kinds, T.StructField("slice", T.IntegerType()), T.StructField("keys", T.BinaryType())])
    # what lies on disk at once: the counts go before texts and keys are written,
    # and whole texts, which compress well, are kept small
    dealt_ = scratch.write(ngrams.mapInArrow(_dealt_counts(model.slices), "slice int, keys binary, levels binary"), "lm-dealt")
    scratch.drop("lm-counts")
    asking = scratch.write(rows.mapInArrow(_asked(shared), layout), "lm-asked", compression="zstd")
    keys = asking.where("slice IS NOT NULL").select("slice", "batch", "keys")
    answered = []
    for part in range(min(ANSWER_PARTS, model.slices)):
        own_part = F.col("slice") % ANSWER_PARTS == part
        met = dealt_.where(own_part).groupBy("slice").cogroup(keys.where(own_part).groupBy("slice"))
        answered.append(scratch.write(met.applyInArrow(_answered, "batch long, slice int, levels binary"), f"lm-answers-{part}"))
    answers = reduce(DataFrame.unionByName, answered)
    scratch.drop("lm-dealt")
    batches = asking.where("slice IS NULL").select("batch", "uid", "row", "text")
    numbers = T.StructType().add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double").add("word", "long").add("times", "long")
    # rows of rare words carry no row of the document's
    layout = T.StructType([kinds["uid"], kinds["row"], *numbers])
    scored = scratch.write(batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(shared), layout), "lm-scored")
    scratch.drop("lm-asked", *[f"lm-answers-{part}" for part in range(len(answered))])
    rare = scored.where("word IS NOT NULL").select("uid", "word", "times").join(rarer, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.scale))
    rest = rare.groupBy("uid").agg(F.sum(F.col("times") * log).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    whole = scored.where("word IS NULL").join(rest, "uid", "left")
    return whole.select(
        *[F.col(f"row.{c}") for c in own], "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
