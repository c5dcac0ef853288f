"""Ranked lexical search by bag deduplication.

Terms are maximal runs of ASCII letters and digits and of everything beyond
ASCII, with A-Z lower-cased. Texts are read once per block of items: each
becomes a bag, its counts of the terms that items use, and its number of terms.
What a document scores depends on its bag and on its length penalty m alone, so
documents fall into classes of equal (bag, m): told apart by a hash, and by
comparing the bytes under that hash. A class is scored once for all items, and
its members follow by ascending id. No item needs more than its k first classes,
nor of a class more than its k smallest ids, so tasks send k rows per class and
k rows per item; both limits hold before rows are shuffled.

Items come in blocks of at most ``ITEMS`` rows and about ``ITEM_BYTES`` of text,
so what the driver numbers and broadcasts (a block's terms and its items' term
lists) has a bound; more items mean more blocks, each against all documents.
A task meets its classes with a block's items through lists from term to items.

Scores are whole numbers: products are added in doubles while no sum can reach
2^53, else in longs. Weights of terms are computed in doubles.

Defined results: null and empty texts and texts without terms count nowhere and
are never found; a repeated document row is a document of its own; a null
document id comes last among equal scores; a repeated item row is answered as
often; an item whose terms no document has gets no row; no documents or no items
give an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelight.llm.common import Scratch, list_values
from sitelight.llm.words import slices

#: Items and bytes of item text in a block.
ITEMS, ITEM_BYTES = 4096, 2**20
#: Scores (classes x items) and products that are worked on at a time.
CELLS, PRODUCTS = 2**20, 2**21
#: Lists that one merge of top lists takes.
FAN = 64

#: What a byte counts as: its lower case in a term, zero between terms.
TERM_BYTE = np.array([b if b >= 0x80 or chr(b).isalnum() else 0 for b in range(256)], dtype=np.uint8)
TERM_BYTE[ord("A") : ord("Z") + 1] += 0x20
#: A pair of term number and count in a bag.
PAIR = np.dtype([("term", "<u4"), ("tf", "<u4")])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts in order, offsets per text)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = TERM_BYTE[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    bounds = ends[(ends > 0) & (ends < len(data))]
    start[bounds] = inside[bounds]
    place = np.cumsum(inside) - inside
    offsets = np.append(place[start], inside.sum()).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())])
    return terms, np.r_[0, np.cumsum(start)][ends]


def _bags(vocabulary):
    """(doc_id, n, bag): the number of terms, and (term, tf) by ascending term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms, offsets = terms_of(batch.column(1))
            encoded = terms.dictionary_encode()
            number = pc.fill_null(pc.index_in(encoded.dictionary, value_set=vocabulary.value), -1).to_numpy().astype(np.int64)
            known = number[encoded.indices.to_numpy()]
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            kept = known >= 0
            pair, tf = np.unique((text[kept] << 32) | known[kept], return_counts=True)
            bag = np.empty(len(pair), dtype=PAIR)
            bag["term"], bag["tf"] = pair & 0xFFFFFFFF, tf
            cuts = np.searchsorted(pair >> 32, np.arange(len(offsets))) * PAIR.itemsize
            bags = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(bag.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), bags.cast(pa.binary())], names=["doc_id", "n", "bag"])

    return run


def _document_frequency(terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            df += np.bincount(_pairs(batch.column(0))["term"], minlength=terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["term", "df"])

    return run


def _pairs(bags: pa.Array) -> np.ndarray:
    size = pc.binary_length(bags).to_numpy()
    first = bags.buffers()[1]
    at = int(np.frombuffer(first, dtype=np.int32, count=1, offset=4 * bags.offset)[0]) if len(bags) else 0
    return np.frombuffer(bags.buffers()[2] or b"", dtype=PAIR, offset=at, count=int(size.sum()) // PAIR.itemsize)


class Items:
    """A block's items as lists from term to (item, times it is asked)."""

    def __init__(self, lists: list[np.ndarray], weight: np.ndarray):
        item = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        pair, times = np.unique((np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64) << 32) | item, return_counts=True)
        term = pair >> 32
        self.n = len(lists)
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.item, self.times, self.weight = pair & 0xFFFFFFFF, times, weight
        #: No score of a document exceeds this.
        self.reach = int(np.bincount(self.item, weights=times * weight[term], minlength=1).max(initial=0)) * 1_000_000

    def scores(self, row: np.ndarray, pairs: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
        """(rows x items) scores of bags given as (row, pair) and the rows' m."""
        term, tf = pairs["term"].astype(np.int64), pairs["tf"].astype(np.int64)
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        spread = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
        cell = np.repeat(row, spread) * self.n + self.item[at]
        part = np.repeat(value, spread) * self.times[at]
        if self.reach < 2**53:
            total = np.bincount(cell, weights=part, minlength=rows * self.n).astype(np.int64)
        else:
            total = np.zeros(rows * self.n, dtype=np.int64)
            np.add.at(total, cell, part)
        return total.reshape(rows, self.n)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item, best first."""
    order = np.lexsort((doc, absent, -score, item))
    group = item[order]
    return order[np.arange(len(order)) - np.searchsorted(group, group) < k]


def _found(items, k: int):
    """The k best documents of each item among a task's classes."""
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.binary_length(batch.column(1)).to_numpy() // PAIR.itemsize
            work = np.r_[0, np.cumsum(np.diff(items.value.first)[_pairs(batch.column(1))["term"]])]
            part = (work[np.cumsum(size) - size] // PRODUCTS << 32) + np.arange(len(size)) // max(1, CELLS // items.value.n)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for at, end in zip(first, np.r_[first[1:], len(part)], strict=True):
                yield batch.slice(at, end - at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in tiles(batches):
            m, bags = batch.column(0).to_numpy(), batch.column(1)
            pairs = _pairs(bags)
            row = np.repeat(np.arange(len(bags)), pc.binary_length(bags).to_numpy() // PAIR.itemsize)
            scores = block.scores(row, pairs, m, len(bags))
            # beyond the k-th best class of a tile nothing can be among an item's best
            if len(bags) > k:
                edge = np.partition(scores, len(bags) - k, axis=0)[len(bags) - k]
                which, item = np.nonzero((scores >= edge) & (scores > 0))
            else:
                which, item = np.nonzero(scores)
            offsets, members = list_values(batch.column(2))
            absent = members.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(members, 0).to_numpy()
            # one row per class first, by its smallest id; then all ids of those that are left
            lead = offsets[which]
            keep = _best(item, scores[which, item], ids[lead], absent[lead], k)
            which, item = which[keep], item[keep]
            n = offsets[which + 1] - offsets[which]
            at = np.repeat(offsets[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            new = [np.repeat(item, n), np.repeat(scores[which, item], n), ids[at], absent[at]]
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            keep = _best(*held, k)
            held = [column[keep] for column in held]
        item, score, doc, absent = held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score), pa.array(doc, mask=absent)], names=["item", "score", "doc_id"])

    return run


def _first(rows: DataFrame, k: int, *keys: str | Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _statistics(bags: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all their terms, documents per term)."""
    total = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms, dtype=np.int64)
    for r in bags.select("bag").mapInArrow(_document_frequency(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_batches():
        df[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return total[0], total[1], df


def classes(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, members): every class with its k smallest ids, ascending."""
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    rows = bags.where(F.length("bag") > 0).select(m.alias("m"), "bag", "doc_id").withColumn("hash", F.xxhash64("m", "bag"))
    by_class = Window.partitionBy("hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    few = rows.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k)
    member = F.struct(F.col("place"), F.col("doc_id"))
    return few.groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list(member)).alias("members")).select("m", "bag", F.col("members.doc_id").alias("members"))


def blocks_of_items(items: DataFrame, id_column: str, text_column: str) -> Iterator[pa.Table]:
    """(id, text) of every item, in blocks of bounded size."""
    scratch = Scratch(items.sparkSession)
    rows = scratch.write(items.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid")), "search-items")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(2 * n / ITEMS) if n > ITEMS else 1, math.ceil(2 * size / ITEM_BYTES) if size > ITEM_BYTES else 1)
    for block in range(blocks if n else 0):
        yield rows.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).orderBy("uid").select("id", "text").toArrow()
    scratch.drop("search-items")


def search(
    docs: DataFrame, items: DataFrame, k: int, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = dict(items.dtypes)[item_column]
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number, block in enumerate(blocks_of_items(items, item_column, item_text_column)):
        terms, offsets = terms_of(block["text"].combine_chunks())
        encoded = terms.dictionary_encode()
        vocabulary = spark.sparkContext.broadcast(encoded.dictionary)
        bags = scratch.write(texts.mapInArrow(_bags(vocabulary), "doc_id long, n long, bag binary").where("n > 0"), f"search-bags-{number}")
        n_docs, n_terms, df = _statistics(bags, len(encoded.dictionary))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], dtype=np.int64)
        numbers = encoded.indices.to_numpy()
        asked = spark.sparkContext.broadcast(Items([numbers[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], weight))
        found = classes(bags, n_docs, n_terms, k).mapInArrow(_found(asked, k), "item int, score long, doc_id long")
        # the tasks' lists meet as a tree, so that no task merges the lists of all
        merged = _first(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))), k, "item", "part").drop("rank", "part")
        answers = _first(merged, k, "item")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(block)), pa.int32()), "item_id": block["id"]}))
        rows = names.join(answers, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = rows if number == 0 else result.unionByName(rows)
    return result
