"""Best-fit packing of pieces into sequences by a grouping genetic algorithm.

Pieces are dealt by hash to shards of about ``shard_items``. Each shard is
solved on several islands. An individual is a set of bins; crossover injects
well-filled bins of one parent whole into the other, dissolves the bins that
held any of the same pieces, and best-fits the displaced ones, longest first.
After each epoch the best individual of an island moves on to the next island
of its shard. A shard that reaches the lower bound (total length over capacity)
needs no further search.

The best solution of a shard keeps its bins that are full to ``settled``; the
pieces of the others are dealt anew, to fewer shards, until one shard holds
them or a level no longer settles half of its pieces. So what sharding wastes
is at most a part of a bin per shard of the last level.

Defined results: a piece of exactly the capacity is a sequence of its own;
pieces with a null length or one outside 1..capacity are refused with an
error; an empty table gives an empty result; equal lengths are told apart by
row, so repeated rows are each placed. All columns of the input are kept, a
``sequence_id`` or ``offset`` among them is replaced.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelight.llm.common import Scratch, record

Bins = list[list[int]]


# --- one shard on one island -----------------------------------------------------
def best_fit(lengths: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """Put the items, in their order, each into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, bin_ in enumerate(bins):
        room = capacity - sum(lengths[i] for i in bin_)
        by_room[room].append(b)
        mask |= 1 << room
    for i in items:
        size = lengths[i]
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([i])
        by_room[room].append(b)
        mask |= 1 << room
    return bins


def fitness(lengths: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, which leave larger gaps."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(lengths: list[int], one: Bins, other: Bins, capacity: int, draw: random.Random) -> Bins:
    full = sorted(other, key=lambda b: -sum(lengths[i] for i in b))[: max(1, len(other) // 2)]
    injected = [b for b in full if draw.random() < 0.5] or full[:1]
    taken = {i for b in injected for i in b}
    kept, displaced = [list(b) for b in injected], []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced.extend(i for i in b if i not in taken)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, kept, capacity)


def from_places(places: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(places, default=-1) + 1)]
    for i, b in enumerate(places):
        bins[b].append(i)
    return bins


def to_places(bins: Bins, n: int) -> list[int]:
    places = [0] * n
    for b, bin_ in enumerate(bins):
        for i in bin_:
            places[i] = b
    return places


def evolve(lengths: list[int], migrants: list[list[int]], capacity: int, population: int, generations: int, seed: int) -> Bins:
    """The best individual of an island after some generations."""
    draw = random.Random(seed)
    bound = math.ceil(sum(lengths) / capacity)
    people = [from_places(p) for p in migrants if p]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    if not people:
        people.append(best_fit(lengths, order, [], capacity))
    if min(map(len, people)) > bound:
        while len(people) < population:
            spread = draw.uniform(0.02, 0.3)
            noisy = sorted(order, key=lambda i: -lengths[i] * draw.uniform(1 - spread, 1))
            people.append(best_fit(lengths, noisy, [], capacity))
        graded = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), reverse=True)
        for g in range(generations):
            if -graded[0][0][0] <= bound:
                break
            a, b = draw.sample(graded, 2)
            child = crossover(lengths, max(a, b)[2], min(a, b)[2], capacity, draw)
            graded = sorted([*graded, (fitness(lengths, child, capacity), population + g, child)], reverse=True)[:population]
        return graded[0][2]
    return min(people, key=len)


# --- shards, islands and levels ------------------------------------------------------
STATE = "shard int, island int, uids array<long>, lengths array<int>, places array<int>, n_bins int, bound int"
ARROW_STATE = pa.schema([
    ("shard", pa.int32()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("places", pa.list_(pa.int32())), ("n_bins", pa.int32()), ("bound", pa.int32()),
])
PLACED = "uid long, shard int, bin int, offset long, fill long"
ARROW_PLACED = pa.schema([("uid", pa.int64()), ("shard", pa.int32()), ("bin", pa.int32()), ("offset", pa.int64()), ("fill", pa.int64())])


def _epoch(capacity: int, population: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best = evolve(row["lengths"], row["migrants"], capacity, population, generations, hash((row["shard"], row["island"], epoch)))
                yield record(
                    ARROW_STATE, shard=[row["shard"]], island=[row["island"]], uids=[row["uids"]], lengths=[row["lengths"]],
                    places=[to_places(best, len(row["lengths"]))], n_bins=[len(best)], bound=[math.ceil(sum(row["lengths"]) / capacity)],
                )

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            places, lengths, uids = np.array(row["places"]), np.array(row["lengths"]), np.array(row["uids"])
            order = np.argsort(places, kind="stable")
            places, lengths = places[order], lengths[order]
            before = np.cumsum(lengths) - lengths
            first = np.searchsorted(places, places)
            fill = np.bincount(places, weights=lengths)[places]
            yield record(ARROW_PLACED, uid=uids[order], shard=np.full(len(places), row["shard"]), bin=places, offset=before - before[first], fill=fill.astype(np.int64))


def solve(items: DataFrame, capacity: int, shards: int, level: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(uid, shard, bin, offset, fill) of (uid, length)."""
    shard = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).cast("int").alias("shard")
    state = (
        items.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
        .select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.uid").alias("uids"),
            F.col("items.length").cast("array<int>").alias("lengths"), F.array().cast("array<array<int>>").alias("migrants"),
        )
    )
    for epoch in range(epochs):
        state = state.repartition("shard", "island").mapInArrow(_epoch(capacity, population, generations, epoch), STATE)
        if epoch + 1 < epochs:
            # each island starts on with its own elite and that of the island before it
            ring = state.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("island", "uids", "lengths", "places", "n_bins", "bound"))).alias("ring"))
            state = ring.select("shard", "ring", F.posexplode("ring").alias("at", "own")).select(
                "shard", "own.island", "own.uids", "own.lengths",
                F.array("own.places", F.element_at(F.col("ring.places"), (F.col("at") + islands - 1) % islands + 1)).alias("migrants"),
            )
    best = state.groupBy("shard").agg(F.min_by(F.struct("uids", "lengths", "places"), F.struct("n_bins", "island")).alias("best"))
    return best.select("shard", "best.*").mapInArrow(_place, PLACED)


def pack(
    pieces: DataFrame, capacity: int, length_column: str = "length", shard_items: int = 4096, islands: int = 2, epochs: int = 2,
    population: int = 4, generations: int = 6, settled: float = 0.98,
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; every sequence is gapless
    from 0 and holds at most ``capacity``."""
    scratch = Scratch(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    size = F.col(length_column)
    fits = F.when(size.between(1, capacity), size.cast("long")).otherwise(F.raise_error(F.concat(F.lit("length outside 1..capacity: "), F.coalesce(size.cast("string"), F.lit("null")))))
    stored = scratch.write(pieces.withColumns({"__length": fits, "__uid": F.monotonically_increasing_id()}), "pack-pieces")
    rows = stored.select(F.col("__uid").alias("uid"), F.col("__length").alias("length"))
    whole = rows.where(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(F.col("length") < capacity)
    n, level, done = left.count(), 0, [whole]
    while n:
        shards = math.ceil(n / shard_items)
        placed = scratch.write(solve(left, capacity, shards, level, islands, epochs, population, generations), f"pack-level-{level}")
        open_ = placed.where(F.col("fill") < math.floor(settled * capacity))
        n_open = open_.count() if shards > 1 else 0
        again = 0 < n_open <= n / 2
        kept = placed.where(F.col("fill") >= math.floor(settled * capacity)) if again else placed
        done.append(kept.select("uid", (F.lit(level) * 2**48 + F.col("shard") * 2**20 + F.col("bin")).cast("long").alias("sequence_id"), "offset"))
        left = open_.select("uid").join(rows, "uid") if again else None
        n, level = (n_open if again else 0), level + 1
    places = done[0]
    for part in done[1:]:
        places = places.unionByName(part)
    placed = stored.join(places.withColumnRenamed("uid", "__uid"), "__uid")
    return placed.drop("__uid", "__length")


def sequences(packed: DataFrame, ids_column: str = "ids") -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, put together in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids_column)))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate(F.col("parts"), F.lit("").cast("binary"), lambda whole, part: F.concat(whole, part[ids_column])).alias("ids")
    )
