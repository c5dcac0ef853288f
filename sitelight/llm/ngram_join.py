"""Similarity join of texts on word shingles, with adaptive multi-match prefixes.

Texts with equal shingle sets are one node. The shingles of a node are ordered:
rare ones by hash, then the frequent ones by frequency. Two sets that are alike
enough share at least L shingles among the first (size - least overlap + L) of
each. Every node is indexed with its prefixes for L = 1 to ``longest``; shingles
that occur in one node's prefixes only are dropped at once. As a probe, a node
takes the L whose estimated cost is least (nodes that share too few entries with
any others for a link are taken out before): the index entries its prefix meets,
plus the candidates among them (at most entries / L) that would need
verification. A pair that shares L prefix shingles is verified, by bitmaps that
rule most others out and then on whole sets.

Large groups are not paired out. First each node is verified against two
leaders of each of its prefix shingles only (the node in which the shingle comes
first, and one by hash). Links join nodes into components, and the adaptive
join then pairs nodes of different components only, since a link inside a
component cannot change it. So the components are those of all links. A pair is
also dropped when the shingles that either side has before a common one, and no
node of another component has, leave too few for the least overlap.

Frequent are the shingles counted most often (within tasks, where at least
twice), ``frequent`` of them at most, which bounds the list that is broadcast.
The order affects cost only.

Shingles and sets are compared by 64-bit hashes of the former. Nodes are told
apart by 64 bits of a 128-bit hash of the set and its size.

Defined results: null texts count as empty; a text with fewer words than a
shingle is one shingle; texts without words have no shingles, link with
nothing and are their own component; rows with a null id get a size and no
component, and link with nothing; repeated rows are one node; rows that repeat
an id with another text are nodes of their own; columns other than id and text
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelight.llm.common import Scratch, may_hold, may_hold_all, member_bits
from sitelight.llm.components import components
from sitelight.llm.words import shingle_sets, slices

#: Shingles that a task counts at a time.
COUNTED = 2_000_000
#: The prefix (as L) whose shingles name leaders.
LEADING = 6
#: Shingles that must name the same leader before a node is verified against it.
AGREEING = 3
#: How often nodes without enough shared entries are taken out before pairing.
PRUNINGS = 2


def set_hash(values: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh128_digest(values.tobytes())[:8], "little", signed=True)


def rows_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[object, np.ndarray]]:
    for batch in slices(batches, "text"):
        yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True)


def _measure(width: int):
    """Rows (doc_id, n, node) and, with ``token``, locally repeated shingles and their counts in ``n``."""
    names = ["doc_id", "n", "node", "token"]

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        token, count = token[count > 1], count[count > 1]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(count, pa.int64()), none, pa.array(token.view(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, out = [], 0, []
        for doc, values in _sets(batches, width):
            out.append((doc, len(values), set_hash(values)))
            if doc is not None:
                held.append(values)
                total += len(values)
            if len(out) >= 10_000 or total > COUNTED:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.nulls(len(out), pa.int64())], names=names)
                out = []
            if total > COUNTED:
                yield repeated(held)
                held, total = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.nulls(len(out), pa.int64())], names=names)
        yield repeated(held)

    return run


def least_overlap(n: int, percent: int) -> int:
    """With any set that is not larger."""
    return -(-percent * n // 100)


def _prefixes(width: int, percent: int, longest: int, shared):
    """(token, node, size and place): a node's first shingles in its order."""
    names = ["token", "node", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        seen: set[int] = set()
        out: list[tuple] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            token = np.concatenate([r[0] for r in rows]).view(np.int64)
            node = np.concatenate([np.full(len(r[0]), r[1]) for r in rows])
            sizes = np.concatenate([(r[2] << 32) + np.arange(len(r[0])) for r in rows])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (token, node, sizes)], names=names)

        for doc, values in _sets(batches, width):
            n = len(values)
            if doc is None or not n:
                continue
            node = set_hash(values)
            if node in seen:
                continue
            seen.add(node)
            if len(seen) > 1_000_000:
                seen.clear()
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                hot = frequent[at] == values
                order = np.concatenate([values[~hot], values[hot][np.argsort(rank[at[hot]], kind="stable")]])
            else:
                order = values
            out.append((order[: n - least_overlap(n, percent) + longest], node, n))
            size += len(out[-1][0])
            if size > 200_000:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def _held(column: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold_all(shared.value, batch.column(batch.schema.names.index(column)).to_numpy())))

    return run


def _levels(entries: DataFrame, percent: int) -> DataFrame:
    """The least L at which an entry belongs to the probe and to the index prefix."""
    n, place = F.expr("cast(shiftright(sizes, 32) as int)"), F.expr("cast(sizes & 4294967295L as int)")
    up, down = F.expr(f"cast((2L * {percent} * n + {99 + percent}) div {100 + percent} as int)"), F.expr(f"cast(({percent}L * n + 99) div 100 as int)")
    rows = entries.withColumns({"n": n, "place": place}).drop("sizes")
    level = lambda least: F.greatest(F.lit(1), F.col("place") + 1 - F.col("n") + least)
    return rows.withColumns({"probe_level": level(down), "index_level": level(up)})


def bitmap(values: np.ndarray) -> bytes:
    """One bit per shingle, in an array of at least twice as many bits."""
    bits = np.zeros(max(64, 1 << (2 * len(values) - 1).bit_length()), dtype=bool)
    bits[values % np.uint64(len(bits))] = True
    return np.packbits(bits).tobytes()


def may_link(one: np.ndarray, two: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether two bitmaps differ in no more bits than two linked sets of these
    sizes could differ in shingles. Each different bit is a different shingle."""
    if len(one) != len(two):
        one, two = sorted((one, two), key=len)
        two = np.bitwise_or.reduce(two.reshape(-1, len(one)), axis=0)
    least = -(-percent * (n + m) // (100 + percent))
    return int(np.bitwise_count(one ^ two).sum()) <= n + m - 2 * least


def _candidate_sets(width: int, shared):
    """(node, n, bits, values) of the texts that the filter lets through."""
    names, kinds = ["node", "n", "bits", "values"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc, values in _sets(batches, width):
            node = set_hash(values)
            if doc is None or not may_hold(shared.value, node ^ doc):
                continue
            out.append((node, len(values), bitmap(values), values.tobytes()))
            size += values.nbytes
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _pass_bitmaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in batch.column(k)] for k in (2, 4))
            sizes = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            keep = [may_link(x, y, n, m, percent) for x, y, (n, m) in zip(one, two, sizes, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (one, two))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that are links: by bitmaps first, then by whole sets."""
    def beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return pairs.select("a", "b", *[f"{side}_{c}" for side in ("a", "b") for c in columns])

    likely = beside(pairs.select("a", "b"), sets.select("node", "bits", "n"), ["bits", "n"]).mapInArrow(_pass_bitmaps(percent), "a long, b long")
    likely = scratch.write(likely.distinct(), f"{name}-likely")
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    bits = sets.sparkSession.sparkContext.broadcast(member_bits(nodes, "node"))
    needed = sets.select("node", "values").mapInArrow(_held("node", bits), "node long, values binary")
    found = scratch.write(beside(likely, needed, ["values"]).mapInArrow(_verified(percent), "a long, b long").distinct(), name)
    scratch.drop(f"{name}-likely")
    return found


def _alike_sizes(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each node beside the leaders of its prefix shingles."""
    entries = entries.where(F.col("probe_level") <= LEADING)
    first = F.min(F.struct("place", "n", "node")).alias("first")
    drawn = F.min(F.struct(F.xxhash64("node").alias("draw"), "n", "node")).alias("drawn")
    leaders = entries.groupBy("token").agg(first, drawn)
    paired = entries.select("token", "node", "n").join(leaders, "token").select("node", "n", F.explode(F.array(
        F.struct(F.col("first.node").alias("node"), F.col("first.n").alias("n")), F.struct(F.col("drawn.node").alias("node"), F.col("drawn.n").alias("n")),
    )).alias("leader"))
    alike = (F.col("node") != F.col("leader.node")) & _alike_sizes("n", "leader.n", percent)
    pairs = paired.where(alike).select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where(F.col("times") >= AGREEING)


def _adaptive_pairs(entries: DataFrame, percent: int, longest: int, check_cost: float) -> DataFrame:
    """Candidate pairs of different components, with L chosen per probing node."""
    levels = range(1, longest + 1)
    lists = entries.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        *[F.sum((F.col("index_level") <= level).cast("int")).alias(f"list_{level}") for level in levels],
    ).where("low <> high").drop("low", "high")
    # shingles of a node before this one that no node of another component has in
    # its prefix: what meets the node here cannot have them either
    place = F.row_number().over(Window.partitionBy("node").orderBy("place", "token"))
    open_ = entries.join(lists, "token").withColumn("most", F.col("n") - F.col("place") + place - 1)
    costs = open_.groupBy("node").agg(F.first("n").alias("n"), *[F.sum(F.when(F.col("probe_level") <= level, F.col(f"list_{level}")).otherwise(0)).alias(f"cost_{level}") for level in levels])
    most = F.ceil(F.col("n") * percent / 100)
    options = F.array(*[
        F.when(F.lit(level) <= most, F.struct((F.col(f"cost_{level}") * (1 + check_cost / level)).alias("cost"), F.lit(level).alias("level"))) for level in levels
    ])
    chosen = costs.select("node", F.array_min(F.filter(options, lambda x: x.isNotNull()))["level"].alias("level"))
    own = ["token", "node", "n", "component", "place", "most"]
    probes = open_.join(chosen, "node").where("probe_level <= level").select(*[F.col(c).alias(f"s_{c}" if c != "token" else c) for c in own], "level")
    index = open_.where(F.col("index_level") <= longest).select(*[F.col(c).alias(f"r_{c}" if c != "token" else c) for c in own], "index_level")
    smaller = (F.col("r_n") < F.col("s_n")) | ((F.col("r_n") == F.col("s_n")) & (F.col("r_node") < F.col("s_node")))
    can = (100 + percent) * F.least("s_most", "r_most") >= percent * (F.col("s_n") + F.col("r_n"))
    met = probes.join(index, "token").where(
        (F.col("index_level") <= F.col("level")) & (F.col("s_component") != F.col("r_component")) & smaller & (100 * F.col("r_n") >= percent * F.col("s_n")) & can
    ).withColumnsRenamed({"s_node": "s", "r_node": "r"})
    after = F.least(F.first("s_n") - F.max("s_place"), F.first("r_n") - F.max("r_place")) - 1
    enough = (100 + percent) * (F.count("*") + after) >= percent * (F.first("s_n") + F.first("r_n"))
    shared = met.groupBy("s", "r").agg(F.count("*").alias("shared"), F.first("level").alias("level"), enough.alias("enough")).where("enough AND shared >= level")
    return shared.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"))


def _several(entries: DataFrame) -> DataFrame:
    """The shingles that more than one node has."""
    return entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")


def _rich(entries: DataFrame, percent: int, longest: int) -> DataFrame:
    """The nodes that can have a link: with it they would share ``longest``
    entries, or as many as the least overlap is."""
    needed = F.least(F.lit(longest), F.ceil(F.shiftright(F.first("sizes"), 32) * percent / 100))
    return entries.groupBy("node").agg((F.count("*") >= needed).alias("rich")).where("rich").select("node")


def _pruned(entries: DataFrame, column: str, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries with a key among ``keys``, and a few others: pruning only spares work."""
    keys = scratch.write(keys, f"join-keys-{column}")
    bits = entries.sparkSession.sparkContext.broadcast(member_bits(keys, column))
    scratch.drop(f"join-keys-{column}")
    return entries.mapInArrow(_held(column, bits), "token long, node long, sizes long")


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` shingles reach."""
    level = F.floor(4 * F.log2("n")).alias("level")  # so that the histogram is short
    histogram = counts.groupBy(level).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    least, listed = 2**62, 0
    for row in histogram:
        listed += row.rows
        if listed > most:
            break
        least = row.n
    return least


def groups(
    docs: DataFrame, width: int, percent: int, id_column: str = "doc_id", text_column: str = "text", longest: int = 16,
    frequent: int = 2**20, check_cost: float = 1.0,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: two texts link when 100 *
    intersection >= percent * union of their sets of ``width``-word shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = rows_of(docs, id_column, text_column)
    measured = scratch.write(texts.mapInArrow(_measure(width), "doc_id long, n long, node long, token long"), "join-sizes")
    rows = measured.where("token IS NULL").drop("token")

    # the frequent shingles: the most frequent ones, at most ``frequent`` of them
    counts = measured.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "join-counts")
    often = counts.where(F.col("n") >= _least_count(counts, frequent)).select("token", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    scratch.drop("join-counts")
    token = often["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    shared = spark.sparkContext.broadcast((token[order], often["n"].to_numpy()[order]))
    del often, token, order

    # entries of shingles that more than one node has in its prefixes
    entries = scratch.write(texts.mapInArrow(_prefixes(width, percent, longest, shared), "token long, node long, sizes long"), "join-entries")
    kept = _pruned(entries, "token", _several(entries), scratch).repartition("node").dropDuplicates(["token", "node"])
    entries = scratch.write(kept, "join-shared-0")
    scratch.drop("join-entries")
    for turn in range(1, PRUNINGS + 1):
        rich = scratch.write(_pruned(entries, "node", _rich(entries, percent, longest), scratch), "join-rich")
        kept = _pruned(rich, "token", _several(rich), scratch)
        entries = scratch.write(kept, f"join-shared-{turn}")
        scratch.drop(f"join-shared-{turn - 1}", "join-rich")
    entries = _levels(entries, percent)

    # whole sets of the nodes that may have a candidate, from one text of each
    least = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    chosen = scratch.write(entries.select("node").distinct().join(least, "node").select(F.expr("node ^ least").alias("key")), "join-chosen")
    bits = spark.sparkContext.broadcast(member_bits(chosen, "key"))
    sets = scratch.write(texts.mapInArrow(_candidate_sets(width, bits), "node long, n int, bits binary, values binary"), "join-sets")

    # links to leaders, then the links between what these left apart
    found = verify(_leader_pairs(entries, percent), sets, percent, scratch, "join-leaders")
    joined = components(found, scratch, "join-components")
    known = entries.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = scratch.write(known, "join-known")
    more = verify(_adaptive_pairs(known, percent, longest, check_cost), sets, percent, scratch, "join-links")
    scratch.drop("join-known", "join-sets", "join-chosen", f"join-shared-{PRUNINGS}")
    linked = scratch.write(components(found.union(more), scratch, "join-all"), "join-linked")

    # the smallest id of each component, by node first
    least = least.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.join(names, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
