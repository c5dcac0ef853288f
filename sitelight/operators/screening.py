"""Screening of proposed bids against the most similar past projects.

Similarity is the cosine between (log value, subcontractors, one-hot type,
one-hot region) vectors. With one-hot categories the cosine has a closed form
in four scalars, so no vectors are built. A portfolio may hold a large share
of all rows, so bids are never paired with whole portfolios: the history is
summarised into blocks, each block's best and worst possible distance to a bid
is known exactly, and only blocks that can still hold one of the k nearest are
opened. Within a cell (one type, region and number of subcontractors) the
distance falls up to one log value and rises after it, so the blocks that count
are found by bisection in the cell's sorted blocks, not by trying them all. The
result is the exact k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight import schema as S
from sitelight.functions.columns import confidence_label, null_nan, wilson_interval
from sitelight.functions.joins import measured
from sitelight.operators.segments import cluster_features, feature_medians
from sitelight.session import materialize, wide_rows

DEFAULT_K = 5
# Distances are compared to this many digits: equal vectors are equal then, and
# the input order decides between them.
TIE_DIGITS = 12
OUTCOME_RANGES = ["delay_days", "cost_overrun_pct", "safety_incidents"]
# What screening reads of a project.
SOURCE = ["portfolio_id", "project_id", "project_type", "region", "contract_value_usd", "subcontractor_count",
          "payment_disputes", *OUTCOME_RANGES]
CELL = ["portfolio_id", "type_key", "region_key", "subs"]
BLOCK = [*CELL, "bin"]
# Steps of the value grid the blocks are assembled from: one for so many rows of
# a cell, within these limits.
STEP_ROWS, GRID, FINEST_GRID = 8, 4096, 2**17
# Consecutive blocks of a cell that make a run, blocks of a piece of the
# directory, bids of a group, copies of the directory that groups spread over.
RUN_BLOCKS, PIECE_BLOCKS, BID_ROWS, COPIES = 4096, 2**14, 4096, 8
# Room for rounding in bounds.
SLACK = 1e-9


def encode_history(
    history: DataFrame, order_by: str = "project_id", medians: DataFrame | None = None
) -> DataFrame:
    """Past projects in feature space, with the outcomes a cohort reports."""
    return cluster_features(history, medians).select(
        "portfolio_id", "project_id", F.col(order_by).alias("ord"),
        "log_value", "subs", "type_key", "region_key",
        *[null_nan(F.col(c).cast("double")).alias(c) for c in [*OUTCOME_RANGES, "payment_disputes"]],
    )


def encode_bids(bids: DataFrame, medians: DataFrame, categories: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Bids in the same space. A NaN value takes the portfolio median, an absent
    one counts as 0; a category the portfolio never had contributes nothing.
    ``categories`` holds the (portfolio, type, region) combinations that occur."""
    types = categories.select("portfolio_id", F.col("type_key").alias("project_type")).distinct()
    regions = categories.select("portfolio_id", F.col("region_key").alias("region")).distinct()
    value = F.col("contract_value_usd").cast("double")
    filled = F.when(F.isnan(value), F.coalesce("median_value", F.lit(0.0))).otherwise(F.coalesce(value, F.lit(0.0)))
    wanted = F.coalesce(F.col("k"), F.lit(k)) if "k" in bids.columns else F.lit(k)
    log_value, subs = F.col("bid_log_value"), F.col("bid_subs")
    return (
        bids.withColumn("k", wanted.cast("int"))
        .join(medians, "portfolio_id", "left")
        .join(types.withColumn("_type", F.lit(1.0)), ["portfolio_id", "project_type"], "left")
        .join(regions.withColumn("_region", F.lit(1.0)), ["portfolio_id", "region"], "left")
        .withColumns(
            {
                "bid_log_value": F.log1p(F.greatest(F.lit(0.0), filled)),
                "bid_subs": F.coalesce(null_nan(F.col("subcontractor_count").cast("double")).cast("int"), F.lit(0)).cast("double"),
            }
        )
        .withColumn(
            "bid_norm",
            F.sqrt(log_value * log_value + subs * subs
                   + F.coalesce("_type", F.lit(0.0)) + F.coalesce("_region", F.lit(0.0))),
        )
        .select(
            "bid_id", "portfolio_id", "k", "bid_log_value", "bid_subs", "bid_norm",
            F.col("project_type").alias("bid_type"), F.col("region").alias("bid_region"),
        )
    )


def matches() -> Column:
    """How many one-hot positions bid and history row share (0, 1 or 2)."""
    same_type = F.coalesce(F.col("bid_type") == F.col("type_key"), F.lit(False))
    same_region = F.coalesce(F.col("bid_region") == F.col("region_key"), F.lit(False))
    return same_type.cast("double") + same_region.cast("double")


def distance(log_value: Column) -> Column:
    """Cosine distance of a bid to a history point with this log value."""
    dot = F.col("bid_log_value") * log_value + F.col("bid_subs") * F.col("subs") + F.col("shared")
    norm = F.sqrt(log_value * log_value + F.col("subs") * F.col("subs") + 2)
    cosine = dot / (F.col("bid_norm") * norm)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - cosine))


def _distance(log_value: np.ndarray, bid_log: np.ndarray, fixed: np.ndarray, bid_norm: np.ndarray, subs: float) -> np.ndarray:
    """``distance`` in a task; ``fixed`` is what does not depend on the log value."""
    with np.errstate(invalid="ignore", over="ignore"):
        cosine = (bid_log * log_value + fixed) / (bid_norm * np.sqrt(log_value * log_value + subs * subs + 2))
        return np.fmax(0.0, np.fmin(2.0, 1.0 - cosine))


def _parts(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class _Meeting:
    """A group of bids with a piece of the directory: blocks in runs, each run
    part of a cell in the order of log values."""

    def __init__(self, asked: pa.StructArray, directory: pa.StructArray):
        names = pa.StructArray.from_arrays([directory.field(c) for c in ("type_key", "region_key")], ["type_key", "region_key"])
        kinds = [names.field(c).dictionary_encode() for c in ("type_key", "region_key")]
        codes = [_parts(k.indices) for k in kinds]
        subs, run, bins = (_parts(directory.field(c)) for c in ("subs", "run", "bin"))
        # a NaN number of subcontractors equals itself
        subs_code = np.unique(subs, return_inverse=True)[1]
        order = np.lexsort((bins, run, subs_code, codes[1], codes[0]))
        key = np.stack([codes[0], codes[1], subs_code, run])[:, order]
        edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        self.runs = list(zip(edges[:-1], edges[1:], strict=True))
        self.at, self.subs = order, subs[order]
        self.low, self.high, self.n = (_parts(directory.field(c))[order] for c in ("low", "high", "n"))
        self.bid_log, self.bid_subs, self.norm, self.k = (_parts(asked.field(c)) for c in ("bid_log_value", "bid_subs", "bid_norm", "k"))
        # which level of the piece each bid has, -1 for none
        self.levels = [(c[order], _parts(pc.fill_null(pc.index_in(asked.field(b), value_set=k.dictionary), -1)))
                       for b, k, c in zip(("bid_type", "bid_region"), kinds, codes, strict=True)]

    def facing(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each bid for one run: shared positions, fixed part of the product,
        the log value of the peak, the last block that begins before it."""
        subs = self.subs[first]
        shared = sum((bids == blocks[first]).astype(float) for blocks, bids in self.levels)
        fixed = self.bid_subs * subs + shared
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            peak = np.where(fixed > 0, self.bid_log * (subs * subs + 2) / fixed, self.high[last - 1])
        return shared, fixed, peak, np.clip(np.searchsorted(self.low[first:last], peak, "right") - 1, 0, last - first - 1) + first

    def farthest(self, first: np.ndarray, last: np.ndarray, fixed: np.ndarray, subs: float) -> np.ndarray:
        """Largest distance to a row of the blocks ``first`` to ``last``: at one of the ends."""
        ends = (self.low[first], self.high[last])
        return np.maximum(*(_distance(e, self.bid_log, fixed, self.norm, subs) for e in ends)) + SLACK

    def reach(self) -> np.ndarray:
        """A distance within which each bid has its k rows: the nearest blocks of
        all runs taken together, whole runs where these are too few."""
        near, whole = [], []
        for first, last in self.runs:
            _, fixed, _, i = self.facing(first, last)
            for j in (i - 1, i, i + 1):
                there = (j >= first) & (j < last)
                block = np.clip(j, first, last - 1)
                far = self.farthest(block, block, fixed, self.subs[first])
                near.append((np.where(there, far, np.inf), np.where(there, self.n[block], 0)))
            whole.append((self.farthest(first, last - 1, fixed, self.subs[first]), np.full(len(i), self.n[first:last].sum())))
        return np.minimum(self._enough(near), self._enough(whole))

    def _enough(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        far, n = (np.stack(p, axis=1) for p in zip(*parts, strict=True))
        # a block has a row at least, so the nearest k blocks are enough
        most = min(far.shape[1], int(self.k.max(initial=1)))
        order = np.argpartition(far, most - 1, axis=1)[:, :most]
        order = np.take_along_axis(order, np.take_along_axis(far, order, axis=1).argsort(axis=1), axis=1)
        held = np.take_along_axis(n, order, axis=1).cumsum(axis=1) >= self.k[:, None]
        first = np.take_along_axis(order, held.argmax(axis=1)[:, None], axis=1)
        return np.where(held.any(axis=1), np.take_along_axis(far, first, axis=1)[:, 0], np.inf)

    def opened(self, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bid, block, shared positions) of every block that begins within reach."""
        found = []
        for first, last in self.runs:
            shared, fixed, peak, i = self.facing(first, last)
            subs = self.subs[first]

            def within(rows, block, peak=peak, fixed=fixed, subs=subs):
                nearest = np.fmax(self.low[block], np.fmin(self.high[block], peak[rows]))
                return _distance(nearest, self.bid_log[rows], fixed[rows], self.norm[rows], subs) - SLACK <= reach[rows]

            rows = np.flatnonzero(within(slice(None), i) | within(slice(None), np.minimum(i + 1, last - 1)))
            if not len(rows):
                continue
            # blocks are nearer the closer they are to the peak, on both sides
            left, bound = np.full(len(rows), first), i[rows] + 1
            while (left < bound).any():
                middle = (left + bound) // 2
                ok = within(rows, np.minimum(middle, last - 1)) & (left < bound)
                left, bound = np.where(ok | (left >= bound), left, middle + 1), np.where(ok, middle, bound)
            right, bound = i[rows], np.full(len(rows), last - 1)
            while (right < bound).any():
                middle = (right + bound + 1) // 2
                ok = within(rows, middle) & (right < bound)
                right, bound = np.where(ok, middle, right), np.where(ok | (right >= bound), bound, middle - 1)
            n = right - left + 1
            start = np.repeat(left - np.r_[0, n.cumsum()[:-1]], n)
            found.append((np.repeat(rows, n), self.at[start + np.arange(n.sum())], np.repeat(shared[rows], n)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            asked, directory = batch.column(0)[i].values, batch.column(1)[i].values
            yield pa.RecordBatch.from_arrays([asked.field("bid_id"), pa.array(_Meeting(asked, directory).reach())], names=["bid_id", "reach"])


def _openings(names: list[str]):
    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, directory = batch.column(0)[i].values, batch.column(1)[i].values
                bid, block, shared = _Meeting(asked, directory).opened(_parts(asked.field("reach")))
                bid, block = pa.array(bid), pa.array(block)
                columns = {c: asked.field(c).take(bid) for c in names if c in asked.type.names}
                columns |= {c: directory.field(c).take(block) for c in BLOCK} | {"shared": pa.array(shared)}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return openings


def directory_of(blocks: DataFrame) -> DataFrame:
    """portfolio_id, piece, copy, directory: the blocks of a portfolio in pieces of
    about ``PIECE_BLOCKS``, a run of a cell in one of them."""
    in_cell = W.partitionBy(*CELL).orderBy("bin")
    run = F.floor((F.row_number().over(in_cell) - 1) / RUN_BLOCKS).cast("int")
    pieces = blocks.groupBy("portfolio_id").agg(F.ceil(F.count(F.lit(1)) / PIECE_BLOCKS).alias("_pieces"))
    piece = F.pmod(F.xxhash64("type_key", "region_key", "subs", "run"), F.col("_pieces")).cast("int")
    return (
        blocks.withColumn("run", run).join(pieces, "portfolio_id").withColumn("piece", piece)
        .groupBy("portfolio_id", "piece", "_pieces").agg(F.collect_list(F.struct(*BLOCK, "run", "low", "high", "n")).alias("directory"))
    )


def _meetings(bids: DataFrame, directory: DataFrame) -> DataFrame:
    """bids, directory: every group of a portfolio's bids with every piece of its directory."""
    sizes = measured(bids.groupBy("portfolio_id").agg(F.ceil(F.count(F.lit(1)) / BID_ROWS).alias("_groups")))
    pieces = measured(directory.groupBy("portfolio_id").agg(F.max("_pieces").alias("_pieces")))
    group = F.pmod(F.xxhash64("bid_id"), F.col("_groups")).cast("int").alias("_group")
    grouped = bids.join(sizes, "portfolio_id").groupBy("portfolio_id", group).agg(F.collect_list(F.struct(*bids.columns)).alias("bids"))
    spread = grouped.join(pieces, "portfolio_id").select(
        "portfolio_id", (F.col("_group") % COPIES).alias("copy"), "bids", F.explode(F.expr("sequence(0, cast(_pieces as int) - 1)")).alias("piece")
    )
    copies = directory.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(COPIES)])))
    return spread.join(copies, ["portfolio_id", "piece", "copy"]).select("bids", "directory")


def blocked(encoded: DataFrame, k_max: int) -> DataFrame:
    """History rows with their block.

    A cell's value range is laid out as a grid, and consecutive grid steps are
    joined until a block has its rows: this needs only counts per grid step.
    Identical points are equally far from every bid, so only the first
    ``k_max`` of each in input order can ever be chosen; the others leave, each
    task dropping its own before the shuffle.
    """
    ranges = measured(
        encoded.groupBy(*CELL).agg(F.min("log_value").alias("_low"), F.max("log_value").alias("_high"), F.count(F.lit(1)).alias("_rows"))
    )
    steps = F.least(F.lit(FINEST_GRID), F.greatest(F.lit(GRID), F.ceil(F.col("_rows") / STEP_ROWS)))
    share = (F.col("log_value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    step = F.when(F.col("_high") > F.col("_low"), F.floor(share * (steps - 1)).cast("int")).otherwise(F.lit(0))
    placed = encoded.join(ranges, CELL).withColumn("_step", step).drop("_low", "_high", "_rows")
    before = F.sum("_n").over(W.partitionBy(*CELL).orderBy("_step").rowsBetween(W.unboundedPreceding, -1))
    layout = measured(
        placed.groupBy(*CELL, "_step").agg(F.count(F.lit(1)).alias("_n"))
        .select(*CELL, "_step", F.floor(F.coalesce(before, F.lit(0)) / F.lit(2.0 * k_max)).cast("int").alias("bin"))
    )
    rows = placed.join(layout, [*CELL, "_step"]).drop("_step")
    same = W.partitionBy(*BLOCK, "log_value").orderBy("ord")
    return rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k_max).drop("_copy")


def _requested(bids: DataFrame, k: int) -> Column:
    return (F.coalesce(F.col("k"), F.lit(k)) if "k" in bids.columns else F.lit(k)).cast("int")


def rejected_bids(bids: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """bid_id, portfolio_id, k and the reason, of bids that ask for too few or too many."""
    asked = bids.select("bid_id", "portfolio_id", _requested(bids, k).alias("k"))
    reason = f"k must be between {S.MIN_K} and {S.MAX_K}"
    return asked.where(~F.col("k").between(S.MIN_K, S.MAX_K)).withColumn("error", F.lit(reason))


def accepted_bids(bids: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    return bids.where(_requested(bids, k).between(S.MIN_K, S.MAX_K))


def nearest(
    bids: DataFrame, history: DataFrame, k: int = DEFAULT_K, order_by: str = "project_id", written: bool = False
) -> DataFrame:
    """The k nearest history rows of every accepted bid: bid_id, k, position,
    project_id, distance and the row's outcomes. Fewer than k rows give all of
    them. A history that is ``written`` is read where it is."""
    bids = accepted_bids(bids, k)
    # Only the columns that matter, written once: everything below reads these.
    history = history.select(*sorted({order_by, *SOURCE}))
    history = history if written else materialize(history, "history")
    medians = measured(feature_medians(history))
    encoded = encode_history(history, order_by, medians)
    categories = measured(encoded.select("portfolio_id", "type_key", "region_key").distinct())
    # Partitioned by bid from here on: bounds, reach and ranks need no new shuffle
    # of the bids while the blocks are small enough to be sent to them.
    tasks = int(bids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = measured(encode_bids(bids, medians, categories, k).repartition(tasks, "bid_id"))
    k_max = asked.agg(F.coalesce(F.max("k"), F.lit(k)).alias("k")).first().k
    rows = materialize(blocked(encoded, k_max), "blocked-history")
    blocks = measured(
        rows.groupBy(*BLOCK).agg(
            F.min("log_value").alias("low"), F.max("log_value").alias("high"), F.count(F.lit(1)).alias("n")
        )
    )

    proper = asked.where("bid_norm >= 1e-12")
    directory = measured(directory_of(blocks))
    # How far a bid has to look at most: blocks with k rows between them guarantee
    # k rows within their worst distance.
    kinds = proper.schema
    reached = T.StructType([kinds["bid_id"]]).add("reach", "double")
    with wide_rows(bids.sparkSession):
        met = _meetings(proper, directory).mapInArrow(_reaches, reached)
        proper = measured(proper.join(met.groupBy("bid_id").agg(F.min("reach").alias("reach")), "bid_id"))
    # The blocks that begin within that reach.
    passed = ["bid_id", "k", "bid_log_value", "bid_subs", "bid_norm"]
    layout = T.StructType([kinds[c] for c in passed]).add("reach", "double")
    layout = T.StructType([*layout.fields, *[blocks.schema[c] for c in BLOCK]]).add("shared", "double")
    with wide_rows(bids.sparkSession):
        opened = materialize(_meetings(proper, directory).mapInArrow(_openings(layout.names), layout), "opened-blocks")
    candidates = opened.join(rows, BLOCK).withColumn("distance", distance(F.col("log_value")))

    # A bid without any direction has no nearest row: it takes the first k.
    head = W.partitionBy("portfolio_id").orderBy("ord")
    first_rows = rows.withColumn("_head", F.row_number().over(head)).where(F.col("_head") <= k_max)
    undirected = (
        asked.where("bid_norm < 1e-12").join(first_rows, "portfolio_id")
        .withColumn("distance", F.lit(None).cast("double"))
    )

    kept = ["bid_id", "portfolio_id", "k", "project_id", "ord", "distance", *OUTCOME_RANGES, "payment_disputes"]
    order = W.partitionBy("bid_id").orderBy(F.round("distance", TIE_DIGITS), "ord")
    return (
        candidates.where(F.col("distance") <= F.col("reach")).select(*kept)
        .unionByName(undirected.select(*kept))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k_max)
        .where(F.col("position") <= F.col("k"))
        .drop("ord")
    )


def cohort_range(outcome: str) -> Column:
    """p25, p50, p75 over a cohort (at most k rows), with count and label."""
    known = F.col(outcome)
    quartiles = F.percentile(known, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.struct(
        quartiles[0].alias("p25"), quartiles[1].alias("p50"), quartiles[2].alias("p75"),
        F.count(known).alias("n"), confidence_label(F.count(known)).alias("confidence"),
    )


def cohort_rate(predicate: Column) -> Column:
    """Share of a cohort for which the predicate holds; null verdicts do not
    count as trials."""
    n, hits = F.count(predicate), F.count_if(predicate)
    low, high = wilson_interval(hits, n)
    return F.struct(
        F.when(n > 0, hits / n).alias("rate"), low.alias("ci_low"), high.alias("ci_high"),
        n.alias("n"), confidence_label(n).alias("confidence"),
    )


def caveats(size: Column) -> Column:
    none = F.array(F.lit("No similar projects in this portfolio — no cohort to draw from."))
    few = F.array(F.format_string("n<5 cohort (n=%d) — treat ranges as directional, not predictive.", size))
    return F.when(size == 0, none).when(size < 5, few).otherwise(F.array().cast("array<string>"))


def screen(
    bids: DataFrame, history: DataFrame, k: int = DEFAULT_K, order_by: str = "project_id",
    cohort: DataFrame | None = None,
) -> DataFrame:
    """One result row per accepted bid, also for bids into empty portfolios."""
    bids = accepted_bids(bids, k)
    cohort = nearest(bids, history, k, order_by) if cohort is None else cohort
    ranked = F.array_sort(F.collect_list(F.struct("position", F.col("project_id").cast("string").alias("id"))))
    summary = cohort.groupBy("bid_id").agg(
        F.count(F.lit(1)).cast("int").alias("cohort_size"),
        F.transform(ranked, lambda r: r["id"]).alias("similar_project_ids"),
        F.struct(
            *[cohort_range(o).alias(o) for o in OUTCOME_RANGES],
            cohort_rate(F.col("payment_disputes") >= 1).alias("any_dispute"),
        ).alias("outcomes"),
    )
    requested = F.coalesce(F.col("k"), F.lit(k)) if "k" in bids.columns else F.lit(k)
    size = F.coalesce("cohort_size", F.lit(0))
    empty_range = "named_struct('p25', cast(null as double), 'p50', cast(null as double), 'p75', cast(null as double), 'n', 0L, 'confidence', 'low')"
    empty = F.expr(
        "named_struct(" + ", ".join(f"'{o}', {empty_range}" for o in OUTCOME_RANGES)
        + ", 'any_dispute', named_struct('rate', cast(null as double), 'ci_low', 0D, 'ci_high', 0D, 'n', 0L, 'confidence', 'low'))"
    )
    return (
        bids.select("bid_id", "portfolio_id", requested.cast("int").alias("k_requested"))
        .join(summary, "bid_id", "left")
        .select(
            "bid_id", "portfolio_id", size.alias("cohort_size"), "k_requested",
            F.coalesce("similar_project_ids", F.array().cast("array<string>")).alias("similar_project_ids"),
            F.coalesce("outcomes", empty).alias("outcomes"),
            caveats(size).alias("caveats"),
        )
    )


def similar_details(cohort: DataFrame, projects: DataFrame) -> DataFrame:
    """Name and outcomes of each similar project, in rank order per bid. A cohort
    has up to k rows a bid and is no summary, so it is not kept: it is computed once,
    on its way to the projects it names."""
    names = projects.select("portfolio_id", "project_id", "project_id_external", "project_name")
    found = cohort.select("bid_id", "portfolio_id", "position", "project_id", "delay_days", "cost_overrun_pct")
    return found.join(names, ["portfolio_id", "project_id"])
