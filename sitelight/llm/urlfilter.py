"""URL rules judged through Bloom filter cascades.

A URL asks for a few keys: each suffix of its host at a dot, followed by each
prefix of its path whose length some rule has. The keys that the whole corpus
asks for are the universe. For the allowed and for the blocked rules one
cascade is built: level 0 encodes the listed keys, level 1 the keys of the
universe that level 0 takes for listed though they are not, level 2 the listed
keys that level 1 takes for those, and so on until a level errs no more. Over
the universe the answer is exact, so judging is one pass without a join.

Size bound of what is broadcast: with r listed keys and s others, level 0 has
an error rate of r / (sqrt(2) s) and the others 1/2, so that every later level
holds about r keys at most and a cascade has about 1.44 r (log2(s / r) + 4)
bits. It follows the rule list, and the corpus by the logarithm only.

Defined results: a null URL or one without ``://`` has an empty host and path;
the longest fitting rule wins (host and path together; then the longer host;
then block); URLs that no rule fits are allowed, since no cascade lists them;
rules with a null host, path or verdict are ignored; repeated rules count once;
other columns are kept, except that ``host``, ``path``, ``rule`` and
``verdict`` are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelight.llm.common import LOWER, UPPER, Scratch

Level = tuple[int, int, np.ndarray]  # number of bits, probes per key, words of 64 bits


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, labels: int, lengths: list[int]) -> list[tuple[str, int]]:
    """(key, length of its host) of every rule that could fit."""
    suffixes, at = [], len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, max(at, 0))
        suffixes.append(host[at + 1:])
        if at < 0:
            break
    return [(s + path[:n], len(s)) for s in suffixes for n in lengths if n <= len(path)]


def _positions(keys: list[str], level: int, bits: int, probes: int) -> np.ndarray:
    """One row of bit positions per key."""
    halves = np.frombuffer(b"".join(xxhash.xxh128_digest(k.encode(), level) for k in keys), dtype="<u8").reshape(-1, 2)
    steps = np.arange(probes, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _holds(level: int, filter_: Level, keys: list[str]) -> np.ndarray:
    bits, probes, words = filter_
    at = _positions(keys, level, bits, probes)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def listed(cascade: list[Level], keys: list[str]) -> np.ndarray:
    """Exact membership, for keys of the universe: a key is listed if the
    first level that lacks it is an odd one."""
    verdict = np.full(len(keys), len(cascade) % 2 == 1)
    alive = np.arange(len(keys))
    for level, filter_ in enumerate(cascade):
        if not len(alive):
            break
        found = _holds(level, filter_, [keys[i] for i in alive])
        verdict[alive[~found]] = level % 2 == 1
        alive = alive[found]
    return verdict


def _encode(keys: DataFrame, level: int, bits: int, probes: int) -> np.ndarray:
    """The filter's words, set by tasks and combined by word."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.unique(_positions(batch.column(0).to_pylist(), level, bits, probes))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    layout = T.StructType([T.StructField("word", T.LongType()), T.StructField("mask", T.LongType())])
    rows = keys.select("key").mapInArrow(partial, layout).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros((bits + 63) // 64, dtype=np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return words


def _mistaken(keys: DataFrame, level: int, filter_: Level) -> DataFrame:
    """The keys that the filter seems to hold."""
    shared = keys.sparkSession.sparkContext.broadcast(filter_)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_holds(level, shared.value, batch.column(0).to_pylist())))

    return keys.select("key").mapInArrow(keep, "key string")


def build_cascade(universe: DataFrame, inside: DataFrame, scratch: Scratch, name: str) -> list[Level]:
    """Levels for the listed keys (``key``) over the universe (``key``)."""
    inside = scratch.write(inside.select("key").distinct(), f"{name}-0-in")
    outside = scratch.write(universe.join(inside, "key", "left_anti"), f"{name}-0-out")
    cascade: list[Level] = []
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        level = len(cascade)
        rate = 0.5 if level or n_out <= n_in else math.sqrt(0.5) * n_in / n_out
        bits = max(64, math.ceil(n_in * math.log2(1 / rate) / math.log(2)))
        probes = max(1, round(bits / n_in * math.log(2))) if bits > 64 else max(1, min(16, round(math.log2(1 / rate))))
        cascade.append((bits, probes, _encode(inside, level, bits, probes)))
        if not n_out:
            break
        again = scratch.write(_mistaken(outside, level, cascade[-1]), f"{name}-{level + 1}-in")
        inside, outside = again, inside
        n_in, n_out = inside.count(), n_in
    return cascade


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path
    and verdict ('allow' or 'block')."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    rules = scratch.write(
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("length"), (F.length(F.regexp_replace("host", "[^.]", "")) + 1).alias("labels"))
        .distinct(), "url-rules",
    )
    shape = rules.agg(F.max("labels").alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    labels, lengths = shape.labels or 0, [int(n) for n in shape.lengths]

    asked = pages.select(host_of(F.col(url_column)).alias("host"), F.substring(path_of(F.col(url_column)), 1, max(lengths, default=0)).alias("path")).distinct()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, _ in keys_of(h, p, labels, lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], names=["key"])

    universe = scratch.write(asked.mapInArrow(spell, "key string").distinct(), "url-universe")
    cascades = {v: build_cascade(universe, rules.where(F.col("verdict") == v), scratch, f"url-{v}") for v in ("allow", "block")}
    scratch.drop(*list(scratch.paths))
    shared = spark.sparkContext.broadcast((labels, lengths, cascades))

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts, paths):
        import pandas as pd

        most, sizes, both = shared.value
        asked = [keys_of(h, p, most, sizes) for h, p in zip(hosts, paths, strict=True)]
        distinct = sorted({k for row in asked for k, _ in row})
        known: dict[str, str] = {}
        for verdict in ("allow", "block"):
            known.update((k, verdict) for k, yes in zip(distinct, listed(both[verdict], distinct), strict=True) if yes)
        rules_, verdicts = [], []
        for row in asked:
            fit = max(((len(k), n, k) for k, n in row if k in known), default=None)
            rules_.append(fit[2] if fit else None)
            verdicts.append(known[fit[2]] if fit else "allow")
        return pd.DataFrame({"rule": rules_, "verdict": verdicts})

    url = F.col(url_column)
    judged = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumn("__judged", decide("host", "path"))
    return judged.withColumns({"rule": F.col("__judged.rule"), "verdict": F.col("__judged.verdict")}).drop("__judged")
