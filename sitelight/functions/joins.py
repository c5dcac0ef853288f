"""Joining facts to small summaries without shuffling the facts.

A summary (per portfolio, per category) is usually tiny, but how tiny is only
known once it has been computed. ``measured`` computes and caches it, so the
optimizer plans the following joins on its *actual* size: below
``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the facts stay
where they are; above it the join shuffles, and adaptive execution splits hot
keys. The cache is an optimisation only: lost blocks are recomputed.

A summary is needed until the result that joins it has been computed, so whoever
computes that result releases it: ``with released():`` around the work drops all
summaries that were cached inside.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_scopes = threading.local()


def measured(summary: DataFrame) -> DataFrame:
    summary = summary.persist(StorageLevel.MEMORY_AND_DISK)
    summary.count()
    for held in getattr(_scopes, "open", [])[-1:]:
        held.append(summary)
    return summary


@contextmanager
def released() -> Iterator[None]:
    """Summaries cached inside, in this thread, are dropped at the end."""
    held: list[DataFrame] = []
    _scopes.open = [*getattr(_scopes, "open", []), held]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        for summary in held:
            summary.unpersist()
