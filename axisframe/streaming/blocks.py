"""Running over rows block by block, and over rows that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions import predicate


def ordered_blocks(rows: DataFrame, order: str = "pos", size: int = 100_000) -> Iterator[list]:
    """Rows in order, ``size`` at a time. One partition is fetched ahead of the reader; one that stops early leaves the rest
    unread."""
    held = []
    for r in rows.orderBy(order).toLocalIterator(prefetchPartitions=True):
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def select_stream(rows: DataFrame, expression: str) -> DataFrame:
    """Arriving rows that an expression selects; it keeps no state, so order and lateness do not matter."""
    return rows.where(predicate.to_column(predicate.parse(expression), rows.schema))
