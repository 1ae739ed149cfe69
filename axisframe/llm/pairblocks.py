"""Comparing the members of groups pair by pair in bounded blocks, without a row per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Most members of a group that one block holds; a block meets one other at a time.
BLOCK = 2048
#: Groups up to this size are compared all at once by shifting.
SMALL = 12


def blocked(rows: DataFrame, key: str, ident: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with pair_a, pair_b and pair_at: the two blocks that meet and the one a row is of.

    A group of up to ``block`` rows is one block. A larger one is dealt by a hash of ``ident`` over
    n / block blocks, and each row goes to every meeting of its block, so that each pair of rows
    meets and no task holds more than about two blocks of a group. The few large keys are written down, so that
    their true size is known and ``rows`` are not shuffled for them unless they are many.
    """
    large = rows.groupBy(key).count().where(F.col("count") > block)
    large = large.select(F.col(key).alias("pair_key"), F.ceil(F.col("count") / block).cast("int").alias("pair_n"))
    large = cut(large, "large")
    out = rows.join(large, F.col(key) == F.col("pair_key"), "left").drop("pair_key")
    out = out.withColumn("pair_n", F.coalesce("pair_n", F.lit(1)))
    out = out.withColumn("pair_at", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("pair_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pair_n") - 1)).alias("pair_other")
    out = out.select("*", other).drop("pair_n")
    out = out.withColumn("pair_a", F.least("pair_at", "pair_other")).withColumn("pair_b", F.greatest("pair_at", "pair_other"))
    return out.drop("pair_other")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from rows that come sorted by ``keys``: a table of groups and where each begins, end last."""
    held: list[pa.Table] = []
    last = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        if t.num_rows:
            new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        edges = starts(t)
        first = tuple(t.column(k)[0].as_py() for k in keys)
        if held and (len(edges) > 1 or first != last):
            # What is held ends within this batch at the latest.
            end = edges[-1]
            held.append(t.slice(0, end))
            whole = pa.concat_tables(held).combine_chunks()
            if whole.num_rows:
                yield whole, np.append(starts(whole), whole.num_rows)
            held = [t.slice(end)]
        elif not held and len(edges) > 1:
            end = edges[-1]
            yield t.slice(0, end).combine_chunks(), np.append(edges[:-1], end)
            held = [t.slice(end)]
        else:
            held.append(t)
        last = tuple(t.column(k)[t.num_rows - 1].as_py() for k in keys)
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, np.append(starts(whole), whole.num_rows)


def spanning(edges: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join what is alike within each group: all alike pairs of small groups, a spanning forest of
    larger ones. ``alike(i, j)`` judges rows
    elementwise, ``near(i, rows)`` one row against many.
    """
    sizes = np.diff(edges)
    left, right = [], []
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        ends = np.repeat(edges[1:], sizes)
        use = np.repeat(small, sizes)
        rows = np.arange(edges[0], edges[-1])
        for d in range(1, int(sizes[small].max())):
            i = rows[use & (rows + d < ends)]
            hit = alike(i, i + d)
            left.append(i[hit])
            right.append(i[hit] + d)
    for g in np.flatnonzero(sizes > SMALL):
        a, b = int(edges[g]), int(edges[g + 1])
        forest = Forest(b - a)
        label = np.arange(b - a)
        for x in range(a, b - 1):
            # Rows that already hang together with x need no look.
            rest = np.flatnonzero(label[x - a + 1 :] != label[x - a]) + x + 1
            if not len(rest):
                continue
            hit = rest[near(x, rest)]
            got = [y for y in hit.tolist() if forest.join(x - a, y - a)]
            if got:
                left.append(np.full(len(got), x))
                right.append(np.array(got))
                label = forest.labels()
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)
