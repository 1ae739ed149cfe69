"""Connected components by alternating large-star and small-star steps in DataFrame joins, a bounded rest in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import cut, discard
from .textkernel import tidy

#: Most edges that ``components`` may be told to end in one task; 8 MB of 128-bit names.
ALONE = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def _ended(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that is not the least one, b, of its component; all edges in one task.

    Each step hangs every root that has a smaller neighbour below one, so at least half of a component's roots go.
    """

    @tidy
    def run(batches):
        if not (batches := [*batches]):
            return
        t = pa.Table.from_batches(batches)
        ends = pa.concat_arrays([*t.column("a").chunks, *t.column("b").chunks]).dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary)
        names = ends.dictionary.take(order)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        x, y = np.split(rank[ends.indices.to_numpy()], 2)
        label = np.arange(len(order))
        while len(x):
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (up := label[label])).any():
                label = up
            x, y = label[x], label[y]
            x, y = x[x != y], y[x != y]
        node = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(node)), names.take(pa.array(label[node]))], names=["a", "b"])

    return edges.repartition(1).mapInArrow(run, edges.schema)


def components(edges: DataFrame, most: int = 60, alone: int = 0) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b); root is the least node reachable.

    Nodes may be of any orderable type. Self-loops and repeated edges are harmless, null ends are
    left out, an empty list gives an empty result. Each round is written to the shared folder, so a lost
    executor costs no earlier round; minima are combined before the shuffle and hot nodes only meet
    in joins that adaptive execution can split. Nothing is collected but two numbers a round.
    As soon as no more than ``alone`` edges are left, one task ends the work (nodes of binary or long type): a round
    costs the driver dozens of stages, however few its rows.
    """
    alone = alone if edges.schema["a"].dataType in (BinaryType(), LongType()) else 0
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most):
        if not mark[0]:
            break
        if mark[0] <= alone:
            was, now = now, cut(_ended(now), "edges")
            discard(was)
            break
        new = cut(_small_star(_large_star(now)), "edges")
        was, mark = mark, _mark(new)
        discard(now)
        now = new
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
