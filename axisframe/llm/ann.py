"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .vectors import matrix, usable

#: Neighbours of a node in the graph, most rounds of descent, and the share of changed neighbours below which it ends.
NEIGHBOURS = 20
ROUNDS = 6
SETTLED = 0.1
#: Rows of a shard, each of which has a graph of its own; queries in a block.
SHARD = 4096
BLOCK = 512
#: Nodes that a search keeps in view, that it starts from at least and that it opens at once.
BEAM = 300
STARTS = 48
OPEN = 8
#: Random edges of a node beside its neighbours in the search.
LONG = 6


def shards(rows: DataFrame, ident: str, vector: str, size: int = SHARD) -> DataFrame:
    """(shard, first, many, node, place, id, v): usable vectors, those of each dimension dealt by a hash into shards of about
    ``size`` rows, which are numbered from ``first`` on; equal vectors of a shard are one node, places are a
    row's own."""
    v = F.col(vector).cast("array<double>")
    clean = cut(rows.select(F.col(ident).alias("id"), v.alias("v")).where(usable(F.col("v"))), "vectors")
    dims = clean.groupBy(F.size("v").alias("dim")).count().collect()  # no more rows than the longest vector is long
    plan, at = [], 0
    for dim, n in sorted(dims):
        many = max(1, -(-n // size))
        plan.append((dim, at, many))
        at += many
    own = clean.sparkSession.createDataFrame(plan, "dim int, first int, many int")
    # Rows that repeat an id and a vector are dealt apart too.
    deal = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("many")).cast("int")
    dealt = cut(clean.withColumn("dim", F.size("v")).join(F.broadcast(own), "dim").withColumn("shard", F.col("first") + deal).drop("dim"), "dealt")
    discard(clean)
    order = Window.partitionBy("shard")
    return dealt.select("shard", "first", "many", (F.dense_rank().over(order.orderBy("v")) - 1).alias("node"), (F.row_number().over(order.orderBy("v", "id")) - 1).alias("place"), "id", "v")


def _random_graph(nodes: DataFrame, k: int) -> DataFrame:
    """Each node with ``k`` others of its shard by a hash of the node."""
    many = nodes.groupBy("shard").agg(F.count("*").cast("int").alias("many"))  # one row a shard
    rows = nodes.select("shard", "node").join(many, "shard").where("many > 1")
    pick = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.pmod(F.col("node") + 1 + F.pmod(F.xxhash64("shard", "node", i), F.col("many") - 1), F.col("many")).cast("int"))
    return rows.select("shard", "node", F.array_distinct(pick).alias("near"))


def _lists(graph: DataFrame, most: int) -> DataFrame:
    """(shard, node, around): neighbours and up to ``most`` of those that have the node as theirs, chosen by a hash."""
    back = graph.select("shard", F.explode("near").alias("to"), F.col("node").alias("from"))
    back = back.groupBy("shard", F.col("to").alias("node")).agg(F.collect_list(F.struct(F.xxhash64("from", "to").alias("h"), "from")).alias("back"))
    back = back.select("shard", "node", F.transform(F.slice(F.array_sort("back"), 1, most), lambda x: x["from"]).alias("back"))
    both = graph.join(back, ["shard", "node"], "left")
    return both.select("shard", "node", F.array_distinct(F.concat("near", F.coalesce("back", F.array().cast("array<int>")))).alias("around"))


def _tops(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest among neighbours and candidates of each node of a shard."""
    shard = right.column("shard")[0].as_py() if right.num_rows else 0
    order = np.argsort(right.column("node").to_numpy())
    x = matrix(right.column("v"))[order].astype(np.float32)
    square = (x * x).sum(1)
    node = left.column("node").to_numpy()
    c = left.column("around").combine_chunks()
    width = np.diff(c.offsets.to_numpy())
    owner, other = np.repeat(node, width), c.flatten().to_numpy()
    # Distinct (node, candidate) pairs, in order of the node.
    pair = np.unique(owner.astype(np.int64) * len(x) + other)
    owner, other = pair // max(1, len(x)), pair % max(1, len(x))
    keep = owner != other
    owner, other = owner[keep], other[keep]
    d = np.empty(len(owner), np.float32)
    for a in range(0, len(owner), 200_000):
        i, j = owner[a : a + 200_000], other[a : a + 200_000]
        d[a : a + 200_000] = square[j] - 2 * np.einsum("ij,ij->i", x[i], x[j])
    by = np.lexsort((d, owner))
    owner, other = owner[by], other[by]
    first = np.searchsorted(owner, np.arange(len(x) + 1))
    rank = np.arange(len(owner)) - first[owner]
    take = rank < k
    owner, other = owner[take], other[take].astype(np.int32)
    n = np.bincount(owner, minlength=len(x))
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.table({"shard": pa.array(np.full(len(x), shard, np.int32)), "node": pa.array(np.arange(len(x), dtype=np.int32)), "near": pa.ListArray.from_arrays(pa.array(at), pa.array(other))})


def descend(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(shard, node, near): about the ``k`` nearest of each node by NN-descent.

    A round joins the neighbours of each node with those nodes' own neighbours, and their reverse, on the node in between;
    the candidates that come of it meet the vectors of their shard, whose size is bounded, and the nearest stay. Each
    round is written to the shared folder.
    """
    graph = cut(_random_graph(nodes, k), "graph")
    where = nodes.select("shard", "node", "v")
    for _ in range(rounds):
        around = cut(_lists(graph, k), "around")
        hops = graph.select("shard", F.col("node").alias("of"), F.explode("near").alias("node"))
        two = hops.join(around, ["shard", "node"]).select("shard", F.col("of").alias("node"), "around")
        found = two.union(around.select("shard", "node", "around"))
        new = found.groupBy("shard").cogroup(where.groupBy("shard")).applyInArrow(lambda a, b: _tops(a, b, k), "shard int, node int, near array<int>")
        new = cut(new, "graph")
        old = graph.select("shard", "node", F.col("near").alias("was"))
        change = new.join(old, ["shard", "node"]).agg(F.avg(F.size(F.array_except("near", "was")) / F.lit(k))).first()[0]
        discard(graph)
        discard(around)
        graph = new
        if change is None or change < SETTLED:
            break
    return graph


def _starts(x: np.ndarray, square: np.ndarray, many: int) -> np.ndarray:
    """Nodes that cover a shard: each the farthest from those before it, and as many evenly spaced ones."""
    at, out = 0, []
    far = np.full(len(x), np.inf, np.float32)
    for _ in range(min(many, len(x))):
        out.append(at)
        far = np.minimum(far, square - 2 * (x @ x[at]) + square[at])
        at = int(far.argmax())
    return np.union1d(out, np.linspace(0, len(x) - 1, many).astype(np.int64))


def _search(left: pa.Table, right: pa.Table, top: int, beam: int) -> pa.Table:
    """The nearest rows of a shard to each query of a block, by greedy search from starts that cover it.

    A group of more nodes than a node has neighbours may have no edge to the rest, so there are more starts than such
    groups, and every node has random edges too.
    """
    out_q, out_id, out_d, out_place = [], [], [], []
    if left.num_rows and right.num_rows:
        order = np.argsort(left.column("node").to_numpy())
        full = matrix(left.column("v"))[order]
        x = full.astype(np.float32)
        square = (x * x).sum(1)
        members = left.column("ids").combine_chunks().take(pa.array(order)).to_pylist()
        least = np.array([x[0] if x[0] is not None else np.iinfo(np.int64).max for x in members], np.int64)
        c = left.column("around").combine_chunks().take(pa.array(order))
        at, flat = c.offsets.to_numpy(), c.flatten().to_numpy()
        at = at - at[0]
        shard, n = left.column("shard")[0].as_py(), len(x)
        # A shard that fits into view is seen as a whole.
        spread = np.arange(n) if n <= beam else _starts(x, square, max(STARTS, n // NEIGHBOURS))
        far = np.random.default_rng(n).integers(0, n, (n, LONG))
        q = matrix(right.column("v"))
        for r in range(right.num_rows):
            y, own = q[r].astype(np.float32), right.column("node")[r].as_py() if right.column("home")[r].as_py() == shard else -1
            seen = np.zeros(n, bool)
            pool = spread
            if own >= 0:
                pool = np.union1d(spread, flat[at[own] : at[own + 1]])
            seen[pool] = True
            d = square[pool] - 2 * (x[pool] @ y)
            opened = np.zeros(len(pool), bool)
            while True:
                near = np.lexsort((least[pool], d))[:beam]
                pool, d, opened = pool[near], d[near], opened[near]
                todo = np.flatnonzero(~opened)[:OPEN]
                if not len(todo):
                    break
                opened[todo] = True
                new = np.unique(np.concatenate([far[pool[todo]].ravel(), *[flat[at[p] : at[p + 1]] for p in pool[todo]]]))
                new = new[~seen[new]]
                seen[new] = True
                pool, d = np.concatenate([pool, new]), np.concatenate([d, square[new] - 2 * (x[new] @ y)])
                opened = np.concatenate([opened, np.zeros(len(new), bool)])
            # All that rounding could put among the nearest, and ties of the last of them.
            best = pool[d <= d[min(top, len(d) - 1)] + 1e-4 * (np.abs(d[0]) + (y * y).sum())]
            exact = np.sqrt(((full[best] - q[r]) ** 2).sum(1))
            query, rows = right.column("query")[r].as_py(), []
            for p, e in zip(best.tolist(), exact.tolist(), strict=True):
                ids = list(members[p])
                if p == own and query in ids:
                    ids.remove(query)
                rows += [(e, i is None, i or 0) for i in ids]
            rows = sorted(rows)[:top]
            out_q += [query] * len(rows)
            out_place += [(right.column("home")[r].as_py() << 32) + right.column("place")[r].as_py()] * len(rows)
            out_id += [None if none else i for _, none, i in rows]
            out_d += [e for e, *_ in rows]
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "place": pa.array(out_place, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_d, pa.float64())})


def nearest(rows: DataFrame, is_query, top: int = 10, ident: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found to each row that meets the condition ``is_query``.

    Score is the Euclidean distance in double precision; ties go to the smaller id; a query's own row is no candidate, other
    rows with its id are. Equal vectors of a shard are one node, which gives its smallest ids. Null, empty, zero and partly
    null or non-finite vectors take no part, and vectors are near those of their own dimension only. Every shard's graph is searched for every query, queries in blocks, and
    the shards' best are merged; shards smaller than the beam are searched whole, so that few rows give all candidates. An
    empty table gives no rows.
    """
    own = cut(shards(rows, ident, vector, shard), "rows")
    # No answer needs more than the ``top`` smallest ids of a node, and its own row besides.
    nodes = own.groupBy("shard", "node").agg(F.any_value("v").alias("v"), F.slice(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), 1, top + 1)["id"].alias("ids"))
    nodes = cut(nodes, "nodes")
    graph = descend(nodes, k)
    around = _lists(graph, 2 * k)
    ready = nodes.join(around, ["shard", "node"], "left").withColumn("around", F.coalesce("around", F.array().cast("array<int>")))
    queries = own.where(is_query(F.col("id"))).select(F.col("id").alias("query"), F.col("shard").alias("home"), "first", "many", "node", "place", "v")
    queries = cut(queries, "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query", "home", "place"), F.lit(blocks)).cast("int"))
    here = cut(ready, "ready").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1))).drop("first", "many")
    found = here.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda a, b: _search(a, b, top, beam), "query_id long, place long, vec_id long, score double")
    order = Window.partitionBy("query_id", "place").orderBy("score", F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
