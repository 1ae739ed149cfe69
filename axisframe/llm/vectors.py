"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import hashlib
import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .components import components
from .pairblocks import blocked, meetings, spanning

#: Bits of a code; vectors of fewer dimensions are padded with zeros before the rotation.
BITS = 256
#: Rotations whose signs the table keys are drawn from; the first one's make the code.
ROTATIONS = 4
#: Widths of the confidence bound, in standard errors of the estimate.
WIDTH = 5.0
#: Chance of missing a pair exactly at the threshold that the number of tables is chosen for.
MISS = 1e-6
THRESHOLD = 0.9


@cache
def rotation(dim: int, bits: int, seed: int = 3) -> np.ndarray:
    """``dim`` rows of a random rotation of ``bits`` dimensions."""
    g = np.random.Generator(np.random.PCG64(seed)).standard_normal((bits, bits))
    q, r = np.linalg.qr(g)
    return (q * np.sign(np.diag(r)))[:dim]


def code_bits(dim: int) -> int:
    return max(BITS, 64 * math.ceil(dim / 64))


def usable(v):
    """Whether a vector has a nonzero component and none that is null or not finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def clean_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``ident``, v) with v an array of doubles; without null, empty, zero and partly null or non-finite vectors."""
    v = F.col(vector).cast("array<double>")
    return rows.select(ident, v.alias("v")).where(usable(F.col("v")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A column of lists as rows: lists of equal length, or of any up to ``width``, filled up with zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False)
    if width is None:
        return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))
    length = np.diff(c.offsets.to_numpy())
    out = np.zeros((len(c), width))
    out[np.arange(width) < length[:, None]] = flat
    return out


def lane(dim: Column) -> Column:
    """The width at which vectors of a dimension are worked on: the next power of two from 64 on."""
    return F.greatest(F.lit(64), F.pow(F.lit(2.0), F.ceil(F.log2(dim.cast("double")))).cast("int"))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of rotated unit vectors, and the inner product of each with its own code (the correction)."""
    bits = code_bits(x.shape[1])
    z = x @ rotation(x.shape[1], bits)
    return np.packbits(z > 0, axis=1), np.abs(z).sum(1) / math.sqrt(bits)


def estimates(z: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of rotated vectors ``z`` with coded ones, and their standard errors.

    The inner product of z with a code, divided by that of the coded vector with its code, has the true
    inner product as its mean; what is orthogonal to it spreads over bits - 1 directions.
    """
    bits = z.shape[1]
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    dot = (z @ signs.T) / math.sqrt(bits)
    return dot / factor, np.sqrt((1 - factor**2) / (factor**2 * (bits - 1)))


def missed(width: int, tables: int, share: float, bits: int) -> float:
    """The chance that a pair whose signs agree with chance ``share`` shares no table's key.

    All tables draw from the same ``bits`` signs, so a pair with fewer agreeing signs has fewer tables: the mean
    over the binomial number of signs that agree.
    """
    k = np.arange(width, bits + 1)
    log_choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    chance = np.exp([log_choose(bits, x) + x * math.log(share) + (bits - x) * math.log(1 - share) for x in k.tolist()])
    key = np.exp([log_choose(x, width) - log_choose(bits, width) for x in k.tolist()])
    return float((chance * np.exp(tables * np.log1p(-np.minimum(key, 1 - 1e-12)))).sum())


def plan(n: int, threshold: float, bits: int) -> tuple[int, int]:
    """(width of a table key, tables): about a row or a few per key, and a chance below MISS to lose a pair at the
    threshold; both grow slowly with the number of rows."""
    width = int(min(24, max(4, math.ceil(math.log2(max(2, n))) - 2)))
    share = 1 - math.acos(threshold) / math.pi
    low, high = 1, 2
    while missed(width, high, share, bits) > MISS:
        low, high = high, 2 * high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if missed(width, mid, share, bits) <= MISS else (mid + 1, high)
    return width, high


def _spread(x: np.ndarray) -> np.ndarray:
    """Table patterns mixed over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def coded(rows: DataFrame, width: int, tables: int, dim: int) -> DataFrame:
    """class, code, factor and the keys of all tables, each of ``width`` signs; vectors of different dimensions have
    different keys."""
    bits = code_bits(dim)
    rng = np.random.Generator(np.random.PCG64(11))
    pick = np.array([rng.choice(bits * ROTATIONS, width, replace=False) for _ in range(tables)])
    weight = (np.uint64(1) << np.arange(width, dtype=np.uint64)).astype(np.uint64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            code, factor = codes(x)
            on = np.concatenate([np.unpackbits(code, axis=1), *((x @ rotation(dim, bits, 3 + r) > 0).astype(np.uint8) for r in range(1, ROTATIONS))], axis=1)
            own = np.diff(batch.column(1).offsets.to_numpy()).astype(np.uint64)
            keys = np.empty((len(x), tables), np.uint64)
            for t in range(tables):
                keys[:, t] = _spread(_spread(on[:, pick[t]] @ weight + (np.uint64(t) << np.uint64(32))) + own)
            at = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64).ravel()))], names=["class", "code", "factor", "keys"])

    return rows.select("class", "v").mapInArrow(run, "class binary, code binary, factor double, keys array<long>")


_EDGE = "a binary, b binary"


def _edges(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    name = t.column("class").combine_chunks()
    return pa.RecordBatch.from_arrays([name.take(pa.array(i)), name.take(pa.array(j))], names=["a", "b"])


def _candidates(batches, threshold: float, bits: int):
    """Pairs whose codes could belong to vectors at the threshold: Hamming distances bounded by WIDTH standard errors."""
    share = math.acos(threshold) / math.pi
    most = math.ceil(bits * share + WIDTH * math.sqrt(bits * share * (1 - share)))
    for t, edges in meetings(batches, ["key", "pair_a", "pair_b"]):
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(t.num_rows, bits // 64)

        def distance(a, b):
            return np.bitwise_count(a ^ b).sum(1)

        i, j = spanning(
            edges,
            lambda i, j, c=code: distance(c[i], c[j]) <= most,
            lambda x, rows, c=code: distance(c[rows], c[x][None]) <= most,
        )
        if len(i):
            yield _edges(t, i, j)


def _exact(batches, threshold: float, dim: int):
    """Links within a meeting of blocks: estimates from the codes leave out what is surely below the threshold, the inner
    product of all other pairs is computed in double precision."""
    for t, edges in meetings(batches, ["root", "pair_a", "pair_b"]):
        x = matrix(t.column("v"), dim)
        own = np.diff(t.column("v").combine_chunks().offsets.to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = (x @ rotation(dim, code_bits(dim))).astype(np.float32)
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        factor, weight, at = t.column("factor").to_numpy(), t.column("times").to_numpy(), t.column("pair_at").to_numpy()
        a_block, b_block = t.column("pair_a").to_numpy(), t.column("pair_b").to_numpy()
        count, left, right = np.zeros(t.num_rows, np.int64), [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            across = a_block[a] != b_block[a]
            label = np.arange(b - a)
            for r in range(a, b, 512):
                rows = np.arange(r, min(b, r + 512))
                guess, error = estimates(z[rows], code[a:b], factor[a:b])
                maybe = (guess + WIDTH * error >= threshold) & (own[rows][:, None] == own[a:b][None, :])
                maybe &= (at[rows][:, None] != at[a:b][None, :]) if across else (rows[:, None] != np.arange(a, b)[None, :])
                i, j = np.nonzero(maybe)
                link = np.zeros(len(i), bool)
                for s in range(0, len(i), 65536):
                    p, q = rows[i[s : s + 65536]], a + j[s : s + 65536]
                    # The same sum for a pair whichever of its rows comes first.
                    link[s : s + 65536] = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                i, j = i[link] + r, j[link] + a
                np.add.at(count, i, weight[j])
                for p, q in zip(i.tolist(), j.tolist(), strict=True) if len(i) <= b - a else _first(i, j, label, a):
                    p0, q0 = label[p - a], label[q - a]
                    if p0 != q0:
                        label[label == max(p0, q0)] = min(p0, q0)
                        left.append(p)
                        right.append(q)
        i, j = np.array(left, np.int64), np.array(right, np.int64)
        name = t.column("class").combine_chunks()
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([name.take(pa.array(i)), name.take(pa.array(some))]), pa.concat_arrays([name.take(pa.array(j)), pa.nulls(len(some), pa.binary())]), pa.array(np.concatenate([np.zeros(len(i), np.int64), count[some]]))],
            names=["a", "b", "n"],
        )


def _first(i: np.ndarray, j: np.ndarray, label: np.ndarray, a: int):
    """Of many links those that still join two components, row by row."""
    for p in np.unique(i).tolist():
        q = j[i == p]
        q = q[label[q - a] != label[p - a]]
        yield from ((p, y) for y in q.tolist())


def _links(kinds: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(class, n_links, root) of the classes (class, v, times) of one lane, which link within their dimension."""
    bits = code_bits(dim)
    width, tables = plan(kinds.count(), threshold, bits * ROTATIONS)
    sketch = cut(coded(kinds, width, tables, dim), "codes")
    keyed = blocked(sketch.select("class", "code", F.explode("keys").alias("key")), "key", "class")
    keyed = keyed.repartition("key", "pair_a", "pair_b").sortWithinPartitions("key", "pair_a", "pair_b", "class")
    first = components(keyed.mapInArrow(lambda it: _candidates(it, threshold, bits), _EDGE))
    members = first.withColumnRenamed("node", "class").join(kinds, "class").join(sketch.select("class", "code", "factor"), "class")
    members = cut(members.withColumn("root", F.xxhash64("root")), "members")
    met = blocked(members, "root", "class")
    met = met.repartition("root", "pair_a", "pair_b").sortWithinPartitions("root", "pair_a", "pair_b", "class")
    found = cut(met.mapInArrow(lambda it: _exact(it, threshold, dim), "a binary, b binary, n long"), "links")
    discard(sketch, members)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
    facts = kinds.select("class", "times").join(counts, "class", "left").join(roots, "class", "left")
    return facts.select("class", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: ``ident``, n_links, component_id and kept, for links at cosine >= ``threshold`` in double precision.

    Equal vectors are one class with a weight, so copies are never paired. Null, empty, zero and partly null or
    non-finite vectors link with nothing but come back with no links and themselves; vectors link with
    those of their own dimension. A component is named by its smallest id; rows that repeat
    an id are separate vectors with that id. An empty table gives no rows; other columns are not read.

    Key tables over signs of rotated vectors bring likely pairs together, a bucket's codes join what could be near into
    candidate components, and within these blocks of vectors are compared: pairs that an upper confidence
    bound leaves open have their exact product, so no link is below the threshold. A pair at the threshold is lost with a
    chance of about MISS in the tables and as much at either bound.
    """
    kind = rows.schema[ident].dataType.simpleString()
    clean = clean_vectors(rows, ident, vector)
    every = rows.select(ident, F.col(vector).cast("array<double>").alias("v"))

    def name(batches):
        for batch in batches:
            v = batch.column(1)
            off, x = v.offsets.to_numpy(), v.flatten().to_numpy(zero_copy_only=False) + 0.0  # one zero
            off = off - off[0] if len(off) else off
            digests = [hashlib.blake2b(x[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), v], names=[ident, "class", "v"])

    named = cut(clean.mapInArrow(name, f"{ident} {kind}, class binary, v array<double>"), "vectors")
    kinds = named.groupBy("class").agg(F.any_value("v").alias("v"), F.count("*").alias("times"))
    kinds = cut(kinds.withColumn("lane", lane(F.size("v"))), "classes")
    lanes = [r[0] for r in kinds.select("lane").distinct().collect()]  # powers of two, so a few
    odd = every.where(~usable(F.col("v"))).select(ident, F.lit(0).cast("long").alias("n_links"), F.col(ident).alias("component_id"))
    if lanes:
        facts = reduce(DataFrame.union, [_links(kinds.where(F.col("lane") == w).drop("lane"), w, threshold) for w in sorted(lanes)])
        named = named.select(ident, "class").join(facts, "class")
        least = named.groupBy("root").agg(F.min(ident).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        odd = named.join(least, "root", "left").select(ident, "n_links", F.coalesce("least", ident).alias("component_id")).union(odd)
    return odd.withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))
