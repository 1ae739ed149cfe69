"""Operators on matrices as (i, j, v) entries or (i, values) rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.store import LAYOUTS, SPARK_TYPES, Matrix
from .axis import renumbered

#: Bounds of the dtypes, as exact integers or as the largest finite value.
RANGES = {
    **{f"int{b}": (-(1 << b - 1), (1 << b - 1) - 1) for b in (8, 16, 32, 64)},
    **{f"uint{b}": (0, (1 << b) - 1) for b in (8, 16, 32, 64)},
    "bool": (0, 1),
    "float16": (-65504.0, 65504.0),
    "float32": (-3.4028234663852886e38, 3.4028234663852886e38),
    "float64": (-1.7976931348623157e308, 1.7976931348623157e308),
}
_WIDTH = {"float16": 2, "float32": 4, "float64": 8, "bool": 1, **{f"{s}int{b}": b // 8 for s in ("", "u") for b in (8, 16, 32, 64)}}
#: A change of layout that makes a matrix more than so many times as large is refused unless forced.
GROWTH = 4
#: Columns of a dense matrix whose places are broadcast at most, and cells that are filled at a time.
WIDE = 1 << 20
CELLS = 1 << 20


def summed(entries: DataFrame) -> DataFrame:
    """Entries with those of one coordinate added up; partial sums are formed before the shuffle."""
    kind = dict(entries.dtypes)["v"]
    v = F.col("v").cast("long") if kind in ("tinyint", "smallint", "int") else F.col("v")
    return entries.groupBy("i", "j").agg(F.sum(v).alias("v"))


def counts_per(entries: DataFrame, key: str) -> DataFrame:
    """(key, n, magnitude): entries and sum of absolute values per row or column."""
    return entries.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.abs("v")).alias("magnitude"))


def transposed(m: Matrix) -> Matrix:
    """The matrix with its axes swapped; a CSR matrix reads as CSC, entries stay where they are."""
    if not m.sparse:
        return densified(transposed(sparsified(m, keep_zeros=True)))
    flip = {"csr": "csc", "csc": "csr"}[m.layout]
    return Matrix(m.data.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), (m.shape[1], m.shape[0]), m.dtype, flip)


def taken(m: Matrix, rows: DataFrame | None, columns: DataFrame | None, shape: tuple[int, ...]) -> Matrix:
    """Entries on the mapped rows and columns, (pos, new_pos) each; None keeps a side as it is.

    Sparse entries meet each map in a join that the planner broadcasts when the map is small. Rows of
    a dense matrix keep the mapped columns in their new order.
    """
    data = m.data
    if rows is not None:
        data = data.join(rows, F.col("i") == F.col("pos")).drop("i", "pos").withColumnRenamed("new_pos", "i")
    if columns is not None and m.sparse:
        data = data.join(columns, F.col("j") == F.col("pos")).drop("j", "pos").withColumnRenamed("new_pos", "j")
    elif columns is not None:
        data = columns_taken(data, columns, shape[1], SPARK_TYPES[m.dtype])
    return replace(m, data=data.select(*(("i", "j", "v") if m.sparse else ("i", "values"))), shape=shape)


def columns_taken(data: DataFrame, mapping: DataFrame, width: int, kind: str, fill: float | None = None) -> DataFrame:
    """Dense rows (i, values) with the mapped columns (pos, new_pos) in their new places, others holding ``fill``.

    Up to WIDE columns the places are one array, which is broadcast, and a row is taken in one pass; beyond that rows are
    taken apart and meet the map in a join.
    """
    value = F.lit(fill).cast(kind) if fill is not None else F.lit(None).cast(kind)
    if width <= WIDE:
        found = mapping.where((F.col("new_pos") >= 0) & (F.col("new_pos") < width)).select("new_pos", "pos").toArrow()
        places = np.full(width, -1, np.int32)
        places[found.column(0).to_numpy()] = found.column(1).to_numpy()
        one = data.sparkSession.createDataFrame(pa.table({"_order": pa.array([places.tolist()], pa.list_(pa.int32()))}))
        taken_value = lambda p: F.when(p >= 0, F.get("values", p).cast(kind)).otherwise(value)
        return data.crossJoin(F.broadcast(one)).select("i", F.transform("_order", taken_value).alias("values"))  # one row of WIDE numbers at most
    cells = data.select("i", F.posexplode("values").alias("pos", "v")).join(mapping, "pos").select("i", F.col("new_pos").alias("j"), "v")
    empty = data.select("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    return empty.join(cells, ["i", "j"], "left").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce(F.col("v").cast(kind), value).alias("v")))).alias("c")).select("i", F.transform("c", lambda c: c["v"]).alias("values"))


def sparsified(m: Matrix, layout: str = "csr", keep_zeros: bool = False) -> Matrix:
    """A dense matrix as entries: those that are not zero (NaN is not), or all."""
    if m.sparse:
        return replace(m, layout=layout)
    rows = m.data.select("i", F.posexplode("values").alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    return replace(m, data=rows if keep_zeros else rows.where("v <> 0"), layout=layout)


def densified(m: Matrix) -> Matrix:
    """A sparse matrix as rows of values; entries of one coordinate add up, rows without entries are zeros."""
    if not m.sparse:
        return m
    kind, width = SPARK_TYPES[m.dtype], m.shape[1]
    files.ship(m.data.sparkSession)
    # A mark for every row, so that those without entries are there too.
    marks = m.data.sparkSession.range(m.shape[0]).select(F.col("id").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(None).cast(kind).alias("v"))
    rows = m.data.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast(kind).alias("v")).union(marks).repartition("i").sortWithinPartitions("i", "j")
    return replace(m, data=rows.mapInArrow(lambda it: _filled(it, width, kind), f"i long, values array<{kind}>"), layout="dense")


def _filled(batches, width: int, kind: str):
    """Rows of values from entries that come sorted by row, each row begun by a mark; a bounded number of cells is held."""
    held: list[pa.RecordBatch] = []
    size, most = 0, max(1, CELLS // max(1, width))

    def flush(rows: pa.Table):
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        mark = j < 0
        own = np.cumsum(mark) - 1
        n = int(mark.sum())
        at = own[~mark] * width + j[~mark]
        v = rows.column("v").filter(pa.array(~mark))
        if kind.startswith("decimal"):
            x = np.zeros(n * width, object)
            np.add.at(x, at, np.array([int(k) for k in v.to_pylist()], object))
            flat = pa.array(x.tolist(), pa.decimal128(20, 0))
        elif kind == "boolean":
            x = np.zeros(n * width, bool)
            np.logical_or.at(x, at, np.array(v.to_pylist(), bool))
            flat = pa.array(x)
        else:
            # Sums are formed wide and narrowed once, as the sum of entries is.
            wide = np.float64 if kind in ("float", "double") else np.int64
            x = np.bincount(at, v.to_numpy().astype(np.float64), n * width) if wide is np.float64 else np.zeros(n * width, np.int64)
            if wide is np.int64:
                np.add.at(x, at, v.to_numpy().astype(np.int64))
            flat = pa.array(x.astype({"float": np.float32, "tinyint": np.int8, "smallint": np.int16, "int": np.int32}.get(kind, wide)))
        off = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)) if width else pa.array(np.zeros(n + 1, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(i[mark]), pa.ListArray.from_arrays(off, flat)], names=["i", "values"])

    for batch in batches:
        at = 0
        marks = np.flatnonzero(batch.column(1).to_numpy() < 0)
        for k in marks.tolist():
            if size == most:
                held.append(batch.slice(at, k - at))
                yield flush(pa.Table.from_batches(held))
                held, at, size = [], k, 0
            size += 1
        held.append(batch.slice(at))
    if size:
        yield flush(pa.Table.from_batches(held))


def packed(m: Matrix) -> DataFrame:
    """(i, indices, data) of every row that has entries, sorted within the row: the exchange form of CSR."""
    pair = F.array_sort(F.collect_list(F.struct("j", "v"))).alias("pairs")
    rows = m.data.groupBy("i").agg(pair)
    return rows.select("i", F.transform("pairs", lambda p: p["j"]).alias("indices"), F.transform("pairs", lambda p: p["v"]).alias("data"))


def unpacked(rows: DataFrame) -> DataFrame:
    """Entries of (i, indices, data) rows."""
    return rows.select("i", F.explode(F.arrays_zip("indices", "data")).alias("e")).select("i", F.col("e.indices").cast("long").alias("j"), F.col("e.data").alias("v"))


def pointers(m: Matrix, axis: str = "i") -> DataFrame:
    """(pos, start, n) of every row (or column): where its entries begin when all are sorted.

    Counts are added up per block of rows first, so the running sum over all rows is never one task's.
    """
    n = m.shape[0] if axis == "i" else m.shape[1]
    spark = m.data.sparkSession
    rows = spark.range(n).select(F.col("id").alias("pos"))
    rows = rows.join(m.data.groupBy(F.col(axis).alias("pos")).agg(F.count("*").alias("n")), "pos", "left").fillna(0, ["n"])
    rows = rows.withColumn("_block", F.floor(F.col("pos") / 65_536))
    blocks = rows.groupBy("_block").agg(F.sum("n").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.sum("n").over(Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(blocks, "_block").select("pos", (F.col("_start") + F.coalesce(own, F.lit(0))).alias("start"), "n")


def compacted(entries: DataFrame, axis: str) -> DataFrame:
    """Entries whose used positions along ``axis`` are numbered 0, 1, ... in order."""
    used = renumbered(entries.select(F.col(axis).alias("pos")).distinct())
    return entries.join(used, F.col(axis) == F.col("pos")).drop(axis, "pos").withColumnRenamed("new_pos", axis).select("i", "j", "v")


@dataclass(frozen=True)
class CastReport:
    """What a cast does to the values: how many there are, how many change, the largest change, whether any leaves the range."""

    total: int
    changed: int
    worst: float
    overflowed: bool

    @property
    def lossless(self) -> bool:
        return not self.changed and not self.overflowed


def values(m: Matrix) -> DataFrame:
    """All stored values as one column v."""
    return m.data.select("v") if m.sparse else m.data.select(F.explode("values").alias("v"))


def cast_value(v: Column, source: str, target: str) -> Column:
    """A value in the target dtype's Spark type, null where it does not fit; unsigned and half-width bounds are kept."""
    low, high = RANGES[target]
    if target == "bool":
        return v.cast("boolean") if source == "bool" else (v != 0)
    if source == "bool":
        return v.cast("int").cast(SPARK_TYPES[target])
    if target.startswith("float"):
        out = v.cast("double") if target == "float64" else v.cast("float")
        if target == "float16":
            # Eleven significant bits, or steps of 2 ** -24 below the normal range.
            x = v.cast("double")
            step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))) - 10, F.lit(-24)))
            out = F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x / step) * step).cast("float")
            out = F.when(F.abs(out) > 65504.0, F.lit(None)).otherwise(out)
        return out
    whole = v if source.startswith(("int", "uint")) else F.when(F.isnan(v), F.lit(None)).otherwise(F.when(v >= 0, F.floor(v.cast("double"))).otherwise(F.ceil(v.cast("double"))))
    exact = whole.try_cast("decimal(38,0)")
    return F.when((exact >= F.lit(str(low)).cast("decimal(38,0)")) & (exact <= F.lit(str(high)).cast("decimal(38,0)")), exact).try_cast(SPARK_TYPES[target])


def cast_report(m: Matrix, target: str) -> CastReport:
    """Cast every value and back, in one aggregate, and count what does not return. NaN returns as NaN."""
    v, source = F.col("v"), m.dtype
    there = cast_value(v, source, target)
    floats = source.startswith("float")
    x = v.cast("int").cast("double") if source == "bool" else v.cast("double")
    y = there.cast("int").cast("double") if target == "bool" else there.cast("double")
    back = there.cast(SPARK_TYPES[source]) if source.startswith("float") and target != "bool" else y
    same = F.coalesce((x == back.cast("double")) | (F.isnan(x) & F.isnan(back.cast("double"))), F.lit(False)) if floats else F.coalesce(x == y, F.lit(False))
    if not floats and target.startswith("float") and source in ("int64", "uint64"):
        # A double cannot tell large whole numbers apart; compare them as such.
        same = F.coalesce(v.cast("decimal(38,0)") == there.try_cast("decimal(38,0)"), F.lit(False))
    low, high = (float(b) for b in RANGES[target])
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.coalesce(finite & ((x > high) | (x < low)), F.lit(False)) if target != "bool" else F.lit(False)
    delta = F.abs(x - y)
    row = values(m).agg(
        F.count("*").alias("total"), F.count_if(~same).alias("changed"), F.max(F.when(~same & ~F.isnan(delta) & (delta < float("inf")), delta)).alias("worst"), F.count_if(out).alias("out")
    ).first()
    return CastReport(row["total"], row["changed"], row["worst"] or 0.0, bool(row["out"]))


def cast(m: Matrix, target: str, force: bool = False) -> Matrix:
    """The matrix in another dtype. A cast that changes a value is refused unless forced; one that leaves the range always."""
    if target not in SPARK_TYPES:
        raise ValueError(f"no dtype {target!r}: {', '.join(SPARK_TYPES)}")
    if target == "float16" and m.sparse:
        raise ValueError("a sparse matrix cannot hold float16")
    if target == m.dtype:
        return m
    report = cast_report(m, target)
    if report.overflowed or report.changed and not force:
        why = "values exceed its range" if report.overflowed else f"largest change {report.worst:g}"
        raise ValueError(f"{m.dtype} -> {target} loses {report.changed} of {report.total} values, {why}")
    if m.sparse:
        return replace(m, data=m.data.withColumn("v", cast_value(F.col("v"), m.dtype, target)), dtype=target)
    return replace(m, data=m.data.withColumn("values", F.transform("values", lambda v: cast_value(v, m.dtype, target))), dtype=target)


def laid_out(m: Matrix, layout: str, force: bool = False) -> Matrix:
    """The matrix as csr, csc, dense or sparse (csr unless it is sparse already). Growth over GROWTH times is refused
    unless forced."""
    if layout == "sparse":
        layout = m.layout if m.sparse else "csr"
    if layout not in LAYOUTS:
        raise ValueError(f"no layout {layout!r}: {', '.join((*LAYOUTS, 'sparse'))}")
    if layout == m.layout:
        return m
    if m.sparse and layout != "dense":
        return replace(m, layout=layout)
    if not force:
        cell, n = _WIDTH[m.dtype], m.shape[0] * m.shape[1]
        stored = values(m).where("v <> 0").count() if not m.sparse else m.data.count()
        sizes = {"dense": n * cell, "sparse": stored * (cell + 4) + 8 * (m.shape[0] + 1)}
        now, then = (sizes["sparse"], sizes["dense"]) if m.sparse else (sizes["dense"], sizes["sparse"])
        if then > GROWTH * max(now, 1):
            raise ValueError(f"{m.layout} -> {layout} makes the matrix {then / max(now, 1):.1f} times as large")
    return densified(m) if layout == "dense" else sparsified(m, layout)


def index_dtype(largest: int, wanted: str | None = None) -> str:
    """int32 if it holds ``largest``, else int64; a wanted one that does not is refused, force or not."""
    fits = "int32" if largest < 1 << 31 else "int64"
    if wanted not in (None, "int32", "int64"):
        raise ValueError(f"indices are int32 or int64, not {wanted}")
    if wanted == "int32" and fits == "int64":
        raise ValueError(f"int32 indices cannot hold {largest}")
    return wanted or fits


def density(m: Matrix) -> float:
    """Share of cells that hold something other than zero."""
    cells = m.shape[0] * m.shape[1]
    return values(m).where("v <> 0").count() / cells if cells else 0.0


def check_entries(entries: DataFrame, shape: tuple[int, int], name: str = "matrix") -> None:
    """Refuse entries outside the shape, in one aggregate."""
    r = entries.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    if r[0] is not None and (r[0] < 0 or r[2] < 0 or r[1] >= shape[0] or r[3] >= shape[1]):
        raise ValueError(f"{name}: an entry lies outside {shape[0]} x {shape[1]}")


def digest(entries: DataFrame):
    """Count and two sums of hashes of entries, whatever their order; values are hashed in their own type, so that whole
    numbers which one float stands for differ. Equal matrices have equal ones; ``same`` tells what has."""
    v = F.col("v")
    if dict(entries.dtypes)["v"] in ("float", "double"):
        v = v + F.lit(0.0).cast(dict(entries.dtypes)["v"])  # one zero
    sums = [F.sum(F.xxhash64(F.lit(seed), F.col("i").cast("long"), F.col("j").cast("long"), v).cast("decimal(38,0)")) for seed in (1, 2)]
    return entries.agg(F.count("*"), *sums).first()


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations have the same columns, types and rows: counts and hashes first, then an exact difference."""
    if a.dtypes != b.dtypes:
        return False
    columns = [F.col(f"`{c}`") for c in a.columns]
    mark = lambda d: d.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(s), *columns).cast("decimal(38,0)")) for s in (1, 2)]).first()
    return mark(a) == mark(b) and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ascending(rows: DataFrame, order: str, key: str, strictly: bool = True) -> bool:
    """Whether ``key`` rises along ``order``: within blocks of positions, and from each block to the next."""
    at = F.floor(F.col(order) / 65_536)
    before = F.lag(key).over(Window.partitionBy("_block").orderBy(order))
    falls = before >= F.col(key) if strictly else before > F.col(key)
    marked = rows.withColumn("_block", at).withColumn("_falls", falls)
    blocks = marked.groupBy("_block").agg(F.count_if("_falls").alias("n"), F.min_by(key, order).alias("a"), F.max_by(key, order).alias("b"))
    last = F.lag("b").over(Window.orderBy("_block"))  # one row a block
    bad = last >= F.col("a") if strictly else last > F.col("a")
    return not blocks.withColumn("_bad", bad).agg(F.sum("n") + F.count_if("_bad")).first()[0]


def grouped(rows: DataFrame, order: str, key: str) -> bool:
    """Whether equal keys stand together along ``order``: no key begins a run twice."""
    before = F.lag(key).over(Window.partitionBy("_block").orderBy(order))
    marked = rows.withColumn("_block", F.floor(F.col(order) / 65_536))
    starts = marked.withColumn("_new", ~F.col(key).eqNullSafe(before))
    blocks = marked.groupBy("_block").agg(F.min_by(key, order).alias("a"), F.max_by(key, order).alias("b"))
    joins = blocks.withColumn("_last", F.lag("b").over(Window.orderBy("_block"))).where(F.col("_last").eqNullSafe(F.col("a")))
    runs = starts.where("_new").count() - joins.where("_block > 0").count()
    return runs == rows.select(key).distinct().count()


def check_pointers(starts: DataFrame, n: int, what: str = "matrix") -> None:
    """Refuse pointers (pos, start) that do not begin at 0, fall, or end elsewhere than at ``n``."""
    r = starts.agg(F.min_by("start", "pos"), F.max_by("start", "pos")).first()
    if r[0] != 0 or r[1] != n or not ascending(starts, "pos", "start", strictly=False):
        raise ValueError(f"{what}: its row pointers do not run from 0 up to {n}")


def index_dtypes(dtypes: Sequence[str], largest: int) -> str:
    """The index dtype of a concatenation: the widest of its inputs, widened only if it cannot hold ``largest``."""
    wanted = "int64" if "int64" in dtypes else "int32"
    return "int64" if largest >= 1 << 31 else wanted
