"""Positions, names and categories of the axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, predicate
from ..sources import files
from ..sources.store import Categories, Frame

#: Positions that are numbered anew in one group.
BLOCK = 65_536


def renumbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with new_pos: 0, 1, ... in the order of pos.

    Rows are counted per block of positions, the counts added up (one row a block), and each block is
    numbered by itself, so no task sees all rows.
    """
    at = F.floor(F.col("pos") / block)
    counts = rows.groupBy(at.alias("_block")).count()
    start = F.sum("count").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_block", F.coalesce(start, F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy("_block").orderBy("pos")) - 1
    return rows.withColumn("_block", at).join(counts, "_block").withColumn("new_pos", (F.col("_start") + n).cast("long")).drop("_block", "_start")


def select(frame: Frame, expression: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """pos of the rows that an expression selects and whose name is among ``wanted`` (name); all without either."""
    rows = frame.data
    if expression is not None:
        rows = rows.where(predicate.to_column(predicate.parse(expression), rows.schema))
    if wanted is not None:
        rows = rows.join(wanted.select("name").distinct(), "name", "left_semi")
    return rows.select("pos")


def absent(frame: Frame, wanted: DataFrame) -> DataFrame:
    """Distinct wanted names that the axis does not have."""
    return wanted.select("name").distinct().join(frame.data.select("name"), "name", "left_anti")


def names_at(frame: Frame, positions: DataFrame | None = None) -> DataFrame:
    """(pos, name) of an axis, at given positions (pos) if any are."""
    rows = frame.data.select("pos", "name")
    return rows if positions is None else rows.join(positions.select("pos").distinct(), "pos", "left_semi")


def row_map(keep: DataFrame) -> DataFrame:
    """(pos, new_pos) of kept positions in source order."""
    return renumbered(keep.select("pos").distinct())


def take(frame: Frame, mapping: DataFrame, prune: bool = True) -> Frame:
    """Rows of ``frame`` at mapped positions, numbered anew; categories that no row has go if ``prune``."""
    out = frame.data.join(mapping, "pos").drop("pos").withColumnRenamed("new_pos", "pos").select(frame.data.columns)
    return Frame(out, pruned(out, frame.categories) if prune else frame.categories)


def pruned(rows: DataFrame, categories: dict[str, Categories]) -> dict[str, Categories]:
    """Categories without the labels that no row has, in one pass; at most as many labels come back as there are."""
    if not categories:
        return {}
    used = rows.agg(*[F.collect_set(F.when(codes(F.col(f"`{c}`"), k.labels) >= 0, F.col(f"`{c}`"))).alias(c) for c, k in categories.items()]).first().asDict()
    return {c: Categories(tuple(x for x in k.labels if x in set(used[c])), k.ordered) for c, k in categories.items()}


def prune_colors(colors: Sequence[str], before: Categories, after: Categories) -> list[str]:
    """Colours of the categories that stayed; a list of another length than the categories is left as it is."""
    if len(colors) != len(before.labels):
        return list(colors)
    kept = set(after.labels)
    return [x for x, label in zip(colors, before.labels, strict=True) if label in kept]


def codes(column: Column, labels: Sequence) -> Column:
    """Category codes of a value column; -1 where it is null or none of the labels."""
    place = F.array_position(F.lit(list(labels)) if labels else F.array().cast("array<string>"), column)
    return F.coalesce(place - 1, F.lit(-1)).cast("int")


def labels_of(column: Column, labels: Sequence) -> Column:
    """Values of category codes; codes outside the labels are null."""
    inside = (column >= 0) & (column < len(labels))
    return F.when(inside, F.element_at(F.lit(list(labels)), (column + 1).cast("int"))) if labels else F.lit(None).cast("string")


def code_dtype(n: int) -> str:
    """The narrowest integer that holds ``n`` codes and -1."""
    return "int8" if n <= 127 else "int16" if n <= 32_767 else "int32"


def categorised(frame: Frame, column: str, most: int = 65_536) -> Frame:
    """``frame`` with a column made categorical, labels in natural order; refused above ``most`` labels."""
    found = [r[0] for r in frame.data.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column}: more than {most} labels")
    return Frame(frame.data, {**frame.categories, column: Categories(tuple(names.natural(found)))})


def groups(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, first): rows per label in order of first appearance; missing (null, NaN) is a group of its own, apart from
    the empty text."""
    c = F.col(label)
    if dict(rows.dtypes)[label] in ("float", "double"):
        c = F.when(~F.isnan(c), c)
    return rows.groupBy(c.alias("label")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def shared_names(axes: Sequence[DataFrame]) -> DataFrame:
    """(name, pos) of names that all axes have, in the first one's order."""
    out = axes[0].select("name", "pos")
    for other in axes[1:]:
        out = out.join(other.select("name"), "name", "left_semi")
    return out


def all_names(axes: Sequence[DataFrame], lengths: Sequence[int]) -> DataFrame:
    """(name, pos) of names that any axis has: the common order if all that are not empty agree, else sorted.

    Which holds is decided by one aggregate per axis.
    """
    full = [a for a, n in zip(axes, lengths, strict=True) if n]
    if not full:
        return axes[0].select("name", "pos")
    first = full[0].select("name", "pos")
    same = all(first.join(a.select("name", "pos"), ["name", "pos"], "left_anti").isEmpty() and a.select("name", "pos").join(first, ["name", "pos"], "left_anti").isEmpty() for a in full[1:])
    if same:
        return first
    every = full[0].select("name")
    for a in full[1:]:
        every = every.union(a.select("name"))
    return ranked(every.distinct())


def ranked(rows: DataFrame) -> DataFrame:
    """(name, pos) of distinct names in their order: ranges are sorted apart and written with the place of each name in its
    range, and what the ranges before it hold is added."""
    spark = rows.sparkSession
    path = files.scratch(spark, "names")
    rows.select("name").repartitionByRange("name").sortWithinPartitions("name").withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes, start = sorted(placed.groupBy("_part").count().collect()), 0  # one row a range
    before = []
    for part, n in sizes:
        before.append((part, start))
        start += n
    own = spark.createDataFrame(before, "_part long, _start long")
    return placed.join(F.broadcast(own), "_part").select("name", (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))


def reordered(frame: Frame, wanted: DataFrame) -> Frame:
    """A frame's rows put in the order of ``wanted`` (pos, name); a name that it lacks or has twice is refused."""
    meets = wanted.select("pos", "name").join(frame.data.withColumnRenamed("pos", "_own"), "name", "left")
    n, have, distinct = meets.agg(F.count("*"), F.count("_own"), F.count_distinct("pos")).first()
    if have < n:
        raise ValueError(f"{n - have} names are without a row")
    if distinct < n:
        raise ValueError("a name has more than one row")
    return Frame(meets.drop("_own").select(*frame.data.columns), frame.categories)


def few_labels(rows: DataFrame, column: str, most: int) -> list | None:
    """The distinct labels of a column in natural order, None if there are more than ``most``; no more than that many are
    looked for."""
    found = [r[0] for r in rows.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()]
    return names.natural(found) if len(found) <= most else None


def null_counts(rows: DataFrame) -> dict[str, int]:
    """Missing entries of every column, in one aggregate."""
    r = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns]).first()
    return r.asDict() if r is not None else {}


def repeated_names(frame: DataFrame) -> DataFrame:
    """(name, n) of names that occur more than once."""
    return frame.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
