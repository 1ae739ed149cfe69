"""Joins of foreign tables to an axis, with their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Match:
    """How a table met an axis: rows of the table without a partner, of the axis without one, keys that repeat."""

    matched: int
    extra: int
    missing: int
    repeated: int


def check(frame: DataFrame, table: DataFrame, key: str, name: str = "name") -> Match:
    """Count how ``table`` meets the axis, in one pass over the full join of keys counted per side."""
    left = frame.groupBy(F.col(name).alias("k")).agg(F.count("*").alias("a"))
    right = table.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("b"))
    r = left.join(right, "k", "full").agg(
        F.sum(F.when(F.col("b").isNotNull(), F.col("a"))).alias("matched"),
        F.sum(F.when(F.col("a").isNull(), F.col("b"))).alias("extra"),
        F.sum(F.when(F.col("b").isNull(), F.col("a"))).alias("missing"),
        F.count_if(F.col("b") > 1).alias("repeated"),
    ).first()
    return Match(*(int(x or 0) for x in r))


def checked_left(frame: DataFrame, table: DataFrame, key: str, allow_missing: bool = True, fills: dict | None = None, what: str = "table") -> tuple[DataFrame, Match]:
    """``frame`` (pos, name, ...) with the columns of ``table``; refused if a key repeats or none meets, and if rows stay
    without a partner unless that is allowed. Gaps take ``fills``."""
    found = check(frame, table, key)
    if found.repeated:
        raise ValueError(f"{what}: {found.repeated} keys repeat")
    if not found.matched and found.missing:
        raise ValueError(f"{what}: no key is among the names")
    if found.missing and not allow_missing:
        raise ValueError(f"{what}: {found.missing} names are without a row")
    out = frame.join(table.withColumnRenamed(key, "_key"), F.col("name") == F.col("_key"), "left").drop("_key")
    for c, v in (fills or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out, found


def matched_inner(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(pos, other_pos) of equal names; every name of ``left`` must be there, once."""
    pairs = left.select(name, "pos").join(right.select(name, F.col("pos").alias("other_pos")), name, "left")
    r = pairs.agg(F.count("*").alias("n"), F.count("other_pos").alias("m"), F.count_distinct("pos").alias("d")).first()
    if r["m"] < r["n"]:
        raise ValueError(f"{r['n'] - r['m']} names are without a partner")
    if r["d"] < r["n"]:
        raise ValueError("a name has more than one partner")
    return pairs.select("pos", "other_pos")


def same_in_order(left: DataFrame, right: DataFrame, columns: list[str]) -> bool:
    """Whether two axes have equal columns at equal positions."""
    a, b = left.select("pos", *columns), right.select("pos", *columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def global_rows(names: DataFrame, own: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(global_pos, pos) that puts an axis of one modality into the global one: by a stored map (global_pos, one-based place,
    0 for absent), which must be one to one, or else by unique names."""
    if mapping is not None:
        out = mapping.where("place > 0").select("global_pos", (F.col("place") - 1).alias("pos"))
        r = out.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b")).first()
        n = own.count()
        if r["n"] != n or r["d"] != n or n and (r["a"] != 0 or r["b"] != n - 1):
            raise ValueError("the stored map is not one to one")
        return out
    for side, df in (("global", names), ("own", own)):
        if not df.groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError(f"{side} names repeat, so they cannot place rows")
    out = own.select("name", "pos").join(names.select("name", F.col("pos").alias("global_pos")), "name", "left")
    if not out.where("global_pos IS NULL").isEmpty():
        raise ValueError("a name is not among the global ones")
    return out.select("global_pos", "pos")


def remapped_graph(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairwise entries (i, j, v) with both ends mapped by (pos, new_pos); entries that lose an end go."""
    a = mapping.select(F.col("pos").alias("i"), F.col("new_pos").alias("_i"))
    b = mapping.select(F.col("pos").alias("j"), F.col("new_pos").alias("_j"))
    return edges.join(a, "i").join(b, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "v")


def looked_up(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of each code by (code, label); codes without a label are null."""
    return rows.join(labels.withColumnRenamed("code", "_code"), F.col(column) == F.col("_code"), "left").drop("_code")
