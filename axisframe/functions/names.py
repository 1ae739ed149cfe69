"""Names of outputs, elements and rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_stem(label: str | None) -> str:
    """A label as part of a file name: separators and blanks as underscores, other signs left out, NA if nothing stays."""
    kept = re.sub(r"[/\\]|\s+", "_", (label or "").strip())
    return re.sub(r"[^\w.-]+", "", kept, flags=re.ASCII) or "NA"


def file_stem_column(c: Column) -> Column:
    """``file_stem`` of a text column."""
    kept = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"[/\\]|\s+", "_")
    kept = F.regexp_replace(kept, r"[^A-Za-z0-9_.-]+", "")
    return F.when(c.isNull() | (kept == ""), "NA").otherwise(kept)


def distinct_stems(labels: Sequence[str | None]) -> dict[str | None, str]:
    """A stem of its own for each label, apart from case.

    The missing label comes first, then labels that are stems as they stand, then the rest in order;
    one whose stem is taken gets the first free number.
    """
    rank = lambda x: 0 if x is None else 1 if file_stem(x) == x else 2
    given: dict[str | None, str] = {}
    used: set[str] = set()
    late = []
    for label in sorted(dict.fromkeys(labels), key=rank):
        stem = file_stem(label)
        if stem.casefold() in used:
            late.append(label)
        else:
            used.add(stem.casefold())
            given[label] = stem
    order = {x: k for k, x in enumerate(labels)}
    for label in sorted(late, key=order.__getitem__):
        given[label] = numbered(file_stem(label), used, fold=True)
    return given


def numbered(name: str, used: set[str], fold: bool = False) -> str:
    """``name_1``, ``name_2``, ... : the first that is free, which then is not."""
    k = 1
    while (f"{name}_{k}".casefold() if fold else f"{name}_{k}") in used:
        k += 1
    used.add(f"{name}_{k}".casefold() if fold else f"{name}_{k}")
    return f"{name}_{k}"


def claim(name: str, used: set[str]) -> str:
    """``name`` if it is free, else the first free numbered one."""
    if name not in used:
        used.add(name)
        return name
    return numbered(name, used)


def member_name(name: str) -> str:
    """A name that can stand as one part of an element's path."""
    return "_" + name if name.strip(".") == "" and len(name) < 3 else name.replace("/", "_")


def natural_key(text: str) -> tuple:
    """Order in which A2 comes before A10, over decomposed characters."""
    pieces = re.split(r"([0-9]+)", unicodedata.normalize("NFD", text))
    return tuple(int(p) if k & 1 else p for k, p in enumerate(pieces))


def natural(labels: Iterable) -> list:
    """Labels in natural order: text by ``natural_key`` (plain order where that ties), other kinds by value."""
    rows = sorted(labels)
    return sorted(rows, key=natural_key) if rows and isinstance(rows[0], str) else rows


def natural_sort_column(c: Column, width: int = 20) -> Column:
    """A text that sorts as the natural order does, digit runs padded to ``width``; characters are not decomposed."""
    padded = F.transform(F.split(F.regexp_replace(c, "([0-9]+)", "\u0001$1\u0001"), "\u0001"), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p))
    return F.array_join(padded, "")


def unique_rows(frame: DataFrame, join: str = "-") -> DataFrame:
    """``frame`` (pos, name, ...) with names made distinct: the first of a name stays, later ones are numbered from 1.

    Numbers skip names that exist. Only repeated names are windowed, each in a group of its own; where
    a numbered name exists already, the count of such names is added until none clashes.
    """
    n = F.row_number().over(Window.partitionBy("name").orderBy("pos")) - 1
    rows = frame.withColumn("_n", n)
    again = rows.where("_n > 0").select("pos", "name", "_n")
    # The numbers that existing names occupy: name-k for a repeated name.
    repeated = again.groupBy("name").agg(F.max("_n").alias("_most"))
    parts = frame.select(F.regexp_extract("name", f"^(.*){re.escape(join)}([1-9][0-9]{{0,8}})$", 1).alias("base"), F.regexp_extract("name", f"^(.*){re.escape(join)}([1-9][0-9]{{0,8}})$", 2).try_cast("int").alias("k"))
    used = parts.where("k IS NOT NULL").join(repeated.select("name"), F.col("base") == F.col("name"), "left_semi").groupBy("base").agg(F.array_sort(F.collect_set("k")).alias("_used"))
    again = again.join(used, F.col("name") == F.col("base"), "left")
    # The n-th free number: walk over the occupied ones, which come in order.
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_n").cast("int"), lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    new = again.select("pos", F.concat("name", F.lit(join), free.cast("string")).alias("_new"))
    out = rows.join(new, "pos", "left").withColumn("name", F.coalesce("_new", "name")).drop("_n", "_new")
    return out.select(*frame.columns)
