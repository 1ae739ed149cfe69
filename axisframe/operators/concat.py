"""Concatenation along obs with alignment and merging along var."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..sources.store import SPARK_TYPES, Categories, Frame, Matrix, Store
from . import axis, matrix

MERGES = (None, "same", "unique", "first", "only")
#: Metadata arrays with more values equal nothing when strategies compare them.
COMPARED = 1_000_000
_NUMPY = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def promoted(dtypes: Sequence[str]) -> str:
    """The dtype that numbers of all ``dtypes`` come to, by numpy's rules."""
    return str(np.result_type(*map(np.dtype, dtypes)))


@dataclass(frozen=True)
class Kind:
    """How a column takes part in a union: its family (categorical, number, text), its dtype, whether it may have gaps."""

    family: str
    dtype: str = ""
    nullable: bool = False


def column_kind(frame: Frame, name: str) -> Kind:
    """The kind of a column. A column of whole numbers or booleans that has nulls is a nullable one."""
    if name in frame.categories:
        return Kind("categorical")
    f = frame.data.schema[name]
    if isinstance(f.dataType, T.StringType):
        return Kind("text", nullable=bool(f.metadata.get("nullable")))
    if f.dataType.simpleString() in _NUMPY:
        return Kind("number", _NUMPY[f.dataType.simpleString()], bool(f.metadata.get("nullable")))
    return Kind("other")


def merged_categories(found: Sequence[Categories]) -> Categories:
    """The first one's labels if they hold all others', else the natural order of all; ordered only if all are ordered
    and alike."""
    voters = [k for k in found if k.labels]
    if not voters:
        return Categories((), bool(found) and all(k.ordered for k in found))
    kinds = {type(x) for k in voters for x in k.labels}
    numbers = kinds <= {int, float} or kinds == {bool}
    cast = (lambda x: x) if numbers or kinds == {str} else str
    if kinds == {int, float}:
        cast = float
    sets = [[cast(x) for x in k.labels] for k in voters]
    union = list(dict.fromkeys(itertools.chain.from_iterable(sets)))
    if any(k.ordered for k in found):
        if all(k.ordered and s == sets[0] for k, s in zip(voters, sets, strict=True)):
            return Categories(tuple(sets[0]), True)
    elif len(sets[0]) == len(union) and found[0].labels and kinds != {int, float}:
        return Categories(tuple(sets[0]))
    return Categories(tuple(names.natural(union)))


@dataclass(frozen=True)
class Union:
    """How one obs column is joined: the Spark type all inputs are cast to, the padding, and its categories if any."""

    spark_type: str
    pad: Any = None
    categories: Categories | None = None
    nullable: bool = False


def plan_column(frames: Sequence[Frame], name: str) -> Union | None:
    """What a column of several frames comes to; None if its kinds do not go together."""
    have = [f for f in frames if name in f.columns]
    kinds = [column_kind(f, name) for f in have]
    families = {k.family for k in kinds}
    lacking = len(have) < len(frames)
    if families == {"categorical"}:
        types = {f.data.schema[name].dataType.simpleString() for f in have}
        kind = types.pop() if len(types) == 1 else "double" if types <= {"tinyint", "smallint", "int", "bigint", "float", "double"} else "string"
        return Union(kind, None, merged_categories([f.categories[name] for f in have]))
    if families == {"number"}:
        dtype = promoted([k.dtype for k in kinds])
        nullable = any(k.nullable for k in kinds)
        if dtype == "bool" or dtype.startswith("int") and nullable:
            return Union(SPARK_TYPES[dtype], None, nullable=nullable or lacking)
        if lacking and not dtype.startswith("float"):
            dtype = "float64"
        return Union(SPARK_TYPES[dtype], float("nan") if dtype.startswith("float") else None)
    if families <= {"text", "categorical", "number"} and all(k.nullable for k in kinds if k.family == "number"):
        return Union("string", None, nullable=any(k.nullable for k in kinds))
    return None


def union_columns(frames: Sequence[Frame], join: str) -> dict[str, Union]:
    """The obs columns of the result: those of all inputs (inner) or any (outer), in order of appearance."""
    every = list(dict.fromkeys(c for f in frames for c in f.columns))
    wanted = [c for c in every if join == "outer" or all(c in f.columns for f in frames)]
    out = {}
    for c in wanted:
        plan = plan_column(frames, c)
        if plan is None:
            warnings.warn(f"column {c!r} is left out: its kinds cannot be joined", stacklevel=2)
        else:
            out[c] = plan
    return out


def _as(frame: Frame, name: str, plan: Union) -> Column:
    if name not in frame.columns:
        return F.lit(plan.pad).cast(plan.spark_type).alias(name)
    c = F.col(f"`{name}`")
    here = frame.data.schema[name].dataType.simpleString()
    out = c if here == plan.spark_type else c.cast("int").cast(plan.spark_type) if here == "boolean" and plan.spark_type not in ("string", "boolean") else c.cast(plan.spark_type)
    if plan.pad is not None:
        out = F.coalesce(out, F.lit(plan.pad).cast(plan.spark_type))
    return out.alias(name, metadata={"nullable": True} if plan.nullable else {})


def union_obs(frames: Sequence[Frame], offsets: Sequence[int], join: str, keys: Sequence[str], label: str | None, index_unique: str | None) -> Frame:
    """All rows of all inputs, one input after the other; every cast is explicit, so no type is coerced on the way."""
    plans = union_columns(frames, join)
    parts = []
    for f, at, key in zip(frames, offsets, keys, strict=True):
        name = F.concat_ws(index_unique, "name", F.lit(key)) if index_unique is not None else F.col("name")
        columns = [_as(f, c, p) for c, p in plans.items() if c != label]
        extra = [F.lit(key).alias(label)] if label else []
        parts.append(f.data.select((F.col("pos") + at).alias("pos"), name.alias("name"), *columns, *extra))
    data = reduce(DataFrame.unionByName, parts)
    categories = {c: p.categories for c, p in plans.items() if p.categories is not None and c != label}
    if label:
        categories[label] = Categories(tuple(keys))
    return Frame(data, categories)


def choose(present: Sequence[bool], equal, strategy: str | None) -> int | None:
    """Which input's value a merge strategy keeps, or None. ``equal(a, b)`` is asked only where the strategy needs values
    and only until it is decided."""
    have = [k for k, p in enumerate(present) if p]
    if strategy is None or not have:
        return None
    if strategy == "first":
        return have[0]
    if strategy == "only":
        return have[0] if len(have) == 1 else None
    if strategy == "same" and len(have) < len(present):
        return None
    return have[0] if all(equal(have[0], k) for k in have[1:]) else None


_same_rows = matrix.same


def merge_uns(trees: Sequence[dict], strategy: str | None) -> dict:
    """Nested metadata merged key by key; mappings merge inside, and those left empty go."""
    if strategy is None:
        return {}
    out: dict[str, Any] = {}
    for k in dict.fromkeys(k for t in trees for k in t):
        have = [t.get(k) if k in t else None for t in trees]
        present = [k in t for t in trees]
        if all(isinstance(v, dict) for v, p in zip(have, present, strict=True) if p):
            inner = merge_uns([v or {} for v in have], strategy)
            if inner:
                out[k] = inner
            continue

        def equal(a: int, b: int, have=have) -> bool:
            x, y = have[a], have[b]
            if isinstance(x, list) and len(x) > COMPARED:
                return False
            return type(x) is type(y) and (x == y or x != x and y != y)

        at = choose(present, equal, strategy)
        if at is not None:
            out[k] = have[at]
    return out


def concat(stores: Mapping[str, Store], join: str = "inner", merge: str | None = None, uns_merge: str | None = None, label: str | None = None, index_unique: str | None = None, fill: float = 0.0) -> Store:
    """Stores one after the other along obs, aligned by name along var.

    ``join`` decides which variables stay (those of all inputs in the first one's order, or those of any) and which obs
    columns do. ``merge`` says which var columns, varm and varp elements survive: an input that lacks a variable of the
    result counts as lacking its elements. Pairwise obs elements and raw are left out.
    """
    if join not in ("inner", "outer") or merge not in MERGES or uns_merge not in MERGES:
        raise ValueError("join is inner or outer; merge strategies are same, unique, first and only")
    keys, items = list(stores), list(stores.values())
    if not items:
        raise ValueError("nothing to concatenate")
    widths = []
    for key, s in stores.items():
        n, distinct = s.var.data.agg(F.count("*"), F.count_distinct("name")).first()
        if n > distinct:
            twice = axis.repeated_names(s.var.data).first()
            raise ValueError(f"{key}: the variable {twice.name!r} comes {twice.n} times")
        widths.append(n)
    lengths = [s.obs.data.count() for s in items]
    offsets = [0, *itertools.accumulate(lengths)][:-1]
    if join == "inner":
        target = axis.renumbered(axis.shared_names([s.var.data for s in items])).select("name", F.col("new_pos").alias("pos"))
    else:
        target = axis.all_names([s.var.data for s in items], lengths)
    width = target.count()
    if not width and any(widths):
        raise ValueError("the inputs have no variable in common")
    # A variable's place in each input, and in the result.
    maps = [s.var.data.select("name", "pos").join(target.withColumnRenamed("pos", "new_pos"), "name").select("pos", "new_pos") for s in items]

    @cache
    def whole(k: int) -> bool:
        """Whether an input has every variable of the result; asked only for inputs that bring something along var."""
        return maps[k].count() == width

    obs = union_obs([s.obs for s in items], offsets, join, keys, label, index_unique)
    var, categories = target, {}
    for c in dict.fromkeys(c for s in items for c in s.var.columns):
        views = [s.var.data.join(m, "pos").select("new_pos", f"`{c}`") if c in s.var.columns else None for s, m in zip(items, maps, strict=True)]
        at = choose([v is not None and merge is not None and whole(k) for k, v in enumerate(views)], lambda a, b, v=views: _same_rows(v[a], v[b]), merge)
        if at is not None:
            var = var.join(views[at].withColumnRenamed("new_pos", "pos"), "pos", "left")
            if c in items[at].var.categories:
                categories[c] = items[at].var.categories[c]
    found: dict[str, Matrix] = {}
    n = sum(lengths)
    paths = [p for p in items[0].matrices if p.split("/")[0] in ("X", "layers", "obsm")]
    for path in paths:
        if not all(path in s.matrices for s in items):
            continue
        ms = [s.matrices[path] for s in items]
        if len({m.sparse for m in ms}) > 1 or len({m.layout for m in ms}) > 1:
            raise ValueError(f"{path}: the inputs have it as {', '.join(m.layout for m in ms)}")
        if path.startswith("obsm/"):
            if len({m.shape[1:] for m in ms}) > 1:
                warnings.warn(f"{path} is left out: its shapes differ", stacklevel=2)
                continue
            found[path] = _stacked(ms, offsets, (n, *ms[0].shape[1:]), None, None)
        else:
            found[path] = _stacked(ms, offsets, (n, width), maps, fill)
    for path in dict.fromkeys(p for s in items for p in s.matrices if p.split("/")[0] in ("varm", "varp")):
        pair = path.startswith("varp/")
        views = []
        for s, m in zip(items, maps, strict=True):
            own = s.matrices.get(path)
            views.append(None if own is None else matrix.taken(own, m, m if pair else None, (width, width if pair else own.shape[1])))
        at = choose([v is not None and merge is not None and whole(k) for k, v in enumerate(views)], lambda a, b, v=views: v[a].dtype == v[b].dtype and v[a].layout == v[b].layout and _same_rows(v[a].data, v[b].data), merge)
        if at is not None:
            found[path] = views[at]
    frames: dict[str, Frame] = {}
    for path in dict.fromkeys(p for s in items for p in s.frames if p.startswith("obsm/")):
        if all(path in s.frames for s in items):
            frames[path] = union_obs([s.frames[path] for s in items], offsets, join, keys, None, None)
    if any(p.startswith("obsp/") for s in items for p in s.matrices) or any(s.raw is not None for s in items):
        warnings.warn("pairwise obs elements and raw are left out", stacklevel=2)
    return Store(obs, Frame(var.select("pos", *[c for c in var.columns if c != "pos"]), categories), found, frames, merge_uns([s.uns for s in items], uns_merge))


def _stacked(ms: Sequence[Matrix], offsets: Sequence[int], shape: tuple[int, ...], maps: Sequence[DataFrame] | None, fill: float | None) -> Matrix:
    """Matrices one below the other in the dtype that holds all of them, columns mapped and gaps of dense ones filled."""
    dtype = promoted([m.dtype for m in ms])
    if not ms[0].sparse and maps is not None and not float(fill).is_integer():
        dtype = promoted([dtype, "float32"])
    kind = SPARK_TYPES[dtype]
    parts = []
    for k, (m, at) in enumerate(zip(ms, offsets, strict=True)):
        if m.sparse:
            data = m.data if maps is None else matrix.taken(m, None, maps[k], shape).data
            v = F.col("v").cast("int").cast(kind) if m.dtype == "bool" and kind != "boolean" else F.col("v").cast(kind)
            parts.append(data.select((F.col("i") + at).alias("i"), "j", v.alias("v")))
            continue
        data = m.data
        if maps is not None:
            data = matrix.columns_taken(data, maps[k], shape[1], kind, fill)
        parts.append(data.select((F.col("i") + at).alias("i"), F.col("values").cast(f"array<{kind}>").alias("values")))
    return Matrix(reduce(DataFrame.unionByName, parts), shape, dtype, ms[0].layout)
