"""Whole-store operators: subset, split and recast."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..sources import files
from ..sources.store import MANIFEST, SPARK_TYPES, Categories, Frame, Matrix, Store, _save, axes_of, matrices
from . import axis, matrix


def _narrowed(store: Store, maps: dict[str, DataFrame | None], sizes: dict[str, int], raw_names: DataFrame | None) -> Store:
    """Every element of a store on the mapped rows of both axes."""
    found: dict[str, Matrix] = {}
    for path, m in store.matrices.items():
        a, b = axes_of(path)
        shape = (sizes[a], sizes[b] if b else m.shape[1], *m.shape[2:])
        found[path] = matrix.taken(m, maps[a], maps[b] if b else None, shape)
    frames = {p: f if maps[axes_of(p)[0]] is None else axis.take(f, maps[axes_of(p)[0]]) for p, f in store.frames.items()}
    # Unused categories go on both axes, also on one that keeps all its rows.
    kept = {a: axis.take(getattr(store, a), maps[a]) if maps[a] is not None else Frame(getattr(store, a).data, axis.pruned(getattr(store, a).data, getattr(store, a).categories)) for a in ("obs", "var")}
    uns = dict(store.uns)
    for a in ("obs", "var"):
        for c, before in getattr(store, a).categories.items():
            colours = uns.get(f"{c}_colors")
            if isinstance(colours, list) and c in kept[a].categories:
                uns[f"{c}_colors"] = axis.prune_colors(colours, before, kept[a].categories[c])
    raw = store.raw
    if raw is not None:
        raw_map = axis.row_map(axis.select(raw.var, wanted=raw_names)) if raw_names is not None else None
        n = raw_map.count() if raw_map is not None else raw.var.data.count()
        raw = _narrowed(replace(raw, obs=store.obs), {"obs": maps["obs"], "var": raw_map}, {"obs": sizes["obs"], "var": n}, None)
    return Store(kept["obs"], kept["var"], found, frames, uns, raw)


def subset(store: Store, obs_query: str | None = None, var_query: str | None = None, obs_names: DataFrame | None = None, var_names: DataFrame | None = None) -> Store:
    """The store on the rows that queries and name lists (name) select; source order stays, empty selections are refused.

    raw keeps the variables whose names the selection on var kept.
    """
    maps: dict[str, DataFrame | None] = {}
    sizes: dict[str, int] = {}
    for a, query, wanted in (("obs", obs_query, obs_names), ("var", var_query, var_names)):
        frame = getattr(store, a)
        if query is None and wanted is None:
            maps[a], sizes[a] = None, frame.data.count()
            continue
        maps[a] = axis.row_map(axis.select(frame, query, wanted))
        sizes[a] = maps[a].count()
        if not sizes[a]:
            raise ValueError(f"nothing in {a} is selected")
    raw_names = None
    if store.raw is not None and maps["var"] is not None:
        raw_names = store.var.data.join(maps["var"], "pos").select("name")
    return _narrowed(store, maps, sizes, raw_names)


@dataclass(frozen=True)
class Part:
    """One output of a split."""

    label: str | None
    stem: str
    rows: int


def parts(store: Store, by: str, over: str = "obs", least: int = 0, most: int = 100_000) -> list[Part]:
    """The labels of a column in order of first appearance, with a file stem each; refused above ``most`` labels.

    The missing label is a part of its own, apart from the empty text.
    """
    frame: Frame = getattr(store, over)
    if by not in frame.columns:
        raise KeyError(f"{over} has no column {by!r}: {', '.join(frame.columns)}")
    rows = axis.groups(frame.data, by).where(F.col("n") >= least).orderBy("first").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{by}: more than {most} labels")
    text = [None if r.label is None else str(r.label).lower() if isinstance(r.label, bool) else str(r.label) for r in rows]
    stems = names.distinct_stems(text)
    return [Part(t, stems[t], r.n) for t, r in zip(text, rows, strict=True)]


def split(store: Store, by: str, over: str = "obs", least: int = 0) -> Iterator[tuple[Part, Store]]:
    """A store per label of a column."""
    frame: Frame = getattr(store, over)
    other = "var" if over == "obs" else "obs"
    n_other = getattr(store, other).data.count()
    label = F.col(by).cast("string")
    if dict(frame.data.dtypes)[by] in ("float", "double"):
        label = F.when(~F.isnan(F.col(by)), label)
    for part in parts(store, by, over, least):
        keep = frame.data.where(label.eqNullSafe(F.lit(part.label))).select("pos")
        maps = {over: axis.row_map(keep), other: None}
        names_kept = frame.data.join(keep, "pos").select("name") if over == "var" and store.raw is not None else None
        yield part, _narrowed(store, maps, {over: part.rows, other: n_other}, names_kept)


def route(store: Store, by: str, over: str = "obs", least: int = 0) -> tuple[list[Part], DataFrame]:
    """Parts, and (pos, part, new_pos) of each row: where it goes and its place there. Parts go by number, so that
    missing and empty labels stay apart."""
    found = parts(store, by, over, least)
    frame: Frame = getattr(store, over)
    label = F.col(by).cast("string")
    if dict(frame.data.dtypes)[by] in ("float", "double"):
        label = F.when(~F.isnan(F.col(by)), label)
    spark = store.spark
    keys = spark.createDataFrame([(p.label, k) for k, p in enumerate(found)], "label string, part int")
    rows = frame.data.select("pos", label.alias("_label"))
    rows = rows.join(keys, F.col("_label").eqNullSafe(F.col("label"))).select("pos", "part")
    # Numbered per part and block of positions, so that a part with most rows is many groups.
    rows = rows.withColumn("_block", F.floor(F.col("pos") / axis.BLOCK))
    counts = rows.groupBy("part", "_block").count()
    before = F.sum("count").over(Window.partitionBy("part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy("part", "_block").orderBy("pos")) - 1
    rows = rows.join(counts, ["part", "_block"]).select("pos", "part", (F.col("_start") + n).alias("new_pos"))
    return found, rows


def split_entries(store: Store, by: str, path: str = "X") -> tuple[list[Part], DataFrame]:
    """Parts, and (part, i, j, v): the entries of a matrix with the output they go to and their row there, in one pass."""
    found, rows = route(store, by)
    m = store.matrices[path]
    out = m.data.join(rows, F.col("i") == F.col("pos")).select("part", F.col("new_pos").alias("i"), *m.data.columns[1:])
    return found, out


def save_split(store: Store, by: str, folder: str, over: str = "obs", least: int = 0, replace_it: bool = False, suffix: str = "") -> DataFrame:
    """Write a store per label under ``folder`` and return the list of them: id, column, value, path, n. All appear or none.

    Rows are routed once; each element is written in one pass, by part, and the parts' files are then moved to their stores.
    A store with raw whose variables are split writes one store after the other.
    """
    spark = store.spark
    rows = []
    with files.staged(spark, folder, replace_it) as new:
        if over == "var" and store.raw is not None:
            for k, (part, own) in enumerate(split(store, by, over, least)):
                _save(own, f"{new}/{part.stem}{suffix}", "zstd")
                rows.append((k, by, part.label, f"{folder}/{part.stem}{suffix}", part.rows))
            return spark.createDataFrame(rows, "id int, column string, value string, path string, n long")
        found, routed = route(store, by, over, least)
        at = files.scratch(spark, "route")
        routed.write.parquet(at)
        routed = spark.read.parquet(at)
        other = "var" if over == "obs" else "obs"
        n_other = getattr(store, other).data.count()
        manifests = [_routed(store, f"{new}/.parts", found, routed, over, other, n_other)]
        if store.raw is not None:
            raw = replace(store.raw, obs=store.obs)
            manifests.append(_routed(raw, f"{new}/.parts/raw", found, routed, over, other, raw.var.data.count(), frames=("var",)))
        for k, part in enumerate(found):
            target = f"{new}/{part.stem}{suffix}"
            for root, inner in ((f"{new}/.parts", target), (f"{new}/.parts/raw", f"{target}/raw"))[: len(manifests)]:
                for name in manifests[0 if inner == target else 1]["elements"]:
                    source = f"{root}/{name}/part={k}"
                    if files.exists(spark, source):
                        files.move(spark, source, f"{inner}/{name}")
            for m, inner in zip(manifests, (target, f"{target}/raw"), strict=False):
                files.write_bytes(spark, f"{inner}/{MANIFEST}", json.dumps(m["of"](k, part, len(manifests) > 1 and inner == target), allow_nan=True).encode())
            rows.append((k, by, part.label, f"{folder}/{part.stem}{suffix}", part.rows))
        files.delete(spark, f"{new}/.parts")
        files.delete(spark, at)
    return spark.createDataFrame(rows, "id int, column string, value string, path string, n long")


def _routed(store: Store, root: str, found: Sequence[Part], routed: DataFrame, over: str, other: str, n_other: int, frames: tuple[str, ...] = ("obs", "var")) -> dict:
    """Write every element of a store once, by part, under ``root``; what the parts' manifests say."""
    spark = store.spark
    ids = spark.createDataFrame([(k,) for k in range(len(found))], "part int")
    written = []

    def put(rows: DataFrame, name: str) -> None:
        # No part is lost that has no rows: its files would not exist.
        rows.write.option("compression", "zstd").partitionBy("part").parquet(f"{root}/{name}")
        for k in range(len(found)):
            if not files.exists(spark, f"{root}/{name}/part={k}"):
                rows.drop("part").limit(0).write.parquet(f"{root}/{name}/part={k}")
        written.append(name)

    def frame_rows(f: Frame, split_here: bool) -> DataFrame:
        return f.data.join(routed, "pos").drop("pos").withColumnRenamed("new_pos", "pos").select("part", *f.data.columns) if split_here else f.data.crossJoin(F.broadcast(ids))  # as many rows as parts

    every = [(n, getattr(store, n), n == over) for n in frames] + [(p, f, axes_of(p)[0] == over) for p, f in store.frames.items()]
    categories: dict[str, dict[int, dict]] = {}
    for name, f, here in every:
        rows = frame_rows(f, here)
        put(rows, name)
        if f.categories:
            used = (rows if here else rows.where("part = 0")).groupBy("part").agg(*[F.collect_set(f"`{c}`").alias(c) for c in f.categories]).collect()
            per = {r["part"]: {c: {"labels": [x for x in k.labels if x in set(r[c])], "ordered": k.ordered} for c, k in f.categories.items()} for r in used}
            categories[name] = per if here else dict.fromkeys(range(len(found)), per.get(0, {}))
    shapes: dict[str, tuple] = {}
    for path, m in store.matrices.items():
        a, b = axes_of(path)
        data = m.data
        if a == over:
            data = data.join(routed.select(F.col("pos").alias("i"), F.col("new_pos").alias("_i"), "part"), "i").drop("i").withColumnRenamed("_i", "i")
        if b == over:
            ends = routed.select(F.col("pos").alias("j"), F.col("new_pos").alias("_j"), F.col("part").alias("_part"))
            if not m.sparse:
                for k in range(len(found)):
                    own = routed.where(F.col("part") == k).select("pos", "new_pos")
                    one = matrix.columns_taken(m.data, own, found[k].rows, SPARK_TYPES[m.dtype]) if a != over else None
                    one.write.option("compression", "zstd").parquet(f"{root}/{path}/part={k}")
                written.append(path)
                shapes[path] = (a, b, m)
                continue
            data = data.join(ends, "j").drop("j").withColumnRenamed("_j", "j")
            data = data.where("part = _part").drop("_part") if a == over else data.withColumnRenamed("_part", "part")
        if over not in (a, b):
            data = data.crossJoin(F.broadcast(ids))
        put(data.select("part", *(("i", "j", "v") if m.sparse else ("i", "values"))), path)
        shapes[path] = (a, b, m)

    def manifest(k: int, part: Part, raw: bool) -> dict:
        side = {over: part.rows, other: n_other}
        out = {"version": 1, "frames": {n: categories.get(n, {}).get(k, {}) for n, *_ in every}, "matrices": {}, "uns": _colours(store, categories, k)}
        for path, (a, b, m) in shapes.items():
            out["matrices"][path] = {"shape": [side[a], side[b] if b else m.shape[1], *m.shape[2:]], "dtype": m.dtype, "layout": m.layout}
        return out | ({"raw": True} if raw else {})

    return {"elements": written, "of": manifest}


def _colours(store: Store, categories: dict, k: int) -> dict:
    uns = dict(store.uns)
    for a in ("obs", "var"):
        for c, before in getattr(store, a).categories.items():
            after = categories.get(a, {}).get(k, {}).get(c)
            if isinstance(uns.get(f"{c}_colors"), list) and after is not None:
                uns[f"{c}_colors"] = axis.prune_colors(uns[f"{c}_colors"], before, Categories(tuple(after["labels"]), after["ordered"]))
    return uns


def recast(store: Store, targets: Sequence[str] | None = None, dtype: str | None = None, layout: str | None = None, force: bool = False) -> Store:
    """Matrices in another dtype or layout; X alone without ``targets``, all of X, layers and raw with ("*",).

    Every check is made before anything of the result exists.
    """
    wanted = matrices(store) if targets and list(targets) == ["*"] else list(targets or ["X"])
    for path in wanted:
        inner = path.removeprefix("raw/")
        owner = store.raw if inner != path else store
        if owner is None or inner not in owner.matrices:
            raise KeyError(f"there is no matrix {path!r}: {', '.join(matrices(store))}")
    plan: dict[str, Matrix] = {}
    for path in wanted:
        inner = path.removeprefix("raw/")
        m = (store.raw if inner != path else store).matrices[inner]
        # Dropping to fewer stored zeros comes last: a lossy cast can make new ones.
        if layout == "dense":
            m = matrix.laid_out(m, layout, force)
        if dtype is not None:
            m = matrix.cast(m, dtype, force)
        if layout is not None and layout != "dense":
            m = matrix.laid_out(m, layout, force)
        plan[path] = m
    own = {p: m for p, m in plan.items() if not p.startswith("raw/")}
    raw = {p.removeprefix("raw/"): m for p, m in plan.items() if p.startswith("raw/")}
    out = replace(store, matrices={**store.matrices, **own})
    return replace(out, raw=replace(store.raw, matrices={**store.raw.matrices, **raw})) if raw else out

