"""Files and folders of several modalities: a store each under ``mod``, global parts beside them, maps between their rows."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axis, matrix, modalities
from . import chunked, files, hdf5, trees
from .store import Frame, Matrix, Store

#: Bytes before the HDF5 part of a file, which begins with what the file is.
BEFORE = 512


def tree_of(spark: SparkSession, path: str) -> trees.Tree | None:
    """The tree at a path if it holds modalities."""
    try:
        if files.names(spark, path):
            tree: trees.Tree = chunked.FolderTree(spark, path)
            return tree if tree.exists("mod") else None
        if not files.exists(spark, path):
            return None
        head = files.read_bytes(spark, path, BEFORE + 8)
        if hdf5.MAGIC not in (head[:8], head[BEFORE:]):
            return None
        tree = hdf5.FileTree(spark, path)
        return tree if tree.exists("mod") and tree.exists("obs") else None
    except (ValueError, FileNotFoundError):
        return None


def is_modalities(spark: SparkSession, path: str) -> bool:
    return tree_of(spark, path) is not None


def _map(tree: trees.Tree, axis_name: str, mod: str) -> DataFrame | None:
    """(global_pos, place) of a modality's rows, one-based, 0 for none; None where the file has no map."""
    path = f"{axis_name}map/{mod}"
    if not tree.exists(path):
        return None
    rows = trees.columns(tree.spark, {"place": tree.array(path)}, path)
    return rows.select(F.col("pos").alias("global_pos"), F.col("place").cast("long").alias("place"))


def _global(tree: trees.Tree, mods: list[str]) -> Store:
    """The parts that span modalities; the masks that say which rows a modality has are left out."""
    found: dict[str, Matrix] = {}
    frames: dict[str, Frame] = {}
    for group in ("obsm", "varm", "obsp", "varp"):
        for name in tree.names(group) if tree.exists(group) else []:
            if name in mods and group in ("obsm", "varm"):
                continue
            path = f"{group}/{name}"
            if tree.array(path) is None and trees.encoding(tree, path) == "dataframe":
                frames[path] = trees.frame(tree, path)
            else:
                found[path] = trees.array_matrix(tree, path)
    uns = trees.metadata(tree, "uns") if tree.exists("uns") else {}
    return Store(trees.frame(tree, "obs"), trees.frame(tree, "var"), found, frames, uns)


def names(tree: trees.Tree) -> list[str]:
    order = tree.attributes("mod").get("mod-order")
    have = tree.names("mod")
    told = [str(x) for x in np.ravel(np.array(order, object))] if order is not None else []
    return [m for m in told if m in have] + [m for m in have if m not in told]


def read_all(spark: SparkSession, path: str) -> dict[str, Store]:
    """Each modality as a store with the global columns, arrays, graphs and metadata on its rows; what it has itself stays
    as it is there."""
    tree = tree_of(spark, path)
    if tree is None:
        raise ValueError(f"{path} holds no modalities")
    mods = names(tree)
    common = _global(tree, mods)
    out = {}
    for mod in mods:
        own = trees.read_store(tree, f"mod/{mod}")
        own = modalities.onto(own, mod, mods, common, _map(tree, "obs", mod))
        own = modalities.onto(own, mod, mods, common, _map(tree, "var", mod), "var")
        out[mod] = replace(own, uns={**common.uns, **own.uns})
    return out


def read(spark: SparkSession, path: str, mod: str | None = None) -> Store:
    """One modality; the only one if none is named."""
    tree = tree_of(spark, path)
    have = names(tree) if tree is not None else []
    if mod is None and len(have) > 1:
        raise ValueError(f"{path} holds several modalities, of which one must be named: {', '.join(have)}")
    if mod is not None and mod not in have:
        raise ValueError(f"no modality {mod!r}: {', '.join(have)}")
    return read_all(spark, path)[mod or have[0]]


def _raw_parts(store: Store, parts: dict[str, Store], column: str) -> dict[str, DataFrame | None]:
    """Which raw features go to which modality: by type where raw has types, else by name; none to two."""
    if store.raw is None:
        return dict.fromkeys(parts)
    raw, found = store.raw.var.data, {}
    if column in store.raw.var.columns:
        types = {m: [r[0] for r in s.var.data.select(column).distinct().collect()] for m, s in parts.items()}
        found = {m: raw.where(F.col(column).isin(t)).select("name") for m, t in types.items()}
    else:
        every = None
        for s in parts.values():
            every = s.var.data.select("name") if every is None else every.union(s.var.data.select("name"))
        if not raw.select("name").join(axis.repeated_names(every), "name", "left_semi").isEmpty():
            raise ValueError("a raw feature has the name of features of several modalities")
        found = {m: raw.join(s.var.data.select("name"), "name", "left_semi").select("name") for m, s in parts.items()}
    return found


def split(store: Store, mod: str | None = None, column: str | None = None) -> dict[str, Store]:
    """A store's modalities: by feature type where var has types, else one; obs keeps names alone, global parts stay out."""
    if mod is not None and column is not None:
        raise ValueError("one modality is named, or features are split by type")
    by = column or ("feature_types" if mod is None and "feature_types" in store.var.columns else None)
    bare = Store(Frame(store.obs.data.select("pos", "name")), store.var, {p: m for p, m in store.matrices.items() if p.split("/")[0] in ("X", "layers", "varm", "varp")}, {p: f for p, f in store.frames.items() if p.startswith("varm/")}, {}, None)
    if by is None:
        return {mod or "rna": replace(bare, raw=store.raw)}
    parts = modalities.by_type(bare, by)
    raws = _raw_parts(store, parts, by)
    if store.raw is None:
        return parts
    out = {}
    for m, s in parts.items():
        rows = axis.row_map(axis.select(store.raw.var, wanted=raws[m]))
        n = rows.count()
        x = matrix.taken(store.raw.matrices["X"], None, rows, (store.obs.data.count(), n))
        out[m] = replace(s, raw=Store(s.obs, axis.take(store.raw.var, rows), {"X": x})) if n else s
    return out


def write(store: Store, path: str, replace: bool = False, mod: str | None = None, column: str | None = None) -> None:
    """A store as a file of modalities, with maps and masks of their rows."""
    parts = split(store, mod, column)
    taken = [p for p in store.matrices if p.startswith("obsm/") and p.partition("/")[2] in parts]
    if taken:
        raise ValueError(f"{taken[0]} has the name of a modality")
    n_obs, sizes = store.obs.data.count(), {m: s.var.data.count() for m, s in parts.items()}
    with files.staged(store.spark, path, replace) as new:
        sink = hdf5.FileSink(store.spark, new, BEFORE)
        sink.group("", **{"encoding-type": "mudata", "encoding-version": "0.1.0", "axis": 0})
        sink.group("mod", **{"mod-order": np.array(list(parts), object)})
        for m, s in parts.items():
            trees.write_store(sink, s, f"mod/{m}")
        trees.write_frame(sink, "obs", store.obs)
        spark, at, every = store.spark, 0, None
        for m, s in parts.items():
            one = s.var.data.select((F.col("pos") + at).alias("pos"), "name")
            every = one if every is None else every.union(one)
            at += sizes[m]
        trees.write_frame(sink, "var", Frame(every))
        n_var, tag = at, {"encoding-type": "array", "encoding-version": "0.2.0"}
        for group in ("obsm", "varm", "obsp", "varp", "obsmap", "varmap"):
            sink.group(group, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
        for p, m in store.matrices.items():
            if p.split("/")[0] in ("obsm", "obsp"):
                trees.write_matrix(sink, p, m)
        for p, f in store.frames.items():
            if p.startswith("obsm/"):
                trees.write_frame(sink, p, f)
        at = 0
        for m in parts:
            ones = spark.range(n_obs).select(F.col("id").alias("pos"), (F.col("id") + 1).cast("int").alias("v"), F.lit(True).alias("m"))
            sink.large([f"obsmap/{m}", f"obsm/{m}"], ones, ["v", "m"], [(n_obs,)] * 2, ["uint32", "bool"], [tag] * 2)
            inside = (F.col("id") >= at) & (F.col("id") < at + sizes[m])
            places = spark.range(n_var).select(F.col("id").alias("pos"), F.when(inside, F.col("id") - at + 1).otherwise(0).cast("int").alias("v"), inside.alias("m"))
            sink.large([f"varmap/{m}", f"varm/{m}"], places, ["v", "m"], [(n_var,)] * 2, ["uint32", "bool"], [tag] * 2)
            at += sizes[m]
        trees.write_metadata(sink, "uns", store.uns)
        sink.close(b"MuData (format-version=0.1.0;creator=axisframe;creator-version=0)")

