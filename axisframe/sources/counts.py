"""Count matrices in HDF5 files: barcodes, features and entries in one group, or a group for each genome; and what a tool
that removes background counts has learnt, beside them."""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as naming
from ..operators import joins, matrix, modalities, reshape
from . import files, hdf5, trees
from .hdf5 import FileSink, FileTree
from .store import Frame, Matrix, Store

# Groups and arrays of such files, and the columns that they become.
GROUPS = ("matrix", "background_removed")
ENTRIES = ("data", "indices", "indptr", "shape")
FEATURES = {"name": "gene_symbols", "feature_type": "feature_types"}
OF_MATRIX = frozenset((*ENTRIES, "barcodes", "features", "genes", "gene_names", "genome", "filtered_barcodes"))
PLACES = "barcode_indices_for_latents"
PROBABILITIES = ("cell_probability", "latent_cell_probability")
AMBIENT = "ambient_expression"


def groups(tree: FileTree) -> list[str]:
    """The groups that hold a matrix: the one of newer files, else one a genome."""
    whole = lambda g: tree.exists(g) and tree.array(g) is None and {*ENTRIES, "barcodes"} <= set(tree.names(g))
    return [g for g in GROUPS if whole(g)] or [g for g in tree.names("") if whole(g) and {"genes", "gene_names"} <= set(tree.names(g))]


def is_counts(spark: SparkSession, path: str) -> bool:
    return _looks(spark, path, lambda t: bool(groups(t)))


def has_latents(spark: SparkSession, path: str) -> bool:
    """Whether a count file holds what background removal learnt."""
    return _looks(spark, path, lambda t: bool(g := groups(t)) and (t.exists("droplet_latents") or any(t.exists(f"{g[0]}/{k}") for k in (PROBABILITIES[1], PLACES))))


def _looks(spark: SparkSession, path: str, test) -> bool:
    if files.names(spark, path) or not files.exists(spark, path) or files.read_bytes(spark, path, 8) != hdf5.MAGIC:
        return False
    try:
        return test(FileTree(spark, path))
    except ValueError:
        return False


def _texts(rows: DataFrame) -> DataFrame:
    """Columns of text with character references as what they stand for."""
    return rows.select(*[modalities.with_characters(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def _features(tree: FileTree, group: str, n: int) -> tuple[DataFrame, bool]:
    """(pos, id, name, feature_type, ...) of a group's features, and whether they are probes of genes."""
    spark = tree.spark
    if tree.exists(f"{group}/features"):
        have = tree.names(f"{group}/features")
        tags = [str(t) for t in trees.whole(tree.array(f"{group}/features/_all_tag_keys")).tolist()] if "_all_tag_keys" in have else []
        if gone := [t for t in tags if t not in have]:
            raise ValueError(f"the features have no {gone[0]!r}, which their tags name")
        wanted = {c: tree.array(f"{group}/features/{c}") for c in have if not c.startswith("_")}
    else:
        wanted = {"id": tree.array(f"{group}/genes"), "name": tree.array(f"{group}/gene_names")}
        if tree.exists(f"{group}/genome"):
            wanted["genome"] = tree.array(f"{group}/genome")
    odd = [f"{c} {a.shape[0]}" for c, a in wanted.items() if a.shape != (n,)]
    if odd:
        raise ValueError(f"the features should be {n}: {', '.join(odd)}")
    return _texts(trees.columns(spark, wanted, "features")), "gene_id" in wanted and "id" in wanted


def _group(tree: FileTree, group: str, names: str) -> Store:
    """The store of one group, named by ids or symbols."""
    spark = tree.spark
    n_var, n_obs = (int(x) for x in trees.whole(tree.array(f"{group}/shape")).tolist())
    cells = {"name": tree.array(f"{group}/barcodes")}
    if tree.exists(f"{group}/filtered_barcodes"):
        cells["filtered_barcodes"] = tree.array(f"{group}/filtered_barcodes")
    if any(a.shape != (n_obs,) for a in cells.values()):
        raise ValueError(f"the barcodes should be {n_obs}")
    found, probes = _features(tree, group, n_var)
    own = F.col("gene_id") if probes else F.col("id")
    ident, symbol = ("gene_ids", own), ("gene_symbols", F.col("name"))
    first, other = (ident, symbol) if names == "ids" else (symbol, ident)
    rest = [c for c in found.columns if c not in ("pos", "id", "name", "gene_id" if probes else "", "feature_type")]
    extra = [F.col("id").alias("probe_ids")] if probes else []
    kind = [F.col("feature_type").alias("feature_types")] if "feature_type" in found.columns else []
    var = found.select("pos", first[1].alias("name"), other[1].alias(other[0]), *kind, *extra, *[F.col(f"`{c}`") for c in rest])
    data, indices, indptr = (tree.array(f"{group}/{x}") for x in ENTRIES[:3])
    if indptr.shape != (n_obs + 1,):
        raise ValueError(f"the pointers should be {n_obs + 1}")
    # By genes in columns there, by cells in rows here: the same arrays.
    x = trees.entries(spark, data, indices, indptr, group)
    x = Matrix(x.select(F.col("major").alias("i"), F.col("minor").alias("j"), "v"), (n_obs, n_var), "float32" if data.name == "float16" else data.name)
    matrix.check_entries(x.data, x.shape, group)
    run = {k: trees.plain(v) for k, v in tree.attributes("").items() if not k.isupper() and not k.startswith("PYTABLES")}
    return Store(Frame(_texts(trees.columns(spark, cells, "barcodes"))), Frame(var), {"X": x}, {}, {"cellranger": run} if run else {})


def read(spark: SparkSession, path: str, names: str = "ids", feature_type: str | None = None, genome: str | None = None, make_unique: bool = False) -> Store:
    """A count file as a store of cells by features, named by gene ``ids`` or ``symbols``; what is not asked for by type or
    genome goes. Of a file with a group a genome, one is read."""
    if names not in ("ids", "symbols"):
        raise ValueError("names are ids or symbols")
    tree = FileTree(spark, path)
    have = groups(tree)
    if not have:
        raise ValueError(f"{path} holds no count matrix")
    group = have[0]
    if have[0] not in GROUPS:
        if genome is None and len(have) > 1:
            raise ValueError(f"{path} holds several genomes: {', '.join(have)}")
        if genome is not None and genome not in have:
            raise ValueError(f"no genome {genome!r}: {', '.join(have)}")
        group, genome = genome or have[0], None
    return _named(modalities.narrowed(_group(tree, group, names), feature_type, genome), make_unique)


def _named(store: Store, make_unique: bool) -> Store:
    return replace(store, var=Frame(naming.unique_rows(store.var.data), store.var.categories)) if make_unique else store


def _ascii(c: Column) -> Column:
    """Text with what is outside ASCII as character references."""

    def one(texts):
        import pyarrow as pa

        return pa.array([None if t is None else t.encode("ascii", "xmlcharrefreplace").decode() for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(one, "string")(c)


def write(store: Store, path: str, replace: bool = False, layer: str = "X", force: bool = False) -> None:
    """A matrix as a count file: entries by cell, barcodes and features as text of fixed width.

    Ids and symbols come from var, the names standing in for the one that is not there; without ids and types the names
    would have to do for both, which is refused unless forced.
    """
    m = store.matrices.get(layer)
    if m is None:
        raise KeyError(f"there is no {layer!r}")
    columns = store.var.columns
    if not force and "gene_ids" not in columns and "feature_types" not in columns:
        raise ValueError("var has neither gene_ids nor feature_types")
    m = matrix.laid_out(m, "csr", force=True) if m.layout != "csr" else m
    pick = lambda c, other: F.coalesce(F.col(c), other) if c in columns else other
    ident, symbol = pick("gene_ids", F.col("name")), pick("gene_symbols", F.col("name"))
    made = {"id": ident, "name": symbol, "feature_type": pick("feature_types", F.lit("Gene Expression")), "genome": pick("genome", F.lit(""))}
    if "probe_ids" in columns:
        made |= {"id": F.col("probe_ids"), "gene_id": ident}
    kinds = dict(store.var.data.dtypes)
    tags = ["genome", *(["gene_id"] if "probe_ids" in columns else [])]
    for c in columns:
        if c not in ("gene_ids", "gene_symbols", "feature_types", "genome", "probe_ids") and kinds[c] in ("string", "boolean"):
            made[c] = F.coalesce(F.col(f"`{c}`"), F.lit(False) if kinds[c] == "boolean" else F.lit(""))
            tags += [c] if kinds[c] == "string" else []
    flags = [c for c in made if kinds.get(c) == "boolean"]
    texts = [c for c in made if c not in flags]
    var = store.var.data.select("pos", *[(e if c in flags else _ascii(e.cast("string"))).alias(c) for c, e in made.items()])
    obs = store.obs.data.select("pos", _ascii(F.col("name")).alias("name"), *([F.coalesce("filtered_barcodes", F.lit(False)).alias("flag")] if "filtered_barcodes" in store.obs.columns else []))
    widths = var.agg(*[F.max(F.octet_length(k)).alias(k) for k in texts]).first()
    width, n_obs = obs.agg(F.max(F.octet_length("name")), F.count("*")).first()
    n_var = m.shape[1]
    with files.staged(store.spark, path, replace) as new:
        sink = FileSink(store.spark, new)
        run = store.uns.get("cellranger", {})
        sink.group("", **{k: np.array(v) if not isinstance(v, str) else v for k, v in run.items() if not isinstance(v, dict)})
        sink.group("matrix")
        sink.group("matrix/features")
        sink.large(["matrix/barcodes", *(["matrix/filtered_barcodes"] if len(obs.columns) > 2 else [])], obs, obs.columns[1:], [(n_obs,)] * (len(obs.columns) - 1), [f"S{max(1, width or 1)}", "bool"][: len(obs.columns) - 1], [{}] * (len(obs.columns) - 1))
        sink.large([f"matrix/features/{k}" for k in made], var, list(made), [(n_var,)] * len(made), ["bool" if k in flags else f"S{max(1, widths[k] or 1)}" for k in made], [{}] * len(made))
        sink.small("matrix/features/_all_tag_keys", np.array(tags, f"S{max(map(len, tags))}"))
        trees.write_sparse(sink, "matrix", replace_dtype(m))
        sink.small("matrix/shape", np.array([n_var, n_obs], np.int32 if max(n_var, n_obs) < 1 << 31 else np.int64))
        sink.close()


def replace_dtype(m: Matrix) -> Matrix:
    """float16 entries as float32, which a sparse matrix can hold."""
    return replace(m, dtype="float32") if m.dtype == "float16" else m


def _latents(tree: FileTree, group: str, n_obs: int, n_var: int) -> dict[str, Any]:
    """What lies beside the matrix: values and rows per analysed droplet, values per feature, all else; and whose rows the
    droplets are."""
    out: dict[str, Any] = {"droplets": {}, "rows": {}, "features": {}, "other": {}, "places": None}

    def member(path: str, kind: str) -> None:
        a, key = tree.array(path), path.rpartition("/")[2]
        if a is None:
            return
        if key == PLACES:
            out["places"] = path
        elif kind == "droplet" and len(a.shape) in (1, 2):
            out["droplets" if len(a.shape) == 1 else "rows"][key] = a
        elif kind != "rest" and a.shape == (n_var,) and np.dtype(a.dtype).kind in "iuf" and (kind == "global" or key == AMBIENT):
            out["features"][key] = a
        else:
            out["other"][key if key not in out["other"] else f"metadata_{key}"] = path

    if tree.exists("droplet_latents"):
        for part, kind in (("droplet_latents", "droplet"), ("global_latents", "global"), ("metadata", "rest")):
            for name in tree.names(part) if tree.exists(part) else []:
                member(f"{part}/{name}", kind)
    else:
        for name in tree.names(group):
            if name not in OF_MATRIX:
                member(f"{group}/{name}", "droplet" if name.startswith("latent_") else "old")
    sizes = {a.shape[0] for a in (*out["droplets"].values(), *out["rows"].values())}
    if len(sizes) > 1:
        raise ValueError(f"what was learnt of droplets differs in length: {', '.join(map(str, sorted(sizes)))}")
    n = sizes.pop() if sizes else 0
    places = tree.array(out["places"]) if out["places"] else None
    if places is not None and places.shape == (n,):
        out["index"] = places
    elif n in (0, n_obs):
        out["index"] = None
        if out["places"]:
            out["other"][PLACES] = out["places"]
    else:
        raise ValueError(f"{n} rows were learnt of {n_obs} barcodes, and nothing says whose they are")
    out["n"] = n
    return out


def read_cleaned(spark: SparkSession, path: str, names: str = "ids", feature_type: str | None = None, genome: str | None = None, make_unique: bool = False, least_probability: float | None = None, raw: str | None = None) -> Store:
    """A count file with what background removal learnt: values per droplet as obs columns (NaN where a droplet was not
    analysed) and rows as obsm, values per feature as var columns, the rest under uns.

    ``least_probability`` keeps droplets that are cells with that probability or more. ``raw`` names the count file that
    the tool worked on, whose counts become a layer beside the cleaned ones.
    """
    tree = FileTree(spark, path)
    if not has_latents(spark, path):
        raise ValueError(f"{path} holds nothing that background removal learnt")
    group = groups(tree)[0]
    store = _group(tree, group, names)
    n_obs, n_var = store.matrices["X"].shape
    found = _latents(tree, group, n_obs, n_var)
    own = {**found["droplets"], **({"_place": found["index"]} if found["index"] is not None else {})}
    obs, nan = store.obs.data, F.lit(float("nan"))
    if own:
        values = trees.columns(spark, own, "droplets").withColumnRenamed("pos", "_row")
        values = values.withColumn("pos", F.col("_place").cast("long") if found["index"] is not None else F.col("_row"))
        if not values.groupBy("pos").count().where("count > 1").isEmpty():
            raise ValueError("a barcode was learnt of twice")
        values = values.withColumn("cellbender_analyzed", F.lit(True))
        obs = obs.join(values.drop("_row", "_place"), "pos", "left")
        obs = obs.select(*[F.coalesce(F.col(c).cast("double"), nan).alias(c) if c in found["droplets"] else F.coalesce(c, F.lit(False)).alias(c) if c == "cellbender_analyzed" else F.col(c) for c in obs.columns])
    matrices = dict(store.matrices)
    for key, a in found["rows"].items():
        rows = trees.rows(spark, a)
        width = math.prod(a.shape[1:])
        if found["index"] is not None:
            rows = rows.join(trees.columns(spark, {"place": found["index"]}).withColumnRenamed("pos", "i"), "i").select(F.col("place").cast("long").alias("i"), "values")
        rows = store.obs.data.select(F.col("pos").alias("i")).join(rows, "i", "left").select("i", F.coalesce(F.col("values").cast("array<double>"), F.array_repeat(nan, width)).alias("values"))
        matrices[f"obsm/{key}"] = Matrix(rows, (n_obs, width), "float64", "dense")
    var = store.var.data
    if found["features"]:
        var = var.join(trees.columns(spark, found["features"], "features"), "pos", "left")
    if "features_analyzed_inds" in found["other"]:
        used = trees.columns(spark, {"at": tree.array(found["other"]["features_analyzed_inds"])}).select(F.col("at").cast("long").alias("pos")).distinct().withColumn("cellbender_analyzed", F.lit(True))
        var = var.join(used, "pos", "left").withColumn("cellbender_analyzed", F.coalesce("cellbender_analyzed", F.lit(False)))
    uns = {**store.uns, "cellbender": {k: trees.plain(trees.whole(tree.array(p))) for k, p in found["other"].items()}}
    store = Store(Frame(obs), Frame(var), matrices, {}, uns)
    if raw is not None:
        store = _with_raw(store, read(spark, raw, names))
    if least_probability is not None:
        column = next((c for c in PROBABILITIES if c in found["droplets"]), None)
        if column is None:
            raise ValueError("no probability of being a cell was learnt")
        most = store.obs.data.agg(F.max(F.when(~F.isnan(column), F.col(column)))).first()[0]
        if most is None or most < least_probability:
            raise ValueError(f"no droplet has a probability of {least_probability:g}; the highest is {most}")
        store = reshape.subset(store, obs_query=f"{column} >= {least_probability!r}")
    return _named(modalities.narrowed(store, feature_type, genome), make_unique)


def _with_raw(store: Store, raw: Store) -> Store:
    """The cleaned counts and those that they were made from as layers. The features must be the same in the same order,
    and every barcode must be in the raw file, once."""
    if not joins.same_in_order(store.var.data, raw.var.data, ["name"]):
        raise ValueError("the raw file has other features")
    place = joins.matched_inner(store.obs.data, raw.obs.data)
    rows = place.select(F.col("other_pos").alias("pos"), F.col("pos").alias("new_pos"))
    before = matrix.taken(raw.matrices["X"], rows, None, store.matrices["X"].shape)
    return replace(store, matrices={**store.matrices, "layers/cellranger": before, "layers/cellbender": store.matrices["X"]})
