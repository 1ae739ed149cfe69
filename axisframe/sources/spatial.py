"""Spatial bundles: spot positions, cell tables, polygons and analysis tables joined to the observations."""

from __future__ import annotations

import io
import json
import re
import tarfile
import warnings
from collections.abc import Callable
from dataclasses import replace as changed

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axis, joins
from . import arrays, counts, files, tables
from .store import Frame, Matrix, Store

# Columns of a position table, in the order of files without a header.
POSITIONS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")
# Columns of a cell table that stay counts and areas.
CENTROIDS = ("x_centroid", "y_centroid")
# Files of a slide's folder, of its segmented cells and of a bundle of cells, and the analyses beside them
# (newer place first).
POSITION_FILES = ("tissue_positions.csv", "tissue_positions_list.csv", "tissue_positions.parquet")
MATRICES = {"spots": ("filtered_feature_bc_matrix", "raw_feature_bc_matrix"), "cells": ("filtered_feature_cell_matrix", "raw_feature_cell_matrix")}
OUTLINES = {"cell": "cell_segmentations.geojson", "nucleus": "nucleus_segmentations.geojson"}
CLUSTERS = ("analysis/clustering/gene_expression_graphclust/clusters.csv", "analysis/clustering/graphclust/clusters.csv")
PROJECTIONS = {"X_umap": ("analysis/umap/gene_expression_2_components/projection.csv", "analysis/umap/2_components/projection.csv"), "X_pca": ("analysis/pca/gene_expression_10_components/projection.csv", "analysis/pca/10_components/projection.csv")}
#: The side of the bins that are read unless another is asked for, in microns.
BIN = 8


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A spot position table, CSV with or without header or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(*POSITIONS)
    first = tables.head_lines(spark, path)[0]
    raw = spark.read.option("header", first.startswith("barcode")).csv(path).toDF(*POSITIONS)
    return raw.select("barcode", *[F.col(c).try_cast("int").alias(c) for c in POSITIONS[1:4]], *[F.col(c).try_cast("double").alias(c) for c in POSITIONS[4:]])


def with_positions(store: Store, table: DataFrame, allow_missing: bool = False) -> Store:
    """obs with the columns of a position table, and obsm/spatial with (x, y) in pixels."""
    rows, _ = joins.checked_left(store.obs.data, table, "barcode", allow_missing, what="positions")
    xy = rows.select(F.col("pos").alias("i"), F.transform(F.array("pxl_col_in_fullres", "pxl_row_in_fullres"), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("values"))
    obs = Frame(rows.drop("pxl_row_in_fullres", "pxl_col_in_fullres"), store.obs.categories)
    return Store(obs, store.var, {**store.matrices, "obsm/spatial": Matrix(xy, (store.obs.data.count(), 2), "float64", "dense")}, store.frames, store.uns, store.raw)


def with_cells(store: Store, table: Frame) -> Store:
    """obs with a cell table (centroids, counts, areas), all cells required, and obsm/spatial with the centroids."""
    data = table.data.drop("pos").withColumnRenamed("name", "cell_id")
    rows, _ = joins.checked_left(store.obs.data, data, "cell_id", allow_missing=False, what="cells")
    xy = rows.select(F.col("pos").alias("i"), F.array(*[F.col(c).cast("double") for c in CENTROIDS]).alias("values"))
    obs = Frame(rows.drop(*CENTROIDS), {**store.obs.categories, **table.categories})
    return Store(obs, store.var, {**store.matrices, "obsm/spatial": Matrix(xy, (store.obs.data.count(), 2), "float64", "dense")}, store.frames, store.uns, store.raw)


def cell_number(c: Column) -> Column:
    """The number in names such as cellid_000000012-1; null for others."""
    return F.when(c.rlike(r"^cellid_[0-9]+-[0-9]+$"), F.regexp_extract(c, r"^cellid_0*([0-9]+)-", 1).try_cast("long"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, rings): the features of a GeoJSON file; rings is an array over parts of arrays over rings of points."""
    point = "array<double>"
    raw = spark.read.schema("features array<struct<properties: struct<cell_id: long>, geometry: struct<type: string, coordinates: string>>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select(F.col("f.properties.cell_id").alias("cell_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one, many = F.from_json("c", f"array<array<{point}>>"), F.from_json("c", f"array<array<array<{point}>>>")
    return f.where(F.col("type").isin("Polygon", "MultiPolygon")).select("cell_id", F.when(F.col("type") == "Polygon", F.array(one)).otherwise(many).alias("parts"))


def _ring(ring: Column) -> Column:
    """(signed double area, x moment, y moment) of a ring by the shoelace formula, taken about its first point so that far
    coordinates lose no digits."""
    n = F.size(ring)
    x0, y0 = F.get(F.get(ring, F.lit(0)), F.lit(0)), F.get(F.get(ring, F.lit(0)), F.lit(1))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, k: Column) -> Column:
        p, q = F.get(ring, k), F.get(ring, F.pmod(k + 1, n))
        px, py, qx, qy = F.get(p, F.lit(0)) - x0, F.get(p, F.lit(1)) - y0, F.get(q, F.lit(0)) - x0, F.get(q, F.lit(1)) - y0
        cross = px * qy - qx * py
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (px + qx) * cross).alias("x"), (acc["y"] + (py + qy) * cross).alias("y"))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)
    return F.struct(total["a"].alias("a"), (total["x"] / 3 + x0 * total["a"]).alias("x"), (total["y"] / 3 + y0 * total["a"]).alias("y"), x0.alias("fx"), y0.alias("fy"))


def measured(shapes: DataFrame) -> DataFrame:
    """(cell_id, area, x, y): area and centroid of each feature; holes are taken off, several parts add up; a feature without
    area has its first point as centroid."""
    rings = shapes.select("cell_id", F.posexplode("parts").alias("part", "rings")).select("cell_id", "part", F.posexplode("rings").alias("k", "ring")).where(F.size("ring") > 0)
    r = rings.select("cell_id", "k", _ring(F.col("ring")).alias("m"))
    # The outer ring counts positive, holes negative, whichever way they run.
    sign = F.when(F.col("k") == 0, F.signum("m.a")).otherwise(-F.signum("m.a"))
    total = r.groupBy("cell_id").agg(F.sum(sign * F.col("m.a")).alias("a"), F.sum(sign * F.col("m.x")).alias("x"), F.sum(sign * F.col("m.y")).alias("y"), F.min_by(F.struct("m.fx", "m.fy"), "k").alias("first"))
    flat = F.col("a") == 0
    return total.select("cell_id", (F.col("a") / 2).alias("area"), F.when(flat, F.col("first.fx")).otherwise(F.col("x") / F.when(flat, 1.0).otherwise(F.col("a"))).alias("x"), F.when(flat, F.col("first.fy")).otherwise(F.col("y") / F.when(flat, 1.0).otherwise(F.col("a"))).alias("y"))


def with_polygons(store: Store, shapes: DataFrame, prefix: str = "cell", microns: float | None = None, allow_missing: bool = False) -> Store:
    """obs with <prefix>_area (in square microns if a pixel's size is given) and obsm/spatial with the centroids."""
    m = measured(shapes).select(F.col("cell_id").alias("_id"), (F.col("area") * (microns or 1.0) ** 2).alias(f"{prefix}_area"), "x", "y")
    rows = store.obs.data.withColumn("_n", cell_number(F.col("name")))
    n = rows.join(m.select("_id"), F.col("_n") == F.col("_id"), "left_anti").count()
    if n and not allow_missing:
        raise ValueError(f"{n} cells are without a polygon")
    rows = rows.join(m, F.col("_n") == F.col("_id"), "left")
    nan = F.lit(float("nan"))
    xy = rows.select(F.col("pos").alias("i"), F.array(F.coalesce("x", nan), F.coalesce("y", nan)).alias("values"))
    obs = rows.withColumn(f"{prefix}_area", F.coalesce(f"{prefix}_area", nan)).drop("_n", "_id", "x", "y")
    return Store(Frame(obs, store.obs.categories), store.var, {**store.matrices, "obsm/spatial": Matrix(xy, (store.obs.data.count(), 2), "float64", "dense")}, store.frames, store.uns, store.raw)


def _joined(store: Store, raw: DataFrame, what: str, *columns) -> DataFrame:
    """obs with columns of an analysis table by its first column; a key that is no row's, or comes twice, is refused."""
    rows, found = joins.checked_left(store.obs.data, raw.select(F.col(f"`{raw.columns[0]}`").alias("_barcode"), *columns), "_barcode", what=what)
    if found.extra:
        raise ValueError(f"{what}: {found.extra} rows are of no observation")
    return rows


def require_numbers(raw: DataFrame, columns: list[str], what: str) -> None:
    """Refuse columns of text that hold something other than numbers."""
    bad = raw.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(str(k)) for k, c in enumerate(columns)]).first()
    if odd := [c for c, n in zip(columns, bad, strict=True) if n]:
        raise ValueError(f"{what}: {odd[0]!r} holds something other than numbers")


def with_clusters(store: Store, path: str, name: str) -> Store:
    """obs with a categorical column from a Barcode,Cluster table, labels in natural order, rows without one missing."""
    raw = store.spark.read.option("header", True).csv(path)
    if "Cluster" not in raw.columns:
        raise ValueError(f"{path} has no column Cluster")
    rows = _joined(store, raw, name, F.col("Cluster").alias(name))
    obs = axis.categorised(Frame(rows, store.obs.categories), name)
    return Store(obs, store.var, store.matrices, store.frames, store.uns, store.raw)


def with_projection(store: Store, path: str, name: str) -> Store:
    """obsm/<name> from a Barcode,a-1,a-2,... table of numbers; rows without one are NaN."""
    raw = store.spark.read.option("header", True).csv(path)
    columns = raw.columns[1:]
    require_numbers(raw, columns, name)
    rows = _joined(store, raw, name, F.array(*[F.col(f"`{c}`").try_cast("double") for c in columns]).alias("_v"))
    nan = F.lit(float("nan"))
    v = F.coalesce(F.transform("_v", lambda x: F.coalesce(x, nan)), F.array_repeat(nan, len(columns)))
    m = Matrix(rows.select(F.col("pos").alias("i"), v.alias("values")), (store.obs.data.count(), len(columns)), "float64", "dense")
    return store.with_matrix(f"obsm/{name}", m)


def scale_factors(spark: SparkSession, path: str) -> dict:
    """The scale factors of a spatial bundle."""
    return json.loads(files.read_bytes(spark, path))


def _there(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str | None:
    return next((f"{folder}/{n}" for n in names if files.exists(spark, f"{folder}/{n}")), None)


def _counts_in(spark: SparkSession, folder: str, kind: str, unfiltered: bool) -> str | None:
    """The count file of a folder, with or without a sample's name before it."""
    wanted = f"{MATRICES[kind][int(unfiltered)]}.h5"
    found = [n for n in files.names(spark, folder) if n == wanted or n.endswith(f"_{wanted}")]
    if len(found) > 1:
        raise ValueError(f"{folder} holds several count files: {', '.join(found)}")
    return f"{folder}/{found[0]}" if found else None


def _bins(spark: SparkSession, folder: str) -> dict[int, str]:
    found = {}
    for n in files.names(spark, f"{folder}/binned_outputs"):
        m = re.fullmatch(r"square_0*([0-9]+)um", n)
        if m:
            found[int(m[1])] = f"{folder}/binned_outputs/{n}"
    return found


def _slide(spark: SparkSession, path: str) -> str | None:
    """The folder of a slide at a path or in its ``outs``."""
    for folder in (path.rstrip("/"), f"{path.rstrip('/')}/outs"):
        if _bins(spark, folder) or files.exists(spark, f"{folder}/{OUTLINES['cell']}"):
            return folder
        if files.exists(spark, f"{folder}/spatial/scalefactors_json.json") and _there(spark, f"{folder}/spatial", POSITION_FILES):
            return folder
    return None


def is_slide(spark: SparkSession, path: str) -> bool:
    return bool(files.names(spark, path)) and _slide(spark, path) is not None


def is_bundle(spark: SparkSession, path: str) -> bool:
    have = files.names(spark, path)
    return "experiment.xenium" in have and "cell_feature_matrix.h5" in have


def _analysed(store: Store, folder: str) -> Store:
    """The clusters, projections and components that lie beside a matrix; rows without one stay empty, with one warning."""
    spark = store.spark
    before = store
    if path := _there(spark, folder, CLUSTERS):
        store = with_clusters(store, path, "graphclust")
    for name, places in PROJECTIONS.items():
        if path := _there(spark, folder, places):
            store = with_projection(store, path, name)
    if store is not before and "graphclust" in store.obs.columns and (n := store.obs.data.where(F.col("graphclust").isNull()).count()):
        warnings.warn(f"{n} rows are not analysed", stacklevel=2)
    return store


def _labelled(store: Store, folder: str, library: str | None, images: bool) -> Store:
    """uns/spatial of a slide: images, scale factors and what made the matrix, under the library's name."""
    spark, run = store.spark, dict(store.uns.get("cellranger", {}))
    ids = run.get("library_ids")
    ids = ids if isinstance(ids, list) else [ids] if ids else []
    if library is None and len(ids) > 1:
        raise ValueError(f"the matrix holds several libraries: {', '.join(map(str, ids))}")
    about = {"scalefactors": scale_factors(spark, f"{folder}/spatial/scalefactors_json.json"), "metadata": {k: run.pop(k) for k in ("chemistry_description", "software_version") if k in run}, "images": {}}
    for size in ("hires", "lowres") if images else ():
        at = f"{folder}/spatial/tissue_{size}_image.png"
        if files.exists(spark, at):
            x = arrays.read_image(files.read_bytes(spark, at))
            about["images"][size] = (x if x.dtype == np.uint8 else (x >> 8).astype(np.uint8)).tolist()
    uns = {k: v for k, v in store.uns.items() if k != "cellranger"}
    return changed(store, uns={**uns, **({"cellranger": run} if run else {}), "spatial": {library or str(ids[0] if ids else "library"): about}})


def read_slide(spark: SparkSession, path: str, unfiltered: bool = False, bin_size: int | None = None, cells: bool = False, library_id: str | None = None, images: bool = True, names: str = "ids", feature_type: str | None = None, genome: str | None = None, make_unique: bool = False) -> Store:
    """A slide's folder as a store: spots, bins of one size, or segmented cells, with their places, images and analyses."""
    folder = _slide(spark, path)
    if folder is None:
        raise ValueError(f"{path} is no slide's folder")
    sizes = _bins(spark, folder)
    if cells and files.exists(spark, f"{folder}/segmented_outputs"):
        folder = f"{folder}/segmented_outputs"
    elif sizes:
        if (bin_size or BIN) not in sizes:
            raise ValueError(f"no bins of {bin_size or BIN} microns: {', '.join(map(str, sizes))}")
        folder = sizes[bin_size or BIN]
    elif bin_size is not None:
        raise ValueError("spots have no bin size")
    outlines = files.exists(spark, f"{folder}/{OUTLINES['cell']}")
    if cells and not outlines:
        raise ValueError(f"{folder} holds no segmented cells")
    kind = "cells" if outlines else "spots"
    matrix = _counts_in(spark, folder, kind, unfiltered)
    if matrix is None:
        raise FileNotFoundError(f"{folder} has no {MATRICES[kind][int(unfiltered)]}.h5")
    store = counts.read(spark, matrix, names, feature_type, genome, make_unique)
    if outlines:
        size = scale_factors(spark, f"{folder}/spatial/scalefactors_json.json").get("microns_per_pixel")
        store = with_polygons(store, polygons(spark, f"{folder}/{OUTLINES['cell']}"), "cell", size)
        if files.exists(spark, f"{folder}/{OUTLINES['nucleus']}"):
            place = store.matrices["obsm/spatial"]
            store = with_polygons(store, polygons(spark, f"{folder}/{OUTLINES['nucleus']}"), "nucleus", size, allow_missing=True).with_matrix("obsm/spatial", place)
    else:
        store = with_positions(store, positions(spark, _there(spark, f"{folder}/spatial", POSITION_FILES)))
    return _analysed(_labelled(store, folder, library_id, images), folder)


def read_bundle(spark: SparkSession, path: str, names: str = "ids", feature_type: str | None = None, genome: str | None = None, make_unique: bool = False) -> Store:
    """A bundle of cells: counts, the table of cells, analyses (also packed ones)."""
    path = path.rstrip("/")
    table = f"{path}/cells.csv.gz"
    if not files.exists(spark, table):
        raise FileNotFoundError(f"{path} has no cells.csv.gz")
    store = counts.read(spark, f"{path}/cell_feature_matrix.h5", names, feature_type, genome, make_unique)
    cells = tables.read_csv(spark, table, "cell_id")
    have = store.obs.data.select("name")
    if extra := cells.data.join(have, "name", "left_anti").count():
        warnings.warn(f"{extra} cells of the table are not in the matrix", stacklevel=2)
        cells = Frame(cells.data.join(have, "name", "left_semi"), cells.categories)
    store = with_cells(store, cells)
    folder = path
    if not files.exists(spark, f"{path}/analysis") and files.exists(spark, f"{path}/analysis.tar.gz"):
        folder = files.scratch(spark, "analysis")
        wanted = {*CLUSTERS, *(p for places in PROJECTIONS.values() for p in places)}
        with files.open_input(f"{path}/analysis.tar.gz") as f, tarfile.open(fileobj=io.BufferedReader(f) if not hasattr(f, "peek") else f, mode="r:gz") as packed:
            for member in packed:
                # By name and content alone: nothing is unpacked where the archive says.
                name = member.name.removeprefix("./")
                if member.isfile() and name in wanted:
                    files.write_bytes(spark, f"{folder}/{name}", packed.extractfile(member).read())
    return _analysed(store, folder)


Reader = Callable[..., Store]
