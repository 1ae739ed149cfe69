"""Loom files: a dense matrix of genes by cells, layers, attributes of both axes, graphs; and the tables of regulons,
embeddings and clusterings that viewers keep in them."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as naming
from ..operators import axis, matrix, modalities
from . import files, hdf5, trees
from .hdf5 import FileSink, FileTree
from .store import Categories, Frame, Matrix, Store, numbered
from .trees import _range, read_range

# Attributes that name cells, genes by id and genes by symbol, the first one there counting.
CELLS = ("CellID", "cell_id", "obs_names", "barcode", "barcodes")
IDS = ("Accession", "gene_id", "gene_ids")
SYMBOLS = ("Gene", "gene_name", "gene_names", "gene_symbols", "Name")
EMBEDDINGS = ("Embeddings_X", "Embeddings_Y", "Embedding")
#: Most values of a global attribute, and most labels of a column that is listed with its values.
GLOBAL = 1_000_000
LABELS = 245
#: Tasks at most that read one matrix, each a chunk at a time.
JOBS = 4096


def is_loom(spark: SparkSession, path: str) -> bool:
    if files.names(spark, path) or not files.exists(spark, path) or files.read_bytes(spark, path, 8) != hdf5.MAGIC:
        return False
    try:
        tree = FileTree(spark, path)
        return tree.exists("matrix") and tree.array("matrix") is not None and (tree.exists("col_attrs") or path.endswith(".loom"))
    except ValueError:
        return False


def nonzero(spark: SparkSession, a: trees.Array) -> DataFrame:
    """(i, j, v) of the values of a two-dimensional array that are not zero; tasks take whole chunks and give only these. Chunks
    that are not stored are passed over where they stand for zeros."""
    import pickle

    kind = a.kind

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                a, tokens = pickle.loads(job.as_py())
                load = a.loader()
                for k, token in tokens:
                    start = [int(p) * c for p, c in zip(np.unravel_index(k, a.grid), a.chunks, strict=True)]
                    x = load(token)[: a.shape[0] - start[0], : a.shape[1] - start[1]]
                    i, j = np.nonzero((x != 0) | (x != x))
                    yield pa.RecordBatch.from_arrays([pa.array((i + start[0]).astype(np.int64)), pa.array((j + start[1]).astype(np.int64)), trees.arrow(x[i, j], kind)], names=["i", "j", "v"])

    if not math.prod(a.shape):
        return spark.createDataFrame([], f"i long, j long, v {kind}")
    bare = a.bare() if hasattr(a, "bare") else a
    zeros = isinstance(a, hdf5.FileArray) and not any(a.fill)
    held = [(k, t) for k, t in enumerate(a.tokens(0, math.prod(a.grid))) if t is not None or not zeros]
    each = max(1, 4 * trees.RUN // math.prod(a.chunks), -(-len(held) // JOBS))
    jobs = [(bare, held[k : k + each]) for k in range(0, len(held), each)]
    return trees._jobs(spark, jobs).mapInArrow(run, f"i long, j long, v {kind}") if jobs else spark.createDataFrame([], f"i long, j long, v {kind}")


def _matrix(tree: FileTree, path: str, dense: bool, shape: tuple[int, int]) -> Matrix:
    """A genes by cells array as cells by genes."""
    a = tree.array(path)
    if a.shape != shape[::-1]:
        raise ValueError(f"{path} is {a.shape[0]} x {a.shape[1]}, not {shape[1]} x {shape[0]}")
    kind = "float32" if a.name == "float16" and not dense else a.name
    m = Matrix(nonzero(tree.spark, a).select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), shape, kind)
    return matrix.densified(m) if dense else m


def records(spark: SparkSession, a: trees.Array) -> DataFrame:
    """(pos, a column a field) of an array of records."""
    import pickle

    kinds = {n: "string" if t.what in ("text", "vtext") else trees.SPARK_TYPES[str(t.dtype().newbyteorder("="))] for n, t, _ in a.type.raw}
    held = {n: object if kinds[n] == "string" else t.dtype().newbyteorder("=") for n, t, _ in a.type.raw}
    n = a.shape[0]
    step = max(1, trees.RUN // max(1, len(kinds)))
    jobs = [(b, _range(a, b, min(n, b + step))) for b in range(0, n, step)]

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                begin, part = pickle.loads(job.as_py())
                rows = read_range(part)
                columns = [trees.arrow(np.array([r[k] for r in rows], held[k]), kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(rows), dtype=np.int64)), *columns], names=["pos", *kinds])

    schema = "pos long, " + ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    return trees._jobs(spark, jobs).mapInArrow(run, schema) if jobs else spark.createDataFrame([], schema)


def _first(have: list[str], wanted: tuple[str, ...]) -> str | None:
    return next((w for w in wanted if w in have), None)


def _axis(tree: FileTree, group: str, n: int, name: str | None, stem: str) -> tuple[Frame, dict[str, Matrix], dict[str, Frame]]:
    """The attributes of an axis: one value each as columns, several as matrices, records as frames."""
    spark = tree.spark
    plain_arrays, wide, compound = {}, {}, {}
    for c in tree.names(group) if tree.exists(group) else []:
        a = tree.array(f"{group}/{c}")
        if a is None:
            continue
        if not a.shape or a.shape[0] != n:
            raise ValueError(f"{group}/{c} should have {n} rows")
        if a.type.what == "record":
            compound[c] = a
        elif len(a.shape) == 1:
            plain_arrays[c] = a
        else:
            wide[c] = a
    labels = {c: {v: k for k, v in a.type.inner.items()} for c, a in plain_arrays.items() if a.type.what == "number" and isinstance(a.type.inner, dict)}
    rows = trees.columns(spark, plain_arrays, group) if plain_arrays else spark.range(n).withColumnRenamed("id", "pos")
    rows = rows.select(*[modalities.with_characters(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])
    for c, names in labels.items():
        rows = rows.withColumn(c, F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])[F.col(f"`{c}`")])
    categories = {c: Categories(tuple(names[k] for k in sorted(names))) for c, names in labels.items() if c != name}
    own = F.col(f"`{name}`").cast("string") if name else F.concat(F.lit(stem), F.col("pos").cast("string"))
    frame = Frame(rows.select("pos", own.alias("name"), *[F.col(f"`{c}`").alias(naming.member_name(c)) for c in plain_arrays if c != name]), categories)
    matrices = {c: Matrix(trees.rows(spark, a), a.shape, a.name, "dense") for c, a in wide.items()}
    frames = {}
    for c, a in compound.items():
        table = records(spark, a)
        renamed = [naming.member_name(f) for f in table.columns]
        frames[c] = Frame(table.toDF(*renamed).join(frame.data.select("pos", "name"), "pos").select("pos", "name", *[f"`{f}`" for f in renamed if f != "pos"]))
    return frame, matrices, frames


def _graphs(tree: FileTree, group: str, n: int) -> dict[str, Matrix]:
    """Graphs as pairwise entries; ends may be stored as floats."""
    out = {}
    for g in tree.names(group) if tree.exists(group) else []:
        parts = {k: tree.array(f"{group}/{g}/{k}") for k in ("a", "b", "w")}
        e = trees.columns(tree.spark, parts, f"{group}/{g}").select(F.col("a").cast("long").alias("i"), F.col("b").cast("long").alias("j"), F.col("w").alias("v"))
        matrix.check_entries(e, (n, n), g)
        out[g] = Matrix(e, (n, n), parts["w"].name)
    return out


def _globals(tree: FileTree) -> dict[str, Any]:
    found = {k: trees.plain(v) for k, v in tree.attributes("").items()}
    for k in tree.names("attrs") if tree.exists("attrs") else []:
        a = tree.array(f"attrs/{k}")
        if a is None or math.prod(a.shape) > GLOBAL:
            warnings.warn(f"the attribute {k!r} is left out", stacklevel=2)
            continue
        found[k] = trees.plain(trees.whole(a))
    from html import unescape

    return {k: unescape(v) if isinstance(v, str) and "&#" in v else v for k, v in found.items()}


def read(spark: SparkSession, path: str, layer: str | None = None, dense: bool = False, names: str = "ids", obs_names_attr: str | None = None, var_names_attr: str | None = None, make_unique: bool = False) -> Store:
    """A loom file as a store of cells by genes; nothing but its structure and global attributes is read until it is used.

    X is the layer that is asked for, else ``spliced`` where there is one and none is called matrix, else the main matrix.
    """
    if names not in ("ids", "symbols"):
        raise ValueError("names are ids or symbols")
    tree = FileTree(spark, path)
    shape = tree.array("matrix").shape[::-1]
    layers = tree.names("layers") if tree.exists("layers") else []
    chosen = layer or ("spliced" if "spliced" in layers and "matrix" not in layers else "matrix")
    if chosen != "matrix" and chosen not in layers:
        raise ValueError(f"no layer {chosen!r}: matrix, {', '.join(layers)}")
    have = tree.names("row_attrs") if tree.exists("row_attrs") else []
    cells = obs_names_attr or _first(tree.names("col_attrs") if tree.exists("col_attrs") else [], CELLS)
    genes = var_names_attr or _first(have, (*IDS, *SYMBOLS) if names == "ids" else (*SYMBOLS, *IDS))
    obs, obsm, obs_frames = _axis(tree, "col_attrs", shape[0], cells, "")
    var, varm, var_frames = _axis(tree, "row_attrs", shape[1], genes, "")
    where = lambda x: "matrix" if x == "matrix" else f"layers/{x}"
    found = {"X": _matrix(tree, where(chosen), dense, shape)}
    for x in layers:
        if x != chosen:
            found[f"layers/{x}"] = _matrix(tree, f"layers/{x}", dense, shape)
    if chosen != "matrix":
        found[f"layers/{naming.claim('matrix', set(layers))}"] = _matrix(tree, "matrix", dense, shape)
    found |= {f"obsm/{k}": m for k, m in obsm.items()} | {f"varm/{k}": m for k, m in varm.items()}
    found |= {f"obsp/{k}": m for k, m in _graphs(tree, "col_graphs", shape[0]).items()} | {f"varp/{k}": m for k, m in _graphs(tree, "row_graphs", shape[1]).items()}
    attrs = _globals(tree)
    store = Store(obs, var, found, {**{f"obsm/{k}": f for k, f in obs_frames.items()}, **{f"varm/{k}": f for k, f in var_frames.items()}}, {"loom": {"attrs": attrs}} if attrs else {})
    if "MetaData" in attrs or any(k in obs_frames for k in (*EMBEDDINGS, "Clusterings", "RegulonsAUC")):
        store = _viewer(store)
    return replace(store, var=Frame(naming.unique_rows(store.var.data), store.var.categories)) if make_unique else store


def _viewer(store: Store) -> Store:
    """Embeddings as matrices of two columns and clusterings as categorical columns, named by the file's metadata."""
    attrs = dict(store.uns.get("loom", {}).get("attrs", {}))
    text = attrs.pop("MetaData", "")
    meta, plain = modalities.unfolded(text) if text else (None, "")
    if text and meta is None:
        warnings.warn("the viewer's metadata cannot be read", stacklevel=2)
    meta = meta or {}
    frames, matrices, obs, categories = dict(store.frames), dict(store.matrices), store.obs.data, dict(store.obs.categories)
    n = store.obs.data.count()
    uns: dict[str, Any] = {"metadata": plain} if text else {}
    x, y, single = (frames.pop(f"obsm/{k}", None) for k in EMBEDDINGS)
    titles = {str(e.get("id")): str(e.get("name", "")) for e in meta.get("embeddings", [])}
    used, placed = set(), {}

    def pair(ident: str, rows: DataFrame) -> None:
        name = naming.claim("X_" + ("_".join(titles[ident].replace("(", " ").replace(")", " ").split()) if titles.get(ident) else f"embedding_{ident}"), used)
        placed[ident] = name
        matrices[f"obsm/{name}"] = Matrix(rows.select(F.col("pos").alias("i"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("values")), (n, 2), "float64", "dense")

    if x is not None and y is not None:
        for ident in x.columns:
            if ident in y.columns:
                pair(ident, x.data.select("pos", F.col(f"`{ident}`").alias("x")).join(y.data.select("pos", F.col(f"`{ident}`").alias("y")), "pos"))
    if single is not None and "-1" not in placed and {"_X", "_Y"} <= set(single.columns):
        pair("-1", single.data.select("pos", F.col("_X").alias("x"), F.col("_Y").alias("y")))
    if placed:
        uns["embeddings"] = {k: {"name": titles.get(k, ""), "key": f"obsm/{v}"} for k, v in placed.items()}
    groups = frames.pop("obsm/Clusterings", None)
    if groups is not None:
        told = {str(c.get("id")): c for c in meta.get("clusterings", [])}
        used = set(obs.columns)
        for ident in groups.columns:
            name = naming.claim(told.get(ident, {}).get("name") or f"clustering_{ident}", used)
            codes = groups.data.select("pos", F.col(f"`{ident}`").cast("long").alias("_code"))
            clusters = sorted(told[ident].get("clusters", []), key=lambda c: c.get("id", 0)) if ident in told else []
            if clusters:
                labels = {int(c["id"]): str(c.get("description", f"Cluster {c['id']}")) for c in clusters}
            else:
                found = sorted(r[0] for r in codes.select("_code").distinct().limit(65_537).collect())
                labels = {k: str(k) for k in found}
            table = store.spark.createDataFrame(list(labels.items()), "code long, label string")
            coded = codes.join(F.broadcast(table), F.col("_code") == F.col("code"), "left").select("pos", F.col("label").alias(name))
            obs = obs.join(coded, "pos", "left")
            categories[name] = Categories(tuple(dict.fromkeys(labels.values())))
            uns.setdefault("clusterings", {})[ident] = {"name": told.get(ident, {}).get("name", ""), "key": f"obs/{name}"}
    if thresholds := meta.get("regulonThresholds"):
        keys = list(dict.fromkeys(k for t in thresholds for k, v in t.items() if not isinstance(v, dict | list)))
        uns["regulon_thresholds"] = {k: [t.get(k) for t in thresholds] for k in keys}
    kept = {**{k: v for k, v in store.uns.items() if k != "loom"}, **({"loom": {"attrs": attrs}} if attrs else {}), "scope": uns}
    return Store(Frame(obs, categories), store.var, matrices, frames, kept, store.raw)


def _written(text: str) -> bytes:
    return text.encode("ascii", "xmlcharrefreplace")


def _attributes(store: Store, side: str, own: dict[str, Any]) -> tuple[DataFrame, list[str], dict[str, Matrix]]:
    """One row of attributes per position, and the matrices of two dimensions, of an axis; a name goes to the file's own
    attributes first, then to columns, then to matrices."""
    frame: Frame = getattr(store, side)
    used = set(own)
    columns, matrices = dict(own), {}
    for c in frame.columns:
        if c in used or c in ("gene_symbols", "gene_ids") and side == "var":
            if c in used:
                warnings.warn(f"{side}/{c} is left out: the name is taken", stacklevel=3)
            continue
        used.add(c)
        columns[c] = F.col(f"`{c}`")
    for p, m in store.matrices.items():
        head, _, name = p.partition("/")
        if head == {"obs": "obsm", "var": "varm"}[side] and len(m.shape) == 2 and not m.sparse:
            if name in used:
                warnings.warn(f"{p} is left out: the name is taken", stacklevel=3)
                continue
            used.add(name)
            matrices[name] = m
    return frame.data.select("pos", *[e.alias(c) for c, e in columns.items()]), list(columns), matrices


def write(store: Store, path: str, replace: bool = False, layer: str = "X", scope: bool = False, clusterings: tuple[str, ...] = (), default_embedding: str | None = None) -> None:
    """A store as a loom file, dense as such files are; with ``scope`` its frames, embeddings of two columns and clusterings in
    the form that viewers read."""
    if layer not in store.matrices:
        raise KeyError(f"there is no {layer!r}")
    n_obs, n_var = store.matrices[layer].shape[:2]
    hidden = set(clusterings)
    var_columns = store.var.columns
    genes = {"Gene": F.col("gene_symbols") if "gene_symbols" in var_columns else F.col("name")}
    if "gene_symbols" in var_columns or "gene_ids" in var_columns:
        genes["Accession"] = F.col("gene_ids") if "gene_ids" in var_columns else F.col("name")
    bad = [c for c in clusterings if c not in store.obs.categories]
    if bad:
        raise ValueError(f"{bad[0]!r} is no categorical column of obs")
    with files.staged(store.spark, path, replace) as new:
        sink = FileSink(store.spark, new)
        for g in ("matrix", "layers", "col_attrs", "row_attrs", "col_graphs", "row_graphs", "attrs"):
            if g != "matrix":
                sink.group(g)
        others = {p.removeprefix("layers/") if p != "X" else "X": m for p, m in store.matrices.items() if p != layer and (p == "X" or p.startswith("layers/"))}
        for name, m in (("matrix", store.matrices[layer]), *((f"layers/{k}", m) for k, m in others.items())):
            sink.tiles(name, matrix.transposed(matrix.sparsified(m)).data, (n_var, n_obs), m.dtype)
        pairs = {p.partition("/")[2]: m for p, m in store.matrices.items() if scope and p.startswith("obsm/") and m.shape[1:] == (2,) and not m.sparse}
        for side, group, own, n in (("obs", "col_attrs", {"CellID": F.col("name")}, n_obs), ("var", "row_attrs", genes, n_var)):
            rows, names, wide = _attributes(store, side, own)
            kinds = dict(rows.dtypes)
            kept = [c for c in names if c not in hidden]
            made, dtypes = [], []
            for c in kept:
                if kinds[c] == "string":
                    text = F.coalesce(F.col(f"`{c}`"), F.lit(""))
                    made.append(F.arrow_udf(lambda t: pa.array([_written(x).decode() for x in t.to_pylist()], pa.string()), "string")(text).alias(c))
                    dtypes.append(None)
                else:
                    gap = F.lit(float("nan")) if kinds[c] in ("float", "double") else F.lit(0).cast(kinds[c]) if kinds[c] != "boolean" else F.lit(False)
                    value = F.coalesce(F.col(f"`{c}`"), gap)
                    made.append((value.cast("tinyint") if kinds[c] == "boolean" else value).alias(c))
                    dtypes.append("uint8" if kinds[c] == "boolean" else trees._DTYPES[kinds[c]])
            sink.large([f"{group}/{c}" for c in kept], rows.select("pos", *made), kept, [(n,)] * len(kept), dtypes, [{}] * len(kept))
            for name, m in wide.items():
                if name not in pairs:
                    sink.large([f"{group}/{name}"], m.data.select(F.col("i").alias("pos"), F.col("values").alias("v")), ["v"], [m.shape], [m.dtype], [{}])
        for side, group in (("obsp", "col_graphs"), ("varp", "row_graphs")):
            for p, m in store.matrices.items():
                if p.startswith(f"{side}/"):
                    g = f"{group}/{p.partition('/')[2]}"
                    e = numbered(matrix.sparsified(m).data.select("i", "j", "v"))
                    k = m.data.count() if m.sparse else e.count()
                    sink.large([f"{g}/a", f"{g}/b", f"{g}/w"], e, ["i", "j", "v"], [(k,)] * 3, ["int64", "int64", m.dtype], [{}] * 3)
        attrs = {k: v for k, v in store.uns.get("loom", {}).get("attrs", {}).items() if isinstance(v, str | int | float)}
        attrs |= {k: v for k, v in store.uns.items() if isinstance(v, str | int | float)}
        attrs["LOOM_SPEC_VERSION"] = "3.0.0"
        if scope:
            attrs["MetaData"] = _write_viewer(sink, store, pairs, clusterings, default_embedding, n_obs, n_var)
        for k, v in attrs.items():
            sink.small(f"attrs/{naming.member_name(k)}", np.array(_written(str(v)).decode(), object))
        sink.close()


def _table(sink: FileSink, path: str, rows: DataFrame, columns: dict[str, str], n: int) -> None:
    """An array of records, a field a column; its datatype must fit into a header."""
    dtype = np.dtype([(c, d) for c, d in columns.items()])
    if len(hdf5.type_message(dtype)) > 60_000:
        raise ValueError(f"{path}: {len(columns)} columns do not fit into one attribute")
    held = np.zeros(n, dtype)
    # One record a cell is what the format asks for; it is put together a block at a time.
    for block in range(0, n, 1 << 16):
        part = rows.where((F.col("pos") >= block) & (F.col("pos") < block + (1 << 16))).orderBy("pos").select(*[F.col(f"`{c}`") for c in columns]).toArrow()
        for c in columns:
            held[c][block : block + part.num_rows] = part.column(c).to_numpy()
    sink.small(path, held)


def _write_viewer(sink: FileSink, store: Store, pairs: dict[str, Matrix], clusterings: tuple[str, ...], default: str | None, n_obs: int, n_var: int) -> str:
    told = store.uns.get("scope", {})
    meta: dict[str, Any] = {"embeddings": [], "annotations": [], "clusterings": [], "metrics": [], "regulonThresholds": []}
    for p, f in store.frames.items():
        head, _, name = p.partition("/")
        kinds = dict(f.data.dtypes)
        columns = {c: trees._DTYPES[kinds[c]] for c in f.columns if kinds[c] in trees._DTYPES and kinds[c] != "boolean"}
        if columns:
            renamed = {c.replace(" ", "_"): d for c, d in columns.items()}
            data = f.data.select("pos", *[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in columns])
            _table(sink, f"{'col_attrs' if head == 'obsm' else 'row_attrs'}/{name}", data, renamed, n_obs if head == "obsm" else n_var)
    known = {v["key"].partition("/")[2]: (int(k), v["name"]) for k, v in told.get("embeddings", {}).items()}
    order = list(pairs)
    first = default or next((k for k, (i, _) in known.items() if i == -1 and k in pairs), None) or next((k for k in ("X_umap", "X_tsne") if k in pairs), order[0] if order else None)
    if default is not None and default not in pairs:
        raise ValueError(f"no embedding {default!r}: {', '.join(pairs)}")
    idents: dict[str, int] = {}
    for name in order:
        idents[name] = -1 if name == first else known[name][0] if name in known and known[name][0] >= 0 else max([-1, *idents.values(), *[i for i, _ in known.values()]]) + 1
        meta["embeddings"].append({"id": idents[name], "name": known[name][1] if name in known and known[name][1] else name.removeprefix("X_")})
    if pairs:
        rows = None
        for name, m in pairs.items():
            one = m.data.select(F.col("i").alias("pos"), F.get("values", F.lit(0)).cast("double").alias(f"x{idents[name]}"), F.get("values", F.lit(1)).cast("double").alias(f"y{idents[name]}"))
            rows = one if rows is None else rows.join(one, "pos")
        for side, field in (("x", "Embeddings_X"), ("y", "Embeddings_Y")):
            _table(sink, f"col_attrs/{field}", rows.select("pos", *[F.col(f"`{side}{i}`").alias(str(i)) for i in idents.values()]), {str(i): "float64" for i in idents.values()}, n_obs)
        _table(sink, "col_attrs/Embedding", rows.select("pos", F.col("`x-1`").alias("_X"), F.col("`y-1`").alias("_Y")), {"_X": "float64", "_Y": "float64"}, n_obs)
    recorded = [v["key"].partition("/")[2] for v in told.get("clusterings", {}).values()]
    chosen = [c for c in dict.fromkeys((*recorded, *clusterings)) if c in store.obs.categories]
    if chosen:
        coded = store.obs.data.select("pos", *[axis.codes(F.col(f"`{c}`"), store.obs.categories[c].labels).alias(str(k)) for k, c in enumerate(chosen)])
        _table(sink, "col_attrs/Clusterings", coded, {str(k): "int32" for k in range(len(chosen))}, n_obs)
        if "ClusterID" not in store.obs.columns:
            sink.large(["col_attrs/ClusterID"], coded.select("pos", F.col("`0`").alias("v")), ["v"], [(n_obs,)], ["int32"], [{}])
        for k, c in enumerate(chosen):
            meta["clusterings"].append({"id": k, "group": "", "name": c, "clusters": [{"id": i, "description": str(x)} for i, x in enumerate(store.obs.categories[c].labels)]})
    kinds = dict(store.obs.data.dtypes)
    for c in store.obs.columns:
        if c in chosen:
            continue
        if kinds[c] == "string":
            values = [r[0] for r in store.obs.data.select(F.col(f"`{c}`")).where(F.col(f"`{c}`").isNotNull()).distinct().limit(LABELS + 1).collect()]
            if len(values) <= LABELS:
                meta["annotations"].append({"name": c, "values": naming.natural(values)})
        elif kinds[c] != "boolean":
            meta["metrics"].append({"name": c})
    table = told.get("regulon_thresholds", {})
    meta["regulonThresholds"] = [dict(zip(table, row, strict=True)) for row in zip(*table.values(), strict=True)]
    return json.dumps(meta)
