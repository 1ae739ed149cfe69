"""The annotated matrix: two axis frames, matrices over them, metadata; and its form on disk."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Dtypes of matrices and the Spark types that hold them; unsigned and half-width ones are kept in the manifest.
SPARK_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
}
LAYOUTS = ("csr", "csc", "dense")
MANIFEST = "_manifest.json"


@dataclass(frozen=True)
class Categories:
    """The labels of a categorical column, in code order."""

    labels: tuple
    ordered: bool = False


@dataclass(frozen=True)
class Frame:
    """An axis table: pos (0, 1, ... in row order), name, and columns in their order."""

    data: DataFrame
    categories: dict[str, Categories] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c not in ("pos", "name")]


@dataclass(frozen=True)
class Matrix:
    """A matrix: (i, j, v) entries for sparse layouts, (i, values) rows for dense ones.

    CSR and CSC are one relation; the layout says how it is sorted when it is exported. Entries that
    are stored stay, zero or not.
    """

    data: DataFrame
    shape: tuple[int, ...]
    dtype: str
    layout: str = "csr"

    @property
    def sparse(self) -> bool:
        return self.layout != "dense"


@dataclass(frozen=True)
class Store:
    """obs, var, X and what hangs on them. ``uns`` is plain nested metadata."""

    obs: Frame
    var: Frame
    matrices: dict[str, Matrix] = field(default_factory=dict)
    frames: dict[str, Frame] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)
    raw: Store | None = None

    def with_matrix(self, path: str, m: Matrix) -> Store:
        return replace(self, matrices={**self.matrices, path: m})

    @property
    def spark(self) -> SparkSession:
        return self.obs.data.sparkSession


#: Which axis each dimension of an element under a mapping runs along.
AXES = {"X": ("obs", "var"), "layers": ("obs", "var"), "obsm": ("obs", None), "varm": ("var", None), "obsp": ("obs", "obs"), "varp": ("var", "var")}


def axes_of(path: str) -> tuple[str | None, str | None]:
    """The axes of an element's first two dimensions, by its path; unknown places are refused."""
    head = path.split("/")[0]
    if head not in AXES or (head == "X") != ("/" not in path):
        raise ValueError(f"{path!r} is no place for a matrix: X, or a name under {', '.join(k for k in AXES if k != 'X')}")
    return AXES[head]


def length(frame: Frame) -> int:
    """Rows of an axis; Parquet answers from its footers."""
    return frame.data.count()


def check_shape(store: Store, path: str, shape: tuple[int, ...]) -> None:
    """Refuse a matrix whose sides differ from the axes it lies along."""
    for side, axis in zip(shape, axes_of(path), strict=False):
        if axis and side != (n := length(getattr(store, axis))):
            raise ValueError(f"{path}: {side} rows along {axis}, which has {n}")


def create(spark: SparkSession, n_obs: int = 0, n_var: int = 0, obs_names: DataFrame | None = None, var_names: DataFrame | None = None) -> Store:
    """An empty store; axes without names get numbered ones, padded so that they sort."""

    def axis(n: int, names: DataFrame | None, stem: str) -> Frame:
        if names is not None:
            return Frame(numbered(names.select("name")))
        if n < 0:
            raise ValueError("an axis cannot be shorter than nothing")
        width = len(str(max(0, n - 1)))
        return Frame(spark.range(n).select(F.col("id").alias("pos"), F.format_string(f"{stem}_%0{width}d", "id").alias("name")))

    return Store(axis(n_obs, obs_names, "cell"), axis(n_var, var_names, "gene"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with pos in the order they are read in: partition counts are added up, no row moves."""
    parts = rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    counts = parts.groupBy("_part").count().collect()  # one row a partition
    start, at = {}, 0
    for part, n in sorted(counts):
        start[part] = at
        at += n
    shift = F.element_at(F.create_map(*[x for p, s in start.items() for x in (F.lit(p), F.lit(s).cast("long"))]), F.col("_part")) if start else F.lit(0).cast("long")
    mask = F.lit((1 << 33) - 1)
    return parts.select((shift + F.col("_row").bitwiseAND(mask)).alias("pos"), *rows.columns)


def describe(store: Store) -> Iterator[dict]:
    """One entry per element in path order: path, kind, dtype, shape, layout. Reads no values but axis lengths."""
    n = {"obs": length(store.obs), "var": length(store.var)}
    found = []
    for axis in ("obs", "var"):
        frame: Frame = getattr(store, axis)
        found.append({"path": axis, "kind": "frame", "shape": [n[axis], len(frame.columns)]})
        for f in frame.data.schema.fields:
            if f.name != "pos":
                kind = "categorical" if f.name in frame.categories else "column"
                found.append({"path": f"{axis}/{f.name}", "kind": kind, "dtype": f.dataType.simpleString(), "shape": [n[axis]]})
    for path, m in store.matrices.items():
        found.append({"path": path, "kind": "matrix", "dtype": m.dtype, "shape": list(m.shape), "layout": m.layout})
    for path, frame in store.frames.items():
        found.append({"path": path, "kind": "frame", "shape": [n[axes_of(path)[0]], len(frame.columns)]})

    def metadata(path: str, value: Any):
        if isinstance(value, dict):
            found.append({"path": path, "kind": "mapping", "shape": [len(value)]})
            for k, v in value.items():
                metadata(f"{path}/{k}", v)
        else:
            found.append({"path": path, "kind": "null" if value is None else type(value).__name__, "shape": [len(value)] if isinstance(value, list) else []})

    if store.uns:
        metadata("uns", store.uns)
    if store.raw is not None:
        found += [{**e, "path": f"raw/{e['path']}"} for e in describe(store.raw) if not e["path"].startswith("obs")]
    yield from sorted(found, key=lambda e: e["path"])


def summary(store: Store) -> str:
    """Size and keys, as text."""
    lines = [f"{length(store.obs)} obs x {length(store.var)} var"]
    for axis in ("obs", "var"):
        if names := getattr(store, axis).columns:
            lines.append(f"{axis}: {', '.join(names)}")
    by: dict[str, list[str]] = {}
    for path in [*store.matrices, *store.frames]:
        head, _, name = path.partition("/")
        by.setdefault(head, []).append(name)
    lines += [f"{k}: {', '.join(sorted(filter(None, v)))}".rstrip(": ") for k, v in sorted(by.items())]
    if store.uns:
        lines.append(f"uns: {', '.join(sorted(store.uns))}")
    if store.raw is not None:
        lines.append(f"raw: {length(store.raw.var)} var")
    return "\n".join(lines)


def listing(store: Store, under: str = "", depth: int | None = None, details: bool = False) -> list[str]:
    """Element paths, indented as a tree unless ``under`` finds nothing, which is refused."""
    rows = [e for e in describe(store) if not under or e["path"] == under or e["path"].startswith(under + "/")]
    if under and not rows:
        raise KeyError(f"there is no {under!r}")
    out = []
    for e in rows:
        level = e["path"].count("/") - (under.count("/") if under else 0)
        if depth is not None and level >= depth:
            continue
        text = "  " * level + e["path"].rpartition("/")[2]
        if details:
            text += "  " + " ".join([e["kind"], "x".join(map(str, e["shape"])), e.get("dtype", ""), e.get("layout", "")]).strip()
        out.append(text)
    return out


def matrices(store: Store) -> list[str]:
    """Paths of X, the layers by name, and raw/X."""
    found = [p for p in ("X", *sorted(p for p in store.matrices if p.startswith("layers/"))) if p in store.matrices]
    return found + (["raw/X"] if store.raw is not None and "X" in store.raw.matrices else [])


def save(store: Store, path: str, replace_it: bool = False, sources: tuple[str, ...] = (), compression: str = "zstd") -> None:
    """Write a store as Parquet folders and, last, the manifest; it appears under ``path`` as a whole."""
    spark = store.spark
    with files.staged(spark, path, replace_it, sources) as new:
        _save(store, new, compression)


def _save(store: Store, path: str, compression: str) -> None:
    spark = store.spark
    manifest: dict[str, Any] = {"version": 1, "frames": {}, "matrices": {}, "uns": store.uns}
    write = lambda df, name: df.write.option("compression", compression).parquet(f"{path}/{name}")
    for name, frame in (("obs", store.obs), ("var", store.var), *store.frames.items()):
        write(frame.data, name)
        manifest["frames"][name] = {c: {"labels": list(k.labels), "ordered": k.ordered} for c, k in frame.categories.items()}
    for name, m in store.matrices.items():
        # Sorted by the major axis, so that row groups have narrow ranges of it.
        keys = ["i"] if not m.sparse else ["i", "j"] if m.layout == "csr" else ["j", "i"]
        write(m.data.repartitionByRange(keys[0]).sortWithinPartitions(*keys), name)
        manifest["matrices"][name] = {"shape": list(m.shape), "dtype": m.dtype, "layout": m.layout}
    if store.raw is not None:
        _save(store.raw, f"{path}/raw", compression)
        manifest["raw"] = True
    files.write_bytes(spark, f"{path}/{MANIFEST}", json.dumps(manifest, allow_nan=True).encode())


def load(spark: SparkSession, path: str) -> Store:
    """A store from disk; nothing but the manifest is read. Element paths that leave the folder are refused."""
    if not files.exists(spark, f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"{path} holds no {MANIFEST}")
    manifest = json.loads(files.read_bytes(spark, f"{path}/{MANIFEST}"))
    for name in (*manifest["frames"], *manifest["matrices"]):
        if name.startswith("/") or ".." in name.split("/") or ":" in name:
            raise ValueError(f"{path}: the element {name!r} lies outside the store")
    if "obs" not in manifest["frames"]:
        manifest["frames"]["obs"] = None
    frames = {n: Frame(spark.read.parquet(f"{path}/{n}") if cats is not None else spark.read.parquet(f"{path.removesuffix('/raw')}/obs"), {c: Categories(tuple(k["labels"]), k["ordered"]) for c, k in (cats or {}).items()}) for n, cats in manifest["frames"].items()}
    found = {n: Matrix(spark.read.parquet(f"{path}/{n}"), tuple(m["shape"]), m["dtype"], m["layout"]) for n, m in manifest["matrices"].items()}
    raw = load(spark, f"{path}/raw") if manifest.get("raw") else None
    return Store(frames.pop("obs"), frames.pop("var"), found, frames, manifest["uns"], raw)
