"""Trees of groups and chunked arrays: how an annotated matrix lies in them, whatever files they are kept in.

A tree says which members a group has, gives the attributes of a member and, for an array, an ``Array`` whose
chunks any process can load by themselves. All bulk reading is done by tasks, each with a run of chunks of its own.
"""

from __future__ import annotations

import math
import pickle
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axis, matrix
from . import files
from .store import SPARK_TYPES, Categories, Frame, Matrix, Store, axes_of

#: Values that a task reads, about; most values of an array that is read as metadata; most rows whose pointers the driver
#: hands out to the tasks that read a sparse matrix.
RUN = 1 << 21
METADATA = 1_000_000
POINTERS = 1 << 24
#: Values in one chunk that is written.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Array(ABC):
    """An array: shape, chunks, dtype (object for text). Chunks are numbered in row-major order over the grid."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    text: bool

    @abstractmethod
    def tokens(self, first: int, last: int) -> list:
        """What a process needs to load each of the chunks from ``first`` up to ``last``."""

    @abstractmethod
    def loader(self) -> Callable[[Any], np.ndarray]:
        """A function of a token that gives the chunk as a whole, in its full size; called in the process that loads."""

    @property
    def kind(self) -> str:
        """The Spark type of a value."""
        return "string" if self.text else SPARK_TYPES[str(np.dtype(self.dtype).newbyteorder("="))]

    @property
    def name(self) -> str:
        """The dtype by name."""
        return str(np.dtype(self.dtype).newbyteorder("="))

    @property
    def grid(self) -> list[int]:
        return [math.ceil(s / c) for s, c in zip(self.shape, self.chunks, strict=True)]


class Tree(ABC):
    """Members by path, ``""`` being the root."""

    spark: SparkSession

    @abstractmethod
    def exists(self, path: str) -> bool: ...

    @abstractmethod
    def names(self, path: str) -> list[str]: ...

    @abstractmethod
    def attributes(self, path: str) -> dict: ...

    @abstractmethod
    def array(self, path: str) -> Array | None:
        """The array at a path; None for a group."""


def whole(a: Array) -> np.ndarray:
    """All of a small array, in the driver."""
    if math.prod(a.shape) > METADATA:
        raise ValueError(f"an array of more than {METADATA} values is no metadata")
    load = a.loader()
    if not a.shape:
        return load(a.tokens(0, 1)[0]).reshape(())
    out = np.empty(a.shape, object if a.text else a.dtype)
    if not out.size:
        return out
    for k, token in enumerate(a.tokens(0, math.prod(a.grid))):
        start = [p * c for p, c in zip(np.unravel_index(k, a.grid), a.chunks, strict=True)]
        stop = [min(s, b + c) for s, b, c in zip(a.shape, start, a.chunks, strict=True)]
        inside = tuple(slice(0, e - b) for b, e in zip(start, stop, strict=True))
        out[tuple(slice(b, e) for b, e in zip(start, stop, strict=True))] = load(token)[inside]
    return out


def arrow(values: np.ndarray, kind: str) -> pa.Array:
    """Values as Spark's types hold them."""
    if kind == "string":
        return pa.array(values.ravel().tolist(), pa.string())
    x = values.ravel()
    x = x.astype(x.dtype.newbyteorder("="))
    if x.dtype == np.uint64:
        return pa.array(x.tolist(), pa.uint64()).cast(pa.decimal128(20, 0))
    wider = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}.get(str(x.dtype))
    return pa.array(x.astype(wider) if wider else x)


def _jobs(spark: SparkSession, jobs: Sequence[Any]) -> DataFrame:
    """One partition for each job. They come as an RDD, of whose size the planner knows nothing: what is read is thousands of times
    as large as the jobs, and by their size it would be broadcast through the driver."""
    files.ship(spark)
    packed = spark.sparkContext.parallelize([(pickle.dumps(j),) for j in jobs], max(1, len(jobs)))
    return spark.createDataFrame(packed, "job binary")


def _runs(a: Array, most: int = RUN) -> Iterator[tuple[int, list]]:
    """Chunk tokens in runs: the number of the first chunk, and the tokens."""
    n, each = math.prod(a.grid), max(1, most // max(1, math.prod(a.chunks)))
    for k in range(0, n, each):
        yield k, a.tokens(k, min(n, k + each))


def values(spark: SparkSession, a: Array) -> DataFrame:
    """(pos, v) of an array in row-major order."""
    if not a.shape or not math.prod(a.shape):
        return spark.createDataFrame(pa.table({"pos": pa.array(range(1 if not a.shape else 0), pa.int64()), "v": arrow(whole(a), a.kind)}))
    kind = a.kind

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                a, first, tokens = pickle.loads(job.as_py())
                load = a.loader()
                for k, token in enumerate(tokens, first):
                    start = [p * c for p, c in zip(np.unravel_index(k, a.grid), a.chunks, strict=True)]
                    sides = [np.arange(b, min(s, b + c)) for s, b, c in zip(a.shape, start, a.chunks, strict=True)]
                    x = load(token)[tuple(slice(0, len(s)) for s in sides)]
                    pos = np.ravel_multi_index(np.ix_(*sides), a.shape).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int64)), arrow(x, kind)], names=["pos", "v"])

    bare = _bare(a)
    return _jobs(spark, [(bare, k, tokens) for k, tokens in _runs(a)]).mapInArrow(run, f"pos long, v {kind}")


def _bare(a: Array) -> Array:
    """The array without what only the driver needs; tokens say where chunks are."""
    return a.bare() if hasattr(a, "bare") else a


def rows(spark: SparkSession, a: Array) -> DataFrame:
    """(i, values) of an array of one or more dimensions: trailing axes flattened, no row of values moves if each chunk
    holds whole rows."""
    width = math.prod(a.shape[1:])
    kind = a.kind
    if not math.prod(a.shape):
        return spark.range(a.shape[0]).select(F.col("id").alias("i"), F.array().cast(f"array<{kind}>").alias("values"))

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                a, first, tokens = pickle.loads(job.as_py())
                load = a.loader()
                for k, token in enumerate(tokens, first):
                    start = [p * c for p, c in zip(np.unravel_index(k, a.grid), a.chunks, strict=True)]
                    size = [min(c, s - b) for s, b, c in zip(a.shape, start, a.chunks, strict=True)]
                    x = load(token)[tuple(slice(0, n) for n in size)]
                    # Pieces of rows: runs along the last axis.
                    lead = [np.arange(b, b + n) for b, n in zip(start[:-1], size[:-1], strict=True)] if len(size) > 1 else []
                    if len(size) == 1:
                        i, at, n = np.arange(start[0], start[0] + size[0]), np.zeros(size[0], np.int64), 1
                    else:
                        flat = np.ravel_multi_index(np.ix_(*lead), a.shape[:-1]).ravel() * a.shape[-1] + start[-1]
                        each = math.prod(a.shape[1:])
                        i, at, n = flat // each, flat % each, size[-1]
                    off = pa.array(np.arange(0, len(i) * n + 1, n, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(at.astype(np.int64)), pa.ListArray.from_arrays(off, arrow(x, kind))], names=["i", "at", "piece"])

    bare = _bare(a)
    pieces = _jobs(spark, [(bare, k, tokens) for k, tokens in _runs(a)]).mapInArrow(run, f"i long, at long, piece array<{kind}>")
    if len(a.shape) <= 2 and (len(a.shape) == 1 or a.chunks[1] >= width):
        return pieces.select("i", F.col("piece").alias("values"))
    sorted_pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])
    return pieces.groupBy("i").agg(F.flatten(sorted_pieces).alias("values"))


def _range(a: Array, begin: int, end: int) -> tuple:
    """What a process needs to read a range of a one-dimensional array."""
    step = a.chunks[0]
    first, last = begin // step, -(-end // step)
    return _bare(a), begin, end, first, a.tokens(first, last)


def read_range(job: tuple) -> np.ndarray:
    a, begin, end, first, tokens = job
    load, step = a.loader(), a.chunks[0]
    parts = [load(t)[max(0, begin - k * step) : max(0, end - k * step)] for k, t in enumerate(tokens, first)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def entries(spark: SparkSession, data: Array, indices: Array, indptr: Array, what: str = "matrix") -> DataFrame:
    """(major, minor, v) of a compressed sparse matrix. The driver reads the pointers and hands each task those of its run
    of entries, so nothing is shuffled; of more than POINTERS rows, or with pointers that do not fit, nothing is read."""
    if data.shape != indices.shape:
        raise ValueError(f"{what}: {data.shape[0]} values but {indices.shape[0]} indices")
    n, kind = data.shape[0], data.kind
    if indptr.shape[0] > POINTERS:
        return _joined(spark, data, indices, indptr)
    load, starts = indptr.loader(), []
    for token in indptr.tokens(0, indptr.grid[0]):
        starts.append(load(token))
    at = np.concatenate(starts)[: indptr.shape[0]].astype(np.int64) if starts else np.zeros(1, np.int64)
    check_pointers(at, n, what)
    step = max(1, RUN // data.chunks[0]) * data.chunks[0] if n else 1
    jobs = []
    for a in range(0, n, step):
        b = min(n, a + step)
        r, s = int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b, side="left"))
        jobs.append((_range(data, a, b), _range(indices, a, b), r, at[r : s + 1].tobytes()))

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                v, minor, row, pointers = pickle.loads(job.as_py())
                pointers = np.frombuffer(pointers, np.int64)
                x, j, (_, begin, end, *_) = read_range(v), read_range(minor), v
                inside = np.clip(pointers, begin, end)
                major = np.repeat(np.arange(row, row + len(inside) - 1), np.diff(inside))
                for k in range(0, len(x), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(major[part].astype(np.int64)), pa.array(j[part].astype(np.int64)), arrow(x[part], kind)], names=["major", "minor", "v"])

    return _jobs(spark, jobs).mapInArrow(run, f"major long, minor long, v {kind}") if jobs else spark.createDataFrame([], f"major long, minor long, v {kind}")


def check_pointers(at: np.ndarray, n: int, what: str) -> None:
    """Pointers begin at 0, never fall and end at the number of entries."""
    if not len(at) or at[0] != 0 or at[-1] != n or (np.diff(at) < 0).any():
        raise ValueError(f"{what}: its row pointers do not run from 0 up to {n}")


def _joined(spark: SparkSession, data: Array, indices: Array, indptr: Array) -> DataFrame:
    p = values(spark, indptr).select(F.col("pos").alias("major"), F.col("v").cast("long").alias("a"))
    ends = p.select((F.col("major") - 1).alias("major"), F.col("a").alias("b"))
    runs = p.join(ends, "major").where("b > a").select("major", F.explode(F.sequence("a", F.col("b") - 1)).alias("pos"))
    return runs.join(values(spark, indices).select("pos", F.col("v").cast("long").alias("minor")), "pos").join(values(spark, data), "pos").drop("pos")


def encoding(tree: Tree, path: str) -> str:
    """What an element is: by its tag, else by what it looks like."""
    tag = tree.attributes(path).get("encoding-type", "")
    if tag:
        return tag
    a = tree.array(path)
    if a is not None:
        return ("string" if a.text else "numeric-scalar") if not a.shape else "string-array" if a.text else "array"
    have = set(tree.names(path))
    if {"data", "indices", "indptr"} <= have:
        return str(tree.attributes(path).get("h5sparse_format", "csr")) + "_matrix"
    if {"codes", "categories"} <= have:
        return "categorical"
    if {"values", "mask"} <= have:
        return "nullable"
    return "dataframe" if "_index" in tree.attributes(path) else "dict"


def columns(spark: SparkSession, arrays: dict[str, Array], what: str = "table") -> DataFrame:
    """(pos, ...) of one-dimensional arrays of one length, side by side: each task reads the same range of all of them."""
    sizes = {a.shape[0] for a in arrays.values()}
    if len(sizes) > 1:
        raise ValueError(f"{what}: its columns differ in length: {', '.join(f'{k} {a.shape[0]}' for k, a in arrays.items())}")
    n = sizes.pop()
    schema = "pos long, " + ", ".join(f"`{k}` {a.kind}" for k, a in arrays.items())
    if not n:
        return spark.createDataFrame([], schema)
    step = max(1, RUN // len(arrays))
    kinds = {k: a.kind for k, a in arrays.items()}
    jobs = [(b, {k: _range(a, b, min(n, b + step)) for k, a in arrays.items()}) for b in range(0, n, step)]

    def run(batches):
        for batch in batches:
            for job in batch.column(0):
                begin, parts = pickle.loads(job.as_py())
                read = [arrow(read_range(p), kinds[k]) for k, p in parts.items()]
                pos = pa.array(np.arange(begin, begin + len(read[0]), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pos, *read], names=["pos", *parts])

    return _jobs(spark, jobs).mapInArrow(run, schema)


def frame(tree: Tree, path: str) -> Frame:
    """A group of columns as an axis frame. Columns are plain, categorical (codes and labels; in an older form the labels
    lie apart and codes refer to them) or nullable (values and a mask); all are read side by side."""
    attributes = tree.attributes(path)
    index = plain(attributes.get("_index", "_index"))
    order = [str(c) for c in np.atleast_1d(np.array(attributes.get("column-order", []), object)).tolist()]
    # Columns that the list leaves out come after those that it names.
    order += [c for c in tree.names(path) if c not in order and c not in (index, "__categories")]
    arrays: dict[str, Array] = {}
    made: list[tuple[str, Any, bool]] = []
    categories = {}
    for k, c in enumerate([index, *order]):
        at, own, nullable = f"{path}/{c}".strip("/"), f"c{k}", False
        a = tree.array(at)
        value = F.col(own)
        if a is not None:
            arrays[own] = a
            labels = tree.attributes(at).get("categories")
            if isinstance(labels, str) and tree.exists(labels):
                found = whole(tree.array(labels)).tolist()
                value = axis.labels_of(value, found)
                categories[c] = Categories(tuple(found), bool(plain(tree.attributes(labels).get("ordered", False))))
        elif (kind := encoding(tree, at)) == "categorical":
            labels = whole(tree.array(f"{at}/categories")).tolist()
            arrays[own] = tree.array(f"{at}/codes")
            value = axis.labels_of(value, labels)
            categories[c] = Categories(tuple(labels), bool(plain(tree.attributes(at).get("ordered", False))))
        elif kind.startswith("nullable"):
            arrays[own], arrays[f"m{k}"] = tree.array(f"{at}/values"), tree.array(f"{at}/mask")
            value, nullable = F.when(~F.col(f"m{k}"), value), True
        else:
            raise ValueError(f"{at}: a column of kind {kind!r} is not read")
        made.append((c, value, nullable))
    rows = columns(tree.spark, arrays, path)
    name = F.coalesce(made[0][1].cast("string"), F.lit("")).alias("name")
    return Frame(rows.select("pos", name, *[v.alias(c, metadata={"nullable": True} if n else {}) for c, v, n in made[1:]]), categories)


def array_matrix(tree: Tree, path: str) -> Matrix:
    """A dense array or a compressed sparse group as a matrix."""
    a = tree.array(path)
    if a is not None:
        if a.text:
            raise ValueError(f"{path}: text is no matrix")
        return Matrix(rows(tree.spark, a), a.shape, a.name, "dense")
    kind = encoding(tree, path)
    if kind not in ("csr_matrix", "csc_matrix"):
        raise ValueError(f"{path}: a matrix of kind {kind!r} is not read")
    data, indices, starts = (tree.array(f"{path}/{n}") for n in ("data", "indices", "indptr"))
    attributes = tree.attributes(path)
    shape = tuple(int(x) for x in (attributes.get("shape") if "shape" in attributes else attributes["h5sparse_shape"]))
    found = entries(tree.spark, data, indices, starts, path)
    i, j = ("major", "minor") if kind == "csr_matrix" else ("minor", "major")
    out = Matrix(found.select(F.col(i).alias("i"), F.col(j).alias("j"), "v"), shape, data.name, kind[:3])
    matrix.check_entries(out.data, shape, path)
    return out


def plain(value: Any) -> Any:
    """A value as metadata hold it."""
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value.tolist()] if value.shape else plain(value.item())
    if isinstance(value, np.generic):
        return value.item()
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else value


def metadata(tree: Tree, path: str) -> Any:
    """A member and all below it as nested plain values; sparse and text groups as what they hold."""
    a = tree.array(path)
    if a is not None:
        return None if tree.attributes(path).get("encoding-type") == "null" else plain(whole(a))
    return {n: metadata(tree, f"{path}/{n}") for n in tree.names(path)}


def read_store(tree: Tree, top: str = "") -> Store:
    """The annotated matrix under a group; only metadata are read until the store is used."""
    at = f"{top}/" if top else ""
    if "encoding-type" not in tree.attributes(top):
        warnings.warn("the file does not say that it is an annotated matrix; it is read as one", stacklevel=3)
    for need in ("obs", "var"):
        if not tree.exists(f"{at}{need}"):
            raise ValueError(f"there is no {need}")
    found: dict[str, Matrix] = {}
    frames: dict[str, Frame] = {}
    if tree.exists(f"{at}X") and tree.attributes(f"{at}X").get("encoding-type") != "null":
        found["X"] = array_matrix(tree, f"{at}X")
    for group in ("layers", "obsm", "varm", "obsp", "varp"):
        for name in tree.names(f"{at}{group}") if tree.exists(f"{at}{group}") else []:
            path = f"{at}{group}/{name}"
            if tree.array(path) is None and encoding(tree, path) == "dataframe":
                frames[f"{group}/{name}"] = frame(tree, path)
            else:
                found[f"{group}/{name}"] = array_matrix(tree, path)
    uns = metadata(tree, f"{at}uns") if tree.exists(f"{at}uns") else {}
    obs = frame(tree, f"{at}obs")
    raw = Store(obs, frame(tree, f"{at}raw/var"), {"X": array_matrix(tree, f"{at}raw/X")}) if tree.exists(f"{at}raw/X") else None
    return Store(obs, frame(tree, f"{at}var"), found, frames, uns, raw)


class Sink(ABC):
    """Where groups and arrays are written to."""

    spark: SparkSession

    @abstractmethod
    def group(self, path: str, **attributes) -> None: ...

    @abstractmethod
    def small(self, path: str, values: np.ndarray, **attributes) -> None:
        """An array that the driver holds; text as objects."""

    @abstractmethod
    def large(self, paths: Sequence[str], rows: DataFrame, columns: Sequence[str], shapes: Sequence[tuple[int, ...]], dtypes: Sequence[str | None], attributes: Sequence[dict]) -> None:
        """Arrays from columns of ``rows`` (pos, columns...): each row holds the values of one step along the first axis of
        each array, and there is one row a step. None as a dtype writes text."""


def chunk_rows(shape: tuple[int, ...]) -> int:
    """Steps along the first axis in one chunk."""
    return max(1, min(shape[0], CHUNK // max(1, math.prod(shape[1:]))))


def encoded(rows: DataFrame, columns: Sequence[str], shapes: Sequence[tuple[int, ...]], dtypes: Sequence[str | None], encode: Callable[[int, int, Any], bytes]) -> DataFrame:
    """(chunk, column, data): whole chunks of all arrays, made by ``encode(column number, chunk number, values)`` in tasks;
    values are an array of the chunk's rows, or a list of texts."""
    files.ship(rows.sparkSession)
    step = chunk_rows(max(shapes, key=lambda s: math.prod(s[1:])))
    dealt = rows.select(F.floor(F.col("pos") / step).alias("chunk"), "pos", *[F.col(f"`{c}`") for c in columns]).repartition("chunk").sortWithinPartitions("chunk", "pos")
    widths = [math.prod(s[1:]) for s in shapes]

    def flush(chunk, held):
        for k in range(len(columns)):
            parts = [p[k] for p in held]
            if dtypes[k] is None:
                x = [v or "" for p in parts for v in p.to_pylist()]
            else:
                flats = [p.flatten() if pa.types.is_list(p.type) else p for p in parts]
                x = np.concatenate([_numbers(f, dtypes[k]) for f in flats]).reshape(-1, widths[k])
            yield {"chunk": chunk, "column": k, "data": encode(k, chunk, x)}

    schema = pa.schema([("chunk", pa.int64()), ("column", pa.int32()), ("data", pa.binary())])

    def run(batches):
        held, of = [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if of is not None and at[a] != of:
                    yield pa.RecordBatch.from_pylist([*flush(of, held)], schema=schema)
                    held = []
                of = int(at[a])
                held.append([batch.column(2 + k).slice(a, b - a) for k in range(len(columns))])
        if held:
            yield pa.RecordBatch.from_pylist([*flush(of, held)], schema=schema)

    return dealt.mapInArrow(run, "chunk long, column int, data binary")


def _numbers(a: pa.Array, dtype: str) -> np.ndarray:
    if pa.types.is_decimal(a.type):
        return np.array([int(x) for x in a.to_pylist()], dtype)
    if pa.types.is_boolean(a.type):
        return np.array(a.to_pylist(), bool).astype(dtype)
    return a.to_numpy(zero_copy_only=False).astype(dtype)


_DTYPES = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def write_frame(sink: Sink, path: str, f: Frame, index: str = "_index") -> None:
    """A frame column by column: plain, categorical, or with a mask where whole numbers, booleans or texts have gaps. All
    columns are written in one pass."""
    kinds = dict(f.data.dtypes)
    names = ["name", *f.columns]
    for c in f.columns:
        if kinds[c] != "string" and kinds[c] not in _DTYPES and c not in f.categories:
            raise ValueError(f"{path}/{c}: a column of type {kinds[c]} cannot be written")
    facts = f.data.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"gone{k}") for k, c in enumerate(names)]).first()
    n = facts["n"]
    sink.group(path, **{"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": index, "column-order": np.array(f.columns, object)})
    tag = lambda dtype: {"encoding-type": "string-array" if dtype is None else "array", "encoding-version": "0.2.0"}
    parts: list[tuple[str, Any, str | None]] = []
    for k, name in enumerate(names):
        at, c, kind = f"{path}/{index if name == 'name' and not k else name}", F.col(f"`{name}`"), kinds[name]
        categories = f.categories.get(name) if k else None
        if categories is not None:
            sink.group(at, **{"encoding-type": "categorical", "encoding-version": "0.2.0", "ordered": categories.ordered})
            labels = np.array(categories.labels, object if not categories.labels or isinstance(categories.labels[0], str) else None)
            sink.small(f"{at}/categories", labels, **tag(None if labels.dtype == object else "number"))
            parts.append((f"{at}/codes", axis.codes(c, categories.labels), axis.code_dtype(len(categories.labels))))
            continue
        dtype = None if kind == "string" else _DTYPES[kind]
        if kind in ("float", "double"):
            parts.append((at, F.coalesce(c, F.lit(float("nan"))), dtype))
        elif facts[f"gone{k}"] and k:
            which = {"string": "string-array", "boolean": "boolean"}.get(kind, "integer")
            sink.group(at, **{"encoding-type": f"nullable-{which}", "encoding-version": "0.1.0"})
            fill = F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(0).cast(kind)
            parts += [(f"{at}/values", F.coalesce(c, fill), dtype), (f"{at}/mask", c.isNull(), "bool")]
        else:
            parts.append((at, c, dtype))
    own = [f"_{k}" for k in range(len(parts))]
    rows = f.data.select("pos", *[e.alias(o) for (_, e, _), o in zip(parts, own, strict=True)])
    sink.large([p for p, _, _ in parts], rows, own, [(n,)] * len(parts), [d for _, _, d in parts], [tag(d) for _, _, d in parts])


def numbered_entries(m: Matrix) -> tuple[DataFrame, DataFrame]:
    """(pos, v, minor) of a sparse matrix's entries in the order of its layout, and (pos, start) of its pointers without the
    last."""
    major, minor = ("i", "j") if m.layout == "csr" else ("j", "i")
    starts = matrix.pointers(m, major)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(major).orderBy(minor)) - 1
    placed = m.data.withColumn("_rank", rank).join(starts.select(F.col("pos").alias(major), "start"), major)
    return placed.select((F.col("start") + F.col("_rank")).alias("pos"), "v", F.col(minor).alias("minor")), starts.select("pos", "start")


def write_sparse(sink: Sink, path: str, m: Matrix, names: tuple[str, str, str] = ("data", "indices", "indptr")) -> None:
    """The three arrays of a sparse matrix under a group that exists."""
    n, side = m.data.count(), m.shape[0 if m.layout == "csr" else 1]
    index = matrix.index_dtype(max(n, *m.shape))
    placed, starts = numbered_entries(m)
    tag = {"encoding-type": "array", "encoding-version": "0.2.0"}
    sink.large([f"{path}/{names[0]}", f"{path}/{names[1]}"], placed, ["v", "minor"], [(n,), (n,)], [m.dtype, index], [tag, tag])
    last = starts.sparkSession.createDataFrame([(side, n)], "pos long, start long")
    sink.large([f"{path}/{names[2]}"], starts.union(last), ["start"], [(side + 1,)], [index], [tag])


def write_matrix(sink: Sink, path: str, m: Matrix) -> None:
    if not m.sparse:
        sink.large([path], m.data.select(F.col("i").alias("pos"), F.col("values").alias("v")), ["v"], [m.shape], [m.dtype], [{"encoding-type": "array", "encoding-version": "0.2.0"}])
        return
    sink.group(path, **{"encoding-type": f"{m.layout}_matrix", "encoding-version": "0.1.0", "shape": np.array(m.shape, np.int64)})
    write_sparse(sink, path, m)


def write_metadata(sink: Sink, path: str, value: Any) -> None:
    """Nested plain values; None is left out."""
    if isinstance(value, dict):
        sink.group(path, **{"encoding-type": "dict", "encoding-version": "0.1.0"})
        for k, v in value.items():
            write_metadata(sink, f"{path}/{k}", v)
    elif value is not None:
        x = np.array(value)
        if x.dtype.kind in "UO":
            if x.ndim > 1:
                raise ValueError(f"{path}: text of more than one dimension cannot be written")
            x = np.array(value, object)
        kind = ("string" if x.dtype == object else "numeric-scalar") if not x.shape else "string-array" if x.dtype == object else "array"
        sink.small(path, x, **{"encoding-type": kind, "encoding-version": "0.2.0"})


def write_store(sink: Sink, store: Store, top: str = "") -> None:
    """An annotated matrix under a group; every element's place is checked before anything is written."""
    for p in (*store.matrices, *store.frames):
        axes_of(p)
    at = f"{top}/" if top else ""
    sink.group(top, **{"encoding-type": "anndata", "encoding-version": "0.1.0"})
    for name, f in (("obs", store.obs), ("var", store.var)):
        write_frame(sink, f"{at}{name}", f)
    for group in ("layers", "obsm", "varm", "obsp", "varp"):
        sink.group(f"{at}{group}", **{"encoding-type": "dict", "encoding-version": "0.1.0"})
    for p, m in store.matrices.items():
        write_matrix(sink, f"{at}{p}", m)
    for p, f in store.frames.items():
        write_frame(sink, f"{at}{p}", f)
    write_metadata(sink, f"{at}uns", store.uns)
    if store.raw is not None:
        sink.group(f"{at}raw", **{"encoding-type": "raw", "encoding-version": "0.1.0"})
        write_frame(sink, f"{at}raw/var", store.raw.var)
        write_matrix(sink, f"{at}raw/X", store.raw.matrices["X"])
