"""Stores of chunked arrays in folders (Zarr versions 2 and 3): JSON metadata beside compressed chunk files."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import codecs, files, trees
from .store import Frame, Matrix, Store
from .trees import CHUNK, Array  # noqa: F401

CODECS = (None, "gzip", "zlib", "zstd", "blosc", "lz4")


@dataclass(frozen=True)
class FolderArray(Array):
    """An array in a folder: where it is, how chunks are packed and named, whether values lie column by column, the fill."""

    path: str
    codec: str | None
    fill: Any
    prefix: str
    separator: str
    columns_first: bool = False
    checked: bool = False

    def tokens(self, first: int, last: int) -> list:
        if not self.shape:
            return [self.prefix.rstrip("/.") or "0"]
        return [self.prefix + self.separator.join(map(str, np.unravel_index(k, self.grid))) for k in range(first, last)]

    def loader(self) -> Callable[[Any], np.ndarray]:
        def load(name: str) -> np.ndarray:
            try:
                with files.open_input(f"{self.path}/{name}") as f:
                    data = f.read()
            except FileNotFoundError:
                data = None
            return decoded(self, data)

        return load


def texts(data: bytes) -> list[str]:
    """Texts with their lengths before them."""
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size].decode("utf-8"))
        at += 4 + size
    return out


def decoded(a: FolderArray, data: bytes | None) -> np.ndarray:
    """A chunk in its full shape; an absent one is all fill."""
    count = math.prod(a.chunks)
    if data is None:
        fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(a.fill, a.fill) if isinstance(a.fill, str) and not a.text else a.fill
        return np.full(a.chunks, (fill or "") if a.text else (fill or 0), object if a.text else a.dtype)
    data = codecs.unpack(data[:-4] if a.checked else data, a.codec)
    if a.text:
        x = np.full(count, "", object)
        got = texts(data)
        x[: len(got)] = got
    else:
        x = np.frombuffer(data, a.dtype)
    # A text chunk at an edge may be shorter than a whole one.
    return x.reshape(a.chunks, order="F" if a.columns_first else "C")


def _version_3(path: str, meta: dict) -> FolderArray:
    codec, text, order, checked = None, False, "<", False
    for c in meta["codecs"]:
        name, how = c["name"], c.get("configuration", {})
        if name == "bytes":
            order = ">" if how.get("endian") == "big" else "<"
        elif name == "vlen-utf8":
            text = True
        elif name in CODECS:
            codec = name
        elif name == "crc32c":
            checked = True
        else:
            raise ValueError(f"{path}: chunks in {name} are not read")
    kind = meta["data_type"] if isinstance(meta["data_type"], str) else meta["data_type"]["name"]
    text = text or kind in ("string", "variable_length_utf8")
    dtype = "object" if text else np.dtype(kind).newbyteorder(order).str
    names = meta["chunk_key_encoding"]
    separator = names.get("configuration", {}).get("separator", "/" if names["name"] == "default" else ".")
    prefix = "c" + separator if names["name"] == "default" else ""
    return FolderArray(tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), dtype, text, path, codec, meta.get("fill_value"), prefix, separator, False, checked)


def _version_2(path: str, meta: dict) -> FolderArray:
    codec = (meta["compressor"] or {}).get("id")
    if codec not in CODECS:
        raise ValueError(f"{path}: chunks in {codec} are not read")
    text = any(f["id"] == "vlen-utf8" for f in meta.get("filters") or [])
    if not text and meta["dtype"] == "|O":
        raise ValueError(f"{path}: objects are not read")
    return FolderArray(tuple(meta["shape"]), tuple(meta["chunks"]), "object" if text else meta["dtype"], text, path, codec, meta.get("fill_value"), "", meta.get("dimension_separator", "."), meta.get("order", "C") == "F")


class FolderTree(trees.Tree):
    """A folder as a tree; metadata are read once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._node = cache(self._read)

    def _json(self, path: str) -> dict | None:
        return json.loads(files.read_bytes(self.spark, path)) if files.exists(self.spark, path) else None

    def _read(self, path: str) -> tuple[FolderArray | None, dict] | None:
        at = f"{self.path}/{path}".rstrip("/")
        v3 = self._json(f"{at}/zarr.json")
        if v3 is not None:
            return (None if v3["node_type"] == "group" else _version_3(at, v3)), v3.get("attributes", {})
        v2 = self._json(f"{at}/.zarray")
        if v2 is None and not files.exists(self.spark, f"{at}/.zgroup"):
            return None
        return (_version_2(at, v2) if v2 is not None else None), self._json(f"{at}/.zattrs") or {}

    def exists(self, path: str) -> bool:
        return self._node(path) is not None

    def _need(self, path: str) -> tuple[FolderArray | None, dict]:
        found = self._node(path)
        if found is None:
            raise FileNotFoundError(f"{self.path}/{path} is neither an array nor a group")
        return found

    def names(self, path: str) -> list[str]:
        at = f"{self.path}/{path}".rstrip("/")
        return [n for n in files.names(self.spark, at) if not n.startswith(".") and n != "zarr.json"]

    def attributes(self, path: str) -> dict:
        return self._need(path)[1]

    def array(self, path: str) -> FolderArray | None:
        return self._need(path)[0]


def read(spark: SparkSession, path: str) -> Store:
    """A folder of chunked arrays laid out as an annotated matrix; only metadata are read until the store is used."""
    tree = FolderTree(spark, path)
    tree.attributes("")
    return trees.read_store(tree)


def frame(spark: SparkSession, path: str) -> Frame:
    return trees.frame(FolderTree(spark, path), "")


def array_matrix(spark: SparkSession, path: str) -> Matrix:
    return trees.array_matrix(FolderTree(spark, path), "")


def _json_value(value: Any) -> Any:
    return value.tolist() if isinstance(value, np.ndarray | np.generic) else value


def _pack(data: bytes, version: int) -> bytes:
    if version == 2:
        return zlib.compress(data, 1)
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _chunk_bytes(values, dtype: str | None, step: int) -> bytes:
    if dtype is None:
        parts = [x.encode() for x in values] + [b""] * (step - len(values))
        return len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(4, "little") + p for p in parts)
    if len(values) == step:
        return np.ascontiguousarray(values).tobytes()
    x = np.zeros((step, *values.shape[1:]), dtype)
    x[: len(values)] = values
    return x.tobytes()


class FolderSink(trees.Sink):
    """Writes groups and arrays of either version; tasks write the chunk files."""

    def __init__(self, spark: SparkSession, root: str, version: int = 2):
        self.spark, self.root, self.version = spark, root, version

    def put(self, path: str, data: bytes) -> None:
        files.write_bytes(self.spark, f"{self.root}/{path}", data)

    def group(self, path: str, **attributes) -> None:
        at = f"{path}/" if path else ""
        attributes = {k: _json_value(v) for k, v in attributes.items()}
        if self.version == 3:
            self.put(f"{at}zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes}).encode())
            return
        self.put(f"{at}.zgroup", b'{"zarr_format": 2}')
        self.put(f"{at}.zattrs", json.dumps(attributes).encode())

    def head(self, path: str, shape: tuple[int, ...], step: int, dtype: str | None, attributes: dict) -> None:
        """The metadata of an array whose chunks hold ``step`` rows."""
        chunks = [step, *shape[1:]] if shape else []
        attributes = {k: _json_value(v) for k, v in attributes.items()}
        if self.version == 3:
            kind = "string" if dtype is None else np.dtype(dtype).name
            first = {"name": "vlen-utf8"} if dtype is None else {"name": "bytes", "configuration": {"endian": "little"}}
            meta = {
                "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [max(1, c) for c in chunks]}},
                "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "" if dtype is None else False if kind == "bool" else 0,
                "codecs": [first, {"name": "zstd", "configuration": {"level": 1, "checksum": False}}], "attributes": attributes, "storage_transformers": [],
            }
            self.put(f"{path}/zarr.json", json.dumps(meta).encode())
            return
        filters = [{"id": "vlen-utf8"}] if dtype is None else None
        meta = {"zarr_format": 2, "shape": list(shape), "chunks": chunks, "dtype": "|O" if dtype is None else np.dtype(dtype).str, "compressor": {"id": "zlib", "level": 1}, "fill_value": "" if dtype is None else 0, "order": "C", "filters": filters}
        self.put(f"{path}/.zarray", json.dumps(meta).encode())
        self.put(f"{path}/.zattrs", json.dumps(attributes).encode())

    def _name(self, k: int, rank: int) -> str:
        place = [str(k), *["0"] * (rank - 1)]
        return "c/" + "/".join(place) if self.version == 3 else ".".join(place)

    def small(self, path: str, values: np.ndarray, **attributes) -> None:
        dtype = None if values.dtype == object else values.dtype.str
        step = max(1, values.shape[0]) if values.shape else 1
        self.head(path, values.shape, step, dtype, attributes)
        if values.size:
            flat = [str(x) for x in values.ravel().tolist()] if dtype is None else values.reshape(step, *values.shape[1:])
            name = self._name(0, values.ndim) if values.shape else "c" if self.version == 3 else "0"
            self.put(f"{path}/{name}", _pack(_chunk_bytes(flat, dtype, step), self.version))

    def large(self, paths: Sequence[str], rows: DataFrame, columns: Sequence[str], shapes: Sequence[tuple[int, ...]], dtypes: Sequence[str | None], attributes: Sequence[dict]) -> None:
        step = trees.chunk_rows(max(shapes, key=lambda s: math.prod(s[1:])))
        for p, s, d, x in zip(paths, shapes, dtypes, attributes, strict=True):
            self.head(p, s, step, d, x)
        root, version, names = self.root, self.version, [(p, len(s)) for p, s in zip(paths, shapes, strict=True)]
        dtypes = list(dtypes)

        def encode(k: int, chunk: int, values) -> bytes:
            path, rank = names[k]
            place = [str(chunk), *["0"] * (rank - 1)]
            at = "c/" + "/".join(place) if version == 3 else ".".join(place)
            data = _pack(_chunk_bytes(values, dtypes[k], step), version)
            # A task that is run again writes the same bytes to the same place.
            with files.open_output(f"{root}/{path}/{at}") as f:
                f.write(data)
            return b""

        trees.encoded(rows, columns, shapes, dtypes, encode).write.format("noop").mode("overwrite").save()


def write(store: Store, path: str, replace: bool = False, version: int = 2) -> None:
    """A store as a folder of version 2 or 3; tasks write the chunks."""
    if version not in (2, 3):
        raise ValueError("versions are 2 and 3")
    with files.staged(store.spark, path, replace) as new:
        trees.write_store(FolderSink(store.spark, new, version), store)
