"""NumPy files, JSON metadata and images."""

from __future__ import annotations

import io
import json
import math
import struct
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .store import SPARK_TYPES, Matrix, Store

#: Elements in one piece of a .npy file, and the most values that a JSON document may hold.
PIECE = 4_000_000
JSON_MOST = 1_000_000


def npy_header(spark: SparkSession, path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """dtype, shape, column order and data offset of a .npy file; arrays of objects are refused."""
    head = files.read_bytes(spark, path, 65_536)
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, order, dtype = read(f)
    if dtype.hasobject:
        raise ValueError(f"{path} holds objects")
    return dtype, shape, order, f.tell()


def read_npy(spark: SparkSession, path: str) -> Matrix:
    """A one- or more-dimensional .npy file as dense rows (i, values), read in pieces of whole rows.

    Each task reads its own bytes of a file on a path that all workers have; trailing axes are flattened
    and kept in the shape.
    """
    dtype, shape, columns_first, offset = npy_header(spark, path)
    if columns_first and len(shape) > 1:
        raise ValueError(f"{path} is stored by columns")
    kind = str(dtype)
    if kind not in SPARK_TYPES:
        raise ValueError(f"{path}: no matrix can hold {kind}")
    width = math.prod(shape[1:])
    rows = shape[0] if shape else 1
    files.ship(spark)
    spark.dataSource.register(NpySource)
    data = spark.read.format("npy_rows").options(path=path.removeprefix("file://"), dtype=dtype.str, width=width, rows=rows, offset=offset, kind=SPARK_TYPES[kind]).load()
    return Matrix(data, (rows, *shape[1:]), kind, "dense")


class NpySource(DataSource):
    """Rows of a .npy file, one partition per run of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        return f"i long, values array<{self.options['kind']}>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(dict(self.options))


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        rows, width = int(self.options["rows"]), max(1, int(self.options["width"]))
        step = max(1, PIECE // width)
        return [InputPartition((a, min(rows, a + step))) for a in range(0, rows, step)]

    def read(self, partition):
        import pyarrow as pa

        a, b = partition.value
        width, dtype = int(self.options["width"]), np.dtype(self.options["dtype"])
        with open(self.options["path"], "rb") as f:
            f.seek(int(self.options["offset"]) + a * width * dtype.itemsize)
            x = np.frombuffer(f.read((b - a) * width * dtype.itemsize), dtype).reshape(b - a, width)
        kinds = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        kind = self.options["kind"]
        flat = pa.array(x.astype(np.float32 if dtype.kind == "f" and dtype.itemsize == 2 else x.dtype.newbyteorder("=")).ravel()).cast(kinds.get(kind, pa.decimal128(20, 0)))
        at = pa.array(np.arange(0, (b - a) * width + 1, width, dtype=np.int32)) if width else pa.array(np.zeros(b - a + 1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int64)), pa.ListArray.from_arrays(at, flat)], names=["i", "values"])


def npy_bytes(rows: DataFrame, column: str, dtype: str | None = None) -> bytes:
    """A column in row order as a .npy file. Whole numbers and booleans with gaps come as float64 with NaN, text at its
    greatest width."""
    kind = dict(rows.dtypes)[column]
    c = F.col(f"`{column}`")
    facts = rows.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("gone"), *([F.max(F.length(c)).alias("w")] if kind == "string" else [])).first()
    names = {v: k for k, v in (("bool", "boolean"), ("int8", "tinyint"), ("int16", "smallint"), ("int32", "int"), ("int64", "bigint"), ("float32", "float"), ("float64", "double"))}
    if kind == "string":
        to = np.dtype(f"<U{max(1, facts['w'] or 0)}")
    else:
        to = np.dtype(dtype or names.get(kind, "float64"))
        if facts["gone"] and to.kind in "iub":
            to = np.dtype("float64")
    out = np.empty(facts["n"], to)
    fill = "" if kind == "string" else np.nan
    for k, r in enumerate(rows.orderBy("pos").select(c).toLocalIterator()):
        out[k] = fill if r[0] is None else r[0]
    f = io.BytesIO()
    np.save(f, out, allow_pickle=False)
    return f.getvalue()


def write_npy(m: Matrix, path: str, replace: bool = False) -> None:
    """Dense rows in order as one .npy file; a batch of rows is held at a time."""
    spark = m.data.sparkSession
    dtype = np.dtype(m.dtype)
    header = io.BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": dtype.str, "fortran_order": False, "shape": m.shape})
    with files.staged(spark, path, replace) as new:
        where = spark._jvm.org.apache.hadoop.fs.Path(new)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(header.getvalue()))
            held = []
            for r in m.data.orderBy("i").select("values").toLocalIterator(prefetchPartitions=True):
                held.append(r[0])
                if len(held) * max(1, len(r[0])) >= 1_000_000:
                    out.write(bytearray(np.array(held, dtype).tobytes()))
                    held = []
            if held:
                out.write(bytearray(np.array(held, dtype).tobytes()))
        finally:
            out.close()


def finite(value: Any) -> Any:
    """A JSON-able value with what is not finite as null; bytes as text, arrays as lists."""
    if isinstance(value, dict):
        return {str(k): finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [finite(v) for v in value]
    if isinstance(value, np.ndarray):
        return finite(value.tolist())
    if isinstance(value, np.generic):
        return finite(value.item())
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _values(value: Any) -> int:
    if isinstance(value, dict):
        return sum(map(_values, value.values()))
    return sum(map(_values, value)) if isinstance(value, list | tuple) else 1


def export_json(store: Store, path: str) -> str:
    """Metadata under ``uns`` (or a part of it, by path) as JSON; more than JSON_MOST values are refused."""
    value: Any = store.uns
    for step in path.split("/")[1:]:
        if not isinstance(value, dict) or step not in value:
            raise KeyError(f"there is no {path!r}")
        value = value[step]
    if _values(value) > JSON_MOST:
        raise ValueError(f"{path} holds more than {JSON_MOST} values")
    return json.dumps(finite(value), ensure_ascii=False, allow_nan=False)


def frame_json(rows: DataFrame) -> DataFrame:
    """Rows of a frame as JSON text, what is not finite as null."""
    columns = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in rows.dtypes]
    return rows.select("pos", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def import_json(text: str) -> Any:
    """JSON text as metadata: null members are left out, rectangular lists of one kind stay lists, others become their text."""

    def plan(value: Any) -> Any:
        if isinstance(value, dict):
            return {k.replace("/", "_"): p for k, v in value.items() if (p := plan(v)) is not None}
        return (value if rectangular(value) else json.dumps(value)) if isinstance(value, list) else value

    return plan(json.loads(text))


def shape_of(value: Any) -> tuple[int, ...] | None:
    """The shape of nested lists, None if they are ragged."""
    if not isinstance(value, list):
        return ()
    inner = {shape_of(v) for v in value}
    if len(inner) > 1 or None in inner:
        return None
    return (len(value), *(inner.pop() if inner else ()))


def rectangular(value: list) -> bool:
    """Whether nested lists have one shape and leaves of one kind."""

    def leaves(v):
        if isinstance(v, list):
            for x in v:
                yield from leaves(x)
        else:
            yield "number" if isinstance(v, int | float) and not isinstance(v, bool) else type(v).__name__

    return shape_of(value) is not None and len(set(leaves(value))) <= 1 and "dict" not in set(leaves(value))


def pixels(x: np.ndarray, scale: bool = False, deep: bool = True) -> np.ndarray:
    """An array as pixels, its values unchanged: booleans as 0 and 255, floats up to 1 times 255 and those up to 255 cut to
    whole numbers, whole numbers as 8 bits, or as 16 in one channel where the format keeps them (``deep``). ``scale``
    stretches any finite range to 0..255, what is not finite becoming 0."""
    if x.ndim not in (2, 3) or x.ndim == 3 and x.shape[2] not in (1, 2, 3, 4) or not x.size or x.dtype.kind not in "biuf":
        raise ValueError(f"an array of shape {x.shape} and type {x.dtype} is no image")
    if x.dtype == bool:
        return x.astype(np.uint8) * 255
    good = np.isfinite(x) if x.dtype.kind == "f" else np.ones(x.shape, bool)
    low, high = (x[good].min(), x[good].max()) if good.any() else (0, 0)
    if scale:
        span = float(high) - float(low)
        return np.rint(np.where(good, (np.where(good, x, 0).astype(np.float64) - float(low)) / span * 255, 0) if span > 0 else np.zeros(x.shape)).astype(np.uint8)
    top = 65_535 if deep and x.ndim == 2 and x.dtype.kind != "f" else 255
    if not good.all() or low < 0 or high > top:
        raise ValueError(f"an image of this form holds whole numbers from 0 to {top} or floats from 0 to 1; scale others")
    if x.dtype.kind == "f":
        return (x * 255.0 if high <= 1 else x).astype(np.uint8)
    return x.astype(np.uint16 if high > 255 or x.dtype == np.uint16 and top > 255 else np.uint8)


def png(x: np.ndarray) -> bytes:
    """Pixels as a PNG file."""
    y = x if x.ndim == 3 else x[:, :, None]
    depth, kind = y.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[y.shape[2]]
    raw = y.astype(f">u{y.dtype.itemsize}").tobytes()
    stride = len(raw) // y.shape[0]
    rows = b"".join(b"\0" + raw[k * stride : (k + 1) * stride] for k in range(y.shape[0]))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", y.shape[1], y.shape[0], depth, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(x: np.ndarray) -> bytes:
    """Pixels as a TIFF file of one uncompressed strip."""
    y = x if x.ndim == 3 else x[:, :, None]
    raw, bits, n = y.astype(y.dtype.newbyteorder("<")).tobytes(), y.dtype.itemsize * 8, y.shape[2]
    where = 8 + len(raw) + len(raw) % 2
    # Tags of a baseline file.
    tags = [(256, 4, 1, y.shape[1]), (257, 4, 1, y.shape[0]), (258, 3, n, bits), (259, 3, 1, 1), (262, 3, 1, 2 if n >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, n), (278, 4, 1, y.shape[0]), (279, 4, 1, len(raw)), (284, 3, 1, 1)]
    if n in (2, 4):
        tags.append((338, 3, 1, 2))
    end = where + 2 + 12 * len(tags) + 4
    body, more = struct.pack("<H", len(tags)), b""
    for tag, kind, count, value in tags:
        if tag == 258 and n > 2:
            body += struct.pack("<HHII", tag, kind, count, end + len(more))
            more += struct.pack(f"<{n}H", *[bits] * n)
        elif kind == 3:
            body += struct.pack("<HHIHH", tag, kind, count, value, value if count == 2 else 0)
        else:
            body += struct.pack("<HHII", tag, kind, count, value)
    return b"II*\0" + struct.pack("<I", where) + raw + b"\0" * (len(raw) % 2) + body + bytes(4) + more


def read_tiff(data: bytes) -> np.ndarray:
    """A TIFF file of strips that are not packed, or packed by deflate, 8 or 16 bits, as (height, width[, channels])."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or data[2:4] not in (b"*\0", b"\0*"):
        raise ValueError("this is no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = {3: 2, 4: 4}.get(kind)
        if size is None:
            continue
        where = at + 10 + 12 * k if n * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, where)
    packed = tags.get(259, (1,))[0]
    if packed not in (1, 8, 32946) or set(tags.get(258, (8,))) - {8, 16} or tags.get(284, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("TIFF files with tiles, planes or other codecs are not read")
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(zlib.decompress(x) if packed != 1 else x for x in strips)
    n, bits = tags.get(277, (1,))[0], tags.get(258, (8,))[0]
    x = np.frombuffer(raw, f"{order}u{bits // 8}").astype(f"u{bits // 8}").reshape(tags[257][0], tags[256][0], n)
    return x[:, :, 0] if n == 1 else x


def image_bytes(x: np.ndarray, path: str, scale: bool = False) -> bytes:
    """An array as the image file that a path's ending asks for."""
    ending = path.lower().rpartition(".")[2]
    if ending == "png":
        return png(pixels(x, scale))
    if ending in ("tif", "tiff"):
        return tiff(pixels(x, scale))
    raise ValueError(f"images are written as png or tiff, not {ending}")


def read_image(data: bytes) -> np.ndarray:
    return read_png(data) if data[:4] == b"\x89PNG" else read_tiff(data)


def read_png(data: bytes) -> np.ndarray:
    """A PNG file that is not interlaced, 8 or 16 bits, as (height, width[, channels])."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("this is no PNG file")
    at, body, palette = 8, b"", None
    while at < len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if tag == b"IHDR":
            width, height, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif tag == b"IDAT":
            body += part
        elif tag == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
    if laced or depth not in (8, 16):
        raise ValueError("interlaced images and those of other depths are not read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    stride = width * step
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for r in range(height):
        how, line = raw[r, 0], raw[r, 1:].astype(np.int32)
        if how == 2:
            line = (line + above) & 255
        elif how in (1, 3, 4):
            for k in range(stride):
                left = int(line[k - step]) if k >= step else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + int(above[k])) // 2
                else:
                    corner = int(above[k - step]) if k >= step else 0
                    p = left + int(above[k]) - corner
                    near = sorted((abs(p - v), o, v) for o, v in enumerate((left, int(above[k]), corner)))
                    guess = near[0][2]
                line[k] = (line[k] + guess) & 255
        out[r], above = line, line
    x = out if depth == 8 else out.view(">u2").astype(np.uint16)
    x = x.reshape(height, width, channels)
    if kind == 3:
        x = palette[x[:, :, 0]]
    return x[:, :, 0] if x.shape[2] == 1 else x
