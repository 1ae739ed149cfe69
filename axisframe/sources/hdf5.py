"""HDF5 files in plain Python: the tree of a file, chunks that any process reads by itself, and a writer.

Read are superblocks of all versions, object headers of both, groups kept as symbol tables or as links, contiguous,
compact and chunked arrays, and the filters deflate, shuffle, checksum, LZF, Blosc and Zstandard. What needs a structure
that is not read (densely stored links or attributes, extensible chunk indexes, data in other files) is refused by name.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs, files, trees
from .store import SPARK_TYPES, Frame, Matrix, Store
from .trees import Array

# The mark of a file, message numbers, filter numbers, the address of nothing.
MAGIC = b"\x89HDF\r\n\x1a\n"
SPACE, LINKS, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, TABLE, ATTRIBUTES = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, CHECKSUM, LZF, BLOSC, ZSTD = 1, 2, 3, 32000, 32001, 32015
NOWHERE = (1 << 64) - 1


@dataclass(frozen=True)
class Type:
    """A datatype: how its raw values read with numpy, and what they are: number, bool, text, vtext (text elsewhere in the
    file), ref, list (values elsewhere), record, or other."""

    raw: str | list
    what: str
    inner: Any = None
    size: int = 0

    def dtype(self) -> np.dtype:
        return np.dtype(self.raw) if isinstance(self.raw, str) else np.dtype({"names": [n for n, _, _ in self.raw], "formats": [t.dtype() for _, t, _ in self.raw], "offsets": [o for _, _, o in self.raw], "itemsize": self.size})


def _name(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def read_type(data: bytes, at: int = 0) -> tuple[Type, int]:
    """A datatype message, and where it ends."""
    head, bits, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little"), struct.unpack_from("<I", data, at + 4)[0]
    version, kind = head >> 4, head & 15
    p = at + 8
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return Type(f"{order}{'i' if bits & 8 else 'u'}{size}", "number"), p + 4
    if kind == 1:
        return Type(f"{order}f{size}", "number"), p + 12
    if kind == 3:
        return Type(f"S{size}", "text", bits & 15), p
    if kind == 4:
        return Type(f"{order}u{size}", "number"), p + 4
    if kind == 5:
        return Type(f"V{size}", "other"), p + bits % 256
    if kind == 7:
        return Type(f"<u{size}" if size == 8 else f"V{size}", "ref"), p
    if kind == 6:
        members = []
        for _ in range(bits & 0xFFFF):
            name, q = _name(data, p)
            if version < 3:
                q = p + -(-(q - p) // 8) * 8
                offset = struct.unpack_from("<I", data, q)[0]
                q += 4
            else:
                width = max(1, (size.bit_length() + 7) // 8)
                offset = int.from_bytes(data[q : q + width], "little")
                q += width
            dims: tuple = ()
            if version == 1:
                rank = data[q]
                dims = struct.unpack_from("<4I", data, q + 12)[:rank]
                q += 28
            inner, p = read_type(data, q)
            members.append((name, Type(f"V{inner.dtype().itemsize * math.prod(dims)}", "other") if dims else inner, offset))
        return Type(members, "record", None, size), p
    if kind == 8:
        base, p = read_type(data, p)
        n, names = bits & 0xFFFF, []
        for _ in range(n):
            name, q = _name(data, p)
            p = q if version >= 3 else p + -(-(q - p) // 8) * 8
            names.append(name)
        values = np.frombuffer(data, base.dtype(), n, p)
        truth = sorted(names) == ["FALSE", "TRUE"] and base.dtype().itemsize == 1
        return Type("?" if truth else base.raw, "bool" if truth else "number", dict(zip(names, values.tolist(), strict=True))), p + n * base.dtype().itemsize
    if kind == 9:
        inner, p = read_type(data, p)
        return Type(f"V{size}", "vtext" if bits & 15 == 1 else "list", inner), p
    if kind == 10:
        rank = data[p]
        p += 1 if version >= 3 else 4
        dims = struct.unpack_from(f"<{rank}I", data, p)
        p += 4 * rank * (1 if version >= 3 else 2)
        inner, p = read_type(data, p)
        return Type(f"V{size}", "other", (inner, dims)), p
    raise ValueError(f"values of class {kind} are not read")


def read_space(data: bytes) -> tuple[int, ...] | None:
    """The shape that a dataspace message gives; None for nothing at all."""
    version, rank = data[0], data[1]
    if version == 2 and data[3] == 2:
        return None
    return struct.unpack_from(f"<{rank}Q", data, 8 if version == 1 else 4)


@dataclass
class Node:
    """An object's messages, read: what it is made of, and what it links to."""

    address: int
    shape: tuple[int, ...] | None = None
    type: Type | None = None
    layout: tuple | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    fill: bytes = b""
    attributes: dict[str, tuple[Type, tuple[int, ...] | None, bytes]] = field(default_factory=dict)
    links: dict[str, int | str] = field(default_factory=dict)
    array: bool = False


class File:
    """A file whose structure is read on demand."""

    def __init__(self, path: str):
        self.path = path
        self.f = files.open_input(path)
        self.base = 0
        self.heaps: dict[int, dict[int, bytes]] = {}
        head = self.at(0, 96)
        while head[:8] != MAGIC:
            self.base = self.base * 2 or 512
            head = self.at(0, 96)
            if len(head) < 48:
                raise ValueError(f"{path} is no HDF5 file")
        if head[8] < 2:
            if head[13] != 8 or head[14] != 8:
                raise ValueError(f"{path}: addresses of {head[13]} bytes are not read")
            at = 24 + (4 if head[8] == 1 else 0)
            self.root = struct.unpack_from("<Q", head, at + 40)[0]
        else:
            self.root = struct.unpack_from("<Q", head, 36)[0]
        self.node = cache(self._node)

    def at(self, offset: int, n: int) -> bytes:
        self.f.seek(self.base + offset)
        return self.f.read(n)

    def _messages(self, address: int) -> Iterator[tuple[int, int, bytes]]:
        head = self.at(address, 64)
        if head[:4] == b"OHDR":
            flags = head[5]
            p = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(head[p : p + width], "little")
            blocks, step = [self.at(address + p + width, size)], 6 if flags & 4 else 4
            while blocks:
                block = blocks.pop(0)
                at = 0
                while at + step <= len(block):
                    kind, n, mark = block[at], struct.unpack_from("<H", block, at + 1)[0], block[at + 3]
                    body = block[at + step : at + step + n]
                    at += step + n
                    if kind == MORE:
                        where, length = struct.unpack_from("<QQ", body)
                        blocks.append(self.at(where + 4, length - 8))
                    elif kind:
                        yield kind, mark, body
            return
        if head[0] != 1:
            raise ValueError(f"{self.path}: no object lies at {address}")
        count, size = struct.unpack_from("<H", head, 2)[0], struct.unpack_from("<I", head, 8)[0]
        blocks = [self.at(address + 16, size)]
        while blocks and count:
            block = blocks.pop(0)
            at = 0
            while at + 8 <= len(block) and count:
                kind, n, mark = struct.unpack_from("<HHB", block, at)
                body = block[at + 8 : at + 8 + n]
                at += 8 + n
                count -= 1
                if kind == MORE:
                    where, length = struct.unpack_from("<QQ", body)
                    blocks.append(self.at(where, length))
                elif kind:
                    yield kind, mark, body

    def _shared(self, body: bytes) -> bytes:
        """The datatype of another object that a message refers to."""
        address = struct.unpack_from("<Q", body, 8 if body[0] == 1 else 2)[0]
        return next(b for k, _, b in self._messages(address) if k == TYPE)

    def _node(self, address: int) -> Node:
        node = Node(address)
        for kind, mark, body in self._messages(address):
            if kind == SPACE:
                node.shape = read_space(body)
                node.array = True
            elif kind == TYPE:
                node.type = read_type(self._shared(body) if mark & 2 else body)[0]
            elif kind == LAYOUT:
                node.layout = self._layout(body)
            elif kind == FILTERS:
                node.filters = _filters(body)
            elif kind == FILL and len(body) >= 4:
                version = body[0]
                known = body[3] if version < 3 else body[1] & 32
                p = 4 if version < 3 else 2
                if known and len(body) >= p + 4:
                    n = struct.unpack_from("<i", body, p)[0]
                    node.fill = body[p + 4 : p + 4 + n] if n > 0 else b""
            elif kind == ATTRIBUTE:
                name, value = self._attribute(body)
                node.attributes[name] = value
            elif kind == ATTRIBUTES:
                p = 2 + (2 if body[1] & 1 else 0)
                if struct.unpack_from("<Q", body, p)[0] != NOWHERE:
                    raise ValueError(f"{self.path}: densely stored attributes are not read")
            elif kind == TABLE:
                node.links.update(self._table(*struct.unpack_from("<QQ", body)))
            elif kind == LINKS:
                p = 2 + (8 if body[1] & 1 else 0)
                if struct.unpack_from("<Q", body, p)[0] != NOWHERE:
                    raise ValueError(f"{self.path}: densely stored links are not read")
            elif kind == LINK:
                name, to = self._link(body)
                node.links[name] = to
        return node

    def _link(self, body: bytes) -> tuple[str, int | str]:
        flags, p, kind = body[1], 2, 0
        if flags & 8:
            kind, p = body[p], p + 1
        p += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n = int.from_bytes(body[p : p + width], "little")
        name = body[p + width : p + width + n].decode("utf-8")
        p += width + n
        if kind == 0:
            return name, struct.unpack_from("<Q", body, p)[0]
        if kind == 1:
            n = struct.unpack_from("<H", body, p)[0]
            return name, body[p + 2 : p + 2 + n].decode("utf-8")
        raise ValueError(f"{self.path}: {name!r} lies in another file")

    def _table(self, tree: int, heap: int) -> Iterator[tuple[str, int | str]]:
        head = self.at(heap, 32)
        size, _, where = struct.unpack_from("<QQQ", head, 8)
        texts = self.at(where, size)
        todo = [tree]
        while todo:
            address = todo.pop(0)
            head = self.at(address, 24)
            if head[:4] == b"TREE":
                n = struct.unpack_from("<H", head, 6)[0]
                keys = self.at(address + 24, 16 * n + 8)
                todo = [struct.unpack_from("<Q", keys, 16 * k + 8)[0] for k in range(n)] + todo
            elif head[:4] == b"SNOD":
                n = struct.unpack_from("<H", head, 6)[0]
                rows = self.at(address + 8, 40 * n)
                for k in range(n):
                    offset, to, kind = struct.unpack_from("<QQI", rows, 40 * k)
                    name = _name(texts, offset)[0]
                    yield name, _name(texts, struct.unpack_from("<I", rows, 40 * k + 24)[0])[0] if kind == 2 else to
            else:
                raise ValueError(f"{self.path}: a group's table is broken")

    def _layout(self, body: bytes) -> tuple:
        version, kind = body[0], body[1]
        if version not in (3, 4):
            raise ValueError(f"{self.path}: a layout of version {version} is not read")
        if kind == 0:
            n = struct.unpack_from("<H", body, 2)[0]
            return "compact", body[4 : 4 + n]
        if kind == 1:
            return "contiguous", *struct.unpack_from("<QQ", body, 2)
        if kind == 3:
            raise ValueError(f"{self.path}: virtual arrays are not read")
        if version == 3:
            rank = body[2]
            address = struct.unpack_from("<Q", body, 3)[0]
            return "tree", address, struct.unpack_from(f"<{rank}I", body, 11)[:-1]
        flags, rank, width = body[2], body[3], body[4]
        dims = tuple(int.from_bytes(body[5 + width * k : 5 + width * (k + 1)], "little") for k in range(rank))[:-1]
        p = 5 + width * rank
        index = body[p]
        p += 1
        if index == 1:
            size = None
            if flags & 2:
                size = struct.unpack_from("<QI", body, p)
                p += 12
            return "single", struct.unpack_from("<Q", body, p)[0], dims, size
        if index == 2:
            return "implicit", struct.unpack_from("<Q", body, p)[0], dims
        if index == 3:
            return "fixed", struct.unpack_from("<Q", body, p + 1)[0], dims
        raise ValueError(f"{self.path}: an extensible chunk index is not read")

    def _attribute(self, body: bytes) -> tuple[str, tuple[Type, tuple[int, ...] | None, bytes]]:
        version, flags = body[0], body[1]
        sizes = struct.unpack_from("<3H", body, 2)
        p = 9 if version == 3 else 8
        pad = (lambda n: -(-n // 8) * 8) if version == 1 else (lambda n: n)
        name = body[p : p + sizes[0]].split(b"\0")[0].decode("utf-8")
        p += pad(sizes[0])
        kind = body[p : p + sizes[1]]
        kind = read_type(self._shared(kind) if version > 1 and flags & 1 else kind)[0]
        p += pad(sizes[1])
        shape = read_space(body[p : p + sizes[2]])
        return name, (kind, shape, body[p + pad(sizes[2]) :])

    def heap(self, address: int) -> dict[int, bytes]:
        """Objects of a global heap collection by their number."""
        if address not in self.heaps:
            if len(self.heaps) > 64:
                self.heaps.clear()
            size = struct.unpack_from("<Q", self.at(address, 16), 8)[0]
            block, at, found = self.at(address, size), 16, {}
            while at + 16 <= size:
                number, n = struct.unpack_from("<H", block, at)[0], struct.unpack_from("<Q", block, at + 8)[0]
                if not number:
                    break
                found[number] = block[at + 16 : at + 16 + n]
                at += 16 + -(-n // 8) * 8
            self.heaps[address] = found
        return self.heaps[address]

    def elsewhere(self, raw: bytes) -> bytes:
        n, address, number = struct.unpack("<IQI", raw)
        return self.heap(address)[number] if address and n else b""

    def decode(self, kind: Type, raw: bytes, count: int) -> np.ndarray:
        """``count`` values of a type from their bytes; texts and lists as objects."""
        if kind.what == "vtext":
            out = np.empty(count, object)
            for k in range(count):
                out[k] = self.elsewhere(raw[16 * k : 16 * k + 16]).split(b"\0")[0].decode("utf-8", "replace")
            return out
        if kind.what == "list":
            out = np.empty(count, object)
            for k in range(count):
                part = self.elsewhere(raw[16 * k : 16 * k + 16])
                out[k] = self.decode(kind.inner, part, len(part) // kind.inner.dtype().itemsize)
            return out
        x = np.frombuffer(raw, kind.dtype(), count)
        if kind.what == "text":
            out = np.empty(count, object)
            strip = b" " if kind.inner == 2 else b"\0"
            out[:] = [v.split(b"\0")[0].rstrip(strip).decode("utf-8", "replace") for v in x.tolist()]
            return out
        if kind.what == "record":
            names = [n for n, _, _ in kind.raw]
            out = np.empty(count, object)
            columns = [self.decode(t, np.ascontiguousarray(x[n]).tobytes(), count).tolist() for n, t, _ in kind.raw]
            out[:] = [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if columns else [{}] * count
            return out
        if kind.what == "other" and kind.inner:
            inner, dims = kind.inner
            each = math.prod(dims)
            flat = self.decode(inner, raw, count * each)
            return flat.reshape(count, *dims)
        return x

    def value(self, kind: Type, shape: tuple[int, ...] | None, raw: bytes) -> Any:
        """An attribute's value."""
        if shape is None:
            return None
        x = self.decode(kind, raw[: kind.dtype().itemsize * math.prod(shape)], math.prod(shape))
        return x[0] if not shape else x.reshape(*shape, *x.shape[1:])

    def find(self, path: str) -> Node | None:
        node = self.node(self.root)
        for step in filter(None, path.split("/")):
            to = node.links.get(step)
            if isinstance(to, str):
                to = (self.find(to) or Node(NOWHERE)).address
            if to is None or to == NOWHERE:
                return None
            node = self.node(to)
        return node

    def chunk_index(self, node: Node) -> dict[tuple[int, ...], tuple[int, int, int]]:
        """Address, size and filter mask of each chunk that is there, by its first position."""
        kind, address, dims, *more = node.layout
        found: dict[tuple[int, ...], tuple[int, int, int]] = {}
        if address == NOWHERE:
            return found
        item = node.type.dtype().itemsize
        whole, grid = item * math.prod(dims), [math.ceil(s / c) for s, c in zip(node.shape, dims, strict=True)]
        place = lambda k: tuple(int(p) * c for p, c in zip(np.unravel_index(k, grid), dims, strict=True))
        if kind == "single":
            size, mask = more[0] or (whole, 0)
            return {(0,) * len(dims): (address, size, mask)}
        if kind == "implicit":
            return {place(k): (address + k * whole, whole, 0) for k in range(math.prod(grid))}
        if kind == "fixed":
            return {place(k): v for k, v in self._fixed(address, whole) if v[0] != NOWHERE}
        rank = len(dims) + 1
        step = 8 + 8 * rank
        todo = [address]
        while todo:
            at = todo.pop()
            head = self.at(at, 24)
            if head[:4] != b"TREE":
                raise ValueError(f"{self.path}: a chunk index is broken")
            level, n = head[5], struct.unpack_from("<H", head, 6)[0]
            rows = self.at(at + 24, n * (step + 8))
            for k in range(n):
                p = k * (step + 8)
                size, mask = struct.unpack_from("<II", rows, p)
                to = struct.unpack_from("<Q", rows, p + step)[0]
                if level:
                    todo.append(to)
                else:
                    found[struct.unpack_from(f"<{rank - 1}Q", rows, p + 8)] = (to, size, mask)
        return found

    def _fixed(self, address: int, whole: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        head = self.at(address, 28)
        client, width, bits = head[5], head[6], head[7]
        n, block = struct.unpack_from("<QQ", head, 8)
        page = 1 << bits
        at = block + 14
        pages = -(-n // page)
        if n > page:
            at += -(-pages // 8) + 4
        for k in range(n):
            if n > page and k and k % page == 0:
                at += 4
            row = self.at(at, width)
            at += width
            if client == 0:
                yield k, (struct.unpack_from("<Q", row)[0], whole, 0)
            else:
                yield k, (struct.unpack_from("<Q", row)[0], int.from_bytes(row[8 : width - 4], "little"), struct.unpack_from("<I", row, width - 4)[0])


def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    version, n = body[0], body[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(n):
        ident = struct.unpack_from("<H", body, at)[0]
        at += 2
        size = 0
        if version == 1 or ident >= 256:
            size = struct.unpack_from("<H", body, at)[0]
            at += 2
        count = struct.unpack_from("<H", body, at + 2)[0]
        at += 4 + (-(-size // 8) * 8 if version == 1 else size)
        out.append((ident, struct.unpack_from(f"<{count}I", body, at)))
        at += 4 * count + (4 if version == 1 and count % 2 else 0)
    return out


def unfiltered(data: bytes, filters: list[tuple[int, tuple[int, ...]]], mask: int, size: int) -> bytes:
    """A chunk's bytes before its filters."""
    for k in range(len(filters) - 1, -1, -1):
        ident, values = filters[k]
        if mask >> k & 1:
            continue
        if ident == DEFLATE:
            data = zlib.decompress(data)
        elif ident == SHUFFLE:
            data = codecs.unshuffled(data, values[0] if values else 1)
        elif ident == CHECKSUM:
            data = data[:-4]
        elif ident == LZF:
            data = codecs.lzf(data, values[2] if len(values) > 2 and values[2] else size)
        elif ident == BLOSC:
            data = codecs.blosc(data)
        elif ident == ZSTD:
            data = codecs.zstd(data)
        else:
            raise ValueError(f"chunks with filter {ident} are not read")
    return data


@dataclass(frozen=True)
class FileArray(Array):
    """An array of a file; the driver's copy knows its chunks, the tasks' copies only how to read them."""

    path: str
    type: Type
    filters: tuple
    fill: bytes
    offset: int = 0
    index: dict | None = field(default=None, compare=False, hash=False)

    def bare(self) -> FileArray:
        return FileArray(self.shape, self.chunks, self.dtype, self.text, self.path, self.type, self.filters, self.fill, self.offset)

    def tokens(self, first: int, last: int) -> list:
        item = self.type.dtype().itemsize
        if self.index is None:
            # Contiguous: chunks are runs of whole rows, the last one may be shorter.
            each = item * math.prod(self.chunks)
            every = item * math.prod(self.shape)
            return [(self.offset + k * each, max(0, min(each, every - k * each)), 0) for k in range(first, last)] if self.offset >= 0 else [None] * (last - first)
        return [self.index.get(tuple(int(p) * c for p, c in zip(np.unravel_index(k, self.grid), self.chunks, strict=True))) for k in range(first, last)]

    def loader(self) -> Callable[[Any], np.ndarray]:
        f = File(self.path)
        count, item = math.prod(self.chunks), self.type.dtype().itemsize

        def load(token) -> np.ndarray:
            if token is None:
                raw = (self.fill or bytes(item)) * count
            else:
                where, size, mask = token
                raw = f.at(where, size) if not isinstance(where, bytes) else where
                if self.filters:
                    raw = unfiltered(raw, list(self.filters), mask, count * item)
                raw = raw + bytes(max(0, count * item - len(raw)))
            return f.decode(self.type, raw, count).reshape(self.chunks)

        return load


class FileTree(trees.Tree):
    """An HDF5 file as a tree; members of groups in the order of their names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.file = spark, path, File(path)

    def exists(self, path: str) -> bool:
        return self.file.find(path) is not None

    def _need(self, path: str) -> Node:
        node = self.file.find(path)
        if node is None:
            raise FileNotFoundError(f"{self.path} has no {path!r}")
        return node

    def names(self, path: str) -> list[str]:
        return sorted(self._need(path).links)

    @cache  # noqa: B019
    def _paths(self) -> dict[int, str]:
        """Paths of all objects by address, for references."""
        found, todo = {}, [("", self.file.node(self.file.root))]
        while todo:
            path, node = todo.pop()
            for name, to in node.links.items():
                if isinstance(to, int) and to not in found:
                    found[to] = f"{path}/{name}".strip("/")
                    todo.append((found[to], self.file.node(to)))
        return found

    def attributes(self, path: str) -> dict:
        out = {}
        for name, (kind, shape, raw) in self._need(path).attributes.items():
            value = self.file.value(kind, shape, raw)
            if kind.what == "ref":
                value = self._paths().get(int(value)) if not shape else [self._paths().get(int(v)) for v in np.ravel(value)]
            out[name] = value
        return out

    def array(self, path: str) -> FileArray | None:
        node = self._need(path)
        if not node.array:
            return None
        kind = node.type
        shape = node.shape if node.shape is not None else (0,)
        text = kind.what in ("text", "vtext")
        dtype = "object" if text or kind.what in ("list", "record") else kind.dtype().str
        layout = node.layout
        how = (self.path, kind, tuple(node.filters), node.fill)
        if layout[0] == "compact":
            single = tuple(max(1, s) for s in shape)
            return FileArray(shape, single, dtype, text, *how, index={(0,) * len(shape): (layout[1], len(layout[1]), 0)})
        if layout[0] == "contiguous":
            width = math.prod(shape[1:]) if shape else 1
            step = max(1, min(shape[0] if shape else 1, trees.CHUNK // max(1, width)))
            chunks = (step, *(max(1, s) for s in shape[1:])) if shape else ()
            return FileArray(shape, chunks, dtype, text, *how, offset=-1 if layout[1] == NOWHERE else layout[1])
        return FileArray(shape, tuple(layout[2]), dtype, text, *how, index=self.file.chunk_index(node))


def read(spark: SparkSession, path: str) -> Store:
    """An annotated matrix from a file; only its structure is read until the store is used."""
    return trees.read_store(FileTree(spark, path))


# Writing: superblock 0, object headers 1, groups as symbol tables, arrays contiguous or chunked with a B-tree.


def _pad(data: bytes, to: int = 8) -> bytes:
    return data + bytes(-len(data) % to)


def type_message(dtype: np.dtype | None) -> bytes:
    """The datatype message of numbers, booleans and fixed-length texts, or (None) of texts of any length."""
    if dtype is None:
        return struct.pack("<B3BI", 0x19, 1, 1, 0, 16) + struct.pack("<B3BIHH", 0x10, 0, 0, 0, 1, 0, 8)
    if dtype.names is not None:
        out = b""
        for n in dtype.names:
            kind, offset = dtype.fields[n][:2]
            out += _pad(n.encode() + b"\0") + struct.pack("<IB3xI4x4I", offset, 0, 0, 0, 0, 0, 0) + type_message(kind)
        return struct.pack("<BHBI", 0x16, len(dtype.names), 0, dtype.itemsize) + out
    if dtype.kind == "b":
        base = struct.pack("<B3BIHH", 0x10, 8, 0, 0, 1, 0, 8)
        return struct.pack("<BHBI", 0x18, 2, 0, 1) + base + _pad(b"FALSE\0") + _pad(b"TRUE\0") + b"\0\1"
    if dtype.kind == "S":
        return struct.pack("<B3BI", 0x13, 1, 0, 0, dtype.itemsize)
    size = dtype.itemsize
    if dtype.kind in "iu":
        return struct.pack("<B3BIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
    exponent, mantissa, bias = {2: (5, 10, 15), 4: (8, 23, 127), 8: (11, 52, 1023)}[size]
    return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, mantissa, exponent, 0, mantissa, bias)


def space_message(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def _type_of(x: np.ndarray) -> np.dtype | None:
    return None if x.dtype == object else x.dtype


def tile_shape(shape: tuple[int, int]) -> tuple[int, int]:
    """Sides of a tile of CHUNK cells at most, square unless a side of the array is shorter than that."""
    side = math.isqrt(trees.CHUNK)
    high = min(shape[0], max(side, trees.CHUNK // shape[1]))
    return high, min(shape[1], trees.CHUNK // high)


def _tiled(batches, cells: int, kind: str, dtype: str):
    """(tile, data) of entries (tile, at, v) that come sorted by tile: one tile is held, and sums are formed wide and narrowed once."""
    wide = object if kind.startswith("decimal") else bool if kind == "boolean" else np.float64 if kind in ("float", "double") else np.int64

    def packed(of: int, x: np.ndarray) -> pa.RecordBatch:
        x = x.astype(dtype)
        return pa.RecordBatch.from_pydict({"tile": pa.array([of], pa.int64()), "data": pa.array([zlib.compress(codecs.shuffled(x.tobytes(), x.dtype.itemsize), 1)], pa.binary())})

    of, x = None, np.zeros(0, wide)
    for batch in batches:
        tile, at, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        v = np.array([int(k) for k in v.to_pylist()], object) if wide is object else v.to_numpy(zero_copy_only=False).astype(wide)
        edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if of != tile[a]:
                if of is not None:
                    yield packed(of, x)
                of, x = int(tile[a]), np.zeros(cells, wide)
            (np.logical_or if wide is bool else np.add).at(x, at[a:b], v[a:b])
    if of is not None:
        yield packed(of, x)


@dataclass
class _Object:
    attributes: dict[str, Any]
    members: dict[str, str] | None = None
    dtype: np.dtype | None = None
    shape: tuple[int, ...] = ()
    chunks: tuple[int, ...] | None = None
    raw: bytes | None = None
    index: list[tuple[tuple[int, ...], int, int]] = field(default_factory=list)
    filtered: bool = True


class FileSink(trees.Sink):
    """Writes one file: chunks are packed by tasks and appended as they come, the structure follows at the end."""

    def __init__(self, spark: SparkSession, path: str, before: int = 0):
        self.spark, self.path, self.before = spark, path, before
        self.out = files.open_output(path)
        self.out.write(bytes(before + 96))
        self.end = 96
        self.objects: dict[str, _Object] = {"": _Object({}, {})}

    def _append(self, data: bytes) -> int:
        where = self.end
        data = _pad(data)
        self.out.write(data)
        self.end += len(data)
        return where

    def _join(self, path: str, made: _Object) -> _Object:
        head, _, name = path.rpartition("/")
        if head not in self.objects:
            self.group(head)
        self.objects[head].members[name] = path
        self.objects[path] = made
        return made

    def group(self, path: str, **attributes) -> None:
        if path in self.objects:
            self.objects[path].attributes.update(attributes)
        else:
            self._join(path, _Object(attributes, {}))

    def _texts(self, values: Sequence[str]) -> bytes:
        """Texts in heap collections; their places. An empty text lies nowhere."""
        out = bytearray(16 * len(values))
        block: list[tuple[int, bytes]] = []
        held = 0

        def flush():
            size = max(4096, 32 + sum(16 + len(_pad(b)) for _, b in block))
            body = bytearray(b"GCOL" + struct.pack("<B3xQ", 1, size))
            for n, (_, b) in enumerate(block, 1):
                body += struct.pack("<HH4xQ", n, 1, len(b)) + _pad(b)
            body += struct.pack("<HH4xQ", 0, 0, size - len(body))
            where = self._append(bytes(body) + bytes(size - len(body)))
            for n, (k, b) in enumerate(block, 1):
                struct.pack_into("<IQI", out, 16 * k, len(b), where, n)
            block.clear()

        for k, v in enumerate(values):
            b = str(v).encode()
            if b:
                block.append((k, b))
                held += len(b)
            if block and (held > 1 << 20 or len(block) >= 60_000 or k + 1 == len(values)):
                flush()
                held = 0
        if block:
            flush()
        return bytes(out)

    def small(self, path: str, values: np.ndarray, **attributes) -> None:
        made = self._join(path, _Object(attributes, None, _type_of(values), values.shape))
        made.raw = self._texts(values.ravel().tolist()) if values.dtype == object else np.ascontiguousarray(values).tobytes()

    def large(self, paths: Sequence[str], rows: DataFrame, columns: Sequence[str], shapes: Sequence[tuple[int, ...]], dtypes: Sequence[str | None], attributes: Sequence[dict]) -> None:
        step = trees.chunk_rows(max(shapes, key=lambda s: math.prod(s[1:])))
        made = [self._join(p, _Object(x, None, None if d is None else np.dtype(d), s, (step, *s[1:]))) for p, s, d, x in zip(paths, shapes, dtypes, attributes, strict=True)]
        dtypes = list(dtypes)

        def encode(k: int, chunk: int, values) -> bytes:
            if dtypes[k] is None:
                return b"".join(struct.pack("<I", len(b)) + b for b in (x.encode() for x in values))
            if len(values) < step:
                values = np.concatenate([values, np.zeros((step - len(values), *values.shape[1:]), values.dtype)])
            return zlib.compress(codecs.shuffled(np.ascontiguousarray(values).tobytes(), values.dtype.itemsize), 1)

        if not math.prod(shapes[0]):
            for m in made:
                m.chunks, m.raw = None, b""
            return
        for r in trees.encoded(rows, columns, shapes, dtypes, encode).toLocalIterator(prefetchPartitions=True):
            m, data = made[r["column"]], bytes(r["data"])
            if dtypes[r["column"]] is None:
                found, at = [], 0
                while at < len(data):
                    n = struct.unpack_from("<I", data, at)[0]
                    found.append(data[at + 4 : at + 4 + n].decode())
                    at += 4 + n
                places = self._texts(found)
                data = zlib.compress(places + bytes(16 * (step - len(found))), 1)
            m.index.append(((r["chunk"] * step, *[0] * (len(m.shape) - 1)), self._append(data), len(data)))

    def tiles(self, path: str, entries: DataFrame, shape: tuple[int, int], dtype: str, **attributes) -> None:
        """A dense array of two dimensions from its entries (i, j, v), those of one cell added up. It is cut into tiles on both sides;
        tasks fill them from entries alone, and a tile without any is not stored: it reads as zeros."""
        made = self._join(path, _Object(attributes, None, np.dtype(dtype), shape))
        if not math.prod(shape):
            made.raw = b""
            return
        made.chunks = tile_shape(shape)
        high, wide = made.chunks
        across, kind = -(-shape[1] // wide), SPARK_TYPES[dtype]
        files.ship(self.spark)
        i, j = F.col("i").cast("long"), F.col("j").cast("long")
        tile = F.floor(i / high) * across + F.floor(j / wide)
        dealt = entries.select(tile.alias("tile"), ((i % high) * wide + j % wide).cast("int").alias("at"), F.col("v").cast(kind).alias("v")).repartition("tile").sortWithinPartitions("tile")
        for r in dealt.mapInArrow(lambda it: _tiled(it, high * wide, kind, dtype), "tile long, data binary").toLocalIterator(prefetchPartitions=True):
            a, b = divmod(r["tile"], across)
            data = bytes(r["data"])
            made.index.append(((a * high, b * wide), self._append(data), len(data)))

    def _message(self, kind: int, body: bytes) -> bytes:
        body = _pad(body)
        if len(body) > 0xFFFF:
            raise ValueError("an attribute of more than 64 kilobytes cannot be written")
        return struct.pack("<HHB3x", kind, len(body), 0) + body

    def _attribute_message(self, name: str, value: Any) -> bytes:
        x = np.array(value, object) if isinstance(value, str) else np.asarray(value)
        if x.dtype.kind == "U":
            x = x.astype(object)
        if x.dtype == object and not x.size:
            x = np.zeros(0, np.float64)
        raw = self._texts(x.ravel().tolist()) if x.dtype == object else x.tobytes()
        label, kind, space = name.encode() + b"\0", type_message(_type_of(x)), space_message(x.shape)
        return self._message(ATTRIBUTE, struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + _pad(label) + _pad(kind) + _pad(space) + raw)

    def _header(self, messages: list[bytes]) -> int:
        body = b"".join(messages)
        return self._append(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def _tree(self, keys: list[bytes], children: list[int], last: bytes, kind: int, most: int) -> int:
        """A B-tree over children that have been written, from the leaves up."""
        level = 0
        while True:
            groups = [(keys[a : a + most], children[a : a + most]) for a in range(0, max(1, len(children)), most)]
            ends = [g[0][0] for g in groups[1:]] + [last]
            size = 24 + most * (len(last) + 8) + len(last)
            where = [self.end + k * -(-size // 8) * 8 for k in range(len(groups))]
            for k, ((ks, cs), end) in enumerate(zip(groups, ends, strict=True)):
                left, right = where[k - 1] if k else NOWHERE, where[k + 1] if k + 1 < len(groups) else NOWHERE
                body = b"TREE" + struct.pack("<BBHQQ", kind, level, len(cs), left, right)
                body += b"".join(a + struct.pack("<Q", c) for a, c in zip(ks, cs, strict=True)) + end
                self._append(body + bytes(size - len(body)))
            if len(groups) == 1:
                return where[0]
            keys, children, level = [g[0][0] for g in groups], where, level + 1

    def _write_array(self, o: _Object) -> int:
        messages = [self._message(SPACE, space_message(o.shape)), self._message(TYPE, type_message(o.dtype)), self._message(FILL, struct.pack("<BBBBI", 2, 2 if o.chunks is None else 3, 2, 1, 0))]
        item = 16 if o.dtype is None else o.dtype.itemsize
        if o.chunks is None:
            where = self._append(o.raw) if o.raw else NOWHERE
            messages.append(self._message(LAYOUT, struct.pack("<BBQQ", 3, 1, where, len(o.raw or b""))))
        else:
            rank = len(o.shape) + 1
            key = lambda at, n: struct.pack("<II", n, 0) + struct.pack(f"<{rank}Q", *at, 0)
            rows = sorted(o.index)
            last = (-(-o.shape[0] // o.chunks[0]) * o.chunks[0], *[0] * (rank - 2))
            tree = self._tree([key(at, n) for at, _, n in rows], [w for _, w, _ in rows], key(last, 0), 1, 64) if rows else NOWHERE
            messages.append(self._message(LAYOUT, struct.pack("<BBBQ", 3, 2, rank, tree) + struct.pack(f"<{rank}I", *o.chunks, item)))
            deflate = struct.pack("<HHHHII", DEFLATE, 0, 1, 1, 1, 0)
            shuffle = struct.pack("<HHHHII", SHUFFLE, 0, 1, 1, item, 0) if o.dtype is not None else b""
            messages.append(self._message(FILTERS, struct.pack("<BB6x", 1, 2 if shuffle else 1) + shuffle + deflate))
        messages += [self._attribute_message(k, v) for k, v in o.attributes.items()]
        return self._header(messages)

    def _write_group(self, o: _Object, leaf: int) -> tuple[int, int, int]:
        where = {n: self._write(p, leaf) for n, p in o.members.items()}
        names = sorted(where, key=lambda n: n.encode())
        heap, offsets = bytearray(8), []
        for n in names:
            offsets.append(len(heap))
            heap += _pad(n.encode() + b"\0")
        free = len(heap)
        heap += struct.pack("<QQ", 1, 16)
        data = self._append(bytes(heap))
        head = self._append(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), free, data))
        nodes, first = [], []
        for a in range(0, max(1, len(names)), 2 * leaf):
            part = names[a : a + 2 * leaf]
            body = b"SNOD" + struct.pack("<BBH", 1, 0, len(part))
            for n, off in zip(part, offsets[a : a + 2 * leaf], strict=True):
                body += struct.pack("<QQII16x", off, where[n], 0, 0)
            nodes.append(self._append(body + bytes(8 + 2 * leaf * 40 - len(body))))
            first.append(struct.pack("<Q", offsets[a - 1] if a else 0))
        last = struct.pack("<Q", offsets[-1] if offsets else 0)
        tree = self._tree(first, nodes, last, 0, 32)
        messages = [self._message(TABLE, struct.pack("<QQ", tree, head)), *(self._attribute_message(k, v) for k, v in o.attributes.items())]
        return self._header(messages), tree, head

    def _write(self, path: str, leaf: int) -> int:
        o = self.objects[path]
        return self._write_group(o, leaf)[0] if o.members is not None else self._write_array(o)

    def close(self, first: bytes = b"") -> None:
        """Write the structure and, last, the start of the file, after ``first`` in the bytes kept before it."""
        leaf = 4
        root, tree, heap = self._write_group(self.objects[""], leaf)
        head = MAGIC + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, leaf, 16, 0)
        head += struct.pack("<QQQQ", self.before, NOWHERE, self.before + self.end, NOWHERE) + struct.pack("<QQII", 0, root, 1, 0) + struct.pack("<QQ", tree, heap)
        self.out.seek(0)
        self.out.write(first[: self.before].ljust(self.before, b"\0") + head)
        self.out.close()


def write(store: Store, path: str, replace: bool = False) -> None:
    """A store as one file. Tasks pack the chunks; one process puts them in the file, as there is but one file."""
    with files.staged(store.spark, path, replace) as new:
        sink = FileSink(store.spark, new)
        trees.write_store(sink, store)
        sink.close()


def arrays_of(tree: FileTree) -> dict[str, FileArray]:
    """All arrays of a file by path."""
    found, todo = {}, [""]
    while todo:
        path = todo.pop()
        for name in tree.names(path):
            at = f"{path}/{name}".strip("/")
            a = tree.array(at)
            if a is None:
                todo.append(at)
            else:
                found[at] = a
    return found


def read_dataset(spark: SparkSession, path: str, key: str | None = None, transpose: bool = False, dense: bool = False, obs_names_key: str | None = None, var_names_key: str | None = None, make_unique: bool = False) -> Store:
    """One array of numbers with two dimensions as a store; without a key the arrays that could be meant are named."""
    from .store import create

    tree = FileTree(spark, path)
    every = arrays_of(tree)
    numeric = {k: a for k, a in every.items() if len(a.shape) == 2 and a.type.what == "number"}
    if key is None or key not in numeric:
        lines = [f"{k} ({a.shape[0]} x {a.shape[1]}, {a.name})" for k, a in numeric.items()]
        raise ValueError(("a key is needed" if key is None else f"{key!r} is no array of numbers with two dimensions") + (": " + ", ".join(lines) if lines else ", and there is none"))
    a = numeric[key]
    shape = a.shape[::-1] if transpose else a.shape
    sides = {"obs": (obs_names_key, "col_names" if transpose else "row_names", shape[0]), "var": (var_names_key, "row_names" if transpose else "col_names", shape[1])}
    used, found = {"key": key}, {}
    for side, (asked, usual, n) in sides.items():
        at = asked or (usual if usual in every else None)
        if at is not None and (at not in every or every[at].shape != (n,)):
            if asked:
                raise ValueError(f"{at!r} does not name {n} of {side}")
            at = None
        if at is not None:
            used[f"{side}_names_key"] = at
            found[side] = Frame(trees.columns(spark, {"name": every[at]}).select("pos", F.col("name").cast("string").alias("name")))
    empty = create(spark, *shape)
    from ..functions import names as naming
    from ..operators import matrix
    from . import loom

    x = loom.nonzero(spark, a)
    x = x.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if transpose else x
    m = Matrix(x, shape, "float32" if a.name == "float16" else a.name)
    var = found.get("var", empty.var)
    return Store(found.get("obs", empty.obs), Frame(naming.unique_rows(var.data)) if make_unique else var, {"X": matrix.densified(m) if dense else m}, {}, {"hdf5": used})
