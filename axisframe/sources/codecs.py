"""Codecs of chunks: what single chunks of array stores are packed with."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

# Numbers of the inner codecs in a Blosc header.
BLOSC = ("blosclz", "lz4", "snappy", "zlib", "zstd")


def lz4_block(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _inner(data: bytes, size: int, codec: str) -> bytes:
    if codec == "lz4":
        return lz4_block(data, size)
    if codec == "zstd":
        return zstd(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "snappy":
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    return blosclz(data, size)


def blosclz(data: bytes, size: int) -> bytes:
    """A block of the codec that Blosc has of its own: literal runs, and matches by length and distance."""
    out, at = bytearray(), 0
    control = data[0] & 31
    at = 1
    while True:
        if control >= 32:
            length, distance = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while True:
                    more = data[at]
                    at += 1
                    length += more
                    if more != 255:
                        break
            low = data[at]
            at += 1
            back = distance + low + 1
            if low == 255 and distance == 31 << 8:
                back = (data[at] << 8) + data[at + 1] + 8192
                at += 2
            for _ in range(length + 3):
                out.append(out[-back])
        else:
            out += data[at : at + control + 1]
            at += control + 1
        if at >= len(data):
            break
        control = data[at]
        at += 1
    if len(out) != size:
        raise ValueError("a packed block does not have its size")
    return bytes(out)


def _unshuffled(block: bytes, width: int) -> bytes:
    n = len(block) // width
    x = np.frombuffer(block, np.uint8, n * width).reshape(width, n)
    return x.T.tobytes() + block[n * width :]


def _bits_unshuffled(block: bytes, width: int) -> bytes:
    n = len(block) // width // 8 * 8
    x = np.frombuffer(block, np.uint8, n * width).reshape(width * 8, n // 8)
    bits = np.unpackbits(x, axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").tobytes() + block[n * width :]


def blosc(data: bytes) -> bytes:
    """A Blosc buffer: a header, where each block begins, blocks that may be split by the bytes of a value."""
    _, _, flags, width, size, each, _ = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + size]
    codec = BLOSC[flags >> 5] if flags >> 5 < len(BLOSC) else "?"
    if codec == "?":
        raise ValueError("a chunk is packed with an unknown codec")
    count = -(-size // each) if each else 0
    out = []
    for k, at in enumerate(struct.unpack_from(f"<{count}i", data, 16)):
        here = min(each, size - k * each)
        splits = width if not flags & 16 and 1 < width <= 16 and here == each and each // width >= 128 else 1
        parts = []
        for _ in range(splits):
            (n,) = struct.unpack_from("<i", data, at)
            raw = data[at + 4 : at + 4 + n]
            parts.append(raw if n == here // splits else _inner(raw, here // splits, codec))
            at += 4 + n
        block = b"".join(parts)
        if flags & 1 and width > 1:
            block = _unshuffled(block, width)
        elif flags & 4:
            block = _bits_unshuffled(block, width)
        out.append(block)
    return b"".join(out)


def lzf(data: bytes, size: int) -> bytes:
    """An LZF block."""
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        at += 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((control & 31) << 8) + data[at] + 1
        at += 1
        begin = len(out) - back
        for k in range(length + 2):
            out.append(out[begin + k])
    if len(out) != size:
        raise ValueError("a packed block does not have its size")
    return bytes(out)


def shuffled(data: bytes, width: int) -> bytes:
    """Bytes of values regrouped by their place in a value."""
    n = len(data) // width
    return np.frombuffer(data, np.uint8, n * width).reshape(n, width).T.tobytes() + data[n * width :]


unshuffled = _unshuffled


def unpack(data: bytes, codec: str | None) -> bytes:
    """What a chunk of a folder store was packed from."""
    if codec is None:
        return data
    if codec == "zstd":
        return zstd(data)
    if codec == "blosc":
        return blosc(data)
    if codec == "lz4":
        return lz4_block(data[4:], int.from_bytes(data[:4], "little"))
    return gzip.decompress(data) if codec == "gzip" else zlib.decompress(data)
