"""SentencePiece BPE encoding that keeps the original byte span of every piece."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import tidy

SPACE = "▁"
#: Segments whose encoding a task remembers in each of two generations, and their longest length in characters.
REMEMBERED = 350_000
REMEMBERED_LENGTH = 48
#: The mark of a segment's first id in a task's memory; ids are smaller.
_FIRST = 1 << 30
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class CharMap:
    """The compiled character map of a normaliser: a double-array trie over UTF-8 and the replacements."""

    def __init__(self, blob: bytes):
        (n,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        if not self.units:
            return None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & ((1 << 31) | 255) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i - at + 1, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Model:
    """A BPE model file, read without the library."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores = []
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode("utf-8"))
                scores.append(struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(f.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are read")
        if _USER in self.kinds or _UNUSED in self.kinds or trainer.get(24, 0):
            raise ValueError("user-defined or unused pieces and word-end spaces are not handled")
        self.charmap = CharMap(normaliser.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        order = sorted((i for i, k in enumerate(self.kinds) if k == _NORMAL), key=lambda i: -scores[i])
        self.rank: dict[str, int] = {}
        last, n = None, -1
        for i in order:
            if scores[i] != last:
                last, n = scores[i], n + 1
            self.rank.setdefault(self.pieces[i], n)
        self.ident = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == _NORMAL}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.written = [str(i) for i in range(len(self.pieces))]
        self.raw = {i: b for b, i in self.byte.items()}
        self.bytewise = np.array([self.raw.get(i, 0) > 0x7F for i in range(len(self.kinds))])
        #: What each id reads as: nothing for controls, None for a byte that is part of a longer character.
        self.surface = [chr(self.raw[i]) if self.raw.get(i, 255) < 0x80 else None if k == _BYTE else "" if k == _CONTROL else " ⁇ " if k == _UNKNOWN else p.replace(SPACE, " ") for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        joined = {c for p in self.ident if len(p) > 1 for c in p}
        lone = "".join(c for c in "\n\r\t" if c not in joined)
        #: Runs of space signs with what follows; controls that no longer piece holds stand by themselves.
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + (f"|[{lone}]+" if lone else ""))
        #: No piece has a space sign after another sign, so none crosses from one segment to the next.
        self.by_segment = self.escape and not any(SPACE in p.lstrip(SPACE) for p in self.ident)

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The text as pieces are cut from it, and the original byte at which each of its characters begins, with the
        end of the text last. Without a character map and trimming the alignment follows from the text
        itself and is None.
        """
        if not self.charmap.units and not self.trim:
            out = text.replace(" ", SPACE) if self.escape else text
            return (SPACE if self.escape else " ") + out if self.dummy and text else out, None
        data = text.encode("utf-8")
        chars: list[tuple[str, int]] = []
        at = 0
        while at < len(data):
            hit = self.charmap.longest(data, at)
            if hit:
                n, new = hit
                new = new.decode("utf-8")
            else:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n].decode("utf-8")
            chars += [(c, at) for c in new]
            at += n
        if self.trim:
            kept: list[tuple[str, int]] = []
            for c in chars:
                if c[0] != " " or kept and kept[-1][0] != " ":
                    kept.append(c)
            while kept and kept[-1][0] == " ":
                kept.pop()
            chars = kept
        if self.dummy and chars:
            chars.insert(0, (" ", chars[0][1]))
        return "".join(SPACE if c == " " and self.escape else c for c, _ in chars), [a for _, a in chars] + [len(data)]

    def cut(self, segment: str) -> list[str]:
        """Pieces of a normalised segment: the best-ranked neighbouring pair is joined, leftmost first, until none is left."""
        parts = list(segment)
        if len(parts) > 40:
            return self._cut_long(parts)
        get = self.rank.get
        none = len(self.pieces)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def _cut_long(self, parts: list) -> list[str]:
        n, get = len(parts), self.rank.get
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k, parts[k + 1], parts[k]) for k in range(n - 1) if (r := get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, b, a = heapq.heappop(heap)
            j = right[k]
            if parts[k] != a or j < 0 or parts[j] != b:
                continue
            parts[k], parts[j] = a + b, None
            right[k] = right[j]
            if right[k] >= 0:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (r := get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[y], parts[x]))
        return [p for p in parts if p is not None]

    def segments(self, normal: str) -> list[str]:
        return self.pattern.findall(normal) if self.by_segment else [normal] if normal else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(self.normalise(text)[0]) for i in self.covered(s)[::3]]

    def begins(self, text: str, begins: list[int] | None) -> np.ndarray:
        """The original byte at which each normalised character begins, the end of the text last; ``begins`` is what
        ``normalise`` says, None if characters stay as they are."""
        if begins is not None:
            return np.array(begins, np.int64)
        shift = int(self.dummy and bool(text))
        out = np.zeros(shift + len(text) + 1, np.int64)
        if text.isascii():
            out[shift:] = np.arange(len(text) + 1)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            np.cumsum(1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF), out=out[shift + 1 :])
        return out

    def covered(self, segment: str) -> list[int]:
        """(id, begin, end), one after the other, of a normalised segment's pieces, in its characters. The bytes of a
        character outside the vocabulary share its place."""
        out: list[int] = []
        at = 0
        for p in self.cut(segment):
            end = at + len(p)
            i = self.ident.get(p)
            if i is not None:
                out += (i, at, end)
            elif self.byte:
                for b in p.encode("utf-8"):
                    out += (self.byte[b], at, end)
            else:
                out += (self.unknown, at, end)
            at = end
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece, in bytes of the original text in UTF-8.

        The bytes of a character outside the vocabulary share its span. The space put before a text spans nothing.
        """
        normal, begins = self.normalise(text)
        begins = self.begins(text, begins)
        out, at = [], 0
        for s in self.segments(normal):
            rows = np.array(self.covered(s)).reshape(-1, 3)
            out += zip(rows[:, 0].tolist(), begins[rows[:, 1] + at].tolist(), begins[rows[:, 2] + at].tolist(), strict=True)
            at += len(s)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, the space put before the text goes."""
        out = [*map(self.surface.__getitem__, ids)]
        for k, i in enumerate(ids):
            if self.kinds[i] == _CONTROL:
                continue
            if (self.dummy or self.trim) and self.kinds[i] == _NORMAL and out[k].startswith(" "):
                out[k] = out[k][1:]
                if self.trim and not out[k]:
                    continue
            break
        if None in out:
            at = np.flatnonzero(self.bytewise[np.asarray(ids)])
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                a, b = int(run[0]), int(run[-1]) + 1
                out[a] = _utf8(bytes([self.raw[i] for i in ids[a:b]]))
                out[a + 1 : b] = [""] * (b - a - 1)
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """The characters of bytes; each byte that is no part of one becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (4, 3, 2, 1):
            try:
                c = raw[at : at + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                break
        else:
            c, n = "\ufffd", 1
        out.append(c)
        at += n
    return "".join(out)


_models: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    key = hashlib.sha1(data).digest()
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


class _Coder:
    """Encodes whole texts through a bounded memory of segments: what ``Model.covered`` gives, the first id marked.

    The memory goes with the coder: a worker lives on between tasks and then runs other operators beside others.
    """

    def __init__(self, data: bytes):
        self.model = _model(data)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segment(self, s: str) -> bytes:
        rows = self.model.covered(s)
        rows[0] |= _FIRST
        return array("i", rows).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and (begin, end) of every piece in bytes of the original text."""
        m, known = self.model, self.known
        normal, begins = m.normalise(text)
        segments = m.segments(normal)
        found = [*map(known.get, segments)]
        if None in found:
            fresh: dict[str, bytes] = {}
            for k, s in enumerate(segments):
                if found[k] is None:
                    if s not in fresh:
                        fresh[s] = self.older.get(s) or self._segment(s)
                    found[k] = fresh[s]
            if len(known) + len(fresh) > REMEMBERED:
                # What was used since the last time stays reachable, the rest is forgotten.
                self.older.clear()
                self.older.update(known)
                known.clear()
            known.update((s, x) for s, x in fresh.items() if len(s) <= REMEMBERED_LENGTH)
        rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, 3)
        first = np.flatnonzero(rows[:, 0] & _FIRST)
        last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
        length = rows[last, 2].astype(np.int64)
        at = np.repeat(np.cumsum(length) - length, last - first + 1)
        place = m.begins(text, begins)
        return rows[:, 0] & (_FIRST - 1), place[rows[:, 1:] + at[:, None]]

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """(ids, SHA-256 of the ids, of what they decode to, and of the spans as pairs of 64-bit numbers)."""
        ids, spans = self.encode(text)
        ids = ids.tolist()
        written = ",".join(map(self.model.written.__getitem__, ids))
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in (written.encode(), self.model.decode(ids).encode("utf-8"), np.ascontiguousarray(spans, "<i8")))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_digests(docs: DataFrame, model_path: str, ident: str = "doc_id") -> DataFrame:
    """Per row: ``ident``, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of the whole text.

    Every text is encoded with the span of each piece and its ids are decoded again. Null counts as empty, an empty
    text has no ids, an empty table gives no rows. The model (below a megabyte) travels with the task. Rows
    are coded one by one in the batches that Arrow hands over, with a memory of at most twice REMEMBERED segments a
    task; there is no shuffle. Repeated rows give repeated rows; other columns are not read.
    """
    data = model_bytes(model_path)
    kind = docs.schema[ident].dataType.simpleString()

    @tidy
    def run(batches):
        coder = _Coder(data)
        for batch in batches:
            found = [coder.digest(t.as_py() or "") for t in batch.column(1)]
            n, *digests = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in digests)], names=[ident, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(ident, "text").mapInArrow(run, f"{ident} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with pieces (in place of a column of that name): an array of (id, begin, end), spans in bytes of the text in
    UTF-8; null counts as empty and an empty text has none."""
    data = model_bytes(model_path)

    @F.pandas_udf("array<struct<id:int,begin:int,end:int>>")
    def spans(texts):
        model = _model(data)
        return texts.map(lambda t: [{"id": i, "begin": a, "end": b} for i, a, b in model.spans(t or "")])

    return docs.withColumn("pieces", spans("text"))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with decoded (in place of a column of that name): the text that the ids of its pieces stand for, empty for
    none. Null pieces give null."""
    data = model_bytes(model_path)

    @F.pandas_udf("string")
    def texts(ids):
        model = _model(data)
        return ids.map(lambda x: None if x is None else model.decode(list(x)))

    return encoded.withColumn("decoded", texts(F.transform("pieces", lambda p: p["id"])))


def default_model(spark: SparkSession) -> str:
    """The path of the public 32,000-piece model, or what ``axisframe.tokenizer.model`` names."""
    found = spark.conf.get("axisframe.tokenizer.model", None)
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
