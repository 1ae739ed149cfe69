"""Files through the session's own file systems, and outputs that appear whole or not at all."""

from __future__ import annotations

import hashlib
import io
import os
import signal
import socket
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once a session: those on other machines do not have it."""
    context = spark.sparkContext
    if getattr(context, "_axisframe_core", False):
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(top.parent))), f.read_bytes())
    at = Path(tempfile.mkdtemp(prefix="axisframe-")) / f"axisframe-core-{hashlib.sha1(packed.getvalue()).hexdigest()[:12]}.zip"
    at.write_bytes(packed.getvalue())
    context.addPyFile(str(at))
    context._axisframe_core = True


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); on one machine, where the session
    names none, in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="axisframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _local(path: str) -> str | None:
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def open_input(path: str):
    """A file to seek in and read from, in any process: on a disk that all have, or in a store that Arrow reaches."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def open_output(path: str):
    """A new file to write to, in any process; folders above it are made."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_output_stream(at)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's bytes (the first ``most`` of them); for small files such as manifests and headers."""
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        n = fs.getFileStatus(where).getLen()
        return bytes(stream.readNBytes(int(n if most is None else min(n, most))))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none for a file or nothing."""
    fs, where = _at(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _at(spark, path)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} cannot be renamed to {to}")


def move(spark: SparkSession, path: str, to: str) -> None:
    """``rename`` that makes the folders above the new place."""
    fs, where = _at(spark, to)
    fs.mkdirs(where.getParent())
    rename(spark, path, to)


def same(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths name one place, once made absolute."""
    (fs, x), (other, y) = _at(spark, a), _at(spark, b)
    return str(fs.makeQualified(x)) == str(other.makeQualified(y))


def _holder(spark: SparkSession, lock: str) -> tuple[str, int] | None:
    """The machine and process that a lock names."""
    try:
        host, _, pid = read_bytes(spark, lock).decode().partition(" ")
        return host, int(pid)
    except Exception:  # noqa: BLE001 - a lock that cannot be read is one that is held
        return None


def _dead(holder: tuple[str, int] | None) -> bool:
    """Whether a lock's process ran on this machine and is gone."""
    if holder is None or holder[0] != socket.gethostname():
        return False
    try:
        os.kill(holder[1], 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        pass
    return False


def claim(spark: SparkSession, lock: str) -> None:
    """Take a lock that nobody holds, or whose holder is gone; a lock from another machine may still be held."""
    fs, where = _at(spark, lock)
    if not fs.createNewFile(where):
        if not _dead(_holder(spark, lock)):
            raise FileExistsError(f"another process is writing here ({lock})")
        fs.delete(where, False)
        if not fs.createNewFile(where):
            raise FileExistsError(f"another process is writing here ({lock})")
    write_bytes(spark, lock, f"{socket.gethostname()} {os.getpid()}".encode())


class Ended(SystemExit):
    """A scheduler or a closed terminal has asked the process to end; the code is the usual one for its signal."""


@contextmanager
def ending_signals() -> Iterator[None]:
    """Within, SIGTERM and SIGHUP raise ``Ended`` (codes 143 and 129), so that what was begun is cleaned up."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    before = {}

    def end(number, _):
        raise Ended(128 + number)

    for s in (signal.SIGTERM, signal.SIGHUP):
        before[s] = signal.signal(s, end)
    try:
        yield
    finally:
        for s, how in before.items():
            signal.signal(s, how)


def settle(path: str) -> None:
    """Have what lies at a local path on the disk, not in its cache."""
    local = _local(path)
    if local is None or not os.path.exists(local):
        return
    for at in [local] if os.path.isfile(local) else [os.path.join(d, n) for d, _, ns in os.walk(local) for n in ns]:
        with open(at, "rb") as f:
            os.fsync(f.fileno())


def inherit(path: str, from_path: str) -> None:
    """Give a local path the mode and group of another."""
    old, new = _local(from_path), _local(path)
    if old and new and os.path.exists(old) and os.path.exists(new):
        told = os.stat(old)
        os.chmod(new, told.st_mode & 0o7777)
        try:
            os.chown(new, -1, told.st_gid)
        except PermissionError:
            pass


def real(path: str) -> str:
    """A local path with links followed, so that what a link points at is replaced and the link kept."""
    local = _local(path)
    if local is None or not os.path.islink(local):
        return path
    return ("file://" if path.startswith("file:") else "") + os.path.realpath(local)


def alias(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths reach one place, by whatever name: links, hard links, another case, or one inside the other."""
    x, y = _local(a), _local(b)
    if x is not None and y is not None and os.path.exists(x) and os.path.exists(y):
        if os.path.samefile(x, y):
            return True
        up, down = sorted((os.path.realpath(x), os.path.realpath(y)), key=len)
        return os.path.isdir(up) and down.startswith(up.rstrip("/") + "/")
    return same(spark, a, b)


def human(n: int) -> str:
    """A number of bytes for people."""
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1000 or unit == "TB":
            break
        size /= 1000
    return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"


def size_of(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def check_space(spark: SparkSession, path: str, need: int) -> None:
    """Refuse to write ``need`` bytes where the file system says that less is free."""
    fs, where = _at(spark, path)
    while where.getParent() is not None and not fs.exists(where):
        where = where.getParent()
    free = int(fs.getStatus(where).getRemaining())
    if free < need:
        raise OSError(f"{path} needs about {human(need)}, of which {human(free)} are free")


@contextmanager
def staged(spark: SparkSession, target: str, replace: bool = False, sources: tuple[str, ...] = ()) -> Iterator[str]:
    """A path beside ``target`` to write to; it takes the target's place at the end, or is deleted after an error.

    A target that exists is refused unless ``replace``, and one that is also an input always unless
    ``replace``. A link's own target is replaced and the link kept; what replaces something is on the disk before, and has
    its mode and group. A lock beside it keeps a second writer away; one whose process is gone is taken over.
    """
    target = real(target.rstrip("/"))
    taken = exists(spark, target)
    if taken and not replace:
        raise FileExistsError(f"{target} exists")
    if not replace and any(alias(spark, target, s) for s in sources):
        raise FileExistsError(f"{target} is also an input")
    head, _, tail = target.rpartition("/")
    beside = f"{head}/.{tail}" if head else f".{tail}"
    claim(spark, f"{beside}.lock")
    fs, lock = _at(spark, f"{beside}.lock")
    new, old = f"{beside}.new-{uuid.uuid4().hex}", f"{beside}.old-{uuid.uuid4().hex}"
    try:
        with ending_signals():
            yield new
            if taken:
                settle(new)
                inherit(new, target)
                rename(spark, target, old)
            try:
                rename(spark, new, target)
            except OSError:
                if taken:
                    rename(spark, old, target)
                raise
            if taken:
                delete(spark, old)
    finally:
        if exists(spark, new):
            delete(spark, new)
        fs.delete(lock, False)
