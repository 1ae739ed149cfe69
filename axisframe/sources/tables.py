"""Delimited tables and dense text matrices."""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typing
from ..operators import axis
from . import files
from .store import Frame, Matrix, Store, numbered

#: Bytes at the start of a file that layouts are told from.
HEAD = 1 << 16


def head_lines(spark: SparkSession, path: str) -> list[str]:
    """Whole lines from the start of a text file; gzip is told by its first bytes, whatever the name says."""
    raw = files.read_bytes(spark, path, HEAD)
    if raw[:2] == b"\x1f\x8b":
        import zlib

        raw = zlib.decompressobj(31).decompress(raw, HEAD)
    text = raw.decode("utf-8-sig", "replace")
    lines = text.split("\n")
    return [x.rstrip("\r") for x in (lines if len(raw) < HEAD else lines[:-1])]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, numbered from 0. A gzip file without the usual ending is unpacked as a whole."""
    packed = files.read_bytes(spark, path, 2) == b"\x1f\x8b"
    if packed and not path.endswith(".gz"):
        blob = spark.read.format("binaryFile").load(path).select("content")

        def unpack(batches):
            import pyarrow as pa

            for batch in batches:
                for content in batch.column(0):
                    yield pa.RecordBatch.from_pydict({"value": gzip.decompress(content.as_py()).decode("utf-8").split("\n")})

        rows = blob.mapInArrow(unpack, "value string")
    else:
        rows = spark.read.text(path)
    rows = rows.select(F.regexp_replace("value", "\r$", "").alias("value"))
    return numbered(rows).withColumnRenamed("pos", "line")


def read_csv(spark: SparkSession, path: str, index: str | None = None, sep: str = ",", categorical: bool | None = None, most_labels: int = 65_536, only: tuple[str, str] | None = None) -> Frame:
    """A CSV file as an axis frame: the index column (the first by default) gives the names, others get the types that
    their entries have. Text becomes categorical if asked for, or if it repeats enough. ``only`` keeps the rows that have a
    value in a column."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    if len(set(raw.columns)) < len(raw.columns):
        raise ValueError(f"{path}: a column name repeats")
    index = index or raw.columns[0]
    if index not in raw.columns:
        raise KeyError(f"{path} has no column {index!r}: {', '.join(raw.columns)}")
    others = [c for c in raw.columns if c != index]
    if only is not None and only[0] not in raw.columns:
        raise KeyError(f"{path} has no column {only[0]!r}: {', '.join(raw.columns)}")
    rows = numbered(raw if only is None else raw.where(F.col(f"`{only[0]}`") == only[1]))
    found = typing.infer(rows, others)
    typed = [typing.typed(F.col(f"`{c}`"), found[c]).alias(c, metadata={"nullable": True} if found[c].missing and found[c].kind != "float" else {}) for c in others]
    frame = Frame(rows.select("pos", F.coalesce(F.col(f"`{index}`"), F.lit("")).alias("name"), *typed))
    if categorical is not False:
        n = None
        for c in others:
            if found[c].kind == "text":
                distinct = rows.select(f"`{c}`").distinct().limit(most_labels + 1).count()
                n = n if n is not None else rows.count()
                if categorical or distinct < n:
                    frame = axis.categorised(frame, c, most_labels)
    return frame


def csv_rows(frame: Frame, columns: list[str] | None = None, head: int | None = None, index: str = "index") -> DataFrame:
    """The frame as text in row order, names first; missing entries are empty. A negative head is refused."""
    if head is not None and head < 0:
        raise ValueError("a head cannot be negative")
    unknown = [c for c in columns or () if c not in frame.columns]
    if unknown:
        raise KeyError(f"no column {unknown[0]!r}: {', '.join(frame.columns)}")
    kinds = dict(frame.data.dtypes)
    texts = [F.coalesce(F.when(F.isnan(f"`{c}`"), "").otherwise(typing.number_text(F.col(f"`{c}`"), kinds[c])) if kinds[c] in ("float", "double") else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns or frame.columns]
    rows = frame.data.orderBy("pos")
    rows = rows.limit(head) if head is not None else rows
    return rows.select(F.coalesce("name", F.lit("")).alias(index), *texts)


def write_csv(frame: Frame, path: str, columns: list[str] | None = None, head: int | None = None, replace: bool = False) -> None:
    """Write one CSV file. Sorted parts are written by Spark and put together byte by byte."""
    rows = csv_rows(frame, columns, head)
    with files.staged(frame.data.sparkSession, path, replace) as new:
        one_file(rows.select(*[_quoted(c) for c in rows.columns]), new, ",".join(_quote(c) for c in rows.columns))


def _quote(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search('[",\r\n]', text) else text


def _quoted(c: str):
    text = F.col(f"`{c}`")
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text).alias(c)


def one_file(rows: DataFrame, path: str, header: str = "", sep: str = ",", packed: bool = False) -> None:
    """Rows of text columns as one file below a header. Parts are written in parallel and copied one after the other, as streams;
    gzip members may follow each other, so packed parts stay packed."""
    spark = rows.sparkSession
    parts = f"{path}.parts"
    text = rows.select(F.concat_ws(sep, *[F.col(f"`{c}`") for c in rows.columns]).alias("value"))
    text.write.option("compression", "gzip" if packed else "none").text(parts)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(to, True)
    try:
        if header:
            first = (header + "\n").encode()
            out.write(bytearray(gzip.compress(first, mtime=0) if packed else first))
        for name in files.names(spark, parts):
            if name.startswith("part-"):
                source = fs.open(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 65536, False)
                source.close()
    finally:
        out.close()
        files.delete(spark, parts)


@dataclass(frozen=True)
class Layout:
    """How a dense text matrix is written: separator (None for runs of blanks), lines before the data, column names, whether
    rows begin with a name."""

    sep: str | None
    skip: int
    columns: tuple[str, ...] | None
    row_names: bool

    def pattern(self) -> str:
        return r"\s+" if self.sep is None else re.escape(self.sep)


def _fields(line: str, sep: str | None) -> list[str]:
    return [x.strip().strip('"') for x in (line.split() if sep is None else line.split(sep))]


def _number(text: str) -> bool:
    return typing.reads_as_number(text)


def layout(spark: SparkSession, path: str, sep: str | None = "auto") -> Layout:
    """Tell the layout of a dense text matrix from its first lines: comments, a header with or without a corner, row names."""
    rows = head_lines(spark, path)
    skip = 0
    while skip < len(rows) and (not rows[skip].strip() or rows[skip].startswith("#")):
        skip += 1
    body = [x for x in rows[skip:] if x.strip()]
    if not body:
        raise ValueError(f"{path} holds no rows")
    if sep == "auto":
        probe = body[min(1, len(body) - 1)]
        sep = next((s for s in ("\t", ",", ";") if s in probe), None)
    first = _fields(body[0], sep)
    second = _fields(body[1], sep) if len(body) > 1 else None
    names_first = second is not None and not _number(second[0])
    headed = any(not _number(x) for x in first[1:]) or len(first) == 1 and not _number(first[0]) or second is not None and len(second) == len(first) + 1
    if not headed and second is None:
        names_first = not _number(first[0])
    if not headed:
        return Layout(sep, skip, None, not _number(first[0]))
    short = second is not None and len(second) == len(first) + 1
    row_names = short or names_first
    columns = first if short or not row_names else first[1:]
    return Layout(sep, skip + 1, tuple(columns), row_names)


def read_dense(spark: SparkSession, path: str, transpose: bool = False, sep: str | None = "auto", keep_zeros: bool = False) -> Store:
    """A dense text matrix as a store: rows are observations, or variables if ``transpose``. Rows of another width and fields
    that are no numbers are refused with their line."""
    how = layout(spark, path, sep)
    rows = lines(spark, path).where(F.col("line") >= how.skip).where("trim(value) <> '' AND NOT startswith(value, '#')")
    text = F.trim("value") if how.sep is None else F.col("value")
    rows = rows.select("line", F.transform(F.split(text, how.pattern()), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")).alias("f"))
    extra = int(how.row_names)
    width = len(how.columns) if how.columns is not None else rows.select(F.size("f")).first()[0] - extra
    values = F.slice("f", 1 + extra, width) if width else F.array().cast("array<string>")
    odd = F.size("f") != width + extra
    wrong = F.exists(values, lambda x: ~typing.is_number(x) & ~F.lower(x).isin("nan", "na"))
    bad = rows.agg(F.min(F.when(odd, F.col("line"))).alias("odd"), F.min(F.when(wrong, F.col("line"))).alias("wrong")).first()
    if bad["odd"] is not None or bad["wrong"] is not None:
        k = min(x for x in (bad["odd"], bad["wrong"]) if x is not None)
        raise ValueError(f"{path}, line {k + 1}: " + (f"it should have {width + extra} fields" if bad["odd"] == k else "a field is no number"))
    rows = axis.renumbered(rows.withColumnRenamed("line", "pos")).drop("pos").withColumnRenamed("new_pos", "pos")
    number = lambda x: F.when(F.lower(x).isin("nan", "na"), F.lit(float("nan"))).otherwise(F.regexp_replace(x, "(?i)inf(?:inity)?$", "Infinity").try_cast("double"))
    named = rows.select("pos", (F.element_at("f", 1) if how.row_names else F.col("pos").cast("string")).alias("name"), F.transform(values, number).alias("v"))
    entries = named.select(F.col("pos").alias("i"), F.posexplode("v").alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    entries = entries if keep_zeros else entries.where("v <> 0")
    columns = how.columns if how.columns is not None else tuple(map(str, range(width)))
    across = spark.createDataFrame([(k, c) for k, c in enumerate(columns)], "pos long, name string")
    down = named.select("pos", "name")
    n = down.count()
    if transpose:
        return Store(Frame(across), Frame(down), {"X": Matrix(entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), (width, n), "float64", "csr")})
    return Store(Frame(down), Frame(across), {"X": Matrix(entries, (n, width), "float64", "csr")})
