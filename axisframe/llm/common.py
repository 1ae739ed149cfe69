"""Shared folder, lineage cuts, joins with hot keys and table access for the operators of this subpackage."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch.
BATCH_ROWS = 2000
#: A key with more than this part of all rows is hot; there are fewer hot keys than this.
HOT_PART = 1000
#: Most bits of the map that ``marked`` broadcasts (2 MB), and the bits a value has in a smaller one.
MAP_BITS, VALUE_BITS = 1 << 24, 16
_MAP_PART = 1 << 15
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers, once a session; and hand whole texts over in batches of no more than BATCH_ROWS
    rows, which bounds both sides' buffers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_axisframe_shipped", False):
        top = Path(__file__).resolve().parents[1]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(f.relative_to(top.parent))), f.read_bytes())
        # The driver serves this file to the executors; nothing else reads it from its folder.
        at = Path(tempfile.mkdtemp(prefix="axisframe-")) / f"axisframe-{hashlib.sha1(packed.getvalue()).hexdigest()[:12]}.zip"
        at.write_bytes(packed.getvalue())
        context.addPyFile(str(at))
        context._axisframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine (tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="axisframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at files that outlive executors.

    What the writing shuffled is deleted as soon as the files are there, as nothing reads it again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    was = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._axisframe_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind ``cut``s that no later plan reads."""
    for df in frames:
        path = getattr(df, "_axisframe_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``facts``, which has one row a key and in ``weight`` how many of ``rows`` have it.

    Keys with more than a HOT_PART-th of all those rows are fewer than HOT_PART, so their facts are broadcast and their
    rows stay where they are; all others are shuffled. Both sides must be cheap to read again.
    """
    total, most = facts.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * HOT_PART <= total:
        return rows.join(facts.drop(weight).hint("shuffle_hash"), keys, how)
    hot = F.col(weight) * HOT_PART > total
    few = facts.where(hot).drop(weight)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.where(~hot).drop(weight).hint("shuffle_hash"), keys, how)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def marked(rows: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: true wherever ``some`` (one column, cheap to read again) holds the value of ``column``,
    else mostly false.

    A map of hashes is broadcast, of VALUE_BITS a value but MAP_BITS at most: with more values than it has room for, more
    rows are marked that need not be, none is missed. What is marked is to be joined with ``some``.
    """
    bits = _MAP_PART
    while bits < min(MAP_BITS, VALUE_BITS * some.count()):
        bits *= 2
    at = lambda value: F.pmod(F.xxhash64(value), F.lit(bits))
    spread = some.select(at(some.columns[0]).alias("at")).select(F.shiftright("at", 15).alias("map_part"), F.pmod("at", F.lit(_MAP_PART)).alias("map_at"))
    maps = spread.groupBy("map_part").agg(F.bitmap_construct_agg("map_at").alias("map"))
    # Byte and bit of the value in its part of the map.
    byte = F.conv(F.hex(F.substring("map", (F.pmod(at(column), F.lit(_MAP_PART)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.pmod(at(column), F.lit(8)) + 1).cast("int")))
    out = rows.join(F.broadcast(maps), F.shiftright(at(column), 15) == F.col("map_part"), "left")
    return out.select(*rows.columns, F.coalesce(bit != 0, F.lit(False)).alias("marked"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")
