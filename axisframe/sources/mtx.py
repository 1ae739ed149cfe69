"""Matrix Market files and the folders that hold one with its names."""

from __future__ import annotations

import json
from dataclasses import dataclass
from dataclasses import replace as replaced

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unique_rows
from ..operators import matrix
from . import files, tables
from .store import Frame, Matrix, Store

BANNER = "%%MatrixMarket"


@dataclass(frozen=True)
class Header:
    """What a file's first lines say: the kind of its values, its shape, its entries, and the lines before them."""

    values: str
    rows: int
    columns: int
    entries: int
    skip: int


def header(spark: SparkSession, path: str) -> Header:
    """Read and check a header: a general coordinate matrix of integer, real or pattern values."""
    rows = tables.head_lines(spark, path)
    words = rows[0].lower().split() if rows else []
    if len(words) < 5 or words[0] != BANNER.lower() or words[1:3] != ["matrix", "coordinate"]:
        raise ValueError(f"{path} is no coordinate Matrix Market file")
    if words[3] not in ("integer", "real", "pattern") or words[4] != "general":
        raise ValueError(f"{path}: {words[3]} {words[4]} matrices are not read")
    for k, line in enumerate(rows[1:], 1):
        if line.strip() and not line.startswith("%"):
            size = line.split()
            if len(size) != 3 or not all(x.isdigit() for x in size):
                raise ValueError(f"{path}, line {k + 1}: three sizes should stand here")
            return Header(words[3], *map(int, size), k + 1)
    raise ValueError(f"{path}: the sizes are missing")


def read(spark: SparkSession, path: str) -> Matrix:
    """A Matrix Market file as entries; those of one coordinate add up.

    Every line is checked in one pass: its fields, its bounds, the number of entries. Integer values come as int32 if
    even the magnitudes of a row's duplicates fit, else int64; real ones as float64, patterns as 1.
    """
    h = header(spark, path)
    rows = tables.lines(spark, path).where((F.col("line") >= h.skip) & ~F.col("value").rlike(r"^\s*(%|$)"))
    f = F.split(F.trim("value"), r"\s+")
    want = 2 if h.values == "pattern" else 3
    number = F.get(f, F.lit(2))
    v = F.lit(1).cast("long") if h.values == "pattern" else number.try_cast("long" if h.values == "integer" else "double")
    rows = rows.select("line", F.size(f).alias("n"), (F.get(f, F.lit(0)).try_cast("long") - 1).alias("i"), (F.get(f, F.lit(1)).try_cast("long") - 1).alias("j"), v.alias("v"))
    wrong = (F.col("n") != want) | F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull()
    outside = (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= h.rows) | (F.col("j") >= h.columns)
    r = rows.agg(F.min(F.when(wrong, F.col("line"))).alias("wrong"), F.min(F.when(outside, F.col("line"))).alias("outside"), F.count("*").alias("n")).first()
    if r["wrong"] is not None:
        raise ValueError(f"{path}, line {r['wrong'] + 1}: {want} numbers should stand here")
    if r["outside"] is not None:
        raise ValueError(f"{path}, line {r['outside'] + 1}: it lies outside {h.rows} x {h.columns}")
    if r["n"] != h.entries:
        raise ValueError(f"{path} has {r['n']} entries, not {h.entries}")
    entries = rows.select("i", "j", "v")
    if h.values == "real":
        return Matrix(matrix.summed(entries), (h.rows, h.columns), "float64")
    dtype = value_dtype(entries)
    kind = "int" if dtype == "int32" else "bigint"
    return Matrix(matrix.summed(entries).withColumn("v", F.col("v").cast(kind)), (h.rows, h.columns), dtype)


def value_dtype(entries: DataFrame) -> str:
    """int32 or int64 for whole numbers whose duplicates will be added up, by a bound that holds for every sum."""
    per = entries.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("v").cast("double"))).alias("m"), F.min("v").alias("a"), F.max("v").alias("b"), F.count_distinct("j").alias("d"))
    r = per.agg(F.max("m").alias("m"), F.min("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("d") < F.col("n")).alias("twice")).first()
    low, high = r["a"] or 0, r["b"] or 0
    if r["twice"]:
        if r["m"] >= 2.0**63:
            raise ValueError("the sum of duplicate entries could exceed int64")
        low, high = min(low, -r["m"]), max(high, r["m"])
    return "int32" if low >= -(1 << 31) and high < 1 << 31 else "int64"


def write(m: Matrix, path: str, head: int | None = None, packed: bool | None = None, replace: bool = False, transpose: bool = False, comment: str = "") -> None:
    """Write entries in row order (the columns of the transposed matrix) to one file, whole numbers as such."""
    if head is not None and head < 0:
        raise ValueError("a head cannot be negative")
    m = matrix.sparsified(m)
    data = m.data.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if transpose else m.data
    keys = ["j", "i"] if transpose else ["i", "j"]
    rows = data.orderBy(*keys)
    rows = rows.limit(head) if head is not None else rows
    n = m.data.count() if head is None else rows.count()
    whole = not m.dtype.startswith("float")
    kind = dict(data.dtypes)["v"]
    from ..functions.typing import number_text

    v = F.col("v").cast("int").cast("string") if kind == "boolean" else number_text(F.col("v"), kind)
    shape = m.shape[::-1] if transpose else m.shape
    top = f"{BANNER} matrix coordinate {'integer' if whole else 'real'} general\n" + (f"%{comment}\n" if comment else "") + f"{shape[0]} {shape[1]} {n}"
    packed = path.endswith(".gz") if packed is None else packed
    with files.staged(m.data.sparkSession, path, replace) as new:
        tables.one_file(rows.select((F.col("i") + 1).cast("string").alias("a"), (F.col("j") + 1).cast("string").alias("b"), v.alias("c")), new, top, " ", packed)


# The matrices of a folder of spliced and unspliced counts, the first of which becomes X too.
LAYERS = ("spliced", "unspliced", "ambiguous")


def _members(spark: SparkSession, folder: str, *wanted: str) -> list[str]:
    """The members of a folder whose names end so, with or without a prefix and gzip."""
    found = []
    for name in files.names(spark, folder):
        bare = name.removesuffix(".gz")
        if any(bare == w or bare.endswith(("_" + w, "-" + w, "." + w)) for w in wanted):
            found.append(f"{folder}/{name}")
    return found


def _member(spark: SparkSession, folder: str, *wanted: str) -> str | None:
    """The one member of a folder whose name ends so; several sets in one folder are told apart by the user."""
    found = _members(spark, folder, *wanted)
    if len(found) > 1:
        raise ValueError(f"{folder} holds several: {', '.join(f.rpartition('/')[2] for f in found)}")
    return found[0] if found else None


def _genomes(spark: SparkSession, folder: str) -> list[str]:
    """Subfolders that are a genome's: those with a table of genes."""
    return [n for n in files.names(spark, folder) if _members(spark, f"{folder}/{n}", "genes.tsv")]


def is_folder(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds counts with their names, or a subfolder a genome that does."""
    if not files.names(spark, folder):
        return False
    whole = bool(_members(spark, folder, "barcodes.tsv")) and bool(_members(spark, folder, "matrix.mtx", *(f"{x}.mtx" for x in LAYERS)))
    return whole or bool(_genomes(spark, folder))


def read_folder(spark: SparkSession, folder: str, names: str = "ids", feature_type: str | None = None, genome: str | None = None, make_unique: bool = False) -> Store:
    """A count folder: matrix.mtx (features x barcodes), barcodes.tsv and features.tsv or genes.tsv, any of them gzipped
    or prefixed; or spliced, unspliced and ambiguous counts, which become layers; or a subfolder a genome.

    ``names`` is ids or symbols; features can be narrowed to one type or genome.
    """
    folder = folder.rstrip("/")
    if not _members(spark, folder, "barcodes.tsv") and (have := _genomes(spark, folder)):
        if genome is None and len(have) > 1 or genome is not None and genome not in have:
            raise ValueError(f"{folder} holds the genomes {', '.join(have)}")
        folder, genome = f"{folder}/{genome or have[0]}", None
    layers = {x: m for x in LAYERS if (m := _member(spark, folder, f"{x}.mtx"))}
    parts = {k: _member(spark, folder, *w) for k, w in {"matrix": ("spliced.mtx",) if layers else ("matrix.mtx",), "barcodes": ("barcodes.tsv",), "features": ("features.tsv", "genes.tsv")}.items()}
    if gone := [k for k, v in parts.items() if v is None]:
        raise FileNotFoundError(f"{folder} has no {', '.join(gone)}")
    if names not in ("ids", "symbols"):
        raise ValueError("names are ids or symbols")
    one = lambda p: tables.lines(spark, p).withColumnRenamed("line", "pos").withColumn("f", F.split("value", "\t"))
    obs = one(parts["barcodes"]).select("pos", F.get("f", F.lit(0)).alias("name"))
    f = one(parts["features"])
    ident, symbol = F.get("f", F.lit(0)), F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0)))
    name, other = (ident, symbol) if names == "ids" else (symbol, ident)
    var = f.select("pos", name.alias("name"), other.alias("gene_symbols" if names == "ids" else "gene_ids"), F.get("f", F.lit(2)).alias("feature_types"), F.get("f", F.lit(3)).alias("genome"))
    sizes = obs.count(), var.count()
    found = {}
    for path, at in {"X": parts["matrix"], **{f"layers/{x}": p for x, p in layers.items()}}.items():
        m = read(spark, at)
        if (m.shape[1], m.shape[0]) != sizes:
            raise ValueError(f"{folder}: {m.shape[0]} x {m.shape[1]} entries, but {sizes[1]} features and {sizes[0]} barcodes")
        found[path] = Matrix(m.data.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), sizes, m.dtype)
    told = run_of(spark, parts["matrix"])
    store = Store(Frame(obs), Frame(var), found, {}, {"cellranger": told} if told else {})
    from ..operators import modalities

    store = modalities.narrowed(store, feature_type, genome)
    return replaced(store, var=Frame(unique_rows(store.var.data))) if make_unique else store


def run_of(spark: SparkSession, path: str) -> dict:
    """What a matrix file's comment says of the run that made it."""
    for line in tables.head_lines(spark, path)[1:]:
        if not line.startswith("%"):
            break
        text = line.lstrip("%").strip()
        if text.startswith("metadata_json:"):
            try:
                value = json.loads(text.partition(":")[2])
            except ValueError:
                return {}
            return value if isinstance(value, dict) else {}
    return {}


def write_folder(store: Store, folder: str, replace: bool = False, feature_type: str = "Gene Expression") -> None:
    """X as a count folder, gzipped, in barcode order. Names that a tab-separated line cannot hold are refused."""
    spark = store.spark
    if "X" not in store.matrices:
        raise KeyError("there is no X")
    broken = lambda c: F.col(c).rlike("[\t\r\n]") | (F.coalesce(c, F.lit("")) == "") | F.startswith(F.col(c), F.lit('"'))
    if not store.var.data.where(broken("name")).isEmpty() or not store.obs.data.where(broken("name") | F.contains(F.col("name"), F.lit(","))).isEmpty():
        raise ValueError("a name is empty, begins with a quote, or holds a tab, a line end or (in a barcode) a comma")
    columns = store.var.columns
    symbol = F.coalesce("gene_symbols", "name") if "gene_symbols" in columns else F.col("name")
    kind = F.coalesce("feature_types", F.lit(feature_type)) if "feature_types" in columns else F.lit(feature_type)
    with files.staged(spark, folder, replace) as new:
        tables.one_file(store.obs.data.orderBy("pos").select("name"), f"{new}/barcodes.tsv.gz", packed=True)
        tables.one_file(store.var.data.orderBy("pos").select("name", symbol.alias("symbol"), kind.alias("kind")), f"{new}/features.tsv.gz", sep="\t", packed=True)
        run = store.uns.get("cellranger")
        write(store.matrices["X"], f"{new}/matrix.mtx.gz", transpose=True, comment=f"metadata_json: {json.dumps(run)}" if run else "")


def feature_types(var: DataFrame) -> DataFrame:
    """(feature_types, n) in order of first appearance."""
    return var.groupBy("feature_types").agg(F.count("*").alias("n"), F.min("pos").alias("_first")).orderBy("_first").drop("_first")


RUN_FILES = ("count_matrix.mtx", "all_genes.csv", "cell_metadata.csv")


def run_folder(spark: SparkSession, path: str, sample: str | None = None, unfiltered: bool = False) -> str | None:
    """The folder of counts that is meant: given itself, of a sample, or of a run (all samples unless one is named)."""
    path = path.rstrip("/")
    if all(_members(spark, path, n) for n in RUN_FILES):
        return path
    inner = "DGE_unfiltered" if unfiltered else "DGE_filtered"
    for folder in (f"{path}/{inner}", f"{path}/{sample or 'all-sample'}/{inner}"):
        if all(_members(spark, folder, n) for n in RUN_FILES):
            return folder
    return None


def samples(spark: SparkSession, path: str, unfiltered: bool = False) -> list[str]:
    """The samples of a run, without the folder that holds all of them."""
    return [n for n in files.names(spark, path) if n != "all-sample" and run_folder(spark, f"{path.rstrip('/')}/{n}", unfiltered=unfiltered)]


def read_run(spark: SparkSession, path: str, genome: str | None = None, sample: str | None = None, unfiltered: bool = False, names: str = "ids", make_unique: bool = False) -> Store:
    """A combinatorial-barcoding run: count_matrix.mtx (cells x genes), all_genes.csv and cell_metadata.csv of all samples or
    one. A genome narrows genes, and cells that are assigned to another species."""
    if sample is not None and sample != "all-sample" and (have := samples(spark, path, unfiltered)) and sample not in have:
        raise ValueError(f"no sample {sample!r}: {', '.join(have)}")
    folder = run_folder(spark, path, sample, unfiltered)
    if folder is None:
        raise FileNotFoundError(f"{path} has no {RUN_FILES[0]}")
    m = read(spark, _member(spark, folder, RUN_FILES[0]))
    genes = tables.read_csv(spark, _member(spark, folder, RUN_FILES[1]), categorical=False)
    cells = tables.read_csv(spark, _member(spark, folder, RUN_FILES[2]))
    sizes = cells.data.count(), genes.data.count()
    if m.shape != sizes:
        raise ValueError(f"{folder}: {m.shape[0]} x {m.shape[1]} entries, but {sizes[0]} cells and {sizes[1]} genes")
    store = Store(cells, genes, {"X": m})
    if "gene_name" in genes.columns:
        from ..operators import modalities

        symbols = Frame(genes.data.withColumnRenamed("gene_name", "gene_symbols"), genes.categories)
        store = Store(cells, symbols, {"X": m})
        store = modalities.renamed_by(store, "gene_symbols", "gene_ids") if names == "symbols" else store
    if genome is not None:
        from ..operators.reshape import subset

        query = f'genome == "{genome}"'
        store = subset(store, var_query=query, obs_query=f'species == "{genome}"' if "species" in cells.columns else None)
    return replaced(store, var=Frame(unique_rows(store.var.data))) if make_unique else store
