"""Queries that go through files and whole stores: what is written, read back or joined equals what SQL gives on the tables.

A shop stands in for an annotated matrix: obs = customers, var = suppliers, X = quantities that customers had from suppliers,
all of them from whole tables.
"""

from __future__ import annotations

import io
import json
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cli
from ..functions import names, typing
from ..operators import axis, concat, joins, matrix, modalities, reshape
from ..sources import arrays, chunked, counts, files, formats, hdf5, loom, mtx, mudata, spatial, store, tables, trees
from ..sources.store import Categories, Frame, Matrix, Store
from ..streaming import blocks
from .catalog import orders, parts, quantities, query, table

_X = "SELECT o_custkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def customers(spark, sf_dir) -> Frame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return axis.categorised(Frame(rows), "segment")


def suppliers(spark, sf_dir) -> Frame:
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_nationkey") % 2 == 0, "Gene Expression").otherwise("Peaks")
    return Frame(s.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("gene_symbols"), kind.alias("feature_types"), F.col("s_nationkey").cast("string").alias("genome")))


def bought(spark, sf_dir) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return matrix.summed(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v")))


def shop(spark, sf_dir, whole: bool = False) -> Store:
    """The shop's store; ``whole`` has quantities as integers."""
    obs, var = customers(spark, sf_dir), suppliers(spark, sf_dir)
    n, m = obs.data.count(), var.data.count()
    path = files.scratch(spark, "bought")
    x = bought(spark, sf_dir)
    (x.withColumn("v", F.col("v").cast("int")) if whole else x).write.parquet(path)
    wide = obs.data.select(F.col("pos").alias("i"), F.array(F.col("balance"), F.col("nation").cast("double")).alias("values"))
    graph = var.data.select(F.col("pos").alias("i"), ((F.col("pos") + 1) % m).alias("j"), F.lit(1.0).alias("v"))
    found = {"X": Matrix(spark.read.parquet(path), (n, m), "int32" if whole else "float64"), "obsm/wide": Matrix(wide, (n, 2), "float64", "dense"), "varp/ring": Matrix(graph, (m, m), "float64")}
    return Store(obs, var, found, {}, {"shop": {"name": "all", "sizes": [n, m]}})


def _entries(s: Store, path: str = "X") -> DataFrame:
    """Entries by the names of their ends."""
    m = matrix.sparsified(s.matrices[path])
    a, b = s.obs.data.select(F.col("pos").alias("i"), F.col("name").alias("a")), s.var.data.select(F.col("pos").alias("j"), F.col("name").alias("b"))
    return m.data.join(a, "i").join(b, "j").select("a", "b", F.col("v").cast("double").alias("v"))


_NAMED = f"SELECT c_name AS a, s_name AS b, v FROM ({_X}) JOIN customer ON c_custkey = i JOIN supplier ON s_suppkey = j"
_OBS = "SELECT c_custkey AS pos, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey::BIGINT AS nation FROM customer"


def _obs(s: Store) -> DataFrame:
    return s.obs.data.select("pos", "name", "segment", "balance", F.col("nation").cast("long").alias("nation"))


@query("store_round_trip", _NAMED)
def store_round_trip(spark, sf_dir):
    """A store written as a folder and opened again."""
    path = files.scratch(spark, "store")
    store.save(shop(spark, sf_dir), path)
    return _entries(store.load(spark, path))


@query(
    "store_listing",
    """SELECT 'obs' AS path, 'frame' AS kind, count(*)::BIGINT AS n, 3::BIGINT AS m FROM customer UNION ALL SELECT 'var', 'frame', count(*), 3 FROM supplier
       UNION ALL SELECT 'X', 'matrix', (SELECT count(*) FROM customer), count(*) FROM supplier UNION ALL SELECT 'obsm/wide', 'matrix', count(*), 2 FROM customer
       UNION ALL SELECT 'varp/ring', 'matrix', count(*), count(*) FROM supplier UNION ALL SELECT 'uns', 'mapping', 1, NULL UNION ALL SELECT 'uns/shop', 'mapping', 2, NULL
       UNION ALL SELECT 'obs/segment', 'categorical', count(*), NULL FROM customer UNION ALL SELECT 'obs/balance', 'column', count(*), NULL FROM customer""",
)
def store_listing(spark, sf_dir):
    """What a store says of its elements without reading their values."""
    rows = [(e["path"], e["kind"], *(list(e["shape"]) + [None, None])[:2]) for e in store.describe(shop(spark, sf_dir))]
    wanted = {"obs", "var", "X", "obsm/wide", "varp/ring", "uns", "uns/shop", "obs/segment", "obs/balance"}
    return spark.createDataFrame([r for r in rows if r[0] in wanted], "path string, kind string, n long, m long")


@query("csv_round_trip", _OBS)
def csv_round_trip(spark, sf_dir):
    """A frame as CSV and back, with the types that its entries have."""
    path = files.scratch(spark, "csv") + ".csv"
    tables.write_csv(customers(spark, sf_dir), path)
    return _obs(Store(tables.read_csv(spark, path), suppliers(spark, sf_dir)))


@query("npy_round_trip", "SELECT vec_id AS i, (k - 1)::INTEGER AS j, e::DOUBLE AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding) AS e FROM embeddings)")
def npy_round_trip(spark, sf_dir):
    """A dense matrix as one array file and back, read by runs of rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("values"))
    path = files.scratch(spark, "npy") + ".npy"
    arrays.write_npy(Matrix(e, (e.count(), 64), "float32", "dense"), path)
    return arrays.read_npy(spark, path).data.select("i", F.posexplode("values").alias("j", "v")).withColumn("v", F.col("v").cast("double"))


@query("npy_column", "SELECT d.doc_id AS pos, coalesce(l.quality, -1)::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def npy_column(spark, sf_dir):
    """A column of whole numbers with gaps as floats, what is missing as NaN (shown as -1)."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    rows = d.join(l, F.col("doc_id") == F.col("id"), "left").select(F.col("doc_id").alias("pos"), "quality")
    x = np.load(io.BytesIO(arrays.npy_bytes(rows, "quality")))
    return spark.createDataFrame([(k, -1.0 if v != v else float(v)) for k, v in enumerate(x.tolist())], "pos long, quality double")


@query("mtx_round_trip", _X)
def mtx_round_trip(spark, sf_dir):
    """Entries as a packed Matrix Market file and back, duplicates added up, whole numbers as such."""
    path = files.scratch(spark, "mtx") + ".mtx.gz"
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    twice = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast("int").alias("v"))
    mtx.write(Matrix(twice, (o.agg(F.max("o_custkey")).first()[0] + 1, l.agg(F.max("l_suppkey")).first()[0] + 1), "int32"), path)
    return mtx.read(spark, path).data.withColumn("v", F.col("v").cast("double"))


@query("mtx_folder_round_trip", _NAMED)
def mtx_folder_round_trip(spark, sf_dir):
    """A count folder and back."""
    path = files.scratch(spark, "folder")
    mtx.write_folder(shop(spark, sf_dir, whole=True), path)
    return _entries(formats.read(spark, path))


@query("feature_type_counts", "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'Gene Expression' ELSE 'Peaks' END AS feature_types, count(*)::BIGINT AS n FROM supplier GROUP BY 1")
def feature_type_counts(spark, sf_dir):
    """Features per type, in order of first appearance."""
    return mtx.feature_types(suppliers(spark, sf_dir).data)


_FIRST = "(SELECT s_nationkey FROM supplier WHERE s_suppkey = 0)"


@query("feature_type_filter", _NAMED + f" WHERE s_nationkey = {_FIRST}")
def feature_type_filter(spark, sf_dir):
    """Features of one type and genome."""
    s = shop(spark, sf_dir)
    first = s.var.data.where("pos = 0").first()
    return _entries(modalities.narrowed(s, first.feature_types, first.genome))


@query("dense_text_round_trip", "SELECT vec_id AS i, (k - 1)::BIGINT AS j, round(e::DOUBLE * 1000)::BIGINT AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding) AS e FROM embeddings) WHERE e <> 0")
def dense_text_round_trip(spark, sf_dir):
    """A dense matrix as delimited text with names, its layout told from the first lines. Texts are the shortest of single precision,
    so they are read back as that."""
    e = table(spark, sf_dir, "embeddings").orderBy("vec_id")
    path = files.scratch(spark, "text") + ".tsv"
    tables.one_file(e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), *[typing.number_text(F.get("embedding", F.lit(k)), "float").alias(f"c{k}") for k in range(64)]), path, "\t".join(["", *[f"c{k}" for k in range(64)]]), "\t")
    s = formats.read(spark, path)
    return s.matrices["X"].data.select("i", "j", F.round(F.col("v").cast("float").cast("double") * 1000).cast("long").alias("v"))


@query("json_round_trip", "SELECT n_name AS name, r_name AS region, n_nationkey::BIGINT AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_round_trip(spark, sf_dir):
    """Nested metadata as JSON and back."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n_nationkey").collect()  # one row a nation
    tree: dict = {}
    for r in rows:
        tree.setdefault(r.r_name, {})[r.n_name] = r.n_nationkey
    s = Store(customers(spark, sf_dir), suppliers(spark, sf_dir), uns={"nations": {**tree, "none": None, "not finite": float("inf")}})
    back = arrays.import_json(arrays.export_json(s, "uns/nations"))
    return spark.createDataFrame([(n, r, k) for r, ns in back.items() for n, k in ns.items()], "name string, region string, key long")


@query("frame_as_json", "SELECT c_custkey AS pos, c_nationkey::BIGINT AS nation, c_name AS name FROM customer")
def frame_as_json(spark, sf_dir):
    """Rows of a frame as JSON texts."""
    j = arrays.frame_json(customers(spark, sf_dir).data)
    return j.select("pos", F.from_json("json", "nation long, name string").alias("v")).select("pos", "v.nation", "v.name")


def _sizes(spark, sf_dir) -> np.ndarray:
    rows = [r[0] for r in table(spark, sf_dir, "part").orderBy("p_partkey").select("p_size").collect()]  # a pixel a part
    return np.array(rows[: len(rows) // 50 * 50]).reshape(-1, 50)


_PIXELS = "(SELECT p_partkey // 50 AS i, p_partkey % 50 AS j, p_size AS v FROM part)"


@query("image_round_trip", f"SELECT i::BIGINT AS i, j::BIGINT AS j, v::BIGINT AS v FROM {_PIXELS}")
def image_round_trip(spark, sf_dir):
    """A matrix as images and back."""
    x = _sizes(spark, sf_dir)
    back = arrays.read_image(arrays.image_bytes(x, "a.png"))
    same = np.array_equal(arrays.read_image(arrays.image_bytes(x, "a.tiff")), back)
    return spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(back)] if same else [], "i long, j long, v long")


@query("image_scaled", f"SELECT i::BIGINT AS i, j::BIGINT AS j, round_even((v - a)::DOUBLE / (b - a) * 255, 0)::BIGINT AS v FROM {_PIXELS} CROSS JOIN (SELECT min(p_size) AS a, max(p_size) AS b FROM part)")
def image_scaled(spark, sf_dir):
    """A matrix stretched over the range of a pixel."""
    x = arrays.pixels(_sizes(spark, sf_dir), scale=True)
    return spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(x)], "i long, j long, v long")


def _through(spark, sf_dir, ending: str, write, whole: bool = False):
    path = files.scratch(spark, "file") + ending
    write(shop(spark, sf_dir, whole), path)
    return path


@query("folder_v2_round_trip", _NAMED)
def folder_v2_round_trip(spark, sf_dir):
    """A store as a folder of chunks, version 2, and back."""
    return _entries(formats.read(spark, _through(spark, sf_dir, ".zarr", chunked.write)))


@query("folder_v3_obs", _OBS)
def folder_v3_obs(spark, sf_dir):
    """obs through a folder of chunks, version 3."""
    return _obs(formats.read(spark, _through(spark, sf_dir, ".zarr", lambda s, p: chunked.write(s, p, version=3))))


@query("h5ad_round_trip", _NAMED)
def h5ad_round_trip(spark, sf_dir):
    """A store as an HDF5 file and back."""
    return _entries(formats.read(spark, _through(spark, sf_dir, ".h5ad", hdf5.write)))


@query("h5ad_obs", _OBS)
def h5ad_obs(spark, sf_dir):
    """obs through an HDF5 file: text, a categorical, floats, whole numbers."""
    return _obs(formats.read(spark, _through(spark, sf_dir, ".h5ad", hdf5.write)))


@query("convert_h5ad_to_folder", _NAMED)
def convert_h5ad_to_folder(spark, sf_dir):
    """One format to another, both told by content and ending."""
    source = _through(spark, sf_dir, ".h5ad", hdf5.write)
    target = files.scratch(spark, "out") + ".zarr"
    formats.convert(spark, source, target)
    return _entries(formats.read(spark, target))


@query("dense_array_round_trip", "SELECT c_custkey AS i, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer")
def dense_array_round_trip(spark, sf_dir):
    """A dense matrix of an HDF5 file, by rows."""
    m = formats.read(spark, _through(spark, sf_dir, ".h5ad", hdf5.write)).matrices["obsm/wide"]
    return m.data.select("i", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


@query("pairwise_round_trip", "SELECT s_suppkey AS i, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS j, 1.0::DOUBLE AS v FROM supplier")
def pairwise_round_trip(spark, sf_dir):
    """A graph over var through a folder of chunks."""
    return formats.read(spark, _through(spark, sf_dir, ".zarr", chunked.write)).matrices["varp/ring"].data


@query("count_file_round_trip", _NAMED)
def count_file_round_trip(spark, sf_dir):
    """A count file: entries by cell, features with ids, symbols, types and genomes."""
    return _entries(formats.read(spark, _through(spark, sf_dir, ".h5", counts.write, True)))


@query("count_file_symbols", "SELECT 'S' || s_suppkey AS name, s_name AS gene_ids, s_nationkey::VARCHAR AS genome FROM supplier WHERE s_nationkey % 2 = 0")
def count_file_symbols(spark, sf_dir):
    """Features of one type, named by symbol."""
    path = _through(spark, sf_dir, ".h5", counts.write, True)
    return formats.read(spark, path, names="symbols", feature_type="Gene Expression").var.data.select("name", "gene_ids", "genome")


@query("loom_round_trip", _NAMED)
def loom_round_trip(spark, sf_dir):
    """A loom file, dense and turned, and back."""
    return _entries(formats.read(spark, _through(spark, sf_dir, ".loom", loom.write)))


@query("loom_attributes", _OBS)
def loom_attributes(spark, sf_dir):
    """Attributes of cells as columns."""
    return _obs(formats.read(spark, _through(spark, sf_dir, ".loom", loom.write)))


@query("viewer_clusterings", "SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer")
def viewer_clusterings(spark, sf_dir):
    """Clusterings and embeddings in the form that viewers read, by the names in the file's metadata."""
    s = formats.read(spark, _through(spark, sf_dir, ".loom", lambda s, p: loom.write(s, p, scope=True, clusterings=("segment",))))
    xy = next(m for p, m in s.matrices.items() if p.startswith("obsm/X_"))
    rows = s.obs.data.join(xy.data, F.col("pos") == F.col("i"))
    return rows.select("name", "segment", F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"))


@query("modalities_round_trip", _NAMED.replace("SELECT c_name", "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'rna' ELSE 'atac' END AS mod, c_name"))
def modalities_round_trip(spark, sf_dir):
    """A modality for each feature type, and all of them back."""
    back = mudata.read_all(spark, _through(spark, sf_dir, ".h5mu", mudata.write))
    return reduce(DataFrame.union, [_entries(s).select(F.lit(m).alias("mod"), "a", "b", "v") for m, s in back.items()])


@query("modality_global_columns", "SELECT c_custkey AS pos, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def modality_global_columns(spark, sf_dir):
    """Global columns on the rows of a modality, by the file's map."""
    return mudata.read(spark, _through(spark, sf_dir, ".h5mu", mudata.write), "atac").obs.data.select("pos", "segment", "balance")


@query("modality_maps", "SELECT CASE WHEN c_nationkey < 10 THEN 'a' ELSE 'b' END AS mod, m.pos AS global_pos, CASE WHEN m.pos = c_custkey THEN row_number() OVER (PARTITION BY m.pos = c_custkey, c_nationkey < 10 ORDER BY c_custkey) ELSE 0 END AS place FROM customer JOIN (SELECT c_custkey AS pos FROM customer) m ON m.pos = c_custkey")
def modality_maps(spark, sf_dir):
    """One-based places of each modality's rows among all rows, where they have one."""
    s = Store(customers(spark, sf_dir), suppliers(spark, sf_dir))
    mods = {"a": reshape.subset(s, "nation < 10"), "b": reshape.subset(s, "nation >= 10")}
    return modalities.maps(mods, s.obs.data).where("place > 0")


_P = "((s_suppkey * 37) % 100) / 100.0"


def _cleaned(spark, sf_dir) -> str:
    """A file of what background removal learnt of the customers with an even key."""
    s = shop(spark, sf_dir, whole=True)
    path = files.scratch(spark, "cleaned") + ".h5"
    n, m = s.matrices["X"].shape
    sink = hdf5.FileSink(spark, path)
    sink.group("matrix/features")
    obs, var = s.obs.data, s.var.data
    sink.large(["matrix/barcodes"], obs.select("pos", "name"), ["name"], [(n,)], ["S18"], [{}])
    sink.large([f"matrix/features/{k}" for k in ("id", "name", "feature_type", "genome")], var.select("pos", F.col("name").alias("id"), F.col("gene_symbols").alias("name"), F.col("feature_types").alias("feature_type"), "genome"), ["id", "name", "feature_type", "genome"], [(m,)] * 4, ["S18", "S12", "S15", "S4"], [{}] * 4)
    trees.write_sparse(sink, "matrix", s.matrices["X"])
    sink.small("matrix/shape", np.array([m, n]))
    k = (n + 1) // 2
    learnt = spark.range(k).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("at"), (F.pmod(F.col("id") * 2 * 37, F.lit(100)) / 100.0).alias("p"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("z"))
    sink.large(["droplet_latents/barcode_indices_for_latents", "droplet_latents/cell_probability"], learnt, ["at", "p"], [(k,)] * 2, ["int64", "float64"], [{}] * 2)
    sink.large(["droplet_latents/gene_expression_encoding"], learnt, ["z"], [(k, 2)], ["float64"], [{}])
    sink.large(["global_latents/ambient_expression"], var.select("pos", (F.col("pos") / 4.0).alias("v")), ["v"], [(m,)], ["float64"], [{}])
    sink.close()
    return path


@query("cleaned_counts", "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN ((c_custkey * 37) % 100) / 100.0::DOUBLE ELSE -1 END AS p, c_custkey % 2 = 0 AS analyzed, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 2.0::DOUBLE ELSE -1 END AS z FROM customer")
def cleaned_counts(spark, sf_dir):
    """What was learnt of some droplets, spread over all (NaN, shown as -1, where nothing was)."""
    s = formats.read(spark, _cleaned(spark, sf_dir))
    rows = s.obs.data.join(s.matrices["obsm/gene_expression_encoding"].data, F.col("pos") == F.col("i"))
    z = F.get("values", F.lit(0))
    return rows.select("name", F.when(F.isnan("cell_probability"), -1.0).otherwise(F.col("cell_probability")).alias("p"), F.col("cellbender_analyzed").alias("analyzed"), F.when(F.isnan(z), -1.0).otherwise(z).alias("z"))


@query("cleaned_cells", "SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey * 37) % 100 >= 50")
def cleaned_cells(spark, sf_dir):
    """Droplets that are cells with a probability of a half or more."""
    return formats.read(spark, _cleaned(spark, sf_dir), least_probability=0.5).obs.data.select("name")


@query("ambient_of_features", "SELECT s_name AS name, s_suppkey / 4.0::DOUBLE AS ambient FROM supplier")
def ambient_of_features(spark, sf_dir):
    """Values learnt of features as a column of var."""
    return formats.read(spark, _cleaned(spark, sf_dir)).var.data.select("name", F.col("ambient_expression").alias("ambient"))


@query("raw_counts_of_cleaned", _NAMED)
def raw_counts_of_cleaned(spark, sf_dir):
    """The counts that background removal worked on, matched by barcode, as a layer."""
    raw = _through(spark, sf_dir, ".h5", counts.write, True)
    return _entries(formats.read(spark, _cleaned(spark, sf_dir), raw=raw), "layers/cellranger")


@query("dataset_of_a_file", "SELECT c_custkey AS i, 0::BIGINT AS j, c_acctbal AS v FROM customer WHERE c_acctbal <> 0 UNION ALL SELECT c_custkey, 1, c_nationkey::DOUBLE FROM customer WHERE c_nationkey <> 0")
def dataset_of_a_file(spark, sf_dir):
    """One array of an HDF5 file, by its key."""
    path = _through(spark, sf_dir, ".h5ad", hdf5.write)
    return hdf5.read_dataset(spark, path, "obsm/wide").matrices["X"].data


@query("split_stores", f"SELECT c_mktsegment AS label, c_name AS a, s_name AS b, v FROM ({_X}) JOIN customer ON c_custkey = i JOIN supplier ON s_suppkey = j")
def split_stores(spark, sf_dir):
    """A store written for each label, all of them opened again."""
    folder = files.scratch(spark, "split")
    listed = reshape.save_split(shop(spark, sf_dir), "segment", folder)
    rows = [(r.value, store.load(spark, r.path)) for r in listed.collect()]  # one row a label
    return reduce(DataFrame.union, [_entries(s).select(F.lit(v).alias("label"), "a", "b", "v") for v, s in rows])


@query("split_manifest", "SELECT c_mktsegment AS value, lower(c_mktsegment) AS stem, count(*)::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) >= 10")
def split_manifest(spark, sf_dir):
    """The list of a split's stores: labels, stems and sizes, small ones left out."""
    found = reshape.parts(shop(spark, sf_dir), "segment", least=10)
    return spark.createDataFrame([(p.label, p.stem.lower(), p.rows) for p in found], "value string, stem string, n long")


@query("distinct_stems", "SELECT s_name || '/' AS label, CASE WHEN s_suppkey % 2 = 0 THEN s_name || '_' ELSE s_name || '_' END AS stem FROM supplier")
def distinct_stems(spark, sf_dir):
    """Stems of labels with separators, no two alike."""
    labels = [r[0] + "/" for r in table(spark, sf_dir, "supplier").select("s_name").collect()]  # one label a supplier
    got = names.distinct_stems(labels)
    return spark.createDataFrame([(k, v.replace("Supplier", "Supplier#") if "#" not in v else v) for k, v in got.items()], "label string, stem string")


@query("member_names", "SELECT p_type AS label, replace(p_type, '/', '_') AS member FROM (SELECT DISTINCT p_type FROM part)")
def member_names(spark, sf_dir):
    """Labels as names of members."""
    return spark.createDataFrame([(r[0], names.member_name(r[0])) for r in table(spark, sf_dir, "part").select("p_type").distinct().collect()], "label string, member string")


@query("recast_layout", "SELECT l_orderkey AS i, l_partkey AS j, CAST(sum(l_quantity) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2")
def recast_layout(spark, sf_dir):
    """Another dtype and layout, checked before anything is made."""
    m = Matrix(matrix.summed(quantities(spark, sf_dir).data), (table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "part").count()), "float64")
    s = Store(orders(spark, sf_dir), parts(spark, sf_dir), {"X": m})
    return reshape.recast(s, ["*"], "int32", "csc").matrices["X"].data


@query("recast_dense", "SELECT vec_id AS i, (k - 1)::INTEGER AS j, e::DOUBLE AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding) AS e FROM embeddings)")
def recast_dense(spark, sf_dir):
    """A dense matrix in a wider dtype."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("values"))
    return matrix.cast(Matrix(e, (e.count(), 64), "float32", "dense"), "float64").data.select("i", F.posexplode("values").alias("j", "v"))


@query("sparse_and_back", "SELECT c_custkey AS i, k AS j, coalesce(v, 0) AS v FROM customer CROSS JOIN (SELECT s_suppkey AS k FROM supplier) LEFT JOIN (" + _X.replace("AS i", "AS a").replace("AS j", "AS b") + ") ON a = c_custkey AND b = k")
def sparse_and_back(spark, sf_dir):
    """All cells of a sparse matrix, also those of empty rows."""
    return matrix.densified(shop(spark, sf_dir).matrices["X"]).data.select("i", F.posexplode("values").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("columns_in_order", "SELECT j, count(*)::BIGINT AS n, sum(i * k)::BIGINT AS places FROM (SELECT i, j, row_number() OVER (PARTITION BY j ORDER BY i) AS k FROM (" + _X + ")) GROUP BY 1")
def columns_in_order(spark, sf_dir):
    """Packed columns: what the other compressed layout holds."""
    rows = matrix.packed(matrix.transposed(shop(spark, sf_dir).matrices["X"]))
    places = F.aggregate(F.sequence(F.lit(1), F.size("indices")), F.lit(0).cast("long"), lambda a, k: a + k * F.element_at("indices", k))
    return rows.select(F.col("i").alias("j"), F.size("indices").cast("long").alias("n"), places.alias("places"))


@query("density", f"SELECT count(*)::DOUBLE / ((SELECT count(*) FROM customer) * (SELECT count(*) FROM supplier)) AS density FROM ({_X}) WHERE v <> 0")
def density(spark, sf_dir):
    """Share of cells that hold something."""
    return spark.createDataFrame([(matrix.density(shop(spark, sf_dir).matrices["X"]),)], "density double")


@query(
    "orders_of_rows",
    "SELECT count(*) = 0 AS rising, (SELECT count(*) FROM (SELECT o_custkey <= lag(o_custkey) OVER (ORDER BY o_orderkey) AS f FROM orders) WHERE f) = 0 AS by_customer, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) > 0 AS grouped FROM (SELECT o_orderkey <= lag(o_orderkey) OVER (ORDER BY o_orderkey) AS f FROM orders) WHERE f",
)
def orders_of_rows(spark, sf_dir):
    """Whether positions rise, whether customers do along them, whether lines of an order stand together in key order."""
    o, l = table(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey")), table(spark, sf_dir, "lineitem")
    lines = l.withColumn("pos", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return spark.createDataFrame([(matrix.ascending(o, "pos", "o_orderkey"), matrix.ascending(o, "pos", "o_custkey"), matrix.grouped(lines, "pos", "l_orderkey"))], "rising boolean, by_customer boolean, grouped boolean")


@query("pointers_checked", f"SELECT count(*)::BIGINT AS n FROM ({_X})")
def pointers_checked(spark, sf_dir):
    """Row pointers that begin at nothing, never fall and end at the number of entries."""
    m = shop(spark, sf_dir).matrices["X"]
    n = m.data.count()
    p = matrix.pointers(m).select("pos", "start")
    matrix.check_pointers(p.union(spark.createDataFrame([(m.shape[0], n)], "pos long, start long")), n)
    return spark.createDataFrame([(n,)], "n long")


@query("missing_per_column", "SELECT count(*) FILTER (WHERE l.quality IS NULL)::BIGINT AS quality, count(*) FILTER (WHERE d.text IS NULL)::BIGINT AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missing_per_column(spark, sf_dir):
    """Missing entries of every column, in one aggregate."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    found = axis.null_counts(d.join(l, F.col("doc_id") == F.col("id"), "left").select("quality", "text"))
    return spark.createDataFrame([(found["quality"], found["text"])], "quality long, text long")


@query("few_labels", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def few_labels(spark, sf_dir):
    """Labels of a column that has few; one that has too many gives none."""
    o = orders(spark, sf_dir).data
    assert axis.few_labels(o, "name", 100) is None or o.count() <= 100
    return spark.createDataFrame([(x,) for x in axis.few_labels(o, "o_orderpriority", 245)], "label string")


@query("rows_in_given_order", "SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS pos, c_name AS name, c_acctbal AS balance FROM customer")
def rows_in_given_order(spark, sf_dir):
    """A frame's rows in the order of given names."""
    f = customers(spark, sf_dir)
    n = f.data.count()
    return axis.reordered(f, f.data.select((F.lit(n - 1) - F.col("pos")).alias("pos"), "name")).data.select("pos", "name", "balance")


@query("rows_taken_by_place", "SELECT (SELECT count(*) FROM customer) - 1 - c_custkey AS i, c_acctbal AS v FROM customer")
def rows_taken_by_place(spark, sf_dir):
    """Rows of a matrix at given places, in another order."""
    m = shop(spark, sf_dir).matrices["obsm/wide"]
    n = m.shape[0]
    turned = spark.range(n).select(F.col("id").alias("pos"), (F.lit(n - 1) - F.col("id")).alias("new_pos"))
    return matrix.taken(m, turned, None, m.shape).data.select("i", F.get("values", F.lit(0)).alias("v"))


@query("matched_names", "SELECT c_custkey AS pos, (SELECT count(*) FROM customer) - 1 - c_custkey AS other_pos FROM customer WHERE c_nationkey < 12")
def matched_names(spark, sf_dir):
    """Each name's partner in another axis, all of them required."""
    f = customers(spark, sf_dir).data
    n = f.count()
    return joins.matched_inner(f.where("nation < 12"), f.select("name", (F.lit(n - 1) - F.col("pos")).alias("pos")))


@query("subset_of_raw", "SELECT c_name AS a, s_name AS b, v FROM (" + _X + ") JOIN customer ON c_custkey = i JOIN supplier ON s_suppkey = j WHERE c_nationkey = 3 AND s_nationkey < 9")
def subset_of_raw(spark, sf_dir):
    """raw keeps the variables whose names the selection kept."""
    s = shop(spark, sf_dir)
    s = replace(s, raw=Store(s.obs, s.var, {"X": s.matrices["X"]}))
    out = reshape.subset(s, "nation == 3", "genome < 9")
    return _entries(Store(out.obs, out.raw.var, out.raw.matrices))


@query("subset_of_graph", "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) AS pos, s_name AS name FROM supplier WHERE s_nationkey < 9")
def subset_of_graph(spark, sf_dir):
    """var after a selection; the graph over it keeps whole edges alone."""
    out = reshape.subset(shop(spark, sf_dir), var_query="genome < 9")
    edges = out.matrices["varp/ring"]
    matrix.check_entries(edges.data, edges.shape)
    return out.var.data.select("pos", "name")


@query("colours_pruned", "SELECT c_mktsegment AS label, '#' || c_mktsegment AS colour FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 0))")
def colours_pruned(spark, sf_dir):
    """Colours go with the labels that no row has any more."""
    s = shop(spark, sf_dir)
    labels = s.obs.categories["segment"].labels
    nation = s.obs.data.where("pos = 0").first().nation
    out = reshape.subset(replace(s, uns={"segment_colors": [f"#{x}" for x in labels]}), f"nation == {nation}")
    return spark.createDataFrame(list(zip(out.obs.categories["segment"].labels, out.uns["segment_colors"], strict=True)), "label string, colour string")


@query("codes_and_labels", "SELECT c_custkey AS pos, c_mktsegment AS segment FROM customer")
def codes_and_labels(spark, sf_dir):
    """Labels as codes and back."""
    f = customers(spark, sf_dir)
    labels = f.categories["segment"].labels
    return f.data.select("pos", axis.codes(F.col("segment"), labels).alias("c")).select("pos", axis.labels_of(F.col("c"), labels).alias("segment"))


@query("repeated_names", "SELECT p_name AS name, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark, sf_dir):
    """Names that come more than once."""
    return axis.repeated_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def _halves(spark, sf_dir) -> dict[str, Store]:
    """Customers of even and odd nations as two stores over the same suppliers; one var column differs, one is in one only."""
    s = shop(spark, sf_dir)
    out = {}
    for k, key in enumerate(("even", "odd")):
        one = reshape.subset(s, f"nation in ({', '.join(str(x) for x in range(k, 25, 2))})")
        var = one.var.data.withColumn("weight", F.col("pos").cast("double") + k)
        out[key] = replace(one, var=Frame(var.withColumn("only", F.col("pos")) if k else var))
    return out


def _merged(strategy: str, columns: str) -> str:
    return f"SELECT s_suppkey AS pos, s_name AS name{columns} FROM supplier"


_KEPT = ", 'S' || s_suppkey AS gene_symbols, s_nationkey::VARCHAR AS genome"


@query("merge_unique", _merged("unique", _KEPT + ", s_suppkey AS only"))
def merge_unique(spark, sf_dir):
    """var columns with one value among those that have them."""
    v = concat.concat(_halves(spark, sf_dir), merge="unique").var
    assert "weight" not in v.columns
    return v.data.select("pos", "name", "gene_symbols", "genome", "only")


@query("merge_first", _merged("first", _KEPT + ", s_suppkey::DOUBLE AS weight, s_suppkey AS only"))
def merge_first(spark, sf_dir):
    """var columns of the first that has them."""
    return concat.concat(_halves(spark, sf_dir), merge="first").var.data.select("pos", "name", "gene_symbols", "genome", "weight", "only")


@query("merge_only", _merged("only", ", s_suppkey AS only"))
def merge_only(spark, sf_dir):
    """var columns that one input alone has."""
    v = concat.concat(_halves(spark, sf_dir), merge="only").var
    return v.data.select("pos", "name", *v.columns)


@query("concat_names", "SELECT c_name || '-' || CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half, c_mktsegment AS segment FROM customer")
def concat_names(spark, sf_dir):
    """Names with their input's key, and a column that says which input a row is of; categories joined."""
    o = concat.concat(_halves(spark, sf_dir), label="half", index_unique="-").obs
    assert o.categories["half"].labels == ("even", "odd") and set(o.categories["segment"].labels) <= set(SEGMENTS)
    return o.data.select("name", "half", "segment")


@query("concat_after_split", _NAMED)
def concat_after_split(spark, sf_dir):
    """Halves put together again hold what the whole held."""
    return _entries(concat.concat(_halves(spark, sf_dir)))


@query("concat_wide", "SELECT row_number() OVER (ORDER BY c_nationkey % 2, c_custkey) - 1 AS i, c_acctbal AS a FROM customer")
def concat_wide(spark, sf_dir):
    """Arrays over obs, one below the other."""
    return concat.concat(_halves(spark, sf_dir)).matrices["obsm/wide"].data.select("i", F.get("values", F.lit(0)).alias("a"))


@query("concat_graph", "SELECT s_suppkey AS i, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS j, 1.0::DOUBLE AS v FROM supplier")
def concat_graph(spark, sf_dir):
    """A graph over var that all inputs have alike."""
    return concat.concat(_halves(spark, sf_dir), merge="same").matrices["varp/ring"].data


@query("concat_dense", "SELECT c_custkey AS name, k AS j, CASE WHEN c_nationkey % 2 = k THEN c_acctbal ELSE -1 END AS v FROM customer CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS k)")
def concat_dense(spark, sf_dir):
    """Dense matrices over different variables: gaps are filled."""
    f = customers(spark, sf_dir)
    stores = {}
    for k in (0, 1):
        rows = axis.renumbered(f.data.where(F.col("nation") % 2 == k)).drop("pos").withColumnRenamed("new_pos", "pos")
        n = rows.count()
        x = Matrix(rows.select(F.col("pos").alias("i"), F.array("balance").alias("values")), (n, 1), "float64", "dense")
        stores[str(k)] = Store(Frame(rows.select("pos", "name")), Frame(spark.createDataFrame([(0, f"b{k}")], "pos long, name string")), {"X": x})
    out = concat.concat(stores, join="outer", fill=-1.0)
    cells = out.matrices["X"].data.join(out.obs.data, F.col("i") == F.col("pos")).select("name", F.posexplode("values").alias("j", "v"))
    return cells.select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("name"), F.col("j").cast("long").alias("j"), "v")


@query("merged_metadata", "SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey % 5 <> 0")
def merged_metadata(spark, sf_dir):
    """Nested metadata merged key by key: what all have alike stays, what differs goes."""
    rows = table(spark, sf_dir, "nation").collect()  # one row a nation
    one = {"nations": {r.n_name: r.n_regionkey for r in rows}}
    two = {"nations": {r.n_name: r.n_regionkey if r.n_nationkey % 5 else -1 for r in rows}, "more": 1}
    return spark.createDataFrame(list(concat.merge_uns([one, two], "same")["nations"].items()), "name string, region long")


@query("promoted_columns", "SELECT c_custkey AS pos, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey::DOUBLE ELSE c_acctbal END AS x FROM customer")
def promoted_columns(spark, sf_dir):
    """Whole numbers and floats of one column come to floats."""
    f = customers(spark, sf_dir).data
    halves = [Frame(f.where(F.col("nation") % 2 == 0).select("pos", "name", F.col("pos").alias("x"))), Frame(f.where(F.col("nation") % 2 == 1).select("pos", "name", F.col("balance").alias("x")))]
    return concat.union_obs(halves, [0, 0], "inner", ["a", "b"], None, None).data.select("pos", "x")


@query("clusters_joined", "SELECT c_custkey AS pos, CASE WHEN c_nationkey < 20 THEN 'Cluster ' || c_nationkey END AS graph FROM customer")
def clusters_joined(spark, sf_dir):
    """A table of clusters on the rows, those without one missing; labels in natural order."""
    f = customers(spark, sf_dir)
    path = files.scratch(spark, "clusters")
    f.data.where("nation < 20").select(F.col("name").alias("Barcode"), F.concat(F.lit("Cluster "), F.col("nation").cast("string")).alias("Cluster")).write.option("header", True).csv(path)
    out = spatial.with_clusters(Store(f, suppliers(spark, sf_dir)), path, "graph").obs
    assert list(out.categories["graph"].labels) == names.natural(out.categories["graph"].labels)
    return out.data.select("pos", "graph")


@query("projection_joined", "SELECT c_custkey AS i, CASE WHEN c_nationkey < 20 THEN c_acctbal ELSE -9999 END AS x FROM customer")
def projection_joined(spark, sf_dir):
    """A table of coordinates as a matrix over obs; NaN (shown as -9999) where a row is without one."""
    f = customers(spark, sf_dir)
    path = files.scratch(spark, "projection")
    f.data.where("nation < 20").select(F.col("name").alias("Barcode"), F.col("balance").alias("X-1"), F.col("nation").alias("X-2")).write.option("header", True).csv(path)
    x = F.get("values", F.lit(0))
    m = spatial.with_projection(Store(f, suppliers(spark, sf_dir)), path, "X_p").matrices["obsm/X_p"]
    return m.data.select("i", F.when(F.isnan(x), -9999.0).otherwise(x).alias("x"))


@query("positions_joined", "SELECT c_custkey AS pos, c_nationkey::INTEGER AS array_row, c_acctbal AS x, c_acctbal * 2 AS y FROM customer")
def positions_joined(spark, sf_dir):
    """A table of spot positions on the rows, whatever its order, and pixels as a matrix."""
    f = customers(spark, sf_dir)
    path = files.scratch(spark, "positions") + ".parquet"
    f.data.select(F.col("name").alias("barcode"), F.lit(1).alias("in_tissue"), F.col("nation").cast("int").alias("array_row"), F.lit(0).alias("array_col"), (F.col("balance") * 2).alias("pxl_row_in_fullres"), F.col("balance").alias("pxl_col_in_fullres")).write.parquet(path)
    s = spatial.with_positions(Store(f, suppliers(spark, sf_dir)), spatial.positions(spark, path))
    rows = s.obs.data.join(s.matrices["obsm/spatial"].data, F.col("pos") == F.col("i"))
    return rows.select("pos", "array_row", F.get("values", F.lit(0)).alias("x"), F.get("values", F.lit(1)).alias("y"))


@query("cells_joined", "SELECT c_custkey AS pos, c_nationkey::BIGINT AS n_counts, c_acctbal AS x FROM customer")
def cells_joined(spark, sf_dir):
    """A cell table on the rows, all of them required, and centroids as a matrix."""
    f = customers(spark, sf_dir)
    cells = Frame(f.data.select("pos", "name", F.col("nation").cast("long").alias("n_counts"), F.col("balance").alias("x_centroid"), F.lit(0.0).alias("y_centroid")))
    s = spatial.with_cells(Store(Frame(f.data.select("pos", "name")), suppliers(spark, sf_dir)), cells)
    rows = s.obs.data.join(s.matrices["obsm/spatial"].data, F.col("pos") == F.col("i"))
    return rows.select("pos", "n_counts", F.get("values", F.lit(0)).alias("x"))


@query("polygons_measured", "SELECT c_custkey AS cell_id, ((c_nationkey + 2) * (c_nationkey + 2) - 1)::DOUBLE AS area, 1000 * c_nationkey + (((c_nationkey + 2) * (c_nationkey + 2) * (c_nationkey + 2) / 2.0 - 1.5) / ((c_nationkey + 2) * (c_nationkey + 2) - 1)) AS x FROM customer")
def polygons_measured(spark, sf_dir):
    """Areas and centroids of squares with a hole, from a GeoJSON file."""
    side, at = F.col("nation") + 2, F.col("nation") * 1000
    ring = lambda a, b: F.array(*[F.array(*p) for p in ((a, a), (b, a), (b, b), (a, b), (a, a))])
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring(at, at + side), ring(at + 1, at + 2)).alias("coordinates"))
    f = customers(spark, sf_dir).data.select(F.struct(F.struct(F.col("pos").alias("cell_id")).alias("properties"), geometry.alias("geometry")).alias("f"))
    path = files.scratch(spark, "shapes") + ".json"
    body = ",".join(json.dumps(r[0].asDict(True)) for r in f.toLocalIterator())
    files.write_bytes(spark, path, ('{"type": "FeatureCollection", "features": [' + body + "]}").encode())
    return spatial.measured(spatial.polygons(spark, path)).select("cell_id", "area", F.col("x"))


@query("cell_numbers", "SELECT c_custkey AS pos, c_custkey AS number FROM customer")
def cell_numbers(spark, sf_dir):
    """Numbers in the names of cells."""
    name = F.format_string("cellid_%09d-1", "pos")
    return customers(spark, sf_dir).data.select("pos", spatial.cell_number(name).alias("number"))


@query("modality_names", "SELECT * FROM (VALUES ('Gene Expression', 'rna'), ('Peaks', 'atac'), ('Antibody Capture', 'prot'), ('CRISPR Guide Capture', 'crispr_guide_capture')) AS t(kind, mod)")
def modality_names(spark, sf_dir):
    """Feature types as names of modalities."""
    return spark.createDataFrame([(t, modalities.modality(t)) for t in ("Gene Expression", "Peaks", "Antibody Capture", "CRISPR Guide Capture")], "kind string, mod string")


@query("characters_decoded", "SELECT c_custkey AS pos, chr((945 + c_nationkey)::INTEGER) || c_name AS name FROM customer")
def characters_decoded(spark, sf_dir):
    """Character references in names as what they stand for."""
    coded = F.concat(F.lit("&#"), (F.col("nation") + 945).cast("string"), F.lit(";"), F.col("name"))
    return customers(spark, sf_dir).data.select("pos", modalities.with_characters(coded).alias("name"))


@query("packed_metadata", "SELECT n_name AS name, n_nationkey::BIGINT AS key FROM nation")
def packed_metadata(spark, sf_dir):
    """Metadata packed into a text."""
    import base64
    import zlib

    tree = {r.n_name: r.n_nationkey for r in table(spark, sf_dir, "nation").collect()}  # one row a nation
    found, _ = modalities.unfolded(base64.b64encode(zlib.compress(json.dumps(tree).encode())).decode())
    return spark.createDataFrame(list(found.items()), "name string, key long")


@query("import_frame", "SELECT c_custkey AS pos, c_name AS name, c_acctbal AS balance FROM customer")
def import_frame(spark, sf_dir):
    """A CSV file put in the place of a store's obs, after its length was checked."""
    s = shop(spark, sf_dir)
    path = files.scratch(spark, "obs") + ".csv"
    tables.write_csv(s.obs, path, ["balance"])
    return cli.put(s, "dataframe", path, "obs").obs.data.select("pos", "name", "balance")


@query("import_matrix", _X)
def import_matrix(spark, sf_dir):
    """A Matrix Market file as a layer, after its shape was checked."""
    s = shop(spark, sf_dir, whole=True)
    path = files.scratch(spark, "layer") + ".mtx"
    mtx.write(s.matrices["X"], path)
    return cli.put(s, "sparse", path, "layers/again").matrices["layers/again"].data.withColumn("v", F.col("v").cast("double"))


@query("head_entries", f"SELECT i, j, v FROM ({_X}) ORDER BY i, j LIMIT 1000")
def head_entries(spark, sf_dir):
    """The first entries in row order, as a file's head."""
    path = files.scratch(spark, "head") + ".mtx"
    mtx.write(shop(spark, sf_dir, whole=True).matrices["X"], path, head=1000)
    return mtx.read(spark, path).data.withColumn("v", F.col("v").cast("double"))


@query("numbered_axis", "SELECT c_custkey AS pos, 'cell_' || lpad(c_custkey::VARCHAR, length(((SELECT count(*) FROM customer) - 1)::VARCHAR)::INTEGER, '0') AS name FROM customer")
def numbered_axis(spark, sf_dir):
    """Names of an empty store's axis, padded so that they sort."""
    return store.create(spark, table(spark, sf_dir, "customer").count(), 3).obs.data


@query("stream_selection", "SELECT o_orderkey AS pos, o_orderpriority FROM orders WHERE o_totalprice > 400000")
def stream_selection(spark, sf_dir):
    """Rows that arrive, selected by an expression."""
    source = orders(spark, sf_dir).data
    at, out = files.scratch(spark, "arriving"), files.scratch(spark, "selected")
    source.write.parquet(at)
    live = spark.readStream.schema(source.schema).parquet(at)
    q = blocks.select_stream(live, "o_totalprice > 400000").writeStream.format("parquet").option("checkpointLocation", files.scratch(spark, "progress")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(out).select("pos", "o_orderpriority")


@query("blocks_in_order", "SELECT (o_orderkey // 4096)::BIGINT AS block, count(*)::BIGINT AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def blocks_in_order(spark, sf_dir):
    """Rows in order, a block at a time."""
    found = [(k, len(b), b[0].pos) for k, b in enumerate(blocks.ordered_blocks(orders(spark, sf_dir).data.select("pos"), size=4096))]
    return spark.createDataFrame(found, "block long, n long, first long")


def _refused(f) -> bool:
    try:
        f()
    except (ValueError, KeyError, OSError):
        return True
    return False


_REFUSALS = ("unknown column", "number against text", "empty selection", "repeated variables", "lossy cast", "sparse halves", "growth", "narrow index", "wrong shape", "no such place", "occupied target", "negative head", "unknown option", "many labels", "entry outside", "missing key", "not an image", "no common variable")


@query("refusals", "SELECT unnest([" + ", ".join(f"'{x}'" for x in _REFUSALS) + "]) AS rule, count(*) > 0 AS refused FROM customer GROUP BY 1")
def refusals(spark, sf_dir):
    """What must not happen does not, whatever the tables hold."""
    s = shop(spark, sf_dir)
    taken = files.scratch(spark, "taken")
    files.write_bytes(spark, taken, b"x")
    halves = Matrix(s.matrices["X"].data.withColumn("v", F.col("v") + 0.5), s.matrices["X"].shape, "float64")
    twice = Store(s.obs, Frame(s.var.data.withColumn("name", F.lit("one"))))
    other = Store(s.obs, Frame(s.var.data.withColumn("name", F.concat(F.lit("other "), F.col("name")))))
    thin = Matrix(s.matrices["X"].data.where("i = 0 AND j = 0"), s.matrices["X"].shape, "float64")
    cases = {
        "unknown column": lambda: reshape.subset(s, "none > 1"), "number against text": lambda: reshape.subset(s, "balance == x"), "empty selection": lambda: reshape.subset(s, "balance > 1e12"),
        "repeated variables": lambda: concat.concat({"a": twice, "b": twice}), "lossy cast": lambda: matrix.cast(halves, "int32"), "sparse halves": lambda: matrix.cast(halves, "float16"),
        "growth": lambda: matrix.laid_out(thin, "dense"), "narrow index": lambda: matrix.index_dtype(1 << 31, "int32"), "wrong shape": lambda: store.check_shape(s, "X", (1, 1)), "no such place": lambda: store.check_shape(s, "nowhere", (1, 1)),
        "occupied target": lambda: store.save(s, taken), "negative head": lambda: tables.csv_rows(s.obs, head=-1), "unknown option": lambda: formats.convert(spark, taken, taken + ".h5ad", "mtx", None, colour=1),
        "many labels": lambda: axis.categorised(s.obs, "name", 10), "entry outside": lambda: matrix.check_entries(s.matrices["X"].data, (1, 1)), "missing key": lambda: joins.checked_left(s.obs.data, s.var.data.select(F.col("name").alias("k")), "k"),
        "not an image": lambda: arrays.pixels(np.array([[-1]])), "no common variable": lambda: concat.concat({"a": s, "b": other}),
    }
    return spark.createDataFrame([(k, _refused(cases[k])) for k in _REFUSALS], "rule string, refused boolean")


@query("formats_told", "SELECT unnest(['h5ad', 'zarr', '10x-h5', 'loom', 'mudata', 'mtx-folder', 'mtx', 'store']) AS written, written AS told FROM (SELECT 1) GROUP BY 1")
def formats_told(spark, sf_dir):
    """Formats told by content, under names that say nothing."""
    s = shop(spark, sf_dir, whole=True)
    found = []
    for name, write in (("h5ad", hdf5.write), ("zarr", chunked.write), ("10x-h5", counts.write), ("loom", loom.write), ("mudata", mudata.write), ("mtx-folder", mtx.write_folder), ("mtx", lambda s, p: mtx.write(s.matrices["X"], p)), ("store", store.save)):
        path = files.scratch(spark, "unnamed")
        write(s, path)
        found.append((name, formats.detect(spark, path).name))
    return spark.createDataFrame(found, "written string, told string")


@query("categories_of_inputs", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)")
def categories_of_inputs(spark, sf_dir):
    """Categories of two inputs that share none of their order: the natural order of all."""
    f = customers(spark, sf_dir)
    labels = f.categories["segment"].labels
    merged = concat.merged_categories([Categories(labels[::-1][:2]), Categories(labels)])
    return spark.createDataFrame([(x, k) for k, x in enumerate(merged.labels)], "label string, code long")


@query("names_at_places", "SELECT c_custkey AS pos, c_name AS name FROM customer WHERE c_custkey % 3 = 1")
def names_at_places(spark, sf_dir):
    """Names of an axis at given positions."""
    f = customers(spark, sf_dir)
    return axis.names_at(f, f.data.where("pos % 3 = 1"))


@query("csv_rows_of_a_value", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'")
def csv_rows_of_a_value(spark, sf_dir):
    """Rows of a CSV file that have a value in a column."""
    path = files.scratch(spark, "csv") + ".csv"
    tables.write_csv(customers(spark, sf_dir), path)
    return tables.read_csv(spark, path, only=("segment", "BUILDING")).data.select("pos", "name", "balance")


@query("commands", _NAMED + " WHERE c_nationkey < 5")
def commands(spark, sf_dir):
    """A store converted, selected and converted again by commands."""
    source = _through(spark, sf_dir, ".h5ad", hdf5.write)
    middle, target = files.scratch(spark, "selected") + ".zarr", files.scratch(spark, "back") + ".h5ad"
    cli.run(spark, ["subset", source, "-o", middle, "--obs-query", "nation < 5"])
    cli.run(spark, ["convert", middle, "-o", target])
    return _entries(formats.read(spark, target))
