import base64
import json
import struct
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.sources import codecs, counts, formats, hdf5, loom, mudata, trees
from axisframe.sources.store import Categories, Frame, Matrix, Store


def dense(m):
    out = np.zeros(m.shape)
    for r in m.data.collect():
        if m.sparse:
            out[r.i, r.j] += r.v
        else:
            out[r.i] = r["values"]
    return out


def column(frame, c):
    return [r[0] for r in frame.data.orderBy("pos").select(c).collect()]


X = np.array([[1, 0, 3, 0], [0, 0, 4, 5], [2, 0, 0, 6]], float)


@pytest.fixture(scope="module")
def small(spark):
    entries = [(int(i), int(j), int(X[i, j])) for i, j in zip(*np.nonzero(X), strict=True)]
    obs = spark.createDataFrame([(0, "a-1", "t1", 0.5, 1), (1, "b-1", "t2", 1.5, 2), (2, "c-1", "t1", 2.5, 3)], "pos long, name string, cat string, f double, n int")
    var = spark.createDataFrame([(0, "g0", "Gène0", "Gene Expression", "hg"), (1, "g1", "S1", "Peaks", "hg"), (2, "g2", "S2", "Gene Expression", "mm"), (3, "g3", "S3", "Peaks", "mm")], "pos long, name string, gene_symbols string, feature_types string, genome string")
    wide = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "i long, values array<double>")
    graph = spark.createDataFrame([(0, 1, 0.5), (2, 0, 0.25)], "i long, j long, v double")
    m = Matrix(spark.createDataFrame(entries, "i long, j long, v int"), (3, 4), "int32")
    return Store(Frame(obs, {"cat": Categories(("t1", "t2"))}), Frame(var), {"X": m, "layers/d": m, "obsm/X_umap": Matrix(wide, (3, 2), "float64", "dense"), "obsp/g": Matrix(graph, (3, 3), "float64")}, {}, {"title": "t"})


def test_bytes_of_a_small_file(spark, tmp_path):
    """The fixed parts of the format, byte by byte: superblock, symbol table, heap, tree, header messages."""
    path = f"{tmp_path}/a.h5"
    sink = hdf5.FileSink(spark, path)
    sink.small("x", np.array([1.5, 2.5], "<f4"), note="é")
    sink.group("g")
    sink.close()
    raw = open(path, "rb").read()
    assert raw[:8] == hdf5.MAGIC and raw[8:16] == bytes([0, 0, 0, 0, 0, 8, 8, 0]) and struct.unpack_from("<HHI", raw, 16) == (4, 16, 0)
    base, free, end, driver = struct.unpack_from("<4Q", raw, 24)
    assert (base, free, end, driver) == (0, 2**64 - 1, len(raw), 2**64 - 1)
    _, header, cached, _, tree, heap = struct.unpack_from("<QQIIQQ", raw, 56)
    assert cached == 1 and raw[header] == 1 and raw[tree : tree + 4] == b"TREE" and raw[heap : heap + 4] == b"HEAP"
    kind, level, used, left, right = struct.unpack_from("<BBHQQ", raw, tree + 4)
    assert (kind, level, used, left, right) == (0, 0, 1, 2**64 - 1, 2**64 - 1)
    (node,) = struct.unpack_from("<Q", raw, tree + 32)
    assert raw[node : node + 4] == b"SNOD" and struct.unpack_from("<BBH", raw, node + 4) == (1, 0, 2)
    (texts,) = struct.unpack_from("<Q", raw, heap + 24)
    offsets = [struct.unpack_from("<Q", raw, node + 8 + 40 * k)[0] for k in range(2)]
    assert [raw[texts + o :].split(b"\0")[0] for o in offsets] == [b"g", b"x"]
    f = hdf5.File(path)
    assert f.find("x").shape == (2,) and f.find("x").type.raw == "<f4" and hdf5.FileTree(spark, path).attributes("x") == {"note": "é"}


def test_structures_of_other_writers(spark, tmp_path):
    """A newer file, laid out by hand: superblock 2, a header with links, a single-chunk array with LZF and checksum."""
    x = np.arange(12, dtype="<i4").reshape(3, 4)
    packed = b""
    raw = x.tobytes()
    for a in range(0, len(raw), 32):
        part = raw[a : a + 32]
        packed += bytes([len(part) - 1]) + part
    packed += b"\0\0\0\0"
    link = lambda name, to: (6, struct.pack("<BBB", 1, 0, len(name)) + name + struct.pack("<Q", to))

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
        return b"OHDR" + struct.pack("<BBB", 2, 0, len(body)) + body + bytes(4)

    chunk_at, array_at = 48, 48 + 128
    filters = struct.pack("<BB", 2, 2) + struct.pack("<HHHH", hdf5.LZF, 0, 0, 3) + struct.pack("<III", 4, 0, 48) + struct.pack("<HHH", hdf5.CHECKSUM, 0, 0)
    layout = struct.pack("<BBBBB", 4, 2, 2, 3, 1) + bytes([3, 4, 4]) + bytes([1]) + struct.pack("<QI", len(packed), 0) + struct.pack("<Q", chunk_at)
    array = header([(1, struct.pack("<BBBB", 2, 2, 0, 1) + struct.pack("<2Q", 3, 4)), (3, hdf5.type_message(np.dtype("<i4"))), (8, layout), (11, filters)])
    root_at = array_at + 256
    out = hdf5.MAGIC + struct.pack("<BBBB", 2, 8, 8, 0) + struct.pack("<QQQQ", 0, 2**64 - 1, 0, root_at) + bytes(4)
    out = out.ljust(chunk_at, b"\0") + packed
    out = out.ljust(array_at, b"\0") + array
    out = out.ljust(root_at, b"\0") + header([link(b"m", array_at)])
    (tmp_path / "n.h5").write_bytes(out + bytes(64))
    store = hdf5.read_dataset(spark, f"{tmp_path}/n.h5", "m")
    assert dense(store.matrices["X"]).tolist() == x.tolist() and store.matrices["X"].dtype == "int32"
    assert dense(hdf5.read_dataset(spark, f"{tmp_path}/n.h5", "m", transpose=True, dense=True).matrices["X"]).tolist() == x.T.tolist()
    with pytest.raises(ValueError, match=r"m \(3 x 4, int32\)"):
        hdf5.read_dataset(spark, f"{tmp_path}/n.h5")
    with pytest.raises(ValueError):
        hdf5.File(__file__)


def test_codecs_of_chunks():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, 5000).astype("<i4").tobytes()
    import pyarrow as pa

    def blosc(shuffle, code):
        block = 8192
        parts, starts = [], []
        at = 16 + 4 * (-(-len(x) // block))
        for a in range(0, len(x), block):
            raw = x[a : a + block]
            if shuffle:
                raw = codecs.shuffled(raw, 4)
            n = 4 if len(raw) == block else 1
            body = b""
            for k in range(n):
                piece = raw[k * len(raw) // n : (k + 1) * len(raw) // n]
                c = pa.Codec("lz4_raw").compress(piece, asbytes=True) if code == 1 else zlib.compress(piece)
                c = c if len(c) < len(piece) else piece
                body += struct.pack("<i", len(c)) + c
            starts.append(at)
            parts.append(body)
            at += len(body)
        return struct.pack("<BBBBIII", 2, 1, (1 if shuffle else 0) | code << 5, 4, len(x), block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(parts)

    assert codecs.blosc(blosc(True, 1)) == x and codecs.blosc(blosc(False, 3)) == x
    assert codecs.blosc(struct.pack("<BBBBIII", 2, 1, 2, 4, len(x), 8192, len(x) + 16) + x) == x
    assert codecs.unpack(struct.pack("<I", len(x)) + pa.Codec("lz4_raw").compress(x, asbytes=True), "lz4") == x
    bits = np.unpackbits(np.frombuffer(x[:64], np.uint8).reshape(16, 4), axis=1, bitorder="little")
    assert codecs._bits_unshuffled(np.packbits(bits.T, axis=1, bitorder="little").tobytes(), 4) == x[:64]
    # A literal run, then a match of five bytes, three back.
    assert codecs.lzf(bytes([2]) + b"abc" + bytes([3 << 5, 2]), 8) == b"abcabcab" and codecs.blosclz(bytes([2]) + b"abc" + bytes([3 << 5, 2]), 8) == b"abcabcab"


def test_store_round_trip(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "CHUNK", 4)
    formats.by_name("a.h5ad").write(small, f"{tmp_path}/a.h5ad")
    assert formats.detect(spark, f"{tmp_path}/a.h5ad").name == "h5ad"
    back = formats.read(spark, f"{tmp_path}/a.h5ad")
    assert np.array_equal(dense(back.matrices["X"]), X) and back.matrices["X"].dtype == "int32"
    assert column(back.obs, "cat") == ["t1", "t2", "t1"] and back.obs.categories["cat"].labels == ("t1", "t2") and column(back.var, "gene_symbols")[0] == "Gène0"
    assert back.uns == {"title": "t"} and dense(back.matrices["obsm/X_umap"]).tolist() == [[0, 1], [1, 1], [2, 1]]
    assert {(r.i, r.j, r.v) for r in back.matrices["obsp/g"].data.collect()} == {(0, 1, 0.5), (2, 0, 0.25)}


def test_pointers_that_lie_are_refused(spark, tmp_path):
    path = f"{tmp_path}/bad.h5"
    sink = hdf5.FileSink(spark, path)
    sink.small("d", np.arange(3.0))
    sink.small("i", np.arange(3))
    sink.small("p", np.array([0, 2, 1, 3]))
    sink.close()
    tree = hdf5.FileTree(spark, path)
    with pytest.raises(ValueError, match="pointers"):
        trees.entries(spark, tree.array("d"), tree.array("i"), tree.array("p"))


def test_count_file_round_trip(spark, small, tmp_path):
    path = f"{tmp_path}/c.h5"
    counts.write(small, path)
    assert formats.detect(spark, path).name == "10x-h5"
    tree = hdf5.FileTree(spark, path)
    assert tree.array("matrix/barcodes").type.raw == "S3" and trees.whole(tree.array("matrix/shape")).tolist() == [4, 3]
    back = counts.read(spark, path)
    assert np.array_equal(dense(back.matrices["X"]), X) and column(back.obs, "name") == ["a-1", "b-1", "c-1"]
    assert column(back.var, "name") == ["g0", "g1", "g2", "g3"] and column(back.var, "gene_symbols")[0] == "Gène0" and column(back.var, "feature_types") == ["Gene Expression", "Peaks"] * 2
    assert dense(counts.read(spark, path, feature_type="Peaks").matrices["X"]).tolist() == X[:, 1::2].tolist()
    assert column(counts.read(spark, path, names="symbols", genome="mm").var, "name") == ["S2", "S3"]
    with pytest.raises(ValueError, match="no genome"):
        counts.read(spark, path, genome="none")


def test_older_count_files_have_a_group_a_genome(spark, tmp_path):
    path = f"{tmp_path}/v2.h5"
    sink = hdf5.FileSink(spark, path)
    for g in ("hg19", "mm10"):
        for k, v in {"data": np.array([1, 2]), "indices": np.array([0, 1]), "indptr": np.array([0, 1, 2]), "shape": np.array([2, 2]), "barcodes": np.array([b"x", b"y"]), "genes": np.array([b"e1", b"e2"]), "gene_names": np.array([b"n", b"n"])}.items():
            sink.small(f"{g}/{k}", v)
    sink.close()
    with pytest.raises(ValueError, match="hg19, mm10"):
        counts.read(spark, path)
    back = counts.read(spark, path, names="symbols", genome="mm10", make_unique=True)
    assert dense(back.matrices["X"]).tolist() == [[1, 0], [0, 2]] and column(back.var, "name") == ["n", "n-1"]


@pytest.fixture(scope="module")
def cleaned(spark, small, tmp_path_factory):
    """What background removal writes: the counts, and values of the two droplets that it analysed."""
    folder = tmp_path_factory.mktemp("cleaned")
    sink = hdf5.FileSink(spark, f"{folder}/c.h5")
    for k, v in {"data": np.array([1, 3, 5, 6]), "indices": np.array([0, 2, 3, 3]), "indptr": np.array([0, 2, 3, 4]), "shape": np.array([4, 3]), "barcodes": np.array([b"a-1", b"b-1", b"c-1"])}.items():
        sink.small(f"matrix/{k}", v)
    for k in ("id", "name", "feature_type", "genome"):
        sink.small(f"matrix/features/{k}", np.array([f"{k}{j}".encode() for j in range(4)]) if k != "id" else np.array([b"g0", b"g1", b"g2", b"g3"]))
    for k, v in {"barcode_indices_for_latents": np.array([2, 0]), "cell_probability": np.array([0.9, 0.2]), "gene_expression_encoding": np.array([[1.0, 2.0], [3.0, 4.0]])}.items():
        sink.small(f"droplet_latents/{k}", v)
    sink.small("global_latents/ambient_expression", np.array([0.1, 0.2, 0.3, 0.4]))
    sink.small("metadata/features_analyzed_inds", np.array([0, 2]))
    sink.small("metadata/estimator", np.array([b"mckp"]))
    sink.close()
    counts.write(small, f"{folder}/raw.h5")
    return folder


def test_cleaned_counts(spark, cleaned):
    path = f"{cleaned}/c.h5"
    assert formats.detect(spark, path).name == "cellbender"
    s = counts.read_cleaned(spark, path, raw=f"{cleaned}/raw.h5")
    p = column(s.obs, "cell_probability")
    assert p[0] == 0.2 and np.isnan(p[1]) and p[2] == 0.9 and column(s.obs, "cellbender_analyzed") == [True, False, True]
    z = dense(s.matrices["obsm/gene_expression_encoding"])
    assert z[0].tolist() == [3, 4] and np.isnan(z[1]).all() and z[2].tolist() == [1, 2]
    assert column(s.var, "ambient_expression") == [0.1, 0.2, 0.3, 0.4] and column(s.var, "cellbender_analyzed") == [True, False, True, False]
    assert s.uns["cellbender"]["estimator"] == ["mckp"] and np.array_equal(dense(s.matrices["layers/cellranger"]), X)
    kept = counts.read_cleaned(spark, path, least_probability=0.5)
    assert column(kept.obs, "name") == ["c-1"]
    with pytest.raises(ValueError, match="highest is 0.9"):
        counts.read_cleaned(spark, path, least_probability=0.95)


def test_loom_round_trip(spark, small, tmp_path):
    path = f"{tmp_path}/l.loom"
    loom.write(small, path)
    assert formats.detect(spark, path).name == "loom"
    back = loom.read(spark, path)
    assert np.array_equal(dense(back.matrices["X"]), X) and np.array_equal(dense(back.matrices["layers/d"]), X)
    assert column(back.obs, "name") == ["a-1", "b-1", "c-1"] and column(back.obs, "cat") == ["t1", "t2", "t1"] and column(back.obs, "n") == [1, 2, 3]
    assert column(back.var, "name") == ["g0", "g1", "g2", "g3"] and column(back.var, "Gene")[0] == "Gène0"
    assert dense(back.matrices["obsm/X_umap"]).tolist() == [[0, 1], [1, 1], [2, 1]] and dense(back.matrices["obsp/g"])[0, 1] == 0.5
    assert back.uns["loom"]["attrs"]["title"] == "t" and column(loom.read(spark, path, names="symbols").var, "name")[0] == "Gène0"
    assert not loom.read(spark, path, layer="d", dense=True).matrices["X"].sparse
    with pytest.raises(ValueError, match="no layer"):
        loom.read(spark, path, layer="none")


def test_loom_of_a_viewer(spark, small, tmp_path):
    path = f"{tmp_path}/s.loom"
    auc = spark.createDataFrame([(i, n, float(i), 2.0 * i) for i, n in enumerate(["a-1", "b-1", "c-1"])], "pos long, name string, `R1 (+)` double, R2 double")
    from dataclasses import replace

    s = replace(small, frames={"obsm/RegulonsAUC": Frame(auc)})
    loom.write(s, path, scope=True, clusterings=("cat",))
    tree = hdf5.FileTree(spark, path)
    meta = json.loads(trees.whole(tree.array("attrs/MetaData")).item())
    assert meta["clusterings"][0]["clusters"] == [{"id": 0, "description": "t1"}, {"id": 1, "description": "t2"}] and meta["embeddings"] == [{"id": -1, "name": "umap"}]
    back = loom.read(spark, path)
    assert column(back.obs, "cat") == ["t1", "t2", "t1"] and back.obs.categories["cat"].labels == ("t1", "t2")
    assert dense(back.matrices["obsm/X_umap"]).tolist() == [[0, 1], [1, 1], [2, 1]]
    assert back.frames["obsm/RegulonsAUC"].columns == ["R1_(+)", "R2"] and column(back.frames["obsm/RegulonsAUC"], "R2") == [0, 2, 4]
    with pytest.raises(ValueError, match="categorical"):
        loom.write(s, f"{tmp_path}/t.loom", scope=True, clusterings=("n",))
    packed = base64.b64encode(zlib.compress(json.dumps(meta).encode())).decode()
    from axisframe.operators import modalities

    assert modalities.unfolded(packed)[0] == meta


def test_modalities_round_trip(spark, small, tmp_path):
    path = f"{tmp_path}/m.h5mu"
    mudata.write(small, path)
    assert open(path, "rb").read(6) == b"MuData" and formats.detect(spark, path).name == "mudata"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        both = mudata.read_all(spark, path)
    assert list(both) == ["rna", "atac"] and dense(both["atac"].matrices["X"]).tolist() == X[:, 1::2].tolist()
    assert column(both["rna"].obs, "cat") == ["t1", "t2", "t1"] and dense(both["rna"].matrices["obsm/X_umap"]).tolist() == [[0, 1], [1, 1], [2, 1]] and both["atac"].uns == {"title": "t"}
    assert column(mudata.read(spark, path, "atac").var, "name") == ["g1", "g3"]
    with pytest.raises(ValueError, match="rna, atac"):
        mudata.read(spark, path)
    from dataclasses import replace

    with pytest.raises(ValueError, match="modality"):
        mudata.write(replace(small, matrices={**small.matrices, "obsm/rna": small.matrices["obsm/X_umap"]}), f"{tmp_path}/n.h5mu")


def test_legacy_labels_lie_apart(spark, tmp_path):
    path = f"{tmp_path}/old.h5ad"
    sink = hdf5.FileSink(spark, path)
    sink.group("obs", **{"_index": "_index", "column-order": np.array(["t"], object)})
    sink.small("obs/_index", np.array(["a", "b"], object))
    sink.small("obs/__categories/t", np.array(["x", "y"], object))
    sink.small("obs/t", np.array([1, 0], np.int8), categories="obs/__categories/t")
    sink.small("var/_index", np.array(["g"], object))
    sink.small("X", np.array([[1.0], [2.0]]))
    sink.close()
    s = hdf5.read(spark, path)
    assert column(s.obs, "t") == ["y", "x"] and s.obs.categories["t"].labels == ("x", "y") and dense(s.matrices["X"]).tolist() == [[1], [2]]
    assert s.obs.data.where(F.col("t").isNull()).isEmpty()
