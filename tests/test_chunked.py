import gzip
import json
from dataclasses import replace

import numpy as np
import pytest

from axisframe.sources import chunked, files, formats, trees
from axisframe.sources.store import Categories, Frame, Matrix, Store


def dense(m):
    out = np.zeros(m.shape)
    for r in m.data.collect():
        if m.sparse:
            out[r.i, r.j] += r.v
        else:
            out[r.i] = r["values"]
    return out


@pytest.fixture(scope="module")
def small(spark):
    x = np.array([[1, 0, 3, 0], [0, 0, 4, 5], [2, 0, 0, 6]], float)
    e = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    obs = spark.createDataFrame([(0, "a", "t1", 1, None, 0.5, None), (1, "b", None, 2, True, float("nan"), "x"), (2, "b", "t2", None, False, 2.0, "é")], "pos long, name string, cat string, n int, flag boolean, f float, text string")
    var = spark.createDataFrame([(j, f"g{j}") for j in range(4)], "pos long, name string")
    wide = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(3)], "i long, values array<float>")
    m = Matrix(spark.createDataFrame(e, "i long, j long, v double"), (3, 4), "float64")
    found = {"X": m, "layers/c": replace(m, layout="csc"), "obsm/w": Matrix(wide, (3, 3), "float32", "dense")}
    return Store(Frame(obs, {"cat": Categories(("t1", "t2", "t3"), True)}), Frame(var), found, {}, {"s": "text", "k": 3, "l": [1.5, 2.0], "d": {"t": ["a", "b"]}}, Store(Frame(obs), Frame(var), {"X": m})), x


def test_round_trip(spark, small, tmp_path, monkeypatch):
    s, x = small
    monkeypatch.setattr(trees, "CHUNK", 4)
    formats.by_name("a.zarr").write(s, f"{tmp_path}/a.zarr")
    assert formats.detect(spark, f"{tmp_path}/a.zarr").name == "zarr"
    back = formats.read(spark, f"{tmp_path}/a.zarr")
    for p in ("X", "layers/c"):
        assert np.array_equal(dense(back.matrices[p]), x) and back.matrices[p].layout == s.matrices[p].layout
    assert dense(back.matrices["obsm/w"]).tolist() == [[0, 1, 2], [1, 1, 2], [2, 1, 2]] and back.matrices["obsm/w"].dtype == "float32"
    rows = lambda f: [repr(tuple(r)) for r in f.data.orderBy("pos").select(s.obs.data.columns).collect()]
    assert rows(back.obs) == rows(s.obs) and back.obs.categories == s.obs.categories and back.uns == s.uns
    assert np.array_equal(dense(back.raw.matrices["X"]), x)


def test_version_3_absent_chunks_and_edges(spark, tmp_path):
    root = tmp_path / "v3.zarr"
    meta = {"zarr_format": 3, "node_type": "array", "shape": [3, 5], "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 3]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}], "fill_value": 7, "attributes": {"a": 1}}
    x = np.arange(15).reshape(3, 5)
    full = np.zeros((4, 6), ">i2")
    full[:3, :5] = x
    for i in range(2):
        for j in range(2):
            if (i, j) != (1, 0):
                (root / f"c/{i}").mkdir(parents=True, exist_ok=True)
                (root / f"c/{i}/{j}").write_bytes(gzip.compress(full[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].tobytes()))
    (root / "zarr.json").write_text(json.dumps(meta))
    m = chunked.array_matrix(spark, str(root))
    x[2, :3] = 7
    assert dense(m).tolist() == x.tolist() and m.dtype == "int16"
    meta["codecs"] = [{"name": "bz2"}]
    (root / "zarr.json").write_text(json.dumps(meta))
    with pytest.raises(ValueError, match="bz2"):
        chunked.array_matrix(spark, str(root))
    with pytest.raises(FileNotFoundError):
        chunked.read(spark, str(tmp_path))


def test_inconsistent_entries_are_refused(spark, small, tmp_path):
    s, _ = small
    chunked.write(s, f"{tmp_path}/b.zarr")
    attrs = json.loads(files.read_bytes(spark, f"{tmp_path}/b.zarr/X/.zattrs"))
    files.write_bytes(spark, f"{tmp_path}/b.zarr/X/.zattrs", json.dumps(attrs | {"shape": [3, 2]}).encode())
    with pytest.raises(ValueError, match="outside"):
        chunked.array_matrix(spark, f"{tmp_path}/b.zarr/X")
