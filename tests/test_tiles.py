"""Dense arrays of files, written from entries."""

import numpy as np
import pytest

from axisframe.sources import hdf5, loom, trees
from axisframe.sources.store import Frame, Matrix, Store


def _axis(spark, n):
    return Frame(spark.range(n).selectExpr("id AS pos", "concat('n', id) AS name"))


def test_tiles_without_entries_are_not_stored(spark, tmp_path):
    n, m, path = 3000, 2000, f"{tmp_path}/l.loom"
    x = spark.range(n).selectExpr("id AS i", "id * 2 DIV 3 AS j", "id + 0.5D AS v")
    loom.write(Store(_axis(spark, n), _axis(spark, m), {"X": Matrix(x, (n, m), "float64")}), path)
    a = hdf5.FileTree(spark, path).array("matrix")
    assert a.shape == (m, n) and a.chunks == (512, 512) and 0 < len(a.index) < np.prod(a.grid) / 2
    assert sorted(map(tuple, loom.read(spark, path).matrices["X"].data.collect())) == [(i, i * 2 // 3, i + 0.5) for i in range(n)]
    dense = np.zeros((m, n))
    dense[np.arange(n) * 2 // 3, np.arange(n)] = np.arange(n) + 0.5
    load, found = a.loader(), np.zeros(np.multiply(a.grid, a.chunks))
    for k, token in enumerate(a.tokens(0, int(np.prod(a.grid)))):
        i, j = np.multiply(np.unravel_index(k, a.grid), a.chunks)
        found[i : i + 512, j : j + 512] = load(token)
    assert np.array_equal(found[:m, :n], dense)


@pytest.mark.parametrize("dtype, kind, values", [("float32", "float", [1.5, 2.25]), ("uint8", "smallint", [200, 55]), ("int64", "long", [1 << 60, 1]), ("uint64", "decimal(20,0)", [(1 << 63) + 5, 6]), ("bool", "boolean", [True, True])])
def test_entries_of_one_cell_add_up(spark, tmp_path, dtype, kind, values):
    rows = spark.createDataFrame([(1, 3, str(v).lower()) for v in values] + [(0, 4, "1")], "i long, j long, v string").selectExpr("i", "j", f"cast(v AS {kind}) AS v")
    sink = hdf5.FileSink(spark, f"{tmp_path}/t.h5")
    sink.tiles("x", rows, (2, 5), dtype)
    sink.tiles("none", rows.where("i > 5"), (2, 5), dtype)
    sink.tiles("flat", rows, (0, 5), dtype)
    sink.close()
    tree = hdf5.FileTree(spark, f"{tmp_path}/t.h5")
    want = np.zeros((2, 5), dtype)
    want[1, 3], want[0, 4] = (any(values) if dtype == "bool" else sum(values)), 1
    x = trees.whole(tree.array("x"))
    assert x.dtype == want.dtype and np.array_equal(x, want)
    assert not trees.whole(tree.array("none")).any() and loom.nonzero(spark, tree.array("none")).count() == 0
    assert tree.array("flat").shape == (0, 5)


def test_tile_shapes():
    assert hdf5.tile_shape((60_000, 900_000)) == (512, 512) and hdf5.tile_shape((3, 10**6)) == (3, trees.CHUNK // 3)
    assert hdf5.tile_shape((10**6, 3)) == (trees.CHUNK // 3, 3) and hdf5.tile_shape((5, 7)) == (5, 7)
