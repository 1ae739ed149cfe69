import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe import cli
from axisframe.functions import names, typing
from axisframe.operators import axis, concat, joins, matrix, reshape
from axisframe.sources import arrays, files, formats, mtx, spatial, store, tables
from axisframe.sources.store import Categories, Frame, Matrix, Store


def dense(m: Matrix) -> np.ndarray:
    out = np.zeros(m.shape)
    if m.sparse:
        for r in m.data.collect():
            out[r.i, r.j] += r.v
    else:
        for r in m.data.collect():
            out[r.i] = r["values"]
    return out


def rows_of(frame: Frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.data.orderBy("pos").collect()]


@pytest.fixture(scope="module")
def rich(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, (30, 9)).astype(float)
    entries = [(i, j, float(x[i, j])) for i in range(30) for j in range(9) if x[i, j]]
    obs = spark.createDataFrame([(i, f"c{i}", ["a", "b", "a/b", None, ""][i % 5], float(i) / 4 if i % 7 else float("nan"), i) for i in range(30)], "pos long, name string, group string, score double, n long")
    var = spark.createDataFrame([(j, f"g{j}", ["k1", "k2"][j % 2]) for j in range(9)], "pos long, name string, kind string")
    graph = spark.createDataFrame([(i, (i * 7) % 30, 1.0) for i in range(30)], "i long, j long, v double")
    wide = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(30)], "i long, values array<double>")
    cats = {"group": Categories(("", "a", "a/b", "b", "never"))}
    raw_x = spark.createDataFrame([(i, j, 1.0) for i in range(30) for j in range(13) if (i + j) % 4 == 0], "i long, j long, v double")
    raw_var = spark.createDataFrame([(j, f"g{12 - j}") for j in range(13)], "pos long, name string")
    frame = Frame(obs, cats)
    raw = Store(frame, Frame(raw_var), {"X": Matrix(raw_x, (30, 13), "float64")})
    s = Store(frame, Frame(var), {"X": Matrix(spark.createDataFrame(entries, "i long, j long, v double"), (30, 9), "float64"), "obsp/g": Matrix(graph, (30, 30), "float64"), "obsm/w": Matrix(wide, (30, 2), "float64", "dense")}, {}, {"group_colors": ["#0", "#1", "#2", "#3", "#4"], "deep": {"x": [1, 2]}}, raw)
    return s, x


def test_subset_keeps_order_and_narrows_everything(rich):
    s, x = rich
    out = reshape.subset(s, obs_query="n >= 5 and score != nan", var_query="kind == k2")
    keep = [i for i in range(30) if i >= 5 and i % 7]
    assert np.array_equal(dense(out.matrices["X"]), x[keep][:, 1::2])
    assert rows_of(out.obs, "pos", "n") == list(enumerate(keep))
    assert out.obs.categories["group"].labels == ("", "a", "a/b", "b") and out.uns["group_colors"] == ["#0", "#1", "#2", "#3"]
    graph = {(r.i, r.j) for r in out.matrices["obsp/g"].data.collect()}
    assert graph == {(keep.index(i), keep.index(i * 7 % 30)) for i in keep if i * 7 % 30 in keep}
    assert [v[0] for v in dense(out.matrices["obsm/w"])] == keep
    assert rows_of(out.raw.var, "name") == [(f"g{12 - j}",) for j in range(13) if 12 - j < 9 and (12 - j) % 2]


def test_subset_of_everything_is_the_same_and_nothing_is_refused(rich, spark):
    s, x = rich
    assert np.array_equal(dense(reshape.subset(s, "n >= 0").matrices["X"]), x)
    with pytest.raises(ValueError, match="nothing in obs"):
        reshape.subset(s, "n > 99")
    listed = spark.createDataFrame([("c3",), ("c1",), ("no",)], "name string")
    assert rows_of(reshape.subset(s, obs_names=listed).obs, "name") == [("c1",), ("c3",)]
    assert [r.name for r in axis.absent(s.obs, listed).collect()] == ["no"]


def test_split_is_a_partition_and_concat_brings_it_back(rich):
    s, x = rich
    parts = list(reshape.split(s, "group"))
    assert [p.label for p, _ in parts] == ["a", "b", "a/b", None, ""] and sorted(p.stem for p, _ in parts) == ["NA", "NA_1", "a", "a_b", "b"]
    back = concat.concat({p.stem: replace(o, raw=None, matrices={"X": o.matrices["X"]}) for p, o in parts}, merge="same", uns_merge="unique")
    order = [i for k in range(5) for i in range(k, 30, 5)]
    assert np.array_equal(dense(back.matrices["X"]), x[order]) and [r[0] for r in rows_of(back.obs, "n")] == order
    assert rows_of(back.var, "kind") == rows_of(s.var, "kind") and back.uns["deep"] == {"x": [1, 2]}
    found, entries = reshape.split_entries(s, "group")
    assert entries.count() == int((x > 0).sum()) and len(found) == 5


def test_concat_aligns_fills_and_promotes(spark):
    def one(names_of, values, **columns):
        n = len(values)
        obs = spark.createDataFrame([(i, f"o{i}", *(c[i] for c in columns.values())) for i in range(n)], "pos long, name string" + "".join(f", {k} {'string' if isinstance(c[0], str) else 'boolean' if isinstance(c[0], bool) else 'int'}" for k, c in columns.items()))
        var = spark.createDataFrame(list(enumerate(names_of)), "pos long, name string")
        e = [(i, j, v) for i, r in enumerate(values) for j, v in enumerate(r) if v]
        return Store(Frame(obs), Frame(var), {"X": Matrix(spark.createDataFrame(e, "i long, j long, v int"), (n, len(names_of)), "int32")})

    a, b = one("xyz", [[1, 2, 3], [0, 4, 0]], shared=[1, 2], only=[7, 8], truth=[True, False]), one("zxw", [[5, 6, 7]], shared=[3], label=["t"])
    inner = concat.concat({"a": a, "b": b}, join="inner", label="src", index_unique="-")
    assert rows_of(inner.var, "name") == [("x",), ("z",)] and dense(inner.matrices["X"]).tolist() == [[1, 3], [0, 0], [6, 5]]
    assert rows_of(inner.obs, "name", "shared", "src") == [("o0-a", 1, "a"), ("o1-a", 2, "a"), ("o0-b", 3, "b")]
    outer = concat.concat({"a": a, "b": b}, join="outer")
    assert [r[0] for r in rows_of(outer.var, "name")] == ["w", "x", "y", "z"] and dense(outer.matrices["X"]).tolist() == [[0, 1, 2, 3], [0, 0, 4, 0], [7, 6, 0, 5]]
    got = rows_of(outer.obs, "only", "truth", "label")
    assert got[0] == (7.0, True, None) and np.isnan(got[2][0]) and got[2][1:] == (None, "t")
    with pytest.raises(ValueError, match="comes 2 times"):
        concat.concat({"a": one("xx", [[1, 2]]), "b": b})


def test_categories_merge_by_rule():
    c = Categories
    assert concat.merged_categories([c(("b", "a")), c(("a",))]) == c(("b", "a"))
    assert concat.merged_categories([c(("a2", "a10")), c(("a1",))]) == c(("a1", "a2", "a10"))
    assert concat.merged_categories([c(("l", "h"), True), c(("l", "h"), True)]) == c(("l", "h"), True)
    assert not concat.merged_categories([c(("l", "h"), True), c(("h", "l"), True)]).ordered


@pytest.mark.parametrize(("strategy", "present", "values", "want"), [(None, [1, 1], "aa", None), ("same", [1, 1], "aa", 0), ("same", [1, 0], "aa", None), ("same", [1, 1], "ab", None), ("unique", [0, 1, 1], "xaa", 1), ("unique", [1, 1], "ab", None), ("first", [0, 1, 1], "xab", 1), ("only", [0, 1, 0], "xax", 1), ("only", [1, 1], "aa", None)])
def test_merge_strategies(strategy, present, values, want):
    assert concat.choose([bool(p) for p in present], lambda a, b: values[a] == values[b], strategy) == want


def test_matrix_forms(spark):
    # The corrected three by four matrix of the fixtures.
    x = np.array([[1, 0, 3, 0], [0, 0, 4, 5], [2, 0, 0, 6]], float)
    m = Matrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "i long, j long, v double"), (3, 4), "float64")
    assert np.array_equal(dense(matrix.transposed(m)), x.T) and matrix.transposed(m).layout == "csc"
    assert np.array_equal(dense(matrix.densified(m)), x) and np.array_equal(dense(matrix.sparsified(matrix.densified(m))), x)
    assert [(r.start, r.n) for r in matrix.pointers(m).orderBy("pos").collect()] == [(0, 2), (2, 2), (4, 2)]
    assert [(r.start, r.n) for r in matrix.pointers(m, "j").orderBy("pos").collect()] == [(0, 2), (2, 0), (2, 2), (4, 2)]
    rows = {r.i: (r.indices, r.data) for r in matrix.packed(m).collect()}
    assert rows[1] == ([2, 3], [4.0, 5.0]) and matrix.unpacked(matrix.packed(m)).exceptAll(m.data).isEmpty()
    assert matrix.density(m) == 0.5
    twice = Matrix(m.data.union(m.data), m.shape, m.dtype)
    assert np.array_equal(dense(Matrix(matrix.summed(twice.data), m.shape, m.dtype)), 2 * x)
    with pytest.raises(ValueError, match="outside"):
        matrix.check_entries(m.data, (3, 3))


@pytest.mark.parametrize(
    ("values", "source", "target", "changed", "out"),
    [([1.0, 2.0, float("nan")], "float64", "float32", 0, False), ([0.1, 1.0], "float64", "float32", 1, False), ([1e300], "float64", "float32", 1, True), ([1.0, 300.0], "float64", "uint8", 1, True), ([1.5, -2.0], "float64", "int32", 1, False), ([float("nan"), 1.0], "float64", "int32", 1, False), ([1.0, 0.1, 65504.0], "float64", "float16", 1, False)],
)
def test_cast_reports(spark, values, source, target, changed, out):
    m = Matrix(spark.createDataFrame([(k, 0, v) for k, v in enumerate(values)], "i long, j long, v double"), (len(values), 1), source)
    r = matrix.cast_report(m, target)
    assert (r.total, r.changed, r.overflowed) == (len(values), changed, out)


def test_recast_refuses_losses_and_growth(rich):
    s, x = rich
    out = reshape.recast(s, dtype="int16", layout="dense")
    assert out.matrices["X"].dtype == "int16" and np.array_equal(dense(out.matrices["X"]), x)
    half = s.with_matrix("X", replace(s.matrices["X"], data=s.matrices["X"].data.withColumn("v", F.col("v") / 2)))
    with pytest.raises(ValueError, match="loses"):
        reshape.recast(half, dtype="int16")
    assert reshape.recast(half, dtype="int16", force=True).matrices["X"].dtype == "int16"
    with pytest.raises(ValueError, match="float16"):
        reshape.recast(s, dtype="float16")
    with pytest.raises(KeyError):
        reshape.recast(s, ["layers/no"], dtype="int8")


def test_numbering_over_blocks(spark):
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("pos"))
    got = [(r.pos, r.new_pos) for r in axis.renumbered(rows, block=64).orderBy("pos").collect()]
    assert got == [(3 * k, k) for k in range(334)]


def test_names(spark):
    assert [names.file_stem(x) for x in ("a/b c", "CD4+", "  ", None, "é")] == ["a_b_c", "CD4", "NA", "NA", "NA"]
    assert names.distinct_stems(["CD4+", "CD4", "CD4_1", "T", "t", None]) == {None: "NA", "CD4": "CD4", "CD4_1": "CD4_1", "T": "T", "CD4+": "CD4_2", "t": "t_1"}
    assert names.natural(["A10", "A2", "B1", "A1"]) == ["A1", "A2", "A10", "B1"] and names.natural([10, 9]) == [9, 10]
    assert [names.member_name(x) for x in ("", ".", "..", "a/b", "x")] == ["_", "_.", "_..", "a_b", "x"]
    rows = spark.createDataFrame(list(enumerate(["a", "b", "a", "a-1", "a", "a"])), "pos long, name string")
    assert [r.name for r in names.unique_rows(rows).orderBy("pos").collect()] == ["a", "b", "a-2", "a-1", "a-3", "a-4"]
    got = spark.createDataFrame([("A10",), ("A2",)], "x string").orderBy(names.natural_sort_column(F.col("x"))).collect()
    assert [r.x for r in got] == ["A2", "A10"]


def test_csv_types_and_round_trip(spark, tmp_path):
    text = 'id,count,score,flag,label,note,gappy,empty\nr1,1,0.5,True,a,"x, ""y""",1,\nr2,2,1e3,False,b,,NA,\nr3,3,NaN,true,a,z,3,\n'
    (tmp_path / "t.csv").write_text(text)
    f = tables.read_csv(spark, f"{tmp_path}/t.csv")
    kinds = dict(f.data.dtypes)
    assert [kinds[c] for c in ("count", "score", "flag", "label", "gappy", "empty")] == ["bigint", "double", "boolean", "string", "bigint", "boolean"]
    got = rows_of(f, "name", "count", "label", "note", "gappy")
    assert got == [("r1", 1, "a", 'x, "y"', 1), ("r2", 2, "b", None, None), ("r3", 3, "a", "z", 3)] and f.categories["label"].labels == ("a", "b")
    tables.write_csv(f, f"{tmp_path}/o.csv")
    assert (tmp_path / "o.csv").read_text().splitlines()[1] == 'r1,1,0.5,true,a,"x, ""y""",1,'
    tables.write_csv(f, f"{tmp_path}/h.csv", ["count"], 0)
    assert (tmp_path / "h.csv").read_text() == "index,count\n"
    with pytest.raises(ValueError, match="negative"):
        tables.csv_rows(f, head=-1)


@pytest.mark.parametrize(("values", "kind"), [(["1", "2"], "int"), (["1", "18446744073709551615"], "uint"), (["-1", "18446744073709551615"], "text"), (["1", "1.5"], "float"), (["inf", "1"], "float"), (["True", "1"], "text"), (["true", "NA"], "bool"), (["", "NA"], "bool"), (["1d"], "text"), (["123456789012345678901234567890123456789012"], "text"), ([" 7 ", "+8"], "int")])
def test_inference(spark, values, kind):
    assert typing.infer(spark.createDataFrame([(v,) for v in values], "x string"), ["x"])["x"].kind == kind


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%note\n3 4 5\n3 1 2\n1 1 1\n1 3 3\n2 3 4\n1 1 5\n")
    m = mtx.read(spark, f"{tmp_path}/m.mtx")
    assert m.dtype == "int32" and dense(m).tolist() == [[6, 0, 3, 0], [0, 0, 4, 0], [2, 0, 0, 0]]
    mtx.write(m, f"{tmp_path}/o.mtx.gz")
    assert dense(mtx.read(spark, f"{tmp_path}/o.mtx.gz")).tolist() == dense(m).tolist()
    for bad, why in (("1 1 1\n9 1 1\n", "line 4.*outside"), ("1 1 1\n", "has 1 entries"), ("1 1\n1 1 1\n", "line 3"), ("1 1 1\n1 1 x\n", "line 4")):
        (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 4 2\n" + bad)
        with pytest.raises(ValueError, match=why):
            mtx.read(spark, f"{tmp_path}/b.mtx")


def test_count_folder_round_trip(spark, rich, tmp_path):
    s, x = rich
    mtx.write_folder(reshape.recast(s, dtype="int32"), f"{tmp_path}/run")
    assert formats.detect(spark, f"{tmp_path}/run").name == "mtx-folder"
    back = mtx.read_folder(spark, f"{tmp_path}/run")
    assert np.array_equal(dense(back.matrices["X"]), x) and rows_of(back.obs, "name") == rows_of(s.obs, "name")


def test_dense_text(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# note\ngene\tc1\tc2\ng1\t1\t0\ng2\t0\t2.5\n")
    s = tables.read_dense(spark, f"{tmp_path}/d.tsv", transpose=True)
    assert dense(s.matrices["X"]).tolist() == [[1, 0], [0, 2.5]] and rows_of(s.obs, "name") == [("c1",), ("c2",)] and rows_of(s.var, "name") == [("g1",), ("g2",)]
    (tmp_path / "bad.tsv").write_text("a\tb\nr1\t1\t2\nr2\t1\n")
    with pytest.raises(ValueError, match="line 3"):
        tables.read_dense(spark, f"{tmp_path}/bad.tsv")


def test_store_round_trip_and_safety(spark, rich, tmp_path):
    s, x = rich
    where = f"{tmp_path}/s.store"
    store.save(s, where)
    back = store.load(spark, where)
    assert np.array_equal(dense(back.matrices["X"]), x) and back.obs.categories == s.obs.categories and back.uns == s.uns and back.raw.var.data.count() == 13
    assert {e["path"] for e in store.describe(back)} >= {"obs", "obs/group", "X", "obsp/g", "uns/deep/x", "raw/X"} and "30 obs x 9 var" in store.summary(back)
    with pytest.raises(FileExistsError):
        store.save(s, where)
    with pytest.raises(RuntimeError), files.staged(spark, where, replace=True) as new:
        files.write_bytes(spark, f"{new}/x", b"half")
        raise RuntimeError
    assert store.load(spark, where).obs.data.count() == 30 and sorted(files.names(spark, str(tmp_path))) == ["s.store"]
    manifest = json.loads(files.read_bytes(spark, f"{where}/{store.MANIFEST}"))
    manifest["matrices"]["../x"] = manifest["matrices"]["X"]
    files.write_bytes(spark, f"{where}/{store.MANIFEST}", json.dumps(manifest).encode())
    with pytest.raises(ValueError, match="outside"):
        store.load(spark, where)


def test_commands(spark, rich, tmp_path, capsys):
    s, x = rich
    store.save(s, f"{tmp_path}/a.store")
    cli.run(spark, ["subset", f"{tmp_path}/a.store", "-o", f"{tmp_path}/b.store", "--obs-query", "n < 10"])
    cli.run(spark, ["view", f"{tmp_path}/b.store"])
    assert "10 obs x 9 var" in capsys.readouterr().out
    cli.run(spark, ["concat", f"{tmp_path}/b.store", f"{tmp_path}/a.store", "-o", f"{tmp_path}/c.store", "--label", "from"])
    cli.run(spark, ["recast", f"{tmp_path}/c.store", "--inplace", "--dtype", "int8"])
    c = store.load(spark, f"{tmp_path}/c.store")
    assert c.matrices["X"].dtype == "int8" and np.array_equal(dense(c.matrices["X"]), np.vstack([x[:10], x]))
    cli.run(spark, ["export", f"{tmp_path}/c.store", "array", "X", "-o", f"{tmp_path}/x.npy"])
    assert np.array_equal(np.load(tmp_path / "x.npy"), np.vstack([x[:10], x]))
    cli.run(spark, ["import", f"{tmp_path}/c.store", "array", f"{tmp_path}/x.npy", "layers/again", "--inplace"])
    assert np.array_equal(dense(store.load(spark, f"{tmp_path}/c.store").matrices["layers/again"]), np.vstack([x[:10], x]))
    cli.run(spark, ["split", f"{tmp_path}/a.store", "--by", "group", "--output-dir", f"{tmp_path}/parts"])
    assert len(files.names(spark, f"{tmp_path}/parts")) == 5
    with pytest.raises(ValueError, match="rows along"):
        cli.run(spark, ["import", f"{tmp_path}/a.store", "array", f"{tmp_path}/x.npy", "X", "-o", f"{tmp_path}/d.store"])


def test_json_and_images():
    assert arrays.finite({"a": [1.0, float("nan")], "b": np.arange(2)}) == {"a": [1.0, None], "b": [0, 1]}
    assert arrays.import_json('{"a": [[1, 2], [3]], "b": [1, 2.5], "c": null, "d/e": true}') == {"a": "[[1, 2], [3]]", "b": [1, 2.5], "d_e": True}
    for x in (np.arange(12, dtype=np.uint8).reshape(3, 4), np.arange(24, dtype=np.uint16).reshape(2, 4, 3) * 2000):
        assert np.array_equal(arrays.read_png(arrays.png(x)), x)
    assert arrays.pixels(np.array([[True, False]])).tolist() == [[255, 0]] and arrays.pixels(np.array([[0.5, 1.0]])).tolist() == [[127, 255]]
    assert arrays.pixels(np.array([[1.5, 254.9]])).tolist() == [[1, 254]] and arrays.pixels(np.array([[1, np.nan], [3, 2]]), scale=True).tolist() == [[0, 0], [255, 128]]
    for bad in (np.array([[300.0]]), np.array([[-1]]), np.full((2, 2, 3), 300), np.array([[np.nan]])):
        with pytest.raises(ValueError):
            arrays.pixels(bad)
    for x in (np.arange(12, dtype=np.uint8).reshape(3, 4), np.arange(6, dtype=np.uint16).reshape(2, 3) * 9000, np.arange(24, dtype=np.uint8).reshape(2, 4, 3)):
        assert np.array_equal(arrays.read_image(arrays.image_bytes(x, "a.tif")), x) and np.array_equal(arrays.read_image(arrays.image_bytes(x, "a.png")), x)
    with pytest.raises(ValueError, match="jpg"):
        arrays.image_bytes(x, "a.jpg")


def test_polygons(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]
    shapes = [{"type": "Feature", "properties": {"cell_id": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}}, {"type": "Feature", "properties": {"cell_id": 2}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[10, 0], [12, 0], [12, 2], [10, 2], [10, 0]]]]}}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    m = {r.cell_id: r for r in spatial.measured(spatial.polygons(spark, f"{tmp_path}/g.json")).collect()}
    assert (m[1].area, m[1].x, m[1].y) == (12, 2, 2) and m[2].area == 20 and abs(m[2].x - (2 * 16 + 11 * 4) / 20) < 1e-12
    assert [r[0] for r in spark.createDataFrame([("cellid_000000012-1",), ("x",)], "n string").select(spatial.cell_number(F.col("n"))).collect()] == [12, None]


def test_checked_joins(spark):
    frame = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, name string")
    t = spark.createDataFrame([("a", 1.0), ("c", 3.0), ("z", 9.0)], "k string, v double")
    out, found = joins.checked_left(frame, t, "k", fills={"v": -1.0})
    assert found == joins.Match(2, 1, 1, 0) and [r.v for r in out.orderBy("pos").collect()] == [1.0, -1.0, 3.0]
    for bad, why in ((t.union(t), "repeat"), (t.where("k = 'z'"), "no key")):
        with pytest.raises(ValueError, match=why):
            joins.checked_left(frame, bad, "k")
    with pytest.raises(ValueError, match="without a row"):
        joins.checked_left(frame, t, "k", allow_missing=False)


def test_streams_are_selected(spark, tmp_path):
    from axisframe.streaming import blocks

    spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("k")).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("pos long, k long").parquet(f"{tmp_path}/in")
    q = blocks.select_stream(live, "k == 3").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 14
    assert [len(b) for b in blocks.ordered_blocks(spark.range(10).withColumnRenamed("id", "pos"), size=4)] == [4, 4, 2]
