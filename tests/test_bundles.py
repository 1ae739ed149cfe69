import json
import os
import pickle
import signal
import socket
import sys
import tarfile
import types

import numpy as np
import pandas as pd
import pytest

from axisframe import cli
from axisframe.sources import arrays, counts, files, formats, mtx, pickles, spatial
from axisframe.sources.store import Frame, Matrix, Store


def column(frame, c):
    return [r[0] for r in frame.data.orderBy("pos").select(c).collect()]


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
    def make(names):
        obs = spark.createDataFrame(list(enumerate(names)), "pos long, name string")
        var = spark.createDataFrame([(0, "g0", "S0", "Gene Expression", "hg"), (1, "g1", "S1", "Peaks", "hg")], "pos long, name string, gene_symbols string, feature_types string, genome string")
        x = Matrix(spark.createDataFrame([(0, 0, 1), (2, 1, 5)], "i long, j long, v int"), (3, 2), "int32")
        return Store(Frame(obs), Frame(var), {"X": x}, {}, {"cellranger": {"library_ids": ["lib"], "software_version": "4"}})

    return make


def _analysis(folder, names):
    for path, text in {spatial.CLUSTERS[0]: "Barcode,Cluster\n" + "".join(f"{n},{k + 1}\n" for k, n in enumerate(names[:2])), spatial.PROJECTIONS["X_umap"][0]: "Barcode,U-1,U-2\n" + "".join(f"{n},{k},{k * 2}\n" for k, n in enumerate(names))}.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


def test_slide_of_spots_and_bins(spark, small, tmp_path):
    names = ["b-1", "a-1", "c-1"]
    for folder in (tmp_path / "outs", tmp_path / "hd/binned_outputs/square_008um"):
        (folder / "spatial").mkdir(parents=True)
        counts.write(small(names), f"{folder}/s_filtered_feature_bc_matrix.h5")
        (folder / "spatial/scalefactors_json.json").write_text('{"spot": 2.5}')
        rows = [f"{n},1,{k},{k + 5},{10 * k},{20 * k}" for k, n in enumerate(["a-1", "c-1", "b-1", "z-1"])]
        (folder / "spatial/tissue_positions_list.csv").write_text("\n".join(rows) + "\n")
        (folder / "spatial/tissue_hires_image.png").write_bytes(arrays.png(np.arange(12, dtype=np.uint8).reshape(3, 4)))
        _analysis(folder, names)
    with pytest.warns(UserWarning, match="1 rows"):
        s = formats.read(spark, f"{tmp_path}")
    assert formats.detect(spark, f"{tmp_path}/outs").name == "visium" and column(s.obs, "array_row") == [2, 0, 1]
    assert dense(s.matrices["obsm/spatial"]).tolist() == [[40, 20], [0, 0], [20, 10]] and column(s.obs, "graphclust") == ["1", "2", None]
    assert dense(s.matrices["obsm/X_umap"]).tolist() == [[0, 0], [1, 2], [2, 4]]
    assert s.uns["spatial"]["lib"]["scalefactors"] == {"spot": 2.5} and s.uns["spatial"]["lib"]["images"]["hires"][2] == [8, 9, 10, 11] and s.uns["spatial"]["lib"]["metadata"] == {"software_version": "4"}
    with pytest.warns(UserWarning):
        assert column(spatial.read_slide(spark, f"{tmp_path}/hd", images=False).obs, "name") == names
    with pytest.raises(ValueError, match="16 microns: 8"):
        spatial.read_slide(spark, f"{tmp_path}/hd", bin_size=16)
    with pytest.raises(FileNotFoundError, match="raw_feature"):
        spatial.read_slide(spark, f"{tmp_path}/outs", unfiltered=True)


def test_segmented_cells(spark, small, tmp_path):
    names = ["cellid_000000002-1", "cellid_000000001-1", "cellid_000000003-1"]
    folder = tmp_path / "segmented_outputs"
    (folder / "spatial").mkdir(parents=True)
    counts.write(small(names), f"{folder}/filtered_feature_cell_matrix.h5")
    (folder / "spatial/scalefactors_json.json").write_text('{"microns_per_pixel": 0.5}')
    square = lambda k, a: {"type": "Feature", "properties": {"cell_id": k}, "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [k + a, 0], [k + a, a], [k, a], [k, 0]]]}}
    (folder / spatial.OUTLINES["cell"]).write_text(json.dumps({"features": [square(k, 2 * k) for k in (1, 2, 3)]}))
    (folder / spatial.OUTLINES["nucleus"]).write_text(json.dumps({"features": [square(1, 1)]}))
    s = formats.read(spark, str(folder))
    assert column(s.obs, "cell_area") == [4, 1, 9] and dense(s.matrices["obsm/spatial"])[0].tolist() == [4, 2]
    assert column(s.obs, "nucleus_area")[1] == 0.25 and np.isnan(column(s.obs, "nucleus_area")[0])


def test_bundle_of_cells(spark, small, tmp_path):
    names = ["x", "y", "z"]
    (tmp_path / "experiment.xenium").write_text("{}")
    counts.write(small(names), f"{tmp_path}/cell_feature_matrix.h5")
    pd.DataFrame({"cell_id": ["y", "q", "x", "z"], "x_centroid": [1.0, 9, 2, 3], "y_centroid": [4.0, 9, 5, 6], "cell_area": [7.5, 0, 8.5, 9.5], "segmentation_method": ["a", "a", "b", "a"]}).to_csv(tmp_path / "cells.csv.gz", index=False)
    _analysis(tmp_path / "loose", names)
    with tarfile.open(tmp_path / "analysis.tar.gz", "w:gz") as t:
        t.add(tmp_path / "loose/analysis", "analysis")
    with pytest.warns(UserWarning, match="not in the matrix"):
        s = formats.read(spark, str(tmp_path))
    assert column(s.obs, "cell_area") == [8.5, 7.5, 9.5] and dense(s.matrices["obsm/spatial"]).tolist() == [[2, 5], [1, 4], [3, 6]] and column(s.obs, "graphclust") == ["1", "2", None]


def test_count_folders_of_all_kinds(spark, small, tmp_path):
    s = small(["a", "b", "c"])
    mtx.write_folder(s, f"{tmp_path}/plain")
    back = mtx.read_folder(spark, f"{tmp_path}/plain", names="symbols", make_unique=True)
    assert back.uns["cellranger"]["software_version"] == "4" and column(back.var, "name") == ["S0", "S1"]
    velocyto = tmp_path / "velocyto"
    velocyto.mkdir()
    for k, x in enumerate(mtx.LAYERS):
        (velocyto / f"{x}.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n2 3 1\n1 2 {k + 1}\n")
    (velocyto / "barcodes.tsv").write_text("a\nb\nc\n")
    (velocyto / "features.tsv").write_text("g0\tS0\ng1\tS1\n")
    v = formats.read(spark, str(velocyto))
    assert dense(v.matrices["X"])[1].tolist() == [1, 0] and dense(v.matrices["layers/ambiguous"])[1].tolist() == [3, 0]
    genomes = tmp_path / "older"
    for g in ("hg", "mm"):
        (genomes / g).mkdir(parents=True)
        (genomes / g / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n1 1 1\n1 1 4\n")
        (genomes / g / "barcodes.tsv").write_text("a\n")
        (genomes / g / "genes.tsv").write_text(f"{g}1\tn\n")
    with pytest.raises(ValueError, match="hg, mm"):
        formats.read(spark, str(genomes))
    assert column(formats.read(spark, str(genomes), genome="mm").var, "name") == ["mm1"]
    several = tmp_path / "several"
    several.mkdir()
    for p in ("one", "two"):
        for n in ("matrix.mtx", "barcodes.tsv", "genes.tsv"):
            (several / f"{p}_{n}").write_bytes((genomes / "hg" / n).read_bytes())
    with pytest.raises(ValueError, match="several: one_matrix.mtx, two_matrix.mtx"):
        formats.read(spark, str(several))


def test_runs_of_samples(spark, tmp_path):
    for sample, n in (("all-sample", 3), ("s1", 2)):
        folder = tmp_path / sample / "DGE_filtered"
        folder.mkdir(parents=True)
        (folder / "count_matrix.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n{n} 2 1\n{n} 2 7\n")
        (folder / "all_genes.csv").write_text('gene_id,gene_name,genome\nE1,"n1",hg\nE2,"n2",mm\n')
        (folder / "cell_metadata.csv").write_text("bc_wells,sample,species\n" + "".join(f"w{k},s1,{'hg' if k else 'mm'}\n" for k in range(n)))
    s = formats.read(spark, str(tmp_path))
    assert formats.detect(spark, str(tmp_path)).name == "run" and s.matrices["X"].shape == (3, 2) and column(s.var, "gene_symbols") == ["n1", "n2"]
    assert mtx.samples(spark, str(tmp_path)) == ["s1"] and mtx.read_run(spark, str(tmp_path), sample="s1", names="symbols").matrices["X"].shape == (2, 2)
    assert mtx.read_run(spark, str(tmp_path), genome="hg").matrices["X"].shape == (2, 1)
    with pytest.raises(ValueError, match="no sample"):
        mtx.read_run(spark, str(tmp_path), sample="s2")


@pytest.fixture()
def topics(tmp_path):
    """A pickle of an object whose class stands in a module of another package."""
    module = types.ModuleType("pycisTopic.cistopic_class")

    class CistopicObject:
        pass

    CistopicObject.__module__, CistopicObject.__qualname__ = module.__name__, "CistopicObject"
    module.CistopicObject = CistopicObject
    sys.modules["pycisTopic"], sys.modules[module.__name__] = types.ModuleType("pycisTopic"), module
    x = CistopicObject()
    x.fragment_matrix = np.array([[1, 0, 2], [0, 3, 0]], np.int32)
    x.binary_matrix = None
    x.cell_names, x.region_names = ["c0", "c1", "c2"], ["r0", "r1"]
    x.cell_data = pd.DataFrame({"n": [3, 1, 2], "kind": pd.Categorical(["a", "b", "a"])}, index=["c2", "c0", "c1"])
    x.region_data = pd.DataFrame({"width": [5.0, 6.0]}, index=["r0", "r1"])
    x.projections = {"cell": {"UMAP": pd.DataFrame({"a": [1.0, 2, 3], "b": [4.0, 5, 6]}, index=["c0", "c1", "c2"])}, "region": {}}
    x.project, x.path_to_fragments, x.selected_model = "p", {"s": "f.tsv"}, None
    yield x, tmp_path
    del sys.modules["pycisTopic"], sys.modules[module.__name__]


def test_pickled_topics(spark, topics):
    x, tmp_path = topics
    (tmp_path / "t.pkl").write_bytes(pickle.dumps(x, protocol=4))
    s = formats.read(spark, f"{tmp_path}/t.pkl")
    assert dense(s.matrices["X"]).tolist() == [[1, 0], [0, 3], [2, 0]] and column(s.obs, "n") == [1, 2, 3] and column(s.obs, "kind") == ["b", "a", "a"]
    assert dense(s.matrices["obsm/X_UMAP"]).tolist() == [[1, 4], [2, 5], [3, 6]] and column(s.var, "width") == [5, 6] and s.uns["pycistopic"]["path_to_fragments"] == {"s": "f.tsv"}
    x.cell_data = x.cell_data.rename({"c0": "c9"})
    (tmp_path / "u.pkl").write_bytes(pickle.dumps(x, protocol=4))
    with pytest.raises(ValueError, match="each name once"):
        pickles.read(spark, f"{tmp_path}/u.pkl")


def test_hostile_pickles_run_nothing(tmp_path):
    mark = tmp_path / "ran"

    class Bad:
        def __reduce__(self):
            return os.system, (f"touch {mark}",)

    for k, data in enumerate([pickle.dumps(Bad()), b"\x80\x04cbuiltins\neval\n(V1\ntR.", pickle.dumps(np.zeros(3, [("a", "i4")])), b"\x80\x04\x95"]):
        (tmp_path / f"{k}.pkl").write_bytes(data)
        with pytest.raises(ValueError):
            pickles.array(pickles.load(f"{tmp_path}/{k}.pkl"))
    assert not mark.exists()
    lying, dtype = pickles.Held(), pickles.Held("f8")
    lying.name, dtype.name = "numpy.core.multiarray._reconstruct", "numpy.dtype"
    dtype.state = (3, "<")
    lying.state = (1, (4,), dtype, False, b"12345678")
    with pytest.raises(ValueError, match="fill"):
        pickles.array(lying)


def test_pandas_frames_become_rows(spark):
    rows = pickles.frame_of(spark, pd.DataFrame({"i": pd.array([1, None], "Int64"), "t": ["a", None], "c": pd.Categorical(["x", "y"]), "b": [True, False]}))
    assert [tuple(r) for r in rows.collect()] == [(1, "a", "x", True), (None, None, "y", False)]
    with pytest.raises(ValueError, match="dates"):
        pickles.frame_of(spark, pd.DataFrame({"d": pd.to_datetime(["2020-01-01"])}))


def test_outputs_survive_the_dead(spark, tmp_path):
    target = f"{tmp_path}/out"
    files.write_bytes(spark, f"{tmp_path}/.out.lock", f"{socket.gethostname()} 999999999".encode())
    with files.staged(spark, target) as new:
        files.write_bytes(spark, new, b"1")
        with pytest.raises(FileExistsError, match="another process"), files.staged(spark, target):
            pass
    os.chmod(target, 0o640)
    os.symlink(target, f"{tmp_path}/link")
    with files.staged(spark, f"{tmp_path}/link", replace=True) as new:
        files.write_bytes(spark, new, b"2")
    assert os.path.islink(f"{tmp_path}/link") and open(target, "rb").read() == b"2" and os.stat(target).st_mode & 0o777 == 0o640
    files.write_bytes(spark, f"{tmp_path}/.other.lock", b"elsewhere 1")
    with pytest.raises(FileExistsError), files.staged(spark, f"{tmp_path}/other"):
        pass
    with pytest.raises(files.Ended) as e, files.staged(spark, f"{tmp_path}/third") as new:
        files.write_bytes(spark, new, b"3")
        os.kill(os.getpid(), signal.SIGTERM)
        signal.pause()
    assert e.value.code == 143 and not [n for n in os.listdir(tmp_path) if "third" in n]
    assert files.alias(spark, f"{tmp_path}/link", target) and files.alias(spark, str(tmp_path), target) and not files.alias(spark, f"{tmp_path}/nothing", target)
    with pytest.raises(OSError, match="free"):
        files.check_space(spark, target, 1 << 60)
    assert files.human(999) == "999 B" and files.human(1_234_567) == "1.2 MB" and cli.shown("a\x1b[0m") == "a\\x1b[0m"


def test_commands_take_any_format(spark, small, tmp_path, capsys):
    counts.write(small(["a", "b", "c"]), f"{tmp_path}/c.h5")
    cli.run(spark, ["convert", f"{tmp_path}/c.h5", "-o", f"{tmp_path}/c.zarr", "--var-names", "gene_symbols", "--zarr-format", "3"])
    cli.run(spark, ["ls", f"{tmp_path}/c.zarr", "--plain"])
    assert "var/gene_ids" in capsys.readouterr().out.split()
    cli.run(spark, ["convert", f"{tmp_path}/c.h5", "-o", f"{tmp_path}/parts.h5ad", "--split-feature-types"])
    assert {"parts.rna.h5ad", "parts.atac.h5ad"} <= set(os.listdir(tmp_path))
    (tmp_path / "i.png").write_bytes(arrays.png(np.array([[0, 255], [7, 8]], np.uint8)))
    cli.run(spark, ["import", f"{tmp_path}/parts.rna.h5ad", "image", f"{tmp_path}/i.png", "uns/picture", "-o", f"{tmp_path}/with.h5ad"])
    cli.run(spark, ["export", f"{tmp_path}/with.h5ad", "image", "uns/picture", "-o", f"{tmp_path}/o.tif"])
    assert arrays.read_image((tmp_path / "o.tif").read_bytes()).tolist() == [[0, 255], [7, 8]]
    with pytest.raises(ValueError, match="two things"):
        cli.run(spark, ["recast", f"{tmp_path}/with.h5ad", "--dtype", "float32", "--inplace", "-o", f"{tmp_path}/x"])
