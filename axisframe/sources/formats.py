"""Which format a path has, and how to read it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import chunked, counts, files, hdf5, loom, mtx, mudata, pickles, spatial, store, tables


@dataclass(frozen=True)
class Format:
    """A format: a test of a path's content, a reader, a writer if there is one, the options that the reader takes, its
    endings, the options that the writer takes."""

    name: str
    sniff: Callable[[SparkSession, str], bool]
    read: Callable
    write: Callable | None = None
    options: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()


def _has(*wanted: str):
    def sniff(spark: SparkSession, path: str) -> bool:
        have = [n.removesuffix(".gz") for n in files.names(spark, path)]
        return all(any(n.endswith(w) for n in have) for w in wanted)

    return sniff


def _starts(*heads: bytes):
    def sniff(spark: SparkSession, path: str) -> bool:
        if files.names(spark, path) or not files.exists(spark, path):
            return False
        return any(files.read_bytes(spark, path, len(h)) == h for h in heads)

    return sniff


def _text(spark: SparkSession, path: str) -> bool:
    if files.names(spark, path) or not files.exists(spark, path):
        return False
    try:
        tables.layout(spark, path)
    except (ValueError, IndexError):
        return False
    return True


def _matrix_only(spark: SparkSession, path: str):
    m = mtx.read(spark, path)
    empty = store.create(spark, *m.shape)
    return empty.with_matrix("X", m)


def _annotated_file(spark: SparkSession, path: str) -> bool:
    if not _starts(hdf5.MAGIC)(spark, path):
        return False
    tree = hdf5.FileTree(spark, path)
    return tree.exists("obs") and tree.exists("var")


_COUNTS = ("names", "feature_type", "genome", "make_unique")
#: In the order in which content is tested; the store itself comes last, and a matrix of text after all that is marked.
FORMATS = (
    Format("cellbender", counts.has_latents, counts.read_cleaned, options=(*_COUNTS, "least_probability", "raw")),
    Format("10x-h5", counts.is_counts, counts.read, counts.write, _COUNTS, (".h5",), ("layer", "force")),
    Format("loom", loom.is_loom, loom.read, loom.write, ("layer", "dense", "names", "obs_names_attr", "var_names_attr", "make_unique"), (".loom",), ("layer", "scope", "clusterings", "default_embedding")),
    Format("mudata", mudata.is_modalities, mudata.read, mudata.write, ("mod",), (".h5mu",), ("mod", "column")),
    Format("h5ad", _annotated_file, hdf5.read, hdf5.write, endings=(".h5ad",)),
    Format("hdf5", lambda spark, path: False, hdf5.read_dataset, options=("key", "transpose", "dense", "obs_names_key", "var_names_key", "make_unique"), endings=(".hdf5", ".he5")),
    Format("visium", spatial.is_slide, spatial.read_slide, options=(*_COUNTS, "unfiltered", "bin_size", "cells", "library_id", "images")),
    Format("xenium", spatial.is_bundle, spatial.read_bundle, options=_COUNTS),
    Format("run", lambda spark, path: bool(files.names(spark, path)) and mtx.run_folder(spark, path) is not None, mtx.read_run, options=("genome", "sample", "unfiltered", "names", "make_unique")),
    Format("mtx-folder", mtx.is_folder, mtx.read_folder, mtx.write_folder, _COUNTS),
    Format("pickle", pickles.is_pickle, pickles.read, options=("dense",), endings=(".pkl", ".pickle")),
    Format("mtx", _starts(mtx.BANNER.encode()), _matrix_only, lambda s, p, replace=False: mtx.write(s.matrices["X"], p, replace=replace), endings=(".mtx", ".mtx.gz")),
    Format("text", _text, tables.read_dense, options=("transpose", "sep"), endings=(".csv", ".tsv", ".txt", ".csv.gz", ".tsv.gz", ".txt.gz")),
    Format("zarr", lambda spark, path: any(n in (".zgroup", "zarr.json") for n in files.names(spark, path)), chunked.read, chunked.write, endings=(".zarr",)),
    Format("store", _has(store.MANIFEST), store.load, lambda s, p, replace=False: store.save(s, p, replace), endings=(".store",)),
)
# Files that are named when they are refused, and how they begin.
UNREADABLE = {"HDF5 without a layout that is known (name one, hdf5 with a key for one array)": (hdf5.MAGIC,)}


def detect(spark: SparkSession, path: str) -> Format:
    """The format of what is at a path, by content, else by ending; what needs a library that is not here is named."""
    for f in FORMATS:
        if f.name != "text" and f.sniff(spark, path):
            return f
    for kind, heads in UNREADABLE.items():
        if _starts(*heads)(spark, path):
            raise ValueError(f"{path} is a file of {kind}, which is not read here")
    text = next(f for f in FORMATS if f.name == "text")
    if text.sniff(spark, path):
        return text
    return by_name(path)


def by_name(path: str, wanted: str | None = None) -> Format:
    """A format by its name, else by the ending of a path; an ending of another format contradicts a name."""
    ended = next((f for f in FORMATS if path.lower().endswith(f.endings) and f.endings), None)
    if wanted is None:
        if ended is None:
            raise ValueError(f"{path}: no format has this ending; name one of {', '.join(f.name for f in FORMATS)}")
        return ended
    found = next((f for f in FORMATS if f.name == wanted), None)
    if found is None:
        raise ValueError(f"no format {wanted!r}: {', '.join(f.name for f in FORMATS)}")
    if ended is not None and ended is not found:
        raise ValueError(f"{path} ends as {ended.name}, not {wanted}")
    return found


def read(spark: SparkSession, path: str, name: str | None = None, **options) -> store.Store:
    """Read any format; options that it does not take are refused."""
    f = by_name(path, name) if name else detect(spark, path)
    odd = [k for k in options if k not in f.options]
    if odd:
        raise ValueError(f"{f.name} takes no {odd[0]}")
    return f.read(spark, path, **options)


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str | None = None, replace: bool = False, **options) -> None:
    """Read one format and write another; all checks of the source come before any output. An option goes to the side that
    takes it, one that neither takes is refused."""
    to = by_name(target, target_format)
    if to.write is None:
        raise ValueError(f"{to.name} is not written")
    of = by_name(source, source_format) if source_format else detect(spark, source)
    odd = [k for k in options if k not in of.options and k not in to.writes]
    if odd:
        raise ValueError(f"neither {of.name} nor {to.name} takes {odd[0]}")
    found = of.read(spark, source, **{k: v for k, v in options.items() if k in of.options})
    to.write(found, target, replace=replace, **{k: v for k, v in options.items() if k in to.writes and k not in of.options})
