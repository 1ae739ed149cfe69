"""Commands over stores: ``python -m axisframe.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import concat, matrix, modalities, reshape
from .sources import arrays, chunked, files, formats, mtx, mudata, store, tables, trees

#: Options of formats that take a text, and those that are said or not.
TEXT_OPTIONS = ("names", "feature_type", "genome", "sep", "layer", "key", "obs_names_key", "var_names_key", "obs_names_attr", "var_names_attr", "raw", "mod", "sample", "library_id", "default_embedding")
FLAG_OPTIONS = ("transpose", "make_unique", "dense", "scope", "unfiltered", "cells")


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("it is at least 1")
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="axisframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help: str, *output: str):
        q = sub.add_parser(name, help=help)
        if name in ("create", "subset", "concat", "convert", "recast", "split", "import"):
            q.add_argument("--zarr-format", type=int, choices=(2, 3), default=None)
            q.add_argument("--chunk", type=_positive, default=None, help="values in a chunk that is written")
            q.add_argument("--no-space-check", action="store_true")
        if "input" in output:
            q.add_argument("input")
        if "output" in output:
            q.add_argument("-o", "--output")
            q.add_argument("--inplace", action="store_true")
            q.add_argument("--force", action="store_true")
        return q

    q = add("view", "size and keys of a store, or one element", "input")
    q.add_argument("entry", nargs="?")
    q.add_argument("--tree", action="store_true")
    q.add_argument("--depth", type=int)
    q = add("ls", "list elements", "input")
    q.add_argument("under", nargs="?", default="")
    q.add_argument("--depth", type=int)
    q.add_argument("--long", action="store_true")
    q.add_argument("--plain", action="store_true", help="whole paths, one per line")
    q = add("create", "an empty store", "output")
    q.add_argument("--n-obs", type=int, default=0)
    q.add_argument("--n-var", type=int, default=0)
    q.add_argument("--obs-names")
    q.add_argument("--var-names")
    q = add("subset", "rows that queries and name lists select", "input", "output")
    for a in ("obs", "var"):
        q.add_argument(f"--{a}", help="a file of names, one per line")
        q.add_argument(f"--{a}-query")
    q = add("split", "one store per label", "input")
    q.add_argument("--by", required=True)
    q.add_argument("--output-dir", required=True)
    q.add_argument("--axis", choices=("obs", "var"), default="obs")
    q.add_argument("--min-size", type=int, default=0)
    q.add_argument("--dry-run", action="store_true")
    q.add_argument("--manifest")
    q.add_argument("--suffix", default="", help="an ending for each store's name")
    q = add("concat", "stores one after the other")
    q.add_argument("inputs", nargs="+")
    q.add_argument("-o", "--output", required=True)
    q.add_argument("--join", choices=("inner", "outer"), default="inner")
    q.add_argument("--label")
    q.add_argument("--keys", nargs="+")
    q.add_argument("--index-unique")
    q.add_argument("--merge", choices=[m for m in concat.MERGES if m])
    q.add_argument("--uns-merge", choices=[m for m in concat.MERGES if m])
    q.add_argument("--fill-value", type=float, default=0.0)
    q = add("recast", "another dtype or layout", "input", "output")
    q.add_argument("targets", nargs="*")
    q.add_argument("--all", action="store_true")
    q.add_argument("--dtype")
    q.add_argument("--layout")
    q.add_argument("--indices-dtype", choices=("int32", "int64"))
    q.add_argument("--in-memory", action="store_true", help="accepted; the plan is the same")
    q = add("convert", "another format", "input")
    q.add_argument("-o", "--output", required=True)
    q.add_argument("--from", dest="source_format")
    q.add_argument("--to", dest="target_format")
    q.add_argument("--force", action="store_true")
    for o in TEXT_OPTIONS:
        q.add_argument("--" + o.replace("_", "-"))
    for o in FLAG_OPTIONS:
        q.add_argument("--" + o.replace("_", "-"), action="store_true", default=None)
    q.add_argument("--var-names", choices=("gene_ids", "gene_symbols"))
    q.add_argument("--min-cell-probability", type=float, dest="least_probability")
    q.add_argument("--bin-size", type=int)
    q.add_argument("--no-images", action="store_false", dest="images", default=None)
    q.add_argument("--clusterings", type=lambda t: tuple(t.split(",")))
    q.add_argument("--split-feature-types", action="store_true")
    q.add_argument("--all-samples", action="store_true")
    for o in ("gene-ids-column", "gene-names-column", "feature-types-column"):
        q.add_argument(f"--{o}")
    q = add("export", "an element as a file", "input")
    q.add_argument("kind", choices=("dataframe", "array", "sparse", "dict", "image"))
    q.add_argument("entry")
    q.add_argument("-o", "--output", required=True)
    q.add_argument("--columns", nargs="+")
    q.add_argument("--head", type=int)
    q.add_argument("--scale", action="store_true")
    q = add("import", "a file as an element", "input", "output")
    q.add_argument("kind", choices=("dataframe", "array", "sparse", "dict", "image"))
    q.add_argument("file")
    q.add_argument("entry")
    q.add_argument("--index")
    return p


def _names(spark: SparkSession, path: str | None):
    """Names from a file, one per line; blank lines count for nothing."""
    if path is None:
        return None
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def _open(spark: SparkSession, path: str) -> store.Store:
    """A store of any kind; a folder of our own is opened as such."""
    return store.load(spark, path) if files.exists(spark, f"{path}/{store.MANIFEST}") else formats.read(spark, path)


def write(out: store.Store, target: str, replace: bool = False, sources: tuple[str, ...] = (), a=None) -> None:
    """A store in the form that the target's ending asks for, our own without one."""
    spark = out.spark
    if getattr(a, "chunk", None):
        trees.CHUNK = a.chunk
    if not replace and any(files.alias(spark, target, s) for s in sources):
        raise FileExistsError(f"{target} is also an input")
    if sources and not getattr(a, "no_space_check", False):
        files.check_space(spark, target, sum(files.size_of(spark, s) for s in sources))
    ended = next((f for f in formats.FORMATS if f.endings and f.write and target.lower().endswith(f.endings) and f.name in ("h5ad", "zarr")), None)
    if ended is None:
        store.save(out, target, replace_it=replace, sources=sources)
    elif ended.name == "zarr":
        chunked.write(out, target, replace, getattr(a, "zarr_format", None) or 3)
    else:
        ended.write(out, target, replace=replace)


def _save(a, out: store.Store) -> None:
    inplace = getattr(a, "inplace", False)
    if inplace and a.output:
        raise ValueError("--inplace and --output say two things")
    target = a.input if inplace else a.output
    if target is None:
        raise ValueError("an output is needed: --output or --inplace")
    write(out, target, a.force or inplace, () if inplace or not hasattr(a, "input") else (a.input,), a)


def put(s: store.Store, kind: str, file: str, entry: str, index: str | None = None) -> store.Store:
    """A store with the content of a file at an element path; shapes are checked first."""
    spark = s.spark
    if kind == "dataframe":
        if entry not in ("obs", "var"):
            raise ValueError("a table goes to obs or var")
        frame = tables.read_csv(spark, file, index)
        n, have = frame.data.count(), getattr(s, entry).data.count()
        if have and n != have:
            raise ValueError(f"{file} has {n} rows, {entry} has {have}")
        return store.Store(frame if entry == "obs" else s.obs, frame if entry == "var" else s.var, s.matrices, s.frames, s.uns, s.raw)
    if kind == "dict":
        head, *steps = entry.split("/")
        if head != "uns":
            raise ValueError("metadata goes under uns")
        value = arrays.import_json(files.read_bytes(spark, file).decode("utf-8"))
        uns = dict(s.uns)
        at = uns
        for k in steps[:-1]:
            at[k] = dict(at.get(k) or {})
            at = at[k]
        if steps:
            at[steps[-1]] = value
        else:
            uns = value
        return store.Store(s.obs, s.var, s.matrices, s.frames, uns, s.raw)
    if kind == "image":
        head, *steps = entry.split("/")
        if head != "uns" or not steps:
            raise ValueError("an image goes under uns")
        uns = dict(s.uns)
        at = uns
        for k in steps[:-1]:
            at[k] = dict(at.get(k) or {})
            at = at[k]
        at[steps[-1]] = arrays.read_image(files.read_bytes(spark, file)).tolist()
        return store.Store(s.obs, s.var, s.matrices, s.frames, uns, s.raw)
    m = mtx.read(spark, file) if kind == "sparse" else arrays.read_npy(spark, file)
    store.check_shape(s, entry, m.shape)
    return s.with_matrix(entry, m)


def run(spark: SparkSession, argv: list[str]) -> None:
    """Run a command; what is refused raises before any output exists."""
    a = _parser().parse_args(argv)
    if a.command == "create":
        _save(a, store.create(spark, a.n_obs, a.n_var, _names(spark, a.obs_names), _names(spark, a.var_names)))
        return
    if a.command == "convert":
        _convert(spark, a)
        return
    if a.command == "concat":
        keys = a.keys or [p.rstrip("/").rpartition("/")[2].partition(".")[0] for p in a.inputs]
        if len(set(keys)) < len(a.inputs) or len(keys) != len(a.inputs):
            raise ValueError("keys must be as many as the inputs, and distinct")
        stores = {k: _open(spark, p) for k, p in zip(keys, a.inputs, strict=True)}
        out = concat.concat(stores, a.join, a.merge, a.uns_merge, a.label, a.index_unique, a.fill_value)
        write(out, a.output, sources=tuple(a.inputs), a=a)
        return
    s = _open(spark, a.input)
    if a.command == "view":
        if a.entry:
            print("\n".join(store.listing(s, a.entry, 1, details=True)))
        else:
            print("\n".join(store.listing(s, depth=a.depth)) if a.tree else store.summary(s))
    elif a.command == "ls":
        print("\n".join([e["path"] for e in store.describe(s) if not a.under or e["path"].startswith(a.under)] if a.plain else store.listing(s, a.under, a.depth, a.long)))
    elif a.command == "subset":
        _save(a, reshape.subset(s, a.obs_query, a.var_query, _names(spark, a.obs), _names(spark, a.var)))
    elif a.command == "split":
        if a.dry_run:
            for p in reshape.parts(s, a.by, a.axis, a.min_size):
                print(p.stem, p.rows)
            return
        listed = reshape.save_split(s, a.by, a.output_dir, a.axis, a.min_size, suffix=a.suffix)
        if a.manifest:
            with files.staged(spark, a.manifest) as new:
                tables.one_file(listed.orderBy("id").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in listed.columns]), new, ",".join(listed.columns))
    elif a.command == "recast":
        if a.indices_dtype:
            for path in store.matrices(s) if a.all else a.targets or ["X"]:
                m = s.matrices[path] if not path.startswith("raw/") else s.raw.matrices[path[4:]]
                matrix.index_dtype(max(m.data.count(), *m.shape), a.indices_dtype)
        _save(a, reshape.recast(s, ["*"] if a.all else a.targets, a.dtype, a.layout, a.force))
    elif a.command == "export":
        _export(s, a)
    elif a.command == "import":
        _save(a, put(s, a.kind, a.file, a.entry, a.index))


def _convert(spark: SparkSession, a) -> None:
    """One format to another, or to a store for each modality, feature type or sample."""
    if a.chunk:
        trees.CHUNK = a.chunk
    options = {k: v for k in (*TEXT_OPTIONS, *FLAG_OPTIONS, "least_probability", "bin_size", "images", "clusterings") if (v := getattr(a, k)) is not None}
    if a.var_names:
        options["names"] = a.var_names.removeprefix("gene_")
    if not a.no_space_check and files.exists(spark, a.input) and not files.names(spark, a.input):
        files.check_space(spark, a.output, files.size_of(spark, a.input))
    of = formats.by_name(a.input, a.source_format) if a.source_format else formats.detect(spark, a.input)
    stem, dot, ending = a.output.rpartition(".")
    named = lambda x: f"{stem}.{x}{dot}{ending}" if dot else f"{a.output}.{x}"
    if a.all_samples:
        for sample in mtx.samples(spark, a.input, bool(a.unfiltered)):
            formats.convert(spark, a.input, named(sample), a.source_format, a.target_format, a.force, sample=sample, **options)
        return
    if of.name == "mudata" and "mod" not in options:
        parts = mudata.read_all(spark, a.input)
        for mod, one in parts.items():
            write(one, named(mod) if len(parts) > 1 else a.output, a.force, a=a)
        return
    if a.split_feature_types:
        odd = [k for k in options if k not in of.options]
        if odd:
            raise ValueError(f"{of.name} takes no {odd[0]}")
        for mod, one in modalities.by_type(of.read(spark, a.input, **options)).items():
            write(one, named(mod), a.force, a=a)
        return
    columns = {"gene_ids": a.gene_ids_column, "gene_symbols": a.gene_names_column, "feature_types": a.feature_types_column}
    to = formats.by_name(a.output, a.target_format)
    if any(columns.values()) or to.name == "zarr":
        s = of.read(spark, a.input, **{k: v for k, v in options.items() if k in of.options})
        for new, old in columns.items():
            if old and old not in s.var.columns:
                raise KeyError(f"var has no column {old!r}")
            if old and old != new:
                s = store.Store(s.obs, store.Frame(s.var.data.drop(new).withColumnRenamed(old, new), s.var.categories), s.matrices, s.frames, s.uns, s.raw)
        if to.name == "zarr":
            chunked.write(s, a.output, a.force, a.zarr_format or 3)
        else:
            to.write(s, a.output, replace=a.force, **{k: v for k, v in options.items() if k in to.writes})
        return
    formats.convert(spark, a.input, a.output, a.source_format, a.target_format, a.force, **options)


def _image(s: store.Store, entry: str):
    """An array under uns, or a dense matrix, as what an image is made of."""
    import numpy as np

    if entry in s.matrices:
        m = matrix.densified(s.matrices[entry])
        if m.shape[0] * m.shape[1] > 1 << 26:
            raise ValueError(f"{entry} is too large for an image")
        return np.array([r[0] for r in m.data.orderBy("i").select("values").collect()], m.dtype).reshape(m.shape)
    value = s.uns
    for step in entry.split("/")[1:] if entry.startswith("uns/") else [None]:
        if not isinstance(value, dict) or step not in value:
            raise KeyError(f"there is no {entry!r}")
        value = value[step]
    return np.array(value)


def _export(s: store.Store, a) -> None:
    if a.kind == "image":
        with files.staged(s.spark, a.output) as new:
            files.write_bytes(s.spark, new, arrays.image_bytes(_image(s, a.entry), a.output, a.scale))
        return
    if a.kind == "dataframe":
        frame = {"obs": s.obs, "var": s.var, **s.frames}.get(a.entry)
        if frame is None:
            raise KeyError(f"there is no frame {a.entry!r}")
        tables.write_csv(frame, a.output, a.columns, a.head)
    elif a.kind == "dict":
        with files.staged(s.spark, a.output) as new:
            files.write_bytes(s.spark, new, arrays.export_json(s, a.entry).encode())
    elif a.entry in s.matrices:
        m = s.matrices[a.entry]
        if a.kind == "sparse":
            mtx.write(m, a.output, a.head)
        else:
            from .operators.matrix import densified

            arrays.write_npy(densified(m), a.output)
    else:
        frame, _, column = a.entry.partition("/")
        if frame not in ("obs", "var") or column not in getattr(s, frame).columns:
            raise KeyError(f"there is no {a.entry!r}")
        with files.staged(s.spark, a.output) as new:
            files.write_bytes(s.spark, new, arrays.npy_bytes(getattr(s, frame).data, column))


def shown(text: str) -> str:
    """A message that a terminal shows as it is: controls that names may hold as escapes."""
    return "".join(c if c.isprintable() or c == "\n" else c.encode("unicode_escape").decode() for c in text)


def main() -> int:
    """The process: one line on what was refused, and 1."""
    spark = SparkSession.builder.appName("axisframe").getOrCreate()
    try:
        run(spark, sys.argv[1:])
        return 0
    except (ValueError, KeyError, OSError) as e:
        print(f"Error: {shown(str(e.args[0] if e.args else e))}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
