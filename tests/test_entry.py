import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from axisframe.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
TABLES = "/root/testdata/sf0.001"


def test_core_stands_without_the_text_operators(tmp_path):
    """After the two optional folders are deleted, and nothing else, what is left imports and registers its queries."""
    top = tmp_path / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(top / "axisframe" / "llm", ignore_errors=True)
    shutil.rmtree(top / "tests" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'subset_query' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); import axisframe.cli"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(top)})


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(repr([None if v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r]) for r in rows)


#: Queries that write whole files in one format or other, which the tests of the formats hold already. The names of all
#: registered queries are held against their SQL if AXISFRAME_ALL is set.
OF_FORMATS = frozenset(
    "ambient_of_features cleaned_cells cleaned_counts commands convert_h5ad_to_folder count_file_round_trip count_file_symbols dataset_of_a_file dense_array_round_trip folder_v2_round_trip folder_v3_obs formats_told h5ad_obs "
    "h5ad_round_trip import_frame import_matrix loom_attributes loom_round_trip modalities_round_trip modality_global_columns mtx_folder_round_trip pairwise_round_trip raw_counts_of_cleaned split_stores store_round_trip "
    "viewer_clusterings concat_graph merge_unique merge_first head_entries csv_rows_of_a_value".split()
)


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLES if "AXISFRAME_ALL" in os.environ or n not in OF_FORMATS))
def test_query_agrees_with_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, TABLES)
    rel = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    assert plain(tuple(r) for r in df.collect()) == plain(tuple(r[k] for k in order) for r in rel.fetchall())
