import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_library_alone_imports_nothing_of_llm():
    code = "import sys, __spark_entry__ as e, loomgraph.cli, loomgraph.streaming.ingest; print(any('llm' in m for m in sys.modules))"
    root = Path(entry.__file__).resolve().parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() == "False"


@pytest.mark.skipif(not SF.exists() or importlib.util.find_spec("duckdb") is None, reason="needs the test tables and duckdb")
@pytest.mark.parametrize("name", ["adjacency_list", "pagerank_k3", "sssp_w_conv", "sssp_reach", "bfs_conv", "container_layout", "pagerank_text", "delete_gc", "vacuum", "legacy_index", "store_report", "sssp_round_counts", "download_ranged"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, str(SF))
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_library_without_a_library_of_the_corpus_operators():
    """Where an import of theirs fails, the other queries are there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), 'op10_secrets' in e.queries(), 'pagerank_k3' in e.queries())"
    root = Path(entry.__file__).resolve().parent
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out[1:] == ["False", "True"]
