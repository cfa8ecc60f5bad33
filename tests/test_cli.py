"""The command line on the fixture graph and a small store, and the text sinks."""

import pytest

from loomgraph import cli
from loomgraph.operators import dedup_store as ds
from loomgraph.sources import edges as src

GRAPH = "1 2 10\n1 3 5\n1 5 2"


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


@pytest.fixture
def graph(tmp_path):
    at = tmp_path / "edges.txt"
    at.write_text(GRAPH)
    return at


def test_read_edges_and_sinks(spark, graph, tmp_path):
    got = src.read_edges(spark, str(graph))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 10), (1, 3, 5), (1, 5, 2)]
    assert src.read_edges(spark, str(graph), weighted=False).columns == ["src", "dst"]
    rows = spark.createDataFrame([(i, f"line {i}") for i in (5, -1, 30, 2)], "id long, value string")
    for _ in range(2):  # the second run replaces the first
        src.write_lines(rows, str(tmp_path / "out"))
    assert lines(tmp_path / "out") == ["line -1", "line 2", "line 5", "line 30"]


def test_graph_commands(spark, graph, tmp_path, capsys):
    cli.main(["pagerank", "0.4", "1", str(graph), str(tmp_path / "ranks")])
    assert lines(tmp_path / "ranks") == ["1 0.2125", "2 0.2625", "3 0.2625", "5 0.2625"]
    cli.main(["sssp", str(graph), str(tmp_path / "paths"), "1", "0", "weighted"])
    assert lines(tmp_path / "paths") == ["1 0 nil", "2 10 1", "3 5 1", "5 2 1"]
    cli.main(["sssp", str(graph), str(tmp_path / "hops"), "1", "2", "hops"])
    assert lines(tmp_path / "hops") == ["1 0 nil", "2 1 1", "3 1 1", "5 1 1"]
    assert capsys.readouterr().out.count("seconds: ") == 3


def test_store_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    one, two = tmp_path / "in" / "one.txt", tmp_path / "in" / "two.bin"
    one.write_text(GRAPH)
    two.write_bytes(bytes(range(256)) * 100)
    store = str(tmp_path / "store")
    cli.main(["upload", "4096", "8192", "16384", "257", str(tmp_path / "in"), store])
    told = capsys.readouterr().out
    assert "files: 2\n" in told and f"logical bytes: {18 + 25600}\n" in told and "ratio: " in told and "seconds: " in told
    assert len(told.partition("ratio: ")[2].splitlines()[0].partition(".")[2]) == 2
    paths = sorted(r["path"] for r in ds.DedupStore(spark, store).recipe.select("path").distinct().collect())
    for path, file in zip(paths, (one, two), strict=True):
        cli.main(["download", path, str(tmp_path / "got"), store])
        assert (tmp_path / "got").read_bytes() == file.read_bytes()
    cli.main(["delete", paths[1], store])
    assert "files: 1\n" in capsys.readouterr().out
    cli.main(["vacuum", store])
    cli.main(["report", store])
    assert "logical bytes: 18\n" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["download", paths[1], str(tmp_path / "got"), store])
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
