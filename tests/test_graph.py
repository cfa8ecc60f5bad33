import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import pagerank as pr
from loomgraph.operators import sssp as sp
from loomgraph.operators.links import HUBS, by_source
from loomgraph.sources import edges as src

F1 = [(1, 2, 10), (1, 3, 5), (1, 5, 2)]
WEIGHTED = "src long, dst long, w long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fixture_paths(spark):
    g = spark.createDataFrame(F1, WEIGHTED)
    assert rows(sp.sssp(g, 1)) == [(1, 0, None), (2, 10, 1), (3, 5, 1), (5, 2, 1)]
    assert rows(sp.sssp(g, 1, weighted=False)) == [(1, 0, None), (2, 1, 1), (3, 1, 1), (5, 1, 1)]
    assert rows(src.path_lines(sp.sssp(g, 1)).select("value"))[0] == ("1 0 nil",)
    assert rows(sp.sssp(g, 2)) == [(2, 0, None)]  # a sink as the source
    assert rows(sp.sssp(g, 99)) == []


def test_fixture_ranks(spark):
    g = spark.createDataFrame(F1, WEIGHTED)
    for k, first, other in ((0, 0.25, 0.25), (1, 0.2125, 0.2625), (2, 0.218125, 0.260625)):
        got = dict(rows(pr.pagerank(g, 0.4, k)))
        assert got == pytest.approx({1: first, 2: other, 3: other, 5: other})
        assert sum(got.values()) == pytest.approx(1)
    assert rows(src.rank_lines(pr.pagerank(g, 0.4, 1)).select("value")) == [("1 0.2125",), ("2 0.2625",), ("3 0.2625",), ("5 0.2625",)]
    with pytest.raises(ValueError):
        pr.pagerank(g, 1.5, 1)
    assert rows(pr.pagerank(spark.createDataFrame([], WEIGHTED), 0.4, 2)) == []


def test_paths_against_bellman_ford(spark):
    rng = random.Random(5)
    es = [(rng.randrange(30), rng.randrange(30), rng.randrange(6)) for _ in range(120)]
    dist = {0: 0}
    for _ in range(40):
        for a, b, w in es:
            if a in dist and dist[a] + w < dist.get(b, 10**9):
                dist[b] = dist[a] + w
    got = {i: (d, p) for i, d, p in rows_of(sp.sssp(spark.createDataFrame(es, WEIGHTED), 0))}
    assert {i: d for i, (d, _) in got.items()} == dist
    best = {}
    for a, b, w in es:
        best[a, b] = min(w, best.get((a, b), 10**9))
    assert all(p is None and i == 0 or dist[p] + best[p, i] == d for i, (d, p) in got.items())
    reach = {i: d for i, d, _ in rows_of(sp.sssp(spark.createDataFrame(es, WEIGHTED), 0, until="reach"))}
    assert reach.keys() == dist.keys() and all(reach[i] >= dist[i] for i in dist)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_negative_weight_and_grammar(spark):
    with pytest.raises(ValueError):
        sp.sssp(spark.createDataFrame([(1, 2, -1)], WEIGHTED), 1)
    lines = spark.createDataFrame([("1 2 10",), ("",), ("  \t ",), ("1\t3  5 ",), ("0 -1 0 extra",)], "value string")
    assert rows(src.parse_edges(lines)) == [(0, -1, 0), (1, 2, 10), (1, 3, 5)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        src.parse_edges(spark.createDataFrame([("a b c",)], "value string")).collect()


def test_zero_cycle_and_parallel_edges(spark):
    es = [(0, 1, 0), (1, 0, 0), (1, 2, 3), (1, 2, 1), (2, 2, 0)]
    assert rows(sp.sssp(spark.createDataFrame(es, WEIGHTED), 0)) == [(0, 0, None), (1, 0, 0), (2, 1, 1)]
    assert dict(rows(pr.out_degree(spark.createDataFrame(es, WEIGHTED)))) == {0: 1, 1: 3, 2: 1}


def test_a_round_shuffles_the_contributions_alone(spark):
    """With broadcasts off: one exchange for a round of ranks."""
    from loomgraph.session import bucketed

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = spark.createDataFrame([(i, (i * 7 + 1) % 50, 1) for i in range(200)], WEIGHTED)
        every = bucketed(pr.nodes(g), "nodes", "id")
        shares = by_source(g, pr.link_counts, "shares")
        assert shares.heavy is None
        step = pr.received(every, pr.push(every.withColumn("rank", F.lit(0.02)), shares))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hubs(spark):
    """Sources with a large share of all links, some of them parallel: their links lie apart, each
    bucket is one file, and ranks and paths are those of plain rounds."""
    rng = random.Random(8)
    es = [(0, rng.randrange(1, 300), rng.randrange(1, 9)) for _ in range(900)] + [(1, i, 2) for i in range(200, 400)] + [(rng.randrange(400), rng.randrange(400), rng.randrange(1, 9)) for _ in range(500)] + [(None, 3, 1), (3, None, 1)]
    g = spark.createDataFrame(es, WEIGHTED)
    es = es[:-2]
    links = by_source(g.filter("src is not null and dst is not null"), pr.link_counts, "shares")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {0, 1} <= {r["id"] for r in links.hubs.collect()} and links.hubs.count() <= HUBS * buckets
    assert links.usual.filter("src in (0, 1)").isEmpty() and len(links.usual.inputFiles()) <= buckets
    every = sorted({x for a, b, _ in es for x in (a, b)})
    out = {a: sum(e[0] == a for e in es) for a in every}
    rank = dict.fromkeys(every, 1 / len(every))
    for _ in range(3):
        got = dict.fromkeys(every, 0.0)
        for a, b, _ in es:
            got[b] += rank[a] / out[a]
        lost = 1 - sum(got.values())
        rank = {v: 0.2 / len(every) + 0.8 * (lost / len(every) + got[v]) for v in every}
    assert {r["id"]: pytest.approx(r["rank"], rel=1e-9) for r in pr.pagerank(g, 0.2, 3).collect()} == rank
    for source, weighted in ((0, True), (5, True), (0, False)):
        dist = {source: 0}
        while True:
            best = dict(dist)
            for a, b, w in es:
                if a in dist:
                    best[b] = min(best.get(b, 1 << 60), dist[a] + (w if weighted else 1))
            if best == dist:
                break
            dist = best
        assert {r["id"]: r["dist"] for r in sp.sssp(g, source, 0, weighted).collect()} == dist
    with pytest.raises(ValueError, match="negative"):
        sp.sssp(g.unionByName(spark.createDataFrame([(0, 5, -1)], WEIGHTED)), 0)


def test_many_rounds(spark):
    """A long chain with a detour: more rounds than tables are kept apart."""
    es = [(i, i + 1, 1) for i in range(14)] + [(0, 14, 50), (3, 9, 20), (14, 0, 1)]
    got = {r["id"]: (r["dist"], r["prev"]) for r in sp.sssp(spark.createDataFrame(es, WEIGHTED), 0).collect()}
    assert got == {0: (0, None)} | {i: (i, i - 1) for i in range(1, 15)}
