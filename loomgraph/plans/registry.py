"""Queries over the star-schema tables, one for each operator family, and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import dedup_store as ds
from ..operators import pagerank as pr
from ..operators import sssp as sp
from ..operators.links import Links
from ..session import saved, scratch_dir
from ..sources import edges as src
from ..verify import differences

ALPHA, SOURCE = 0.4, 0
LEAST, AVG, MOST, BASE = 128, 512, 1024, 257
DELETED = "0"

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return saved(chunking.chunk(src.document_files(spark, d), LEAST, AVG, MOST, BASE), "chunks")


def _layout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, d)
    return chunks, ds.next_fit(ds.first_occurrences(chunks))


def _edges_from_text(spark: SparkSession, d: str, weighted: bool) -> DataFrame:
    g = src.dense_graph(spark, d)
    return src.parse_edges(g.select(F.concat_ws(" \t", *[F.col(c).cast("string") for c in g.columns]).alias("value")), weighted)


def _ranks(graph, k: int) -> Query:
    return lambda s, d: pr.pagerank(graph(s, d), ALPHA, k).select("id", F.round("rank", 9).alias("rank"))


def _paths(graph, k: int, weighted: bool = True, until: str = "distance") -> Query:
    return lambda s, d: sp.sssp(graph(s, d), SOURCE, k, weighted, until)


def _pushed(s: SparkSession, d: str) -> DataFrame:
    g = src.dense_graph(s, d)
    every = pr.nodes(g)
    return pr.push(every.withColumn("rank", F.lit(1.0 / every.count())), Links(pr.link_counts(g)))


def _mass(s: SparkSession, d: str) -> DataFrame:
    return pr.received(pr.nodes(src.dense_graph(s, d)), _pushed(s, d)).agg(F.round(1 - F.sum("p"), 9).alias("mass"))


def _round_counts(s: SparkSession, d: str) -> DataFrame:
    counts = sp.search(src.dense_graph(s, d), SOURCE)[1]
    return s.createDataFrame([(c["round"], c["improved"], c["reached"]) for c in counts], "round int, improved long, reached long")


def _store(s: SparkSession) -> ds.DedupStore:
    return ds.DedupStore(s, f"{scratch_dir(s)}/store-{uuid.uuid4().hex}")


def _uploaded(s: SparkSession, d: str) -> ds.DedupStore:
    store = _store(s)
    store.upload(src.document_files(s, d), LEAST, AVG, MOST, BASE)
    return store


def _download(s: SparkSession, d: str) -> DataFrame:
    got = _uploaded(s, d).download()
    return got.select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"))


def _ranged(s: SparkSession, d: str) -> DataFrame:
    parts = chunking.chunk(src.document_files(s, d), 2, 2, 2, BASE, with_content=True)  # many chunks: several ranges a file
    return ds.join_chunks(parts.select("path", "chunk_no", "content")).select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"))


def _deleted(s: SparkSession, d: str) -> DataFrame:
    store = _uploaded(s, d)
    return store.delete(DELETED).select("files", "logical_chunks", "unique_chunks", "logical_bytes", "unique_bytes")


def _vacuumed(s: SparkSession, d: str) -> DataFrame:
    """Half of the files after the other half was deleted and the store vacuumed: their bytes, read
    from containers of which none has less than half of its bytes alive."""
    files = src.document_files(s, d)
    store = _store(s)
    odd = F.col("path").cast("long") % 2 == 1
    store.upload(files.filter(odd).withColumn("path", F.concat(F.lit("old-"), "path")), LEAST, AVG, MOST, BASE)
    store.upload(files, LEAST, AVG, MOST, BASE)
    store.delete_all(files.filter(odd).select(F.concat(F.lit("old-"), "path").alias("path")).unionByName(files.filter(odd).select("path")))
    store.vacuum()
    return store.download().select(F.col("path").cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"))


def _guard(s: SparkSession, d: str) -> DataFrame:
    """Which of the documents and their copies under new names an upload would refuse."""
    files = src.document_files(s, d).select("path")
    recipe = _chunks(s, d).select("path").distinct()
    offered = files.unionByName(files.select(F.concat(F.lit("copy-"), "path").alias("path")))
    known = offered.join(recipe, "path", "left_semi").withColumn("refused", F.lit(True))
    return known.unionByName(offered.join(recipe, "path", "left_anti").withColumn("refused", F.lit(False)))


def _golden(s: SparkSession, d: str) -> DataFrame:
    g = src.dense_graph(s, d)
    lines = lambda weighted: src.path_lines(sp.sssp(g, SOURCE, 0, weighted)).select("value")
    return differences(lines(True), lines(False))


def _legacy_index(s: SparkSession, d: str) -> DataFrame:
    chunks, index = _layout(s, d)
    return ds.read_index_text(ds.index_text(chunks, index).select("value")).select("hash", "container_id", "offset", "size")


def _legacy_recipe(s: SparkSession, d: str) -> DataFrame:
    return ds.read_recipe_text(ds.recipe_text(_chunks(s, d)))


def queries() -> dict[str, Query]:
    dense, sparse = src.dense_graph, src.sparse_graph
    return {
        "edges_weighted": lambda s, d: _edges_from_text(s, d, True),
        "edges_unweighted": lambda s, d: _edges_from_text(s, d, False),
        "graph_nodes": lambda s, d: pr.nodes(dense(s, d)),
        "node_count": lambda s, d: pr.nodes(dense(s, d)).agg(F.count("*").alias("n")),
        "out_degree": lambda s, d: pr.out_degree(dense(s, d)),
        "adjacency_list": lambda s, d: pr.adjacency_lists(dense(s, d)).select("src", F.concat_ws(" ", F.transform("adj", lambda x: x.cast("string"))).alias("adj")),
        "adjacency_map_min": lambda s, d: pr.adjacency_maps(dense(s, d)).select("src", F.concat_ws(" ", F.transform(F.map_entries("adj"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))).alias("adj")),
        "pr_contrib_sum": lambda s, d: _pushed(s, d).select(F.col("dst").alias("id"), F.round("p", 9).alias("p")),
        "pr_missing_mass": _mass,
        "pagerank_k0": _ranks(dense, 0),
        "pagerank_k1": _ranks(dense, 1),
        "pagerank_k3": _ranks(dense, 3),
        "pagerank_sparse_k3": _ranks(sparse, 3),
        "pagerank_text": lambda s, d: src.rank_lines(pr.pagerank(sparse(s, d), ALPHA, 2)),
        "sssp_w_k1": _paths(dense, 1),
        "sssp_w_k3": _paths(dense, 3),
        "sssp_w_conv": _paths(dense, 0),
        "sssp_sparse": _paths(sparse, 0),
        "bfs_k3": _paths(dense, 3, False),
        "bfs_conv": _paths(dense, 0, False),
        "sssp_reach": _paths(dense, 0, True, "reach"),
        "sssp_round_counts": _round_counts,
        "sssp_text": lambda s, d: src.path_lines(sp.sssp(dense(s, d), SOURCE)),
        "cdc_anchors": lambda s, d: chunking.anchor_points(src.document_files(s, d), LEAST, AVG, BASE).select(F.col("path").cast("long").alias("doc_id"), "end_offset"),
        "cdc_boundaries": lambda s, d: _chunks(s, d).select(F.col("path").cast("long").alias("doc_id"), "chunk_no", "start_offset", "size"),
        "cdc_trace": lambda s, d: _chunks(s, d).select(F.col("path").cast("long").alias("doc_id"), (F.col("start_offset") + F.col("size")).alias("end_offset")),
        "fixed_chunks": lambda s, d: chunking.chunk(src.document_files(s, d), 256, 256, 256, BASE).select(F.col("path").cast("long").alias("doc_id"), "chunk_no", "start_offset", "size", "hash"),
        "chunk_hashes": lambda s, d: _chunks(s, d).select(F.col("path").cast("long").alias("doc_id"), "chunk_no", "hash"),
        "fingerprint_index": lambda s, d: ds.first_occurrences(_chunks(s, d)),
        "refcounts": lambda s, d: ds.refcounts(_chunks(s, d)),
        "file_recipe": lambda s, d: _chunks(s, d).select("path", "chunk_no", "hash"),
        "chunk_count_per_file": lambda s, d: _chunks(s, d).groupBy("path").agg(F.count("*").alias("chunks")),
        "container_layout": lambda s, d: _layout(s, d)[1],
        "container_liveness": lambda s, d: ds.liveness(*_layout(s, d)),
        "store_report": lambda s, d: _uploaded(s, d).report(),
        "legacy_index": _legacy_index,
        "legacy_recipe": _legacy_recipe,
        "download_roundtrip": _download,
        "download_ranged": _ranged,
        "delete_gc": _deleted,
        "vacuum": _vacuumed,
        "upload_guard": _guard,
        "golden_diff": _golden,
    }


_DENSE = "g AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE l_partkey <> l_suppkey)"
_SPARSE = "g AS (SELECT o_custkey AS src, l_suppkey AS dst, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey GROUP BY 1, 2)"
_NODES = "n AS (SELECT src AS id FROM g UNION SELECT dst FROM g), nn AS (SELECT count(*) AS c FROM n), od AS (SELECT src, count(*) AS deg FROM g GROUP BY src)"


def _rank_ctes(graph: str, k: int) -> str:
    out = [graph, _NODES, "r0 AS (SELECT id, 1.0::DOUBLE / c AS rank FROM n, nn)"]
    for i in range(1, k + 1):
        out += [
            f"p{i} AS (SELECT n.id, coalesce(s.p, 0) AS p FROM n LEFT JOIN (SELECT g.dst, sum(r.rank / od.deg) AS p FROM g JOIN od ON od.src = g.src JOIN r{i - 1} r ON r.id = g.src GROUP BY g.dst) s ON s.dst = n.id)",
            f"m{i} AS (SELECT 1 - sum(p) AS m FROM p{i})",
            f"r{i} AS (SELECT id, {ALPHA} / c + (1 - {ALPHA}) * (m / c + p) AS rank FROM p{i}, m{i}, nn)",
        ]
    return "WITH " + ", ".join(out)


def _path_ctes(graph: str, rounds: int, weighted: bool = True) -> str:
    w = "g.w" if weighted else "1"
    out = [graph, f"s0 AS (SELECT CAST({SOURCE} AS BIGINT) AS id, CAST(0 AS BIGINT) AS dist, CAST(NULL AS BIGINT) AS prev WHERE EXISTS (SELECT 1 FROM g WHERE src = {SOURCE} OR dst = {SOURCE}))"]
    for i in range(1, rounds + 1):
        out += [
            f"o{i} AS MATERIALIZED (SELECT g.dst AS id, s.dist + {w} AS dist, g.src AS prev FROM s{i - 1} s JOIN g ON g.src = s.id)",
            f"b{i} AS (SELECT o.id, o.dist, min(o.prev) AS prev FROM o{i} o JOIN (SELECT id, min(dist) AS dist FROM o{i} GROUP BY id) m ON m.id = o.id AND m.dist = o.dist GROUP BY o.id, o.dist)",
            f"s{i} AS MATERIALIZED (SELECT coalesce(s.id, b.id) AS id, CASE WHEN s.id IS NULL OR b.dist < s.dist THEN b.dist ELSE s.dist END AS dist, CASE WHEN s.id IS NULL OR b.dist < s.dist THEN b.prev ELSE s.prev END AS prev FROM s{i - 1} s FULL JOIN b{i} b ON b.id = s.id)",
        ]
    return "WITH " + ", ".join(out)


_ROUNDS = 10
_COUNTS = " UNION ALL ".join(
    f"SELECT {i} AS round, (SELECT count(*) FROM s{i} a LEFT JOIN s{i - 1} b ON a.id = b.id WHERE b.id IS NULL OR a.dist < b.dist) AS improved, (SELECT count(*) FROM s{i} a LEFT JOIN s{i - 1} b ON a.id = b.id WHERE b.id IS NULL) AS reached"
    for i in range(1, _ROUNDS + 1)
)
# 257 * 257 = 1 (mod 512), so the powers of the base's inverse are 1 and 257 in turn.
_BYTES = f"""
f AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(range(n)) AS i, h FROM f),
v AS (SELECT doc_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS u FROM b),
t AS (SELECT doc_id, i, (CASE WHEN u > 127 THEN u - 256 ELSE u END) * (CASE WHEN i % 2 = 0 THEN 1 ELSE {BASE} END) AS x FROM v),
w AS (SELECT doc_id, i + 1 AS e, sum(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {LEAST - 1} PRECEDING AND CURRENT ROW) AS s FROM t),
a AS (SELECT doc_id, CAST(e AS BIGINT) AS e FROM w WHERE e >= {LEAST} AND s % {AVG} = 0)
"""
_CUTS = f"""WITH RECURSIVE {_BYTES},
l AS (SELECT f.doc_id, CAST(f.n AS BIGINT) AS n, coalesce((SELECT list(e ORDER BY e) FROM a WHERE a.doc_id = f.doc_id), CAST([] AS BIGINT[])) AS es FROM f),
c(doc_id, no, lo, hi) AS (
  SELECT doc_id, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM l
  UNION ALL
  SELECT c.doc_id, c.no + 1, c.hi, CASE WHEN l.n - c.hi < {LEAST} THEN l.n
    ELSE coalesce(list_min(list_filter(l.es, lambda e: e >= c.hi + {LEAST} AND e <= least(c.hi + {MOST}, l.n))), least(c.hi + {MOST}, l.n)) END
  FROM c JOIN l ON l.doc_id = c.doc_id WHERE c.hi < l.n),
k AS (SELECT c.doc_id, CAST(c.doc_id AS VARCHAR) AS path, CAST(no AS INTEGER) AS chunk_no, lo AS start_offset, hi - lo AS size, base64(unhex(sha256(unhex(substr(f.h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)))))) AS hash
  FROM c JOIN f ON f.doc_id = c.doc_id WHERE no > 0),
first AS (SELECT hash, path, chunk_no, size FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path, chunk_no) AS r FROM k) WHERE r = 1),
"""
_PLACED = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chunk_no) AS r FROM first),
q(path, r, seq, lo) AS (
  SELECT path, r, 0, CAST(0 AS BIGINT) FROM o WHERE r = 1
  UNION ALL
  SELECT o.path, o.r, CASE WHEN q.lo + p.size + o.size > {ds.CONTAINER_BYTES} THEN q.seq + 1 ELSE q.seq END, CASE WHEN q.lo + p.size + o.size > {ds.CONTAINER_BYTES} THEN 0 ELSE q.lo + p.size END
  FROM q JOIN o p ON p.path = q.path AND p.r = q.r JOIN o ON o.path = q.path AND o.r = q.r + 1),
z AS (SELECT path, sum(cnt) OVER (ORDER BY path) - cnt AS before FROM (SELECT path, max(seq) + 1 AS cnt FROM q GROUP BY path)),
i AS (SELECT o.hash, CAST(z.before + q.seq AS BIGINT) AS container_id, q.lo AS "offset", o.size FROM q JOIN o ON o.path = q.path AND o.r = q.r JOIN z ON z.path = q.path),
refs AS (SELECT hash, count(*) AS refs FROM k GROUP BY hash)
"""


def _report(where: str = "true", columns: str = "") -> str:
    return f"""{_CUTS} {_PLACED}
SELECT (SELECT count(DISTINCT path) FROM k WHERE {where}) AS files, CAST(coalesce(sum(refs), 0) AS BIGINT) AS logical_chunks, count(*) AS unique_chunks,
  CAST(coalesce(sum(refs * size), 0) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes{columns}
FROM i JOIN (SELECT hash, count(*) AS refs FROM k WHERE {where} GROUP BY hash) USING (hash)"""


def oracle_sql() -> dict[str, str]:
    ranks = lambda graph, k: f"{_rank_ctes(graph, k)} SELECT id, round(rank, 9) AS rank FROM r{k}"
    paths = lambda graph, k, weighted=True: f"{_path_ctes(graph, k, weighted)} SELECT id, dist, prev FROM s{k}"
    line = "id || ' ' || dist || ' ' || coalesce(CAST(prev AS VARCHAR), 'nil')"
    texts = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE coalesce(text, '') <> ''"
    hops = _path_ctes(_DENSE, _ROUNDS, False).removeprefix(f"WITH {_DENSE}, ")
    for name in ["s", "o", "b"]:
        for i in range(_ROUNDS, -1, -1):
            hops = hops.replace(f"{name}{i} ", f"h{name}{i} ")
    return {
        "edges_weighted": f"WITH {_DENSE} SELECT src, dst, w FROM g",
        "edges_unweighted": f"WITH {_DENSE} SELECT src, dst FROM g",
        "graph_nodes": f"WITH {_DENSE} SELECT src AS id FROM g UNION SELECT dst FROM g",
        "node_count": f"WITH {_DENSE} SELECT count(*) AS n FROM (SELECT src FROM g UNION SELECT dst FROM g)",
        "out_degree": f"WITH {_DENSE} SELECT src, count(*) AS outdeg FROM g GROUP BY src",
        "adjacency_list": f"WITH {_DENSE} SELECT src, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS adj FROM g GROUP BY src",
        "adjacency_map_min": f"WITH {_DENSE}, m AS (SELECT src, dst, min(w) AS w FROM g GROUP BY 1, 2) SELECT src, string_agg(dst || ':' || w, ' ' ORDER BY dst) AS adj FROM m GROUP BY src",
        "pr_contrib_sum": f"{_rank_ctes(_DENSE, 0)} SELECT g.dst AS id, round(sum(r.rank / od.deg), 9) AS p FROM g JOIN od ON od.src = g.src JOIN r0 r ON r.id = g.src GROUP BY g.dst",
        "pr_missing_mass": f"{_rank_ctes(_DENSE, 1)} SELECT round(m, 9) AS mass FROM m1",
        "pagerank_k0": ranks(_DENSE, 0),
        "pagerank_k1": ranks(_DENSE, 1),
        "pagerank_k3": ranks(_DENSE, 3),
        "pagerank_sparse_k3": ranks(_SPARSE, 3),
        "pagerank_text": f"{_rank_ctes(_SPARSE, 2)} SELECT id, id || ' ' || regexp_replace(printf('%.6f', round(rank, 6)), '\\.?0+$', '') AS value FROM r2",
        "sssp_w_k1": paths(_DENSE, 1),
        "sssp_w_k3": paths(_DENSE, 3),
        "sssp_w_conv": paths(_DENSE, _ROUNDS),
        "sssp_sparse": paths(_SPARSE, _ROUNDS),
        "bfs_k3": paths(_DENSE, 3, False),
        "bfs_conv": paths(_DENSE, _ROUNDS, False),
        "sssp_reach": f"""{_path_ctes(_DENSE, _ROUNDS)}, x AS ({_COUNTS}), d AS (SELECT id, min(r) AS r FROM ({" UNION ALL ".join(f"SELECT id, {i} AS r FROM s{i}" for i in range(_ROUNDS + 1))}) GROUP BY id),
            k AS (SELECT least(max(r) + 3, {_ROUNDS}) AS k FROM d WHERE id IN (SELECT src FROM g))
            SELECT id, dist, prev FROM ({" UNION ALL ".join(f"SELECT {i} AS i, id, dist, prev FROM s{i}" for i in range(_ROUNDS + 1))}), k WHERE i = k""",
        "sssp_round_counts": f"{_path_ctes(_DENSE, _ROUNDS)}, x AS ({_COUNTS}) SELECT CAST(round AS INTEGER) AS round, improved, reached FROM x WHERE round <= (SELECT min(round) FROM x WHERE improved = 0)",
        "sssp_text": f"{_path_ctes(_DENSE, _ROUNDS)} SELECT id, {line} AS value FROM s{_ROUNDS}",
        "cdc_anchors": f"WITH {_BYTES} SELECT doc_id, e AS end_offset FROM a",
        "cdc_boundaries": f"{_CUTS.rstrip().rstrip(',')} SELECT doc_id, chunk_no, start_offset, size FROM k",
        "cdc_trace": f"{_CUTS.rstrip().rstrip(',')} SELECT doc_id, start_offset + size AS end_offset FROM k",
        "fixed_chunks": "WITH f AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), c AS (SELECT *, unnest(range(0, n, 256)) AS lo FROM f) SELECT doc_id, CAST(lo // 256 + 1 AS INTEGER) AS chunk_no, lo AS start_offset, least(256, n - lo) AS size, base64(unhex(sha256(unhex(substr(h, 2 * lo + 1, 512))))) AS hash FROM c",
        "chunk_hashes": f"{_CUTS.rstrip().rstrip(',')} SELECT doc_id, chunk_no, hash FROM k",
        "fingerprint_index": f"{_CUTS.rstrip().rstrip(',')} SELECT hash, path, chunk_no, size FROM first",
        "refcounts": f"{_CUTS.rstrip().rstrip(',')} SELECT hash, count(*) AS refs FROM k GROUP BY hash",
        "file_recipe": f"{_CUTS.rstrip().rstrip(',')} SELECT path, chunk_no, hash FROM k",
        "chunk_count_per_file": f"{_CUTS.rstrip().rstrip(',')} SELECT path, count(*) AS chunks FROM k GROUP BY path",
        "container_layout": f"{_CUTS} {_PLACED} SELECT hash, container_id, \"offset\", size FROM i",
        "container_liveness": f"{_CUTS} {_PLACED} SELECT container_id, CAST(sum(refs) AS BIGINT) AS refs, count(*) AS chunks FROM i JOIN refs USING (hash) GROUP BY container_id",
        "store_report": _report(columns=", count(DISTINCT container_id) AS containers, CAST(sum(refs * size) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS ratio"),
        "legacy_index": f"{_CUTS} {_PLACED} SELECT hash, container_id, \"offset\", size FROM i",
        "legacy_recipe": f"{_CUTS.rstrip().rstrip(',')} SELECT path, chunk_no, hash FROM k",
        "download_roundtrip": texts,
        "download_ranged": texts,
        "delete_gc": _report(f"path <> '{DELETED}'"),
        "vacuum": f"{texts} AND doc_id % 2 = 0",
        "upload_guard": "SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') <> '' AS refused FROM documents UNION ALL SELECT 'copy-' || doc_id, false FROM documents",
        "golden_diff": f"{_path_ctes(_DENSE, _ROUNDS)}, {hops}, x AS (SELECT {line} AS value FROM s{_ROUNDS}), y AS (SELECT {line} AS value FROM hs{_ROUNDS}) SELECT value, 'left' AS side FROM (SELECT value FROM x EXCEPT ALL SELECT value FROM y) UNION ALL SELECT value, 'right' FROM (SELECT value FROM y EXCEPT ALL SELECT value FROM x)",
    }
