"""Exact top-k by integer inner product, with a KD-tree for each shard.

Vectors are dealt to shards by the cells of a KD-tree over a bounded sample (median splits, too),
so that a shard's vectors lie together; a cell with more than ``shard_rows`` of them is dealt over
several shards by a hash. A shard's own tree splits at the median of its widest component down to
leaves, and each node has the tight bounding box of its vectors. A query keeps a queue of nodes and
always opens the one whose box allows the largest inner product, an inner node into its two halves,
a leaf into its vectors; it stops when that bound is below its k-th score.

A query first searches the shard whose root box allows most. The k-th score found there goes with
it to those other shards whose root boxes reach it. Each shard's queries are read as a stream by a
task that holds the shard's tree; a shard with many queries is read by several such tasks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS, LEAF = 1 << 16, 256
#: Queries that travel as one row, that are searched at once, and that one task takes for a shard.
TOGETHER, AT_ONCE, QUERIES = 16, 2048, 1 << 15
#: Rows of the sample that lays out the cells, and bytes of root boxes that the driver may hold.
SAMPLE, BOX_BYTES = 1 << 14, 1 << 25
NONE = np.iinfo(np.int64).min + 1


class Tree:
    """Median splits in breadth-first order. ``kids`` has two nodes, or none for a leaf; ``range``
    is a node's part of ``ids`` and ``rows``, which ascend by id within a leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.lo, self.hi, self.kids, self.range = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            nxt = []
            for a, b, parent in todo:
                part = rows[order[a:b]]
                node = len(self.lo)
                self.lo.append(part.min(axis=0))
                self.hi.append(part.max(axis=0))
                self.kids.append(())
                self.range.append((a, b))
                if parent >= 0:
                    self.kids[parent] += (node,)
                spread = self.hi[-1].astype(np.float64) - self.lo[-1]
                if b - a > leaf and spread.max() > 0:
                    mid = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(part[:, int(np.argmax(spread))], mid)]
                    nxt += [(a, a + mid, node), (a + mid, b, node)]
                else:
                    order[a:b] = order[a:b][np.argsort(ids[order[a:b]])]
            todo = nxt
        self.ids, self.rows = ids[order], rows[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)


def _kind(dim: int, *parts: np.ndarray):
    """The cheapest type in which all inner products are exact; 64-bit integers always hold them,
    see :func:`vectors`."""
    size = dim
    for p in parts:
        size *= max(1, -int(p.min(initial=0)), int(p.max(initial=0)))
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64


def bound(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Queries by boxes: no vector of a box has a larger inner product with the query. What
    rounding could take off is added."""
    q, lo, hi = (x.astype(np.float64) for x in (queries, lo, hi))
    most = np.maximum(q, 0).dot(hi.T) + np.minimum(q, 0).dot(lo.T)
    return most + 1e-12 * np.abs(q).dot(np.maximum(np.abs(lo), np.abs(hi)).T)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores (falling, ties to the smaller id) and ids of each query's ``k`` best rows of the
    tree but its own, as far as they reach ``floor``; unused places have score NONE. The third
    result is the number of visits to leaves."""
    kind = _kind(queries.shape[1], queries, tree.rows)
    q, rows = queries.astype(kind), tree.rows.astype(kind)
    n, visits = len(q), 0
    scores, ids = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
    kth = floor.copy()
    # The queue of each query: bounds of its open nodes, minus infinity elsewhere.
    queue = np.full((n, len(tree.kids)), -np.inf)
    queue[:, :1] = bound(q, tree.lo[:1], tree.hi[:1])
    active = np.arange(n)
    while active.size:
        node = queue[active].argmax(axis=1)
        go = queue[active, node] >= kth[active]
        active, node = active[go], node[go]
        queue[active, node] = -np.inf
        by = np.argsort(node, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if by.size else ():
            who, at = active[group], int(node[group[0]])
            if tree.kids[at]:
                kids = list(tree.kids[at])
                queue[who[:, None], kids] = bound(q[who], tree.lo[kids], tree.hi[kids])
                continue
            visits += len(who)
            a, b = tree.range[at]
            found = q[who].dot(rows[a:b].T)
            row, col = np.nonzero((found >= kth[who][:, None]) & (tree.ids[None, a:b] != query_ids[who][:, None]))
            if not row.size:
                continue
            # What reaches the k-th score is set beside the old best, as wide as the longest row.
            count = np.bincount(row, minlength=len(who))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            s, i = np.full((len(who), k + int(count.max())), NONE), np.full((len(who), k + int(count.max())), np.iinfo(np.int64).max)
            s[:, :k], i[:, :k] = scores[who], ids[who]
            s[row, k + place], i[row, k + place] = found[row, col].astype(np.int64), tree.ids[a:b][col]
            best = np.lexsort((i, -s), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[who] = np.maximum(kth[who], scores[who, -1])
    return scores, ids, visits


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, dim, v``: each component x as floor(scale * x). Rows whose id or vector is null, or
    with a null or non-finite component, or without components, are left out, and so are vectors
    whose scaled squared length reaches 2**61 (the others' inner products fit 64 bits). Rows that repeat
    an id are one, the smallest vector."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(usable)
    scaled = F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    short = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x) < float(1 << 61)
    v = F.transform(scaled, lambda x: F.floor(x).cast("long"))
    one = ok.filter(short).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    return one.withColumn("dim", F.size("v"))


def cell_splits(sample: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """(component, median) of each inner node of a complete binary tree of about ``cells`` leaves,
    in breadth-first order."""
    out, todo = [], [sample]
    while len(todo) < cells:
        nxt = []
        for part in todo:
            spread = np.ptp(part.astype(np.float64), axis=0) if len(part) else np.zeros(sample.shape[1])
            c = int(np.argmax(spread))
            m = int(np.sort(part[:, c])[len(part) // 2]) if len(part) else 0
            out.append((c, m))
            nxt += [part[part[:, c] < m], part[part[:, c] >= m]]
        todo = nxt
    return out


def cells_of(rows: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    at = np.zeros(len(rows), np.int64)
    inner = np.array(splits, np.int64).reshape(-1, 2)
    while len(inner) and at[0] < len(inner):
        c, m = inner[at].T
        at = 2 * at + 1 + (rows[np.arange(len(rows)), c] >= m)
    return at - len(inner)


def _packed(rows: np.ndarray) -> bytes:
    """The smallest integer type that holds ``rows`` (its code is the first byte), then the values."""
    lo, hi = int(rows.min(initial=0)), int(rows.max(initial=0))
    code = next(c for c in "bhiq" if np.iinfo(c).min <= lo and hi <= np.iinfo(c).max)
    return code.encode() + rows.astype(f"<{code}").tobytes()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"<{raw[:1].decode()}", offset=1).reshape(-1, dim)


def _searched(pairs: DataFrame, trees: DataFrame, k: int, queries: int) -> DataFrame:
    """``dim, shard, n, ids, q, floor, scores, found`` for rows ``dim, shard, n, ids, q, floor`` of
    up to TOGETHER queries each. A shard's tree goes to one task for each ``queries`` of them, and
    stands there before the queries."""
    # Decided by the shard: a row for each shard, so these joins are small.
    load = saved(pairs.groupBy("dim", "shard").agg(F.ceil(F.sum("n") / queries).cast("int").alias("parts")), "load")
    heads = trees.join(load, ["dim", "shard"]).select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast("binary").alias("floor"), "tree")
    asked = pairs.join(load, ["dim", "shard"]).select("dim", "shard", F.pmod(F.xxhash64("ids"), "parts").cast("int").alias("part"), "n", "ids", "q", "floor", F.lit(None).cast("binary").alias("tree"))

    def run(frames):
        tree = None
        for pdf in frames:
            first = np.flatnonzero(pdf["tree"].notna().to_numpy())
            for a, b in zip([0, *first], [*first, len(pdf)], strict=True):
                if a < len(pdf) and pdf["tree"].iat[a] is not None:
                    tree = pickle.loads(pdf["tree"].iat[a])
                    a += 1
                # Rows go together, up to AT_ONCE queries.
                upto = pdf["n"].to_numpy()[a:b].cumsum() // AT_ONCE
                for part in np.split(np.arange(a, b), np.flatnonzero(np.diff(upto)) + 1) if b > a else ():
                    rows = pdf.iloc[part]
                    dim, n = int(rows["dim"].iat[0]), rows["n"].to_numpy()
                    ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
                    q = np.concatenate([_unpacked(x, dim).astype(np.int64) for x in rows["q"]])
                    floor = np.frombuffer(b"".join(rows["floor"]), np.int64)
                    scores, found, _ = search(tree, ids, q, k, floor)
                    cut = np.cumsum(n)[:-1]
                    each = lambda x, cut=cut: [y.tobytes() for y in np.split(x, cut)]
                    yield pd.DataFrame({"dim": rows["dim"], "shard": rows["shard"], "n": n, "ids": rows["ids"], "q": rows["q"], "floor": each(np.maximum(floor, scores[:, -1])), "scores": each(scores), "found": each(found)})

    both = heads.unionByName(asked).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("tree").isNull())
    return both.mapInPandas(run, "dim int, shard long, n int, ids binary, q binary, floor binary, scores binary, found binary")


def top_k(
    df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64,
    shard_rows: int = SHARD_ROWS, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (a condition on the
    column ``id``) admits, the ``k`` rows with the largest inner product, ties to the smaller id.

    A vector is compared with those of its own length only. Rows that can't take part are named
    at :func:`vectors`. With fewer than ``k`` other rows all are returned; an empty table or one
    without queries gives an empty result. Other columns are ignored. The sample of SAMPLE rows
    for each length lays out the shards and has no part in the results.
    """
    spark = df.sparkSession
    rows = saved(vectors(df, id_col, vector_col, scale), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    # No more rows in a shard than shard_rows, and work for all cores on small tables.
    cores = spark.sparkContext.defaultParallelism
    splits: dict[int, list[tuple[int, int]]] = {}
    for dim, n in sizes.items():
        want = max(-(-n // shard_rows), min(cores, -(-n // (16 * LEAF))))
        cells = min(want, SAMPLE // 16)
        near = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(n)) < 2 * SAMPLE)).select("v").limit(SAMPLE) if cells > 1 else None
        splits[dim] = cell_splits(np.array([r["v"] for r in near.collect()], np.int64).reshape(-1, dim), cells) if near is not None else []

    def place(frames):
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                mat = np.stack(part["v"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"id": part["id"], "dim": dim, "cell": cells_of(mat, splits[int(dim)]), "q": [_packed(x) for x in mat]})

    placed = saved(rows.mapInPandas(place, "id long, dim int, cell long, q binary"), "placed")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    # At most SAMPLE / 16 cells for each length.
    number = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), "parts")
    dealt = placed.join(F.broadcast(parts), ["dim", "cell"]).select("id", "dim", number.alias("shard"), "q")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iat[0])
        mat = np.concatenate([_unpacked(x, dim) for x in pdf["q"]])
        tree = Tree(pdf["id"].to_numpy(np.int64), mat)
        return pd.DataFrame({"dim": [dim], "shard": [int(pdf["shard"].iat[0])], "lo": [tree.lo[0].astype(np.int64).tobytes()], "hi": [tree.hi[0].astype(np.int64).tobytes()], "tree": [pickle.dumps(tree, 5)]})

    trees = saved(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, lo binary, hi binary, tree binary"), "trees")
    # Root boxes, if they are few MB: without them a query's home is a shard by turns and it visits all.
    shards = trees.groupBy("dim").agg(F.sort_array(F.collect_list("shard")).alias("shards")).collect()
    every = {r["dim"]: np.array(r["shards"], np.int64) for r in shards}
    roots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if sum(16 * dim * len(x) for dim, x in every.items()) <= BOX_BYTES:
        for dim in every:
            at = {r["shard"]: r for r in trees.filter(F.col("dim") == dim).select("shard", "lo", "hi").collect()}
            roots[dim] = tuple(np.array([np.frombuffer(at[s][side], np.int64) for s in every[dim].tolist()]) for side in ("lo", "hi"))

    def grouped(dim: int, shard: np.ndarray, ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> pd.DataFrame:
        """Rows of up to TOGETHER queries that go to one shard."""
        order = np.argsort(shard, kind="stable")
        head = np.flatnonzero(np.diff(shard[order])) + 1
        out = [x[lo : lo + TOGETHER] for x in np.split(order, head) if len(x) for lo in range(0, len(x), TOGETHER)]
        return pd.DataFrame({"dim": dim, "shard": [shard[x[0]] for x in out], "n": [len(x) for x in out], "ids": [ids[x].tobytes() for x in out], "q": [_packed(q[x]) for x in out], "floor": [floor[x].tobytes() for x in out]})

    def home(frames):
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                ids, q = part["id"].to_numpy(np.int64), np.concatenate([_unpacked(x, int(dim)).astype(np.int64) for x in part["q"]])
                best = bound(q, *roots[int(dim)]).argmax(axis=1) if int(dim) in roots else ids % len(every[int(dim)])
                yield grouped(int(dim), every[int(dim)][best], ids, q, np.full(len(ids), NONE))

    def others(frames):
        for pdf in frames:
            for (dim, shard), part in pdf.groupby(["dim", "shard"]):
                dim, ids = int(dim), np.frombuffer(b"".join(part["ids"]), np.int64)
                q = np.concatenate([_unpacked(x, dim).astype(np.int64) for x in part["q"]])
                floor = np.frombuffer(b"".join(part["floor"]), np.int64)
                # In parts, so that queries by shards stay a few MB.
                for lo in range(0, len(ids), AT_ONCE):
                    at = slice(lo, lo + AT_ONCE)
                    open_ = bound(q[at], *roots[dim]) >= floor[at][:, None] if dim in roots else np.ones((len(ids[at]), len(every[dim])), bool)
                    open_ &= every[dim][None, :] != shard
                    who, to = np.nonzero(open_)
                    yield grouped(dim, every[dim][to], ids[at][who], q[at][who], floor[at][who])

    ddl = "dim int, shard long, n int, ids binary, q binary, floor binary"
    asked = saved(placed.filter(is_query).select("id", "dim", "q").mapInPandas(home, ddl), "asked")
    first = saved(_searched(asked, trees, k, queries), "home")
    more = _searched(saved(first.select("dim", "shard", "ids", "q", "floor").mapInPandas(others, ddl), "pairs"), trees, k, queries)

    def unpack(frames):
        for pdf in frames:
            ids, s, f = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("ids", "scores", "found"))
            ok = s != NONE
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[ok], "vec_id": f[ok], "score": s[ok]})

    found = first.select("ids", "scores", "found").unionByName(more.select("ids", "scores", "found")).mapInPandas(unpack, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
