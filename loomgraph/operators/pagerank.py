"""PageRank with a random jump and redistribution of the mass lost at dangling nodes.

``p'(v)`` is the sum of ``p(u) / outdegree(u)`` over edges ``u -> v`` (parallel edges count each),
``m = 1 - sum p'`` the missing mass, and ``p(v) = alpha / N + (1 - alpha) * (m / N + p'(v))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed
from .links import Links, by_source


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ids of both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("outdeg"))


def adjacency_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("adj"))


def adjacency_maps(edges: DataFrame) -> DataFrame:
    """For each source a map from target to its least weight."""
    least = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    return least.groupBy("src").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dst", "w")))).alias("adj"))


def link_counts(edges: DataFrame) -> DataFrame:
    """Parallel edges folded to ``src, dst, share`` with share = multiplicity / outdegree."""
    multi = edges.groupBy("src", "dst").agg(F.count("*").alias("links"))
    return multi.join(out_degree(edges), "src").select("src", "dst", (F.col("links") / F.col("outdeg")).alias("share"))


def push(ranks: DataFrame, shares: Links) -> DataFrame:
    """``dst, p``: what the targets receive."""
    sent = shares.meet(ranks, [F.col("dst"), (F.col("rank") * F.col("share")).alias("p")])
    return sent.groupBy("dst").agg(F.sum("p").alias("p"))


def received(all_nodes: DataFrame, pushed: DataFrame) -> DataFrame:
    """``id, p`` for every node, 0 for those that receive nothing."""
    return all_nodes.join(pushed.withColumnRenamed("dst", "id"), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))


def missing_mass(got: DataFrame) -> float:
    return got.agg((1 - F.sum("p")).alias("m")).first()["m"]


def adjust(got: DataFrame, alpha: float, n: int, mass: float) -> DataFrame:
    return got.select("id", (F.lit(alpha / n) + F.lit(1 - alpha) * (F.lit(mass / n) + F.col("p"))).alias("rank"))


def pagerank(edges: DataFrame, alpha: float, iterations: int) -> DataFrame:
    """``id, rank`` after ``iterations`` rounds; none gives 1 / N.

    Links lie in buckets of their source, nodes and what they received in buckets of their id. A
    round joins them where they lie and shuffles nothing but the contributions, summed on the
    sender's side first; its result is written once, and the driver gets one number. Links of hubs
    lie apart and get the hubs' ranks by broadcast."""
    if not 0 <= alpha <= 1 or iterations < 0:
        raise ValueError("alpha must be in [0, 1] and iterations not negative")
    edges = edges.select("src", "dst").filter("src is not null and dst is not null")
    every = bucketed(nodes(edges), "nodes", "id")
    n = every.count()
    ranks = every.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    if not n or not iterations:
        return ranks
    shares = by_source(edges, link_counts, "shares")
    for _ in range(iterations):
        got = bucketed(received(every, push(ranks, shares)), "received", "id")
        ranks = adjust(got, alpha, n, missing_mass(got))
    return ranks
