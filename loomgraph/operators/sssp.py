"""Single-source shortest paths by rounds of relaxation, weighted or by hops.

Only nodes that improved in the last round send; a strict improvement can't come from another, so
distances and predecessors are those of full rounds. On equal distances within a round the smaller
predecessor wins; an old one stays unless the distance falls.

Links lie in buckets of their source and the state in buckets of its node, so a round joins them
where they lie and shuffles the offers alone; it writes the reached nodes once. Links of hubs lie
apart and get the hubs' state by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed
from .links import Links, by_source

STATE = "id long, dist long, prev long, round int"


def relax(frontier: DataFrame, links: Links) -> DataFrame:
    """``id, best (dist, prev)`` offered by the frontier."""
    offer = F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"))
    return links.meet(frontier, [F.col("dst"), offer.alias("offer")]).groupBy(F.col("dst").alias("id")).agg(F.min("offer").alias("best"))


def search(edges: DataFrame, source: int, iterations: int = 0, weighted: bool = True, until: str = "distance") -> tuple[DataFrame, list[dict]]:
    """The state ``id, dist, prev, round`` (the round of the last improvement) and each round's
    counts: improved and newly reached nodes."""
    if iterations < 0 or until not in ("distance", "reach"):
        raise ValueError("iterations must not be negative; until is 'distance' or 'reach'")
    spark = edges.sparkSession
    w = F.col("w") if weighted else F.lit(1).cast("long")
    # Of parallel edges the least weight decides.
    links = by_source(edges.filter("src is not null and dst is not null"), lambda e: e.groupBy("src", "dst").agg(F.min(w).alias("w")), "links")
    if weighted and not all(x.filter("w < 0").isEmpty() for x in links.parts()):
        raise ValueError("weights must not be negative")
    senders = reduce(DataFrame.unionByName, [x.select(F.col("src").alias("id"), F.lit(True).alias("sends")).distinct() for x in links.parts()])
    there = not all(x.filter((F.col("src") == source) | (F.col("dst") == source)).isEmpty() for x in links.parts())
    state = spark.createDataFrame([(source, 0, None, 0)] if there else [], STATE)
    counts, last_new, k = [], 0, 0
    while there and (not iterations or k < iterations):
        k += 1
        best = relax(state.filter(F.col("round") == k - 1), links)
        old = state.select("id", F.col("dist").alias("old"), F.col("prev").alias("old_prev"), "round")
        better = F.col("best").isNotNull() & (F.col("old").isNull() | (F.col("best.dist") < F.col("old")))
        both = old.join(best, "id", "full").select("id", F.when(better, F.col("best.dist")).otherwise(F.col("old")).alias("dist"), F.when(better, F.col("best.prev")).otherwise(F.col("old_prev")).alias("prev"), F.when(better, F.lit(k)).otherwise(F.col("round")).alias("round"), (better & F.col("old").isNull()).alias("new"))
        step = bucketed(both, "state", "id")
        seen = step.filter(F.col("round") == k).join(senders, "id", "left").agg(F.count("*").alias("improved"), F.count_if("new").alias("reached"), F.count_if(F.col("new") & F.coalesce("sends", F.lit(False))).alias("senders")).first()
        counts.append({"round": k, "improved": seen["improved"], "reached": seen["reached"]})
        state = step.select("id", "dist", "prev", "round")
        if seen["senders"]:
            last_new = k
        # Further rounds change nothing.
        if not seen["improved"] or (until == "reach" and not iterations and k >= last_new + 3):
            break
    return state, counts


def sssp(edges: DataFrame, source: int, iterations: int = 0, weighted: bool = True, until: str = "distance") -> DataFrame:
    """``id, dist, prev`` of all reached nodes; the source has no predecessor. ``iterations`` 0
    runs until no distance improves, or (``until="reach"``) until two rounds after the last one
    that newly reached a node with edges. A source outside the graph reaches nothing."""
    return search(edges, source, iterations, weighted, until)[0].select("id", "dist", "prev")
