"""Links kept by their source, those of hubs apart.

Links of one source lie in one bucket and meet its state in one task. A source with a large share
of all links would make that task as long as its share, so such hubs' links are written as they
come, in tasks of even size, and the few rows of the hubs' own state are broadcast to them. A hub
has more than 1 / HUBS of an average bucket's links, so there are at most HUBS hubs for a bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bucket_count, bucketed, saved

HUBS = 4


@dataclass(frozen=True)
class Links:
    usual: DataFrame
    heavy: DataFrame | None = None
    hubs: DataFrame | None = None

    def parts(self) -> list[DataFrame]:
        return [self.usual] if self.heavy is None else [self.usual, self.heavy]

    def meet(self, state: DataFrame, columns: list[Column]) -> DataFrame:
        """``columns`` of ``state`` (by ``id``) joined with the links of its nodes."""
        met = state.join(self.usual, state["id"] == self.usual["src"]).select(*columns)
        if self.heavy is None:
            return met
        few = F.broadcast(state.join(F.broadcast(self.hubs), "id", "left_semi"))
        return met.unionByName(self.heavy.join(few, few["id"] == self.heavy["src"]).select(*columns))


def by_source(edges: DataFrame, fold: Callable[[DataFrame], DataFrame], tag: str) -> Links:
    """``fold(edges)``, links with ``src``, for repeated use. ``fold`` must treat sources apart."""
    spark = edges.sparkSession
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    sizes = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    least = (sizes["all"] or 0) / (HUBS * bucket_count(spark))
    if (sizes["most"] or 0) <= least:
        return Links(bucketed(fold(edges), tag, "src", deal=True))
    found = [(r["src"],) for r in counts.filter(F.col("n") > least).select("src").collect()]
    hubs = spark.createDataFrame(found, "id long")
    of_hubs = F.col("src") == hubs["id"]
    usual = bucketed(fold(edges.join(F.broadcast(hubs), of_hubs, "left_anti")), tag, "src", deal=True)
    return Links(usual, saved(fold(edges.join(F.broadcast(hubs), of_hubs, "left_semi")), f"{tag}-hubs"), hubs)
