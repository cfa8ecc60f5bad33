"""Each row together with its successor in the order of an id, over any number of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


BUCKET_BYTES = 1 << 26


def with_next(df: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """``id, text, bucket, own``: rows dealt to ``bucket`` by ranges of (id, hash of the text), so
    that an id with many rows is dealt over several; ``partitions`` of them, or one for each
    BUCKET_BYTES of text if that is more. Each bucket also gets the first row of the next bucket
    that has any (the last one: of the first), as ``own`` false, so that within a bucket, in the
    order (own first, id, hash, text), every own row is followed by its successor. (Rows that
    equal that first row may come with it; they follow it and have no part.) Null ids come before
    all others. Rows move once; the driver gets bounds and first keys, two numbers for a bucket.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    share = F.xxhash64("text")
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(1, partitions, -(-size // BUCKET_BYTES))
    cuts = [i / partitions for i in range(1, partitions)]
    found = base.agg(F.percentile_approx(low, cuts, 10_000).alias("q")).first()["q"] if cuts else None
    # Bounds are pairs: where several fall on one id, they part its rows evenly by hash.
    ids, times = np.unique(np.array(found or [], np.int64), return_counts=True)
    bounds = [(i, -(1 << 63) + (k * (1 << 64)) // n) for i, n in zip(ids.tolist(), times.tolist(), strict=True) for k in range(n)]
    bound_id = np.array([i for i, _ in bounds], np.int64)
    bound_hash = np.array([h for _, h in bounds], np.int64)

    def bucket_of(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        lo, out = np.searchsorted(bound_id, key), np.searchsorted(bound_id, key, side="right")
        for at in np.unique(lo[out > lo]).tolist():
            mine = np.flatnonzero((lo == at) & (out > lo))
            part = bound_hash[at : int(out[mine[0]])]
            out[mine] = at + np.searchsorted(part, h[mine], side="right")
        return out

    @F.pandas_udf(T.LongType())
    def bucket(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(key.to_numpy(), h.to_numpy()))

    keyed = base.select(low.alias("key"), share.alias("h"))
    firsts = keyed.select(bucket("key", "h").alias("bucket"), "key", "h").groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], "id long, text string, bucket long, own boolean, key long")
    # The bucket before each first row.
    prior = {(r["first"]["key"], r["first"]["h"]): firsts[k - 1]["bucket"] for k, r in enumerate(firsts)}
    first_ids = np.unique(np.array([k for k, _ in prior], np.int64))

    @F.pandas_udf("array<struct<bucket:long,own:boolean>>")
    def places(key: pd.Series, h: pd.Series) -> pd.Series:
        k, x = key.to_numpy(), h.to_numpy()
        own = bucket_of(k, x)
        maybe = first_ids[np.minimum(np.searchsorted(first_ids, k), len(first_ids) - 1)] == k
        also: list[int | None] = [None] * len(k)
        done = set()
        for i in np.flatnonzero(maybe).tolist():
            # Of equal rows one from each batch is enough.
            at = (int(k[i]), int(x[i]))
            if at in prior and at not in done:
                also[i] = prior[at]
                done.add(at)
        return pd.Series([[{"bucket": int(b), "own": True}] + ([] if p is None else [{"bucket": int(p), "own": False}]) for b, p in zip(own, also, strict=True)])

    spread = base.withColumn("key", low).withColumn("h", share).withColumn("p", F.explode(places("key", "h")))
    # By number, not by hash: no partition gets several buckets.
    dealt = spread.select("id", "text", "p.bucket", "p.own", "key", "h").repartitionById(partitions, F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", F.desc("own"), "key", "h", "text")
