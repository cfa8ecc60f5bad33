"""Token counts through a digest cache.

A text's content digest and the tokenizer's version digest (of its file's bytes) are the key of a
stored count. Only distinct digests without a stored count are encoded, and their counts are
appended to the cache, a Parquet table with a folder for each tokenizer, which later runs share.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir
from .tokens import text_groups

SCHEMA = "digest binary, n_tokens long, tokenizer string"
_loaded: dict[str, object] = {}


def version(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(tokenizer_path: str):
    """``texts -> counts`` without special tokens, truncation or padding."""
    if tokenizer_path not in _loaded:
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            _loaded[tokenizer_path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path)
            t.no_truncation()
            t.no_padding()
            _loaded[tokenizer_path] = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[tokenizer_path]


def content_digest(text: Column) -> Column:
    """The 256-bit digest of a normalised text. Null is the empty text; nothing else is changed,
    as any other change could change the count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _stored(spark, cache_path: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer: its folder of the cache alone is read."""
    try:
        cache = spark.read.schema(SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], SCHEMA)
    return cache.filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty. Equal texts share one stored count. Null ids and rows that repeat
    are kept as they are; an empty table gives an empty result; other columns are ignored. The
    cache is updated when this is called. By default it lies in the shared folder.
    """
    spark = df.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/loomgraph/token_cache"
    tokenizer = version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("digest"))
    with_text = df.select(content_digest(text).alias("digest"), text.alias("text"))
    stored = _stored(spark, cache_path, tokenizer)

    def encode(batches):
        count = counter(tokenizer_path)
        for batch in batches:
            counts = [n for group in text_groups(batch.column(1).to_pylist()) for n in count(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    # Copies meet before the shuffle; each distinct text is moved and encoded once.
    misses = with_text.dropDuplicates(["digest"]).join(stored.select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(encode, "digest binary, n_tokens long")
    fresh.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    # Written first: then a join under a hot digest is dealt anew, which sums in its stage prevent.
    # A run that was started twice may have stored a digest twice.
    counts = saved(_stored(spark, cache_path, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = keyed.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
