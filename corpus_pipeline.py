"""A corpus from raw documents to packed sequences: language ID, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, neardup, secrets
from loomgraph.llm.common import bound_batches, fresh, saved
from loomgraph.llm.queries import packed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null and empty ones too) go; a missing lang is filled in, as
    ``und`` if no document has a label to learn from. Each row is judged by itself, so null ids and
    repeated rows stay as they are. All columns are kept, whatever their names; an empty table
    gives an empty result."""
    bound_batches(spark)
    model = langid.train(docs)
    if not model.languages:
        # Every text is und then: what has a letter stays. \p{L} is what str.isalpha means.
        return docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.coalesce("lang", F.lit(langid.UND))).select(*docs.columns)
    label, score = (fresh(docs.columns, n) for n in ("label", "score"))
    out = langid.identify(docs, model, keep=tuple(docs.columns), spans=False, names=(label, score, "spans")).filter(F.col(label) != langid.UND)
    return out.withColumn("lang", F.coalesce("lang", label)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id; null ids
    come last, and of rows that repeat an id any one stays. Rows are known by a number of their
    own, so repeated rows and null ids are documents like others. Null and empty texts are in no
    group: they stay. All columns are kept; an empty table gives an empty result."""
    bound_batches(spark)
    row = fresh(docs.columns, "row")
    # Written first: a number that is made anew could differ.
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = saved(neardup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id"), "groups")
    # Components of one row need no choice; the others' rows are few numbers each.
    grouped = found.join(found.filter(F.col(row) != F.col("component_id")).select("component_id").distinct(), "component_id", "left_semi")
    best = grouped.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("best"))
    gone = saved(grouped.select(row).join(best.select(F.col(f"best.{row}").alias(row)), row, "left_anti"), "gone")
    # A few MB of numbers at most are broadcast; more are joined by a shuffle.
    few = gone.count() <= neardup.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark, and n_chars follows; no row goes. Null texts stay
    null with null n_chars, empty ones empty; each row is read by itself, so null ids and repeated
    rows stay as they are. All columns are kept; an empty table gives an empty result."""
    bound_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token runs of all documents in sequences of 4096. A null or empty text is an end mark alone;
    null ids and repeated rows are packed like others; further columns are ignored; an empty table
    gives an empty result."""
    bound_batches(spark)
    return packed(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]
#: Tokenizers and the language model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
