"""Edge lists from text, adapters from star-schema tables, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_edges(lines: DataFrame, weighted: bool = True, col: str = "value") -> DataFrame:
    """``src, dst[, w]`` from lines of numbers parted by white space. Blank lines are skipped,
    further columns ignored; a missing or malformed number raises."""
    words = F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")
    number = lambda i: F.element_at(words, i + 1).cast("bigint")
    kept = lines.filter(F.trim(F.regexp_replace(col, r"\s+", " ")) != "")
    return kept.select(number(0).alias("src"), number(1).alias("dst"), *([number(2).alias("w")] if weighted else []))


def read_edges(spark: SparkSession, path: str, weighted: bool = True) -> DataFrame:
    return parse_edges(spark.read.text(path), weighted)


def dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers, one edge per line item; key spaces overlap, so there are cycles."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("w")).filter("src <> dst")


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers, one edge per pair with its least quantity; most targets dangle."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity").filter("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.min("l_quantity").cast("bigint").alias("w"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def rank_text(rank: Column) -> Column:
    """At most six decimals, rounded half up, without trailing zeros."""
    return F.call_function("format_number", F.round(rank, 6), F.lit("#.######"))


def rank_lines(ranks: DataFrame, decimals: int | None = 6) -> DataFrame:
    shown = rank_text(F.col("rank")) if decimals == 6 else (F.col("rank") if decimals is None else F.round("rank", decimals)).cast("string")
    return ranks.select("id", F.concat_ws(" ", F.col("id").cast("string"), shown).alias("value"))


def path_lines(paths: DataFrame) -> DataFrame:
    return paths.select("id", F.concat_ws(" ", F.col("id").cast("string"), F.col("dist").cast("string"), F.coalesce(F.col("prev").cast("string"), F.lit("nil"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text ascending by id, over as many files as there are partitions."""
    lines.orderBy("id").select("value").write.mode("overwrite").text(path)
