"""The driver's tables as inputs of the memory operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: purchases end an episode, sign-ups start one."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "ts", "event_type", "value", "props",
        F.concat_ws(" ", "event_type", F.round("value", 0).cast("long").cast("string")).alias("content"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("attention"),
        (F.col("event_type") == "purchase").alias("terminal"), (F.col("event_type") == "signup").alias("boundary"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order priority over time; each order's value holds until the next order."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("subject"), "o_orderkey", F.col("o_orderpriority").alias("object_value"),
        F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"), F.row_number().over(w).alias("revision_number"), "o_totalprice",
    )


def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", tokens(F.col("text")).alias("tokens"))


def text_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cue_id"), tokens(F.col("text")).alias("tokens"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bipartite graph of orders and what they hold."""
    li = table(spark, sf_dir, "lineitem")
    part = li.select(F.col("l_orderkey").alias("memory"), F.concat(F.lit("P:"), F.col("l_partkey").cast("string")).alias("entity"))
    supplier = li.select(F.col("l_orderkey").alias("memory"), F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("entity"))
    return part.unionByName(supplier).distinct()


def numbered_order_edges(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Like :func:`order_edges`; parts are even and suppliers odd numbers, which are shorter than text. Rows are moved before they are two edges each."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory"), "l_partkey", "l_suppkey").repartition(parts, "memory")
    return lines.select("memory", F.explode(F.array(F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1)).alias("entity")).distinct()


def pieces(spark: SparkSession, sf_dir: str, name: str, rows: int) -> int:
    """Partitions for a table of this many rows each, so that a task's work doesn't grow with the table."""
    return max(1, -(-table(spark, sf_dir, name).count() // rows))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    return x.select("doc_id", F.when(F.col("toxic") == 1, "incorrect").when(F.col("quality") == 1, "helpful").otherwise("unhelpful").alias("outcome"))
