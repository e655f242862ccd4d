"""Transcripts with exons: representatives, order, intersections."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import overlap_counts, overlap_join


def representative(df: DataFrame, keys: list[str]) -> DataFrame:
    """One transcript for each of ``keys``: the longest span, then the smallest name."""
    w = Window.partitionBy(*keys).orderBy((F.col("tx_end") - F.col("tx_start")).desc(), "name")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_order(df: DataFrame) -> DataFrame:
    """By chrom, start, end, and strand last."""
    return df.orderBy("chrom", "tx_start", "tx_end", "strand")


def intersect_pairs(a: DataFrame, b: DataFrame, match_strand: bool = False, min_bp: int = 1) -> DataFrame:
    """(a_name, b_name, overlap_bp) of spans that share at least ``min_bp`` positions."""
    keys = ["chrom", *(["strand"] if match_strand else [])]
    left = a.select(*keys, F.col("name").alias("a_name"), "tx_start", "tx_end")
    right = b.select(*keys, F.col("name").alias("b_name"), F.col("tx_start").alias("b_start"), F.col("tx_end").alias("b_end"))
    return overlap_join(left, right, keys, min_bp, a_cols=("tx_start", "tx_end"), b_cols=("b_start", "b_end")).select("a_name", "b_name", "overlap_bp")


def intersect_counts(a: DataFrame, b: DataFrame, match_strand: bool = False, min_bp: int = 1) -> DataFrame:
    """(b_name, n, overlap_bp): the pairs of ``intersect_pairs`` counted and summed by ``b_name`` without making them."""
    keys = ["chrom", *(["strand"] if match_strand else [])]
    right = b.select(*keys, F.col("name").alias("b_name"), "tx_start", "tx_end")
    return overlap_counts(a, right, keys, ["b_name"], min_bp, a_cols=("tx_start", "tx_end"), b_cols=("tx_start", "tx_end"))
