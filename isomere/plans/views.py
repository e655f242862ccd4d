"""Reads, genes, samples and texts derived from the driver's tables, for Spark and for DuckDB.

The tables hold no genomic columns; these views spread line items over 200 loci
of three contigs and three strands, and parts over the same loci as genes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread

_READS = """
SELECT 'chr' || CAST(l_suppkey % 3 + 1 AS {s}) AS contig,
       CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand,
       CAST((l_partkey % 200) * 1500 + (l_orderkey % 4) * 7 + CASE WHEN l_quantity > 40 THEN 300 ELSE 0 END AS BIGINT) AS {q}start{q},
       CAST((l_partkey % 200) * 1500 + 1000 + (l_linenumber % 3) * 9 - CASE WHEN l_quantity < 10 THEN 150 ELSE 0 END AS BIGINT) AS {q}end{q},
       CAST(l_orderkey AS {s}) || '_' || CAST(l_linenumber AS {s}) || '_' || CAST(l_partkey AS {s}) || '_' || CAST(l_suppkey AS {s}) AS id,
       's' || CAST(l_suppkey % 4 AS {s}) AS sample
FROM lineitem
"""
_GENES = """
SELECT CAST(p_partkey AS BIGINT) AS gene_idx, 'chr' || CAST(p_size % 3 + 1 AS {s}) AS contig,
       CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand,
       CAST((p_partkey % 200) * 1500 + p_size * 10 AS BIGINT) AS {q}start{q},
       CAST((p_partkey % 200) * 1500 + p_size * 10 + 400 AS BIGINT) AS {q}end{q},
       'g' || CAST(p_partkey AS {s}) AS gene_id
FROM part
"""

READS_SQL = _READS.format(s="VARCHAR", q='"')
GENES_SQL = _GENES.format(s="VARCHAR", q='"')
SAMPLES_SQL = "SELECT * FROM (VALUES ('s0', 'even'), ('s1', 'odd'), ('s2', 'even'), ('s3', 'odd')) t(sample, grp)"
SAMPLES = [("s0", "even"), ("s1", "odd"), ("s2", "even"), ("s3", "odd")]


_USED = {"lineitem": ["l_suppkey", "l_returnflag", "l_partkey", "l_orderkey", "l_quantity", "l_linenumber"], "part": ["p_partkey", "p_size"]}


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*_USED[table]))
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=rows)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, strand, start, end, id, sample."""
    return _view(spark, sf_dir, "lineitem", _READS.format(s="STRING", q="`"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_idx, contig, strand, start, end, gene_id."""
    return _view(spark, sf_dir, "part", _GENES.format(s="STRING", q="`"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLES_SQL)
