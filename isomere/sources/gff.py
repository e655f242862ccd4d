"""Genes of GFF3 lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bed import number, strand

#: What a gene is called after, first come first served.
NAMES = ("Name", "gene", "locus_tag", "ID")


def attribute(attrs: Column, name: str) -> Column:
    """The last value of a key; keys end at the first ``=``, entries at ``;``."""
    own = F.filter(F.split(attrs, ";"), lambda x: x.startswith(f"{name}="))
    return F.try_element_at(F.transform(own, lambda x: F.substr(x, F.lit(len(name) + 2))), F.lit(-1))


def parse_gff3(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """gene_idx, contig, strand, start, end (half-open), gene_id, attrs of ``gene`` lines of nine fields; other lines are passed over.

    ``order`` names the column that holds the place in the file; genes without
    a name are called by their number among the genes.
    """
    f = F.split("value", "\t", -1)
    df = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", f).filter((F.size("f") == 9) & (F.col("f")[2] == "gene"))
    one = number(F.col("f")[3], "start")
    start = F.when(one >= 1, one - 1).otherwise(F.raise_error(F.lit("GFF3 coordinates start at 1")).cast("long"))
    df = df.withColumns({"contig": F.col("f")[0], "strand": strand(F.col("f")[6]), "start": start, "_e": number(F.col("f")[4], "end"), "attrs": F.col("f")[8]})
    df = df.withColumn("end", F.when(F.col("start") <= F.col("_e"), F.col("_e")).otherwise(F.raise_error(F.lit("start after end in GFF3")).cast("long")))
    df = df.withColumn("gene_idx", F.row_number().over(Window.orderBy(order)).cast("long"))
    name = F.coalesce(*(attribute(F.col("attrs"), k) for k in NAMES), F.concat(F.lit("gene_"), F.col("gene_idx").cast("string")))
    return df.select("gene_idx", "contig", "strand", "start", "end", name.alias("gene_id"), "attrs")


def kind(attrs: Column) -> Column:
    """Feature kind: mRNA for protein_coding, any other biotype as it is, gene without one."""
    biotype = attribute(attrs, "gene_biotype")
    return F.coalesce(F.when(biotype == "protein_coding", "mRNA").otherwise(biotype), F.lit("gene"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a file; annotation files are small, so their lines are numbered in one task."""
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return parse_gff3(lines)
