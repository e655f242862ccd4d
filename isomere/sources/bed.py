"""BED6, BED12, TSV and membership lines as tables.

Parsers take a table with a string column ``value`` (as ``spark.read.text``
gives) and raise on malformed lines when they are evaluated.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 4_294_967_295


def number(text: Column, what: str) -> Column:
    """An unsigned 32-bit number: digits, with a plus sign at most."""
    value = F.when(text.rlike(r"^\+?[0-9]{1,19}$"), text.try_cast("long"))
    return F.when(text.isNull(), F.lit(None).cast("long")).when(value <= LIMIT, value).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(text, F.lit("missing")))).cast("long"))


def strand(text: Column) -> Column:
    return F.when(text.isNull() | text.isin("+", "-", "."), text).otherwise(F.raise_error(F.concat(F.lit("invalid strand: "), F.coalesce(text, F.lit("missing")))))


def fields(lines: DataFrame, least: int, what: str, tabs_only: bool = False) -> DataFrame:
    """Adds ``f``: fields of the lines that are neither blank nor comments; white space parts them where no tab does."""
    # nothing is raised for lines that are passed over, in whatever order conditions are evaluated
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    df = lines.withColumn("_l", F.when((line != "") & ~line.startswith("#"), line)).filter(F.col("_l").isNotNull())
    cut = F.split("_l", "\t") if tabs_only else F.when(F.col("_l").contains("\t"), F.split("_l", "\t")).otherwise(F.split("_l", r"\s+"))
    # the generator keeps the fields one column, else every use of a field would split the line anew
    df = df.withColumn("_f", F.explode(F.array(cut)))
    wide = F.when(F.col("_l").isNull() | (F.size("_f") >= least), F.col("_f")).otherwise(F.raise_error(F.concat(F.lit(f"too few columns in {what}: "), "_l")).cast("array<string>"))
    return df.withColumn("f", wide).drop("_l", "_f")


def _at(k: int) -> Column:
    return F.try_element_at("f", F.lit(k))


def _ordered(s: Column, e: Column) -> Column:
    return F.when(s.isNull() | e.isNull() | (s <= e), e).otherwise(F.raise_error(F.concat(F.lit("start after end: "), s.cast("string"), F.lit(" "), e.cast("string"))).cast("long"))


def parse_bed6(lines: DataFrame) -> DataFrame:
    """chrom, start, end, name, score (0 if unreadable), strand, extra."""
    df = fields(lines, 6, "BED6").withColumns({"start": number(_at(2), "start"), "_e": number(_at(3), "end")})
    score = F.when(_at(5).rlike(r"^\+?[0-9]{1,19}$"), _at(5).try_cast("long"))
    return df.select(*(c for c in df.columns if c not in ("value", "f", "_e", "start")), _at(1).alias("chrom"), "start", _ordered(F.col("start"), F.col("_e")).alias("end"), _at(4).alias("name"), F.when(score <= LIMIT, score).otherwise(0).alias("score"), strand(_at(6)).alias("strand"), F.slice("f", 7, F.greatest(F.size("f"), F.lit(1))).alias("extra"))


def _list(text: Column, what: str) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: number(x, what))


def parse_bed12(lines: DataFrame) -> DataFrame:
    """chrom, strand, tx_start, tx_end, name, score, thick_start, thick_end, item_rgb, exons, extra; blocks end with the transcript at the latest."""
    df = fields(lines, 12, "BED12").withColumns({"tx_start": number(_at(2), "start"), "_e": number(_at(3), "end"), "_n": number(_at(10), "block count"), "_sizes": _list(_at(11), "block size"), "_starts": _list(_at(12), "block start")})
    df = df.withColumn("tx_end", _ordered(F.col("tx_start"), F.col("_e")))
    ok = (F.size("_sizes") == F.col("_n")) & (F.size("_starts") == F.col("_n")) & (F.col("_n") > 0)
    exons = F.array_sort(F.zip_with("_starts", "_sizes", lambda s, z: F.struct((F.col("tx_start") + s).alias("start"), F.least(F.col("tx_start") + s + z, F.col("tx_end")).alias("end"))))
    good = F.forall(exons, lambda x: x["start"] <= x["end"])
    kind = "array<struct<start:bigint,end:bigint>>"
    score = F.when(_at(5).rlike(r"^\+?[0-9]{1,19}$"), _at(5).try_cast("long"))
    return df.select(_at(1).alias("chrom"), strand(_at(6)).alias("strand"), "tx_start", "tx_end", _at(4).alias("name"), F.coalesce(score, F.lit(0)).alias("score"), number(_at(7), "thick start").alias("thick_start"), number(_at(8), "thick end").alias("thick_end"), _at(9).alias("item_rgb"), F.when(ok & good, exons.cast(kind)).otherwise(F.raise_error(F.concat(F.lit("bad blocks: "), "value")).cast(kind)).alias("exons"), F.slice("f", 13, F.greatest(F.size("f"), F.lit(1))).alias("extra"))


def parse_tsv(lines: DataFrame) -> DataFrame:
    """contig, strand, start, end, id of lines contig, start, end, id, strand."""
    df = fields(lines, 5, "reads").withColumns({"start": number(_at(2), "start"), "_e": number(_at(3), "end")})
    return df.select(_at(1).alias("contig"), strand(_at(5)).alias("strand"), "start", _ordered(F.col("start"), F.col("_e")).alias("end"), _at(4).alias("id"))


def parse_membership(lines: DataFrame, tabs_only: bool = False) -> DataFrame:
    """(id, tu_id) of membership lines; further columns are not looked at."""
    df = fields(lines, 2, "membership", tabs_only)
    return df.select(*(c for c in df.columns if c not in ("value", "f")), _at(1).alias("id"), _at(2).alias("tu_id"))


def as_reads(df: DataFrame, fmt: str) -> DataFrame:
    """contig, strand, start, end, id of parsed lines; of BED12 the outer span only."""
    if fmt == "bed6":
        return df.select(F.col("chrom").alias("contig"), "strand", "start", "end", F.col("name").alias("id"))
    if fmt == "bed12":
        return df.select(F.col("chrom").alias("contig"), "strand", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), F.col("name").alias("id"))
    return df


def infer_format(path: str, default: str = "bed6") -> str:
    """bed6, bed12, tsv or fastq by the file's name; unknown names are BED6."""
    name = path.lower()
    if name.endswith((".fastq", ".fq", ".fastq.gz", ".fq.gz")):
        return "fastq"
    for end, fmt in ((".bed12", "bed12"), (".bed", "bed6"), (".tsv", "tsv"), (".txt", "tsv")):
        if name.endswith(end):
            return fmt
    return default


PARSERS = {"bed6": parse_bed6, "bed12": parse_bed12, "tsv": parse_tsv}


def read_reads(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    fmt = infer_format(path) if fmt == "auto" else fmt
    if fmt == "fastq":
        raise ValueError(f"{path}: FASTQ is not supported directly; map the reads first")
    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt!r}")
    return as_reads(PARSERS[fmt](spark.read.text(path)), fmt)
