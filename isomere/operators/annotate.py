"""Units against gene annotation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import overlap_join


def unit_genes(tus: DataFrame, genes: DataFrame) -> DataFrame:
    """Overlaps of units with genes of the same contig and strand, with ``overlap_bp``."""
    g = genes.select("contig", "strand", "gene_idx", "gene_id", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"))
    t = tus.select("contig", "strand", "tu_id", F.col("start").alias("tu_start"), F.col("end").alias("tu_end"))
    return overlap_join(t, g, ["contig", "strand"], a_cols=("tu_start", "tu_end"), b_cols=("gene_start", "gene_end"))


def anchored_blocks(tus: DataFrame, genes: DataFrame, membership: DataFrame) -> DataFrame:
    """BED12 rows: a block for each overlapping gene (the whole unit without one), member ids and gene ids.

    Blocks of overlapping genes are not merged.
    """
    hits = unit_genes(tus, genes)
    hit = F.struct(F.col("gene_start").alias("gs"), F.col("gene_end").alias("ge"), F.col("gene_id").alias("gid"), F.greatest("tu_start", "gene_start").alias("start"), F.least("tu_end", "gene_end").alias("end"))
    blocks = hits.groupBy("tu_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    members = membership.groupBy("tu_id").agg(F.array_sort(F.collect_list(F.struct("contig", "strand", "start", "end", "id"))).alias("members"))
    out = tus.join(blocks, "tu_id", "left").join(members, "tu_id", "left")
    spans = F.coalesce(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))), F.array(F.struct("start", "end")))
    text = lambda f: F.concat(F.array_join(F.transform(spans, f), ","), F.lit(","))
    return out.select(
        "tu_id", "contig", "strand", "start", "end", F.size(spans).alias("block_count"), text(lambda b: (b["end"] - b["start"]).cast("string")).alias("block_sizes"), text(lambda b: (b["start"] - F.col("start")).cast("string")).alias("block_starts"),
        name2(F.transform("members", lambda m: m["id"])).alias("name2"), F.coalesce(F.array_join(F.transform("hits", lambda h: h["gid"]), ","), F.lit(".")).alias("gene_list"),
    )


def name2(ids):
    """``r1,r2,|2``; ``,|0`` for none."""
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return F.concat(F.array_join(ids, ","), F.lit(",|"), F.size(ids).cast("string"))
