"""Count tables of units, samples, groups and genes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..runtime import small


def pooled(samples: dict[str, DataFrame]) -> DataFrame:
    """Reads of all samples under pooled ids, with the sample name."""
    out = None
    for name, reads in samples.items():
        if "::" in name:
            raise ValueError(f"sample name {name!r} holds '::'")
        part = reads.withColumns({"id": iv.pooled_id(F.lit(name), "id"), "sample": F.lit(name)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no samples")
    return out


def pooled_rows(reads: DataFrame) -> DataFrame:
    """The same for reads that name their sample in a column, in one pass."""
    name = F.when(F.col("sample").contains("::"), F.raise_error(F.concat(F.lit("sample name holds '::': "), "sample")).cast("string")).otherwise(F.col("sample"))
    return reads.withColumn("sample", name).withColumn("id", iv.pooled_id("sample", "id"))


def unit_ids(membership: DataFrame) -> DataFrame:
    """(sample, tu_ids): the different units of pooled ids, sorted."""
    return membership.groupBy(iv.pooled_sample("id").alias("sample")).agg(F.array_join(F.array_sort(F.collect_set("tu_id")), ",").alias("tu_ids"))


def unit_counts(membership: DataFrame, minimum: int = 0) -> DataFrame:
    return membership.groupBy("tu_id").agg(F.count("*").alias("count")).filter(F.col("count") >= minimum)


def sample_counts(membership: DataFrame, minimum: int = 0) -> DataFrame:
    """(tu_id, sample, count) of pooled ids; units under ``minimum`` in all go, without new numbers."""
    long = membership.groupBy("tu_id", iv.pooled_sample("id").alias("sample")).agg(F.count("*").alias("count"))
    if minimum <= 0:
        return long
    return long.join(long.groupBy("tu_id").agg(F.sum("count").alias("_all")).filter(F.col("_all") >= minimum).select("tu_id"), "tu_id", "left_semi")


def matrix(long: DataFrame, key: str, column: str, names: list[str], value: str = "count") -> DataFrame:
    """Wide, zero-filled table with a column for each of ``names``."""
    return long.groupBy(key).pivot(column, names).agg(F.sum(value)).na.fill(0, names)


def group_counts(long: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts by sample group; samples without a group are left out. ``samples``: (sample, grp)."""
    return long.join(small(samples.filter("grp is not null")), "sample").groupBy("tu_id", "grp").agg(F.sum("count").alias("count"))


def unknown_samples(membership: DataFrame, samples: DataFrame) -> DataFrame:
    """Sample names of pooled ids that the manifest does not list."""
    return membership.select(iv.pooled_sample("id").alias("sample")).distinct().join(small(samples), "sample", "left_anti")


def recount(assignments: DataFrame, samples: DataFrame, minimum: int = 0) -> DataFrame:
    """(tu_id, sample, count) from (id, tu_id) alone; a sample that the manifest lacks is an error."""
    if bad := [r.sample for r in unknown_samples(assignments, samples).limit(5).collect()]:
        raise ValueError(f"reads of unknown samples: {', '.join(bad)}")
    return sample_counts(assignments, minimum)


def gene_counts(genes: DataFrame, hits: DataFrame, per_unit: DataFrame, by: list[str] = []) -> DataFrame:
    """One row per annotation record, in file order and with zeros: sum of the counts of the different units that overlap it.

    ``hits``: (tu_id, gene_idx); ``per_unit``: (tu_id, *by, count).
    """
    sums = hits.select("tu_id", "gene_idx").distinct().join(per_unit, "tu_id").groupBy("gene_idx", *by).agg(F.sum("count").alias("count"))
    return genes.select("gene_idx", "gene_id").join(sums, "gene_idx", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def fractional_counts(lists: DataFrame, excluded: DataFrame) -> DataFrame:
    """Counts of isoforms whose subreads are shared: each subread gives 1 / (isoforms that list it).

    ``lists``: (isoform_id, subreads as ``r1,r2,|n``); names in ``excluded`` (name) count nothing.
    """
    names = F.filter(F.split(F.substring_index("subreads", "|", 1), ","), lambda x: x != "")
    rows = lists.select("isoform_id", F.explode(names).alias("name")).join(excluded, "name", "left_anti")
    share = rows.groupBy("name").agg((F.lit(1.0) / F.count("*")).alias("share"))
    sums = rows.join(share, "name").groupBy("isoform_id").agg(F.sum("share").alias("count"))
    return lists.select("isoform_id").join(sums, "isoform_id", "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
