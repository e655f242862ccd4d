"""The queries of the engine, each over whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import annotate, cluster, counts, missed, ranges, transcripts
from ..runtime import durable
from ..sources import bam, bed, gff, writers
from . import oracles
from .views import genes, reads, samples

PLACE = ["contig", "strand", "start", "end"]
MISSED = missed.MissedParams(min_family=8, min_mode=5)
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _clustered(spark: SparkSession, sf_dir: str, p: cluster.ClusterParams = cluster.ClusterParams(), **more) -> cluster.Clustering:
    return cluster.cluster(reads(spark, sf_dir), p, **more)


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships under pooled ids."""
    df = reads(spark, sf_dir).withColumn("id", iv.pooled_id("sample", "id"))
    return cluster.cluster(df).membership


# scalars, filters, scans


@query
def interval_scalars(spark, sf_dir):
    """Every scalar on read against the middle of its locus."""
    df = reads(spark, sf_dir).withColumns({"ws": F.expr("start div 1500 * 1500 + 100"), "we": F.expr("start div 1500 * 1500 + 900")})
    a = ("start", "end", "ws", "we")
    cut = iv.intersection(*a)
    return df.select(
        "id", "contig", "strand", "start", "end", iv.length("start", "end").alias("len"), iv.overlap_len(*a).alias("overlap"), iv.overlaps(*a).alias("hit"), cut["start"].alias("cut_start"), cut["end"].alias("cut_end"), iv.score1(*a).alias("score1"), iv.score2(*a).alias("score2"),
        iv.distance("start", "end", F.col("we") + 200, F.col("we") + 250).alias("gap"), iv.three_prime("strand", "start", "end").alias("p3"), iv.five_prime("strand", "start", "end").alias("p5"), iv.five_prime_delta("strand", *a).alias("delta5"), iv.within_three_prime("strand", *a, 12).alias("within3"),
    )


@query
def read_filter(spark, sf_dir):
    return reads(spark, sf_dir).filter((F.col("start") < F.col("end")) & (iv.length("start", "end") >= 1000)).select(*PLACE, "id")


def _bed_lines(spark, sf_dir):
    """The reads as BED6 lines with comments, blanks and odd scores among them."""
    df = reads(spark, sf_dir)
    score = F.when(F.length("id") % 3 == 0, F.lit("bad")).otherwise(F.length("id").cast("string"))
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "id", score, "strand")
    line = F.when(F.length("id") % 5 == 0, F.concat(F.lit("  "), line, F.lit("\textra\tmore"))).when(F.length("id") % 7 == 0, F.regexp_replace(line, "\t", " ")).otherwise(line)
    notes = df.select(F.lit("# note").alias("value")).union(df.select(F.lit("").alias("value")))
    return df.select(line.alias("value")).union(notes)


@query
def bed6_scan(spark, sf_dir):
    return bed.parse_bed6(_bed_lines(spark, sf_dir)).select(F.col("chrom").alias("contig"), "start", "end", F.col("name").alias("id"), "score", "strand", F.size("extra").cast("long").alias("n_extra"))


@query
def bed12_scan(spark, sf_dir):
    """Exons and introns of BED12 lines with two blocks a read."""
    df = reads(spark, sf_dir)
    last = F.col("end") - F.col("start") - 300
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "id", F.lit("0"), "strand", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("0"), F.lit("2"), F.lit("200,400,"), F.concat(F.lit("0,"), last.cast("string"), F.lit(",")))
    t = bed.parse_bed12(df.select(line.alias("value"))).withColumn("gaps", iv.introns("exons"))
    return t.select(F.col("name").alias("id"), "tx_start", "tx_end", iv.total_len("exons").alias("exon_bp"), F.size("gaps").cast("long").alias("n_introns"), F.try_element_at("gaps", F.lit(1))["start"].alias("intron_start"), F.try_element_at("gaps", F.lit(1))["end"].alias("intron_end"))


@query
def tsv_scan(spark, sf_dir):
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "id", "strand")
    return bed.parse_tsv(reads(spark, sf_dir).select(line.alias("value"))).select(*PLACE, "id")


@query
def gff_scan(spark, sf_dir):
    """Genes written as GFF3 and read again, with the order of id attributes."""
    g = genes(spark, sf_dir)
    attrs = F.when(F.col("gene_idx") % 4 == 0, F.concat(F.lit("ID=x;Name="), "gene_id")).when(F.col("gene_idx") % 4 == 1, F.concat(F.lit("locus_tag="), "gene_id", F.lit(";ID=y"))).when(F.col("gene_idx") % 4 == 2, F.concat(F.lit("ID="), "gene_id", F.lit("=2"))).otherwise(F.lit("note=none"))
    kind = F.when(F.col("gene_idx") % 5 == 0, "CDS").otherwise("gene")
    line = F.concat_ws("\t", "contig", F.lit("src"), kind, (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    return gff.parse_gff3(g.select(line.alias("value"), F.col("gene_idx").alias("line_no"))).select("gene_idx", "contig", "strand", "start", "end", "gene_id")


@query
def pooled_union(spark, sf_dir):
    return counts.pooled_rows(reads(spark, sf_dir)).select("id", "sample", *PLACE)


@query
def interval_flags(spark, sf_dir):
    """Emptiness and strand keys of reads and of reads cut at the end of their locus."""
    df = reads(spark, sf_dir).withColumn("stop", F.greatest("start", F.expr("start div 1500 * 1500 + 1000")))
    return df.select("id", "start", "stop", iv.is_empty("start", "stop").alias("empty"), iv.strand_key("strand", True).alias("matched"), iv.strand_key("strand", False).alias("any_strand"))


@query
def gene_kinds(spark, sf_dir):
    """Feature kinds of GFF3 attributes by biotype."""
    g = genes(spark, sf_dir)
    attrs = F.when(F.col("gene_idx") % 3 == 0, "ID=a;gene_biotype=protein_coding").when(F.col("gene_idx") % 3 == 1, F.concat(F.lit("gene_biotype=ncRNA_"), F.col("gene_idx").cast("string"))).otherwise("ID=b")
    return g.select("gene_idx", gff.kind(attrs).alias("kind"))


@query
def bed6_reads(spark, sf_dir):
    """Reads of BED6 lines."""
    return bed.as_reads(bed.parse_bed6(_bed_lines(spark, sf_dir)), "bed6").select(*PLACE, "id")


@query
def bed12_reads(spark, sf_dir):
    """Reads of BED12 lines: the outer spans."""
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "id", F.lit("0"), "strand", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("0"), F.lit("1"), (F.col("end") - F.col("start")).cast("string"), F.lit("0"))
    return bed.as_reads(bed.parse_bed12(reads(spark, sf_dir).select(line.alias("value"))), "bed12").select(*PLACE, "id")


@query
def bam_scan(spark, sf_dir):
    """Reads packed into BAM files in a column and decoded again; unmapped, secondary and spliced records are left out."""
    return bam.decode(bam.packed(reads(spark, sf_dir))).select(F.col("chrom").alias("contig"), "start", "end", F.col("name").alias("id"), "score", "strand")


@query
def bed6_lines(spark, sf_dir):
    """Units as BED6 lines."""
    tus = _clustered(spark, sf_dir).tus
    return tus.select("tu_id", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "tu_id", F.lit("0"), "strand").alias("line"))


@query
def pooled_lines(spark, sf_dir):
    """Reads under pooled ids as BED6 lines."""
    return writers.text(counts.pooled_rows(reads(spark, sf_dir)).withColumn("zero", F.lit(0)), "contig", "start", "end", "id", "zero", "strand")


@query
def gene_lines(spark, sf_dir):
    """Genes as BED6 lines."""
    return writers.text(genes(spark, sf_dir).withColumn("zero", F.lit(0)), "contig", "start", "end", "gene_id", "zero", "strand")


@query
def membership_lines(spark, sf_dir):
    """Memberships with scores of six decimals."""
    return writers.text(_clustered(spark, sf_dir).membership, "id", "tu_id", "score1", "score2", scores=("score1", "score2"))


@query
def tu_count_lines(spark, sf_dir):
    return writers.text(_clustered(spark, sf_dir).tus, "tu_id", "n_reads", sep=",")


@query
def sample_count_lines(spark, sf_dir):
    return writers.text(counts.sample_counts(_pooled(spark, sf_dir)), "tu_id", "sample", "count")


@query
def tu_gene_lines(spark, sf_dir):
    hits = annotate.unit_genes(_clustered(spark, sf_dir).tus, genes(spark, sf_dir))
    return writers.text(hits, "contig", "strand", "tu_id", "tu_start", "tu_end", "gene_id", "gene_start", "gene_end", "overlap_bp")


@query
def read_unit_lines(spark, sf_dir):
    """(read, isoform) lines, the units of seeds alone being the isoforms."""
    return writers.text(_clustered(spark, sf_dir, cluster.ClusterParams(attach=False)).membership, "id", "tu_id")


@query
def bed12_lines(spark, sf_dir):
    """Merged genes as BED12 lines of one block."""
    m = ranges.merge_overlaps(genes(spark, sf_dir), ["contig", "strand"])
    size = F.concat((F.col("end") - F.col("start")).cast("string"), F.lit(","))
    line = writers.bed12_line(F.col("contig"), F.col("start"), F.col("end"), F.lit("m"), F.col("n_merged"), F.col("strand"), size, F.lit("0,"), F.lit(1))
    return m.select(line.alias("line"))


# range joins and islands


def _places(spark, sf_dir):
    return reads(spark, sf_dir).select(*PLACE).distinct()


def _sites(spark, sf_dir):
    return genes(spark, sf_dir).select("contig", "strand", "gene_idx", F.col("start").alias("b_start"), F.col("end").alias("b_end"))


@query
def overlap_join(spark, sf_dir):
    return ranges.overlap_join(_places(spark, sf_dir), _sites(spark, sf_dir), ["contig", "strand"])


@query
def overlap_join_min_bp(spark, sf_dir):
    return ranges.overlap_join(_places(spark, sf_dir), _sites(spark, sf_dir), ["contig", "strand"], min_bp=250)


@query
def overlap_join_any_strand(spark, sf_dir):
    g = _sites(spark, sf_dir).withColumnRenamed("strand", "b_strand")
    pairs = ranges.overlap_join(_places(spark, sf_dir), g, ["contig"])
    return pairs.groupBy("contig", "strand", "b_strand", "gene_idx").agg(F.count("*").alias("n"), F.sum("overlap_bp").alias("overlap_bp"))


@query
def regions_islands(spark, sf_dir):
    at = ranges.islands(cluster.distinct_intervals(reads(spark, sf_dir)), ["contig", "strand"])
    return _long(at.groupBy("contig", "strand", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_reads").alias("n")), "island")


@query
def cluster_stats(spark, sf_dir):
    return cluster.stats(reads(spark, sf_dir))


@query
def span_clusters(spark, sf_dir):
    return ranges.span_clusters(reads(spark, sf_dir), False).drop("strand")


@query
def span_clusters_match(spark, sf_dir):
    return ranges.span_clusters(reads(spark, sf_dir), True)


@query
def merge_overlaps(spark, sf_dir):
    return ranges.merge_overlaps(genes(spark, sf_dir), ["contig", "strand"])


@query
def list_lengths(spark, sf_dir):
    """Lengths and scores of the merged gene lists of plus and minus, by contig and locus block."""
    m = ranges.merge_overlaps(genes(spark, sf_dir), ["contig", "strand"]).withColumn("block", F.expr("start div 30000"))
    pack = lambda s: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("strand") == s, F.struct("start", "end")))), F.array())
    w = m.groupBy("contig", "block").agg(pack("+").alias("a"), pack("-").alias("b"))
    return w.select("contig", "block", iv.total_len("a").alias("len_a"), iv.total_len("b").alias("len_b"), iv.list_intersection_len("a", "b").alias("shared_bp"), iv.list_union_len("a", "b").alias("covered_bp"), iv.list_score1("a", "b").alias("score1"), iv.list_score2("a", "b").alias("score2"), iv.exonic_overlap("a", "b").alias("walked"))


# clustering


@query
def seed_edges(spark, sf_dir):
    return cluster.seed_edges(_places(spark, sf_dir), 0.95)


@query
def seed_edges_low(spark, sf_dir):
    """The same under a threshold of 0.3, which takes the plain bins."""
    e = cluster.seed_edges(_places(spark, sf_dir), 0.3)
    return e.groupBy("contig", "strand", "a_start").agg(F.count("*").alias("n"), F.min("score1").alias("least"))


@query
def seed_components(spark, sf_dir):
    """Sizes of the connected components, found by contraction."""
    places = cluster.distinct_intervals(reads(spark, sf_dir))
    s = cluster.seeds_by_join(places, 0.95)
    return s.groupBy("seed").agg(F.min(F.struct(*PLACE)).alias("f"), F.count("*").alias("n"), F.sum("n_reads").alias("n_reads"), F.max("end").alias("last_end")).select("f.*", "n", "n_reads", "last_end")


@query
def representatives(spark, sf_dir):
    placed = cluster.assign(reads(spark, sf_dir))
    reps = placed.select("contig", "strand", F.col("rep_start").alias("start"), F.col("rep_end").alias("end")).distinct()
    return reps.join(cluster.distinct_intervals(reads(spark, sf_dir)).select(*PLACE, "id"), PLACE)


def _parents(spark, sf_dir, p):
    places = cluster.distinct_intervals(reads(spark, sf_dir))
    reps = durable(cluster.representatives(cluster.seeds_by_join(places, p.t1)), "representatives")
    return cluster.parents(reps, p)


@query
def attach_parents(spark, sf_dir):
    return _parents(spark, sf_dir, cluster.ClusterParams())


@query
def attach_five_prime_override(spark, sf_dir):
    return _parents(spark, sf_dir, cluster.ClusterParams(t2=0.9, max_five=40))


def _units(c):
    return c.tus.select("tu_id", *PLACE, "id", "n_reads")


@query
def cluster_tus(spark, sf_dir):
    return _units(_clustered(spark, sf_dir))


@query
def cluster_tus_seed_only(spark, sf_dir):
    return _units(_clustered(spark, sf_dir, cluster.ClusterParams(attach=False)))


@query
def cluster_tus_by_joins(spark, sf_dir):
    """The same units with every island taken as too large for one task."""
    return _units(_clustered(spark, sf_dir, island=0))


@query
def cluster_tus_override(spark, sf_dir):
    return _units(_clustered(spark, sf_dir, cluster.ClusterParams(t2=0.9, max_five=40)))


@query
def membership_scores(spark, sf_dir):
    return _clustered(spark, sf_dir).membership.select("id", *PLACE, "tu_id", "score1", "score2")


@query
def min_tu_count_filter(spark, sf_dir):
    return _units(_clustered(spark, sf_dir, min_count=20))


# counts


@query
def tu_counts(spark, sf_dir):
    return counts.unit_counts(_clustered(spark, sf_dir).membership)


@query
def tu_sample_long(spark, sf_dir):
    return counts.sample_counts(_pooled(spark, sf_dir))


@query
def tu_sample_matrix(spark, sf_dir):
    return counts.matrix(counts.sample_counts(_pooled(spark, sf_dir)), "tu_id", "sample", ["s0", "s1", "s2", "s3"])


@query
def tu_group_matrix(spark, sf_dir):
    by = counts.group_counts(counts.sample_counts(_pooled(spark, sf_dir)), samples(spark, sf_dir))
    return counts.matrix(by, "tu_id", "grp", ["even", "odd"])


@query
def recount(spark, sf_dir):
    """Counts from (id, unit) lines alone, units under 20 reads left out without new numbers."""
    lines = _pooled(spark, sf_dir).select(F.concat_ws("\t", "id", "tu_id", F.col("score1").cast("string")).alias("value"))
    return counts.recount(bed.parse_membership(lines), samples(spark, sf_dir), 20)


@query
def membership_scan(spark, sf_dir):
    """Membership lines read again: tabs, further columns, notes and blank lines."""
    m = _pooled(spark, sf_dir)
    lines = m.select(F.concat_ws("\t", "id", "tu_id", F.lit("1.000000"), F.lit("0.9")).alias("value"))
    notes = m.limit(3).select(F.lit("# note").alias("value")).union(m.limit(2).select(F.lit("").alias("value")))
    return bed.parse_membership(lines.union(notes))


@query
def tu_counts_least(spark, sf_dir):
    """Units of 20 reads at least, under the ids that they have."""
    return counts.unit_counts(_clustered(spark, sf_dir).membership, 20)


@query
def unknown_samples(spark, sf_dir):
    """Samples of pooled ids that a shorter list lacks."""
    return counts.unknown_samples(_pooled(spark, sf_dir), samples(spark, sf_dir).filter("grp = 'even'"))


@query
def unit_ids(spark, sf_dir):
    """The different units of each sample, in order."""
    return counts.unit_ids(_pooled(spark, sf_dir))


@query
def fractional_counts(spark, sf_dir):
    """Orders as isoforms, parts as subreads they share, some parts left out."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").cast("string").alias("r")).distinct()
    lists = li.groupBy(F.col("l_orderkey").cast("string").alias("isoform_id")).agg(annotate.name2(F.array_sort(F.collect_list("r"))).alias("subreads"))
    out = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("name"))
    return counts.fractional_counts(lists, out).withColumn("count", F.round("count", 9))


# genes


@query
def tu_gene_overlap(spark, sf_dir):
    hits = annotate.unit_genes(_clustered(spark, sf_dir).tus, genes(spark, sf_dir))
    return hits.select("contig", "strand", "tu_id", "tu_start", "tu_end", "gene_id", "gene_start", "gene_end", "overlap_bp")


def _hits(spark, sf_dir, c):
    return annotate.unit_genes(c.tus, genes(spark, sf_dir)).select("tu_id", "gene_idx")


@query
def gene_counts(spark, sf_dir):
    c = _clustered(spark, sf_dir)
    return counts.gene_counts(genes(spark, sf_dir), _hits(spark, sf_dir, c), counts.unit_counts(c.membership))


@query
def gene_sample_matrix(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("id", iv.pooled_id("sample", "id"))
    c = cluster.cluster(df)
    g = genes(spark, sf_dir)
    long = counts.gene_counts(g, _hits(spark, sf_dir, c), counts.sample_counts(c.membership), ["sample"])
    names = ["s0", "s1", "s2", "s3"]
    return long.groupBy("gene_idx", "gene_id").pivot("sample", names).agg(F.sum("count")).na.fill(0, names)


@query
def gene_group_matrix(spark, sf_dir):
    df = reads(spark, sf_dir).withColumn("id", iv.pooled_id("sample", "id"))
    c = cluster.cluster(df)
    g = genes(spark, sf_dir)
    by = counts.group_counts(counts.sample_counts(c.membership), samples(spark, sf_dir))
    names = ["even", "odd"]
    return counts.gene_counts(g, _hits(spark, sf_dir, c), by, ["grp"]).groupBy("gene_idx", "gene_id").pivot("grp", names).agg(F.sum("count")).na.fill(0, names)


@query
def bed12_blocks(spark, sf_dir):
    c = _clustered(spark, sf_dir)
    return _long(annotate.anchored_blocks(c.tus, genes(spark, sf_dir), c.membership), "block_count")


@query
def junction_subset(spark, sf_dir):
    """Gene chains by locus: which chain of introns is part of, or equal to, that of the next strand."""
    g = genes(spark, sf_dir).withColumn("locus", F.expr("start div 6000"))
    t = g.groupBy("contig", "strand", "locus").agg(F.array_sort(F.collect_list(F.struct(F.expr("start div 100 * 100").alias("start"), (F.expr("start div 100 * 100") + 50).alias("end")))).alias("x"))
    t = t.withColumn("x", F.array_distinct("x"))
    other = t.select("contig", "locus", F.col("strand").alias("other"), F.col("x").alias("y"))
    return t.join(other, ["contig", "locus"]).filter("strand <> other").select("contig", "locus", "strand", "other", F.size(iv.introns("x")).cast("long").alias("n_introns"), iv.junctions_subset("x", "y").alias("part"), iv.junctions_equal("contig", F.lit("+"), "x", "contig", F.lit("+"), "y").alias("same"))


def _transcripts(spark, sf_dir):
    return reads(spark, sf_dir).select(F.col("contig").alias("chrom"), "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.col("id").alias("name"))


@query
def representative_transcripts(spark, sf_dir):
    """The longest read of each locus and strand."""
    t = _transcripts(spark, sf_dir).withColumn("locus", F.expr("tx_start div 1500"))
    return transcripts.representative(t, ["chrom", "strand", "locus"])


@query
def transcript_order(spark, sf_dir):
    """The places of transcripts in the order chromosome, start, end, strand, name."""
    return ranges.ranked(durable(_transcripts(spark, sf_dir), "transcripts"), ["chrom", "tx_start", "tx_end", "strand", "name"], "place")[0]


@query
def intersect_transcripts(spark, sf_dir):
    """Reads against genes as spans, any strand, 300 positions at least, counted by gene."""
    g = genes(spark, sf_dir).select(F.col("contig").alias("chrom"), "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.col("gene_id").alias("name"))
    return transcripts.intersect_counts(_transcripts(spark, sf_dir), g, min_bp=300)


# missed modes


@query
def three_prime_families(spark, sf_dir):
    fam = missed.families(reads(spark, sf_dir), 12)
    return _long(fam.groupBy("contig", "strand", "family").agg(F.count("*").alias("n"), F.min("p3").alias("first3"), F.max("p3").alias("last3")), "family")


@query
def family_mode_coord(spark, sf_dir):
    return _long(missed.family_modes(missed.families(reads(spark, sf_dir), 12), 8), "family")


@query
def five_prime_modes(spark, sf_dir):
    fam = missed.families(reads(spark, sf_dir), 12)
    return missed.five_prime_modes(fam, missed.family_modes(fam, 8), MISSED)


def _modes(spark, sf_dir):
    fam = durable(missed.families(reads(spark, sf_dir), 12), "families")
    return missed.candidate_modes(fam, missed.five_prime_modes(fam, missed.family_modes(fam, 8), MISSED), MISSED)


@query
def candidate_modes(spark, sf_dir):
    return _modes(spark, sf_dir)


def _few_units(spark, sf_dir):
    """Units to diagnose against: clustering under wide thresholds, so that some modes are missed."""
    c = _clustered(spark, sf_dir, cluster.ClusterParams(t1=0.85, t2=0.5))
    return c.tus.withColumn("tu_idx", F.substring("tu_id", 3, 20).cast("long")), c.membership


@query
def nearest_tu(spark, sf_dir):
    return missed.nearest_units(_modes(spark, sf_dir), _few_units(spark, sf_dir)[0], MISSED)


@query
def gene_hint(spark, sf_dir):
    return missed.gene_hints(_modes(spark, sf_dir), genes(spark, sf_dir)).select("contig", "strand", "start", "end", "gene_hint")


@query
def diagnose_missed(spark, sf_dir):
    return missed.diagnose(reads(spark, sf_dir), _few_units(spark, sf_dir)[0], genes(spark, sf_dir), MISSED)


@query
def dedup_candidates(spark, sf_dir):
    return _long(missed.without_neighbours(durable(_modes(spark, sf_dir), "modes"), missed.MissedParams(window3=400, window5=400)), "cand_idx")


def _rescued(spark, sf_dir):
    tus, members = _few_units(spark, sf_dir)
    # read ids are unique for rescue: the last of equal ones stays
    one = reads(spark, sf_dir).groupBy("id").agg(F.max(F.struct(*PLACE)).alias("p")).select("id", "p.*")
    own = members.groupBy("id").agg(F.max_by("tu_id", F.struct(*PLACE)).alias("tu_id"))
    return missed.rescue(one, tus, own, genes(spark, sf_dir), MISSED)


@query
def rescue_units(spark, sf_dir):
    return _rescued(spark, sf_dir)[0]


@query
def rescue_membership(spark, sf_dir):
    return _rescued(spark, sf_dir)[1]


ORACLES = oracles.ORACLES
