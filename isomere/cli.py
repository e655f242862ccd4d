"""Command line: cluster, recount, diagnose-missed-tus, rescue-missed-tus, bam-to-bed, gff-to-bed, map, run."""
from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intervals as iv
from .operators import annotate, cluster, counts, missed
from .runtime import durable
from .sources import bam, bed, gff, manifest
from .sources import writers as w

PLACE = ["contig", "strand", "start", "end"]


def session(threads: int | None = None) -> SparkSession:
    """The active session, or a new one; ``threads`` are the cores of a local one, and are refused if they are none."""
    if threads is not None and threads < 1:
        raise SystemExit("--threads must be at least 1")
    if (spark := SparkSession.getActiveSession()) is not None:
        return spark
    new = SparkSession.builder.appName("isomere").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    if threads and "spark.master" not in new._options and not os.environ.get("MASTER"):
        new = new.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", threads)
    return new.getOrCreate()


class Phases:
    """Times of the phases of a command, a line each on the error stream if asked for."""

    def __init__(self, shown: bool):
        self.shown, self.began = shown, time.time()
        self.last = self.began

    def end(self, name: str) -> None:
        now = time.time()
        if self.shown:
            print(f"{name}\t{now - self.last:.3f} s", file=sys.stderr)
        self.last = now

    def total(self) -> None:
        if self.shown:
            print(f"total\t{time.time() - self.began:.3f} s", file=sys.stderr)


def _paths(a: argparse.Namespace, source: str, names: dict[str, str]) -> None:
    """Fills missing output paths with files of the output folder."""
    if not a.out_dir:
        stem = os.path.splitext(os.path.basename(source))[0] or "isomere"
        a.out_dir = os.path.join(os.path.dirname(source) or ".", f"{stem}.isomere")
    for name, file in names.items():
        if getattr(a, name, None) is None:
            setattr(a, name, os.path.join(a.out_dir, file))


def _annotation(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Genes with their place in the file; annotation is small, so it is numbered in one task."""
    if not path:
        return None
    from pyspark.sql import Window

    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    g = bed.parse_bed6(lines)
    return durable(g.select(F.row_number().over(Window.orderBy("line_no")).cast("long").alias("gene_idx"), F.col("chrom").alias("contig"), "strand", "start", "end", F.col("name").alias("gene_id")), "genes")


def _pooled(spark: SparkSession, records: list[manifest.Sample], fmt: str) -> DataFrame:
    fmt = manifest.manifest_format(records) if fmt == "auto" else fmt
    return counts.pooled({s.sample: bed.read_reads(spark, s.reads, fmt) for s in records})


def _matrices(a, long: DataFrame, key: str, names: list[str], records, by: dict[str, DataFrame], order: list) -> None:
    """Sample and group matrices; no group file without groups."""
    for path, column, cols, df in ((names[0], "sample", [s.sample for s in records], long), (names[1], "grp", manifest.groups(records), by.get("grp"))):
        target = getattr(a, path, None)
        if target and cols and df is not None:
            wide = df.groupBy(*order, *([] if key in order else [key])).pivot(column, cols).agg(F.sum("count")).na.fill(0, cols)
            w.write_lines(target, w.lines(wide, order, key, *cols), "\t".join([key, *cols]))


def _unit_tables(spark, a, membership: DataFrame, records) -> DataFrame:
    table = manifest.as_table(spark, records)
    long = durable(counts.recount(membership, table, a.min_tu_count or 0), "long")
    if a.out_tu_count:
        w.write_lines(a.out_tu_count, w.lines(long.groupBy("tu_id").agg(F.sum("count").alias("count")), ["tu_id"], "tu_id", "count", sep=","), "tu_id,count")
    if a.out_tu_sample_count_long:
        w.write_lines(a.out_tu_sample_count_long, w.lines(long.join(F.broadcast(table), "sample"), ["tu_id", "sample_idx"], "tu_id", "sample", "count"), "tu_id\tsample\tcount")
    by = counts.group_counts(long, table.select("sample", "grp"))
    # units of samples without a group still have their row
    if manifest.groups(records):
        by = long.select("tu_id").distinct().join(by, "tu_id", "left")
    _matrices(a, long, "tu_id", ["out_tu_sample_count_matrix", "out_tu_group_count_matrix"], records, {"grp": by}, ["tu_id"])
    return long


def run_cluster(a: argparse.Namespace) -> None:
    phases, spark = Phases(a.timings), session(a.threads)
    if bool(a.input) == bool(a.manifest):
        raise SystemExit("give either --in or --manifest")
    params = cluster.ClusterParams(a.score1_threshold, a.score2_threshold, not a.skip_score2_attachment, a.three_prime_tolerance_bp, a.max_5p_delta)
    names = {"out_tu": "tus.bed", "out_membership": "membership.tsv", "out_tu_count": "tu_count.csv"}
    if a.manifest:
        names |= {"out_pooled_reads": "pooled.bed", "out_tu_sample_count_long": "tu_sample_long.tsv", "out_tu_sample_count_matrix": "tu_sample_matrix.tsv", "out_tu_group_count_matrix": "tu_group_matrix.tsv"}
    if a.annotation_bed:
        names |= {"out_tu_gene": "tu_gene.tsv", "out_tu_bed12": "tus.anchored.bed12", "out_gene_count": "gene_count.csv"}
        if a.manifest:
            names |= {"out_gene_sample_count_matrix": "gene_sample_matrix.tsv", "out_gene_group_count_matrix": "gene_group_matrix.tsv"}
    _paths(a, a.input or a.manifest, names)
    records = manifest.parse_manifest(a.manifest) if a.manifest else None
    reads = _pooled(spark, records, a.format) if records else bed.read_reads(spark, a.input, a.format)
    reads = reads.filter("start < end")
    if a.min_read_len:
        reads = reads.filter(iv.length("start", "end") >= a.min_read_len)
    if records:
        at = F.monotonically_increasing_id()
        if a.parts:
            w.write_parts(a.out_pooled_reads, reads.withColumns({"_at": at, "_zero": F.lit(0)}), ["_at"], "contig", "start", "end", "id", "_zero", "strand")
        else:
            w.write_lines(a.out_pooled_reads, w.bed6(reads.withColumn("_at", at), "id", ["_at"]))
    phases.end("read")
    c = cluster.cluster(reads, params, a.min_tu_count or 0)
    phases.end("cluster")
    members = durable(c.membership, "membership")
    phases.end("membership")
    w.write_lines(a.out_tu, w.bed6(c.tus, "tu_id", ["tu_id"]))
    columns = dict(scores=("score1", "score2"))
    if a.parts:
        w.write_parts(a.out_membership, members, [*PLACE, "id"], "id", "tu_id", "score1", "score2", **columns)
    else:
        w.write_lines(a.out_membership, w.lines(members, [*PLACE, "id"], "id", "tu_id", "score1", "score2", **columns))
    long = None
    if records:
        keep, a.min_tu_count = a.min_tu_count, 0
        long = _unit_tables(spark, a, members.select("id", "tu_id"), records)
        a.min_tu_count = keep
    else:
        w.write_lines(a.out_tu_count, w.lines(c.tus, ["tu_id"], "tu_id", "n_reads", sep=","), "tu_id,count")
    phases.end("write and count")
    if a.annotation_bed:
        genes = _annotation(spark, a.annotation_bed)
        hits = durable(annotate.unit_genes(c.tus, genes), "hits")
        cols = ("contig", "strand", "tu_id", "tu_start", "tu_end", "gene_id", "gene_start", "gene_end", "overlap_bp")
        w.write_lines(a.out_tu_gene, w.lines(hits, ["tu_id", "gene_start", "gene_end", "gene_id"], *cols), "#" + "\t".join(cols))
        b = annotate.anchored_blocks(c.tus, genes, members)
        line = w.bed12_line(*(F.col(x) for x in ("contig", "start", "end", "tu_id")), F.lit(0), *(F.col(x) for x in ("strand", "block_sizes", "block_starts", "block_count", "name2", "gene_list")))
        w.write_lines(a.out_tu_bed12, (r.line for r in b.select("tu_id", line.alias("line")).orderBy("tu_id").toLocalIterator()))
        total = counts.gene_counts(genes, hits, c.tus.select("tu_id", F.col("n_reads").alias("count")))
        w.write_lines(a.out_gene_count, w.lines(total, ["gene_idx"], "gene_id", "count", sep=","), "gene_id,count")
        if records:
            per = counts.gene_counts(genes, hits, long, ["sample"])
            grouped = counts.gene_counts(genes, hits, counts.group_counts(long, manifest.as_table(spark, records).select("sample", "grp")), ["grp"])
            _matrices(a, per, "gene_id", ["out_gene_sample_count_matrix", "out_gene_group_count_matrix"], records, {"grp": grouped}, ["gene_idx"])
        phases.end("annotate")
    phases.total()


def run_recount(a: argparse.Namespace) -> None:
    phases, spark = Phases(a.timings), session(a.threads)
    _paths(a, a.manifest, {"out_tu_count": "tu_count.csv", "out_tu_sample_count_long": "tu_sample_long.tsv", "out_tu_sample_count_matrix": "tu_sample_matrix.tsv", "out_tu_group_count_matrix": "tu_group_matrix.tsv"})
    records = manifest.parse_manifest(a.manifest)
    members = bed.parse_membership(spark.read.text(a.pooled_membership))
    phases.end("read")
    _unit_tables(spark, a, members, records)
    phases.end("write and count")
    phases.total()


def _missed_inputs(spark, a) -> tuple[DataFrame, DataFrame, DataFrame | None, missed.MissedParams]:
    from pyspark.sql import Window

    reads = bed.read_reads(spark, a.input, "bed6")
    if a.min_read_len:
        reads = reads.filter(iv.length("start", "end") >= a.min_read_len)
    lines = spark.read.text(a.existing_tu).withColumn("_at", F.monotonically_increasing_id())
    tus = bed.parse_bed6(lines).select(F.row_number().over(Window.orderBy("_at")).cast("long").alias("tu_idx"), F.col("name").alias("tu_id"), F.col("chrom").alias("contig"), "strand", "start", "end")
    p = missed.MissedParams(a.three_prime_window_bp, a.five_prime_window_bp, a.min_family_support, a.min_mode_support, a.min_mode_fraction, a.max_candidates_per_family)
    return reads, durable(tus, "tus"), _annotation(spark, a.annotation_bed), p


#: The columns of the candidates report.
REPORT = "candidate_id contig strand candidate_start candidate_end three_prime_coord five_prime_coord family_support mode_support mode_fraction reason nearest_tu_id nearest_tu_start nearest_tu_end nearest_tu_three_prime_delta_bp nearest_tu_five_prime_delta_bp nearest_tu_score1 nearest_tu_score2 gene_hint".split()


def _report(cands: DataFrame, tsv: str | None, out_bed: str | None) -> None:
    cols = ["candidate_id", *PLACE, "c3", "c5", "family_support", "mode_support", "mode_fraction", "reason", "nearest_tu_id", "nearest_start", "nearest_end", "d3", "d5", "score1", "score2", "gene_hint"]
    rows = cands.orderBy("candidate_id")
    show = lambda c, v: "." if v is None else w.six(v) if c in ("mode_fraction", "score1", "score2") else str(v)
    if tsv:
        w.write_lines(tsv, ("\t".join(show(c, r[c]) for c in cols) for r in rows.toLocalIterator()), "\t".join(REPORT))
    if out_bed:
        w.write_lines(out_bed, ("\t".join(map(str, (r.contig, r.start, r.end, f"{r.candidate_id}|{r.reason}|{r.gene_hint}", r.mode_support, r.strand))) for r in rows.toLocalIterator()))


def run_diagnose(a: argparse.Namespace) -> None:
    reads, tus, genes, p = _missed_inputs(session(), a)
    _report(missed.diagnose(reads, tus, genes, p), a.out_tsv, a.out_bed)


def run_rescue(a: argparse.Namespace) -> None:
    from pyspark.sql import Window

    spark = session()
    reads, tus, genes, p = _missed_inputs(spark, a)
    lines = spark.read.text(a.existing_membership).withColumn("_at", F.monotonically_increasing_id())
    known = bed.parse_membership(lines, tabs_only=True)
    last = Window.partitionBy("id").orderBy(F.col("_at").desc())
    known = known.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("id", "tu_id")
    units, members, cands = missed.rescue(reads, tus, known, genes, p, a.rescued_id_prefix)
    order = [*PLACE, "tu_id"]
    w.write_lines(a.out_tu, w.bed6(units, "tu_id", order))
    w.write_lines(a.out_membership, w.lines(members, [*PLACE, "id"], "id", "tu_id", "score1", "score2", scores=("score1", "score2")))
    w.write_lines(a.out_tu_count, w.lines(units, order, "tu_id", "n_reads", sep=","), "tu_id,count")
    n = cands.count()
    cands = cands.withColumn("candidate_id", iv.padded_id("MISS", F.row_number().over(Window.orderBy("cand_idx")), n, 4))
    _report(cands, a.out_candidates_tsv, a.out_candidates_bed)


def _bam_to_bed(spark: SparkSession, source: str, out: str) -> None:
    rows = bam.sorted_bed(bam.read_bam(spark, source))
    w.write_lines(out, ("\t".join(map(str, (r.chrom, r.start, r.end, r.name, r.score, r.strand))) for r in rows.toLocalIterator()))


def _bed_manifest(spark: SparkSession, records: list[manifest.Sample], out_dir: str) -> str:
    manifest.check_file_names(records)
    rows = []
    for s in records:
        to = os.path.abspath(os.path.join(out_dir, "bed", f"{manifest.file_name(s.sample)}.bed"))
        _bam_to_bed(spark, s.reads, to)
        rows.append(f"{s.sample}\t{s.group or ''}\t{to}")
    path = os.path.join(out_dir, "samples.bed.tsv")
    w.write_lines(path, rows, "sample\tgroup\treads")
    return path


def run_bam_to_bed(a: argparse.Namespace) -> None:
    if a.in_bam:
        _bam_to_bed(session(), a.in_bam, a.out_bed)
    else:
        _bed_manifest(session(), manifest.parse_manifest(a.manifest), a.out_dir)


def run_gff_to_bed(a: argparse.Namespace) -> None:
    w.write_lines(a.out_bed, w.bed6(gff.read_gff3(session(), a.annotation_gff), "gene_id", ["gene_idx"]))


def _map(records: list[manifest.Sample], a: argparse.Namespace) -> list[manifest.Sample]:
    """Maps each sample's FASTQ with minimap2 and samtools, programs of their own, one sample after another."""
    manifest.check_file_names(records)
    os.makedirs(os.path.join(a.out_dir, "bam"), exist_ok=True)
    os.makedirs(os.path.join(a.out_dir, "logs"), exist_ok=True)
    out, rows, threads = [], [], str(a.threads or os.cpu_count() or 1)
    for s in records:
        name = manifest.file_name(s.sample)
        to = os.path.abspath(os.path.join(a.out_dir, "bam", f"{name}.sorted.bam"))
        steps = [
            ["minimap2", *a.minimap2_args.split(), "-t", threads, a.reference_fasta, s.reads],
            ["samtools", "view", "-b", "-F", "260", "-F", "2048", "-q", str(a.min_mapq), "-"],
            ["samtools", "sort", "-@", threads, "-o", to, "-"],
        ]
        running, feed = [], None
        for k, step in enumerate(steps):
            log = open(os.path.join(a.out_dir, "logs", f"{name}.{k}.{step[0]}.log"), "w")  # noqa: SIM115
            running.append(subprocess.Popen(step, stdin=feed, stdout=subprocess.PIPE if k < 2 else None, stderr=log))
            if feed:
                feed.close()
            feed = running[-1].stdout
        if any([p.wait() for p in running]):
            raise SystemExit(f"mapping of sample {s.sample!r} failed; see {a.out_dir}/logs")
        subprocess.run(["samtools", "index", to], check=True)
        out.append(manifest.Sample(s.sample, to, s.group))
        rows.append(f"{s.sample}\t{s.group or ''}\t{to}")
    w.write_lines(os.path.join(a.out_dir, "samples.bam.tsv"), rows, "sample\tgroup\treads")
    return out


def run_map(a: argparse.Namespace) -> str:
    mapped = _map(manifest.parse_manifest(a.manifest), a)
    return _bed_manifest(session(), mapped, a.out_dir)


def run_all(a: argparse.Namespace) -> None:
    beds = run_map(a)
    genes = a.annotation_bed
    if a.annotation_gff:
        genes = os.path.join(a.out_dir, "annotation.bed")
        w.write_lines(genes, w.bed6(gff.read_gff3(session(), a.annotation_gff), "gene_id", ["gene_idx"]))
    args = ["cluster", "--manifest", beds, "--format", "bed6", "--out-dir", os.path.join(a.out_dir, "results"), *(["--annotation-bed", genes] if genes else [])]
    for name in ("score1_threshold", "score2_threshold", "three_prime_tolerance_bp", "max_5p_delta", "min_read_len", "min_tu_count"):
        if (value := getattr(a, name)) is not None:
            args += [f"--{name.replace('_', '-')}", str(value)]
    main([*args, *(["--skip-score2-attachment"] if a.skip_score2_attachment else []), *(["--timings"] if a.timings else [])])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="isomere", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        return p

    def thresholds(p) -> None:
        p.add_argument("--score1-threshold", type=float, default=0.95)
        p.add_argument("--score2-threshold", type=float, default=0.80)
        p.add_argument("--three-prime-tolerance-bp", type=int, default=12)
        p.add_argument("--max-5p-delta", type=int)
        p.add_argument("--skip-score2-attachment", action="store_true")
        p.add_argument("--min-read-len", type=int)
        p.add_argument("--min-tu-count", type=int)

    def plain(p, *names: str, required: tuple[str, ...] = ()) -> None:
        for n in names:
            p.add_argument(f"--{n}", required=n in required)

    units = ("out-tu-count", "out-tu-sample-count-long", "out-tu-sample-count-matrix", "out-tu-group-count-matrix")
    c = command("cluster", run_cluster)
    c.add_argument("--in", dest="input")
    c.add_argument("--format", choices=["auto", "bed6", "bed12", "tsv"], default="auto")
    plain(c, "manifest", "out-dir", "out-tu", "out-membership", "out-pooled-reads", *units, "annotation-bed", "out-tu-gene", "out-tu-bed12", "out-gene-count", "out-gene-sample-count-matrix", "out-gene-group-count-matrix")
    thresholds(c)
    c.add_argument("--parts", action="store_true", help="write membership and pooled reads as folders of ordered text files, from the executors")
    c.add_argument("--threads", type=int)
    c.add_argument("--timings", action="store_true")

    r = command("recount", run_recount)
    plain(r, "manifest", "pooled-membership", "out-dir", *units, required=("manifest", "pooled-membership"))
    r.add_argument("--min-tu-count", type=int)
    r.add_argument("--threads", type=int)
    r.add_argument("--timings", action="store_true")

    def windows(p) -> None:
        p.add_argument("--in", dest="input", required=True)
        p.add_argument("--three-prime-window-bp", type=int, default=12)
        p.add_argument("--five-prime-window-bp", type=int, default=10)
        p.add_argument("--min-family-support", type=int, default=20)
        p.add_argument("--min-mode-support", type=int, default=20)
        p.add_argument("--min-mode-fraction", type=float, default=0.02)
        p.add_argument("--max-candidates-per-family", type=int, default=3)
        p.add_argument("--min-read-len", type=int)

    d = command("diagnose-missed-tus", run_diagnose)
    windows(d)
    plain(d, "existing-tu", "annotation-bed", "out-tsv", "out-bed", required=("existing-tu", "out-tsv"))
    s = command("rescue-missed-tus", run_rescue)
    windows(s)
    plain(s, "existing-tu", "existing-membership", "annotation-bed", "out-tu", "out-membership", "out-tu-count", "out-candidates-tsv", "out-candidates-bed", required=("existing-tu", "existing-membership", "out-tu", "out-membership", "out-tu-count"))
    s.add_argument("--rescued-id-prefix", default="RESC")

    b = command("bam-to-bed", run_bam_to_bed)
    plain(b, "in-bam", "manifest", "out-bed", "out-dir")
    g = command("gff-to-bed", run_gff_to_bed)
    g.add_argument("--annotation-gff", "--gff", required=True)
    plain(g, "out-bed", required=("out-bed",))

    for name, run in (("map", run_map), ("run", run_all)):
        m = command(name, run)
        plain(m, "manifest", "reference-fasta", "out-dir", required=("manifest", "reference-fasta", "out-dir"))
        m.add_argument("--threads", type=int)
        m.add_argument("--min-mapq", type=int, default=0)
        m.add_argument("--minimap2-args", default="-ax map-ont")
        if name == "run":
            plain(m, "annotation-bed", "annotation-gff")
            thresholds(m)
            m.add_argument("--timings", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
