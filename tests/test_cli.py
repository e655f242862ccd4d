import subprocess
import sys
from pathlib import Path

import pytest

from isomere import cli
from isomere.sources import bam, manifest

REPO = Path(__file__).resolve().parent.parent

# The input lines and the expected files of the tests below are golden values of the formats.


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def lines(path):
    return Path(path).read_text().splitlines()


@pytest.fixture
def two_samples(tmp_path):
    put(tmp_path / "a.bed", "chr1\t100\t200\tr1\t0\t+\nchr1\t101\t201\tr2\t0\t+\nchr1\t300\t400\tr3\t0\t+\n")
    put(tmp_path / "b.bed", "chr1\t120\t180\tr1\t0\t+\nchr1\t300\t400\tr2\t0\t+\nchr1\t500\t600\tr3\t0\t+\n")
    put(tmp_path / "genes.bed", "chr1\t90\t150\tgeneA\t0\t+\nchr1\t160\t220\tgeneB\t0\t+\nchr1\t290\t310\tgeneC\t0\t+\nchr1\t490\t520\tgeneD\t0\t+\n")
    return put(tmp_path / "m.tsv", "sample\tgroup\treads\nsampleA\tcontrol\ta.bed\nsampleB\ttreated\tb.bed\n")


def test_cluster_and_recount(spark, two_samples, tmp_path):
    out = tmp_path / "out"
    cli.main(["cluster", "--manifest", two_samples, "--annotation-bed", str(tmp_path / "genes.bed"), "--out-dir", str(out), "--score2-threshold", "0.99"])
    assert lines(out / "tus.bed") == ["chr1\t100\t200\tTU000001\t0\t+", "chr1\t120\t180\tTU000002\t0\t+", "chr1\t300\t400\tTU000003\t0\t+", "chr1\t500\t600\tTU000004\t0\t+"]
    assert [x.split("\t")[0] for x in lines(out / "membership.tsv")] == ["sampleA::r1", "sampleA::r2", "sampleB::r1", "sampleA::r3", "sampleB::r2", "sampleB::r3"]
    assert lines(out / "membership.tsv")[1] == "sampleA::r2\tTU000001\t0.980198\t0.990000"
    assert lines(out / "tu_count.csv") == ["tu_id,count", "TU000001,2", "TU000002,1", "TU000003,2", "TU000004,1"]
    assert lines(out / "tu_sample_long.tsv") == ["tu_id\tsample\tcount", "TU000001\tsampleA\t2", "TU000002\tsampleB\t1", "TU000003\tsampleA\t1", "TU000003\tsampleB\t1", "TU000004\tsampleB\t1"]
    assert lines(out / "tu_sample_matrix.tsv") == ["tu_id\tsampleA\tsampleB", "TU000001\t2\t0", "TU000002\t0\t1", "TU000003\t1\t1", "TU000004\t0\t1"]
    assert lines(out / "tu_group_matrix.tsv") == ["tu_id\tcontrol\ttreated", "TU000001\t2\t0", "TU000002\t0\t1", "TU000003\t1\t1", "TU000004\t0\t1"]
    assert lines(out / "gene_count.csv") == ["gene_id,count", "geneA,3", "geneB,3", "geneC,2", "geneD,1"]
    assert lines(out / "gene_sample_matrix.tsv")[1:] == ["geneA\t2\t1", "geneB\t2\t1", "geneC\t1\t1", "geneD\t0\t1"]
    assert [x.split("\t")[3] for x in lines(out / "pooled.bed")] == ["sampleA::r1", "sampleA::r2", "sampleA::r3", "sampleB::r1", "sampleB::r2", "sampleB::r3"]
    assert lines(out / "tu_gene.tsv")[:2] == ["#contig\tstrand\ttu_id\ttu_start\ttu_end\tgene_id\tgene_start\tgene_end\toverlap_bp", "chr1\t+\tTU000001\t100\t200\tgeneA\t90\t150\t50"]
    assert lines(out / "tus.anchored.bed12")[0] == "chr1\t100\t200\tTU000001\t0\t+\t100\t200\t0\t2\t50,40,\t0,60,\tsampleA::r1,sampleA::r2,|2\tgeneA,geneB"
    again = tmp_path / "again"
    cli.main(["recount", "--manifest", two_samples, "--pooled-membership", str(out / "membership.tsv"), "--out-dir", str(again)])
    for name in ("tu_count.csv", "tu_sample_long.tsv", "tu_sample_matrix.tsv", "tu_group_matrix.tsv"):
        assert lines(again / name) == lines(out / name)


def test_no_group_column_no_group_file(spark, tmp_path):
    put(tmp_path / "a.bed", "chr1\t100\t200\tr1\t0\t+\n")
    m = put(tmp_path / "m.tsv", "reads\tsample\na.bed\tA\n")
    cli.main(["cluster", "--manifest", m, "--out-dir", str(tmp_path / "o")])
    assert not (tmp_path / "o/tu_group_matrix.tsv").exists() and lines(tmp_path / "o/tu_sample_matrix.tsv") == ["tu_id\tA", "TU000001\t1"]


def test_empty_input(spark, tmp_path):
    b, g = put(tmp_path / "e.bed", "# nothing\n"), put(tmp_path / "g.bed", "c\t1\t5\tg1\t0\t+\n")
    cli.main(["cluster", "--in", b, "--annotation-bed", g, "--out-dir", str(tmp_path / "o")])
    assert lines(tmp_path / "o/tus.bed") == [] and lines(tmp_path / "o/tu_count.csv") == ["tu_id,count"] and lines(tmp_path / "o/gene_count.csv") == ["gene_id,count", "g1,0"]


def test_diagnose_and_rescue(spark, tmp_path):
    reads = put(tmp_path / "r.bed", "".join(f"chr1\t{a}\t210\tr{k}\t0\t+\n" for k, a in enumerate((100, 102, 104, 150, 151), 1)))
    tus, genes = put(tmp_path / "t.bed", "chr1\t150\t210\tTU000001\t0\t+\n"), put(tmp_path / "g.bed", "chr1\t105\t205\tgeneA\t0\t+\n")
    member = put(tmp_path / "m.tsv", "".join(f"r{k}\tTU000001\t1.0\t1.0\n" for k in range(1, 6)))
    small = ["--min-family-support", "2", "--min-mode-support", "2", "--min-mode-fraction", "0.2", "--in", reads, "--existing-tu", tus, "--annotation-bed", genes]
    cli.main(["diagnose-missed-tus", *small, "--out-tsv", str(tmp_path / "c.tsv"), "--out-bed", str(tmp_path / "c.bed")])
    assert lines(tmp_path / "c.tsv")[1] == "MISS0001\tchr1\t+\t100\t210\t210\t100\t5\t3\t0.600000\tsame_3p_missing_5p_mode\tTU000001\t150\t210\t0\t50\t0.545455\t0.545455\tgeneA"
    assert lines(tmp_path / "c.bed") == ["chr1\t100\t210\tMISS0001|same_3p_missing_5p_mode|geneA\t3\t+"]
    cli.main(["rescue-missed-tus", *small, "--existing-membership", member, "--out-tu", str(tmp_path / "x.bed"), "--out-membership", str(tmp_path / "x.tsv"), "--out-tu-count", str(tmp_path / "x.csv")])
    assert lines(tmp_path / "x.bed") == ["chr1\t100\t210\tRESC0001\t0\t+", "chr1\t150\t210\tTU000001\t0\t+"]
    assert lines(tmp_path / "x.csv") == ["tu_id,count", "RESC0001,3", "TU000001,2"]
    assert lines(tmp_path / "x.tsv") == ["r1\tRESC0001\t1.000000\t1.000000", "r2\tRESC0001\t0.981818\t0.981818", "r3\tRESC0001\t0.963636\t0.963636", "r4\tTU000001\t1.000000\t1.000000", "r5\tTU000001\t0.983333\t0.983333"]


def test_bam(spark, tmp_path):
    rows = [
        dict(name="r_plus", flag=0, ref=0, pos=99, mapq=42, cigar=[(0, 10)]), dict(name="r_minus", flag=16, ref=0, pos=149, mapq=60, cigar=[(4, 3), (0, 4), (1, 2), (2, 2)]), dict(name="second", flag=256, ref=0, pos=5, mapq=1, cigar=[(0, 5)]),
        dict(name="spliced", flag=0, ref=0, pos=5, mapq=1, cigar=[(0, 10), (3, 100), (0, 10)]), dict(name="unmapped", flag=4, ref=-1, pos=-1, mapq=0, cigar=[]), dict(name="r_chr2", flag=0, ref=1, pos=49, mapq=255, cigar=[(0, 5)]),
    ]
    bam.write_bam(str(tmp_path / "x.bam"), [("chr1", 1000), ("chr2", 1000)], rows * 1 + [])
    cli.main(["bam-to-bed", "--in-bam", str(tmp_path / "x.bam"), "--out-bed", str(tmp_path / "x.bed")])
    assert lines(tmp_path / "x.bed") == ["chr1\t99\t109\tr_plus\t42\t+", "chr1\t149\t155\tr_minus\t60\t-", "chr2\t49\t54\tr_chr2\t0\t+"]
    m = put(tmp_path / "m.tsv", "sample\treads\ns/1\tx.bam\n")
    cli.main(["bam-to-bed", "--manifest", m, "--out-dir", str(tmp_path / "o")])
    assert lines(tmp_path / "o/samples.bed.tsv")[1].startswith("s/1\t\t") and len(lines(tmp_path / "o/bed/s_1.bed")) == 3
    bam.write_bam(str(tmp_path / "long.bam"), [("chr1", 10**6)], [dict(name=f"read{k}", flag=0, ref=0, pos=k, mapq=9, cigar=[(0, 7)]) for k in range(5000)])
    assert bam.read_bam(spark, str(tmp_path / "long.bam")).count() == 5000


def test_bgzf_blocks_and_plain_gzip():
    import gzip
    import zlib

    data = bytes(range(256)) * 2000
    rows = [dict(name=f"r{k}", flag=0, ref=0, pos=k, mapq=9, cigar=[(0, 7)]) for k in range(3000)]
    raw = bam.bam_bytes([("chr1", 10**6)], rows)
    whole = b"".join(bam.inflate(raw))
    assert whole[:4] == b"BAM\1" and len(list(bam.records(raw))) == 3000 and len(list(bam.inflate(raw))) > 1
    assert b"".join(bam.inflate(gzip.compress(data) + gzip.compress(data[:77]))) == data + data[:77]
    for broken in (raw[:-5], gzip.compress(data)[:-9]):
        with pytest.raises((ValueError, zlib.error)):
            list(bam.inflate(broken))


STUB = """#!{python}
import sys
sys.path.insert(0, {repo!r})
from isomere.sources import bam
name, args = {name!r}, sys.argv[1:]
if name == "minimap2":
    if "broken" in args[-1]:
        sys.exit("cannot map")
    assert "-t" in args and args[-2].endswith("ref.fa")
    print("\\n".join(x[1:].strip() for x in open(args[-1]) if x.startswith("@")))
elif args[0] == "view":
    sys.stdout.write(sys.stdin.read())
elif args[0] == "sort":
    rows = [dict(name=x.split(":")[0], flag=0, ref=0, pos=int(x.split(":")[1]), mapq=30, cigar=[(0, 100)]) for x in sys.stdin.read().split()]
    bam.write_bam(args[args.index("-o") + 1], [("chr1", 10000)], rows)
else:
    open(args[1] + ".bai", "w").close()
"""


@pytest.fixture
def stubs(tmp_path, monkeypatch):
    for name in ("minimap2", "samtools"):
        at = Path(put(tmp_path / "bin" / name, STUB.format(python=sys.executable, repo=str(REPO), name=name)))
        at.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path / 'bin'}:/usr/bin:/bin")
    put(tmp_path / "ref.fa", ">chr1\nACGT\n")
    put(tmp_path / "a.fastq", "@a1:100\nA\n+\nI\n@a2:101\nA\n+\nI\n")
    put(tmp_path / "b.fq", "@b1:100\nA\n+\nI\n@b2:500\nA\n+\nI\n")
    return put(tmp_path / "m.tsv", "sample\tgroup\treads\nA\tx\ta.fastq\nB\ty\tb.fq\n")


def test_map_and_run_with_stub_programs(spark, stubs, tmp_path, capsys):
    out = tmp_path / "mapped"
    common = ["--manifest", stubs, "--reference-fasta", str(tmp_path / "ref.fa")]
    cli.main(["map", *common, "--out-dir", str(out), "--threads", "2"])
    assert [x.split("\t")[:2] for x in lines(out / "samples.bam.tsv")[1:]] == [["A", "x"], ["B", "y"]]
    assert lines(out / "bed/A.bed") == ["chr1\t100\t200\ta1\t30\t+", "chr1\t101\t201\ta2\t30\t+"]
    assert (out / "bam/A.sorted.bam.bai").exists() and (out / "logs/A.0.minimap2.log").exists()
    g = put(tmp_path / "x.gff", "chr1\ts\tgene\t51\t150\t.\t+\t.\tName=geneA\n")
    cli.main(["run", *common, "--out-dir", str(tmp_path / "all"), "--annotation-gff", g, "--timings"])
    results = tmp_path / "all/results"
    assert lines(results / "tus.bed") == ["chr1\t100\t200\tTU000001\t0\t+", "chr1\t500\t600\tTU000002\t0\t+"]
    assert lines(results / "tu_sample_matrix.tsv") == ["tu_id\tA\tB", "TU000001\t2\t1", "TU000002\t0\t1"]
    assert lines(results / "gene_count.csv") == ["gene_id,count", "geneA,3"]
    said = [x.split("\t")[0] for x in capsys.readouterr().err.splitlines() if x.endswith(" s")]
    assert said == ["read", "cluster", "membership", "write and count", "annotate", "total"]


def test_failed_mapping_is_an_error(spark, stubs, tmp_path):
    put(tmp_path / "broken.fq", "@x:1\n")
    m = put(tmp_path / "n.tsv", "sample\treads\nA\tbroken.fq\n")
    with pytest.raises(SystemExit, match="mapping of sample 'A' failed"):
        cli.main(["map", "--manifest", m, "--reference-fasta", str(tmp_path / "ref.fa"), "--out-dir", str(tmp_path / "o")])
    with pytest.raises(SystemExit, match="threads"):
        cli.session(0)


def test_gff_to_bed(spark, tmp_path):
    g = put(tmp_path / "x.gff", "##gff-version 3\nchr1\ts\tgene\t11\t50\t.\t+\t.\tName=geneA\nchr1\ts\tCDS\t1\t2\t.\t+\t.\t.\n")
    cli.main(["gff-to-bed", "--annotation-gff", g, "--out-bed", str(tmp_path / "x.bed")])
    assert lines(tmp_path / "x.bed") == ["chr1\t10\t50\tgeneA\t0\t+"]


@pytest.mark.parametrize("text,match", [
    ("", "empty manifest"), ("sample\tgroup\nA\tx\n", "missing column 'reads'"), ("sample\treads\tsample\n", "duplicate column"), ("sample\treads\nA\tx\nA\ty\n", "duplicate sample"), ("sample\treads\na::b\tx\n", "::"), ("sample\treads\tgroup\nA\tx\t\n", "too few"),
])
def test_manifest_errors(tmp_path, text, match):
    with pytest.raises(manifest.ManifestError, match=match):
        manifest.parse_manifest(put(tmp_path / "m.tsv", text))


def test_manifest_rules(tmp_path):
    m = manifest.parse_manifest(put(tmp_path / "m.tsv", "# c\nSAMPLE\tGroup\tOther\treads\nA\t\tx\tr.bed\nB\tg\ty\t/abs.bed\n"))
    assert m == [manifest.Sample("A", str(tmp_path / "r.bed"), None), manifest.Sample("B", "/abs.bed", "g")] and manifest.groups(m) == ["g"]
    with pytest.raises(manifest.ManifestError, match="FASTQ"):
        manifest.manifest_format([manifest.Sample("a", "x.fastq.gz")])
    with pytest.raises(manifest.ManifestError, match="filename sanitization"):
        manifest.check_file_names([manifest.Sample("sample a", "x"), manifest.Sample("sample/a", "y")])


def test_help():
    text = subprocess.run([sys.executable, "-m", "isomere.cli", "--help"], capture_output=True, text=True, cwd=REPO).stdout
    assert all(x in text for x in ("cluster", "recount", "diagnose-missed-tus", "rescue-missed-tus", "bam-to-bed", "gff-to-bed", "map", "run"))


def test_outputs_in_parts(spark, two_samples, tmp_path):
    for name, more in (("whole", []), ("parts", ["--parts"])):
        cli.main(["cluster", "--manifest", two_samples, "--out-dir", str(tmp_path / name), *more])
    for file in ("membership.tsv", "pooled.bed"):
        parts = sorted((tmp_path / "parts" / file).glob("part-*"))
        assert [x for p in parts for x in lines(p)] == lines(tmp_path / "whole" / file)


def test_span_histogram(spark, tmp_path):
    from isomere.streaming.folder import span_histogram

    put(tmp_path / "in/a.bed", "chr1\t1\t5\ta\t0\t+\nchr1\t2\t6\tb\t0\t+\nchr1\t20000\t20006\tc\t0\t-\n")
    q = span_histogram(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("spans").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("spans").collect())) == [("chr1", "+", 0, 2), ("chr1", "-", 2, 1)]


def test_stream(spark, tmp_path):
    from isomere.streaming.folder import watch_bed

    put(tmp_path / "in/a.bed", "chr1\t1\t5\ta\t0\t+\nchr1\t2\t6\tb\t0\t-\n")
    seen = []
    for _ in range(2):
        q = watch_bed(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
        q.awaitTermination(60)
        put(tmp_path / "in/b.bed", "chr1\t3\t7\tc\t0\t+\n")
    assert seen == [2, 3]
