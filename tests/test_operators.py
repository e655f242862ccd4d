import random

import pytest
from pyspark.sql import functions as F

from isomere.functions import intervals as iv
from isomere.operators import annotate, counts, missed, ranges
from isomere.sources import bed, gff

# Where tests name inputs and results literally, they are golden values of the definitions.
PLACE = "contig string, strand string, start long, end long"


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first())


def test_scalars(spark):
    assert one(spark, iv.overlaps(0, 1, 1, 2), iv.overlaps(0, 2, 1, 2), iv.overlaps(5, 5, 5, 6), iv.overlaps(5, 5, 4, 6)) == (False, True, False, False)
    assert one(spark, iv.score1(0, 10, 2, 8), iv.score2(0, 10, 2, 8), iv.score1(5, 5, 5, 5), iv.score1(0, 2, 5, 9)) == (0.6, 0.6, 0.0, 0.0)
    assert one(spark, iv.distance(0, 5, 5, 9), iv.distance(0, 5, 8, 9), iv.distance(8, 9, 0, 5)) == (0, 3, 3)
    assert one(spark, iv.padded_id("TU", F.lit(1234567), 1234567, 6), iv.padded_id("TU", F.lit(3), 9, 6)) == ("TU1234567", "TU000003")
    assert one(spark, iv.pooled_sample(F.lit("s::r::1"))) == ("s",)


def spans(*xs):
    return F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in xs))


def test_lists(spark):
    a, b, c = spans((0, 10)), spans((10, 20)), spans((5, 15))
    assert one(spark, iv.list_intersection_len(a, b), iv.list_union_len(a, b), iv.list_intersection_len(a, c), iv.list_union_len(a, c)) == (0, 20, 5, 15)
    assert one(spark, iv.exonic_overlap(spans((0, 10), (20, 30)), spans((5, 25))), iv.exonic_overlap(spans((0, 10), (2, 4)), spans((0, 3), (3, 9)))) == (10, 9)
    assert [tuple(x) for x in one(spark, iv.introns(spans((100, 150), (170, 200))))[0]] == [(150, 170)]
    assert one(spark, iv.introns(spans((1, 2)))) == ([],)
    long, short = spans((0, 10), (20, 30), (40, 50)), spans((0, 10), (20, 30))
    assert one(spark, iv.junctions_subset(short, long), iv.junctions_subset(long, short), iv.junctions_equal(F.lit("c"), F.lit("+"), short, F.lit("c"), F.lit("+"), long)) == (True, False, False)


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_equals_loop(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice(["c1", "c2"]), (s := rng.randint(0, 200)), s + rng.randint(0, 50), k) for k in range(n)]
    a, b = make(60), make(60)
    low = rng.choice([1, 7, 25])
    fa = spark.createDataFrame(a, "contig string, start long, end long, ka long")
    fb = spark.createDataFrame(b, "contig string, b_start long, b_end long, kb long")
    got = sorted((r.ka, r.kb, r.overlap_bp) for r in ranges.overlap_join(fa, fb, ["contig"], low, width=16).collect())
    want = sorted((x[3], y[3], o) for x in a for y in b if x[0] == y[0] and (o := min(x[2], y[2]) - max(x[1], y[1])) >= low)
    assert got == want


def test_span_clusters(spark):
    df = spark.createDataFrame([("c", "+", 10, 20, "a"), ("c", "+", 15, 25, "b"), ("c", "+", 30, 40, "c"), ("d", "+", 1, 9, "d"), ("d", "-", 2, 9, "e"), ("d", "+", 3, 9, "f"), ("e", "+", 1, 5, "g"), ("e", "+", 5, 9, "h")], PLACE + ", id string")
    sizes = lambda m: sorted((r.contig, r.members) for r in ranges.span_clusters(df, m).collect())
    assert sizes(False) == [("c", 1), ("c", 2), ("d", 3), ("e", 1), ("e", 1)]
    assert sizes(True) == [("c", 1), ("c", 2), ("d", 1), ("d", 1), ("d", 1), ("e", 1), ("e", 1)]


def test_fractional_counts(spark):
    df = spark.createDataFrame([("a", "r1,r2,|0"), ("b", "r2,|0"), ("c", ",|0")], "isoform_id string, subreads string")
    none = spark.createDataFrame([], "name string")
    assert {r.isoform_id: r["count"] for r in counts.fractional_counts(df, none).collect()} == {"a": 1.5, "b": 0.5, "c": 0.0}
    assert {r.isoform_id: r["count"] for r in counts.fractional_counts(df, spark.createDataFrame([("r1",)], "name string")).collect()} == {"a": 0.5, "b": 0.5, "c": 0.0}


def test_unknown_samples_are_an_error(spark):
    rows = spark.createDataFrame([("A::r", "TU1"), ("Z::r", "TU1")], "id string, tu_id string")
    with pytest.raises(ValueError, match="Z"):
        counts.recount(rows, spark.createDataFrame([("A",)], "sample string"))
    with pytest.raises(ValueError):
        counts.pooled({"a::b": rows})


def test_bed_lines(spark):
    lines = ["chr1\t1\t5\ta\tx\t+\te1\te2", "  # no", "", "chr1 2 6 b 7 -", "\tchr2\t3\t3\tc\t99999999999\t.\t"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(tuple(r)[:6] + (list(r.extra),) for r in bed.parse_bed6(df).collect())
    assert got == [("chr1", 1, 5, "a", 0, "+", ["e1", "e2"]), ("chr1", 2, 6, "b", 7, "-", []), ("chr2", 3, 3, "c", 0, ".", [])]
    for bad in ("chr1\t5\t1\ta\t0\t+", "chr1\t-1\t5\ta\t0\t+", "chr1\t1\t5\ta\t0\tx", "chr1\t1\t5", "track name=x", "chr1\t1\t4294967296\ta\t0\t+"):
        with pytest.raises(Exception, match="invalid|few|after"):
            bed.parse_bed6(spark.createDataFrame([(bad,)], "value string")).collect()


def test_bed12_lines(spark):
    ok = "c\t100\t200\tt\t0\t+\t100\t200\t0\t2\t50,40,\t0,70,"
    r = bed.parse_bed12(spark.createDataFrame([(ok,)], "value string")).first()
    assert [tuple(x) for x in r.exons] == [(100, 150), (170, 200)]
    for bad in (ok.replace("\t2\t", "\t3\t"), ok.replace("0,70,", "0,170,")):
        with pytest.raises(Exception, match="bad blocks"):
            bed.parse_bed12(spark.createDataFrame([(bad,)], "value string")).collect()


def test_gff_genes(spark):
    lines = ["##gff", "chr1\ts\tgene\t11\t50\t.\t+\t.\tID=x;Name=geneA", "chr1\ts\tCDS\t11\t50\t.\t+\t.\tID=y", "chr1\ts\tgene\t61\t100\t.\t-\t.\tID=z;locus_tag=b0002", "chr2\ts\tgene\t5\t20\t.\t+\t.\tID=id3", "chr2\ts\tgene\t5\t20\t.\t+\t.\tnote=1", "chr2\tshort\tgene"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = [tuple(r)[1:6] for r in gff.parse_gff3(df).orderBy("gene_idx").collect()]
    assert got == [("chr1", "+", 10, 50, "geneA"), ("chr1", "-", 60, 100, "b0002"), ("chr2", "+", 4, 20, "id3"), ("chr2", "+", 4, 20, "gene_4")]


def test_formats():
    assert [bed.infer_format(x) for x in ("A.FQ.GZ", "b.bed12", "c.BED", "d.txt", "e")] == ["fastq", "bed12", "bed6", "tsv", "bed6"]
    with pytest.raises(ValueError, match="not supported directly"):
        bed.read_reads(None, "x.fastq")


def missed_input(spark, strand="+"):
    spans = [(100, 210), (102, 210), (104, 210), (150, 210), (151, 210)]
    if strand == "-":
        spans = [(1000 - b, 1000 - a) for a, b in spans]
    reads = spark.createDataFrame([("chr1", strand, a, b, f"r{k}") for k, (a, b) in enumerate(spans, 1)], PLACE + ", id string")
    unit, gene = ((150, 210), (105, 205)) if strand == "+" else ((790, 850), (795, 895))
    tus = spark.createDataFrame([(1, "TU000001", "chr1", strand, *unit)], "tu_idx long, tu_id string, " + PLACE)
    genes = spark.createDataFrame([(1, "geneA", "chr1", strand, *gene)], "gene_idx long, gene_id string, " + PLACE)
    return reads, tus, genes


SMALL = missed.MissedParams(min_family=2, min_mode=2, min_fraction=0.2)


@pytest.mark.parametrize("strand", ["+", "-"])
def test_diagnose(spark, strand):
    reads, tus, genes = missed_input(spark, strand)
    (r,) = missed.diagnose(reads, tus, genes, SMALL).collect()
    place = (100, 210) if strand == "+" else (790, 900)
    assert (r.candidate_id, r.start, r.end) == ("MISS0001", *place)
    assert (r.family_support, r.mode_support, r.mode_fraction, r.reason) == (5, 3, 0.6, "same_3p_missing_5p_mode")
    assert (r.nearest_tu_id, r.d3, r.d5, round(r.score1, 6), r.gene_hint) == ("TU000001", 0, 50, 0.545455, "geneA")


def test_rescue(spark):
    reads, tus, genes = missed_input(spark)
    known = reads.select("id", F.lit("TU000001").alias("tu_id"))
    units, members, cands = missed.rescue(reads, tus, known, genes, SMALL)
    assert sorted((r.tu_id, r.start, r.end, r.n_reads) for r in units.collect()) == [("RESC0001", 100, 210, 3), ("TU000001", 150, 210, 2)]
    got = {r.id: (r.tu_id, round(r.score1, 6)) for r in members.collect()}
    assert got == {"r1": ("RESC0001", 1.0), "r2": ("RESC0001", 0.981818), "r3": ("RESC0001", 0.963636), "r4": ("TU000001", 1.0), "r5": ("TU000001", 0.983333)}
    assert cands.count() == 1
    # without members, everyone that fits goes and the rest vanishes
    _, alone, _ = missed.rescue(reads, tus, known.limit(0), genes, SMALL)
    assert {r.id for r in alone.collect()} == {"r1", "r2", "r3"}


def test_hints_fall_back_to_the_nearest_gene(spark):
    c = spark.createDataFrame([("c", "+", 10, 20), ("c", "-", 10, 20), ("d", "+", 1, 2)], PLACE)
    g = spark.createDataFrame([(2, "late", "c", "+", 30, 40), (1, "early", "c", "+", 0, 1), (3, "b", "c", "-", 12, 15), (4, "a", "c", "-", 11, 30)], "gene_idx long, gene_id string, " + PLACE)
    assert {(r.contig, r.strand): r.gene_hint for r in missed.gene_hints(c, g).collect()} == {("c", "+"): "early", ("c", "-"): "b,a", ("d", "+"): "."}


def test_neighbours_go(spark):
    rng = random.Random(8)
    rows = [("c", s, f, 50, (a := rng.randint(0, 60)), (b := rng.randint(100, 160)), rng.randint(5, 9), 0.5, min(a, b), max(a, b)) for f, s in enumerate("+-" * 25)]
    df = spark.createDataFrame(rows, "contig string, strand string, family long, family_support long, c3 long, c5 long, mode_support long, mode_fraction double, start long, end long")
    got = {(r.strand, r.c3, r.c5, r.mode_support) for r in missed.without_neighbours(df, missed.MissedParams()).collect()}
    want = set()
    for s in "+-":
        kept = []
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[6], -r[7], r[8], r[9])):
            if not any(abs(k[4] - r[4]) <= 12 and abs(k[5] - r[5]) <= 10 for k in kept):
                kept.append(r)
        want |= {(s, r[4], r[5], r[6]) for r in kept}
    assert got == want


def test_blocks(spark):
    tus = spark.createDataFrame([("TU000001", "chr1", "+", 100, 200), ("TU000002", "chr1", "+", 300, 400), ("TU000003", "chr2", "+", 1, 9)], "tu_id string, " + PLACE)
    genes = spark.createDataFrame([(1, "geneA", "chr1", "+", 90, 150), (2, "geneB", "chr1", "+", 160, 220), (3, "geneC", "chr1", "+", 290, 310)], "gene_idx long, gene_id string, " + PLACE)
    members = spark.createDataFrame([("r1", "chr1", "+", 100, 200, "TU000001"), ("r2", "chr1", "+", 101, 201, "TU000001"), ("r3", "chr1", "+", 300, 400, "TU000002")], "id string, " + PLACE + ", tu_id string")
    got = {r.tu_id: (r.block_count, r.block_sizes, r.block_starts, r.name2, r.gene_list) for r in annotate.anchored_blocks(tus, genes, members).collect()}
    assert got == {"TU000001": (2, "50,40,", "0,60,", "r1,r2,|2", "geneA,geneB"), "TU000002": (1, "10,", "0,", "r3,|1", "geneC"), "TU000003": (1, "8,", "0,", ",|0", ".")}


def test_transcripts(spark, tmp_path):
    from isomere.operators import transcripts
    from isomere.sources import writers

    t = spark.createDataFrame([("c", "+", 10, 20, "b"), ("c", "-", 12, 22, "a"), ("c", "+", 10, 15, "z")], "chrom string, strand string, tx_start long, tx_end long, name string")
    assert transcripts.representative(t, ["chrom"]).first().name == "a"
    assert [r.name for r in transcripts.in_order(t).collect()] == ["z", "b", "a"]
    assert sorted(tuple(r) for r in transcripts.intersect_pairs(t, t, True, 5).collect()) == [("a", "a", 10), ("b", "b", 10), ("b", "z", 5), ("z", "b", 5), ("z", "z", 5)]
    writers.write_counts(str(tmp_path / "c.csv"), spark.createDataFrame([("x", 1.5), ("y", 2.0)], "isoform_id string, count double"))
    assert (tmp_path / "c.csv").read_text() == "isoform_id,count\nx,1.5\ny,2\n"
    line = "c\t100\t200\tt\t0\t+\t100\t200\t0\t2\t50,30,\t0,70,\tmore"
    writers.write_transcripts(str(tmp_path / "t.bed"), bed.parse_bed12(spark.createDataFrame([(line,)], "value string")))
    assert (tmp_path / "t.bed").read_text() == line + "\n"


def islands_by_hand(rows):
    """The number of the chain of each (key, start, end), in order."""
    out, last = {}, {}
    for key, start, end in sorted(rows):
        n, top = last.get(key, (0, None))
        if top is None or start >= top:
            n, top = n + 1, end
        last[key] = n, max(top, end)
        out[key, start, end] = n
    return out


def test_islands_sessions_and_neighbours_across_bins(spark, monkeypatch):
    rng = random.Random(1)
    for width in (7, 50, 1 << 16):
        monkeypatch.setattr(ranges, "SPAN", width)
        rows = {(rng.choice("ab"), s := rng.randint(0, 900), s + rng.choice([1, 3, 10, 120])) for _ in range(150)}
        df = spark.createDataFrame(sorted(rows), "k string, start long, end long")
        assert {(r.k, r.start, r.end): r.island for r in ranges.islands(df, ["k"]).collect()} == islands_by_hand(rows)
        want, last = {}, {}
        for k, x in sorted({(k, x) for k, x, _ in rows}):
            n, before = last.get(k, (0, None))
            want[k, x] = n + (before is None or x - before > 9)
            last[k] = want[k, x], x
        assert {(r.k, r.start): r.run for r in ranges.sessions(df, ["k"], F.col("start"), 9, "run").collect()} == want
        marks = spark.createDataFrame([("a", m) for m in (5, 77, 400, 401)], "k string, mark long")
        got = {(r.k, r.start): (r.p, r.n) for r in ranges.neighbours(df, marks, ["k"], "start", "mark", "p", "n").collect()}
        assert got == {(k, x): (max((m for m in (5, 77, 400, 401) if m <= x), default=None), min((m for m in (5, 77, 400, 401) if m >= x), default=None)) if k == "a" else (None, None) for k, x, _ in rows}


def test_ranks_in_one_task_and_by_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 101, str(k)) for k in range(500)], "x long, y string")
    for limit in (10, 1000):
        got, n = ranges.ranked(df, [F.col("x").desc(), "y"], "place", limit)
        rows = sorted(got.collect(), key=lambda r: r.place)
        assert n == 500 and [r.place for r in rows] == list(range(1, 501))
        assert [(r.x, r.y) for r in rows] == sorted(((r.x, r.y) for r in rows), key=lambda t: (-t[0], t[1]))


def test_nearest_units_and_hints_by_brute_force(spark):
    rng = random.Random(4)
    p = missed.MissedParams()
    span = lambda n: [(rng.choice(["c1", "c2"]), rng.choice("+-"), s := rng.randint(0, 3000), s + rng.randint(0, 400)) for _ in range(n)]
    three = lambda r: r[2] if r[1] == "-" else r[3]
    five = lambda r: r[3] if r[1] == "-" else r[2]
    cands, tus, genes = span(60), [x for x in span(90) if x[0] == "c1" or x[1] == "+"], [x for x in span(25) if x[0] == "c1"] + [("c1", "+", 50, 50), ("c1", "-", 900, 900)]
    c = spark.createDataFrame([(i, *x, three(x), five(x), 5) for i, x in enumerate(cands)], "family long, contig string, strand string, start long, end long, c3 long, c5 long, mode_support long")
    t = spark.createDataFrame([(*x, f"t{i}", i) for i, x in enumerate(tus)], "contig string, strand string, start long, end long, tu_id string, tu_idx long")
    got = {r.family: r for r in missed.nearest_units(c, t, p).collect()}
    score2 = lambda a, b: max(0, min(a[3], b[3]) - max(a[2], b[2])) / max(a[3] - a[2], b[3] - b[2], 1)
    for i, x in enumerate(cands):
        own = [(abs(three(u) - three(x)), abs(five(u) - five(x)), -score2(x, u), k) for k, u in enumerate(tus) if u[:2] == x[:2]]
        if any(a <= p.window3 and b <= p.window5 for a, b, _, _ in own):
            assert i not in got
            continue
        any3, any5 = any(a <= p.window3 for a, *_ in own), any(b <= p.window5 for _, b, *_ in own)
        assert got[i].reason == ("boundary_mode_shifted" if any3 and any5 else "same_3p_missing_5p_mode" if any3 else "same_5p_missing_3p_mode" if any5 else "no_matching_tu")
        assert got[i].nearest_tu_id == (f"t{min(own)[3]}" if own else None) and got[i].d3 == (min(own)[0] if own else None)
    g = spark.createDataFrame([(*x, i, f"g{i}") for i, x in enumerate(genes)], "contig string, strand string, start long, end long, gene_idx long, gene_id string")
    hints = {r.family: r.gene_hint for r in missed.gene_hints(c, g).collect()}
    for i, x in enumerate(cands):
        own = [(k, y) for k, y in enumerate(genes) if y[:2] == x[:2]]
        over = [f"g{k}" for k, y in own if min(x[3], y[3]) - max(x[2], y[2]) > 0]
        far = min(((max(0, y[2] - x[3], x[2] - y[3]), k) for k, y in own), default=None)
        assert hints[i] == (",".join(over) or (f"g{far[1]}" if far else "."))
