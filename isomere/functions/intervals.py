"""Column expressions on half-open intervals [start, end) with long coordinates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def length(s, e) -> Column:
    return _c(e) - _c(s)


def is_empty(s, e) -> Column:
    return _c(s) == _c(e)


def overlap_len(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def overlaps(s1, e1, s2, e2) -> Column:
    """True if a position is shared; touching or empty intervals share none."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    return (s1 < e2) & (s2 < e1) & (s1 < e1) & (s2 < e2)


def intersection(s1, e1, s2, e2) -> Column:
    """Struct of the shared stretch, or null."""
    s, e = F.greatest(_c(s1), _c(s2)), F.least(_c(e1), _c(e2))
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


def score1(s1, e1, s2, e2) -> Column:
    """Shared positions over covered positions; 0 if nothing is covered."""
    o = overlap_len(s1, e1, s2, e2)
    union = length(s1, e1) + length(s2, e2) - o
    return F.when(union == 0, F.lit(0.0)).otherwise(o / F.nullif(union, F.lit(0)))


def score2(s1, e1, s2, e2) -> Column:
    """Shared positions over the longer length; 0 if both are empty."""
    most = F.greatest(length(s1, e1), length(s2, e2))
    return F.when(most == 0, F.lit(0.0)).otherwise(overlap_len(s1, e1, s2, e2) / F.nullif(most, F.lit(0)))


def distance(s1, e1, s2, e2) -> Column:
    """Gap between two intervals; 0 if they overlap or touch."""
    return F.greatest(F.lit(0).cast("long"), _c(s2) - _c(e1), _c(s1) - _c(e2))


def three_prime(strand, s, e) -> Column:
    return F.when(_c(strand) == "-", _c(s)).otherwise(_c(e))


def five_prime(strand, s, e) -> Column:
    return F.when(_c(strand) == "-", _c(e)).otherwise(_c(s))


def three_prime_priority(strand, coord) -> Column:
    """Among equally good 3' coordinates the outermost is preferred."""
    return F.when(_c(strand) == "-", -_c(coord)).otherwise(_c(coord))


def five_prime_priority(strand, coord) -> Column:
    return F.when(_c(strand) == "-", _c(coord)).otherwise(-_c(coord))


def from_boundaries(strand, three, five) -> Column:
    """Struct (start, end) between a 3' and a 5' coordinate; null if inverted."""
    s = F.when(_c(strand) == "-", _c(three)).otherwise(_c(five))
    e = F.when(_c(strand) == "-", _c(five)).otherwise(_c(three))
    return F.when(s <= e, F.struct(s.alias("start"), e.alias("end")))


def within_three_prime(strand, child_s, child_e, cand_s, cand_e, tolerance: int) -> Column:
    """The candidate reaches the child's 3' end, up to the tolerance."""
    return F.when(_c(strand) == "-", _c(cand_s) <= _c(child_s) + tolerance).otherwise(_c(cand_e) + tolerance >= _c(child_e))


def five_prime_delta(strand, child_s, child_e, cand_s, cand_e) -> Column:
    """How far the child's 5' end lies inside the candidate, at least 0."""
    return F.greatest(F.lit(0).cast("long"), F.when(_c(strand) == "-", _c(cand_e) - _c(child_e)).otherwise(_c(child_s) - _c(cand_s)))


def strand_key(strand, match: bool) -> Column:
    return _c(strand) if match else F.lit(None).cast("string")


# lists of intervals: arrays of struct<start, end>


def total_len(xs) -> Column:
    return F.aggregate(_c(xs), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def list_intersection_len(xs, ys) -> Column:
    """Shared length of two sorted lists, each without overlaps of its own."""
    return F.aggregate(_c(xs), F.lit(0).cast("long"), lambda a, x: a + F.aggregate(_c(ys), F.lit(0).cast("long"), lambda b, y: b + overlap_len(x["start"], x["end"], y["start"], y["end"])))


def list_union_len(xs, ys) -> Column:
    return total_len(xs) + total_len(ys) - list_intersection_len(xs, ys)


def list_score1(xs, ys) -> Column:
    u = list_union_len(xs, ys)
    return F.when(u == 0, F.lit(0.0)).otherwise(list_intersection_len(xs, ys) / F.nullif(u, F.lit(0)))


def list_score2(xs, ys) -> Column:
    m = F.greatest(total_len(xs), total_len(ys))
    return F.when(m == 0, F.lit(0.0)).otherwise(list_intersection_len(xs, ys) / F.nullif(m, F.lit(0)))


def exonic_overlap(xs, ys) -> Column:
    """Shared length of two exon lists by a walk that leaves behind the exon ending first (the left one on ties), as one pass over both sorted lists."""
    # state: place in each list and the sum; one step for each exon of both lists
    steps = F.sequence(F.lit(1), F.size(_c(xs)) + F.size(_c(ys)))
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, _: Column) -> Column:
        x, y = F.try_element_at(_c(xs), a["i"]), F.try_element_at(_c(ys), a["j"])
        more = (a["i"] <= F.size(_c(xs))) & (a["j"] <= F.size(_c(ys)))
        left = x["end"] <= y["end"]
        return F.struct(
            F.when(more & left, a["i"] + 1).otherwise(a["i"]).alias("i"), F.when(more & ~left, a["j"] + 1).otherwise(a["j"]).alias("j"),
            F.when(more, a["sum"] + overlap_len(x["start"], x["end"], y["start"], y["end"])).otherwise(a["sum"]).alias("sum"),
        )

    return F.when((F.size(_c(xs)) == 0) | (F.size(_c(ys)) == 0), F.lit(0).cast("long")).otherwise(F.aggregate(steps, start, step)["sum"])


def introns(exons) -> Column:
    """Gaps between consecutive sorted exons; touching exons have none between them."""
    x = _c(exons)
    n = F.greatest(F.size(x) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    return F.filter(gaps, lambda g: g["start"] < g["end"])


def junctions_equal(chrom1, strand1, exons1, chrom2, strand2, exons2) -> Column:
    return (_c(chrom1) == _c(chrom2)) & (_c(strand1) == _c(strand2)) & (introns(exons1) == introns(exons2))


def junctions_subset(exons1, exons2) -> Column:
    """Every intron of the first is one of the second; chromosome and strand are not looked at."""
    return F.size(F.array_except(introns(exons1), introns(exons2))) == 0


def padded_id(prefix: str, number, count: int, least: int) -> Column:
    """prefix + zero-padded number; wide enough for ``count``, never cut."""
    return F.format_string(f"{prefix}%0{max(least, len(str(count)))}d", _c(number))


def pooled_id(sample, read) -> Column:
    return F.concat(_c(sample), F.lit("::"), _c(read))


def pooled_sample(pooled) -> Column:
    """The sample of a pooled id: all before the first ``::``."""
    return F.substring_index(_c(pooled), "::", 1)
