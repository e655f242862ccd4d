"""Boundary modes that clustering missed, and their rescue."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..runtime import durable, ship
from .ranges import neighbours, overlap_join, ranked, sessions

PLACE = ["contig", "strand", "start", "end"]
FAMILY = ["contig", "strand", "family"]


@dataclass(frozen=True)
class MissedParams:
    window3: int = 12
    window5: int = 10
    min_family: int = 20
    min_mode: int = 20
    min_fraction: float = 0.02
    most: int = 3

    def __post_init__(self) -> None:
        if self.window3 < 0 or self.window5 < 0 or self.min_family < 1 or self.min_mode < 1 or self.most < 1 or not 0 <= self.min_fraction <= 1:
            raise ValueError("windows must not be negative, supports and the number of modes at least 1, the fraction between 0 and 1")


def families(reads: DataFrame, window: int) -> DataFrame:
    """Reads with p3, p5 and ``family``: runs of 3' ends that follow each other within the window."""
    df = reads.withColumns({"p3": iv.three_prime("strand", "start", "end"), "p5": iv.five_prime("strand", "start", "end")})
    return sessions(df, ["contig", "strand"], F.col("p3"), window, "family")


def family_modes(fam: DataFrame, minimum: int) -> DataFrame:
    """(FAMILY, family_support, c3): the most frequent 3' end, ties to the outermost."""
    n = fam.groupBy(*FAMILY, "p3").agg(F.count("*").alias("n"))
    out = n.groupBy(*FAMILY).agg(F.sum("n").alias("family_support"), F.max_by("p3", F.struct("n", iv.three_prime_priority("strand", "p3"))).alias("c3"))
    return out.filter(F.col("family_support") >= minimum)


def _peaks(counts: dict[int, int], minus: bool, window: int, most: int) -> list[tuple[int, int]]:
    """Greedy (coordinate, support) picks: most support within the window, then most frequent, then outermost; what a pick covers is gone.

    Supports come out falling, so the search ends once ``most`` are found and the next is smaller than the last of them.
    """
    left, out = dict(counts), []
    while left:
        keys = sorted(left)
        total, prefix = 0, [0]
        for k in keys:
            total += left[k]
            prefix.append(total)
        best, lo, hi = None, 0, 0
        for i, k in enumerate(keys):
            while keys[lo] < k - window:
                lo += 1
            hi = max(hi, i)
            while hi + 1 < len(keys) and keys[hi + 1] <= k + window:
                hi += 1
            mark = (prefix[hi + 1] - prefix[lo], left[k], k if minus else -k)
            if best is None or mark > best[0]:
                best = mark, k
        (support, _, _), k = best
        if len(out) >= most and support < out[most - 1][1]:
            break
        out.append((k, support))
        for x in [x for x in left if abs(x - k) <= window]:
            del left[x]
    out.sort(key=lambda x: (-x[1], -(x[0] if minus else -x[0])))
    return out[:most]


def five_prime_modes(fam: DataFrame, kept: DataFrame, p: MissedParams) -> DataFrame:
    """(FAMILY, family_support, c3, c5): up to ``most`` 5' peaks of each family, from its histogram of 5' ends."""
    ship(fam.sparkSession)
    bars = fam.join(kept, FAMILY).groupBy(*FAMILY, "family_support", "c3", "p5").agg(F.count("*").alias("n"))
    hist = bars.groupBy(*FAMILY, "family_support", "c3").agg(F.collect_list(F.struct("p5", "n")).alias("bars"))
    window, most = p.window5, p.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, c) for r in batch.to_pylist() for c, _ in _peaks({b["p5"]: b["n"] for b in r["bars"]}, r["strand"] == "-", window, most)]
            cols = {k: [r[k] for r, _ in rows] for k in ("contig", "strand", "family", "family_support", "c3")} | {"c5": [c for _, c in rows]}
            yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("contig", pa.string()), ("strand", pa.string()), *((k, pa.int64()) for k in ("family", "family_support", "c3", "c5"))]))

    return hist.mapInArrow(run, "contig string, strand string, family long, family_support long, c3 long, c5 long")


def mode_support(fam: DataFrame, modes: DataFrame, p: MissedParams) -> DataFrame:
    """(mode, read) pairs: reads of the family within both windows of a mode; a read may support two."""
    pairs = fam.select(*FAMILY, "id", "start", "end", "p3", "p5").join(modes, FAMILY)
    return pairs.filter((F.abs(F.col("p3") - F.col("c3")) <= p.window3) & (F.abs(F.col("p5") - F.col("c5")) <= p.window5))


def candidate_modes(fam: DataFrame, modes: DataFrame, p: MissedParams) -> DataFrame:
    """Modes with their interval, support and fraction that pass the thresholds."""
    n = mode_support(fam, modes, p).groupBy(*FAMILY, "family_support", "c3", "c5").agg(F.count("*").alias("mode_support"))
    n = n.withColumn("mode_fraction", F.col("mode_support") / F.col("family_support")).filter((F.col("mode_support") >= p.min_mode) & (F.col("mode_fraction") >= p.min_fraction))
    span = iv.from_boundaries("strand", "c3", "c5")
    return n.withColumn("_s", span).filter("_s is not null").withColumns({"start": F.col("_s.start"), "end": F.col("_s.end")}).drop("_s")


def nearest_units(cands: DataFrame, tus: DataFrame, p: MissedParams) -> DataFrame:
    """Candidates that no unit represents, with reason and the nearest unit (null without one).

    ``tus`` has tu_idx, its place in the file, which breaks ties.
    """
    at = ["contig", "strand"]
    t = tus.select(*at, F.col("tu_id").alias("nearest_tu_id"), "tu_idx", F.col("start").alias("nearest_start"), F.col("end").alias("nearest_end"), iv.three_prime("strand", "start", "end").alias("_t3"), iv.five_prime("strand", "start", "end").alias("_t5"))
    key = [*FAMILY, "c3", "c5"]
    gap = lambda c, p, n: F.least(F.col(c) - F.col(p), F.col(n) - F.col(c))
    near = cands.join(neighbours(cands, t, at, "c3", "_t3", "_p3", "_n3"), [*at, "c3"]).join(neighbours(cands, t, at, "c5", "_t5", "_p5", "_n5"), [*at, "c5"])
    near = near.withColumns({"_g3": gap("c3", "_p3", "_n3"), "any3": F.coalesce(gap("c3", "_p3", "_n3") <= p.window3, F.lit(False)), "any5": F.coalesce(gap("c5", "_p5", "_n5") <= p.window5, F.lit(False))})
    # units within both windows of a candidate lie in its cell or a neighbouring one
    cell = lambda c, width: F.floor(F.col(c) / (width + 1))
    around = lambda c, width: F.explode(F.sequence(cell(c, width) - 1, cell(c, width) + 1))
    spots = t.select(*at, "_t3", "_t5", cell("_t3", p.window3).alias("_a"), cell("_t5", p.window5).alias("_b")).distinct()
    cells = cands.select(*key, around("c3", p.window3).alias("_a")).select("*", around("c5", p.window5).alias("_b"))
    same = cells.join(spots, [*at, "_a", "_b"]).filter((F.abs(F.col("_t3") - F.col("c3")) <= p.window3) & (F.abs(F.col("_t5") - F.col("c5")) <= p.window5)).select(*key).distinct()
    near = near.join(same, key, "left_anti")
    # the nearest unit has the nearest 3' end, of which there are two at most
    ends = F.array_distinct(F.array_compact(F.array(F.when(F.col("c3") - F.col("_p3") == F.col("_g3"), F.col("_p3")), F.when(F.col("_n3") - F.col("c3") == F.col("_g3"), F.col("_n3")))))
    args = ("start", "end", "nearest_start", "nearest_end")
    both = near.select(*key, "start", "end", F.explode(ends).alias("_t3")).join(t, [*at, "_t3"]).withColumns({"d3": F.abs(F.col("_t3") - F.col("c3")), "d5": F.abs(F.col("_t5") - F.col("c5")), "score1": iv.score1(*args), "score2": iv.score2(*args)})
    best = F.min(F.struct("d3", "d5", (-F.col("score2")).alias("_m"), "tu_idx", "nearest_tu_id", "nearest_start", "nearest_end", "score1", "score2"))
    out = near.drop("_p3", "_n3", "_p5", "_n5", "_g3").join(both.groupBy(*key).agg(best.alias("_b")), key, "left")
    reason = (
        F.when(F.col("any3") & ~F.col("any5"), "same_3p_missing_5p_mode").when(F.col("any5") & ~F.col("any3"), "same_5p_missing_3p_mode").when(F.col("any3") & F.col("any5"), "boundary_mode_shifted").otherwise("no_matching_tu")
    )
    cols = ["nearest_tu_id", "nearest_start", "nearest_end", "d3", "d5", "score1", "score2"]
    return out.withColumns({"reason": reason, **{c: F.col(f"_b.{c}") for c in cols}}).drop("_b", "any3", "any5")


def gene_hints(cands: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds gene_hint: all overlapping genes in file order, else the nearest of the contig and strand, else a dot."""
    key = ["contig", "strand", "start", "end"]
    g = genes.select("contig", "strand", "gene_idx", "gene_id", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"))
    spots = cands.select(*key).distinct()
    over = overlap_join(spots, g, ["contig", "strand"], b_cols=("gene_start", "gene_end")).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gene_idx", "gene_id"))), lambda x: x["gene_id"]), ",").alias("_over"))
    # only candidates without a hit look further: to the genes that end nearest before them or begin nearest after them
    far = durable(spots.join(over, key, "left_anti"), "far")
    at = ["contig", "strand"]
    left = far.join(neighbours(far, g, at, "start", "gene_end", "_p", "_q").drop("_q"), [*at, "start"]).withColumnRenamed("_p", "gene_end").join(g, [*at, "gene_end"])
    right = far.join(neighbours(far, g, at, "end", "gene_start", "_q", "_p").drop("_q"), [*at, "end"]).withColumnRenamed("_p", "gene_start").join(g, [*at, "gene_start"])
    # empty intervals overlap nothing, but may lie within the other or at its place
    wide = lambda df, a, b: df.withColumns({"_s": F.col(a), "_e": F.greatest(F.col(b), F.col(a) + 1)})
    empty = overlap_join(wide(far, "start", "end"), wide(g, "gene_start", "gene_end").withColumnsRenamed({"_s": "_gs", "_e": "_ge"}), at, a_cols=("_s", "_e"), b_cols=("_gs", "_ge")).filter("start = end or gene_start = gene_end")
    cols = [*key, "gene_idx", "gene_id", "gene_start", "gene_end"]
    found = left.select(*cols).union(right.select(*cols)).union(empty.select(*cols))
    far = found.groupBy(*key).agg(F.min(F.struct(iv.distance("start", "end", "gene_start", "gene_end").alias("d"), "gene_idx", "gene_id")).alias("_far"))
    return cands.join(over, key, "left").join(far, key, "left").withColumn("gene_hint", F.coalesce("_over", "_far.gene_id", F.lit("."))).drop("_over", "_far")


def diagnose(reads: DataFrame, tus: DataFrame, genes: DataFrame | None, p: MissedParams = MissedParams()) -> DataFrame:
    """The candidates report, numbered MISS0001 and on by position."""
    cands, n = ranked(durable(detect(reads, tus, genes, p)[1], "candidates"), [*PLACE, F.col("mode_support").desc()], "_rank")
    return cands.withColumn("candidate_id", iv.padded_id("MISS", "_rank", n, 4)).drop("_rank")


def detect(reads: DataFrame, tus: DataFrame, genes: DataFrame | None, p: MissedParams) -> tuple[DataFrame, DataFrame]:
    """(reads with families, candidates with nearest unit, reason and hint)."""
    fam = durable(families(reads, p.window3), "families")
    modes = five_prime_modes(fam, family_modes(fam, p.min_family), p)
    cands = nearest_units(candidate_modes(fam, modes, p), tus, p)
    return fam, gene_hints(cands, genes) if genes is not None else cands.withColumn("gene_hint", F.lit("."))


def without_neighbours(cands: DataFrame, p: MissedParams) -> DataFrame:
    """Per contig and strand, best first: drops candidates within both windows of a kept one; adds cand_idx by position.

    Only candidates whose 3' ends follow each other within the window can drop
    one another, so each such chain is settled by itself.
    """
    ship(cands.sparkSession)
    w3, w5 = p.window3, p.window5
    names = cands.columns

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (-rows[i]["mode_support"], -rows[i]["mode_fraction"], rows[i]["start"], rows[i]["end"]))
        kept: list[int] = []
        grid: dict[tuple[int, int], list[int]] = {}
        for i in order:
            a, b = rows[i]["c3"], rows[i]["c5"]
            x, y = a // (w3 + 1), b // (w5 + 1)
            near = (k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((x + dx, y + dy), ()))
            if not any(abs(rows[k]["c3"] - a) <= w3 and abs(rows[k]["c5"] - b) <= w5 for k in near):
                kept.append(i)
                grid.setdefault((x, y), []).append(i)
        return group.take(pa.array(sorted(kept), pa.int64())).select(names)

    chained = sessions(cands, ["contig", "strand"], F.col("c3"), w3, "_chain")
    out = durable(chained.groupBy("contig", "strand", "_chain").applyInArrow(run, cands.schema), "apart")
    return ranked(out, [*PLACE, F.col("mode_support").desc()], "cand_idx")[0]


def rescue(reads: DataFrame, tus: DataFrame, membership: DataFrame, genes: DataFrame | None, p: MissedParams = MissedParams(), prefix: str = "RESC") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, membership, candidates) after reads moved to the candidates they fit better.

    A read goes to its best candidate if it has no unit, or if the candidate's
    ends are not farther than its unit's; candidates need ``min_mode`` reads
    before and after that test. A read whose candidate fails keeps its unit.
    Of rows with equal read ids the last one has the unit of the membership.
    """
    fam, found = detect(reads, tus, genes, p)
    cands = durable(without_neighbours(durable(found, "found"), p), "rescue-candidates")
    c = cands.select(*FAMILY, "family_support", "c3", "c5", F.col("start").alias("cand_start"), F.col("end").alias("cand_end"), "cand_idx", F.col("mode_support").alias("_support"))
    fits = mode_support(fam, c, p).withColumns({"d3": F.abs(F.col("p3") - F.col("c3")), "d5": F.abs(F.col("p5") - F.col("c5"))})
    best = fits.groupBy("contig", "strand", "start", "end", "id").agg(F.min(F.struct("d3", "d5", (-F.col("_support")).alias("_m"), "cand_idx", "cand_start", "cand_end")).alias("b")).select(*PLACE, "id", "b.d3", "b.d5", "b.cand_idx", "b.cand_start", "b.cand_end")
    gate1 = best.groupBy("cand_idx").agg(F.count("*").alias("n")).filter(F.col("n") >= p.min_mode).select("cand_idx")
    units = tus.select("tu_id", F.col("contig").alias("_tc"), F.col("strand").alias("_ts"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    now = membership.select("id", "tu_id").join(units, "tu_id", "left")
    u3 = F.abs(iv.three_prime("strand", "_s", "_e") - iv.three_prime("strand", "start", "end"))
    u5 = F.abs(iv.five_prime("strand", "_s", "_e") - iv.five_prime("strand", "start", "end"))
    tested = best.join(gate1, "cand_idx").join(now, "id", "left").withColumns({"u3": u3, "u5": u5})
    use = tested.filter(F.col("u3").isNull() | (F.struct("d3", "d5") <= F.struct(F.col("u3").alias("d3"), F.col("u5").alias("d5"))))
    gate2 = use.groupBy("cand_idx").agg(F.count("*").alias("n")).filter(F.col("n") >= p.min_mode).select("cand_idx")
    kept = durable(cands.join(gate2, "cand_idx"), "rescued")
    kept, total = ranked(kept, ["cand_idx"], "_rank")
    kept = kept.withColumn("rescue_id", iv.padded_id(prefix, "_rank", total, 4)).drop("_rank")
    moved = use.join(kept.select("cand_idx", "rescue_id"), "cand_idx").select("id", *PLACE, F.col("rescue_id").alias("new_id"), "cand_start", "cand_end")
    everyone = reads.select("id", *PLACE).join(moved, ["id", *PLACE], "left").join(now.drop("_tc", "_ts"), "id", "left")
    final = everyone.withColumns({"tu_id": F.coalesce("new_id", "tu_id"), "_us": F.coalesce("cand_start", "_s"), "_ue": F.coalesce("cand_end", "_e")}).filter("tu_id is not null")
    args = ("start", "end", "_us", "_ue")
    final = durable(final.select("id", *PLACE, "tu_id", iv.score1(*args).alias("score1"), iv.score2(*args).alias("score2")), "rescue-membership")
    pool = tus.select("tu_id", *PLACE).unionByName(kept.select(F.col("rescue_id").alias("tu_id"), *PLACE))
    out = pool.join(final.groupBy("tu_id").agg(F.count("*").alias("n_reads")), "tu_id")
    return out, final, kept
