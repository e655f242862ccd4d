"""Range joins, islands and merged intervals as equi-joins and windows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import overlap_len
from ..runtime import durable, small

#: Positions in a bin of the overlap join; in a bin that is sorted as one; rows that one task may number or that are broadcast.
BIN, SPAN, SMALL = 4096, 1 << 16, 200_000
#: What is summed along positions: rows begun, rows ended, starts less ends.
SUMS = ("_begun", "_ended", "_sum")


def _binned(df: DataFrame, start: str, end: str, width: int, out: str) -> DataFrame:
    return df.filter(F.col(start) < F.col(end)).withColumn(out, F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"({end} - 1) div {width}"))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], min_bp: int = 1, width: int = BIN, a_cols: tuple[str, str] = ("start", "end"), b_cols: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs of rows with equal ``keys`` that share at least ``min_bp`` positions; adds ``overlap_bp``.

    Both sides are dealt to fixed bins and joined on keys and bin, so the plan
    is an equi-join at any size; a pair is kept in the bin of the later start
    only, which drops repeats without a shuffle. The columns of the two sides
    must differ but for the keys.
    """
    s1, e1 = a_cols
    s2, e2 = b_cols
    pairs = _binned(a, s1, e1, width, "_bin").join(_binned(b, s2, e2, width, "_bin"), [*keys, "_bin"])
    bp = overlap_len(s1, e1, s2, e2)
    return pairs.filter((bp >= max(1, min_bp)) & (F.col("_bin") == F.expr(f"greatest({s1}, {s2}) div {width}"))).withColumn("overlap_bp", bp).drop("_bin")


def _over_bins(rows: DataFrame, keys: list[str], later: bool = False, **values: tuple[Column, Callable]) -> DataFrame:
    """(keys, _bin) with each value, an aggregate of a bin, folded over the earlier bins of the same keys (or the later ones)."""
    bins = rows.groupBy(*keys, "_bin").agg(*(v.alias(c) for c, (v, _) in values.items()))
    w = Window.partitionBy(*keys).orderBy("_bin")
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    return bins.select(*keys, "_bin", *(fold(c).over(w).alias(c) for c, (_, fold) in values.items()))


def _place(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("_bin", F.expr(f"`{at}` div {SPAN}"))


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", out: str = "island") -> DataFrame:
    """Numbers maximal groups of rows whose intervals overlap in a chain, within ``keys``; touching does not chain.

    Rows are dealt to bins of ``SPAN`` positions by their start and sorted within
    them; only the end reached so far and the number of groups go from bin to
    bin, so no task sorts a whole contig.
    """
    w = Window.partitionBy(*keys, "_bin").orderBy(start, end)
    rows = _place(df, start)
    rows = rows.join(_over_bins(rows, keys, _reach=(F.max(end), F.max)), [*keys, "_bin"])
    top = F.greatest("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(top.isNull() | (F.col(start) >= top), 1).otherwise(0))
    rows = rows.withColumn(out, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(_over_bins(rows, keys, _earlier=(F.sum("_new"), F.sum)), [*keys, "_bin"])
    return rows.withColumn(out, F.col(out) + F.coalesce("_earlier", F.lit(0))).drop("_bin", "_reach", "_new", "_earlier")


def overlap_counts(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], min_bp: int = 1, a_cols: tuple[str, str] = ("start", "end"), b_cols: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """``overlap_join`` counted by ``by``, columns of ``b``: ``n`` pairs that share ``overlap_bp`` positions in all; no pair is made.

    All ends move down by ``min_bp`` - 1, so pairs of the rows still not empty
    that share a position are the pairs wanted, each with as much less overlap.
    The rows of ``a`` that meet [s, e) are those begun before e less those ended
    by s; the positions of ``a`` before x are x times the rows open there, plus
    the ends of those closed, less the starts of all. So a row of ``b`` is read
    off running sums at its first and last position. The sums are taken over
    the different ends and positions, in bins of ``SPAN``.
    """
    cut = max(1, min_bp) - 1

    def ends(df, s, e, at, *more):
        df = df.withColumns({"_s": F.col(s).cast("long"), "_e": F.col(e).cast("long") - cut}).filter("_s < _e")
        return df.select(*keys, *(c for c in more if c not in keys), F.inline(F.array(*at)))

    row = lambda x, begun, ended, sum_: F.struct(F.expr(x).alias("_x"), F.lit(begun).alias("_begun"), F.lit(ended).alias("_ended"), F.expr(sum_).alias("_sum"))
    marks = ends(b, *b_cols, [F.struct(F.col("_s").alias("_x"), F.lit(False).alias("_last")), F.struct((F.col("_e") - 1).alias("_x"), F.lit(True).alias("_last"))], *by)
    spots = ends(a, *a_cols, [row("_s", 1, 0, "_s"), row("_e", 0, 1, "-_e")]).union(marks.select(*keys, "_x", *(F.lit(0).alias(c) for c in SUMS)))
    spots = _place(durable(spots.groupBy(*keys, "_x").agg(*(F.sum(c).alias(c) for c in SUMS)), "spots"), "_x")
    w = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = spots.select(*keys, "_bin", "_x", *(F.sum(c).over(w).alias(c) for c in SUMS))
    at = at.join(_over_bins(spots, keys, **{f"{c}_earlier": (F.sum(c), F.sum) for c in SUMS}), [*keys, "_bin"])
    at = durable(at.select(*keys, "_x", *(F.expr(f"{c} + coalesce({c}_earlier, 0)").alias(c) for c in SUMS)), "running")
    read = marks.join(small(at, SMALL), [*keys, "_x"])
    n = F.when(F.col("_last"), F.col("_begun")).otherwise(-F.col("_ended"))
    bp = F.expr("if(_last, (_x + 1) * (_begun - _ended) - _sum, _sum - _x * (_begun - _ended))")
    return read.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(bp + n * cut).alias("overlap_bp")).filter("n > 0")


def merge_overlaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """One row per island; touching intervals stay apart."""
    return islands(df, keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("island")


def span_clusters(df: DataFrame, match_strand: bool) -> DataFrame:
    """Clusters of chained intervals in the order (contig, start, end, strand).

    With ``match_strand`` a change of strand between neighbours in that order
    closes a cluster as well. Returns contig, strand (null unless matched),
    start, end and the number of members.
    """
    order = ["start", "end", "strand", "id"]
    rows = _place(df, "start").withColumn("_run", F.lit(0))
    if match_strand:
        w = Window.partitionBy("contig", "_bin").orderBy(*order)
        rows = rows.join(_over_bins(rows, ["contig"], _last=(F.max_by("strand", F.struct(*order)), F.last)), ["contig", "_bin"])
        before = F.coalesce(F.lag("strand").over(w), "_last")
        rows = rows.withColumn("_new", F.when(before.isNull() | (before != F.col("strand")), 1).otherwise(0))
        rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        rows = rows.join(_over_bins(rows, ["contig"], _earlier=(F.sum("_new"), F.sum)), ["contig", "_bin"])
        rows = rows.withColumn("_run", F.col("_run") + F.coalesce("_earlier", F.lit(0))).drop("_last", "_new", "_earlier")
    rows = islands(rows.drop("_bin"), ["contig", "_run"], out="_island")
    strand = F.first("strand") if match_strand else F.max(F.lit(None).cast("string"))
    return rows.groupBy("contig", "_run", "_island").agg(strand.alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")).drop("_run", "_island")


def sessions(df: DataFrame, keys: list[str], coord: Column, gap: int, out: str) -> DataFrame:
    """Numbers runs of rows whose ``coord`` follows the last one within ``gap``.

    The different coordinates are numbered, bin by bin, and joined back; rows
    themselves are never sorted.
    """
    df = df.withColumn("_x", coord)
    w = Window.partitionBy(*keys, "_bin").orderBy("_x")
    spots = _place(df.select(*keys, "_x").distinct(), "_x")
    spots = spots.join(_over_bins(spots, keys, _last=(F.max("_x"), F.max)), [*keys, "_bin"])
    last = F.coalesce(F.lag("_x").over(w), "_last")
    spots = spots.withColumn("_new", F.when(last.isNull() | (F.col("_x") - last > gap), 1).otherwise(0))
    spots = spots.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spots = spots.join(_over_bins(spots, keys, _earlier=(F.sum("_new"), F.sum)), [*keys, "_bin"])
    numbered = durable(spots.select(*keys, "_x", (F.col(out) + F.coalesce("_earlier", F.lit(0))).alias(out)), "sessions")
    return df.join(small(numbered, SMALL), [*keys, "_x"]).drop("_x")


def neighbours(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark: str, prev: str, next_: str) -> DataFrame:
    """(keys, at) of the different points with the nearest mark at or before each and at or after it, null for none; bin by bin."""
    both = points.select(*keys, F.col(at).alias("_x"), F.lit(None).cast("long").alias("_m")).union(marks.select(*keys, F.col(mark).alias("_x"), F.col(mark).cast("long").alias("_m"))).distinct()
    both = _place(both, "_x")
    w = Window.partitionBy(*keys, "_bin").orderBy("_x")
    both = both.withColumns({prev: F.max("_m").over(w.rangeBetween(Window.unboundedPreceding, 0)), next_: F.min("_m").over(w.rangeBetween(0, Window.unboundedFollowing))})
    both = both.join(_over_bins(both, keys, _before=(F.max("_m"), F.max)), [*keys, "_bin"]).join(_over_bins(both, keys, True, _after=(F.min("_m"), F.min)), [*keys, "_bin"])
    return both.filter("_m is null").select(*keys, F.col("_x").alias(at), F.coalesce(prev, "_before").alias(prev), F.coalesce(next_, "_after").alias(next_))


def ranked(df: DataFrame, order: list, out: str, limit: int = SMALL) -> tuple[DataFrame, int]:
    """``df`` with ``out``, the place of each row in the order, and the number of rows; ``df`` must be cheap to read.

    Up to ``limit`` rows are numbered in one task; more are dealt by ranges, and
    only the sizes of the ranges are summed in one place.
    """
    n = df.count()
    if n <= limit:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long")), n
    rows = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(earlier, "_part").withColumn(out, own + F.col("_earlier")).drop("_part", "_earlier"), n
