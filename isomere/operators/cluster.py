"""Clustering of stranded intervals into units.

1. Equal intervals are one. Two intervals of a contig and strand are linked if
   they overlap with score1 of at least ``t1``; connected ones are a seed.
2. The longest interval of a seed stands for it (then the smallest read id).
3. A representative is attached to the best one that starts before it, reaches
   past its start, is longer, keeps the 3' end within ``tolerance`` and has
   score2 of at least ``t2`` or, if given, a 5' distance within ``max_five``.
4. What is not attached is a unit; the rest belongs to the unit at the end of
   its chain.

Links and attachments need overlap, so nothing crosses an island of chained
intervals. Islands of at most ``ISLAND`` different intervals are solved whole
within a task, many at once; larger ones by blocked joins and contraction, so
no island is too large for a machine. Reads of at most ``WHOLE`` bytes, by the
sizes of their files, go to a task for each contig and strand; beyond that
islands are found bin by bin and dealt to tasks. All ways give the same result.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..runtime import durable, plan_bytes, ship, small
from .components import components
from .ranges import SMALL, islands, overlap_join, ranked

ISLAND, WHOLE, FEW = 512, 128 << 20, 4 << 20
PLACE = ["contig", "strand", "start", "end"]


@dataclass(frozen=True)
class ClusterParams:
    t1: float = 0.95
    t2: float = 0.80
    attach: bool = True
    tolerance: int = 12
    max_five: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.t1 <= 1:
            raise ValueError("score1 threshold must lie between 0 and 1")
        if self.attach and not 0 <= self.t2 <= 1:
            raise ValueError("score2 threshold must lie between 0 and 1")
        if self.tolerance < 0 or (self.max_five is not None and self.max_five < 0):
            raise ValueError("distances must not be negative")


def distinct_intervals(reads: DataFrame) -> DataFrame:
    """One row per different interval: its number of reads and smallest read id."""
    return reads.groupBy(*PLACE).agg(F.count("*").alias("n_reads"), F.min("id").alias("id"))


def seed_edges(places: DataFrame, t: float) -> DataFrame:
    """Pairs (a_start, a_end, b_start, b_end) of different intervals with overlap and score1 >= t, smaller one first.

    For t of a half or more the join is blocked by length class and start: with
    lengths in classes of ratio 1/t, linked intervals differ by at most one
    class, and their starts by at most (1 - t) of the longer length.
    """
    side = lambda p: places.select("contig", "strand", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end")).filter(f"{p}_start < {p}_end")
    a, b = side("a"), side("b")
    if t >= 1:
        return a.join(b, ["contig", "strand"]).filter(F.lit(False)).withColumn("score1", F.lit(1.0))
    first = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_end") < F.col("b_end")))
    score = iv.score1("a_start", "a_end", "b_start", "b_end")
    if t < 0.5:
        pairs = overlap_join(a, b, ["contig", "strand"], a_cols=("a_start", "a_end"), b_cols=("b_start", "b_end")).drop("overlap_bp")
        return pairs.filter(first & (score >= t)).withColumn("score1", score)
    a, b = _blocks(a, b, t)
    pairs = a.join(b, ["contig", "strand", "_k", "_bin"]).drop("_k", "_bin")
    return pairs.filter(first & (iv.overlap_len("a_start", "a_end", "b_start", "b_end") > 0) & (score >= t)).withColumn("score1", score)


def _blocks(a: DataFrame, b: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with _k and _bin: a row of ``a`` in its own block, a row of ``b`` in every block whose rows it may be linked with."""
    ratio = (1 / t) * (1 + 1e-9)
    klass = lambda p: F.floor(F.log(F.col(f"{p}_end") - F.col(f"{p}_start")) / math.log(ratio))
    width = lambda k: F.ceil(F.pow(F.lit(ratio), k + 2) * (1 - t)) + 1
    a = a.withColumn("_k", klass("a")).withColumn("_bin", F.floor(F.col("a_start") / width(F.col("_k"))))
    b = b.withColumn("_k", F.explode(F.sequence(klass("b") - 1, klass("b") + 1))).withColumn("_at", F.floor(F.col("b_start") / width(F.col("_k"))))
    return a, b.withColumn("_bin", F.explode(F.sequence(F.col("_at") - 1, F.col("_at") + 1))).drop("_at")


def seed_forest(places: DataFrame, t: float) -> DataFrame:
    """Edges like those of ``seed_edges``, but of each block a spanning forest only: fewer than its rows, however dense it is."""
    if not 0.5 <= t < 1:
        return seed_edges(places, t)
    spark = places.sparkSession
    ship(spark)
    side = lambda p: places.select("contig", "strand", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end")).filter(f"{p}_start < {p}_end")
    a, b = _blocks(side("a"), side("b"), t)
    block = ["contig", "strand", "_k", "_bin"]
    rows = a.withColumn("own", F.lit(True)).withColumnsRenamed({"a_start": "s", "a_end": "e"}).unionByName(b.withColumn("own", F.lit(False)).withColumnsRenamed({"b_start": "s", "b_end": "e"}))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([*((c, "ascending") for c in block), ("own", "descending")]).combine_chunks()
        new = np.zeros(len(group), bool)
        new[:1] = True
        for c in block:
            x = group[c].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        s, e, own = group["s"].to_numpy(), group["e"].to_numpy(), group["own"].to_numpy(zero_copy_only=False).astype(bool)
        first = np.flatnonzero(new)
        at, to = [], []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(s)], strict=True):
            m = int(own[lo:hi].sum())  # own rows stand first
            if not m or hi - lo == m:
                continue
            x, y = s[lo : lo + m], e[lo : lo + m]
            p, q = s[lo + m : hi], e[lo + m : hi]
            # an own row and its copy among the others are one node
            node = np.unique(np.stack([s[lo:hi], e[lo:hi]], 1), axis=0, return_inverse=True)[1].ravel()
            root, here = np.arange(node.max() + 1), np.empty(node.max() + 1, np.int64)
            here[node] = np.arange(lo, hi)
            for k in range(0, m, 256):
                o = np.minimum(y[k : k + 256, None], q[None]) - np.maximum(x[k : k + 256, None], p[None])
                union = (y - x)[k : k + 256, None] + (q - p)[None] - o
                i, j = np.nonzero((o > 0) & (o / np.maximum(union, 1) >= t))
                root = _hook(root, node[k + i], node[m + j])
            found = np.flatnonzero(root != np.arange(len(root)))
            at.append(here[found])
            to.append(here[root[found]])
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, to))
        cols = [group["contig"].take(pa.array(i)), group["strand"].take(pa.array(i)), pa.array(s[i]), pa.array(e[i]), pa.array(s[j]), pa.array(e[j])]
        return pa.table(cols, names=["contig", "strand", "a_start", "a_end", "b_start", "b_end"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64(*block), F.lit(tasks)))
    return dealt.groupBy("_task").applyInArrow(run, "contig string, strand string, a_start long, a_end long, b_start long, b_end long")


def _node(p: str):
    return F.struct("contig", "strand", F.col(f"{p}start").alias("start"), F.col(f"{p}end").alias("end"))


def seeds_by_join(places: DataFrame, t: float) -> DataFrame:
    """``places`` with ``seed``, some member of its seed, by joins alone."""
    edges = seed_forest(places, t).select(_node("a_").alias("a"), _node("b_").alias("b"))
    found = components(edges)
    return places.withColumn("node", _node("")).join(found, "node", "left").withColumn("seed", F.coalesce("root", "node")).drop("node", "root")


def representatives(seeded: DataFrame) -> DataFrame:
    """One row per seed: the longest interval, then smallest id, then first place."""
    w = Window.partitionBy("seed").orderBy((F.col("end") - F.col("start")).desc(), "id", "start", "end")
    return seeded.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("seed", *PLACE, "id")


def parents(reps: DataFrame, p: ClusterParams) -> DataFrame:
    """The best parent of each representative that has one: (contig, strand, start, end, id) and parent_start, parent_end, parent_id, scores."""
    child = reps.select(*PLACE, "id").filter("start < end")
    cand = reps.select("contig", "strand", F.col("start").alias("parent_start"), F.col("end").alias("parent_end"), F.col("id").alias("parent_id"))
    pairs = overlap_join(child, cand, ["contig", "strand"], b_cols=("parent_start", "parent_end")).drop("overlap_bp")
    args = ("start", "end", "parent_start", "parent_end")
    s1, s2 = iv.score1(*args), iv.score2(*args)
    good = s2 >= p.t2
    if p.max_five is not None:
        good = good | (iv.five_prime_delta("strand", *args) <= p.max_five)
    ok = (F.col("parent_start") < F.col("start")) & (F.col("parent_end") - F.col("parent_start") > F.col("end") - F.col("start")) & iv.within_three_prime("strand", *args, p.tolerance) & good
    pairs = pairs.filter(ok).withColumns({"score1": s1, "score2": s2})
    w = Window.partitionBy(*PLACE).orderBy(F.col("score2").desc(), F.col("score1").desc(), "parent_id", "parent_start", "parent_end")
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def roots(reps: DataFrame, up: DataFrame) -> DataFrame:
    """Every representative with the end of its chain of parents, by pointer doubling: PLACE and root_start, root_end."""
    now = reps.select(*PLACE).join(up.select(*PLACE, "parent_start", "parent_end"), PLACE, "left").select(*PLACE, F.coalesce("parent_start", "start").alias("root_start"), F.coalesce("parent_end", "end").alias("root_end"))
    now = durable(now, "roots")
    while True:
        nxt = now.select("contig", "strand", F.col("start").alias("root_start"), F.col("end").alias("root_end"), F.col("root_start").alias("_s"), F.col("root_end").alias("_e"))
        both = durable(now.join(nxt, ["contig", "strand", "root_start", "root_end"]).select(*PLACE, F.col("_s").alias("root_start"), F.col("_e").alias("root_end"), ((F.col("_s") != F.col("root_start")) | (F.col("_e") != F.col("root_end"))).alias("_moved")), "roots")
        now = both.drop("_moved")
        if both.filter("_moved").isEmpty():
            return now


def _by_join(places: DataFrame, p: ClusterParams) -> DataFrame:
    seeded = durable(seeds_by_join(places, p.t1), "seeds")
    reps = durable(representatives(seeded), "representatives")
    up = parents(reps, p) if p.attach else None
    end = roots(reps, up) if up is not None else reps.select(*PLACE, F.col("start").alias("root_start"), F.col("end").alias("root_end"))
    named = reps.select("seed", *PLACE).join(end, PLACE).select("seed", F.col("start").alias("rep_start"), F.col("end").alias("rep_end"), F.col("root_start").alias("unit_start"), F.col("root_end").alias("unit_end"))
    return seeded.join(named, "seed").select(*PLACE, "id", "n_reads", "rep_start", "rep_end", "unit_start", "unit_end")


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest members of the groups of a flat forest after the edges (i, j) are added."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _first(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first of each key in an order that is sorted by it."""
    k = key[order]
    return order[np.concatenate([[True], k[1:] != k[:-1]])] if len(order) else order


def solve(s: np.ndarray, e: np.ndarray, ids: pa.Array, minus: np.ndarray, group: np.ndarray, p: ClusterParams) -> tuple[np.ndarray, np.ndarray]:
    """The index of each interval's representative and of its unit's, for different intervals sorted by island (``group``) and start.

    All islands are worked on at once: every interval is compared with the next,
    the one after it, and so on, as long as any two overlap.
    """
    n, size = len(s), e - s
    rank = pc.rank(ids, tiebreaker="dense").to_numpy()

    def pairs(s, e, group):
        i, k = np.arange(len(s) - 1), 1
        while len(i):
            i = i[i + k < len(s)]
            i = i[(group[i + k] == group[i]) & (s[i + k] < e[i])]
            yield i, i + k
            k += 1

    root = np.arange(n)
    if p.t1 < 1:
        for i, j in pairs(s, e, group):
            o = np.minimum(e[i], e[j]) - s[j]
            hit = (o > 0) & (o / np.maximum(size[i] + size[j] - o, 1) >= p.t1)
            root = _hook(root, i[hit], j[hit])
    best = np.empty(n, np.int64)
    chosen = _first(np.lexsort((e, s, rank, -size, root)), root)
    best[root[chosen]] = chosen
    rep = best[root]
    reps = np.unique(rep)
    up = np.arange(len(reps))
    if p.attach:
        rs, re, rz, rm = s[reps], e[reps], size[reps], minus[reps]
        found = []
        for d, c in pairs(rs, re, group[reps]):
            o = np.maximum(0, np.minimum(re[d], re[c]) - rs[c])
            s2 = o / np.maximum(np.maximum(rz[d], rz[c]), 1)
            good = s2 >= p.t2
            if p.max_five is not None:
                good |= np.where(rm[c], np.maximum(0, re[d] - re[c]), np.maximum(0, rs[c] - rs[d])) <= p.max_five
            good &= np.where(rm[c], rs[d] <= rs[c] + p.tolerance, re[d] + p.tolerance >= re[c])
            good &= (rs[d] < rs[c]) & (rz[d] > rz[c]) & (rz[c] > 0)
            if good.any():
                d, c, o = d[good], c[good], o[good]
                found.append((c, d, -s2[good], -(o / np.maximum(rz[d] + rz[c] - o, 1))))
        if found:
            c, d, s2, s1 = (np.concatenate(x) for x in zip(*found, strict=True))
            at = _first(np.lexsort((re[d], rs[d], rank[reps[d]], s1, s2, c)), c)
            up[c[at]] = d[at]
        while not np.array_equal(far := up[up], up):
            up = far
    return rep, reps[up][np.searchsorted(reps, rep)]


def solve_island(s: np.ndarray, e: np.ndarray, ids: list[str], minus: bool, p: ClusterParams) -> tuple[np.ndarray, np.ndarray]:
    """The same for different intervals of one island in any order."""
    order = np.lexsort((e, s))
    rep, unit = solve(s[order], e[order], pa.array([ids[i] for i in order.tolist()], pa.string()), np.full(len(s), minus), np.zeros(len(s), np.int64), p)
    back = np.argsort(order)
    return order[rep][back], order[unit][back]


SOLVED = "contig string, strand string, start long, end long, id string, n_reads long, rep_start long, rep_end long, unit_start long, unit_end long"
_NAMES = [*PLACE, "id", "n_reads", "rep_start", "rep_end", "unit_start", "unit_end"]


def _solved(group: pa.Table, island: np.ndarray, p: ClusterParams, most: int | None = None) -> pa.Table:
    """Rows sorted by contig, strand, start and end; islands of over ``most`` rows are left open."""
    s, e = group["start"].to_numpy(), group["end"].to_numpy()
    done = np.ones(len(s), bool) if most is None else np.bincount(island)[island] <= most
    minus = pc.equal(group["strand"], "-").to_numpy()
    at = np.flatnonzero(done)
    rep, unit = solve(s[at], e[at], group["id"].combine_chunks().take(pa.array(at)), minus[at], island[at], p)
    cols = []
    for x in (s[at][rep], e[at][rep], s[at][unit], e[at][unit]):
        full = np.zeros(len(s), np.int64)
        full[at] = x
        cols.append(pa.array(full, mask=~done))
    return pa.table([*(group[c] for c in PLACE), group["id"], group["n_reads"], *cols], names=_NAMES)


def _by_island(places: DataFrame, p: ClusterParams, tasks: int) -> DataFrame:
    """Islands are dealt to ``tasks`` groups, each solving its islands together."""
    ship(places.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("contig", "strand", "island", "start", "end")]).combine_chunks()
        new = np.zeros(len(group), bool)
        for c in ("contig", "strand", "island"):
            x = group[c].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        return _solved(group, np.cumsum(new), p)

    dealt = places.withColumn("_task", F.pmod(F.xxhash64("contig", "strand", "island"), F.lit(tasks)))
    return dealt.groupBy("_task").applyInArrow(run, SOLVED)


def _whole(places: DataFrame, p: ClusterParams, island: int) -> DataFrame:
    """A task for each contig and strand, which finds the islands itself; islands of over ``island`` intervals are left open."""
    ship(places.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("start", "ascending"), ("end", "ascending")]).combine_chunks()
        s, e = group["start"].to_numpy(), group["end"].to_numpy()
        new = np.ones(len(s), bool)
        new[1:] = s[1:] >= np.maximum.accumulate(e)[:-1]
        return _solved(group, np.cumsum(new) - 1, p, island)

    return places.groupBy("contig", "strand").applyInArrow(run, SOLVED)


def assign(reads: DataFrame, p: ClusterParams = ClusterParams(), island: int = ISLAND, whole: int = WHOLE) -> DataFrame:
    """Every different interval with its representative and unit: PLACE, id, n_reads, rep_start, rep_end, unit_start, unit_end."""
    if plan_bytes(reads) <= whole:
        out = durable(_whole(distinct_intervals(reads), p, island), "assigned")
        left = out.filter("unit_start is null")
        if left.isEmpty():
            return out
        return durable(out.filter("unit_start is not null").unionByName(_by_join(left.select(*PLACE, "id", "n_reads"), p)), "assigned")
    places = islands(distinct_intervals(reads), ["contig", "strand"])
    size = F.count("*").over(Window.partitionBy("contig", "strand", "island"))
    places = durable(places.withColumn("_size", size), "places")
    kind = F.when(F.col("_size") > island, 2).when(F.col("_size") == 1, 0).otherwise(1)
    found = {r.kind: r.n for r in places.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
    # an interval alone on its island is its own unit
    own = {f"{k}_{c}": F.col(c) for k in ("rep", "unit") for c in ("start", "end")}
    out = places.filter(kind == 0).withColumns(own).select(*_NAMES)
    if 1 in found:
        out = out.unionByName(_by_island(places.filter(kind == 1).drop("_size"), p, max(reads.sparkSession.sparkContext.defaultParallelism, found[1] // 20_000)))
    if 2 in found:
        out = out.unionByName(_by_join(places.filter(kind == 2).drop("_size", "island"), p))
    return durable(out, "assigned")


def numbered(units: DataFrame, prefix: str = "TU", least: int = 6, few: int = FEW) -> DataFrame:
    """Adds ``tu_id`` in the order contig, strand, start, end, id; a table of few bytes is numbered in one task."""
    if plan_bytes(units) <= few:
        order = Window.orderBy(*PLACE, "id")
        rank, n = F.row_number().over(order).cast("string"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("string")
        return units.withColumn("tu_id", F.concat(F.lit(prefix), F.lpad(rank, F.greatest(F.lit(least), F.length(n)), F.lit("0"))))
    units, n = ranked(durable(units, "units"), [*PLACE, "id"], "_rank")
    return units.withColumn("tu_id", iv.padded_id(prefix, "_rank", n, least)).drop("_rank")


@dataclass
class Clustering:
    """``tus`` (tu_id, PLACE, id of the representative read, n_reads) and ``membership`` (id, PLACE, tu_id, score1, score2)."""

    tus: DataFrame
    membership: DataFrame


def cluster(reads: DataFrame, p: ClusterParams = ClusterParams(), min_count: int = 0, island: int = ISLAND, whole: int = WHOLE) -> Clustering:
    """Clusters reads (contig, strand, start, end, id); units with fewer than ``min_count`` reads go, and the rest is numbered anew."""
    reads = reads.filter("start < end")
    placed = assign(reads, p, island, whole)
    stands = (F.col("start") == F.col("unit_start")) & (F.col("end") == F.col("unit_end"))
    units = placed.groupBy("contig", "strand", "unit_start", "unit_end").agg(F.sum("n_reads").alias("n_reads"), F.max(F.when(stands, F.col("id"))).alias("id"))
    units = units.filter(F.col("n_reads") >= min_count).withColumnsRenamed({"unit_start": "start", "unit_end": "end"})
    tus = durable(numbered(units), "tus").select("tu_id", *PLACE, "id", "n_reads")
    own = tus.select("tu_id", "contig", "strand", F.col("start").alias("unit_start"), F.col("end").alias("unit_end"))
    # units go to the different intervals, and these to the reads, which move once at most
    keys = ["contig", "strand", "unit_start", "unit_end"]
    of_place = placed.drop("id", "n_reads")
    if plan_bytes(placed) <= FEW:
        of_place = F.broadcast(of_place.join(F.broadcast(own), keys))
    else:
        of_place = small(durable(of_place.join(small(own, SMALL), keys), "unit-places"), SMALL)
    args = ("start", "end", "unit_start", "unit_end")
    membership = reads.join(of_place, PLACE).select("id", *PLACE, "tu_id", iv.score1(*args).alias("score1"), iv.score2(*args).alias("score2"))
    return Clustering(tus, membership)


def stats(reads: DataFrame) -> DataFrame:
    """One row: partitions, islands and the largest of each, counted in reads."""
    at = islands(distinct_intervals(reads.filter("start < end")), ["contig", "strand"])
    region = at.groupBy("contig", "strand", "island").agg(F.sum("n_reads").alias("n"))
    parts = region.groupBy("contig", "strand").agg(F.sum("n").alias("n"), F.count("*").alias("regions"), F.max("n").alias("most"))
    return parts.agg(F.count("*").alias("partitions"), F.sum("regions").alias("regions"), F.max("n").alias("max_partition_reads"), F.max("regions").alias("max_partition_regions"), F.max("most").alias("max_region_reads"))
