"""SimHash near-duplicates linked through vantage-point trees.

A text is lower-cased (A-Z), cut into words at ASCII white space, and each run
of three words is hashed by XXH64 (seed 42); a fingerprint bit is set if it is
set in over half of the hashes. Texts of one or two words count as one run;
texts without words, null ones included, have fingerprint zero.

Two fingerprints that differ in at most three bits differ in at most one bit in
one of their halves. For each half a vantage-point tree, grown on a bounded
sample, cuts the distinct fingerprints into shards by their distance to vantage
points. A point on the shell at the cut is also sent across it, as a query,
since by the triangle inequality no other pair can be parted; so every close
pair meets in a shard. Where many points share a half, the tree goes on with
the distance over all 64 bits and shells of three. A shard that is still large
gets a tree of its own, grown on a sample of its points, and so on, so the
number of shards follows the data and neither the driver nor a task holds more
than a sample or a shard. Within a shard trees are grown on the points
themselves and the leaves compared exactly; a ball too dense to be cut is first
joined along links of one bit, then only what lies outside its largest part is
compared. A shard gives a spanning forest of its links, never all pairs.
Components of the forest are found by contraction of the edge table.

Rows with equal ids are separate rows of one id; ids may be null (a component's
id is its smallest id that is not null). Whole texts are read, whatever their
length, one at a time; an empty table gives an empty table; other columns are
dropped by ``dedup`` and kept by ``firsts``, whatever their names.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import durable, ship, small
from .batches import by_bytes

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Points per shard aimed at, points of the sample, largest leaf compared by brute force.
SHARD, SAMPLE, LEAF = 3000, 16_384, 1024
#: A shard of more points is cut again, by a tree grown on about so many of them.
LARGE, AGAIN = 100_000, 8192
HALVES = (0xFFFFFFFF, 0xFFFFFFFF00000000)
_hash = xxhash.xxh64_intdigest


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n < SHINGLE:
        return _hash(line, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = np.array([_hash(line[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:], strict=False)], np.uint64)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, 512):
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


@dataclass
class Tree:
    """Node arrays of a vantage-point tree: inside (distance <= cut) goes left; leaves have left < 0."""

    point: np.ndarray
    mask: np.ndarray
    reach: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray


def distance(x: np.ndarray, v: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int16)


def grow(points: np.ndarray, half: int, leaf: int, seed: int = 1) -> Tree:
    """Splits ``points`` at the median distance to random vantage points until leaves hold at most ``leaf``."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    todo = [(points, -1, 0)]
    while todo:
        x, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([0, 0, 0, 0, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if len(x) <= leaf:
            continue
        best = None
        for mask, reach in ((HALVES[half], RADIUS // 2), (0xFFFFFFFFFFFFFFFF, RADIUS)):
            for v in x[rng.integers(0, len(x), 4)]:
                d = distance(x, v, np.uint64(mask))
                cut = int(np.sort(d)[(len(d) - 1) // 2])
                for c in (cut, cut - 1):
                    inside = int((d <= c).sum())
                    if 0 < inside < len(x):
                        # work left after the split, with what is sent across
                        sent = int(((d <= c) & (d > c - reach)).sum())
                        cost = inside**2 + (len(x) - inside) ** 2 + sent * (len(x) - inside)
                        if best is None or cost < best[0]:
                            best = cost, v, mask, reach, c, d <= c
            if best is not None and best[0] < 0.9 * len(x) ** 2:
                break
        if best is None or best[0] >= 0.97 * len(x) ** 2:
            continue
        _, v, mask, reach, c, inside = best
        nodes[me][:4] = [int(v), mask, reach, c]
        todo += [(x[inside], me, 0), (x[~inside], me, 1)]
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0], np.uint64), np.array(cols[1], np.uint64), *(np.array(c, np.int32) for c in cols[2:]))


def route(tree: Tree, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, own) of every visit: a point has one leaf of its own, and visits as a query those across its shells."""
    row, node, out = np.arange(len(x)), np.zeros(len(x), np.int32), []
    while len(row):
        done = tree.left[node] < 0
        if done.any():
            out.append((row[done], node[done], own[done]))
            row, node, own = row[~done], node[~done], own[~done]
        d = distance(x[row], tree.point[node], tree.mask[node])
        cut, reach = tree.cut[node], tree.reach[node]
        # own points: left or right, and across from the left shell; queries: wherever an own point may be near
        left = np.where(own, d <= cut, d - reach <= cut)
        right = np.where(own, d > cut - reach, d + reach > cut)
        row, node, own = np.concatenate([row[left], row[right]]), np.concatenate([tree.left[node[left]], tree.right[node[right]]]), np.concatenate([own[left], own[right] & (d[right] > cut[right])])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (row, node, own)  # type: ignore[return-value]


def _flat(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The flat forest with the edges (i, j) added."""
    while len(i):
        root = _flat(root)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        # a larger root hooks to one of the smaller roots near it
        root[np.maximum(root[i], root[j])] = np.minimum(root[i], root[j])
    return _flat(root)


def _by_one_bit(x: np.ndarray, rows: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Adds the links of one bit among ``rows``."""
    order = rows[np.argsort(x[rows])]
    y = x[order]
    for bit in range(64):
        z = y ^ (np.uint64(1) << np.uint64(bit))
        at = np.minimum(np.searchsorted(y, z), len(y) - 1)
        hit = np.flatnonzero(y[at] == z)
        root = _hook(root, order[hit], order[at[hit]])
    return root


def forest(x: np.ndarray, own: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a spanning forest of the links between own points, and between queries and own points."""
    root = np.arange(len(x))
    if len(x) > LEAF:
        row, leaf, mine = route(grow(x, half, LEAF // 2), x, own)
        order = np.argsort(leaf, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1)
    else:
        row, mine, parts = np.arange(len(x)), own, [np.arange(len(x))]
    for part in parts:
        rows, is_own = row[part], mine[part]
        target = rows[is_own]
        work = [(rows, target)]
        if len(rows) > 2 * LEAF:
            root = _by_one_bit(x, np.unique(rows), root)
            mark, size = np.unique(root[rows], return_counts=True)
            inside = root[rows] == mark[size.argmax()]
            # pairs within the largest part are linked already
            work = [(rows[~inside], target), (rows[inside], rows[is_own & ~inside])]
        for rows, target in work:
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                for t0 in range(0, len(target), 8192):
                    i, j = np.nonzero(np.bitwise_count(x[some][:, None] ^ x[target[t0 : t0 + 8192]][None, :]) <= RADIUS)
                    i, j = some[i], target[t0 + j]
                    root = _hook(root, i[i != j], j[i != j])
    at = np.flatnonzero(root != np.arange(len(x)))
    return at, root[at]


ROWS = "shard string, fp bigint, own boolean"


def _deeper(dealt: DataFrame, level: int, large: int, again: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows of shards that stay, rows of the others dealt anew) of the shards of more than ``large`` own points; None if there are none."""
    sizes = durable(dealt.filter("own").groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > large), "simhash-large")
    if sizes.isEmpty():
        return None
    sizes = small(sizes)
    chosen = dealt.filter("own").join(sizes, "shard").filter(F.pmod(F.xxhash64("fp", F.lit(level)), F.lit(1 << 30)) < F.lit(float(again << 30)) / F.col("n")).select("shard", "fp", "n")

    def plant(group: pa.Table) -> pa.Table:
        x = np.sort(group["fp"].to_numpy()).view(np.uint64)
        name, n = group["shard"][0].as_py(), group["n"][0].as_py()
        tree = grow(x, int(name[0]), max(8, -(-len(x) * SHARD // n)), level)
        return pa.table({"shard": [name], "tree": [pickle.dumps(tree)], "cut": [bool(tree.left[0] >= 0)]})

    trees = durable(chosen.groupBy("shard").applyInArrow(plant, "shard string, tree binary, cut boolean"), "simhash-trees")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / large)).cast("int")
    split = durable(trees.join(sizes, "shard").filter("cut").select("shard", parts.alias("parts"), "tree"), "simhash-cuts")
    names = small(durable(split.select("shard", "parts"), "simhash-names"))
    rows = dealt.join(names, "shard").select("shard", F.pmod(F.xxhash64("fp", F.lit(-level)), F.col("parts")).cast("int").alias("part"), "fp", "own", F.lit(None).cast("binary").alias("tree"))
    roots_ = split.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("fp"), F.lit(None).cast("boolean").alias("own"), "tree")

    def deal(group: pa.Table) -> pa.Table:
        tree = pickle.loads(group["tree"].drop_null()[0].as_py())
        group = group.filter(group["fp"].is_valid()).combine_chunks()
        name, x = (group["shard"][0].as_py() if len(group) else ""), group["fp"].to_numpy().view(np.uint64)
        row, leaf, own = route(tree, x, group["own"].to_numpy(zero_copy_only=False).astype(bool))
        return pa.table({"shard": pa.array([f"{name}.{k}" for k in leaf.tolist()], pa.string()), "fp": pa.array(x[row].view(np.int64), pa.int64()), "own": pa.array(own, pa.bool_())})

    anew = durable(rows.unionByName(roots_).groupBy("shard", "part").applyInArrow(deal, ROWS), "simhash-dealt")
    return dealt.join(names.select("shard"), "shard", "left_anti"), anew


def links(distinct: DataFrame, shard: int = SHARD, sample: int = SAMPLE, large: int = LARGE, again: int = AGAIN) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp``, enough to connect what is connected."""
    spark = distinct.sparkSession
    ship(spark)
    n = distinct.count()
    seen = np.sort(np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64)).view(np.uint64)
    trees = [grow(seen, h, max(8, -(-len(seen) * shard // max(1, n)))) for h in (0, 1)] if n else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for h, tree in enumerate(trees):
                row, leaf, own = route(tree, x, np.ones(len(x), bool))
                yield pa.RecordBatch.from_arrays([pa.array([f"{h}.{k}" for k in leaf.tolist()], pa.string()), pa.array(x[row].view(np.int64)), pa.array(own)], ["shard", "fp", "own"])

    def solve(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, own = group["fp"].to_numpy().view(np.uint64), group["own"].to_numpy(zero_copy_only=False).astype(bool)
        i, j = forest(x, own, int(group["shard"][0].as_py()[0]))
        return pa.table({"a": x[i].view(np.int64), "b": x[j].view(np.int64)})

    dealt = durable(distinct.select("fp").mapInArrow(deal, ROWS), "simhash-dealt")
    done: list[DataFrame] = []
    for level in range(1, 9):
        # what a tree cannot cut further stays a shard, whatever its size
        got = _deeper(dealt, level, large, again)
        if got is None:
            break
        done.append(got[0])
        dealt = got[1]
    for x in done:
        dealt = dealt.unionByName(x)
    return dealt.groupBy("shard").applyInArrow(solve, "a bigint, b bigint")


def roots(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the column root added: fingerprints are of one component exactly if their roots are equal."""
    comp = components(links(distinct))
    return distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row."""
    fps = durable(fingerprints(docs, id_col, text_col), "simhash")
    distinct = durable(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-distinct")
    root = roots(distinct).select("fp", "first", "root")
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(root.join(least, "root").select("fp", "component_id"), "simhash-map")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (null last), then of the smallest hash of its columns."""
    # numbered and written, so that equal rows and rows of one id can be told apart; packed, so that no name can clash
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = durable(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*names).alias("row")), "simhash-rows")
    hashed = F.xxhash64(*(F.col(f"row.`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    own = F.col(f"row.`{id_col}`")
    key = F.struct(own.isNull().alias("none"), own.alias("id"), hashed.alias("hash"), F.col("number"))
    fps = durable(fingerprints(rows.select(key.alias("key"), F.col(f"row.`{text_col}`").alias("text")), "key", "text"), "simhash")
    root = roots(durable(fps.select("fp").distinct(), "simhash-distinct"))
    kept = fps.join(root, "fp").groupBy("root").agg(F.min("key").alias("key")).select("key.number")
    return rows.join(kept, "number", "left_semi").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
