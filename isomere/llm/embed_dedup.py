"""Near-duplicate embeddings within a label, by a robust-pruned flat graph.

Equal vectors of a label are one node with a count. Centroids for each label
come from a bounded sample (``sample`` vectors in all, in the order of a hash)
by spherical k-means, near centroids being merged; a vector is at home in the
shard of its nearest centroid, and a shard of more than ``PART`` vectors is
dealt over parts by a hash. Each part builds a robust-pruned graph of its own
vectors by inserting them one batch after the other, and searches it for each:
greedily from its medoid, then through everything within ``low`` of the query.
Some of its queries are compared with brute force; if any link of theirs was
missed, it searches again with a wider reach, and in the end compares all of
its rows. A vector is also a guest in every other part that can hold a vector
within ``threshold`` of it (one way for each two parts): the shards overlap by
the angle of the threshold. There it is compared with all rows at home, so no
link is lost at a border. Pairs are verified in double precision: cosine of at
least ``threshold`` counts as a link. A part gives counts and a spanning forest
of its links, never pairs. At last the links of ``AUDIT`` vectors, chosen by a
hash among all, are counted by brute force over the whole table; if fewer than
the share ``recall`` of them were found, all parts compare all of their rows.

A vector that is null, zero, or holds nulls, NaNs or infinities, and a vector
with a null label, links with nothing. Vectors of different lengths link with
nothing of the other length. Repeated rows are linked like any equal vectors;
null ids are left out of minima. An empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import durable, release, ship, small
from . import graph

SAMPLE, SHARD, MERGE, GUESTS, PART, AUDIT = 16_384, 400, 0.85, 16_384, 4096, 256


def _unit(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.float64)
    # scaled first, so that huge and tiny components neither overflow nor vanish
    a /= np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Up to ``k`` unit centroids of unit vectors, none within ``MERGE`` of another."""
    c = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))].copy()
    for step in range(rounds + 1):
        keep: list[int] = []
        for i in range(len(c)):
            if not keep or (c[keep] @ c[i]).max() < MERGE:
                keep.append(i)
        c = c[keep]
        if step == rounds:
            break
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1))
        c = sums[size > 1e-9] / size[size > 1e-9, None]
    return c


def _exact(x: np.ndarray, hits: np.ndarray, threshold: float) -> None:
    """Marks all pairs with cosine of ``threshold`` or more."""
    for b in range(0, len(x), 256):
        hits[b : b + 256] |= x[b : b + 256] @ x.T >= threshold


def near_pairs(x: np.ndarray, threshold: float, exact: bool = False, checks: int = 64) -> np.ndarray:
    """Which pairs of unit vectors have a cosine of ``threshold`` or more, as a square of booleans."""
    n = len(x)
    hits = np.zeros((n, n), bool)
    if not exact and n > 1:
        adj, start = graph.build(x), graph.medoid(x)
        at = np.arange(0, n, max(1, n // checks))
        truth = x[at] @ x.T >= threshold
        block = max(1, min(256, 65536 // n))
        for low in (threshold - 0.05, threshold - 0.2):
            for b in range(0, n, block):
                q = x[b : b + block]
                i, j = graph.expand(x, adj, q, graph.search(x, adj, q, start, 16)[0], low)
                good = np.concatenate([np.einsum("kd,kd->k", q[i[c : c + 8192]], x[j[c : c + 8192]]) for c in range(0, len(i), 8192)] or [np.zeros(0)]) >= threshold
                hits[b + i[good], j[good]] = True
            hits |= hits.T
            if (hits[at] | ~truth)[~np.eye(n, dtype=bool)[at]].all():
                break
        else:
            exact = True
    if exact:
        _exact(x, hits, threshold)
        hits |= hits.T
    hits[np.arange(n), np.arange(n)] = False
    return hits


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (smallest indices) after the edges (i, j) are added to a flat forest."""
    while len(i):
        a, b = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, a, b)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def visits(x: np.ndarray, at: np.ndarray, c: np.ndarray, width: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): the other shards that may hold a vector within ``threshold`` of a row, by one of the two ends of each pair of shards.

    ``at`` is the shard of each row, ``width`` the angle of a shard's farthest
    own row from its centroid. Own rows of a shard are no nearer to another
    centroid than to theirs, so a row farther than the threshold's angle from
    that half-space, or from the shard's cone, has no link there.
    """
    angle = np.arccos(min(1.0, max(-1.0, threshold)))
    sine = np.sin(angle) if threshold > 0 else np.inf
    shards = np.arange(len(c))
    rows, to = [], []
    for b in range(0, len(x), 512):
        s, mine = x[b : b + 512] @ c.T, at[b : b + 512, None]
        # a pair of shards is searched in the one of the two that its parity names
        may = np.where((mine + shards) % 2 == 0, mine < shards, mine > shards)
        may &= np.arccos(np.clip(s, -1, 1)) <= width + angle + 1e-6
        k = min(8, len(c))
        for d in np.argpartition(-s, k - 1, axis=1)[:, :k].T:
            apart = np.sqrt(np.maximum(0, 2 - 2 * c[d] @ c.T))
            may &= s[np.arange(len(s)), d][:, None] - s <= sine * apart + 1e-6 if np.isfinite(sine) else True
        i, j = np.nonzero(may)
        rows.append(b + i)
        to.append(j)
    return np.concatenate(rows), np.concatenate(to)


def nodes_of(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, node, valid): ``node`` is a hash of label and vector."""
    v = F.col(vec_col)
    fine = F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(label_col, vec_col).alias("node"), F.coalesce(fine, F.lit(False)).alias("valid"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vec"))


def audited(nodes: DataFrame, found: DataFrame, threshold: float, checks: int = AUDIT) -> float:
    """The share of the links of ``checks`` nodes, chosen by a hash, that ``found`` holds; their links are counted by brute force over all nodes."""
    some = nodes.orderBy(F.xxhash64("node", F.lit(4)), "node").limit(checks).select("node", "space", "vec").collect()
    asked = {space: ([r.node for r in some if r.space == space], _unit(np.array([r.vec for r in some if r.space == space]))) for space in {r.space for r in some}}
    if not asked:
        return 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            names, ids, copies = np.array(batch.column(1).to_pylist(), object), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for space, (keys, q) in asked.items():
                rows = np.flatnonzero(names == space)
                for b in range(0, len(rows), 2048):
                    at = rows[b : b + 2048]
                    x = _unit(batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                    for key, near in zip(keys, q @ x.T >= threshold, strict=True):
                        total[key] = total.get(key, 0) + int(copies[at[near & (ids[at] != key)]].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["a", "n"])

    true = nodes.select("node", "space", "copies", "vec").mapInArrow(count, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("true"))
    got = found.join(F.broadcast(true.select("a")), "a").groupBy("a").agg(F.sum("n").alias("got"))
    r = true.join(got, "a", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("got", F.lit(0)))).alias("got")).first()
    return r.got / r.true if r.true else 1.0


def dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.98, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = df.sparkSession
    ship(spark)
    rows = nodes_of(df, id_col, vec_col, label_col)
    valid = rows.filter("valid")
    nodes = durable(valid.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("vec").alias("vec")).withColumn("space", F.concat_ws(":", F.size("vec").cast("string"), "label")), "embed-nodes")
    total = nodes.count()
    some = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).select("node", "space", "vec").toArrow()
    scale = total / max(1, some.num_rows)
    spaces: dict[str, np.ndarray] = {}
    names = np.array(some["space"].to_pylist(), object)
    vecs = some["vec"].to_pylist()
    order = np.argsort(np.array(some["node"].to_pylist(), np.int64), kind="stable") if total else []
    for name in sorted({*names}):
        x = _unit(np.array([vecs[i] for i in order if names[i] == name]))
        spaces[name] = centroids(x, max(1, int(round(len(x) * scale / shard))))
    first_shard = dict(zip(spaces, np.cumsum([0, *(len(c) for c in spaces.values())]).tolist(), strict=False))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_ = np.array(batch.column(2).to_pylist(), object)
            raw = batch.column(3).to_pylist()
            shards, at, angle, unit = [""] * len(names_), np.zeros(len(names_), np.int32), np.zeros(len(names_)), [None] * len(names_)
            for name in {*names_}:
                rows_ = np.flatnonzero(names_ == name)
                x = _unit(np.array([raw[i] for i in rows_]))
                if name in spaces:
                    s = x @ spaces[name].T
                    at[rows_] = s.argmax(1)
                    angle[rows_] = np.arccos(np.clip(s.max(1), -1, 1))
                for r, i in enumerate(rows_):
                    shards[i] = str(first_shard[name] + int(at[i])) if name in spaces else name
                    unit[i] = x[r]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), batch.column(0), batch.column(1), batch.column(2), pa.array(at), pa.array(angle), pa.array(unit, pa.list_(pa.float64()))], ["shard", "node", "copies", "space", "at", "angle", "vec"])

    home = durable(nodes.select("node", "copies", "space", "vec").mapInArrow(settle, "shard string, node bigint, copies bigint, space string, at int, angle double, vec array<double>"), "embed-home")
    width = {name: np.zeros(len(c)) for name, c in spaces.items()}
    for r in home.groupBy("space", "at").agg(F.max("angle").alias("angle")).toLocalIterator():
        if r.space in width:
            width[r.space][r["at"]] = r.angle

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_ = np.array(batch.column(2).to_pylist(), object)
            at, vecs_ = batch.column(3).to_numpy(), batch.column(4)
            src, to = [], []
            for name in {*names_} & {*spaces}:
                rows_ = np.flatnonzero(names_ == name)
                x = vecs_.take(pa.array(rows_)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows_), -1)
                r, c = visits(x, at[rows_], spaces[name], width[name], threshold)
                src.append(rows_[r])
                to += (first_shard[name] + c).astype(str).tolist()
            src = pa.array(np.concatenate(src) if src else np.zeros(0, np.int64), pa.int64())
            for b in range(0, len(to), 65536):
                some_ = src.slice(b, 65536)
                yield pa.RecordBatch.from_arrays([pa.array(to[b : b + 65536], pa.string()), *(batch.column(k).take(some_) for k in (0, 1, 4))], ["shard", "node", "copies", "vec"])

    visitors = home.select("node", "copies", "space", "at", "vec").mapInArrow(visit, "shard string, node bigint, copies bigint, vec array<double>")
    # large shards are dealt over parts, whose rows visit the later parts of the same shard
    split = durable(home.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("split")).filter("split > 1"), "embed-split")
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.coalesce("split", F.lit(1))).cast("int")
    named = lambda k: F.concat_ws("/", "shard", k.cast("string"))
    home = durable(home.join(small(split), "shard", "left").withColumn("slice", part), "embed-slices")
    later = home.filter("split > 1 and slice < split - 1").select("shard", F.explode(F.sequence(F.col("slice") + 1, F.col("split") - 1)).alias("to"), "node", "copies", "vec")
    visitors = visitors.join(small(split), "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("split", F.lit(1)) - 1)).alias("to"), "node", "copies", "vec")
    guests = durable(visitors.unionByName(later).select(named(F.col("to")).alias("shard"), "node", "copies", "vec"), "embed-guests")
    # a part of many guests is searched by several tasks, its own rows being in each
    parts = durable(guests.groupBy("shard").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("parts")), "embed-parts")
    owners = home.withColumn("shard", named(F.col("slice"))).join(small(parts), "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "node", "copies", F.lit(True).alias("own"), "vec")
    callers = guests.join(small(parts), "shard").select("shard", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("part"), "node", "copies", F.lit(False).alias("own"), "vec")

    def search(group: pa.Table, exact: bool) -> pa.Table:
        group = group.combine_chunks().sort_by([("own", "descending"), ("node", "ascending")])
        ids, own, copies = group["node"].to_numpy(), group["own"].to_numpy(zero_copy_only=False).astype(bool), group["copies"].to_numpy()
        flat = group["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = _unit(flat.reshape(len(ids), -1))
        m = int(own.sum())  # own rows stand first
        n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if group["part"][0].as_py() == 0:
            hits = near_pairs(x[:m], threshold, exact)
            for b in range(0, m, 256):
                i, j = np.nonzero(hits[b : b + 256])
                np.add.at(n, b + i, copies[j])
                root = _hook(root, b + i, j)
            del hits
        for b in range(m, len(ids), 256):
            # guests are compared with every own row
            i, j = np.nonzero(x[b : b + 256] @ x[:m].T >= threshold)
            i += b
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            root = _hook(root, i, j)
        at = np.flatnonzero(n)
        return pa.table({"a": ids[at], "b": ids[root[at]], "n": n[at]})

    dealt = owners.unionByName(callers).groupBy("shard", "part")
    found = durable(dealt.applyInArrow(lambda g: search(g, False), "a bigint, b bigint, n bigint"), "embed-links")
    if audited(nodes, found, threshold) < recall:
        release(found)
        found = durable(dealt.applyInArrow(lambda g: search(g, True), "a bigint, b bigint, n bigint"), "embed-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("a <> b").select("a", "b"))
    root = nodes.select("node", "copies", "first").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(root.join(least, "root").join(counts, "node", "left").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "embed-named")
    ids = rows.select("id", "node", "valid")
    linked = ids.filter("valid").join(named, "node").select(F.col("id").alias(id_col), "n_links", "component_id")
    alone = ids.filter("not valid").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
