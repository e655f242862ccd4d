"""Connected components of a graph given as an edge table, without collecting it.

Every node is mapped to the neighbour (or itself) with the smallest hash and
the graph is contracted along that map until no edge is left; the maps are then
composed. The hash makes long chains shrink by a constant factor a round and a
star vanish in two rounds. Each round's tables are written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, release


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, root) for every node on an edge; nodes are connected exactly if their roots are equal.

    Null ends are ignored, loops and repeated edges are harmless. The root is
    a node of the component, not its smallest.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    loops = None
    e = durable(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    loops = e.filter("a = b").select(F.col("a").alias("node"))
    live = e.filter("a <> b")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        if len(maps) == rounds:
            raise RuntimeError("components did not end")
        both = live.union(live.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        step = durable(near.select(F.col("a").alias("node"), F.when(F.col("best") < rank("a"), F.col("best.v")).otherwise(F.col("a")).alias("root")), "step")
        maps.append(step)
        left = live.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        new = durable(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if len(maps) > 1:
            release(e)
        e = live = new
    if not maps:
        return loops.select("node", F.col("node").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = durable(m.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "map")
    return out.unionByName(loops.join(out, "node", "left_anti").select("node", F.col("node").alias("root")))
