import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isomere.operators import ranges, transcripts
from isomere.plans import registry

SPANS = "chrom string, strand string, tx_start long, tx_end long, name string"


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_loop(spark, monkeypatch, seed):
    """Short bins, marks broadcast or not; positions below zero, empty and reversed spans, nulls, repeated rows and names."""
    rng = random.Random(seed)
    monkeypatch.setattr(ranges, "SPAN", [16, 50, 64, 1 << 16][seed])
    monkeypatch.setattr(ranges, "SMALL", [0, 200_000][seed % 2])
    some = lambda x: None if rng.random() < 0.03 else x
    make = lambda n, names: [(some(rng.choice(["c1", "c2"])), rng.choice(["+", "-"]), some(s := rng.randint(-60, 200)), some(s + rng.choice([-3, 0, 1, rng.randint(0, 50), 150])), some(rng.choice(names))) for _ in range(n)]
    a, b = make(90, ["r1", "r2"]), make(60, [f"g{k}" for k in range(30)])
    a, b = a + a[:5], b + b[:5]
    fa, fb = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    low, strands = [0, 1, 7, 25][seed], seed % 2 == 0
    want = defaultdict(lambda: [0, 0])
    for x in a:
        for y in b:
            if None in (x[0], y[0], *x[2:4], *y[2:4]) or x[0] != y[0] or (strands and x[1] != y[1]):
                continue
            if (bp := min(x[3], y[3]) - max(x[2], y[2])) >= max(1, low):
                want[y[4]][0] += 1
                want[y[4]][1] += bp
    got = [tuple(r) for r in transcripts.intersect_counts(fa, fb, strands, low).collect()]
    assert len(want) >= 8
    assert sorted(got, key=str) == sorted(((k, *v) for k, v in want.items()), key=str)
    pairs = transcripts.intersect_pairs(fa, fb, strands, low).groupBy("b_name").agg(F.count("*"), F.sum("overlap_bp"))
    assert sorted(got, key=str) == sorted((tuple(r) for r in pairs.collect()), key=str)


def test_counts_by_a_key(spark):
    a = spark.createDataFrame([("c1", 0, 10), ("c1", 5, 20), ("c2", 0, 4)], "contig string, start long, end long")
    b = spark.createDataFrame([("c1", 8, 12, 1), ("c1", 30, 40, 2), ("c2", 3, 9, 1)], "contig string, b_start long, b_end long, kind int")
    got = ranges.overlap_counts(a, b, ["contig"], ["contig", "kind"])
    assert sorted(tuple(r) for r in got.collect()) == [("c1", 1, 2, 6), ("c2", 1, 1, 1)]
    assert ranges.overlap_counts(a.limit(0), b, ["contig"], ["kind"]).count() == 0


def most_rows(spark, run):
    """The result of ``run`` and the most rows that any step of any of its plans put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for k in range((all_ := store.executionsList()).size()):
        if (i := all_.apply(k).executionId()) in before:
            continue
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            for m in (node.metrics().apply(n) for n in range(node.metrics().size())):
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    most = max(most, int(v.get().replace(",", "")))
    return out, most


def test_a_pile_of_reads_and_genes_makes_no_pairs(spark, tmp_path):
    """400 reads and 300 genes at one place: 120,000 pairs, of which the query makes none."""
    spark.range(400).selectExpr("id * 4 as l_orderkey", "200 * id as l_partkey", "0L as l_suppkey", "'A' as l_returnflag", "20.0D as l_quantity", "3 as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("200 * id as p_partkey", "3 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    rows, most = most_rows(spark, lambda: registry.QUERIES["intersect_transcripts"](spark, str(tmp_path)).collect())
    # reads lie at [0, 1000), genes at [30, 430)
    assert sorted(tuple(r) for r in rows) == sorted((f"g{200 * k}", 400, 400 * 400) for k in range(300))
    assert 800 <= most <= 1400
