import random

import pytest
from tests.model import cluster as plain
from tests.model import peaks as plain_peaks

from isomere.operators import cluster, missed
from isomere.operators.components import components

SCHEMA = "contig string, strand string, start long, end long, id string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def units(spark, rows, p=cluster.ClusterParams(), **more):
    c = cluster.cluster(frame(spark, rows), p, **more)
    return sorted((r.contig, r.strand, r.start, r.end, r.n_reads) for r in c.tus.collect())


BASIC = [("chr1", "+", 100, 200, "r1"), ("chr1", "+", 101, 201, "r2"), ("chr1", "+", 120, 180, "r3"), ("chr1", "+", 300, 400, "r4"), ("chr1", "+", 301, 401, "r5"), ("chr1", "+", 320, 360, "r6"), ("chr1", "-", 100, 200, "r7")]


@pytest.mark.parametrize("t2", [0.8, 0.99])
def test_seven_reads(spark, t2):
    c = cluster.cluster(frame(spark, BASIC), cluster.ClusterParams(t2=t2))
    assert [tuple(r) for r in c.tus.select("tu_id", "start", "end", "strand", "n_reads").orderBy("tu_id").collect()] == [
        ("TU000001", 100, 200, "+", 2), ("TU000002", 120, 180, "+", 1), ("TU000003", 300, 400, "+", 2), ("TU000004", 320, 360, "+", 1), ("TU000005", 100, 200, "-", 1),
    ]
    m = {r.id: (r.tu_id, round(r.score1, 6), round(r.score2, 6)) for r in c.membership.collect()}
    assert m["r2"] == ("TU000001", 0.980198, 0.99) and m["r5"] == ("TU000003", 0.980198, 0.99) and m["r7"] == ("TU000005", 1, 1)


def test_minimum_numbers_anew(spark):
    c = cluster.cluster(frame(spark, BASIC), cluster.ClusterParams(t2=0.99), min_count=2)
    assert sorted((r.tu_id, r.start) for r in c.tus.collect()) == [("TU000001", 100), ("TU000002", 300)]
    assert {r.id for r in c.membership.collect()} == {"r1", "r2", "r4", "r5"}


CASES = [
    ([(108, 200), (100, 200), (101, 201)], "+", dict(t2=0.9), 1),
    ([(108, 200), (100, 200), (101, 201)], "+", dict(t2=0.9, attach=False), 2),
    ([(100, 205), (112, 210)], "+", dict(t2=0.6), 1),
    ([(100, 205), (112, 210)], "+", dict(t2=0.6, tolerance=0), 2),
    ([(100, 205), (108, 210)], "-", dict(t2=0.6), 1),
    ([(100, 205), (120, 218)], "+", dict(t2=0.6), 2),
    ([(100, 205), (150, 210)], "+", dict(t2=0.6), 2),
    ([(100, 205), (150, 210)], "+", dict(t2=0.6, max_five=50), 1),
    ([(100, 205), (105, 155)], "-", dict(t2=0.6), 2),
    ([(100, 205), (105, 155)], "-", dict(t2=0.6, max_five=50), 1),
    ([(100, 205), (150, 210)], "+", dict(t2=0.6, max_five=40), 2),
    ([(100, 205), (120, 210)], "+", dict(t2=0.6, max_five=10), 1),
    ([(100, 190), (101, 205)], "+", dict(t2=0.8), 2),
]


@pytest.mark.parametrize("spans,strand,options,want", CASES)
def test_attachment(spark, spans, strand, options, want):
    rows = [("c", strand, a, b, f"r{k}") for k, (a, b) in enumerate(spans, 1)]
    p = cluster.ClusterParams(**options)
    import numpy as np

    s, e = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    _, unit = cluster.solve_island(s, e, [r[4] for r in rows], strand == "-", p)
    assert len(set(unit.tolist())) == want


def random_reads(rng, n):
    out = []
    for k in range(n):
        a = rng.randint(0, 300)
        out.append((rng.choice(["c1", "c2"]), rng.choice("+-."), a, a + rng.choice([1, 5, 60, 100, 104, 110, rng.randint(1, 200)]), f"r{k:03d}"))
    return out


@pytest.mark.parametrize("seed,options", [(1, {}), (2, dict(t1=0.6, t2=0.5)), (3, dict(t1=0.3, t2=0.9, max_five=30)), (4, dict(t1=1.0, t2=0.7, tolerance=0)), (5, dict(t1=0.0))])
def test_both_ways_equal_the_model(spark, seed, options):
    rows = random_reads(random.Random(seed), 220)
    p = cluster.ClusterParams(**options)
    want = plain(rows, p.t1, p.t2, p.tolerance, p.max_five)
    assert units(spark, rows, p) == want
    assert units(spark, rows, p, island=0) == want
    # islands found bin by bin and dealt to tasks
    assert units(spark, rows, p, whole=0) == want and units(spark, rows, p, whole=0, island=3) == want


def test_island_solver_equals_the_model():
    import numpy as np

    rng = random.Random(9)
    for _ in range(150):
        rows = sorted({(rng.randint(0, 40), rng.randint(1, 40)) for _ in range(rng.randint(1, 14))})
        strand = rng.choice("+-.")
        reads = [("c", strand, a, a + n, f"r{rng.randint(0, 999):03d}_{a}_{n}") for a, n in rows]
        p = cluster.ClusterParams(rng.choice([0.3, 0.5, 0.8, 0.95]), rng.choice([0.2, 0.6, 0.9]), tolerance=rng.choice([0, 3, 12]), max_five=rng.choice([None, 0, 5]))
        s, e = np.array([r[2] for r in reads]), np.array([r[3] for r in reads])
        _, unit = cluster.solve_island(s, e, [r[4] for r in reads], strand == "-", p)
        got = {}
        for u in unit.tolist():
            got[u] = got.get(u, 0) + 1
        assert sorted(("c", strand, int(s[u]), int(e[u]), n) for u, n in got.items()) == plain(reads, p.t1, p.t2, p.tolerance, p.max_five)


def test_wrong_parameters():
    for bad in (dict(t1=1.5), dict(t2=-0.1), dict(tolerance=-1), dict(max_five=-1)):
        with pytest.raises(ValueError):
            cluster.ClusterParams(**bad)
    cluster.ClusterParams(t2=7, attach=False)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5040)] + [(7, None), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            root[find(a)] = find(b)
    groups = {}
    for n in got:
        groups.setdefault(find(n), set()).add(got[n])
    assert set(got) == set(root) and all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_peaks_equal_the_model():
    rng = random.Random(6)
    for _ in range(400):
        h = {rng.randint(0, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}
        minus, w, k = rng.random() < 0.5, rng.choice([0, 3, 10]), rng.choice([1, 2, 3])
        assert missed._peaks(h, minus, w, k) == plain_peaks(h, minus, w, k)


def test_no_cross_join_in_the_plans(spark):
    from isomere.plans import registry

    for name in ("overlap_join", "seed_edges", "seed_edges_low", "tu_gene_overlap"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
