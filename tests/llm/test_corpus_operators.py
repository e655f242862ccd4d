"""Mixing, near-duplicates, repeats, embeddings, fingerprints and the pipeline."""
import hashlib
import random
import re
import struct
import tempfile
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from isomere.llm import embed_dedup, graph, induced, mixing, repeats, simhash, syncmers

SMALL = "/root/testdata/sf0.001"


def groups(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def divisor_seats(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_apportion_equals_seat_by_seat(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        w = [rng.choice([0, 1, 5, 7, 30, 200, 1000]) for _ in range(rng.randint(1, 9))]
        n = rng.choice([0, 1, 3, 40, 333])
        if sum(w) == 0:
            n = 0
        rows += [(g, k, x, n) for k, x in enumerate(w)]
        want |= {(g, k): s for k, s in enumerate(divisor_seats(w, n))}
    df = spark.createDataFrame(rows, "g int, k int, w long, seats long")
    assert {(r.g, r.k): r.got for r in mixing.apportion(df, "w", "seats", ["g"], "k", "got").collect()} == want


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 300])), rng.choice(["b", "a", "é", "Z", None, "a"])) for i in range(300)] + [(7, None, "a"), (7, None, "a"), (None, "x y", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(mixing.sized(df)).select("id", "source", "size", "source_size", "target", "taken").collect()
    sizes, taken = Counter(), Counter()
    for r in plan:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = targets_by_hand(sizes)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 40 for s in want)
    again = mixing.mixed(df).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixing.mixed(df.repartition(7)).collect()))
    words = Counter()
    for r in mixing.texts(df).collect():
        words[r.source] += len(r.text.split())
    assert words == +taken
    assert mixing.mixed(df.limit(0)).count() == 0


def test_simhash_trees_find_all_groups():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 600, dtype=np.uint64)
    near = base.copy()
    for _ in range(4):
        near = np.where(rng.random(600) < 0.7, near ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)), near)
    dense = np.uint64(12345678901234567) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near, dense]))
    found = []
    for half in (0, 1):
        tree = simhash.grow(rng.choice(x, 500, replace=False), half, 60)
        row, leaf, own = simhash.route(tree, x, np.ones(len(x), bool))
        assert sorted(row[own]) == list(range(len(x)))
        for v in np.unique(leaf):
            at = row[leaf == v]
            i, j = simhash.forest(x[at], own[leaf == v], half)
            assert (np.bitwise_count(x[at[i]] ^ x[at[j]]) >= 0).all()
            found += zip(at[i].tolist(), at[j].tolist(), strict=True)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    assert groups(len(x), found) == groups(len(x), zip(i.tolist(), j.tolist(), strict=True))


def test_simhash_dense_ball_and_deeper_shards(spark):
    rng = np.random.default_rng(2)
    centre = np.uint64(0x123456789ABCDEF0)
    ball = np.full(6000, centre)
    for _ in range(4):
        ball ^= np.uint64(1) << rng.integers(0, 64, 6000, dtype=np.uint64)
    x = np.unique(np.concatenate([ball, rng.integers(0, 2**64, 3000, dtype=np.uint64)]))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= 3) for v in x]
    want = groups(len(x), [(i, int(j)) for i, js in enumerate(near) for j in js if j > i])
    found = [simhash.forest(x, np.ones(len(x), bool), half) for half in (0, 1)]
    assert all(len(i) < len(x) for i, _ in found) and groups(len(x), [e for i, j in found for e in zip(i.tolist(), j.tolist(), strict=True)]) == want
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    # a driver's tree of few points, shards cut again by trees of their own
    got = simhash.links(df, shard=3000, sample=64, large=1200, again=400).collect()
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    assert groups(len(x), [(at[r.a], at[r.b]) for r in got]) == want
    sizes = simhash._deeper(spark.createDataFrame([("0.0", int(v), True) for v in x.view(np.int64)], simhash.ROWS), 1, 1200, 2000)[1].groupBy("shard").count().collect()
    assert len(sizes) > 1


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1003, "one"), (1004, "two words"), (1005, "x " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.dedup(df).select("doc_id", simhash.hexed().alias("h"), "component_id").collect()
    fp = [simhash.fingerprint(t) for _, t in rows]
    x = np.array(fp, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    root = groups(len(x), zip(i.tolist(), j.tolist(), strict=True))
    least = defaultdict(lambda: 10**9)
    for k, (d, _) in enumerate(rows):
        least[root[k]] = min(least[root[k]], d)
    want = Counter((d, f"{fp[k]:016x}", least[root[k]]) for k, (d, _) in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert simhash.dedup(df.limit(0)).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, a = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        t = np.append(rng.integers(1, a + 1, n), 0).astype(np.uint16)
        sa, s = induced.suffix_array(t, a + 1), t.tolist()
        want = sorted(range(n + 1), key=lambda i: s[i:])
        assert sa.tolist() == want
        _, shared = induced.common_prefixes(t, sa)
        for x, y in zip(want, want[1:], strict=False):
            k = 0
            while max(x, y) + k < n + 1 and s[x + k] == s[y + k]:
                k += 1
            assert shared[y] == k


def removed_by_hand(texts, w=repeats.WINDOW):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                hit[i : i + w] = b"\1" * w
        kept = bytes(b for b, h in zip(r, hit, strict=True) if not h)
        spans = sum(1 for i in range(len(r)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 4])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", 20)
    rng = random.Random(3)
    p = "the quick brown fox jumps over lazy dogs again and again " * 3 + "".join(rng.choice("abcdef ") for _ in range(300))
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 700))) + p[rng.randint(0, 60) : rng.randint(350, len(p))] + "".join(rng.choice("éabc ") for _ in range(rng.randint(0, 300))) for _ in range(100)]
    texts += ["ab" * 400, "ba" * 500, "a" * 900, "Of " * 150, None, "", None, p, p, p]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal(df).collect()}
    assert got == dict(enumerate(removed_by_hand(texts)))


def test_repeats_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (3, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.removal(df).collect()) == [(1, 0, 0), (2, 0, 0), (3, 5, 0), (3, 5, 0)]
    assert repeats.removal(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "x", "é" * 300 + "tail", 304), (2, "y", "é" * 300 + "end", 303)], "doc_id long, key string, text string, n_chars long")
    got = {r.doc_id: r for r in repeats.cleaned(odd).collect()}
    assert got[1].text == "tail" and got[1].n_chars == 4 and got[2].key == "y"


def test_repeats_in_long_texts_and_names(spark, monkeypatch):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    texts = [long[:65_400] + passage + long[65_400:], "x" * 150 + passage, long[200_000:200_350] + "unlike", "é" * 100_000]
    df = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in "abcdefghijk"]) for k, t in enumerate(texts)], "doc_id long, text string, key string, _key string, _runs string, runs string, row string, k1 string, k2 string, n string, tid string, h string, at string")
    by_hand = removed_by_hand(texts)
    assert {r.doc_id: tuple(r)[1:] for r in repeats.removal(df).collect()} == dict(enumerate(by_hand))
    got = {r.doc_id: r for r in repeats.cleaned(df).collect()}
    assert all(tuple(got[k])[2:] == tuple(f"{c}{k}" for c in "abcdefghijk") for k in range(4))
    assert repeats.cleaned(df).columns == df.columns and len(got[1].text) == by_hand[1][0] - by_hand[1][1]


def test_scan_of_a_long_text_in_bounded_memory():
    raw = np.random.default_rng(1).integers(97, 123, 6_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    work = repeats._Scan()
    work.add(7, raw)
    work.flush()
    rows = work.take()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.num_rows > 50_000 and {7} == set(rows.column(0).unique().to_pylist())
    assert peak < 40e6  # segments, at 40 bytes each, and a piece of 64 kB at work
    # the segments cover every window start once, in order
    at = rows.column(4).to_numpy()
    first, more = at >> 11, (at >> 1) & 1023
    assert first[0] == 0 and (first[1:] == first[:-1] + more[:-1] + 1).all() and first[-1] + more[-1] == len(raw) - repeats.WINDOW


def links_by_hand(rows, threshold=0.93):
    fine = [i for i, (_, e, l) in enumerate(rows) if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = [(0, r[0]) for r in rows]
    by = defaultdict(list)
    for i in fine:
        by[rows[i][2], len(rows[i][1])].append(i)
    for v in by.values():
        x = np.array([rows[i][1] for i in v], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        m = x @ x.T >= threshold
        np.fill_diagonal(m, True)
        low = np.array([rows[i][0] for i in v])
        while not np.array_equal(new := np.array([low[r].min() for r in m]), low):
            low = new
        for k, i in enumerate(v):
            out[i] = int(m[k].sum()) - 1, int(low[k])
    return out


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 32))
    x[300:700] = x[0] + 0.08 * rng.normal(size=(400, 32))
    x[700:] = x[rng.integers(1, 300, 200)] + 0.1 * rng.normal(size=(200, 32))
    rows = [(i, v.tolist(), int(i % 2) if i < 700 else 0) for i, v in enumerate(x)] + [(2000, x[5].tolist(), 1), (2001, x[5].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [tuple(r) for r in df.collect()]
    want = links_by_hand(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.dedup(df, shard=100).collect()}
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want)
    assert all(got[r[0]][0] <= n for r, (n, _) in zip(rows, want, strict=True))
    assert sum(got[r[0]][1] == c for r, (_, c) in zip(rows, want, strict=True)) >= 0.98 * len(rows)


def test_embeddings_of_tight_groups_near_each_other():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([c + 0.0025 * rng.normal(size=(60, 64)) for c in (centre + 0.028 * rng.normal(size=(6, 64)))] + [rng.normal(size=(100, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    assert want[:60, 60:360].any() and (embed_dedup.near_pairs(x, 0.93) == want).all() and (embed_dedup.near_pairs(x, 0.93, exact=True) == want).all()


def test_graph_is_grown_by_search_and_found_again():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 1500)] + 0.2 * rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    adj = graph.build(x)
    assert adj.shape[0] == 1500 and graph.DEGREE <= adj.shape[1] < graph.DEGREE + 10 and (adj < 1500).all() and (adj != np.arange(1500)[:, None]).all()
    assert graph.reached(adj, graph.medoid(x)).all()
    ids, sims = graph.search(x, adj, x, graph.medoid(x))
    assert (ids[:, 0] == np.arange(1500)).mean() > 0.99 and (np.diff(sims, axis=1) <= 1e-12).all()
    want = x @ x.T >= 0.9
    i, j = graph.expand(x, adj, x, ids[:, :16], 0.85)
    seen = np.zeros_like(want)
    seen[i, j] = True
    assert (seen & want).sum() >= 0.99 * want.sum() and seen.mean() < 0.2


def test_many_near_vectors_in_bounded_memory():
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + 0.1 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    hits = embed_dedup.near_pairs(x, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hits.sum() == 3000 * 2999 and peak < 100e6


def test_embeddings_of_parts_and_a_failed_audit(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=8) + 0.25 * rng.normal(size=(250, 8)), rng.normal(size=(150, 8))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = [n for n, _ in links_by_hand(rows)]
    monkeypatch.setattr(embed_dedup, "PART", 60)
    assert [r.n_links for r in embed_dedup.dedup(df).orderBy("vec_id").collect()] == want
    # if the search finds nothing, the audit sees it and everything is compared
    calls = []

    def blind(x, threshold, exact=False, real=embed_dedup.near_pairs):
        calls.append(exact)
        return real(x, threshold, True) if exact else np.zeros((len(x), len(x)), bool)

    nodes = spark.createDataFrame([(i, "8:0", 1, v.tolist()) for i, v in enumerate(x)], "node long, space string, copies long, vec array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(unit @ unit.T >= 0.93)
    half = spark.createDataFrame([(int(a), int((i == a).sum()) // 2) for a in range(len(x))], "a long, n long")
    assert 0.3 < embed_dedup.audited(nodes, half, 0.93) < 0.6
    full = spark.createDataFrame([(int(a), int((i == a).sum()) - 1) for a in range(len(x))], "a long, n long")
    assert embed_dedup.audited(nodes, full, 0.93) == 1.0


def test_embeddings_across_shards(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "GUESTS", 100, raising=False)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(1500, 6)))] + [(5000, [1.0] * 6, 0), (5001, [2.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = links_by_hand(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.dedup(df, shard=80).collect()}
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want)
    assert all(got[r[0]][0] <= n for r, (n, _) in zip(rows, want, strict=True))
    assert sum(got[r[0]][1] == c for r, (_, c) in zip(rows, want, strict=True)) >= 0.98 * len(rows)


def test_guests_reach_every_shard_of_a_link():
    rng = np.random.default_rng(7)
    for dims in (3, 8, 64):
        x = embed_dedup._unit(rng.normal(size=(1200, min(dims, 8))) @ rng.normal(size=(min(dims, 8), dims)))
        c = embed_dedup.centroids(x, 20)
        s = x @ c.T
        at = s.argmax(1)
        width = np.array([np.arccos(np.clip(s[at == k, k].min(), -1, 1)) if (at == k).any() else 0 for k in range(len(c))])
        seen = set(zip(*(v.tolist() for v in embed_dedup.visits(x, at, c, width, 0.93)), strict=True))
        i, j = np.nonzero(x @ x.T >= 0.93)
        assert len(c) > 3 and all(((a, at[b]) in seen) != ((b, at[a]) in seen) for a, b in zip(i.tolist(), j.tolist(), strict=True) if at[a] != at[b])


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.1], 1), (11, [1e30, 0.0], 1), (11, [1e30, 0.0], 1), (12, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: tuple(r)[1:] for r in embed_dedup.dedup(df).collect()}
    assert got == {i: (5, 1, i == 1) if i in (1, 2, 9, 10, 11) else (0, i, True) for i in range(1, 13)}
    assert embed_dedup.dedup(df.limit(0)).count() == 0


def tokens_by_hand(text):
    """Words of at most 16 characters; longer runs cut after single characters beyond ASCII and after those of the cut list."""
    cut = set("aeiouAEIOU01234/._=&?%-")
    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        if len(run) <= syncmers.TOKEN:
            out.append(run)
            continue
        held = ""
        for c in run:
            if ord(c) > 127:
                out += [held, c] if held else [c]
                held = ""
            else:
                held += c
                if c in cut or len(held) == syncmers.TOKEN:
                    out.append(held)
                    held = ""
        out += [held] if held else []
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def syncmers_by_hand(text):
    """The run hashes of a text, by the rule; hashes chain as Spark's do."""
    k, s = syncmers.K, syncmers.S
    h64 = lambda data, seed: signed(xxhash.xxh64_intdigest(data, seed & (2**64 - 1)))
    t = [h64(w.encode(), 42) for w in tokens_by_hand(text)]

    def whole(run):
        seed = 42
        for x in run:
            seed = h64(struct.pack("<q", x), seed)
        return seed & 0xFFFFFFFF

    if len(t) < k:
        return [whole(t)] if t else []
    inner = [a ^ (b >> 1) for a, b in zip(t, t[1:], strict=False)]
    return [whole(t[i : i + k]) for i in range(len(t) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


def likeness_by_hand(a, b):
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS", 20)
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    odd = ["中文" * 40 + "x", "http://example.org/" + "a1b2" * 30, "y" * 200, "ё" * 50 + " end", "", None, "B" * 17 + "é" + "zzz.zzz" * 5, "\x00\x1f" * 20]
    df = df.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(odd)], df.schema))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    ids = sorted(texts, reverse=True)
    written = lambda runs: "".join(f"{x:08x}" for x in runs)
    got = {r.doc_id: r for r in syncmers.compared(df).collect()}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        own, edit, next_ = (syncmers_by_hand(x) for x in (t, edited, after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (written(own), written(edit))
        assert got[i].near_edited == pytest.approx(likeness_by_hand(own, edit)) and got[i].near_next == pytest.approx(likeness_by_hand(own, next_))
    long = [i for i in ids if len(texts[i]) > 400 and i < 10_000]
    assert np.mean([got[i].near_edited for i in long]) > 0.25 > 0.05 > np.mean([got[i].near_next for i in long])
    # one character put before a text changes what is near it alone, with and without white space
    for letters in ("".join(map(chr, range(0x4E00, 0x4F00))), "abcdefghijklmnopqrstuvwxyz0123456789/.", "abcdefghij klmno "):
        t = "".join(rng.choice(letters) for _ in range(3000))
        pair = spark.createDataFrame([("b", t), ("a", "X" + t)], "doc_id string, text string")
        assert {r.doc_id: r.near_next for r in syncmers.compared(pair).collect()}["b"] > 0.95


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b c"), (3, "x " * 50), (4, "y" * 5000)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_chars, r.near_edited) for r in syncmers.compared(df).collect()))
    assert [x[:2] for x in got] == [(-1, 5), (1, 0), (2, 0), (2, 0), (3, 100), (4, 5000)]
    assert syncmers.compared(df.limit(0)).count() == 0 and syncmers.compared(df.limit(1)).count() == 1


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    from isomere.llm import stages

    rng = random.Random(9)
    a, b, c = (" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(200)) for _ in range(3))
    rows = [(1, a, "en"), (1, a, "en"), (None, a, "en"), (None, b, "de"), (None, b, "de"), (2, c, "fr"), (2, a.upper(), "en"), (4, c, "fr"), (3, None, "en"), (None, "", "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for some in (df, df.repartition(5)):
        assert Counter(map(tuple, stages.simhash(spark, some, SMALL).collect())) == Counter([(1, a, "en"), (None, b, "de"), (2, c, "fr"), (3, None, "en")])
    # none of the repeated documents is lost to the later stages
    left = stages.repeats(spark, stages.simhash(spark, df, SMALL), SMALL).collect()
    assert {r.text for r in left} == {a, b, c, None}
    assert stages.simhash(spark, df.limit(0), SMALL).count() == 0


CLASHES = ["target", "sid", "source_size", "shards", "nb", "_nb", "taken", "shard", "size", "_size", "score", "_score", "_key", "_runs", "key", "row", "text_", "fp", "number", "id", "place", "extra", "runs", "pass"]


def test_stages_keep_columns_of_any_name(spark):
    from isomere.llm import stages

    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["sun", "moon", "a", "of", "stars"]) + str(rng.randint(0, 99)) for _ in range(60)), rng.choice("ab"), 7, *[f"{c}{k}" for c in CLASHES]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    df.select(F.col("doc_id"), (F.col("doc_id") % 2).cast("int").alias("quality")).write.mode("overwrite").parquet(f"{(d := tempfile.mkdtemp())}/labels.parquet")
    for stage in (stages.quality, stages.simhash, stages.repeats, stages.mix):
        out = stage(spark, df, d)
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES)
    assert stages.mix(spark, df, d).count() >= 40


def mix_by_hand(rows):
    """(id, text) of each pass over (id, text, source) rows, each id once: the operator's rule seat by seat."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = {k: len(word.findall(t or "")) for k, t, _ in rows}
    place = {k: hashlib.md5(f"mix-1{k}".encode()).hexdigest() for k, _, _ in rows}
    total = Counter()
    for k, _, s in rows:
        total[s] += size[k]
    want = targets_by_hand(total)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    seats = dict(zip(names, divisor_seats([want[s] for s in names], int(sum(total.values()) * 1.5 / 16 + 0.5)), strict=True))
    out = []
    for s in names:
        shards = 1 if total[s] <= mixing.SHARD_WORDS else 2 ** ((total[s] - 1) // mixing.SHARD_WORDS).bit_length()
        members = defaultdict(list)
        for k, t, source in rows:
            if source == s:
                members[int(place[k][:8], 16) % mixing.FINE % shards].append((place[k], k, t))
        words = [sum(size[k] for _, k, _ in members[h]) for h in range(shards)]
        for h, quota in enumerate(divisor_seats(words, seats[s])):
            n = -(-words[h] // 16)
            quota, at = min(quota, 2 * n), 0
            seed = int(hashlib.md5(f"mix-1/{s or ''}/{h}".encode()).hexdigest()[:8], 16) % max(n, 1)
            more = [((j + 1) * (quota % n) + seed) // n > (j * (quota % n) + seed) // n for j in range(n)]
            for _, k, t in sorted(members[h]):
                spans = [m.span() for m in word.finditer(t or "")]
                ends = [b for b, _ in spans[1:]] + [len(t or "")]
                some = [t[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if more[(at + i) // 16]]
                for _ in range(quota // n if n and spans else 0):
                    out.append((k, t))
                if some:
                    out.append((k, t if len(some) == len(spans) else "".join(some)))
                at += len(spans)
    return out


def test_pipeline(spark):
    """The rows of run() against each stage by brute force."""
    import base64

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from isomere.llm import stages

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = stages.quality(spark, docs, d).cache()
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(i in ids for i, q in labels.items() if q) >= 0.99 * sum(labels.values())
    rows = kept.select("doc_id", "text", "source").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    x = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    first = {}
    for r, g in zip(rows, groups(len(rows), zip(i.tolist(), j.tolist(), strict=True)), strict=True):
        if g not in first or r.doc_id < first[g].doc_id:
            first[g] = r
    alone = list(first.values())
    cut = cut_by_hand([r.text for r in alone])
    mixed = mix_by_hand([(r.doc_id, t, r.source) for r, t in zip(alone, cut, strict=True)])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((k, len(got), sha(" ".join(map(str, got)).encode()), sha(t.encode())) for k, t in mixed for got in [coder.encode_ordinary(t)])
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, out.collect())) == want


def cut_by_hand(texts, w=repeats.WINDOW):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for t, r in zip(texts, raws, strict=True):
        hit = bytearray(len(r))
        for i in range(len(r) - w + 1):
            if seen[r[i : i + w]] > 1:
                hit[i : i + w] = b"\1" * w
        out.append(t if not any(hit) else bytes(b for b, h in zip(r, hit, strict=True) if not h).decode(errors="ignore"))
    return out
