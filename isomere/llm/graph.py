"""A flat, robust-pruned neighbour graph for cosine range search, on numpy.

Built without comparing all pairs: points go in by batches, each searched for
greedily from the medoid in the graph of those before it, what the search met
is robust-pruned to the point's edges, and edges back are pruned again where a
node has too many.
"""
from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA = 24, 40, 1.2


def _chord(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * sims))


def prune(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidate lists (nearest first, -1 for none): (n, degree), -1 for none.

    A candidate goes if a kept one is nearer to it, by the factor alpha, than
    the point itself is; distances are chords.
    """
    n, c = ids.shape
    out = np.full((n, degree), -1, np.int32)
    alive = ids >= 0
    dist = _chord(sims)
    rows = np.arange(n)
    vec = x[np.maximum(ids, 0)]
    for k in range(min(degree, c)):
        some = np.flatnonzero(alive.any(1))
        if not len(some):
            break
        best = alive[some].argmax(1)
        out[some, k] = ids[some, best]
        between = _chord(np.einsum("ncd,nd->nc", vec[some], vec[some, best]))
        alive[some] &= ~(alpha * between <= dist[some])
        alive[some, best] = False
    return out


def _ranked(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best different ids of each row, nearest first, -1 for none."""
    order = np.lexsort((ids, -sims))
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    # equal ids have equal similarities, so they stand together
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(again | (ids < 0), -3.0, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2.5, ids, -1), sims


def search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, start: int, beam: int = BEAM, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of each query from ``start``: (ids, similarities) of the nearest met, nearest first, -1 for none."""
    n = len(q)
    ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -3.0)
    ids[:, 0], sims[:, 0] = start, q @ x[start]
    done = np.zeros((n, len(x)), bool)  # expanded
    live = np.arange(n)
    while len(live):
        open_ = (ids[live] >= 0) & ~done[live[:, None], np.maximum(ids[live], 0)]
        has = open_.any(1)
        live, open_ = live[has], open_[has]
        if not len(live):
            break
        first = np.argsort(~open_, axis=1, kind="stable")[:, :at_once]
        picked = np.where(np.take_along_axis(open_, first, 1), np.take_along_axis(ids[live], first, 1), -1)
        row, col = np.nonzero(picked >= 0)
        done[live[row], picked[row, col]] = True
        near = np.where(picked[:, :, None] >= 0, adj[np.maximum(picked, 0)], -1).reshape(len(live), -1)
        s = np.where(near >= 0, np.einsum("qd,qkd->qk", q[live], x[np.maximum(near, 0)]), -3.0)
        ids[live], sims[live] = _ranked(np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1), beam)
    return ids, sims


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax()) if len(x) else -1


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 1) -> np.ndarray:
    """Adjacency (n, degree) of unit vectors, -1 for none, grown from the medoid."""
    n = len(x)
    adj = np.full((n, degree), -1, np.int32)
    if n < 2:
        return adj
    start = medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + max(8, min(256, at // 4))]
        ids, sims = search(x, adj, x[batch], start, beam)
        # those that come in together see each other as well
        own = x[batch] @ x[batch].T
        own[np.arange(len(batch)), np.arange(len(batch))] = -3.0
        ids, sims = _ranked(np.concatenate([ids, np.where(own > -2.5, batch[None], -1)], 1), np.concatenate([sims, own], 1), beam)
        adj[batch] = prune(x, ids, sims, degree)
        back(x, adj, batch)
        at += len(batch)
    return joined(x, adj, start, beam)


def reached(adj: np.ndarray, start: int) -> np.ndarray:
    """Which nodes the edges lead to from ``start``."""
    seen = np.zeros(len(adj), bool)
    at = np.array([start])
    while len(at):
        seen[at] = True
        at = np.unique(adj[at])
        at = at[at >= 0]
        at = at[~seen[at]]
    return seen


def joined(x: np.ndarray, adj: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Adds edges in further columns, until all nodes can be reached, from the nearest that can be."""
    seen = reached(adj, start)
    while not seen.all():
        lost = np.flatnonzero(~seen)
        ids, _ = search(x, adj, x[lost], start, beam)
        # one new edge a node in each round
        extra = np.full(len(adj), -1, adj.dtype)
        for node, near in zip(lost.tolist(), ids.tolist(), strict=True):
            at = next((v for v in near if v >= 0 and extra[v] < 0), -1)
            if at >= 0:
                extra[at] = node
        adj = np.concatenate([adj, extra[:, None]], 1)
        seen = reached(adj, start)
    return adj


def back(x: np.ndarray, adj: np.ndarray, batch: np.ndarray) -> None:
    """Edges back to ``batch`` from the nodes it points to; nodes with too many are pruned anew."""
    src, col = np.nonzero(adj[batch] >= 0)
    dst, src = adj[batch][src, col].astype(np.int64), batch[src]
    order = np.argsort(dst, kind="stable")
    dst, src = dst[order], src[order]
    nodes, first, size = np.unique(dst, return_index=True, return_counts=True)
    new = np.full((len(nodes), int(size.max(initial=0))), -1, np.int64)
    new[np.repeat(np.arange(len(nodes)), size), np.arange(len(dst)) - np.repeat(first, size)] = src
    for a in range(0, len(nodes), 128):
        some = nodes[a : a + 128]
        ids = np.concatenate([adj[some].astype(np.int64), new[a : a + 128]], 1)
        sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", x[some], x[np.maximum(ids, 0)]), -3.0)
        ids, sims = _ranked(ids, sims, ids.shape[1])
        keep = ids[:, : adj.shape[1]]
        full = (ids >= 0).sum(1) > adj.shape[1]
        if full.any():
            keep = keep.copy()
            keep[full] = prune(x, ids[full], sims[full], adj.shape[1])
        adj[some, : keep.shape[1]] = keep


def expand(x: np.ndarray, adj: np.ndarray, q: np.ndarray, seeds: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Range expansion: the (query, node) pairs reached from ``seeds`` (ids for each query, -1 for none) through nodes of cosine ``low`` or more."""
    seen = np.zeros((len(q), len(x)), bool)
    qi, col = np.nonzero(seeds >= 0)
    ni = seeds[qi, col].astype(np.int64)
    while len(qi):
        code = np.unique(qi * len(x) + ni)
        qi, ni = code // len(x), code % len(x)
        fresh = ~seen[qi, ni]
        qi, ni = qi[fresh], ni[fresh]
        seen[qi, ni] = True
        good = np.concatenate([np.einsum("kd,kd->k", q[qi[b : b + 8192]], x[ni[b : b + 8192]]) for b in range(0, len(qi), 8192)]) >= low if len(qi) else np.zeros(0, bool)
        qi, near = qi[good], adj[ni[good]]
        qi, ni = np.repeat(qi, near.shape[1]), near.ravel().astype(np.int64)
        ok = ni >= 0
        qi, ni = qi[ok], ni[ok]
        ok = ~seen[qi, ni]
        qi, ni = qi[ok], ni[ok]
    return np.nonzero(seen)
