"""A small classification tree (Gini splits) for tables of a few hundred rows."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    value: float  # share of positive rows
    feature: int = -1  # -1 for a leaf
    cut: float = 0.0  # left: feature <= cut
    left: "Node | None" = None
    right: "Node | None" = None


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 8) -> Node:
    """Grows a tree; equal gains go to the first feature and the lowest cut."""
    n, pos = len(rows), sum(labels)
    if depth == 0 or pos in (0, n):
        return Node(pos / n if n else 0.0)
    best = None
    base = pos * (n - pos) / n
    for f in range(len(rows[0])):
        order = sorted(range(n), key=lambda i: rows[i][f])
        seen = 0
        for k, i in enumerate(order[:-1], 1):
            seen += labels[i]
            a, b = rows[i][f], rows[order[k]][f]
            if a == b:
                continue
            gain = base - seen * (k - seen) / k - (pos - seen) * (n - k - pos + seen) / (n - k)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = gain, f, (a + b) / 2
    if best is None:
        return Node(pos / n)
    _, f, cut = best
    side = [[i for i in range(n) if (rows[i][f] <= cut) == left] for left in (True, False)]
    return Node(pos / n, f, cut, *(grow([rows[i] for i in s], [labels[i] for i in s], depth - 1) for s in side))


def predict(node: Node, row: tuple[float, ...]) -> float:
    while node.feature >= 0:
        node = node.left if row[node.feature] <= node.cut else node.right  # type: ignore[assignment]
    return node.value
