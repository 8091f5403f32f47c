"""Guide trees of one family: agglomeration, orders to join in, permutations."""

from __future__ import annotations

import numpy as np


def agglomerate(d: np.ndarray, linkage: str = "biased") -> list[tuple[int, int, float]]:
    """Joins (left, right, height): leaves are 0..n-1, the k-th join makes node n + k.

    linkage: min, max, avg (both sides alike, whatever their sizes), avgs (by size), biased (a tenth
    avg, the rest min).
    """
    n = len(d)
    d = np.array(d, float)
    np.fill_diagonal(d, np.inf)
    name, size = list(range(n)), [1] * n
    out = []
    # The first least value of each row; rows are read again only when it goes.
    at = d.argmin(axis=1) if n else np.zeros(0, int)
    low_at = d[np.arange(n), at]
    for k in range(n - 1):
        i = int(low_at.argmin())
        i, j = sorted((i, int(at[i])))
        out.append((name[i], name[j], max(0.0, float(d[i, j]) / 2)))
        a, b = d[i], d[j]
        low, mean = np.minimum(a, b), (a + b) / 2
        new = {
            "min": low, "max": np.maximum(a, b), "avg": mean, "avgs": (size[i] * a + size[j] * b) / (size[i] + size[j]), "biased": 0.1 * mean + 0.9 * low,
        }[linkage]
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        lost = (at == i) | (at == j)
        lost[i], lost[j] = True, False
        near = ~lost & ((new < low_at) | ((new == low_at) & (i < at)))
        near[j] = False
        low_at[near], at[near] = new[near], i
        for r in np.flatnonzero(lost):
            at[r] = d[r].argmin()
            low_at[r] = d[r, at[r]]
        low_at[j] = np.inf
        name[i] = n + k
        size[i] += size[j]
    return out


def members(joins: list[tuple[int, int, float]], n: int) -> list[list[int]]:
    """Leaves below each node."""
    out = [[i] for i in range(n)]
    for a, b, _ in joins:
        out.append(out[a] + out[b])
    return out


def permuted(joins: list[tuple[int, int, float]], n: int, how: str) -> list[tuple[int, int, float]]:
    """Join the three largest parts of a tree in another order: `abc`, `acb` or `bca`; unchanged below six leaves or for `none`."""
    if how == "none" or n < 6:
        return joins
    below = members(joins, n)
    kids = {n + k: (a, b) for k, (a, b, _) in enumerate(joins)}
    root = n + len(joins) - 1
    parts = list(kids[root])
    big = max((p for p in parts if p in kids), key=lambda p: len(below[p]))
    parts.remove(big)
    parts += kids[big]
    a, b, c = sorted(parts, key=lambda p: (len(below[p]), p))
    order = {"abc": (a, b, c), "acb": (a, c, b), "bca": (b, c, a)}[how]
    kept = [(k, j) for k, j in enumerate(joins) if n + k not in (root, big)]
    new = {i: i for i in range(n)} | {n + k: n + at for at, (k, _) in enumerate(kept)}
    out = [(new[x], new[y], h) for _, (x, y, h) in kept]
    top = joins[-1][2]
    out.append((new[order[0]], new[order[1]], top))
    out.append((n + len(out) - 1, new[order[2]], top + 0.1))
    return out


def newick(joins: list[tuple[int, int, float]], labels: list[str]) -> str:
    n = len(labels)
    text, height = list(labels), [0.0] * n
    for a, b, h in joins:
        text.append(f"({text[a]}:{h - height[a]:.6g},{text[b]}:{h - height[b]:.6g})")
        height.append(h)
    return text[-1] + ";"
