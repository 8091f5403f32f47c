"""Gap-free blocks of one alignment and greedy merges of a family's alignments."""

from __future__ import annotations

from collections import Counter

import numpy as np

from sparkloom.kernels import family, hmm


def core_blocks(rows: list[str], least_rows: int = 8, least_columns: int = 8) -> list[tuple[int, int, int, int]]:
    """(top, left, height, width) of rectangles of upper-case letters, from 0.

    The first free cell in reading order opens a rectangle: as many letters to its right as are free,
    then as many rows down as are free over that width. Its cells are used up either way; it is
    reported if it has the least size on both sides.
    """
    free = np.array([[c.isupper() for c in row] for row in rows], bool)
    if not free.size:
        return []
    out = []
    for top in range(free.shape[0]):
        while free[top].any():
            left = int(free[top].argmax())
            run = free[top, left:]
            width = int(run.argmin()) if not run.all() else len(run)
            below = free[top:, left : left + width].all(axis=1)
            height = int(below.argmin()) if not below.all() else len(below)
            free[top : top + height, left : left + width] = False
            if height >= least_rows and width >= least_columns:
                out.append((top, left, height, width))
    return out


def _plain(rows: list[str]) -> Counter:
    """The different sequences of an alignment that have letters, with the number of their rows."""
    return Counter(x for r in rows if (x := r.replace("-", "").replace(".", "")))


def closeness(a: list[str], b: list[str]) -> float:
    """The mean expected accuracy of all pairs across two alignments, by their ungapped rows."""
    left, right = _plain(a), _plain(b)
    n = left.total() * right.total()
    return sum(i * j * hmm.pair_accuracy(x, y) for x, i in left.items() for y, j in right.items()) / n if n else 0.0


def merge_greedily(blocks: list[tuple[list, list[str]]]) -> tuple[list, list[str], list[tuple[int, int]]]:
    """(ids, rows, joins): join the closest two alignments (ids, rows) until one is left; ties (to 12 digits) go to the lower numbers.

    joins holds the numbers of each step's two parts; the k-th step makes part len(blocks) + k. Rows
    keep their letters when parts join, so sums over pairs of a joined part are those of its parts:
    each two different sequences are compared once.
    """
    parts = dict(enumerate(blocks))
    joins, n = [], len(blocks)
    held = [_plain(rows) for _, rows in blocks]
    names = sorted(set().union(*held))
    ea = np.zeros((len(names), len(names)))
    for k, x in enumerate(names):
        for r in range(k, len(names)):
            ea[k, r] = ea[r, k] = hmm.pair_accuracy(x, names[r])
    at = {x: k for k, x in enumerate(names)}
    counts = np.zeros((n, len(names)))
    for k, h in enumerate(held):
        for x, c in h.items():
            counts[k, at[x]] = c
    # Slots of the parts that are left: their numbers, sizes, sums over pairs, and each slot's closest one.
    number, size = np.arange(n), counts.sum(axis=1)
    total = counts @ ea @ counts.T
    alive = np.ones(n, bool)

    def best(k: int) -> tuple[float, int]:
        pairs = size[k] * size
        mean = np.where(alive, np.round(np.divide(total[k], pairs, out=np.zeros(n), where=pairs > 0), 12), -1.0)
        mean[k] = -1.0
        top = np.flatnonzero(mean == mean.max())
        return float(mean[top[0]]), int(top[number[top].argmin()])

    near = [best(k) for k in range(n)] if n > 1 else []
    score, partner = np.array([v for v, _ in near]), np.array([k for _, k in near], int)
    for step in range(n - 1):
        slots = np.flatnonzero(alive & (score == score[alive].max()))
        low, high = np.minimum(number[slots], number[partner[slots]]), np.maximum(number[slots], number[partner[slots]])
        k = slots[np.lexsort((high, low))[0]]
        i, j = sorted((int(k), int(partner[k])), key=lambda s: number[s])
        joins.append((int(number[i]), int(number[j])))
        parts[n + step] = _joined(parts.pop(joins[-1][0]), parts.pop(joins[-1][1]))
        total[i] += total[j]
        total[:, i] += total[:, j]
        size[i] += size[j]
        number[i], alive[j], score[j] = n + step, False, -2.0
        if step == n - 2:
            break
        lost = alive & ((partner == i) | (partner == j))
        lost[i] = True
        for r in np.flatnonzero(lost):
            score[r], partner[r] = best(r)
        # Others may be closer to the joined part than to any other; its number is the highest, so ties stay.
        rest = np.flatnonzero(alive & ~lost)
        pairs = size[i] * size[rest]
        mean = np.round(np.divide(total[i, rest], pairs, out=np.zeros(len(rest)), where=pairs > 0), 12)
        closer = mean > score[rest]
        score[rest[closer]], partner[rest[closer]] = mean[closer], i
    return (*next(iter(parts.values()), ([], [])), joins)


def merge_in_order(blocks: list[tuple[list, list[str]]], joins: list[tuple[int, int]]) -> tuple[list, list[str]]:
    """Join alignments in a given order, numbered as by merge_greedily."""
    parts = dict(enumerate(blocks))
    for k, (i, j) in enumerate(joins):
        if i not in parts or j not in parts or i == j:
            raise ValueError(f"step {k} joins parts that aren't there")
        parts[len(blocks) + k] = _joined(parts.pop(i), parts.pop(j))
    if len(parts) != 1:
        raise ValueError("the order leaves more than one part")
    return next(iter(parts.values()))


def _joined(a: tuple[list, list[str]], b: tuple[list, list[str]]) -> tuple[list, list[str]]:
    rows, more = family.merge(a[1], b[1])
    return a[0] + b[0], rows + more
