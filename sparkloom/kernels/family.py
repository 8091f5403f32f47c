"""Alignment of one family of sequences: posteriors, consistency, progressive joins, refinement."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from sparkloom.kernels import guide, hmm


def posteriors(seqs: list[str], model: hmm.Model) -> dict[tuple[int, int], np.ndarray]:
    return {(i, j): hmm.pair_posterior(seqs[i], seqs[j], model).astype(np.float32) for i in range(len(seqs)) for j in range(i + 1, len(seqs))}


def relax(post: dict[tuple[int, int], np.ndarray], n: int) -> dict[tuple[int, int], np.ndarray]:
    """(2 P_xy + sum over z of P_xz P_zy) / n, where P_xy was above zero."""
    at = lambda i, j: post[i, j] if i < j else post[j, i].T
    out = {}
    for (i, j), p in post.items():
        s = 2 * p
        for z in range(n):
            if z not in (i, j):
                s = s + at(i, z) @ at(z, j)
        out[i, j] = np.where(p > 0, s / n, 0.0).astype(np.float32)
    return out


class Block:
    """An alignment of some sequences: for each its columns' positions, -1 in gaps."""

    def __init__(self, ids: list[int], rows: np.ndarray):
        self.ids, self.rows = ids, rows

    def kept(self, ids: set[int]) -> Block:
        pick = [k for k, i in enumerate(self.ids) if i in ids]
        rows = self.rows[pick]
        return Block([self.ids[k] for k in pick], rows[:, (rows >= 0).any(axis=0)])


def join(a: Block, b: Block, post: dict[tuple[int, int], np.ndarray]) -> Block:
    """Align two alignments by the summed posteriors of their columns."""
    total = np.zeros((a.rows.shape[1], b.rows.shape[1]), np.float32)
    for k, i in enumerate(a.ids):
        for r, j in enumerate(b.ids):
            p = post[i, j] if i < j else post[j, i].T
            ca, cb = np.flatnonzero(a.rows[k] >= 0), np.flatnonzero(b.rows[r] >= 0)
            total[np.ix_(ca, cb)] += p
    return joined(a, b, total / (len(a.ids) * len(b.ids)))


def joined(a: Block, b: Block, mean: np.ndarray) -> Block:
    """Two alignments side by side by the mean posteriors of their columns."""
    path, _ = hmm.max_accuracy(mean)
    step = np.frombuffer(path.encode(), np.uint8)
    in_a, in_b = step != ord("Y"), step != ord("X")
    rows = np.full((len(a.ids) + len(b.ids), len(path)), -1, np.int64)
    rows[: len(a.ids), in_a] = a.rows
    rows[len(a.ids) :, in_b] = b.rows
    return Block(a.ids + b.ids, rows)


def align(seqs: list[str], consistency: int = 2, refine: int = 100, seed: int = 0, perm: str = "none", model: hmm.Model | None = None) -> list[str]:
    """Rows of the alignment, in the order of the sequences.

    Equal sequences are aligned once. seed perturbs the model (0: not) and orders the refinement, perm
    reorders the guide tree.
    """
    first = {s: i for i, s in reversed(list(enumerate(s.upper() for s in seqs)))}
    unique = sorted(first, key=first.get)
    n = len(unique)
    if n == 1 or not all(unique):
        width = max(map(len, seqs), default=0)
        return [s.upper().ljust(width, "-") for s in seqs]
    post = posteriors(unique, (model or hmm.Model()).perturbed(seed))
    whole = assemble(post, [len(s) for s in unique], consistency, refine, seed, perm)
    row = {unique[i]: "".join(unique[i][p] if p >= 0 else "-" for p in r) for i, r in zip(whole.ids, whole.rows.tolist(), strict=True)}
    return [row[s.upper()] for s in seqs]


def assemble(post: dict[tuple[int, int], np.ndarray], lengths: list[int], consistency: int = 2, refine: int = 100, seed: int = 0, perm: str = "none") -> Block:
    """The alignment of sequences of these lengths from the posteriors of all pairs (i < j)."""
    n = len(lengths)
    d = np.zeros((n, n))
    for (i, j), p in post.items():
        d[i, j] = d[j, i] = 1 - hmm.expected_accuracy(p)
    joins = guide.permuted(guide.agglomerate(d), n, perm)
    for _ in range(consistency if n > 2 else 0):
        post = relax(post, n)
    blocks = [Block([i], np.arange(k)[None, :]) for i, k in enumerate(lengths)]
    for a, b, _ in joins:
        blocks.append(join(blocks[a], blocks[b], post))
    whole = blocks[-1]
    rng = np.random.default_rng(seed + 1)
    for _ in range(refine if n > 2 else 0):
        side = {i for i in range(n) if rng.integers(2)}
        if 0 < len(side) < n:
            whole = join(whole.kept(side), whole.kept(set(range(n)) - side), post)
    return whole


def assemble_kinds(post: dict[tuple[int, int], np.ndarray], kind: list[int], lengths: list[int], consistency: int = 2, refine: int = 100, seed: int = 0, perm: str = "none") -> Block:
    """What :func:`assemble` makes of sequences of which many are equal.

    kind: the number of each sequence's letters; post: posteriors by kinds (c, d) of each two
    sequences i < j, both ways round where both occur. Sums over sequences are taken over kinds by their numbers.
    """
    n, kinds = len(kind), max(kind) + 1
    of = np.array(kind)
    number = np.bincount(of, minlength=kinds)
    ea = np.zeros((kinds, kinds))
    for (c, d), p in post.items():
        ea[c, d] = hmm.expected_accuracy(p)
    d = 1 - ea[np.ix_(of, of)]
    d = np.triu(d, 1)
    d = d + d.T
    joins = guide.permuted(guide.agglomerate(d), n, perm)
    at = lambda p, c, d: p[c, d] if (c, d) in p else p[d, c].T
    post = {(c, d): at(post, c, d) for c in range(kinds) for d in range(c, kinds) if (c, d) in post or (d, c) in post}
    for _ in range(consistency if n > 2 else 0):
        new = {}
        for (c, d), p in post.items():
            s = 2 * p
            for e in range(kinds):
                others = int(number[e]) - (e == c) - (e == d)
                if others > 0:
                    s = s + np.float32(others) * (at(post, c, e) @ at(post, e, d))
            new[c, d] = np.where(p > 0, s / n, 0.0).astype(np.float32)
        post = new

    def counted(b: Block) -> dict[int, np.ndarray]:
        """For each kind how many of its rows have the letter in the column."""
        out = {}
        for c in np.unique(of[b.ids]):
            rows = b.rows[of[b.ids] == c]
            table = np.zeros((lengths[kind.index(c)], rows.shape[1]))
            np.add.at(table, (rows[rows >= 0], np.nonzero(rows >= 0)[1]), 1)
            out[int(c)] = table
        return out

    def join(a: Block, b: Block) -> Block:
        total = np.zeros((a.rows.shape[1], b.rows.shape[1]))
        left, right = counted(a), counted(b)
        for c, x in left.items():
            for d, y in right.items():
                total += x.T @ at(post, c, d) @ y
        return joined(a, b, total / (len(a.ids) * len(b.ids)))

    blocks = [Block([i], np.arange(k)[None, :]) for i, k in enumerate(lengths)]
    for a, b, _ in joins:
        blocks.append(join(blocks[a], blocks[b]))
        blocks[a] = blocks[b] = None
    whole = blocks[-1]
    rng = np.random.default_rng(seed + 1)
    for _ in range(refine if n > 2 else 0):
        side = {i for i in range(n) if rng.integers(2)}
        if 0 < len(side) < n:
            whole = join(whole.kept(side), whole.kept(set(range(n)) - side))
    return whole


def row_pairs(n: int, m: int, target: int = 2000) -> list[tuple[int, int]]:
    """All pairs of n and m rows if they are under 3/2 of the target, else `target` different ones drawn by a seeded generator."""
    if 2 * n * m < 3 * target:
        return [(i, j) for i in range(n) for j in range(m)]
    return [divmod(k, m) for k in sorted(random.Random(1).sample(range(n * m), target))]


def merge(left: list[str], right: list[str], model: hmm.Model | None = None) -> tuple[list[str], list[str]]:
    """Two alignments side by side by the posteriors of all pairs of their rows; pairs of the same letters are computed once."""
    m = model or hmm.Model()
    a, b = _places(left), _places(right)
    total = np.zeros((len(left[0]), len(right[0])))
    for x, at in a.items():
        for y, to in b.items():
            total += at.T @ hmm.pair_posterior(x, y, m) @ to
    path, _ = hmm.max_accuracy(total / max(1, len(left) * len(right)))

    def spread(row: str, skip: str) -> str:
        letters = iter(row)
        return "".join("-" if c == skip else next(letters) for c in path)

    in_left, in_right = ({r: spread(r, skip) for r in set(rows)} for rows, skip in ((left, "Y"), (right, "X")))
    return [in_left[r] for r in left], [in_right[r] for r in right]


def _places(rows: list[str]) -> dict[str, np.ndarray]:
    """For each different sequence of an alignment (letters x columns) how many of its rows have the letter in the column."""
    out: dict[str, np.ndarray] = {}
    for row, n in Counter(rows).items():
        at = [k for k, c in enumerate(row) if c != "-"]
        letters = "".join(row[k] for k in at)
        table = out.setdefault(letters, np.zeros((len(at), len(row))))
        table[np.arange(len(at)), at] += n
    return out
