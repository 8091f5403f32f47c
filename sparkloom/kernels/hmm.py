"""Five-state pair HMM (a match, short and long inserts on either side): posteriors and what follows from them.

The recurrences run over anti-diagonals, all cells of one at a time, in scaled probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np

from sparkloom.kernels.scores import LETTERS, NUCLEOTIDES, encode, given, joint

LEAST = 0.01


@dataclass(frozen=True)
class Model:
    """Transition probabilities: starts of a match, a short and a long insert, opening and extending inserts.

    emit: (joint, single) probabilities of letters, by default those of the alphabet.
    """

    # The defaults of the model, for amino acids and nucleotides alike.
    start: float = 0.6
    start_short: float = 0.02
    start_long: float = 0.18
    open_short: float = 0.012
    open_long: float = 0.008
    extend_short: float = 0.35
    extend_long: float = 0.9
    nucleotides: bool = False
    emit: tuple | None = None

    @staticmethod
    def of(parameters: dict[str, float], nucleotides: bool = False) -> Model:
        """From the named probabilities of a model file; what it lacks keeps its default."""
        named = {"START_M": "start", "START_IS": "start_short", "START_IL": "start_long", "M_IS": "open_short", "M_IL": "open_long", "IS_IS": "extend_short", "IL_IL": "extend_long"}
        found = {field: parameters[f"T.{name}"] for name, field in named.items() if f"T.{name}" in parameters}
        emit = given(parameters, NUCLEOTIDES if nucleotides else LETTERS) if any(k.startswith("E.") for k in parameters) else None
        return Model(**found, nucleotides=nucleotides, emit=emit)

    def single_affine(self) -> Model:
        """Both kinds of inserts alike, with the means of their probabilities."""
        start, open_, extend = (self.start_short + self.start_long) / 2, (self.open_short + self.open_long) / 2, (self.extend_short + self.extend_long) / 2
        return replace(self, start_short=start, start_long=start, open_short=open_, open_long=open_, extend_short=extend, extend_long=extend)

    def code(self, seq: str) -> np.ndarray:
        return encode(seq, NUCLEOTIDES if self.nucleotides else LETTERS)

    def perturbed(self, seed: int, most: float = 0.25) -> Model:
        """Each parameter times 1 - most .. 1 + most in steps of 0.01; seed 0 changes nothing."""
        if not seed:
            return self
        rng = np.random.default_rng(seed)
        steps = int(100 * most)
        moved = {f.name: getattr(self, f.name) * (1 + rng.integers(-steps, steps + 1) / 100) for f in fields(self) if f.type == "float"}
        total = moved["start"] + 2 * moved["start_short"] + 2 * moved["start_long"]
        moved |= {k: moved[k] / total for k in ("start", "start_short", "start_long")} | {k: min(0.95, moved[k]) for k in ("extend_short", "extend_long")}
        return replace(self, **moved)


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Start and transition probabilities over the states M, IX, IY, JX, JY."""
    s, l = model.open_short, model.open_long  # noqa: E741
    t = np.zeros((5, 5))
    t[0] = [1 - 2 * s - 2 * l, s, s, l, l]
    for k, e in ((1, model.extend_short), (2, model.extend_short), (3, model.extend_long), (4, model.extend_long)):
        t[k, k], t[k, 0] = e, 1 - e
    return np.array([model.start, model.start_short, model.start_short, model.start_long, model.start_long]), t


def emissions(x: np.ndarray, y: np.ndarray, model: Model = Model()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, single = model.emit or joint(model.nucleotides)
    return pair[np.ix_(x, y)], single[x], single[y]


def posterior(x: np.ndarray, y: np.ndarray, model: Model = Model(), emit=None) -> np.ndarray:
    """The probability of each pair of places to be aligned. emit: (match, insert x, insert y) to use instead of letters'."""
    match, ex, ey = emissions(x, y, model) if emit is None else emit
    n, m = match.shape
    if not n or not m:
        return np.zeros((n, m))
    # Dividing each emission by its background keeps values near one; what remains is scaled by diagonal.
    ratio = match / (ex[:, None] * ey[None, :])
    start, t = _tables(model)
    f = np.zeros((5, n + 1, m + 1))
    logs = np.zeros(n + m + 1)
    total = 0.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        # Diagonals d - 1 and d - 2 carry scales of their own; the match state steps over two.
        step = np.exp(-logs[d - 1]) if d > 1 else 1.0
        up, left, both = i > 0, j > 0, (i > 0) & (j > 0)
        a, b = i[both], j[both]
        if len(a):
            v = np.tensordot(t[:, 0], f[:, a - 1, b - 1], 1)
            v += np.where((a == 1) & (b == 1), start[0], 0.0)
            f[0, a, b] = step * v * ratio[a - 1, b - 1]
        a, b = i[up], j[up]
        for k in (1, 3):
            f[k, a, b] = t[0, k] * f[0, a - 1, b] + t[k, k] * f[k, a - 1, b] + np.where((a == 1) & (b == 0), start[k], 0.0)
        a, b = i[left], j[left]
        for k in (2, 4):
            f[k, a, b] = t[0, k] * f[0, a, b - 1] + t[k, k] * f[k, a, b - 1] + np.where((a == 0) & (b == 1), start[k], 0.0)
        top = f[:, i, j].max()
        if top > 0:
            f[:, i, j] /= top
            logs[d] = np.log(top)
            total += logs[d]
    g = np.zeros((5, n + 2, m + 2))
    g[:, n, m] = 1.0
    gl = np.zeros(n + m + 3)
    for d in range(n + m - 1, 0, -1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        hit = np.where((i < n) & (j < m), ratio[np.minimum(i, n - 1), np.minimum(j, m - 1)] * g[0, i + 1, j + 1], 0.0) * np.exp(-gl[d + 1])
        down, right = np.where(i < n, 1.0, 0.0), np.where(j < m, 1.0, 0.0)
        out = t[:, 0][:, None] * hit[None, :]
        for k in (1, 3):
            v = down * g[k, i + 1, j]
            out[0] += t[0, k] * v
            out[k] += t[k, k] * v
        for k in (2, 4):
            v = right * g[k, i, j + 1]
            out[0] += t[0, k] * v
            out[k] += t[k, k] * v
        top = out.max()
        if top > 0:
            out /= top
            gl[d] = np.log(top)
        g[:, i, j] = out
    # Cumulated scales: of the forward values up to a diagonal, of the backward values from it on.
    up_to, from_on = np.cumsum(logs), np.cumsum(gl[::-1])[::-1]
    end = np.log(f[:, n, m].sum()) + up_to[n + m]
    d = np.add.outer(np.arange(1, n + 1), np.arange(1, m + 1))
    p = f[0, 1:, 1:] * g[0, 1 : n + 1, 1 : m + 1] * np.exp(up_to[d] + from_on[d] - end)
    return np.where(p >= LEAST, np.minimum(p, 1.0), 0.0)


def max_accuracy(p: np.ndarray) -> tuple[str, float]:
    """(path over B, X, Y; summed probability) of the alignment of the highest sum; ties B, then X, then Y."""
    n, m = p.shape
    s = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        s[i, 1:] = np.maximum.accumulate(np.maximum(s[i - 1, :-1] + p[i - 1], s[i - 1, 1:]))
    path, i, j = [], n, m
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + p[i - 1, j - 1] and (p[i - 1, j - 1] > 0 or s[i, j] > max(s[i - 1, j], s[i, j - 1])):
            path.append("B")
            i, j = i - 1, j - 1
        elif i and s[i, j] == s[i - 1, j]:
            path.append("X")
            i -= 1
        else:
            path.append("Y")
            j -= 1
    return "".join(reversed(path)), float(s[n, m])


def expected_accuracy(p: np.ndarray) -> float:
    return max_accuracy(p)[1] / max(1, min(p.shape))


class Kept:
    """Results by key, so that equal pairs are computed once; forgotten all at once when their arrays exceed `most` bytes."""

    def __init__(self, most: int = 64 << 20):
        self.most, self.held, self.found = most, 0, {}

    def get(self, key, make):
        if key not in self.found:
            value = make()
            size = getattr(value, "nbytes", 0) + 512
            if self.held + size > self.most:
                self.held, self.found = 0, {}
            self.held += size
            self.found[key] = value
        return self.found[key]


_posteriors, _accuracies, _named = Kept(), Kept(16 << 20), {}


def kept(name) -> Kept:
    """The results that this process keeps under a name, for all its tasks."""
    return _named.setdefault(name, Kept(32 << 20))


def pair_posterior(x: str, y: str, model: Model = Model()) -> np.ndarray:
    """Read only: pairs of the same letters share it. A model with emissions of its own is computed anew."""

    def make() -> np.ndarray:
        p = posterior(model.code(x), model.code(y), model)
        p.flags.writeable = False
        return p

    return make() if model.emit is not None else _posteriors.get((x.upper(), y.upper(), model), make)


def pair_accuracy(x: str, y: str) -> float:
    """The expected accuracy of a pair; pairs of the same letters are computed once."""
    return _accuracies.get((x.upper(), y.upper()), lambda: expected_accuracy(pair_posterior(x, y)))
