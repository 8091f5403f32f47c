"""Kernels against all paths on short strings, and invariants."""

import os
import random
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from sparkloom.kernels import family, guide, hmm, pairwise
from sparkloom.kernels.scores import LETTERS, NUCLEOTIDES, blosum62, encode, joint


def all_paths(n, m, steps="MDI"):
    def go(i, j):
        if i == n and j == m:
            yield ""
        if i < n and j < m:
            yield from (steps[0] + p for p in go(i + 1, j + 1))
        if i < n:
            yield from (steps[1] + p for p in go(i + 1, j))
        if j < m:
            yield from (steps[2] + p for p in go(i, j + 1))

    return list(go(0, 0))


def path_score(s, path, i, j, gap_open, gap_extend):
    total, last = 0.0, ""
    for c in path:
        if c == "M":
            total += s[i, j]
        else:
            total += gap_extend if c == last else gap_open
        i, j, last = i + (c != "I"), j + (c != "D"), c
    return total


@pytest.mark.parametrize("seed", range(12))
def test_global_against_all_paths(seed):
    rng = random.Random(seed)
    x, y = ("".join(rng.choice("ACDW") for _ in range(rng.randint(1, 4))) for _ in range(2))
    s = pairwise.score_matrix(x, y)
    score, i, j, path = pairwise.align(s, -3.0, -0.5)
    best = max(path_score(s, p, 0, 0, -3.0, -0.5) for p in all_paths(len(x), len(y)))
    assert score == pytest.approx(best)
    assert path_score(s, path, i, j, -3.0, -0.5) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(12))
def test_local_against_all_paths(seed):
    rng = random.Random(seed)
    x, y = ("".join(rng.choice("ACDW") for _ in range(rng.randint(1, 4))) for _ in range(2))
    s = pairwise.score_matrix(x, y)
    score, i, j, path = pairwise.smith_waterman(x, y, -5.0, -1.0)
    spans = [(a, b) for a, b in product(range(len(x)), range(1, len(x) + 1)) if a < b]
    best = 0.0
    for a, b in spans:
        for c, d in [(c, d) for c in range(len(y)) for d in range(c + 1, len(y) + 1)]:
            best = max(best, max(path_score(s[a:b, c:d], p, 0, 0, -5.0, -1.0) for p in all_paths(b - a, d - c)))
    assert score == pytest.approx(best)
    assert path_score(s, path, i, j, -5.0, -1.0) == pytest.approx(best)


def brute_posterior(x, y, model):
    start, t = hmm._tables(model)
    match, ex, ey = hmm.emissions(encode(x), encode(y))
    n, m = len(x), len(y)
    total, p = 0.0, np.zeros((n, m))
    for path in all_paths(n, m, "MXY"):
        for kinds in product(*(((0,), (1, 3), (2, 4))["MXY".index(c)] for c in path)):
            w, i, j, last, used = 1.0, 0, 0, None, []
            for k in kinds:
                w *= start[k] if last is None else t[last, k]
                if k == 0:
                    w *= match[i, j]
                    used.append((i, j))
                    i, j = i + 1, j + 1
                elif k in (1, 3):
                    w *= ex[i]
                    i += 1
                else:
                    w *= ey[j]
                    j += 1
                last = k
            total += w
            for a in used:
                p[a] += w
    return p / total


@pytest.mark.parametrize(("x", "y"), [("A", "C"), ("ACD", "AD"), ("WWA", "WA"), ("ACDE", "CD")])
def test_posterior_against_all_paths(x, y):
    want = brute_posterior(x, y, hmm.Model())
    got = hmm.pair_posterior(x, y)
    assert np.allclose(got, np.where(want >= hmm.LEAST, want, 0), atol=1e-9)


def test_posterior_of_long_sequences_is_a_probability():
    rng = random.Random(1)
    x = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(400))
    p = hmm.pair_posterior(x, x)
    assert p.max() <= 1 and (p.sum(axis=1) <= 1 + 1e-6).all()
    assert hmm.expected_accuracy(p) > 0.95


@pytest.mark.parametrize("seed", range(6))
def test_accuracy_path_is_best(seed):
    p = np.random.default_rng(seed).random((3, 4)) * 0.5
    path, score = hmm.max_accuracy(p)

    def value(q):
        i = j = 0
        v = 0.0
        for c in q:
            v += p[i, j] if c == "B" else 0
            i, j = i + (c != "Y"), j + (c != "X")
        return v

    assert score == pytest.approx(max(map(value, all_paths(3, 4, "BXY"))))
    assert value(path) == pytest.approx(score)


def test_matrix_is_symmetric():
    m = blosum62()
    at = lambda a, b: m[LETTERS.index(a), LETTERS.index(b)]
    assert (m == m.T).all() and m.shape == (20, 20)
    assert (at("A", "A"), at("W", "W"), at("C", "C"), at("Y", "Y")) == (1.9646, 5.252, 4.2911, 3.2975)
    assert (at("I", "V"), at("W", "D"), at("K", "R"), at("F", "Y")) == (1.2735, -2.1072, 1.0544, 1.4696)
    # The scores are log-odds in bits: with the probabilities they imply, letters pair as chance has it in no other way.
    q, p = joint()
    assert q[:20, :20].sum() == pytest.approx(1) and np.allclose(q[:20, :20].sum(axis=1), p[:20])
    assert np.allclose(np.log2(q[:20, :20] / np.outer(p[:20], p[:20])), m, atol=1e-5)


def test_other_letters_say_nothing():
    assert pairwise.score_matrix("AXB", "A-Z").tolist() == [[1.9646, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert encode("AxY").tolist() == [0, 20, 19] and encode("acgun", NUCLEOTIDES).tolist() == [0, 1, 2, 3, 20]
    x = hmm.pair_posterior("ACDEFGHIKL", "ACDXFGHIKL")
    assert x[3, 3] > 0.5


@pytest.mark.parametrize("nucleotides", [False, True])
def test_parameters_of_a_file_are_used(nucleotides):
    q, _ = joint(nucleotides)
    letters = NUCLEOTIDES if nucleotides else LETTERS
    named = {f"E.{letters[i]}{letters[j]}": q[i, j] for i in range(len(letters)) for j in range(i + 1)}
    named |= {"T.START_M": 0.6, "T.START_IS": 0.02, "T.START_IL": 0.18, "T.M_IS": 0.012, "T.M_IL": 0.008, "T.IS_IS": 0.35, "T.IL_IL": 0.9}
    read, plain = hmm.Model.of(named, nucleotides), hmm.Model(nucleotides=nucleotides)
    assert np.allclose(hmm.pair_posterior("ACGTAC", "ACTAC", read), hmm.pair_posterior("ACGTAC", "ACTAC", plain))
    assert not np.allclose(hmm.pair_posterior("ACGTAC", "ACTAC", hmm.Model.of(named | {"T.M_IS": 0.1}, nucleotides)), hmm.pair_posterior("ACGTAC", "ACTAC", plain))
    start, t = hmm._tables(plain.perturbed(3))
    assert start.sum() == pytest.approx(1) and np.allclose(t.sum(axis=1), 1)
    single = plain.single_affine()
    assert single.start_short == single.start_long == pytest.approx(0.1) and single.extend_short == pytest.approx(0.625)


@pytest.mark.parametrize("seed", range(5))
def test_end_gaps_cost_what_they_say(seed):
    s = np.random.default_rng(seed).normal(size=(3, 4))

    def value(path):
        i = j = 0
        v, k = 0.0, 0
        while k < len(path):
            stop = k
            while stop < len(path) and path[stop] == path[k]:
                stop += 1
            if path[k] == "M":
                for _ in range(stop - k):
                    v, i, j = v + s[i, j], i + 1, j + 1
            else:
                down = path[k] == "D"
                ends = (j in (0, 4)) if down else (i in (0, 3))
                v += (-0.1 - 0.05 * (stop - k - 1)) if ends else (-0.9 - 0.2 * (stop - k - 1))
                i, j = (i + stop - k, j) if down else (i, j + stop - k)
            k = stop
        return v

    score, _, _, path = pairwise.align(s, -0.9, -0.2, end_open=-0.1, end_extend=-0.05)
    assert score == pytest.approx(max(map(value, all_paths(3, 4)))) == pytest.approx(value(path))


def test_agglomeration():
    d = np.array([[0, 1, 4], [1, 0, 2], [4, 2, 0.0]])
    assert guide.agglomerate(d, "min") == [(0, 1, 0.5), (2, 3, 1.0)] or guide.agglomerate(d, "min") == [(0, 1, 0.5), (3, 2, 1.0)]
    assert guide.agglomerate(d, "max")[-1][2] == 2.0
    assert guide.agglomerate(d, "avg")[-1][2] == 1.5


def test_permutations_keep_leaves():
    d = np.abs(np.subtract.outer(np.arange(8), np.arange(8))).astype(float)
    joins = guide.agglomerate(d)
    for how in ("none", "abc", "acb", "bca"):
        assert sorted(guide.members(guide.permuted(joins, 8, how), 8)[-1]) == list(range(8))


def test_likelihood_distance_grows():
    assert pairwise.likelihood_distance("ACDEFGHIKL", "ACDEFGHIKL") < pairwise.likelihood_distance("ACDEFGHIKL", "ACDEFGWWWW")
    assert pairwise.likelihood_distance("A-", "-A") == -1.0


def test_merge_pairs_use_all_rows():
    assert family.row_pairs(59, 50) == [(i, j) for i in range(59) for j in range(50)]
    for n, m in ((100, 10), (200, 4), (1000, 10), (500, 16)):
        pairs = family.row_pairs(n, m)
        assert len(set(pairs)) == len(pairs) == min(n * m, 2000)
        assert {j for _, j in pairs} == set(range(m)) and len({i for i, _ in pairs}) > 0.8 * n


def test_family_keeps_letters_and_duplicates():
    seqs = ["ACDEFGH", "ACDFGH", "acdfgh", "CDEFGHK"]
    rows = family.align(seqs, refine=5)
    assert [r.replace("-", "") for r in rows] == [s.upper() for s in seqs]
    assert len(set(map(len, rows))) == 1 and rows[1] == rows[2]


GOLD = os.environ.get("SPARKLOOM_GOLD_DIR", "")


@pytest.mark.skipif(not GOLD, reason="no folder with fa/ and ref_alns/")
@pytest.mark.parametrize(("name", "q", "tc"), [("BB11001", 1, 1), ("BB11002", 0.611, 0), ("BB11009", 0.764, 0.617)])
def test_gold(name, q, tc):
    read = lambda p: {r.split("\n")[0].split()[0]: "".join(r.split("\n")[1:]) for r in Path(GOLD, p, name).read_text().split(">")[1:]}
    seqs, gold = read("fa"), read("ref_alns")
    rows = dict(zip(seqs, family.align(list(seqs.values())), strict=True))
    place = {k: [i for i, c in enumerate(rows[k]) if c != "-"] for k in gold}
    at, hit, pairs, right, scored = dict.fromkeys(gold, -1), 0, 0, 0, 0
    for col in zip(*gold.values(), strict=True):
        spots = []
        for k, c in zip(gold, col, strict=True):
            if c not in "-.":
                at[k] += 1
                if c.isupper():
                    spots.append(place[k][at[k]])
        if len(spots) > 1:
            n = Counter(spots)
            hit += sum(v * (v - 1) // 2 for v in n.values())
            pairs += len(spots) * (len(spots) - 1) // 2
            right += len(n) == 1
            scored += 1
    assert hit / pairs >= 0.7 * q and right / scored >= 0.7 * tc
