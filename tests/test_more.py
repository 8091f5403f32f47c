"""Blocks, greedy merges, searches for parameters and the rows-only queries over trees."""

import pytest

from sparkloom.kernels import blocks
from sparkloom.plans import catalog, tuning


def test_core_blocks():
    rows = ["ABCDx-", "EFGHx-", "IJ--KL", "MN..KL"]
    assert blocks.core_blocks(rows, 2, 2) == [(0, 0, 2, 4), (2, 0, 2, 2), (2, 4, 2, 2)]
    assert blocks.core_blocks(rows, 3, 2) == [] == blocks.core_blocks([], 1, 1)


def test_merges_keep_letters_and_follow_the_order():
    parts = [([1], ["ACDEFG"]), ([2], ["WYWYWY"]), ([3], ["ACDFG"])]
    ids, rows, joins = blocks.merge_greedily(parts)
    assert sorted(ids) == [1, 2, 3] and joins[0] == (0, 2)
    assert {i: r.replace("-", "") for i, r in zip(ids, rows, strict=True)} == {1: "ACDEFG", 2: "WYWYWY", 3: "ACDFG"}
    assert len(set(map(len, rows))) == 1
    assert blocks.merge_in_order(parts, joins) == (ids, rows)
    with pytest.raises(ValueError):
        blocks.merge_in_order(parts, [(0, 1)])


def test_search():
    near = lambda points: [p | {"tc": 1 - abs(p["x"] - 3)} for p in points]
    best = tuning.spatter(near, {"x": 0.0}, {"x": 2.0}, most_failures=4)
    assert best["tc"] > 0.5
    found = near(tuning.grid({"x": [1.0, 2.9, 3.0, 3.2]}))
    assert [p["x"] for p in tuning.ranked(found, ["x"], 0.5, 0.15)] == [3.0, 3.2]


@pytest.mark.parametrize("name", ["core_blocks", "sampled_pairs"])
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_chain_tree(spark, sf):
    rows = catalog.QUERIES["random_chain_tree"](spark, sf).collect()
    kids: dict = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r["node"])
    assert kids.pop(None) == [-1]
    assert all(len(k) == 2 for k in kids.values())
    assert len({r["node"] for r in rows}) == len(rows)
