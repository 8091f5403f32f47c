"""Small alignments whose answers are known."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import letters as L
from sparkloom.operators import ensemble, kmers, msa, posterior, score, sequences, trees

ROWS = [("m", 1, "AC-GT"), ("m", 2, "A--GT"), ("m", 3, "TC-G-")]


def cells(spark, rows=ROWS):
    return msa.to_cells(spark.createDataFrame(rows, "msa_id string, seq_id bigint, row string"))


def rows_of(df):
    return {r["seq_id"]: r["row"] for r in df.collect()}


def test_round_trip(spark):
    assert rows_of(msa.to_rows(cells(spark))) == {i: r for _, i, r in ROWS}


def test_signed_positions(spark):
    got = {(r["seq_id"], r["col"]): (r["pos"], r["signed"]) for r in msa.positions(cells(spark)).collect()}
    assert [got[2, c] for c in range(1, 6)] == [(1, 1), (None, -1), (None, -1), (2, 2), (3, 3)]


def test_all_gap_column_goes(spark):
    assert rows_of(msa.to_rows(msa.drop_gap_columns(cells(spark)))) == {1: "ACGT", 2: "A-GT", 3: "TCG-"}


def test_consensus_ties_to_the_first_letter(spark):
    tie = [("m", 1, "TA-"), ("m", 2, "CA-"), ("m", 3, "--A")]
    got = msa.consensus(cells(spark, tie), "ACGT").collect()
    assert [r["consensus"] for r in got] == ["CA"]


def test_mixed_case_column_is_an_error(spark):
    with pytest.raises(Exception, match="mixed case"):
        msa.aligned_columns(cells(spark, [("m", 1, "A"), ("m", 2, "a")])).collect()


def test_squeeze_pads_the_middle_on_both_sides(spark):
    rows = [("m", 1, "AxyzB"), ("m", 2, "A--wB")]
    c = cells(spark, rows)
    core = c.where("col in (1, 5)").select("msa_id", "col").distinct()
    assert rows_of(msa.squeeze_inserts(c, core)) == {1: "AxyzB", 2: "A.w.B"}


def test_a2m(spark):
    c = cells(spark)
    assert rows_of(msa.a2m(c, msa.match_columns(c, 0.4))) == {1: "ACGT", 2: "A-GT", 3: "TCG-"}


def test_strip_anchors(spark):
    assert rows_of(msa.to_rows(msa.strip_anchors(cells(spark, [("m", 1, "A1C"), ("m", 2, "G1-")])))) == {1: "AC", 2: "G-"}
    with pytest.raises(Exception, match="anchors"):
        msa.strip_anchors(cells(spark, [("m", 1, "A1C"), ("m", 2, "G2-")])).collect()


def test_perfect_score(spark):
    gold = cells(spark, [("m", 1, "ACg-"), ("m", 2, "A-gt")])
    test = gold.withColumn("letter", F.upper("letter"))
    got = score.quality(test, gold).collect()[0]
    assert (got["q"], got["tc"]) == (1.0, 1.0)


def test_shifted_score(spark):
    gold = cells(spark, [("m", 1, "AC"), ("m", 2, "AC")])
    test = cells(spark, [("m", 1, "AC-"), ("m", 2, "-AC")])
    got = score.quality(test, gold, "strict").collect()[0]
    assert (got["q"], got["tc"]) == (0.0, 0.0)


def test_one_residue_column_by_mode(spark):
    gold = cells(spark, [("m", 1, "AC"), ("m", 2, "A-")])
    for mode, tc in (("classic", 1.0), ("strict", 1.0)):
        assert score.quality(gold, gold, mode).collect()[0]["tc"] == tc
    assert {r["gold_col"]: r["right"] for r in score.column_scores(gold, gold, "classic").collect()} == {1: 1, 2: 0}
    assert {r["gold_col"]: r["right"] for r in score.column_scores(gold, gold, "strict").collect()} == {1: 1, 2: 1}


def test_aligned_columns_of_one_letter(spark):
    rows = cells(spark, [("m", 1, "ACg-"), ("m", 2, "A-g-")])
    for most_gaps, columns in ((1.0, [1, 2]), (0.5, [1, 2]), (0.4, [1])):
        assert sorted(r["col"] for r in msa.aligned_columns(rows, most_gaps).collect()) == columns


def test_quartiles_take_the_upper_median(spark):
    got = sequences.quartiles(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v bigint"), "v").collect()[0]
    assert (got["lo"], got["median"], got["hi"], got["n"]) == (1, 3, 4, 4)


@pytest.mark.parametrize(("top", "hits"), [(1, []), (2, [1, 2]), (3, [1, 3]), (4, [1, 4])])
def test_word_search_cut_off(spark, top, hits):
    q = spark.createDataFrame([(0, f"k{i}", 1) for i in range(5)], "seq_id bigint, kmer string, n bigint")
    t = spark.createDataFrame([(1, "k0", 1), *((9, f"k{i}", 1) for i in range(top))], "seq_id bigint, kmer string, n bigint")
    got = sorted(r["u"] for r in kmers.word_search(q, t).collect())
    assert got == (sorted(hits) if hits else [])


def test_word_search_cut_off_drops_below_half(spark):
    q = spark.createDataFrame([(0, f"k{i}", 1) for i in range(8)], "seq_id bigint, kmer string, n bigint")
    t = spark.createDataFrame([(1, "k0", 1), (2, "k0", 1), (2, "k1", 1), *((9, f"k{i}", 1) for i in range(7))], "seq_id bigint, kmer string, n bigint")
    assert {r["target_id"] for r in kmers.word_search(q, t).collect()} == {2, 9}


def test_duplicates_by_case(spark):
    seqs = spark.createDataFrame([(1, "AC"), (2, "ac"), (3, "G")], "seq_id bigint, letters string")
    assert {r["seq_id"]: r["size"] for r in sequences.representatives(seqs).collect()} == {1: 2, 3: 1}
    values = spark.createDataFrame([(1, "x"), (3, "y")], "seq_id bigint, v string")
    assert {r["seq_id"]: r["v"] for r in sequences.reinsert(values, sequences.duplicate_map(seqs)).collect()} == {1: "x", 2: "x", 3: "y"}


def test_ensemble_confidence(spark):
    members = spark.createDataFrame(
        [("m", i, s, c + 1, x) for i, rows in enumerate((("AC", "AC"), ("AC", "AC"), ("AC-", "-AC"))) for s, r in enumerate(rows) for c, x in enumerate(r)],
        "msa_id string, msa_idx bigint, seq_id bigint, col bigint, letter string",
    )
    cols = ensemble.columns(members)
    got = sorted((r["key"], r["n"]) for r in ensemble.confidence(cols).collect())
    assert got == [("-2,2", 1), ("1,0", 1), ("1,1", 2), ("2,1", 1), ("2,2", 2)]
    assert ensemble.best_member(cols).collect()[0]["last_by_total"] == 1


TREE = [(0, None, None), (1, 0, 1.0), (2, 0, 2.0), (3, 1, 1.0), (4, 1, 1.0), (5, 2, 3.0)]


def test_tree(spark):
    t = spark.createDataFrame(TREE, "node bigint, parent bigint, length double")
    assert {r["node"]: r["n_leaves"] for r in trees.subtree_sizes(t).collect()} == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    assert {r["node"] for r in trees.shrubs(t, 2).collect()} == {1, 2}
    lca = trees.lowest_common_ancestor(t, spark.createDataFrame([(3, 4), (3, 5)], "a bigint, b bigint"))
    assert {(r["a"], r["b"]): (r["ancestor"], r["distance"]) for r in lca.collect()} == {(3, 4): (1, 2.0), (3, 5): (0, 7.0)}
    below, above = trees.divide(t, 3, 4)
    assert ({r["node"] for r in below.collect()}, {r["node"] for r in above.collect()}) == ({3, 4}, {5})
    sub = trees.subset(t, spark.createDataFrame([(3,), (5,)], "node bigint"))
    assert {r["node"]: (r["parent"], r["length"]) for r in sub.collect()} == {0: (None, None), 3: (0, 2.0), 5: (0, 5.0)}
    assert abs(sum(r["weight"] for r in trees.sequence_weights(t).collect()) - 1) < 1e-9
    assert [r["node"] for r in trees.join_order(t).orderBy("place").collect()] == [2, 1, 0]


def test_deep_chain(spark):
    t = spark.createDataFrame([(i, i - 1 if i else None, 1.0 if i else None) for i in range(21)], "node bigint, parent bigint, length double")
    assert trees.closure(t).count() == 21 * 22 // 2


def test_relaxation(spark):
    post = spark.createDataFrame([("s", 0, 1, 1, 1, 0.5), ("s", 0, 2, 1, 1, 0.4), ("s", 1, 2, 1, 1, 0.8)], "set_id string, x bigint, y bigint, pos_x bigint, pos_y bigint, p double")
    n = spark.createDataFrame([("s", 3)], "set_id string, n bigint")
    got = {(r["x"], r["y"]): r["p"] for r in posterior.relax(post, n).collect()}
    assert got[0, 1] == pytest.approx((1.0 + 0.4 * 0.8) / 3)


def test_functions(spark):
    df = spark.createDataFrame([("BXY", "sp|P1|x y", 0.0)], "path string, label string, p double")
    r = df.select(L.invert_path("path").alias("i"), L.accession("label").alias("a"), L.kimura("p").alias("k"), L.interpolate("p", [(0.0, 1.0), (1.0, 3.0)]).alias("f")).collect()[0]
    assert (r["i"], r["a"], r["k"], r["f"]) == ("BYX", "P1", 0.0, 1.0)
