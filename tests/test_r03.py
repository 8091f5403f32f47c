"""Findings of round 3, each with what would have failed before."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.kernels import blocks, family, guide, hmm, mega
from sparkloom.operators import ensemble, kmers
from sparkloom.plans import align, catalog, groups, wide_queries
from tests.test_oracles import TABLES, plain


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        if (folder / f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = [r.asDict() for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    cursor = con.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert got and plain(got, sorted(names)) == plain(want, sorted(names))
    return got


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """A part table with names beyond fifteen letters, in one brand."""
    folder = tmp_path_factory.mktemp("parts")
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN 'small green stone and a big blue one' ELSE 'big ring ' || repeat('of gold ', i % 4) END AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type,
      CAST(i % 50 AS INTEGER) AS p_size, 900.0 AS p_retailprice FROM range(12) t(i)) TO '{folder}/part.parquet'""")
    return folder


def test_dispersions_read_whole_rows(spark, parts):
    got = against_sql(spark, parts, "ensemble_dispersions")
    cut = ensemble.dispersions(catalog.s.members(spark, str(parts))).first()
    assert round(cut["d_q"], 6) != got[0]["d_q"]


def test_columns_of_one_letter_do_not_count(spark):
    rows = [("m", k, i, 1 + c, x) for k, pair in enumerate((("AC-", "AC-"), ("AC-", "A-C"))) for i, row in enumerate(pair) for c, x in enumerate(row)]
    df = spark.createDataFrame(rows, "msa_id string, msa_idx bigint, seq_id bigint, col bigint, letter string")
    r = ensemble.pair_scores(df).first()
    # Against the first member one of two columns is right; the second has one column of two letters, which is.
    assert (r["q"], r["tc"]) == (0.75, 0.75)
    with pytest.raises(Exception, match="letters differ"):
        ensemble.pair_scores(df.withColumn("letter", F.when(F.expr("msa_idx = 1 and col = 1"), "G").otherwise(F.col("letter")))).collect()


def test_closeness_and_merges_use_all_pairs():
    """Before: 8 pairs of a closeness, 2,000 of a merge."""
    few, more = ["ACDEFG"] * 9 + ["WYWYWY"], ["WYWYWY"]
    pair = lambda x, y: hmm.expected_accuracy(hmm.pair_posterior(x, y))
    assert blocks.closeness(few, more) == pytest.approx((9 * pair(few[0], more[0]) + pair(more[0], more[0])) / 10)
    left, right = ["ACDEF-G"] * 4000 + ["WYWY-WY"], ["WYWYWY"]
    total = np.zeros((7, 6))
    total[[0, 1, 2, 3, 4, 6]] += 4000 * hmm.pair_posterior("ACDEFG", right[0])
    total[[0, 1, 2, 3, 5, 6]] += hmm.pair_posterior(right[0], right[0])
    path = hmm.max_accuracy(total / 4001)[0]
    a, b = family.merge(left, right)
    assert len(a) == 4001 and {r.replace("-", "") for r in a + b} == {"ACDEFG", "WYWYWY"}
    assert [x == "-" for x in b[0]] == [c == "X" for c in path]
    assert [x == "-" for x in a[0]] == [c == "Y" or at == 5 for c, at in zip(path, np.cumsum([c != "Y" for c in path]) - 1, strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_merges_against_all_closenesses(seed):
    rng = np.random.default_rng(seed)
    names = ["ACDEFGHI", "ACDFGHI", "WWYYPPQQ", "WYPPQQR", ""][: 4 + seed % 2]
    given = [([i], [names[rng.integers(len(names))] or "--"]) for i in range(9)]
    parts, joins = dict(enumerate(given)), []
    while len(parts) > 1:
        score = {(i, j): round(blocks.closeness(parts[i][1], parts[j][1]), 12) for i in parts for j in parts if i < j}
        i, j = min(score, key=lambda p: (-score[p], p))
        joins.append((i, j))
        parts[8 + len(joins)] = blocks._joined(parts.pop(i), parts.pop(j))
    assert blocks.merge_greedily(given) == (*parts[8 + len(joins)], joins)


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("ACDEW"), 7)) for _ in range(14)]
    table = [("a", i, names[rng.integers(14)]) for i in range(40)] + [("b", i, names[i]) for i in range(3)]
    return spark.createDataFrame(table, "set_id string, seq_id bigint, letters string")


def test_pairs_meet_in_blocks(sequences):
    rows = sequences.collect()
    want = sorted((a["set_id"], a["seq_id"], b["seq_id"], a["letters"], b["letters"]) for a in rows for b in rows if a["set_id"] == b["set_id"])
    some = align.pairs_between(sequences.where("seq_id % 2 = 0"), sequences, 7)
    assert sorted(map(tuple, some.collect())) == [r for r in want if r[1] % 2 == 0]
    ea = align.expected_accuracies(align.pairs_within(sequences))
    assert ea.rdd.getNumPartitions() >= 8 * sequences.sparkSession.sparkContext.defaultParallelism
    got = {(r["set_id"], r["x"], r["y"]): r["ea"] for r in ea.collect()}
    assert got == {(s, x, y): hmm.expected_accuracy(hmm.posterior(hmm.Model().code(a), hmm.Model().code(b))) for s, x, y, a, b in want if x < y}


def test_accuracy_clusters_see_all_centroids(sequences):
    """Before: only those of the round in which a sequence was first reached."""
    found = {(r["set_id"], r["seq_id"]): r for r in groups.cluster_by_accuracy(sequences, 0.9, 2).collect()}
    letters = {(r["set_id"], r["seq_id"]): r["letters"] for r in sequences.collect()}
    ea = lambda s, x, y: hmm.pair_accuracy(letters[s, x], letters[s, y])
    centres: dict = {}
    for s, i in sorted(letters):
        if not any(ea(s, c, i) > 0.9 for c in centres.get(s, [])):
            centres.setdefault(s, []).append(i)
    assert len(centres["a"]) > 2
    for s, i in letters:
        want = (i, 1.0) if i in centres[s] else min(((c, ea(s, i, c)) for c in centres[s]), key=lambda x: (-x[1], x[0]))
        assert (found[s, i]["centroid_id"], found[s, i]["ea"]) == want


def test_column_models_read_all_sequences(spark, sf):
    sizes = {r["set_id"]: r["count"] for r in catalog._families(spark, sf).groupBy("set_id").count().collect()}
    models = {r["set_id"]: int(r["model"].split("\t")[1]) for r in catalog.QUERIES["feature_column_models"](spark, sf).collect()}
    assert models == sizes


@pytest.mark.parametrize("seed", range(3))
def test_alignment_of_kinds_is_that_of_all(seed):
    rng = np.random.default_rng(seed)
    f = wide_queries.features()
    coded = [mega.code(wide_queries.symbols(["gear", "ear", "gears", "olive"][k]), f) for k in rng.integers(0, 4, 9)]
    post = {(i, j): mega.posterior(coded[i], coded[j], f).astype(np.float32) for i in range(9) for j in range(i + 1, 9)}
    whole = family.assemble(post, [len(c) for c in coded], 2, 3)
    assert mega.align(coded, f, refine=3).tolist() == whole.rows[np.argsort(whole.ids)].tolist()


@pytest.mark.parametrize("linkage", ["min", "max", "avg", "avgs", "biased"])
def test_joins_are_the_first_least_ones(linkage):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        d = rng.integers(0, 5, (12, 12)).astype(float)
        d = d + d.T
        joins, left = [], d.copy()
        np.fill_diagonal(left, np.inf)
        name, size = list(range(12)), [1] * 12
        for k in range(11):
            i, j = sorted(np.unravel_index(left.argmin(), left.shape))
            joins.append((name[i], name[j], left[i, j] / 2))
            a, b = left[i].copy(), left[j].copy()
            left[i] = left[:, i] = {"min": np.minimum(a, b), "max": np.maximum(a, b), "avg": (a + b) / 2, "avgs": (size[i] * a + size[j] * b) / (size[i] + size[j]), "biased": 0.1 * ((a + b) / 2) + 0.9 * np.minimum(a, b)}[linkage]
            left[i, i], left[j], left[:, j] = np.inf, np.inf, np.inf
            name[i], size[i] = 12 + k, size[i] + size[j]
        assert guide.agglomerate(d, linkage) == joins


@pytest.mark.parametrize("block", [(1 << 18, 1 << 12), (40, 3)])
@pytest.mark.parametrize("letters", ["AB", "ACDEFGHIKL"])
def test_common_words_in_blocks(spark, letters, block):
    rng = np.random.default_rng(len(letters))
    counted = {(s, i, "".join(rng.choice(list(letters), 2))): int(rng.integers(1, [4, 1 << 30][i == 3])) for s in "xy" for i in range(11) for _ in range(9)}
    df = spark.createDataFrame([(*k, n) for k, n in counted.items()], "set_id string, seq_id bigint, kmer string, n bigint")
    own, want = {}, {}
    for (s, i, w), n in counted.items():
        own[s, i] = own.get((s, i), 0) + n
        for j in range(i + 1, 11):
            if (s, j, w) in counted:
                want[s, i, j] = want.get((s, i, j), 0) + min(n, counted[s, j, w])
    got = {tuple(r)[:3]: tuple(r)[3:] for r in kmers.shared(df, block).collect()}
    assert got == {(s, i, j): (c, own[s, i], own[s, j]) for (s, i, j), c in want.items()}
