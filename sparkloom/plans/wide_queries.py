"""Queries over projections, ensembles, trees, features, fast alignments and clusters by distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions.letters import SYMBOLS
from sparkloom.kernels import mega
from sparkloom.kernels.scores import joint
from sparkloom.operators import ensemble, kmers, msa, profile, score, sequences, trees
from sparkloom.plans import align, groups
from sparkloom.plans import stand_ins as s
from sparkloom.plans.catalog import CLASSIC, ENS, IDENTITY, MEMBER_POS, _families
from sparkloom.plans.registry import COUNTS, GAP, N, PLACED, R, query, rounded
from sparkloom.session import spread

# Projections

RENUMBERED = "SELECT msa_id, seq_id, dense_rank() OVER (PARTITION BY msa_id ORDER BY col) AS col, letter FROM {}"


@query(f"WITH {s.TEST}, chosen AS (SELECT * FROM test WHERE seq_id % 3 = 0), full_ AS (SELECT chosen.* FROM chosen JOIN (SELECT DISTINCT msa_id, col FROM chosen WHERE letter <> '-') USING (msa_id, col)) {RENUMBERED.format('full_')}")
def projected_rows(spark, sf):
    c = s.cells(spark, sf)
    return msa.project(c, c.select("msa_id", "seq_id").where("seq_id % 3 = 0").distinct())


@query(f"WITH {s.TEST} SELECT msa_id, seq_id, col - 3 AS col, letter FROM test WHERE col BETWEEN 4 AND 9 AND seq_id % 2 = 0")
def row_and_column_range(spark, sf):
    c = s.cells(spark, sf)
    return msa.ranges(c, 4, 9, c.select("msa_id", "seq_id").where("seq_id % 2 = 0").distinct())


@query(f"WITH {s.TEST}, more AS (SELECT * FROM test WHERE col NOT IN (2, 5) UNION ALL SELECT msa_id, seq_id, col + {s.WIDTH}, letter FROM test WHERE col = 3) {RENUMBERED.format('more')}")
def edited_columns(spark, sf):
    c = s.cells(spark, sf)
    columns = c.select("msa_id", "col").distinct()
    return msa.edited(c, columns.where("col in (2, 5)"), columns.where("col = 3"))


@query("SELECT p_partkey AS seq_id, p_name AS letters FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def subset_by_ids(spark, sf):
    parts = s.table(spark, sf, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("letters"))
    return sequences.subset(parts, s.table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("seq_id")))


@query(
    f"""WITH {s.TEST}, {COUNTS.format("test")}, enough AS (SELECT msa_id FROM counts WHERE gaps = 0 GROUP BY 1 HAVING count(*) >= 1),
  g AS (SELECT msa_id, col, gaps = 0 AS core, sum(CASE WHEN gaps = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id ORDER BY col) AS grp FROM counts JOIN enough USING (msa_id)),
  i AS (SELECT test.msa_id, seq_id, grp, string_agg(CASE WHEN letter = '-' THEN '' ELSE lower(letter) END, '' ORDER BY col) AS t, max(col) AS last FROM test JOIN g USING (msa_id, col) WHERE NOT core GROUP BY 1, 2, 3),
  w AS (SELECT *, max(length(t)) OVER (PARTITION BY msa_id, grp) - length(t) AS dots FROM i),
  f AS (SELECT msa_id, seq_id, grp, 1 AS kind, CASE WHEN grp = 0 THEN repeat('.', dots) || t WHEN last = {s.WIDTH} THEN t || repeat('.', dots) ELSE repeat('.', dots // 2) || t || repeat('.', dots - dots // 2) END AS t FROM w
    UNION ALL SELECT test.msa_id, seq_id, grp, 0, upper(letter) FROM test JOIN g USING (msa_id, col) WHERE core)
  SELECT msa_id, seq_id, string_agg(t, '' ORDER BY grp, kind) AS row FROM f GROUP BY 1, 2"""
)
def core_alignment(spark, sf):
    """Alignments that have a gap-free column, the others squeezed."""
    return msa.core(s.cells(spark, sf), 1)


@query(
    f"""{ENS}, b AS (SELECT *, CAST(floor(confidence * 10) AS BIGINT) AS bin FROM cc),
  i AS (SELECT *, row_number() OVER (PARTITION BY msa_id, msa_idx ORDER BY col) - row_number() OVER (PARTITION BY msa_id, msa_idx, bin ORDER BY col) AS island FROM b)
  SELECT msa_id, msa_idx, bin, min(col) AS first_col, max(col) AS last_col FROM i GROUP BY msa_id, msa_idx, bin, island"""
)
def confidence_runs(spark, sf):
    return msa.confidence_runs(ensemble.column_confidence(ensemble.columns(s.members(spark, sf))))


@query(
    f"""WITH {s.TEST}, {COUNTS.format("test")}, v AS (SELECT msa_id, 'length' AS what, count(*) FILTER (letter <> '-') AS v FROM test GROUP BY msa_id, seq_id UNION ALL SELECT msa_id, 'gap_percent', gaps * 100 // n_rows FROM counts)
  SELECT msa_id, what, min(v) AS lo, list_sort(list(v))[count(*) // 2 + 1] AS median, max(v) AS hi, {R("avg(v)")} AS mean FROM v GROUP BY 1, 2"""
)
def msa_spread_statistics(spark, sf):
    return rounded(msa.spread_statistics(s.cells(spark, sf)), "mean")


@query(f"SELECT lang, count(*) AS n, min(length(text)) AS lo, max(length(text)) AS hi, {R('avg(length(text))')} AS mean FROM documents GROUP BY lang")
def length_statistics(spark, sf):
    return rounded(sequences.length_statistics(s.documents(spark, sf), ["lang"]), "mean")


@query("""SELECT 'left' AS side, p_name AS letters FROM (SELECT p_name FROM part EXCEPT ALL SELECT p_name FROM part WHERE p_size > 10)
  UNION ALL SELECT 'right', p_name FROM (SELECT p_name FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_name FROM part)""")
def sequence_differences(spark, sf):
    part = s.table(spark, sf, "part").withColumnRenamed("p_name", "letters")
    return sequences.differences(part, part.where("p_size > 10"), ["letters"])


NUCLEO = "CASE WHEN p_partkey % 3 = 0 THEN translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACG') ELSE upper(p_name) END"


@query(f"SELECT p_partkey AS seq_id, CAST(length({NUCLEO}) - length(translate({NUCLEO}, 'ACGTU', '')) > 0.75 * length({NUCLEO}) AS BIGINT) AS nucleotide FROM part")
def nucleotide_sequences(spark, sf):
    """A third of the part names spelled in four letters, told apart from the rest."""
    part = s.table(spark, sf, "part").select(F.col("p_partkey").alias("seq_id"), F.expr(NUCLEO).alias("letters"))
    return part.select("seq_id", sequences.looks_nucleotide("letters").cast("bigint").alias("nucleotide"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def labels_without_match(spark, sf):
    orders = s.table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return sequences.without(s.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


# Ensembles and scores

MEMBER_GOLD = f"""{PLACED.format("gold")}, j AS (SELECT g.msa_id, msa_idx, g.seq_id, g.col AS gold_col, t.col AS test_col, g.letter AS gl, t.letter AS tl FROM (SELECT * FROM gold_pos WHERE letter <> '-') g
    JOIN (SELECT * FROM m_pos WHERE letter <> '-') t ON g.msa_id = t.msa_id AND g.seq_id = t.seq_id AND g.n = t.n)"""


@query(
    f"""{ENS}, {s.GOLD}, {MEMBER_GOLD}, sp AS (SELECT msa_id, msa_idx, gold_col, test_col, count(*) AS n FROM j WHERE gl <> lower(gl) GROUP BY ALL),
  c AS (SELECT msa_id, msa_idx, gold_col, sum(n) AS n, sum(n * (n - 1) // 2) AS r, count(*) AS places FROM sp GROUP BY ALL),
  q AS (SELECT msa_id, msa_idx, sum(r)::DOUBLE / sum(n * (n - 1) // 2) AS q, count(*) FILTER (n > 1 AND places = 1)::DOUBLE / count(*) FILTER (n > 1) AS tc FROM c GROUP BY 1, 2)
  SELECT msa_id, msa_idx, cols, singletons, {R("total")} AS total, {R("total / cols")} AS cc, {R("median")} AS median, {R("1 - median")} AS error, {R("q")} AS q, {R("tc")} AS tc FROM stats LEFT JOIN q USING (msa_id, msa_idx)"""
)
def ensemble_table(spark, sf):
    return rounded(ensemble.member_table(s.members(spark, sf), s.cells(spark, sf, "gold")), "total", "cc", "median", "error", "q", "tc")


@query(
    f"""WITH {s.ENSEMBLE_WHOLE}, {MEMBER_POS}, a AS (SELECT msa_id, msa_idx, seq_id, n, col FROM m_pos WHERE NOT {GAP}), sp AS (SELECT x.msa_id, x.msa_idx AS i, y.msa_idx AS j, y.col AS gc, x.col AS tc, count(*) AS n FROM a x JOIN a y
    ON x.msa_id = y.msa_id AND x.seq_id = y.seq_id AND x.n = y.n AND x.msa_idx <> y.msa_idx GROUP BY ALL),
  ok AS (SELECT msa_id, msa_idx AS j, col AS gc FROM members WHERE NOT {GAP} GROUP BY ALL HAVING count(*) >= 2),
  c AS (SELECT msa_id, i, j, gc, sum(n) AS n, sum(n * (n - 1) // 2) AS r, count(*) AS places FROM sp JOIN ok USING (msa_id, j, gc) GROUP BY ALL),
  q AS (SELECT msa_id, least(i, j) AS a, greatest(i, j) AS b, sum(r)::DOUBLE / sum(n * (n - 1) // 2) AS q, count(*) FILTER (places = 1)::DOUBLE / count(*) AS tc FROM c GROUP BY msa_id, i, j, 2, 3),
  m AS (SELECT msa_id, a, b, avg(q) AS q, avg(tc) AS tc FROM q GROUP BY 1, 2, 3)
  SELECT msa_id, {R("1 - list_sort(list(q))[count(*) // 2 + 1]")} AS d_q, {R("1 - list_sort(list(tc))[count(*) // 2 + 1]")} AS d_tc FROM m GROUP BY 1"""
)
def ensemble_dispersions(spark, sf):
    return rounded(ensemble.dispersions(s.members(spark, sf, whole=True)), "d_q", "d_tc")


@query(
    f"""{ENS}, {s.GOLD}, {MEMBER_GOLD}, sp AS (SELECT msa_id, msa_idx, gold_col, test_col, count(*) AS n FROM j GROUP BY ALL),
  top AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (PARTITION BY msa_id, msa_idx, gold_col ORDER BY n DESC, test_col) AS rk FROM sp WINDOW w AS (PARTITION BY msa_id, msa_idx, gold_col)),
  nr AS (SELECT msa_id, col AS gold_col, count(*) AS nrows FROM gold GROUP BY 1, 2), held AS (SELECT msa_id, msa_idx, test_col AS col, max(CAST(n = total AS BIGINT)) AS "right" FROM top JOIN nr USING (msa_id, gold_col) WHERE rk = 1 AND n >= nrows // 2 GROUP BY 1, 2, 3)
  SELECT CAST(floor(confidence * 10) AS BIGINT) AS bin, count(*) AS columns, {N('sum("right")')} AS "right" FROM cc JOIN held USING (msa_id, msa_idx, col) GROUP BY 1"""
)
def confidence_against_gold(spark, sf):
    """Columns by confidence, and how many are right, of those that stand for a gold column."""
    members = s.members(spark, sf)
    cc = ensemble.column_confidence(ensemble.columns(members))
    held = ensemble.right_columns(members, s.cells(spark, sf, "gold"))
    both = cc.join(held, ["msa_id", "msa_idx", "col"])
    return both.groupBy(F.floor(F.col("confidence") * 10).cast("bigint").alias("bin")).agg(F.count("*").alias("columns"), F.sum("right").cast("bigint").alias("right"))


@query(
    f"""WITH {s.ENSEMBLE}, {s.GOLD}, {MEMBER_POS}, {MEMBER_GOLD}, sp AS (SELECT msa_id, msa_idx, gold_col, test_col, count(*) AS n FROM j GROUP BY ALL), b AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY msa_id, msa_idx, gold_col) AS total,
    row_number() OVER (PARTITION BY msa_id, msa_idx, gold_col ORDER BY n DESC, test_col) AS rk FROM sp) WHERE rk = 1 AND n > total // 2),
  l AS (SELECT j.msa_id, j.seq_id, j.gold_col, count(*) FILTER (j.test_col = b.test_col)::DOUBLE / {s.MEMBERS} AS c FROM j LEFT JOIN b ON j.msa_id = b.msa_id AND j.msa_idx = b.msa_idx AND j.gold_col = b.gold_col GROUP BY 1, 2, 3),
  m AS (SELECT msa_id, gold_col, round(avg(c), 9) AS c FROM l GROUP BY 1, 2)
  SELECT msa_id, string_agg(substr('{SYMBOLS}', 1 + CAST(floor(10 * c) AS INTEGER), 1), '' ORDER BY gold_col) AS symbols FROM m GROUP BY 1"""
)
def letter_confidence_rows(spark, sf):
    return score.confidence_rows(score.letter_confidence(s.members(spark, sf), s.cells(spark, sf, "gold")))


@query(
    f"""WITH {s.TEST_ROWS}, {s.GOLD_ROWS} SELECT t.msa_id, t.seq_id, g.seq_id AS gold_id FROM test_rows t JOIN gold_rows g
  ON t.msa_id = g.msa_id AND lower(replace(replace(t.row, '-', ''), '.', '')) = lower(replace(replace(g.row, '-', ''), '.', ''))"""
)
def rows_by_sequence(spark, sf):
    return score.by_sequence(s.rows(spark, sf), s.rows(spark, sf, "gold"))


@query(
    f"""WITH {s.ENSEMBLE}, {s.GOLD}, {MEMBER_POS}, {PLACED.format("gold")},
  cut AS (SELECT t.msa_id, t.msa_idx, t.seq_id, t.col, CASE WHEN g.letter <> upper(g.letter) THEN '-' ELSE t.letter END AS letter FROM m_pos t
    LEFT JOIN (SELECT * FROM gold_pos WHERE letter <> '-') g ON t.msa_id = g.msa_id AND t.seq_id = g.seq_id AND t.n = g.n AND t.letter <> '-')
  SELECT cut.msa_id, cut.msa_idx, cut.seq_id, cut.col, cut.letter FROM cut JOIN (SELECT DISTINCT msa_id, msa_idx, col FROM cut WHERE letter <> '-') USING (msa_id, msa_idx, col)"""
)
def trim_ensemble_to_reference(spark, sf):
    return msa.trim_ensemble(s.members(spark, sf), s.cells(spark, sf, "gold")).select("msa_id", "msa_idx", "seq_id", "col", "letter")


@query(f"{CLASSIC} SELECT msa_id, tc >= 0.5 AS good FROM q")
def good_alignments(spark, sf):
    return score.quality(s.cells(spark, sf), s.cells(spark, sf, "gold")).select("msa_id", (F.col("tc") >= 0.5).alias("good"))


# Profiles

SHARES = "shares AS (SELECT msa_id, col, letter, count(*)::DOUBLE / any_value(nr) AS share FROM test JOIN (SELECT msa_id, count(*) AS nr FROM test_rows GROUP BY 1) USING (msa_id) WHERE letter <> '-' GROUP BY 1, 2, 3)"


@query(
    f"""WITH {s.TEST}, {SHARES}, m AS (SELECT msa_id, col, round(sum(share), 9) AS total, max(share) AS top, arg_min(letter, (-share, letter)) AS letter FROM (SELECT msa_id, col, letter, round(share, 9) AS share FROM shares) GROUP BY 1, 2)
  SELECT msa_id, string_agg(CASE WHEN total < 0.5 THEN '-' WHEN top < 0.5 THEN lower(letter) ELSE letter END, '' ORDER BY col) AS consensus FROM m GROUP BY 1"""
)
def profile_consensus(spark, sf):
    shares = profile.letter_shares(s.cells(spark, sf))
    return profile.consensus(shares.withColumn("share", F.round("share", 9)))


@query(
    f"""WITH {s.TEST}, {IDENTITY}, alike AS (SELECT msa_id, a, b FROM ident WHERE both_ > 0 AND 100.0 * same / both_ BETWEEN 20 AND 60)
  SELECT least(x.letter, y.letter) AS x, greatest(x.letter, y.letter) AS y, count(*) AS pairs FROM alike JOIN test x ON x.msa_id = alike.msa_id AND x.seq_id = a JOIN test y ON y.msa_id = alike.msa_id AND y.seq_id = b AND y.col = x.col
  WHERE x.letter <> '-' AND y.letter <> '-' GROUP BY 1, 2"""
)
def substitutions_in_window(spark, sf):
    return profile.substitutions_between(s.cells(spark, sf), 20, 60)


WORDS66 = """w AS (SELECT p_brand || '/' || p_type AS set_id, p_partkey AS k, translate(upper(replace(p_name, ' ', '')), 'AGPSTILMVBDENQZHKRFWYCJOUX', '00000111122222233344450000') AS t FROM part),
  k AS (SELECT set_id, k, substr(t, CAST(i AS INTEGER), 6) AS word, count(*) AS n FROM w, range(1, 64) AS r(i) WHERE i <= length(t) - 5 GROUP BY ALL),
  own AS (SELECT k, sum(n) AS o FROM k GROUP BY 1), c AS (SELECT a.set_id, a.k AS x, b.k AS y, sum(least(a.n, b.n)) AS c FROM k a JOIN k b ON a.set_id = b.set_id AND a.word = b.word AND a.k < b.k GROUP BY ALL)"""


@query(f"""WITH {WORDS66} SELECT set_id, x, y, {R("least(3.0 * (p.o - c) / p.o, 3.0 * (q.o - c) / q.o)")} AS d FROM c JOIN own p ON p.k = x JOIN own q ON q.k = y""")
def grouped_word_distance(spark, sf):
    """Distances by words of six letter groups, of pairs of a family that share a word."""
    letters = F.translate(F.upper("letters"), "AGPSTILMVBDENQZHKRFWYCJOUX", "00000111122222233344450000")
    coded = _families(spark, sf).withColumn("t", letters).where("length(t) > 5")
    at = F.sequence(F.lit(1), F.length("t") - 5)
    words = coded.select("set_id", "seq_id", F.explode(F.transform(at, lambda i: F.substring("t", i, F.lit(6)))).alias("kmer")).groupBy("set_id", "seq_id", "kmer").agg(F.count("*").alias("n"))
    side = lambda o: 3.0 * (F.col(o) - F.col("common")) / F.col(o)
    return rounded(kmers.shared(words).select("set_id", F.col("a").alias("x"), F.col("b").alias("y"), F.least(side("own_a"), side("own_b")).alias("d")), "d")


# Trees


@query(
    f"""WITH RECURSIVE {s.TREE}, h AS (SELECT ancestor AS node, max(distance) AS height FROM up JOIN leaf USING (node) GROUP BY 1), kids AS (SELECT parent AS node, count(*) AS kids FROM tree WHERE parent IS NOT NULL GROUP BY 1),
  o AS (SELECT node, sum(kids - 1) OVER (ORDER BY height DESC, node) + 1 AS made FROM h JOIN kids USING (node)), split AS (SELECT node FROM o WHERE made <= 20)
  SELECT node, {R("height")} AS height FROM tree JOIN h USING (node) WHERE node NOT IN (SELECT node FROM split) AND (parent IN (SELECT node FROM split) OR parent IS NULL)"""
)
def tree_cut_by_count(spark, sf):
    return rounded(trees.cut_by_count(s.tree(spark, sf), 20), "height")


@query(f"WITH RECURSIVE {s.TREE} SELECT node, parent, {R('greatest(length, 2.0)')} AS length, n_leaves AS below, (SELECT count(*) FROM leaf) - n_leaves AS beyond FROM tree JOIN size USING (node) WHERE parent IS NOT NULL")
def tree_edges(spark, sf):
    return rounded(trees.edges(s.tree(spark, sf), 2.0), "length")


@query(f"WITH RECURSIVE {s.TREE}, gone AS (SELECT DISTINCT node FROM up WHERE depth > 0 AND ancestor >= 100 AND ancestor < 1000 AND ancestor % 2 = 0) SELECT node, parent, {R('length')} AS length FROM tree WHERE node NOT IN (SELECT node FROM gone)")
def tree_pruned(spark, sf):
    tree = s.tree(spark, sf)
    return rounded(trees.pruned(tree, tree.where("node >= 100 and node < 1000 and node % 2 = 0").select("node")), "length")


@query(
    f"""WITH RECURSIVE {s.TREE} SELECT 'roots' AS fault, count(*) - 1 AS n FROM tree WHERE parent IS NULL UNION ALL SELECT 'repeated nodes', count(*) FROM (SELECT node FROM tree GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'unknown parents', count(*) FROM tree WHERE parent NOT IN (SELECT node FROM tree) UNION ALL SELECT 'single children', count(*) FROM (SELECT parent FROM tree WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
  UNION ALL SELECT 'bad lengths', count(*) FROM tree WHERE parent IS NOT NULL AND (length IS NULL OR length < 0)"""
)
def tree_faults(spark, sf):
    return trees.checked(s.tree(spark, sf))


CHAIN = "chain AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey > 0 THEN CAST(p_partkey - 1 AS BIGINT) END AS parent, CASE WHEN p_partkey > 0 THEN 1.0::DOUBLE END AS length FROM part)"


@query(f"WITH {CHAIN} SELECT node, CAST(1 AS BIGINT) AS n_leaves, (SELECT max(node) FROM chain) - node AS height FROM chain")
def deep_chain_sizes(spark, sf):
    """Leaves below and height of each node of a tree that is one chain of all parts."""
    key = F.col("p_partkey").cast("bigint")
    chain = s.table(spark, sf, "part").select(key.alias("node"), F.when(key > 0, key - 1).alias("parent"), F.when(key > 0, 1.0).alias("length"))
    return trees.subtree_sizes(chain).join(trees.heights(chain).hint("merge"), "node").select("node", "n_leaves", F.col("height").cast("bigint").alias("height"))


@query(f"WITH RECURSIVE {s.TREE}, t AS (SELECT node FROM leaf WHERE node >= 1000) SELECT node, c_name AS label FROM t JOIN customer ON c_custkey + 1000 = node")
def leaf_sequences(spark, sf):
    """The sequence (here the customer's name) of each leaf; a leaf without one is an error."""
    names = s.table(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("bigint").alias("node"), F.col("c_name").alias("label"))
    tips = trees.leaves(s.tree(spark, sf)).where("node >= 1000").join(names, "node", "left")
    return tips.select("node", F.when(F.col("label").isNull(), F.raise_error(F.lit("a leaf without sequence"))).otherwise(F.col("label")).alias("label"))


# Column pairs

PAIRS = """pairs AS (SELECT DISTINCT p_brand AS msa_id, CAST(p_size % 15 + 1 AS BIGINT) AS "left", CAST(p_partkey % 15 + 1 AS BIGINT) AS "right" FROM part WHERE p_partkey % 7 = 0),
  best AS (SELECT msa_id, "left", min("right") AS "right" FROM pairs GROUP BY 1, 2)"""


def _column_pairs(spark, sf):
    part = s.table(spark, sf, "part").where("p_partkey % 7 = 0")
    return part.select(F.col("p_brand").alias("msa_id"), (F.col("p_size") % 15 + 1).cast("bigint").alias("left"), (F.col("p_partkey") % 15 + 1).cast("bigint").alias("right")).distinct()


@query(f"""WITH {PAIRS} SELECT msa_id, "left", "right" FROM (SELECT *, max("right") OVER (PARTITION BY msa_id ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) WHERE before IS NULL OR "right" > before""")
def monotone_columns(spark, sf):
    return groups.monotone(_column_pairs(spark, sf))


@query()
def joined_alignments(spark, sf):
    """Each test alignment beside its gold one, joined on monotone column pairs."""
    return groups.joined_on_columns(s.rows(spark, sf), s.rows(spark, sf, "gold"), groups.monotone(_column_pairs(spark, sf)))


# Kernels over families


@query()
def fast_alignment(spark, sf):
    return groups.fast_alignments(_families(spark, sf))


@query()
def shuffled_alignment(spark, sf):
    return groups.fast_alignments(_families(spark, sf), shuffled=1)


@query()
def best_replicate(spark, sf):
    return groups.best_alignments(_families(spark, sf), 4)


@query()
def distance_clusters(spark, sf):
    return groups.cluster_by_distance(_families(spark, sf), 2.0)


@query()
def distance_clusters_again(spark, sf):
    seqs = _families(spark, sf)
    return groups.cluster_again(seqs, groups.cluster_by_distance(seqs, 2.0), 2.0, 4)


@query()
def accuracy_clusters(spark, sf):
    return groups.cluster_by_accuracy(_families(spark, sf), 0.7)


@query()
def distance_search(spark, sf):
    seqs = _families(spark, sf)
    return groups.search(seqs.where("seq_id % 10 = 0"), seqs, 1.5)


@query()
def accuracy_order(spark, sf):
    seqs = _families(spark, sf)
    return groups.by_accuracy(seqs.where("seq_id % 10 = 0"), seqs)


@query()
def local_similarities(spark, sf):
    return groups.local_tree(_families(spark, sf))[0]


@query()
def local_score_tree(spark, sf):
    return groups.local_tree(_families(spark, sf))[1]


@query()
def aligned_rows_tree(spark, sf):
    return groups.aligned_tree(s.rows(spark, sf).withColumnRenamed("msa_id", "set_id"))


@query()
def super6_alignment(spark, sf):
    return groups.align_by_clusters(_families(spark, sf), 1.5, 20)


@query()
def super7_alignment(spark, sf):
    """Nations of a region as one family, by the tree of regions and nations."""
    tree = s.tree(spark, sf).where("node < 1000")
    nation = s.table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("seq_id"), F.translate("n_name", " ", "").alias("letters"))
    return groups.align_by_tree(nation, tree, 4)


@query()
def queries_against_alignments(spark, sf):
    seqs = _families(spark, sf)
    rows = groups.fast_alignments(seqs.where("seq_id % 10 > 0"))
    return groups.against_alignments(seqs.where("seq_id % 10 = 0"), rows)


# Several features a place: the letter, and whether it is a vowel and where in the word it stands


def features() -> list[mega.Feature]:
    q, p = joint()
    kinds = np.array([[0.3, 0.1], [0.1, 0.5]])
    near = np.array([[0.25, 0.08, 0.02], [0.08, 0.2, 0.05], [0.02, 0.05, 0.25]])
    return [mega.Feature("AA", 0.6, p[:20], q[:20, :20]), mega.Feature("Vowel", 0.2, kinds.sum(axis=1), kinds), mega.Feature("Place", 0.2, near.sum(axis=1), near)]


def symbols(letters: str) -> list[str]:
    return [c.upper() + ("A" if c.lower() in "aeiou" else "B") + "ABC"[3 * i // len(letters)] for i, c in enumerate(letters)]


def _of_pairs(pairs, name: str, one, columns: str):
    def score(x: str, y: str):
        f = features()
        return one(mega.code(symbols(x), f), mega.code(symbols(y), f), f)

    return align.scored(pairs, ("features", name), score, columns)


@query()
def feature_accuracy(spark, sf):
    from sparkloom.kernels.hmm import expected_accuracy

    return _of_pairs(align.pairs_within(_families(spark, sf)), "accuracy", lambda x, y, f: (expected_accuracy(mega.posterior(x, y, f)),), "ea double")


@query()
def feature_viterbi(spark, sf):
    return _of_pairs(align.pairs_within(_families(spark, sf)), "viterbi", lambda x, y, f: mega.viterbi(x, y, f)[::3], "score double, path string")


def _feature_rows(pdf: pd.DataFrame, refine: int):
    f = features()
    coded = [mega.code(symbols(x), f) for x in pdf["letters"]]
    return f, coded, mega.align(coded, f, refine=refine)


@query()
def feature_alignment(spark, sf):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        rows = _feature_rows(pdf, 5)[2]
        return pd.DataFrame({"set_id": key[0], "seq_id": pdf["seq_id"], "row": ["".join(x[p].upper() if p >= 0 else "-" for p in r) for x, r in zip(pdf["letters"], rows.tolist(), strict=True)]})

    return spread(_families(spark, sf), "set_id").groupBy("set_id").applyInPandas(run, align.ROWS)


def _column_models(seqs):
    """(set_id, consensus, model) of each family of (set_id, seq_id, letters)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        f, coded, rows = _feature_rows(pdf, 0)
        columns = mega.column_model(rows, coded, f)
        return pd.DataFrame({"set_id": [key[0]], "consensus": [mega.consensus(columns)], "model": [mega.model_text(key[0], columns, f, len(coded), 0.69, 0.05)]})

    return spread(seqs, "set_id").groupBy("set_id").applyInPandas(run, "set_id string, consensus string, model string")


@query()
def feature_column_models(spark, sf):
    """The consensus of each family's column model, and the model as text."""
    return _column_models(_families(spark, sf))


@query()
def feature_model_search(spark, sf):
    """Local alignment of a quarter of each family with the column model of the rest, by all features and by letters alone."""
    models = _column_models(_families(spark, sf).where("seq_id % 4 > 0")).select("set_id", "model")

    def run(batches):
        f = features()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                head, columns, _ = mega.parse_model(r.model)
                all_ = mega.search(columns, mega.code(symbols(r.letters), f), f, head["gap_open"], head["gap_extend"])
                plain = mega.search_letters(columns, r.letters, f, head["gap_open"], head["gap_extend"])
                out.append((r.set_id, r.seq_id, all_[0], all_[3], plain[0], plain[3]))
            yield pd.DataFrame(out, columns=["set_id", "seq_id", "score", "path", "letter_score", "letter_path"])

    held = _families(spark, sf).where("seq_id % 4 = 0").join(models, "set_id").select("set_id", "seq_id", "letters", "model")
    return held.mapInPandas(run, "set_id string, seq_id bigint, score double, path string, letter_score double, letter_path string")
