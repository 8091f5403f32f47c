"""Queries over trees, models, benchmark construction, blocks and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.kernels import blocks, guide
from sparkloom.operators import benchsets, models, msa, trees
from sparkloom.plans import align, tuning
from sparkloom.plans import stand_ins as s
from sparkloom.plans.registry import COUNTS, R, query, rounded
from sparkloom.session import spread



@query(
    f"""WITH RECURSIVE {s.TREE}, below AS (SELECT DISTINCT up.node FROM up JOIN leaf USING (node) WHERE ancestor = 3)
  SELECT node, CAST(node IN (SELECT node FROM below) AS BIGINT) AS inside FROM leaf"""
)
def divide_tree(spark, sf):
    """Leaves below the lowest common ancestor of two nations of the third region, and the others."""
    third = s.table(spark, sf, "nation").where("n_regionkey = 2").agg(F.min("n_nationkey"), F.max("n_nationkey")).first()
    inside, outside = trees.divide(s.tree(spark, sf), third[0] + 100, third[1] + 100)
    mark = lambda df, v: df.select("node", F.lit(v).cast("bigint").alias("inside"))
    return mark(inside, 1).union(mark(outside, 0))


@query(
    f"""WITH RECURSIVE {s.TREE}, tip AS (SELECT node FROM leaf WHERE node >= 1000 AND node % 7 = 0),
  held AS (SELECT DISTINCT ancestor AS node FROM up JOIN tip USING (node)),
  fork AS (SELECT tree.parent AS node FROM tree JOIN held USING (node) WHERE tree.parent IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
  kept AS (SELECT node FROM tip UNION SELECT node FROM fork),
  near AS (SELECT up.node, up.ancestor, up.distance, row_number() OVER (PARTITION BY up.node ORDER BY up.depth) AS r FROM up JOIN kept USING (node) WHERE depth > 0 AND up.ancestor IN (SELECT node FROM fork))
  SELECT kept.node, near.ancestor AS parent, {R("near.distance")} AS length FROM kept LEFT JOIN near ON near.node = kept.node AND r = 1"""
)
def tree_subset_nodes(spark, sf):
    tree = s.tree(spark, sf)
    tips = trees.leaves(tree).where("node >= 1000 and node % 7 = 0")
    return rounded(trees.subset(tree, tips), "length")


@query(
    f"""WITH RECURSIVE {s.TREE}, inner_ AS (SELECT parent AS node, min(node) AS "left", max(node) AS "right" FROM tree WHERE parent IS NOT NULL GROUP BY 1)
  SELECT row_number() OVER (ORDER BY n_leaves, node) AS place, node, "left", "right" FROM inner_ JOIN size USING (node)"""
)
def guide_tree_join_order(spark, sf):
    return trees.join_order(s.tree(spark, sf))


@query()
def permuted_trees(spark, sf):
    """Joins of each family's guide tree in each order of its three largest parts."""
    ea = align.expected_accuracies(align.pairs_within(_families(spark, sf)))
    joins = align.upgma(ea.select("set_id", "x", "y", (1 - F.col("ea")).alias("d")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = len(pdf) + 1
        names = sorted({v for v in [*pdf["left"], *pdf["right"]] if v >= 0})
        at = {v: i for i, v in enumerate(names)} | {-(k + 1): n + k for k in range(len(pdf))}
        plain = [(at[a], at[b], h) for a, b, h in zip(pdf["left"], pdf["right"], pdf["height"], strict=True)]
        node = [*names, *(-(k + 1) for k in range(len(plain)))]
        rows = [(key[0], how, k + 1, node[a], node[b], h) for how in ("none", "abc", "acb", "bca") for k, (a, b, h) in enumerate(guide.permuted(plain, n, how))]
        return pd.DataFrame(rows, columns=["set_id", "perm", "place", "left", "right", "height"])

    return joins.groupBy("set_id").applyInPandas(run, "set_id string, perm string, place bigint, left bigint, right bigint, height double")


def _families(spark, sf):
    part = s.table(spark, sf, "part")
    return part.select(F.concat_ws("/", "p_brand", "p_type").alias("set_id"), F.col("p_partkey").cast("bigint").alias("seq_id"), F.translate("p_name", " ", "").alias("letters"))


# Columns


@query(
    f"""WITH {s.TEST}, {COUNTS.format("test")}, full_ AS (SELECT msa_id, col, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS n FROM counts WHERE gaps = 0)
  SELECT msa_id, count(*) AS core, max(col) AS last_core FROM full_ GROUP BY 1"""
)
def gap_free_core(spark, sf):
    """Gap-free columns of each alignment: the core that squeezing keeps."""
    c = s.cells(spark, sf)
    return msa.match_columns(c, 0.0).groupBy("msa_id").agg(F.count("*").alias("core"), F.max("col").alias("last_core"))


@query(f"WITH {s.TEST} SELECT msa_id, seq_id, col, letter FROM test WHERE col % 5 <> 0")
def strip_anchors(spark, sf):
    """Every fifth column is made an anchor, a digit in all rows, and goes."""
    anchored = F.when(F.col("col") % 5 == 0, (F.col("col") / 5).cast("int").cast("string")).otherwise(F.col("letter"))
    return msa.strip_anchors(s.cells(spark, sf).withColumn("letter", anchored))


@query(
    f"""WITH {s.TEST}, ident AS (SELECT a.msa_id, a.seq_id AS a, b.seq_id AS b, count(*) AS both_, count(*) FILTER (a.letter = b.letter) AS same FROM test a
    JOIN test b ON a.msa_id = b.msa_id AND a.col = b.col AND a.seq_id < b.seq_id WHERE a.letter <> '-' AND b.letter <> '-' GROUP BY 1, 2, 3)
  SELECT CAST(floor(100 * same / both_) AS BIGINT) AS percent, count(*) AS pairs FROM ident GROUP BY 1"""
)
def identity_histogram(spark, sf):
    return benchsets.identity_histogram(msa.row_pairs(s.cells(spark, sf)))


@query()
def core_blocks(spark, sf):
    """Rectangles of upper-case letters of each gold alignment."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = blocks.core_blocks(list(pdf.sort_values("seq_id")["row"]), 2, 3)
        return pd.DataFrame([(key[0], *b) for b in found], columns=["msa_id", "top", "left", "height", "width"])

    return s.rows(spark, sf, "gold").groupBy("msa_id").applyInPandas(run, "msa_id string, top bigint, left bigint, height bigint, width bigint")


# Models: the nations of a region stand for a part's parameters

PARAMETERS = """p AS (SELECT CAST(0 AS BIGINT) AS model, n_regionkey AS part, n_name AS name, (n_nationkey + 1.0::DOUBLE) / sum(n_nationkey + 1.0::DOUBLE) OVER (PARTITION BY n_regionkey) AS value FROM nation),
  moved AS (SELECT model, part, name, value * (1 + ((row_number() OVER (PARTITION BY part ORDER BY name) * 7919 + 3 * 104729) % 51 - 25) / 100.0::DOUBLE) AS value FROM p),
  fresh AS (SELECT model, part, name, value / sum(value) OVER (PARTITION BY part) AS value FROM moved)"""


def _parameters(spark, sf):
    nation = s.table(spark, sf, "nation")
    raw = nation.select(F.lit(0).cast("bigint").alias("model"), F.col("n_regionkey").alias("part"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("double").alias("value"))
    return models.normalized(raw)


@query(f"WITH {PARAMETERS} SELECT model, part, name, {R('value')} AS value FROM fresh")
def perturbed_model(spark, sf):
    return rounded(models.perturbed(_parameters(spark, sf), 3), "value")


@query(f"WITH {PARAMETERS} SELECT p.model, p.part, count(*) AS n, {R('avg(abs(p.value - fresh.value))')} AS delta FROM p JOIN fresh USING (model, part, name) GROUP BY 1, 2")
def model_deltas(spark, sf):
    p = _parameters(spark, sf)
    return rounded(models.deltas(p, models.perturbed(p, 3)), "delta")


@query(f"WITH {PARAMETERS} SELECT model, part, count(*) AS n, {R('sum(value)')} AS total, {R('sum(-value * log2(value))')} AS entropy FROM p GROUP BY 1, 2")
def model_report(spark, sf):
    return rounded(models.report(_parameters(spark, sf)), "total", "entropy")


# Benchmark construction: order lines stand for regions of families (parts) in sequences (orders)

REGIONS = """r AS (SELECT l_partkey % 200 AS family, l_orderkey AS seq_id, CAST(l_linenumber * 60 AS BIGINT) AS start, CAST(l_linenumber * 60 + l_quantity AS BIGINT) AS stop,
    CAST(200 AS BIGINT) AS seq_length, l_linenumber = 1 AS main, CAST(l_partkey % 200 % 40 AS BIGINT) AS core FROM lineitem)"""


def _regions(spark, sf):
    line = s.table(spark, sf, "lineitem")
    big = lambda c: c.cast("bigint")
    family, start = F.col("l_partkey") % 200, F.col("l_linenumber") * 60
    return line.select(
        family.alias("family"), F.col("l_orderkey").alias("seq_id"), big(start).alias("start"), big(start + F.col("l_quantity")).alias("stop"),
        big(F.lit(200)).alias("seq_length"), (F.col("l_linenumber") == 1).alias("primary"), big(family % 40).alias("core"),
    )


@query(
    f"""WITH {REGIONS}, c AS (SELECT *, stop - start + 1 AS size, sum(stop - start + 1) OVER (PARTITION BY seq_id) AS covered FROM r),
  fit AS (SELECT * FROM c WHERE size >= 30 AND covered >= 0.5 * seq_length AND size >= 0.1 * seq_length)
  SELECT family, count(*) AS members, max(core) AS core, {R("avg(CASE WHEN main THEN 1.0 ELSE 0.0 END)")} AS primary_share FROM fit GROUP BY 1
  HAVING count(*) >= 8 AND max(core) >= 10 AND avg(CASE WHEN main THEN 1.0 ELSE 0.0 END) >= 0.1"""
)
def select_families(spark, sf):
    return rounded(benchsets.select_families(_regions(spark, sf), least_coverage=0.5, least_primary=0.1), "primary_share")


@query(
    """WITH r AS (SELECT l_partkey % 3 AS family, l_orderkey AS seq_id, l_linenumber AS start FROM lineitem),
  d AS (SELECT seq_id, string_agg(CAST(family AS VARCHAR), '+' ORDER BY start, family) AS domains FROM r GROUP BY 1),
  g AS (SELECT domains, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, domains) AS place FROM d GROUP BY 1 HAVING count(*) >= 3),
  u AS (SELECT domains, place, unnest(list_distinct(string_split(domains, '+'))) AS family FROM g),
  f AS (SELECT domains, place, min(place) OVER (PARTITION BY family) AS first FROM u)
  SELECT domains, any_value(n) AS n, g.place, bool_and(first = f.place) AS taken FROM f JOIN g USING (domains) GROUP BY domains, g.place"""
)
def domain_groups(spark, sf):
    line = s.table(spark, sf, "lineitem")
    return benchsets.domain_groups(line.select((F.col("l_partkey") % 3).alias("family"), F.col("l_orderkey").alias("seq_id"), F.col("l_linenumber").alias("start")), 3)


# Merges and accuracy


@query()
def greedy_merge(spark, sf):
    """Each family's sequences as alignments of one row, merged closest first."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        ids, rows, _ = blocks.merge_greedily([([i], [x.upper()]) for i, x in zip(pdf["seq_id"], pdf["letters"], strict=True)])
        return pd.DataFrame({"set_id": key[0], "seq_id": ids, "row": rows})

    return spread(_families(spark, sf), "set_id").groupBy("set_id").applyInPandas(run, align.ROWS)


@query()
def bench_accuracy(spark, sf):
    """Mean accuracy of aligned families against the same families with refinement."""
    families = _families(spark, sf)
    return tuning.bench(families, align.align_families(families, 1, 3), consistency=1)


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7919 % 10007, p_partkey) AS r FROM part WHERE p_partkey % 2 = 0),
  y AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 7919 % 10007, p_partkey) AS r FROM part WHERE p_partkey % 2 = 1),
  b AS (SELECT x.p_brand AS set_id, x.p_partkey AS x, y.p_partkey AS y, row_number() OVER (PARTITION BY x.p_brand ORDER BY (x.p_partkey * 7919 + y.p_partkey * 104729) % 10007, x.p_partkey, y.p_partkey) AS r
    FROM x JOIN y ON x.p_brand = y.p_brand WHERE x.r <= 8 AND y.r <= 8)
  SELECT set_id, x, y FROM b WHERE r <= 50"""
)
def sampled_pairs(spark, sf):
    """Pairs of names across the two halves of each brand, at most fifty a brand."""
    part = s.table(spark, sf, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").cast("bigint").alias("seq_id"))
    mixed = lambda x, y=None: (x * 7919 if y is None else x * 7919 + y * 104729) % 10007
    return benchsets.sampled_pairs(part.where("seq_id % 2 = 0"), part.where("seq_id % 2 = 1"), 50, order=mixed)


@query(
    """WITH o AS (SELECT CAST(c_custkey AS BIGINT) AS leaf, row_number() OVER (ORDER BY c_custkey * 7919 % 1000003, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer)
  SELECT leaf AS node, -least(k, n - 2) - 1 AS parent, 1.0::DOUBLE AS length FROM o
  UNION ALL SELECT -k - 1, CASE WHEN k > 0 THEN -k END, CASE WHEN k > 0 THEN 1.0::DOUBLE END FROM o WHERE k < n - 1"""
)
def random_chain_tree(spark, sf):
    """(node, parent, length): customers in a mixed order, each hung one step below the one before."""
    key = F.col("c_custkey").cast("bigint")
    return trees.chain(s.table(spark, sf, "customer").select(key.alias("leaf"), ((key * 7919) % 1000003).alias("o")))
