"""A test alignment against a gold one: residue pairs and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.letters import confidence_symbol, is_gap, is_upper
from sparkloom.operators import msa, sequences


def residue_join(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, seq_id, pos, gold_col, test_col, gold_letter, test_letter): the same residue in both."""
    place = lambda df, side: msa.positions(df).where("pos is not null").select("msa_id", "seq_id", "pos", F.col("col").alias(f"{side}_col"), F.col("letter").alias(f"{side}_letter"))
    return place(gold, "gold").join(place(test, "test").hint("merge"), ["msa_id", "seq_id", "pos"])


def by_sequence(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(seq_id, gold_id) of rows with equal letters, for alignments that label them differently. Rows: (msa_id, seq_id, row)."""
    key = F.struct("msa_id", F.lower(F.translate("row", "-.", "")).alias("k")).alias("set_id")
    keyed = lambda rows: rows.select(key, "seq_id", F.lit("").alias("letters"))
    return sequences.pairs_between(keyed(test), keyed(gold)).select(F.col("set_id.msa_id").alias("msa_id"), F.col("x").alias("seq_id"), F.col("y").alias("gold_id"))


def column_scores(test: DataFrame, gold: DataFrame, mode: str = "classic", most_gaps: float = 1.0) -> DataFrame:
    """For each scored gold column: n residues, pairs, right pairs, whether the column is right.

    classic: columns by their upper-case residues, right only with two residues or more, all upper
    case in the test. strict: columns upper case as a whole with at most a share of gaps; a column of
    one residue is right, and letters that differ are an error.
    """
    joined = residue_join(test, gold)
    if mode == "classic":
        joined = joined.where(is_upper("gold_letter"))
    else:
        joined = joined.join(msa.aligned_columns(gold, most_gaps).withColumnRenamed("col", "gold_col"), ["msa_id", "gold_col"], "left_semi")
        differ = F.lower("gold_letter") != F.lower("test_letter")
        joined = joined.withColumn("pos", F.when(differ, F.raise_error(F.lit("letters differ")).cast("bigint")).otherwise(F.col("pos")))
    upper = F.sum(F.when(is_upper("test_letter"), 1).otherwise(0))
    spots = joined.groupBy("msa_id", "gold_col", "test_col").agg(F.count("*").alias("n"), upper.alias("uppers"))
    c = spots.groupBy("msa_id", "gold_col").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("right_pairs"), F.count("*").alias("places"), F.sum("uppers").alias("uppers")
    )
    one_place = F.col("places") == 1
    right = (one_place & (F.col("n") > 1) & (F.col("uppers") == F.col("n"))) if mode == "classic" else one_place
    return c.select("msa_id", "gold_col", "n", F.expr("n * (n - 1) div 2").alias("pairs"), "right_pairs", right.cast("bigint").alias("right"))


def quality(test: DataFrame, gold: DataFrame, mode: str = "classic", most_gaps: float = 1.0) -> DataFrame:
    """(msa_id, q, tc): share of gold pairs and of gold columns that the test has; null where there is nothing to score."""
    c = column_scores(test, gold, mode, most_gaps)
    scored = F.col("n") > 1 if mode == "classic" else F.lit(True)
    total = F.sum(F.when(scored, 1).otherwise(0))
    return c.groupBy("msa_id").agg(
        F.when(F.sum("pairs") > 0, F.sum("right_pairs") / F.sum("pairs")).alias("q"), F.when(total > 0, F.sum("right") / total).alias("tc")
    )


def directory_average(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_sets"), F.avg("q").alias("q"), F.avg("tc").alias("tc"))


def best_columns(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, gold_col, test_col, n): the test column with most of a gold column's residues, if over half; ties to the left one."""
    spots = residue_join(test, gold).groupBy("msa_id", "gold_col", "test_col").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("msa_id", "gold_col"))
    rank = F.row_number().over(Window.partitionBy("msa_id", "gold_col").orderBy(F.desc("n"), "test_col"))
    return spots.withColumn("total", total).withColumn("r", rank).where("r = 1 and n > total div 2").select("msa_id", "gold_col", "test_col", "n")


def pair_quality(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, q): mean over consecutive gold rows (by seq_id) of the share of their aligned pairs that the test has."""
    rows = gold.select("msa_id", "seq_id").distinct().withColumn("next", F.lead("seq_id").over(Window.partitionBy("msa_id").orderBy("seq_id"))).where("next is not null")
    j = residue_join(test, gold).select("msa_id", "seq_id", "gold_col", "test_col")
    first = j.join(rows, ["msa_id", "seq_id"])
    second = j.select("msa_id", F.col("seq_id").alias("next"), "gold_col", F.col("test_col").alias("other"))
    pairs = first.join(second, ["msa_id", "next", "gold_col"]).groupBy("msa_id", "seq_id").agg((F.sum((F.col("test_col") == F.col("other")).cast("int")) / F.count("*")).alias("q"))
    return pairs.groupBy("msa_id").agg(F.avg("q").alias("q"))


def letter_confidence(members: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, seq_id, gold_col, confidence): share of ensemble members in which a gold residue lies in its column's best test column."""
    split = lambda c: F.split(c, "\t")
    glue = F.concat_ws("\t", "msa_id", F.col("msa_idx").cast("string"))
    test = members.withColumn("msa_id", glue).select("msa_id", "seq_id", "col", "letter")
    golds = members.select("msa_id", "msa_idx").distinct().join(gold, "msa_id").withColumn("msa_id", glue).select("msa_id", "seq_id", "col", "letter")
    best = best_columns(test, golds).select("msa_id", "gold_col", F.col("test_col").alias("best"))
    j = residue_join(test, golds).join(best, ["msa_id", "gold_col"], "left")
    n = members.select("msa_id", "msa_idx").distinct().groupBy("msa_id").agg(F.count("*").alias("m"))
    hits = j.withColumn("msa_id", split("msa_id")[0]).groupBy("msa_id", "seq_id", "gold_col").agg(F.sum(F.coalesce((F.col("test_col") == F.col("best")).cast("int"), F.lit(0))).alias("hits"))
    return hits.join(n, "msa_id").select("msa_id", "seq_id", "gold_col", (F.col("hits") / F.col("m")).alias("confidence"))


def confidence_rows(letters: DataFrame) -> DataFrame:
    """(msa_id, symbols): the mean letter confidence of each gold column as a symbol, from (msa_id, gold_col, confidence)."""
    each = letters.groupBy("msa_id", "gold_col").agg(F.round(F.avg("confidence"), 9).alias("c"))
    packed = F.array_sort(F.collect_list(F.struct("gold_col", confidence_symbol("c").alias("s"))))
    return each.groupBy("msa_id").agg(F.array_join(F.transform(packed, lambda x: x["s"]), "").alias("symbols"))


def compare_columns(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, test_col, gold_col, n): the gold column that most residues of a test column lie in, counted anew for each column."""
    swapped = best_columns(gold, test)
    return swapped.select("msa_id", F.col("gold_col").alias("test_col"), F.col("test_col").alias("gold_col"), "n")


def aligned_pairs(cells: DataFrame) -> DataFrame:
    """(msa_id, a, b, pos_a, pos_b): residues that an alignment puts into one column."""
    p = msa.positions(cells).where(~is_gap("letter")).select("msa_id", "col", "seq_id", "pos")
    a = p.select("msa_id", "col", F.col("seq_id").alias("a"), F.col("pos").alias("pos_a"))
    b = p.select("msa_id", "col", F.col("seq_id").alias("b"), F.col("pos").alias("pos_b"))
    return a.join(b, ["msa_id", "col"]).where("a < b").select("msa_id", "a", "b", "pos_a", "pos_b")
