"""Profiles of alignments and substitution scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.letters import is_gap


def _with_neighbours(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("msa_id", "seq_id").orderBy("col")
    gap = is_gap("letter")
    return cells.select("*", gap.alias("gap"), F.coalesce(F.lag(gap).over(w), F.lit(False)).alias("before"), F.coalesce(F.lead(gap).over(w), F.lit(False)).alias("after"))


def column_profile(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Shares of letter/gap steps from the column before (ll, lg, gl, gg) and occupancy; beyond the edges stand letters.

    weights: (msa_id, seq_id, weight) summing to one in each alignment; else all rows count alike.
    """
    x = _with_neighbours(cells)
    if weights is None:
        n = cells.select("msa_id", "seq_id").distinct().groupBy("msa_id").agg((F.lit(1.0) / F.count("*")).alias("weight"))
        x = x.join(n, "msa_id")
    else:
        x = x.join(weights, ["msa_id", "seq_id"])
    share = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    before, gap = F.col("before"), F.col("gap")
    return x.groupBy("msa_id", "col").agg(
        share(~before & ~gap).alias("ll"), share(~before & gap).alias("lg"), share(before & ~gap).alias("gl"), share(before & gap).alias("gg"), share(~gap).alias("occ")
    )


def letter_shares(cells: DataFrame) -> DataFrame:
    """(msa_id, col, letter, share) of letters, over all rows."""
    n = cells.select("msa_id", "seq_id").distinct().groupBy("msa_id").agg(F.count("*").alias("n_rows"))
    counted = cells.where(~is_gap("letter")).groupBy("msa_id", "col", F.upper("letter").alias("letter")).agg(F.count("*").alias("n"))
    return counted.join(n, "msa_id").select("msa_id", "col", "letter", (F.col("n") / F.col("n_rows")).alias("share"))


def letter_scores(shares: DataFrame, matrix: DataFrame) -> DataFrame:
    """(msa_id, col, letter, score): for each letter the mean of its matrix scores with the column. matrix: (letter, other, value), a fixed table."""
    m = matrix.select(F.col("other").alias("letter"), F.col("letter").alias("scored"), "value")
    return shares.join(F.broadcast(m), "letter").groupBy("msa_id", "col", F.col("scored").alias("letter")).agg(F.sum(F.col("share") * F.col("value")).alias("score"))


def self_score(shares: DataFrame, matrix: DataFrame) -> DataFrame:
    s = letter_scores(shares, matrix)
    return shares.join(s, ["msa_id", "col", "letter"]).groupBy("msa_id").agg(F.sum(F.col("share") * F.col("score")).alias("self_score"))


def gap_scores(profile: DataFrame, gap_open: float) -> DataFrame:
    """Scores to open and close a gap at each column; the first and last columns cost half by occupancy."""
    w = Window.partitionBy("msa_id").orderBy("col")
    following = F.lead("gl").over(w)
    first = F.row_number().over(w) == 1
    return profile.select(
        "msa_id", "col",
        F.when(first, F.col("occ") * gap_open / 2).otherwise(gap_open * (1 - F.col("lg")) / 2).alias("open"),
        F.when(following.isNull(), F.col("occ") * gap_open / 2).otherwise(gap_open * (1 - following) / 2).alias("close"),
    )


def gap_stages(cells: DataFrame) -> DataFrame:
    """(msa_id, col, letters, opens, extends, closes): a gap after a gap extends, else before a gap opens, else closes."""
    x = _with_neighbours(cells)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    gap, before, after = F.col("gap"), F.col("before"), F.col("after")
    return x.groupBy("msa_id", "col").agg(
        share(~gap).alias("letters"), share(gap & ~before & after).alias("opens"), share(gap & before).alias("extends"), share(gap & ~before & ~after).alias("closes")
    )


def consensus(shares: DataFrame) -> DataFrame:
    """(msa_id, consensus) of letter shares (msa_id, col, letter, share): the most frequent letter, lower case below one half, `-` where letters make up less than one half."""
    top = shares.groupBy("msa_id", "col").agg(F.sum("share").alias("total"), F.min(F.struct((-F.col("share")).alias("s"), "letter")).alias("m"))
    letter = F.when(F.col("total") < 0.5, "-").when(-F.col("m.s") < 0.5, F.lower("m.letter")).otherwise(F.col("m.letter"))
    packed = F.array_sort(F.collect_list(F.struct("col", letter.alias("l"))))
    return top.groupBy("msa_id").agg(F.array_join(F.transform(packed, lambda x: x["l"]), "").alias("consensus"))


def substitutions_between(cells: DataFrame, least: float, most: float) -> DataFrame:
    """(x, y, pairs), x <= y: letters that stand in one column of two rows whose percent identity lies in a window."""
    from sparkloom.operators.msa import row_pairs

    alike = row_pairs(cells).where(F.col("both") > 0).withColumn("p", 100.0 * F.col("same") / F.col("both")).where(F.col("p").between(least, most)).select("msa_id", "a", "b")
    letters = cells.where(~is_gap("letter")).select("msa_id", "seq_id", "col", F.upper("letter").alias("letter"))
    first = alike.join(letters.select("msa_id", F.col("seq_id").alias("a"), "col", F.col("letter").alias("la")), ["msa_id", "a"])
    both = first.join(letters.select("msa_id", F.col("seq_id").alias("b"), "col", F.col("letter").alias("lb")), ["msa_id", "b", "col"])
    return both.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.count("*").alias("pairs"))


def substitutions(cells: DataFrame) -> DataFrame:
    """(x, y, pairs, log_odds), x <= y: letters that stand in one column, against what their shares give.

    Pairs come from the counts of letters in a column, n * m or n * (n - 1) / 2, not from pairs of rows.
    """
    counted = cells.where(~is_gap("letter")).groupBy("msa_id", "col", F.upper("letter").alias("x")).agg(F.count("*").alias("n"))
    other = counted.select("msa_id", "col", F.col("x").alias("y"), F.col("n").alias("m"))
    n = F.when(F.col("x") == F.col("y"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("m"))
    pairs = counted.join(other, ["msa_id", "col"]).where("x <= y").groupBy("x", "y").agg(F.sum(n).alias("pairs"))
    single = counted.groupBy("x").agg(F.sum("n").alias("n"))
    total = single.agg(F.sum("n").alias("letters"))
    both = pairs.agg(F.sum("pairs").alias("all_pairs"))
    share = single.join(F.broadcast(total)).select("x", (F.col("n") / F.col("letters")).alias("f"))
    joined = pairs.where("pairs > 0").join(share.withColumnRenamed("f", "fx"), "x").join(share.select(F.col("x").alias("y"), F.col("f").alias("fy")), "y").join(F.broadcast(both))
    twice = F.when(F.col("x") == F.col("y"), 1.0).otherwise(2.0)
    return joined.select("x", "y", "pairs", F.log2(F.col("pairs") / F.col("all_pairs") / (twice * F.col("fx") * F.col("fy"))).alias("log_odds"))
