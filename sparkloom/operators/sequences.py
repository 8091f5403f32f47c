"""Operators over sequence sets: (seq_id, letters, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import spread


def representatives(seqs: DataFrame) -> DataFrame:
    """(seq_id, size): the first of each class of sequences that are equal but for case."""
    return seqs.groupBy(F.lower("letters").alias("k")).agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("size")).select("seq_id", "size")


def duplicate_map(seqs: DataFrame) -> DataFrame:
    """(seq_id, rep_id) for each sequence that isn't its class's first."""
    keyed = seqs.select("seq_id", F.xxhash64(F.lower("letters")).alias("h"), F.lower("letters").alias("k"))
    first = keyed.groupBy("h", "k").agg(F.min("seq_id").alias("rep_id"), F.count("*").alias("n")).where("n > 1").select("h", "k", "rep_id")
    return keyed.join(first, ["h", "k"]).where("seq_id <> rep_id").select("seq_id", "rep_id")


def reinsert(values: DataFrame, duplicates: DataFrame, key: str = "seq_id") -> DataFrame:
    """values of representatives, copied to their duplicates."""
    copies = duplicates.join(values.withColumnRenamed(key, "rep_id"), "rep_id").drop("rep_id")
    return values.unionByName(copies.select(*values.columns))


def quartiles(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, lo, q1, median, q3, hi and mean; quartile k is the value of rank floor(k * n / 4), so medians are upper ones.

    Values are counted before they are ordered, so a window holds different values only.
    """
    by = by or []
    counts = df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(run))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    joined = placed.join(total, by) if by else placed.crossJoin(F.broadcast(total))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(F.col("n") * k / 4), F.col("v")))
    return joined.groupBy(*by).agg(
        F.first("n").alias("n"), F.min("v").alias("lo"), at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"), F.max("v").alias("hi"), F.first("mean").alias("mean")
    )


def chunks(seqs: DataFrame, size: int) -> DataFrame:
    """(seq_id, chunk): consecutive pieces of `size` sequences by an unbroken order 0, 1, ... in `ord`."""
    return seqs.select("seq_id", F.floor(F.col("ord") / size).cast("bigint").alias("chunk"))


def looks_nucleotide(letters: Column | str) -> Column:
    """Whether over 75 % of the letters are A, C, G, T or U; counted over all letters, not a sample."""
    x = F.upper(F.col(letters)) if isinstance(letters, str) else F.upper(letters)
    return (F.length(x) - F.length(F.translate(x, "ACGTU", ""))) > 0.75 * F.length(x)


def relabel(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Labels replaced where (old_label, new_label) has them."""
    return rows.join(names, rows["label"] == names["old_label"], "left").withColumn("label", F.coalesce("new_label", "label")).drop("old_label", "new_label")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def subset(rows: DataFrame, ids: DataFrame, key: str = "seq_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def length_statistics(seqs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, lo, hi and mean of the lengths."""
    n = F.length("letters")
    aggregates = [F.count("*").alias("n"), F.min(n).cast("bigint").alias("lo"), F.max(n).cast("bigint").alias("hi"), F.avg(n).alias("mean")]
    return seqs.groupBy(*by).agg(*aggregates) if by else seqs.agg(*aggregates)


def differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(side, columns...): rows of one side that the other lacks, as often as it lacks them; none if both are the same."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).select(F.lit("left").alias("side"), *columns).union(b.exceptAll(a).select(F.lit("right").alias("side"), *columns))


def label_check(seqs: DataFrame) -> DataFrame:
    """Labels that occur more than once."""
    return seqs.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")


def in_length_order(seqs: DataFrame) -> DataFrame:
    """seq_id and its place by falling length, ties by id; ranks within lengths plus counts of longer ones."""
    sizes = seqs.select("seq_id", F.length("letters").cast("bigint").alias("n"))
    counts = sizes.groupBy("n").agg(F.count("*").alias("c"))
    above = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("n").orderBy("seq_id"))
    return sizes.withColumn("r", within).join(above.select("n", "before"), "n").select("seq_id", "n", (F.col("before") + F.col("r") - 1).cast("bigint").alias("place"))


def drawn(units: DataFrame, replicates: int, key: str = "unit", seed: int = 0) -> DataFrame:
    """(rep, site, unit): units 0..n-1 drawn with replacement, as many as there are, for each replicate.

    Draws are arithmetic in (rep, site), so they are the same on every run and in any engine.
    """
    n = units.agg(F.count("*").alias("n"))
    sites = units.select(F.col(key).alias("site")).join(F.broadcast(n))
    grid = sites.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("rep", F.col("rep").cast("bigint"))
    pick = (F.col("rep") * 7919 + F.col("site") * 104729 + F.lit(seed)) % F.col("n")
    return grid.select("rep", "site", pick.cast("bigint").alias(key))


#: Sequences of a set that one side of a block of pairs holds.
BLOCK = 512


def pairs_between(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(set_id, x, y, sx, sy) of each sequence of the left with each of the right in its set.

    Sets are dealt to blocks of about `block` sequences on either side, and each block of the left meets
    each of the right by itself, so that neither a large set nor few of them fall on one task. What is
    shuffled are sequences, once for each block of the other side; pairs are not.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    count = lambda df, l, r: df.groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", l.alias("l"), r.alias("r"))
    none, n = F.lit(0).cast("bigint"), F.col("n")
    sizes = count(left, n, none).union(count(right, none, n)).groupBy("set_id").agg(blocks(F.sum("l")).alias("ls"), blocks(F.sum("r")).alias("rs"))

    def dealt(df: DataFrame, name: str, text: str, own: str, other: str, ours: str, theirs: str) -> DataFrame:
        deal = F.expr(f"cast(pmod(xxhash64(seq_id, 5), {ours}) as int)").alias(own)
        each = df.select("set_id", "seq_id", "letters").join(sizes.hint("merge"), "set_id")
        each = each.select("set_id", F.col("seq_id").alias(name), F.col("letters").alias(text), deal, F.explode(F.expr(f"sequence(0, {theirs} - 1)")).alias(other))
        return spread(each, "set_id", "p", "q")

    a = dealt(left, "x", "sx", "p", "q", "ls", "rs")
    b = dealt(right, "y", "sy", "q", "p", "rs", "ls")
    return a.join(b.hint("merge"), ["set_id", "p", "q"]).select("set_id", "x", "y", "sx", "sy")
