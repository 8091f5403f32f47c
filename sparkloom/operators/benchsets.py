"""Building benchmarks: which families to take, groups of sequences by their domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_families(
    regions: DataFrame,
    least_members: int = 8,
    least_core: int = 10,
    least_primary: float = 0.666,
    least_length: int = 30,
    least_coverage: float = 0.8,
    least_share: float = 0.1,
) -> DataFrame:
    """(family, members, core, primary_share) of families fit for a benchmark.

    regions: (family, seq_id, start, stop, seq_length, primary, core): the part of a sequence that
    lies in a family, whether the sequence's main domain is this one, and the family's core columns.
    A region counts if it is long enough and covers enough of its sequence's domains taken together;
    a family counts if it has enough regions, core columns and main domains.
    """
    size = (F.col("stop") - F.col("start") + 1).alias("size")
    each = regions.select("family", "seq_id", "primary", "core", "seq_length", size)
    covered = F.sum("size").over(Window.partitionBy("seq_id"))
    fit = each.withColumn("covered", covered).where(
        (F.col("size") >= least_length) & (F.col("covered") >= least_coverage * F.col("seq_length")) & (F.col("size") >= least_share * F.col("seq_length"))
    )
    return (
        fit.groupBy("family")
        .agg(F.count("*").alias("members"), F.max("core").alias("core"), F.avg(F.col("primary").cast("int")).alias("primary_share"))
        .where((F.col("members") >= least_members) & (F.col("core") >= least_core) & (F.col("primary_share") >= least_primary))
    )


def domain_strings(regions: DataFrame) -> DataFrame:
    """(seq_id, domains): the families of each sequence in the order of their starts, joined by `+`."""
    packed = F.array_sort(F.collect_list(F.struct("start", "family")))
    return regions.groupBy("seq_id").agg(F.array_join(F.transform(packed, lambda x: x["family"].cast("string")), "+").alias("domains"))


def domain_groups(regions: DataFrame, least: int = 10) -> DataFrame:
    """(domains, n, place, taken): groups of sequences with the same domains, largest first.

    A group is taken if no larger one holds a family of its own, so that a family serves once. Only
    groups, not sequences, are compared.
    """
    strings = domain_strings(regions)
    groups = strings.groupBy("domains").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "domains")).cast("bigint")
    ranked = groups.withColumn("place", place)
    used = ranked.select("domains", "place", F.explode(F.array_distinct(F.split("domains", r"\+"))).alias("family"))
    first = F.min("place").over(Window.partitionBy("family"))
    clear = used.withColumn("first", first).groupBy("domains").agg(F.min((F.col("first") == F.col("place")).cast("int")).alias("clear"))
    return ranked.join(clear, "domains").select("domains", "n", "place", (F.col("clear") == 1).alias("taken"))


def identity_histogram(pairs: DataFrame) -> DataFrame:
    """(percent, pairs) from row pairs (both, same): how many pairs have each whole percent of identity."""
    percent = F.floor(100 * F.col("same") / F.col("both")).cast("bigint")
    return pairs.where("both > 0").groupBy(percent.alias("percent")).agg(F.count("*").alias("pairs"))


def sampled_pairs(left: DataFrame, right: DataFrame, most: int, seed: int = 0, order=None) -> DataFrame:
    """(set_id, x, y): the pairs across two groups (set_id, seq_id), `most` of each set by the order of a seeded hash (or of what `order` makes of columns).

    Each side is thinned to the square root of the target before pairs are formed, so a large set
    never has all of its pairs made.
    """
    side = int(most**0.5) + 1
    key = order or (lambda *c: F.xxhash64(F.lit(seed), *c))

    def thin(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("set_id").orderBy(key(F.col("seq_id")), "seq_id"))
        return df.select("set_id", F.col("seq_id").alias(name), place.alias("r")).where(F.col("r") <= side).drop("r")

    both = thin(left, "x").join(thin(right, "y"), "set_id").where("x <> y")
    place = F.row_number().over(Window.partitionBy("set_id").orderBy(key(F.col("x"), F.col("y")), "x", "y"))
    return both.withColumn("r", place).where(F.col("r") <= most).drop("r")
