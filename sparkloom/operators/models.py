"""Tables of model parameters (model, part, name, value): a part's values are probabilities that sum to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalized(parameters: DataFrame) -> DataFrame:
    """Values over the sum of their part; a part that sums to zero is null."""
    total = F.sum("value").over(Window.partitionBy("model", "part"))
    return parameters.withColumn("value", F.when(total > 0, F.col("value") / total))


def perturbed(parameters: DataFrame, seed: int, most: int = 25) -> DataFrame:
    """Each value times 1 - most % .. 1 + most % in steps of one percent, then normalised; seed 0 changes nothing.

    The step depends on the seed and the place of the name in its part alone, so that it is the same
    wherever the row lies.
    """
    if not seed:
        return normalized(parameters)
    place = F.row_number().over(Window.partitionBy("model", "part").orderBy("name"))
    step = (place * 7919 + F.lit(seed) * 104729) % (2 * most + 1) - most
    return normalized(parameters.withColumn("value", F.col("value") * (1 + step / 100.0)))


def deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """(model, part, n, delta): the mean absolute difference of the values of two tables."""
    other = right.select("model", "part", "name", F.col("value").alias("other"))
    both = left.join(other, ["model", "part", "name"])
    return both.groupBy("model", "part").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("other"))).alias("delta"))


def report(parameters: DataFrame) -> DataFrame:
    """(model, part, n, total, entropy): what a listing of a model says about each part."""
    bits = F.when(F.col("value") > 0, -F.col("value") * F.log2("value")).otherwise(0.0)
    return parameters.groupBy("model", "part").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(bits).alias("entropy"))


def marginals(pairs: DataFrame) -> DataFrame:
    """(model, letter, value) from (model, letter, other, value): row sums of a symmetric table given by its lower half."""
    whole = pairs.union(pairs.where("letter <> other").select("model", F.col("other"), F.col("letter"), "value"))
    return whole.groupBy("model", "letter").agg(F.sum("value").alias("value"))
