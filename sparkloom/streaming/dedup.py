"""Streams: dereplication and counts that keep bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dereplicate_stream(seqs: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of equal sequences (but for case) within the watermark; state is dropped behind it."""
    return seqs.withWatermark(time, delay).withColumn("__key", F.xxhash64(F.lower("letters"))).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def kmer_stream(seqs: DataFrame, k: int, time: str = "ts", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, kmer, n): k-mer counts of tumbling windows."""
    n = F.length("letters") - k + 1
    words = seqs.withWatermark(time, delay).where(n > 0).select(time, F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("letters", i, F.lit(k)))).alias("kmer"))
    return words.groupBy(F.window(time, window).alias("window"), "kmer").agg(F.count("*").alias("n"))
