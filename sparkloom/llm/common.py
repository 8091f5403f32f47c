"""What the operators of this subpackage share: reading, materialising, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch may hold where the session sets no bound; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20

_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by the bytes of a batch; a bound that the session has already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _folder:
        _folder[app] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _folder[app], True)
    return f"file://{_folder[app]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy refers to it."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each action inside when it ends; else they stay until the driver's JVM happens to collect garbage.

    Only for frames that are executed once: a second run of the same one computes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_id(docs: DataFrame, key: Column, text: Column) -> Column:
    """A number that tells the texts of a repeated document key apart: always 0 if no key of docs has several."""
    own = F.xxhash64(text.cast("binary"))
    several = docs.where(text.isNotNull()).groupBy(key.alias("k")).agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b")
    return F.lit(0).cast("long") if several.isEmpty() else own


def split_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text; bytes.split() has exactly these separators."""
    return data.split() if data else []


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        yield tuple(c.to_pylist() for c in batch.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the components of an undirected edge list, named by some member node.

    Contraction in rounds: each node moves to the neighbour that comes first in a random order of
    the round, and edges are renamed. At least half of the nodes that still have edges are expected
    to move, so rounds grow with the logarithm of the largest component. Only aggregations with
    partial sums and equi-joins, so that hubs are no hot spots; each round is written to the shared
    folder. Loops and repeated edges do no harm; nodes without edges don't appear.
    """
    left = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .distinct()
    )
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("cur", F.col("node"))
    if left.isEmpty():
        return nodes.select("node", F.col("cur").alias("component"))
    turn = 0
    while not left.isEmpty():
        turn += 1
        order = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        pick = both.groupBy("u").agg(F.min(F.struct(order("v").alias("p"), F.col("v"))).alias("m"))
        moves = materialize(
            pick.where(F.col("m.p") < order("u")).select("u", F.col("m.v").alias("to"))
        )
        rest = materialize(
            left.join(moves.select(F.col("u").alias("a"), F.col("to").alias("to_a")), "a", "left")
            .join(moves.select(F.col("u").alias("b"), F.col("to").alias("to_b")), "b", "left")
            .select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        moved = materialize(
            nodes.join(moves.withColumnRenamed("u", "cur"), "cur", "left")
            .select("node", F.coalesce("to", "cur").alias("cur"))
        )
        for done in (left, moves, nodes if turn > 1 else None):
            if done is not None:
                drop_materialized(done)
        left, nodes = rest, moved
    return nodes.select("node", F.col("cur").alias("component"))
