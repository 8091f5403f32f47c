"""Exact top-k by inner product: aggregation of sorted lists without random access.

The dimensions are dealt to a few lists; a list ranks candidates by their partial inner product with
the query. Lists are read from the top in rounds. A candidate's lower bound adds the least value of
each list it wasn't yet seen in, its upper bound the value last read there. Reading stops when no
candidate outside those already seen can reach the k-th lower bound; the scores of those that still
can are then resolved. Bounds only exclude, so results are exact whatever is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that meet in one task.
QUERIES, CANDIDATES = 1 << 13, 1 << 13


def block_top(queries: np.ndarray, vectors: np.ndarray, k: int, own: np.ndarray, lists: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of whole numbers) the indexes and scores of its k best vectors, ties to lower indexes.

    own[q]: a mask or index array of vectors that query q must not meet.
    """
    exact = np.int64 if _large(queries, vectors) else np.float64
    queries, vectors = queries.astype(exact), vectors.astype(exact)
    n, dims = vectors.shape
    parts = [np.arange(i, dims, lists) for i in range(min(lists, dims))]
    scores = [queries[:, p] @ vectors[:, p].T for p in parts]
    out = []
    for q in range(len(queries)):
        values = [s[q] for s in scores]
        allowed = n - len(own[q])
        if allowed <= k or not parts:
            pool = np.setdiff1d(np.arange(n), own[q])
        else:
            pool = _no_random_access(values, k, own[q], n)
        total = sum(v[pool] for v in values) if parts else np.zeros(len(pool), exact)
        order = np.argsort(-total, kind="stable")[:k]
        out.append((pool[order], total[order].astype(np.int64)))
    return out


def _large(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether sums may leave the whole numbers that a double holds."""
    top = lambda x: float(np.abs(x).max(initial=0))
    return top(queries) * top(vectors) * max(1, vectors.shape[1]) >= 2**52


def _no_random_access(values: list[np.ndarray], k: int, own: np.ndarray, n: int) -> np.ndarray:
    """Sorted indexes of candidates that may be among the k best (the query's own excluded)."""
    least = [v.min() for v in values]
    depth = max(2 * k, n // 16)
    while True:
        read = [np.partition(v, n - depth)[n - depth] if depth < n else v.min() for v in values]
        known = [v >= r for v, r in zip(values, read, strict=True)]
        lower = sum(np.where(s, v, m) for s, v, m in zip(known, values, least, strict=True)).astype(values[0].dtype)
        lower[own] = np.iinfo(np.int64).min if lower.dtype == np.int64 else -np.inf
        bar = np.partition(lower, n - k)[n - k]
        if depth >= n or sum(read) < bar:
            break
        if depth >= n // 4:  # lists this long: resolve what is left at once
            depth = n
        depth = min(n, 2 * depth)
    upper = sum(np.where(s, v, r) for s, v, r in zip(known, values, read, strict=True))
    may = upper >= bar
    may[own] = False
    return np.flatnonzero(may)


def _scorer(k: int):
    """For applyInArrow over a block of queries and one of candidates, all of one length: each query's k best of the block."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("variant", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not queries.num_rows or not candidates.num_rows:
            return kinds.empty_table()
        numbers = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, variants, wanted = numbers(queries, "id"), numbers(queries, "variant"), matrix(queries)
        vec_id, vectors = numbers(candidates, "id"), matrix(candidates)
        order = np.argsort(vec_id, kind="stable")
        vec_id, vectors = vec_id[order], vectors[order]
        lo, hi = np.searchsorted(vec_id, ids), np.searchsorted(vec_id, ids, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(ids), 256):
            own = [np.arange(a, b) for a, b in zip(lo[at : at + 256], hi[at : at + 256], strict=True)]
            found += block_top(wanted[at : at + 256], vectors, k, own)
        sizes = [len(index) for index, _ in found]
        out = [np.repeat(ids, sizes), np.repeat(variants, sizes), np.concatenate([vec_id[index] for index, _ in found]), np.concatenate([score for _, score in found])]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=kinds)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of each query with the highest inner product.

    Components x become floor(scale * x). A candidate that has the query's id is the query's own and
    takes no part, repeated rows with that id included; other repeated rows are candidates each.
    Ties go to the smaller vec_id. Equal query rows count once; queries of one id with different
    vectors have a list each, both under that id. Vectors that are null, hold null or non-finite
    components or have no id take no part; queries meet vectors of their own length. An empty table
    gives an empty result.

    Queries and candidates are dealt to blocks of bounded size by a hash of their rows, and each block
    of queries meets each of candidates in a task: nothing is gathered on the driver but the number of
    rows of each length, and only k rows for each query and block are shuffled afterwards.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))

    wanted = whole(queries).distinct().withColumns({"n": F.size("v"), "variant": F.xxhash64("v")})
    given = whole(vectors).withColumn("n", F.size("v"))
    tables = [df.groupBy("n").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(name)) for df, size, name in ((wanted, QUERIES, "q"), (given, CANDIDATES, "c"))]
    sizes = tables[0].join(tables[1], "n")
    block = lambda name, *c: F.pmod(F.xxhash64(*c), F.col(name)).cast("int")
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = wanted.join(sizes, "n").select("n", block("q", "id", "v").alias("qb"), upto("c").alias("cb"), "id", "variant", "v")
    right = given.join(sizes, "n").select("n", block("c", "id", "v").alias("cb"), upto("q").alias("qb"), "id", "v")
    keys = ["n", "qb", "cb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scorer(k), "query_id long, variant long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
