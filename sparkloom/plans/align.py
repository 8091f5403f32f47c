"""Alignment plans: kernels over pairs, families and clusters, arranged by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.kernels import family, guide, hmm, pairwise
from sparkloom.operators import kmers
from sparkloom.operators.sequences import pairs_between
from sparkloom.session import materialize, spread

ROWS = "set_id string, seq_id bigint, row string"


def pairs_within(seqs: DataFrame) -> DataFrame:
    """(set_id, x, y, sx, sy) of each two different sequences of a set."""
    return pairs_between(seqs, seqs).where("x < y")


def _different(batch: pa.RecordBatch) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The different pairs of letters (sx, sy) of a batch, and the number of each row's."""
    x, y = (batch.column(c).dictionary_encode() for c in ("sx", "sy"))
    wide = max(1, len(y.dictionary))
    code = x.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + y.indices.to_numpy(zero_copy_only=False)
    found, at = np.unique(code, return_inverse=True)
    dx, dy = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    return [(dx[c // wide], dy[c % wide]) for c in found.tolist()], at


def pair_posteriors(pairs: DataFrame, model: hmm.Model = hmm.Model()) -> DataFrame:
    """(set_id, x, y, pos_x, pos_y, p), one batch of pairs after another."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                different, at = _different(batch)
                found = [hmm.pair_posterior(x, y, model) for x, y in different]
                cells = [np.nonzero(p) for p in found]
                sizes = np.array([len(i) for i, _ in cells], np.int64)[at]
                rows = pa.array(np.repeat(np.arange(len(at)), sizes))
                all_ = lambda parts: pa.array(np.concatenate([parts[k] for k in at]))  # noqa: B023, E731
                given = [batch.column(c).take(rows) for c in ("set_id", "x", "y")]
                yield pa.RecordBatch.from_arrays(
                    [*given, all_([i + 1 for i, _ in cells]), all_([j + 1 for _, j in cells]), all_([p[c] for p, c in zip(found, cells, strict=True)])], ["set_id", "x", "y", "pos_x", "pos_y", "p"]
                )

    return pairs.mapInArrow(run, "set_id string, x bigint, y bigint, pos_x bigint, pos_y bigint, p double")


def scored(pairs: DataFrame, name, score, columns: str) -> DataFrame:
    """(set_id, x, y, columns...) by score(sx, sy); pairs of the same letters are computed once in a process, under the name of the score."""
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string()}
    named = [c.split() for c in columns.split(", ")]

    def run(batches):
        known = hmm.kept(name)
        for batch in batches:
            different, at = _different(batch)
            found = [known.get(pair, lambda: score(*pair)) for pair in different]  # noqa: B023
            made = [pa.array([f[k] for f in found], kinds[kind]).take(pa.array(at)) for k, (_, kind) in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set_id", "x", "y")), *made], ["set_id", "x", "y", *(c for c, _ in named)])

    return pairs.mapInArrow(run, f"set_id string, x bigint, y bigint, {columns}")


def expected_accuracies(pairs: DataFrame) -> DataFrame:
    """(set_id, x, y, ea)."""
    return scored(pairs, "ea", lambda x, y: (hmm.pair_accuracy(x, y),), "ea double")


def local_scores(pairs: DataFrame, gap_open: float = -5.0, gap_extend: float = -1.0) -> DataFrame:
    """(set_id, x, y, score, start_x, start_y, path)."""
    return scored(pairs, ("local", gap_open, gap_extend), lambda x, y: pairwise.smith_waterman(x, y, gap_open, gap_extend), "score double, start_x bigint, start_y bigint, path string")


def global_identities(pairs: DataFrame) -> DataFrame:
    """(set_id, x, y, score, identity, path)."""

    def one(x, y):
        score, i, j, path = pairwise.viterbi(x, y)
        return score, pairwise.identity(x, y, path, i, j), path

    return scored(pairs, "global", one, "score double, identity double, path string")


def likelihood_distances(pairs: DataFrame) -> DataFrame:
    """(set_id, x, y, d): by maximum likelihood over the global alignment of a pair."""

    def one(x, y):
        _, i, j, path = pairwise.viterbi(x, y)
        a, b = [], []
        for c in path:
            a.append(x[i] if c != "I" else "-")
            b.append(y[j] if c != "D" else "-")
            i, j = i + (c != "I"), j + (c != "D")
        return (pairwise.likelihood_distance("".join(a), "".join(b)),)

    return scored(pairs, "likelihood", one, "d double")


def align_families(seqs: DataFrame, consistency: int = 2, refine: int = 100, seed: int = 0, perm: str = "none") -> DataFrame:
    """(set_id, seq_id, row): each set aligned by itself; a set is one task's work, so it should be a family, not a corpus."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        return pd.DataFrame({"set_id": key[0], "seq_id": pdf["seq_id"], "row": family.align(list(pdf["letters"]), consistency, refine, seed, perm)})

    return spread(seqs.select("set_id", "seq_id", "letters"), "set_id").groupBy("set_id").applyInPandas(run, ROWS)


def replicates(seqs: DataFrame, seeds: int = 4, perms: tuple[str, ...] = ("none", "abc", "acb", "bca"), consistency: int = 2, refine: int = 100) -> DataFrame:
    """(set_id, rep, seq_id, row): every set with every seed and guide-tree order, all in parallel."""
    spark = seqs.sparkSession
    grid = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate((s, p) for s in range(seeds) for p in perms)], "rep int, seed int, perm string")
    many = seqs.select("set_id", "seq_id", "letters").join(F.broadcast(grid))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        rows = family.align(list(pdf["letters"]), consistency, refine, int(pdf["seed"].iloc[0]), pdf["perm"].iloc[0])
        return pd.DataFrame({"set_id": key[0], "rep": key[1], "seq_id": pdf["seq_id"], "row": rows})

    return spread(many, "set_id", "rep").groupBy("set_id", "rep").applyInPandas(run, "set_id string, rep int, seq_id bigint, row string")


def upgma(distances: DataFrame, linkage: str = "biased") -> DataFrame:
    """(set_id, place, left, right, height) from (set_id, x, y, d); nodes beyond the leaves are minus their place."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.union1d(pdf["x"], pdf["y"])
        d = np.full((len(names), len(names)), float(pdf["d"].max()))
        x, y = np.searchsorted(names, pdf["x"]), np.searchsorted(names, pdf["y"])
        d[x, y] = d[y, x] = pdf["d"]
        joins = guide.agglomerate(d, linkage)
        node = [*names.tolist(), *(-(k + 1) for k in range(len(joins)))]
        return pd.DataFrame([(key[0], k + 1, node[a], node[b], h) for k, (a, b, h) in enumerate(joins)], columns=["set_id", "place", "left", "right", "height"])

    return distances.groupBy("set_id").applyInPandas(run, "set_id string, place bigint, left bigint, right bigint, height double")


def cluster(seqs: DataFrame, least: float = 0.9, k: int = 3, most_rejects: int = 8) -> DataFrame:
    """(set_id, seq_id, centroid_id, ea): greedy clusters, longest sequences first (ties by id).

    In each round the sequences that no longer, unassigned one shares a word with become centroids;
    all others are tried against the centroids so far, best word counts first, and join the first of
    at most `most_rejects` whose expected accuracy is high enough. Sequences are deduplicated first.
    """

    seqs = seqs.select("set_id", "seq_id", "letters")
    own = ["set_id", "seq_id"]
    words = kmers.words(seqs.withColumn("seq_id", F.struct(*own)), k).groupBy("seq_id", "kmer").agg(F.count("*").alias("n")).select("seq_id.*", "kmer", "n")
    counted = materialize(words.join(seqs.select(*own, F.length("letters").alias("n_letters")), own))
    left = materialize(seqs)
    done = None
    while not left.isEmpty():
        live = counted.join(left.select(*own), own, "left_semi")
        rank = F.struct(-F.col("n_letters"), F.col("seq_id"))
        first = live.groupBy("set_id", "kmer").agg(F.min(rank).alias("m"))
        beaten = live.join(first, ["set_id", "kmer"]).where(rank > F.col("m")).select(*own).distinct()
        fresh = materialize(left.join(beaten, own, "left_anti"))
        centroids = fresh.select("set_id", F.col("seq_id").alias("centroid_id"), F.col("letters").alias("sy"))
        centres = fresh.select("set_id", "seq_id", F.col("seq_id").alias("centroid_id"), F.lit(1.0).alias("ea"))
        rest = left.join(fresh.select(*own), own, "left_anti")
        words = live.join(fresh.select(*own), own, "left_semi").select("set_id", "kmer", F.col("seq_id").alias("centroid_id"), F.col("n").alias("m"))
        shared = live.join(rest.select(*own), own, "left_semi").join(words, ["set_id", "kmer"]).groupBy("set_id", "seq_id", "centroid_id").agg(F.sum(F.col("n") * F.col("m")).alias("u"))
        best = shared.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("u"), "centroid_id"))).where(F.col("r") <= most_rejects)
        tried = best.join(rest, ["set_id", "seq_id"]).join(centroids, ["set_id", "centroid_id"]).select("set_id", F.col("seq_id").alias("x"), F.col("centroid_id").alias("y"), F.col("letters").alias("sx"), "sy", "r")
        found = expected_accuracies(spread(tried, "set_id", "x", "y")).where(F.col("ea") >= least)
        joined = found.join(best.select("set_id", F.col("seq_id").alias("x"), F.col("centroid_id").alias("y"), "r"), ["set_id", "x", "y"]).groupBy("set_id", F.col("x").alias("seq_id")).agg(F.min(F.struct("r", "y", "ea")).alias("m"))
        assigned = materialize(centres.unionByName(joined.select("set_id", "seq_id", F.col("m.y").alias("centroid_id"), F.col("m.ea").alias("ea"))))
        done = assigned if done is None else done.unionByName(assigned)
        left = materialize(left.join(assigned.select(*own), own, "left_anti"))
    return done if done is not None else seqs.select("set_id", "seq_id", F.col("seq_id").alias("centroid_id"), F.lit(1.0).alias("ea"))


def divide_and_conquer(seqs: DataFrame, least: float = 0.7, consistency: int = 2, refine: int = 0) -> DataFrame:
    """(set_id, seq_id, row): deduplicate, cluster, align clusters in parallel, merge their alignments, put duplicates back.

    The merge of a set's clusters is one task over their rows; clusters are what is done in parallel.
    """

    keyed = seqs.select("set_id", "seq_id", "letters")
    reps = keyed.groupBy("set_id", F.upper("letters").alias("letters")).agg(F.min("seq_id").alias("seq_id"), F.collect_list("seq_id").alias("all"))
    reps = materialize(reps)
    groups = cluster(reps, least)
    parts = reps.join(groups.select("set_id", "seq_id", "centroid_id"), ["set_id", "seq_id"]).select(F.to_json(F.struct("set_id", "centroid_id")).alias("set_id"), "seq_id", "letters")
    named = F.from_json("set_id", "set_id string, centroid_id bigint")
    aligned = align_families(parts, consistency, refine).withColumn("x", named).select("x.set_id", F.col("x.centroid_id").alias("part"), "seq_id", "row")

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [(list(g["seq_id"]), list(g["row"])) for _, g in sorted(pdf.groupby("part"), key=lambda x: (-len(x[1]), x[0]))]
        ids, rows = blocks[0]
        for other, more in blocks[1:]:
            a, b = family.merge(rows, more)
            ids, rows = ids + other, a + b
        return pd.DataFrame({"set_id": key[0], "seq_id": ids, "row": rows})

    merged = aligned.select("set_id", "part", "seq_id", "row").groupBy("set_id").applyInPandas(merge, ROWS)
    return merged.join(reps.select("set_id", "seq_id", "all"), ["set_id", "seq_id"]).select("set_id", F.explode("all").alias("seq_id"), "row")


def transitive_rows(paths: DataFrame, reference: DataFrame) -> DataFrame:
    """(seq_id, row): new sequences in the columns of an alignment, through the row that each was aligned to.

    paths: (seq_id, ref_id, letters, path over B, X, Y; X: the new sequence's letter alone). reference:
    (ref_id, row). Letters between two columns go left-justified into as many new columns as the
    widest insert there needs. One task's work for each new sequence; widths meet by aggregation.
    """
    steps = "seq_id bigint, gap bigint, col bigint, letter string, k bigint"

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cols = [i for i, c in enumerate(r.row) if c not in "-."]
                i = at = k = 0
                for c in r.path:
                    if c == "B":
                        out.append((r.seq_id, None, cols[at], r.letters[i], 0))
                        i, at, k = i + 1, at + 1, 0
                    elif c == "X":
                        out.append((r.seq_id, cols[at] if at < len(cols) else len(r.row), None, r.letters[i], k))
                        i, k = i + 1, k + 1
                    else:
                        at, k = at + 1, 0
            yield pd.DataFrame(out, columns=["seq_id", "gap", "col", "letter", "k"]).astype({"gap": "Int64", "col": "Int64"})

    cells = paths.join(reference, "ref_id").select("seq_id", "letters", "path", "row").mapInPandas(run, steps)
    width = cells.where("gap is not null").groupBy("gap").agg((F.max("k") + 1).alias("w"))
    length = reference.agg(F.max(F.length("row")).alias("n"))
    grid = length.select(F.explode(F.sequence(F.lit(0), F.col("n"))).alias("g")).select(F.col("g").cast("bigint").alias("gap")).join(width, "gap", "left").withColumn("w", F.coalesce("w", F.lit(0)))
    before = F.sum("w").over(Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    starts = grid.select("gap", (F.col("gap") + before - F.col("w")).alias("first"), (F.col("gap") + before).alias("own"))
    total = starts.agg(F.max("own").alias("total"))
    placed = cells.join(F.broadcast(starts), F.coalesce(cells["gap"], cells["col"]) == starts["gap"]).select("seq_id", F.when(cells["gap"].isNull(), F.col("own")).otherwise(F.col("first") + F.col("k")).alias("at"), "letter")
    packed = F.map_from_entries(F.collect_list(F.struct("at", "letter")))
    full = placed.groupBy("seq_id").agg(packed.alias("m")).join(F.broadcast(total))
    return full.select("seq_id", F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("-"))), "").alias("row"))
