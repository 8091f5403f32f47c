"""K-mer counts, distances and the word-count search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialize, spread


def words(seqs: DataFrame, k: int) -> DataFrame:
    """(seq_id, kmer): all words of k letters."""
    n = F.length("letters") - k + 1
    return seqs.where(n > 0).select("seq_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("letters", i, F.lit(k)))).alias("kmer"))


def counts(seqs: DataFrame, k: int) -> DataFrame:
    return words(seqs, k).groupBy("seq_id", "kmer").agg(F.count("*").alias("n"))


#: Words and sequences that one side of a block of pairs holds at most.
BLOCK = (1 << 18, 1 << 12)


def _common(left: tuple, right: tuple, words: int) -> np.ndarray:
    """The sum over words of the smaller count, for each sequence of the left and each of the right.

    A side: (its number of sequences, and for each count its sequence, its word and the count). The
    smaller of two counts is the sum over the steps between counts that both reach, so all sums are one
    product of matrices; with many rare words the words are gone through one by one.
    """
    (n, a, wa, ca), (m, b, wb, cb) = left, right
    na, nb = (np.bincount(w, minlength=words).astype(float) for w in (wa, wb))
    both = (na > 0) & (nb > 0)
    (a, wa, ca), (b, wb, cb) = ((x[k], w[k], c[k]) for x, w, c in ((a, wa, ca), (b, wb, cb)) for k in [np.flatnonzero(both[w])])
    exact = np.float32 if max(ca.sum(), cb.sum(), 0) < 1 << 24 else np.float64
    out = np.zeros((n, m), exact)
    if not len(a):
        return out
    heights, rank = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    keys, at = np.unique(np.concatenate([wa, wb]) * len(heights) + rank, return_inverse=True)
    word, height = keys // len(heights), heights[keys % len(heights)]
    first = np.searchsorted(word, np.arange(words + 1))
    start = np.r_[True, word[1:] != word[:-1]]
    step = height - np.where(start, 0, np.r_[0, height[:-1]])
    if float(n) * m * len(word) > 64.0 * (na[both] @ nb[both]):
        by_a, by_b = np.argsort(wa, kind="stable"), np.argsort(wb, kind="stable")
        to_a, to_b = np.searchsorted(wa[by_a], np.arange(words + 1)), np.searchsorted(wb[by_b], np.arange(words + 1))
        for w in np.flatnonzero(both):
            k, r = by_a[to_a[w] : to_a[w + 1]], by_b[to_b[w] : to_b[w + 1]]
            out[np.ix_(a[k], b[r])] += np.minimum.outer(ca[k], cb[r])
        return out
    wide = 1024

    def reached(x, w, last):
        """(sequence, step) of all steps up to each count, by step."""
        size = last - first[w] + 1
        steps = np.repeat(first[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(steps, kind="stable")
        return np.repeat(x, size)[order], steps[order]

    (xa, sa), (xb, sb) = reached(a, wa, at[: len(a)]), reached(b, wb, at[len(a) :])
    for lo in range(0, len(word), wide):
        sides = []
        for rows, x, steps in ((n, xa, sa), (m, xb, sb)):
            k = slice(*np.searchsorted(steps, (lo, lo + wide)))
            side = np.zeros((rows, min(wide, len(word) - lo)), exact)
            side[x[k], steps[k] - lo] = 1
            sides.append(side)
        out += (sides[0] * step[lo : lo + wide].astype(exact)) @ sides[1].T
    return out


def shared(counted: DataFrame, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(set_id, a, b, common, own_a, own_b), a < b: of pairs of a set with a common word the sum of the smaller counts, and each one's own sum.

    counted: (set_id, seq_id, kmer, n). The sequences of a set are packed to blocks, and each two blocks
    are one unit of work: what is shuffled is each block, once for each other; pairs are not.
    """
    each = counted.groupBy("set_id", "seq_id").agg(F.sum("n").cast("bigint").alias("own"), F.collect_list("kmer").alias("words"), F.collect_list(F.col("n").cast("bigint")).alias("counts"))
    each = materialize(each)
    n, most_words, most = F.col("n"), F.lit(block[0]), F.lit(block[1])
    blocks = F.greatest(F.ceil(F.col("w") / most_words), F.ceil(n / most), F.least(F.ceil(n * 8 / most), F.lit(8))).cast("int").alias("blocks")
    sizes = each.groupBy("set_id").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w")).select("set_id", blocks)
    deal = F.expr("cast(pmod(xxhash64(seq_id, 11), blocks) as int)")
    packed = each.join(sizes.hint("merge"), "set_id").groupBy("set_id", "blocks", deal.alias("block")).agg(F.collect_list(F.struct("seq_id", "own", "words", "counts")).alias("held"))
    packed = materialize(packed)
    left = packed.select("set_id", F.col("block").alias("p"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("q"), F.col("held").alias("left"))
    right = packed.select("set_id", F.explode(F.expr("sequence(0, block)")).alias("p"), F.col("block").alias("q"), F.col("held").alias("right"))
    met = spread(left, "set_id", "p", "q").join(spread(right, "set_id", "p", "q").hint("merge"), ["set_id", "p", "q"])
    kind = counted.schema["seq_id"].dataType.simpleString()

    def side(held: pa.StructArray, codes: np.ndarray) -> tuple:
        lists = held.field("words")
        row = np.repeat(np.arange(len(held)), np.diff(lists.offsets.to_numpy()))
        return len(held), row, codes, held.field("counts").flatten().to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("left")[k].values, batch.column("right")[k].values
                texts = [x.field("words").flatten() for x in (a, b)]
                found = pa.concat_arrays(texts).dictionary_encode()
                code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                total = _common(side(a, code[: len(texts[0])]), side(b, code[len(texts[0]) :]), len(found.dictionary))
                same = batch.column("p")[k] == batch.column("q")[k]
                ids, own = ([x.field(c).to_numpy(zero_copy_only=False) for x in (a, b)] for c in ("seq_id", "own"))
                rows = max(1, (1 << 18) // max(1, len(b)))
                for lo in range(0, len(a), rows):
                    i, j = np.nonzero(total[lo : lo + rows])
                    v, i = total[lo + i, j], i + lo
                    less = ids[0][i] < ids[1][j]
                    if same:
                        i, j, v, less = i[less], j[less], v[less], less[less]
                    x, y, ox, oy = ids[0][i], ids[1][j], own[0][i], own[1][j]
                    columns = [np.where(less, x, y), np.where(less, y, x), v.astype(np.int64), np.where(less, ox, oy), np.where(less, oy, ox)]
                    of = a.field("seq_id").type
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column("set_id")[k], len(i)), *(pa.array(c, of) for c in columns[:2]), *map(pa.array, columns[2:])], ["set_id", "a", "b", "common", "own_a", "own_b"]
                    )

    return met.mapInArrow(run, f"set_id {counted.schema['set_id'].dataType.simpleString()}, a {kind}, b {kind}, common bigint, own_a bigint, own_b bigint")


def common(counted: DataFrame) -> DataFrame:
    """(a, b, common), a < b: sum over shared k-mers of the smaller count."""
    return shared(counted.withColumn("set_id", F.lit(0))).select("a", "b", "common")


def distances(counted: DataFrame) -> DataFrame:
    """(a, b, d) of pairs with a common k-mer: the least over both sides of 3 * (own - common) / own."""
    side = lambda o: 3.0 * (F.col(o) - F.col("common")) / F.col(o)
    return shared(counted.withColumn("set_id", F.lit(0))).select("a", "b", F.least(side("own_a"), side("own_b")).alias("d"))


def word_search(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id, u): targets by occurrences of the query's words, from half the top count (less one) on.

    queries, targets: counts of k-mers. Top counts of 0 and 1 give no hit.
    """
    q = queries.select(F.col("seq_id").alias("query_id"), "kmer", F.col("n").alias("nq"))
    t = targets.select(F.col("seq_id").alias("target_id"), "kmer", F.col("n").alias("nt"))
    u = q.join(t, "kmer").where("query_id <> target_id").groupBy("query_id", "target_id").agg(F.sum(F.col("nq") * F.col("nt")).alias("u"))
    top = F.max("u").over(Window.partitionBy("query_id"))
    least = F.greatest(F.lit(1), F.floor(F.col("top") / 2) - 1)
    return u.withColumn("top", top).where((F.col("top") > 1) & (F.col("u") >= least)).select("query_id", "target_id", "u")
