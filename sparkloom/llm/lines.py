"""Line dedup by pairwise alignment of overlapping documents (patience diff)."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_materialized, materialize, small_batches, text_id

#: Removed spans below this size go to every executor; beyond it documents are shuffled to them.
BROADCAST_BYTES = 32 << 20
#: Documents that may hold a line for it to count as rare.
RARE = 8


def line_keys(text: bytes, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A signed 64-bit key and a 32-bit check of each line; a line of few words is keyed together with what stands before it.

    So a short or blank line, common everywhere, counts as shared only where its context is. Lines
    are found by their keys and aligned by keys and checks, which by chance agree for one of 2^96.
    """
    keys, checks, before = [], [], 0
    digest = xxhash.xxh3_128_intdigest
    for line in text.split(b"\n"):
        before = digest(line, 0 if len(line.split(None, least_words)) >= least_words else (before ^ 0x5BD1E995) & 0xFFFFFFFFFFFFFFFF)
        keys.append(before & 0xFFFFFFFFFFFFFFFF)
        checks.append(before >> 96)
    return np.array(keys, np.uint64).view(np.int64), np.array(checks, np.uint32).view(np.int32)


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (the patience sort)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences: equal ends, then lines unique in both, then what lies between."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        both = [(where[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in where]
        chain = [both[i] for i in increasing([i for i, _ in both])]
        if not chain:
            continue
        out += chain
        edge = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(edge, edge[1:], strict=False) if p + 1 < q and s + 1 < t]
    return sorted(out)


def _aligned(batches):
    """For mapInArrow over (doc_id, text_id, places, keys, checks, their_keys, their_checks): (doc_id, text_id, place) of the aligned lines."""
    for batch in batches:
        out: list[tuple] = []
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7)]
        for row, (doc, text) in enumerate(zip(docs, texts, strict=True)):
            places, keys, checks, their_keys, their_checks = (x[row] for x in arrays)
            mine, theirs = (list(zip(k.tolist(), c.tolist(), strict=True)) for k, c in ((keys, checks), (their_keys, their_checks)))
            both = set(mine) & set(theirs)
            own = [(p, k) for p, k in zip(places.tolist(), mine, strict=True) if k in both]
            found = patience([k for k in theirs if k in both], [k for _, k in own])
            out += [(doc, text, own[j][0]) for _, j in found]
        kinds = (pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "text_id", "place"])


def aligned_lines(docs: DataFrame, least_words: int, rare: int) -> DataFrame:
    """(doc_id, text_id, starts, stops): spans of lines aligned with an earlier document. docs: (doc_id without nulls, text binary, text_id)."""
    row = ["doc_id", "text_id"]

    def keys(batches):
        for batch in batches:
            ids, texts, places, keys, checks = [], [], [], [], []
            for doc, text, text_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    key, check = line_keys(text, least_words)
                    keys.append(key)
                    checks.append(check)
                    ids.append(np.full(len(key), doc, np.int64))
                    texts.append(np.full(len(key), text_id, np.int64))
                    places.append(np.arange(len(key), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, texts, places, keys, checks)], ["doc_id", "text_id", "place", "key", "check"])

    lines = materialize(docs.mapInArrow(keys, "doc_id long, text_id long, place int, key long, check int"))
    # What is aggregated is written before it is joined, so that adaptive execution can split a hot key.
    several = materialize(lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key"))
    shared = lines.join(several, "key")
    ordered = shared.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("place", "key", "check"))).alias("s"))
    sequences = materialize(ordered.select(*row, F.col("s.place").alias("places"), F.col("s.key").alias("keys"), F.col("s.check").alias("checks")))
    # Documents with the same sequence of shared lines are one; all but the first of them lose all of it.
    same = [F.xxhash64("keys").alias("h"), F.xxhash64("checks", "keys").alias("g")]
    classes = materialize(sequences.select("doc_id", *same).groupBy("h", "g").agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("last")).where("class < last").drop("last"))
    copies = materialize(sequences.select(*row, *same).join(classes, ["h", "g"]).where("doc_id > class").select(*row))
    whole = sequences.join(copies, row, "left_semi").select(*row, F.explode("places").alias("place"))
    own = materialize(sequences.join(copies, row, "left_anti"))
    held = own.select(*row, F.explode(F.array_distinct("keys")).alias("key"))
    holder = F.struct(*row)
    known = materialize(held.groupBy("key").agg(F.count("*").alias("n"), F.min(holder).alias("e")).where("n > 1"))
    met = materialize(held.join(known, "key").select("key", "n", holder.alias("d"), "e"))
    all_earlier = met.where(F.col("n") <= rare).groupBy("key").agg(F.collect_set("d").alias("all")).select(F.explode("all").alias("d"), "all").select("d", F.explode("all").alias("e"))
    pairs = met.where(F.col("n") > rare).select("d", "e").union(all_earlier).where("e.doc_id < d.doc_id").distinct()
    pairs = materialize(pairs.select("d.doc_id", "d.text_id", F.col("e.doc_id").alias("e_doc"), F.col("e.text_id").alias("e_text")))
    theirs = own.select(F.col("doc_id").alias("e_doc"), F.col("text_id").alias("e_text"), F.col("keys").alias("their_keys"), F.col("checks").alias("their_checks"))
    both = pairs.join(own, row).join(theirs, ["e_doc", "e_text"]).select(*row, "places", "keys", "checks", "their_keys", "their_checks")
    gone = whole.union(both.mapInArrow(_aligned, "doc_id long, text_id long, place int"))
    placed = gone.groupBy(*row).agg(F.array_sort(F.collect_set("place")).alias("s"))
    spans = materialize(
        placed.select(
            *row,
            F.expr("filter(s, (x, i) -> i = 0 or x - s[i - 1] > 1)").alias("starts"),
            F.expr("transform(filter(s, (x, i) -> i = size(s) - 1 or s[i + 1] - x > 1), x -> x + 1)").alias("stops"),
        )
    )
    for done in (lines, several, sequences, classes, copies, own, known, met, pairs):
        drop_materialized(done)
    return spans


def dedup(docs: DataFrame, least_words: int = 3, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with their text cut, and n_lines and n_removed (columns of these names are replaced).

    A document is paired with every earlier document (smaller doc_id) that has one of its rare lines
    (those that at most `rare` documents have) and, for each line that more have, with the earliest
    that has it. The two documents of a pair are aligned whole by patience diff, over all lines that
    both have: lines unique in both anchor the alignment. Aligned blocks are removed from the later document. Documents with the same
    sequence of shared lines count as one, and all but the first lose all of it. So a pair is made for
    each rare line at most `rare` times, for any other once, however many documents have it. Lines of
    fewer than `least_words` words (blank ones too) are shared only together with the line before
    them.

    Null texts stay null with no lines. Rows that repeat a doc_id are one document: each loses what
    an earlier document has and nothing to the others. Rows without doc_id are one document after
    all others. A very long text is one task's work as a row, with memory in proportion to its lines
    and to those of its partner. An empty table gives an empty result; all other columns are kept.
    """
    small_batches(docs.sparkSession)
    last = (1 << 63) - 1
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(last))
    text = F.col(text_col).cast("binary")
    number = text_id(docs, key, text)
    spans = aligned_lines(docs.select(key.alias("doc_id"), text.alias("text"), number.alias("text_id")), least_words, rare)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id"), F.col("starts").alias("__starts"), F.col("stops").alias("__stops"))
    size = spans.agg(F.sum(F.lit(48) + 8 * F.size("__starts"))).first()[0] or 0
    kept = docs.drop("n_lines", "n_removed")
    keyed = kept.withColumn("__key", key).withColumn("__number", number)
    same = (F.col("__key") == F.col("__id")) & (F.col("__number") == F.col("__text_id"))
    joined = keyed.join(F.broadcast(spans) if size <= broadcast_bytes else spans, same, "left")
    joined = joined.withColumn("__lines", F.split(F.col(text_col), "\n", -1))
    left = F.expr(
        """array_join(flatten(transform(sequence(0, size(__starts)), i -> slice(__lines,
             if(i = 0, 0, __stops[i - 1]) + 1,
             greatest(0, if(i = size(__starts), size(__lines), __starts[i]) - if(i = 0, 0, __stops[i - 1]))))), '\n')"""
    )
    removed = F.expr("aggregate(arrays_zip(__starts, __stops), 0L, (n, x) -> n + x.__stops - x.__starts)")
    cut = F.col("__starts").isNotNull() & F.col(text_col).isNotNull()
    return joined.select(
        *(F.when(cut, left).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(cut, removed).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )
