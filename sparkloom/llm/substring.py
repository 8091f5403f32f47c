"""Exact substring dedup as a relative Lempel-Ziv parse against everything that comes earlier."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_materialized, materialize, shuffles_dropped, small_batches, text_id

#: Odd multipliers of the polynomial hashes.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))


def rolling(h: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of every run of `width` words, well mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(base)
        out += h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` grams the place of its least gram, the first among equals."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 15) + span - 1], span)
        out[at : at + len(part)] = part.argmin(axis=1)
    return out + np.arange(n)


def _all_anchors(width: int, gram: int):
    """For mapInArrow over (doc_id, text, text_id): the different anchors of each document."""

    def run(batches):
        for batch in batches:
            ids, docs, texts, places = [np.zeros(0, np.uint64)], [], [], []
            for doc, text, text_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split() if text else []
                if len(words) >= width:
                    grams = rolling(word_hashes(words), gram)
                    at = np.unique(anchors(grams, width - gram + 1))
                    ids.append(grams[at])
                    docs.append(np.full(len(at), doc, np.int64))
                    texts.append(np.full(len(at), text_id, np.int64))
                    places.append(at.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (docs, texts, places))],
                    ["anchor", "doc_id", "text_id", "place"],
                )

    return run


def _windows(width: int, gram: int):
    """For mapInArrow over (doc_id, text, text_id, places): the windows whose anchor stands at one of the places."""

    def run(batches):
        for batch in batches:
            for doc, text, text_id, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = word_hashes(text.split())
                chosen = np.isin(anchors(rolling(h, gram), width - gram + 1), np.array(places, np.int64))
                starts = np.flatnonzero(chosen)
                keys, checks = rolling(h, width)[starts], (rolling(h, width, OTHER_BASE)[starts] >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(checks.view(np.int32)), *(pa.array(np.full(len(starts), x, np.int64)) for x in (doc, text_id)), pa.array(starts.astype(np.int32))],
                    ["window", "check", "doc_id", "text_id", "start"],
                )

    return run


def _regroup(run, rows: int = 1 << 17):
    """Join the small record batches that run yields into ones of about `rows` rows."""

    def joined(batches):
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def duplicate_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, text_id, starts, stops): spans of words under windows that also start earlier; null: the whole text.

    docs: (doc_id long without nulls, text binary, text_id long). What is aggregated by a key is
    written before it is joined: both sides of a join are then plain exchanges, of which adaptive
    execution splits the partition of a hot key. What a step has written goes before the next one
    that does not read it.
    """
    row, given = ["doc_id", "text_id"], docs.where("text is not null")
    digests = given.select(*row, F.unhex(F.sha2("text", 256)).alias("digest"))
    first = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    copies = materialize(digests.join(first, "digest").where("doc_id > first").select(*row).distinct())
    drop_materialized(first)

    found = materialize(given.mapInArrow(_all_anchors(width, gram), "anchor long, doc_id long, text_id long, place int"))
    shared = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = materialize(found.join(shared, "anchor").groupBy(*row).agg(F.collect_set("place").alias("places")).join(copies, row, "left_anti"))
    for done in (shared, found):
        drop_materialized(done)
    windows = materialize(
        given.join(places, row)
        .select("doc_id", "text", "text_id", "places")
        .mapInArrow(_regroup(_windows(width, gram)), "window long, check int, doc_id long, text_id long, start int")
    )
    drop_materialized(places)
    earliest = windows.groupBy("window", "check").agg(F.min(F.struct("doc_id", "text_id", "start")).alias("first"), F.count("*").alias("n"))
    earliest = materialize(earliest.where("n > 1").drop("n"))
    later = windows.join(earliest, ["window", "check"]).where("struct(doc_id, text_id, start) > first").groupBy(*row).agg(F.array_sort(F.collect_set("start")).alias("s"))
    spans = later.select(
        *row,
        F.expr(f"filter(s, (x, i) -> i = 0 or x - s[i - 1] > {width})").alias("starts"),
        F.expr(f"transform(filter(s, (x, i) -> i = size(s) - 1 or s[i + 1] - x > {width}), x -> x + {width})").alias("stops"),
    )
    null = F.lit(None).cast("array<int>")
    flagged = materialize(spans.unionByName(copies.select(*row, null.alias("starts"), null.alias("stops"))))
    for done in (windows, earliest, copies):
        drop_materialized(done)
    return flagged


def _kept(width: int):
    """For mapInArrow over (doc_id, text, starts, stops, whole)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
    names = ["doc_id", "n_words", "n_removed", "kept", "factors"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, starts, stops, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split() if text else []
                n, spans = len(words), []
                if whole and n >= width:
                    spans = [[0, n]]
                elif starts:
                    spans = [list(x) for x in zip(starts, stops, strict=True)]
                left, at = [], 0
                for start, stop in spans:
                    left += words[at:start]
                    at = stop
                left += words[at:]
                rows.append((doc, n, n - len(left), b" ".join(left).decode(), spans))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


#: Flagged spans below this size go to every executor; beyond it documents are shuffled to them.
BROADCAST_BYTES = 32 << 20


def dedup(docs: DataFrame, width: int = 20, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) for every row of docs.

    The text is parsed against all that comes before it (smaller doc_id, or same document and
    earlier start): a copied factor is a maximal run of words covered by windows of `width` words
    whose word sequence starts earlier too; everything else is literal. factors lists the word spans
    that were removed, kept is the rest joined by single spaces. Windows are judged on the input.

    Windows meet by their anchor, the least of their `gram`-word hashes, which equal windows share:
    about one row for seven words is shuffled instead of one for each word, and only windows whose
    anchor occurs more than once are compared, by 96 bits of hashes of their words. Exact copies of a
    whole text are found first and settled without windows.

    Null texts have no words. Rows that repeat a doc_id are one document: equal texts count as one
    text and are cut alike, different ones follow each other in the order of their hash. Rows without
    doc_id are one document after all others. Texts shorter than a window are kept whole; a very long
    one is one row's work, with memory in proportion to its words. An empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    last = (1 << 63) - 1
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(last)), F.col(text_col).cast("binary")
    with shuffles_dropped(docs.sparkSession):
        docs = docs.select(key.alias("doc_id"), text.alias("text"), text_id(docs, key, text).alias("text_id"))
        flagged = duplicate_spans(docs, width, gram).withColumn("flag", F.lit(True))
        size = flagged.agg(F.sum(F.lit(48) + 8 * F.coalesce(F.size("starts"), F.lit(0)))).first()[0] or 0
    if size <= broadcast_bytes:
        flagged = F.broadcast(flagged)
    joined = docs.join(flagged, ["doc_id", "text_id"], "left").select(
        "doc_id", "text", "starts", "stops", F.expr("coalesce(flag and starts is null, false)").alias("whole")
    )
    out = joined.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept string, factors array<array<long>>")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {last})"))
