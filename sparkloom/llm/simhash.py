"""SimHash near-duplicates: fingerprints, pigeonhole blocks, exact Hamming check, components.

Two fingerprints that differ in at most ``max_bits`` bits, cut into ``max_bits + k`` blocks, agree
on k whole blocks at least. So each fingerprint is filed under every choice of k blocks and only
fingerprints filed together are compared. Fingerprints of a drawer with more than ``crowd`` members
are filed again under finer choices (more blocks), which leaves fewer free bits: at the last level
12 free bits, so at most 4,096 different fingerprints, whatever the input. No link is lost, no
drawer emits all of its pairs (a spanning forest is enough for components), and work stays in
proportion to the fingerprints.

Similarities of shingle sets that bit distance can't decide are the matter of ``near``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, materialize, small_batches

#: Shingles that are summed at once, which bounds memory for very long texts.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Plan:
    """How fingerprints are filed: masks by level, from coarse to fine."""

    max_bits: int
    levels: tuple[tuple[int, ...], ...]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exact_plan(max_bits: int = 3, blocks: tuple[int, ...] = (5, 8, 16)) -> Plan:
    """Pigeonhole blocks over 64 bits; each level has C(blocks, max_bits) masks."""
    levels = []
    for n in blocks:
        cuts = [64 * i // n for i in range(n + 1)]
        part = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
        levels.append(tuple(_signed(sum(part[i] for i in keep)) for keep in combinations(range(n), n - max_bits)))
    return Plan(max_bits, tuple(levels))


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle, in chunks."""
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, len(part) - width + 1)


def fingerprint(words: list[bytes], width: int) -> int:
    """Unsigned; a bit is set if it is set in over half of the hashes; no word: zero."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, width):
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0) for every row; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.lower().split(), width) if t else 0 for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "f0"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, f0 long")


def forest(nodes: np.ndarray, fps: np.ndarray, max_bits: int, out: list) -> None:
    """Append spanning-forest edges of the graph that links rows of fps at most max_bits apart."""
    if len(nodes) == 2:
        if np.bitwise_count(fps[0] ^ fps[1]) <= max_bits:
            out.append((nodes[0], nodes[1]))
        return
    rest = np.arange(len(nodes))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
            found, rest = rest[near], rest[~near]
            out.extend((nodes[at], nodes[i]) for i in found)
            frontier.extend(found)


def _forests(plan: Plan):
    """For mapInArrow over rows sorted by drawer: the edges of each drawer."""

    def run(batches):
        key = np.zeros(0, np.int64)
        node = np.zeros(0, np.int64)
        fps = np.zeros(0, np.uint64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            key = np.concatenate([key, cols[0]])
            node = np.concatenate([node, cols[1]])
            fps = np.concatenate([fps, cols[2].view(np.uint64)])
            ends = np.flatnonzero(np.diff(key)) + 1
            out: list = []
            start = 0
            for end in ends:
                if end - start > 1:
                    forest(node[start:end], fps[start:end], plan.max_bits, out)
                start = end
            key, node, fps = key[start:], node[start:], fps[start:]
            yield _pairs(out)
        out = []
        if len(key) > 1:
            forest(node, fps, plan.max_bits, out)
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    x = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def links(reps: DataFrame, plan: Plan, crowd: int = 512) -> DataFrame:
    """(a, b): edges between nodes whose fingerprints are at most max_bits apart, enough for components.

    reps: (node, f0), one row for each different fingerprint.
    """
    tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for level, masks in enumerate(plan.levels):
        last = level == len(plan.levels) - 1
        mask = F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))
        # Filing makes a row for each mask, so the few files of reps are dealt to all tasks first.
        filed = reps.repartition(tasks, "node").select("node", "f0", mask.alias("m")).select(F.xxhash64("m", F.col("f0").bitwiseAND(F.col("m"))).alias("key"), "node")
        counts = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(filed.join(counts, "key"))
        members = shared if last else shared.where(F.col("n") <= crowd)
        rows = members.select("key", "node").join(reps, "node").select("key", "node", "f0")
        edges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(plan), "a long, b long")
        found = edges if found is None else found.union(edges)
        if last:
            break
        crowded = shared.where(F.col("n") > crowd).select("node").distinct()
        if crowded.isEmpty():
            break
        reps = materialize(reps.join(crowded, "node", "left_semi"))
    return found


def near_duplicates(docs: DataFrame, plan: Plan | None = None, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, component_id): one row for each row of docs.

    component_id is the smallest doc_id that links reach, the document's own included. Null and
    empty texts have fingerprint zero and link like any other. Very long texts are hashed in chunks.
    Rows that repeat a doc_id stay rows of their own; a null doc_id never names a component unless
    all of its component are null. An empty table gives an empty result. Other columns of docs are
    ignored.
    """
    fps = materialize(fingerprints(docs, width, id_col, text_col))
    reps = materialize(fps.groupBy("f0").agg(F.min("doc_id").alias("node")))
    groups = connected_components(links(reps.where("node is not null"), plan or exact_plan()))
    least = groups.groupBy("component").agg(F.min("node").alias("component_id"))
    named = groups.join(least, "component").select("node", "component_id")
    classes = reps.join(named, "node", "left").select("f0", F.coalesce("component_id", "node").alias("component_id"))
    return fps.join(classes, "f0").select("doc_id", "f0", "component_id")


def fingerprint_hex(col: str = "f0"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
