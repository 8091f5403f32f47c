"""Near copies by Jaccard similarity of shingle sets: operator 1 carried on to similarities that bit distance can't decide.

First the steps of operator 1: each set of shingles has a SimHash fingerprint, fingerprints are filed
under pigeonhole blocks, those at most 3 bits apart link, and links chain into components. No pair of
fingerprints that close is lost, and each component is a drawer of sets to be compared. But pairs of a
similarity of 0.8 differ in about 10 of 64 bits (47 of 256 must be allowed for), too many for
pigeonhole blocks, and bit distance alone mistakes 0.7 for 0.8. So sets also meet under blocks of
least hashes: each is filed under 40 drawers more, one for each block of 6 least hashes. A pair of
similarity s shares one of these with probability 1 - (1 - s ** 6) ** 40: all but 5 in a million at
0.8, 3 % at 0.3. Every link of either kind is then verified by the exact similarity of the two sets.

Components need a spanning forest only. First each set is compared with one pivot of each of its
drawers, which settles groups of near copies of any size by equi-joins. Drawers whose members are
then still in several components are compared whole, within a task where they are small and block
against block where they are large; sets already joined aren't compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, materialize, small_batches
from sparkloom.llm.simhash import exact_plan, links
from sparkloom.llm.substring import rolling, word_hashes

DRAWERS, ROWS = 40, 6
#: Shingles whose least hashes or bits are computed at once.
CHUNK = 1 << 12
#: Shingles of one group of sets that a task compares.
TOGETHER = 1 << 20
LAST = (1 << 63) - 1
KEY = ["__id", "__text", "__row"]


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The different hashes of runs of `width` words, ASCII case folded; fewer words are one run, none give none."""
    words = text.lower().split() if text else []
    return np.unique(rolling(word_hashes(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def _owners(ends: np.ndarray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in n shingles from `at` on each set starts that has some of them, and which sets these are."""
    owner = np.searchsorted(ends, np.arange(at, at + n), side="right")
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return first, owner[first]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: a bit is set if it is set in over half of the shingles' hashes; empty sets: zero."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    sizes = np.array([len(s) for s in sets], np.int64)
    ends, ones = np.cumsum(sizes), np.zeros((len(sets), 64), np.int64)
    for at in range(0, len(flat), CHUNK):
        part = flat[at : at + CHUNK]
        first, who = _owners(ends, at, len(part))
        ones[who] += np.add.reduceat(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    state = np.random.default_rng(20_011)
    draw = lambda: state.integers(0, 1 << 64, DRAWERS * ROWS, np.uint64)
    return draw(), draw() | np.uint64(1)


def drawers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x DRAWERS) keys; rows of empty sets mean nothing."""
    xor, times = _mixers()
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    ends = np.cumsum([len(s) for s in sets])
    least = np.full((DRAWERS * ROWS, len(sets)), ~np.uint64(0))
    for at in range(0, len(flat), CHUNK):
        part = flat[at : at + CHUNK]
        mixed = (part[None, :] ^ xor[:, None]) * times[:, None]
        first, who = _owners(ends, at, len(part))
        least[:, who] = np.minimum(least[:, who], np.minimum.reduceat(mixed, first, axis=1))
    blocks = least.reshape(DRAWERS, ROWS, len(sets))
    key = np.repeat(np.arange(1, DRAWERS + 1, dtype=np.uint64)[:, None], len(sets), axis=1)
    for r in range(ROWS):
        key = (key ^ blocks[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.T


def _sketches(width: int):
    """For mapInArrow over (__id, __text, __row, text): the set's digest, its size, its fingerprint and its drawers."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(3).to_pylist()]
            keys = drawers(sets).view(np.int64)
            ends = np.cumsum([0, *(DRAWERS if len(s) else 0 for s in sets)]).astype(np.int32)
            filled = keys[np.array([len(s) > 0 for s in sets], bool)].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(fingerprints(sets).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(filled))),
                ],
                [*KEY, "digest", "size", "f0", "drawers"],
            )

    return run


def _sets(width: int):
    """For mapInArrow over (node, text): (node, size, s)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            sizes = [len(s) for s in sets]
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), flat)], ["node", "size", "s"]
            )

    return run


def forest(nodes: list[int], parts: list[int], sets: list[np.ndarray], similarity: float, out: list) -> None:
    """Append edges that, with the given parts (components so far), connect all sets linked by the similarity.

    Walks from part to part; a set meets only those not reached yet, through their common shingles.
    """
    n, sizes = len(nodes), np.array([len(s) for s in sets], np.int64)
    _, part = np.unique(np.array(parts), return_inverse=True)
    if part.max(initial=0) == 0:
        return
    members = np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part))[:-1])
    shingles, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.r_[0, np.cumsum(sizes)]
    holder, word = np.repeat(np.arange(n), sizes), ids
    rest, live = np.ones(n, bool), n

    def posted():
        keep = rest[holder]
        h, w = holder[keep], word[keep]
        order = np.argsort(w, kind="stable")
        return h[order], np.searchsorted(w[order], np.arange(len(shingles) + 1))

    for root in range(len(members)):
        if not rest[members[root][0]]:
            continue
        frontier = list(members[root])
        rest[frontier] = False
        holders, starts = posted()
        live = int(rest.sum())
        while frontier and live:
            at = frontier.pop()
            own = ids[ends[at] : ends[at + 1]]
            held = [holders[starts[i] : starts[i + 1]] for i in own]
            if not held:
                continue
            common = np.bincount(np.concatenate(held), minlength=n)
            near = np.flatnonzero(rest & (common > 0) & (common >= similarity * (sizes + sizes[at] - common) - 1e-9))
            for p in np.unique(part[near]):
                out.append((nodes[at], nodes[near[part[near] == p][0]]))
                frontier.extend(members[p])
                rest[members[p]] = False
            now = int(rest.sum())
            if 2 * now < live:
                holders, starts = posted()
                live = now
            elif not now:
                live = 0


def _forests(similarity: float):
    """For mapInArrow over (key, node, part, s) sorted by key: the edges of each group."""

    def run(batches):
        last, nodes, parts, sets = None, [], [], []
        for batch in batches:
            out: list = []
            for key, node, part, s in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).to_numpy(zero_copy_only=False), strict=True):
                if key != last:
                    if len(nodes) > 1:
                        forest(nodes, parts, sets, similarity, out)
                    last, nodes, parts, sets = key, [], [], []
                nodes.append(node)
                parts.append(part)
                sets.append(np.array(s, np.int64))
            yield _pairs(out)
        out = []
        if len(nodes) > 1:
            forest(nodes, parts, sets, similarity, out)
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    x = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, node, part, n, weight) with groups heavier than `most` dealt to pairs of blocks, under a key for each pair.

    Any two rows of a group meet under some key, so the edges of the forests of all keys connect
    what those of whole groups would.
    """
    blocks = F.least(F.col("n"), F.ceil(2 * F.col("weight") / most)).cast("int")
    small = rows.where(F.col("weight") <= most)
    large = rows.where(F.col("weight") > most).withColumn("__all", blocks).where("__all > 1")
    large = large.withColumn("__own", F.expr("cast(pmod(xxhash64(node, 5), __all) as int)")).withColumn("__other", F.explode(F.expr("sequence(0, __all - 1)")))
    large = large.where("__own <> __other").withColumn("key", F.xxhash64("key", F.least("__own", "__other"), F.greatest("__own", "__other")))
    return small.select("key", "node", "part").union(large.select("key", "node", "part"))


def _tried(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("size").alias("m"), "s"), sets.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("s").alias("t"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("m", "n") >= similarity * F.greatest("m", "n"))
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("c"), (F.col("m") + F.col("n")).alias("m"))
    return common.where(F.col("c") >= similarity * (F.col("m") - F.col("c")) - 1e-9).select("a", "b")


def _alike(reps: DataFrame) -> DataFrame:
    """(node, size, key): a drawer for each component of fingerprints at most 3 bits apart, which pigeonhole blocks find."""
    filled = reps.where("size > 0").select("node", "size", "f0")
    prints = materialize(filled.groupBy("f0").agg(F.min("node").alias("node")))
    groups = prints.join(connected_components(links(prints, exact_plan())), "node", "left")
    return filled.join(groups.select("f0", F.xxhash64(F.lit("bits"), F.coalesce("component", "node")).alias("key")), "f0").select("node", "size", "key")


def _classes(docs: DataFrame, similarity: float, width: int, text_col: str, together: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (KEY, digest) of each row of keyed docs, and (digest, n, best), best the first row of the component.

    nodes has only classes that have several rows or links.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(*KEY, F.col(text_col).cast("binary").alias("text"))
    rows = materialize(texts.mapInArrow(_sketches(width), "__id long, __text long, __row long, digest binary, size long, f0 long, drawers array<long>"))
    own = F.struct(*KEY)
    grouped = rows.groupBy("digest").agg(F.min(own).alias("first"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "f0", "drawers")))
    # Numbers are drawn once, as they are written, and read from there ever after.
    reps = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
    filed = reps.select("node", "size", F.explode("drawers").alias("key")).union(materialize(_alike(reps)))
    pivots = filed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    shared = materialize(filed.select("key", "node").join(materialize(pivots), "key"))
    pairs = materialize(shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sources = materialize(reps.join(met, "node", "left_semi").select("node", *(F.col(f"first.{k}").alias(k) for k in KEY)))
    # The same join at every size: candidates grow with the input, so they are never sent whole to every executor.
    some = texts.join(sources.hint("merge"), KEY).select("node", "text")
    # Equal rows give the same set several times; one is enough.
    sets = materialize(some.mapInArrow(_sets(width), "node long, size long, s array<long>"))
    if not rows.groupBy(*KEY).count().where("count > 1").isEmpty():
        sets = materialize(sets.dropDuplicates(["node"]))
    found = materialize(_tried(pairs, sets, similarity))
    parts = connected_components(found)
    # Drawers of three or more sets in several components: pairs that met no pivot are still to be compared.
    wide = shared.where("n > 2").select("key", "node", "n", "weight").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    wide = materialize(wide)
    mixed = wide.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    left = materialize(wide.join(materialize(mixed), "key", "left_semi"))
    if not left.isEmpty():
        dealt = in_blocks(left, together).join(sets.select("node", "s"), "node").select("key", "node", "part", "s")
        more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(similarity), "a long, b long")
        parts = connected_components(found.union(materialize(more)))
    linked = reps.select("node", "digest", "first", "n").join(materialize(parts), "node", "left").where("component is not null or n > 1")
    linked = materialize(linked.withColumn("component", F.coalesce("component", "node")))
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    return rows, linked.join(best, "component").select("digest", "n", "best")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with KEY: equal for equal rows only; rows without id come last."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__text": F.xxhash64(F.col(text_col).cast("binary")), "__row": F.xxhash64(*plain)})


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id that links of the similarity reach. See :func:`one_of_each`."""
    keyed = _keyed(docs, id_col, text_col)
    rows, nodes = _classes(keyed, similarity, width, text_col, together)
    joined = rows.select("__id", "digest").join(nodes, "digest", "left")
    known = lambda c: F.nullif(c, F.lit(LAST))
    return joined.select(known(F.col("__id")).alias("doc_id"), known(F.coalesce("best.__id", "__id")).alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """docs with one row of each group of near copies: the one of the smallest doc_id.

    Documents whose sets of `width`-word shingles have at least this Jaccard similarity link, and
    links chain into groups. ASCII case doesn't count; texts of fewer words are one shingle; texts
    without words (null ones too) are one group. Rows are kept or dropped one by one: rows that
    repeat a doc_id with other texts are documents of their own, of equal rows one stays, and rows
    without doc_id come after all others (ties by a hash of the text, then of the row). All columns
    are kept as they are, whatever their names. An empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    rows, nodes = _classes(keyed, similarity, width, text_col, together)
    own = F.struct(*(F.col(k) for k in KEY))
    judged = rows.select(*KEY, "digest").join(materialize(nodes), "digest").select(*KEY, (own == F.col("best")).alias("__best"))
    judged = materialize(judged)
    gone = judged.where("not __best").select(*KEY).distinct()
    repeated = materialize(judged.where("__best").groupBy(*KEY).count().where("count > 1").select(*KEY))
    kept = keyed.join(gone, KEY, "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, KEY, "left_anti").union(keyed.join(repeated, KEY, "left_semi").dropDuplicates(KEY))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
