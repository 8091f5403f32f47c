"""Quality rules over each whole text, with repetition measured on a suffix array of its words."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

#: Words that go into one suffix array; a longer document has its own.
WORDS = 1 << 17


def suffix_array(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, lcp): word suffixes within documents in order, and words each shares with the one before.

    x: word numbers; doc: the document of each word, rising. Prefix doubling on those suffixes only
    that aren't told apart yet; the ranks of each round give the common prefixes afterwards.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(x.max()) + 1) + x
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    end = np.searchsorted(doc, doc, side="right")
    ranks, step = [rank.copy()], 1
    while True:
        alone = new & np.r_[new[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        p = sa[open_]
        first = rank[p]
        second = np.where(p + step < end[p], rank[np.minimum(p + step, n - 1)], -1)
        order = np.lexsort((second, first))
        sa[open_] = p = p[order]
        first, second = first[order], second[order]
        new[open_] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[p] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        step *= 2
        ranks.append(rank.copy())
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r, ok = ranks[level], (a + common < n) & (b + common < n)
        at, bt = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = ok & (at < end[a]) & (bt < end[b]) & (r[at] == r[bt])
        common += same * (1 << level)
    lcp[1:] = common
    return sa, lcp


def repeats(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run from it on that occurs elsewhere in its document.

    That is the height of the deepest LCP interval its suffix lies in; the union of the spans of all
    maximal repeats of some least length is the union of these runs of that length or more.
    """
    sa, lcp = suffix_array(x, doc)
    longest = np.zeros(len(x), np.int64)
    longest[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return longest


def spread(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are covered by spans."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _base(data: bytes) -> tuple[int, int, int]:
    chars = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return chars, len(data) - len(data.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines))


def measure(texts: list[bytes], least: int) -> list[tuple[int, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat) of each text."""
    out: list[tuple[int, ...]] = []
    held: list[tuple[bytes, list[bytes]]] = []
    size = 0

    def flush() -> None:
        ids = defaultdict(count().__next__)
        sizes = np.array([len(w) for _, w in held], np.int64)
        x = np.fromiter((ids[w] for _, ws in held for w in ws), np.int64, int(sizes.sum()))
        n = len(x)
        longest = repeats(x, np.repeat(np.arange(len(held)), sizes))
        some, deep = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= least)
        ends = np.r_[0, np.cumsum(sizes)]
        total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][ends])
        three = total(spread(some, np.full(len(some), 3), n))
        covered = total(spread(deep, longest[deep], n))
        for i, (data, words) in enumerate(held):
            part = longest[ends[i] : ends[i + 1]]
            out.append((len(words), *_base(data), int(three[i]), int(covered[i]), int(part.max()) if len(part) else 0))

    for data in texts:
        words = data.split() if data else []
        if held and size + len(words) > WORDS:
            flush()
            held, size = [], 0
        held.append((data or b"", words))
        size += len(words)
    if held:
        flush()
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def rules(
    docs: DataFrame, least: int = 10, most_covered: float = 0.2, most_longest: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed, kept).

    A text fails the base rules if it has fewer than 50 words or over half of them lie in repeated
    3-word windows. It fails the repetition rule if maximal repeated runs of `least` words or more
    cover over `most_covered` of its words or the longest has over `most_longest` of them. Words that
    long runs cover lie in repeated 3-word windows too, so limits at the base rule's 50 % could reject
    nothing more: a passage pasted twice covers twice its share. With 0.2 and 0.1 a text goes if long
    repeats cover a fifth of it or if a single one holds a tenth.

    One row for each row of docs, equal ones too; null and empty texts have no words and fail. A very
    long text has a suffix array of its own, with memory in proportion to its words times the logarithm
    of its longest repeat. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = measure(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NAMES)))], ["doc_id", *NAMES])

    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)
    )
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_longest * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
