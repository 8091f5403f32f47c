"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkloom.llm.common import small_batches

#: Buckets of n-grams; one more stands for n-grams across texts and weighs nothing.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
#: Texts are scored together up to so many characters.
CHARS = 1 << 19
#: Labels that a task counts at once, which bounds memory.
TOGETHER = 128


@dataclass
class Model:
    """log_prob[bucket, language] by columns, one bucket more than BUCKETS that is all zero."""

    languages: list[str]
    log_prob: np.ndarray


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams of each order at each character of all texts, and where each text starts."""
    pad = "\0" * (len(ORDERS) - 1) + "\0"
    lowered = [t.lower() + pad for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.r_[0, np.cumsum([len(t) for t in lowered])[:-1]].astype(np.int64)
    out, h, blank = [], np.zeros(len(chars), np.uint64), np.zeros(len(chars), bool)
    for order in ORDERS:
        moved = np.zeros(len(chars), np.uint64)
        moved[: len(chars) - order + 1] = chars[order - 1 :]
        blank |= moved == 0
        h = (h + moved + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)
        bucket[blank] = BUCKETS
        out.append(bucket)
    return out, starts


def pieces(text: str):
    """Buckets of the n-grams of a text of any length, CHARS characters at a time; each n-gram comes once."""
    more = max(ORDERS) - 1
    text = text.lower()
    for at in range(0, len(text), CHARS):
        part = text[at : at + CHARS + more]
        for order, bucket in zip(ORDERS, grams([part])[0], strict=True):
            yield bucket[: min(CHARS, len(text) - at - order + 1)] if len(text) - at >= order else bucket[:0]


def fit(docs: DataFrame, per_language: int = 4000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from at most about `per_language` texts of each label.

    The texts are those whose hashed doc_id falls below the share that the bound leaves, so the same
    rows are taken on every run. Labels have no prior: only the n-grams of a text decide. Rows with a
    null text or label teach nothing, rows that repeat an id teach each; an empty table gives a model
    of no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null"
    )
    seen = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)))
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in seen}
    place = F.expr("pmod(xxhash64(id, 11), 1048576) / 1048576.0")
    labels = docs.sparkSession.createDataFrame([(x, i, share[x]) for i, x in enumerate(languages)], "lang string, number int, share double")
    sample = rows.join(F.broadcast(labels), "lang").where(place < F.col("share")).select(F.col("number").alias("lang"), "text")
    k = len(languages)

    def run(batches):
        total: dict[int, np.ndarray] = {}

        def flush():
            for lang, counts in total.items():
                used = np.flatnonzero(counts[:BUCKETS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), lang, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["lang", "bucket", "n"]
                )
            total.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in total and len(total) >= TOGETHER:
                    yield from flush()
                held = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for bucket in pieces(text):
                    held += np.bincount(bucket, minlength=BUCKETS + 1)
        yield from flush()

    counted = sample.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    log_prob = np.zeros((BUCKETS + 1, k), order="F")
    log_prob[counted["bucket"], counted["lang"]] = counted["n"]
    for column in log_prob.T:
        column[:BUCKETS] = np.log((column[:BUCKETS] + 0.5) / (column[:BUCKETS].sum() + 0.5 * BUCKETS))
    return Model(languages, log_prob)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text; `und` and 0 without any letter."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)]

    def settle(some: list[int], sums: np.ndarray) -> None:
        best = sums.argmax(axis=1)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, o in zip(some, best.tolist(), odds.tolist(), strict=True):
            names[i], scores[i] = model.languages[b], 1.0 / o

    for i in [i for i in todo if len(texts[i]) > CHARS]:
        total = np.zeros(len(model.languages))
        for bucket in pieces(texts[i]):
            total += np.array([column[bucket].sum() for column in model.log_prob.T])
        settle([i], total[None, :])
    todo = [i for i in todo if len(texts[i]) <= CHARS]
    while todo:
        size, some = 0, []
        while todo and (not some or size + len(texts[todo[-1]]) <= CHARS):
            some.append(todo.pop())
            size += len(texts[some[-1]])
        buckets, starts = grams([texts[i] for i in some])
        sums = sum(np.stack([np.add.reduceat(column[b], starts) for column in model.log_prob.T], axis=1) for b in buckets)
        settle(some, sums)
    return names, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced.

    The log-probability matrix (languages x buckets, 0.26 MB a label) is broadcast. A null text or one
    without letters (Unicode categories L) is `und` with score 0, and so is all if nothing could be
    learned. Ties go to the label that sorts first. Each row is judged by its own text, repeated rows
    too; a very long text is scored whole, in pieces of bounded size. An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)
    given = docs.select(*kept)

    def run(batches):
        for batch in batches:
            langs, scores = score(sent.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = StructType([*given.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    """Whether a document is left out of learning: crc32 of the id's text mod 5 is 0; so is one without id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
