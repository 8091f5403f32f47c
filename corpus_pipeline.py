"""A corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, lines, near, packing, pii
from sparkloom.llm.common import materialize, table
from sparkloom.llm.queries import tokenizer_path
from sparkloom.session import ship

#: The posterior below which a document counts as of no known language.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns of these names under reserved ones, since a stage makes columns of its own so called."""
    return docs.select(*(F.col(f"`{c}`").alias(f"__theirs_{c}" if c in names else c) for c in docs.columns))


def _same(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs in their order, those set apart under their own names, with n_chars brought up to date."""
    given = lambda c: F.col(f"`__theirs_{c}`" if f"__theirs_{c}" in found.columns else f"`{c}`").alias(c)
    out = found.select(*(given(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages of the documents that aren't held out.

    A document whose text is null or has no letter goes, and so does one whose best language has a
    posterior below LEAST_SCORE; if no row has a label, nothing can be learned and all go. Rows that
    repeat an id, equal or not, are judged by their own texts; rows without id teach nothing. All
    columns stay as they are. An empty table gives an empty result.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(_apart(docs, "lang_pred", "score"), model)
    return _same(docs, judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines aligned with an earlier document; documents of which nothing is left go.

    Nulls, repeated ids, rows without id and ties as in :func:`lines.dedup`; documents without words
    that lost nothing stay. Other columns stay as they are but n_chars, the new length.
    """
    cut = lines.dedup(_apart(docs, "n_lines", "n_removed"))
    return _same(docs, cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Candidates meet in pigeonhole blocks of SimHash fingerprints and, beyond 3 bits, in blocks of
    least hashes; the exact similarity decides. Rows are kept or dropped one by one, as
    :func:`near.one_of_each` says: a unique text under a repeated id stays, of equal rows one stays,
    and rows without id give way to those with one.
    """
    return _same(docs, near.one_of_each(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind.

    No row goes. Null texts stay null, rows that repeat an id or have none are each masked by their
    own matches. Other columns stay as they are but n_chars, the new length.
    """
    names = [*(f"n_{k}" for k in pii.KINDS), "base", "spans"]
    return _same(docs, pii.find(_apart(docs, *names)).withColumn("text", pii.masked()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048. Null and empty texts are the end id alone; see :func:`packing.pack`."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("private", private), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
