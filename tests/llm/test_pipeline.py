"""The corpus pipeline on a small folder of tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    prose = lambda i, n: " ".join(f"{'theing' if i % 2 else 'oueau'}{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i * 3 + k * 5) % 26)}{k}" for k in range(n))
    rows = [(i, prose(i, 80) + f"\nmail u{i}@mail.org now ok {i}", "en" if i % 2 else "fr", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, "123 !!", "en", "s", 0), (102, None, "fr", "s", 0), (103, rows[5][1].replace("\n", " again "), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packed":
            assert docs.columns == first.columns
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert ids["language"] == set(range(40)) | {100, 103}
    assert 100 not in ids["line_dedup"] and set(range(40)) <= ids["line_dedup"]
    assert ids["near_dedup"] == set(range(40)) == ids["packed"]
    private = spark.read.parquet(str(tmp_path / "private"))
    assert private.where("text like '%@%' or text not like '%[EMAIL]%'").count() == 0
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == 40


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASH = ["score", "lang_pred", "n_lines", "n_removed", "base", "spans", "n_email", "digest", "component", "size"]


def test_stages_keep_rows_and_columns(spark, tmp_path):
    """Nulls, repeated rows and ids, ties, and columns that are named like those of the stages."""
    prose = " ".join(f"the thing and {chr(97 + k)}ing{k}" for k in range(30))
    other = " ".join(f"some {chr(97 + k)}tion with {k} words" for k in range(30))
    table = [(3, prose, "en"), (5, other, "en"), (5, prose + " x", "en"), (7, "seven of these equal words here", "en"), (7, "seven of these equal words here", "en"), (None, prose, "en"), (8, None, "en"), (9, "", None), (10, "½ ② Ⅷ", "en"), (11, "mail me@x.org and words that stay", "fr")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    out = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES[:4]}
    for df in out.values():
        assert df.columns == docs.columns
        for r in df.collect():
            assert all(r[c] == f"mine {c}" for c in CLASH)
    ids = {name: sorted(str(r["doc_id"]) for r in df.collect()) for name, df in out.items()}
    assert ids["language"] == sorted(str(i) for i, t, _ in table if i not in (8, 9, 10))
    assert ids["near_dedup"] == sorted(["3", "5", "7", "8", "10", "11"])
    assert {r["text"] for r in out["near_dedup"].where("doc_id = 5").collect()} == {other}
    assert len(ids["private"]) == len(table) and out["private"].where("text like '%[EMAIL]%'").count() == 1
    assert out["line_dedup"].where("doc_id = 3").first()["text"] == prose and out["line_dedup"].where("doc_id is null").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
