import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.plans import align
from sparkloom.sources import text
from sparkloom.streaming import dedup


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one x\nAC-\nd.e\n>two\n\n>one x\nGG\n")
    rows = text.read_fasta(spark, path).orderBy("ord").collect()
    assert [(r["label"], r["letters"]) for r in rows] == [("one x", "ACDE"), ("one x", "GG")]
    kept = text.read_fasta(spark, path, keep_gaps=True, preserve_case=True, accessions=True).orderBy("ord").collect()
    assert [(r["label"], r["letters"]) for r in kept] == [("one", "AC-d.e"), ("one", "GG")]
    named = text.number_duplicates(text.read_fasta(spark, path)).orderBy("ord").collect()
    assert [r["label"] for r in named] == ["one x", "one x dupelabel1"]


def test_not_fasta(spark, tmp_path):
    with pytest.raises(Exception, match="not FASTA"):
        text.read_fasta(spark, put(tmp_path, "b.fa", "AC\n>x\nA\n")).collect()


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "A" * 130), (2, "b", "C")], "ord bigint, label string, letters string")
    text.write_fasta(rows, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert lines.split("\n")[1:4] == ["A" * 60, "A" * 60, "A" * 10]
    back = text.read_fasta(spark, str(tmp_path / "out")).collect()
    assert {(r["label"], r["letters"]) for r in back} == {("a", "A" * 130), ("b", "C")}


def test_ragged_alignment(spark, tmp_path):
    rows = text.read_fasta(spark, put(tmp_path, "c.fa", ">a\nAC\n>b\nA\n"), keep_gaps=True)
    with pytest.raises(Exception, match="different lengths"):
        text.checked_alignment(rows).collect()


def test_ensemble_file(spark, tmp_path):
    path = put(tmp_path, "e.efa", "<m1\n>a\nA-\n>b\nAC\n<m2\n>a\n-A\n>b\nAC\n")
    assert text.is_efa(spark, path)
    rows = text.read_efa(spark, path)
    assert {(r["msa_name"], r["label"], r["letters"]) for r in rows.collect()} == {("m1", "a", "A-"), ("m1", "b", "AC"), ("m2", "a", "-A"), ("m2", "b", "AC")}
    assert {r["value"] for r in text.efa_text(rows).collect()} == {"<m1\n>a\nA-\n>b\nAC", "<m2\n>a\n-A\n>b\nAC"}


def test_newick():
    rows = text.parse_newick("((a:1,b:2):0.5,'c d':3);")
    assert [(r[2], r[3]) for r in rows if r[2]] == [("a", 1.0), ("b", 2.0), ("c d", 3.0)]
    assert text.parse_newick(text.newick_text(rows).replace("c d", "'c d'")) == rows
    with pytest.raises(ValueError):
        text.parse_newick("((a,b);")


def test_tables(spark, tmp_path):
    d = text.read_distances(spark, put(tmp_path, "d.tsv", "a\tb\t0.5\n"))
    assert {(r["a"], r["b"], r["d"]) for r in d.collect()} == {("a", "b", 0.5), ("b", "a", 0.5)}
    with pytest.raises(Exception, match="itself"):
        text.read_distances(spark, put(tmp_path, "d2.tsv", "a\ta\t0.5\n")).collect()
    i = text.read_indexed_distances(spark, put(tmp_path, "i.tsv", "distmx\t2\n0\tx\n1\ty\n0\t1\t0.25\n"))
    assert [(r["a"], r["b"], r["d"]) for r in i.collect()] == [("x", "y", 0.25)]
    with pytest.raises(Exception, match="named twice"):
        text.read_names(spark, put(tmp_path, "n.tsv", "a\tb\na\tc\n")).collect()
    assert text.read_parameters(spark, put(tmp_path, "p.hmm", "HMM aa\nT.x 0.5\nE.AA 0.1\n")) == {"T.x": 0.5, "E.AA": 0.1}
    m = text.read_matrix(spark, put(tmp_path, "m.tsv", "\tA\tC\nA\t4\t0\nC\t0\t9\n"))
    assert {(r["letter"], r["other"]): r["value"] for r in m.collect()} == {("A", "A"): 4.0, ("A", "C"): 0.0, ("C", "A"): 0.0, ("C", "C"): 9.0}


def test_transitive_rows(spark):
    ref = spark.createDataFrame([(1, "A-CD")], "ref_id bigint, row string")
    paths = spark.createDataFrame([(10, 1, "AxyCD", "BXXBB"), (11, 1, "AzD", "BXYB")], "seq_id bigint, ref_id bigint, letters string, path string")
    got = {r["seq_id"]: r["row"] for r in align.transitive_rows(paths, ref).collect()}
    assert got == {10: "A-xyCD", 11: "A-z--D"}


def test_stream_dereplicates(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:00:00", "AC"), ("2024-01-01 00:01:00", "ac"), ("2024-01-01 00:02:00", "G")], "ts string, letters string").selectExpr("cast(ts as timestamp) ts", "letters").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, letters string").parquet(str(src))
    query = dedup.dereplicate_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("kept").count() == 2


def test_dispatch_on_suffix(spark, tmp_path):
    fasta = put(tmp_path, "s.fa", ">a\nAC-D\n")
    efa = put(tmp_path, "s.efa", "<one\n>a\nAC-\n>b\n-cD\n")
    assert [(r["label"], r["letters"]) for r in text.read_sequences(spark, fasta).collect()] == [("a", "ACD")]
    assert sorted((r["label"], r["letters"]) for r in text.read_sequences(spark, efa).collect()) == [("a", "AC"), ("b", "CD")]


def test_replicate_paths():
    assert text.replicate_path("out.@.fa", "abc", 3) == "out.abc.3.fa" and text.replicate_path("c@.fa", 7) == "c7.fa"
    with pytest.raises(ValueError, match="no @"):
        text.replicate_path("out.fa", 1)


def test_models_are_read_as_written(spark, tmp_path):
    from sparkloom.kernels import mega
    from sparkloom.plans import wide_queries

    f = wide_queries.features()
    coded = [mega.code(wide_queries.symbols(t), f) for t in ("gear", "ear")]
    value = mega.model_text("m", mega.column_model(np.array([[0, 1, 2, 3], [-1, 0, 1, 2]]), coded, f), f, 2, 0.7, 0.05)
    text.write_models(spark.createDataFrame([("m", value)], "label string, model string"), str(tmp_path / "models"))
    r = text.read_models(spark, str(tmp_path / "models" / "*")).first()
    assert (r["label"], r["n_rows"], r["n_cols"], r["gap_open"]) == ("m", 2, 4, 0.7) and r["model"].strip() == value.strip()


def test_feature_alignments(spark):
    cells = spark.createDataFrame([("m", 1, 1, "A"), ("m", 1, 2, "-"), ("m", 1, 3, "C")], "msa_id string, seq_id bigint, col bigint, letter string")
    places = spark.createDataFrame([(1, 0, "AX"), (1, 1, "CY")], "seq_id bigint, pos int, symbols string")
    assert sorted((r["feature"], r["row"]) for r in text.feature_alignments(cells, places).collect()) == [(0, "A-C"), (1, "X-Y")]
    with pytest.raises(Exception, match="without symbols"):
        text.feature_alignments(cells, places.where("pos = 0")).collect()


def test_annotations_and_comparison(spark):
    runs = spark.createDataFrame([("m", "a", 1, 4, 10), ("m", "a", 5, 6, 3)], "msa_id string, label string, first_pos bigint, last_pos bigint, bin bigint")
    value = text.features_text(runs).first()["value"].split("\n")
    assert len(value) == 13 and value[11] == "confidence 10\ta\t-1\t1\t4\tconfidence10"
    test = spark.createDataFrame([("m", 1, 1, "A"), ("m", 1, 2, "C"), ("m", 2, 1, "A")], "msa_id string, seq_id bigint, col bigint, letter string")
    gold = test.where("seq_id = 1").withColumn("col", F.col("col") + 1)
    html = text.comparison_html(test, gold).first()["html"]
    assert html == "<pre><span style='background:hsl(94,70%,80%)'>A</span><span style='background:hsl(141,70%,80%)'>C</span>\nA</pre>"
