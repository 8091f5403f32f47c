"""Text formats of sequences, alignments, ensembles, trees, distances and models, as DataFrames.

Files are cut at their record marks by Spark's text reader, so records of one file are read in
parallel and never gathered; single trees and models, which are small, are parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.letters import accession


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): at rises within a file."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value")).alias("value"))


def read_fasta(spark: SparkSession, path: str, keep_gaps: bool = False, preserve_case: bool = False, accessions: bool = False) -> DataFrame:
    """(file, ord, label, letters), one row for each record. A file that doesn't begin with `>` is an error; empty records are left out.

    ord rises within a file, without being unbroken. The label is the header line, or its accession.
    """
    records = spark.read.option("lineSep", ">").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), "value")
    head = records.groupBy("file").agg(F.min_by("value", "ord").alias("head"))
    stray = head.select(F.when(F.trim(F.col("head")) != "", F.raise_error(F.concat(F.lit("not FASTA: "), "file")).cast("string")).alias("x")).where("x is not null")
    label = F.rtrim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.substring_index("value", "\n", -1), r"\s", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    letters = body if keep_gaps else F.translate(body, "-.", "")
    letters = letters if preserve_case else F.upper(letters)
    out = records.where(F.trim(F.col("value")) != "").select("file", "ord", (accession(label) if accessions else label).alias("label"), letters.alias("letters")).where("letters <> ''")
    return out.unionByName(stray.select(F.col("x").alias("file"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("label"), F.lit("").alias("letters")))


def number_duplicates(seqs: DataFrame) -> DataFrame:
    """Labels that occur again in a file get ` dupelabel<i>` behind them, i counting from 1."""
    i = F.row_number().over(Window.partitionBy("file", "label").orderBy("ord")) - 1
    return seqs.withColumn("i", i).withColumn("label", F.when(F.col("i") > 0, F.concat("label", F.lit(" dupelabel"), F.col("i").cast("string"))).otherwise(F.col("label"))).drop("i")


def checked_alignment(rows: DataFrame, key: str = "file") -> DataFrame:
    """The rows, if all of an alignment are of one length; else an error."""
    sizes = rows.groupBy(key).agg(F.min(F.length("letters")).alias("lo"), F.max(F.length("letters")).alias("hi"))
    ok = sizes.select(key, F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("rows of different lengths")).cast("int")).otherwise(F.col("hi")).alias("width"))
    return rows.join(ok, key)


def fasta_text(label: str = "label", letters: str = "letters", width: int = 60):
    folded = F.regexp_replace(F.col(letters), f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), F.col(label), F.lit("\n"), folded)


def write_fasta(seqs: DataFrame, path: str, order: str = "ord", by: str | None = None) -> None:
    """Text files in the order of a column, 60 letters a line; one folder for each value of `by`."""
    out = seqs.select(*([by] if by else []), F.col(order), fasta_text().alias("value"))
    if by:
        out.repartition(by).sortWithinPartitions(by, order).drop(order).write.partitionBy(by).mode("overwrite").text(path)
    else:
        out.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def read_efa(spark: SparkSession, path: str) -> DataFrame:
    """(file, msa_name, ord, label, letters) of files in which `<name` lines part alignments."""
    blocks = spark.read.option("lineSep", "<").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("block"), "value").where("trim(value) <> ''")
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    each = blocks.select("file", "block", name.alias("msa_name"), F.posexplode(F.split(F.regexp_replace("value", r"^[^\n]*\n", ""), ">")).alias("ord", "record")).where("trim(record) <> ''")
    label = F.rtrim(F.regexp_extract("record", r"^([^\r\n]*)", 1))
    return each.select("file", "block", "msa_name", "ord", label.alias("label"), F.upper(F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "")).alias("letters"))


def efa_text(rows: DataFrame) -> DataFrame:
    """(msa_name, value): the text of each alignment of an ensemble."""
    packed = F.array_sort(F.collect_list(F.struct("ord", fasta_text().alias("t"))))
    return rows.groupBy("msa_name").agg(F.concat(F.lit("<"), F.col("msa_name"), F.lit("\n"), F.array_join(F.transform(packed, lambda x: x["t"]), "\n")).alias("value"))


def from_files(spark: SparkSession, paths: list[str], base_names: bool = True) -> DataFrame:
    """An ensemble of aligned FASTA files: (msa_name, ord, label, letters)."""
    rows = read_fasta(spark, ",".join(paths) if len(paths) == 1 else paths, keep_gaps=True)
    name = F.regexp_extract("file", r"([^/]*)$", 1) if base_names else F.col("file")
    return rows.select(name.alias("msa_name"), "ord", "label", "letters")


def is_efa(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where("trim(value) <> ''").take(1)
    return bool(first) and first[0][0].lstrip().startswith("<")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) from `label label distance` lines, in both orders; a pair of one label is an error."""
    raw = spark.read.option("sep", "\t").schema("a string, b string, d double").csv(path)
    a = F.when(F.col("a") == F.col("b"), F.raise_error(F.concat(F.lit("a distance of a label to itself: "), "a"))).otherwise(F.col("a"))
    one = raw.select(a.alias("a"), "b", "d")
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def read_indexed_distances(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) from a header that ends in a count, so many label lines, then `i j distance` lines."""
    lines = _lines(spark, path)
    n = int(lines.where("value <> ''").orderBy("at").first()["value"].split()[-1])
    numbered = lines.where("value <> ''").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 2)
    labels = numbered.where((F.col("k") >= 0) & (F.col("k") < n)).select(F.col("k").alias("i"), F.element_at(F.split("value", "\t"), -1).alias("label"))
    parts = F.split("value", r"\s+")
    body = numbered.where(F.col("k") >= n).select(parts[0].cast("int").alias("i"), parts[1].cast("int").alias("j"), parts[2].cast("double").alias("d"))
    return body.join(labels.withColumnRenamed("label", "a"), "i").join(labels.select(F.col("i").alias("j"), F.col("label").alias("b")), "j").select("a", "b", "d")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(old_label, new_label); an old label that occurs twice is an error."""
    names = spark.read.option("sep", "\t").schema("old_label string, new_label string").csv(path)
    new = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("label named twice: "), F.first("old_label")))).otherwise(F.first("new_label"))
    return names.groupBy("old_label").agg(new.alias("new_label"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("name"))


def parse_newick(text: str) -> list[tuple[int, int | None, str, float | None]]:
    """(node, parent, label, length) rows; nodes are numbered as they are met, the root is 0."""
    rows: list[list] = [[0, None, "", None]]
    at, token, quoted = 0, "", False

    def close() -> None:
        nonlocal token
        name, _, length = token.strip().rpartition(":") if ":" in token else (token.strip(), "", "")
        rows[at][2] = name.strip().strip("'") or rows[at][2]
        rows[at][3] = float(length) if length.strip() else rows[at][3]
        token = ""

    for c in text:
        if c == "'":
            quoted = not quoted
            token += c
        elif quoted or c not in "(),;":
            token += c
        elif c == "(":
            rows.append([len(rows), at, "", None])
            at, token = len(rows) - 1, ""
        elif c == ",":
            close()
            rows.append([len(rows), rows[at][1], "", None])
            at = len(rows) - 1
        elif c == ")":
            close()
            at = rows[at][1]
            if at is None:
                raise ValueError("a bracket too many")
        else:
            close()
            break
    if at or quoted:
        raise ValueError("the tree does not end")
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    return spark.createDataFrame(parse_newick(text), "node bigint, parent bigint, label string, length double")


def newick_text(rows: list[tuple[int, int | None, str, float | None]]) -> str:
    """The inverse of parse_newick."""
    kids: dict[int | None, list] = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    done: dict[int, str] = {}
    stack = [(r, False) for r in kids[None]]
    while stack:
        r, ready = stack.pop()
        if not ready:
            stack.append((r, True))
            stack += [(k, False) for k in kids.get(r[0], [])]
        else:
            inner = ",".join(done[k[0]] for k in kids.get(r[0], []))
            done[r[0]] = (f"({inner})" if inner else "") + r[2] + (f":{r[3]:g}" if r[3] is not None else "")
    return done[kids[None][0][0]] + ";"


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    """Named probabilities of a model file (`T.name p`, `E.xy p`)."""
    pairs = [r[0].split() for r in spark.read.text(path).collect()]
    return {p[0]: float(p[1]) for p in pairs if len(p) == 2 and p[0][:2] in ("T.", "E.")}


def parameters_text(parameters: dict[str, float], alphabet: str = "aa") -> str:
    return "\n".join([f"HMM {alphabet}", *(f"{k} {v:.8g}" for k, v in parameters.items())]) + "\n"


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(letter, other, value) of a table with a line of letters on top and one in front of each line."""
    lines = [r[0].rstrip("\n") for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#")]
    head = lines[0].split()
    rows = [(x[0], o, float(v)) for x in (line.split() for line in lines[1:]) for o, v in zip(head, x[1:], strict=True)]
    return spark.createDataFrame(rows, "letter string, other string, value double")


def parse_mega(text: str) -> tuple[list[tuple], list[tuple]]:
    """Features (index, name, letters, weight, freqs, joint) and places (label, place, symbols) of a multi-feature profile file."""
    lines = [line.split("\t") for line in text.splitlines() if line.strip()]
    head = lines[0]
    if head[0] != "mega":
        raise ValueError("not a multi-feature profile")
    n_features, at = int(head[1]), 1
    features, places = [], []
    for _ in range(n_features):
        index, name, size, weight = int(lines[at][0]), lines[at][1], int(lines[at][2]), float(lines[at][3])
        freqs = [float(v) for v in lines[at + 1][1:] if v]
        joint = [[0.0] * size for _ in range(size)]
        for i in range(size):
            for j, v in enumerate([v for v in lines[at + 2 + i][1:] if v][: i + 1]):
                joint[i][j] = joint[j][i] = float(v)
        features.append((index, name, size, weight, freqs, joint))
        at += 2 + size
        while at < len(lines) and lines[at][0] != "chain" and not (lines[at][0].isdigit() and len(lines[at]) == 4 and not lines[at][1][:1].isdigit() and len(lines[at][1]) > 1):
            at += 1
    while at < len(lines):
        if lines[at][0] == "chain":
            label, size = lines[at][2], int(lines[at][3])
            places += [(label, int(x[1]), x[2]) for x in lines[at + 1 : at + 1 + size]]
            at += size
        at += 1
    return features, places


def read_mega(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, feature table) and (file, label, pos, symbols); one file is parsed by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def rows(part: int):
        def run(batches):
            for pdf in batches:
                for file, value in zip(pdf["file"], pdf["value"], strict=True):
                    import pandas as pd

                    found = parse_mega(value)[part]
                    names = ["feature", "name", "size", "weight", "freqs", "joint"] if part == 0 else ["label", "pos", "symbols"]
                    yield pd.DataFrame([(file, *r) for r in found], columns=["file", *names])

        return run

    features = whole.mapInPandas(rows(0), "file string, feature int, name string, size int, weight double, freqs array<double>, joint array<array<double>>")
    return features, whole.mapInPandas(rows(1), "file string, label string, pos int, symbols string")


def confidence_html(rows: DataFrame) -> DataFrame:
    """(msa_id, html) from (msa_id, seq_id, col, letter, confidence): letters on a colour from blue to red by confidence."""
    colours = F.array(*(F.lit(c) for c in ("#4040ff", "#4080ff", "#40c0ff", "#40ffc0", "#80ff80", "#c0ff40", "#ffe040", "#ffb040", "#ff8040", "#ff4040")))
    span = F.concat(F.lit("<span style='background:"), F.element_at(colours, (F.least(F.floor(F.coalesce("confidence", F.lit(0.0)) * 10), F.lit(9)) + 1).cast("int")), F.lit("'>"), "letter", F.lit("</span>"))
    join = lambda keys, at, v, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(v)))), lambda x: x[v]), sep)
    line = rows.withColumn("span", span).groupBy("msa_id", "seq_id").agg(join(None, "col", "span", "").alias("line"))
    return line.groupBy("msa_id").agg(F.concat(F.lit("<pre>"), join(None, "seq_id", "line", "\n"), F.lit("</pre>")).alias("html"))


def read_sequences(spark: SparkSession, path: str, suffix: str | None = None, **options) -> DataFrame:
    """(file, ord, label, letters) of any input, by its suffix: `.mega` gives each chain's first feature, `.efa` rows without gaps, all else is FASTA."""
    kind = suffix or path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "mega":
        places = read_mega(spark, path)[1].groupBy("file", "label")
        letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("symbols", 1, 1).alias("c")))), lambda x: x["c"]), "")
        return places.agg(letters.alias("letters")).select("file", F.monotonically_increasing_id().alias("ord"), "label", F.upper("letters").alias("letters"))
    if kind == "efa":
        return read_efa(spark, path).select("file", F.monotonically_increasing_id().alias("ord"), "label", F.upper(F.translate("letters", "-.", "")).alias("letters"))
    return read_fasta(spark, path, **options)


def replicate_path(pattern: str, perm: str | int, seed: int | None = None) -> str:
    """A path with `@` replaced by `perm.seed`, or by a number alone; a pattern without `@` is an error."""
    if "@" not in pattern:
        raise ValueError("no @ in the path of replicates")
    return pattern.replace("@", f"{perm}.{seed}" if seed is not None else str(perm))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, n_rows, n_cols, gap_open, gap_extend, model) of column-model files; a file that can't be parsed is an error."""
    import pandas as pd

    def run(batches):
        from sparkloom.kernels import mega

        for pdf in batches:
            rows = []
            for file, value in zip(pdf["file"], pdf["value"], strict=True):
                head, columns, _ = mega.parse_model(value)
                rows.append((file, head["label"], head["n_rows"], len(columns), head["gap_open"], head["gap_extend"], value))
            yield pd.DataFrame(rows, columns=["file", "label", "n_rows", "n_cols", "gap_open", "gap_extend", "model"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInPandas(run, "file string, label string, n_rows int, n_cols int, gap_open double, gap_extend double, model string")


def write_models(models: DataFrame, path: str) -> None:
    """One text file folder for each label of (label, model)."""
    models.select("label", F.rtrim("model", F.lit("\n")).alias("value")).write.partitionBy("label").mode("overwrite").text(path)


def feature_alignments(cells: DataFrame, places: DataFrame) -> DataFrame:
    """(msa_id, feature, seq_id, row): an alignment of (msa_id, seq_id, col, letter) once for each feature, its letters in place of the residues.

    places: (seq_id, pos from 0, symbols). A residue without symbols is an error.
    """
    from sparkloom.operators.msa import positions

    placed = positions(cells).withColumn("p", F.col("pos") - 1).drop("pos", "signed")
    joined = placed.join(places.select("seq_id", F.col("pos").cast("bigint").alias("p"), "symbols"), ["seq_id", "p"], "left")
    checked = F.when(F.col("p").isNotNull() & F.col("symbols").isNull(), F.raise_error(F.lit("a residue without symbols")).cast("string")).otherwise(F.col("symbols"))
    n = places.agg(F.max(F.length("symbols")).alias("n"))
    each = joined.withColumn("symbols", checked).join(F.broadcast(n)).withColumn("feature", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    letter = F.coalesce(F.substring("symbols", F.col("feature") + 1, F.lit(1)), F.lit("-"))
    packed = F.array_sort(F.collect_list(F.struct("col", letter.alias("l"))))
    return each.groupBy("msa_id", "feature", "seq_id").agg(F.array_join(F.transform(packed, lambda x: x["l"]), "").alias("row"))


def features_text(runs: DataFrame) -> DataFrame:
    """(msa_id, value): an annotation file of runs (msa_id, label, first_pos, last_pos, bin): a colour for each tenth, then a line for each run."""
    head = "\n".join(f"confidence{b}\t{int(255 * b / 10):02x}40{int(255 * (10 - b) / 10):02x}" for b in range(11))
    line = F.concat_ws("\t", F.format_string("confidence %d", "bin"), "label", F.lit("-1"), F.col("first_pos").cast("string"), F.col("last_pos").cast("string"), F.concat(F.lit("confidence"), F.col("bin").cast("string")))
    packed = F.array_sort(F.collect_list(F.struct("label", "first_pos", line.alias("t"))))
    return runs.groupBy("msa_id").agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(packed, lambda x: x["t"]), "\n")).alias("value"))


def comparison_html(test: DataFrame, gold: DataFrame) -> DataFrame:
    """(msa_id, html): the test alignment with each residue coloured by the gold column it stands in; residues that gold lacks stay plain."""
    from sparkloom.operators.score import residue_join

    hues = residue_join(test, gold).select("msa_id", "seq_id", F.col("test_col").alias("col"), ((F.col("gold_col") * 47) % 360).alias("hue"))
    coloured = test.join(hues, ["msa_id", "seq_id", "col"], "left")
    span = F.when(F.col("hue").isNull(), F.col("letter")).otherwise(F.format_string("<span style='background:hsl(%d,70%%,80%%)'>%s</span>", "hue", "letter"))
    join = lambda at, v, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, F.col(v)))), lambda x: x[v]), sep)
    line = coloured.withColumn("span", span).groupBy("msa_id", "seq_id").agg(join("col", "span", "").alias("line"))
    return line.groupBy("msa_id").agg(F.concat(F.lit("<pre>"), join("seq_id", "line", "\n"), F.lit("</pre>")).alias("html"))
