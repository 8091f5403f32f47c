"""Operators over alignments as cells (msa_id, seq_id, col, letter), col from 1, gaps `-` or `.`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.letters import is_gap, is_lower, is_upper
from sparkloom.operators.sequences import quartiles


def to_cells(rows: DataFrame) -> DataFrame:
    """From (msa_id, seq_id, row)."""
    letters = F.filter(F.split("row", ""), lambda c: c != "")
    return rows.select("msa_id", "seq_id", F.posexplode(letters).alias("pos", "letter")).select("msa_id", "seq_id", (F.col("pos") + 1).cast("bigint").alias("col"), "letter")


def to_rows(cells: DataFrame) -> DataFrame:
    """(msa_id, seq_id, row): the letters of each sequence in the order of their columns."""
    packed = F.array_sort(F.collect_list(F.struct("col", "letter")))
    return cells.groupBy("msa_id", "seq_id").agg(F.array_join(F.transform(packed, lambda x: x["letter"]), "").alias("row"))


def positions(cells: DataFrame) -> DataFrame:
    """cells with pos (1-based, null in a gap) and signed (in a gap minus the letters so far)."""
    before = Window.partitionBy("msa_id", "seq_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(is_gap("letter"), 0).otherwise(1)).over(before).cast("bigint")
    return cells.withColumn("n", n).select("*", F.when(~is_gap("letter"), F.col("n")).alias("pos"), F.when(is_gap("letter"), -F.col("n")).otherwise(F.col("n")).alias("signed")).drop("n")


def column_counts(cells: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    letter = F.col("letter")
    return cells.groupBy("msa_id", "col").agg(
        F.count("*").alias("n_rows"), one(is_gap("letter")).alias("gaps"), one(is_upper("letter")).alias("uppers"), one(is_lower("letter")).alias("lowers"),
        one(letter == ".").alias("dots"), one(letter == "-").alias("dashes"),
    )


def occupancy(cells: DataFrame) -> DataFrame:
    return column_counts(cells).select("msa_id", "col", ((F.col("n_rows") - F.col("gaps")) / F.col("n_rows")).alias("occupancy"))


def aligned_columns(cells: DataFrame, most_gaps: float = 1.0) -> DataFrame:
    """Upper-case columns with at most a share of gaps; a column with letters of both cases is an error."""
    c = column_counts(cells)
    mixed = (F.col("uppers") > 0) & (F.col("lowers") > 0)
    checked = c.withColumn("uppers", F.when(mixed, F.raise_error(F.concat(F.lit("mixed case in column "), F.col("col").cast("string"))).cast("bigint")).otherwise(F.col("uppers")))
    return checked.where((F.col("uppers") > 0) & (F.col("gaps") <= most_gaps * F.col("n_rows"))).select("msa_id", "col")


def project(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that (msa_id, seq_id) names, without the columns that are then all gaps, numbered anew."""
    return renumber(drop_gap_columns(cells.join(rows, ["msa_id", "seq_id"], "left_semi")))


def ranges(cells: DataFrame, first: int, last: int, rows: DataFrame | None = None) -> DataFrame:
    """Columns first to last (of the given rows), numbered from 1."""
    some = cells if rows is None else cells.join(rows, ["msa_id", "seq_id"], "left_semi")
    return some.where(F.col("col").between(first, last)).withColumn("col", F.col("col") - (first - 1))


def edited(cells: DataFrame, gone: DataFrame | None = None, copied: DataFrame | None = None) -> DataFrame:
    """Without the columns (msa_id, col) of `gone` and with copies of those of `copied` at the right end, numbered anew."""
    kept = cells if gone is None else cells.join(gone, ["msa_id", "col"], "left_anti")
    if copied is None:
        return renumber(kept)
    width = cells.groupBy("msa_id").agg(F.max("col").alias("width"))
    more = on_columns(cells, copied).join(width, "msa_id").withColumn("col", F.col("col") + F.col("width")).drop("width")
    return renumber(kept.unionByName(more))


def core(cells: DataFrame, least: int = 10) -> DataFrame:
    """(msa_id, seq_id, row): columns without any gap in upper case, the others squeezed; alignments of fewer such columns have none."""
    columns = match_columns(cells, 0.0)
    enough = columns.groupBy("msa_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("msa_id")
    kept = columns.join(enough, "msa_id", "left_semi")
    return squeeze_inserts(cells.join(enough, "msa_id", "left_semi"), kept)


def confidence_runs(columns: DataFrame) -> DataFrame:
    """(msa_id, msa_idx, first_col, last_col, bin): maximal runs of columns whose confidence is in one tenth. columns: (msa_id, msa_idx, col, confidence)."""
    keys = ["msa_id", "msa_idx"]
    binned = columns.withColumn("bin", F.floor(F.col("confidence") * 10).cast("bigint"))
    island = F.row_number().over(Window.partitionBy(*keys).orderBy("col")) - F.row_number().over(Window.partitionBy(*keys, "bin").orderBy("col"))
    return binned.withColumn("island", island).groupBy(*keys, "bin", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("island")


def on_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return cells.join(columns, ["msa_id", "col"], "left_semi")


def strip_gappy_columns(cells: DataFrame, most: float = 0.5) -> DataFrame:
    return on_columns(cells, column_counts(cells).where(F.col("gaps") <= most * F.col("n_rows")))


def strip_gappy_rows(cells: DataFrame, most: float = 0.5) -> DataFrame:
    rows = cells.groupBy("msa_id", "seq_id").agg(F.count("*").alias("n"), F.sum(is_gap("letter").cast("int")).alias("gaps"))
    return cells.join(rows.where(F.col("gaps") <= most * F.col("n")), ["msa_id", "seq_id"], "left_semi")


def strip_gappy(cells: DataFrame, most: float = 0.5) -> DataFrame:
    """Columns first, then rows by their gaps among the columns that stay."""
    return strip_gappy_rows(strip_gappy_columns(cells, most), most)


def drop_gap_columns(cells: DataFrame) -> DataFrame:
    return on_columns(cells, cells.where(~is_gap("letter")).select("msa_id", "col").distinct())


def renumber(cells: DataFrame) -> DataFrame:
    """Columns numbered 1, 2, ... again."""
    order = F.dense_rank().over(Window.partitionBy("msa_id").orderBy("col")).cast("bigint")
    columns = cells.select("msa_id", "col").distinct().withColumn("new", order)
    return cells.join(columns, ["msa_id", "col"]).select("msa_id", "seq_id", F.col("new").alias("col"), "letter")


def consensus(cells: DataFrame, alphabet: str) -> DataFrame:
    """(msa_id, consensus): the most frequent letter of each column; ties to the first in the alphabet, the gap last and left out."""
    letter = F.upper("letter")
    at = F.instr(F.lit(alphabet), F.upper(F.col("letter")))
    rank = F.when(is_gap("letter"), len(alphabet) + 1).when(at > 0, at)
    counted = cells.select("msa_id", "col", F.when(is_gap("letter"), "-").otherwise(letter).alias("letter"), rank.alias("rank")).where("rank is not null").groupBy("msa_id", "col", "letter", "rank").agg(F.count("*").alias("n"))
    best = counted.groupBy("msa_id", "col").agg(F.min(F.struct(-F.col("n"), "rank", "letter"))["letter"].alias("letter"))
    packed = F.array_sort(F.collect_list(F.struct("col", "letter")))
    return best.where("letter <> '-'").groupBy("msa_id").agg(F.array_join(F.transform(packed, lambda x: x["letter"]), "").alias("consensus"))


def a2m(cells: DataFrame, match: DataFrame) -> DataFrame:
    """Rows in which match columns are upper case or `-` and the letters of others lower case, without gaps."""
    flagged = cells.join(match.select("msa_id", "col", F.lit(True).alias("match")), ["msa_id", "col"], "left").withColumn("match", F.coalesce("match", F.lit(False)))
    letter = F.when(F.col("match"), F.when(is_gap("letter"), "-").otherwise(F.upper("letter"))).otherwise(F.lower("letter"))
    return to_rows(flagged.where("match or letter not in ('-', '.')").withColumn("letter", letter))


def match_columns(cells: DataFrame, most_gaps: float = 0.5) -> DataFrame:
    return column_counts(cells).where(F.col("gaps") <= most_gaps * F.col("n_rows")).select("msa_id", "col")


def reference_columns(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """Columns in which the reference row of each alignment (msa_id, seq_id) has a letter."""
    return cells.join(reference, ["msa_id", "seq_id"], "left_semi").where(~is_gap("letter")).select("msa_id", "col")


def insert_runs(cells: DataFrame, core: DataFrame) -> DataFrame:
    """(msa_id, first_col, last_col): maximal runs of columns that aren't core."""
    columns = cells.select("msa_id", "col").distinct().join(core, ["msa_id", "col"], "left_anti")
    island = F.col("col") - F.row_number().over(Window.partitionBy("msa_id").orderBy("col"))
    return columns.withColumn("island", island).groupBy("msa_id", "island").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col")).drop("island")


def squeeze_inserts(cells: DataFrame, core: DataFrame) -> DataFrame:
    """(msa_id, seq_id, row): each run of insert columns packed to its longest insert.

    Letters of inserts become lower case; dots fill the rest: on the left in the first run if it opens
    the alignment, on the right in the last if it ends it, else one half of them (rounded down) left.
    """
    keys = ["msa_id", "seq_id"]
    columns = cells.select("msa_id", "col").distinct().join(core.withColumn("core", F.lit(True)), ["msa_id", "col"], "left")
    by_col = Window.partitionBy("msa_id").orderBy("col")
    group = F.sum(F.when(F.col("core"), 1).otherwise(0)).over(by_col.rowsBetween(Window.unboundedPreceding, 0))
    ends = columns.groupBy("msa_id").agg(F.max("col").alias("last_col"))
    marked = cells.join(columns.withColumn("group", group.cast("bigint")), ["msa_id", "col"])
    kept = F.when(is_gap("letter"), "").otherwise(F.lower("letter"))
    packed = F.array_sort(F.collect_list(F.struct("col", "kept")))
    inserts = (
        marked.where("core is null").withColumn("kept", kept).groupBy(*keys, "group")
        .agg(F.array_join(F.transform(packed, lambda x: x["kept"]), "").alias("text"), F.max("col").alias("end"))
        .withColumn("width", F.max(F.length("text")).over(Window.partitionBy("msa_id", "group")))
        .join(ends, "msa_id")
    )
    dots = F.col("width") - F.length("text")
    left = F.when(F.col("group") == 0, dots).when(F.col("end") == F.col("last_col"), 0).otherwise(F.floor(dots / 2)).cast("int")
    filled = inserts.select(*keys, "group", F.lit(1).alias("kind"), F.concat(F.repeat(F.lit("."), left), F.col("text"), F.repeat(F.lit("."), (dots - left).cast("int"))).alias("text"))
    letters = marked.where("core").select(*keys, "group", F.lit(0).alias("kind"), F.when(is_gap("letter"), "-").otherwise(F.upper("letter")).alias("text"))
    all_ = F.array_sort(F.collect_list(F.struct("group", "kind", "text")))
    return filled.unionByName(letters).groupBy(*keys).agg(F.array_join(F.transform(all_, lambda x: x["text"]), "").alias("row"))


def trim_to_reference(cells: DataFrame, reference: DataFrame, *also: str) -> DataFrame:
    """Rows that the reference has, with letters blanked where the reference's are lower case, without all-gap columns. also: further columns that name an alignment of cells, such as its member's number."""
    own = Window.partitionBy("msa_id", "seq_id", *also).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(is_gap("letter"), 0).otherwise(1)).over(own).cast("bigint")
    placed = cells.withColumn("pos", F.when(~is_gap("letter"), n))
    ref = positions(reference).where("pos is not null").select("msa_id", "seq_id", "pos", is_lower("letter").alias("low"))
    known = reference.where(~is_gap("letter")).select("msa_id", "seq_id").distinct()
    joined = placed.join(known.hint("merge"), ["msa_id", "seq_id"], "left_semi").join(ref.hint("merge"), ["msa_id", "seq_id", "pos"], "left")
    trimmed = joined.select("msa_id", *also, "seq_id", "col", F.when(F.col("low"), "-").otherwise(F.col("letter")).alias("letter"))
    filled = trimmed.where(~is_gap("letter")).select("msa_id", *also, "col").distinct()
    return trimmed.join(filled, ["msa_id", *also, "col"], "left_semi")


def trim_ensemble(cells: DataFrame, reference: DataFrame, members: str = "msa_idx") -> DataFrame:
    """trim_to_reference of each member of an ensemble; cells has the member's number too."""
    return trim_to_reference(cells, reference, members)


def row_pairs(cells: DataFrame) -> DataFrame:
    """Identity of each two rows of an alignment: both (letters in both), same, either (letters in one at least)."""
    a = cells.select("msa_id", "col", F.col("seq_id").alias("a"), F.col("letter").alias("la"))
    b = cells.select("msa_id", "col", F.col("seq_id").alias("b"), F.col("letter").alias("lb"))
    both = ~is_gap("la") & ~is_gap("lb")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return a.join(b, ["msa_id", "col"]).where("a < b").groupBy("msa_id", "a", "b").agg(
        one(both).alias("both"), one(both & (F.col("la") == F.col("lb"))).alias("same"), one(both & (F.lower("la") == F.lower("lb"))).alias("alike"),
        one(~is_gap("la") | ~is_gap("lb")).alias("either"),
    )


def concatenate(left: DataFrame, right: DataFrame, empty_width: int = 0) -> DataFrame:
    """(msa_id, seq_id, row) of both side by side, joined by seq_id; a row that one side lacks is gaps there.

    An alignment without any row on one side has `empty_width` columns there.
    """
    wide = lambda df: df.groupBy("msa_id").agg(F.max(F.length("row")).alias("width"))
    joined = left.withColumnRenamed("row", "l").join(right.withColumnRenamed("row", "r"), ["msa_id", "seq_id"], "full")
    joined = joined.join(wide(left).withColumnRenamed("width", "lw"), "msa_id", "left").join(wide(right).withColumnRenamed("width", "rw"), "msa_id", "left")
    gaps = lambda c: F.repeat(F.lit("-"), F.coalesce(c, F.lit(empty_width)).cast("int"))
    return joined.select("msa_id", "seq_id", F.concat(F.coalesce("l", gaps(F.col("lw"))), F.coalesce("r", gaps(F.col("rw")))).alias("row"))


def strip_anchors(cells: DataFrame) -> DataFrame:
    """Without the digit columns, which must be equal in all rows."""
    digits = cells.where(F.col("letter").rlike("^[0-9]$")).select("msa_id", "col").distinct()
    odd = on_columns(cells, digits).groupBy("msa_id", "col").agg(F.min("letter").alias("x"), F.max("letter").alias("y"))
    checked = odd.select("msa_id", F.when(F.col("x") != F.col("y"), F.raise_error(F.lit("anchors differ")).cast("bigint")).otherwise(F.col("col")).alias("col"))
    return cells.join(checked, ["msa_id", "col"], "left_anti")


def spread_statistics(cells: DataFrame) -> DataFrame:
    """(msa_id, what, lo, median, hi, mean) of the lengths of rows without gaps and of the gap percent of columns (whole numbers); medians are upper ones."""
    lengths = cells.groupBy("msa_id", "seq_id").agg(F.sum((~is_gap("letter")).cast("bigint")).alias("v")).select("msa_id", F.lit("length").alias("what"), "v")
    gaps = column_counts(cells).select("msa_id", F.lit("gap_percent").alias("what"), F.expr("gaps * 100 div n_rows").alias("v"))
    return quartiles(lengths.union(gaps), "v", ["msa_id", "what"]).select("msa_id", "what", "lo", "median", "hi", "mean")


def statistics(cells: DataFrame) -> DataFrame:
    """One row for each alignment: rows, columns, gap-free columns, case of columns, share of gaps."""
    c = column_counts(cells)
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return c.groupBy("msa_id").agg(
        F.max("n_rows").alias("n_rows"), F.count("*").alias("n_cols"), one(F.col("gaps") == 0).alias("gap_free"), one((F.col("uppers") > 0) & (F.col("lowers") == 0)).alias("upper_cols"),
        one((F.col("lowers") > 0) & (F.col("uppers") == 0)).alias("lower_cols"), one((F.col("lowers") > 0) & (F.col("uppers") > 0)).alias("mixed_cols"), (F.sum("gaps") / F.sum("n_rows")).alias("gap_share"),
    )
