"""Personal data: base patterns with checks, and identifiers that bootstrapped contexts add.

DataFrame and SQL functions only. Places of matches come from split() and regexp_extract_all() with
one pattern: what stands between matches and the matches themselves alternate, so running sums of
their lengths (in code points) are the places. Matches become rows before they are placed, checked
and compared, so the work on a text grows with its length and not with the square of its matches.
The patterns are possessive and begin only where a run begins or the last match ended, so that very
long words cost no more than their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A word that may be an identifier: six letters or more with a digit.
CANDIDATE = r"(?<![A-Za-z0-9@._+-])(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@._+-]{5,}[A-Za-z0-9]"
WHITE = "\t\n\x0b\f\r"
MATCHES = "array<struct<gap:int,size:int,value:string,left:string,right:string>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        )
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        backwards = F.reverse(digits)
        total = F.aggregate(
            F.sequence(F.lit(1), F.length(digits)),
            F.lit(0),
            lambda a, i: a + F.element_at(F.array(*(F.lit(x) for x in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), (F.substring(backwards, i, F.lit(1)).cast("int") + F.lit(1) + F.lit(10) * ((i + 1) % 2))),
        )
        return F.length(digits).between(13, 19) & (total % 10 == 0)
    return F.lit(True)


def _beside(between: Column, last: bool) -> Column:
    """The last or first word of what stands beside a match, in lower case with digits as 0; empty if there is none."""
    plain = F.translate(F.coalesce(between, F.lit("")), WHITE, "     ")
    word = F.substring_index(F.rtrim(plain), " ", -1) if last else F.substring_index(F.ltrim(plain), " ", 1)
    return F.translate(F.lower(word), "123456789", "000000000")


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """All matches in order, each with the length of what stands before it since the last one, its own length and the words beside it."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(between.alias("a"), found.alias("b"), F.slice(between, 2, 1 << 30).alias("c"))
    each = F.transform(
        F.filter(zipped, lambda x: x["b"].isNotNull()),
        lambda x: F.struct(F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("size"), x["b"].alias("value"), _beside(x["a"], True).alias("left"), _beside(x["c"], False).alias("right")),
    )
    return F.when(text.rlike(hint), each).otherwise(F.array().cast(MATCHES))


def matches(rows: DataFrame) -> DataFrame:
    """(row, kind, start, stop, value, left, right) of the matches in rows (row, a column of arrays for each kind), unchecked ones too."""
    each = reduce(DataFrame.union, (rows.select("row", F.lit(k).alias("kind"), F.posexplode(f"__{k}").alias("pos", "m")) for k in (*KINDS, "other")))
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(before).cast("int")
    placed = each.withColumn("stop", stop)
    return placed.select("row", "kind", (F.col("stop") - F.col("m.size")).alias("start"), "stop", "m.value", "m.left", "m.right")


def apart(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates that overlap no base span of their row: two sorts of each row's spans, no pairs."""
    both = base.withColumn("is_base", F.lit(True)).unionByName(candidates.withColumn("is_base", F.lit(False)))
    up = Window.partitionBy("row").orderBy("start", F.desc("is_base")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("is_base")).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("reach", F.max(F.when(F.col("is_base"), F.col("stop"))).over(up)).withColumn("next", F.min(F.when(F.col("is_base"), F.col("start"))).over(down))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop"))
    return marked.where(~F.col("is_base") & free).drop("is_base", "reach", "next")


def _patterns() -> Column:
    """The patterns of an instance: the word to its left, and the words on both sides."""
    left, right = F.col("left"), F.col("right")
    return F.filter(F.array(F.when(left != "", F.concat(F.lit("L "), left)), F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right))), lambda p: p.isNotNull())


def discover(instances: DataFrame, rounds: int = 10, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, score): patterns to trust, from a graph of patterns and instances scored in rounds.

    instances: (value, left, right, kind, n), kind null where nothing is known. A pattern's score for
    a kind is the sum of its instances' scores over their number plus one; an instance's score is one
    if a base pattern knows its kind, else the best score of its trusted patterns, those with `support`
    and at least `confidence`. Rounds end when no instance becomes known any more, or after `rounds`.
    """
    edges = materialize(instances.select("value", "n", F.explode(_patterns()).alias("pattern")).groupBy("pattern", "value").agg(F.sum("n").alias("n")))
    totals = materialize(edges.groupBy("pattern").agg(F.sum("n").alias("total")))
    seeds = instances.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    known = materialize(seeds)
    size, trusted = known.count(), None
    for _ in range(rounds):
        hits = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("n").alias("held"))
        scored = hits.join(totals, "pattern").withColumn("score", F.round(F.col("hits") / (F.col("total") + 1), 9))
        trusted = materialize(scored.where((F.col("held") >= support) & (F.col("score") >= confidence)).select("pattern", "kind", "score"))
        found = edges.join(trusted, "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
        known = materialize(found.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")))
        now = known.count()
        if now == size:
            break
        size = now
    return trusted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base and spans: arrays of (kind, start, stop), by kind, then start.

    base are checked matches of the patterns; spans add the identifiers (words of six letters or more
    with a digit) whose left word, or words on both sides, is a trusted pattern; among several kinds
    the one of the best score counts, then the first as listed. Nulls and empty texts have none;
    columns of these names are replaced, all others kept; rows that repeat a doc_id, or have none,
    each have their own spans. Time on a very long text grows with its length. An empty table gives
    an empty result.
    """
    names = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    plain = docs.drop(*names)
    text = F.coalesce(F.col("text"), F.lit(""))
    given = plain.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text"))
    looked = given.select("doc_id", "text_id", *(_matches(text, PATTERNS[k], HINTS[k]).alias(f"__{k}") for k in KINDS), _matches(text, CANDIDATE, "[0-9]").alias("__other"))
    some = looked.where(reduce(lambda a, b: a | b, (F.size(f"__{k}") > 0 for k in (*KINDS, "other"))))
    # Numbers are drawn as the rows are written and read from there.
    rows = materialize(some.withColumn("row", F.monotonically_increasing_id()))
    placed = materialize(matches(rows))
    valid = reduce(lambda a, k: a.when(F.col("kind") == k, _valid(k, F.col("value"))), KINDS[1:], F.when(F.col("kind") == KINDS[0], _valid(KINDS[0], F.col("value"))))
    base = materialize(placed.where(F.col("kind") != "other").where(valid))
    others = materialize(apart(placed.where("kind = 'other'"), base))
    unknown = F.lit(None).cast("string")
    occurrences = base.unionByName(others.withColumn("kind", unknown))
    trusted = discover(occurrences.groupBy("value", "left", "right", "kind").agg(F.count("*").alias("n")))
    order = F.array(*(F.lit(k) for k in KINDS))
    met = others.select("row", "start", "stop", F.explode(_patterns()).alias("pattern")).join(trusted, "pattern")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.array_position(order, F.col("kind")).alias("place"), F.col("kind").alias("k")))["k"]
    more = met.groupBy("row", "start", "stop").agg(best.alias("kind"))
    typed = "array<struct<kind:string,start:int,stop:int>>"
    span = F.struct(F.array_position(order, F.col("kind")).alias("place"), "start", "stop", "kind")
    every = base.select("row", span.alias("s"), F.lit(True).alias("is_base")).union(more.select("row", span.alias("s"), F.lit(False).alias("is_base")))
    plainly = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    packed = every.groupBy("row").agg(
        *(F.sum((F.col("is_base") & (F.col("s.kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS),
        plainly(F.collect_list(F.when(F.col("is_base"), F.col("s")))).alias("base"),
        plainly(F.collect_list("s")).alias("spans"),
    )
    found = packed.join(rows.select("row", F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text")), "row").dropDuplicates(["__doc", "__text"]).drop("row")
    keyed = plain.withColumn("__key", F.col(id_col).cast("long")).withColumn("__hash", F.xxhash64(F.col(text_col)))
    key = F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text"))
    zero, none = F.lit(0).cast("long"), F.array().cast(typed)
    return keyed.join(found, key, "left").select(
        *(F.col(f"`{c}`") for c in plain.columns), *(F.coalesce(F.col(f"n_{k}"), zero).alias(f"n_{k}") for k in KINDS), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def spelled(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: str = "text", spans: str = "spans") -> Column:
    """The text with its spans, joined where they overlap, replaced by [KIND] of the first of them.

    The text is cut into characters once and sliced, so that the work grows with its length.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    # The farthest end before each span, as a running maximum; a span that begins before it belongs to the one before.
    reach = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("far"), F.array().cast("array<int>").alias("all")),
        lambda acc, s: F.struct(F.greatest(acc["far"], s["stop"]).alias("far"), F.array_append(acc["all"], acc["far"]).alias("all")),
        lambda acc: F.array_append(acc["all"], acc["far"]),
    )
    # Each new span with the end of what is masked before it.
    marked = F.filter(F.arrays_zip(ordered.alias("s"), reach.alias("before")), lambda x: x["s"].isNull() | (x["s"]["start"] >= x["before"]))
    t = F.col(text)
    letters = F.split(t, "")
    piece = lambda chars, a, n: F.array_join(F.slice(chars, a + 1, F.greatest(n, F.lit(0))), "")
    parts = F.transform(
        F.array(F.struct(letters.alias("chars"), marked.alias("marked"))),
        lambda x: F.array_join(
            F.transform(
                x["marked"],
                lambda m: F.when(m["s"].isNull(), piece(x["chars"], m["before"], F.size(x["chars"]) - m["before"])).otherwise(
                    F.concat(piece(x["chars"], m["before"], m["s"]["start"] - m["before"]), F.lit("["), F.upper(m["s"]["kind"]), F.lit("]"))
                ),
            ),
            "",
        ),
    )[0]
    return F.when((F.size(spans) > 0) & t.isNotNull(), parts).otherwise(t)
