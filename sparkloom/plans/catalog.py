"""Queries over the benchmark tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.letters import DAYHOFF_PAMS, kimura
from sparkloom.operators import ensemble, kmers, msa, posterior, profile, score, sequences, trees
from sparkloom.plans import align
from sparkloom.plans import stand_ins as s
from sparkloom.plans.registry import ALPHABET, COUNTS, GAP, PLACED, QUERIES, SQL, N, R, longs, query, rounded

# Sequence sets


@query("SELECT min(doc_id) AS seq_id, count(*) AS size FROM documents GROUP BY lower(text)")
def derep_representatives(spark, sf):
    return sequences.representatives(s.documents(spark, sf))


@query("SELECT doc_id AS seq_id, rep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(text)) AS rep_id FROM documents) WHERE doc_id <> rep_id")
def derep_duplicate_map(spark, sf):
    return sequences.duplicate_map(s.documents(spark, sf))


@query("SELECT doc_id AS seq_id, CAST(length(first_value(text) OVER (PARTITION BY lower(text) ORDER BY doc_id)) AS BIGINT) AS n FROM documents")
def dupes_reinserted(spark, sf):
    docs = s.documents(spark, sf)
    firsts = docs.join(sequences.representatives(docs).select("seq_id"), "seq_id", "left_semi").select("seq_id", F.length("letters").cast("bigint").alias("n"))
    return sequences.reinsert(firsts, sequences.duplicate_map(docs))


@query("""SELECT lang, count(*) AS n, min(l) AS lo, list_sort(list(l))[count(*) // 4 + 1] AS q1, list_sort(list(l))[count(*) // 2 + 1] AS median,
  list_sort(list(l))[3 * count(*) // 4 + 1] AS q3, max(l) AS hi, round(avg(l), 6) AS mean FROM (SELECT lang, length(text) AS l FROM documents) GROUP BY lang""")
def seq_length_quartiles(spark, sf):
    sized = s.documents(spark, sf).select("lang", F.length("letters").cast("bigint").alias("l"))
    return rounded(sequences.quartiles(sized, "l", ["lang"]), "mean")


@query("SELECT c_custkey AS seq_id, c_custkey // 64 AS chunk FROM customer")
def chunk_split(spark, sf):
    return sequences.chunks(s.table(spark, sf, "customer").select(F.col("c_custkey").alias("seq_id"), F.col("c_custkey").alias("ord")), 64)


@query("""SELECT doc_id AS seq_id, CAST(length(text) - length(translate(text, 'ACGTUacgtu', '')) > 0.75 * length(text) AS BIGINT) AS nucleotide FROM documents""")
def nucleotide_guess(spark, sf):
    folded = F.translate("letters", "acgtu", "ACGTU")
    plain = (F.length("letters") - F.length(F.translate(folded, "ACGTU", ""))) > 0.75 * F.length("letters")
    return s.documents(spark, sf).select("seq_id", plain.cast("bigint").alias("nucleotide"))


@query("""SELECT n_nationkey AS seq_id, CASE WHEN n_regionkey < 3 THEN r_name || '_' || n_nationkey ELSE n_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def relabel_left_join(spark, sf):
    nation, region = s.table(spark, sf, "nation"), s.table(spark, sf, "region")
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).where("n_regionkey < 3").select(F.col("n_name").alias("old_label"), F.concat_ws("_", "r_name", "n_nationkey").alias("new_label"))
    return sequences.relabel(nation.select(F.col("n_nationkey").alias("seq_id"), F.col("n_name").alias("label")), names).select("seq_id", "label")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def label_set_difference(spark, sf):
    orders = s.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sequences.without(s.table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT p_name AS label, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_labels(spark, sf):
    return sequences.label_check(s.table(spark, sf, "part").select(F.col("p_name").alias("label")))


@query("SELECT doc_id AS seq_id, CAST(length(text) AS BIGINT) AS n, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS place FROM documents")
def length_order(spark, sf):
    return sequences.in_length_order(s.documents(spark, sf))


@query("""SELECT CAST(r AS BIGINT) AS rep, CAST(a.n_nationkey AS BIGINT) AS site, CAST((r * 7919 + a.n_nationkey * 104729) % 25 AS BIGINT) AS unit FROM nation a, range(100) AS t(r)""")
def resampled_columns(spark, sf):
    return sequences.drawn(s.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("unit")), 100)


# K-mers

KMERS = s.EVENTS + ", k AS (SELECT seq_id, substr(letters, CAST(i AS INTEGER), 3) AS kmer, count(*) AS n FROM seqs, range(1, 100000) AS t(i) WHERE i <= length(letters) - 2 GROUP BY 1, 2)"


def _kmers(spark, sf):
    return kmers.counts(s.event_sequences(spark, sf), 3)


@query(f"WITH {KMERS} SELECT seq_id, kmer, n FROM k")
def kmer_counts(spark, sf):
    return _kmers(spark, sf)


@query(f"WITH {KMERS} SELECT a.seq_id AS a, b.seq_id AS b, {N('sum(least(a.n, b.n))')} AS common FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_id < b.seq_id GROUP BY 1, 2")
def kmer_common_pairs(spark, sf):
    return kmers.common(_kmers(spark, sf))


@query(
    f"""WITH {KMERS}, own AS (SELECT seq_id, sum(n) AS o FROM k GROUP BY 1),
  c AS (SELECT a.seq_id AS a, b.seq_id AS b, sum(least(a.n, b.n)) AS c FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_id < b.seq_id GROUP BY 1, 2)
  SELECT c.a, c.b, {R("least(3.0 * (x.o - c) / x.o, 3.0 * (y.o - c) / y.o)")} AS d FROM c JOIN own x ON x.seq_id = c.a JOIN own y ON y.seq_id = c.b"""
)
def kmer_distance(spark, sf):
    return rounded(kmers.distances(_kmers(spark, sf)), "d")


@query(
    f"""WITH {KMERS}, u AS (SELECT a.seq_id AS q, b.seq_id AS t, sum(a.n * b.n) AS u FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_id <> b.seq_id GROUP BY 1, 2),
  m AS (SELECT *, max(u) OVER (PARTITION BY q) AS top FROM u)
  SELECT q AS query_id, t AS target_id, {N("u")} AS u FROM m WHERE top > 1 AND u >= greatest(1, top // 2 - 1)"""
)
def usort_top_hits(spark, sf):
    k = _kmers(spark, sf)
    return kmers.word_search(k, k)


# Alignments


@query(f"WITH {s.TEST}, {PLACED.format('test')} SELECT msa_id, seq_id, col, CASE WHEN NOT {GAP} THEN {N('n')} END AS pos, {N(f'CASE WHEN {GAP} THEN -n ELSE n END')} AS signed FROM test_pos")
def signed_pos_map(spark, sf):
    return msa.positions(s.cells(spark, sf)).drop("letter")


@query(f"WITH {s.GOLD}, {COUNTS.format('gold')} SELECT * FROM counts")
def column_case_counts(spark, sf):
    return msa.column_counts(s.cells(spark, sf, "gold"))


@query(f"WITH {s.TEST}, {COUNTS.format('test')} SELECT msa_id, col, {R('(n_rows - gaps) / n_rows')} AS occupancy FROM counts")
def column_gap_fraction(spark, sf):
    return rounded(msa.occupancy(s.cells(spark, sf)), "occupancy")


@query(f"WITH {s.GOLD}, {COUNTS.format('gold')} SELECT msa_id, col FROM counts WHERE uppers > 0 AND gaps <= 0.3 * n_rows")
def aligned_columns(spark, sf):
    return msa.aligned_columns(s.cells(spark, sf, "gold"), 0.3)


ROWS = "SELECT msa_id, seq_id, string_agg(letter, '' ORDER BY col) AS row FROM {} GROUP BY msa_id, seq_id"
KEPT = "cut AS (SELECT test.* FROM test JOIN counts USING (msa_id, col) WHERE gaps <= 0.5 * n_rows)"


@query(f"WITH {s.TEST}, {COUNTS.format('test')}, {KEPT} {ROWS.format('cut')}")
def strip_gappy_columns(spark, sf):
    return msa.to_rows(msa.strip_gappy_columns(s.cells(spark, sf)))


@query(f"WITH {s.TEST}, ok AS (SELECT msa_id, seq_id FROM test GROUP BY 1, 2 HAVING count(*) FILTER ({GAP}) <= 0.4 * count(*)) SELECT test_rows.* FROM test_rows JOIN ok USING (msa_id, seq_id)")
def strip_gappy_rows(spark, sf):
    return msa.to_rows(msa.strip_gappy_rows(s.cells(spark, sf), 0.4))


@query(
    f"""WITH {s.TEST}, {COUNTS.format("test")}, cut AS (SELECT test.* FROM test JOIN counts USING (msa_id, col) WHERE gaps <= 0.3 * n_rows),
  ok AS (SELECT msa_id, seq_id FROM cut GROUP BY 1, 2 HAVING count(*) FILTER ({GAP}) <= 0.3 * count(*)), fine AS (SELECT cut.* FROM cut JOIN ok USING (msa_id, seq_id)) {ROWS.format("fine")}"""
)
def strip_gappy(spark, sf):
    return msa.to_rows(msa.strip_gappy(s.cells(spark, sf), 0.3))


@query(
    f"""WITH {s.TEST}, filled AS (SELECT DISTINCT msa_id, col FROM test WHERE NOT {GAP}), num AS (SELECT msa_id, col, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS new FROM filled),
  fine AS (SELECT test.msa_id, seq_id, new AS col, letter FROM test JOIN num USING (msa_id, col)) SELECT * FROM fine"""
)
def drop_gap_columns(spark, sf):
    return msa.renumber(msa.drop_gap_columns(s.cells(spark, sf)))


@query(
    f"""WITH {s.TEST}, c AS (SELECT msa_id, col, letter, count(*) AS n, CASE WHEN {GAP} THEN 27 ELSE instr('{ALPHABET}', letter) END AS rank FROM test GROUP BY msa_id, col, letter),
  b AS (SELECT *, row_number() OVER (PARTITION BY msa_id, col ORDER BY n DESC, rank) AS r FROM c WHERE rank > 0)
  SELECT msa_id, string_agg(letter, '' ORDER BY col) AS consensus FROM b WHERE r = 1 AND letter <> '-' GROUP BY msa_id"""
)
def consensus_rows(spark, sf):
    return msa.consensus(s.cells(spark, sf), ALPHABET)


A2M = """a AS (SELECT msa_id, seq_id, string_agg(CASE WHEN m THEN upper(letter) WHEN letter = '-' THEN '' ELSE lower(letter) END, '' ORDER BY col) AS row FROM flagged GROUP BY 1, 2) SELECT * FROM a"""


@query(f"WITH {s.TEST}, {COUNTS.format('test')}, flagged AS (SELECT test.*, gaps <= 0.5 * n_rows AS m FROM test JOIN counts USING (msa_id, col)), {A2M}")
def make_a2m(spark, sf):
    c = s.cells(spark, sf)
    return msa.a2m(c, msa.match_columns(c))


REFS = "refs AS (SELECT p_brand AS msa_id, min(p_partkey) AS seq_id FROM part GROUP BY 1)"


@query(
    f"""WITH {s.TEST}, {REFS}, rc AS (SELECT test.msa_id, col FROM test JOIN refs USING (msa_id, seq_id) WHERE letter <> '-'),
  flagged AS (SELECT test.*, rc.col IS NOT NULL AS m FROM test LEFT JOIN rc USING (msa_id, col)), {A2M}"""
)
def make_a2m_refseq(spark, sf):
    c = s.cells(spark, sf)
    first = s.rows(spark, sf).groupBy("msa_id").agg(F.min("seq_id").alias("seq_id"))
    return msa.a2m(c, msa.reference_columns(c, first))


RUNS = """ins AS (SELECT msa_id, col, col - row_number() OVER (PARTITION BY msa_id ORDER BY col) AS island FROM counts WHERE gaps > 0.3 * n_rows)"""


@query(f"WITH {s.TEST}, {COUNTS.format('test')}, {RUNS} SELECT msa_id, min(col) AS first_col, max(col) AS last_col FROM ins GROUP BY msa_id, island")
def insert_runs(spark, sf):
    c = s.cells(spark, sf)
    return msa.insert_runs(c, msa.match_columns(c, 0.3))


@query(
    f"""WITH {s.TEST}, {COUNTS.format("test")}, g AS (SELECT msa_id, col, gaps <= 0.3 * n_rows AS core, sum(CASE WHEN gaps <= 0.3 * n_rows THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id ORDER BY col) AS grp FROM counts),
  i AS (SELECT test.msa_id, seq_id, grp, string_agg(CASE WHEN letter = '-' THEN '' ELSE lower(letter) END, '' ORDER BY col) AS t, max(col) AS last FROM test JOIN g USING (msa_id, col) WHERE NOT core GROUP BY 1, 2, 3),
  w AS (SELECT *, max(length(t)) OVER (PARTITION BY msa_id, grp) - length(t) AS dots FROM i),
  f AS (SELECT msa_id, seq_id, grp, 1 AS kind, CASE WHEN grp = 0 THEN repeat('.', dots) || t WHEN last = {s.WIDTH} THEN t || repeat('.', dots) ELSE repeat('.', dots // 2) || t || repeat('.', dots - dots // 2) END AS t FROM w
    UNION ALL SELECT test.msa_id, seq_id, grp, 0, upper(letter) FROM test JOIN g USING (msa_id, col) WHERE core)
  SELECT msa_id, seq_id, string_agg(t, '' ORDER BY grp, kind) AS row FROM f GROUP BY 1, 2"""
)
def squeeze_inserts(spark, sf):
    c = s.cells(spark, sf)
    return msa.squeeze_inserts(c, msa.match_columns(c, 0.3))


TRIM = f"""{PLACED.format("test")}, {PLACED.format("gold")},
  cut AS (SELECT t.msa_id, t.seq_id, t.col, CASE WHEN g.letter <> upper(g.letter) THEN '-' ELSE t.letter END AS letter FROM test_pos t
    LEFT JOIN (SELECT * FROM gold_pos WHERE letter <> '-') g ON t.msa_id = g.msa_id AND t.seq_id = g.seq_id AND t.n = g.n AND t.letter <> '-'),
  fine AS (SELECT cut.* FROM cut JOIN (SELECT DISTINCT msa_id, col FROM cut WHERE letter <> '-') USING (msa_id, col))"""


@query(f"WITH {s.TEST}, {s.GOLD}, {TRIM} {ROWS.format('fine')}")
def trim_to_reference(spark, sf):
    return msa.to_rows(msa.trim_to_reference(s.cells(spark, sf), s.cells(spark, sf, "gold")))


IDENTITY = f"""ident AS (SELECT a.msa_id, a.seq_id AS a, b.seq_id AS b, count(*) FILTER (a.letter <> '-' AND b.letter <> '-') AS both_, count(*) FILTER (a.letter <> '-' AND a.letter = b.letter) AS same,
  count(*) FILTER (a.letter <> '-' OR b.letter <> '-') AS either_ FROM test a JOIN test b ON a.msa_id = b.msa_id AND a.col = b.col AND a.seq_id < b.seq_id GROUP BY 1, 2, 3)"""


@query(f"WITH {s.TEST}, {IDENTITY} SELECT msa_id, a, b, CASE WHEN both_ > 0 THEN {R('100.0 * same / both_')} END AS percent FROM ident")
def pairwise_identity(spark, sf):
    p = msa.row_pairs(s.cells(spark, sf))
    return rounded(p.select("msa_id", "a", "b", F.when(F.col("both") > 0, 100.0 * F.col("same") / F.col("both")).alias("percent")), "percent")


KIMURA = f"CASE WHEN p > 0.93 THEN 10.0 WHEN p < 0.75 THEN -ln(1 - p - p * p / 5) ELSE ({DAYHOFF_PAMS})[CAST(floor((p - 0.75) * 1000 + 0.5) AS INTEGER) + 1] / 100.0 END"


@query(f"SELECT CAST(k AS BIGINT) AS thousandths, {R(KIMURA)} AS d FROM (SELECT DISTINCT p_partkey % 1001 AS k, (p_partkey % 1001) / 1000.0::DOUBLE AS p FROM part)")
def kimura_curve(spark, sf):
    """The correction at each thousandth."""
    k = s.table(spark, sf, "part").select((F.col("p_partkey") % 1001).cast("bigint").alias("thousandths")).distinct()
    return rounded(k.select("thousandths", kimura(F.col("thousandths") / 1000.0).alias("d")), "d")


@query(f"WITH {s.TEST}, {IDENTITY}, f AS (SELECT *, 1 - same::DOUBLE / either_ AS p FROM ident) SELECT msa_id, a, b, {R(KIMURA)} AS d FROM f")
def kimura_distance(spark, sf):
    p = msa.row_pairs(s.cells(spark, sf)).withColumn("p", 1 - F.col("alike") / F.col("either"))
    return rounded(p.select("msa_id", "a", "b", kimura("p").alias("d")), "d")


@query(
    f"""WITH {s.TEST_ROWS}, {s.GOLD_ROWS}, third AS (SELECT * FROM gold_rows WHERE seq_id % 3 = 0)
  SELECT t.msa_id, t.seq_id, t.row || coalesce(g.row, repeat('-', {s.WIDTH})) AS row FROM test_rows t LEFT JOIN third g USING (msa_id, seq_id)"""
)
def concat_alignments(spark, sf):
    return msa.concatenate(s.rows(spark, sf), s.rows(spark, sf, "gold").where("seq_id % 3 = 0"), s.WIDTH)


@query(
    f"""WITH {s.GOLD}, {COUNTS.format("gold")} SELECT msa_id, max(n_rows) AS n_rows, count(*) AS n_cols, count(*) FILTER (gaps = 0) AS gap_free, count(*) FILTER (uppers > 0 AND lowers = 0) AS upper_cols,
  count(*) FILTER (lowers > 0 AND uppers = 0) AS lower_cols, count(*) FILTER (lowers > 0 AND uppers > 0) AS mixed_cols, {R("sum(gaps) / sum(n_rows)")} AS gap_share FROM counts GROUP BY msa_id"""
)
def msa_statistics(spark, sf):
    return rounded(msa.statistics(s.cells(spark, sf, "gold")), "gap_share")


# Scores

RESIDUES = f"""{PLACED.format("test")}, {PLACED.format("gold")}, j AS (SELECT g.msa_id, g.seq_id, g.n AS pos, g.col AS gold_col, t.col AS test_col, g.letter AS gl, t.letter AS tl
  FROM (SELECT * FROM gold_pos WHERE letter <> '-') g JOIN (SELECT * FROM test_pos WHERE letter <> '-') t ON g.msa_id = t.msa_id AND g.seq_id = t.seq_id AND g.n = t.n)"""
SPOTS = "spots AS (SELECT msa_id, gold_col, test_col, count(*) AS n FROM j {} GROUP BY 1, 2, 3), c AS (SELECT msa_id, gold_col, sum(n) AS n, sum(n * (n - 1) // 2) AS r, count(*) AS places FROM spots GROUP BY 1, 2)"
CLASSIC = f"WITH {s.TEST}, {s.GOLD}, {RESIDUES}, {SPOTS.format('WHERE gold_col <= 8')}, q AS (SELECT msa_id, CASE WHEN sum(n * (n - 1) // 2) > 0 THEN sum(r)::DOUBLE / sum(n * (n - 1) // 2) END AS q, CASE WHEN count(*) FILTER (n > 1) > 0 THEN count(*) FILTER (n > 1 AND places = 1)::DOUBLE / count(*) FILTER (n > 1) END AS tc FROM c GROUP BY 1)"


def _scores(spark, sf, mode="classic", most=1.0):
    return score.quality(s.cells(spark, sf), s.cells(spark, sf, "gold"), mode, most)


@query(f"{CLASSIC} SELECT msa_id, {R('q')} AS q, {R('tc')} AS tc FROM q")
def qscore_classic(spark, sf):
    return rounded(_scores(spark, sf), "q", "tc")


@query(
    f"""WITH {s.TEST}, {s.GOLD}, {RESIDUES}, {COUNTS.format("gold")}, ok AS (SELECT msa_id, col AS gold_col FROM counts WHERE uppers > 0 AND gaps <= 0.5 * n_rows), k AS (SELECT j.* FROM j JOIN ok USING (msa_id, gold_col)),
  {SPOTS.format("").replace("FROM j", "FROM k")} SELECT msa_id, {R("CASE WHEN sum(n * (n - 1) // 2) > 0 THEN sum(r)::DOUBLE / sum(n * (n - 1) // 2) END")} AS q, {R("count(*) FILTER (places = 1)::DOUBLE / count(*)")} AS tc FROM c GROUP BY 1"""
)
def qscore_strict(spark, sf):
    return rounded(_scores(spark, sf, "strict", 0.5), "q", "tc")


@query(f"{CLASSIC} SELECT count(*) AS n_sets, {R('avg(q)')} AS q, {R('avg(tc)')} AS tc FROM q")
def qscore_dir_average(spark, sf):
    return rounded(score.directory_average(_scores(spark, sf)), "q", "tc")


BEST = "best AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY msa_id, gold_col) AS total, row_number() OVER (PARTITION BY msa_id, gold_col ORDER BY n DESC, test_col) AS rk FROM spots) WHERE rk = 1 AND n > total // 2)"


@query(f"WITH {s.TEST}, {s.GOLD}, {RESIDUES}, {SPOTS.format('')}, {BEST} SELECT msa_id, gold_col, test_col, n FROM best")
def best_test_columns(spark, sf):
    return score.best_columns(s.cells(spark, sf), s.cells(spark, sf, "gold"))


@query(
    f"""WITH {s.TEST}, {s.GOLD}, {RESIDUES}, spots AS (SELECT msa_id, test_col AS gold_col, gold_col AS test_col, count(*) AS n FROM j GROUP BY 1, 2, 3), {BEST} SELECT msa_id, gold_col AS test_col, test_col AS gold_col, n FROM best"""
)
def compare_columns(spark, sf):
    return score.compare_columns(s.cells(spark, sf), s.cells(spark, sf, "gold"))


@query(
    f"""WITH {s.TEST}, {s.GOLD}, {RESIDUES}, nx AS (SELECT msa_id, seq_id, lead(seq_id) OVER (PARTITION BY msa_id ORDER BY seq_id) AS nxt FROM gold_rows),
  p AS (SELECT a.msa_id, a.seq_id, count(*) FILTER (a.test_col = b.test_col)::DOUBLE / count(*) AS q FROM j a JOIN nx USING (msa_id, seq_id) JOIN j b ON b.msa_id = a.msa_id AND b.seq_id = nx.nxt AND b.gold_col = a.gold_col GROUP BY 1, 2)
  SELECT msa_id, {R("avg(q)")} AS q FROM p GROUP BY 1"""
)
def pair_quality(spark, sf):
    return rounded(score.pair_quality(s.cells(spark, sf), s.cells(spark, sf, "gold")), "q")


MEMBER_POS = f"m_pos AS (SELECT *, sum(CASE WHEN {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY msa_id, msa_idx, seq_id ORDER BY col) AS n FROM members)"


@query(
    f"""WITH {s.ENSEMBLE}, {s.GOLD}, {PLACED.format("gold")}, {MEMBER_POS}, j AS (SELECT g.msa_id, msa_idx, g.seq_id, g.col AS gold_col, t.col AS test_col FROM (SELECT * FROM gold_pos WHERE letter <> '-') g
    JOIN (SELECT * FROM m_pos WHERE letter <> '-') t ON g.msa_id = t.msa_id AND g.seq_id = t.seq_id AND g.n = t.n),
  sp AS (SELECT msa_id, msa_idx, gold_col, test_col, count(*) AS n FROM j GROUP BY ALL), b AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY msa_id, msa_idx, gold_col) AS total,
    row_number() OVER (PARTITION BY msa_id, msa_idx, gold_col ORDER BY n DESC, test_col) AS rk FROM sp) WHERE rk = 1 AND n > total // 2)
  SELECT j.msa_id, j.seq_id, j.gold_col, {R(f"count(*) FILTER (j.test_col = b.test_col)::DOUBLE / {s.MEMBERS}")} AS confidence FROM j LEFT JOIN b ON j.msa_id = b.msa_id AND j.msa_idx = b.msa_idx AND j.gold_col = b.gold_col GROUP BY 1, 2, 3"""
)
def letter_confidence(spark, sf):
    return rounded(score.letter_confidence(s.members(spark, sf), s.cells(spark, sf, "gold")), "confidence")


# Ensembles

ENS = f"""WITH {s.ENSEMBLE}, {MEMBER_POS}, cols AS (SELECT msa_id, msa_idx, col, string_agg(CAST(CAST(CASE WHEN {GAP} THEN -n ELSE n END AS BIGINT) AS VARCHAR), ',' ORDER BY seq_id) AS key,
    avg(CASE WHEN {GAP} THEN 1.0 ELSE 0.0 END) AS gap_share FROM m_pos GROUP BY 1, 2, 3),
  uni AS (SELECT msa_id, key, count(*) AS n, count(*)::DOUBLE / {s.MEMBERS} AS confidence, min(gap_share) AS gap_share FROM cols GROUP BY 1, 2),
  cc AS (SELECT cols.msa_id, msa_idx, col, uni.n, confidence FROM cols JOIN uni USING (msa_id, key)),
  stats AS (SELECT msa_id, msa_idx, count(*) AS cols, count(*) FILTER (n = 1) AS singletons, sum(confidence) AS total, list_sort(list(confidence))[count(*) // 2 + 1] AS median FROM cc GROUP BY 1, 2)"""


def _columns(spark, sf):
    return ensemble.columns(s.members(spark, sf))


@query(f"{ENS} SELECT msa_id, msa_idx, col, n, {R('confidence')} AS confidence FROM cc")
def ensemble_column_confidence(spark, sf):
    return rounded(ensemble.column_confidence(_columns(spark, sf)), "confidence")


@query(f"{ENS} SELECT msa_id, n, count(*) AS columns FROM uni GROUP BY 1, 2")
def ensemble_abundance(spark, sf):
    return ensemble.abundance(_columns(spark, sf))


@query(f"{ENS} SELECT msa_id, msa_idx, cols, singletons, {R('total')} AS total, {R('median')} AS median FROM stats")
def ensemble_singletons(spark, sf):
    return rounded(ensemble.member_stats(_columns(spark, sf)), "total", "median")


@query(
    f"""{ENS}, r AS (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY round(total, 9) DESC, msa_idx DESC) AS a, row_number() OVER (PARTITION BY msa_id ORDER BY round(total, 9) DESC, msa_idx) AS b,
    row_number() OVER (PARTITION BY msa_id ORDER BY median DESC, msa_idx) AS c FROM stats)
  SELECT msa_id, max(CASE WHEN a = 1 THEN msa_idx END) AS last_by_total, max(CASE WHEN b = 1 THEN msa_idx END) AS first_by_total, max(CASE WHEN c = 1 THEN msa_idx END) AS first_by_median FROM r GROUP BY 1"""
)
def ensemble_best_member(spark, sf):
    return ensemble.best_member(_columns(spark, sf))


@query(
    f"""{ENS} SELECT msa_id, key, {R("confidence")} AS confidence, row_number() OVER (PARTITION BY msa_id ORDER BY confidence DESC, key) AS place FROM uni WHERE confidence >= 0.5 AND gap_share <= 0.5"""
)
def ensemble_best_columns(spark, sf):
    return rounded(ensemble.best_columns(_columns(spark, sf), 0.5), "confidence")


@query(
    f"""{ENS}, a AS (SELECT msa_id, msa_idx, seq_id, n, col FROM m_pos WHERE NOT {GAP}), sp AS (SELECT x.msa_id, x.msa_idx AS i, y.msa_idx AS j, y.col AS gc, x.col AS tc, count(*) AS n FROM a x JOIN a y
    ON x.msa_id = y.msa_id AND x.seq_id = y.seq_id AND x.n = y.n AND x.msa_idx <> y.msa_idx GROUP BY ALL),
  c AS (SELECT msa_id, i, j, gc, sum(n) AS n, sum(n * (n - 1) // 2) AS r FROM sp GROUP BY ALL), q AS (SELECT msa_id, least(i, j) AS a, greatest(i, j) AS b, sum(r)::DOUBLE / sum(n * (n - 1) // 2) AS q FROM c GROUP BY msa_id, i, j, 2, 3),
  m AS (SELECT msa_id, a, b, avg(q) AS q FROM q GROUP BY 1, 2, 3) SELECT msa_id, {R("1 - list_sort(list(q))[count(*) // 2 + 1]")} AS dispersion FROM m GROUP BY 1"""
)
def ensemble_dispersion(spark, sf):
    return rounded(ensemble.dispersion(s.members(spark, sf)), "dispersion")


@query(f"{ENS} SELECT CAST(floor(confidence * 10) AS BIGINT) AS bin, count(*) AS columns, {N('sum(CASE WHEN col % 2 = 0 THEN 1 ELSE 0 END)')} AS \"right\" FROM cc GROUP BY 1")
def confidence_bins(spark, sf):
    cols = _columns(spark, sf)
    right = cols.select("msa_id", "msa_idx", "col", (F.col("col") % 2 == 0).cast("bigint").alias("right"))
    return longs(ensemble.confidence_bins(cols, right), "columns", "right")


@query(
    f"""{ENS} SELECT msa_id, msa_idx, string_agg(CASE WHEN confidence >= 1 THEN '+' ELSE CAST(CAST(floor(confidence * 10) AS BIGINT) AS VARCHAR) END, '' ORDER BY col) AS tenths,
  string_agg(CASE WHEN confidence >= 1 THEN '+' ELSE CAST(CAST(floor(confidence * 100) AS BIGINT) % 10 AS VARCHAR) END, '' ORDER BY col) AS hundredths FROM cc GROUP BY 1, 2"""
)
def confidence_digits(spark, sf):
    return ensemble.confidence_digits(_columns(spark, sf))


# Profiles

STEPS = f"""steps AS (SELECT *, {GAP} AS gap, coalesce(lag({GAP}) OVER w, false) AS before, coalesce(lead({GAP}) OVER w, false) AS after, 1.0::DOUBLE / count(*) OVER (PARTITION BY msa_id, col) AS wt FROM test WINDOW w AS (PARTITION BY msa_id, seq_id ORDER BY col))"""
PROFILE = f"""{STEPS}, prof AS (SELECT msa_id, col, sum(CASE WHEN NOT before AND NOT gap THEN wt ELSE 0 END) AS ll, sum(CASE WHEN NOT before AND gap THEN wt ELSE 0 END) AS lg,
  sum(CASE WHEN before AND NOT gap THEN wt ELSE 0 END) AS gl, sum(CASE WHEN before AND gap THEN wt ELSE 0 END) AS gg, sum(CASE WHEN NOT gap THEN wt ELSE 0 END) AS occ FROM steps GROUP BY 1, 2)"""


@query(f"WITH {s.TEST}, {PROFILE} SELECT msa_id, col, {', '.join(f'{R(c)} AS {c}' for c in ('ll', 'lg', 'gl', 'gg', 'occ'))} FROM prof")
def profile_column_freqs(spark, sf):
    return rounded(profile.column_profile(s.cells(spark, sf)), "ll", "lg", "gl", "gg", "occ")


@query(
    f"""WITH {s.TEST}, {PROFILE}, x AS (SELECT *, row_number() OVER w AS r, lead(gl) OVER w AS nx FROM prof WINDOW w AS (PARTITION BY msa_id ORDER BY col))
  SELECT msa_id, col, {R("CASE WHEN r = 1 THEN occ * -3 / 2 ELSE -3 * (1 - lg) / 2 END")} AS open, {R("CASE WHEN nx IS NULL THEN occ * -3 / 2 ELSE -3 * (1 - nx) / 2 END")} AS close FROM x"""
)
def profile_gap_scores(spark, sf):
    return rounded(profile.gap_scores(profile.column_profile(s.cells(spark, sf)), -3.0), "open", "close")


@query(
    f"""WITH {s.TEST}, {STEPS} SELECT msa_id, col, {R("avg(CASE WHEN NOT gap THEN 1.0 ELSE 0 END)")} AS letters, {R("avg(CASE WHEN gap AND NOT before AND after THEN 1.0 ELSE 0 END)")} AS opens,
  {R("avg(CASE WHEN gap AND before THEN 1.0 ELSE 0 END)")} AS extends, {R("avg(CASE WHEN gap AND NOT before AND NOT after THEN 1.0 ELSE 0 END)")} AS closes FROM steps GROUP BY 1, 2"""
)
def masm_gap_freqs(spark, sf):
    return rounded(profile.gap_stages(s.cells(spark, sf)), "letters", "opens", "extends", "closes")


SHARES = "shares AS (SELECT msa_id, col, letter, count(*)::DOUBLE / any_value(nr) AS share FROM test JOIN (SELECT msa_id, count(*) AS nr FROM test_rows GROUP BY 1) USING (msa_id) WHERE letter <> '-' GROUP BY 1, 2, 3)"


@query(f"WITH {s.TEST}, {SHARES} SELECT msa_id, col, letter, {R('share')} AS share FROM shares")
def profile_letter_shares(spark, sf):
    return rounded(profile.letter_shares(s.cells(spark, sf)), "share")


def _matrix(spark):
    """A small matrix: 4 for the same letter, else minus the distance of the letters modulo 3."""
    return spark.createDataFrame([(x, y, 4.0 if x == y else -float(abs(i - j) % 3)) for i, x in enumerate(ALPHABET) for j, y in enumerate(ALPHABET)], "letter string, other string, value double")


MATRIX = "mx AS (SELECT chr(CAST(65 + i AS INTEGER)) AS letter, chr(CAST(65 + j AS INTEGER)) AS other, CASE WHEN i = j THEN 4.0 ELSE -CAST(abs(i - j) % 3 AS DOUBLE) END AS value FROM range(26) a(i), range(26) b(j))"


@query(
    f"""WITH {s.TEST}, {SHARES}, {MATRIX}, sc AS (SELECT msa_id, col, mx.letter, sum(share * value) AS score FROM shares JOIN mx ON mx.other = shares.letter GROUP BY 1, 2, 3)
  SELECT msa_id, {R("sum(share * score)")} AS self_score FROM shares JOIN sc USING (msa_id, col, letter) GROUP BY 1"""
)
def profile_self_score(spark, sf):
    return rounded(profile.self_score(profile.letter_shares(s.cells(spark, sf)), _matrix(spark)), "self_score")


@query(
    f"""WITH {s.TEST}, p AS (SELECT least(a.letter, b.letter) AS x, greatest(a.letter, b.letter) AS y, count(*) AS pairs FROM test a JOIN test b ON a.msa_id = b.msa_id AND a.col = b.col AND a.seq_id < b.seq_id
    WHERE a.letter <> '-' AND b.letter <> '-' GROUP BY 1, 2), f AS (SELECT letter AS x, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM test WHERE letter <> '-' GROUP BY 1)
  SELECT p.x, p.y, pairs, {R("log2(pairs::DOUBLE / (SELECT sum(pairs) FROM p) / (CASE WHEN p.x = p.y THEN 1.0 ELSE 2.0 END * a.f * b.f))")} AS log_odds FROM p JOIN f a ON a.x = p.x JOIN f b ON b.x = p.y"""
)
def substitution_log_odds(spark, sf):
    return rounded(profile.substitutions(s.cells(spark, sf)), "log_odds")


# Trees and distances



@query(f"WITH RECURSIVE {s.TREE} SELECT node, n_leaves FROM size")
def subtree_sizes(spark, sf):
    return trees.subtree_sizes(s.tree(spark, sf))


@query(f"WITH RECURSIVE {s.TREE} SELECT tree.node, a.n_leaves FROM tree JOIN size a ON a.node = tree.node LEFT JOIN size b ON b.node = tree.parent WHERE a.n_leaves <= 60 AND (tree.parent IS NULL OR b.n_leaves > 60)")
def shrub_cut(spark, sf):
    return trees.shrubs(s.tree(spark, sf), 60)


HEIGHTS = "h AS (SELECT ancestor AS node, max(distance) AS height FROM up JOIN leaf USING (node) GROUP BY 1)"


@query(f"WITH RECURSIVE {s.TREE}, {HEIGHTS} SELECT tree.node, a.height FROM tree JOIN h a ON a.node = tree.node LEFT JOIN h b ON b.node = tree.parent WHERE a.height <= 6.5 AND (tree.parent IS NULL OR b.height > 6.5)")
def tree_cut_by_height(spark, sf):
    return trees.cut_at_height(s.tree(spark, sf), 6.5)


@query(
    f"""WITH RECURSIVE {s.TREE}, st AS (SELECT node AS ancestor, greatest(length, 0.05) / n_leaves AS st FROM tree JOIN size USING (node) WHERE parent IS NOT NULL),
  w AS (SELECT up.node, sum(st) AS w FROM up JOIN leaf USING (node) JOIN st USING (ancestor) GROUP BY 1) SELECT node, {R("w / (SELECT sum(w) FROM w)")} AS weight FROM w"""
)
def sequence_weights(spark, sf):
    return rounded(trees.sequence_weights(s.tree(spark, sf)), "weight")


@query(
    f"""WITH RECURSIVE {s.TREE}, pr AS (SELECT CAST(c_custkey + 1000 AS BIGINT) AS a, CAST(100 + c_custkey % 25 AS BIGINT) AS b FROM customer),
  m AS (SELECT pr.a, pr.b, x.ancestor, x.distance + y.distance AS distance, row_number() OVER (PARTITION BY pr.a, pr.b ORDER BY x.depth) AS rk FROM pr JOIN up x ON x.node = pr.a JOIN up y ON y.node = pr.b AND y.ancestor = x.ancestor)
  SELECT a, b, ancestor, {R("distance")} AS distance FROM m WHERE rk = 1"""
)
def tree_lca(spark, sf):
    pairs = s.table(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("bigint").alias("a"), (100 + F.col("c_custkey") % 25).cast("bigint").alias("b"))
    return rounded(trees.lowest_common_ancestor(s.tree(spark, sf), pairs), "distance")


@query(
    f"""WITH {KMERS}, own AS (SELECT seq_id, sum(n) AS o FROM k GROUP BY 1),
  c AS (SELECT a.seq_id AS a, b.seq_id AS b, sum(least(a.n, b.n)) AS c FROM k a JOIN k b ON a.kmer = b.kmer AND a.seq_id < b.seq_id GROUP BY 1, 2),
  d AS (SELECT c.a, c.b, least(3.0::DOUBLE * (x.o - c) / x.o, 3.0::DOUBLE * (y.o - c) / y.o) AS d FROM c JOIN own x ON x.seq_id = c.a JOIN own y ON y.seq_id = c.b)
  SELECT a, b, {R("10 * (d - (SELECT min(d) FROM d)) / ((SELECT max(d) FROM d) - (SELECT min(d) FROM d))")} AS d FROM d"""
)
def rescale_distances(spark, sf):
    return rounded(trees.rescale(kmers.distances(_kmers(spark, sf))), "d")


@query(
    f"""WITH RECURSIVE {s.TREE}, m AS (SELECT max(node) + 1 AS shift FROM tree) SELECT node, coalesce(parent, 2 * shift) AS parent, CASE WHEN parent IS NULL THEN 0.5 ELSE length END AS length FROM tree, m
  UNION ALL SELECT node + shift, coalesce(parent + shift, 2 * shift), CASE WHEN parent IS NULL THEN 0.5 ELSE length END FROM tree, m UNION ALL SELECT 2 * shift, NULL, NULL FROM m"""
)
def join_trees(spark, sf):
    t = s.tree(spark, sf)
    return trees.join_trees(t, t, 0.5)


# Posteriors

RELAX = f"""through AS (SELECT a.set_id, a.x, b.y, a.pos_x, b.pos_y, sum(a.p * b.p) AS more FROM both_ways a JOIN both_ways b ON a.set_id = b.set_id AND a.y = b.x AND a.pos_y = b.pos_x WHERE a.x < b.y GROUP BY ALL)
  SELECT post.set_id, post.x, post.y, post.pos_x, post.pos_y, {R("(2 * p + coalesce(more, 0)) / n")} AS p FROM post JOIN sizes USING (set_id) LEFT JOIN through t ON post.set_id = t.set_id AND post.x = t.x AND post.y = t.y AND post.pos_x = t.pos_x AND post.pos_y = t.pos_y"""


@query(f"WITH {s.POST}, {RELAX}")
def consistency_step(spark, sf):
    return rounded(posterior.relax(s.posteriors(spark, sf), s.set_sizes(spark, sf)), "p")


@query(f"WITH {s.POST} SELECT set_id, x, y, pos_x, pos_y, {R('p')} AS p FROM post WHERE p >= 0.2")
def sparse_posteriors(spark, sf):
    return rounded(posterior.sparsify(s.posteriors(spark, sf), 0.2), "p")


@query(
    f"""WITH {s.POST} SELECT b.set_id, b.pos_x AS col_left, b.pos_y AS col_right, {R("sum(b.p)")} AS p FROM both_ways b WHERE b.x % 2 = 0 AND b.y % 2 = 1 GROUP BY 1, 2, 3"""
)
def msa_pair_posterior(spark, sf):
    return rounded(s.column_posteriors(spark, sf), "p")


# Kernels: each brand-and-type set of part names is a family; rows only


def _families(spark, sf):
    return s.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("set_id"), F.col("p_partkey").cast("bigint").alias("seq_id"), F.translate("p_name", " ", "").alias("letters"))


@query()
def pair_posteriors(spark, sf):
    return align.pair_posteriors(align.pairs_within(_families(spark, sf)))


@query()
def expected_accuracy(spark, sf):
    return align.expected_accuracies(align.pairs_within(_families(spark, sf)))


@query()
def sw_scores(spark, sf):
    return align.local_scores(align.pairs_within(_families(spark, sf)))


@query()
def viterbi_identity(spark, sf):
    return align.global_identities(align.pairs_within(_families(spark, sf)))


@query()
def likelihood_distance(spark, sf):
    return align.likelihood_distances(align.pairs_within(_families(spark, sf)))


@query()
def upgma_tree(spark, sf):
    ea = align.expected_accuracies(align.pairs_within(_families(spark, sf)))
    return align.upgma(ea.select("set_id", "x", "y", (1 - F.col("ea")).alias("d")))


@query()
def progressive_alignment(spark, sf):
    return align.align_families(_families(spark, sf), refine=0)


@query()
def refined_alignment(spark, sf):
    return align.align_families(_families(spark, sf), refine=10)


@query()
def replicate_ensemble(spark, sf):
    return align.replicates(_families(spark, sf), seeds=2, perms=("none", "abc"), consistency=1, refine=0)


@query()
def greedy_clusters(spark, sf):
    return align.cluster(_families(spark, sf), 0.7)


@query()
def super5_alignment(spark, sf):
    return align.divide_and_conquer(_families(spark, sf), 0.7)


from sparkloom.plans import more_queries, wide_queries  # noqa: E402, F401  register the rest
