"""Each query with SQL against DuckDB on the same tables; the others for rows."""

import math

import duckdb
import pytest

from sparkloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted(tuple(value(r[n]) for n in names) for r in rows) if all(None not in r.values() for r in rows) else sorted((tuple(value(r[n]) for n in names) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf, duck, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert len(got) == len(want)
    if got:
        assert sorted(got[0]) == sorted(names)
        assert plain(got, sorted(names)) == plain(want, sorted(names))


@pytest.mark.parametrize("name", ["pair_posteriors", "sw_scores", "viterbi_identity", "upgma_tree"])
def test_rows_only(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["progressive_alignment", "super5_alignment"])
def test_alignments_keep_letters(spark, sf, name):
    families = {r["seq_id"]: r["letters"].upper() for r in catalog._families(spark, sf).collect()}
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert {r["seq_id"]: r["row"].replace("-", "") for r in rows} == families
    widths = {}
    for r in rows:
        assert widths.setdefault(r["set_id"], len(r["row"])) == len(r["row"])


def test_clusters_cover_each_sequence_once(spark, sf):
    rows = catalog.QUERIES["greedy_clusters"](spark, sf).collect()
    assert len({r["seq_id"] for r in rows}) == len(rows) == catalog._families(spark, sf).count()
    centres = {r["seq_id"] for r in rows if r["seq_id"] == r["centroid_id"]}
    assert all(r["centroid_id"] in centres and r["ea"] >= 0.7 for r in rows)
