import duckdb
import pytest

import __spark_entry__ as entry
from tarnwell.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_matches_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_stems_of_documents_in_every_language(spark, db):
    got = sorted(r["doc_id"] for r in catalogue.QUERIES["stemmed_terms"](spark, DATA).collect())
    assert got == [i for (i,) in db.sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
