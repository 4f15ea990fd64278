"""Every query with SQL, against DuckDB on the smallest data; the others must give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tracelode.plans import queries
from tracelode.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Tables too small to hold any.
MAY_BE_EMPTY = {"extract_bitcoin_addresses", "table_page"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module", autouse=True)
def findings_once(spark):
    """Most queries start from the same findings; they are extracted once here."""
    kept, made = queries.found, {}

    def found(session, path):
        if path not in made:
            made[path] = kept(session, path).cache()
        return made[path]

    queries.found = found
    yield
    queries.found = kept


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    assert rows or name in MAY_BE_EMPTY
    if name in SQL:
        want = duck.sql(SQL[name])
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


#: Queries that tell where a value stands.
PLACED = ["context_round_trip", "csv_rows", "export_indicators", "findings", "live_indicators", "master_insert", "master_runs", "merge_in_batches", "nested_json", "report_rows", "stored_findings", "streamed_findings"]


@pytest.fixture(scope="module")
def refused_first(tmp_path_factory):
    """Documents in which a value stands, before it is matched, where its pattern refuses it: addresses before another on their line, in a longer number."""
    texts = ["to abc@def.com or ghi@jkl.org\nto abc@def.com", "v1.210.9.8.7 is 10.9.8.7 or 10.9.8.7", "é 99.10.9.8.6 and 10.9.8.6", None, ""]
    path = tmp_path_factory.mktemp("refused")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', ?, 0)", [(i, t, f"s{i % 2}") for i, t in enumerate(texts)])
    con.sql(f"copy documents to '{path}/documents.parquet'")
    return con, str(path)


@pytest.mark.parametrize("name", PLACED)
def test_places_as_in_sql(spark, refused_first, name):
    con, path = refused_first
    got = QUERIES[name](spark, path)
    cols = sorted(got.columns)
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
