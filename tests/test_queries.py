"""Every registered query agrees with its DuckDB oracle (sf0.001), and the
rendered corpus is byte-identical in both engines."""
import pytest

import __spark_entry__ as E
from fieldloom.plans import catalog
from tests.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "reconciled" in df.columns


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLE) == set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    d = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert s == d


def test_render_matches_duckdb(spark, con):
    from fieldloom.plans.oracle_corpus import with_invoices
    from fieldloom.sources.corpus import render_invoices
    from fieldloom.sources.tables import Tables
    sp = {r.doc_key: r.text for r in render_invoices(Tables(spark, SF)).collect()}
    dk = dict(con.execute(with_invoices("SELECT doc_key, text FROM invoices")).fetchall())
    assert sp == dk
