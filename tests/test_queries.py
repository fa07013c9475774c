"""Every query of the catalogue against its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

from presslake.plans import catalog, item_queries, policy_queries, queries, repair_queries, signature_queries, story_queries, term_queries, text_queries  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if isinstance(v, Decimal) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS FROM '{DATA}/{file}'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    expected = rows_of(columns, want.fetchall())
    got = catalog.QUERIES[name](spark, DATA)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == expected
