"""Every query of the reconciliation operators against its SQL."""

import math
import os

import duckdb
import pytest

from tallyweave import catalog

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == expected


def test_without_statement():
    """Those held by tests of their own: test_decode, test_jobs, test_sheets, test_whole_link."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"link_rows", "link_sheets", "link_sheets_modes", "link_sheets_metrics", "j8_candidate_union", "w11_decode_sequence", "w12_max_marginals", "d8_fixed_point"}
