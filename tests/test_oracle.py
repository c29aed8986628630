"""Every query with an SQL twin gives the same rows as the twin, on whole tables."""

import glob
import os

import duckdb
import pytest

from foliospark import catalog

SF = os.environ.get("FOLIO_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    twin = sorted((tuple(_norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(_norm(x[c]) for c in cols) for x in df.collect()), key=repr) == twin


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
