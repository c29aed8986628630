"""The registered corpus queries on whole small tables."""

import glob
import os

import duckdb
import pytest

from foliospark.llm import queries

SF = os.environ.get("FOLIO_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = {
    "p1_found": ["chunk_id_a", "chunk_id_b"], "p2_found": ["chunk_id", "sent_start", "sent_end"], "p3_found": ["chunk_id", "seg_start", "language"],
    "p4_found": ["chunk_id", "piece_start", "piece_end"], "p5_found": ["chunk_id_a", "chunk_id_b"], "p6_found": ["chunk_id", "pos", "repaired"],
    "p7_found": ["chunk_id_a", "chunk_id_b"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject_area"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    r = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in r.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(set(map(tuple, rows))) == len(rows) > 0
