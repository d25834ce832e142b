"""Every query with SQL gives the rows that DuckDB gives, over the smallest test data."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import rows  # noqa: E402

from dowser.plans import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"create view {p.stem} as from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_queries_without_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"fs_rename_pairing", "chunk_documents", "embed_metadata"}
