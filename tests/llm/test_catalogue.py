import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import rows  # noqa: E402

from dowser.llm import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    got = df.collect()
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for p in Path(DATA).iterdir():
            con.execute(f"create view {p.stem} as from read_parquet('{p}')")
        rel = con.sql(catalogue.oracle_sql()[name])
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    if name.endswith("_found"):
        assert len(got) == len({tuple(r) for r in got})
