import os
from pathlib import Path

import duckdb
import pytest

from leafmill import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    done = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    want = sorted((tuple(r) for r in done.fetchall()), key=repr)
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want
