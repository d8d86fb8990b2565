"""Every query of the subpackage that has SQL against it in DuckDB, on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import queries
from tests.test_oracles import DATA, TABLES, rows


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, want = queries.queries()[name](spark, str(DATA)), c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
