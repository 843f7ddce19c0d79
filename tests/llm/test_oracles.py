"""Queries of this subpackage against their SQL."""

import duckdb
import pytest

from lading.llm.oracles import SQL
from lading.llm.queries import queries


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries()[name](spark, sf_dir), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
