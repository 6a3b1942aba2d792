"""Every registered query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from cairn.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.test_queries import TABLES, norm


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    res = con.execute(ORACLES[name])
    cols = sorted(c[0] for c in res.description)
    assert sorted(df.columns) == cols
    at = [[c[0] for c in res.description].index(c) for c in cols]
    assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in res.fetchall())
