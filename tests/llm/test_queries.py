"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from braidmill.llm.queries import QUERIES
from braidmill.llm.sql import ORACLES
from tests.conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        result = db.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    else:
        assert got
