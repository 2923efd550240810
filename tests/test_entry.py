"""Every registered query of the workflow against its SQL, on the smallest tables."""

import duckdb
import pytest

from braidmill.plans.oracles import ORACLES
from braidmill.plans.registry import QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())
        assert got == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tables_between_steps_are_removed(spark):
    from pathlib import Path

    from braidmill import session

    there = lambda: {p.name for p in Path(session.shared_dir(spark).removeprefix("file://")).iterdir()}
    before, since = there(), session.bookmark()
    df = session.materialize(spark.range(5))
    out = session.settled(df.selectExpr("id + 1 as id"), since)
    assert len(there() - before) == 1 and sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]
    assert session.bookmark() == since + 1


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from braidmill import session

    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")
