from pathlib import Path

from pyspark.sql import functions as F

from braidmill import session


def _there(spark):
    return {p.name for p in Path(session.shared_dir(spark).removeprefix("file://")).iterdir()}


def test_stepwise_tables(spark):
    table = session.Stepwise(spark, "a long, b string")
    assert table.all().collect() == [] and table.step(3).collect() == []
    rows = spark.createDataFrame([(1, "x", 0), (2, "y", 3), (3, None, 3)], "a long, b string, layer int")
    table.add(rows)
    table.add(rows.where("a = 1").withColumn("layer", F.lit(3)))
    assert sorted((r.a, r.layer) for r in table.all().collect()) == [(1, 0), (1, 3), (2, 3), (3, 3)]
    step = table.step(3)
    assert step.columns == ["a", "b"] and sorted((r.a, r.b or "") for r in step.collect()) == [(1, "x"), (2, "y"), (3, "")]
    assert "layer=0" not in step._jdf.queryExecution().executedPlan().toString()
    table.drop(3)
    table.drop(8)
    assert table.step(3).collect() == [] and [r.a for r in table.all().collect()] == [1]
    other = session.Stepwise(spark, "n int", "round")
    other.add(spark.createDataFrame([(5, 7)], "n int, round int"))
    assert other.step(7).first().n == 5


def test_old_tables_are_forgotten(spark):
    since, before = session.bookmark(), _there(spark)
    kept = [session.materialize(spark.range(n)) for n in range(1, 5)]
    session.forget(since, keep=2)
    assert len(_there(spark) - before) == 2 and session.bookmark() == since + 2
    assert [df.count() for df in kept[2:]] == [3, 4]
    session.forget(since, keep=0)
    assert _there(spark) == before
