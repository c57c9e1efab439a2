"""Steps whose tasks must not grow with the tables."""

from pyspark.sql import functions as F

from tidebar.catalog import queries as q
from tidebar.operators import asof as A
from tidebar.operators import selection as S

SF = "/root/testdata/sf0.001"


def test_rankings_read_the_rows_once(spark):
    """One scan and the first rows of every task, not all rows of twenty branches in one task of a union."""
    plan = q.QUERIES["ranking_metrics"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "WindowGroupLimit" in plan


def test_first_of_rankings(spark):
    rows = [(i, *(None if (i + j) % 7 == 0 else (i * 37 + j * 11) % 13 / 4 for j in range(len(S.RANKINGS)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{m} double" for m in S.RANKINGS)).repartition(5)
    got = {(r.metric, r.place): (r.id, r.value) for r in S.first_of_rankings(df, 5, "id").collect()}
    dd = list(S.RANKINGS).index("max_drawdown") + 1
    for j, (m, larger) in enumerate(S.RANKINGS.items(), 1):
        key = lambda r: (r[j] is None, 0 if r[j] is None else -r[j] if larger else r[j], r[dd] is not None, r[dd] or 0, r[0])  # noqa: E731, B023
        for n, r in enumerate(sorted(rows, key=key)[:5], 1):
            assert got[m, n] == (r[0], r[j]), (m, n)


def test_asof_in_many_tasks(spark):
    bars = spark.range(400).select((F.col("id") % 9).cast("string").alias("series_id"), (F.col("id") * 7 % 101).alias("ct"), F.col("id").alias("b"))
    events = spark.range(90).select((F.col("id") % 9).cast("string").alias("series_id"), (F.col("id") * 13 % 97).alias("ts_ms"), F.col("id").alias("e"))
    one, many = A.asof(bars, events, ["e"], order=["e"]), A.asof(bars, events, ["e"], order=["e"], parts=7)
    assert many.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)


def test_lines_are_dealt_by_their_number(spark):
    plan = q.QUERIES["asof_lineitem_order"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
