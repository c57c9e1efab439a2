"""Joins in time that never compare every row with every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(bars: DataFrame, events: DataFrame, values: list[str], by: str = "series_id", at: str = "ct", event_at: str = "ts_ms", tolerance_ms: int | None = None, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Bars with the latest event at or before `at`, no older than the tolerance, and its age in minutes.

    Both sides are put in one row order by key and time, events first among equals, and the last event is carried forward: one
    shuffle by key and one sort, instead of an inequality join. parts: tasks that the keys are dealt to, where the session's number and
    size of partitions would make them large."""
    order = order or []
    taken = F.struct(F.col(event_at).alias("_t"), *values)
    left = bars.select(F.col(by).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_bar"), *(F.lit(None).cast(dict(events.dtypes)[c]).alias(f"_o{i}") for i, c in enumerate(order)), F.lit(None).cast(events.select(taken.alias("x")).schema["x"].dataType).alias("_e"), F.struct(*bars.columns).alias("_row"))
    right = events.select(F.col(by).alias("_k"), F.col(event_at).alias("_at"), F.lit(0).alias("_bar"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), taken.alias("_e"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy("_k").orderBy("_at", "_bar", *(f"_o{i}" for i in range(len(order)))).rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right)
    both = both if parts is None else both.repartition(parts, "_k")
    found = both.withColumn("_last", F.last("_e", True).over(w)).where("_bar = 1")
    age = F.col("_at") - F.col("_last._t")
    fresh = F.lit(True) if tolerance_ms is None else age <= tolerance_ms
    keep = [c for c in bars.columns if c not in values]
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in keep), *(F.when(fresh, F.col(f"_last.{c}")).alias(c) for c in values), F.when(fresh, age / 60000).alias("age_minutes"))


def next_true(rows: DataFrame, mask: str, out: str, by: list[str], order: str) -> DataFrame:
    """The first row at or after each row where mask holds: carried backward by a running last in descending order."""
    w = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.expr(f"case when {mask} then {order} end"), True).over(w))


def exactly_before(bars: DataFrame, ms: int, values: list[str], by: str = "series_id") -> DataFrame:
    """The values exactly `ms` before each bar's close: a range frame of width zero, so no self join."""
    w = W.partitionBy(by).orderBy("ct").rangeBetween(-ms, -ms)
    return bars.withColumns({f"{c}_before": F.max(c).over(w) for c in values})


def at_the_close(minutes: DataFrame, tf: DataFrame) -> DataFrame:
    """Rows of a timeframe on the very minute at which they close."""
    return minutes.join(tf, ["series_id", "ct"])
