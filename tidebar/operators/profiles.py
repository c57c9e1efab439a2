"""Aggregates over days, volume and states: price profiles, volume buckets, transitions, seasonal slots."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import DAY


def day_profile(bars: DataFrame, width: Column, share: float = 0.7, bars_a_day: int | None = None) -> DataFrame:
    """Per series and UTC day: the price box with the most volume (the lowest of equal ones) and the value area around it, which grows
    by the neighbouring box with more volume (the lower on a tie) until it holds `share` of the day's volume.

    Boxes are summed before anything meets; a day's boxes are then one short array, folded in place. bars_a_day: days with another
    number of bars are left out. Columns: series_id, ct, c, v."""
    day = F.floor((F.col("ct") - 1) / DAY)
    rows = bars.select("series_id", day.alias("day"), width.alias("w"), "c", "v")
    boxes = rows.groupBy("series_id", "day", "w", F.floor(F.col("c") / F.col("w")).alias("box")).agg(F.sum("v").alias("volume"), F.count("*").alias("n"))
    days = boxes.groupBy("series_id", "day", "w").agg(F.map_from_entries(F.collect_list(F.struct("box", "volume"))).alias("m"), F.min("box").alias("lo"), F.max("box").alias("hi"), F.sum("volume").alias("total"), F.sum("n").alias("n"))
    if bars_a_day is not None:
        days = days.where(F.col("n") == bars_a_day)
    # empty boxes between the first and the last have no volume
    days = days.withColumn("vs", F.expr("transform(sequence(lo, hi), b -> coalesce(element_at(m, b), 0d))"))
    days = days.withColumn("at", F.expr("cast(array_position(vs, array_max(vs)) as int)"))
    start = "named_struct('a', at, 'b', at, 'kept', element_at(vs, at))"
    left, right = "case when s.a > 1 then element_at(vs, s.a - 1) else -1d end", "case when s.b < size(vs) then element_at(vs, s.b + 1) else -1d end"
    done = f"s.kept >= {share!r}d * total or (s.a = 1 and s.b = size(vs))"
    step = f"case when {done} then s when {left} >= {right} then named_struct('a', s.a - 1, 'b', s.b, 'kept', s.kept + {left}) else named_struct('a', s.a, 'b', s.b + 1, 'kept', s.kept + {right}) end"
    days = days.withColumn("s", F.expr(f"aggregate(sequence(1, size(vs)), {start}, (s, i) -> {step})"))
    first = F.col("lo") - 1
    return days.select("series_id", "day", ((first + F.col("at") + 0.5) * F.col("w")).alias("poc"), ((first + F.col("s.a")) * F.col("w")).alias("value_low"), ((first + F.col("s.b") + 1) * F.col("w")).alias("value_high"), "total")


def volume_buckets(bars: DataFrame, target: float) -> DataFrame:
    """Whole bars gathered until their volume reaches the target; what is above it does not go on to the next bucket, so buckets follow
    each other and need one pass in order per series. Bars after the last full bucket are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ct")
        ends, volume = [], 0.0
        for t, v in enumerate(pdf["v"].to_numpy(float)):
            volume += v
            if volume >= target:
                ends.append(t)
                volume = 0.0
        begin = np.concatenate([[0], np.array(ends[:-1], int) + 1]) if ends else np.empty(0, int)
        cols = {k: pdf[k].to_numpy() for k in ("ct", "o", "h", "l", "c", "v")}
        out = [(pdf["series_id"].iloc[0], k, int(cols["ct"][b]), cols["o"][a], cols["h"][a : b + 1].max(), cols["l"][a : b + 1].min(), cols["c"][b], cols["v"][a : b + 1].sum(), int(b - a + 1)) for k, (a, b) in enumerate(zip(begin, ends))]
        return pd.DataFrame(out, columns=["series_id", "bucket", "ct", "o", "h", "l", "c", "v", "n_bars"])

    return bars.select("series_id", "ct", "o", "h", "l", "c", "v").groupBy("series_id").applyInPandas(run, "series_id string, bucket int, ct long, o double, h double, l double, c double, v double, n_bars int")


def transition_counts(df: DataFrame, state: str, states: Sequence[int], rows: int, by: Sequence[str] = ("series_id",), order: str = "ct") -> DataFrame:
    """For each bar the share of each follower of its state's predecessor, over the transitions within the `rows` bars before, one added
    to every count; null where a state is missing. One window pass for all pairs."""
    w = W.partitionBy(*by).orderBy(order)
    f = w.rowsBetween(-rows, -1)
    df = df.withColumn("_p", F.lag(state).over(w))
    pair = {(a, b): F.count_if((F.col("_p") == a) & (F.col(state) == b)).over(f) + 1 for a in states for b in states}
    total = {a: sum((pair[a, b] for b in states), F.lit(0)) for a in states}
    share = F.lit(None).cast("double")
    for a in states:
        for b in states:
            share = F.when((F.col("_p") == a) & (F.col(state) == b), pair[a, b] / total[a]).otherwise(share)
    return df.withColumn("share", share).drop("_p")


def seasonal_slots(df: DataFrame, value: str, slot: str, day: str, days: int = 60, least: int = 30, shrink: float = 30.0, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """For each day and slot the mean of a slot over the days before, drawn to the mean of all slots, and its standard error; only days
    with every slot count, and at least `least` of them must be there.

    Sums per slot and day run in a range frame over the day number: no join of days with days."""
    n_slots = df.select(slot).distinct().count()
    full = df.groupBy(*by, day).agg(F.count(value).alias("_n"), F.sum(value).alias("_all"))
    rows = df.join(full, [*by, day]).withColumn("_full", F.col("_n") == n_slots)
    w = W.partitionBy(*by, slot).orderBy(day).rangeBetween(-days, -1)
    ok = lambda x: F.when(F.col("_full"), x)
    count, sums, squares, whole = F.count(ok(F.col(value))).over(w), F.sum(ok(F.col(value))).over(w), F.sum(ok(F.col(value) * F.col(value))).over(w), F.sum(ok(F.col("_all"))).over(w)
    rows = rows.withColumns({"n_days": count, "_s": sums, "_q": squares, "_w": whole}).where(F.col("n_days") >= least)
    mean = F.col("_s") / F.col("n_days")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("n_days") - mean * mean, F.lit(0.0)))
    return rows.select(*by, day, slot, "n_days", ((F.col("_s") + shrink * F.col("_w") / (F.col("n_days") * n_slots)) / (F.col("n_days") + shrink)).alias("mean"), (spread / F.sqrt("n_days")).alias("error"))
