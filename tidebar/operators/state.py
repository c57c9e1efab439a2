"""States of a bar series: directions, reversals, runs, pivots, latches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(by: list[str], order: str = "ct"):
    return W.partitionBy(*by).orderBy(order)


def direction(x: str, by: list[str]) -> Column:
    """Sign of the last change that was not zero; 0 before there was one."""
    step = F.signum(F.col(x) - F.lag(x).over(_w(by)))
    return F.when(step != 0, step)


def with_direction(df: DataFrame, x: str, by: list[str], out: str = "dir") -> DataFrame:
    df = df.withColumn("_step", direction(x, by))
    return df.withColumn(out, F.coalesce(F.last("_step", True).over(_w(by).rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)).cast("int")).drop("_step")


def reversals(df: DataFrame, x: str, volume: str, by: list[str]) -> DataFrame:
    """turn: +1 where x turned up after falling, -1 where down after rising; sufficient: on more volume than the bar before."""
    w = _w(by)
    d1, d2 = F.col(x) - F.lag(x).over(w), F.lag(x).over(w) - F.lag(x, 2).over(w)
    turn = F.when((d1 > 0) & (d2 < 0), 1).when((d1 < 0) & (d2 > 0), -1).otherwise(0)
    return df.withColumns({"turn": turn, "sufficient": F.coalesce(F.col(volume) > F.lag(volume).over(w), F.lit(False))})


def latched_case(df: DataFrame, by: list[str]) -> DataFrame:
    """state: +1/-1 from a sufficient turn up/down, +2/-2 from an insufficient one, held until the next turn; 0 before any."""
    event = F.when(F.col("turn") != 0, F.col("turn") * F.when(F.col("sufficient"), 1).otherwise(2))
    return df.withColumn("_event", event).withColumn("state", F.coalesce(F.last("_event", True).over(_w(by).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).drop("_event")


def reversal_break(df: DataFrame, volume: str, by: list[str]) -> DataFrame:
    """breaks: a sufficient turn on more volume than the last turn the other way had."""
    before = _w(by).rowsBetween(W.unboundedPreceding, -1)
    last = {s: F.last(F.when(F.col("turn") == s, F.col(volume)), True).over(before) for s in (1, -1)}
    other = F.when(F.col("turn") == 1, last[-1]).when(F.col("turn") == -1, last[1])
    return df.withColumn("breaks", F.coalesce(F.col("sufficient") & (F.col(volume) > other), F.lit(False)))


def runs(df: DataFrame, of: str, by: list[str]) -> DataFrame:
    """run_id: number of the run of equal values; run_bars: bars of it so far, this one included."""
    w = _w(by)
    df = df.withColumn("_new", F.coalesce(F.col(of) != F.lag(of).over(w), F.lit(True)).cast("int"))
    df = df.withColumn("run_id", F.sum("_new").over(w)).drop("_new")
    return df.withColumn("run_bars", F.row_number().over(_w([*by, "run_id"])))


def pivots(df: DataFrame, by: list[str]) -> DataFrame:
    """trough, peak: low of the last bar of the latest falling run and high of that of the rising one, seen one bar after it ended."""
    w = _w(by)
    was, turned = F.lag("dir").over(w), F.col("dir") != F.lag("dir").over(w)
    df = df.withColumns({"_t": F.when(turned & (was == -1), F.lag("low").over(w)), "_p": F.when(turned & (was == 1), F.lag("high").over(w))})
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"trough": F.last("_t", True).over(upto), "peak": F.last("_p", True).over(upto)}).drop("_t", "_p")


def zero_runs(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """cycle_id: run of one side of zero; zeros go with the side before them, leading zeros have 0."""
    w = _w(by)
    df = df.withColumn("_s", F.signum(x)).withColumn("_s", F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_n", F.coalesce((F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0.0))).cast("int"), F.lit(0)))
    return df.withColumn("cycle_id", F.sum("_n").over(w)).drop("_s", "_n")


def full_cycles(df: DataFrame, x: str, by: list[str], start: int) -> DataFrame:
    """full_id: cycles of both colours, counted at edges into the start colour that were seen; 0 before the first."""
    w = _w(by)
    df = df.withColumn("_s", F.last(F.when(F.col(x) != 0, F.signum(x)), True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = (F.col("_s") == start) & (F.lag("_s").over(w) == -start)
    return df.withColumn("_e", F.coalesce(edge.cast("int"), F.lit(0))).withColumn("full_id", F.sum("_e").over(w)).drop("_s", "_e")


def excursion_peak(df: DataFrame, deviation: str, reset: str, by: list[str]) -> DataFrame:
    """peak: the largest deviation since the last reset, the resetting bar not included."""
    w = _w(by)
    df = df.withColumn("_e", F.sum(F.col(reset).cast("int")).over(w))
    return df.withColumn("excursion", F.max(F.when(~F.col(reset), F.col(deviation))).over(_w([*by, "_e"]).rowsBetween(W.unboundedPreceding, 0))).drop("_e")


def divergence(df: DataFrame, price: str, x: str, lookback: int, by: list[str]) -> DataFrame:
    """bearish: price above the highest of the bars before while x is below its value there (the first of equal highs); bullish mirrored."""
    f = _w(by).rowsBetween(-lookback, -1)
    n = F.row_number().over(_w(by))
    df = df.withColumn("_n", n)
    full = F.count(price).over(f) == lookback
    at_high, at_low = F.max_by(x, F.struct(price, -F.col("_n"))).over(f), F.min_by(x, F.struct(price, F.col("_n"))).over(f)
    bear = full & (F.col(price) > F.max(price).over(f)) & (F.col(x) < at_high)
    bull = full & (F.col(price) < F.min(price).over(f)) & (F.col(x) > at_low)
    return df.withColumns({"bearish": F.coalesce(bear, F.lit(False)), "bullish": F.coalesce(bull, F.lit(False))}).drop("_n")


def confirmed(df: DataFrame, cond: str, k: int, by: list[str], out: str) -> DataFrame:
    """The condition on this bar and the k - 1 before it."""
    f = _w(by).rowsBetween(-(k - 1), 0)
    return df.withColumn(out, F.coalesce((F.min(F.expr(cond).cast("int")).over(f) == 1) & (F.count("*").over(f) == k), F.lit(False)))


def pause_until(df: DataFrame, by: list[str], short: int = 5, minutes: int = 60) -> DataFrame:
    """pause_until: the end of the longest pause so far. A pause of `minutes` begins with the bar that turns out of the second short run
    in a row (one of fewer than `short` bars); then, and after a longer run, counting starts anew. Needs run_id (runs())."""
    ends = df.groupBy(*by, "run_id").agg(F.count("*").alias("_len"), F.min("ct").alias("_begin"))
    order = W.partitionBy(*by).orderBy("run_id")
    ends = ends.withColumns({"_short": F.col("_len") < short, "_turn": F.lead("_begin").over(order)})
    # stretches of short runs: every second one of a stretch pauses
    ends = ends.withColumn("_stretch", F.sum((~F.col("_short")).cast("int")).over(order))
    nth = F.sum(F.col("_short").cast("int")).over(W.partitionBy(*by, "_stretch").orderBy("run_id"))
    ends = ends.withColumn("_pause", F.when(F.col("_short") & (nth % 2 == 0), F.col("_turn") + minutes * 60000))
    ends = ends.withColumn("pause_until", F.max("_pause").over(order.rowsBetween(W.unboundedPreceding, -1))).select(*by, "run_id", "pause_until")
    return df.join(ends, [*by, "run_id"])


def whipsaw_pause(df: DataFrame, by: list[str], short: int = 5, minutes: int = 60) -> DataFrame:
    """paused: whether a bar closes within a pause."""
    return pause_until(df, by, short, minutes).withColumn("paused", F.coalesce(F.col("ct") < F.col("pause_until"), F.lit(False))).drop("pause_until")


# fixed values: when entries are allowed, and what is used up by a trade
ENTRY_MODES = ("LIVE_01", "TF_EVENT", "F5_EVENT", "MACD_CYCLE", "MACD_FULL_RED", "MACD_FULL_GREEN")


def entry_runs(df: DataFrame, mode: str, frame_minutes: int = 1, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """entry_run: the run that a trade on this bar would use up, null where the mode admits none. From columns ct, i, run_id and hist.

    LIVE_01: the run of one direction; TF_EVENT: any bar at which the lowest enabled frame closes, F5_EVENT: any bar with an event, both
    without a limit; MACD_CYCLE: the histogram's run on one side of zero; MACD_FULL_RED, MACD_FULL_GREEN: both sides of it from one seen
    edge to the next. What lies before the first cycle admits nothing."""
    keys = list(by)
    if mode == "LIVE_01":
        return df.withColumn("entry_run", F.col("run_id").cast("long"))
    if mode == "TF_EVENT":
        return df.withColumn("entry_run", F.when(F.col("ct") % (frame_minutes * 60_000) == 0, F.col("i")).cast("long"))
    if mode == "F5_EVENT":
        return df.withColumn("entry_run", F.col("i").cast("long"))
    if mode == "MACD_CYCLE":
        out, run = zero_runs(df, "hist", keys), "cycle_id"
    else:
        out, run = full_cycles(df, "hist", keys, {"MACD_FULL_RED": 1, "MACD_FULL_GREEN": -1}[mode]), "full_id"
    return out.withColumn("entry_run", F.when(F.col(run) > 0, F.col(run)).cast("long")).drop(run)
