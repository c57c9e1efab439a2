"""Price structures: triangles of pivots, pivot clusters over two timeframes, cascades of expansions, point and figure.

All but the last are windows, running values and joins on equal keys over the bars and, mostly, over the few bars with an event. What
waits for a bar (`pending`) is the last thing that was opened before it, so no state is handed from bar to bar. A point-and-figure
column begins anew each UTC day, so a day is a task.

Bars: series_id, segment, i, ct, o, h, l, c, v and atr14; i counts the bars of a segment from 0. A value is used from the bar on at
whose close it is known: a pivot two bars after its extreme, a larger bar at its own close.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import DAY
from .walkforward import KEYS


def _row():
    return W.partitionBy(*KEYS).orderBy("i")


def _so_far():
    return _row().rowsBetween(W.unboundedPreceding, 0)


def _before():
    return _row().rowsBetween(W.unboundedPreceding, -1)


def pending(df: DataFrame, opened: Column, fires, out: str) -> DataFrame:
    """df with `out`: the struct of the thing that fires on the bar, or null.

    opened: a struct with `i`, the bar it is opened at, and `live`, false for one that only ends what was open; null on other bars.
    fires(thing) says whether it fires on a bar; only the last one opened before a bar can, and each only once."""
    df = df.withColumn("_thing", F.last(opened, ignorenulls=True).over(_before()))
    thing = F.col("_thing")
    df = df.withColumn("_hit", F.coalesce(thing["live"] & fires(thing), F.lit(False)))
    df = df.withColumn("_fired", F.max(F.when(F.col("_hit"), thing["i"])).over(_before()))
    once = F.col("_hit") & (F.col("_fired").isNull() | (F.col("_fired") < thing["i"]))
    return df.withColumn(out, F.when(once, thing)).drop("_thing", "_hit", "_fired")


def confirmed_pivots(df: DataFrame, order: str = "i") -> DataFrame:
    """peak and trough: the high or low two bars ago, where it is beyond both neighbours on either side."""
    w = W.partitionBy(*KEYS).orderBy(order)
    at = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    high, low = at("h", 2), at("l", 2)
    peak, trough = F.lit(True), F.lit(True)
    for k in (0, 1, 3, 4):
        peak, trough = peak & (high > at("h", k)), trough & (low < at("l", k))
    return df.withColumns({"peak": F.when(peak, high), "trough": F.when(trough, low)})


def zigzag(df: DataFrame, points: int, within: int) -> DataFrame:
    """Bars whose pivot goes on or renews the zigzag, with `points`: (k, value) of its last pivots, the oldest first; pivots more than
    `within` bars before the newest do not count, and a bar that has not so many left is left out.

    Of pivots of one kind in a row the most extreme counts, of equal ones the later; a bar with both kinds counts as none."""
    kind = F.when(F.col("peak").isNotNull() & F.col("trough").isNull(), 1).when(F.col("trough").isNotNull() & F.col("peak").isNull(), -1)
    e = confirmed_pivots(df).withColumn("kind", kind).where("kind IS NOT NULL").withColumns({"k": F.col("i") - 2, "value": F.coalesce("peak", "trough")})
    e = e.withColumn("run", F.sum((F.col("kind") != F.lag("kind", 1, 0).over(_row())).cast("int")).over(_so_far()))
    reach = F.col("kind") * F.col("value")
    before = F.max(reach).over(W.partitionBy(*KEYS, "run").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("_best", before).where(F.col("_best").isNull() | (reach >= F.col("_best"))).drop("_best")
    # the last that was taken in a run is its final pivot
    final = e.groupBy(*KEYS, "run").agg(F.max(F.struct("i", "k", "value")).alias("f"))
    w = W.partitionBy(*KEYS).orderBy("run")
    past = final.select(*KEYS, "run", *(F.lag(F.struct("f.k", "f.value"), n).over(w).alias(f"p{n}") for n in range(points - 1, 0, -1)))
    e = e.join(past, [*KEYS, "run"]).where(F.col(f"p{points - 1}").isNotNull() & (F.col("k") - F.col(f"p{points - 1}.k") <= within))
    return e.withColumn("points", F.array(*(F.col(f"p{n}") for n in range(points - 1, 0, -1)), F.struct("k", "value"))).drop(*(f"p{n}" for n in range(1, points)))


def triangles(bars: DataFrame, within: int = 180, narrow: float = 0.7, flat: float = 0.3, buffer: float = 0.1, patience: int = 20) -> DataFrame:
    """Ascending and descending triangles of the last six pivots: one side flat within `flat` ranges, the other drawing near, the width
    down to `narrow`. The first close beyond the flat side and a buffer within `patience` bars is the signal; both kinds at once end a
    triangle that waits."""
    z = zigzag(bars, 6, within)
    value = lambda n: F.col("points")[n]["value"]
    side = lambda kind: [F.when(F.col("kind") == kind, value(n + 1)).otherwise(value(n)) for n in (0, 2, 4)]
    z = z.withColumns({f"{name}{n}": c for name, kind in (("hi", 1), ("lo", -1)) for n, c in enumerate(side(kind))})
    hi, lo = [F.col(f"hi{n}") for n in range(3)], [F.col(f"lo{n}") for n in range(3)]
    first, last = hi[0] - lo[0], hi[2] - lo[2]
    shaped = (first > 0) & (last > 0) & (last <= narrow * first)
    even = lambda x: F.greatest(*x) - F.least(*x) <= flat * F.col("atr14")
    rising = shaped & even(hi) & (lo[1] > lo[0]) & (lo[2] > lo[1])
    falling = shaped & even(lo) & (hi[1] < hi[0]) & (hi[2] < hi[1])
    z = z.where(F.col("atr14").isNotNull()).withColumns({"rising": rising, "falling": falling}).where("rising OR falling")
    sign = F.when(F.col("rising"), 1).otherwise(-1)
    level = F.when(F.col("rising"), F.greatest(*hi)).otherwise(F.least(*lo))
    opened = z.select(*KEYS, "i", F.struct("i", (F.col("rising") != F.col("falling")).alias("live"), sign.alias("sign"), level.alias("level"), (buffer * F.col("atr14")).alias("buffer")).alias("opened"))
    rows = bars.select(*KEYS, "i", "ct", "c").withColumn("past", F.lag("c").over(_row())).join(opened, [*KEYS, "i"], "left")
    over = lambda t, c: t["sign"] * (F.col(c) - t["level"])
    rows = pending(rows, F.col("opened"), lambda t: (F.col("i") <= t["i"] + patience) & (over(t, "c") > t["buffer"]) & (over(t, "past") <= t["buffer"]), "fired")
    return rows.where("opened IS NOT NULL OR fired IS NOT NULL").select(*KEYS, "i", "ct", F.when(F.col("opened.live"), F.col("opened.sign")).alias("opens"), F.when(F.col("opened.live"), F.col("opened.level")).alias("level"), F.coalesce("fired.sign", F.lit(0)).alias("side"))


def larger(bars: DataFrame, bars_each: int, step: int) -> DataFrame:
    """Bars of `bars_each` smaller ones of `step` milliseconds, at the bar that ends them: (i, ct, o, h, l, c, v). They end at times
    divisible by their length and take that many bars back, the first of a segment only when so many are there."""
    w = _row().rowsBetween(1 - bars_each, 0)
    made = bars.select(*KEYS, "i", "ct", F.first("o").over(w).alias("o"), F.max("h").over(w).alias("h"), F.min("l").over(w).alias("l"), "c", F.sum("v").over(w).alias("v"))
    return made.where((F.col("ct") % (bars_each * step) == 0) & (F.col("i") >= bars_each - 1))


def _range_folds(made: DataFrame) -> DataFrame:
    from ..functions.folds import with_folds

    return with_folds(made).select(*made.columns, "atr14")


def pivot_clusters(bars: DataFrame, step: int, small: int = 5, large: int = 15, near: float = 0.3, buffer: float = 0.1, patience: int = 60) -> DataFrame:
    """Where the latest pivots of two larger timeframes lie within `near` ranges of the larger, the first close through both and a
    buffer within `patience` bars is the signal. A new pivot on either timeframe opens, renews or ends its side's wait."""
    five = confirmed_pivots(larger(bars, small, step)).select(*KEYS, "i", F.col("peak").alias("p_s"), F.col("trough").alias("t_s"))
    fifteen = confirmed_pivots(_range_folds(larger(bars, large, step))).select(*KEYS, "i", F.col("peak").alias("p_l"), F.col("trough").alias("t_l"), F.col("atr14").alias("scale"), F.lit(True).alias("closed"))
    rows = bars.select(*KEYS, "i", "ct", "c", "atr14").join(five, [*KEYS, "i"], "left").join(fifteen, [*KEYS, "i"], "left")
    # a larger bar without a range yet hides the one before it
    scale = F.last(F.when(F.col("closed"), F.struct("scale")), ignorenulls=True).over(_so_far())["scale"]
    rows = rows.withColumns({"past": F.lag("c").over(_row()), "scale_now": scale, **{f"{c}_now": F.last(c, ignorenulls=True).over(_so_far()) for c in ("p_s", "t_s", "p_l", "t_l")}})
    for kind, sign in (("p", 1), ("t", -1)):
        a, b = F.col(f"{kind}_s_now"), F.col(f"{kind}_l_now")
        live = F.coalesce(F.abs(a - b) <= near * F.col("scale_now"), F.lit(False)) & F.col("atr14").isNotNull()
        level = (F.greatest(a, b) if sign > 0 else F.least(a, b)) + sign * buffer * F.col("atr14")
        new = F.col(f"{kind}_s").isNotNull() | F.col(f"{kind}_l").isNotNull()
        through = lambda t, s=sign: (F.col("i") <= t["i"] + patience) & (s * (F.col("past") - t["level"]) <= 0) & (s * (F.col("c") - t["level"]) > 0)
        rows = rows.withColumn(f"open_{kind}", F.when(new, F.struct("i", live.alias("live"), level.alias("level"))))
        rows = pending(rows, F.col(f"open_{kind}"), through, f"fired_{kind}")
    up, down = F.col("fired_p").isNotNull(), F.col("fired_t").isNotNull()
    level = lambda k: F.when(F.col(f"open_{k}.live"), F.col(f"open_{k}.level"))
    return rows.where(F.col("open_p.live") | F.col("open_t.live") | up | down).select(*KEYS, "i", "ct", level("p").alias("above"), level("t").alias("below"), up.alias("up"), down.alias("down"))


def expansions(bars: DataFrame, rows: int = 60, times: float = 1.5) -> DataFrame:
    """(i, sign): bars whose true range begins to exceed `times` the mean of so many before; the sign is their body's."""
    before = F.lag("c").over(_row())
    tr = F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))
    past = _row().rowsBetween(-rows, -1)
    df = bars.select(*KEYS, "i", "o", "c", tr.alias("tr"))
    wide = F.coalesce((F.count("tr").over(past) == rows) & (F.col("tr") > times * F.avg("tr").over(past)), F.lit(False))
    df = df.withColumn("wide", wide)
    df = df.withColumn("begins", F.col("wide") & ~F.lag("wide", 1, False).over(_row()))
    return df.where("begins").select(*KEYS, "i", F.signum(F.col("c") - F.col("o")).cast("int").alias("sign"))


def cascade(bars: DataFrame, step: int, small: int = 5, large: int = 15, rows: int = 60, times: float = 1.5, patience: int = 20) -> DataFrame:
    """An expansion of a large bar, then of a smaller, then of a single one, all to the same side and all within `patience` bars. The
    next large expansion starts anew; a smaller or single one to the other side ends the chain."""
    made = {"e_l": larger(bars, large, step), "e_s": larger(bars, small, step), "e_1": bars}
    df = bars.select(*KEYS, "i", "ct")
    for name, b in made.items():
        # a made bar's neighbours are made bars, in their order
        e = expansions(b, rows, times).where("sign <> 0").withColumnRenamed("sign", name)
        df = df.join(e, [*KEYS, "i"], "left")
    back = W.partitionBy(*KEYS).orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, -1)
    upcoming = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct("i", c)), ignorenulls=True).over(back)
    df = df.withColumns({"next_l": upcoming("e_l"), "next_s": upcoming("e_s"), "next_1": upcoming("e_1")})
    start = df.where("e_l IS NOT NULL").select(*KEYS, F.col("i").alias("first"), F.col("e_l").alias("sign"), F.coalesce("next_l.i", F.lit(2**62)).alias("end"), F.col("next_s.i").alias("i"), F.col("next_s.e_s").alias("second"))
    start = start.where((F.col("i") < F.col("end")) & (F.col("i") <= F.col("first") + patience) & (F.col("second") == F.col("sign")))
    third = df.select(*KEYS, "i", F.col("next_1.i").alias("third"), F.col("next_1.e_1").alias("kind"))
    hit = start.join(third, [*KEYS, "i"]).where((F.col("third") < F.col("end")) & (F.col("third") <= F.col("first") + patience) & (F.col("kind") == F.col("sign")))
    return hit.select(*KEYS, F.col("third").alias("i"), "first", F.col("i").alias("second"), F.col("sign").alias("side")).join(bars.select(*KEYS, "i", "ct"), [*KEYS, "i"]).select(*KEYS, "i", "ct", "first", "second", "side")


def point_and_figure(bars: DataFrame, bars_a_day: int = 1440, of_range: float = 0.5, least: float = 0.01, reversal: int = 3) -> DataFrame:
    """Columns of boxes whose height is half the median range of the complete day before, anew each UTC day: a row a bar with its box,
    its column (+1 rising, -1 falling, 0 none yet), the columns so far, and side: where a column first passes the last one of its kind.

    The scale is the other day's aggregate, met by a join on the day; the automaton runs over one day of one series a task."""
    day = F.floor((F.col("ct") - 1) / DAY)
    rows = bars.select(*KEYS, "i", "ct", "c", "atr14", day.alias("day"))
    whole = rows.groupBy(*KEYS, "day").agg(F.count("*").alias("n"), F.min("ct").alias("a"), F.max("ct").alias("b"), F.expr("percentile(atr14, 0.5)").alias("m")).where(F.col("m").isNotNull() & (F.col("n") == bars_a_day) & (F.col("b") == (F.col("day") + 1) * DAY))
    scale = whole.select(*KEYS, (F.col("day") + 1).alias("day"), F.greatest(F.col("m") * of_range, F.lit(least)).alias("height"))
    boxed = rows.join(scale, [*KEYS, "day"]).withColumn("box", F.floor(F.col("c") / F.col("height")).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        out = columns_of(pdf["box"].to_numpy(), reversal)
        return pdf[[*KEYS, "i", "ct", "box"]].assign(column=out[0], columns=out[1], side=out[2])

    return boxed.select(*KEYS, "day", "i", "ct", "box").groupBy(*KEYS, "day").applyInPandas(run, "series_id string, segment int, i long, ct long, box long, column int, columns int, side int")


def columns_of(boxes: np.ndarray, reversal: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, number of columns and signal at each bar of a day."""
    column, number, side = (np.zeros(len(boxes), int) for _ in range(3))
    now, count, free = 0, 1, False
    end = {1: None, -1: None}  # where the last finished column of a kind ended
    reach = boxes[0] if len(boxes) else 0
    for t, box in enumerate(boxes):
        if now == 0:
            now, reach = int(np.sign(box - reach)), box
        else:
            ahead = now * (box - reach)
            if ahead <= -reversal:
                end[now], now, reach, count, free = reach, -now, box, count + 1, True
            elif ahead > 0:
                reach = box
            if free and count >= 3 and end[now] is not None and end[-now] is not None and now * (box - end[now]) >= 1:
                side[t], free = now, False
        column[t], number[t] = now, count
    return column, number, side
