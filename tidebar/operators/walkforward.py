"""Walk-forward models: a fit is frozen for a block of bars, and a block with its look-back is a task.

A block is a UTC day or a fixed number of bars of one series and segment. Every bar goes to its own block and to those later blocks
that look back to it, `look_back` bars at most, so a task holds a block and its look-back and never a series; blocks run side by side
and a bar is sent 1 + look_back / block times. What a model says of a bar depends on its block alone, and therefore on no later bar
than that one. Conditions between neighbouring bars (`begins`) are windows over what the blocks have returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import DAY

KEYS = ["series_id", "segment"]
Columns = dict[str, np.ndarray]


def numbered(bars: DataFrame) -> DataFrame:
    """bars with i, their number within series and segment from 0."""
    return bars.withColumn("i", (F.row_number().over(W.partitionBy(*KEYS).orderBy("ct")) - 1).cast("long"))


def day_blocks(bars: DataFrame, look_back: int, since: DataFrame | None = None, closing: bool = False) -> DataFrame:
    """Each bar once for every block that needs it: (block, own). bars have i; a bar belongs to the UTC day of its last
    millisecond, or with `closing` to that of its close.

    since: (series_id, segment, block, since), the blocks wanted and a bar of each from which it looks back instead of from its first.

    The days' ranges of bars are cut into cells of `look_back` bars, so the join is one on equal keys, whose size per key is bounded."""
    day = F.floor((F.col("ct") - (0 if closing else 1)) / DAY)
    days = bars.groupBy(*KEYS, day.alias("block")).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    lowest = F.col("_first") - look_back
    if since is not None:
        days, lowest = days.join(since, [*KEYS, "block"]), F.least("_first", "since") - look_back
    days = days.withColumn("_low", F.greatest(lowest, F.lit(0)))
    cell = max(1, look_back)
    cells = F.sequence(F.floor(F.col("_low") / cell), F.floor(F.col("_last") / cell))
    days = days.select(*KEYS, "block", "_first", "_last", "_low", F.explode(cells).alias("_cell"))
    rows = bars.withColumn("_cell", F.floor(F.col("i") / cell)).join(days, [*KEYS, "_cell"])
    inside = (F.col("i") >= F.col("_low")) & (F.col("i") <= F.col("_last"))
    return rows.where(inside).withColumn("own", F.col("i") >= F.col("_first")).drop("_cell", "_first", "_last", "_low")


def row_blocks(bars: DataFrame, look_back: int, size: int, start: int = 0) -> DataFrame:
    """The same for blocks of `size` bars, the first of which begins with bar `start`; earlier bars only serve to look back to."""
    at = F.col("i") - start
    lowest, highest = F.greatest(F.floor(at / size), F.lit(0)), F.floor((at + look_back) / size)
    last = F.max("i").over(W.partitionBy(*KEYS))
    blocks = F.explode(F.sequence(lowest, F.least(highest, F.floor((F.col("_end") - start) / size))))
    rows = bars.withColumn("_end", last).where((F.col("_end") >= start) & (F.col("i") >= start - look_back)).withColumn("block", blocks)
    return rows.withColumn("own", (F.col("i") >= start) & (F.floor(at / size) == F.col("block"))).drop("_end")


def walk_forward(blocks: DataFrame, columns: list[str], run: Callable[[Columns, int, str, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """run(columns, first, series, block) for every block, where bars from `first` on are its own; it returns arrays for those.

    The result has series_id, segment, i, ct and what `schema` names."""
    full = f"series_id string, segment int, i long, ct long, {schema}"
    names = [x.split()[0] for x in schema.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "ct"], kind="stable")
        own = pdf["own"].to_numpy(bool)
        first = int(own.argmax()) if own.any() else len(own)
        tail = pdf.iloc[first:]
        if not len(tail):
            return pd.DataFrame({c: [] for c in ("series_id", "segment", "i", "ct", *names)})
        got = run({c: pdf[c].to_numpy(float if c not in ("i", "ct") else np.int64) for c in columns}, first, str(tail["series_id"].iloc[0]), int(tail["block"].iloc[0]))
        return pd.DataFrame({**{c: tail[c] for c in ("series_id", "segment", "i", "ct")}, **{c: got[c] for c in names}})

    need = list(dict.fromkeys(["i", "ct", *columns]))
    return blocks.select(*KEYS, "block", "own", *need).groupBy(*KEYS, "block").applyInPandas(one, full)


def begins(condition: Column) -> Column:
    """The condition holds and did not hold a bar ago; to be used on rows (series_id, segment, i)."""
    before = F.lag(condition, 1).over(W.partitionBy(*KEYS).orderBy("i"))
    return condition & ~F.coalesce(before, F.lit(False))


def sided(up: Column, down: Column) -> Column:
    """+1, -1 or 0."""
    return F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0)
