"""Bars from a stream of prints: a bucket comes out once the watermark has passed its end; later prints for it are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(prints: DataFrame, minutes: int, lateness: str = "1 minute") -> DataFrame:
    """prints (series_id, ts TIMESTAMP, trade_id, price, quantity) to closed buckets, for append mode. ct is the bucket's end."""
    order = F.struct("ts", "trade_id")
    bars = prints.withWatermark("ts", lateness).groupBy("series_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.count("*").alias("trades"),
    )
    return bars.select("series_id", F.unix_millis(F.col("w.start")).alias("open_ms"), F.unix_millis(F.col("w.end")).alias("ct"), "open", "high", "low", "close", "volume", "trades")


STATE = "last_close double, previous_close double, volume double, state int, ct long"
OUT = "series_id string, ct long, state int, turn int"


def latched_states(bars: DataFrame, step_ms: int) -> DataFrame:
    """The latched reversal state of each series, carried from batch to batch; a gap starts it anew. For append mode."""

    def step(key, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        c1, c2, v1, state, before = held.get if held.exists else (None, None, None, 0, None)
        rows = pd.concat(parts).sort_values("ct")
        out = []
        for ct, close, volume in zip(rows["ct"], rows["close"], rows["volume"]):
            if before is not None and ct - before != step_ms:
                c1 = c2 = v1 = None
                state = 0
            turn = 0
            if c1 is not None and c2 is not None:
                turn = 1 if close > c1 and c1 < c2 else -1 if close < c1 and c1 > c2 else 0
            if turn:
                state = turn * (1 if v1 is not None and volume > v1 else 2)
            out.append((key[0], int(ct), int(state), turn))
            c2, c1, v1, before = c1, float(close), float(volume), int(ct)
        held.update((c1, c2, v1, int(state), before))
        yield pd.DataFrame(out, columns=["series_id", "ct", "state", "turn"])

    return bars.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
