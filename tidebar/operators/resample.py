"""Larger bars from smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import MINUTE
from ..sources.bars import ADDITIVE, STATE
from .asof import asof


def resample(bars: DataFrame, minutes: int, base: int = 1, complete: bool = True) -> DataFrame:
    """Epoch-aligned buckets of `minutes` from bars of `base` minutes; with `complete` only those in which no bar is missing."""
    step, want = minutes * MINUTE, minutes // base
    add = [c for c in ADDITIVE if c in bars.columns]
    state = [c for c in STATE if c in bars.columns]
    out = bars.groupBy("series_id", (F.floor(F.col("open_ms") / step) * step).alias("bucket")).agg(
        F.min_by("open", "open_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ms").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("n_base"),
        *(F.when(F.count(c) == want, F.sum(c)).alias(c) for c in add),
        *(F.max_by(c, "open_ms").alias(c) for c in state),
    )
    out = out.withColumnRenamed("bucket", "open_ms")
    return out.where(F.col("n_base") == want) if complete else out


def features(bars: DataFrame, timeframes: tuple[int, ...] = (1, 5, 15, 60, 240)) -> DataFrame:
    """All timeframes in one long table (series_id, tf, open_ms, ct, ...); ct is when a bar is known."""
    parts = [(bars.withColumn("n_base", F.lit(1).cast("long")) if m == 1 else resample(bars, m)).withColumn("tf", F.lit(m)) for m in timeframes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ct", F.col("open_ms") + F.col("tf") * MINUTE)


def segments(bars: DataFrame, minutes: int) -> DataFrame:
    """segment: number of the gapless run that a bar is in; i: its place there."""
    w = W.partitionBy("series_id").orderBy("ct")
    new = F.coalesce(F.col("ct") - F.lag("ct").over(w) != minutes * MINUTE, F.lit(True))
    out = bars.withColumn("segment", F.sum(new.cast("int")).over(w))
    return out.withColumn("i", F.row_number().over(W.partitionBy("series_id", "segment").orderBy("ct")) - 1)


def timeframe_map(minutes: DataFrame, tf: DataFrame) -> DataFrame:
    """Each minute with the close time of the latest closed bar of a timeframe, null before the first."""
    closes = tf.select("series_id", F.col("ct").alias("ts_ms"), F.col("ct").alias("tf_ct"))
    return asof(minutes.select("series_id", "ct"), closes, ["tf_ct"]).drop("age_minutes")
