"""Minute bars: contract, trade prints to bars, optional columns merged in, and what a source offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import MINUTE, DataError, require

PRICES = ("open", "high", "low", "close")
#: Summed over a larger bar; null there unless every minute has a value.
ADDITIVE = ("quote_volume", "agg_trades", "trades", "taker_buy_base", "taker_sell_base", "taker_buy_quote", "delta_base")
#: Taken from the last minute of a larger bar.
STATE = ("funding_rate", "open_interest", "open_interest_value")
# fixed values: what a named capability needs
CAPABILITIES = {
    "price": PRICES, "volume": ("volume",), "taker_flow": ("taker_buy_base",), "signed_flow": ("delta_base",), "trade_count": ("trades",),
    "trade_size": ("volume", "trades"), "quote_volume": ("quote_volume",), "quote_flow": ("taker_buy_quote", "quote_volume"),
    "funding": ("funding_rate",), "open_interest": ("open_interest",), "open_interest_value": ("open_interest_value",),
}


def validate(bars: DataFrame, least: int = 500, step: int = MINUTE) -> DataFrame:
    """Bars that keep the contract, equal duplicates dropped: finite positive prices, high and low at the edges, aligned, no gaps, flow within volume."""
    bars = bars.dropDuplicates()
    o, h, lo, c, v = (F.col(x) for x in (*PRICES, "volume"))
    broken = {
        "missing price or volume": F.coalesce(o + h + lo + c + v, F.lit(float("nan"))) == float("nan"),
        "price not positive": (F.least(o, h, lo, c) <= 0),
        "high is not highest": h < F.greatest(o, c, lo),
        "low is not lowest": lo > F.least(o, c, h),
        "negative volume": v < 0,
        "not on the grid": F.col("open_ms") % step != 0,
    }
    if "taker_buy_base" in bars.columns:
        broken["taker volume above volume"] = F.col("taker_buy_base") > v * (1 + 1e-8) + 1e-10
    require(bars, **broken)
    w = W.partitionBy("series_id").orderBy("open_ms")
    gap = F.col("open_ms") - F.lag("open_ms").over(w)
    require(bars.select(gap.alias("gap")), **{"conflicting duplicate": F.col("gap") == 0, "gap": F.col("gap") > step})
    short = bars.groupBy("series_id").count().where(F.col("count") < least).limit(1).collect()
    if short:
        raise DataError(f"series {short[0]['series_id']} has {short[0]['count']} bars; {least} are needed")
    return bars


def duplicate_conflicts(rows: DataFrame, *key: str) -> DataFrame:
    """Keys whose rows differ, with the number of rows and of different ones."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*rest)).alias("n_versions")).where("n_versions > 1")


def trade_bars(trades: DataFrame, step: int = MINUTE) -> DataFrame:
    """Bars of `step` ms from prints (series_id, trade_id, ts_ms, price, quantity, is_buyer_maker[, first_trade_id, last_trade_id]).

    Sums are partial before the shuffle; ties in time are ordered by trade id."""
    order = F.struct("ts_ms", "trade_id")
    taker = ~F.col("is_buyer_maker")
    quote = F.col("price") * F.col("quantity")
    prints = F.col("last_trade_id") - F.col("first_trade_id") + 1 if {"first_trade_id", "last_trade_id"} <= set(trades.columns) else F.lit(1)
    return (
        trades.groupBy("series_id", (F.floor(F.col("ts_ms") / step) * step).alias("open_ms"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"), F.sum(quote).alias("quote_volume"), F.count("*").alias("agg_trades"), F.sum(prints).alias("trades"),
            F.sum(F.when(taker, F.col("quantity")).otherwise(0.0)).alias("taker_buy_base"), F.sum(F.when(taker, quote).otherwise(0.0)).alias("taker_buy_quote"),
        )
    )


def derived_flow(bars: DataFrame) -> DataFrame:
    """Ratios and signed flow from the totals; nothing where a total is missing or zero."""
    vol, buy, quote, buy_quote = (F.nullif(F.col(c), F.lit(0.0)) if c in ("volume", "quote_volume") else F.col(c) for c in ("volume", "taker_buy_base", "quote_volume", "taker_buy_quote"))
    return bars.withColumns(
        {
            "taker_buy_ratio": buy / vol, "delta_base": 2 * buy - F.col("volume"), "avg_trade_size": F.col("volume") / F.nullif(F.col("trades"), F.lit(0)),
            "taker_buy_quote_ratio": buy_quote / quote, "delta_quote": 2 * buy_quote - F.col("quote_volume"),
        }
    )


def merge_micro(bars: DataFrame, micro: DataFrame) -> DataFrame:
    """One-to-one left join of optional columns; the external value wins, the bar's own fills."""
    require(micro.groupBy("series_id", "open_ms").count(), **{"minute given twice": F.col("count") > 1})
    extra = [c for c in micro.columns if c not in ("series_id", "open_ms")]
    other = micro.select("series_id", "open_ms", *(F.col(c).alias(f"_{c}") for c in extra))
    joined = bars.join(other, ["series_id", "open_ms"], "left")
    return joined.select(*(F.col(c) for c in bars.columns if c not in extra), *(F.coalesce(f"_{c}", c).alias(c) if c in bars.columns else F.col(f"_{c}").alias(c) for c in extra))


def inspect(bars: DataFrame, step: int = MINUTE) -> DataFrame:
    """Per series: rows, first and last bar, missing bars, and the share of rows in which each optional column has a value."""
    optional = [c for c in bars.columns if c not in ("series_id", "open_ms", *PRICES, "volume")]
    return bars.groupBy("series_id").agg(
        F.count("*").alias("n_bars"), F.min("open_ms").alias("first_ms"), F.max("open_ms").alias("last_ms"),
        ((F.max("open_ms") - F.min("open_ms")) / step + 1 - F.count("*")).cast("long").alias("n_missing"),
        *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"has_{c}") for c in optional),
    )


def capabilities(columns: list[str]) -> list[str]:
    return [k for k, need in CAPABILITIES.items() if set(need) <= set(columns)]


def source_fingerprint(spark, paths: dict[str, str]) -> str:
    """One hash of all sources: kinds, paths and the files' contents, hashed where they lie."""
    parts = [spark.read.format("binaryFile").load(p).select(F.lit(k).alias("kind"), F.col("path"), F.sha2("content", 256).alias("digest")) for k, p in sorted(paths.items())]
    from .normalise import union_all

    return union_all(parts).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "path", "digest")))), 256)).first()[0]


def slice_days(bars: DataFrame, start_ms: int | None, end_ms: int | None, halo_ms: int = 0) -> DataFrame:
    """Bars from start (with a halo before it for what looks back) to the end, which is not included."""
    if start_ms is not None:
        bars = bars.where(F.col("open_ms") >= start_ms - halo_ms)
    return bars if end_ms is None else bars.where(F.col("open_ms") < end_ms)
