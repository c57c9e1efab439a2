"""Column names, numbers and timestamps made uniform; conflicts are errors, never the last one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DataError, require

# fixed values: spellings of the columns
ALIASES = {
    "open_ms": ("openTime", "open_time", "timestamp", "time", "date", "datetime"),
    "open": ("Open", "o"),
    "high": ("High", "h"),
    "low": ("Low", "l"),
    "close": ("Close", "c"),
    "volume": ("Volume", "v", "vol"),
    "quote_volume": ("quoteVolume", "quote_asset_volume"),
    "trades": ("count", "number_of_trades", "num_trades"),
    "taker_buy_base": ("taker_buy_volume", "taker_buy_base_asset_volume", "takerBuyBase"),
    "taker_buy_quote": ("taker_buy_quote_volume", "taker_buy_quote_asset_volume", "takerBuyQuote"),
    "funding_rate": ("fundingRate", "last_funding_rate"),
    "open_interest": ("openInterest", "sum_open_interest", "sumOpenInterest"),
    "open_interest_value": ("openInterestValue", "sum_open_interest_value", "sumOpenInterestValue"),
}
#: The short spelling of trades counts only as a whole.
SHORT_TRADES = {"p": "price", "q": "quantity", "T": "ts_ms", "m": "is_buyer_maker"}


def rename(df: DataFrame) -> DataFrame:
    """One column for each name: spellings that stand beside each other must agree where both have a value."""
    clean = {c: c.strip().lstrip("﻿") for c in df.columns}
    df = df.withColumnsRenamed({c: n for c, n in clean.items() if c != n})
    if set(SHORT_TRADES) <= set(df.columns):
        return df.withColumnsRenamed(SHORT_TRADES)
    for name, others in ALIASES.items():
        have = [c for c in (name, *others) if c in df.columns]
        if len(have) > 1:
            first, *more = (F.col(f"`{c}`") for c in have)
            require(df, **{f"{name} disagrees with {c}": (first.isNotNull() & m.isNotNull() & (first.cast("string") != m.cast("string"))) for c, m in zip(have[1:], more)})
            df = df.withColumn("_one", F.coalesce(first, *more)).drop(*have).withColumnRenamed("_one", name)
        elif have and have[0] != name:
            df = df.withColumnRenamed(have[0], name)
    return df


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as DOUBLE; text that is no number, and infinite numbers, are errors; empty text is missing."""
    out = {c: F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as double)") for c in columns}
    bad = {f"{c} is no number": F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "") & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) for c, x in out.items()}
    return require(df, **bad).withColumns(out)


def unit(x: Column) -> Column:
    """The unit of an epoch number by its size."""
    return F.when(x >= 10**17, "ns").when(x >= 10**14, "us").when((x >= 10**9) & (x < 10**11), "s").otherwise("ms")


def to_ms(x: Column) -> Column:
    """Milliseconds of an epoch number in any unit; finer ones are floored."""
    whole = x.cast("decimal(20,0)").cast("long")
    return F.when(unit(x) == "ns", F.expr("0") + F.floor(whole / 10**6)).when(unit(x) == "us", F.floor(whole / 10**3)).when(unit(x) == "s", whole * 1000).otherwise(whole).cast("long")


def timestamps(df: DataFrame, column: str = "open_ms") -> DataFrame:
    """The column as BIGINT milliseconds, from epoch numbers of one unit, ISO text or timestamps."""
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind.startswith("timestamp"):
        return df.withColumn(column, F.unix_millis(c.cast("timestamp")))
    number = F.expr(f"try_cast(`{column}` as decimal(20,0))")
    units = [r[0] for r in df.where(number.isNotNull()).select(unit(number)).distinct().limit(3).collect()]
    if len(units) > 1:
        raise DataError(f"{column} mixes units: {', '.join(sorted(units))}")
    text = F.unix_millis(F.expr(f"try_cast(`{column}` as timestamp)")) if kind == "string" else F.lit(None).cast("long")
    out = F.coalesce(F.when(number.isNotNull(), to_ms(number)), text)
    return require(df, **{f"{column} is no time": c.isNotNull() & out.isNull()}).withColumn(column, out)


def maker_flag(x: Column) -> Column:
    """true, false, 1, 0, 1.0 or 0.0; other text is null and an error for the caller."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "1.0"), True).when(t.isin("false", "0", "0.0"), False)


def one_symbol(df: DataFrame, expected: str | None, column: str = "symbol") -> DataFrame:
    """The column, where there, has one value, and it is the expected one."""
    if column not in df.columns:
        return df
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(2).collect()]
    if len(found) > 1 or (expected and found and found[0] != expected):
        raise DataError(f"symbol: {', '.join(map(str, found))}; expected {expected or 'one'}")
    return df


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
