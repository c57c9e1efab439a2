"""Where and when an entry is allowed."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import DAY, MINUTE, DataError

# fixed values: sessions by UTC hour, first included, last not
SESSIONS = {"ASIA": (0, 8), "EU": (7, 16), "US": (13, 22)}


def _hour(ct: Column) -> Column:
    return F.floor(F.pmod(ct, F.lit(DAY)) / (60 * MINUTE))


def weekday(ct: Column) -> Column:
    """0 Monday to 6 Sunday of a time in ms, UTC."""
    return F.pmod(F.floor(ct / DAY) + 3, F.lit(7))


def session(name: str, ct: str = "ct") -> Column:
    """Whether a bar's close lies in a session. EX_THIN leaves out the thin hours from 22 to 2."""
    t = F.col(ct)
    if name == "ALL":
        return F.lit(True)
    if name in ("WEEKDAY", "WEEKEND"):
        return (weekday(t) < 5) if name == "WEEKDAY" else (weekday(t) >= 5)
    if name == "EX_THIN":
        return (_hour(t) >= 2) & (_hour(t) < 22)
    lo, hi = SESSIONS[name]
    return (_hour(t) >= lo) & (_hour(t) < hi)


def side(name: str, column: str = "side") -> Column:
    return {"BOTH": F.lit(True), "LONG": F.col(column) == 1, "SHORT": F.col(column) == -1}[name]


def structure_gate(close: Column, level: Column, side_: Column, gap: float) -> Column:
    """Long: the close is no further than the gap above the trough; short mirrored below the peak."""
    return F.coalesce(F.when(side_ == 1, close <= level * (1 + gap)).otherwise(close >= level * (1 - gap)), F.lit(False))


@dataclass(frozen=True)
class Position:
    """What an entry's place must meet: distance to the average in ATR, the range of the bars before with its edge, the chase limit."""

    ema: float | None = None
    bars: int = 0
    edge: float = 0.0
    chase: float | None = None


# fixed values: codes of position filters
POSITION = {
    "OFF": Position(),
    "EMA5_ATR075": Position(ema=0.75), "EMA5_ATR100": Position(ema=1.0), "EMA5_ATR150": Position(ema=1.5), "EMA5_ATR200": Position(ema=2.0),
    "RANGE30_EDGE10": Position(bars=30, edge=0.1), "RANGE30_EDGE20": Position(bars=30, edge=0.2), "RANGE60_EDGE10": Position(bars=60, edge=0.1), "RANGE60_EDGE20": Position(bars=60, edge=0.2),
    "EMA5_ATR100_R60_E10": Position(ema=1.0, bars=60, edge=0.1), "EMA5_ATR100_R60_E20": Position(ema=1.0, bars=60, edge=0.2),
    "EMA5_ATR150_R60_E10": Position(ema=1.5, bars=60, edge=0.1), "EMA5_ATR150_R60_E20": Position(ema=1.5, bars=60, edge=0.2),
    "RESEARCH_CHASE5_SMAATR100": Position(chase=1.0), "RESEARCH_CHASE5_SMAATR150": Position(chase=1.5), "RESEARCH_CHASE5_SMAATR200": Position(chase=2.0),
}


def position_inputs(df: DataFrame, by: list[str], step_ms: int = MINUTE) -> DataFrame:
    """What position filters look at, from bars (ct, high, low, close) `step_ms` apart: highest and lowest of the 30 and 60 bars before
    (null across gaps), the move of five bars and the plain mean of 14 true ranges (null unless 24 bars are there, gapless and valid)."""
    w = W.partitionBy(*by).orderBy("ct")
    cols: dict[str, Column] = {}
    for n in (30, 60):
        f = w.rowsBetween(-n, -1)
        full = (F.count("high").over(f) == n) & (F.count("low").over(f) == n) & (F.col("ct") - F.lag("ct", n).over(w) == n * step_ms)
        cols[f"hi{n}"], cols[f"lo{n}"] = F.when(full, F.max("high").over(f)), F.when(full, F.min("low").over(f))
    prev = F.lag("close").over(w)
    out = df.withColumns(cols).withColumn("_tr", F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))))
    good = F.coalesce((F.col("high") >= F.col("close")) & (F.col("close") >= F.col("low")) & (F.col("low") > 0), F.lit(False))
    all24 = (F.count_if(good).over(w.rowsBetween(-23, 0)) == 24) & (F.col("ct") - F.lag("ct", 23).over(w) == 23 * step_ms)
    atr = F.when(F.count("_tr").over(w.rowsBetween(-13, 0)) == 14, F.avg("_tr").over(w.rowsBetween(-13, 0)))
    return out.withColumns({"move5": F.when(all24, F.col("close") - F.lag("close", 5).over(w)), "sma_atr14": F.when(all24, atr)}).drop("_tr")


def mapped_average(native: DataFrame, by: list[str], step_ms: int = 5 * MINUTE) -> DataFrame:
    """Of native bars with columns ema20, atr14: both null unless the last 20 bars are there and gapless."""
    w = W.partitionBy(*by).orderBy("ct")
    ok = F.col("ct") - F.lag("ct", 19).over(w) == 19 * step_ms
    return native.select(*by, "ct", F.when(ok, F.col("ema20")).alias("ema20"), F.when(ok, F.col("atr14")).alias("atr14"))


def position(code: str, side_: Column) -> Column:
    """Whether an entry's place passes; missing data never do. Columns: close, those of position_inputs, and ema20 and atr14 of the last
    native bar, null where that is not fresh."""
    p = POSITION[code]
    c, ok = F.col("close"), F.lit(True)
    if p.chase is not None:
        return F.coalesce((F.col("sma_atr14") > 0) & (F.col("move5") * side_ < p.chase * F.col("sma_atr14")), F.lit(False))
    if p.ema is not None:
        ok = ok & (F.col("atr14") > 0) & ((c - F.col("ema20")) * side_ <= p.ema * F.col("atr14"))
    if p.bars:
        hi, lo = F.col(f"hi{p.bars}"), F.col(f"lo{p.bars}")
        room = F.when(side_ == 1, c <= hi - p.edge * (hi - lo)).otherwise(c >= lo + p.edge * (hi - lo))
        ok = ok & (hi > lo) & room
    return F.coalesce(ok, F.lit(False))


#: Native bars that must have closed before a filter of a higher timeframe is trusted, and bars of the base series before any is.
NATIVE_WARM, BASE_WARM = 35, 200


def higher_filter(code: int, short_frame: bool, side_: Column, native: Column, dir_: Column, bars: Column, state: Column, paused: Column, base: Column, warm: tuple[int, int] = (NATIVE_WARM, BASE_WARM)) -> Column:
    """Codes of a higher timeframe, from its last closed bar: its number from 0, direction, run counter from 1 and latched state.

    0 none. On the long frames (15 minutes and up) 1: not against a run in its first three bars, 2: with one. On the short frame (5
    minutes) 1: with the direction and no pause, 2: with the direction. 3: the state of sufficient volume, 4: also the opposite state
    of insufficient volume. All but 0 wait for `warm`: so many native and so many base bars."""
    early = (bars <= 3) & (native >= 1)
    rule = {
        0: F.lit(True), 1: (dir_ == side_) & ~paused if short_frame else ~(early & (dir_ == -side_)), 2: dir_ == side_ if short_frame else early & (dir_ == side_),
        3: (native >= 2) & (state == side_), 4: (native >= 2) & ((state == side_) | (state == -2 * side_)),
    }[code]
    known = (base >= warm[1]) & (native >= warm[0]) if code else base >= warm[1]
    return F.coalesce(rule & known, F.lit(False))


def trigger(code: int, flip: bool, side_: Column, dir_: Column, turned: Column, close: Column, average: Column, turn: Column, sufficient: Column) -> Column:
    """Codes of the base timeframe: 0 none, 1 the direction, 2 also on the average's side, 3 a turn on sufficient volume, 4 also a turn
    the other way on insufficient volume. flip: codes 1 and 2 only on the bar that changed the direction."""
    with_it = (dir_ == side_) & (turned if flip else F.lit(True))
    rule = {
        0: F.lit(True), 1: with_it, 2: with_it & ((close - average) * side_ > 0),
        3: (turn == side_) & sufficient, 4: ((turn == side_) & sufficient) | ((turn == -side_) & ~sufficient),
    }[code]
    return F.coalesce(rule, F.lit(False))


def holidays(spark: SparkSession, days: dict[int, list[date]]) -> DataFrame:
    return spark.createDataFrame([(y, d) for y, ds in days.items() for d in (ds or [None])], "year int, day date")


def day_kind(df: DataFrame, known: DataFrame, out: str = "off_day") -> DataFrame:
    """Whether the UTC+8 day of ct is a weekend or a listed holiday; a year that is not listed is an error."""
    day = F.to_date(F.timestamp_millis(F.col("ct") + 8 * 60 * MINUTE))
    years = {r[0] for r in known.select("year").distinct().collect()}
    missing = [r[0] for r in df.select(F.year(day).alias("y")).distinct().where(~F.col("y").isin(*years) if years else F.lit(True)).limit(3).collect()]
    if missing:
        raise DataError(f"no holidays known for {', '.join(map(str, missing))}")
    rows = df.withColumn("_day", day).join(F.broadcast(known.select(F.col("day").alias("_day"), F.lit(True).alias("_off"))), "_day", "left")
    return rows.withColumn(out, F.coalesce("_off", F.lit(False)) | (F.dayofweek("_day").isin(1, 7))).drop("_day", "_off")


def rate_by_day(ct: Column, weekday_rate: float, weekend_rate: float) -> Column:
    """A rate by the day of the entry's close."""
    return F.when(weekday(ct) < 5, F.lit(weekday_rate)).otherwise(F.lit(weekend_rate))
