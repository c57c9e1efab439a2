"""Recurrences over a series: each value follows from the one before, so a segment is folded in one task, many segments in parallel.

Columns added: hist, dif, dea (MACD 12/26/9 seeded by the first value, hist doubled), x (= hist), atr14 (Wilder, seeded by the mean of
the first 14 ranges), rsi14, kama10, kama20, ema{n}_1..3 (chained, seeded by the first value they see, null for n - 1 of them),
pdi/mdi/adx14 and 28, ha3, ha5 (close of smoothed candles minus their open), chaikin{fast}_{slow}.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EMAS = (5, 10, 20, 30, 40, 60, 80)
KAMAS, DMIS, HAS, CHAIKINS = (10, 20), (14, 28), (3, 5), ((3, 10), (3, 20), (5, 10), (5, 20))
NAMES = ["hist", "dif", "dea", "x", "atr14", "rsi14", *(f"kama{n}" for n in KAMAS), *(f"ema{n}_{k}" for n in EMAS for k in (1, 2, 3)), *(f"{k}{n}" for n in DMIS for k in ("pdi", "mdi", "adx")), *(f"ha{n}" for n in HAS), *(f"chaikin{a}_{b}" for a, b in CHAIKINS)]


def first_seeded(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(span=n, adjust=False).mean().to_numpy()


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(span=n, adjust=False, min_periods=n).mean().to_numpy()


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=1 / n, adjust=False, min_periods=n).mean().to_numpy()


def seeded_by_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average that begins with the plain mean of the first n values."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = pd.Series(np.concatenate([[x[:n].mean()], x[n:]])).ewm(alpha=1 / n, adjust=False).mean().to_numpy()
    return out


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.abs(b) > 1e-20, a / b, np.nan)


def kama(c: np.ndarray, n: int) -> np.ndarray:
    """Adaptive average between the speeds of 2 and 30 bars, from the mean of the first n on."""
    out = np.full(len(c), np.nan)
    if len(c) > n:
        path = pd.Series(np.abs(np.diff(c, prepend=np.nan))).rolling(n).sum().to_numpy()
        change = np.abs(c - np.concatenate([np.full(n, np.nan), c[:-n]]))
        share = np.where(path > 0, change / np.where(path > 0, path, 1), 0.0)
        speed = (share * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        out[n - 1] = now = c[:n].mean()
        for t in range(n, len(c)):
            now += speed[t] * (c[t] - now)
            out[t] = now
    return out


def smoothed_candles(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    eo, ec = ema(o, n), ema((o + h + low + c) / 4, n)
    out, now, before = np.full(len(c), np.nan), np.nan, np.nan
    for t in range(len(c)):
        if np.isfinite(eo[t]):
            now = (eo[t] + ec[t]) / 2 if not np.isfinite(now) else (now + before) / 2
            before, out[t] = ec[t], ec[t] - now
    return out


def fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """All recurrences of one segment; rows come in any order."""
    pdf = pdf.sort_values("ct")
    o, h, low, c, v = (pdf[k].to_numpy(float) for k in "ohlcv")
    before = np.concatenate([[np.nan], c[:-1]])
    new = {}
    new["dif"] = first_seeded(c, 12) - first_seeded(c, 26)
    new["dea"] = first_seeded(new["dif"], 9)
    new["hist"] = new["x"] = 2 * (new["dif"] - new["dea"])
    with np.errstate(invalid="ignore"):
        tr = np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))
        new["atr14"] = seeded_by_mean(tr, 14)
        step = c - before
        gain, loss = wilder(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), 14), wilder(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), 14)
        new["rsi14"] = 100 - 100 / (1 + np.where(loss != 0, gain / np.where(loss != 0, loss, 1), np.nan))
        for n in KAMAS:
            new[f"kama{n}"] = kama(c, n)
        for n in EMAS:
            e = c
            for k in (1, 2, 3):
                e = new[f"ema{n}_{k}"] = ema(e, n)
        up, dn = np.diff(h, prepend=np.nan), -np.diff(low, prepend=np.nan)
        plus, minus = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
        tr[:1] = np.nan
        for n in DMIS:
            a, p, m = wilder(tr, n), wilder(plus, n), wilder(minus, n)
            p, m = 100 * _over(p, a), 100 * _over(m, a)
            new[f"pdi{n}"], new[f"mdi{n}"], new[f"adx{n}"] = p, m, wilder(100 * _over(np.abs(p - m), p + m), n)
        for n in HAS:
            new[f"ha{n}"] = smoothed_candles(o, h, low, c, n)
        spread = np.where(h > low, _over(2 * c - h - low, h - low), 0.0)
        line = np.cumsum(spread * v)
        for a, b in CHAIKINS:
            new[f"chaikin{a}_{b}"] = ema(line, a) - ema(line, b)
    return pdf.assign(**{k: new[k] for k in NAMES})


def with_folds(bars: DataFrame) -> DataFrame:
    """bars (series_id, segment, ct, o, h, l, c, v, ...) with the columns NAMES; missing values are NULL."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from ..core import finite

    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in NAMES)])
    out = bars.groupBy("series_id", "segment").applyInPandas(fold, schema)
    return out.select(*bars.columns, *(finite(F.col(n)).alias(n) for n in NAMES))
