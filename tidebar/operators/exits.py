"""Stops and targets of entries: exit places and prices on the bars of each series.

Entries (series_id, i, side) and bars (series_id, i, ct, o, h, l, c, atr14, ...) are brought together by series, and every plan is
evaluated for all of a series' entries at once. `exit_i` is null where a plan never exits; a hit on the level itself counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


@dataclass(frozen=True)
class Plan:
    """kind: fixed, atr, pivot, bad, ma, event, time, sequence (stops); target, target_atr, structure, risk, reversal, target_time,
    ma_cross, fade, deviation (targets); trail_share, trail_price, lock (targets that move with the price).

    a and b: rate; multiple of ATR; share given back (b) after an activation (a); locked rate (b) after an activation (a); risk: multiple
    of the distance to the stop's risk level; ma_cross: average and confirming closes; fade: ratio of the volume and confirming bars;
    deviation: average, activation (b) and c confirming bars that come nearer."""

    id: int
    kind: str
    a: float = 0.0
    b: float = 0.0
    intrabar: bool = True
    c: int = 1


def _never(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, np.iinfo(np.int64).max), np.full(n, np.nan)


def hit(bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray, level: np.ndarray, stop: bool) -> tuple[np.ndarray, np.ndarray]:
    """First bar after entry that touches the level: stops lie against the entry, targets in its direction."""
    n = len(bars["c"])
    out = np.full(len(i), n, np.int64)
    for s in (1, -1):
        own = side == s
        down = (s == 1) == stop
        out[own] = P.first_at_most(bars["l"], i[own] + 1, level[own]) if down else P.first_at_least(bars["h"], i[own] + 1, level[own])
    found = out < n
    return np.where(found, out, np.iinfo(np.int64).max), np.where(found, level, np.nan)


def _at(bars: dict[str, np.ndarray], found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exits at the close of the bars found."""
    n = len(bars["c"])
    ok = found < n
    return np.where(ok, found, np.iinfo(np.int64).max), np.where(ok, bars["c"][np.minimum(found, n - 1)], np.nan)


def evaluate(plan: Plan, bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exit place, exit price, risk level) of each entry."""
    c, price = bars["c"], bars["c"][i]
    none = np.full(len(i), np.nan)
    if plan.kind in ("fixed", "target"):
        level = price * (1 + side * plan.a * (-1 if plan.kind == "fixed" else 1))
        return *hit(bars, i, side, level, plan.kind == "fixed"), level if plan.kind == "fixed" else none
    if plan.kind in ("atr", "target_atr"):
        level = price + side * plan.a * bars["atr14"][i] * (-1 if plan.kind == "atr" else 1)
        return *hit(bars, i, side, level, plan.kind == "atr"), level if plan.kind == "atr" else none
    if plan.kind == "pivot":
        level = np.where(side == 1, bars["trough"][i] * (1 - plan.a), bars["peak"][i] * (1 + plan.a))
        level = np.where((price - level) * side > 0, level, np.nan)
        return *hit(bars, i, side, level, True), level
    if plan.kind == "structure":
        level = np.where(side == 1, bars["peak"][i] * (1 - plan.a), bars["trough"][i] * (1 + plan.a))
        level = np.where((level - price) * side > 0, level, np.nan)
        return *hit(bars, i, side, level, False), none
    if plan.kind == "bad":  # so many closes in a row on the losing side of the entry
        k = int(plan.a)
        worst = {1: pd.Series(c).rolling(k).max().to_numpy(), -1: pd.Series(c).rolling(k).min().to_numpy()}
        out = np.full(len(i), len(c), np.int64)
        for s in (1, -1):
            own = side == s
            edge = np.nextafter(price[own], -s * np.inf)
            out[own] = P.first_at_most(worst[1], i[own] + k, edge) if s == 1 else P.first_at_least(worst[-1], i[own] + k, edge)
        return *_at(bars, out), none
    if plan.kind == "ma":  # so many closes in a row on the wrong side of an average
        n, k = int(plan.a), int(plan.b)
        ma = pd.Series(c).rolling(n).mean().to_numpy()
        out = np.full(len(i), len(c), np.int64)
        for s in (1, -1):
            own = side == s
            wrong = (c < ma) if s == 1 else (c > ma)
            out[own] = P.next_event(pd.Series(wrong.astype(float)).rolling(k).sum().to_numpy() == k, i[own] + k)
        return *_at(bars, out), none
    if plan.kind == "event":  # a column of +1/-1: an event against the entry
        out = np.full(len(i), len(c), np.int64)
        for s in (1, -1):
            out[side == s] = P.next_event(bars["event"] == -s, i[side == s] + 1)
        return *_at(bars, out), none
    if plan.kind == "reversal":  # the same, but only in profit
        out = np.full(len(i), len(c), np.int64)
        for s in (1, -1):
            own = side == s
            out[own] = P.first_profitable(c, bars["event"] == -s, i[own] + 1, price[own], side[own])
        return *_at(bars, out), none
    if plan.kind == "sequence":  # direction flips, then dif below dea, then above again, then the histogram shrinks; mirrored for shorts
        out = np.full(len(i), len(c), np.int64)
        shrink = np.append(False, np.abs(np.diff(bars["hist"])) > 0) & np.append(False, np.abs(bars["hist"][1:]) < np.abs(bars["hist"][:-1]))
        for s in (1, -1):
            own = side == s
            at = i[own] + 1
            for mask in (bars["dir"] == -s, s * (bars["dif"] - bars["dea"]) < 0, s * (bars["dif"] - bars["dea"]) > 0, shrink):
                at = P.next_event(mask, np.minimum(at, len(c)))
            out[own] = at
        return *_at(bars, out), none
    if plan.kind in ("time", "target_time"):
        found = i + int(plan.a)
        if plan.kind == "target_time":
            later = c[np.minimum(found, len(c) - 1)]
            found = np.where((later - price) * side > 0, found, len(c))
        return *_at(bars, found), none
    if plan.kind in ("ma_cross", "fade", "deviation"):
        marks = _marks(plan, bars)
        out = np.full(len(i), len(c), np.int64)
        for s in (1, -1):
            own = side == s
            out[own] = P.first_profitable(c, marks[s], i[own] + 1, price[own], side[own])
        return *_at(bars, out), none
    if plan.kind in MOVING:
        found = [moving(plan, bars, int(k), int(s)) for k, s in zip(i, side)]
        at = np.array([len(c) if f is None else f[0] for f in found], np.int64)
        return np.where(at < len(c), at, np.iinfo(np.int64).max), np.array([np.nan if f is None else f[1] for f in found]), none
    raise ValueError(f"no such plan: {plan.kind}")


MOVING = ("trail_share", "trail_price", "lock")


def _run(mask: np.ndarray, k: int) -> np.ndarray:
    """The condition on a bar and on the k - 1 before it."""
    return pd.Series(mask.astype(float)).rolling(k).sum().to_numpy() == k


def _before(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(x), bool)
    out[k:] = x[:-k] if k else x
    return out


def _marks(plan: Plan, bars: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
    """Bars that end a long (1) and a short (-1) in profit."""
    c = bars["c"]
    if plan.kind == "fade":  # so many bars on a volume of at most a share of the 20 before
        v = pd.Series(bars["v"])
        mean = v.shift(1).rolling(20).mean().to_numpy()
        quiet = _run((mean > 0) & (bars["v"] <= plan.a * mean), int(plan.b))
        return {1: quiet, -1: quiet}
    ma = pd.Series(c).rolling(int(plan.a)).mean().to_numpy()
    if plan.kind == "ma_cross":  # the close went through the average and stayed beyond it for so many bars
        k = int(plan.b)
        return {1: _run(c < ma, k) & _before(c >= ma, k), -1: _run(c > ma, k) & _before(c <= ma, k)}
    # a deviation of at least the activation since the average was last touched, then so many bars that come nearer
    out = {}
    for s in (1, -1):
        away = s * (c / ma - 1)
        touched = ~(away > 0)
        since = pd.Series(np.where(touched, 0.0, away)).groupby(np.cumsum(touched)).cummax().to_numpy()
        out[s] = _run(np.append(False, away[1:] < away[:-1]), plan.c) & (since >= plan.b) & ~touched
    return out


def moving(plan: Plan, bars: dict[str, np.ndarray], i: int, side: int, start: int | None = None) -> tuple[int, float] | None:
    """Where a moving target ends an entry: armed by the path, effective from the next bar on; the line that a bar is held against is
    the one known when it began. `start`: the last bar before the search (the entry, or a first part's exit)."""
    price, n = bars["c"][i], len(bars["c"])
    begin, length = (i if start is None else start) + 1, 64
    while begin < n:
        stop = min(begin + length, n)
        good, bad, close = ((bars["h"], bars["l"]) if side == 1 else (bars["l"], bars["h"])) + (bars["c"],)
        good, bad, close = good[begin:stop], bad[begin:stop], close[begin:stop]
        if plan.kind == "lock":
            armed = (close - price * (1 + side * plan.a)) * side >= 0
            line = np.full(len(close), price * (1 + side * plan.b))
        else:
            best = side * np.maximum.accumulate(np.maximum(side * good, side * price))
            armed = (best - price * (1 + side * plan.a)) * side >= 0
            known = np.append(price, best[:-1])
            line = price + (known - price) * (1 - plan.b) if plan.kind == "trail_share" else known * (1 - side * plan.b)
        live = np.append(False, np.logical_or.accumulate(armed)[:-1])
        hit_ = np.flatnonzero(live & ((bad - line) * side <= 0))
        if len(hit_):
            return begin + int(hit_[0]), float(line[hit_[0]])
        if stop == n:
            return None
        length *= 4
    return None


def merge_stops(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], side: np.ndarray, intrabar: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The earliest stop; on a tie the one within the bar goes before one at its close, and of two the adverse price counts."""
    at, price, risk = (x.copy() for x in parts[0])
    inside = np.full(len(at), intrabar[0])
    for (a, p, r), own in zip(parts[1:], intrabar[1:]):
        tie = (a == at) & (a < np.iinfo(np.int64).max)
        take = (a < at) | tie & (own & ~inside | (own == inside) & (p * side < price * side))
        at, price, risk = np.where(take, a, at), np.where(take, p, price), np.where(take, r, risk)
        inside = np.where(take, own, inside)
    return at, price, risk


def combine_targets(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The earliest target; on a tie the worse price."""
    at, price, none = (x.copy() for x in parts[0])
    for a, p, _ in parts[1:]:
        take = (a < at) | (a == at) & (p * side < price * side)
        at, price = np.where(take, a, at), np.where(take, p, price)
    return at, price, none


#: Entries of a series that one task takes; a longer list is dealt to several, each with the bars.
ENTRIES = 100_000


def exit_table(entries: DataFrame, bars: DataFrame, plans: list[Plan], each: int = ENTRIES) -> DataFrame:
    """(series_id, i, side, plan_id, exit_i, exit_px, risk_px) of every entry under every plan."""

    def run(key, e: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i")
        cols = {k: b[k].to_numpy(float) for k in b.columns if k not in ("series_id", "i", "deal")}
        i, side = e["i"].to_numpy(np.int64), e["side"].to_numpy(np.int64)
        out = []
        for p in plans if len(e) and len(b) else ():
            at, price, risk = evaluate(p, cols, i, side)
            out.append(pd.DataFrame({"series_id": key[0], "i": i, "side": side, "plan_id": p.id, "exit_i": np.where(at < len(b), at, -1), "exit_px": price, "risk_px": risk}))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("series_id", "i", "side", "plan_id", "exit_i", "exit_px", "risk_px")})

    ddl = "series_id string, i long, side int, plan_id int, exit_i long, exit_px double, risk_px double"
    entries, bars = dealt(entries, bars, "i", each)
    out = entries.groupBy("series_id", "deal").cogroup(bars.groupBy("series_id", "deal")).applyInPandas(run, ddl)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("series_id", "i", "side", "plan_id", F.when(F.col("exit_i") >= 0, F.col("exit_i")).alias("exit_i"), clean("exit_px"), clean("risk_px"))


def dealt(work: DataFrame, bars: DataFrame, by: str, each: int) -> tuple[DataFrame, DataFrame]:
    """Work of a series in deals of about `each` rows, and the bars once for every deal."""
    n = work.groupBy("series_id").agg(F.ceil(F.count("*") / each).cast("int").alias("deals"))
    rows = work.join(n, "series_id").withColumn("deal", F.pmod(F.xxhash64(by), F.col("deals")).cast("int")).drop("deals")
    copies = bars.join(n, "series_id").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    # both may come from one table: columns get names of their own
    return rows.toDF(*rows.columns), copies.toDF(*copies.columns)
