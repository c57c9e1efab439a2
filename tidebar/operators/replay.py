"""Accounts replayed over the bars: one path for each configuration and leverage, in order, in one task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..core import MINUTE
from ..functions import paths as P
from .exits import MOVING, Plan, combine_targets, dealt, evaluate, hit, merge_stops, moving

NEVER = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Account:
    leverage: float = 1.0
    initial: float = 1000.0
    cap: float = 1e12
    least_quantity: float = 0.0
    enforce_least: bool = False
    slippage: float = 0.0
    fee: float = 0.0
    funding: float = 0.0
    protection: float = 1.0
    cross_margin: bool = False
    maintenance: float = 0.005
    cooldown: int = 0
    least_gap: int = 0
    close_confirmed: bool = False
    bar_minutes: int = 1


@dataclass
class Result:
    """Sums over an account's trades; profit and loss are sums of net returns, money stands in equity alone."""

    trades: int = 0
    wins: int = 0
    longs: int = 0
    orders: int = 0
    hold_minutes: int = 0
    wait_minutes: int = 0
    sum_ret: float = 0.0
    sum_sq: float = 0.0
    profit: float = 0.0
    loss: float = 0.0
    protections: int = 0
    forced: int = 0
    stopped: bool = False
    max_drawdown: float = 0.0
    equity: float = 0.0
    first_capacity_ms: int | None = None
    by_year: dict[int, float] = field(default_factory=dict)


@dataclass(frozen=True)
class ExitPath:
    """Exit place and price of each candidate, whether that is a target, and where and at what price a first part was closed before."""

    at: np.ndarray
    price: np.ndarray
    profit: np.ndarray
    part_at: np.ndarray
    part_price: np.ndarray
    share: float = 0.0


def exit_plan(bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray, stops: list[Plan], targets: list[Plan], first: Plan | None = None, share: float = 0.5) -> ExitPath:
    """The exit of each candidate; it does not depend on leverage. A stop on the target's bar goes first.

    Targets that move with the price run beside the fixed ones: the earlier ends the trade, the moving one on a tie. With `first`, a
    target that closes `share` of the position, the one target given rules what is left from the next bar on."""
    nan, never = np.full(len(i), np.nan), np.full(len(i), NEVER)
    none = never, nan, nan
    sa, sp, risk = merge_stops([evaluate(p, bars, i, side) for p in stops], side, [p.intrabar for p in stops]) if stops else none
    last = len(bars["c"]) - 1
    if first is not None:
        if len(targets) != 1:
            raise ValueError("a position that is closed in parts has one target for the rest")
        part_at, part_price, _ = evaluate(first, bars, i, side)
        done = part_at < sa
        part_at, part_price = np.where(done, part_at, NEVER), np.where(done, part_price, np.nan)
        ta, tp = _rest(targets[0], bars, i, side, part_at, last)
    else:
        part_at, part_price = never, nan
        plain = [_risk(p, bars, i, side, risk) if p.kind == "risk" else evaluate(p, bars, i, side) for p in targets if p.kind not in MOVING]
        ta, tp, _ = combine_targets(plain, side) if plain else none
        for p in targets:
            if p.kind in MOVING:
                a, x, _ = evaluate(p, bars, i, side)
                take = a <= ta
                ta, tp = np.where(take, a, ta), np.where(take, x, tp)
    profit = ta < sa
    at, price = np.where(profit, ta, sa), np.where(profit, tp, sp)
    clipped = at > last
    return ExitPath(np.where(clipped, last, at), np.where(clipped, bars["c"][last], price), profit & ~clipped, part_at, part_price, share if first is not None else 0.0)


def _risk(plan: Plan, bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray, risk: np.ndarray):
    """A target so many times as far from the entry as the stop's risk level; none where that level is not on the losing side."""
    price = bars["c"][i]
    level = price + (price - risk) * plan.a
    level = np.where((level - price) * side > 0, level, np.nan)
    return *hit(bars, i, side, level, False), np.full(len(i), np.nan)


def _rest(plan: Plan, bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray, part_at: np.ndarray, last: int):
    """Where the rest of a position ends that was closed in part at part_at: its target begins anew on the bar after."""
    ta, tp = np.full(len(i), NEVER), np.full(len(i), np.nan)
    for k in np.flatnonzero(part_at <= last):
        j, s, price = int(part_at[k]), int(side[k]), bars["c"][i[k]]
        if plan.kind in MOVING:
            found = moving(plan, bars, int(i[k]), s, j)
        elif plan.kind == "reversal":
            x = int(P.first_profitable(bars["c"], bars["event"] == -s, np.array([j + 1]), np.array([price]), np.array([s]))[0])
            found = (x, bars["c"][x]) if x <= last else None
        else:
            raise ValueError(f"no target for the rest of a position: {plan.kind}")
        if found is not None:
            ta[k], tp[k] = found
    return ta, tp


def _walk(high: np.ndarray, low: np.ndarray, close: np.ndarray, entry: float, s: int, part: int, part_ret: float, share: float, fee: float):
    """Returns of an open position bar by bar, before its last exit: at the adverse extreme and at the close, each less the fees paid.

    `part`: the bar (from 0) on which a share was closed; it counts for that bar's close and for everything after."""
    n = np.arange(len(close))
    out = []
    for price, gone in ((low if s == 1 else high, n > part), (close, n >= part)):
        left, got = np.where(gone, 1 - share, 1.0), np.where(gone, share * part_ret, 0.0)
        out.append(got + left * (price / entry - 1) * s - fee - np.where(gone, share * (1 + s * part_ret) * fee, 0.0))
    return out


def replay(bars: dict[str, np.ndarray], i: np.ndarray, side: np.ndarray, run: np.ndarray, plan: ExitPath, a: Account) -> Result:
    """Candidates in time order, one position at a time, one trade for each run of signals.

    Equity bears the opening fee at once. From the bar after the entry on, a position is marked at the adverse extreme less the fees
    paid; where that loss reaches the limit (protection, or liquidation where margin is shared and it comes first) the trade ends there,
    at the price that uses the limit up. Fees are on what is traded at each leg, slippage is taken once from the return; a liquidation
    loses everything. The peak rises only with closes."""
    r = Result(equity=a.initial)
    c, hi, lo, ct = bars["c"], bars["h"], bars["l"], bars["ct"].astype(np.int64)
    equity, peak, ready, used, n = a.initial, a.initial, -1, None, len(bars["c"])
    settled = ct // (480 * MINUTE)
    for k in range(len(i)):
        entry, s, end = int(i[k]), int(side[k]), int(plan.at[k])
        if entry < ready or run[k] == used:
            continue
        price0 = c[entry]
        quantity = min(equity * a.leverage / price0, a.cap)
        if equity <= 0 or a.enforce_least and quantity < a.least_quantity:
            r.stopped = True
            break
        if end <= entry:
            continue
        if quantity >= a.cap and r.first_capacity_ms is None:
            r.first_capacity_ms = int(ct[entry])
        effective = quantity * price0 / equity
        parted = plan.share > 0 and plan.part_at[k] < end
        part = int(plan.part_at[k]) if parted else NEVER
        part_ret = s * ((c[part] if a.close_confirmed else plan.part_price[k]) / price0 - 1) if parted else 0.0
        raw = s * ((c[end] if a.close_confirmed else plan.price[k]) / price0 - 1)
        if parted:
            raw = plan.share * part_ret + (1 - plan.share) * raw
        took, orders = parted if plan.share > 0 else bool(plan.profit[k]), 3 if parted else 2
        limit, liquid = a.protection, False
        if a.cross_margin and (all_gone := max(0.0, 1 - effective * a.maintenance)) <= limit:
            limit, liquid = all_gone, True
        opened = max(0.0, equity * (1 - effective * a.fee))
        r.max_drawdown = max(r.max_drawdown, 1 - opened / peak)
        path = slice(entry + 1, end + 1)
        worst, closing = _walk(hi[path], lo[path], c[path], price0, s, part - entry - 1 if parted else NEVER, part_ret, plan.share, a.fee)
        broke = np.flatnonzero(-effective * worst >= limit)
        saved = len(broke) > 0
        if saved:
            stop = int(broke[0])
            end, took = entry + 1 + stop, False
            orders = 3 if parted and end > part else 2
            paid = a.fee + (plan.share * (1 + s * part_ret) * a.fee if parted and end > part else 0.0)
            raw = -limit / effective + paid
            worst, closing = worst[:stop], closing[:stop]
        else:
            closing = closing[:-1]
        if len(worst):
            low_eq = np.maximum(0.0, equity * (1 + effective * worst))
            close_eq = np.maximum(0.0, equity * (1 + effective * closing))
            peaks = np.maximum.accumulate(np.append(peak, close_eq))
            r.max_drawdown = max(r.max_drawdown, float(np.max(1 - low_eq / peaks[: len(low_eq)])))
            if len(close_eq):
                r.max_drawdown = max(r.max_drawdown, float(np.max(1 - close_eq / peaks[: len(close_eq)])))
            peak = float(peaks[-1])
        net = -1 / effective if saved and liquid else raw - a.slippage - a.fee - a.fee * (1 + s * raw)
        if a.funding:
            net -= a.funding * (settled[end] - settled[entry])
        equity = 0.0 if saved and liquid else float(np.clip(equity * (1 + effective * net), 0, 1e300))
        r.max_drawdown = max(r.max_drawdown, 1 - equity / peak)
        peak = max(peak, equity)
        r.trades += 1
        r.orders += orders
        r.wins += net > 0
        r.longs += s == 1
        r.sum_ret += net
        r.sum_sq += net * net
        r.profit += max(net, 0.0)
        r.loss += max(-net, 0.0)
        r.protections += saved and not liquid
        r.forced += saved and liquid
        year = int(np.datetime64(int(ct[end]), "ms").astype("datetime64[Y]").astype(int)) + 1970
        r.by_year[year] = r.by_year.get(year, 0.0) + net
        r.hold_minutes += a.bar_minutes * (end - entry)
        if took:
            r.wait_minutes += a.bar_minutes * min(a.cooldown, n - 1 - end)
        used, ready = run[k], max(end + (a.cooldown if took else 0) + 1, end + a.least_gap)
        if equity <= 0:
            r.stopped = True
            break
    if a.enforce_least and n and min(equity * a.leverage / c[-1], a.cap) < a.least_quantity:
        r.stopped = True
    r.equity = equity
    return r


RESULT_DDL = (
    "config_id long, series_id string, accounts array<struct<leverage double, trades int, wins int, long_share double, orders int, hold_minutes long, wait_minutes long, sum_ret double, "
    "sum_sq double, profit double, loss double, protections int, forced int, stopped boolean, max_drawdown double, final_equity double, first_capacity_ms long, by_year map<int,double>>>"
)


def _row(r: Result, a: Account) -> dict:
    return {
        "leverage": a.leverage, "trades": r.trades, "wins": int(r.wins), "long_share": r.longs / r.trades if r.trades else None, "orders": r.orders, "hold_minutes": int(r.hold_minutes), "wait_minutes": int(r.wait_minutes),
        "sum_ret": float(r.sum_ret), "sum_sq": float(r.sum_sq), "profit": float(r.profit), "loss": float(r.loss), "protections": int(r.protections), "forced": int(r.forced), "stopped": r.stopped,
        "max_drawdown": float(r.max_drawdown), "final_equity": float(r.equity), "first_capacity_ms": r.first_capacity_ms, "by_year": {int(k): float(v) for k, v in r.by_year.items()},
    }


#: Bars are sent to every task up to this many bytes; a longer series is brought to its configurations by a cogroup.
BROADCAST_BYTES = 64 << 20
#: Configurations of a series that one task takes beyond that; each such deal comes with the bars.
CONFIGURATIONS = 512


def replay_grid(configs: DataFrame, bars: DataFrame, entries: DataFrame, stops: dict[int, list[Plan]], targets: dict[int, list[Plan]], base: Account, bar_columns: tuple[str, ...] = ("ct", "o", "h", "l", "c", "atr14"), firsts: dict[int, Plan] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Results of configs (config_id, series_id, rule_id, stop_id, target_id, leverages) over bars and entries (series_id, rule_id, i, side, run).

    firsts: by target_id, the target that closes half of a position before the target itself. The exit plan of a configuration is made
    once and shared by its leverages. Configurations are dealt evenly over the tasks."""

    def one(cfg: dict, cols: dict[str, np.ndarray], e: pd.DataFrame) -> dict:
        i, side, run = (e[k].to_numpy(np.int64) for k in ("i", "side", "run"))
        plan = exit_plan(cols, i, side, stops.get(cfg["stop_id"], []), targets.get(cfg["target_id"], []), (firsts or {}).get(cfg["target_id"]))
        accounts = []
        for x in cfg["leverages"]:
            a = Account(**{**base.__dict__, "leverage": float(x)})
            accounts.append(_row(replay(cols, i, side, run, plan, a), a))
        return {"config_id": cfg["config_id"], "series_id": cfg["series_id"], "accounts": accounts}

    spark = configs.sparkSession
    size = bars.count() * 8 * len(bar_columns) + entries.count() * 32
    if size <= broadcast_bytes:
        held = {k: {c: g.sort_values("i")[c].to_numpy(float) for c in bar_columns} for k, g in bars.select("series_id", "i", *bar_columns).toPandas().groupby("series_id")}
        cand = {k: g.sort_values("i") for k, g in entries.select("series_id", "rule_id", "i", "side", "run").toPandas().groupby(["series_id", "rule_id"])}
        shared = spark.sparkContext.broadcast((held, cand))
        nothing = pd.DataFrame({"i": [], "side": [], "run": []})

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, candidates = shared.value
            for part in parts:
                yield pd.DataFrame([one(c, known[c["series_id"]], candidates.get((c["series_id"], c["rule_id"]), nothing)) for c in part.to_dict("records")], columns=["config_id", "series_id", "accounts"])

        return configs.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(run, RESULT_DDL)

    from pyspark.sql import functions as F

    by_rule = entries.groupBy("series_id", "rule_id").agg(F.sort_array(F.collect_list(F.struct("i", "side", "run"))).alias("cand"))
    own, bars = dealt(configs.join(by_rule, ["series_id", "rule_id"], "left"), bars.select("series_id", "i", *bar_columns), "config_id", CONFIGURATIONS)

    def group(key, cfgs: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i")
        cols = {c: b[c].to_numpy(float) for c in bar_columns}
        rows = [one(c, cols, pd.DataFrame([dict(i=x["i"], side=x["side"], run=x["run"]) for x in (c["cand"] if c["cand"] is not None else [])], columns=["i", "side", "run"])) for c in cfgs.to_dict("records")]
        return pd.DataFrame(rows, columns=["config_id", "series_id", "accounts"])

    return own.groupBy("series_id", "deal").cogroup(bars.groupBy("series_id", "deal")).applyInPandas(group, RESULT_DDL)
