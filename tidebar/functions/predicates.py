"""What an entry rule's algorithm means, as SQL over bars and window features.

A predicate names features; a feature is an expression over columns or other features, usually with a window. `Features` keeps each
distinct one once and knows in which layer it can be computed, so any set of rules takes as many passes over the windows as its
deepest feature, all with one sort. Texts keep to what Spark SQL and ANSI engines share; `⟦x⟧` stands for the last value of x that is
not null, which is spelt differently. Missing values are NULL; a comparison with NULL never fires.

Columns of the bars: o h l c v (prices, volume), x (the selected MACD field), hist, dif, dir (+1, -1, 0), ct (close, ms), open_ms, i
(row number in the segment from 0), minutes, and where there: ratio, delta, trades, avg_size, qv, tq_ratio, delta_quote, funding, oi,
oiv. Folds: see folds.py.
"""

from __future__ import annotations

import re

PART = "partition by series_id, segment order by ct"


class Features:
    def __init__(self):
        self.layers: list[dict[str, str]] = []
        self._known: dict[str, tuple[str, int]] = {}

    def __call__(self, sql: str) -> str:
        if sql not in self._known:
            used = [int(n) for n in re.findall(r"\bf(\d+)_\d+\b", sql)]
            layer = max(used, default=-1) + 1
            while len(self.layers) <= layer:
                self.layers.append({})
            name = f"f{layer}_{len(self.layers[layer])}"
            self.layers[layer][name] = sql
            self._known[sql] = name, layer
        return self._known[sql][0]

    # windows
    def lag(self, x: str, k: int = 1) -> str:
        return x if k == 0 else self(f"lag({x}, {k}) over ({PART})")

    def _full(self, agg: str, x: str, n: int, frame: str) -> str:
        return self(f"case when count({x}) over ({PART} {frame}) = {n} then {agg}({x}) over ({PART} {frame}) end")

    def prior(self, agg: str, x: str, n: int) -> str:
        """Over the n bars before this one; null unless all are there."""
        return self._full(agg, self(x) if not x.isidentifier() else x, n, f"rows between {n} preceding and 1 preceding")

    def recent(self, agg: str, x: str, n: int) -> str:
        """Over the last n bars, this one included."""
        return self._full(agg, self(x) if not x.isidentifier() else x, n, f"rows between {n - 1} preceding and current row")

    def all_run(self, cond: str, k: int) -> str:
        return cond if k <= 1 else f"({self.recent('sum', self(f'case when {cond} then 1 else 0 end'), k)} = {k})"

    def z(self, x: str, n: int) -> str:
        # rounded: counts meet a limit exactly, and engines differ in the last digit there
        return self(f"round(({x} - {self.prior('avg', x, n)}) / nullif({self.prior('stddev_pop', x, n)}, 0), 9)")

    def ratio(self, x: str, n: int) -> str:
        return self(f"round({x} / nullif({self.prior('avg', x, n)}, 0), 9)")

    def corr(self, a: str, b: str, n: int) -> str:
        ab = self.prior("avg", self(f"case when {a} is not null and {b} is not null then {a} * {b} end"), n)
        return self(f"({ab} - {self.prior('avg', a, n)} * {self.prior('avg', b, n)}) / {_div(f'({self.prior("stddev_pop", a, n)} * {self.prior("stddev_pop", b, n)})')}")

    def wma(self, x: str, n: int) -> str:
        return self("(" + " + ".join(f"{n - k} * {self.lag(x, k)}" for k in range(n)) + f") / {n * (n + 1) / 2}")


def _div(x: str) -> str:
    """A divisor that is null where it is as good as zero."""
    return f"case when abs({x}) > 1e-20 then {x} end"


def _up(f: Features, a: str, b: str) -> tuple[str, str]:
    """Crossing above and below."""
    pa, pb = f.lag(f(a) if not a.isidentifier() else a), f.lag(f(b) if not b.isidentifier() else b)
    return f"({a} > {b} and {pa} <= {pb})", f"({a} < {b} and {pa} >= {pb})"


def _level(f: Features, a: str, low: float, high: float) -> tuple[str, str]:
    """Coming up through the low level, going down through the high one."""
    return f"({a} >= {low} and {f.lag(a)} < {low})", f"({a} <= {high} and {f.lag(a)} > {high})"


def _both(cond: str) -> tuple[str, str]:
    return cond, cond


def _in(x: str, values) -> str:
    return f"{x} in ({', '.join(map(str, values))})"


def predicate(f: Features, algorithm: str, params: tuple[float, ...], minutes: int) -> tuple[str, str]:
    """SQL of the long and the short side, without the direction that both also need."""
    a = params[0] if params else 0
    n = int(a)
    span, lag = "(h - l)", f.lag
    safe = "nullif(h - l, 0)"
    green, red = "(c > o)", "(c < o)"
    sides = lambda x, p, q, y=None: (f"{x} {p}", f"{y or x} {q}")
    ret = f"(c / nullif({lag('c')}, 0) - 1)"
    if algorithm == "zero":
        return sides("x", "> 0", "< 0")
    if algorithm == "wick":
        return f"h > l and (h - greatest(c, o)) / {safe} <= {a}", f"h > l and (least(c, o) - l) / {safe} <= {a}"
    if algorithm == "body":
        return _both(f"h > l and abs(c - o) / {safe} >= {a}")
    if algorithm == "slope":
        ma = f.recent("avg", "c", 20)
        return sides(ma, f"> {lag(ma, n)}", f"< {lag(ma, n)}")
    if algorithm in ("distance", "distance_min"):
        d = f(f"c / nullif({f.recent('avg', 'c', 20)}, 0) - 1")
        return (f"{d} >= 0 and {d} <= {a}", f"{d} <= 0 and {d} >= -{a}") if algorithm == "distance" else sides(d, f">= {a}", f"<= -{a}")
    d1 = f(f"x - {lag('x')}") if algorithm.startswith("macd_") else ""
    d2 = f(f"{d1} - {lag(d1)}") if algorithm in ("macd_accel", "macd_accel2", "macd_decel") else ""
    if algorithm == "macd_accel":
        return sides(d2, "> 0", "< 0")
    if algorithm == "macd_accel2":
        return f"{d2} > 0 and {lag(d2)} > 0", f"{d2} < 0 and {lag(d2)} < 0"
    if algorithm == "macd_decel":
        return sides(d2, "< 0", "> 0")
    if algorithm == "macd_amp_std":
        sd = f.prior("stddev_pop", "x", 20)
        return _both(f"{sd} > 0 and abs(x) >= {a} * {sd}")
    if algorithm == "macd_slope_run":
        return f.all_run(f"{d1} > 0", n), f.all_run(f"{d1} < 0", n)
    if algorithm == "macd_z":
        return sides(f.z("x", 20), f">= {a}", f"<= -{a}")
    if algorithm == "macd_near_zero":
        return _both(f"abs({f.z('x', 20)}) <= {a}")
    if algorithm == "zero_cross_event":
        return f"x > 0 and {lag('x')} <= 0", f"x < 0 and {lag('x')} >= 0"
    if algorithm in ("dual_macd_dir", "macd_dir_disagree"):
        dh, dd = f"sign(hist - {lag('hist')})", f"sign(dif - {lag('dif')})"
        return (f"{dh} > 0 and {dd} > 0", f"{dh} < 0 and {dd} < 0") if algorithm == "dual_macd_dir" else _both(f"{dh} * {dd} < 0")
    if algorithm == "hist_sign_align":
        return sides("hist", "> 0", "< 0")
    if algorithm == "clv":
        return sides(f"(2 * c - h - l) / {safe}", f">= {a}", f"<= -{a}")
    if algorithm == "candle_align":
        return green, red
    if algorithm == "candle_body_align":
        body = f"abs(c - o) / {safe} >= {a}"
        return f"{green} and {body}", f"{red} and {body}"
    ratios = {"range_ratio": f(span), "volume_ratio": "v", "quote_volume_ratio": "qv"}
    if (m := re.fullmatch("(range_ratio|volume_ratio|quote_volume_ratio)_(min|max)", algorithm)) is not None:
        return _both(f"{f.ratio(ratios[m[1]], 20)} {'>=' if m[2] == 'min' else '<='} {a}")
    if algorithm in ("trades_ratio", "trades_ratio_max", "avg_trade_ratio", "avg_trade_ratio_max"):
        return _both(f"{f.ratio('trades' if algorithm[0] == 't' else 'avg_size', 20)} {'<=' if algorithm.endswith('max') else '>='} {a}")
    if algorithm == "momentum_run":
        return f.all_run(f"c > {lag('c')}", n), f.all_run(f"c < {lag('c')}", n)
    if algorithm == "candle_run":
        return f.all_run(green, n), f.all_run(red, n)
    if algorithm == "volume_falling":
        return _both(f.all_run(f"v < {lag('v')}", n))
    if algorithm == "donchian_break":
        return f"c > {f.prior('max', 'h', n)}", f"c < {f.prior('min', 'l', n)}"
    if algorithm == "donchian_near":
        up, dn = f.prior("max", "h", 20), f.prior("min", "l", 20)
        return f"c <= {up} and ({up} - c) / nullif({up} - {dn}, 0) <= {a}", f"c >= {dn} and (c - {dn}) / nullif({up} - {dn}, 0) <= {a}"
    if algorithm in ("boll_trend", "boll_contra"):
        mean, sd = f.recent("avg", "c", 20), f.recent("stddev_pop", "c", 20)
        up, dn = f"c >= {mean} + {a} * {sd}", f"c <= {mean} - {a} * {sd}"
        return (up, dn) if algorithm == "boll_trend" else (dn, up)
    if algorithm == "rsi_trend":
        return sides("rsi14", f">= {a}", f"<= {100 - a}")
    if algorithm == "rsi_contra":
        return sides("rsi14", f"<= {a}", f">= {100 - a}")
    if algorithm in ("efficiency_min", "efficiency_max"):
        er = f"abs(c - {lag('c', 10)}) / nullif({f.recent('sum', f(f'abs(c - {lag("c")})'), 10)}, 0)"
        return _both(f"{er} {'>=' if algorithm.endswith('min') else '<='} {a}")
    if algorithm in ("vwap_side", "vwap_distance"):
        w = 20 if algorithm == "vwap_distance" else n
        d = f(f"c / nullif({f.recent('sum', f('(h + l + c) / 3 * v'), w)} / nullif({f.recent('sum', 'v', w)}, 0), 0) - 1")
        return sides(d, ">= 0", "<= 0") if algorithm == "vwap_side" else (f"{d} >= 0 and {d} <= {a}", f"{d} <= 0 and {d} >= -{a}")
    if algorithm == "close_break":
        return f"c > {f.prior('max', 'c', n)}", f"c < {f.prior('min', 'c', n)}"
    ph, pl, po, pc = lag("h"), lag("l"), lag("o"), lag("c")
    if algorithm == "inside_break":
        inside = f"{ph} <= {lag('h', 2)} and {pl} >= {lag('l', 2)}"
        return f"{inside} and c > {lag('h', 2)}", f"{inside} and c < {lag('l', 2)}"
    if algorithm == "sweep_reclaim":
        return f"l < {pl} and c > {pl}", f"h > {ph} and c < {ph}"
    if algorithm == "micro_reversal":
        return f"{pc} < {po} and {green}", f"{pc} > {po} and {red}"
    if algorithm == "engulf":
        return f"{pc} < {po} and {green} and o <= {pc} and c >= {po}", f"{pc} > {po} and {red} and o >= {pc} and c <= {po}"
    if algorithm == "outside_align":
        return f"h > {ph} and l < {pl} and {green}", f"h > {ph} and l < {pl} and {red}"
    if algorithm == "pin_reversal":
        return f"(least(o, c) - l) / {safe} >= {a} and c >= o", f"(h - greatest(o, c)) / {safe} >= {a} and c <= o"
    if algorithm == "close_extreme":
        return f"(h - c) / {safe} <= {a}", f"(c - l) / {safe} <= {a}"
    if algorithm == "doji_break":
        doji = f"abs({pc} - {po}) / nullif({ph} - {pl}, 0) <= {a}"
        return f"{doji} and c > {ph}", f"{doji} and c < {pl}"
    if algorithm in ("nr_n", "wr_n"):
        s = f(span)
        return _both(f"{s} <= {f.prior('min', s, n - 1)}" if algorithm == "nr_n" else f"{s} >= {f.prior('max', s, n - 1)}")
    if algorithm in ("return2_min", "return5_min", "return5_contra"):
        r = f"(c / nullif({lag('c', int(algorithm[6]))}, 0) - 1)"
        return sides(r, f"<= -{a}", f">= {a}") if algorithm.endswith("contra") else sides(r, f">= {a}", f"<= -{a}")
    if algorithm == "two_bar_reversal":
        mid = f"({ph} + {pl}) / 2"
        return f"{pc} < {po} and {green} and c > {mid}", f"{pc} > {po} and {red} and c < {mid}"
    if algorithm == "failed_break_strong":
        return f"l < {pl} and c > {ph}", f"h > {ph} and c < {pl}"
    if algorithm == "alternating":
        s = f("sign(c - o)")
        turns = " and ".join(f"{lag(s, k)} <> 0 and {lag(s, k)} <> {s}" for k in range(1, n))
        return f"{turns} and {s} > 0", f"{turns} and {s} < 0"
    if algorithm in ("atr_regime_low", "atr_regime_high", "rv_regime_low", "rv_regime_high", "boll_width_low", "boll_width_high"):
        if algorithm[0] == "a":
            y = "atr14"
        elif algorithm[0] == "r":
            y = f.recent("stddev_pop", f(f"case when c > 0 and {pc} > 0 then ln(c / {pc}) end"), 10)
        else:
            y = f(f"4.0 * {f.recent('stddev_pop', 'c', 20)} / nullif({f.recent('avg', 'c', 20)}, 0)")
        return _both(f"{f.ratio(y, 60)} {'<=' if algorithm.endswith('low') else '>='} {a}")
    true_range = f"case when {pc} is not null then greatest(h - l, abs(h - {pc}), abs(l - {pc})) end"
    if algorithm == "tr_z_high":
        return _both(f"{f.z(f(true_range), 20)} >= {a}")
    if algorithm in ("volume_z_high", "volume_z_low"):
        return _both(f"{f.z('v', 20)} {f'>= {a}' if algorithm.endswith('high') else f'<= -{a}'}")
    if algorithm == "trades_z_high":
        return _both(f"{f.z('trades', 20)} >= {a}")
    if algorithm == "taker_ratio":
        return sides("ratio", f">= {a}", f"<= {round(1 - a, 10)}")
    if algorithm == "taker_contra":
        return sides("ratio", f"<= {round(1 - a, 10)}", f">= {a}")
    if algorithm == "taker_z":
        return sides(f.z("ratio", 60), f">= {a}", f"<= -{a}")
    if algorithm == "delta_z_side":
        return sides(f.z("delta", 60), f">= {a}", f"<= -{a}")
    if algorithm == "delta_side":
        return sides("delta", "> 0", "< 0")
    if algorithm == "cvd_slope":
        return sides(f.recent("sum", "delta", n), "> 0", "< 0")
    if algorithm == "price_cvd_div":
        s = f.recent("sum", "delta", n)
        return f"c < {lag('c', n)} and {s} > 0", f"c > {lag('c', n)} and {s} < 0"
    if algorithm == "flow_candle_align":
        return f"{green} and delta > 0", f"{red} and delta < 0"
    if algorithm == "flow_absorption":
        return f"l < {pl} and c > {pl} and delta < 0", f"h > {ph} and c < {ph} and delta > 0"
    if algorithm == "funding_contra":
        return sides("funding", f"<= -{a}", f">= {a}")
    if algorithm == "funding_align":
        return sides("funding", "> 0", "< 0")
    if algorithm == "funding_flip_contra":
        p = lag("funding")
        return f"{p} >= 0 and funding < 0", f"{p} <= 0 and funding > 0"
    ago = lambda x, m: f"case when {m} % {minutes} = 0 and ct - {lag('ct', max(1, m // minutes))} = {m * 60000} then {lag(x, max(1, m // minutes))} end"
    if algorithm in ("oi_change_min", "oi_change60_min", "oi_change_max", "oi_expand_confirm", "price_oi_squeeze", "oi_delever_trend", "oi_value_change_min"):
        m = 60 if algorithm == "oi_change60_min" else 15
        x = "oiv" if algorithm == "oi_value_change_min" else "oi"
        change, past = f(f"{x} / nullif({ago(x, m)}, 0) - 1"), f(ago("c", m))
        if algorithm == "price_oi_squeeze":
            return f"c < {past} and {change} >= {a}", f"c > {past} and {change} >= {a}"
        if algorithm == "oi_delever_trend":
            return f"c > {past} and {change} <= -{a}", f"c < {past} and {change} <= -{a}"
        return _both(f"{change} {'<=' if algorithm == 'oi_change_max' else '>='} {a}")
    if algorithm == "oi_z_high":
        bars = max(1, 60 // minutes)
        return _both(f"{f.z('oi', bars)} >= {a} and ct - {lag('ct', bars)} = 3600000")
    if algorithm == "taker_quote_ratio":
        return sides("tq_ratio", f">= {a}", f"<= {round(1 - a, 10)}")
    if algorithm == "quote_delta_side":
        return sides("delta_quote", "> 0", "< 0")
    placebo = {
        "minute_tail7": "minute_ % 10 = 7", "price_tail78": "cents_ % 10 in (7, 8)", "minute_fib": _in("minute_", (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)),
        "minute_mod5": "minute_ % 5 = 0", "minute_prime": _in("minute_", (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59)),
        "hour_odd": "hour_ % 2 = 1", "hour_fib": _in("hour_", (0, 1, 2, 3, 5, 8, 13, 21)), "price_integer_tail7": "cast(floor(abs(c)) as bigint) % 10 = 7",
        "price_cents_0050": "cents_ in (0, 50)", "volume_tail7": "cast(floor(abs(v)) as bigint) % 10 = 7", "trades_odd": "cast(floor(trades) as bigint) % 2 = 1",
        "time_price_match": "minute_ = cents_ % 60", "time_hash20": "(epoch_minute_ * 1103515245 + 12345) % 100 < 20", "minute_mod13": "minute_ % 13 = 0",
        "minute_13_37": "minute_ in (13, 37)", "minute_double": _in("minute_", range(0, 60, 11)), "day_hour_match": "day_ % 24 = hour_",
        "price_cents_special": "cents_ in (13, 42, 69)", "avg_size_tail7": "cast(floor(abs(avg_size) * 1000000 + 1e-9) as bigint) % 10 = 7",
    }
    if algorithm in placebo:
        return _both(placebo[algorithm])
    return _family(f, algorithm, params, ret) if params else _third(f, algorithm)


def _family(f: Features, algorithm: str, params: tuple[float, ...], ret: str) -> tuple[str, str]:
    lag = f.lag
    n, b = int(params[0]), params[-1]
    change = f(f"c - {lag('c')}")
    ret, ap = f(ret), lag("atr14")
    if algorithm == "kama":
        k = f"kama{n}"
        return f"{k} > {lag(k)} and c > {k} + {b} * atr14", f"{k} < {lag(k)} and c < {k} - {b} * atr14"
    if algorithm == "dema":
        return _up(f, "c", f(f"2 * ema{n}_1 - ema{n}_2"))
    if algorithm == "tema":
        z = f(f"3 * ema{n}_1 - 3 * ema{n}_2 + ema{n}_3")
        d = f(f"{z} - {lag(z)}")
        return f"c > {z} and {d} > 0 and {d} > {lag(d)}", f"c < {z} and {d} < 0 and {d} < {lag(d)}"
    if algorithm == "trix":
        r = f(f"(ema{n}_3 - {lag(f'ema{n}_3')}) / {_div(lag(f'ema{n}_3'))}")
        return f"{r} > 0 and {lag(r)} <= 0", f"{r} < 0 and {lag(r)} >= 0"
    if algorithm == "hma":
        z = f.wma(f(f"2 * {f.wma('c', n // 2)} - {f.wma('c', n)}"), int(n**0.5))
        return f"{z} > {lag(z)} and c > {z}", f"{z} < {lag(z)} and c < {z}"
    if algorithm in ("reg_reentry", "reg_t"):
        y = "c" if algorithm == "reg_reentry" else f("case when c > 0 then ln(c) end")
        sx, xx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6 - (n * (n - 1) / 2) ** 2 / n
        sy, sxy = f.prior("sum", y, n), f(f"{f.prior('sum', f(f'i * {y}'), n)} - (i - {n}) * {f.prior('sum', y, n)}")
        slope = f(f"({sxy} - {sx} * {sy} / {n}) / {xx}")
        sse = f"greatest({f.prior('stddev_pop', y, n)} * {f.prior('stddev_pop', y, n)} * {n} - {slope} * {slope} * {xx}, 0)"
        se = f(f"sqrt({sse} / {n - 2})")
        if algorithm == "reg_t":
            t = f(f"case when {se} > 1e-12 then {slope} * {xx**0.5} / {se} end")
            return f"{t} > {b} and {change} > 0", f"{t} < -{b} and {change} < 0"
        r = f(f"(c - (({sy} - {slope} * {sx}) / {n} + {slope} * {n})) / {_div(se)}")
        return _level(f, r, -b, b)
    if algorithm == "rank_reentry":
        below = " + ".join(f"case when {lag('c', k)} < c then 1.0 when {lag('c', k)} = c then 0.5 else 0.0 end" for k in range(1, n + 1))
        r = f(f"case when i >= {n} then ({below}) / {n} end")
        return _level(f, r, b, round(1 - b, 10))
    if algorithm == "stoch":
        lo, hi = f.recent("min", "l", n), f.recent("max", "h", n)
        k = f(f"100 * (c - {lo}) / {_div(f'({hi} - {lo})')}")
        up, dn = _up(f, k, f.recent("avg", k, 3))
        return f"{up} and {lag(k)} < {b}", f"{dn} and {lag(k)} > {100 - b}"
    if algorithm == "cci":
        tp = f("(h + l + c) / 3")
        mean = f.recent("avg", tp, n)
        mad = f("(" + " + ".join(f"abs({lag(tp, k)} - {mean})" for k in range(n)) + f") / {n}")
        return _level(f, f(f"({tp} - {mean}) / {_div(f'(0.015 * {mad})')}"), -b, b)
    if algorithm == "dmi":
        up, dn = _up(f, f"pdi{n}", f"mdi{n}")
        return f"{up} and adx{n} >= {b}", f"{dn} and adx{n} >= {b}"
    if algorithm == "aroon":
        hi, lo = f.recent("max", "h", n), f.recent("min", "l", n)
        since = lambda x, y: "case " + " ".join(f"when {lag(x, k)} = {y} then {k}" for k in range(n)) + " end"
        a = f(f"100.0 * (({since('l', lo)}) - ({since('h', hi)})) / {n - 1}")
        return f"{a} > {b} and {change} > 0", f"{a} < -{b} and {change} < 0"
    if algorithm == "ha_turn":
        s, k = f"ha{n}", int(b)
        return f"{f.all_run(f'{s} > 0', k)} and {lag(s, k)} < 0", f"{f.all_run(f'{s} < 0', k)} and {lag(s, k)} > 0"
    if algorithm == "pv_corr":
        r = f.corr(ret, f(f"(v - {lag('v')}) / {_div(lag('v'))}"), n)
        return f"{r} >= {b} and {change} > 0 and v > {lag('v')}", f"{r} <= -{b} and {change} < 0 and v > {lag('v')}"
    if algorithm == "volume_absorb":
        good = f"v >= {params[0]} * {f.prior('avg', 'v', 20)} and abs({change}) <= {b} * {ap}"
        return f"{good} and c > (h + l) / 2 and least(c, o) - l >= abs(c - o)", f"{good} and c < (h + l) / 2 and h - greatest(c, o) >= abs(c - o)"
    if algorithm == "mfi":
        tp = f("(h + l + c) / 3")
        pos = f.recent("sum", f(f"case when {tp} > {lag(tp)} then {tp} * v else 0 end"), n)
        neg = f.recent("sum", f(f"case when {tp} < {lag(tp)} then {tp} * v else 0 end"), n)
        return _level(f, f(f"100 * {pos} / {_div(f'({pos} + {neg})')}"), b, 100 - b)
    if algorithm == "chaikin":
        co = f"chaikin{n}_{int(b)}"
        return f"{co} > 0 and {lag(co)} <= 0", f"{co} < 0 and {lag(co)} >= 0"
    if algorithm == "semivar":
        pos = f.prior("sum", f(f"case when {ret} > 0 then {ret} * {ret} else 0 end"), n)
        neg = f.prior("sum", f(f"case when {ret} < 0 then {ret} * {ret} else 0 end"), n)
        return f"{pos} > {b} * {neg} and {change} > 0", f"{neg} > {b} * {pos} and {change} < 0"
    if algorithm == "autocorr":
        p = lag(ret)
        good = f"{f.corr(ret, p, n)} < -{b}"
        return f"{good} and {p} < 0 and {ret} > 0", f"{good} and {p} > 0 and {ret} < 0"
    if algorithm == "skew":
        m, m2, m3 = f.prior("avg", ret, n), f.prior("avg", f(f"{ret} * {ret}"), n), f.prior("avg", f(f"{ret} * {ret} * {ret}"), n)
        var = f(f"{m2} - {m} * {m}")
        s = f(f"case when {var} > 1e-14 then {(n * (n - 1)) ** 0.5 / (n - 2)} * ({m3} - 3 * {m} * {m2} + 2 * {m} * {m} * {m}) / ({var} * sqrt({var})) end")
        return f"{s} < -{b} and {ret} > 0", f"{s} > {b} and {ret} < 0"
    if algorithm == "park_release":
        spread = f("case when l > 0 and h > 0 then ln(h / l) end")  # a bar without a price has no spread
        q = f.recent("avg", f(f"{spread} * {spread} / (4 * ln(2.0))"), n)
        r = f(f"{q} / {_div(f.prior('avg', q, 60))}")
        good = f"{r} > {b} and {lag(r)} <= {b}"
        return f"{good} and c > o", f"{good} and c < o"
    if algorithm == "squeeze_break":
        sd = f.recent("stddev_pop", "c", n)
        good = f"{lag(sd)} < {b} * {f.prior('avg', sd, 120)}"
        return f"{good} and c > {f.prior('max', 'h', n)}", f"{good} and c < {f.prior('min', 'l', n)}"
    if algorithm == "daily_pivot":
        k, b = int(params[1]), params[0]
        p = "pivot_"
        same = f"day_ = {lag('day_', k)}"
        return f"{f.all_run(f'c > {p} + {b} * {ap}', k)} and {lag('c', k)} <= {lag(p, k)} and {same}", f"{f.all_run(f'c < {p} - {b} * {ap}', k)} and {lag('c', k)} >= {lag(p, k)} and {same}"
    if algorithm == "opening_range":
        hi, lo, pp = f"or_hi{n}", f"or_lo{n}", lag(ap)
        late = f"day_minute_ >= {n}"
        return f"{late} and c > {hi} + {b} * {ap} and {lag('c')} <= {hi} + {b} * {pp}", f"{late} and c < {lo} - {b} * {ap} and {lag('c')} >= {lo} - {b} * {pp}"
    if algorithm == "range_reclaim":
        lo, hi = f.prior("min", "l", n), f.prior("max", "h", n)
        return f"l < {lo} - {b} * {ap} and c > {lo}", f"h > {hi} + {b} * {ap} and c < {hi}"
    if algorithm == "impulse_pullback":
        move = f(f"{lag('c', 2)} - {lag('c', n + 2)}")
        good = f"{lag('v')} <= {b} * {lag(f.prior('avg', 'v', 20))}"
        return f"{move} > {lag('atr14', 2)} and {lag('c')} < {lag('c', 2)} and {good} and c > {lag('h')}", f"{move} < -{lag('atr14', 2)} and {lag('c')} > {lag('c', 2)} and {good} and c < {lag('l')}"
    if algorithm == "scale_div":
        short, long = f(f"c - {lag('c', n)}"), f(f"c - {lag('c', int(b))}")
        return f"{long} > 0 and {short} > 0 and {lag(short)} <= 0", f"{long} < 0 and {short} < 0 and {lag(short)} >= 0"
    if algorithm == "trade_intensity":
        y = f("trades / case when abs((h - l) / nullif(c, 0)) > 1e-20 then (h - l) / c end")
        good = f"{y} >= {b} * {f.prior('avg', y, n)}"
        return f"{good} and c >= l + 0.75 * (h - l) and c > o", f"{good} and c <= l + 0.25 * (h - l) and c < o"
    if algorithm == "flow_accel":
        flow = f(f"{f.recent('sum', 'delta', n)} / {_div(f.recent('sum', 'v', n))}")
        z = f.z(flow, 20)
        return f"{flow} > 0 and {z} > {b} and {flow} > {lag(flow)}", f"{flow} < 0 and {z} < -{b} and {flow} < {lag(flow)}"
    if algorithm == "flow_residual":
        x = f(f"delta / {_div('v')}")
        mx, my, sx, sy = f.prior("avg", x, n), f.prior("avg", ret, n), f.prior("stddev_pop", x, n), f.prior("stddev_pop", ret, n)
        cov = f(f"{f.prior('avg', f(f'{x} * {ret}'), n)} - {mx} * {my}")
        slope = f(f"{cov} / {_div(f'({sx} * {sx})')}")
        se = f(f"sqrt(greatest({sy} * {sy} - {slope} * {cov}, 0))")
        r = f(f"({ret} - ({my} - {slope} * {mx} + {slope} * {x})) / {_div(se)}")
        up, dn = _level(f, r, -b, b)
        return f"{up} and {x} > 0", f"{dn} and {x} < 0"
    raise ValueError(f"no such algorithm: {algorithm}")


#: What a trade is taken to cost, as a share.
COST = 0.0001


def _edge(f: Features, cond: str) -> str:
    """Where a condition begins to hold."""
    x = f(f"case when {cond} then 1 else 0 end")
    return f"({x} = 1 and coalesce({f.lag(x)}, 0) = 0)"


def _third(f: Features, algorithm: str) -> tuple[str, str]:
    """Algorithms of the third catalogue that need only windows. They have a direction of their own."""
    lag = f.lag
    r, d = f(f"case when c > 0 and {lag('c')} > 0 then ln(c) - ln({lag('c')}) end"), f(f"delta / {_div('v')}")
    change = f(f"c - {lag('c')}")
    if algorithm == "t023":  # the drift of 30 bars, with its bound from the spread of the 240 before, beyond the cost
        sigma = f.prior("stddev_pop", r, 240)
        m, bound = f(f"{f.recent('sum', r, 30)} / 60"), f(f"1.6448536269514722 * {sigma} / sqrt(60.0)")
        return _edge(f, f"{sigma} > 0 and {m} - {bound} > {COST / 10!r} and {r} > 0"), _edge(f, f"{sigma} > 0 and {m} + {bound} < -{COST / 10!r} and {r} < 0")
    if algorithm == "t070":  # the price moves less for the same flow than it did
        def slope(n: int) -> str:
            cov = f"{f.prior('avg', f(f'{d} * {r}'), n)} - {f.prior('avg', d, n)} * {f.prior('avg', r, n)}"
            sd = f.prior("stddev_pop", f(f"case when {r} is not null then {d} end"), n)
            return f(f"({cov}) / {_div(f'({sd} * {sd})')}")

        short, long = slope(30), lag(slope(120), 30)
        collapse = f"{long} > 0 and {short} < 0.3 * {long}"
        return f"{collapse} and {f.all_run('delta < 0', 3)} and {change} > 0 and c > {lag('h')}", f"{collapse} and {f.all_run('delta > 0', 3)} and {change} < 0 and c < {lag('l')}"
    if algorithm == "t072":  # flow gathers on one side after it was spread
        total = _div(f.recent("sum", "v", 60))
        p, q = (f(f"{f.recent('sum', f(f'case when {d} {side} then v else 0 end'), 60)} / {total}") for side in ("> 0.1", "< -0.1"))
        part = lambda x: f"case when {x} > 0 then -({x}) * ln({x}) else 0 end"
        e = f(f"({part(p)} + {part(q)} + {part(f'(1 - {p} - {q})')}) / ln(3.0)")
        cross = f"{p} is not null and {e} < 0.7 and {lag(e)} > 0.9"
        return f"{cross} and {p} > 0.7", f"{cross} and {q} > 0.7"
    if algorithm == "t096":  # records come faster than they did, none on the other side; the first of each such stretch
        out = []
        hit = {s: f(f"case when c {op} {f.prior(agg, 'c', 60)} then 1 else 0 end") for s, op, agg in ((1, ">", "max"), (-1, "<", "min"))}
        for s in (1, -1):
            recent, older, other = f.recent("sum", hit[s], 20), lag(f.recent("sum", hit[s], 60), 20), f.recent("sum", hit[-s], 20)
            on = f(f"case when i >= 139 and {recent} / 20.0 > 3 * ({older} + 1) / 60.0 and {recent} >= 3 and {other} = 0 then 1 else 0 end")
            stretch = f(f"sum(case when {on} = 0 then 1 else 0 end) over ({PART})")
            nth = f(f"sum({on} * {hit[s]}) over (partition by series_id, segment, {stretch} order by ct)")
            out.append(f"({on} = 1 and {hit[s]} = 1 and {nth} = 1)")
        return out[0], out[1]
    raise ValueError(f"no such algorithm: {algorithm}")
