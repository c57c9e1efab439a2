"""Rules held against plain definitions, bar by bar and without windows: one function for each algorithm of the single rules."""

import math
import random

import numpy as np
import pytest

from tidebar.catalog.market import HAVE
from tidebar.functions import folds
from tidebar.operators import signals
from tidebar.operators.signals import day_levels
from tidebar.operators.state import with_direction
from tidebar.plans import rules as R

MINUTES = 60


@pytest.fixture(scope="module")
def bars(spark):
    r = random.Random(77)
    rows, c = [], 100.0
    for k in range(420):
        o = c if r.random() < 0.7 else round(c * (1 + r.gauss(0, 0.002)), 2)
        c = round(o * math.exp(r.gauss(0, 0.012)), 2) if r.random() < 0.95 else o
        h, low = round(max(o, c) + abs(r.gauss(0, 0.5)), 2), round(min(o, c) - abs(r.gauss(0, 0.5)), 2)
        if r.random() < 0.03:
            h = low = c = o
        v = float(r.randint(1, 400))
        buy = round(v * r.random(), 3)
        trades = float(r.randint(1, 60))
        qv = round(v * c, 4)
        oi = 1000 + 10 * r.gauss(0, 1)
        rows.append(("s", k * 3_600_000, (k + 1) * 3_600_000, o, h, low, c, v, qv, trades, buy / v, 2 * buy - v, v / trades, r.random(), r.gauss(0, 50), oi, oi * c, round(r.gauss(0, 0.0004), 6), 0, k))
    names = "series_id string, open_ms long, ct long, o double, h double, l double, c double, v double, qv double, trades double, ratio double, delta double, avg_size double, tq_ratio double, delta_quote double, oi double, oiv double, funding double, segment int, i int"
    return day_levels(with_direction(folds.with_folds(spark.createDataFrame(rows, names)), "x", ["series_id"]), 60).cache()


class Bars:
    """Columns by name; everything asked of a place before the first bar, or of missing values, is None."""

    def __init__(self, pdf):
        self.col = {k: [None if isinstance(x, float) and math.isnan(x) else x for x in pdf[k].tolist()] for k in pdf.columns}

    def __call__(self, name, t, back=0):
        return self.col[name][t - back] if t - back >= 0 else None

    def before(self, f, t, n):
        """The n values of f before t."""
        out = [f(q) for q in range(t - n, t)] if t >= n else [None]
        return None if None in out else out

    def upto(self, f, t, n):
        out = [f(q) for q in range(t - n + 1, t + 1)] if t >= n - 1 else [None]
        return None if None in out else out


def ok(f):
    """A condition on missing values is false, and so is one that divides by zero."""
    try:
        return bool(f())
    except (TypeError, ZeroDivisionError):
        return False


def spread(x):
    m = sum(x) / len(x)
    return math.sqrt(sum((v - m) ** 2 for v in x) / len(x))


def mean(x):
    return sum(x) / len(x)


def definitions(b):
    """algorithm: (t, a) -> (long, short) as two callables."""
    o, h, l, c, v = (lambda t, k=0, n=n: b(n, t, k) for n in "ohlcv")  # noqa: E741
    x = lambda t, k=0: b("x", t, k)
    span = lambda t, k=0: h(t, k) - l(t, k)
    of = lambda name: (lambda t: b(name, t))
    ma = lambda t: mean(b.upto(c, t, 20))
    dev = lambda t: c(t) / ma(t) - 1
    d1 = lambda t: x(t) - x(t, 1)
    d2 = lambda t: d1(t) - (x(t, 1) - x(t, 2))
    green, red = (lambda t: c(t) > o(t)), (lambda t: c(t) < o(t))
    run = lambda f, t, n: all(ok(lambda q=q: f(q)) for q in range(t - n + 1, t + 1)) and t >= n - 1
    z = lambda f, t, n: round((f(t) - mean(b.before(f, t, n))) / spread(b.before(f, t, n)), 9)
    ratio = lambda f, t, n=20: round(f(t) / mean(b.before(f, t, n)), 9)
    both = lambda f: (f, f)
    tr = lambda t: max(h(t) - l(t), abs(h(t) - c(t, 1)), abs(l(t) - c(t, 1)))
    logr = lambda t: math.log(c(t) / c(t, 1))
    rv = lambda t: spread(b.upto(logr, t, 10)) if t >= 10 else None
    width = lambda t: 4 * spread(b.upto(c, t, 20)) / mean(b.upto(c, t, 20)) if t >= 19 else None
    body = lambda t: abs(c(t) - o(t)) / span(t)
    vwap = lambda t, n: sum((h(q) + l(q) + c(q)) / 3 * v(q) for q in range(t - n + 1, t + 1)) / sum(v(q) for q in range(t - n + 1, t + 1)) if t >= n - 1 else None
    flow = lambda t, n: sum(b.upto(of("delta"), t, n))
    sign = lambda t, k=0: (c(t, k) > o(t, k)) - (c(t, k) < o(t, k))
    f_ = of("funding")
    return {
        "zero": lambda t, a: (lambda: x(t) > 0, lambda: x(t) < 0),
        "wick": lambda t, a: (lambda: (h(t) - max(c(t), o(t))) / span(t) <= a, lambda: (min(c(t), o(t)) - l(t)) / span(t) <= a),
        "body": lambda t, a: both(lambda: body(t) >= a),
        "slope": lambda t, a: (lambda: ma(t) > ma(t - int(a)), lambda: ma(t) < ma(t - int(a))),
        "distance": lambda t, a: (lambda: 0 <= dev(t) <= a, lambda: -a <= dev(t) <= 0),
        "distance_min": lambda t, a: (lambda: dev(t) >= a, lambda: dev(t) <= -a),
        "macd_accel": lambda t, a: (lambda: d2(t) > 0, lambda: d2(t) < 0),
        "macd_accel2": lambda t, a: (lambda: d2(t) > 0 and d2(t - 1) > 0, lambda: d2(t) < 0 and d2(t - 1) < 0),
        "macd_decel": lambda t, a: (lambda: d2(t) < 0, lambda: d2(t) > 0),
        "macd_amp_std": lambda t, a: both(lambda: spread(b.before(x, t, 20)) > 0 and abs(x(t)) >= a * spread(b.before(x, t, 20))),
        "macd_slope_run": lambda t, a: (lambda: run(lambda q: d1(q) > 0, t, int(a)), lambda: run(lambda q: d1(q) < 0, t, int(a))),
        "macd_z": lambda t, a: (lambda: z(x, t, 20) >= a, lambda: z(x, t, 20) <= -a),
        "macd_near_zero": lambda t, a: both(lambda: abs(z(x, t, 20)) <= a),
        "zero_cross_event": lambda t, a: (lambda: x(t) > 0 >= x(t, 1), lambda: x(t) < 0 <= x(t, 1)),
        "hist_sign_align": lambda t, a: (lambda: b("hist", t) > 0, lambda: b("hist", t) < 0),
        "dual_macd_dir": lambda t, a: (lambda: b("hist", t) > b("hist", t, 1) and b("dif", t) > b("dif", t, 1), lambda: b("hist", t) < b("hist", t, 1) and b("dif", t) < b("dif", t, 1)),
        "macd_dir_disagree": lambda t, a: both(lambda: (b("hist", t) - b("hist", t, 1)) * (b("dif", t) - b("dif", t, 1)) < 0),
        "clv": lambda t, a: (lambda: (2 * c(t) - h(t) - l(t)) / span(t) >= a, lambda: (2 * c(t) - h(t) - l(t)) / span(t) <= -a),
        "candle_align": lambda t, a: (lambda: green(t), lambda: red(t)),
        "candle_body_align": lambda t, a: (lambda: green(t) and body(t) >= a, lambda: red(t) and body(t) >= a),
        "range_ratio_min": lambda t, a: both(lambda: ratio(span, t) >= a), "range_ratio_max": lambda t, a: both(lambda: ratio(span, t) <= a),
        "volume_ratio_min": lambda t, a: both(lambda: ratio(v, t) >= a), "volume_ratio_max": lambda t, a: both(lambda: ratio(v, t) <= a),
        "quote_volume_ratio_min": lambda t, a: both(lambda: ratio(of("qv"), t) >= a), "quote_volume_ratio_max": lambda t, a: both(lambda: ratio(of("qv"), t) <= a),
        "trades_ratio": lambda t, a: both(lambda: ratio(of("trades"), t) >= a), "trades_ratio_max": lambda t, a: both(lambda: ratio(of("trades"), t) <= a),
        "avg_trade_ratio": lambda t, a: both(lambda: ratio(of("avg_size"), t) >= a), "avg_trade_ratio_max": lambda t, a: both(lambda: ratio(of("avg_size"), t) <= a),
        "momentum_run": lambda t, a: (lambda: run(lambda q: c(q) > c(q, 1), t, int(a)), lambda: run(lambda q: c(q) < c(q, 1), t, int(a))),
        "candle_run": lambda t, a: (lambda: run(green, t, int(a)), lambda: run(red, t, int(a))),
        "volume_falling": lambda t, a: both(lambda: run(lambda q: v(q) < v(q, 1), t, int(a))),
        "donchian_break": lambda t, a: (lambda: c(t) > max(b.before(h, t, int(a))), lambda: c(t) < min(b.before(l, t, int(a)))),
        "donchian_near": lambda t, a: (lambda: 0 <= (max(b.before(h, t, 20)) - c(t)) / (max(b.before(h, t, 20)) - min(b.before(l, t, 20))) <= a, lambda: 0 <= (c(t) - min(b.before(l, t, 20))) / (max(b.before(h, t, 20)) - min(b.before(l, t, 20))) <= a),
        "boll_trend": lambda t, a: (lambda: c(t) >= ma(t) + a * spread(b.upto(c, t, 20)), lambda: c(t) <= ma(t) - a * spread(b.upto(c, t, 20))),
        "boll_contra": lambda t, a: (lambda: c(t) <= ma(t) - a * spread(b.upto(c, t, 20)), lambda: c(t) >= ma(t) + a * spread(b.upto(c, t, 20))),
        "rsi_trend": lambda t, a: (lambda: b("rsi14", t) >= a, lambda: b("rsi14", t) <= 100 - a), "rsi_contra": lambda t, a: (lambda: b("rsi14", t) <= a, lambda: b("rsi14", t) >= 100 - a),
        "efficiency_min": lambda t, a: both(lambda: abs(c(t) - c(t, 10)) / sum(abs(c(q) - c(q, 1)) for q in range(t - 9, t + 1)) >= a), "efficiency_max": lambda t, a: both(lambda: abs(c(t) - c(t, 10)) / sum(abs(c(q) - c(q, 1)) for q in range(t - 9, t + 1)) <= a),
        "vwap_side": lambda t, a: (lambda: c(t) / vwap(t, int(a)) - 1 >= 0, lambda: c(t) / vwap(t, int(a)) - 1 <= 0),
        "vwap_distance": lambda t, a: (lambda: 0 <= c(t) / vwap(t, 20) - 1 <= a, lambda: -a <= c(t) / vwap(t, 20) - 1 <= 0),
        "close_break": lambda t, a: (lambda: c(t) > max(b.before(c, t, int(a))), lambda: c(t) < min(b.before(c, t, int(a)))),
        "inside_break": lambda t, a: (lambda: h(t, 1) <= h(t, 2) and l(t, 1) >= l(t, 2) and c(t) > h(t, 2), lambda: h(t, 1) <= h(t, 2) and l(t, 1) >= l(t, 2) and c(t) < l(t, 2)),
        "sweep_reclaim": lambda t, a: (lambda: l(t) < l(t, 1) < c(t), lambda: h(t) > h(t, 1) > c(t)),
        "micro_reversal": lambda t, a: (lambda: c(t, 1) < o(t, 1) and green(t), lambda: c(t, 1) > o(t, 1) and red(t)),
        "engulf": lambda t, a: (lambda: c(t, 1) < o(t, 1) and green(t) and o(t) <= c(t, 1) and c(t) >= o(t, 1), lambda: c(t, 1) > o(t, 1) and red(t) and o(t) >= c(t, 1) and c(t) <= o(t, 1)),
        "outside_align": lambda t, a: (lambda: h(t) > h(t, 1) and l(t) < l(t, 1) and green(t), lambda: h(t) > h(t, 1) and l(t) < l(t, 1) and red(t)),
        "pin_reversal": lambda t, a: (lambda: (min(o(t), c(t)) - l(t)) / span(t) >= a and c(t) >= o(t), lambda: (h(t) - max(o(t), c(t))) / span(t) >= a and c(t) <= o(t)),
        "close_extreme": lambda t, a: (lambda: (h(t) - c(t)) / span(t) <= a, lambda: (c(t) - l(t)) / span(t) <= a),
        "doji_break": lambda t, a: (lambda: abs(c(t, 1) - o(t, 1)) / span(t, 1) <= a and c(t) > h(t, 1), lambda: abs(c(t, 1) - o(t, 1)) / span(t, 1) <= a and c(t) < l(t, 1)),
        "nr_n": lambda t, a: both(lambda: span(t) <= min(b.before(span, t, int(a) - 1))), "wr_n": lambda t, a: both(lambda: span(t) >= max(b.before(span, t, int(a) - 1))),
        "return2_min": lambda t, a: (lambda: c(t) / c(t, 2) - 1 >= a, lambda: c(t) / c(t, 2) - 1 <= -a), "return5_min": lambda t, a: (lambda: c(t) / c(t, 5) - 1 >= a, lambda: c(t) / c(t, 5) - 1 <= -a),
        "return5_contra": lambda t, a: (lambda: c(t) / c(t, 5) - 1 <= -a, lambda: c(t) / c(t, 5) - 1 >= a),
        "two_bar_reversal": lambda t, a: (lambda: c(t, 1) < o(t, 1) and green(t) and c(t) > (h(t, 1) + l(t, 1)) / 2, lambda: c(t, 1) > o(t, 1) and red(t) and c(t) < (h(t, 1) + l(t, 1)) / 2),
        "failed_break_strong": lambda t, a: (lambda: l(t) < l(t, 1) and c(t) > h(t, 1), lambda: h(t) > h(t, 1) and c(t) < l(t, 1)),
        "alternating": lambda t, a: (lambda: sign(t) > 0 and all(sign(t, k) == -1 for k in range(1, int(a))), lambda: sign(t) < 0 and all(sign(t, k) == 1 for k in range(1, int(a)))),
        "atr_regime_low": lambda t, a: both(lambda: ratio(of("atr14"), t, 60) <= a), "atr_regime_high": lambda t, a: both(lambda: ratio(of("atr14"), t, 60) >= a),
        "rv_regime_low": lambda t, a: both(lambda: ratio(rv, t, 60) <= a), "rv_regime_high": lambda t, a: both(lambda: ratio(rv, t, 60) >= a),
        "boll_width_low": lambda t, a: both(lambda: ratio(width, t, 60) <= a), "boll_width_high": lambda t, a: both(lambda: ratio(width, t, 60) >= a),
        "tr_z_high": lambda t, a: both(lambda: z(tr, t, 20) >= a),
        "volume_z_high": lambda t, a: both(lambda: z(v, t, 20) >= a), "volume_z_low": lambda t, a: both(lambda: z(v, t, 20) <= -a), "trades_z_high": lambda t, a: both(lambda: z(of("trades"), t, 20) >= a),
        "taker_ratio": lambda t, a: (lambda: b("ratio", t) >= a, lambda: b("ratio", t) <= 1 - a), "taker_contra": lambda t, a: (lambda: b("ratio", t) <= 1 - a, lambda: b("ratio", t) >= a),
        "taker_z": lambda t, a: (lambda: z(of("ratio"), t, 60) >= a, lambda: z(of("ratio"), t, 60) <= -a), "delta_z_side": lambda t, a: (lambda: z(of("delta"), t, 60) >= a, lambda: z(of("delta"), t, 60) <= -a),
        "delta_side": lambda t, a: (lambda: b("delta", t) > 0, lambda: b("delta", t) < 0), "cvd_slope": lambda t, a: (lambda: flow(t, int(a)) > 0, lambda: flow(t, int(a)) < 0),
        "price_cvd_div": lambda t, a: (lambda: c(t) < c(t, int(a)) and flow(t, int(a)) > 0, lambda: c(t) > c(t, int(a)) and flow(t, int(a)) < 0),
        "flow_candle_align": lambda t, a: (lambda: green(t) and b("delta", t) > 0, lambda: red(t) and b("delta", t) < 0),
        "flow_absorption": lambda t, a: (lambda: l(t) < l(t, 1) < c(t) and b("delta", t) < 0, lambda: h(t) > h(t, 1) > c(t) and b("delta", t) > 0),
        "funding_contra": lambda t, a: (lambda: f_(t) <= -a, lambda: f_(t) >= a), "funding_align": lambda t, a: (lambda: f_(t) > 0, lambda: f_(t) < 0),
        "funding_flip_contra": lambda t, a: (lambda: b("funding", t, 1) >= 0 > f_(t), lambda: b("funding", t, 1) <= 0 < f_(t)),
        # a quarter of an hour before is on no hourly bar
        "oi_change60_min": lambda t, a: both(lambda: b("oi", t) / b("oi", t, 1) - 1 >= a),
        "taker_quote_ratio": lambda t, a: (lambda: b("tq_ratio", t) >= a, lambda: b("tq_ratio", t) <= 1 - a), "quote_delta_side": lambda t, a: (lambda: b("delta_quote", t) > 0, lambda: b("delta_quote", t) < 0),
    }


PLACEBO = {r.algorithm for r in R.single_rules() if r.placebo}
NEVER_HOURLY = {"oi_change_min", "oi_change_max", "oi_expand_confirm", "price_oi_squeeze", "oi_delever_trend", "oi_value_change_min", "oi_z_high"}


def test_single_rules_by_definition(bars):
    rules = [r for r in R.single_rules() if r.id not in R.unavailable(R.single_rules(), HAVE, MINUTES)]
    pdf = bars.toPandas().sort_values("ct").reset_index(drop=True)
    b = Bars(pdf)
    say = definitions(b)
    got: dict[int, dict[int, int]] = {}
    for x in signals.signals(bars, rules, MINUTES).select("rule_id", "ct", "side").collect():
        got.setdefault(x["rule_id"], {})[x["ct"] // 3_600_000 - 1] = x["side"]
    fired = set()
    for r in rules:
        if r.algorithm in PLACEBO or r.algorithm in NEVER_HOURLY:
            continue
        want = {}
        for t in range(len(pdf)):
            long, short = say[r.algorithm](t, r.params[0])
            side = 1 if b("dir", t) == 1 and ok(long) else -1 if b("dir", t) == -1 and ok(short) else 0
            if side and b("x", t) is not None:
                want[t] = side
        assert got.get(r.id, {}) == want, (r, sorted(set(got.get(r.id, {}).items()) ^ set(want.items()))[:6])
        fired |= {r.algorithm} if want else set()
    missing = {r.algorithm for r in rules} - PLACEBO - NEVER_HOURLY - set(say)
    assert not missing and len(fired) > 60


def families(b):
    """algorithm: (t, params) -> (long, short); averages and oscillators with a memory are taken from the folds."""
    o, h, l, c, v = (lambda t, k=0, n=n: b(n, t, k) for n in "ohlcv")  # noqa: E741
    col = lambda name: (lambda t, k=0: b(name, t, k))
    atr = col("atr14")
    change = lambda t: c(t) - c(t, 1)
    ret = lambda t: c(t) / c(t, 1) - 1
    need = lambda x: x if None not in x else None
    last = lambda f, t, n: need([f(q) for q in range(t - n + 1, t + 1)]) if t >= n - 1 else None
    prior = lambda f, t, n: need([f(q) for q in range(t - n, t)]) if t >= n else None
    safe = lambda f: (lambda t: _none(f, t))
    level = lambda f, low, high: (lambda t: f(t) >= low > f(t - 1), lambda t: f(t) <= high < f(t - 1))

    def line(values):
        n = len(values)
        mx, my = (n - 1) / 2, mean(values)
        slope = sum((j - mx) * (y - my) for j, y in enumerate(values)) / sum((j - mx) ** 2 for j in range(n))
        start = my - slope * mx
        error = math.sqrt(sum((y - start - slope * j) ** 2 for j, y in enumerate(values)) / (n - 2))
        return start + slope * n, error, slope * math.sqrt(sum((j - mx) ** 2 for j in range(n))) / error

    def corr(x, y):
        return (mean([p * q for p, q in zip(x, y)]) - mean(x) * mean(y)) / (spread(x) * spread(y))

    def weighted(f, t, n):
        return sum((k + 1) * x for k, x in enumerate(last(f, t, n))) / (n * (n + 1) / 2)

    def hull(t, n):
        inner = safe(lambda q: 2 * weighted(c, q, n // 2) - weighted(c, q, n))
        return weighted(inner, t, int(math.sqrt(n)))

    def skewness(x):
        n, m = len(x), mean(x)
        m2, m3 = mean([(y - m) ** 2 for y in x]), mean([(y - m) ** 3 for y in x])
        return math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5

    def stochastic(n):
        return safe(lambda t: 100 * (c(t) - min(last(l, t, n))) / (max(last(h, t, n)) - min(last(l, t, n))))

    def cci(n):
        tp = lambda t: (h(t) + l(t) + c(t)) / 3
        return safe(lambda t: (tp(t) - mean(last(tp, t, n))) / (0.015 * mean([abs(x - mean(last(tp, t, n))) for x in last(tp, t, n)])))

    def mfi(n):
        tp = lambda t: (h(t) + l(t) + c(t)) / 3
        part = lambda t, s: sum(tp(q) * v(q) for q in range(t - n + 1, t + 1) if q and (tp(q) - tp(q - 1)) * s > 0) if t >= n - 1 else None
        return safe(lambda t: 100 * part(t, 1) / (part(t, 1) + part(t, -1)))

    def aroon(t, n):
        hi, lo = last(h, t, n), last(l, t, n)
        latest = lambda x, y: max(k for k in range(n) if x[k] == y)
        return 100 * (latest(hi, max(hi)) - latest(lo, min(lo))) / (n - 1)

    def parkinson(n):
        q = safe(lambda t: mean(last(lambda k: math.log(h(k) / l(k)) ** 2 / (4 * math.log(2)), t, n)))
        return safe(lambda t: q(t) / mean(prior(q, t, 60)))

    def residual(n):
        x = safe(lambda t: b("delta", t) / v(t))

        def f(t):
            xs, ys = prior(x, t, n), prior(safe(ret), t, n)
            cov = mean([p * q for p, q in zip(xs, ys)]) - mean(xs) * mean(ys)
            slope = cov / spread(xs) ** 2
            return (ret(t) - (mean(ys) - slope * mean(xs) + slope * x(t))) / math.sqrt(max(spread(ys) ** 2 - slope * cov, 0))

        return safe(f)

    run = lambda f, t, k: all(ok(lambda q=q: f(q)) for q in range(t - k + 1, t + 1))
    kama = lambda n: col(f"kama{int(n)}")
    e = lambda n, k: col(f"ema{int(n)}_{k}")
    dema = lambda t, n: 2 * e(n, 1)(t) - e(n, 2)(t)
    tema = lambda t, n: 3 * e(n, 1)(t) - 3 * e(n, 2)(t) + e(n, 3)(t)
    trix = lambda t, n: (e(n, 3)(t) - e(n, 3)(t, 1)) / e(n, 3)(t, 1)
    step = lambda f, t, *a: f(t, *a) - f(t - 1, *a)
    rank = lambda n: safe(lambda t: sum((y < c(t)) + 0.5 * (y == c(t)) for y in prior(c, t, n)) / n)
    reg = lambda n: safe(lambda t: (c(t) - line(prior(c, t, n))[0]) / line(prior(c, t, n))[1])
    volume_up = lambda t: (v(t) - v(t, 1)) / v(t, 1)
    both = lambda f: (f, f)
    squeeze = lambda t, n, x: spread(last(c, t - 1, n)) < x * mean([spread(last(c, q, n)) for q in range(t - 120, t)])
    semi = lambda t, n, s: sum(x * x for x in prior(safe(ret), t, n) if x * s > 0)
    intensity = safe(lambda t: b("trades", t) / ((h(t) - l(t)) / c(t)))
    flow = lambda n: safe(lambda t: sum(last(col("delta"), t, n)) / sum(last(v, t, n)))
    zflow = lambda t, n: round((flow(n)(t) - mean(prior(flow(n), t, 20))) / spread(prior(flow(n), t, 20)), 9)
    day = lambda t: t // 24  # noqa: E731  bars begin at midnight
    pivot = lambda t: (max(h(q) for q in range(24 * day(t) - 24, 24 * day(t))) + min(l(q) for q in range(24 * day(t) - 24, 24 * day(t))) + c(24 * day(t) - 1)) / 3 if day(t) else None
    absorbed = lambda t, m, x: v(t) >= m * mean(prior(v, t, 20)) and abs(change(t)) <= x * atr(t, 1)
    quiet = lambda t, x: v(t, 1) <= x * mean(prior(v, t - 1, 20))
    cross = lambda f, g, t: (ok(lambda: f(t) > g(t) and f(t - 1) <= g(t - 1)), ok(lambda: f(t) < g(t) and f(t - 1) >= g(t - 1)))
    two = lambda pair, also_up=lambda: True, also_down=lambda: True: (lambda: pair[0] and also_up(), lambda: pair[1] and also_down())
    at_level = lambda f, low, high, t: (lambda: level(f, low, high)[0](t), lambda: level(f, low, high)[1](t))
    return {
        "kama": lambda t, n, x: (lambda: kama(n)(t) > kama(n)(t, 1) and c(t) > kama(n)(t) + x * atr(t), lambda: kama(n)(t) < kama(n)(t, 1) and c(t) < kama(n)(t) - x * atr(t)),
        "dema": lambda t, n: two(cross(c, lambda q: dema(q, n), t)),
        "tema": lambda t, n: (lambda: c(t) > tema(t, n) and step(tema, t, n) > 0 and step(tema, t, n) > step(tema, t - 1, n), lambda: c(t) < tema(t, n) and step(tema, t, n) < 0 and step(tema, t, n) < step(tema, t - 1, n)),
        "trix": lambda t, n: (lambda: trix(t, n) > 0 >= trix(t - 1, n), lambda: trix(t, n) < 0 <= trix(t - 1, n)),
        "hma": lambda t, n: (lambda: hull(t, n) > hull(t - 1, n) and c(t) > hull(t, n), lambda: hull(t, n) < hull(t - 1, n) and c(t) < hull(t, n)),
        "reg_reentry": lambda t, n, x: at_level(reg(n), -x, x, t),
        "reg_t": lambda t, n, x: (lambda: line(prior(lambda q: math.log(c(q)), t, n))[2] > x and change(t) > 0, lambda: line(prior(lambda q: math.log(c(q)), t, n))[2] < -x and change(t) < 0),
        "rank_reentry": lambda t, n, x: at_level(rank(n), x, round(1 - x, 10), t),
        "stoch": lambda t, n, x: two(cross(stochastic(n), safe(lambda q: mean(last(stochastic(n), q, 3))), t), lambda: stochastic(n)(t - 1) < x, lambda: stochastic(n)(t - 1) > 100 - x),
        "cci": lambda t, n, x: at_level(cci(n), -x, x, t),
        "dmi": lambda t, n, x: two(cross(col(f"pdi{n}"), col(f"mdi{n}"), t), lambda: b(f"adx{n}", t) >= x, lambda: b(f"adx{n}", t) >= x),
        "aroon": lambda t, n, x: (lambda: aroon(t, n) > x and change(t) > 0, lambda: aroon(t, n) < -x and change(t) < 0),
        "ha_turn": lambda t, n, k: (lambda: run(lambda q: b(f"ha{n}", q) > 0, t, int(k)) and b(f"ha{n}", t, int(k)) < 0, lambda: run(lambda q: b(f"ha{n}", q) < 0, t, int(k)) and b(f"ha{n}", t, int(k)) > 0),
        "pv_corr": lambda t, n, x: (lambda: corr(prior(safe(ret), t, n), prior(safe(volume_up), t, n)) >= x and change(t) > 0 and v(t) > v(t, 1), lambda: corr(prior(safe(ret), t, n), prior(safe(volume_up), t, n)) <= -x and change(t) < 0 and v(t) > v(t, 1)),
        "volume_absorb": lambda t, m, x: (lambda: absorbed(t, m, x) and c(t) > (h(t) + l(t)) / 2 and min(c(t), o(t)) - l(t) >= abs(c(t) - o(t)), lambda: absorbed(t, m, x) and c(t) < (h(t) + l(t)) / 2 and h(t) - max(c(t), o(t)) >= abs(c(t) - o(t))),
        "mfi": lambda t, n, x: at_level(mfi(n), x, 100 - x, t),
        "chaikin": lambda t, n, x: (lambda: b(f"chaikin{n}_{int(x)}", t) > 0 >= b(f"chaikin{n}_{int(x)}", t, 1), lambda: b(f"chaikin{n}_{int(x)}", t) < 0 <= b(f"chaikin{n}_{int(x)}", t, 1)),
        "semivar": lambda t, n, x: (lambda: semi(t, n, 1) > x * semi(t, n, -1) and change(t) > 0, lambda: semi(t, n, -1) > x * semi(t, n, 1) and change(t) < 0),
        "autocorr": lambda t, n, x: (lambda: corr(prior(safe(ret), t, n), prior(safe(lambda q: ret(q - 1)), t, n)) < -x and ret(t - 1) < 0 < ret(t), lambda: corr(prior(safe(ret), t, n), prior(safe(lambda q: ret(q - 1)), t, n)) < -x and ret(t - 1) > 0 > ret(t)),
        "skew": lambda t, n, x: (lambda: skewness(prior(safe(ret), t, n)) < -x and ret(t) > 0, lambda: skewness(prior(safe(ret), t, n)) > x and ret(t) < 0),
        "park_release": lambda t, n, x: (lambda: parkinson(n)(t) > x >= parkinson(n)(t - 1) and c(t) > o(t), lambda: parkinson(n)(t) > x >= parkinson(n)(t - 1) and c(t) < o(t)),
        "squeeze_break": lambda t, n, x: (lambda: t >= 119 + n and squeeze(t, n, x) and c(t) > max(prior(h, t, n)), lambda: t >= 119 + n and squeeze(t, n, x) and c(t) < min(prior(l, t, n))),
        "daily_pivot": lambda t, x, k: (lambda: day(t) == day(t - int(k)) and run(lambda q: c(q) > pivot(q) + x * atr(q, 1), t, int(k)) and c(t, int(k)) <= pivot(t - int(k)), lambda: day(t) == day(t - int(k)) and run(lambda q: c(q) < pivot(q) - x * atr(q, 1), t, int(k)) and c(t, int(k)) >= pivot(t - int(k))),
        "opening_range": lambda t, n, x: (lambda: t % 24 * 60 >= n and c(t) > h(24 * day(t)) + x * atr(t, 1) and c(t, 1) <= h(24 * day(t)) + x * atr(t, 2), lambda: t % 24 * 60 >= n and c(t) < l(24 * day(t)) - x * atr(t, 1) and c(t, 1) >= l(24 * day(t)) - x * atr(t, 2)),
        "range_reclaim": lambda t, n, x: (lambda: l(t) < min(prior(l, t, n)) - x * atr(t, 1) and c(t) > min(prior(l, t, n)), lambda: h(t) > max(prior(h, t, n)) + x * atr(t, 1) and c(t) < max(prior(h, t, n))),
        "impulse_pullback": lambda t, n, x: (lambda: c(t, 2) - c(t, n + 2) > atr(t, 2) and c(t, 1) < c(t, 2) and quiet(t, x) and c(t) > h(t, 1), lambda: c(t, 2) - c(t, n + 2) < -atr(t, 2) and c(t, 1) > c(t, 2) and quiet(t, x) and c(t) < l(t, 1)),
        "scale_div": lambda t, n, x: (lambda: c(t) > c(t, int(x)) and c(t) > c(t, n) and c(t, 1) <= c(t, n + 1), lambda: c(t) < c(t, int(x)) and c(t) < c(t, n) and c(t, 1) >= c(t, n + 1)),
        "trade_intensity": lambda t, n, x: (lambda: intensity(t) >= x * mean(prior(intensity, t, n)) and c(t) >= l(t) + 0.75 * (h(t) - l(t)) and c(t) > o(t), lambda: intensity(t) >= x * mean(prior(intensity, t, n)) and c(t) <= l(t) + 0.25 * (h(t) - l(t)) and c(t) < o(t)),
        "flow_accel": lambda t, n, x: (lambda: flow(n)(t) > 0 and zflow(t, n) > x and flow(n)(t) > flow(n)(t - 1), lambda: flow(n)(t) < 0 and zflow(t, n) < -x and flow(n)(t) < flow(n)(t - 1)),
        "flow_residual": lambda t, n, x: (lambda: level(residual(n), -x, x)[0](t) and b("delta", t) > 0, lambda: level(residual(n), -x, x)[1](t) and b("delta", t) < 0),
        "_": both,
    }


def _none(f, t):
    try:
        return f(t)
    except (TypeError, ZeroDivisionError):
        return None


def test_family_rules_by_definition(bars):
    every = R.family_rules()
    rules = [r for r in every if r.id not in R.unavailable(every, HAVE, MINUTES)]
    b = Bars(bars.toPandas().sort_values("ct").reset_index(drop=True))
    n, say = len(b.col["c"]), families(b)
    got: dict[int, dict[int, int]] = {}
    for x in signals.signals(bars, rules, MINUTES).select("rule_id", "ct", "side").collect():
        got.setdefault(x["rule_id"], {})[x["ct"] // 3_600_000 - 1] = x["side"]
    fired, seen = set(), set()
    for r in rules:
        if r.algorithm in seen:  # one rule of each family: these definitions are slow
            continue
        seen.add(r.algorithm)
        params = [int(p) if p == int(p) else p for p in r.params]
        want = {}
        for t in range(n):
            side = b("dir", t)
            if side and b("x", t) is not None and ok(say[r.algorithm](t, *params)[0 if side == 1 else 1]):
                want[t] = side
        assert got.get(r.id, {}) == want, (r, sorted(set(got.get(r.id, {}).items()) ^ set(want.items()))[:6])
        fired |= {r.algorithm} if want else set()
    assert len(seen) == 30 and len(fired) > 20, sorted(seen - fired)


def test_run_lengths_by_the_recursion_of_each_run():
    """Every run's posterior updated value by value, as the model is stated, instead of from running sums."""
    from math import exp, lgamma, log, pi

    from tidebar.functions import machines as M

    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, 60), r.normal(3, 0.5, 40), r.normal(-1, 2, 30)])
    runs = [(1.0, 0.0, 1.0, 2.0, 1.0)]  # probability, mean, worth, shape, rate
    for value, (log_p, lost) in zip(x, M.run_lengths(x, hazard=1 / 50, most=80)):
        grown, ended = [], 0.0
        for p, m, k, a, b in runs:
            s2 = b * (k + 1) / (a * k)
            like = exp(lgamma(a + 0.5) - lgamma(a) - 0.5 * log(2 * a * pi * s2) - (a + 0.5) * log(1 + (value - m) ** 2 / (2 * a * s2)))
            ended += p * like / 50
            grown.append((p * like * 49 / 50, (k * m + value) / (k + 1), k + 1, a + 0.5, b + k * (value - m) ** 2 / (2 * (k + 1))))
        runs = [(ended, 0.0, 1.0, 2.0, 1.0), *grown]
        total = sum(q[0] for q in runs)
        assert abs(sum(q[0] for q in runs[80:]) / total - lost) < 1e-9
        runs = runs[:80]
        total = sum(q[0] for q in runs)
        runs = [(q[0] / total, *q[1:]) for q in runs]
        assert np.allclose(np.exp(log_p), [q[0] for q in runs], atol=1e-9)


def test_reversion_bar_by_bar():
    from tidebar.functions import machines as M

    r = np.random.default_rng(5)
    x = np.empty(1500)
    x[0] = 4.6
    for t in range(1, 1500):
        x[t] = x[t - 1] + 0.06 * (4.6 - x[t - 1]) + 0.004 * r.standard_t(4)
    x[1000] = np.nan
    want, last = np.zeros(1500, int), (False, False)
    for t in range(200, 1500):
        now = (False, False)
        if (t - 200) % 30 == 0:
            w, fit = x[t - 200 : t], None
            if np.isfinite(w).all():
                slope, cut = np.polyfit(w[:-1], w[1:], 1)
                if 0 < slope < 1 and 3 <= -np.log(2) / np.log(slope) <= 120:
                    fit = cut / (1 - slope), (w[1:] - slope * w[:-1] - cut).std() / np.sqrt(1 - slope**2), slope
        if not np.isfinite(x[t] - x[t - 1]):
            fit = None
        if fit:
            back, step = (fit[0] - x[t]) * (1 - fit[2] ** 10), x[t] - x[t - 1]
            now = x[t] < fit[0] - 2 * fit[1] and step > 0 and back > 2e-4, x[t] > fit[0] + 2 * fit[1] and step < 0 and back < -2e-4
        want[t] = int(now[0] and not last[0]) - int(now[1] and not last[1])
        last = now
    got = M.reversion({"c": np.exp(x)}, rows=200)
    assert (got == want).all() and (want == 1).sum() >= 3 and (want == -1).sum() >= 3
