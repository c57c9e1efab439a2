import math
import random

import duckdb
import numpy as np
import pytest

from tidebar.catalog import market, strategy
from tidebar.functions import folds, paths
from tidebar.operators import exits, filters, selection, signals, state
from tidebar.operators.asof import asof
from tidebar.operators.replay import Account, exit_plan, replay
from tidebar.operators.resample import features, resample, segments
from tidebar.plans import rules as R
from tidebar.sources import bars as B
from tidebar.sources import normalise as N
from tidebar.core import DataError, require
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SLOW = {"rules_single", "rules_family"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "lineitem orders events part customer nation".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(strategy.ORACLE))
def test_query_matches_its_sql(spark, duck, name):
    got = market.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(strategy.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(got.select(*cols).collect()) == plain([[r[i] for i in at] for r in want.fetchall()])


@pytest.fixture(scope="module")
def sine(spark):
    n = 1440
    close = [2000 + 5 * math.sin(x / 11) + 2 * math.sin(x / 3) for x in range(n)]
    start = 1_767_355_200_000
    rows = []
    for x, c in enumerate(close):
        o = close[x - 1] if x else c
        rows.append(("s", start + x * 60000, o, max(o, c) + 0.5, min(o, c) - 0.5, c, 10.0 + x % 11, 5.0, None if x == 7 else 3.0))
    return spark.createDataFrame(rows, "series_id string, open_ms long, open double, high double, low double, close double, volume double, taker_buy_base double, trades double")


def test_resample_completeness_and_nulls(sine):
    five = {r["open_ms"]: r for r in resample(sine, 5).collect()}
    assert len(five) == 288 and sum(r["trades"] is None for r in five.values()) == 1
    gap = sine.where("open_ms % 600000 <> 0")
    assert resample(gap, 5).count() == 144 and resample(gap, 5, complete=False).count() == 288
    long = features(sine, (1, 5, 60))
    assert {r["tf"]: r["count"] for r in long.groupBy("tf").count().collect()} == {1: 1440, 5: 288, 60: 24}


def test_contract(sine):
    assert B.validate(sine).count() == 1440
    for bad in (sine.where("open_ms % 600000 <> 0"), sine.withColumn("high", F.col("low")), sine.withColumn("volume", F.lit(1.0)), sine.limit(100), sine.unionByName(sine.limit(1).withColumn("close", F.col("close") + 0.1).withColumn("high", F.col("high") + 1)), sine.withColumn("open", F.lit(-1.0)), sine.withColumn("close", F.lit(None).cast("double"))):
        with pytest.raises(DataError):
            B.validate(bad)


def test_segments_restart_at_gaps(sine):
    gap = sine.withColumn("ct", F.col("open_ms") + 60000).where("open_ms % 36000000 <> 0")
    got = segments(gap, 1).groupBy("segment").agg(F.min("i").alias("a"), F.count("*").alias("n")).collect()
    assert len(got) >= 3 and all(r["a"] == 0 for r in got)


def test_names_numbers_times(spark):
    df = spark.createDataFrame([("1700000000", "1", "1.5", None), ("1700000060", "2", None, "2.5")], "openTime string, Open string, o string, close string")
    with pytest.raises(DataError):
        N.rename(df)
    ok = N.timestamps(N.numbers(N.rename(df.drop("Open")), "open", "close"))
    assert [r["open_ms"] for r in ok.collect()] == [1700000000000, 1700000060000]
    for unit, x in (("ms", 1700000000123), ("us", 1700000000123456), ("ns", 1700000000123456789)):
        assert N.timestamps(spark.createDataFrame([(x,)], "open_ms long")).first()[0] == 1700000000123, unit
    with pytest.raises(DataError):
        N.timestamps(spark.createDataFrame([(1700000000,), (1700000000000,)], "open_ms long"))
    with pytest.raises(DataError):
        N.numbers(spark.createDataFrame([("x",)], "open string"), "open")
    flags = spark.createDataFrame([("TRUE",), ("0.0",), ("maybe",)], "m string").select(N.maker_flag(F.col("m")).alias("m")).collect()
    assert [r[0] for r in flags] == [True, False, None]
    with pytest.raises(DataError):
        require(df, any_row=F.lit(True))


def test_micro_merge(spark, sine):
    micro = spark.createDataFrame([("s", 1_767_355_200_000, 9.0, 1.0)], "series_id string, open_ms long, taker_buy_base double, delta_base double")
    got = B.merge_micro(sine, micro).orderBy("open_ms").limit(2).collect()
    assert [(r["taker_buy_base"], r["delta_base"]) for r in got] == [(9.0, 1.0), (5.0, None)]
    with pytest.raises(DataError):
        B.merge_micro(sine, micro.unionByName(micro))


def test_asof_takes_the_event_at_the_same_time(spark):
    bars = spark.createDataFrame([("a", 10), ("a", 20), ("a", 90)], "series_id string, ct long")
    events = spark.createDataFrame([("a", 10, 1.0), ("a", 19, 2.0), ("a", 21, None)], "series_id string, ts_ms long, x double")
    assert [(r["ct"], r["x"]) for r in asof(bars, events, ["x"], tolerance_ms=50).orderBy("ct").collect()] == [(10, 1.0), (20, 2.0), (90, None)]


def test_searches_against_brute_force():
    r = np.random.default_rng(271828)
    for n in (1, 2, 7, 31, 300):
        x = r.integers(0, 12, n).astype(float)
        x[r.random(n) < 0.1] = np.nan
        start, level = r.integers(0, n + 1, 60), r.integers(-1, 13, 60).astype(float)
        level[:3] = np.nan
        want = [next((j for j in range(s, n) if x[j] <= v), n) for s, v in zip(start, level)]
        assert paths.first_at_most(x, start, level).tolist() == want
        want = [next((j for j in range(s, n) if x[j] >= v), n) for s, v in zip(start, level)]
        assert paths.first_at_least(x, start, level).tolist() == want
        mask, side = r.random(n) < 0.4, np.where(r.random(60) < 0.5, 1, -1)
        assert paths.next_event(mask, start).tolist() == [next((j for j in range(s, n) if mask[j]), n) for s in start]
        want = [next((j for j in range(s, n) if mask[j] and (x[j] - v) * d > 0), n) for s, v, d in zip(start, level, side)]
        assert paths.first_profitable(x, mask, start, level, side).tolist() == want


def test_stop_merge_prefers_the_bar_and_the_adverse_price():
    never = np.iinfo(np.int64).max
    a = (np.array([5, 5, never]), np.array([10.0, 10.0, np.nan]), np.array([1.0, 1.0, 1.0]))
    b = (np.array([5, 4, 7]), np.array([9.0, 11.0, 3.0]), np.array([2.0, 2.0, 2.0]))
    at, price, risk = exits.merge_stops([a, b], np.array([1, 1, -1]), [True, True])
    assert at.tolist() == [5, 4, 7] and price.tolist() == [9.0, 11.0, 3.0] and risk.tolist() == [2.0, 2.0, 2.0]
    at, price, _ = exits.merge_stops([a, b], np.array([1, 1, -1]), [True, False])
    assert price.tolist() == [10.0, 11.0, 3.0]


def bars(c, h=None, low=None):
    c = np.array(c, float)
    return {"c": c, "h": np.array(h if h is not None else c, float), "l": np.array(low if low is not None else c, float), "ct": (np.arange(len(c)) + 1) * 60000.0}


def run(b, i, side, stops, targets, **kw):
    i, side = np.array(i), np.array(side)
    return replay(b, i, side, kw.pop("run", i), exit_plan(b, i, side, stops, targets), Account(initial=1000.0, **kw))


def test_replay_by_hand():
    b = bars([100, 105, 111, 90, 80])
    r = run(b, [0], [1], [exits.Plan(1, "fixed", 0.5)], [exits.Plan(2, "target", 0.1)])
    assert (r.trades, r.wins, r.hold_minutes) == (1, 1, 2) and r.equity == pytest.approx(1100)
    r = run(b, [0], [1], [exits.Plan(1, "fixed", 0.5)], [exits.Plan(2, "target", 0.1)], fee=0.001, slippage=0.002)
    assert r.sum_ret == pytest.approx(0.1 - 0.002 - 0.001 - 0.001 * 1.1)
    r = run(b, [3], [-1], [exits.Plan(1, "fixed", 0.5)], [exits.Plan(2, "target", 0.5)])
    assert r.equity == pytest.approx(1000 * (1 + 10 / 90))  # the last bar closes it
    r = run(b, [0, 1], [1, 1], [exits.Plan(1, "fixed", 0.9)], [exits.Plan(2, "target", 0.01)], run=np.array([7, 7]))
    assert r.trades == 1  # one trade for a run
    r = run(b, [2], [1], [exits.Plan(1, "fixed", 0.9)], [], leverage=10.0, protection=0.5)
    assert r.protections == 1 and r.equity == pytest.approx(500)
    r = run(b, [2], [1], [exits.Plan(1, "fixed", 0.9)], [], leverage=10.0, protection=1.0, cross_margin=True, maintenance=0.05)
    assert r.forced == 1 and r.equity == 0 and r.max_drawdown == 1
    r = run(b, [0], [1], [exits.Plan(1, "fixed", 0.05)], [exits.Plan(2, "target", 0.05)], enforce_least=True, least_quantity=100.0)
    assert r.stopped and r.trades == 0


def test_stop_goes_before_target_on_one_bar():
    b = bars([100, 100], h=[100, 120], low=[100, 80])
    assert run(b, [0], [1], [exits.Plan(1, "fixed", 0.1)], [exits.Plan(2, "target", 0.1)]).equity == pytest.approx(900)


def test_moving_targets_arm_on_the_next_bar():
    b = bars([100, 110, 104], h=[100, 112, 110], low=[100, 99, 103])
    find = lambda kind, x, y: exits.moving(exits.Plan(1, kind, x, y), b, 0, 1)
    assert find("trail_price", 0.05, 0.05) == pytest.approx((2, 112 * 0.95))
    assert find("trail_share", 0.05, 0.5) == pytest.approx((2, 106.0))
    assert find("lock", 0.05, 0.04) == pytest.approx((2, 104.0))
    assert find("trail_price", 0.5, 0.05) is None
    short = bars([100, 90, 96], h=[100, 101, 97], low=[100, 88, 90])
    assert exits.moving(exits.Plan(1, "trail_share", 0.05, 0.5), short, 0, -1) == pytest.approx((2, 94.0))


def test_moving_targets_over_many_blocks():
    """Found blocks later as by a plain loop, the best price carried along."""
    r = np.random.default_rng(4)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.002, 1500)))
    b = bars(c, h=c * (1 + r.random(1500) * 0.003), low=c * (1 - r.random(1500) * 0.003))
    for side in (1, -1):
        for i in range(0, 1400, 37):
            best, armed, want = c[i], False, None
            for j in range(i + 1, 1500):
                line = best * (1 - side * 0.01)
                if armed and ((b["l"][j] <= line) if side == 1 else (b["h"][j] >= line)):
                    want = j, line
                    break
                best = max(best, b["h"][j]) if side == 1 else min(best, b["l"][j])
                armed = armed or (best - c[i] * (1 + side * 0.02)) * side >= 0
            got = exits.moving(exits.Plan(1, "trail_price", 0.02, 0.01), b, i, side)
            assert got == (want if want is None else pytest.approx(want))


def test_risk_multiple_parts_and_moving_beside_fixed():
    P = exits.Plan
    b = bars([100, 103, 106, 104, 101], h=[100, 104, 110, 105, 102], low=[100, 101, 102, 103, 100])
    i, s = np.array([0]), np.array([1])
    plan = exit_plan(b, i, s, [P(1, "fixed", 0.02)], [P(2, "risk", 2.0)])
    assert (plan.at[0], plan.price[0], plan.profit[0]) == (1, pytest.approx(104), True)
    plan = exit_plan(b, i, s, [], [P(1, "trail_price", 0.05, 0.05), P(2, "target", 0.09)])
    assert (plan.at[0], plan.price[0]) == (2, pytest.approx(109))
    plan = exit_plan(b, i, s, [], [P(1, "trail_price", 0.05, 0.05)], P(2, "target", 0.03))
    assert (plan.part_at[0], plan.part_price[0], plan.at[0], plan.price[0]) == (1, pytest.approx(103), 3, pytest.approx(104.5))
    r = replay(b, i, s, i, plan, Account(fee=0.001))
    raw = 0.5 * 0.03 + 0.5 * 0.045
    assert r.orders == 3 and r.sum_ret == pytest.approx(raw - 0.001 - 0.001 * (1 + raw))


def test_fees_eat_into_protection_and_liquidation_takes_all():
    b = bars([100, 95, 90, 80], h=[100, 100, 95, 90], low=[100, 94, 89, 70])
    i, s = np.array([0]), np.array([1])
    plan = exit_plan(b, i, s, [], [])
    r = replay(b, i, s, i, plan, Account(leverage=5, fee=0.001, protection=0.5))
    net = (-0.5 / 5 + 0.001) - 0.001 - 0.001 * (1 - 0.1 + 0.001)
    assert r.protections == 1 and r.hold_minutes == 2 and r.sum_ret == pytest.approx(net) and r.equity == pytest.approx(1000 * (1 + 5 * net))
    r = replay(b, i, s, i, plan, Account(leverage=10, protection=1.0, cross_margin=True, maintenance=0.005))
    assert r.forced == 1 and r.equity == 0 and r.stopped and r.sum_ret == pytest.approx(-0.1) and r.max_drawdown == pytest.approx(1)


def test_folds_do_not_look_ahead():
    import pandas as pd

    r = np.random.default_rng(824)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 400)))
    pdf = pd.DataFrame({"ct": np.arange(400), "o": np.roll(c, 1), "h": c * 1.01, "l": c * 0.99, "c": c, "v": r.random(400) + 1})
    whole, part = folds.fold(pdf), folds.fold(pdf.head(250))
    for k in folds.NAMES:
        np.testing.assert_allclose(whole[k].to_numpy()[:250], part[k].to_numpy(), rtol=1e-9, equal_nan=True, err_msg=k)


def test_catalogue():
    ids = [r.id for r in R.catalogue()]
    assert ids == list(range(5, 384)) and len(R.family_rules()) == 120 and len(R.single_rules()) == 139
    assert sum(r.status == "active" for r in R.third_rules()) == 39 and sum(r.status == "unavailable" for r in R.third_rules()) == 18
    refused = R.unavailable(R.single_rules(), set(), 60)
    assert refused[53] == "needs ratio" and 5 not in refused
    text = signals.signal_sql(R.single_rules(), 1, "t")
    assert "over (partition by series_id" in text


def test_calendar(spark):
    days = filters.holidays(spark, {2024: []})
    rows = spark.createDataFrame([(1_704_067_200_000,), (1_704_556_800_000,)], "ct long")  # Monday 8:00 and Sunday 0:00 in UTC+8
    assert [r["off_day"] for r in filters.day_kind(rows, days).orderBy("ct").collect()] == [False, True]
    with pytest.raises(DataError):
        filters.day_kind(rows, filters.holidays(spark, {2023: []}))
    assert len(filters.POSITION) == 16


def test_selection_odds(spark):
    one = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (3, "b", 7.0)], "id int, category string, m double")
    got = {r["id"]: r["score"] for r in selection.percentile_score(one, "category", [("m", True, 1.0)]).collect()}
    assert got == pytest.approx({1: 50.0, 2: 0.0, 3: 100.0})
    rows, conflicts = selection.merged_results([one, one, one.where("id = 1").withColumn("m", F.lit(9.0))], "id")
    assert rows.count() == 4 and [r[0] for r in conflicts.collect()] == [1]
    assert selection.evenly_spaced(10, 4) == [0, 3, 6, 9] and selection.evenly_spaced(3, 9) == [0, 1, 2]
    assert len(selection.RANKINGS) == 20


def test_average_rank(spark):
    import pandas as pd

    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 1, 500), 1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(500), "x": x}))
    for up in (True, False):
        got = selection.average_rank(df, "x", "p", up, 7).toPandas().sort_values("id")["p"].to_numpy()
        np.testing.assert_allclose(got, pd.Series(x if up else -x).rank(method="average", pct=True).to_numpy())


def test_whipsaw_and_confirm(spark):
    # runs of 2, 2, 7 and 1 bars: the second short one ends at bar 4 (minute 5), the pause lasts to minute 10
    rows = [("a", (i + 1) * 60000, d, i) for i, d in enumerate([1, 1, -1, -1, 1, 1, 1, 1, 1, 1, 1, -1])]
    df = state.runs(spark.createDataFrame(rows, "series_id string, ct long, dir int, i int"), "dir", ["series_id"])
    got = [r["paused"] for r in state.whipsaw_pause(df, ["series_id"], 5, 5).orderBy("i").collect()]
    assert got[:4] == [False] * 4 and got[4:9] == [True] * 5 and got[9:] == [False] * 3
    c = state.confirmed(df, "dir = 1", 3, ["series_id"], "ok").orderBy("i").collect()
    assert [r["i"] for r in c if r["ok"]] == [6, 7, 8, 9, 10]
    assert random.Random(1) is not None


def test_rules_at_a_price_of_zero(spark):
    """Bars with a low, or a range, of zero: no rule divides by it or takes its logarithm."""
    from tidebar.operators.signals import day_levels
    from tidebar.operators.state import with_direction

    r = random.Random(2)
    rows = []
    for k in range(400):
        c = 10 + r.random()
        low = 0.0 if k % 50 == 7 else c - 0.1
        high, low = (c, c) if k % 50 == 9 else (c + 0.1, low)
        rows.append(("s", k * 3_600_000, (k + 1) * 3_600_000, c, high, low, c, 0.0 if k % 40 == 3 else 5.0, 0.0 if k % 40 == 3 else 50.0, 3.0, 0.5, 0.1, 1.0, 0.5, 0.2, 100.0, 1000.0, 0.0, 0, k))
    b = spark.createDataFrame(rows, "series_id string, open_ms long, ct long, o double, h double, l double, c double, v double, qv double, trades double, ratio double, delta double, avg_size double, tq_ratio double, delta_quote double, oi double, oiv double, funding double, segment int, i int")
    b = day_levels(with_direction(folds.with_folds(b), "x", ["series_id"]), 60)
    rules = [r for r in R.single_rules() + R.family_rules() if r.id not in R.unavailable(R.single_rules() + R.family_rules(), market.HAVE, 60)]
    assert signals.signals(b, rules, 60).count() > 0


def test_machines_do_not_look_ahead():
    from tidebar.functions.machines import MACHINES

    r = np.random.default_rng(5)
    n = 1500
    step = r.standard_t(3, n) * 0.004 + 0.002 * np.sin(np.arange(n) / 60)
    c = 100 * np.exp(np.cumsum(step))
    o = np.concatenate([[100.0], c[:-1]])
    b = {"o": o, "c": c, "h": np.maximum(o, c) * (1 + r.random(n) * 0.004), "l": np.minimum(o, c) * (1 - r.random(n) * 0.004), "v": r.lognormal(3, 1, n), "trades": np.ceil(r.lognormal(3, 1, n)), "delta": r.normal(0, 5, n), "atr14": np.full(n, 0.5)}
    fired = {}
    for name, f in MACHINES.items():
        whole = f(b)
        for upto in (500, 1100):
            assert (f({k: v[:upto] for k, v in b.items()}) == whole[:upto]).all(), name
        fired[name] = int((whole != 0).sum())
    assert sum(k > 0 for k in fired.values()) >= 6, fired


def test_sequential_machines_on_a_shift():
    from tidebar.functions.machines import cusum, page_hinkley, probability_ratio

    r = np.random.default_rng(6)
    x = r.normal(0, 0.01, 700)
    x[400:] += 0.015
    b = {"c": 100 * np.exp(np.cumsum(x))}
    for f in (cusum, page_hinkley, probability_ratio):
        out = f(b)
        assert (out[402:440] == 1).any() and not (out[402:440] == -1).any() and not out[:240].any()


def test_model_machines_against_slow_versions():
    """Each bar's window cut out and fitted on its own."""
    from tidebar.functions import machines as M

    r = np.random.default_rng(12)
    n = 1900
    noise = r.normal(0, 0.004, n)
    x = np.zeros(n)
    for t in range(1, n):  # drawn back to zero, with a wave
        x[t] = 0.93 * x[t - 1] + noise[t] + 0.002 * np.sin(t / 5)
    c = 100 * np.exp(x)
    b = {"c": c, "v": r.lognormal(1, 0.2, n), "delta": np.append(np.diff(x)[1:], [0, 0]) * 200 + r.normal(0, 0.05, n), "atr14": np.full(n, 20.0)}
    x, ret = np.log(c), np.diff(np.log(c), prepend=np.nan)
    # the wave: regression by hand
    want = np.zeros(n, int)
    j = np.arange(120)
    for t in range(120, n):
        design = np.column_stack([np.ones(120), j, np.sin(2 * np.pi * j / 30), np.cos(2 * np.pi * j / 30)])
        _, drift, s, k = np.linalg.lstsq(design, x[t - 120 : t], rcond=None)[0]
        wave = [s * np.sin(2 * np.pi * q / 30) + k * np.cos(2 * np.pi * q / 30) for q in (119, 120, 121)]
        d0, d1 = wave[1] - wave[0], wave[2] - wave[1]
        want[t] = int(d0 <= 0 and d1 > 0 and drift + d1 > 0.0002) - int(d0 >= 0 and d1 < 0 and drift + d1 < -0.0002)
    assert (M.harmonic_turn(b) == want).all() and (want != 0).sum() > 10
    # five lags, refitted every sixty bars
    said = np.full(n, np.nan)
    for t in range(1445, n):
        if (t - 1445) % 60 == 0:
            rows = range(t - 1440, t)
            design = np.array([[1, *(ret[q - m] for m in range(5))] for q in rows])
            fit = np.linalg.lstsq(design, np.array([x[q + 1] - x[q] for q in rows]), rcond=None)[0]
        said[t] = fit @ [1, *(ret[t - m] for m in range(5))]
    up, down = said > 0.0002, said < -0.0002
    want = (up & ~np.append(False, up[:-1])).astype(int) - (down & ~np.append(False, down[:-1]))
    assert (M.autoregression(b) == want).all() and (want != 0).sum() > 10
    # the level that prices are drawn to
    up, down = np.zeros(n, bool), np.zeros(n, bool)
    for t in range(720, n):
        at = 720 + (t - 720) // 30 * 30
        w = x[at - 720 : at]
        slope, inter = np.polyfit(w[:-1], np.diff(w), 1)
        phi = 1 + slope
        if not (slope < 0 < phi and 3 <= -np.log(2) / np.log(phi) <= 120):
            continue
        level, spread = -inter / slope, np.std(np.diff(w) - inter - slope * w[:-1]) / np.sqrt(1 - phi * phi)
        back = (level - x[t]) * (1 - phi**10)
        up[t], down[t] = x[t] < level - 2 * spread and ret[t] > 0 and back > 0.0002, x[t] > level + 2 * spread and ret[t] < 0 and back < -0.0002
    want = (up & ~np.append(False, up[:-1])).astype(int) - (down & ~np.append(False, down[:-1]))
    assert (M.reversion(b) == want).all() and (want != 0).any()
    # persistence at one place
    h = [np.log(np.std(x[1300 - 1023 + k : 1301] - x[1300 - 1023 : 1301 - k])) for k in (4, 8, 16, 32)]
    assert np.polyfit(np.log([4, 8, 16, 32]), h, 1)[0] < 0.6  # drawn back: nothing fires
    assert not M.persistence(b).any()
    assert M.persistence({"c": 100 * np.exp(0.05 * np.sin(np.arange(n) / 60))}).any()
    # flow that leads the price is seen
    share = r.uniform(-1, 1, 3400)
    leads = {"c": 100 * np.exp(np.cumsum(np.append(0, 0.004 * share[:-1]) + r.normal(0, 0.0005, 3400))), "v": np.ones(3400), "delta": share, "atr14": np.full(3400, 20.0)}
    out = M.flow_ridge(leads)
    assert (out != 0).sum() > 50 and (np.sign(share[out != 0]) == out[out != 0]).mean() > 0.9 and not out[:2884].any()


def test_trend_filter_and_change_points_on_a_shift():
    from tidebar.functions import machines as M

    r = np.random.default_rng(8)
    x = r.normal(0, 0.001, 2600)
    x[1900:] += 0.0008
    out = M.trend_filter({"c": 100 * np.exp(np.cumsum(x))})
    assert (out[1900:2300] == 1).any() and not out[:1441].any()
    y = r.normal(0, 0.001, 900)
    y[600:603] += 0.008
    out = M.change_point({"c": 100 * np.exp(np.cumsum(y))})
    assert (out[600:606] == 1).any() and not out[:241].any()


def test_grid_and_ids(spark):
    from itertools import combinations

    from tidebar.plans import grid as G

    for n in (2, 3, 17, 84):
        got = [(r["a"], r["b"]) for r in G.pairs(spark, n).orderBy("pair_id").collect()]
        assert got == list(combinations(range(n), 2))
    assert G.compound_id("entry", "and", ["b", "a"]) == G.compound_id("entry", "and", ["a", "b", "a"]) < 0
    assert G.rate_code(" 1.250% ") == "1.25" and G.rate_code("100") == "100"


@pytest.fixture(scope="module")
def candles(spark):
    from tidebar.catalog.base import rule_bars

    rows = rule_bars(spark, SF).select("series_id", "i", "ct", "o", "h", "l", "c", "atr14", "dir").orderBy("series_id", "i").toPandas()
    return {k: g.reset_index(drop=True) for k, g in rows.groupby("series_id")}


def brute_exits(b, i, side):
    """plan_id: (exit_i, exit_px) of one entry, bar after bar."""
    n, px, atr = len(b["c"]), b["c"][i], b["atr14"][i]
    inside = {1: px * (1 - side * 0.2), 2: px * (1 + side * 0.3), 5: px - side * 0.5 * atr, 10: px + side * 0.5 * atr}
    ma = [sum(b["c"][j - 9 : j + 1]) / 10 if j >= 9 else math.nan for j in range(n)]
    wrong = lambda x, y: x < y if side == 1 else x > y
    hits = {
        **{p: (lambda j, v=v: b["l"][j] <= v if side == 1 else b["h"][j] >= v) for p, v in inside.items() if p in (1, 5)},
        **{p: (lambda j, v=v: b["h"][j] >= v if side == 1 else b["l"][j] <= v) for p, v in inside.items() if p in (2, 10)},
        3: lambda j: j == i + 5, 4: lambda j: j >= i + 3 and all(wrong(x, px) for x in b["c"][j - 2 : j + 1]),
        6: lambda j: j >= i + 2 and wrong(b["c"][j], ma[j]) and wrong(b["c"][j - 1], ma[j - 1]), 7: lambda j: j == i + 4 and (b["c"][j] - px) * side > 0,
        8: lambda j: b["dir"][j] == -side, 9: lambda j: b["dir"][j] == -side and (b["c"][j] - px) * side > 0,
    }
    first = {p: next((j for j in range(i + 1, n) if f(j)), None) for p, f in hits.items()}
    return {p: (j, None if j is None else inside.get(p, b["c"][j])) for p, j in first.items()}


def test_exit_plans_of_every_entry(spark, candles):
    want = {}
    for name, g in candles.items():
        b = {k: g[k].tolist() for k in g.columns}
        for i in range(len(g)):
            if b["c"][i] != b["o"][i]:
                side = 1 if b["c"][i] > b["o"][i] else -1
                want |= {(name, i, side, p): x for p, x in brute_exits(b, i, side).items()}
    assert len(candles) == 6 and "all" in candles
    rows = market.QUERIES["exit_plans"](spark, SF).collect()
    got = {(r["series_id"], r["i"], r["side"], r["plan_id"]): (r["exit_i"], r["exit_px"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for k, (j, px) in want.items():
        assert got[k][0] == j and (px is None and got[k][1] is None or abs(got[k][1] - px) < 1e-5), k


def test_replays_alike_however_dealt(spark, monkeypatch):
    """Bars sent to every task, or cogrouped with deals of configurations: one result."""
    from tidebar.catalog.base import rule_bars
    from tidebar.operators import replay as Rp

    b = rule_bars(spark, SF).select("series_id", "i", "ct", "o", "h", "l", "c", "atr14").where("i < 150").cache()
    e = b.where("c <> o").select("series_id", F.lit(1).alias("rule_id"), "i", F.when(F.col("c") > F.col("o"), 1).otherwise(-1).alias("side"), F.col("i").alias("run"))
    cfg = spark.range(18).select(F.col("id").alias("config_id"), F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 2 + 1).cast("int")).alias("series_id"), F.lit(1).alias("rule_id"), F.lit(0).alias("stop_id"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("target_id"), F.array(F.lit(1.0), F.lit(4.0)).alias("leverages"))
    P = exits.Plan
    run = lambda n: {(r["config_id"], r["leverage"]): r for r in selection.account_rows(Rp.replay_grid(cfg, b, e, {0: [P(0, "fixed", 0.1)]}, {0: [P(1, "trail_share", 0.05, 0.2)], 1: [P(2, "lock", 0.05, 0.01), P(3, "target", 0.2)], 2: [P(4, "trail_price", 0.05, 0.05)]}, Account(fee=0.0004, protection=0.6), firsts={2: P(5, "target", 0.03)}, broadcast_bytes=n)).collect()}
    whole = run(1 << 30)
    monkeypatch.setattr(Rp, "CONFIGURATIONS", 4)
    assert whole == run(0) and len(whole) == 36 and any(r["orders"] > 2 * r["trades"] for r in whole.values())
    few = exits.exit_table(e, b, [P(1, "fixed", 0.1)], each=40)
    assert sorted(few.collect()) == sorted(exits.exit_table(e, b, [P(1, "fixed", 0.1)]).collect())


def test_replays_take_every_series(spark, candles):
    grid = market.QUERIES["replay_configurations"](spark, SF).select("series_id", "config_id").distinct().collect()
    assert {r["series_id"] for r in grid} == candles.keys() and len(grid) == 6 * 12


def test_all_stop_definitions():
    from tidebar.plans import grid as G

    codes = G.all_stop_codes()
    assert len(codes) == len(set(codes)) == 6666
    assert codes[:4] == ["S1", "S3_1m", "S1+S3_1m", "S4_1m"] and codes[151] == "OFF" and codes[152] == "S1+S9_1m" and codes[911] == "OFF+S9_4h"
    assert codes[912] == "ATR50_1m" and codes[995] == "BAD30_1m" and codes[996] == "S1+ATR50_1m" and codes[3179] == "S9_4h+BAD30_1m" and codes[-1] == "BAD15_1m+BAD30_1m"
    assert {"S3_15m+S5_15m+S9_5m", "S1+S3_1m+S9_4h", "S1+S3_15m+S4_15m+S5_15m+S6_15m"} <= set(codes)
