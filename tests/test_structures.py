"""Structures against slow versions that go bar by bar with states of their own, and against prefixes."""

import math

import numpy as np
import pytest
from test_learned import DAY, STEP, bars, by_bar, each

from tidebar.functions.folds import seeded_by_mean
from tidebar.operators import structures as S
from tidebar.operators.walkforward import numbered

RULES = {
    "triangles": lambda b: S.triangles(b, within=120, flat=4.0, narrow=1.0, patience=40),
    "pivot_clusters": lambda b: S.pivot_clusters(b, STEP, 3, 6, near=1.0, patience=20),
    "cascade": lambda b: S.cascade(b, STEP, 2, 3, rows=12, times=1.1, patience=12),
    "point_and_figure": lambda b: S.point_and_figure(b, bars_a_day=144, of_range=0.6),
}


def made(spark, n=None):
    pdf = bars(1200, seed=3)
    return numbered(spark.createDataFrame(pdf if n is None else pdf.groupby("series_id").head(n)))


@pytest.fixture(scope="module")
def said(spark):
    return {name: by_bar(rule(made(spark))) for name, rule in RULES.items()}


@pytest.mark.parametrize("name", RULES)
def test_no_bar_changes_when_later_bars_come(spark, said, name):
    short = by_bar(RULES[name](made(spark, 777)))
    assert short == {k: v for k, v in said[name].items() if k[1] < 777} and short


def pivots(b, t):
    h, low, k = b["h"], b["l"], t - 2
    if t < 4:
        return None, None
    near = [k - 2, k - 1, k + 1, k + 2]
    return h[k] if all(h[k] > h[j] for j in near) else None, low[k] if all(low[k] < low[j] for j in near) else None


def test_triangles(said):
    want = {}
    for s, b, *_ in each(bars(1200, seed=3)):
        points, wait, c = [], None, b["c"]
        for t in range(len(c)):
            side = 0
            if wait and t > wait["at"] + 40:
                wait = None
            elif wait and wait["sign"] * (c[t] - wait["level"]) > wait["buffer"] >= wait["sign"] * (c[t - 1] - wait["level"]):
                side, wait = wait["sign"], None
            opens = None
            high, low = pivots(b, t)
            if (high is None) != (low is None):
                kind, value = (1, high) if low is None else (-1, low)
                if not (points and points[-1][0] == kind and kind * value < kind * points[-1][2]):
                    if points and points[-1][0] == kind:
                        points.pop()
                    points.append((kind, t - 2, value))
                    near = [p for p in points if t - 2 - p[1] <= 120][-6:]
                    if len(near) == 6:
                        hv, lv, a = [p[2] for p in near if p[0] == 1], [p[2] for p in near if p[0] == -1], b["atr14"][t]
                        if hv[0] > lv[0] and 0 < hv[2] - lv[2] <= 1.0 * (hv[0] - lv[0]):
                            up = max(hv) - min(hv) <= 4.0 * a and lv[0] < lv[1] < lv[2]
                            down = max(lv) - min(lv) <= 4.0 * a and hv[0] > hv[1] > hv[2]
                            if up != down:
                                opens = wait = {"at": t, "sign": 1 if up else -1, "level": max(hv) if up else min(lv), "buffer": 0.1 * a}
                            elif up:
                                wait = None
                                want[s, t] = (None, None, side)
            if opens or side:
                want[s, t] = (opens["sign"], opens["level"], side) if opens else (None, None, side)
    got = {k: (v["opens"], v["level"], v["side"]) for k, v in said["triangles"].items()}
    assert got == want and sum(1 for v in want.values() if v[2]) >= 3


def larger(b, n):
    """Bars of n, by their last place."""
    out = [t for t in range(n - 1, len(b["c"])) if b["ct"][t] % (n * STEP) == 0]
    return out, [b["o"][t - n + 1] for t in out], [max(b["h"][t - n + 1 : t + 1]) for t in out], [min(b["l"][t - n + 1 : t + 1]) for t in out], [b["c"][t] for t in out]


def ranges(h, low, c):
    return np.array([h[0] - low[0]] + [max(h[k] - low[k], abs(h[k] - c[k - 1]), abs(low[k] - c[k - 1])) for k in range(1, len(c))])


def test_pivot_clusters(said):
    want = {}
    for s, b, *_ in each(bars(1200, seed=3)):
        c, frames = b["c"], []
        for n in (3, 6):
            at, o, h, low, close = larger(b, n)
            frames.append({t: (*pivots({"h": h, "l": low}, k), seeded_by_mean(ranges(h, low, close), 14)[k]) for k, t in enumerate(at)})
        latest, wait, scale = {}, [None, None], math.nan
        for t in range(len(c)):
            fired, opened, changed = [False, False], [None, None], [False, False]
            for n, frame in enumerate(frames):
                if t in frame:
                    for side in (0, 1):
                        if frame[t][side] is not None:
                            latest[n, side], changed[side] = frame[t][side], True
                    if n:
                        scale = frame[t][2]
            for side, sign in ((0, 1), (1, -1)):
                if wait[side] and t > wait[side][0] + 20:
                    wait[side] = None
                if wait[side] and sign * (c[t - 1] - wait[side][1]) <= 0 < sign * (c[t] - wait[side][1]):
                    fired[side], wait[side] = True, None
                if changed[side]:
                    a, d = latest.get((0, side)), latest.get((1, side))
                    near = a is not None and d is not None and abs(a - d) <= 1.0 * scale
                    wait[side] = opened[side] = (t, (max, min)[side](a, d) + sign * 0.1 * b["atr14"][t]) if near else None
            if any(fired) or any(opened):
                want[s, t] = (opened[0] and opened[0][1], opened[1] and opened[1][1], *fired)
    got = said["pivot_clusters"]
    assert got.keys() == want.keys() and sum(v[2] or v[3] for v in want.values()) > 5
    for k, v in want.items():
        assert (got[k]["up"], got[k]["down"]) == v[2:]
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip((got[k]["above"], got[k]["below"]), v))


def test_cascade(said):
    want = {}
    for s, b, *_ in each(bars(1200, seed=3)):
        n = len(b["c"])
        events = []
        for size in (3, 2, 1):
            at, o, h, low, c = larger(b, size) if size > 1 else (list(range(n)), b["o"], b["h"], b["l"], b["c"])
            tr, e, last = ranges(h, low, c), [0] * n, False
            for k, t in enumerate(at):
                now = k >= 12 and tr[k] > 1.1 * tr[k - 12 : k].mean()
                if now and not last:
                    e[t] = int(np.sign(c[k] - o[k]))
                last = now
            events.append(e)
        stage = sign = begun = second = 0
        for t in range(n):
            if stage and t - begun > 12:
                stage = 0
            if events[0][t]:
                sign, stage, begun = events[0][t], 1, t
            elif stage == 1 and events[1][t]:
                stage, second = (2, t) if events[1][t] == sign else (0, 0)
            elif stage == 2 and events[2][t]:
                if events[2][t] == sign:
                    want[s, t] = (begun, second, sign)
                stage = 0
    got = {k: (v["first"], v["second"], v["side"]) for k, v in said["cascade"].items()}
    assert got == want and len(want) > 5


def test_point_and_figure(said):
    want = {}
    for s, b, _, _, day in each(bars(1200, seed=3)):
        for d in np.unique(day):
            own, past = np.flatnonzero(day == d), np.flatnonzero(day == d - 1)
            if len(past) != 144:
                continue
            height = max(0.6 * np.median(b["atr14"][past]), 0.01)
            kind, top, bottom, done, used = None, None, None, [], False
            for t in own:
                box, side = math.floor(b["c"][t] / height), 0
                if top is None:
                    top = bottom = box
                elif kind is None:
                    kind = "X" if box > top else "O" if box < bottom else None
                    top, bottom = max(top, box), min(bottom, box)
                    if kind:
                        top = bottom = box
                elif kind == "X" and box <= top - 3:
                    done.append(("X", top))
                    kind, bottom, used = "O", box, False
                elif kind == "O" and box >= bottom + 3:
                    done.append(("O", bottom))
                    kind, top, used = "X", box, False
                elif kind == "X":
                    top = max(top, box)
                else:
                    bottom = min(bottom, box)
                if kind and len(done) >= 2 and not used:
                    last = [v for k, v in done if k == kind][-1:]
                    if last and (box > last[0] if kind == "X" else box < last[0]):
                        side, used = (1 if kind == "X" else -1), True
                want[s, t] = (box, {"X": 1, "O": -1, None: 0}[kind], len(done) + 1, side)
    got = {k: (v["box"], v["column"], v["columns"], v["side"]) for k, v in said["point_and_figure"].items()}
    assert got == want and sum(1 for v in want.values() if v[3]) > 5


def test_values_of_a_larger_bar_are_not_read_before_its_close(spark):
    """Changing a larger bar's last small bar changes nothing before it."""
    n = 600
    base, other = bars(n, seed=3), bars(n, seed=3)
    last = (other["ct"] % (6 * STEP) == 0) & (other["ct"] > other["ct"].max() - 12 * STEP)
    at = other[last].groupby("series_id")["ct"].min()
    other.loc[last, ["h", "c"]] *= 1.5
    for name in ("pivot_clusters", "cascade"):
        a, b = (by_bar(RULES[name](numbered(spark.createDataFrame(x)))) for x in (base, other))
        for rows in (a, b):
            for k in [k for k, v in rows.items() if v["ct"] >= at[k[0]]]:
                del rows[k]
        assert a == b and a
    assert (at % DAY >= 0).all()


# ---- ranks, limits, coverage, restoring


def test_counted_ranks_are_percent_ranks(spark):
    import random

    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tidebar.operators import selection as Sel

    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, 0.0, r.gauss(0, 1), float("nan")]), r.randint(0, 5)) for i in range(700)] + [(700, "alone", 1.0, 2)]
    df = spark.createDataFrame(rows, "id int, k string, x double, y int")
    for parts in (1, 8):
        got = Sel.counted_ranks(df, "k", [("x", True), ("y", False)], parts).select("id", "r_x", "r_y").collect()
        rank = lambda c: F.when(F.count("*").over(W.partitionBy("k")) == 1, 0.5).otherwise(F.percent_rank().over(W.partitionBy("k").orderBy(c)))
        want = df.select("id", rank(F.asc("x")).alias("r_x"), rank(F.desc("y")).alias("r_y")).collect()
        assert len(got) == len(rows) and all(abs(a[1] - b[1]) < 1e-12 and abs(a[2] - b[2]) < 1e-12 for a, b in zip(sorted(got), sorted(want)))


def test_limits_coverage_and_restoring_on_odd_rows(spark):
    from pyspark.sql import functions as F

    from tidebar.operators import selection as Sel

    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, 1.0, 5), (2, None, 5), (3, nan, 5), (4, inf, 5), (5, 2.0, None), (6, 2.0, 4), (7, 0.5, 9)], "id int, x double, n int")
    ok = lambda **limits: [x["id"] for x in df.where(Sel.within_limits(**limits)).sort("id").collect()]
    assert ok(x=(0.5, 2.0)) == [1, 5, 6, 7] and ok(x=(None, 1.0), n=(5, None)) == [1, 7] and ok(x=(None, None)) == [1, 5, 6, 7] and ok() == [1, 2, 3, 4, 5, 6, 7]

    options = spark.createDataFrame([("size", "1", "done"), ("size", "1", "queued"), ("size", "2", "queued"), ("size", "x", "done"), ("stop", "S1", "failed")], "key string, option string, state string")
    universe = spark.createDataFrame([("size", "1"), ("size", "2"), ("size", "3"), ("stop", "S1"), ("stop", "S1"), ("none", "a")], "key string, option string")
    got = {x["key"]: tuple(x)[1:] for x in Sel.coverage(options, universe, F.col("state") == "done").collect()}
    assert got == {"size": (3, 2, ["2"], ["3"]), "stop": (1, 0, ["S1"], []), "none": (1, 0, [], ["a"])}

    rows = spark.createDataFrame([(5, 1, "a"), (3, 1, "a"), (9, 2, None)], "id int, p int, q string").withColumn("fp", Sel.fingerprint("p", "q"))
    fps = {x["id"]: x["fp"] for x in rows.collect()}
    text = spark.createDataFrame([(f"{fps[5].upper()}\n{fps[9]}, 0000000000000000 and not g{fps[3]} {fps[3]}0",), (None,), ("",)], "t string")
    wanted = Sel.wanted_fingerprints(text, "t")
    got = {x["fingerprint"]: tuple(x)[1:] for x in Sel.restored(wanted, {"best": rows, "worst": rows.where("id = 3")}, ["p", "q"], "id").collect()}
    assert got == {fps[5]: (3, 1, "a", 3, ["best", "worst"], False), fps[9]: (9, 2, None, 1, ["best"], False), "0" * 16: (None, None, None, 0, [], False)}
