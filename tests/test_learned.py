"""Walk-forward models against slow versions by definition, bar after bar over a whole series, and against prefixes of it."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest

from tidebar.functions.models import boosting, forest, gaussian, hidden, logit, quantile, recurrence, reverting, tail
from tidebar.operators import learned as L
from tidebar.operators import walkforward as WF

STEP, DAY = 600_000, 86_400_000


def bars(n=620, seed=1, series=("a", "b")):
    """Ten-minute bars with calm and wild stretches, drifts, and jumps; they begin within a day."""
    out = []
    for s in series:
        r = np.random.default_rng([seed, zlib.crc32(s.encode())])
        wild = np.where(np.arange(n) // 37 % 3 == 2, 4.0, 1.0)
        step = r.normal(0, 0.001, n) * wild + np.where(np.arange(n) // 53 % 2 == 0, 0.0006, -0.0006)
        step[r.random(n) < 0.01] *= 6
        c = 100 * np.exp(np.cumsum(step))
        o = np.append(100.0, c[:-1])
        reach = np.abs(r.normal(0, 0.0006, n)) * c
        h, low = np.maximum(o, c) + reach, np.minimum(o, c) - reach
        v = r.gamma(3, 10, n) * wild
        tr = pd.Series(h - low)
        out.append(pd.DataFrame({"series_id": s, "segment": 0, "ct": DAY * 20000 + STEP * (np.arange(n) + 50), "o": o, "h": h, "l": low, "c": c, "v": v, "atr14": tr.rolling(14, min_periods=1).mean(), "trades": np.round(v) + 1.0, "delta": v * r.uniform(-0.8, 0.8, n)}))
    return pd.concat(out, ignore_index=True)


def by_bar(df):
    return {(x["series_id"], x["i"]): x for x in (r.asDict() for r in df.collect())}


def each(pdf):
    for s, g in pdf.groupby("series_id"):
        g = g.sort_values("ct")
        x = np.log(g["c"].to_numpy())
        yield s, {k: g[k].to_numpy() for k in g.columns}, x, np.diff(x, prepend=np.nan), (g["ct"].to_numpy() - 1) // DAY


RULES = {
    "hidden_states": lambda b: L.hidden_states(b, rows=150),
    "boosted_trees": lambda b: L.boosted_trees(b, rows=150, rounds=8, least=0.4, ahead=0.05, cost=1e-3),
    "class_logit": lambda b: L.class_logit(b, rows=150, least=0.4, ahead=0.05, cost=1e-3),
    "gaussian_process": lambda b: L.gaussian_process(b, rows=80, every=30, bound=0.2),
    "quantile_band": lambda b: L.quantile_band(b, rows=100, every=30),
    "tail_fade": lambda b: L.tail_fade(b, rows=200, scale=40, least=8, rare=0.03),
    "recurrence_turn": lambda b: L.recurrence_turn(b, rows=60, limit=0.3),
    "flow_lags": lambda b: L.flow_lags(b, rows=150, horizon=5, errors=12),
    "expert_mix": lambda b: L.expert_mix(b, rows=150, ar_rows=60, ou_rows=80, cost=1e-3),
    "partial_bucket": lambda b: L.partial_bucket(b, STEP, 6, 2, rows=30, usual=4, still=5.0, buckets=7),
    "isolation_forest": lambda b: L.isolation_forest(b, rows=150, trees=20, contamination=0.05, patience=4),
}


@pytest.fixture(scope="module")
def said(spark):
    b = spark.createDataFrame(bars())
    return {name: by_bar(rule(b)) for name, rule in RULES.items()}


@pytest.mark.parametrize("name", RULES)
def test_no_bar_changes_when_later_bars_come(spark, said, name):
    n = 431  # in the middle of a day
    short = by_bar(RULES[name](spark.createDataFrame(bars().groupby("series_id").head(n))))
    long = {k: v for k, v in said[name].items() if k[1] < n}
    assert short.keys() == long.keys() and len(short) > (30 if name != "partial_bucket" else 15)
    for k, row in short.items():
        for c, x in row.items():
            assert x == long[k][c] or (isinstance(x, float) and (abs(x - long[k][c]) < 1e-9 or math.isnan(x) and math.isnan(long[k][c]))), (k, c)
    assert any(v["side"] for v in said[name].values())


def test_blocks_cover_each_bar_once_and_look_back_far_enough(spark):
    b = WF.numbered(spark.createDataFrame(bars(300)))
    for blocks, back in ((WF.day_blocks(b, 70), 70), (WF.row_blocks(b, 33, 50, 40), 33)):
        got = blocks.select("series_id", "block", "i", "own").toPandas()
        own = got[got["own"]]
        assert not own.duplicated(["series_id", "i"]).any()
        for _, g in got.groupby(["series_id", "block"]):
            if not g["own"].any():
                continue
            first = g.loc[g["own"], "i"].min()
            assert sorted(g["i"]) == list(range(max(0, first - back), g.loc[g["own"], "i"].max() + 1))
        assert len(own) == (600 if back == 70 else 2 * 260)


# ---- the hidden chain


def slow_filter(x, chain, before=None):
    out = []
    for k, v in enumerate(x):
        prior = (chain.start if k == 0 and before is None else (before if k == 0 else out[-1]) @ chain.moves)
        like = np.exp(-0.5 * (v - chain.means) ** 2 / chain.variances) / np.sqrt(2 * np.pi * chain.variances)
        out.append(prior * like / (prior * like).sum())
    return np.array(out)


def test_filter_is_the_forward_recursion():
    r = np.random.default_rng(1)
    chain = hidden.Chain(np.array([0.3, 0.7]), np.array([[0.95, 0.05], [0.2, 0.8]]), np.array([-1.0, 2.0]), np.array([1.0, 3.0]))
    for n in (1, 2, 17, 1000):
        x = r.normal(0, 2, n)
        assert np.abs(hidden.filtered(x, chain) - slow_filter(x, chain)).max() < 1e-9
        assert np.abs(hidden.filtered(x, chain, np.array([0.1, 0.9])) - slow_filter(x, chain, np.array([0.1, 0.9]))).max() < 1e-9


def test_expectation_maximisation_finds_the_states():
    r, state, x = np.random.default_rng(2), 0, []
    for _ in range(4000):
        state = state if r.random() < 0.97 else 1 - state
        x.append(r.normal((-1, 3)[state], (1, 2)[state]))
    chain = hidden.fit(np.array(x))
    assert np.abs(chain.means - [-1, 3]).max() < 0.2 and np.abs(np.sqrt(chain.variances) - [1, 2]).max() < 0.2 and np.abs(np.diag(chain.moves) - 0.97).max() < 0.01
    like = lambda c: np.log([(p * np.exp(-0.5 * (v - c.means) ** 2 / c.variances) / np.sqrt(2 * np.pi * c.variances)).sum() for p, v in zip(np.vstack([c.start, slow_filter(x, c)[:-1] @ c.moves]), x)]).sum()
    best = like(chain)
    for change in range(6):  # a maximum: no small change of any parameter is better
        for sign in (-1, 1):
            moved = hidden.Chain(chain.start, chain.moves.copy(), chain.means.copy(), chain.variances.copy())
            if change < 2:
                moved.means[change] += sign * 0.05
            elif change < 4:
                moved.variances[change - 2] *= 1 + sign * 0.05
            else:
                moved.moves[change - 4] = np.clip(moved.moves[change - 4] + sign * np.array([0.01, -0.01]), 1e-6, 1)
            assert like(moved) <= best
    assert hidden.fit(np.ones(50)) is None and hidden.fit(np.array([1.0, np.nan, 2.0])) is None


def test_hidden_states_bar_by_bar(said):
    want = {}
    for s, b, x, r, day in each(bars()):
        chain = p = None
        for t in range(151, len(x)):
            if t == 151 or day[t] != day[t - 1]:
                train = r[t - 150 : t] * 1e4
                chain = hidden.fit(train)
                p = slow_filter(train, chain)[-1] if chain else None
            if chain is None:
                continue
            last, p = p, slow_filter([r[t] * 1e4], chain, p)[0]
            up, down = last[1] < 0.6 and p[1] > 0.8 and chain.means[1] / 1e4 > 1e-5, last[0] < 0.6 and p[0] > 0.8 and chain.means[0] / 1e4 < -1e-5
            want[s, t] = (p, int(up) - int(down))
    got = said["hidden_states"]
    assert got.keys() == want.keys()
    assert all(abs(got[k]["p_high"] - p[1]) < 1e-9 and got[k]["side"] == side for k, (p, side) in want.items())


# ---- trees and regressions


def test_boosting_first_split_is_the_best_of_all():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    y = (x[:, 1] + 0.3 * r.normal(size=200) > 0.2).astype(int)
    model = boosting.fit(x, y, 2, rounds=1, depth=1, least_rows=20)
    p = np.bincount(y) / len(y)
    g, h = p[1] - y, np.full(200, p[1] * (1 - p[1]))
    best = max((g[m].sum() ** 2 / h[m].sum() + g[~m].sum() ** 2 / h[~m].sum(), j, np.sort(x[:, j])[k]) for j in range(3) for k in range(19, 180) for m in [x[:, j] <= np.sort(x[:, j])[k]] if 20 <= m.sum() <= 180)
    feature, cut, value = model.nodes[0][1]
    edge = model.edges[feature[0]][cut[0]]
    assert feature[0] == best[1] and best[2] <= edge < np.sort(x[x[:, best[1]] > best[2], best[1]])[0]
    left = x[:, feature[0]] <= edge
    assert np.allclose(value[1:3], [-0.05 * g[left].sum() / h[left].sum(), -0.05 * g[~left].sum() / h[~left].sum()])


def test_boosting_learns_and_walks_its_trees():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0.4, 2, np.where(x[:, 2] > 1, 0, 1))
    model = boosting.fit(x[:2000], y[:2000], 3)
    p = boosting.probabilities(model, x[2000:])
    assert (p.argmax(1) == y[2000:]).mean() > 0.93 and np.allclose(p.sum(1), 1)

    def walk(tree, row):
        node = 0
        while tree[0][node] >= 0:
            node = 2 * node + 1 + (row[tree[0][node]] > model.edges[tree[0][node]][tree[1][node]])
        return tree[2][node]

    for row, q in zip(x[2000:2020], p):
        score = model.base + [sum(walk(trees[k], row) for trees in model.nodes) for k in range(3)]
        assert np.allclose(np.exp(score) / np.exp(score).sum(), q)


def test_logit_is_at_its_optimum():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = (x @ [1.0, -1, 0] + r.logistic(size=400) > 0).astype(int) + (x[:, 2] > 1)
    w = logit.fit(x, y, 3)
    value, gradient = logit.objective(w, x, np.eye(3)[y], 1.0)
    assert np.abs(gradient).max() < 1e-4
    for _ in range(30):
        assert logit.objective(w + r.normal(size=w.shape) * 0.01, x, np.eye(3)[y], 1.0)[0] >= value


@pytest.mark.parametrize("name,fit,say", [("boosted_trees", lambda x, y: boosting.fit(x, y, 3, rounds=8), boosting.probabilities), ("class_logit", lambda x, y: logit.fit(x, y, 3), logit.probabilities)])
def test_class_rules_bar_by_bar(said, name, fit, say):
    want = {}
    for s, b, x, _, day in each(bars()):
        f, p = L.features(b), None
        up = down = False
        for t in range(180, len(x)):
            if t == 180 or day[t] != day[t - 1]:
                rows = np.arange(t - 9 - 150, t - 9)
                y = x[rows + 10] - x[rows]
                label = np.where(y > 1e-3, 2, np.where(y < -1e-3, 0, 1))
                model = None
                if np.bincount(label, minlength=3).min() >= 10:
                    m, d = f[rows].mean(0), f[rows].std(0)
                    model = fit((f[rows] - m) / d, label)
            if model is None:
                up = down = False
                continue
            p = say(model, (f[t : t + 1] - m) / d)[0]
            now = p[2] > 0.4 and p[2] - p[0] > 0.05, p[0] > 0.4 and p[0] - p[2] > 0.05
            want[s, t] = (p, int(now[0] and not up) - int(now[1] and not down))
            up, down = now
    got = said[name]
    assert got.keys() == want.keys() and len(got) > 50
    assert all(np.abs(np.array([got[k]["p_falls"], got[k]["p_stays"], got[k]["p_rises"]]) - p).max() < 1e-7 and got[k]["side"] == side for k, (p, side) in want.items())


def test_gaussian_process_is_the_dense_solution(said):
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 2))
    y = np.sin(2 * x[:, 0]) * 3 + 0.2 * r.normal(size=90) + 5
    model = gaussian.fit(x, y)
    new = r.normal(size=(40, 2))
    kernel = lambda a, b: np.exp(-((a[:, None] - b) ** 2).sum(2) / (2 * model.length**2))
    inverse = np.linalg.inv(kernel(x, x) + (model.noise + gaussian.JITTER) * np.eye(90))
    mean = kernel(new, x) @ inverse @ (y - y.mean()) + y.mean() * np.ones(40)
    deviation = np.sqrt(1 + model.noise - np.einsum("ij,jk,ik->i", kernel(new, x), inverse, kernel(new, x))) * y.std()
    got = gaussian.predict(model, new)
    assert np.abs(got[0] - mean).max() < 1e-6 and np.abs(got[1] - deviation).max() < 1e-6
    d2, z = ((x[:, None] - x) ** 2).sum(2), (y - y.mean()) / y.std()
    for theta in (np.log([0.5, 0.2]), np.log([2.0, 0.01])):
        _, g = gaussian.likelihood(theta, d2, z)
        slow = [(gaussian.likelihood(theta + e, d2, z)[0] - gaussian.likelihood(theta - e, d2, z)[0]) / 2e-5 for e in np.eye(2) * 1e-5]
        assert np.allclose(g, slow, rtol=1e-4)
    best = gaussian.likelihood(np.log([model.length, model.noise]), d2, z)[0]
    assert all(gaussian.likelihood(np.array([a, b]), d2, z)[0] <= best + 1e-3 for a in np.linspace(-2, 2, 15) for b in np.linspace(-6, 1, 15))
    # the rule: one fit by hand, at the third refit of the first series
    s, b, logs, _, _ = next(each(bars()))
    t = 80 + 5 + 20 + 60
    f = L.features(b)[:, :5]
    own = np.arange(t - 4 - 80, t - 4)
    m, d = f[own].mean(0), f[own].std(0)
    p = gaussian.predict(gaussian.fit((f[own] - m) / d, logs[own + 5] - logs[own]), (f[t : t + 30] - m) / d)
    assert all(abs(said["gaussian_process"][s, t + k]["mean"] - p[0][k]) < 1e-9 and abs(said["gaussian_process"][s, t + k]["deviation"] - p[1][k]) < 1e-9 for k in range(30))


def test_quantile_regression_by_subgradients():
    r = np.random.default_rng(7)
    for n, d, alpha, tau in ((240, 4, 0.01, 0.1), (240, 4, 0.01, 0.9), (60, 2, 0.0, 0.5), (100, 3, 0.3, 0.25), (40, 1, 0.0, 0.9)):
        x = r.normal(size=(n, d))
        y = x @ r.normal(size=d) + r.standard_t(3, n)
        b = quantile.fit(x, y, tau, alpha)
        design, response, taus = quantile.rows_of_penalty(x, y, tau, alpha)
        u = response - design @ b
        at = np.abs(u) < 1e-9
        assert at.sum() >= d + 1
        # 0 is in the subdifferential: weights between tau - 1 and tau of the rows on the plane balance all others
        side = -design[~at].T @ np.where(u[~at] > 0, taus[~at], taus[~at] - 1)
        weights = np.linalg.lstsq(design[at].T, side, rcond=None)[0]
        assert np.allclose(design[at].T @ weights, side, atol=1e-8)
        if at.sum() == d + 1:
            assert (weights <= taus[at] + 1e-7).all() and (weights >= taus[at] - 1 - 1e-7).all()
        best = quantile.loss(b, design, response, taus)
        assert all(quantile.loss(b + r.normal(size=d + 1) * s, design, response, taus) >= best - 1e-9 for s in (1e-4, 1e-2, 1) for _ in range(50))
    assert abs(quantile.fit(np.zeros((101, 1)), np.arange(101.0), 0.25, 0.01)[0] - 25) < 1e-6


def test_quantile_band_bar_by_bar(said):
    s, b, logs, r, _ = next(each(bars()))
    x = np.column_stack([r, np.append(np.nan, r[:-1]), logs - np.concatenate([np.full(5, np.nan), logs[:-5]]), b["atr14"] / b["c"]])
    last = False, False
    for t in range(122, len(r)):
        if (t - 122) % 30 == 0:
            own = np.arange(t - 101, t - 1)
            m, d = x[own].mean(0), x[own].std(0)
            models = [quantile.fit((x[own] - m) / d, r[own + 1], q) for q in (0.1, 0.9)]
        low, high = (w[0] + (x[t - 1] - m) / d @ w[1:] for w in models)
        now = low <= high and r[t] > high, low <= high and r[t] < low
        row = said["quantile_band"][s, t]
        assert abs(row["lower"] - low) < 1e-9 and abs(row["upper"] - high) < 1e-9
        assert row["side"] == int(now[0] and not last[0]) - int(now[1] and not last[1])
        last = now


# ---- tails, recurrence, forests


def test_pareto_likelihood_is_not_below_a_grid():
    r = np.random.default_rng(8)
    for x in (r.exponential(2, 200), r.pareto(3, 500), r.uniform(0, 1, 150), r.pareto(1.2, 120) * 0.001, np.full(50, 2.0), r.gamma(0.5, 1, 100)):
        shape, scale = tail.fit(x)
        best = tail.likelihood(x, shape, scale)
        grid = max(tail.likelihood(x, k, s) for k in np.linspace(-0.99, 3, 80) for s in np.geomspace(x.mean() / 50, x.mean() * 50, 200))
        assert np.isfinite(best) and best >= grid - 1e-6
    assert np.allclose(tail.survival(np.array([0.0, 1.0]), 0.5, 2.0), [1, 1.25**-2]) and tail.fit(np.array([])) is None


def test_tail_fade_bar_by_bar(said):
    want = {}
    for s, b, x, r, day in each(bars()):
        z = r / pd.Series(r).rolling(40, min_periods=40).std(ddof=0).shift(1).to_numpy()
        c, o, models, chance = b["c"], b["o"], [None, None], None
        for t in range(241, len(x)):
            if t == 241 or day[t] != day[t - 1]:
                models = []
                for sign in (-1, 1):
                    own = sign * z[t - 200 : t]
                    limit = np.quantile(own, 0.95)
                    over = own[own > limit] - limit
                    models.append((limit, *tail.fit(over)) if len(over) >= 8 else None)
            side = 0
            if chance and t > chance[1] + 5:
                chance = None
            elif chance and chance[0] * (c[t] - c[t - 1]) > 0 and chance[0] * (c[t] - (chance[3] + (chance[2] - chance[3]) / 3)) >= 0:
                side, chance = chance[0], None
            for k, m in enumerate(models):
                v = z[t] * (1 if k else -1)
                if m and (tail.survival(v - m[0], *m[1:]) if v > m[0] else 1) < 0.03:
                    chance = (-1 if k else 1, t, o[t], c[t])
            want[s, t] = side
    got = said["tail_fade"]
    assert {k: v["side"] for k, v in got.items()} == want and sum(map(abs, want.values())) >= 3


def test_recurrence_by_definition(said):
    def slow(w):
        x = (w - w.mean()) / w.std()
        n = len(x) - 2
        near = {(i, j) for i in range(n) for j in range(n) if abs(i - j) > 2 and sum((x[i + k] - x[j + k]) ** 2 for k in range(3)) < 0.25}
        long = set()
        for i, j in near:
            line = [(i, j)]
            for d in (-1, 1):
                k = 1
                while (i + d * k, j + d * k) in near:
                    line.append((i + d * k, j + d * k))
                    k += 1
            if len(line) >= 3:
                long.add((i, j))
        return len(long) / len(near) if near else math.nan

    r = np.random.default_rng(9)
    for w in (r.normal(size=60), np.sin(np.arange(80) / 3), r.normal(size=120).cumsum(), np.tile(r.normal(size=7), 12) + r.normal(size=84) * 0.1):
        assert abs(recurrence.determinism(w) - slow(w)) < 1e-12
    assert math.isnan(recurrence.determinism(np.ones(40)))
    for s, b, x, ret, _ in each(bars()):
        last = math.nan
        for t in range(61, len(x), 5):
            now = slow(ret[t - 60 : t])
            row = said["recurrence_turn"][s, t]
            assert abs(row["determinism"] - now) < 1e-9 and row["side"] == (np.sign(x[t] - x[t - 10]) if last <= 0.3 < now else 0)
            last = now
        break


def test_forest_scores_are_the_recursive_ones():
    r = np.random.default_rng(10)
    x = r.normal(size=(600, 4))
    x[:5] += 6
    model = forest.fit(x, seed=3, trees=30, sample=128, contamination=0.02)

    def length(k, row, node=0):
        f = model.feature[k][node]
        return model.path[k][node] if f < 0 else length(k, row, 2 * node + 1 + (row[f] > model.threshold[k][node]))

    got = forest.anomaly(model, x[:40])
    assert np.allclose(got, [2 ** (-np.mean([length(k, row) for k in range(30)]) / model.expected) for row in x[:40]])
    assert got[:5].min() > got[5:].max() and 0.01 < (forest.decision(model, x) < 0).mean() <= 0.025
    assert np.array_equal(forest.anomaly(forest.fit(x, 3, 30, 128), x), forest.anomaly(model, x))

    def build(rows, level):  # path lengths by their definition: a leaf's level plus what its rows would still take
        return level + (2 * (math.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows if rows > 2 else rows - 1 if rows > 0 else 0)

    assert math.isclose(forest.expected_path(256), build(256, 0)) and forest.expected_path(2) == 1 and forest.expected_path(1) == 0


def test_isolation_forest_bar_by_bar(spark):
    """The machine over the whole series, with its model kept while an anomaly is open, also over midnight."""
    pdf = bars(620, seed=4)
    day_of = (pdf["ct"].to_numpy() - 1) // DAY
    night = np.isin((pdf["ct"].to_numpy() - 1) % DAY // STEP, (143, 0, 1, 2))  # unusual volumes around each midnight
    pdf.loc[night, "v"] *= 40
    whole = pdf["series_id"].eq("b") & (day_of == day_of.min() + 2)  # and one whole day, so that no refit comes on it
    pdf.loc[whole, "v"] *= 60
    got = by_bar(L.isolation_forest(spark.createDataFrame(pdf), rows=150, trees=20, contamination=0.05, patience=4))
    want, fits = {}, []
    for s, b, x, r, day in each(pdf):
        before = np.append(np.nan, b["c"][:-1])
        tr = np.fmax(b["h"] - b["l"], np.fmax(abs(b["h"] - before), abs(b["l"] - before)))
        f = np.column_stack([r, tr / b["atr14"], np.log(b["v"]), np.log(b["trades"]), b["delta"] / b["v"]])
        model = context = last_day = None
        waits = False
        for t in range(170, len(x)):
            if day[t] != last_day and context is None and not waits:
                last_day, own = day[t], f[t - 150 : t]
                m, d = own.mean(0), own.std(0)
                model = forest.fit((own - m) / d, zlib.crc32(f"{s}:{t}".encode()), trees=20, contamination=0.05)
                fits.append((s, t, t > 170 and day[t] == day[t - 1]))
            score, side = forest.decision(model, (f[t : t + 1] - m) / d)[0], 0
            if waits:
                waits = score < 0
            elif score < 0:
                if context is None:
                    context = (t, x[t - 1], b["atr14"][t] / b["c"][t])
                elif t - context[0] >= 4:
                    context, waits = None, True
            elif context is not None:
                move = x[t - 1] - context[1]
                if t - context[0] <= 4:
                    side = int(move < -context[2] and b["c"][t] > b["c"][t - 1]) - int(move > context[2] and b["c"][t] < b["c"][t - 1])
                context = None
            want[s, t] = (score, side)
    assert any(late for *_, late in fits), "no fit was put off"
    assert got.keys() == want.keys() and all(abs(got[k]["score"] - v[0]) < 1e-9 and got[k]["side"] == v[1] for k, v in want.items())


# ---- lags of flow, experts


def test_levels_are_those_of_a_regression():
    r = np.random.default_rng(11)
    x = np.empty(900)
    x[0] = 5
    for t in range(1, 900):
        x[t] = x[t - 1] + 0.05 * (4.6 - x[t - 1]) + 0.01 * r.normal()
    x[700:720] = np.nan
    at = np.arange(200, 900, 37)
    for t, level, deviation, phi in zip(at, *reverting.fits(x, 200, at)):
        w = x[t - 200 : t]
        if not np.isfinite(w).all():
            assert math.isnan(level)
            continue
        slope, cut = np.polyfit(w[:-1], w[1:], 1)
        half = -np.log(2) / np.log(slope) if 0 < slope < 1 else 0
        if not 3 <= half <= 120:
            assert math.isnan(level)
            continue
        rest = w[1:] - slope * w[:-1] - cut
        assert np.allclose([level, deviation, phi], [cut / (1 - slope), rest.std() / np.sqrt(1 - slope**2), slope], rtol=1e-6)


def test_flow_lags_bar_by_bar(said):
    want = {}
    for s, b, x, r, _ in each(bars()):
        day, share, n = b["ct"] // DAY, b["delta"] / b["v"], len(x)
        usual = np.array([b["trades"][t - 19 : t + 1].mean() if t > 18 else np.nan for t in range(n)])
        back = lambda v, k: np.concatenate([np.full(k, np.nan), v[: n - k]])
        f = np.column_stack([back(share, k) for k in range(10)] + [back(b["trades"] / usual, k) for k in range(10)] + [back(r, k) for k in range(3)])
        up = down = False
        for t in range(183, n):
            if t == 183 or day[t] != day[t - 1]:
                rows = np.arange(t - 4 - 150, t - 4)
                m, d = f[rows].mean(0), f[rows].std(0)
                z, y = (f[rows] - m) / d, x[rows + 5] - x[rows]
                slopes, base, log = np.linalg.solve(z.T @ z + 10 * np.eye(23), z.T @ (y - y.mean())), y.mean(), []
                said_here = {}
            if t - 5 in said_here:
                log.append((abs(said_here[t - 5] - (x[t] - x[t - 5])), x[t] - x[t - 5]))
            p = said_here[t] = base + (f[t] - m) / d @ slopes
            last = np.array(log[-12:])
            ok = len(last) == 12 and last[:, 0].mean() < last[:, 1].std()
            now = ok and p > 2e-4, ok and p < -2e-4
            want[s, t] = (p, int(now[0] and not up) - int(now[1] and not down))
            up, down = now
    got = said["flow_lags"]
    assert got.keys() == want.keys() and all(abs(got[k]["forecast"] - p) < 1e-9 and got[k]["side"] == side for k, (p, side) in want.items())


def test_expert_weights_are_the_sequential_ones(spark, said):
    b = spark.createDataFrame(bars())
    ar, ou = by_bar(L.autoregressive(b, 60, 10)), by_bar(L.level_return(b, 80, 10))
    got, seen = said["expert_mix"], 0
    for s, bar, x, r, day in each(bars()):
        f, ratio = L.features(bar), bar["atr14"] / bar["c"]
        for t in (130, 200):  # experts by hand
            k = t - (t - 74) % 60
            rows = np.arange(k - 9 - 60, k - 9)
            lags = lambda at: np.column_stack([np.ones(len(at)), *(r[at - j] for j in range(5))])
            w = np.linalg.lstsq(lags(rows), x[rows + 10] - x[rows], rcond=None)[0]
            assert abs(ar[s, t]["forecast"] - (lags(np.array([t])) @ w)[0]) < 1e-9
        logs, made, model = np.full((2, 3), -np.log(3)), {}, None
        for t in range(180, len(x)):
            if t - 10 in made:
                old, k, v = made[t - 10]
                logs[k] -= 0.1 * np.clip((old - (x[t] - x[t - 10])) ** 2 / v, 0, 10)
                logs[k] -= np.log(np.exp(logs[k]).sum())
            if t == 180 or day[t] != day[t - 1]:
                rows = np.arange(t - 9 - 150, t - 9)
                y = x[rows + 10] - x[rows]
                label = np.where(y > 1e-3, 2, np.where(y < -1e-3, 0, 1))
                model = None
                if np.bincount(label, minlength=3).min() >= 10:
                    m, d = f[rows].mean(0), f[rows].std(0)
                    model, means, spread = logit.fit((f[rows] - m) / d, label, 3), np.array([y[label == j].mean() for j in range(3)]), y.var()
            a, o = ar.get((s, t)), ou.get((s, t))
            if model is None or a is None or o is None or o["forecast"] is None:
                assert (s, t) not in got
                continue
            issued = np.array([a["forecast"], o["forecast"], (logit.probabilities(model, (f[t : t + 1] - m) / d) @ means)[0]])
            g = int(ratio[t] > np.median(ratio[t - 150 : t]))
            made[t] = (issued, g, spread)
            row, seen = got[s, t], seen + 1
            assert np.allclose([row["w0"], row["w1"], row["w2"]], np.exp(logs[g]), atol=1e-9)
            assert abs(row["mix"] - issued @ np.exp(logs[g])) < 1e-9 and row["wild"] == bool(g)
    assert seen == len(got) > 60


def test_partial_bucket_by_bucket(said):
    want = {}
    for s, b, *_ in each(bars()):
        groups = {}
        for t, ct in enumerate(b["ct"]):
            groups.setdefault((ct - STEP) // (6 * STEP), []).append(t)
        volumes, taught, ranges, past = [], [], [], None
        for k, rows in sorted(groups.items()):
            if b["ct"][rows[0]] - STEP != k * 6 * STEP or len(rows) < 2:
                continue
            two, at = rows[:2], rows[1]
            base = np.mean(volumes[-4:]) if len(volumes) >= 4 else np.nan
            x = np.array([np.log(b["c"][at] / b["o"][rows[0]]), (b["h"][two].max() - b["l"][two].min()) / b["o"][rows[0]], b["v"][two].sum() / base])
            if len(taught) >= 30 and np.isfinite(x).all():
                f, y = np.array([v for v, _ in taught[-30:]]), np.array([v for _, v in taught[-30:]])
                m, d = f.mean(0), f.std(0)
                w = np.linalg.solve(((f - m) / d).T @ ((f - m) / d) + np.eye(3), ((f - m) / d).T @ (y - y.mean()))
                p = y.mean() + (x - m) / d @ w
                scale = np.mean(ranges[:14]) if len(ranges) >= 14 else np.nan
                for v in ranges[14:]:
                    scale = (13 * scale + v) / 14
                quiet = abs(b["c"][at] - b["o"][rows[0]]) < 5 * scale
                want[s, at] = (p, (int(p > 2e-4) - int(p < -2e-4)) if quiet else 0)
            if len(rows) == 6:
                if np.isfinite(x).all():
                    taught.append((x, np.log(b["c"][rows[-1]] / b["c"][at])))
                volumes.append(b["v"][two].sum())
                high, low = b["h"][rows].max(), b["l"][rows].min()
                ranges.append(high - low if past is None else max(high - low, abs(high - past), abs(low - past)))
                past = b["c"][rows[-1]]
    got = said["partial_bucket"]
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k]["forecast"] - p) < 1e-9 and got[k]["side"] == side for k, (p, side) in want.items())
