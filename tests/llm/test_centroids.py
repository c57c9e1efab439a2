import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidebar.llm import centroids as C

DDL = "vec_id long, embedding array<float>, label int, cluster int"


def vectors(n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2) + (i % 5) / 8)) for _ in range(64)], 0, 7) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[9][1], 0, 7), (None, None, 0, 7), (n, None, 0, 7), (n + 1, [], 0, 7), (n + 2, [0.5] * 63, 0, 7), (n + 3, [0.5] * 65, 0, 7)]
    return rows + [(n + 4, [*[0.5] * 63, None], 0, 7), (n + 5, [*[0.5] * 63, math.nan], 0, 7), (n + 6, [-math.inf, *[0.5] * 63], 0, 7), (-5, [-0.001] * 64, 0, 7), (5, rows[8][1], 0, 7)]


def plain(rows, k=16, rounds=3):
    x = [(i, [math.floor(64 * y) for y in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(y is not None and math.isfinite(y) for y in v)]
    order = sorted(x, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    c = [v for _, v in order[:k]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    to = lambda v: min((d(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        got = [to(v)[1] for _, v in x]
        for j in range(len(c)):
            own = [v for (_, v), g in zip(x, got) if g == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    far = [(i, *to(v)) for i, v in x]
    total = sum(f for _, f, _ in far)
    return sorted(((i, j, f, sum(g for _, g, h in far if h == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, f, j in far), key=str)


@pytest.mark.parametrize("n", [0, 3, 400])
def test_against_plain_integers(spark, n):
    rows = vectors(400)[:n] if n < 400 else vectors()
    got = C.cluster(spark.createDataFrame(rows, DDL).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_sql(spark, tmp_path):
    spark.createDataFrame(vectors(), DDL).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    got = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({C.OP11_SQL})").fetchall()
    assert sorted(got, key=str) == plain(vectors())


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 20, 1 << 25, C.LARGEST])
def test_intervals_hold_and_ties_go_to_the_lowest_number(size):
    """Distances that float32 cannot tell apart: centroids one unit from each other, equal ones, and vectors midway between two."""
    r = np.random.default_rng(size)
    c = r.integers(-size, size + 1, (16, 64))
    c[5], c[9], c[10] = c[2], c[3], c[3]
    c[10, 0] += 1 if c[10, 0] < size else -1
    x = np.concatenate([r.integers(-size, size + 1, (300, 64)), c, (c[:8] + c[8:]) // 2, np.clip(c + r.integers(-1, 2, c.shape), -size, size)])
    to, far, exact = C.nearest(x, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
    assert list(zip(far.tolist(), to.tolist())) == want and 0 < exact < len(x)


def test_float32_alone_would_err():
    """The exact step is needed: at this size the product's rounding decides some rows wrongly."""
    r = np.random.default_rng(8)
    c = r.integers(-(1 << 20), 1 << 20, (1, 64)) + r.integers(-2, 3, (16, 64))
    x = c[0] + r.integers(-3, 4, (500, 64))
    naive = ((c * c).sum(1) - 2.0 * (x.astype(np.float32) @ c.astype(np.float32).T)).argmin(1)
    right = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    assert (naive != right).any() and (C.nearest(x, c)[0] == right).all()


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        C.cluster(spark.createDataFrame([(1, [1e30] * 64, 0, 0)], DDL)).collect()
