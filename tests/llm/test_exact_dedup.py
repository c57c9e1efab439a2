import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidebar.llm import exact_dedup as X


def rows():
    r = random.Random(1)
    texts = ["", " ", "\t\n", "a b", "a  b", "a b", " a b", "long " * 9000, *(f"t{i}" for i in range(40))]
    out = [(i, r.choice(texts), "x", 0) for i in range(300)] + [(300, None, "x", 0), (None, "only null", "x", 1), (None, "only null", "y", 1), (None, "a b", "x", 0)]
    return out + [out[5], out[5], (7, "other", "z", 9)]


DDL = "doc_id long, text string, key string, m int"


def want():
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows():
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep, first = min((i for i in ids if i is not None), default=None), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def test_copies_against_brute_force(spark):
    df = spark.createDataFrame(rows(), DDL).repartition(7)
    assert sorted(map(tuple, X.copies(df).collect()), key=str) == want()
    assert X.copies(df.limit(0)).count() == 0


def test_drop_copies(spark):
    df = spark.createDataFrame(rows(), DDL)
    got = X.drop_copies(df)
    assert got.schema == df.schema
    assert sorted((i for i, *_ in got.collect()), key=str) == sorted((i for i, _, _, kept, _ in want() if kept), key=str)


def test_merge_keeps_smallest():
    f, t = False, True
    a = X.sorted_run(np.array([b"b" * 40, b"a" * 40, b"b" * 40], "S40"), np.array([5, 9, 3]), np.array([f, f, f]), np.array([1, 1, 2]))
    assert a[0].tolist() == [b"a" * 40, b"b" * 40] and a[1].tolist() == [9, 3] and a[3].tolist() == [1, 3]
    b = X.sorted_run(np.array([b"c" * 40, b"b" * 40, b"0" * 40, b"b" * 40], "S40"), np.array([0, 2**63 - 1, -(2**63), 0]), np.array([t, f, f, t]), np.array([1, 1, 1, 1]))
    m = X.merged(a, b)
    assert m[0].tolist() == [x * 40 for x in (b"0", b"a", b"b", b"c")] and m[1][:3].tolist() == [-(2**63), 9, 3] and m[2].tolist() == [f, f, f, t] and m[3].tolist() == [1, 1, 5, 1]
    with pytest.raises(ValueError):
        X.sorted_run(np.array([b"d" * 32 + b"1" * 8, b"d" * 32 + b"2" * 8], "S40"), np.array([1, 2]), np.array([f, f]), np.array([1, 1]))
    x, y = (X.sorted_run(np.array([b"d" * 32 + n * 8], "S40"), np.array([1]), np.array([f]), np.array([1])) for n in (b"1", b"2"))
    with pytest.raises(ValueError):
        X.merged(x, y)


def test_merge_in_any_order_is_one_sort():
    r = np.random.default_rng(3)
    runs, rows = [], []
    for _ in range(9):
        n = int(r.integers(0, 200))
        part = np.array([b"%032d" % k + b"8" * 8 for k in r.integers(0, 150, n)], "S40"), r.integers(-(2**63), 2**63 - 1, n), r.random(n) < 0.3, r.integers(1, 5, n)
        rows.append(part)
        runs.append(X.sorted_run(*part) if n else part)
    want = X.sorted_run(*(np.concatenate(x) for x in zip(*rows)))
    got = runs[0]
    for other in runs[1:]:
        got = X.merged(got, other)
    assert all((a == b).all() for a, b in zip((got[0], np.where(got[2], 0, got[1]), got[2], got[3]), (want[0], np.where(want[2], 0, want[1]), want[2], want[3])))


def test_every_id_is_an_id(spark, monkeypatch):
    """Both ends of 64 bits, beside rows without an id, in small blocks and small sorts."""
    monkeypatch.setattr(X, "BLOCK", 3)
    monkeypatch.setattr(X, "MOST", 5)
    ids = [-(2**63), -1, 0, 2**62, 2**63 - 1, None]
    data = [(i, f"text {k % 7 if i is None else k}") for k in range(20) for i in ids[k % 6 :]] + [(2**63 - 1, "end"), (None, "end"), (-(2**63), "start"), (2**63 - 1, "start")]
    got = {(x["doc_id"], x["text_sha256"]): x for x in X.copies(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()}
    for text in {t for _, t in data}:
        own = [i for i, t in data if t == text]
        keep = min((i for i in own if i is not None), default=None)
        for i in own:
            row = got[i, hashlib.sha256(text.encode()).hexdigest()]
            assert (row["keep_id"], row["group_size"]) == (keep, len(own))
    stay = sorted(((x["doc_id"], x["text"]) for x in X.drop_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    assert {t for _, t in stay} == {t for _, t in data} and len(stay) == len({t for _, t in data})


def test_sql(spark, tmp_path):
    df = spark.createDataFrame(rows(), DDL)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({X.OP4_SQL})").fetchall(), key=str) == want()
