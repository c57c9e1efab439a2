import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from tidebar.llm import conversations as C

DDL = "conv_id long, turn long, role string, text string, first int, kind string"
WHITE = " \t\n\x0b\x0c\r"


def rows(seed=1, n=120):
    r, out = random.Random(seed), []
    for c in [*r.sample(range(-5, 10**6), n), None]:
        for t in range(r.randint(1, 9)):
            turn = r.choice([t, t, t, t + 2, None])
            out.append((c, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No!", "cut off", " ", "", None, "What? ", f"Own {r.random()}.", ".\x1f"]), 1, "x"))
    return out + [out[0], out[0]] + [(7777777, t, "user" if t % 2 else "assistant", f"turn {t}.", 1, "x") for t in range(300)]


def broken(conversation):
    """The rows after damage, in order."""
    out = []
    for c, t, role, text, *_ in conversation:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def faults(rs):
    seen, out = set(), []
    for _, role, text in rs:
        shown = text.strip(WHITE)
        out.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def best(rs, fs):
    """Cheapest (cost, edits, lines) by a plain recursion over all edits, with up to two inserts before each row and at the end."""
    grammar = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def go(i, q, inserts):
        ways = [(0, "", ())] if i == len(rs) and q in (0, 3) else []
        if inserts < 2:
            for role in ("user", "assistant"):
                if (q, role[0]) in grammar:
                    ways += [(5 + c, "I" + e, (f"{role}:", *x)) for c, e, x in [go(i, grammar[q, role[0]], inserts + 1)] if c < 10**9]
        if i < len(rs):
            _, role, text = rs[i]
            ways += [(2 + c, "D" + e, x) for c, e, x in [go(i + 1, q, 0)]]
            for cost, e, to in [(0, "K", role), (1, "R", "user"), (1, "R", "assistant")]:
                if fs[i] not in (1, 2) and (q, to[:1]) in grammar:
                    ways += [(cost + 5 * (fs[i] == 3) + c, e + y, (f"{to}:{text}", *x)) for c, y, x in [go(i + 1, grammar[q, to[:1]], 0)]]
        return min(ways, default=(10**9, "", ()))

    return go(0, 0, 0)


def plain(rs):
    by = defaultdict(list)
    for x in rs:
        by[x[0]].append(x)
    out = []
    for c, own in by.items():
        after = broken(own)
        fs = faults(after)
        turns = {t for t, *_ in after if t is not None}
        cost, edits, lines = best(after, fs)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, fs.count(1), fs.count(2), fs.count(3), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, data):
    got = C.repair(C.damaged(spark.createDataFrame(data, DDL).repartition(5)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(data)


def test_against_recursion(spark):
    check(spark, rows())
    assert C.repair(C.damaged(spark.createDataFrame([], DDL))).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_change_nothing(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(block)
    for _ in range(300):
        after = [(t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", " ", "c!", f"{t}?"])) for t in range(r.randint(0, 12))]
        fs, one = faults(after), C.Open(1)
        for (t, role, text), f in zip(after, fs):
            one.add(t, role, text, f)
        cost, edits, lines = best(after, fs)
        assert one.result()[-3:] == (cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_every_short_sequence():
    for n in range(5):
        for seq in product([("s", 0), ("u", 0), ("a", 0), ("u", 3), ("a", 1)], repeat=n):
            rs = [(i, {"s": "system", "u": "user", "a": "assistant"}[x], str(i)) for i, (x, _) in enumerate(seq)]
            found = C.a_star(list(seq), 0)
            assert min(found[q] for q in C.ENDS if q in found) == best(rs, [f for _, f in seq])[:2]


def test_a_very_long_conversation_is_read_in_blocks(spark):
    r = random.Random(5)
    data = [(1, t, r.choice(["user", "assistant"]), f"turn {t}" + r.choice([".", ""]), 1, "x") for t in range(30_000)] + [(2, 0, "user", "long " * 2_000_000, 1, "x"), (2, 1, "assistant", "Yes.", 1, "x")]
    got = {x["conv_id"]: x for x in C.repair(C.damaged(spark.createDataFrame(data, DDL))).collect()}
    kept = got[1]["audit"].replace("I", "")
    after = broken([x for x in data if x[0] == 1])
    assert len(kept) == len(after) and got[1]["cost"] == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in got[1]["audit"]) + 5 * sum(e in "KR" and f == 3 for e, f in zip(kept, faults(after)))
    assert got[2]["truncated"] == 1


def test_sql(spark, tmp_path):
    data = rows(3)
    spark.createDataFrame(data, DDL).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    got = con.execute(f"select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from ({C.OP13_SQL})").fetchall()
    assert sorted(got, key=str) == plain(data)
