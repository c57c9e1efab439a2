import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tidebar.llm import line_dedup as L

DDL = "doc_id long, text string, h int, keeper string, _lines int"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def documents(seed=1, n=160):
    r = random.Random(seed)
    common = [f"Shared line number {i} of the corpus" for i in range(12)] + ["ÄRGER mit Umlauten und Großem ẞ", "  Padded line of enough letters \t", "padded LINE of enough letters", "exactly twenty chars", "only nineteen chars", " no-break space is kept ", "a line\rwith a return inside it"]
    rows = []
    for i in r.sample(range(-50, 10**6), n):
        lines = [r.choice(common) if r.random() < 0.5 else r.choice(["", " ", f"own line {r.random()} of {i}", "short"]) for _ in range(r.randint(0, 9))]
        rows.append((i, "\n".join(lines), 1, "k", 2))
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1, "k", 2), (None, rows[3][1], 1, "k", 2), (None, rows[3][1], 1, None, 2), (2**63 - 1, rows[4][1], 1, "k", 2), (-(2**63), rows[4][1], 1, "k", 2), (7, None, 1, "k", 2), (8, "", 1, "k", 2), (9, "\n\n", 1, "k", 2)]
    return rows + [(None, "a line that only null ids have", 1, "k", 2)] * 3 + [(10**7, "\n".join(common * 3000), 1, "k", 2)]


def plain(rows, least=20, documents=3):
    holders = defaultdict(set)
    for u, (_, t, *_) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(u)
    low = -(2**63) - 1
    ident = lambda i: low if i is None else i
    top = {k: max(ident(rows[u][0]) for u in v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in top or ident(i) == top[key(x)]]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **how):
    got = L.drop_lines(df, **how).selectExpr("doc_id", "_lines", "_dropped", "sha2(_kept, 256)") if "_lines" not in df.columns else None
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("batches,fan", [(1, 2), (4, 2), (5, 3), (3, 9)])
def test_against_brute_force(spark, batches, fan):
    df = spark.createDataFrame(documents(), DDL).drop("_lines").repartition(6)
    assert result(df, batches=batches, fan=fan) == plain(documents())


def test_query_on_extra_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame(documents(2), DDL).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op12_line_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(documents(2))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({L.OP12_SQL})").fetchall(), key=str) == plain(documents(2))
    assert L.drop_lines(spark.createDataFrame([], DDL).drop("_lines")).count() == 0


def test_a_line_in_every_document(spark):
    rows = [(i, f"the line that every document has\nline {i} that is its own, long enough", 1, "k") for i in range(3000)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string, h int, keeper string"))
    assert got == plain(rows) and sum(x[2] for x in got) == 2999


def test_runs_keep_counts_and_keepers_over_levels(spark):
    runs = L.Runs(spark, fan=2)
    r, want = random.Random(3), {}
    try:
        for b in range(7):  # ids fall from batch to batch
            batch = {bytes([r.randint(0, 60)]): (r.randint(1, 5), 1000 - 10 * b - r.randint(0, 9)) for _ in range(25)}
            for h, (n, top) in batch.items():
                want[h] = (want.get(h, (0, top))[0] + n, want.get(h, (0, top))[1])
            runs.add(spark.createDataFrame([(h, n, t) for h, (n, t) in batch.items()], "h binary, n long, top long"))
        assert [len(x) for _, x in sorted(runs.levels.items())] == [1, 1, 1]
        assert {bytes(x["h"]): (x["n"], x["keeper"]) for x in runs.merged().collect()} == want
    finally:
        runs.close()


def test_no_python_and_no_shuffle_between_runs(spark):
    runs = L.Runs(spark, fan=9)
    try:
        for b in range(2):
            runs.add(spark.createDataFrame([(bytes([i]), 1, 5 - b) for i in range(40)], "h binary, n long, top long"))
        a, b = runs.levels[0]
        plan = a.join(b.select("h").hint("merge"), "h", "left_anti")._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        runs.close()
    plan = L.drop_lines(spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, h int"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
