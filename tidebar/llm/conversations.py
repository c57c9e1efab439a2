"""Repair of conversations' structure by A* on the edit lattice.

A conversation's rows, in order of turn, have faults: blank (no visible character), duplicate (role and text were there before) or
truncated (the last visible character is none of `.!?`); the first of them counts. Edits make of the rows a sequence whose role
initials are `(s?(ua)+)?`: Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty
turn 5, and a truncated row that is not deleted 5 more. The cheapest edits win, of equal ones the ASCII-least string of their initials.

The lattice's nodes are (rows read, state of the grammar). A* takes them in order of (cost so far plus heuristic, edits so far). The
heuristic is a suffix sum: 2 for each row still to come that must be deleted, and min(2, 5) for each truncated one, which has to be
paid for either way. It never rises by more than an edit costs, so a node's first visit is its best; and among equal costs the
least string comes first, as the edits up to a node are a prefix of all that follow and two equal-cost ways to one node are never
prefixes of each other (an insert is never free).

A conversation of any length passes in blocks of at most BLOCK rows and BLOCK_BYTES of text: A* runs through a block from every
state that can be open at its begin to every state at its end (in the last block: to an end of the grammar), and only four (cost, edits, SHA-256 so far) remain of all that lies
before. Rows travel once, by conversation, sorted by Spark; which rows are duplicates is decided before that by minima over
(conversation, role, digest of the text), which are summed up before they are shuffled. What a task holds is a block and the edits.
A SHA-256 over a whole conversation is sequential, so a conversation is read by one task, but never held by one.

Odd rows: nulls in role and text are one space, and so are those in conv_id and turn for the damage; a null conv_id is a conversation
of its own; null turns come first. Rows of one turn are in order of role and text. Repeated rows are duplicates. Roles other than the
three are rerolled or deleted; an empty role has an empty initial. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
BLOCK, BLOCK_BYTES = 1024, 4 << 20
_VISIBLE = r"[^\x20\x09-\x0D]"
#: Grammar: nothing yet, after s, after u, after a. A sequence may end in the first and the last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

Row = tuple[str, int]  # initial, fault


def a_star(rows: list[Row], begin: int, goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, edits) through all rows from one state of the grammar to the best of the goals, or without goals to each
    state that can be reached."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] in (BLANK, DUPLICATE) else min(DELETE, CUT) if rows[i][1] == TRUNCATED else 0)
    queue, done, found = [(rest[0], "", 0, begin, 0)], set(), {}
    while queue and len(found) < 4:
        _, edits, i, q, cost = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows):
            found[q] = (cost, edits)
            if q in goals:
                return {q: (cost, edits)}
        for initial in "ua":
            if (q, initial) in STEPS:
                heapq.heappush(queue, (cost + INSERT + rest[i], edits + "I", i, STEPS[q, initial], cost + INSERT))
        if i == len(rows):
            continue
        own, fault = rows[i]
        heapq.heappush(queue, (cost + DELETE + rest[i + 1], edits + "D", i + 1, q, cost + DELETE))
        if fault in (BLANK, DUPLICATE):
            continue
        more = CUT if fault == TRUNCATED else 0
        if (q, own) in STEPS:
            heapq.heappush(queue, (cost + KEEP + more + rest[i + 1], edits + "K", i + 1, STEPS[q, own], cost + KEEP + more))
        for initial in "ua":
            if (q, initial) in STEPS:
                heapq.heappush(queue, (cost + REROLE + more + rest[i + 1], edits + "R", i + 1, STEPS[q, initial], cost + REROLE + more))
    return found


def applied(edits: str, rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """`role:text` of the rows that the edits leave; they are unambiguous, as rerole and insert only go to u or a and a state admits one of them."""
    at = 0
    for e in edits:
        role, text = rows[at] if e != "I" else ("", "")
        at += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = NAMES["a" if state == 2 else "u"]
        state = STEPS[state, role[:1]]
        yield f"{role}:{text}"


class Open:
    """A conversation that is being read: what is known of it so far."""

    def __init__(self, conv):
        self.conv, self.rows, self.texts, self.size = conv, [], [], 0
        self.best = {0: (0, "", hashlib.sha256())}
        self.faults, self.illegal, self.last, self.turns, self.low, self.high, self.turn = [0] * 4, 0, None, 0, None, None, None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None:
            self.turns += self.turn != turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.rows.append((role[:1], fault))
        self.texts.append((role, text))
        self.size += len(text)
        if len(self.rows) >= BLOCK or self.size >= BLOCK_BYTES:
            self.close_block()

    def close_block(self, goals: tuple[int, ...] = ()) -> None:
        ways: dict[int, tuple] = {}
        for q, (cost, edits, _) in self.best.items():
            for to, (more, own) in a_star(self.rows, q, goals).items():
                new = (cost + more, edits + own, q, own)
                if to not in ways or new[:2] < ways[to][:2]:
                    ways[to] = new
        best = {}
        for to, (cost, edits, q, own) in ways.items():
            digest, first = self.best[q][2].copy(), q == 0
            for line in applied(own, self.texts, q):
                digest.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
                first = False
            best[to] = (cost, edits, digest)
        self.best, self.rows, self.texts, self.size = best, [], [], 0

    def result(self) -> tuple:
        self.close_block(ENDS)
        cost, edits, digest = min((self.best[q] for q in ENDS if q in self.best), key=lambda x: x[:2])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, edits, digest.hexdigest())


OUT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, same = None, [], None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in rows_of(batches):
            for conv, turn, role, text, there, first, none_first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "first", "none_first"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now, same = Open(conv), None
                if not there:  # damage dropped it: the conversation still has a row in the result
                    continue
                shown = text.strip(" \t\n\x0b\x0c\r")
                # equal rows of one turn follow each other
                again = same == (turn, role, text) or (turn is not None and (none_first or turn > first))
                fault = BLANK if not shown else DUPLICATE if again else TRUNCATED if shown[-1] not in ".!?" else FINE
                now.add(turn, role, text, fault)
                same = (turn, role, text)
                if len(out) >= 1000:
                    yield packed()
                    out.clear()
        if now is not None:
            out.append(now.result())
        if out:
            yield packed()

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows after the damage that crc32(`conv_id:turn`) % 20 names; dropped ones have there = false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), twice.alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation, from rows (conv_id, turn, role, text, there)."""
    spark, digest = rows.sparkSession, F.unhex(F.left(F.sha2("text", 256), F.lit(32)))
    kind = rows.schema["conv_id"].dataType
    firsts = rows.where("there").select("conv_id", "role", digest.alias("d"), "turn").groupBy("conv_id", "role", "d").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("none_first"), F.count("*").alias("m")).where("m > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("d").alias("_d"), "first", "none_first")
    # rows that are alone need no answer; the join's large keys can be split
    told = rows.withColumn("d", digest).join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("d") == F.col("_d")), "left")
    told = told.select("conv_id", "turn", "role", "text", "there", "first", F.coalesce("none_first", F.lit(False)).alias("none_first"))
    told = told.withColumn("first", F.coalesce("first", F.lit(2**63 - 1)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = told.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("conv_id", _arrow(kind)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return ordered.mapInArrow(_repaired(schema), OUT.format(kind.simpleString()))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = "xor(4294967295, list_reduce([4294967295] || [CAST(ord(b) AS BIGINT) FOR b IN string_split({s}, '')], lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, _: xor(c // 2, (c % 2) * 3988292384))))"
    key = "coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

    def way(s: str, state: int, cost: str, edit: str, line: str | None = None, when: str = "true") -> str:
        text = f"{s}.t" if line is None else line if state == 0 else f"{s}.t || chr(10) || {line}"
        return f"CASE WHEN {s}.c IS NOT NULL AND {when} THEN {{'c': {s}.c + {cost}, 'e': {s}.e || '{edit}', 't': {text}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def inserts(source: str, what: str) -> str:
        two = least("s2", *(way(f"s{q}", q, "5", "I", "'user:'") for q in (0, 1, 3)))
        return f"SELECT *, {least('s3', way('i2', 2, '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS i3 FROM (SELECT {what}, {two} AS i2 FROM {source})"

    keep, more = "fault NOT IN (1, 2)", "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    line = "role || ':' || text"
    gone = [way(f"i{q}" if q > 1 else f"s{q}", 1, "2", "D") for q in range(4)]
    to_u = [way(s, q, more, "K", line, f"{keep} AND initial = 'u'") for s, q in (("s0", 0), ("s1", 1), ("i3", 3))] + [way(s, q, f"1 + {more}", "R", "'user:' || text", keep) for s, q in (("s0", 0), ("s1", 1), ("i3", 3))]
    to_a = [way("i2", 2, more, "K", line, f"{keep} AND initial = 'a'"), way("i2", 2, f"1 + {more}", "R", "'assistant:' || text", keep)]
    to_s = [way("s0", 0, more, "K", line, f"{keep} AND initial = 's'")]
    start, never = "{'c': 0, 'e': '', 't': ''}", "CAST(NULL AS STRUCT(c INTEGER, e VARCHAR, t VARCHAR))"
    typed = lambda x: f"CAST({x} AS STRUCT(c INTEGER, e VARCHAR, t VARCHAR))"
    return rf"""
WITH RECURSIVE g AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT g.g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc.format(s=key)} % 20 AS k FROM conversations c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id),
w AS (SELECT g, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM r),
o AS (SELECT g, turn, role, text, left(role, 1) AS initial, trim(text, {blank}) AS shown, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM w),
f AS (SELECT *, CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair FROM o),
n AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
walk AS (
  SELECT g, CAST(0 AS BIGINT) AS i, {typed(start)} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM g
  UNION ALL
  SELECT g, i, {typed(gone[0])}, {typed(least(gone[1], *to_s))}, {typed(least(gone[2], *to_u))}, {typed(least(gone[3], *to_a))}
  FROM ({inserts("walk JOIN f ON f.g = walk.g AND f.i = walk.i + 1", "f.g AS g, f.i AS i, role, text, initial, fault, s0, s1, s2, s3")})
), last AS (SELECT g, {least("s0", "i3")} AS b FROM ({inserts("walk LEFT JOIN n USING (g) WHERE i = coalesce(n, 0)", "g, s0, s1, s2, s3")}))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.c AS BIGINT) AS cost, b.e AS audit, sha256(b.t) AS repaired_sha256
FROM g JOIN last USING (g) LEFT JOIN n USING (g)
"""


OP13_SQL = _sql()
