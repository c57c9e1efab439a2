"""Queries on bars, joins in time, states, filters, rules and exits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.machines import MACHINES, machine_signals
from ..operators import asof as A
from ..operators import filters, resample, state
from ..operators.signals import compound, signal_sql, signals
from ..plans import rules as R
from ..sources import bars as B
from .base import FEED, HOUR, HOURLY, MS, PRINTS, RULE_BARS, feed, hourly, prints, rule_bars, table

#: Rows that a task of a large join or window should get.
TASK_ROWS = 250_000

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places: sums depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in (cols or [c for c, t in df.dtypes if t == "double"])})


# ---- bars


@query("WITH " + HOURLY.strip() + """
SELECT series_id, open_ms, open, high, low, close, volume, round(quote_volume, 4) AS quote_volume, trades, taker_buy_base, round(taker_buy_quote, 4) AS taker_buy_quote FROM hourly""")
def trade_print_bars(spark, sf):
    h = hourly(spark, sf)
    return h.select("series_id", "open_ms", "open", "high", "low", "close", "volume", F.round("quote_volume", 4).alias("quote_volume"), "trades", "taker_buy_base", F.round("taker_buy_quote", 4).alias("taker_buy_quote"))


@query("""SELECT l_suppkey AS series_id, epoch_us(l_shipdate) // 86400000000 AS day, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume, count(*) AS trades
FROM (SELECT *, l_extendedprice / l_quantity AS price, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY ALL""")
def ohlcv_daily(spark, sf):
    li = table(spark, sf, "lineitem")
    price, k = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    day = F.floor(F.expr(MS.format("l_shipdate")) / 86_400_000)
    return li.groupBy(F.col("l_suppkey").alias("series_id"), day.alias("day")).agg(F.min_by(price, k).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, k).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))


_MULTI = HOURLY + """, multi AS (
  SELECT series_id, tf, open_ms // (tf * 60000) * (tf * 60000) AS bucket, arg_min(open, open_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ms) AS close, sum(volume) AS volume, count(*) AS n_base,
         CASE WHEN count(taker_buy_base) = tf // 60 THEN sum(taker_buy_base) END AS taker_buy_base
  FROM hourly, (VALUES (120), (240), (1440)) t(tf) GROUP BY series_id, tf, open_ms // (tf * 60000) * (tf * 60000)
)"""


def _multi(spark, sf, complete):
    h = hourly(spark, sf).drop("quote_volume", "agg_trades", "trades", "taker_buy_quote")
    parts = [resample.resample(h, m, 60, complete).withColumn("tf", F.lit(m)) for m in (120, 240, 1440)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH " + _MULTI.strip() + " SELECT series_id, tf, bucket AS open_ms, open, high, low, close, volume, n_base, taker_buy_base FROM multi WHERE n_base = tf // 60")
def complete_buckets(spark, sf):
    return _multi(spark, sf, True)


@query("WITH " + _MULTI.strip() + " SELECT series_id, tf, bucket AS open_ms, open, high, low, close, volume, n_base, taker_buy_base FROM multi")
def ohlcv_multi_tf(spark, sf):
    return _multi(spark, sf, False)


@query("WITH " + HOURLY.strip() + """ SELECT series_id, open_ms, round(taker_buy_base / nullif(volume, 0), 6) AS taker_buy_ratio, 2 * taker_buy_base - volume AS delta_base, round(volume / trades, 6) AS avg_trade_size,
round(taker_buy_quote / nullif(quote_volume, 0), 6) AS taker_buy_quote_ratio, round(2 * taker_buy_quote - quote_volume, 4) AS delta_quote FROM hourly""")
def derived_flow(spark, sf):
    d = B.derived_flow(hourly(spark, sf))
    return d.select("series_id", "open_ms", F.round("taker_buy_ratio", 6).alias("taker_buy_ratio"), "delta_base", F.round("avg_trade_size", 6).alias("avg_trade_size"), F.round("taker_buy_quote_ratio", 6).alias("taker_buy_quote_ratio"), F.round("delta_quote", 4).alias("delta_quote"))


@query("WITH " + (HOURLY + FEED).strip() + """ SELECT h.series_id, h.open_ms, CASE WHEN h.open_ms + 3600000 - f.ts_ms <= 7200000 THEN f.oi END AS oi, CASE WHEN h.open_ms + 3600000 - f.ts_ms <= 7200000 THEN round((h.open_ms + 3600000 - f.ts_ms) / 60000, 6) END AS age_minutes
FROM hourly h ASOF LEFT JOIN (SELECT series_id, ts_ms, arg_max(oi, trade_id) AS oi FROM feed GROUP BY ALL) f ON f.series_id = h.series_id AND h.open_ms + 3600000 >= f.ts_ms""")
def asof_state(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", (F.col("open_ms") + HOUR).alias("ct"))
    return A.asof(h, feed(spark, sf), ["oi"], tolerance_ms=2 * HOUR, order=["trade_id"]).select("series_id", "open_ms", "oi", F.round("age_minutes", 6).alias("age_minutes"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey, count(*) AS n_lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS asof_order FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, n_lines, asof_order, o_orderdate AS asof_date FROM x ASOF LEFT JOIN o ON o.o_custkey = x.o_custkey AND x.l_shipdate >= o.o_orderdate""")
def asof_lineitem_order(spark, sf):
    """Each line's ship date with the customer's latest order placed by then."""
    o = table(spark, sf, "orders")
    ms = lambda c: F.expr(MS.format(c))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ms("l_shipdate").alias("ct"))
    n_lines, n_orders = li.count(), o.count()
    # dealt out once, by order, for the join and the counts
    parts = max(8, -(-n_lines // TASK_ROWS), -(-n_orders // TASK_ROWS))
    owner = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("series_id"))
    met = li.repartition(parts, "l_orderkey").join(owner.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = met.groupBy("l_orderkey", "l_linenumber", "series_id", "ct").agg(F.count("*").alias("n_lines"))
    events = o.select(F.col("o_custkey").cast("string").alias("series_id"), ms("o_orderdate").alias("ts_ms"), F.col("o_orderkey").alias("asof_order"), F.col("o_orderdate").alias("asof_date"))
    return A.asof(lines, events, ["asof_order", "asof_date"], order=["asof_order"], parts=max(8, -(-(n_lines + n_orders) // TASK_ROWS))).select("l_orderkey", "l_linenumber", "n_lines", "asof_order", "asof_date")


@query("WITH " + HOURLY.strip() + """ SELECT series_id, count(*) AS n_bars, min(open_ms) AS first_ms, max(open_ms) AS last_ms, CAST((max(open_ms) - min(open_ms)) / 3600000 + 1 - count(*) AS BIGINT) AS n_missing,
avg(CASE WHEN taker_buy_base > 0 THEN 1.0 ELSE 0.0 END) AS has_taker_buy_base FROM hourly GROUP BY series_id""")
def coverage_report(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", "open", "high", "low", "close", "volume", F.when(F.col("taker_buy_base") > 0, F.col("taker_buy_base")).alias("taker_buy_base"))
    return B.inspect(h, HOUR)


@query("""SELECT user_id, k, count(*) AS n_rows, count(DISTINCT value) AS n_versions FROM (SELECT user_id, event_type || CAST(epoch_us(ts) // 86400000000 AS VARCHAR) AS k, value FROM events) GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def duplicate_conflicts(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("user_id", F.concat("event_type", F.floor(F.expr(MS.format("ts")) / 86_400_000).cast("string")).alias("k"), "value")
    return B.duplicate_conflicts(rows, "user_id", "k")


@query("WITH " + PRINTS.strip() + """, h AS (SELECT DISTINCT series_id, ts_ms // 3600000 * 3600000 + 3600000 AS ct FROM prints), d AS (SELECT DISTINCT series_id, ts_ms // 14400000 * 14400000 + 14400000 AS tf_ct FROM prints)
SELECT h.series_id, h.ct, max(d.tf_ct) AS tf_ct FROM h LEFT JOIN d ON d.series_id = h.series_id AND d.tf_ct <= h.ct GROUP BY ALL""")
def timeframe_map(spark, sf):
    p = prints(spark, sf)
    h = p.select("series_id", (F.floor(F.col("ts_ms") / HOUR) * HOUR + HOUR).alias("ct")).distinct()
    d = p.select("series_id", (F.floor(F.col("ts_ms") / (4 * HOUR)) * 4 * HOUR + 4 * HOUR).alias("ct")).distinct()
    return resample.timeframe_map(h, d)


@query("WITH " + HOURLY.strip() + """ SELECT a.series_id, a.open_ms, b.close AS close_before FROM hourly a LEFT JOIN hourly b ON b.series_id = a.series_id AND b.open_ms = a.open_ms - 10800000""")
def time_shift(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", "close", (F.col("open_ms") + HOUR).alias("ct"))
    return A.exactly_before(h, 3 * HOUR, ["close"]).select("series_id", "open_ms", "close_before")


# ---- states


_W = "OVER (PARTITION BY series_id ORDER BY open_ms"
_STATES = HOURLY + f""", s1 AS (
  SELECT series_id, open_ms, open, high, low, close, volume, lag(close) {_W}) AS p1, lag(close, 2) {_W}) AS p2, lag(volume) {_W}) AS pv, lag(high) {_W}) AS ph, lag(low) {_W}) AS pl FROM hourly
), s2 AS (
  SELECT *, CASE WHEN close > p1 AND p1 < p2 THEN 1 WHEN close < p1 AND p1 > p2 THEN -1 ELSE 0 END AS turn, coalesce(volume > pv, false) AS sufficient,
         coalesce(CAST(last_value(nullif(sign(close - p1), 0) IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT), 0) AS dir FROM s1
), s3 AS (
  SELECT *, coalesce(last_value(CASE WHEN turn <> 0 THEN turn * CASE WHEN sufficient THEN 1 ELSE 2 END END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state,
         last_value(CASE WHEN turn = 1 THEN volume END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v_up, last_value(CASE WHEN turn = -1 THEN volume END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v_dn,
         lag(dir) {_W}) AS pdir FROM s2
), s4 AS (
  SELECT *, sum(CASE WHEN dir IS DISTINCT FROM pdir OR pdir IS NULL THEN 1 ELSE 0 END) {_W}) AS run_id,
         last_value(CASE WHEN dir <> pdir AND pdir = -1 THEN pl END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trough, last_value(CASE WHEN dir <> pdir AND pdir = 1 THEN ph END IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM s3
)"""


def _states(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", "open", "high", "low", "close", "volume", (F.col("open_ms") + HOUR).alias("ct"))
    by = ["series_id"]
    h = state.with_direction(h, "close", by)
    h = state.latched_case(state.reversals(h, "close", "volume", by), by)
    h = state.reversal_break(h, "volume", by)
    return state.pivots(state.runs(h, "dir", by), by)


@query("WITH " + _STATES.strip() + " SELECT series_id, open_ms, dir FROM s2")
def direction_ffill(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", "close", F.col("open_ms").alias("ct"))
    return state.with_direction(h, "close", ["series_id"]).select("series_id", "open_ms", "dir")


@query("WITH " + _STATES.strip() + " SELECT series_id, open_ms, turn, sufficient, state, coalesce(sufficient AND volume > CASE turn WHEN 1 THEN v_dn WHEN -1 THEN v_up END, false) AS breaks FROM s3")
def strict_reversal_states(spark, sf):
    return _states(spark, sf).select("series_id", "open_ms", "turn", "sufficient", "state", "breaks")


@query("WITH " + _STATES.strip() + " SELECT series_id, open_ms, run_id, row_number() OVER (PARTITION BY series_id, run_id ORDER BY open_ms) AS run_bars, trough, peak FROM s4")
def runs_and_pivots(spark, sf):
    return _states(spark, sf).select("series_id", "open_ms", "run_id", "run_bars", "trough", "peak")


@query("WITH " + _STATES.strip() + """ SELECT state, (open_ms + 3600000) % 86400000 // 3600000 AS hour, count(*) AS entries, sum(CASE WHEN close > open THEN 1 ELSE 0 END) AS green, round(sum(close - open), 4) AS body
FROM s3 WHERE ((open_ms + 3600000) // 86400000 + 3) % 7 < 5 AND state <> 0 GROUP BY ALL""")
def entry_states_by_hour(spark, sf):
    """The flagship: prints to hourly bars, strict reversals split by volume, the latched state, weekday sessions, counts by state and hour."""
    s = _states(spark, sf).where(filters.session("WEEKDAY") & (F.col("state") != 0))
    hour = F.floor(F.pmod("ct", F.lit(86_400_000)) / HOUR)
    return s.groupBy("state", hour.alias("hour")).agg(F.count("*").alias("entries"), F.sum((F.col("close") > F.col("open")).cast("int")).alias("green"), F.round(F.sum(F.col("close") - F.col("open")), 4).alias("body"))


_WEEK = "((open_ms + 3600000) // 86400000 + 3) % 7"
_HR = "(open_ms + 3600000) % 86400000 // 3600000"


@query("WITH " + HOURLY.strip() + f""" SELECT name, count(*) AS n FROM hourly, (VALUES ('ALL'), ('WEEKDAY'), ('WEEKEND'), ('ASIA'), ('EU'), ('US'), ('EX_THIN')) t(name)
WHERE CASE name WHEN 'ALL' THEN true WHEN 'WEEKDAY' THEN {_WEEK} < 5 WHEN 'WEEKEND' THEN {_WEEK} >= 5 WHEN 'ASIA' THEN {_HR} < 8 WHEN 'EU' THEN {_HR} >= 7 AND {_HR} < 16 WHEN 'US' THEN {_HR} >= 13 AND {_HR} < 22 ELSE NOT ({_HR} >= 22 OR {_HR} < 2) END GROUP BY name""")
def session_filter(spark, sf):
    h = hourly(spark, sf).select((F.col("open_ms") + HOUR).alias("ct"))
    names = ["ALL", "WEEKDAY", "WEEKEND", "ASIA", "EU", "US", "EX_THIN"]
    return h.select(F.explode(F.array_compact(F.array(*(F.when(filters.session(n), F.lit(n)) for n in names)))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# the state machine itself, run by run: short runs in a row, the end of the pause
_PAUSE = _STATES + """, rr AS (SELECT series_id, run_id, count(*) AS len, min(open_ms) + 3600000 AS begin FROM s4 GROUP BY ALL),
  machine(series_id, run_id, bad, cur) AS (
    SELECT series_id, run_id, 0, 0::BIGINT FROM rr WHERE run_id = 1
    UNION ALL
    SELECT n.series_id, n.run_id, CASE WHEN p.len < 3 AND m.bad + 1 < 2 THEN m.bad + 1 ELSE 0 END, CASE WHEN p.len < 3 AND m.bad + 1 >= 2 THEN greatest(m.cur, n.begin + 300 * 60000) ELSE m.cur END
    FROM machine m JOIN rr p ON p.series_id = m.series_id AND p.run_id = m.run_id JOIN rr n ON n.series_id = m.series_id AND n.run_id = m.run_id + 1
  )"""


@query("WITH RECURSIVE " + _PAUSE.strip() + " SELECT s4.series_id, open_ms, open_ms + 3600000 < cur AS paused FROM s4 JOIN machine USING (series_id, run_id)")
def whipsaw_pause(spark, sf):
    """Pauses of five hours after two short runs (under three bars) in a row."""
    return state.whipsaw_pause(_states(spark, sf), ["series_id"], 3, 300).select("series_id", "open_ms", "paused")


_FOUR = """, q0 AS (
  SELECT series_id, open_ms // 14400000 * 14400000 AS open_ms, arg_min(open, open_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ms) AS close, sum(volume) AS volume FROM hourly GROUP BY 1, 2
), q1 AS (
  SELECT *, row_number() OVER w - 1 AS k, lag(close) OVER w AS p1, lag(close, 2) OVER w AS p2, lag(volume) OVER w AS pv FROM q0 WINDOW w AS (PARTITION BY series_id ORDER BY open_ms)
), q2 AS (
  SELECT *, coalesce(CAST(last_value(nullif(sign(close - p1), 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INT), 0) AS d,
    coalesce(last_value(CASE WHEN close > p1 AND p1 < p2 THEN CASE WHEN volume > pv THEN 1 ELSE 2 END WHEN close < p1 AND p1 > p2 THEN CASE WHEN volume > pv THEN -1 ELSE -2 END END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS st FROM q1
), q3 AS (SELECT *, max(CASE WHEN d IS DISTINCT FROM pd OR k = 0 THEN k END) OVER (PARTITION BY series_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS begin FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY k) AS pd FROM q2)),
  rr AS (SELECT series_id, begin, count(*) AS len, min(open_ms) + 14400000 AS turn, row_number() OVER (PARTITION BY series_id ORDER BY begin) AS run_no FROM q3 GROUP BY series_id, begin),
  machine(series_id, run_no, bad, cur) AS (
    SELECT series_id, run_no, 0, 0::BIGINT FROM rr WHERE run_no = 1
    UNION ALL
    SELECT n.series_id, n.run_no, CASE WHEN p.len < 3 AND m.bad = 0 THEN 1 ELSE 0 END, CASE WHEN p.len < 3 AND m.bad = 1 THEN greatest(m.cur, n.turn + 1200 * 60000) ELSE m.cur END
    FROM machine m JOIN rr p ON p.series_id = m.series_id AND p.run_no = m.run_no JOIN rr n ON n.series_id = m.series_id AND n.run_no = m.run_no + 1
  ),
  native AS (SELECT q3.series_id, q3.open_ms + 14400000 AS tf_ct, k, d, k - q3.begin + 1 AS cnt, st, cur FROM q3 JOIN rr ON rr.series_id = q3.series_id AND rr.begin = q3.begin JOIN machine m ON m.series_id = rr.series_id AND m.run_no = rr.run_no),
  base AS (SELECT series_id, open_ms + 3600000 AS ct, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) - 1 AS i FROM hourly),
  mapped AS (SELECT b.*, k, d, cnt, st, cur FROM base b ASOF LEFT JOIN native n ON n.series_id = b.series_id AND b.ct >= n.tf_ct)"""


@query("WITH RECURSIVE " + HOURLY.strip() + _FOUR + """, cases AS (SELECT f.frame, c.code, s.side FROM (VALUES ('long'), ('short')) f(frame), (SELECT unnest(range(0, 5)) AS code) c, (VALUES (1), (-1)) s(side)),
hit AS (SELECT frame, code, side, series_id, CASE code
    WHEN 0 THEN i >= 20
    WHEN 1 THEN i >= 20 AND k >= 5 AND CASE frame WHEN 'long' THEN NOT (cnt <= 3 AND k >= 1 AND d = -side) ELSE d = side AND NOT ct < cur END
    WHEN 2 THEN i >= 20 AND k >= 5 AND CASE frame WHEN 'long' THEN cnt <= 3 AND k >= 1 AND d = side ELSE d = side END
    WHEN 3 THEN i >= 20 AND k >= 5 AND st = side
    ELSE i >= 20 AND k >= 5 AND (st = side OR st = -2 * side) END AS ok FROM mapped, cases)
SELECT frame, CAST(code AS INT) AS code, side, series_id, count_if(ok) AS n FROM hit GROUP BY ALL""")
def higher_filters(spark, sf):
    """How many hourly bars each filter of a four-hour frame admits, in the meaning of the long frames and in that of the short one."""
    by = ["series_id"]
    h = hourly(spark, sf).select("series_id", "open_ms", "open", "high", "low", "close", "volume")
    q = resample.resample(h, 240, 60, complete=False).withColumn("ct", F.col("open_ms") + 4 * HOUR)
    q = state.latched_case(state.reversals(state.with_direction(q, "close", by), "close", "volume", by), by)
    q = state.pause_until(state.runs(q, "dir", by), by, 3, 1200).withColumn("native", F.row_number().over(W.partitionBy(*by).orderBy("ct")) - 1)
    b = h.select("series_id", (F.col("open_ms") + HOUR).alias("ct")).withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("ct")) - 1)
    b = A.asof(b, q.withColumnRenamed("ct", "ts_ms"), ["native", "dir", "run_bars", "state", "pause_until"])
    paused = F.coalesce(F.col("ct") < F.col("pause_until"), F.lit(False))
    c = F.col
    # all cases in one pass: counts of conditions, not rows for each case
    cases = [(frame, code, side) for frame in ("long", "short") for code in range(5) for side in (1, -1)]
    ok = lambda frame, code, side: filters.higher_filter(code, frame == "short", F.lit(side), c("native"), c("dir"), c("run_bars"), c("state"), paused, c("i"), (5, 20))
    wide = b.groupBy("series_id").agg(*(F.count_if(ok(*x)).alias(f"n{k}") for k, x in enumerate(cases)))
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("frame"), F.lit(x).alias("code"), F.lit(s).alias("side"), c(f"n{k}").alias("n")) for k, (f, x, s) in enumerate(cases))))
    return wide.select("series_id", rows.alias("r")).select("r.frame", "r.code", "r.side", "series_id", "r.n")


# (code, EMA limit, bars of the range, edge, chase limit), written out from the definitions
_PLACES = """(VALUES ('OFF', NULL, NULL, NULL, NULL), ('EMA5_ATR075', 0.75, NULL, NULL, NULL), ('EMA5_ATR100', 1.0, NULL, NULL, NULL), ('EMA5_ATR150', 1.5, NULL, NULL, NULL), ('EMA5_ATR200', 2.0, NULL, NULL, NULL),
  ('RANGE30_EDGE10', NULL, 30, 0.1, NULL), ('RANGE30_EDGE20', NULL, 30, 0.2, NULL), ('RANGE60_EDGE10', NULL, 60, 0.1, NULL), ('RANGE60_EDGE20', NULL, 60, 0.2, NULL),
  ('EMA5_ATR100_R60_E10', 1.0, 60, 0.1, NULL), ('EMA5_ATR100_R60_E20', 1.0, 60, 0.2, NULL), ('EMA5_ATR150_R60_E10', 1.5, 60, 0.1, NULL), ('EMA5_ATR150_R60_E20', 1.5, 60, 0.2, NULL),
  ('RESEARCH_CHASE5_SMAATR100', NULL, NULL, NULL, 1.0), ('RESEARCH_CHASE5_SMAATR150', NULL, NULL, NULL, 1.5), ('RESEARCH_CHASE5_SMAATR200', NULL, NULL, NULL, 2.0)) p(code, ema_limit, bars, edge, chase_limit)"""


@query(RULE_BARS + f""", u0 AS (SELECT series_id, ct, h, l, c, ema20_1, atr14, lag(c) OVER w AS pc, lag(c, 5) OVER w AS c5, ct - lag(ct, 19) OVER w AS d19, ct - lag(ct, 23) OVER w AS d23, ct - lag(ct, 30) OVER w AS d30, ct - lag(ct, 60) OVER w AS d60 FROM rb WINDOW w AS (PARTITION BY series_id ORDER BY ct)),
u1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr, CASE WHEN h >= c AND c >= l AND l > 0 THEN 1 ELSE 0 END AS good FROM u0),
u AS (SELECT *, CASE WHEN d30 = 30 * 3600000 THEN max(h) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS hi30, CASE WHEN d30 = 30 * 3600000 THEN min(l) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS lo30,
  CASE WHEN d60 = 60 * 3600000 THEN max(h) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS hi60, CASE WHEN d60 = 60 * 3600000 THEN min(l) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS lo60,
  d23 = 23 * 3600000 AND sum(good) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24 AS usable, avg(tr) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS sma FROM u1),
x AS (SELECT p.code, s.side, u.series_id, p.ema_limit, p.bars, p.chase_limit, u.c, p.edge, CASE p.bars WHEN 30 THEN hi30 WHEN 60 THEN hi60 END AS hi, CASE p.bars WHEN 30 THEN lo30 WHEN 60 THEN lo60 END AS lo,
  CASE WHEN d19 = 19 * 3600000 THEN ema20_1 END AS ema, atr14, usable, sma, c - c5 AS move FROM u, {_PLACES}, (VALUES (1), (-1)) s(side)),
y AS (SELECT code, side, series_id,
  (ema_limit IS NULL OR coalesce(atr14 > 0 AND CASE side WHEN 1 THEN c <= ema + ema_limit * atr14 ELSE c >= ema - ema_limit * atr14 END, false))
  AND (bars IS NULL OR coalesce(hi > lo AND CASE side WHEN 1 THEN c <= hi - edge * (hi - lo) ELSE c >= lo + edge * (hi - lo) END, false))
  AND (chase_limit IS NULL OR coalesce(usable AND sma > 0 AND side * move < chase_limit * sma, false)) AS ok FROM x)
SELECT code, side, series_id, count_if(ok) AS n FROM y GROUP BY ALL""")
def position_filters(spark, sf):
    """How many hourly bars each position filter admits on each side; the averages are those of the same bars."""
    by = ["series_id"]
    rb = rule_bars(spark, sf)
    b = filters.position_inputs(rb.select("series_id", "ct", F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close")), by, HOUR)
    native = filters.mapped_average(rb.select("series_id", "ct", F.col("ema20_1").alias("ema20"), "atr14"), by, HOUR)
    b = b.join(native, ["series_id", "ct"])
    cases = [(code, side) for code in filters.POSITION for side in (1, -1)]
    wide = b.groupBy("series_id").agg(*(F.count_if(filters.position(code, F.lit(side))).alias(f"n{k}") for k, (code, side) in enumerate(cases)))
    rows = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(side).alias("side"), F.col(f"n{k}").alias("n")) for k, (code, side) in enumerate(cases))))
    return wide.select("series_id", rows.alias("r")).select("r.code", "r.side", "series_id", "r.n")


@query(RULE_BARS + f""", z AS (SELECT series_id, ct, hist, last_value(nullif(sign(hist), 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ct ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sd FROM rb),
y AS (SELECT *, lag(sd) OVER (PARTITION BY series_id ORDER BY ct) AS psd FROM z)
SELECT series_id, ct, CAST(sum(CASE WHEN sd IS NOT NULL AND sd <> coalesce(psd, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ct) AS BIGINT) AS cycle_id,
CAST(sum(CASE WHEN sd = -1 AND psd = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ct) AS BIGINT) AS full_id FROM y""")
def macd_run_ids(spark, sf):
    b = rule_bars(spark, sf).select("series_id", "ct", "hist")
    return state.full_cycles(state.zero_runs(b, "hist", ["series_id"]), "hist", ["series_id"], -1).select("series_id", "ct", "cycle_id", "full_id")


@query("WITH " + HOURLY.strip() + """, n AS (SELECT series_id, open_ms, close, volume, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) AS n FROM hourly)
SELECT a.series_id, a.open_ms, a.close > max(b.close) AND a.volume < arg_max(b.volume, b.close) AS bearish, a.close < min(b.close) AND a.volume > arg_min(b.volume, b.close) AS bullish
FROM n a JOIN n b ON b.series_id = a.series_id AND b.n BETWEEN a.n - 10 AND a.n - 1 WHERE a.n > 10 GROUP BY a.series_id, a.open_ms, a.close, a.volume""")
def divergence(spark, sf):
    h = hourly(spark, sf).select("series_id", "open_ms", "close", "volume", F.col("open_ms").alias("ct"))
    h = h.withColumn("n", F.row_number().over(W.partitionBy("series_id").orderBy("ct")))
    return state.divergence(h, "close", "volume", 10, ["series_id"]).where("n > 10").select("series_id", "open_ms", "bearish", "bullish")


# ---- rules


HAVE = {"ratio", "delta", "trades", "avg_size", "funding", "oi", "oiv", "qv", "tq_ratio", "delta_quote"}


def _runnable(rules):
    skip = R.unavailable(rules, HAVE, 60)
    return [r for r in rules if r.id not in skip]


def _counted(sig: DataFrame) -> DataFrame:
    return sig.groupBy("rule_id", "side").agg(F.count("*").alias("n_signals"), F.countDistinct("series_id").alias("n_series"), F.min("ct").alias("first_ct"), F.max("ct").alias("last_ct"))


_COUNTED = " SELECT rule_id, side, count(*) AS n_signals, count(DISTINCT series_id) AS n_series, min(ct) AS first_ct, max(ct) AS last_ct FROM sig GROUP BY ALL"


def _rule_sql(rules):
    return RULE_BARS + ", sig AS (" + signal_sql(rules, 60, "rb", spark=False) + ")" + _COUNTED


@query(_rule_sql(_runnable(R.single_rules())))
def rules_single(spark, sf):
    return _counted(signals(rule_bars(spark, sf), _runnable(R.single_rules()), 60))


@query(_rule_sql(_runnable(R.family_rules())))
def rules_family(spark, sf):
    return _counted(signals(rule_bars(spark, sf), _runnable(R.family_rules()), 60))


@query(RULE_BARS + " SELECT series_id, ct, round(hist, 6) AS hist, round(dif, 6) AS dif, round(atr14, 6) AS atr14, round(rsi14, 6) AS rsi14, round(kama10, 6) AS kama10, round(ema20_3, 6) AS ema20_3, round(adx14, 6) AS adx14, round(ha5, 6) AS ha5, round(chaikin3_10, 6) AS chaikin3_10 FROM rb")
def indicator_folds(spark, sf):
    return r6(rule_bars(spark, sf).select("series_id", "ct", "hist", "dif", "atr14", "rsi14", "kama10", "ema20_3", "adx14", "ha5", "chaikin3_10"))


@query(RULE_BARS + ", sig AS (" + signal_sql([r for r in R.single_rules() if r.id in (24, 31, 56, 73)], 60, "rb", spark=False) + """), g AS (SELECT 1000 AS group_id, 'and' AS logic, unnest([24, 56]) AS rule_id, 2 AS n UNION ALL SELECT 1001, 'or', unnest([31, 73]), 2)
SELECT series_id, ct, group_id AS rule_id, side FROM sig JOIN g USING (rule_id) GROUP BY series_id, ct, group_id, side, logic, n HAVING logic = 'or' OR count(DISTINCT rule_id) = n""")
def compound_rules(spark, sf):
    sig = signals(rule_bars(spark, sf), [r for r in R.single_rules() if r.id in (24, 31, 56, 73)], 60)
    return compound(sig, spark.createDataFrame([(1000, "and", [24, 56]), (1001, "or", [31, 73])], "group_id int, logic string, members array<int>"))


_WINDOWED = [r for r in R.third_rules() if r.algorithm in ("t023", "t070", "t072", "t096")]


@query(_rule_sql(_WINDOWED))
def rules_third_windowed(spark, sf):
    return _counted(signals(rule_bars(spark, sf), _WINDOWED, 60))


@query()
def rules_third_machines(spark, sf):
    """Sequential detectors and event machines; no SQL says them, tests hold them against slow versions and against prefixes."""
    return _counted(machine_signals(rule_bars(spark, sf), {r.algorithm: r.id for r in R.third_rules() if r.algorithm in MACHINES}))


@query()
def rule_catalogue(spark, sf):
    rows = [(r.id, r.batch, r.algorithm, list(r.params), list(r.needs), r.status, r.placebo) for r in R.catalogue()]
    return spark.createDataFrame(rows, "rule_id int, batch string, algorithm string, params array<double>, needs array<string>, status string, placebo boolean")
