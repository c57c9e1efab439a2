"""Queries on sources, triggers, gates, entry modes and campaigns, each with SQL of its own."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import shared_folder
from ..operators import filters, state
from ..operators import profiles as P
from ..operators import selection as S
from ..operators.signals import unambiguous
from ..sources import bars as B
from ..sources import normalise as N
from ..sources.scan import read_table
from .base import HOUR, HOURLY, RULE_BARS, hourly, prints, rule_bars, table
from .market import _STATES, _states, query

# ---- sources


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf):
    """A table written as CSV and scanned as text, its numbers read strictly."""
    path = f"{shared_folder(spark)}/customer.csv"
    table(spark, sf, "customer").write.mode("overwrite").csv(path, header=True)
    t = N.numbers(read_table(spark, path), "c_acctbal")
    return t.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@query("WITH " + HOURLY.strip() + " SELECT series_id, open_ms, open, high, low, close, volume, taker_buy_base FROM hourly")
def normalised_bars(spark, sf):
    """Bars under other names, with numbers as text and times in seconds, made uniform again."""
    h = hourly(spark, sf)
    messy = h.select("series_id", (F.col("open_ms") / 1000).cast("long").cast("string").alias("openTime"), *(F.col(a).cast("string").alias(b) for a, b in (("open", "Open"), ("high", "h"), ("low", "Low"), ("close", "c"), ("volume", "vol"), ("taker_buy_base", "takerBuyBase"))))
    names = ("open", "high", "low", "close", "volume", "taker_buy_base")
    return N.timestamps(N.numbers(N.rename(messy), *names)).select("series_id", "open_ms", *names)


@query("WITH " + HOURLY.strip() + """, m AS (SELECT series_id, ts_ms // 3600000 * 3600000 AS open_ms, count(*) AS big, sum(quantity) AS taker_buy_base FROM prints WHERE price > 30 GROUP BY ALL)
SELECT h.series_id, h.open_ms, coalesce(m.taker_buy_base, h.taker_buy_base) AS taker_buy_base, m.big FROM hourly h LEFT JOIN m USING (series_id, open_ms)""")
def micro_merge(spark, sf):
    """Minute columns of another source joined one to one: its values win, the bar's own fill."""
    p = prints(spark, sf).where("price > 30")
    m = p.groupBy("series_id", (F.floor(F.col("ts_ms") / HOUR) * HOUR).alias("open_ms")).agg(F.count("*").alias("big"), F.sum("quantity").alias("taker_buy_base"))
    return B.merge_micro(hourly(spark, sf), m).select("series_id", "open_ms", "taker_buy_base", "big")


@query("WITH " + HOURLY.strip() + " SELECT series_id, open_ms, close FROM hourly WHERE open_ms >= 1704844800000 - 7200000 AND open_ms < 1705276800000")
def date_slice(spark, sf):
    """Five days of bars with two hours before them."""
    return B.slice_days(hourly(spark, sf), 1_704_844_800_000, 1_705_276_800_000, 2 * HOUR).select("series_id", "open_ms", "close")


# ---- entries


@query("WITH " + _STATES.strip() + """, a AS (SELECT *, dir <> lag(dir) OVER (PARTITION BY series_id ORDER BY open_ms) AS flips, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f END AS ma FROM s3 WINDOW f AS (PARTITION BY series_id ORDER BY open_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
t AS (SELECT a.*, m.mode, c.code, s.side FROM a, (VALUES ('state'), ('flip')) m(mode), (SELECT unnest(range(0, 5)) AS code) c, (VALUES (1), (-1)) s(side)),
x AS (SELECT series_id, mode, code, side, CASE code WHEN 0 THEN true WHEN 1 THEN dir = side AND (mode = 'state' OR flips) WHEN 2 THEN dir = side AND (mode = 'state' OR flips) AND CASE side WHEN 1 THEN close > ma ELSE close < ma END
  WHEN 3 THEN turn = side AND sufficient ELSE (turn = side AND sufficient) OR (turn = -side AND NOT sufficient) END AS ok FROM t)
SELECT series_id, mode, CAST(code AS INT) AS code, side, count_if(ok) AS n FROM x GROUP BY ALL""")
def base_triggers(spark, sf):
    """How often each trigger of the base timeframe fires on each side."""
    by = W.partitionBy("series_id").orderBy("ct")
    f = by.rowsBetween(-19, 0)
    b = _states(spark, sf).withColumns({"flips": F.col("dir") != F.lag("dir").over(by), "ma": F.when(F.count("close").over(f) == 20, F.avg("close").over(f))})
    c = F.col
    cases = [(m, code, side) for m in ("state", "flip") for code in range(5) for side in (1, -1)]
    ok = [filters.trigger(code, m == "flip", F.lit(side), c("dir"), c("flips"), c("close"), c("ma"), c("turn"), c("sufficient")) for m, code, side in cases]
    wide = b.groupBy("series_id").agg(*(F.count_if(x).alias(f"n{k}") for k, x in enumerate(ok)))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(code).alias("code"), F.lit(side).alias("side"), c(f"n{k}").alias("n")) for k, (m, code, side) in enumerate(cases))))
    return wide.select("series_id", rows.alias("r")).select("series_id", "r.mode", "r.code", "r.side", "r.n")


def _two_sided(spark, sf) -> DataFrame:
    """Signals of two rules, one of which fires for both sides on some bars."""
    h = hourly(spark, sf)
    green = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1)
    far = F.array_compact(F.array(F.when(F.col("high") > F.col("open") * 1.2, 1), F.when(F.col("low") < F.col("open") * 0.8, -1)))
    one = h.select("series_id", (F.col("open_ms") + HOUR).alias("ct"), F.lit(1).alias("rule_id"), green.alias("side")).where("side is not null")
    return one.unionByName(h.select("series_id", (F.col("open_ms") + HOUR).alias("ct"), F.lit(2).alias("rule_id"), F.explode(far).alias("side")))


_TWO = """, sig AS (SELECT series_id, open_ms + 3600000 AS ct, 1 AS rule_id, CASE WHEN close > open THEN 1 ELSE -1 END AS side FROM hourly WHERE close <> open
  UNION ALL SELECT series_id, open_ms + 3600000, 2, 1 FROM hourly WHERE high > open * 1.2::DOUBLE UNION ALL SELECT series_id, open_ms + 3600000, 2, -1 FROM hourly WHERE low < open * 0.8::DOUBLE)"""


@query("WITH " + HOURLY.strip() + _TWO + """ SELECT series_id, ct, rule_id, side FROM sig s WHERE NOT EXISTS (SELECT 1 FROM sig o WHERE o.series_id = s.series_id AND o.ct = s.ct AND o.rule_id = s.rule_id AND o.side = -s.side)""")
def unambiguous_signals(spark, sf):
    return unambiguous(_two_sided(spark, sf))


@query("WITH " + HOURLY.strip() + _TWO + """ SELECT name, rule_id, count(*) AS n FROM sig, (VALUES ('BOTH', 1), ('BOTH', -1), ('LONG', 1), ('SHORT', -1)) d(name, way) WHERE side = way GROUP BY ALL""")
def direction_filter(spark, sf):
    s = _two_sided(spark, sf)
    names = F.explode(F.array_compact(F.array(*(F.when(filters.side(n), F.lit(n)) for n in ("BOTH", "LONG", "SHORT")))))
    return s.select("rule_id", names.alias("name")).groupBy("name", "rule_id").agg(F.count("*").alias("n"))


@query("WITH " + _STATES.strip() + """ SELECT s4.series_id, s4.open_ms, coalesce(s4.close <= s4.trough * 1.3::DOUBLE, false) AS long_ok, coalesce(s4.close >= s4.peak * 0.7::DOUBLE, false) AS short_ok FROM s4""")
def structure_gate(spark, sf):
    """Closes not further than 30 % above the last trough, and below the last peak."""
    b = _states(spark, sf)
    c = F.col
    return b.select("series_id", "open_ms", filters.structure_gate(c("close"), c("trough"), F.lit(1), 0.3).alias("long_ok"), filters.structure_gate(c("close"), c("peak"), F.lit(-1), 0.3).alias("short_ok"))


@query(RULE_BARS + """, s0 AS (SELECT series_id, ct, hist, dir, lag(dir) OVER w AS pdir, last_value(nullif(sign(hist), 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ct ROWS UNBOUNDED PRECEDING) AS z FROM rb WINDOW w AS (PARTITION BY series_id ORDER BY ct)),
s1 AS (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY ct) AS pz, row_number() OVER (PARTITION BY series_id ORDER BY ct) - 1 AS i FROM s0),
s2 AS (SELECT *, sum(CASE WHEN dir IS DISTINCT FROM pdir OR i = 0 THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN z IS NOT NULL AND z IS DISTINCT FROM pz THEN 1 ELSE 0 END) OVER w AS cycle, sum(CASE WHEN z = 1 AND pz = -1 THEN 1 ELSE 0 END) OVER w AS red, sum(CASE WHEN z = -1 AND pz = 1 THEN 1 ELSE 0 END) OVER w AS green FROM s1 WINDOW w AS (PARTITION BY series_id ORDER BY ct)),
m AS (SELECT series_id, 'LIVE_01' AS mode, run AS id, true AS ok FROM s2 UNION ALL SELECT series_id, 'TF_EVENT', i, ct % 14400000 = 0 FROM s2 UNION ALL SELECT series_id, 'F5_EVENT', i, true FROM s2 UNION ALL SELECT series_id, 'MACD_CYCLE', cycle, cycle > 0 FROM s2
  UNION ALL SELECT series_id, 'MACD_FULL_RED', red, red > 0 FROM s2 UNION ALL SELECT series_id, 'MACD_FULL_GREEN', green, green > 0 FROM s2)
SELECT series_id, mode, count(*) AS n_bars, count(DISTINCT id) AS n_runs, CAST(sum(id) AS BIGINT) AS id_sum FROM m WHERE ok GROUP BY ALL""")
def entry_modes(spark, sf):
    """The bars that each entry mode admits and the runs they belong to; the lowest enabled frame is four hours."""
    b = state.runs(rule_bars(spark, sf).select("series_id", "ct", "hist", "dir", "i"), "dir", ["series_id"])
    each = [state.entry_runs(b, m, 240).select("series_id", F.lit(m).alias("mode"), F.col("entry_run").alias("id")).where("id is not null") for m in state.ENTRY_MODES]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("series_id", "mode").agg(F.count("*").alias("n_bars"), F.countDistinct("id").alias("n_runs"), F.sum("id").cast("long").alias("id_sum"))


@query("WITH " + HOURLY.strip() + """, d AS (SELECT series_id, open_ms, close, CAST(epoch_ms(open_ms + 3600000 + 28800000) AS DATE) AS day FROM hourly)
SELECT off_day, count(*) AS n, round(sum(close), 4) AS total FROM (SELECT close, dayofweek(day) IN (0, 6) OR day IN (DATE '2024-01-01', DATE '2024-01-10', DATE '2024-01-20') AS off_day FROM d) GROUP BY off_day""")
def holiday_kinds(spark, sf):
    """Weekends and listed holidays by the UTC+8 day of the close."""
    known = filters.holidays(spark, {2024: [date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 20)]})
    h = filters.day_kind(hourly(spark, sf).withColumn("ct", F.col("open_ms") + HOUR), known)
    return h.groupBy("off_day").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("WITH " + HOURLY.strip() + """, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) AS k FROM hourly)
SELECT a.series_id, a.open_ms, round(quantile_cont(b.close, 0.9), 6) AS q90, a.close > quantile_cont(b.close, 0.9) AS above FROM n a JOIN n b ON b.series_id = a.series_id AND b.k BETWEEN a.k - 20 AND a.k - 1 WHERE a.k > 20 GROUP BY a.series_id, a.open_ms, a.close""")
def rolling_quantile(spark, sf):
    """The interpolated ninth decile of the twenty closes before each."""
    by = W.partitionBy("series_id").orderBy("open_ms")
    f = by.rowsBetween(-20, -1)
    q = hourly(spark, sf).withColumns({"q": F.percentile("close", F.lit(0.9)).over(f), "n": F.count("close").over(f)}).where("n = 20")
    return q.select("series_id", "open_ms", F.round("q", 6).alias("q90"), (F.col("close") > F.col("q")).alias("above"))


@query("WITH " + _STATES.strip() + """, r AS (SELECT series_id, open_ms, dir, close, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) AS n FROM s4),
c AS (SELECT a.series_id, a.open_ms, count(b.n) = 3 AS held FROM r a LEFT JOIN r b ON b.series_id = a.series_id AND b.n BETWEEN a.n - 2 AND a.n AND b.dir = 1 GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN turn <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY open_ms) AS part FROM s4)
SELECT g.series_id, g.open_ms, c.held, (SELECT max(x.close) FROM g x WHERE x.series_id = g.series_id AND x.part = g.part AND x.open_ms <= g.open_ms AND x.turn = 0) AS excursion FROM g JOIN c USING (series_id, open_ms)""")
def confirmed_and_excursions(spark, sf):
    """Three rising directions in a row, and the highest close since the last turn."""
    b = state.confirmed(_states(spark, sf), "dir = 1", 3, ["series_id"], "held")
    b = state.excursion_peak(b.withColumn("reset", F.col("turn") != 0), "close", "reset", ["series_id"])
    return b.select("series_id", "open_ms", "held", "excursion")


# ---- campaigns


_CAMPAIGN = """c AS (SELECT l_suppkey AS config_id, l_linestatus AS win, l_returnflag AS cost, count(*) AS trades, round(sum(l_discount) / greatest(max(l_tax), 0.02), 6) AS ret_over_dd FROM lineitem GROUP BY ALL),
k AS (SELECT config_id, config_id % 7 AS family, round(0.5 * min(ret_over_dd) + 0.5 * median(ret_over_dd), 5) AS campaign_score FROM c WHERE trades >= 20 GROUP BY 1 HAVING count(DISTINCT win || cost) = 6),
f AS (SELECT family, round(median(campaign_score), 6) AS family_score, count(*) AS members FROM k GROUP BY 1)"""


def _campaign(spark, sf) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("config_id"), F.col("l_linestatus").alias("win"), F.col("l_returnflag").alias("cost")).agg(F.count("*").alias("trades"), F.round(F.sum("l_discount") / F.greatest(F.max("l_tax"), F.lit(0.02)), 6).alias("ret_over_dd"))
    k = S.in_all_cells(c, "config_id", ["win", "cost"], 6, F.col("trades") >= 20)
    return k.select("config_id", (F.col("config_id") % 7).alias("family"), F.round("campaign_score", 5).alias("campaign_score"))


@query("WITH " + _CAMPAIGN + " SELECT * FROM f")
def family_medians(spark, sf):
    f = S.family_medians(_campaign(spark, sf), "family")
    return f.select("family", F.round("family_score", 6).alias("family_score"), "members")


@query("WITH " + _CAMPAIGN + """, won AS (SELECT family FROM f ORDER BY family_score DESC, family LIMIT 3)
SELECT config_id, family, campaign_score FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY campaign_score DESC, config_id) AS n FROM k WHERE family IN (SELECT family FROM won)) WHERE n <= 2""")
def frozen_for_validation(spark, sf):
    """Up to two candidates of each of the three best families."""
    c = _campaign(spark, sf)
    f = S.family_medians(c, "family").withColumn("family_score", F.round("family_score", 6))
    return S.frozen_for_validation(c, f, "family", "config_id", 3).select("config_id", "family", "campaign_score")


@query("""WITH p AS (SELECT l_suppkey % 5 AS category, l_suppkey * 10 + l_linenumber AS id, substr(sha256(CAST(l_suppkey % 50 AS VARCHAR) || '|' || l_linenumber), 1, 16) AS fp, round(sum(l_discount), 6) AS score FROM lineitem GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS n FROM p) WHERE n <= 20),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY id) AS m FROM t) WHERE m = 1)
SELECT id, fp, score FROM o ORDER BY score DESC, id LIMIT 30""")
def global_top(spark, sf):
    """The best of all from the best of each category, equal configurations once."""
    p = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("category"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), F.substring(F.sha2(F.concat_ws("|", F.col("l_suppkey") % 50, "l_linenumber"), 256), 1, 16).alias("fp")).agg(F.round(F.sum("l_discount"), 6).alias("score"))
    best = S.top_k(p, 20, [F.desc("score"), F.asc("id")], "category")
    return S.top_k(S.first_of_each(best.select("id", "fp", "score"), "fp", "id"), 30, [F.desc("score"), F.asc("id")]).select("id", "fp", "score")



# ---- days, volume, states


_OHLC = HOURLY + ", b AS (SELECT series_id, open_ms + 3600000 AS ct, open AS o, high AS h, low AS l, close AS c, volume AS v FROM hourly)"


def _ohlc(spark, sf) -> DataFrame:
    return hourly(spark, sf).select("series_id", (F.col("open_ms") + HOUR).alias("ct"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))


@query("WITH RECURSIVE " + _OHLC.strip() + """, x AS (SELECT series_id, (ct - 1) // 86400000 AS day, CAST(floor(c / 7) AS BIGINT) AS box, sum(v) AS volume FROM b GROUP BY ALL),
g AS (SELECT series_id, day, min(box) AS lo, max(box) AS hi, sum(volume) AS total FROM x GROUP BY ALL),
f AS (SELECT g.series_id, g.day, s.box, coalesce(x.volume, 0) AS volume FROM g, LATERAL (SELECT unnest(range(lo, hi + 1)) AS box) s LEFT JOIN x ON x.series_id = g.series_id AND x.day = g.day AND x.box = s.box),
p AS (SELECT series_id, day, min(box) AS poc FROM (SELECT *, max(volume) OVER (PARTITION BY series_id, day) AS most FROM f) WHERE volume = most GROUP BY ALL),
area(series_id, day, a, b, kept, k) AS (
  SELECT p.series_id, p.day, p.poc, p.poc, f.volume, 0 FROM p JOIN f ON f.series_id = p.series_id AND f.day = p.day AND f.box = p.poc
  UNION ALL
  SELECT t.series_id, t.day, CASE WHEN coalesce(l.volume, -1) >= coalesce(r.volume, -1) THEN t.a - 1 ELSE t.a END, CASE WHEN coalesce(l.volume, -1) >= coalesce(r.volume, -1) THEN t.b ELSE t.b + 1 END,
    t.kept + CASE WHEN coalesce(l.volume, -1) >= coalesce(r.volume, -1) THEN l.volume ELSE r.volume END, t.k + 1
  FROM area t JOIN g ON g.series_id = t.series_id AND g.day = t.day LEFT JOIN f l ON l.series_id = t.series_id AND l.day = t.day AND l.box = t.a - 1 LEFT JOIN f r ON r.series_id = t.series_id AND r.day = t.day AND r.box = t.b + 1
  WHERE t.kept < 0.7::DOUBLE * g.total AND (t.a > g.lo OR t.b < g.hi)),
e AS (SELECT series_id, day, arg_max(a, k) AS a, arg_max(b, k) AS b FROM area GROUP BY ALL)
SELECT e.series_id, e.day, (p.poc + 0.5::DOUBLE) * 7 AS poc, e.a * 7.0::DOUBLE AS value_low, (e.b + 1) * 7.0::DOUBLE AS value_high, g.total FROM e JOIN p USING (series_id, day) JOIN g USING (series_id, day)""")
def volume_profile(spark, sf):
    """The busiest price box of each day and the area that holds 70 % of its volume."""
    return P.day_profile(_ohlc(spark, sf), F.lit(7.0)).select("series_id", "day", "poc", "value_low", "value_high", "total")


@query("WITH RECURSIVE " + _OHLC.strip() + """, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ct) AS n FROM b),
walk(series_id, n, held, bucket, ends) AS (
  SELECT series_id, n, v, 0, v >= 900 FROM r WHERE n = 1
  UNION ALL SELECT r.series_id, r.n, CASE WHEN w.ends THEN r.v ELSE w.held + r.v END, w.bucket + CASE WHEN w.ends THEN 1 ELSE 0 END, CASE WHEN w.ends THEN r.v ELSE w.held + r.v END >= 900 FROM walk w JOIN r ON r.series_id = w.series_id AND r.n = w.n + 1)
SELECT series_id, CAST(bucket AS INT) AS bucket, max(r.ct) AS ct, arg_min(o, r.ct) AS o, max(h) AS h, min(l) AS l, arg_max(c, r.ct) AS c, sum(v) AS v, CAST(count(*) AS INT) AS n_bars FROM walk JOIN r USING (series_id, n) GROUP BY series_id, bucket HAVING bool_or(ends)""")
def volume_clock(spark, sf):
    """Buckets of whole bars with a volume of 900 at least."""
    return P.volume_buckets(_ohlc(spark, sf), 900.0)


@query("WITH " + _OHLC.strip() + """, s AS (SELECT series_id, ct, CASE WHEN c > o * 1.1::DOUBLE THEN 2 WHEN c < o * 0.9::DOUBLE THEN 0 ELSE 1 END AS st, row_number() OVER (PARTITION BY series_id ORDER BY ct) AS n FROM b),
t AS (SELECT a.series_id, a.ct, a.n, p.st AS was, a.st AS now FROM s a JOIN s p ON p.series_id = a.series_id AND p.n = a.n - 1),
k AS (SELECT t.series_id, t.ct, count(u.n) FILTER (WHERE u.was = t.was AND u.now = t.now) AS same, count(u.n) FILTER (WHERE u.was = t.was) AS from_it FROM t LEFT JOIN t u ON u.series_id = t.series_id AND u.n BETWEEN t.n - 100 AND t.n - 1 GROUP BY ALL)
SELECT s.series_id, s.ct, round((k.same + 1) / (k.from_it + 3.0), 9) AS share FROM s LEFT JOIN k USING (series_id, ct)""")
def state_transitions(spark, sf):
    """How usual each bar's change of state was among the hundred before."""
    b = _ohlc(spark, sf)
    b = b.withColumn("st", F.when(F.col("c") > F.col("o") * 1.1, 2).when(F.col("c") < F.col("o") * 0.9, 0).otherwise(1))
    return P.transition_counts(b, "st", (0, 1, 2), 100).select("series_id", "ct", F.round("share", 9).alias("share"))


@query("WITH " + _OHLC.strip() + """, x AS (SELECT series_id, (ct - 1) // 86400000 AS day, CAST((ct - 1) % 86400000 // 14400000 AS INT) AS slot, round(sum(c - o), 6) AS move FROM b GROUP BY ALL),
d AS (SELECT series_id, day FROM x GROUP BY ALL HAVING count(*) = 6), f AS (SELECT x.* FROM x JOIN d USING (series_id, day)),
m AS (SELECT a.series_id, a.day, a.slot, count(*) AS n_days, avg(p.move) AS slot_mean, stddev_pop(p.move) AS sd FROM x a JOIN f p ON p.series_id = a.series_id AND p.slot = a.slot AND p.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT a.series_id, a.day, a.slot, avg(p.move) AS all_mean FROM m a JOIN f p ON p.series_id = a.series_id AND p.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY ALL)
SELECT m.series_id, m.day, m.slot, m.n_days, round((n_days * slot_mean + 30 * all_mean) / (n_days + 30), 8) AS mean, round(sd / sqrt(n_days), 4) AS error FROM m JOIN g USING (series_id, day, slot)""")
def seasonal_slots(spark, sf):
    """Mean moves of the six four-hour slots over the fourteen days before, drawn to the mean of all."""
    b = _ohlc(spark, sf)
    x = b.groupBy("series_id", F.floor((F.col("ct") - 1) / 86_400_000).alias("day"), F.floor(F.pmod(F.col("ct") - 1, F.lit(86_400_000)) / 14_400_000).cast("int").alias("slot")).agg(F.round(F.sum(F.col("c") - F.col("o")), 6).alias("move"))
    s = P.seasonal_slots(x, "move", "slot", "day", 14, 5)
    return s.select("series_id", "day", "slot", "n_days", F.round("mean", 8).alias("mean"), F.round("error", 4).alias("error"))
