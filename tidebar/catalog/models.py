"""Queries of the walk-forward models, over the hourly bars of every series.

The catalogue's own training windows have thousands of minute bars; a table of hourly bars has some seven hundred a series. So windows
of ten days (240 bars) stand in for weeks of minutes here, and costs are those of prices that jump by halves. Only the recurrence plot
can be said in SQL; tests/test_learned.py holds all of them against slow versions, bar by bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import with_folds
from ..operators import learned as L
from ..operators import structures as S
from ..operators.walkforward import numbered
from ..sources.bars import derived_flow
from .base import HOUR, HOURLY, hourly
from .market import query, r6

ROWS = 240


def model_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived_flow(hourly(spark, sf_dir)).select(
        "series_id", F.lit(0).alias("segment"), "open_ms", (F.col("open_ms") + HOUR).alias("ct"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.col("volume").alias("v"), F.col("trades").cast("double").alias("trades"), F.col("delta_base").alias("delta"),
    )
    b = with_folds(numbered(b))
    return b.select("series_id", "segment", "ct", "o", "h", "l", "c", "v", "trades", "delta", "atr14")


def _out(df: DataFrame) -> DataFrame:
    return r6(df.drop("segment", "i"))


@query()
def rule_hidden_states(spark, sf):
    return _out(L.hidden_states(model_bars(spark, sf), rows=ROWS))


@query()
def rule_isolation_forest(spark, sf):
    return _out(L.isolation_forest(model_bars(spark, sf), rows=ROWS))


@query()
def rule_boosted_trees(spark, sf):
    return _out(L.boosted_trees(model_bars(spark, sf), rows=ROWS, cost=0.2))


@query()
def rule_class_logit(spark, sf):
    return _out(L.class_logit(model_bars(spark, sf), rows=ROWS, cost=0.2))


@query()
def rule_gaussian_process(spark, sf):
    return _out(L.gaussian_process(model_bars(spark, sf), rows=ROWS, bound=0.2))


@query()
def rule_quantile_band(spark, sf):
    return _out(L.quantile_band(model_bars(spark, sf), rows=ROWS))


@query()
def rule_tail_fade(spark, sf):
    return _out(L.tail_fade(model_bars(spark, sf), rows=ROWS, scale=48, least=10))


_RECURRENCE = "WITH " + HOURLY.strip() + """, b AS (
  SELECT series_id, open_ms + 3600000 AS ct, i, x, x - lag(x) OVER w AS r, x - lag(x, 10) OVER w AS move
  FROM (SELECT series_id, open_ms, ln(close) AS x, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) - 1 AS i FROM hourly) WINDOW w AS (PARTITION BY series_id ORDER BY i)
), e AS (SELECT series_id, i AS t FROM b WHERE i >= 61 AND (i - 61) % 5 = 0),
z AS (SELECT series_id, t, k, (r - avg(r) OVER g) / nullif(stddev_pop(r) OVER g, 0) AS z FROM (SELECT e.series_id, t, b.i - t + 60 AS k, r FROM e JOIN b ON b.series_id = e.series_id AND b.i BETWEEN t - 60 AND t - 1) WINDOW g AS (PARTITION BY series_id, t)),
v AS (SELECT *, lead(z, 1) OVER g AS z1, lead(z, 2) OVER g AS z2 FROM z WINDOW g AS (PARTITION BY series_id, t ORDER BY k)),
p AS (SELECT a.series_id, a.t, b.k - a.k AS apart, a.k FROM v a JOIN v b ON a.series_id = b.series_id AND a.t = b.t AND b.k > a.k + 2 WHERE (a.z - b.z) ** 2 + (a.z1 - b.z1) ** 2 + (a.z2 - b.z2) ** 2 < 0.25),
l AS (SELECT series_id, t, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY series_id, t, apart ORDER BY k) AS line FROM p) GROUP BY series_id, t, apart, line),
d AS (SELECT series_id, t, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / sum(n) AS determinism FROM l GROUP BY series_id, t),
o AS (SELECT e.series_id, t, determinism, lag(determinism) OVER (PARTITION BY e.series_id ORDER BY t) AS past FROM e LEFT JOIN d USING (series_id, t))
SELECT o.series_id, ct, round(determinism, 6) AS determinism, CASE WHEN past <= 0.3 AND determinism > 0.3 THEN CAST(sign(move) AS INTEGER) ELSE 0 END AS side FROM o JOIN b ON b.series_id = o.series_id AND b.i = o.t
"""


@query(_RECURRENCE)
def rule_recurrence(spark, sf):
    return _out(L.recurrence_turn(model_bars(spark, sf), rows=60, limit=0.3))


@query()
def rule_flow_lags(spark, sf):
    return _out(L.flow_lags(model_bars(spark, sf), rows=ROWS, horizon=3, errors=8))


@query()
def rule_expert_mix(spark, sf):
    return _out(L.expert_mix(model_bars(spark, sf), rows=ROWS, ar_rows=120, ou_rows=120, cost=0.2, half_life=(0.05, 120)))


# ---- structures


def _numbered(spark, sf):
    return numbered(model_bars(spark, sf))


@query()
def rule_triangles(spark, sf):
    return _out(S.triangles(_numbered(spark, sf), flat=1.0))


@query()
def rule_pivot_clusters(spark, sf):
    return _out(S.pivot_clusters(_numbered(spark, sf), HOUR, 2, 4))


_WIDE = "coalesce(count(tr) OVER p = 12 AND tr > 1.2 * avg(tr) OVER p, false)"


def _expansion_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT *, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY i)),
{name}1 AS (SELECT *, {_WIDE} AS wide FROM {name}0 WINDOW p AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT series_id, i, CAST(sign(c - o) AS INTEGER) AS sign FROM (SELECT *, lag(wide, 1, false) OVER (PARTITION BY series_id ORDER BY i) AS was FROM {name}1) WHERE wide AND NOT was AND c <> o)"""


def _larger_sql(name: str, n: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT series_id, i, ct, first_value(o) OVER w AS o, max(h) OVER w AS h, min(l) OVER w AS l, c FROM b WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE ct % {n * HOUR} = 0 AND i >= {n - 1})"""


_BARS = "WITH RECURSIVE " + HOURLY.strip() + ", b AS (SELECT series_id, open_ms + 3600000 AS ct, open AS o, high AS h, low AS l, close AS c, row_number() OVER (PARTITION BY series_id ORDER BY open_ms) - 1 AS i FROM hourly)"
#: Bar by bar: the stage of the chain, its side and when it began and went on.
_CASCADE = f"""{_BARS}, {_larger_sql("m4", 4)}, {_larger_sql("m2", 2)}, {_expansion_sql("e4", "m4")}, {_expansion_sql("e2", "m2")}, {_expansion_sql("e1", "b")},
e AS (SELECT b.series_id, b.i, b.ct, coalesce(e4.sign, 0) AS e4, coalesce(e2.sign, 0) AS e2, coalesce(e1.sign, 0) AS e1 FROM b LEFT JOIN e4 USING (series_id, i) LEFT JOIN e2 USING (series_id, i) LEFT JOIN e1 USING (series_id, i)),
walk AS (
  SELECT series_id, i, ct, CASE WHEN e4 <> 0 THEN 1 ELSE 0 END AS stage, e4 AS sign, i AS first, i AS second, 0 AS side FROM e WHERE i = 0
  UNION ALL
  SELECT e.series_id, e.i, e.ct, CASE WHEN e4 <> 0 THEN 1 WHEN live = 1 AND e2 <> 0 THEN CASE WHEN e2 = w.sign THEN 2 ELSE 0 END WHEN live = 2 AND e1 <> 0 THEN 0 ELSE live END,
         CASE WHEN e4 <> 0 THEN e4 ELSE w.sign END, CASE WHEN e4 <> 0 THEN e.i ELSE w.first END, CASE WHEN e4 = 0 AND live = 1 AND e2 <> 0 THEN e.i ELSE w.second END,
         CASE WHEN e4 = 0 AND live = 2 AND e1 <> 0 AND e1 = w.sign THEN e1 ELSE 0 END
  FROM (SELECT *, CASE WHEN i + 1 - first > 20 THEN 0 ELSE stage END AS live FROM walk) w JOIN e ON e.series_id = w.series_id AND e.i = w.i + 1
) SELECT series_id, ct, first, second, side FROM walk WHERE side <> 0
"""


@query(_CASCADE)
def rule_cascade(spark, sf):
    return _out(S.cascade(_numbered(spark, sf), HOUR, 2, 4, rows=12, times=1.2))


#: Box by box from the closes alone; the range is the mean-seeded one, as a recursive query.
_FIGURE = f"""{_BARS}, r AS (SELECT *, greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr FROM b WINDOW w AS (PARTITION BY series_id ORDER BY i)),
a AS (
  SELECT series_id, i, (SELECT avg(tr) FROM r q WHERE q.series_id = r.series_id AND q.i < 14) AS atr FROM r WHERE i = 13
  UNION ALL SELECT r.series_id, r.i, (13 * a.atr + r.tr) / 14 FROM a JOIN r ON r.series_id = a.series_id AND r.i = a.i + 1
), d AS (SELECT b.series_id, (ct - 1) // 86400000 AS day, median(atr) AS m FROM b LEFT JOIN a USING (series_id, i) GROUP BY ALL HAVING count(*) = 24 AND median(atr) IS NOT NULL AND max(ct) % 86400000 = 0),
x AS (SELECT b.series_id, ct, (ct - 1) // 86400000 AS day, CAST(floor(c / greatest(m * 0.1, 0.01)) AS BIGINT) AS box, row_number() OVER (PARTITION BY b.series_id, (ct - 1) // 86400000 ORDER BY ct) AS k
  FROM b JOIN d ON d.series_id = b.series_id AND d.day + 1 = (ct - 1) // 86400000),
s AS (
  SELECT series_id, day, k, ct, box, 0 AS col, 1 AS columns, box AS reach, CAST(NULL AS BIGINT) AS top, CAST(NULL AS BIGINT) AS bottom, false AS free, 0 AS side FROM x WHERE k = 1
  UNION ALL
  SELECT series_id, day, k, ct, box, col, columns, reach, top, bottom, free AND NOT fires, CASE WHEN free AND fires THEN col ELSE 0 END FROM (
    SELECT *, columns >= 3 AND top IS NOT NULL AND bottom IS NOT NULL AND CASE WHEN col = 1 THEN box > top ELSE box < bottom END AS fires FROM (
      SELECT x.series_id, x.day, x.k, x.ct, x.box, CASE WHEN s.col = 0 THEN CAST(sign(x.box - s.reach) AS INTEGER) WHEN turns THEN -s.col ELSE s.col END AS col, CASE WHEN turns THEN columns + 1 ELSE columns END AS columns,
             CASE WHEN s.col = 0 OR turns OR s.col * (x.box - s.reach) > 0 THEN x.box ELSE s.reach END AS reach, CASE WHEN turns AND s.col = 1 THEN s.reach ELSE top END AS top, CASE WHEN turns AND s.col = -1 THEN s.reach ELSE bottom END AS bottom, free OR turns AS free
      FROM (SELECT s.*, s.col <> 0 AND s.col * (n.box - s.reach) <= -3 AS turns FROM s JOIN x n ON n.series_id = s.series_id AND n.day = s.day AND n.k = s.k + 1) s JOIN x ON x.series_id = s.series_id AND x.day = s.day AND x.k = s.k + 1))
) SELECT series_id, ct, box, col AS "column", columns, side FROM s
"""


@query(_FIGURE)
def rule_point_and_figure(spark, sf):
    return _out(S.point_and_figure(_numbered(spark, sf), bars_a_day=24, of_range=0.1))


@query()
def rule_partial_bucket(spark, sf):
    """The rest of each half day from its first four hours."""
    return _out(L.partial_bucket(model_bars(spark, sf), HOUR, 12, 4, rows=24, usual=5))
