"""Queries on results, selections, exits, replays, grids and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters
from ..operators import selection as S
from ..operators.asof import next_true
from ..operators.calendar import allowed_direction
from ..operators.exits import Plan, exit_table
from ..operators.replay import Account, replay_grid
from ..plans.grid import all_stop_codes
from ..plans.grid import grid as lazy_grid
from ..plans.targets import target_catalogue as all_targets
from .base import HOUR, HOURLY, MS, RULE_BARS, hourly, rule_bars, table
from .market import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

# ---- result rows made from order lines


def accounts(spark, sf) -> DataFrame:
    """Result rows: a configuration for each supplier and line number, its trades the lines, one year's after the other."""
    ret = F.round(F.col("l_discount") - 0.05, 2)
    years = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("config_id"), (F.col("l_suppkey") % 5).alias("category"), F.year("l_shipdate").alias("year")).agg(
        F.count("*").alias("trades"), F.count_if(ret > 0).alias("wins"), F.sum(ret).alias("sum_ret"), F.sum(ret * ret).alias("sum_sq"), F.sum(F.when(ret > 0, ret).otherwise(0.0)).alias("profit"), F.sum(F.when(ret < 0, -ret).otherwise(0.0)).alias("loss"),
        F.sum(F.col("l_quantity")).alias("hold_minutes"), F.sum("l_tax").alias("tax"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)).alias("protections"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 50) & (F.col("l_tax") == 0)).alias("forced"),
        F.count_if(F.col("l_linestatus") == "O").alias("longs"), F.max((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08)).alias("stopped"),
    )
    total = lambda c: F.sum(c).alias(c)
    r6 = lambda c: F.round(F.sum(c), 6).alias(c)
    in_year = lambda y: F.round(F.sum(F.when(F.col("year") == y, F.col("sum_ret")).otherwise(0.0)), 6)
    out = years.groupBy("config_id", "category").agg(
        total("trades"), total("wins"), r6("sum_ret"), r6("sum_sq"), r6("profit"), r6("loss"), total("hold_minutes"), F.round(F.sum("tax") / F.sum("trades") * 8, 6).alias("max_drawdown"), total("protections"), total("forced"),
        F.round(F.sum("longs") / F.sum("trades"), 6).alias("long_share"), F.max("stopped").alias("stopped"), F.min(F.round("sum_ret", 6)).alias("worst_year"), in_year(1996).alias("first_year"), in_year(1997).alias("last_year"),
    )
    return out.withColumns({"initial": F.lit(1000.0), "final_equity": F.round(1000 * (1 + F.col("sum_ret")), 4)})


ACCOUNTS = """years AS (
  SELECT l_suppkey * 10 + l_linenumber AS config_id, l_suppkey % 5 AS category, year(l_shipdate) AS year, count(*) AS trades, count_if(ret > 0) AS wins, sum(ret) AS sum_ret, sum(ret * ret) AS sum_sq, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) AS profit, sum(CASE WHEN ret < 0 THEN -ret ELSE 0 END) AS loss,
         sum(l_quantity) AS hold_minutes, sum(l_tax) AS tax, count_if(l_returnflag = 'R' AND l_quantity >= 50) AS protections, count_if(l_returnflag = 'A' AND l_quantity >= 50 AND l_tax = 0) AS forced, count_if(l_linestatus = 'O') AS longs, bool_or(l_quantity = 50 AND l_tax = 0.08::DOUBLE) AS stopped
  FROM (SELECT *, round(l_discount - 0.05::DOUBLE, 2) AS ret FROM lineitem) GROUP BY ALL
), accounts AS (
  SELECT *, 1000.0::DOUBLE AS initial, round(1000 * (1 + sum_ret), 4) AS final_equity FROM (
    SELECT config_id, category, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(wins) AS BIGINT) AS wins, round(sum(sum_ret), 6) AS sum_ret, round(sum(sum_sq), 6) AS sum_sq, round(sum(profit), 6) AS profit, round(sum(loss), 6) AS loss, sum(hold_minutes) AS hold_minutes,
           round(sum(tax) / sum(trades) * 8, 6) AS max_drawdown, CAST(sum(protections) AS BIGINT) AS protections, CAST(sum(forced) AS BIGINT) AS forced, round(sum(longs) / sum(trades), 6) AS long_share, bool_or(stopped) AS stopped, min(round(sum_ret, 6)) AS worst_year,
           round(sum(CASE WHEN year = 1996 THEN sum_ret ELSE 0 END), 6) AS first_year, round(sum(CASE WHEN year = 1997 THEN sum_ret ELSE 0 END), 6) AS last_year FROM years GROUP BY ALL)
), metrics0 AS (
  SELECT *, CASE WHEN loss > 0 THEN round(profit / loss, 6) ELSE 0 END AS profit_factor, round(wins / trades, 6) AS win_rate, round(sum_ret / trades, 6) AS mean_ret,
         CASE WHEN trades > 1 THEN round(sqrt(greatest((sum_sq - trades * (sum_ret / trades) * (sum_ret / trades)) / (trades - 1), 0)), 5) END AS std_ret, round(trades / 2500.0, 6) AS trades_per_day, round(hold_minutes / (2500.0 * 1440), 6) AS capacity FROM accounts
), metrics AS (
  SELECT *, round(mean_ret + 0.001::DOUBLE, 6) AS gross_before_cost, round(mean_ret + 0.001::DOUBLE - 0.003::DOUBLE, 6) AS p95_net, round((mean_ret + 0.001::DOUBLE) / 0.001::DOUBLE, 6) AS cost_ratio FROM metrics0
)"""


def metrics(spark, sf) -> DataFrame:
    m = S.finalised(accounts(spark, sf), F.lit(2500.0)).drop("t_stat")
    m = m.withColumns({c: F.round(c, 6) for c in ("profit_factor", "win_rate", "mean_ret", "trades_per_day", "capacity")} | {"std_ret": F.round("std_ret", 5)})
    return S.cost_metrics(m, 0.001, 0.003, 0.01).withColumns({c: F.round(c, 6) for c in ("gross_before_cost", "p95_net", "cost_ratio")})


@query("WITH " + ACCOUNTS + " SELECT config_id, trades, mean_ret, std_ret, profit_factor, win_rate, trades_per_day, capacity, p95_net, cost_ratio FROM metrics")
def trade_metrics(spark, sf):
    return metrics(spark, sf).select("config_id", "trades", "mean_ret", "std_ret", "profit_factor", "win_rate", "trades_per_day", "capacity", "p95_net", "cost_ratio")


_GATED = ACCOUNTS + """, gated AS (
  SELECT *, list_filter([CASE WHEN NOT coalesce(trades >= 20, false) THEN 'few_trades' END, CASE WHEN NOT coalesce(final_equity > initial, false) THEN 'no_profit' END, CASE WHEN NOT coalesce(max_drawdown <= 0.5, false) THEN 'drawdown' END,
    CASE WHEN NOT coalesce(profit_factor >= 1.05 OR (profit_factor = 0 AND win_rate = 1), false) THEN 'profit_factor' END, CASE WHEN NOT coalesce(protections = 0, false) THEN 'protected' END, CASE WHEN NOT coalesce(NOT stopped, false) THEN 'stopped' END], lambda e: e IS NOT NULL) AS reasons FROM metrics
)"""


def gated(spark, sf):
    return metrics(spark, sf).withColumn("reasons", S.gate_reasons(**S.return_gates()))


@query("WITH " + _GATED + " SELECT config_id, array_to_string(reasons, ',') AS reasons FROM gated")
def eligibility_reasons(spark, sf):
    return gated(spark, sf).select("config_id", F.array_join("reasons", ",").alias("reasons"))


@query("WITH " + _GATED + ", r AS (SELECT unnest(reasons) AS reason FROM gated) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def rejection_counts(spark, sf):
    return S.reason_counts(gated(spark, sf))


@query("WITH " + ACCOUNTS + """, g AS (SELECT config_id, list_filter([
  CASE WHEN protections > 0 THEN 'protected' END, CASE WHEN forced <> 0 THEN 'liquidated' END, CASE WHEN stopped THEN 'out_of_capital' END, CASE WHEN max_drawdown > 0.4 THEN 'drawdown' END, CASE WHEN first_year <= 0 THEN 'first_year_lost' END, CASE WHEN last_year <= 0 THEN 'last_year_lost' END,
  CASE WHEN profit_factor < 1.05 THEN 'profit_factor' END, CASE WHEN p95_net <= 0 THEN 'p95_net' END, CASE WHEN cost_ratio < 2 THEN 'cost_ratio' END, CASE WHEN gross_before_cost <= 0 THEN 'gross' END, CASE WHEN capacity > 0.0003 THEN 'capacity' END,
  CASE WHEN long_share NOT BETWEEN 0.3 AND 0.7 THEN 'long_share' END, CASE WHEN trades < 20 THEN 'few_trades' END], lambda e: e IS NOT NULL) AS reasons FROM metrics)
SELECT reason, count(*) AS n, min(config_id) AS first_id FROM (SELECT config_id, unnest(CASE WHEN len(reasons) = 0 THEN ['passed'] ELSE reasons END) AS reason FROM g) GROUP BY reason""")
def stress_gates(spark, sf):
    """The thirteen hard gates of the stress scheme: how many configurations fail at each."""
    gates = S.stress_gates(0, 0.4, 1.05, 0.0003, (0.3, 0.7), 20, ("first_year", "last_year"))
    g = metrics(spark, sf).withColumn("reasons", S.gate_reasons(**gates))
    g = g.withColumn("reason", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("passed"))).otherwise(F.col("reasons"))))
    return g.groupBy("reason").agg(F.count("*").alias("n"), F.min("config_id").alias("first_id"))


def _rank_sql(metric: str, order: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY category) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY category ORDER BY {metric}{order}) END"


_SCORED = ACCOUNTS + f""", ranked AS (SELECT *, {_rank_sql('max_drawdown', ' DESC')} AS r_dd, {_rank_sql('p95_net', '')} AS r_net, {_rank_sql('worst_year', '')} AS r_year, {_rank_sql('capacity', ' DESC')} AS r_cap, {_rank_sql('profit_factor', '')} AS r_pf FROM metrics),
scored AS (SELECT *, round(100.0 * (0.35 * ((least(0.975, greatest(0.025, r_dd)) - 0.025) / 0.95) + 0.25 * ((least(0.975, greatest(0.025, r_net)) - 0.025) / 0.95) + 0.20 * ((least(0.975, greatest(0.025, r_year)) - 0.025) / 0.95)
  + 0.10 * ((least(0.975, greatest(0.025, r_cap)) - 0.025) / 0.95) + 0.10 * ((least(0.975, greatest(0.025, r_pf)) - 0.025) / 0.95)), 6) AS score FROM ranked)"""


def scored(spark, sf):
    return S.percentile_score(metrics(spark, sf), "category").withColumn("score", F.round("score", 6))


@query("WITH " + _SCORED + " SELECT config_id, category, round(score, 4) AS score FROM scored")
def percentile_score(spark, sf):
    return scored(spark, sf).select("config_id", "category", F.round("score", 4).alias("score"))


@query("WITH " + _SCORED + """, s AS (SELECT *, round(score, 4) AS sc, config_id // 30 AS cluster FROM scored),
top AS (SELECT config_id, why FROM (
  SELECT config_id, 'score' AS why, row_number() OVER (PARTITION BY category ORDER BY sc DESC, max_drawdown, p95_net DESC, config_id) AS n, 20 AS k FROM s
  UNION ALL SELECT config_id, 'drawdown', row_number() OVER (PARTITION BY category ORDER BY max_drawdown, sc DESC, config_id), 10 FROM s
  UNION ALL SELECT config_id, 'p95_net', row_number() OVER (PARTITION BY category ORDER BY p95_net DESC, sc DESC, config_id), 10 FROM s) WHERE n <= k),
t AS (SELECT config_id, string_agg(why, ';' ORDER BY why) AS reasons FROM top GROUP BY 1),
c AS (SELECT s.*, t.reasons FROM s JOIN t USING (config_id)),
b AS (SELECT category, cluster, arg_min(config_id, row(-sc, max_drawdown, -p95_net, config_id)) AS best FROM c GROUP BY ALL),
l AS (SELECT c.category, c.cluster, arg_min(c.config_id, row(max_drawdown, -p95_net, -sc, c.config_id)) AS low FROM c JOIN b USING (category, cluster) WHERE c.config_id <> b.best GROUP BY ALL),
kept AS (SELECT * FROM c WHERE config_id IN (SELECT best FROM b UNION ALL SELECT low FROM l))
SELECT config_id, category, cluster, reasons, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sc DESC, max_drawdown, p95_net DESC, config_id) AS place FROM kept) WHERE place <= 12""")
def research_candidates(spark, sf):
    """The preselection of 20, 10 and 10 of each category, two of each cluster, twelve a category."""
    rows = scored(spark, sf).withColumns({"score": F.round("score", 4), "cluster": F.floor(F.col("config_id") / 30)}).select("config_id", "category", "cluster", "score", "max_drawdown", "p95_net")
    out = S.research_candidates(rows, "category", "cluster", "config_id", 12)
    return out.select("config_id", "category", "cluster", F.array_join("reasons", ";").alias("reasons"), "place")


_RANKING_SQL = {"total_return": "sum_ret", "t_stat": "CASE WHEN std_ret > 0 THEN round(mean_ret / (std_ret / sqrt(trades)), 4) END", "orders_per_day": "2 * trades_per_day", "executed": "trades", "open_quantity": "round(final_equity / 100, 6)", "mean_hold": "round(hold_minutes / trades, 6)", "stopped": "CAST(stopped AS INT)"}


@query("WITH " + ACCOUNTS + ", x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, config_id, CAST({_RANKING_SQL.get(m, m)} AS DOUBLE) AS value, row_number() OVER (ORDER BY {_RANKING_SQL.get(m, m)} {'DESC' if up else 'ASC'} NULLS LAST, max_drawdown, config_id) AS place FROM metrics" for m, up in (
    ("final_equity", 1), ("total_return", 1), ("profit_factor", 1), ("t_stat", 1), ("win_rate", 1), ("trades_per_day", 1), ("orders_per_day", 1), ("trades", 1), ("mean_ret", 1), ("sum_ret", 1), ("first_year", 1), ("last_year", 1), ("long_share", 1), ("executed", 1), ("open_quantity", 1),
    ("max_drawdown", 0), ("protections", 0), ("forced", 0), ("mean_hold", 0), ("stopped", 0))) + ") SELECT metric, config_id, value, CAST(place AS INT) AS place FROM x WHERE place <= 5")
def ranking_metrics(spark, sf):
    """The first five configurations by each of the twenty metrics."""
    n = F.col("trades")
    m = metrics(spark, sf).withColumns({
        "total_return": F.col("sum_ret"), "t_stat": F.when(F.col("std_ret") > 0, F.round(F.col("mean_ret") / (F.col("std_ret") / F.sqrt(n)), 4)), "orders_per_day": 2 * F.col("trades_per_day"), "executed": n,
        "open_quantity": F.round(F.col("final_equity") / 100, 6), "mean_hold": F.round(F.col("hold_minutes") / n, 6), "stopped": F.col("stopped").cast("int"),
    })
    return S.first_of_rankings(m, 5, "config_id").select("metric", "config_id", "value", "place")


@query("WITH " + ACCOUNTS + " SELECT * FROM (SELECT config_id, category, final_equity, row_number() OVER (PARTITION BY category ORDER BY final_equity DESC, max_drawdown, config_id) AS rank FROM metrics) WHERE rank <= 10")
def topk_per_category(spark, sf):
    return S.top_k(metrics(spark, sf), 10, [F.desc("final_equity"), F.asc("max_drawdown"), F.asc("config_id")], "category").select("config_id", "category", "final_equity", "rank")


@query("WITH " + _GATED + """ SELECT * FROM (SELECT config_id, category, 'best' AS list, row_number() OVER (PARTITION BY category ORDER BY final_equity DESC, max_drawdown, config_id) AS rank FROM gated WHERE len(reasons) <= 1) WHERE rank <= 5
UNION ALL SELECT * FROM (SELECT config_id, category, 'worst' AS list, row_number() OVER (PARTITION BY category ORDER BY final_equity, max_drawdown DESC, protections, config_id) AS rank FROM gated WHERE trades > 0) WHERE rank <= 3""")
def best_and_worst(spark, sf):
    return S.best_and_worst(gated(spark, sf), 5, 3, "final_equity", "category", "config_id", F.size("reasons") <= 1).select("config_id", "category", "list", "rank")


@query("WITH " + ACCOUNTS + """, b AS (SELECT category, max(final_equity) AS best FROM metrics GROUP BY category)
SELECT config_id, category, final_equity, rank FROM (SELECT m.config_id, m.category, m.final_equity, row_number() OVER (PARTITION BY m.category ORDER BY m.max_drawdown, m.final_equity DESC, m.config_id) AS rank FROM metrics m JOIN b USING (category) WHERE m.final_equity >= 0.9 * b.best) WHERE rank <= 20""")
def best90_retention(spark, sf):
    near = S.near_best(metrics(spark, sf), "final_equity", "category")
    return S.top_k(near, 20, [F.asc("max_drawdown"), F.desc("final_equity"), F.asc("config_id")], "category").select("config_id", "category", "final_equity", "rank")


@query("WITH " + _SCORED + """, c AS (SELECT config_id, config_id // 50 AS cluster, round(score, 6) AS score, max_drawdown FROM scored), a AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, config_id) AS n, row_number() OVER (PARTITION BY cluster ORDER BY max_drawdown, score DESC, config_id) AS m FROM c)
SELECT config_id, cluster, score FROM a WHERE n = 1 OR m = 1""")
def cluster_diversity(spark, sf):
    c = scored(spark, sf).select("config_id", F.floor(F.col("config_id") / 50).alias("cluster"), F.round("score", 6).alias("score"), "max_drawdown")
    return S.diverse(c, "cluster", "config_id").select("config_id", "cluster", "score")


@query("""SELECT min(l_orderkey * 10 + l_linenumber) AS id, substr(sha256('l_discount=' || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) || '|l_returnflag=' || l_returnflag || '|l_tax=' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR)), 1, 16) AS config_fp FROM lineitem GROUP BY 2""")
def config_fingerprint(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"), "l_returnflag", F.round(F.col("l_tax") * 100).cast("long").alias("l_tax"))
    li = li.withColumn("config_fp", S.fingerprint("l_discount", "l_returnflag", "l_tax"))
    return S.first_of_each(li, "config_fp", "id").select("id", "config_fp")


_REGIMES = """r AS (SELECT l_suppkey, l_linenumber, l_returnflag, round(sum(round(l_discount - 0.05::DOUBLE, 2)), 6) + 0.0::DOUBLE AS final_return, round(avg(l_tax), 6) AS max_drawdown, round(sum(l_discount) / greatest(sum(l_tax), 0.01::DOUBLE), 6) AS profit_factor, round(avg(l_quantity), 6) AS t_stat, count(*) AS trades FROM lineitem GROUP BY ALL)"""


@query("WITH " + _REGIMES + """, a AS (SELECT l_suppkey, l_linenumber, round(avg(final_return), 6) AS mean_ret, min(final_return) AS worst_ret, max(final_return) AS best_ret, count_if(final_return > 0) AS profitable, round(avg(max_drawdown), 6) AS mean_dd, round(avg(profit_factor), 6) AS mean_pf, round(avg(t_stat), 6) AS mean_t, min(trades) AS least_trades FROM r GROUP BY ALL),
n AS (SELECT count(*) AS n FROM a),
q AS (SELECT a.*, (rank() OVER (ORDER BY worst_ret) + (count(*) OVER (PARTITION BY worst_ret) - 1) / 2.0) / n AS p1, (rank() OVER (ORDER BY mean_ret) + (count(*) OVER (PARTITION BY mean_ret) - 1) / 2.0) / n AS p2, (rank() OVER (ORDER BY mean_dd DESC) + (count(*) OVER (PARTITION BY mean_dd) - 1) / 2.0) / n AS p3,
  (rank() OVER (ORDER BY mean_pf) + (count(*) OVER (PARTITION BY mean_pf) - 1) / 2.0) / n AS p4, (rank() OVER (ORDER BY mean_t) + (count(*) OVER (PARTITION BY mean_t) - 1) / 2.0) / n AS p5 FROM a, n)
SELECT l_suppkey, l_linenumber, worst_ret, best_ret, profitable, least_trades, round((0.60 * p1 + 0.20 * p2 + 0.10 * p3 + 0.05 * p4 + 0.05 * p5) * least(1.0, sqrt(least_trades / 20.0)) * 100, 4) AS stress FROM q""")
def stress_score(spark, sf):
    c = F.col
    r = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag").agg(
        (F.round(F.sum(F.round(c("l_discount") - 0.05, 2)), 6) + 0.0).alias("final_return"), F.round(F.avg("l_tax"), 6).alias("max_drawdown"), F.round(F.sum("l_discount") / F.greatest(F.sum("l_tax"), F.lit(0.01)), 6).alias("profit_factor"),
        F.round(F.avg("l_quantity"), 6).alias("t_stat"), F.count("*").alias("trades"),
    )
    agg = S.regimes(r, ["l_suppkey", "l_linenumber"]).withColumns({m: F.round(m, 6) for m in ("mean_ret", "mean_dd", "mean_pf", "mean_t")})
    s = S.scored_by_ranks(agg)
    return s.select("l_suppkey", "l_linenumber", "worst_ret", "best_ret", "profitable", "least_trades", F.round("stress", 4).alias("stress"))


@query("""WITH c AS (SELECT l_suppkey AS config_id, l_linestatus AS win, l_returnflag AS cost, count(*) AS trades, round(sum(l_discount) / greatest(max(l_tax), 0.02), 6) AS ret_over_dd FROM lineitem GROUP BY ALL),
k AS (SELECT config_id, count(DISTINCT win || cost) AS n_cells, min(ret_over_dd) AS worst, median(ret_over_dd) AS middle FROM c WHERE trades >= 20 GROUP BY 1 HAVING count(DISTINCT win || cost) = 6)
SELECT config_id, config_id % 7 AS family, n_cells, round(0.5 * worst + 0.5 * middle, 5) AS campaign_score FROM k""")
def walkforward_two_window(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("config_id"), F.col("l_linestatus").alias("win"), F.col("l_returnflag").alias("cost")).agg(F.count("*").alias("trades"), F.round(F.sum("l_discount") / F.greatest(F.max("l_tax"), F.lit(0.02)), 6).alias("ret_over_dd"))
    return S.in_all_cells(c, "config_id", ["win", "cost"], 6, F.col("trades") >= 20).select("config_id", (F.col("config_id") % 7).alias("family"), "n_cells", F.round("campaign_score", 5).alias("campaign_score"))


@query("""WITH v AS (SELECT l_returnflag, l_linenumber, l_suppkey AS seed, round(sum(l_discount - 0.05::DOUBLE), 6) AS x FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS q10, round(quantile_cont(x, 0.9), 6) AS q90, max(x) AS best, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END), 6) AS profitable, count(*) AS seeds FROM v GROUP BY ALL""")
def seed_quantiles(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber", F.col("l_suppkey").alias("seed")).agg(F.round(F.sum(F.col("l_discount") - 0.05), 6).alias("x"))
    q = S.seed_quantiles(v, ["l_returnflag", "l_linenumber"], "x")
    return q.withColumns({c: F.round(c, 6) for c in ("median", "q10", "q90", "profitable")})


# ---- exits


_PLANS = [Plan(1, "fixed", 0.2), Plan(2, "target", 0.3), Plan(3, "time", 5), Plan(4, "bad", 3), Plan(5, "atr", 0.5), Plan(6, "ma", 10, 2), Plan(7, "target_time", 4), Plan(8, "event"), Plan(9, "reversal"), Plan(10, "target_atr", 0.5)]


def _exit_inputs(spark, sf):
    """Entries, each bar with a candle for its side, and the bars of all series."""
    b = rule_bars(spark, sf).withColumn("event", F.col("dir"))
    b = b.select("series_id", "i", "ct", "o", "h", "l", "c", "v", "atr14", "event")
    return b.where("c <> o").select("series_id", "i", F.when(F.col("c") > F.col("o"), 1).otherwise(-1).alias("side")), b


_EXITS = RULE_BARS + """, bb AS (SELECT series_id, CAST(i AS BIGINT) AS i, o, h, l, c, atr14, dir, avg(c) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma10 FROM rb),
ee AS (SELECT series_id, i, CASE WHEN c > o THEN 1 ELSE -1 END AS side, c AS px, atr14 FROM bb WHERE c <> o),
b3 AS (SELECT *, CASE WHEN i >= 2 THEN max(c) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS mx3, CASE WHEN i >= 2 THEN min(c) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS mn3,
  CASE WHEN i >= 10 THEN c < ma10 AND lag(c) OVER w < lag(ma10) OVER w END AS below2, CASE WHEN i >= 10 THEN c > ma10 AND lag(c) OVER w > lag(ma10) OVER w END AS above2 FROM bb WINDOW w AS (PARTITION BY series_id ORDER BY i)),
x AS (
  SELECT e.series_id, e.i, e.side, e.px, e.atr14,
    min(CASE WHEN CASE WHEN side = 1 THEN l <= px * (1 - side * 0.2::DOUBLE) ELSE h >= px * (1 - side * 0.2::DOUBLE) END THEN b.i END) AS x1,
    min(CASE WHEN CASE WHEN side = 1 THEN h >= px * (1 + side * 0.3::DOUBLE) ELSE l <= px * (1 + side * 0.3::DOUBLE) END THEN b.i END) AS x2,
    min(CASE WHEN b.i = e.i + 5 THEN b.i END) AS x3,
    min(CASE WHEN b.i >= e.i + 3 AND CASE WHEN side = 1 THEN mx3 < px ELSE mn3 > px END THEN b.i END) AS x4,
    min(CASE WHEN CASE WHEN side = 1 THEN l <= px - side * 0.5::DOUBLE * e.atr14 ELSE h >= px - side * 0.5::DOUBLE * e.atr14 END THEN b.i END) AS x5,
    min(CASE WHEN b.i >= e.i + 2 AND CASE WHEN side = 1 THEN below2 ELSE above2 END THEN b.i END) AS x6,
    min(CASE WHEN b.i = e.i + 4 AND (c - px) * side > 0 THEN b.i END) AS x7,
    min(CASE WHEN dir = -side THEN b.i END) AS x8,
    min(CASE WHEN dir = -side AND (c - px) * side > 0 THEN b.i END) AS x9,
    min(CASE WHEN CASE WHEN side = 1 THEN h >= px + side * 0.5::DOUBLE * e.atr14 ELSE l <= px + side * 0.5::DOUBLE * e.atr14 END THEN b.i END) AS x10
  FROM ee e JOIN b3 b ON b.series_id = e.series_id AND b.i > e.i GROUP BY ALL
), long AS (
  SELECT e.series_id, e.i, e.side, p.plan_id, CASE p.plan_id WHEN 1 THEN x1 WHEN 2 THEN x2 WHEN 3 THEN x3 WHEN 4 THEN x4 WHEN 5 THEN x5 WHEN 6 THEN x6 WHEN 7 THEN x7 WHEN 8 THEN x8 WHEN 9 THEN x9 ELSE x10 END AS exit_i, e.px, e.atr14
  FROM ee e LEFT JOIN x USING (series_id, i, side), (SELECT unnest(range(1, 11)) AS plan_id) p
)
SELECT l.series_id, l.i, l.side, CAST(l.plan_id AS INT) AS plan_id, l.exit_i, round(CASE WHEN l.exit_i IS NULL THEN NULL WHEN l.plan_id = 1 THEN px * (1 - l.side * 0.2::DOUBLE) WHEN l.plan_id = 2 THEN px * (1 + l.side * 0.3::DOUBLE) WHEN l.plan_id = 5 THEN px - l.side * 0.5::DOUBLE * l.atr14 WHEN l.plan_id = 10 THEN px + l.side * 0.5::DOUBLE * l.atr14 ELSE b.c END, 6) AS exit_px
FROM long l LEFT JOIN bb b ON b.series_id = l.series_id AND b.i = l.exit_i"""


@query(_EXITS)
def exit_plans(spark, sf):
    """Every plan for every entry of every series."""
    e, b = _exit_inputs(spark, sf)
    return exit_table(e, b, _PLANS).select("series_id", "i", "side", "plan_id", "exit_i", F.round("exit_px", 6).alias("exit_px"))


_MOVING = [Plan(1, "trail_share", 0.1, 0.3), Plan(2, "trail_price", 0.1, 0.05), Plan(3, "lock", 0.1, 0.02), Plan(4, "ma_cross", 10, 2), Plan(5, "fade", 0.7, 2)]


@query(RULE_BARS + """, bb AS (SELECT series_id, CAST(i AS BIGINT) AS i, o, h, l, c, v FROM rb),
m AS (SELECT *, CASE WHEN i >= 9 THEN avg(c) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS ma, CASE WHEN i >= 20 THEN avg(v) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS mv FROM bb),
ev AS (SELECT *, c < ma AND lag(c) OVER w < lag(ma) OVER w AND lag(c, 2) OVER w >= lag(ma, 2) OVER w AS dn, c > ma AND lag(c) OVER w > lag(ma) OVER w AND lag(c, 2) OVER w <= lag(ma, 2) OVER w AS up, mv > 0 AND v <= 0.7::DOUBLE * mv AND lag(mv) OVER w > 0 AND lag(v) OVER w <= 0.7::DOUBLE * lag(mv) OVER w AS fade FROM m WINDOW w AS (PARTITION BY series_id ORDER BY i)),
e AS (SELECT series_id, i, CASE WHEN c > o THEN 1 ELSE -1 END AS side, c AS px FROM bb WHERE c <> o),
-- the whole path of every entry; prices of shorts are turned over, so that up is in the entry's favour
q0 AS (SELECT e.series_id, e.i, e.side, e.px, b.i AS j, CASE e.side WHEN 1 THEN b.h ELSE -b.l END AS good, CASE e.side WHEN 1 THEN b.l ELSE -b.h END AS bad, e.side * b.c AS close, e.side * e.px AS entry, (b.c - e.px) * e.side > 0 AS gain, CASE e.side WHEN 1 THEN b.dn ELSE b.up END AS crossed, b.fade FROM e JOIN ev b ON b.series_id = e.series_id AND b.i > e.i),
q1 AS (SELECT *, greatest(entry, max(good) OVER w) AS best, greatest(entry, coalesce(max(good) OVER (PARTITION BY series_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) AS known, max(CASE WHEN close >= side * (px * (1 + side * 0.1::DOUBLE)) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS locked FROM q0 WINDOW w AS (PARTITION BY series_id, i ORDER BY j ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, known >= side * (px * (1 + side * 0.1::DOUBLE)) AS armed, entry + (known - entry) * (1 - 0.3::DOUBLE) AS share_line, side * (abs(known) * (1 - side * 0.05::DOUBLE)) AS price_line, side * (px * (1 + side * 0.02::DOUBLE)) AS lock_line FROM q1),
x AS (SELECT series_id, i, side, plan_id, j, line FROM (
    SELECT series_id, i, side, 1 AS plan_id, j, share_line AS line FROM q WHERE armed AND bad <= share_line UNION ALL SELECT series_id, i, side, 2, j, price_line FROM q WHERE armed AND bad <= price_line
    UNION ALL SELECT series_id, i, side, 3, j, lock_line FROM q WHERE locked = 1 AND bad <= lock_line UNION ALL SELECT series_id, i, side, 4, j, close FROM q WHERE crossed AND gain UNION ALL SELECT series_id, i, side, 5, j, close FROM q WHERE fade AND gain)),
f AS (SELECT series_id, i, side, plan_id, min(j) AS exit_i, arg_min(line, j) AS line FROM x GROUP BY ALL)
SELECT e.series_id, e.i, e.side, CAST(p.plan_id AS INT) AS plan_id, f.exit_i, round(e.side * f.line, 5) AS exit_px FROM e CROSS JOIN (SELECT unnest(range(1, 6)) AS plan_id) p LEFT JOIN f ON f.series_id = e.series_id AND f.i = e.i AND f.plan_id = p.plan_id""")
def moving_exits(spark, sf):
    """Trailing and locked targets, crossings of an average and fading volume, for every entry of every series."""
    e, b = _exit_inputs(spark, sf)
    return exit_table(e, b, _MOVING).select("series_id", "i", "side", "plan_id", "exit_i", F.round("exit_px", 5).alias("exit_px"))


@query("WITH " + HOURLY.strip() + """ SELECT series_id, open_ms, min(CASE WHEN close > open * 1.5 THEN open_ms END) OVER (PARTITION BY series_id ORDER BY open_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ms FROM hourly""")
def next_event(spark, sf):
    return next_true(hourly(spark, sf), "close > open * 1.5", "next_ms", ["series_id"], "open_ms").select("series_id", "open_ms", "next_ms")


@query("WITH " + HOURLY.strip() + """ SELECT CASE WHEN ((open_ms + 3600000) // 86400000 + 3) % 7 < 5 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END AS rate, count(*) AS n, round(sum(close * CASE WHEN ((open_ms + 3600000) // 86400000 + 3) % 7 < 5 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END), 4) AS distance FROM hourly GROUP BY 1""")
def weekday_rates(spark, sf):
    h = hourly(spark, sf).withColumn("rate", filters.rate_by_day(F.col("open_ms") + HOUR, 0.01, 0.02))
    return h.groupBy("rate").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close") * F.col("rate")), 4).alias("distance"))


# ---- replay


def grid(spark, series: list[str]) -> DataFrame:
    """Every combination of series, stop and target, made by mixed-radix decoding of one number: nothing is multiplied out on the driver."""
    stops, targets = 4, 3
    n = len(series) * stops * targets
    ids = spark.range(n).withColumn("series_id", F.element_at(F.lit(series), (F.floor(F.col("id") / (stops * targets)) + 1).cast("int")))
    return ids.select(F.col("id").alias("config_id"), "series_id", F.lit(24).alias("rule_id"), (F.floor(F.col("id") / targets) % stops).cast("int").alias("stop_id"), (F.col("id") % targets).cast("int").alias("target_id"), F.array(F.lit(0.5), F.lit(1.0), F.lit(3.0)).alias("leverages"))


@query()
def replay_configurations(spark, sf):
    """Configurations replayed over the bars, all leverages sharing one exit plan, with their metrics."""
    b = rule_bars(spark, sf).withColumn("event", F.col("dir")).select("series_id", "i", "ct", "o", "h", "l", "c", "atr14", "event")
    e = b.where("c <> o").select("series_id", F.lit(24).alias("rule_id"), "i", F.when(F.col("c") > F.col("o"), 1).otherwise(-1).alias("side"), F.col("i").alias("run"))
    stops = {0: [Plan(0, "fixed", 0.5)], 1: [Plan(1, "fixed", 0.2), Plan(2, "bad", 3, intrabar=False)], 2: [Plan(3, "atr", 1)], 3: [Plan(4, "time", 10, intrabar=False)]}
    targets = {0: [Plan(0, "target", 0.3)], 1: [Plan(1, "target_atr", 1)], 2: [Plan(2, "reversal", intrabar=False), Plan(3, "target", 0.5)]}
    base = Account(slippage=0.0005, fee=0.0004, protection=0.9, cooldown=2, bar_minutes=60)
    found = replay_grid(grid(spark, ["click", "error", "purchase", "signup", "view", "all"]), b, e, stops, targets, base, ("ct", "o", "h", "l", "c", "atr14", "event"))
    rows = S.account_rows(found).withColumn("initial", F.lit(base.initial))
    return S.finalised(rows, F.lit(30.0))


_COSTS = dict(slippage=0.0005, fee=0.0004, protection=0.5)


_COSTS_SQL = RULE_BARS + """, bb AS (SELECT series_id, CAST(i AS BIGINT) AS i, ct, o, h, l, c FROM rb), n AS (SELECT series_id, max(i) AS last FROM bb GROUP BY 1),
e AS (SELECT series_id, i, CASE WHEN c > o THEN 1 ELSE -1 END AS side, c AS px FROM bb WHERE c <> o),
-- the first touch of the stop, of the target, and of the level at which half of the equity is gone after the opening fee, at three times leverage
lim AS (SELECT *, px * (1 - side * 0.12::DOUBLE) AS stop_px, px * (1 + side * 0.2::DOUBLE) AS target_px, CASE WHEN lev = 1 THEN 'one' ELSE 'five' END AS who FROM e, (VALUES (1.0::DOUBLE), (5.0::DOUBLE)) v(lev)),
x AS (SELECT q.series_id, q.lev, q.i, q.side, q.px,
    min(CASE WHEN CASE q.side WHEN 1 THEN b.l <= stop_px ELSE b.h >= stop_px END THEN b.i END) AS s, min(CASE WHEN CASE q.side WHEN 1 THEN b.h >= target_px ELSE b.l <= target_px END THEN b.i END) AS t,
    min(CASE WHEN lev * (0.0004::DOUBLE - q.side * (CASE q.side WHEN 1 THEN b.l ELSE b.h END / px - 1)) >= 0.5::DOUBLE THEN b.i END) AS p
  FROM lim q LEFT JOIN bb b ON b.series_id = q.series_id AND b.i > q.i GROUP BY ALL),
y AS (SELECT x.series_id, lev, x.i, side, px, CASE WHEN t IS NOT NULL AND (s IS NULL OR t < s) THEN t WHEN s IS NOT NULL THEN s ELSE last END AS planned, t IS NOT NULL AND (s IS NULL OR t < s) AS took, s, t, p, last FROM x JOIN n USING (series_id)),
z AS (SELECT y.series_id, lev, y.i, y.side, y.px, CASE WHEN p <= planned THEN p ELSE planned END AS x, coalesce(p <= planned, false) AS saved, took AND NOT coalesce(p <= planned, false) AS took,
    CASE WHEN p <= planned THEN -0.5::DOUBLE / lev + 0.0004::DOUBLE WHEN took THEN side * ((px * (1 + side * 0.2::DOUBLE)) / px - 1) WHEN s IS NOT NULL THEN side * ((px * (1 - side * 0.12::DOUBLE)) / px - 1) ELSE side * (b.c / px - 1) END AS raw
  FROM y JOIN bb b ON b.series_id = y.series_id AND b.i = last WHERE planned > y.i),
f AS (SELECT *, raw - 0.0005::DOUBLE - 0.0004::DOUBLE - 0.0004::DOUBLE * (1 + side * raw) AS net, greatest(x + CASE WHEN took THEN 2 ELSE 0 END + 1, x + 1) AS ready FROM z),
nxt AS (SELECT a.series_id, a.lev, a.i, min(b.i) AS j FROM f a JOIN f b ON b.series_id = a.series_id AND b.lev = a.lev AND b.i >= a.ready GROUP BY ALL),
path(series_id, lev, k, i, equity, after) AS (
  SELECT f.series_id, f.lev, 0, f.i, 1000.0::DOUBLE, 1000.0::DOUBLE * greatest(0, 1 + f.lev * f.net) FROM f WHERE f.i = (SELECT min(g.i) FROM f g WHERE g.series_id = f.series_id AND g.lev = f.lev)
  UNION ALL
  SELECT p.series_id, p.lev, p.k + 1, g.i, p.after, p.after * greatest(0, 1 + p.lev * g.net) FROM path p JOIN nxt USING (series_id, lev, i) JOIN f g ON g.series_id = p.series_id AND g.lev = p.lev AND g.i = nxt.j WHERE p.after > 0),
trade AS (SELECT p.*, f.side, f.px, f.x, f.saved, f.took, f.net FROM path p JOIN f USING (series_id, lev, i)),
-- equity as it was seen: after the opening fee, at each bar's adverse extreme, at its close, after the trade; only the last two raise the peak
ev AS (
  SELECT series_id, lev, k, i AS j, 0 AS part, greatest(0, equity * (1 - lev * 0.0004::DOUBLE)) AS v, false AS raises FROM trade
  UNION ALL SELECT t.series_id, lev, k, b.i, 1, greatest(0, equity * (1 + lev * (side * (CASE side WHEN 1 THEN b.l ELSE b.h END / px - 1) - 0.0004::DOUBLE))), false FROM trade t JOIN bb b ON b.series_id = t.series_id AND b.i > t.i AND (b.i < t.x OR b.i = t.x AND NOT saved)
  UNION ALL SELECT t.series_id, lev, k, b.i, 2, greatest(0, equity * (1 + lev * (side * (b.c / px - 1) - 0.0004::DOUBLE))), true FROM trade t JOIN bb b ON b.series_id = t.series_id AND b.i > t.i AND b.i < t.x
  UNION ALL SELECT series_id, lev, k, x, 3, after, true FROM trade),
dd AS (SELECT series_id, lev, max(1 - v / greatest(1000.0::DOUBLE, coalesce(peak, 0))) AS max_drawdown FROM (SELECT *, max(CASE WHEN raises THEN v END) OVER (PARTITION BY series_id, lev ORDER BY k, j, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM ev) GROUP BY ALL)
SELECT t.series_id, t.lev AS leverage, count(*) AS trades, count_if(net > 0) AS wins, CAST(sum(x - t.i) AS BIGINT) AS hold_bars, CAST(sum(CASE WHEN took THEN least(2, last - x) ELSE 0 END) AS BIGINT) AS wait_bars, count_if(saved) AS protections,
  round(sum(net), 6) AS sum_ret, round(sum(greatest(net, 0)), 6) AS profit, round(sum(greatest(-net, 0)), 6) AS loss, round(arg_max(after, k), 4) AS final_equity, round(greatest(0, any_value(max_drawdown)), 6) AS max_drawdown
FROM trade t JOIN n USING (series_id) JOIN dd USING (series_id, lev) GROUP BY ALL"""
_TOUCHED = "WHEN took THEN side * ((px * (1 + side * 0.2::DOUBLE)) / px - 1) WHEN s IS NOT NULL THEN side * ((px * (1 - side * 0.12::DOUBLE)) / px - 1) ELSE side * (b.c / px - 1) END AS raw"


def _with_costs(spark, sf, **more) -> DataFrame:
    b = rule_bars(spark, sf).select("series_id", "i", "ct", "o", "h", "l", "c", "atr14")
    e = b.where("c <> o").select("series_id", F.lit(1).alias("rule_id"), "i", F.when(F.col("c") > F.col("o"), 1).otherwise(-1).alias("side"), F.col("i").alias("run"))
    cfg = b.select("series_id").distinct().select(F.xxhash64("series_id").alias("config_id"), "series_id", F.lit(1).alias("rule_id"), F.lit(0).alias("stop_id"), F.lit(0).alias("target_id"), F.array(F.lit(1.0), F.lit(5.0)).alias("leverages"))
    a = S.account_rows(replay_grid(cfg, b, e, {0: [Plan(0, "fixed", 0.12)]}, {0: [Plan(1, "target", 0.2)]}, Account(cooldown=2, **_COSTS, **more)))
    long = lambda c, n=None: F.col(c).cast("long").alias(n or c)
    six = lambda c, n=6: F.round(c, n).alias(c)
    return a.select("series_id", "leverage", long("trades"), long("wins"), long("hold_minutes", "hold_bars"), long("wait_minutes", "wait_bars"), long("protections"), six("sum_ret"), six("profit"), six("loss"), six("final_equity", 4), six("max_drawdown"))


@query(_COSTS_SQL)
def replay_with_costs(spark, sf):
    """Accounts of every series at one and five times leverage with fees, slippage, protection at half of the equity and a cooldown."""
    return _with_costs(spark, sf)


@query(_COSTS_SQL.replace(_TOUCHED, "ELSE side * (d.c / px - 1) END AS raw").replace("FROM y JOIN bb b ON b.series_id = y.series_id AND b.i = last", "FROM y JOIN bb d ON d.series_id = y.series_id AND d.i = planned"))
def replay_confirmed_closes(spark, sf):
    """The same, filled at the close of the bar on which an exit was touched."""
    return _with_costs(spark, sf, close_confirmed=True)


@query("""SELECT CAST(id AS BIGINT) AS config_id, CAST(id // 1320 % 6 AS INT) AS session, CAST(id // 22 % 60 AS INT) AS stop, CAST(id % 22 AS INT) AS leverage FROM (SELECT unnest(range(0, 7920)) AS id)
EXCEPT SELECT l_orderkey, CAST(l_orderkey // 1320 % 6 AS INT), CAST(l_orderkey // 22 % 60 AS INT), CAST(l_orderkey % 22 AS INT) FROM lineitem""")
def grid_resume(spark, sf):
    """A lazily decoded grid without the configurations that are done."""
    g = spark.range(6 * 60 * 22).select(F.col("id").alias("config_id"), (F.floor(F.col("id") / 1320) % 6).cast("int").alias("session"), (F.floor(F.col("id") / 22) % 60).cast("int").alias("stop"), (F.col("id") % 22).cast("int").alias("leverage"))
    return S.not_done(g, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("config_id")))


# the definitions in their frozen order, as SQL says them: old combinations with and without S1, the bar of the ninth stop, newer ones
@query("""WITH fr(f, o) AS (VALUES ('1m', 1), ('5m', 2), ('15m', 3), ('1h', 4), ('4h', 5)),
masks AS (SELECT m, list_filter([CASE WHEN m & 1 = 1 THEN 3 END, CASE WHEN m & 2 = 2 THEN 4 END, CASE WHEN m & 4 = 4 THEN 5 END, CASE WHEN m & 8 = 8 THEN 6 END], lambda x: x IS NOT NULL) AS ks FROM (SELECT unnest(range(1, 16)) AS m)),
sets AS (SELECT array_to_string(list_transform(ks, lambda k: 'S' || k || '_' || f), '+') AS code, o, len(ks) AS n, ks FROM masks, fr),
base AS (SELECT code, row_number() OVER (ORDER BY part, o, n, ks, s1) AS b FROM (SELECT 'S1' AS code, 0 AS part, 0 AS o, 0 AS n, [0] AS ks, 0 AS s1 UNION ALL SELECT code, 1, o, n, ks, 0 FROM sets UNION ALL SELECT 'S1+' || code, 1, o, n, ks, 1 FROM sets UNION ALL SELECT 'OFF', 2, 0, 0, [0], 0)),
frozen AS (SELECT code, 0 AS o, b FROM base UNION ALL SELECT code || '+S9_' || f, o, b FROM base, fr),
neu AS (SELECT code, row_number() OVER (ORDER BY o, kind, x, y) AS e FROM (
  SELECT 'ATR' || CAST(k AS INT) || '_' || f AS code, o, 0 AS kind, k AS x, 0 AS y FROM fr, (SELECT unnest([50, 75, 100, 150, 200, 250, 300]) AS k) UNION ALL SELECT 'MA' || ma || 'C' || n || '_' || f, o, 1, ma, n FROM fr, (SELECT unnest([20, 60, 120]) AS ma), (SELECT unnest([1, 2, 3]) AS n)
  UNION ALL SELECT 'BAD' || n || '_1m', 9, 2, n, 0 FROM (SELECT unnest([5, 10, 15, 30]) AS n))),
atoms AS (SELECT 'S1' AS code, 0 AS a UNION ALL SELECT 'S' || k || '_' || f, o * 10 + k FROM fr, (SELECT unnest([3, 4, 5, 6, 9]) AS k)),
every AS (SELECT code, 0 AS part, o AS x, b AS y FROM frozen UNION ALL SELECT code, 1, e, 0 FROM neu UNION ALL SELECT atoms.code || '+' || neu.code, 2, e, a FROM neu, atoms UNION ALL SELECT p.code || '+' || q.code, 3, p.e, q.e FROM neu p JOIN neu q ON p.e < q.e)
SELECT row_number() OVER (ORDER BY part, x, y) - 1 AS stop_id, code FROM every""")
def stop_dictionary(spark, sf):
    """All 6,666 stop definitions with their frozen numbers."""
    return spark.createDataFrame(list(enumerate(all_stop_codes())), "stop_id long, code string")


@query("""WITH fr(f, o) AS (VALUES ('1m', 1), ('5m', 2), ('15m', 3), ('1h', 4), ('4h', 5)),
masks AS (SELECT m, list_filter([CASE WHEN m & 1 = 1 THEN 1 END, CASE WHEN m & 2 = 2 THEN 2 END, CASE WHEN m & 4 = 4 THEN 3 END, CASE WHEN m & 8 = 8 THEN 4 END, CASE WHEN m & 16 = 16 THEN 5 END], lambda x: x IS NOT NULL) AS os FROM (SELECT unnest(range(1, 32)) AS m)),
sub AS (SELECT array_to_string(list_transform(os, lambda x: ['1m', '5m', '15m', '1h', '4h'][x]), '+') AS frames, row_number() OVER (ORDER BY len(os), os) AS s FROM masks),
n10 AS (SELECT unnest(range(1, 11)) AS k), n20 AS (SELECT unnest(range(1, 21)) AS k), n3 AS (SELECT unnest([1, 2, 3]) AS k), f5 AS (SELECT unnest(range(1, 6)) AS k), macd(ind, w) AS (VALUES ('hist', 1), ('dif', 2)), mas(ind, w) AS (VALUES ('ma20', 1), ('ma120', 2)),
one AS (SELECT row_number() OVER (ORDER BY blk, a, b, c, d) AS id, kind, frames, indicator, p1, p2, 0.0::DOUBLE AS p3 FROM (
  SELECT 1 AS blk, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 'none' AS kind, '' AS frames, '' AS indicator, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2
  UNION ALL SELECT 2, k, 0, 0, 0, 'fixed', '', '', k::DOUBLE / 1000, 0 FROM n10
  UNION ALL SELECT 3, x.k, y.k, 0, 0, 'fixed_by_day', '', '', x.k::DOUBLE / 1000, y.k::DOUBLE / 1000 FROM n10 x, n10 y
  UNION ALL SELECT 4, s, w, k, 0, 'reversal', frames, ind, k, 0 FROM sub, macd, n3
  UNION ALL SELECT 5, s, w, n3.k, f5.k, 'deviation', frames, ind, n3.k, f5.k::DOUBLE * 2 / 1000 FROM sub, mas, n3, f5
  UNION ALL SELECT 6, s, x.w, 0, 0, 'structure', frames, 'pivots', x.r, 0 FROM sub, (VALUES (0.0::DOUBLE, 1), (0.0005::DOUBLE, 2), (0.001::DOUBLE, 3), (0.002::DOUBLE, 4)) x(r, w)
  UNION ALL SELECT 7, CAST(r * 10 AS INT), 0, 0, 0, 'risk', '', 'r', r, 0 FROM (SELECT unnest([0.5::DOUBLE, 1, 1.5, 2, 3, 4]) AS r)
  UNION ALL SELECT 8, a.k, b.k, 0, 0, 'trail', '', 'share', a.k::DOUBLE / 1000, b.k::DOUBLE * 5 / 100 FROM n20 a, n10 b
  UNION ALL SELECT 9, a.k, b.k, 0, 0, 'trail', '', 'price', a.k::DOUBLE / 1000, b.k::DOUBLE * 5 / 10000 FROM n20 a, n10 b
  UNION ALL SELECT 10, a.k, b.w, 0, 0, 'lock', '', 'close', a.k::DOUBLE / 1000, b.r FROM n20 a, (VALUES (0.0::DOUBLE, 1), (0.0005::DOUBLE, 2), (0.001::DOUBLE, 3), (0.0015::DOUBLE, 4), (0.002::DOUBLE, 5)) b(r, w)
  UNION ALL SELECT 11, m, 0, 0, 0, 'time', '', 'minutes', m, 0 FROM (SELECT unnest([15, 30, 60, 120, 240]) AS m)
  UNION ALL SELECT 12, s, w, l, k, 'divergence', frames, ind, l, k FROM sub, macd, (SELECT unnest([5, 10, 20]) AS l), n3)),
parts AS (SELECT 2420 + row_number() OVER (ORDER BY k, CASE one.kind WHEN 'reversal' THEN 0 ELSE 1 END, one.id) AS id, 'parts' AS kind, frames, indicator, k::DOUBLE / 1000 AS p1, 0.5::DOUBLE AS p2, one.id::DOUBLE AS p3 FROM n10, one WHERE one.kind IN ('reversal', 'trail')),
early AS (SELECT 8280 + row_number() OVER (ORDER BY x, y) AS id, 'trail' AS kind, '' AS frames, 'share' AS indicator, x AS p1, y AS p2, 0.0::DOUBLE AS p3 FROM (SELECT unnest([0.0005::DOUBLE, 0.00075, 0.001, 0.00125, 0.0015, 0.00175, 0.002, 0.0025]) AS x), (SELECT unnest([0.01::DOUBLE, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2]) AS y)
  WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.kind = 'trail' AND one.indicator = 'share' AND one.p1 = x AND one.p2 = y)),
had AS (SELECT p1, p2 FROM one WHERE kind = 'trail' AND indicator = 'share' UNION ALL SELECT p1, p2 FROM early),
steps AS (SELECT k::DOUBLE / 10000 AS r, true AS fine FROM (SELECT unnest(range(1, 10)) AS k) UNION ALL SELECT k::DOUBLE / 1000, false FROM n10),
later AS (SELECT 8344 + row_number() OVER (ORDER BY blk, a, b, c, d) AS id, kind, frames, indicator, p1, p2, 0.0::DOUBLE AS p3 FROM (
  SELECT 1 AS blk, o::DOUBLE AS a, 1::DOUBLE AS b, w::DOUBLE AS c, k::DOUBLE AS d, 'ma_cross' AS kind, f AS frames, ind AS indicator, k::DOUBLE AS p1, 0.0::DOUBLE AS p2 FROM fr, mas, n3
  UNION ALL SELECT 1, o, 2, r, k, 'fade', f, 'volume20', r, k FROM fr, (SELECT unnest([0.3::DOUBLE, 0.5, 0.7]) AS r), n3
  UNION ALL SELECT 2, m, 0, 0, 0, 'time', '', 'minutes', m, 0 FROM (SELECT unnest([1, 3, 5, 10, 45, 90]) AS m)
  UNION ALL SELECT 3, x.p1, k, 0, 0, 'trail', '', 'share', x.p1, k::DOUBLE / 200 FROM (SELECT DISTINCT p1 FROM had) x, (SELECT unnest(range(2, 21)) AS k) WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.p1 = x.p1 AND had.p2 = k::DOUBLE / 200)
  UNION ALL SELECT 4, o, r, 0, 0, 'atr', f, 'atr14', r, 0 FROM fr, (SELECT unnest([0.5::DOUBLE, 1, 1.5, 2, 3, 4]) AS r)
  UNION ALL SELECT 5, k, 0, 0, 0, 'fixed', '', '', k::DOUBLE / 10000, 0 FROM (SELECT unnest(range(1, 10)) AS k)
  UNION ALL SELECT 6, x.r, y.r, 0, 0, 'fixed_by_day', '', '', x.r, y.r FROM steps x, steps y WHERE x.fine OR y.fine
  UNION ALL SELECT 7, m, 0, 0, 0, 'time', '', 'minutes', m, 0 FROM (SELECT unnest([2, 20, 180, 360, 480, 720, 1440]) AS m)))
SELECT CAST(id AS INT) AS target_id, kind, frames, indicator, p1, p2, p3 FROM (SELECT * FROM one UNION ALL SELECT * FROM parts UNION ALL SELECT * FROM early UNION ALL SELECT * FROM later)""")
def target_catalogue(spark, sf):
    """All 9,142 take-profit plans with their frozen numbers."""
    rows = [(t.id, t.kind, t.frames, t.indicator, t.p1, t.p2, t.p3) for t in all_targets()]
    return spark.createDataFrame(rows, "target_id int, kind string, frames string, indicator string, p1 double, p2 double, p3 double")


@query("""WITH days AS (SELECT d, CAST(d AS DATE) AS day, year(d) AS y, month(d) * 100 + day(d) AS md FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d)),
x AS (SELECT *, CASE WHEN md < 204 OR md >= 1207 THEN 11 WHEN md < 306 THEN 0 WHEN md < 405 THEN 1 WHEN md < 506 THEN 2 WHEN md < 606 THEN 3 WHEN md < 707 THEN 4 WHEN md < 807 THEN 5 WHEN md < 908 THEN 6 WHEN md < 1008 THEN 7 WHEN md < 1107 THEN 8 ELSE 9 END AS idx FROM days),
k AS (SELECT *, CASE WHEN (2 * ((y - 4) % 5) + 2 + idx) % 10 <= 5 THEN -1 WHEN (2 * ((y - 4) % 5) + 2 + idx) % 10 >= 8 THEN 1 ELSE 0 END AS colour FROM x),
g AS (SELECT *, sum(CASE WHEN colour IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY d) AS band FROM (SELECT *, lag(colour) OVER (ORDER BY d) AS p FROM k)),
b AS (SELECT band, any_value(colour) AS colour, epoch_ms(min(d)) - 28800000 AS begin, count(*) AS n FROM g GROUP BY band),
s AS (SELECT CAST(ceil((begin + n * 43200000) / 7200000.0) AS BIGINT) * 7200000 + 7200000 AS at, colour FROM b WHERE colour <> 0 AND band > 1 AND band < (SELECT max(band) FROM b)),
o AS (SELECT DISTINCT epoch_us(o_orderdate) // 1000 AS at FROM orders)
SELECT o.at, s.colour AS direction FROM o ASOF LEFT JOIN s ON o.at >= s.at""")
def calendar_direction(spark, sf):
    """The direction that the calendar allows on each day of an order."""
    o = table(spark, sf, "orders").select(F.expr(MS.format("o_orderdate")).alias("at")).distinct()
    return o.select("at", allowed_direction(F.col("at"), 1992, 1999).alias("direction"))


@query("""SELECT id AS config_id, CAST(id // 180 % 4 AS INT) AS field, CAST(id // 36 % 5 AS INT) AS session, CAST(id // 6 % 6 AS INT) AS stop, CAST(id % 6 AS INT) AS target FROM (SELECT unnest(range(0, 720)) AS id)""")
def lazy_configurations(spark, sf):
    return lazy_grid(spark, field=4, session=5, stop=6, target=6)


# ---- limits, coverage, restoring


@query("WITH " + ACCOUNTS + """ SELECT config_id, category, rank FROM (SELECT config_id, category, row_number() OVER (PARTITION BY category ORDER BY profit_factor DESC, max_drawdown, config_id) AS rank FROM metrics
WHERE isfinite(std_ret) AND std_ret <= 0.04 AND isfinite(max_drawdown) AND max_drawdown <= 0.36 AND trades >= 20 AND win_rate BETWEEN 0.3 AND 0.8) WHERE rank <= 25""")
def ranking_limits(spark, sf):
    """The first of each category among rows within the limits; a missing or non-finite metric fails its limit."""
    m = metrics(spark, sf).where(S.within_limits(std_ret=(None, 0.04), max_drawdown=(None, 0.36), trades=(20, None), win_rate=(0.3, 0.8)))
    return S.top_k(m, 25, S.ranking_order("profit_factor", "config_id"), "category").select("config_id", "category", "rank")


@query("""WITH o AS (SELECT 'nation' AS key, n_name AS opt, o_orderstatus = 'F' AS done FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'segment', c_mktsegment, o_orderstatus = 'F' FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'part', p_name, o_orderstatus = 'F' FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
u AS (SELECT 'nation' AS key, n_name AS opt FROM nation UNION SELECT 'segment', c_mktsegment FROM customer UNION SELECT 'part', p_name FROM part),
h AS (SELECT key, opt, bool_or(done) AS finished FROM o GROUP BY ALL),
m AS (SELECT coalesce(u.key, h.key) AS key, coalesce(u.opt, h.opt) AS opt, u.opt IS NOT NULL AS defined, finished FROM u FULL JOIN h ON h.key = u.key AND h.opt = u.opt)
SELECT key, count_if(defined) AS defined, count_if(coalesce(finished, false)) AS completed, array_to_string(list_sort(coalesce(list(opt) FILTER (WHERE NOT finished), [])), ',') AS assigned_not_completed, array_to_string(list_sort(coalesce(list(opt) FILTER (WHERE defined AND finished IS NULL), [])), ',') AS not_assigned FROM m GROUP BY key""")
def campaign_coverage(spark, sf):
    """Orders as jobs, done when their status is F; the options are nations, segments and parts."""
    t = lambda name: table(spark, sf, name)
    jobs = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    of = jobs.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = t("lineitem").select("l_orderkey", "l_partkey").join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    option = lambda df, key, c: df.select(F.lit(key).alias("key"), F.col(c).alias("option"), "o_orderstatus")
    options = option(of, "nation", "n_name").unionByName(option(of, "segment", "c_mktsegment")).unionByName(option(parts, "part", "p_name"))
    defined = lambda name, key, c: t(name).select(F.lit(key).alias("key"), F.col(c).alias("option"))
    universe = defined("nation", "nation", "n_name").unionByName(defined("customer", "segment", "c_mktsegment")).unionByName(defined("part", "part", "p_name"))
    got = S.coverage(options, universe, F.col("o_orderstatus") == "F")
    return got.withColumns({c: F.array_join(c, ",") for c in ("assigned_not_completed", "not_assigned")})


@query("""WITH r AS (SELECT 'sold' AS src, l_orderkey * 10 + l_linenumber AS id, CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag AS f, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT 'open', l_orderkey * 10 + l_linenumber, CAST(round(l_discount * 100) AS BIGINT), l_returnflag, CAST(round(l_tax * 100) AS BIGINT) FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT *, substr(sha256('l_discount=' || d || '|l_returnflag=' || f || '|l_tax=' || t), 1, 16) AS fp FROM r),
w AS (SELECT DISTINCT substr(sha256('l_discount=' || p_size % 14 || '|l_returnflag=' || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END || '|l_tax=' || p_partkey % 11), 1, 16) AS fp FROM part),
g AS (SELECT fp, min(id) AS id, any_value(d) AS d, any_value(f) AS f, any_value(t) AS t, count(*) AS n, string_agg(DISTINCT src, ',' ORDER BY src) AS rankings FROM p GROUP BY fp)
SELECT w.fp AS fingerprint, id, d AS l_discount, f AS l_returnflag, t AS l_tax, coalesce(n, 0) AS rows, coalesce(rankings, '') AS rankings, false AS ambiguous FROM w LEFT JOIN g USING (fp)""")
def restored_configurations(spark, sf):
    """Fingerprints named in texts (one for each part, some of configurations that never were) looked up in two rankings."""
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"), "l_returnflag", F.round(F.col("l_tax") * 100).cast("long").alias("l_tax"))
    part = table(spark, sf, "part").select((F.col("p_size") % 14).alias("l_discount"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("l_returnflag"), (F.col("p_partkey") % 11).alias("l_tax"))
    named = part.select(F.concat(F.lit("see #"), F.upper(S.fingerprint("l_discount", "l_returnflag", "l_tax")), F.lit(", not 0123456789abcdef0")).alias("text"))
    rankings = {"sold": li.where("l_linestatus = 'F'"), "open": li.where("l_linestatus = 'O'")}
    got = S.restored(S.wanted_fingerprints(named, "text"), rankings, ["l_discount", "l_returnflag", "l_tax"], "id")
    return got.withColumn("rankings", F.array_join("rankings", ","))


# ---- exits on structures and sequences

_STRUCTURED = [Plan(1, "sequence"), Plan(2, "pivot", 0.01), Plan(3, "structure", 0.01), Plan(4, "deviation", 10, 0.1, c=1), Plan(5, "deviation", 20, 0.2, c=2)]


def _next(mask: str) -> str:
    return f"min(CASE WHEN {mask} THEN i END) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _away_sql(n: int, least: float, bars: int) -> str:
    """Marks of a deviation from the average of n closes, for both sides."""
    near = lambda s: " AND ".join(f"lag(a{s}, {k}) OVER w < lag(a{s}, {k + 1}) OVER w" if k else f"a{s} < lag(a{s}) OVER w" for k in range(bars))
    rolled = f"CASE WHEN i >= {n - 1} THEN avg(c) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    return f"""v{n}a AS (SELECT series_id, i, c / ({rolled}) - 1 AS ap, -(c / ({rolled}) - 1) AS am FROM bb),
v{n}b AS (SELECT *, sum(CASE WHEN coalesce(ap > 0, false) THEN 0 ELSE 1 END) OVER w AS gp, sum(CASE WHEN coalesce(am > 0, false) THEN 0 ELSE 1 END) OVER w AS gm, coalesce({near('p')}, false) AS np, coalesce({near('m')}, false) AS nm FROM v{n}a WINDOW w AS (PARTITION BY series_id ORDER BY i)),
v{n} AS (SELECT series_id, i, coalesce(ap > 0, false) AND np AND max(ap) OVER (PARTITION BY series_id, gp ORDER BY i) >= {least} AS up, coalesce(am > 0, false) AND nm AND max(am) OVER (PARTITION BY series_id, gm ORDER BY i) >= {least} AS dn FROM v{n}b)"""


_EXITS_MORE = RULE_BARS + f""", bb AS (SELECT series_id, CAST(i AS BIGINT) AS i, o, h, l, c, dir, dif - dea AS gap, abs(hist) < abs(lag(hist) OVER w) AS shrinks, lag(dir) OVER w AS pdir, lag(l) OVER w AS pl, lag(h) OVER w AS ph FROM rb WINDOW w AS (PARTITION BY series_id ORDER BY i)),
pv AS (SELECT *, last_value(CASE WHEN dir <> pdir AND pdir = -1 THEN pl END IGNORE NULLS) OVER w AS trough, last_value(CASE WHEN dir <> pdir AND pdir = 1 THEN ph END IGNORE NULLS) OVER w AS peak FROM bb WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nx AS (SELECT series_id, i, {_next('dir = -1')} AS f1, {_next('dir = 1')} AS f_1, {_next('gap < 0')} AS lo, {_next('gap > 0')} AS hi, {_next('shrinks')} AS sh FROM bb),
{_away_sql(10, 0.1, 1)}, {_away_sql(20, 0.2, 2)},
e AS (SELECT *, CASE WHEN c > o THEN 1 ELSE -1 END AS side, c AS px FROM pv WHERE c <> o),
lv AS (SELECT *, CASE side WHEN 1 THEN trough * (1 - 0.01::DOUBLE) ELSE peak * (1 + 0.01::DOUBLE) END AS stop, CASE side WHEN 1 THEN peak * (1 - 0.01::DOUBLE) ELSE trough * (1 + 0.01::DOUBLE) END AS goal FROM e),
sq AS (SELECT e.series_id, e.i, CASE WHEN n3.sh IS NOT NULL THEN n3.sh END AS x1 FROM e JOIN nx n0 ON n0.series_id = e.series_id AND n0.i = e.i + 1
  JOIN nx n1 ON n1.series_id = e.series_id AND n1.i = CASE side WHEN 1 THEN n0.f1 ELSE n0.f_1 END
  JOIN nx n2 ON n2.series_id = e.series_id AND n2.i = CASE side WHEN 1 THEN n1.lo ELSE n1.hi END
  JOIN nx n3 ON n3.series_id = e.series_id AND n3.i = CASE side WHEN 1 THEN n2.hi ELSE n2.lo END),
x AS (SELECT e.series_id, e.i,
    min(CASE WHEN (px - stop) * side > 0 AND CASE side WHEN 1 THEN b.l <= stop ELSE b.h >= stop END THEN b.i END) AS x2,
    min(CASE WHEN (goal - px) * side > 0 AND CASE side WHEN 1 THEN b.h >= goal ELSE b.l <= goal END THEN b.i END) AS x3,
    min(CASE WHEN (b.c - px) * side > 0 AND CASE side WHEN 1 THEN v10.up ELSE v10.dn END THEN b.i END) AS x4,
    min(CASE WHEN (b.c - px) * side > 0 AND CASE side WHEN 1 THEN v20.up ELSE v20.dn END THEN b.i END) AS x5
  FROM lv e JOIN bb b ON b.series_id = e.series_id AND b.i > e.i JOIN v10 ON v10.series_id = b.series_id AND v10.i = b.i JOIN v20 ON v20.series_id = b.series_id AND v20.i = b.i GROUP BY ALL),
y AS (SELECT e.series_id, e.i, e.side, p.plan_id, CASE p.plan_id WHEN 1 THEN x1 WHEN 2 THEN x2 WHEN 3 THEN x3 WHEN 4 THEN x4 ELSE x5 END AS exit_i, stop, goal
  FROM lv e LEFT JOIN x USING (series_id, i) LEFT JOIN sq USING (series_id, i), (SELECT unnest(range(1, 6)) AS plan_id) p)
SELECT y.series_id, y.i, y.side, CAST(plan_id AS INT) AS plan_id, exit_i, round(CASE WHEN exit_i IS NULL THEN NULL WHEN plan_id = 2 THEN stop WHEN plan_id = 3 THEN goal ELSE b.c END, 6) AS exit_px FROM y LEFT JOIN bb b ON b.series_id = y.series_id AND b.i = y.exit_i"""


@query(_EXITS_MORE)
def exit_structures(spark, sf):
    """Stops on pivots and on the sequence of turns, targets on structures and deviations, for every entry of every series."""
    from ..operators import state

    b = rule_bars(spark, sf).withColumns({"low": F.col("l"), "high": F.col("h")})
    b = state.pivots(b, ["series_id"]).select("series_id", "i", "ct", "o", "h", "l", "c", "v", "atr14", "dir", "dif", "dea", "hist", "trough", "peak")
    e = b.where("c <> o").select("series_id", "i", F.when(F.col("c") > F.col("o"), 1).otherwise(-1).alias("side"))
    return exit_table(e, b, _STRUCTURED).select("series_id", "i", "side", "plan_id", "exit_i", F.round("exit_px", 6).alias("exit_px"))
