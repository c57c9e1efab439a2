"""Bars, prints and feeds made from the star-schema tables, in Spark and in the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.asof import asof
from ..operators.signals import day_levels
from ..operators.state import with_direction
from ..sources.bars import derived_flow, trade_bars

HOUR = 3_600_000
MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str, everything: bool = True) -> DataFrame:
    """Events as trade prints: one series for each event type and, with `everything`, one of all."""
    e = table(spark, sf_dir, "events")
    series = F.explode(F.array(F.col("event_type"), F.lit("all"))) if everything else F.col("event_type")
    return e.select(
        series.alias("series_id"), F.col("event_id").alias("trade_id"), F.expr(MS.format("ts")).alias("ts_ms"), F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"), (F.pmod("user_id", F.lit(2)) == 1).alias("is_buyer_maker"),
    )


PRINTS = """
prints0 AS (
  SELECT event_type, event_id AS trade_id, epoch_us(ts) // 1000 AS ts_ms, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity, user_id % 2 = 1 AS is_buyer_maker FROM events
), prints AS (
  SELECT event_type AS series_id, * EXCLUDE (event_type) FROM prints0 UNION ALL SELECT 'all', * EXCLUDE (event_type) FROM prints0
)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_bars(prints(spark, sf_dir), HOUR)


HOURLY = PRINTS + """, hourly AS (
  SELECT series_id, ts_ms // 3600000 * 3600000 AS open_ms, arg_min(price, ts_ms * 1000000 + trade_id) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ts_ms * 1000000 + trade_id) AS close, sum(quantity) AS volume, sum(price * quantity) AS quote_volume, count(*) AS agg_trades, count(*) AS trades,
         sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END) AS taker_buy_base, sum(CASE WHEN NOT is_buyer_maker THEN price * quantity ELSE 0 END) AS taker_buy_quote
  FROM prints GROUP BY ALL
)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse state feed: every fifth kind of print, as open interest and funding."""
    p = prints(spark, sf_dir).where("quantity % 5 = 0")
    return p.select("series_id", "ts_ms", "trade_id", ((F.col("quantity") - 50) / 100000).alias("funding"), (1000 + F.col("price")).alias("oi"), (F.col("price") * (1000 + F.col("price"))).alias("oiv"))


FEED = """, feed AS (
  SELECT series_id, ts_ms, trade_id, (quantity - 50) / 100000 AS funding, 1000 + price AS oi, price * (1000 + price) AS oiv FROM prints WHERE quantity % 5 = 0
)"""


def rule_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in the columns that rules want, with the feed as of each close and day levels; rows follow each other as they come."""
    from ..functions.folds import with_folds

    b = derived_flow(hourly(spark, sf_dir)).select(
        "series_id", "open_ms", (F.col("open_ms") + HOUR).alias("ct"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"),
        F.col("quote_volume").alias("qv"), F.col("trades").cast("double").alias("trades"), F.col("taker_buy_ratio").alias("ratio"), F.col("delta_base").alias("delta"),
        F.col("avg_trade_size").alias("avg_size"), F.col("taker_buy_quote_ratio").alias("tq_ratio"), "delta_quote",
    )
    f = feed(spark, sf_dir)
    b = asof(b, f, ["oi", "oiv"], tolerance_ms=HOUR, order=["trade_id"]).drop("age_minutes")
    b = asof(b, f, ["funding"], tolerance_ms=24 * HOUR, order=["trade_id"]).drop("age_minutes")
    b = b.withColumn("segment", F.lit(0)).withColumn("i", F.row_number().over(W.partitionBy("series_id").orderBy("ct")) - 1)
    b = with_direction(with_folds(b), "x", ["series_id"])
    return day_levels(b, 60)


def _fold_sql() -> str:
    """Recurrences row by row, as a recursive query."""
    from ..functions.folds import CHAIKINS, DMIS, EMAS, HAS, KAMAS

    cols: dict[str, str] = {}

    def run(name: str, x: str, start: int, alpha: float) -> str:
        cols[name] = f"CASE WHEN {{i}} < {start} THEN NULL WHEN {{i}} = {start} THEN {x} ELSE p.{name} + {alpha!r} * ({x} - p.{name}) END"
        return name

    run("e12", "b.c", 0, 2 / 13), run("e26", "b.c", 0, 2 / 27)
    cols["atr14"] = "CASE WHEN {i} < 13 THEN NULL WHEN {i} = 13 THEN b.tr14 ELSE (p.atr14 * 13 + b.tr) / 14 END"
    run("gain", "greatest(b.step, 0)", 1, 1 / 14), run("loss", "greatest(-b.step, 0)", 1, 1 / 14)
    for n in KAMAS:
        cols[f"kama{n}"] = f"CASE WHEN {{i}} < {n - 1} THEN NULL WHEN {{i}} = {n - 1} THEN b.mean{n} ELSE p.kama{n} + b.speed{n} * (b.c - p.kama{n}) END"
    for n in EMAS:
        run(f"q{n}_1", "b.c", 0, 2 / (n + 1))
    for n in DMIS:
        run(f"wtr{n}", "b.tr", 1, 1 / n), run(f"wp{n}", "b.plus", 0, 1 / n), run(f"wm{n}", "b.minus", 0, 1 / n)
    for n in HAS:
        run(f"eo{n}", "b.o", 0, 2 / (n + 1)), run(f"ec{n}", "(b.o + b.h + b.l + b.c) / 4", 0, 2 / (n + 1))
    for n in sorted({x for p in CHAIKINS for x in p}):
        run(f"adl{n}", "b.adl", 0, 2 / (n + 1))
    seed = ", ".join(f"{sql.format(i='0').replace('p.' + name, 'NULL')} AS {name}" for name, sql in cols.items())
    seed = seed.replace("p.", "b.")
    step = ", ".join(f"{sql.format(i='b.i')} AS {name}" for name, sql in cols.items())
    # values that need this row's first layer go one layer on
    layers = []
    second: dict[str, tuple[str, int, float]] = {"dea": ("e12 - e26", 0, 2 / 10)}
    for n in EMAS:
        second[f"q{n}_2"] = (f"q{n}_1", n - 1, 2 / (n + 1))
    for n in DMIS:
        p, m = f"100 * wp{n} / nullif(wtr{n}, 0)", f"100 * wm{n} / nullif(wtr{n}, 0)"
        second[f"qx{n}"] = (f"100 * abs({p} - {m}) / nullif({p} + {m}, 0)", n, 1 / n)
    third = {f"q{n}_3": (f"q{n}_2", 2 * n - 2, 2 / (n + 1)) for n in EMAS}
    at = "fold1"
    for k, layer in enumerate((second, third)):
        s0 = ", ".join(f"CASE WHEN {st} = 0 THEN {x} END AS {n}" for n, (x, st, _) in layer.items())
        s1 = ", ".join(f"CASE WHEN b.i < {st} THEN NULL WHEN b.i = {st} THEN b.in_{n} ELSE p.{n} + {al!r} * (b.in_{n} - p.{n}) END AS {n}" for n, (x, st, al) in layer.items())
        ins = ", ".join(f"{x} AS in_{n}" for n, (x, _, _) in layer.items())
        layers.append(f", lay{k} AS (SELECT *, {ins} FROM {at}), rec{k} AS (SELECT series_id, i, {s0} FROM lay{k} WHERE i = 0 UNION ALL SELECT b.series_id, b.i, {s1} FROM rec{k} p JOIN lay{k} b ON b.series_id = p.series_id AND b.i = p.i + 1), out{k} AS (SELECT l.*, {', '.join('r.' + n for n in layer)} FROM lay{k} l JOIN rec{k} r USING (series_id, i))")
        at = f"out{k}"
    ha0 = ", ".join(f"NULL::DOUBLE AS ho{n}" if n > 1 else "" for n in HAS)
    ha1 = ", ".join(f"CASE WHEN b.i < {n - 1} THEN NULL WHEN b.i = {n - 1} THEN (b.eo{n} + b.ec{n}) / 2 ELSE (p.ho{n} + a.ec{n}) / 2 END AS ho{n}" for n in HAS)
    layers.append(f", recha AS (SELECT series_id, i, {ha0} FROM {at} WHERE i = 0 UNION ALL SELECT b.series_id, b.i, {ha1} FROM recha p JOIN {at} b ON b.series_id = p.series_id AND b.i = p.i + 1 JOIN {at} a ON a.series_id = p.series_id AND a.i = p.i)")
    out = ["e12 - e26 AS dif", "dea", "2 * (e12 - e26 - dea) AS hist", "2 * (e12 - e26 - dea) AS x", "atr14", "CASE WHEN i >= 14 AND loss <> 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi14", *(f"kama{n}" for n in KAMAS)]
    out += [f"CASE WHEN i >= {k * (n - 1)} THEN q{n}_{k} END AS ema{n}_{k}" for n in EMAS for k in (1, 2, 3)]
    for n in DMIS:
        out += [f"CASE WHEN i >= {n} THEN 100 * wp{n} / nullif(wtr{n}, 0) END AS pdi{n}", f"CASE WHEN i >= {n} THEN 100 * wm{n} / nullif(wtr{n}, 0) END AS mdi{n}", f"CASE WHEN i >= {2 * n - 1} THEN qx{n} END AS adx{n}"]
    out += [f"CASE WHEN i >= {n - 1} THEN ec{n} - ho{n} END AS ha{n}" for n in HAS]
    out += [f"CASE WHEN i >= {b - 1} THEN adl{a} - adl{b} END AS chaikin{a}_{b}" for a, b in CHAIKINS]
    w = "OVER (PARTITION BY series_id ORDER BY ct"
    speed = ", ".join(f"power(coalesce(abs(c - lag(c, {n}) {w})) / nullif(sum(abs(step)) {w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0), 0) * (CAST(2 AS DOUBLE) / 3 - CAST(2 AS DOUBLE) / 31) + CAST(2 AS DOUBLE) / 31, 2) AS speed{n}, avg(c) {w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS mean{n}" for n in KAMAS)
    return f""", fin0 AS (
  SELECT *, CASE WHEN i = 0 THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr, c - pc AS step,
         CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0.0 END AS plus, CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0.0 END AS minus,
         sum(CASE WHEN h > l THEN (2 * c - h - l) / (h - l) * v ELSE 0.0 END) {w}) AS adl
  FROM (SELECT *, lag(c) {w}) AS pc, lag(h) {w}) AS ph, lag(l) {w}) AS pl FROM rb0)
), fin AS (SELECT *, avg(tr) {w} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS tr14, {speed} FROM fin0
), rec AS (
  SELECT b.series_id, b.i, {seed} FROM fin b WHERE b.i = 0
  UNION ALL SELECT b.series_id, b.i, {step} FROM rec p JOIN fin b ON b.series_id = p.series_id AND b.i = p.i + 1
), fold1 AS (SELECT f.*, r.* EXCLUDE (series_id, i) FROM fin f JOIN rec r USING (series_id, i)){''.join(layers)}
, folded AS (SELECT series_id, open_ms, ct, o, h, l, c, v, qv, trades, ratio, delta, avg_size, tq_ratio, delta_quote, oi, oiv, funding, 0 AS segment, i, {', '.join(out)} FROM {at} JOIN recha USING (series_id, i))
, rb AS (
  SELECT d.*, g.or_hi60, g.or_lo60, NULL::DOUBLE AS or_hi15, NULL::DOUBLE AS or_lo15, y.pivot_ FROM (
    SELECT *, CAST(coalesce(last_value(nullif(sgn, 0) IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INT) AS dir FROM (SELECT *, sign(x - lag(x) {w})) AS sgn FROM folded)) d
  LEFT JOIN day1 g ON g.series_id = d.series_id AND g.day = d.open_ms // 86400000
  LEFT JOIN day1 y ON y.series_id = d.series_id AND y.day + 1 = d.open_ms // 86400000
)"""


RB0 = """, rb0 AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ct) - 1 AS i FROM (
    SELECT b.*, CASE WHEN b.ct - f.ts_ms <= 3600000 THEN f.oi END AS oi, CASE WHEN b.ct - f.ts_ms <= 3600000 THEN f.oiv END AS oiv, CASE WHEN b.ct - f.ts_ms <= 86400000 THEN f.funding END AS funding
    FROM (SELECT series_id, open_ms, open_ms + 3600000 AS ct, open AS o, high AS h, low AS l, close AS c, volume AS v, quote_volume AS qv, CAST(trades AS DOUBLE) AS trades, taker_buy_base / nullif(volume, 0) AS ratio,
                 2 * taker_buy_base - volume AS delta, volume / nullif(trades, 0) AS avg_size, taker_buy_quote / nullif(quote_volume, 0) AS tq_ratio, 2 * taker_buy_quote - quote_volume AS delta_quote FROM hourly) b
    ASOF LEFT JOIN (SELECT series_id, ts_ms, arg_max(oi, trade_id) AS oi, arg_max(oiv, trade_id) AS oiv, arg_max(funding, trade_id) AS funding FROM feed GROUP BY ALL) f ON f.series_id = b.series_id AND b.ct >= f.ts_ms)
), day1 AS (
  SELECT series_id, open_ms // 86400000 AS day, CASE WHEN count(*) = 24 THEN (max(h) + min(l) + arg_max(c, ct)) / 3 END AS pivot_,
         max(CASE WHEN open_ms % 86400000 < 3600000 THEN h END) AS or_hi60, min(CASE WHEN open_ms % 86400000 < 3600000 THEN l END) AS or_lo60 FROM rb0 GROUP BY ALL
)"""

#: Everything up to the bars that rules look at.
RULE_BARS = "WITH RECURSIVE " + HOURLY.strip() + FEED + RB0 + _fold_sql()
