"""Rules applied to bars: sparse signals (series_id, ct, rule_id, side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Features, predicate
from ..plans.rules import Rule

# what placebo rules look at
LABELS = {
    "epoch_minute_": "cast(floor(open_ms / 60000) as bigint)", "minute_": "cast(floor(open_ms / 60000) as bigint) % 60", "hour_": "cast(floor(open_ms / 3600000) as bigint) % 24",
    "day_": "cast(floor(open_ms / 86400000) as bigint)", "day_minute_": "cast(floor(open_ms / 60000) as bigint) % 1440", "cents_": "cast(floor(abs(c) * 100 + 1e-9) as bigint) % 100",
}


def signal_sql(rules: list[Rule], minutes: int, source: str, spark: bool = True) -> str:
    """One query for all rules: layers of window features, then the rules that fire on each bar, exploded.

    A rule also needs the direction of the selected MACD field and a valid bar. With `spark` false, the same in plain ANSI spelling."""
    f = Features()
    valid = "v >= 0 and c > 0 and h >= l and x is not null"
    fired = []
    for r in rules:
        long, short = predicate(f, r.algorithm, r.params, minutes)
        if r.batch == "third":  # these have a direction of their own; bars on which both sides fire are left out
            long, short = f"coalesce({long}, false)", f"coalesce({short}, false)"
            fired.append(f"case when {long} and not {short} then {r.id} when {short} and not {long} then {-r.id} end")
            continue
        # a side is +1 or -1; both at once cannot be, as the direction is one
        fired.append(f"case when dir = 1 and ({long}) then {r.id} when dir = -1 and ({short}) then {-r.id} end")
    lines, at = [f"with l_ as (select *, {', '.join(f'{v} as {k}' for k, v in LABELS.items())} from {source} where {valid})"], "l_"
    for n, layer in enumerate(f.layers):
        lines.append(f"f_{n} as (select *, {', '.join(f'{sql} as {name}' for name, sql in layer.items())} from {at})")
        at = f"f_{n}"
    if spark:
        tail = f"select series_id, ct, explode(array_compact(array({', '.join(fired)}))) as hit from {at}"
    else:
        tail = f"select series_id, ct, unnest(list_filter([{', '.join(fired)}], lambda e: e is not null)) as hit from {at}"
    return ",\n".join(lines) + f"\nselect series_id, ct, cast(abs(hit) as int) as rule_id, cast(sign(hit) as int) as side from ({tail}) t_"


def signals(bars: DataFrame, rules: list[Rule], minutes: int) -> DataFrame:
    """bars: as predicates.py wants them, with folds and day columns."""
    return bars.sparkSession.sql(signal_sql(rules, minutes, "{bars}"), bars=bars)


def day_levels(bars: DataFrame, minutes: int, openings: tuple[int, ...] = (15, 60)) -> DataFrame:
    """pivot_: mean of high, low and close of the complete UTC day before; or_hi{n}, or_lo{n}: the complete opening range of the day."""
    day = F.floor(F.col("open_ms") / 86_400_000)
    minute = F.floor(F.col("open_ms") / 60_000) % 1440
    rows = bars.select("series_id", day.alias("_day"), minute.alias("_minute"), "h", "l", "c", "ct")
    first = lambda n, agg, x: F.when(F.count(F.when(F.col("_minute") < n, 1)) == n // minutes, agg(F.when(F.col("_minute") < n, F.col(x)))) if n % minutes == 0 and minutes <= n else F.lit(None).cast("double")
    days = rows.groupBy("series_id", "_day").agg(
        F.when(F.count("*") == 1440 // minutes, (F.max("h") + F.min("l") + F.max_by("c", "ct")) / 3).alias("pivot_"),
        *(first(n, F.max, "h").alias(f"or_hi{n}") for n in openings), *(first(n, F.min, "l").alias(f"or_lo{n}") for n in openings),
    )
    out = bars.withColumn("_day", day)
    out = out.join(days.drop("pivot_"), ["series_id", "_day"], "left")
    return out.join(days.select("series_id", (F.col("_day") + 1).alias("_day"), "pivot_"), ["series_id", "_day"], "left").drop("_day")


def compound(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Signals of compound rules (group_id, logic 'and' or 'or', members): rows where all, or any, of the members fire for one side."""
    member = groups.select("group_id", "logic", F.explode("members").alias("rule_id"), F.size("members").alias("n"))
    hits = signals.join(F.broadcast(member), "rule_id").groupBy("series_id", "ct", "side", "group_id").agg(F.countDistinct("rule_id").alias("k"), F.first("n").alias("n"), F.first("logic").alias("logic"))
    return hits.where((F.col("logic") == "or") | (F.col("k") == F.col("n"))).select("series_id", "ct", F.col("group_id").alias("rule_id"), "side")


def unambiguous(signals: DataFrame) -> DataFrame:
    """Without bars on which a rule fires for both sides."""
    one = signals.groupBy("series_id", "ct", "rule_id").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return one.where("lo = hi").select("series_id", "ct", "rule_id", F.col("lo").alias("side"))
