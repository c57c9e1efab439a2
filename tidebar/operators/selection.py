"""From result rows to candidates: gates, scores, rankings, fingerprints, clusters, campaigns. All relational."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import store


def account_rows(results: DataFrame, packed: str = "accounts") -> DataFrame:
    """One row per account from results with an array of per-leverage structs."""
    return results.select(*[c for c in results.columns if c != packed], F.explode(packed).alias("_a")).select(*[c for c in results.columns if c != packed], "_a.*")


def finalised(rows: DataFrame, days: Column) -> DataFrame:
    """Metrics of sums: mean, sample deviation, t, profit factor (0 where nothing was lost), win rate, per-day rates, used capacity."""
    n = F.col("trades")
    mean = F.col("sum_ret") / F.nullif(n, F.lit(0))
    var = F.when(n > 1, F.greatest((F.col("sum_sq") - n * mean * mean) / (n - 1), F.lit(0.0)))
    return rows.withColumns(
        {
            "mean_ret": mean, "std_ret": F.sqrt(var), "t_stat": F.when(var > 0, mean / F.sqrt(var / n)),
            "profit_factor": F.when(F.col("loss") > 0, F.col("profit") / F.col("loss")).otherwise(0.0),
            "win_rate": F.col("wins") / F.nullif(n, F.lit(0)), "trades_per_day": n / days,
            "capacity": (F.col("hold_minutes") + (F.col("wait_minutes") if "wait_minutes" in rows.columns else F.lit(0))) / (days * 1440),
        }
    )


def gate_reasons(**gates: Column) -> Column:
    """All gates that a row fails, by name; missing values fail."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items())))


def return_gates() -> dict[str, Column]:
    """Hard gates of the default scheme."""
    return {
        "few_trades": F.col("trades") >= 20, "no_profit": F.col("final_equity") > F.col("initial"), "drawdown": F.col("max_drawdown") <= 0.5,
        "profit_factor": (F.col("profit_factor") >= 1.05) | ((F.col("profit_factor") == 0) & (F.col("win_rate") == 1)),
        "protected": F.col("protections") == 0, "stopped": ~F.col("stopped"),
    }


def reason_counts(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def fingerprint(*fields: str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the fields in the order of their names."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(fields))), 256), 1, 16)


def first_of_each(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """The row with the smallest id of each key: partial minima before the shuffle, not a window."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), id_col).alias("_r")).select("_r.*")


def stress_gates(most_protections: Column | int = 0, most_drawdown: float = 0.5, least_factor: float = 1.05, most_capacity: float = 1.0, longs: tuple[float, float] = (0.0, 1.0), least_trades: int = 20, years: Sequence[str] = ()) -> dict[str, Column]:
    """Hard gates of the stress scheme, thirteen with the two years that must have earned; a ratio without a cost is not asked."""
    c = F.col
    return {
        "protected": c("protections") <= most_protections, "liquidated": c("forced") == 0, "out_of_capital": ~c("stopped").cast("boolean"), "drawdown": c("max_drawdown") <= most_drawdown,
        **{f"{y}_lost": c(y) > 0 for y in years},
        "profit_factor": c("profit_factor") >= least_factor, "p95_net": c("p95_net") > 0, "cost_ratio": c("cost_ratio").isNull() | (c("cost_ratio") >= 2), "gross": c("gross_before_cost") > 0,
        "capacity": c("capacity") <= most_capacity, "long_share": (c("long_share") >= longs[0]) & (c("long_share") <= longs[1]), "few_trades": c("trades") >= least_trades,
    }


def cost_metrics(rows: DataFrame, applied: float, p95: float, extreme: float) -> DataFrame:
    """What a trade earned before slippage, and after the slippage of a bad and of an extreme day; the ratio is null without a cost."""
    gross = F.col("mean_ret") + applied
    return rows.withColumns({"gross_before_cost": gross, "p95_net": gross - p95, "extreme_net": gross - extreme, "cost_ratio": gross / applied if applied > 0 else F.lit(None).cast("double")})


# fixed values: metrics of the percentile score, whether larger is better, and their weights
SCORED = (("max_drawdown", False, 0.35), ("p95_net", True, 0.25), ("worst_year", True, 0.20), ("capacity", False, 0.10), ("profit_factor", True, 0.10))


def counted_ranks(rows: DataFrame, category: str, orders: Sequence[tuple[str, bool]], parts: int = 64) -> DataFrame:
    """rows with r_<metric>: the share of its category's other rows that come before a row, in order of each metric (larger: ascending,
    missing values first; else descending, missing ones last), as percent_rank has it; 0.5 for a row that is alone.

    Values are counted first. Counts are summed in ranges of values, the same for all categories, so a category of any size is dealt
    over `parts` tasks, and equal values are one row. All shuffles are of counts but for the joins back, whose keys may be split."""
    rows = base = store(rows)  # read once more for each metric
    edges = rows.approxQuantile([m for m, _ in orders], [k / parts for k in range(1, parts)], 1 / (2 * parts)) if parts > 1 else [[]] * len(orders)
    keep = rows.columns
    for (m, larger), cuts in zip(orders, edges):
        cuts = sorted(set(cuts))
        part = F.coalesce(sum(((F.col("_v") > e).cast("int") for e in cuts), F.lit(0)), F.lit(-1))
        counts = base.groupBy(F.col(category).alias("_c"), F.col(m).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", part if larger else -part)
        sums = counts.groupBy("_c", "_b").agg(F.sum("_n").alias("_s"))
        w = W.partitionBy("_c").orderBy("_b")  # at most parts + 1 rows a category
        sums = sums.select("_c", "_b", (F.sum("_s").over(w) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy("_c")).alias("_all"))
        inside = W.partitionBy("_c", "_b").orderBy(F.asc("_v") if larger else F.desc("_v"))
        met = counts.join(sums.select(F.col("_c").alias("_d"), F.col("_b").alias("_e"), "_before", "_all"), F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_b") == F.col("_e")))
        rank = (F.col("_before") + F.sum("_n").over(inside) - F.col("_n")) / (F.col("_all") - 1)
        met = met.select("_c", "_v", F.when(F.col("_all") == 1, 0.5).otherwise(rank).alias(f"r_{m}"))
        rows = rows.join(met, F.col(category).eqNullSafe(F.col("_c")) & F.col(m).eqNullSafe(F.col("_v")))
        keep = [*keep, f"r_{m}"]
        rows = rows.select(*keep)
    return rows


def percentile_score(rows: DataFrame, category: str, metrics: Sequence[tuple[str, bool, float]] = SCORED, clip: float = 0.025, parts: int = 64) -> DataFrame:
    """score, 0 to 100: weighted percentile ranks within the category, clipped and stretched again; a category of one row ranks 0.5."""
    ranked = counted_ranks(rows, category, [(m, larger) for m, larger, _ in metrics], parts)
    each = [F.lit(w) * ((F.least(F.greatest(F.col(f"r_{m}"), F.lit(clip)), F.lit(1 - clip)) - clip) / (1 - 2 * clip)) for m, _, w in metrics]
    return ranked.withColumn("score", 100 * sum(each[1:], each[0])).select(*rows.columns, "score")


def within_limits(**limits: tuple[float | None, float | None]) -> Column:
    """Whether a row may enter a ranking: each limited metric is there, finite, and between its least and most (ends included)."""
    ok = F.lit(True)
    for metric, (least, most) in limits.items():
        x = F.col(metric).cast("double")
        there = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        ok = ok & there & (F.lit(True) if least is None else x >= least) & (F.lit(True) if most is None else x <= most)
    return F.coalesce(ok, F.lit(False))


def coverage(options: DataFrame, universe: DataFrame, done: Column) -> DataFrame:
    """Per kind of option (key): how many are defined, how many a finished job has had, which have only been assigned, and which never.

    options: (key, option) of jobs, with what `done` needs; universe: (key, option). Options are summed to one row each before they
    meet; what jobs have had beyond the universe counts as had but is not listed as missing."""
    had = options.groupBy("key", "option").agg(F.max(done).alias("finished"))
    met = universe.distinct().withColumn("defined", F.lit(True)).join(had, ["key", "option"], "full")
    listed = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("option"))))
    return met.groupBy("key").agg(
        F.count_if("defined").alias("defined"), F.count_if("finished").alias("completed"),
        listed(~F.col("finished")).alias("assigned_not_completed"), listed(F.col("defined") & F.col("finished").isNull()).alias("not_assigned"),
    )


def wanted_fingerprints(texts: DataFrame, text: str) -> DataFrame:
    """(fingerprint, times): every run of exactly 16 hexadecimal digits in the texts, in lower case."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![0-9a-z])([0-9a-f]{16})(?![0-9a-z])"), F.lit(1))).alias("fingerprint"))
    return found.groupBy("fingerprint").agg(F.count("*").alias("times"))


def restored(wanted: DataFrame, rankings: dict[str, DataFrame], fields: Sequence[str], id_col: str) -> DataFrame:
    """The configurations behind 16-digit fingerprints: for each one wanted, its fields, the first id, how many rows had it and in which
    rankings it stands. Fingerprints are computed again from the fields, never read, so a row that was altered is not found; one whose
    rows disagree in their fields (a collision of 64 bits) is marked. Wanted ones that are nowhere have no fields."""
    rows = None
    for name, r in rankings.items():
        part = r.select(F.lit(name).alias("_in"), id_col, *fields).withColumn("fingerprint", fingerprint(*fields)).join(wanted.select("fingerprint"), "fingerprint", "left_semi")
        rows = part if rows is None else rows.unionByName(part)
    same = F.struct(*fields)
    found = rows.groupBy("fingerprint").agg(F.min_by(same, id_col).alias("_f"), F.min(id_col).alias(id_col), F.count("*").alias("rows"), F.array_sort(F.collect_set("_in")).alias("rankings"), (F.min(same) != F.max(same)).alias("ambiguous"))
    return wanted.join(found, "fingerprint", "left").select("fingerprint", id_col, "_f.*", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("rankings", F.array().cast("array<string>")).alias("rankings"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def research_candidates(rows: DataFrame, category: str, cluster: str, id_col: str, most: int = 50) -> DataFrame:
    """Of each category the first 20 by score, 10 by drawdown and 10 by net return at the bad cost; of these, in each cluster the best
    score and of the rest the lowest drawdown; at most `most` a category, best score first. All orders end with the id."""
    c = W.partitionBy(category)
    orders = {"score": [F.desc("score"), F.asc("max_drawdown"), F.desc("p95_net")], "drawdown": [F.asc("max_drawdown"), F.desc("score")], "p95_net": [F.desc("p95_net"), F.desc("score")]}
    # the first forty ranks stop early: each order is a limit within the category
    picked = None
    for (name, order), k in zip(orders.items(), (20, 10, 10)):
        part = rows.withColumn("_n", F.row_number().over(c.orderBy(*order, F.asc(id_col)))).where(F.col("_n") <= k).drop("_n").withColumn("_why", F.lit(name))
        picked = part if picked is None else picked.unionByName(part)
    cols = [x for x in rows.columns if x != id_col]
    picked = picked.groupBy(id_col).agg(*(F.first(x).alias(x) for x in cols), F.array_sort(F.collect_set("_why")).alias("reasons"))
    k = W.partitionBy(category, cluster)
    picked = picked.withColumn("_best", F.row_number().over(k.orderBy(F.desc("score"), F.asc("max_drawdown"), F.desc("p95_net"), F.asc(id_col))))
    picked = picked.withColumn("_low", F.row_number().over(W.partitionBy(category, cluster, F.col("_best") == 1).orderBy(F.asc("max_drawdown"), F.desc("p95_net"), F.desc("score"), F.asc(id_col))))
    kept = picked.where((F.col("_best") == 1) | (F.col("_low") == 1)).drop("_best", "_low")
    place = F.row_number().over(c.orderBy(F.desc("score"), F.asc("max_drawdown"), F.desc("p95_net"), F.asc(id_col)))
    return kept.withColumn("place", place).where(F.col("place") <= most)


# fixed values: metrics that a ranking may follow: column, and whether larger is better
RANKINGS = {
    "final_equity": True, "total_return": True, "profit_factor": True, "t_stat": True, "win_rate": True, "trades_per_day": True, "orders_per_day": True, "trades": True, "mean_ret": True, "sum_ret": True,
    "first_year": True, "last_year": True, "long_share": True, "executed": True, "open_quantity": True, "max_drawdown": False, "protections": False, "forced": False, "mean_hold": False, "stopped": False,
}


def ranking_order(metric: str, id_col: str) -> list[Column]:
    """The metric, then the lower drawdown, then the id."""
    return [F.desc_nulls_last(metric) if RANKINGS[metric] else F.asc_nulls_last(metric), F.asc("max_drawdown"), F.asc(id_col)]


def first_of_rankings(rows: DataFrame, k: int, id_col: str) -> DataFrame:
    """(metric, id, value, place): the first k rows by each metric of RANKINGS, in one pass over the rows. Every task keeps its own first
    k of each metric, so that is all that a task of the last step reads."""
    value = lambda m: F.struct(F.lit(m).alias("metric"), F.lit(RANKINGS[m]).alias("_larger"), F.col(m).cast("double").alias("value"))
    each = rows.select(id_col, "max_drawdown", F.explode(F.array(*(value(m) for m in RANKINGS))).alias("_x")).select(id_col, "max_drawdown", "_x.*")
    each = each.withColumns({"_desc": F.when(F.col("_larger"), F.col("value")), "_asc": F.when(~F.col("_larger"), F.col("value"))})
    w = W.partitionBy("metric").orderBy(F.desc_nulls_last("_desc"), F.asc_nulls_last("_asc"), F.asc("max_drawdown"), F.asc(id_col))
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("metric", id_col, "value", "place")


def evenly_spaced(n: int, k: int) -> list[int]:
    """k places of n that lie evenly, the first and the last among them."""
    return list(range(n)) if k >= n else sorted({round(i * (n - 1) / max(1, k - 1)) for i in range(k)})


def top_k(rows: DataFrame, k: int, order: Sequence[Column], category: str | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows in an order that must be total, of each category or of all."""
    if category is None:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(category).orderBy(*order))).where(F.col(rank) <= k)


def best_and_worst(rows: DataFrame, k_best: int, k_worst: int, metric: str, category: str, id_col: str, eligible: Column) -> DataFrame:
    """Best rows among the eligible, worst among all with trades, side by side with `list` telling which."""
    best = top_k(rows.where(eligible), k_best, [F.desc(metric), F.asc("max_drawdown"), F.asc(id_col)], category)
    worst = top_k(rows.where("trades > 0"), k_worst, [F.asc(metric), F.desc("max_drawdown"), F.asc("protections"), F.asc(id_col)], category)
    return best.withColumn("list", F.lit("best")).unionByName(worst.withColumn("list", F.lit("worst")))


def near_best(rows: DataFrame, metric: str, category: str, share: float = 0.9) -> DataFrame:
    """Rows with at least the share of their category's best."""
    best = rows.groupBy(category).agg(F.max(metric).alias("_best"))
    return rows.join(best, category).where(F.col(metric) >= share * F.col("_best")).drop("_best")


def diverse(rows: DataFrame, cluster: str, id_col: str) -> DataFrame:
    """Of each cluster the row with the best score and the one with the lowest drawdown; one row where they are the same."""
    a = rows.withColumn("_n", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), F.asc(id_col))))
    b = a.withColumn("_m", F.row_number().over(W.partitionBy(cluster).orderBy(F.asc("max_drawdown"), F.desc("score"), F.asc(id_col))))
    return b.where("_n = 1 or _m = 1").drop("_n", "_m")


def average_rank(rows: DataFrame, column: str, out: str, larger: bool = True, parts: int = 64, base: DataFrame | None = None) -> DataFrame:
    """The average rank of ties as a share of all rows (of `base`, where rows have been joined to others since). Values are counted first; counts are summed in ranges of values between
    approximate quantiles, so no task sorts them all and only `parts` sums meet in one."""
    c = F.col(column) if larger else -F.col(column)
    base = rows if base is None else base
    counts = base.groupBy(c.alias("_v")).agg(F.count("*").alias("_n"))
    edges = sorted(set(base.select(c.cast("double").alias("_v")).approxQuantile("_v", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    bucket = sum(((F.col("_v") > e).cast("int") for e in edges), F.lit(0))
    counts = counts.withColumn("_b", bucket)
    sums = counts.groupBy("_b").agg(F.sum("_n").alias("_s"))  # at most `parts` rows
    w = W.orderBy("_b")
    sums = sums.select("_b", (F.sum("_s").over(w) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy()).alias("_all"))
    ranked = counts.join(F.broadcast(sums), "_b").select("_v", ((F.col("_before") + F.sum("_n").over(W.partitionBy("_b").orderBy("_v")) - (F.col("_n") - 1) / 2) / F.col("_all")).alias(out))
    return rows.withColumn("_v", c).join(ranked, "_v").drop("_v")


# fixed values: what the stress score is made of: column, whether larger is better, weight
STRESS = (("worst_ret", True, 0.60), ("mean_ret", True, 0.20), ("mean_dd", False, 0.10), ("mean_pf", True, 0.05), ("mean_t", True, 0.05))


def regimes(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per configuration over exit regimes (final_return, max_drawdown, profit_factor, t_stat, trades): means, worst and best."""
    return rows.groupBy(*key).agg(
        F.avg("final_return").alias("mean_ret"), F.min("final_return").alias("worst_ret"), F.max("final_return").alias("best_ret"), F.count_if(F.col("final_return") > 0).alias("profitable"),
        F.avg("max_drawdown").alias("mean_dd"), F.max("max_drawdown").alias("worst_dd"), F.avg("profit_factor").alias("mean_pf"), F.avg("t_stat").alias("mean_t"), F.min("trades").alias("least_trades"),
    )


def scored_by_ranks(agg: DataFrame) -> DataFrame:
    """stress, 0 to 100: weighted average-rank percentiles of regimes(), less where the regime with the fewest trades has under 20."""
    agg = base = store(agg)  # read once more for each metric
    for m, larger, _ in STRESS:
        agg = average_rank(agg, m, f"_p_{m}", larger, base=base)
    score = sum((w * F.col(f"_p_{m}") for m, _, w in STRESS), F.lit(0.0))
    penalty = F.least(F.lit(1.0), F.sqrt(F.greatest(F.col("least_trades"), F.lit(0)) / 20))
    return agg.withColumn("stress", 100 * score * penalty).drop(*(f"_p_{m}" for m, *_ in STRESS))


def in_all_cells(rows: DataFrame, key: str, cells: Sequence[str], needed: int, ok: Column) -> DataFrame:
    """Keys that pass in every one of the needed (window, cost) cells."""
    return rows.where(ok).groupBy(key).agg(F.count_distinct(F.struct(*cells)).alias("n_cells"), F.min("ret_over_dd").alias("worst"), F.median("ret_over_dd").alias("middle")).where(F.col("n_cells") == needed).withColumn("campaign_score", 0.5 * F.col("worst") + 0.5 * F.col("middle"))


def family_medians(candidates: DataFrame, family: str, score: str = "campaign_score") -> DataFrame:
    return candidates.groupBy(family).agg(F.median(score).alias("family_score"), F.count("*").alias("members"))


def frozen_for_validation(candidates: DataFrame, families: DataFrame, family: str, id_col: str, k_families: int, per_family: int = 2) -> DataFrame:
    """Up to two candidates of each winning family; what validation finds never comes back here."""
    won = families.orderBy(F.desc("family_score"), F.asc(family)).limit(k_families)
    return top_k(candidates.join(won, family), per_family, [F.desc("campaign_score"), F.asc(id_col)], family)


def seed_quantiles(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, tenth and ninetieth percentile, maximum over seeds, and the share above zero; missing values are left out."""
    v = F.col(value)
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(
        F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.1)).alias("q10"), F.percentile(v, F.lit(0.9)).alias("q90"),
        F.max(v).alias("best"), F.avg((v > 0).cast("double")).alias("profitable"), F.count("*").alias("seeds"),
    )


def merged_results(parts: Sequence[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Result tables as one, equal rows once; and the keys on which they disagree."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct()
    return rows, rows.groupBy(key).count().where("count > 1").select(key)


def not_done(configs: DataFrame, done: DataFrame, key: str = "config_id") -> DataFrame:
    """What a run that is taken up again still has to do."""
    return configs.join(done.select(key).distinct(), key, "left_anti")
