"""Dashboards over logs: counts, rates, trends, pivots and rollups.

Every operator is one plan of DataFrame functions: partial aggregation before each shuffle, no
driver-side loop, and columns only where they are used.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_of(ts: str | Column, tz: str = "UTC") -> Column:
    """The calendar day of a UTC timestamp in a time zone, as a date."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c if tz == "UTC" else F.from_utc_timestamp(c, tz))


def rate(part: Column, whole: Column, digits: int = 1, empty: float | None = 0.0) -> Column:
    """100 part / whole, rounded; ``empty`` where the whole is zero or null."""
    share = F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0, digits)
    return share if empty is None else F.coalesce(share, F.lit(empty))


def daily_distinct(rows: DataFrame, ts: str, who: str, tz: str = "UTC") -> DataFrame:
    """day and the number of distinct ``who``."""
    return rows.groupBy(day_of(ts, tz).alias("day")).agg(F.countDistinct(who).alias("active"))


def daily_rate(rows: DataFrame, ts: str, hit: Column, by: Sequence[str] = (), tz: str = "UTC") -> DataFrame:
    """day (and groups): number of rows, of hits, and their rate."""
    found = rows.groupBy(day_of(ts, tz).alias("day"), *by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return found.withColumn("hit_rate", rate(F.col("hits"), F.col("n")))


def with_spine(found: DataFrame, spine: Sequence[str], by: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Every combination of the spine's and the groups' values, absent ones with defaults.

    Both sides are distinct values of an aggregate, one row for each day and each group.
    """
    days, groups = found.select(*spine).distinct(), found.select(*by).distinct()
    return days.join(groups).join(found, [*spine, *by], "left").fillna(defaults)


PERIODS = ("today", "yesterday", "this_week", "this_month", "last_7_days", "last_30_days")


def period_bounds(period: str, as_of: dt.date) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """Half-open current and previous ranges of a preset: (from, to, previous from, previous to)."""
    day = dt.timedelta(days=1)
    if period == "today":
        return as_of, as_of + day, as_of - day, as_of
    if period == "yesterday":
        return as_of - day, as_of, as_of - 2 * day, as_of - day
    if period == "this_week":
        monday = as_of - dt.timedelta(days=as_of.weekday())
        return monday, as_of + day, monday - 7 * day, monday
    if period == "this_month":
        first = as_of.replace(day=1)
        return first, as_of + day, (first - day).replace(day=1), first
    days = {"last_7_days": 7, "last_30_days": 30}[period]
    start = as_of - dt.timedelta(days=days - 1)
    return start, as_of + day, start - dt.timedelta(days=days), start


def period_over_period(rows: DataFrame, ts: str, who: str, hit: Column, as_of: dt.date, periods: Sequence[str] = PERIODS) -> DataFrame:
    """A row for each preset: counts, users and hit rate now and before, and their difference.

    One scan: each row is dealt to the ranges it lies in, at most two for each preset.
    """
    ranges = []
    for p in periods:
        a, b, c, d = period_bounds(p, as_of)
        ranges += [(p, "now", a, b), (p, "before", c, d)]
    at = F.to_date(ts)
    dealt = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(w).alias("part"), ((at >= F.lit(a)) & (at < F.lit(b))).alias("inside")) for p, w, a, b in ranges))
    least, most = min(r[2] for r in ranges), max(r[3] for r in ranges)
    parts = rows.where((F.col(ts) >= F.lit(least)) & (F.col(ts) < F.lit(most))).select(F.col(who).alias("who"), hit.alias("hit"), F.inline(F.filter(dealt, lambda x: x["inside"])))
    out = parts.groupBy("period").agg(
        *(F.count_if(F.col("part") == w).alias(f"n_{w}") for w in ("now", "before")),
        *(F.count_distinct(F.when(F.col("part") == w, F.col("who"))).alias(f"users_{w}") for w in ("now", "before")),
        *(F.count_if((F.col("part") == w) & F.col("hit")).alias(f"hits_{w}") for w in ("now", "before")),
    )
    r = [rate(F.col(f"hits_{w}"), F.col(f"n_{w}")) for w in ("now", "before")]
    return out.select("period", "n_now", "n_before", "users_now", "users_before", (F.col("n_now") - F.col("n_before")).alias("n_trend"), (F.col("users_now") - F.col("users_before")).alias("users_trend"), r[0].alias("rate_now"), r[1].alias("rate_before"), F.round(r[0] - r[1], 1).alias("rate_trend"))


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of each key's last row in the order given; ties go to the largest columns."""
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("last"))
    return best.select(key, *(F.col("last")[c].alias(c) for c in columns))


def clamped_mean(rows: DataFrame, by: str, part: str, whole: str) -> DataFrame:
    """Mean over rows of min(100, 100 part / max(whole, 1)), and the number of rows."""
    score = F.least(F.lit(100.0), F.col(part) * 100.0 / F.greatest(F.col(whole), F.lit(1)))
    return rows.groupBy(by).agg(F.count("*").alias("submissions"), F.round(F.avg(score), 2).alias("mean_accuracy"))


def share_of_total(rows: DataFrame, by: str) -> DataFrame:
    """Size of each group and its share of all rows."""
    found = rows.groupBy(by).agg(F.count("*").alias("n"))
    return found.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy())))


def top_and_other(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest groups and the rest as one, with shares."""
    found = rows.groupBy(by).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), by))
    name = F.when(F.col("rank") <= k, F.col(by)).otherwise(F.lit("other"))
    out = found.withColumn("rank", rank).groupBy(name.alias(by)).agg(F.sum("n").alias("n"))
    return out.withColumn("share", rate(F.col("n"), F.sum("n").over(Window.partitionBy())))


def trend_pivot(rows: DataFrame, ts: str, by: str, names: Sequence[str], days: int) -> DataFrame:
    """A row for each of the last ``days`` days that occur, a count column for each name."""
    found = rows.groupBy(day_of(ts).alias("day")).agg(*(F.count_if(F.col(by) == n).alias(n) for n in names))
    return found.orderBy(F.desc("day")).limit(days)


def usage_rollup(rows: DataFrame, request: str, provider: str, tokens: str) -> DataFrame:
    """Calls and tokens in total, by request and by provider: one pass of grouping sets."""
    found = rows.groupingSets([[], [request], [provider]], request, provider).agg(
        F.grouping_id().alias("level"), F.count("*").alias("calls"), F.round(F.sum(tokens), 2).alias("tokens")
    )
    kind = F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "request").otherwise("provider")
    return found.select(kind.alias("kind"), F.coalesce(request, provider, F.lit("all")).alias("name"), "calls", "tokens")


def decision_accuracy(rows: DataFrame, by: str, action: str, names: Sequence[str] = ("accepted", "rejected", "modified", "pending")) -> DataFrame:
    """Counts of each action by group, and rates over decided rows (null where none is decided)."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(action) == n).alias(n) for n in names))
    decided = F.col("accepted") + F.col("rejected") + F.col("modified")
    return out.withColumns(
        {
            "accept_rate": rate(F.col("accepted"), decided, empty=None),
            "reject_rate": rate(F.col("rejected"), decided, empty=None),
            "pending_rate": rate(F.col("pending"), F.col("n"), empty=None),
        }
    )


def consistency(runs: DataFrame, key: str, run: str, rules: str, count: str, least: float = 0.5, most: float = 30.0) -> DataFrame:
    """Each run against the one before of its key: Jaccard of the rule sets and change of the count.

    Consistent if the Jaccard is ``least`` or more and the count changed by at most ``most``
    percent. The first run of a key has nothing before it and is left out.
    """
    w = Window.partitionBy(key).orderBy(run)
    both = runs.withColumns({"rules_before": F.lag(rules).over(w), "count_before": F.lag(count).over(w)}).where("rules_before is not null")
    union = F.size(F.array_union(rules, "rules_before"))
    jaccard = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(rules, "rules_before")) / union)
    change = F.abs(F.col(count) - F.col("count_before")) * 100.0 / F.greatest(F.col("count_before"), F.lit(1))
    out = both.select(key, run, F.round(jaccard, 4).alias("jaccard"), F.round(change, 2).alias("change"))
    return out.withColumn("consistent", (F.col("jaccard") >= least) & (F.col("change") <= most))


def next_key(keys: DataFrame, column: str, prefix: str = "R", width: int = 3) -> DataFrame:
    """The key after the largest one: prefix and a number with leading zeros; 1 if there is none."""
    number = F.substring(F.max(column), len(prefix) + 1, 20).cast("int")
    return keys.agg(F.format_string(f"{prefix}%0{width}d", F.coalesce(number, F.lit(0)) + 1).alias("next_key"))


def usage_map(rows: DataFrame, request: str, provider: str) -> DataFrame:
    """A row for each request type: its calls, and a map of provider to calls."""
    found = rows.groupBy(request, provider).agg(F.count("*").alias("n"))
    return found.groupBy(request).agg(F.sum("n").alias("calls"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(provider, "n")))).alias("providers"))


def effectiveness(rows: DataFrame, rule: str, category: str, high: Column, document: str, top: int = 20) -> DataFrame:
    """(grouping, name, n, high, high_rate, documents) in total, by category, and for the ``top`` rules with most findings."""
    found = rows.groupingSets([[], [category], [rule]], rule, category).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(high).alias("high"), F.countDistinct(document).alias("documents"))
    kind = F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "rule").otherwise("category")
    found = found.select(kind.alias("grouping"), F.coalesce(rule, category, F.lit("all")).alias("name"), "n", "high", rate(F.col("high"), F.col("n")).alias("high_rate"), "documents")
    rank = F.row_number().over(Window.partitionBy("grouping").orderBy(F.desc("n"), "name"))
    return found.withColumn("_n", rank).where((F.col("grouping") != "rule") | (F.col("_n") <= top)).drop("_n")
