"""Privacy-gated demand aggregates and velocities."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"watch_adds": "watch_add", "watch_removes": "watch_remove", "searches": "search_view", "portfolio_adds": "portfolio_add", "views": "card_view"}


def eligible(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """Events of users that are neither operators nor opted out."""
    return events.join(excluded.select("user").distinct(), "user", "left_anti")


def demand_aggregate(events: DataFrame, excluded: DataFrame, period: Column, threshold: int = 20) -> DataFrame:
    """(variant, period, counts by kind, unique_users, privacy_threshold_met)."""
    rows = eligible(events, excluded).withColumn("period", period)
    return rows.groupBy("variant", "period").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for n, k in KINDS.items()], F.count_distinct("user").alias("unique_users"), (F.count_distinct("user") >= threshold).alias("privacy_threshold_met")
    )


def trailing_rate(periods: DataFrame, end: datetime.date, days: int, value: Column, name: str) -> DataFrame:
    """(variant, name): events by user and day over periods that cover the window exactly, or null."""
    lo = end - datetime.timedelta(days=days - 1)
    own = periods.where((F.col("period_start") >= F.lit(lo)) & (F.col("period_end") <= F.lit(end)))
    w = Window.partitionBy("variant").orderBy("period_start")
    own = own.withColumn("__gap", F.datediff("period_start", F.coalesce(F.lag("period_end").over(w), F.date_sub(F.lit(lo), 1))))
    span = F.datediff("period_end", "period_start") + 1
    ok = (F.max(F.col("__gap") != 1) == F.lit(False)) & (F.max("period_end") == F.lit(end)) & F.bool_and("privacy_threshold_met") & (F.min("unique_users") > 0)
    return own.groupBy("variant").agg(F.when(ok, F.sum(value) / F.sum(F.col("unique_users") * span)).alias(name))


def demand_velocity(periods: DataFrame, end: datetime.date) -> DataFrame:
    """(variant, velocities, demand_acceleration) from periods that end by `end`."""
    c = F.col
    watch, intent = c("watch_adds") - c("watch_removes"), c("watch_adds") - c("watch_removes") + c("portfolio_adds")
    parts = [
        trailing_rate(periods, end, 7, watch, "watchlist_velocity_7d"),
        trailing_rate(periods, end, 30, watch, "watchlist_velocity_30d"),
        trailing_rate(periods, end, 7, c("searches"), "search_velocity_7d"),
        trailing_rate(periods, end, 30, c("portfolio_adds"), "portfolio_add_velocity_30d"),
        trailing_rate(periods, end, 7, c("views"), "view_velocity_7d"),
        trailing_rate(periods, end, 7, intent, "__now"),
        trailing_rate(periods, end - datetime.timedelta(days=7), 7, intent, "__before"),
    ]
    out = periods.where(c("period_end") <= F.lit(end)).select("variant").distinct()
    for p in parts:
        out = out.join(p, "variant", "left")
    return out.withColumn("demand_acceleration", c("__now") - c("__before")).drop("__now", "__before")
