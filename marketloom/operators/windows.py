"""Window forms over series: steps, levels, reversion, down-sampling, interpolation, streaks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.stats import join_same, quantile_of_large
from marketloom.sources.io import bounded, settled


def step_returns(panel: DataFrame, keys: list[str], t: str = "t", price: str = "price") -> DataFrame:
    """panel with r: log return over the last priced step, by step, null at the first."""
    w = Window.partitionBy(*keys).orderBy(t)
    return panel.where(F.col(price) > 0).withColumn("r", F.log(F.col(price) / F.lag(price).over(w)) / (F.col(t) - F.lag(t).over(w)))


def cumulative(df: DataFrame, keys: list[str], t: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(value, F.lit(0.0))).over(w))


def smoothed(df: DataFrame, keys: list[str], t: str, value: str, alpha: float, name: str = "smoothed") -> DataFrame:
    """df with the exponential smoothing of each series' values that are not null, from the first one on, and `<name>_n`, how many they are so far.

    A series is cut into runs whose weights span eight powers of ten. A run is a pair (decay, level) and pairs compose: the level here is
    the run's own part plus decay times the level before the run, which the three runs before give to 24 powers of ten.
    So it holds for any length, in windows over the series' rows.
    """
    q, n = 1.0 - alpha, f"{name}_n"
    run = max(1, math.floor(8 * math.log(10) / -math.log(q)))
    series = Window.partitionBy(*keys)
    x = df.withColumn(n, F.count(value).over(series.orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__run", F.floor((F.col(n) - 1) / run)).withColumn("__p", F.col(n) - 1 - F.col("__run") * run)
    weight = F.when(F.col(n) == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 / q), "__p")
    inside = Window.partitionBy(*keys, "__run").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__own", F.pow(F.lit(q), "__p") * F.sum(weight * F.col(value)).over(inside))
    end = F.when(F.col("__p") == run - 1, F.col("__own"))
    before = [F.coalesce(F.max(end).over(series.orderBy("__run").rangeBetween(-k, -k)), F.lit(0.0)) * q ** (run * (k - 1)) for k in (1, 2, 3)]
    return x.withColumn(name, F.col("__own") + F.pow(F.lit(q), F.col("__p") + 1) * (before[0] + before[1] + before[2])).drop("__run", "__p", "__own")


def level_reversion(df: DataFrame, keys: list[str], t: str, value: str, k: int = 13, least: int = 2) -> DataFrame:
    """df with reversion: median of the trailing k steps minus the present value."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-(k - 1), 0)
    return df.withColumn("reversion", F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w) - F.col(value)))


def last_known(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, t).alias(value), F.max(t).alias(t))


def previous_forecast(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at)
    change = F.when(F.lag(value).over(w).isNull(), "first").when(F.col(value) > F.lag(value).over(w), "raised").when(F.col(value) < F.lag(value).over(w), "lowered").otherwise("unchanged")
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("change", change)


def downsample(points: DataFrame, keys: list[str], at: str, value: str, n: int = 32) -> DataFrame:
    """At most n contiguous buckets of each series: mean value and last date."""
    w = Window.partitionBy(*keys)
    size = F.ceil(F.count("*").over(w) / n)
    b = points.withColumn("bucket", F.floor((F.row_number().over(w.orderBy(at)) - 1) / size))
    return b.groupBy(*keys, "bucket").agg(F.avg(value).alias(value), F.max(at).alias(at))


def range_filter(points: DataFrame, keys: list[str], at: str, days: int) -> DataFrame:
    """Rows of the last `days` before the series' own last date."""
    return points.withColumn("__last", F.max(at).over(Window.partitionBy(*keys))).where(F.col(at) >= F.date_sub("__last", days)).drop("__last")


def interpolate_daily(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """A row for each day between checkpoints, on the straight line."""
    w = Window.partitionBy(*keys).orderBy(at)
    p = points.withColumns({"__next": F.lead(at).over(w), "__v": F.lead(value).over(w)})
    span = F.datediff("__next", at)
    days = p.withColumn("__d", F.explode(F.sequence(F.lit(0), F.coalesce(span - 1, F.lit(0)))))
    return days.select(*keys, F.date_add(at, F.col("__d")).alias(at), F.when(F.col("__next").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("__v") - F.col(value)) * F.col("__d") / span).alias(value))


def spaced_origins(df: DataFrame, keys: list[str], at: str, gap_days: int) -> DataFrame:
    """(keys, at): dates taken greedily, each at least gap_days after the last taken; a fold over a series' distinct dates."""
    dates = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.datediff(at, F.lit("1970-01-01")))).alias("d"))
    taken = F.aggregate(
        "d",
        F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= gap_days), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return dates.select(*keys, F.explode(taken).alias("__d")).select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__d")).alias(at))


def flag_streak(df: DataFrame, keys: list[str], at: str, flag: str, k: int = 3, lo: int = 6, hi: int = 8, span: int = 14) -> DataFrame:
    """df with streak: flagged here and at the k - 1 origins before, gaps of lo to hi days, span days in all."""
    w = Window.partitionBy(*keys).orderBy(at)
    ok = F.col(flag)
    for i in range(1, k):
        gap = F.datediff(F.lag(at, i - 1).over(w) if i > 1 else F.col(at), F.lag(at, i).over(w))
        ok = ok & F.lag(flag, i).over(w) & gap.between(lo, hi)
    return df.withColumn("streak", F.coalesce(ok & (F.datediff(at, F.lag(at, k - 1).over(w)) >= span), F.lit(False)))


def expanding_mad(df: DataFrame, origins: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """(keys, origin, mad) over points up to each of a few origins.

    A group may hold a large share of all points, so both medians go by counted cells (stats.quantiles_of_large). The points are written once, with
    what is read of them.
    """
    known = settled(df.where(F.col(value).isNotNull()).select(*keys, t, value)).join(F.broadcast(origins), F.col(t) <= F.col("origin"))
    own = ["origin", *keys]
    centre = bounded(quantile_of_large(known, own, value, {"__c": 0.5}, steps=256, few=True))
    off = join_same(known, centre, own).select(*own, F.abs(F.col(value) - F.col("__c")).alias("__off"))
    return join_same(known.select(*own).distinct(), quantile_of_large(off, own, "__off", {"mad": 0.5}, steps=256, few=True), own)
