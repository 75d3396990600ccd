"""The daily market pass: features of each series, bands, and a roll-up by set."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import clamp, normal_cdf
from marketloom.operators.stats import join_same, quantiles_of_large

HORIZONS = (7, 30, 90, 180, 365)
BAND_HORIZONS = (30, 90, 180, 365)
#: Quantiles of the standard normal distribution.
Z = {"q10": -1.281551565545, "q25": -0.674489750196, "q50": 0.0, "q75": 0.674489750196, "q90": 1.281551565545}


def market_metrics(history: DataFrame, as_of: datetime.date, keys: list[str], horizons: tuple[int, ...] = HORIZONS, tolerance: int = 3) -> DataFrame:
    """Features of every series with a row on as_of: one row for each value of keys.

    history has keys, day and price. Rows of 368 days up to as_of are read; a series' rows are brought together once,
    on keys, and the daily aggregate, the windows and the last aggregate all use that partitioning.
    """
    day = F.lit(as_of).cast("date")
    raw = history.where(F.col("day").between(F.date_sub(day, 368), day)).select(*keys, "day", "price").repartition(*keys)
    daily = raw.groupBy(*keys, "day").agg(F.max("price").alias("any_price"), F.max(F.when(F.col("price") > 0, F.col("price"))).alias("price"))
    order = Window.partitionBy(*keys).orderBy("day")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    priced = F.col("price").isNotNull()
    steps = daily.select(
        *keys,
        "day",
        "any_price",
        "price",
        F.last("price", ignorenulls=True).over(before).alias("previous"),
        F.last(F.when(priced, F.col("day")), ignorenulls=True).over(before).alias("previous_day"),
        F.max("price").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"),
    )
    recent = F.col("day") >= F.date_sub(day, 30)
    step = F.when(priced & F.col("previous").isNotNull(), F.log(F.col("price") / F.col("previous")) / F.sqrt(F.datediff("day", "previous_day")))

    def reference(h: int) -> Column:
        near = priced & F.col("day").between(F.date_sub(day, h + tolerance), F.date_sub(day, h))
        return F.max_by(F.when(near, F.col("price")), F.when(near, F.col("day"))).alias(f"reference_{h}d")

    found = steps.groupBy(*keys).agg(
        F.max(F.when(F.col("day") == day, F.col("any_price"))).alias("today"),
        F.max((F.col("day") == day).cast("int")).alias("is_today"),
        F.count("price").alias("observation_count"),
        *[reference(h) for h in horizons],
        F.expr("regr_slope(ln(price), datediff(day, date '1970-01-01'))" + f" FILTER (WHERE price IS NOT NULL AND day >= date_sub(date '{as_of}', 30))").alias("slope"),
        F.stddev_samp(F.when(recent, step)).alias("volatility"),
        F.max(1 - F.col("price") / F.col("peak")).alias("drawdown"),
    )
    current = F.when(F.col("today") > 0, F.col("today"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return found.where("is_today = 1").select(
        *keys,
        current.alias("current_price"),
        "observation_count",
        *[F.when((F.col(f"reference_{h}d") > 0), current / F.col(f"reference_{h}d") - 1).alias(f"return_{h}d") for h in horizons],
        finite(F.col("slope")).alias("daily_log_slope_30d"),
        finite(F.col("volatility")).alias("volatility_30d"),
        F.col("drawdown").alias("max_drawdown_365d"),
        F.when(F.col("observation_count") > 0, F.least(F.lit(1.0), F.col("observation_count") / 366.0)).alias("history_density_365d"),
    )


def sufficient() -> Column:
    return F.coalesce((F.col("current_price") > 0) & (F.col("observation_count") >= 14) & F.col("history_density_365d").isNotNull() & F.col("daily_log_slope_30d").isNotNull() & F.col("volatility_30d").isNotNull(), F.lit(False))


def shadow_score(metrics: DataFrame) -> DataFrame:
    """metrics with trend_status, trend_confidence, opportunity_score and opportunity_status."""
    ok = sufficient()
    vol, density = F.col("volatility_30d"), F.col("history_density_365d")
    z = F.col("daily_log_slope_30d") / F.greatest(vol, F.lit(0.01))
    status = F.when(z >= 0.35, "strong_rise").when(z >= 0.12, "rise").when(z <= -0.35, "strong_fall").when(z <= -0.12, "fall").otherwise("stable")
    confidence = F.round(clamp(density * 70 + F.least(F.col("observation_count") / 90, F.lit(1.0)) * 30, 0.0, 100.0), 4)
    score = F.round(
        clamp(
            45
            + clamp(F.coalesce("return_30d", F.lit(0.0)) * 100, -25.0, 25.0)
            + 18 * F.tanh(z)
            + 12 * (1 - clamp(vol / 0.15, 0.0, 1.0))
            + 10 * density
            - 15 * clamp(F.coalesce("max_drawdown_365d", F.lit(0.0)), 0.0, 1.0),
            0.0,
            100.0,
        ),
        4,
    )
    out = metrics.withColumns({"trend_status": F.when(ok, status).otherwise("insufficient"), "trend_confidence": F.when(ok, confidence), "opportunity_score": F.when(ok, score)})
    label = F.when(F.col("opportunity_score") >= 70, "candidate").when(F.col("opportunity_score") <= 30, "risk").when(F.col("opportunity_score").isNotNull(), "neutral").otherwise("insufficient")
    return out.withColumn("opportunity_status", label)


def shadow_bands(metrics: DataFrame, keys: list[str], horizons: tuple[int, ...] = BAND_HORIZONS) -> DataFrame:
    """A row for each sufficient series and horizon: quantiles, probability_up, confidence."""
    rows = metrics.where(sufficient()).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    drift = clamp(F.col("daily_log_slope_30d") * F.col("horizon") * 0.25, -0.70, 0.70)
    sigma = clamp(F.col("volatility_30d") * F.sqrt("horizon") * 0.75, 0.05, 1.20)
    base = clamp(F.col("history_density_365d") * 75 + F.least(F.col("observation_count") / 365, F.lit(1.0)) * 25, 0.0, 100.0)
    return rows.select(
        *keys,
        "horizon",
        *[(F.col("current_price") * F.exp(drift + z * sigma)).alias(q) for q, z in Z.items()],
        normal_cdf(drift / sigma).alias("probability_up"),
        clamp(base * F.sqrt(30 / F.col("horizon")), 0.0, 100.0).alias("confidence"),
    )


def set_metrics(metrics: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: counts, median return, breadth and median volatility; groups without rows too."""
    rolled = metrics.groupBy(*keys).agg(
        F.count("*").alias("series_count"),
        F.count("current_price").alias("priced_series_count"),
        F.avg(F.when(F.col("return_30d").isNotNull(), (F.col("return_30d") > 0).cast("double"))).alias("breadth_30d"),
    )
    rolled = join_same(rolled, quantiles_of_large(metrics, keys, {f"median_{value}": (value, 0.5) for value in ("return_30d", "volatility_30d")}), keys)
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("series_count", "priced_series_count")}
    return groups.select(*keys).distinct().join(rolled, keys, "left").withColumns(zero)


def set_hotness(rolled: DataFrame, least_priced: int = 5) -> DataFrame:
    ok = F.coalesce((F.col("priced_series_count") >= least_priced) & F.col("median_return_30d").isNotNull() & F.col("breadth_30d").isNotNull(), F.lit(False))
    score = 50 + clamp(F.col("median_return_30d") * 100, -25.0, 25.0) + (F.col("breadth_30d") - 0.5) * 30 - 10 * clamp(F.coalesce("median_volatility_30d", F.lit(0.0)) / 0.20, 0.0, 1.0)
    return rolled.withColumns({"hotness_score": F.when(ok, F.round(clamp(score, 0.0, 100.0), 4)), "feature_status": F.when(ok, "available").otherwise("insufficient")})
