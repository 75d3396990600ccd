"""Baselines, damped trend, shrunk drift, conformal bands, panel forecasts, scenarios and serving rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import array_median, clamp, log_ratio
from marketloom.operators.index import cohort_return
from marketloom.operators.stats import join_same, quantile_of_large, tercile_bucket, trimmed_mean_of_large
from marketloom.operators.windows import smoothed
from marketloom.sources.io import bounded, settled

CAP = 0.70
QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
ALPHA, BETA, PHI = 0.3, 0.1, 0.85
MAD_FLOOR = 1e-4


def baselines(df: DataFrame, keys: list[str], horizon_days: int, damping: float = 0.25) -> DataFrame:
    """(keys, baseline, log_return, price) in long form. df: price, slope, market_slope, cohort, structural. Equal prices have no gap, also where both are zero."""
    names = {
        "no_change": F.lit(0.0),
        "damped_momentum": F.col("slope") * horizon_days * damping,
        "market_index": F.col("market_slope") * horizon_days * damping,
        "lifecycle_cohort": F.col("cohort"),
        "structural_convergence": F.when(F.col("structural") == F.col("price"), 0.0).otherwise(log_ratio(F.col("structural"), F.col("price"))) * damping,
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), clamp(x, -CAP, CAP).alias("log_return")) for n, x in names.items()]))
    return df.select(*keys, "price", rows.alias("b")).select(*keys, "b.baseline", "b.log_return", (F.col("price") * F.exp("b.log_return")).alias("price"))


def damped_trend(levels: DataFrame, keys: list[str], t: str, value: str, alpha: float = ALPHA, beta: float = BETA, phi: float = PHI) -> DataFrame:
    """(keys, t, level, trend): Holt's damped recursion over each series, from its first two points.

    A fold over the sorted array of an index series, whose length is the number of dates.
    """
    points = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("y")))).alias("p")).where(F.size("p") >= 2)
    first = F.struct(F.get("p", F.lit(0))["t"].alias("t"), F.get("p", F.lit(0))["y"].alias("level"), (F.get("p", F.lit(1))["y"] - F.get("p", F.lit(0))["y"]).alias("trend"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        level = alpha * x["y"] + (1 - alpha) * (last["level"] + phi * last["trend"])
        trend = beta * (level - last["level"]) + (1 - beta) * phi * last["trend"]
        return F.concat(acc, F.array(F.struct(x["t"].alias("t"), level.alias("level"), trend.alias("trend"))))

    states = F.aggregate(F.slice("p", 2, F.size("p") - 1), F.array(first), step)
    return points.select(*keys, F.explode(states).alias("s")).select(*keys, F.col("s.t").alias(t), "s.level", "s.trend")


def damped_delta(trend: Column, steps: Column, phi: float = PHI) -> Column:
    return trend * phi * (1 - F.pow(F.lit(phi), steps)) / (1 - phi)


def theta_drift(residuals: DataFrame, keys: list[str], t: str, value: str, alpha: float = 0.3, n0: float = 8.0) -> DataFrame:
    """(keys, n, drift): exponential smoothing of a series' steps, gaps skipped, shrunk by n / (n + n0)."""
    points = residuals.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(value).alias("r")))).alias("p"))
    level = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["r"].cast("double"), lambda acc, x: alpha * x["r"] + (1 - alpha) * acc)
    return points.select(*keys, F.size("p").alias("n"), level.alias("level")).select(*keys, "n", (F.col("level") * F.col("n") / (F.col("n") + n0)).alias("drift"))


def group_delta(df: DataFrame, n0: float = 12.0) -> DataFrame:
    """df (n, own_delta, cohort_return) with delta: the group's own damped move blended with its cohort's."""
    w = F.col("n") / (F.col("n") + n0)
    return df.withColumn("delta", w * F.col("own_delta") + (1 - w) * clamp(F.coalesce("cohort_return", F.lit(0.0)), -CAP, CAP))


def confidence_tier(mad: Column, n: Column, weeks_stale: Column, least: int = 8, stale: float = 8.0) -> Column:
    return F.when(mad.isNull(), "insufficient-history").when(n < least, "low-history").when(weeks_stale > stale, "low-history").otherwise("standard")


#: How far (as a log) the anchor may move from the own price, and how much wider a cold start's band is.
MOST_SHIFT, COLD_WIDEN = 1.0986122886681098, 1.75


def hedonic_anchor(own: Column, hedonic: Column, n: Column, least: int = 8, n0: float = 8.0, most: float = MOST_SHIFT) -> Column:
    """The own log price, moved towards the hedonic one where history is short."""
    shift = clamp((1 - n / (n + n0)) * (hedonic - own), -most, most)
    return F.when((n >= least) | hedonic.isNull(), own).otherwise(own + shift)


def anchor_saturated(own: Column, hedonic: Column, n: Column, least: int = 8, n0: float = 8.0, most: float = MOST_SHIFT) -> Column:
    """Whether hedonic_anchor wanted to move further than it may."""
    return F.coalesce((n < least) & (F.abs((1 - n / (n + n0)) * (hedonic - own)) > most), F.lit(False))


def conformal_offsets(residuals: DataFrame, keys: list[str], value: str = "standardized", least: int = 1, few: bool = False) -> DataFrame:
    """(keys, q10..q90, pool): quantiles of standardised residuals; the middle is 0 and each side stays on its side.

    A pool of fewer than `least` residuals takes the default (q - 1/2) 2. few: as in quantiles_of_large.
    """
    found = join_same(residuals.groupBy(*keys).agg(F.count(value).alias("pool")), quantile_of_large(residuals, keys, value, QUANTILES, few=few), keys)
    enough = F.col("pool") >= least
    side = lambda q, p: F.lit(0.0) if p == 0.5 else F.when(~enough | F.col(q).isNull(), (p - 0.5) * 2).otherwise(F.least(F.lit(0.0), F.col(q)) if p < 0.5 else F.greatest(F.lit(0.0), F.col(q)))
    return found.select(*keys, *[side(q, p).alias(q) for q, p in QUANTILES.items()], "pool")


def index_context(index: DataFrame, horizons: Sequence[int], curve: DataFrame | None = None, released: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(category, grp, t, level, deltas): for each group and date of index_levels, market + category + group level, and for each horizon (in steps) the
    damped move of all three from there on. A group's own move is blended with its cohort's by n / (n + 12): curve (age, curve) and
    released (category, grp, released), if given. Groups of `more` (category, grp) without a level have a row at the last date, with no move of their own.
    Rows are groups by dates, never series."""
    levels = index.select(F.col("level").alias("of"), "category", "grp", "t", "idx")
    trend = damped_trend(levels, ["of", "category", "grp"], "t", "idx").select("of", "category", "grp", "t", "trend")
    both = join_same(levels, trend, ["of", "category", "grp", "t"])
    part = lambda level, keys, x: both.where(F.col("of") == level).select(*keys, F.col("idx").alias(f"__i{x}"), F.coalesce("trend", F.lit(0.0)).alias(f"__d{x}"))
    g = part("group", ["category", "grp", "t"], "g")
    if more is not None:
        unseen = more.select("category", "grp").distinct().join(g.select("category", "grp").distinct(), ["category", "grp"], "left_anti")
        g = g.unionByName(unseen.join(F.broadcast(levels.agg(F.max("t").alias("t")))).withColumns({"__ig": F.lit(0.0), "__dg": F.lit(0.0)}))
    g = g.join(part("category", ["category", "t"], "c"), ["category", "t"]).join(part("market", ["t"], "m"), "t")
    g = g.withColumn("__n", F.col("t") - F.min("t").over(Window.partitionBy("category", "grp")))
    if curve is not None and released is not None:
        g = g.join(released.select("category", "grp", (F.col("released")).alias("__released")), ["category", "grp"], "left").withColumn("age", F.col("t") - F.col("__released"))
        for k, h in enumerate(horizons):
            ages = cohort_return(curve, g.where("age >= 0").select("age").distinct(), h).select("age", F.col("cohort_return").alias(f"__c{k}"))
            g = g.join(ages, "age", "left")

    def delta(k: int, h: int) -> Column:
        own, w = damped_delta(F.col("__dg"), F.lit(h)), F.col("__n") / (F.col("__n") + 12.0)
        cohort = clamp(F.coalesce(f"__c{k}", F.lit(0.0)), -CAP, CAP) if curve is not None and released is not None else F.lit(0.0)
        return damped_delta(F.col("__dm"), F.lit(h)) + damped_delta(F.col("__dc"), F.lit(h)) + w * own + (1 - w) * cohort

    return g.select("category", "grp", "t", (F.col("__im") + F.col("__ic") + F.col("__ig")).alias("level"), F.array(*[delta(k, h) for k, h in enumerate(horizons)]).alias("deltas"))


#: What a forecast row carries besides its keys and quantiles.
PACKET = {"horizon": "int", "tier": "string", "bucket": "string", "n": "bigint", "origin": "int", "price": "double", "anchor": "double", "saturated": "boolean"}


def trajectory_forecast(
    panel: DataFrame,
    keys: list[str],
    index: DataFrame,
    horizons: Sequence[int] = (4, 9, 13),
    step_days: int = 7,
    weights: dict[int, tuple[float, float, float]] | None = None,
    min_origin: int = 15,
    lookback: int = 13,
    curve: DataFrame | None = None,
    released: DataFrame | None = None,
    hedonic: DataFrame | None = None,
) -> DataFrame:
    """(keys, horizon, tier, bucket, n, origin, price, anchor, saturated, q10..q90) of every series from its last known price; horizons are in steps.

    panel: category, grp, product, t, price; index: the result of index_levels. A price less the three index levels is the series' own
    part: its steps are smoothed and shrunk to a drift, its trailing median less its value is the reversion. The middle is anchor + a index move + c
    reversion + b drift h, with weights (a, c, b) by horizon. Bands are quantiles of residuals of the same rule at up to five earlier
    origins (what it then knew against what came), in units of the series' spread, pooled by category, spread tercile and horizon.

    hedonic: keys and hedonic_log. The anchor of a series with little history is moved towards it (anchor, and saturated where it
    wanted to move further than it may). Keys that were never priced are cold starts: they stand at the hedonic price on the
    last date, without drift or reversion, in the widest band of their category (spread times the typical spread of its bucket), widened. A key of a category
    without index has no row. An empty panel gives none; a null hedonic_log counts as none.

    A series is brought together once; smoothing, drift, reversion and spread are windows over its dates.
    """
    horizons = list(horizons)
    if hedonic is not None:
        hedonic = hedonic.where("hedonic_log is not null").select(*keys, "hedonic_log")
    context = settled(index_context(settled(index), horizons, curve, released, hedonic))
    priced = panel.where("price > 0")
    ends = priced.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if ends["lo"] is None:
        return panel.select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in (*PACKET.items(), *((q, "double") for q in QUANTILES))]).where("false")
    w, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    near = w.rangeBetween(-(lookback - 1), 0)
    x = priced.join(context, ["category", "grp", "t"]).select(*keys, "t", F.log("price").alias("y"), (F.log("price") - F.col("level")).alias("own"), "deltas")
    x = x.withColumn("r", (F.col("own") - F.lag("own").over(w)) / (F.col("t") - F.lag("t").over(w)))
    x = smoothed(x, keys, "t", "r", ALPHA, "ses")
    x = x.withColumns({"n": F.count("r").over(whole), "last": F.max("t").over(whole), "centre": F.percentile("r", 0.5).over(whole), "near": F.when(F.count("own").over(near) >= 2, F.percentile("own", 0.5).over(near) - F.col("own")).otherwise(0.0)})
    x = x.withColumn("mad", F.when(F.col("n") >= 2, 1.4826 * F.percentile(F.abs(F.col("r") - F.col("centre")), 0.5).over(whole)))
    drift = F.when(F.col("ses_n") > 0, F.col("ses") * F.col("ses_n") / (F.col("ses_n") + 8.0)).otherwise(0.0)
    origins = {h: walk_forward_origins(ends["lo"] + min_origin, ends["hi"], h) for h in horizons}

    def step(k: int, h: int) -> Column:
        """The middle from here on, by what is known here; and, at an origin, what came of it in units of the spread."""
        a, c, b = (weights or {}).get(h, (1.0, 0.0, 1.0))
        middle = F.col("y") + a * F.get("deltas", F.lit(k)) + c * F.col("near") + b * h * drift
        came = F.max("y").over(w.rangeBetween(h, h))
        known = F.col("t").isin(origins[h]) if origins[h] else F.lit(False)
        return F.struct(F.lit(h).alias("horizon"), middle.alias("y"), F.when(known, (came - middle) / F.greatest("mad", F.lit(MAD_FLOOR))).alias("standardized"))

    wanted = sorted({o for own in origins.values() for o in own})
    x = x.withColumn("steps", F.array(*[step(k, h) for k, h in enumerate(horizons)]))
    # the only pass over the points: one shuffle by series, all windows on its order; what follows works on a few rows of each series
    kept = settled(x.where((F.col("t") == F.col("last")) | F.col("t").isin(wanted) if wanted else F.col("t") == F.col("last")).select(*keys, "t", "last", "y", "mad", "n", "steps"))
    pool_keys = ["category", "bucket", "horizon"]
    found = settled(tercile_bucket(kept.where("t = last").select(*keys, "y", "mad", "n", "last", F.col("steps").alias("middles")), ["category"], "mad", few=True))
    # read for the counts, the cells and the ranks
    pooled = settled(join_same(kept.where("mad is not null").select(*keys, F.explode("steps").alias("x")).where("x.standardized is not null"), found.select(*keys, "bucket"), keys).select("category", "bucket", "x.horizon", "x.standardized"))
    offsets = conformal_offsets(pooled, pool_keys, few=True)
    if hedonic is not None:
        offsets = settled(offsets)
    fallback = trimmed_mean_of_large(found, ["category"], "mad", name="__fallback").select("category", F.greatest("__fallback", F.lit(MAD_FLOOR)).alias("__fallback"))
    out = found.select(*keys, "bucket", "mad", "n", "last", F.col("y").alias("own"), F.explode("middles").alias("m")).select(*keys, "bucket", "mad", "n", "last", "own", "m.horizon", "m.y")
    out = join_same(out, offsets.withColumnsRenamed({q: f"__{q}" for q in QUANTILES}), pool_keys)
    out = join_same(out, fallback, ["category"])
    width = F.when(F.col("mad") >= MAD_FLOOR, F.col("mad")).otherwise(F.coalesce("__fallback", F.lit(MAD_FLOOR)))
    default = {q: (p - 0.5) * 2 for q, p in QUANTILES.items()}
    tier = confidence_tier(F.col("mad"), F.col("n"), (F.lit(ends["hi"]) - F.col("last")) * step_days / 7.0)
    own = F.col("own")
    if hedonic is not None:
        out = join_same(out, hedonic, keys)
        anchor, saturated = hedonic_anchor(own, F.col("hedonic_log"), F.col("n")), anchor_saturated(own, F.col("hedonic_log"), F.col("n"))
    else:
        anchor, saturated = own, F.lit(False)
    facts = {"horizon": F.col("horizon"), "tier": tier, "bucket": F.col("bucket"), "n": F.col("n"), "origin": F.col("last"), "price": F.exp(own), "anchor": F.exp(anchor), "saturated": saturated}
    served = out.select(*keys, *[facts[c].cast(t).alias(c) for c, t in PACKET.items()], *[F.exp(F.col("y") + (anchor - own) + F.coalesce(f"__{q}", F.lit(default[q])) * width).alias(q) for q in QUANTILES])
    if hedonic is None:
        return served
    cold = hedonic.join(found.select(*keys), keys, "left_anti")
    return served.unionByName(_cold_starts(cold, keys, horizons, weights or {}, context.where(F.col("t") == ends["hi"]), found, offsets, fallback, ends["hi"]))


def _cold_starts(cold: DataFrame, keys: list[str], horizons: list[int], weights: dict[int, tuple[float, float, float]], context: DataFrame, found: DataFrame, offsets: DataFrame, fallback: DataFrame, last: int) -> DataFrame:
    """Rows of keys that were never priced: the hedonic price moved with the index, in the widest band of the category."""
    typical = quantile_of_large(found, ["category", "bucket"], "mad", {"__typical": 0.5}, few=True).withColumn("__typical", F.greatest("__typical", F.lit(MAD_FLOOR)))
    spread = F.greatest(*QUANTILES) - F.least(*QUANTILES)
    pools = join_same(join_same(offsets, typical, ["category", "bucket"]), fallback, ["category"]).withColumn("__scale", F.coalesce("__typical", "__fallback", F.lit(MAD_FLOOR)))
    widest = pools.groupBy("category", "horizon").agg(F.max_by(F.struct(*[F.col(q).alias(f"__{q}") for q in QUANTILES], "__scale"), F.struct(spread * F.col("__scale"), "bucket")).alias("__w"))
    moves = F.explode(F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("h"), F.col("deltas").alias("d")))
    rows = cold.join(context.select("category", "grp", "deltas"), ["category", "grp"]).select(*keys, "hedonic_log", moves.alias("m")).select(*keys, "hedonic_log", F.col("m.h").alias("horizon"), F.col("m.d").alias("move"))
    rows = join_same(join_same(rows, widest, ["category", "horizon"]), fallback, ["category"])
    a = F.lit(1.0)
    for h, (share, _, _) in weights.items():
        a = F.when(F.col("horizon") == h, share).otherwise(a)
    scale = F.coalesce("__w.__scale", "__fallback", F.lit(MAD_FLOOR)) * COLD_WIDEN
    facts = {"horizon": F.col("horizon"), "tier": F.lit("cold-start"), "bucket": F.lit("unknown"), "n": F.lit(0), "origin": F.lit(last), "price": F.lit(None), "anchor": F.exp("hedonic_log"), "saturated": F.lit(False)}
    band = {q: F.coalesce(f"__w.__{q}", F.lit((p - 0.5) * 2)) for q, p in QUANTILES.items()}
    return rows.select(*keys, *[facts[c].cast(t).alias(c) for c, t in PACKET.items()], *[F.exp(F.col("hedonic_log") + a * F.col("move") + band[q] * scale).alias(q) for q in QUANTILES])


def forecast_packets(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each series of trajectory_forecast: its facts, `horizons` (horizon, q10..q90, in order) and `path`, which has the anchor at the
    origin and the middle at each horizon and nothing in between."""
    by_series = [c for c in PACKET if c != "horizon"]
    g = forecasts.groupBy(*keys, *by_series).agg(F.array_sort(F.collect_list(F.struct("horizon", *QUANTILES))).alias("horizons"))
    first = F.array(F.struct(F.col("origin").alias("t"), F.col("anchor").alias("price")))
    return g.withColumn("path", F.concat(first, F.transform("horizons", lambda x: F.struct((F.col("origin") + x["horizon"]).alias("t"), x["q50"].alias("price")))))


def origin_blocks(df: DataFrame, at: str, train: float = 0.6, embargo: int = 1) -> DataFrame:
    """df with block: train, embargo or holdout by whole origins. The ranks are over the distinct origins only."""
    origins = df.select(at).distinct()
    n = origins.agg(F.count("*").alias("n"))
    ranked = origins.withColumn("r", F.row_number().over(Window.orderBy(at))).join(F.broadcast(n))
    cut = F.floor(F.col("n") * train)
    block = F.when(F.col("r") <= cut, "train").when(F.col("r") <= cut + embargo, "embargo").otherwise("holdout")
    return df.join(F.broadcast(ranked.select(at, block.alias("block"))), at)


def origin_parts(df: DataFrame, by: Sequence[str], at: str, embargo_days: Column | int = 0, share: float = 0.25, parts: Sequence[str] = ("train", "validate", "calibrate")) -> DataFrame:
    """df with part: whole origins in order, of each group the last floor(n share) of its n distinct ones the last part, as many before it the next, and so on.

    A later part has one origin at least and leaves one to the first. An origin less than embargo_days before the next part is `embargo`, so that no label of one
    part matures inside the next. A group of fewer origins than parts is all train. The ranks are over distinct origins only.
    """
    by, k = list(by), len(parts)
    w = Window.partitionBy(*by)
    o = df.where(F.col(at).isNotNull()).select(*by, at).distinct()
    o = o.withColumns({"__r": F.row_number().over(w.orderBy(at)), "__n": F.count("*").over(w)})
    each = F.least(F.greatest(F.lit(1), F.floor(F.col("__n") * share)), F.greatest(F.lit(1), F.floor((F.col("__n") - 1) / (k - 1))))
    place = F.when((F.col("__n") < k) | (F.col("__r") <= F.col("__n") - each * (k - 1)), 0).otherwise(k - 1 - F.floor((F.col("__n") - F.col("__r")) / each)).cast("int")
    o = o.withColumn("__p", place)
    day = F.datediff(F.to_date(at), F.lit("1970-01-01")) if dict(df.dtypes)[at] in ("date", "timestamp") else F.col(at)
    o = o.withColumn("__day", day)
    # the first origin of the next part: the least of those beyond the rows of this part
    o = o.withColumn("__next", F.min("__day").over(w.orderBy("__p").rangeBetween(1, 1)))
    gap = F.lit(embargo_days) if isinstance(embargo_days, int) else embargo_days
    near = F.coalesce((gap > 0) & (F.col("__day") >= F.col("__next") - gap), F.lit(False))
    named = F.when(near, "embargo").otherwise(F.get(F.array(*[F.lit(x) for x in parts]), F.col("__p")))
    return join_same(df, bounded(o.select(*by, at, named.alias("part"))), [*by, at])


def range_only_band(df: DataFrame) -> DataFrame:
    """df with lo and hi: symmetric in log space about the price, as wide as the wider side."""
    radius = F.greatest(F.abs(F.log(F.col("q10") / F.col("price"))), F.abs(F.log(F.col("q90") / F.col("price"))))
    return df.withColumns({"lo": F.col("price") * F.exp(-radius), "hi": F.col("price") * F.exp(radius)})


#: Tiers that claim a direction, kinds that never may, and how far under its list price a sealed product may be served.
DIRECTIONAL_TIERS, UNDIRECTED_KINDS, LIST_PRICE_FLOOR = ("category-validated", "relative-validated"), ("sealed", "unknown"), 0.8


def serve_tiers(packets: DataFrame, eligibility: DataFrame, list_prices: DataFrame) -> DataFrame:
    """packets with served (the tier, or null), withheld (the reason, or null), downgraded and served_q50.

    packets: category, product, confidence, kind (null is unknown), saturated, price, horizon, q50. eligibility: category, confidence, horizon, tier for what
    may be served. list_prices: product, list_price, in_print. In order: a saturated anchor withholds; then no eligibility; cold starts
    are attribute-reference, other cohorts than standard range-only; sealed and unknown products lose a directional tier; a
    sealed product in print is withheld under the floor of its list price, and never lifted.
    """
    kind = F.coalesce("kind", F.lit("unknown"))
    j = packets.join(eligibility.select("category", "confidence", "horizon", F.col("tier").alias("__tier"), F.lit(True).alias("__may")), ["category", "confidence", "horizon"], "left")
    j = j.join(list_prices.select("product", F.col("list_price").alias("__list"), F.col("in_print").alias("__print")), "product", "left")
    known = F.col("__tier").isin(*DIRECTIONAL_TIERS, "range-only", "attribute-reference")
    earned = F.when(F.col("confidence") == "cold-start", "attribute-reference").when(F.col("confidence") != "standard", "range-only").when(known, F.col("__tier")).otherwise("range-only")
    j = j.withColumn("__earned", earned).withColumn("downgraded", kind.isin(*UNDIRECTED_KINDS) & F.col("__earned").isin(*DIRECTIONAL_TIERS))
    j = j.withColumn("__served", F.when(F.col("downgraded"), "range-only").otherwise(F.col("__earned")))
    j = j.withColumn("served_q50", F.when(F.col("__served") == "range-only", F.coalesce("price", "q50")).otherwise(F.col("q50")))
    low = (kind == "sealed") & F.coalesce("__print", F.lit(False)) & (F.col("served_q50") < LIST_PRICE_FLOOR * F.col("__list"))
    withheld = F.when(F.coalesce("saturated", F.lit(False)), "anchor_clamp_saturated").when(F.col("__may").isNull(), "no_eligible_cohort").when(low, "below_list_price_floor")
    j = j.withColumn("withheld", withheld)
    return j.withColumns({"served": F.when(F.col("withheld").isNull(), F.col("__served")), "downgraded": F.coalesce(F.col("downgraded") & (F.coalesce("withheld", F.lit("")).isin("", "below_list_price_floor")), F.lit(False))}).drop("__tier", "__may", "__list", "__print", "__earned", "__served")


def serve_counters(served: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, n): how many rows were served by tier, withheld by reason, and downgraded by kind."""
    names = F.array_compact(F.array(F.concat(F.lit("served:"), "served"), F.concat(F.lit("withheld:"), "withheld"), F.when(F.col("downgraded"), F.concat(F.lit("downgraded:"), F.coalesce("kind", F.lit("unknown"))))))
    return served.select(*by, F.explode(names).alias("name")).groupBy(*by, "name").agg(F.count("*").alias("n"))


#: Quantiles of the cone, and the most that a year's volatility may be.
CONE_Z, MOST_VOLATILITY = {"q10": -1.533, "q25": -0.741, "q50": 0.0, "q75": 0.741, "q90": 1.533}, 1.791759469228055 / (2 * 1.533)


def volatility_cone(points: DataFrame, keys: list[str], day: str, price: str, horizon_days: int, as_of: Column, prior_volatility: float = 0.025, prior_drift: float = 0.0, trust: float = 1.0) -> DataFrame:
    """(keys, price, n, excluded, drift, volatility, q10..q90, confidence, status): a scenario of each series from its own past values.

    Changes beyond 4 max(prior, 0.06) a root day are jumps and left out. Drift (half-life 180 days) is shrunk by the span of the
    series against 730 days, variance (60 days) by n / (n + 10) against the prior; both are clamped. trust scales the confidence of a source.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    gap = F.datediff(day, F.lag(day).over(w))
    s = points.where(F.col(day) <= as_of).select(*keys, day, price, gap.alias("g"), F.log(F.col(price) / F.lag(price).over(w)).alias("r"))
    jump = F.abs("r") / F.sqrt("g") > 4 * max(prior_volatility, 0.06)
    kept = (F.col("g") > 0) & ~jump
    age = F.datediff(as_of, day)
    wd, wv = F.pow(F.lit(0.5), age / 180), F.pow(F.lit(0.5), age / 60)
    z = F.col("r") / F.sqrt("g")
    g = s.groupBy(*keys).agg(
        F.max_by(price, day).alias("price"),
        F.count("*").alias("n"),
        F.count_if((F.col("g") > 0) & jump).alias("excluded"),
        F.count_if(kept).alias("__pairs"),
        F.datediff(F.max(day), F.min(day)).alias("__span"),
        F.datediff(as_of, F.max(day)).alias("__stale"),
        (F.sum(F.when(kept, wd * F.col("r") / F.col("g"))) / F.sum(F.when(kept, wd))).alias("__d"),
        (F.sum(F.when(kept, wv * z)) / F.sum(F.when(kept, wv))).alias("__m"),
        (F.sum(F.when(kept, wv * z * z)) / F.sum(F.when(kept, wv))).alias("__m2"),
    )
    own_variance = F.when(F.col("__pairs") > 1, F.greatest(F.lit(0.0), F.col("__m2") - F.col("__m") * F.col("__m"))).otherwise(prior_volatility**2)
    drift_share, share = F.col("__span") / (F.col("__span") + 730), F.col("__pairs") / (F.col("__pairs") + 10)
    g = g.withColumns({"drift": drift_share * F.coalesce("__d", F.lit(0.0)) + (1 - drift_share) * prior_drift, "volatility": clamp(F.sqrt(share * own_variance + (1 - share) * prior_volatility**2), 0.015, 0.06)})
    most = 0.69 * horizon_days / 365
    move = clamp(F.col("drift") * horizon_days, -most, most)
    spread = F.least(F.col("volatility") * horizon_days**0.5, F.lit(MOST_VOLATILITY * (horizon_days / 365) ** 0.5))
    score = F.least(F.lit(0.75), F.col("n") / (F.col("n") + 20) * F.exp(-F.col("__stale") / 90) * trust)
    n = F.col("n")
    label = F.when((n < 3) | (score < 0.15), "early").when((n < 8) | (score < 0.35), "low").when((n < 21) | (score < 0.55), "developing").otherwise("moderate")
    status = F.when(F.col("__stale") > 180, "stale").when(n < 3, "early").when(n < 8, "limited").otherwise("available")
    fresh = F.col("__stale") <= 180
    bands = [F.when(fresh, F.col("price") * F.exp(move + z * spread)).alias(q) for q, z in CONE_Z.items()]
    return g.select(*keys, "price", "n", "excluded", "drift", "volatility", *bands, label.alias("confidence"), status.alias("status"))


def walk_forward_origins(first: int, last: int, horizon: int, most: int = 5, apart: bool = False) -> list[int]:
    """Origins whose horizon ends by `last`: up to `most` evenly spaced ones from `first` on (calibration), or, with `apart`, every
    first + k horizon, so that no two horizons overlap (evaluation)."""
    end = last - horizon
    if end < first:
        return []
    if apart:
        return list(range(first, end + 1, horizon))
    n = min(most, end - first + 1)
    return sorted({first + round(i * (end - first) / max(1, n - 1)) for i in range(n)})
