"""Holdings: value, cost, gain, allocation, concentration, sets and history. No currency is ever converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.asof import carry_forward


def _value() -> Column:
    return F.coalesce(F.col("market_price") * F.greatest(F.lit(0.0), F.col("quantity")), F.lit(0.0))


def _cost() -> Column:
    return F.coalesce(F.col("purchase_price") * F.col("quantity"), F.lit(0.0)) + F.coalesce("fees", F.lit(0.0))


def portfolio_summary(h: DataFrame, keys: list[str], currency: str) -> DataFrame:
    """Per owner: value, cost and gain in one currency, with counts of what was left out and why."""
    m, c = F.col("currency") == currency, F.col("cost_currency") == currency
    priced, costed = F.col("market_price").isNotNull(), F.col("purchase_price").isNotNull()
    both = m & c & priced & costed
    add = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    out = h.groupBy(*keys).agg(
        add(m, _value()).alias("market_value"),
        add(c, _cost()).alias("cost_basis"),
        add(both, _value()).alias("comparable_market_value"),
        add(both, _cost()).alias("comparable_cost_basis"),
        F.count_if(costed).alias("cost_basis_items"),
        F.count_if(both).alias("gain_eligible_items"),
        F.count_if(~both & (~priced | ~costed)).alias("missing_gain_items"),
        F.count_if(~both & priced & costed).alias("excluded_gain_items"),
        F.count_if(~m).alias("excluded_market_items"),
        F.count_if(~c).alias("excluded_cost_items"),
        F.count("*").alias("unique_items"),
        F.sum(F.greatest(F.lit(0.0), F.col("quantity"))).alias("total_quantity"),
    )
    gain = F.col("comparable_market_value") - F.col("comparable_cost_basis")
    return out.withColumn("gain", gain).withColumn("return_percent", F.when(F.col("comparable_cost_basis") > 0, 100 * gain / F.col("comparable_cost_basis")))


def portfolio_allocation(h: DataFrame, keys: list[str], currency: str) -> DataFrame:
    return h.groupBy(*keys, "category").agg(F.sum(F.when(F.col("currency") == currency, _value()).otherwise(0.0)).alias("value"))


def concentration(h: DataFrame, keys: list[str], currency: str) -> DataFrame:
    """Per owner: Herfindahl index, share of the top five, largest holding and a label."""
    v = h.select(*keys, "id", F.when(F.col("currency") == currency, _value()).otherwise(0.0).alias("v")).where("v > 0")
    w = Window.partitionBy(*keys)
    r = v.select(*keys, "id", "v", (F.col("v") / F.sum("v").over(w)).alias("s"), F.row_number().over(w.orderBy(F.desc("v"), "id")).alias("r"))
    out = r.groupBy(*keys).agg(
        F.sum("v").alias("total_value"), F.sum(F.col("s") * F.col("s")).alias("hhi"), F.sum(F.when(F.col("r") <= 5, F.col("s")).otherwise(0.0)).alias("top_five_share"), F.max("s").alias("top_share"), F.min_by("id", "r").alias("top_id")
    )
    return out.withColumn("concentration", F.when((F.col("hhi") >= 0.35) | (F.col("top_share") >= 0.5), "high").when(F.col("hhi") >= 0.2, "moderate").otherwise("spread"))


def portfolio_sets(h: DataFrame, keys: list[str], currency: str) -> DataFrame:
    """Per (owner, category, set): holdings, copies, distinct printings, value, latest update, cover."""
    ok = F.col("currency") == currency
    return h.where(F.col("set_name").isNotNull()).groupBy(*keys, "category", "set_name").agg(
        F.count("*").alias("holdings"),
        F.sum(F.greatest(F.lit(0.0), F.col("quantity"))).alias("copies"),
        F.count_distinct("product").alias("printings"),
        F.sum(F.when(ok, _value()).otherwise(0.0)).alias("value"),
        F.count_if(F.col("market_price").isNotNull() & ok).alias("priced"),
        F.count_if(F.col("market_price").isNull()).alias("unpriced"),
        F.count_if(F.col("market_price").isNotNull() & ~ok).alias("excluded"),
        F.max("updated_on").alias("updated_on"),
        F.min("id").alias("cover"),
    )


def value_breakdown(h: DataFrame, keys: list[str], currency: str) -> DataFrame:
    ok = F.col("currency") == currency
    return h.groupBy(*keys).agg(
        F.count_if(F.col("market_price").isNotNull() & ok).alias("priced"),
        F.count_if(F.col("market_price").isNull()).alias("unpriced"),
        F.count_if(F.col("market_price").isNotNull() & ~ok).alias("excluded"),
        F.sum(F.when(ok, _value()).otherwise(0.0)).alias("priced_value"),
    )


#: What a stated direction moves the market or a category, and an item, and the half width of each volatility label.
DIRECTION_RATE, ITEM_RATE, WIDTHS = {"down": -0.08, "unchanged": 0.0, "up": 0.08}, {"down": -0.12, "unchanged": 0.0, "up": 0.12}, {"low": 0.08, "typical": 0.16, "high": 0.28}


def shock_revalue(h: DataFrame, evidence: DataFrame, horizon_days: int, currency: str, market: str = "unchanged", categories: dict[str, str] | None = None, items: dict[int, str] | None = None, volatility: str = "typical", manual_follows: bool = False) -> DataFrame:
    """(owner, id, value, q10, q25, q50, q75, q90, evidence) of priced holdings in one currency under a stated scenario.

    Directions add up and scale with the root of the horizon over 90 days (2 at most), within -75 % and +150 %; values set by
    hand only follow if `manual_follows`. evidence (id, observations, sources) counts what is known of a holding. h has a boolean column manual.
    """
    scale = min(2.0, (horizon_days / 90) ** 0.5)
    width = min(0.65, WIDTHS[volatility] * scale)
    rate = lambda column, said, rates: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in said.items() for x in (k, rates[v])]), F.col(column)), F.lit(0.0)) if said else F.lit(0.0)
    move = (DIRECTION_RATE[market] + rate("category", categories, DIRECTION_RATE) + rate("id", items, ITEM_RATE)) * scale
    move = F.when(~F.col("manual") | F.lit(manual_follows), F.greatest(F.lit(-0.75), F.least(F.lit(1.5), move))).otherwise(0.0)
    priced = h.where((F.col("currency") == currency) & (F.col("market_price") >= 0) & (F.col("quantity") > 0)).withColumn("value", _value())
    j = priced.withColumn("q50", F.greatest(F.lit(0.0), F.col("value") * (1 + move))).join(evidence, "id", "left")
    seen, sources = F.greatest(F.lit(1), F.coalesce("observations", F.lit(0))), F.greatest(F.lit(1), F.coalesce("sources", F.lit(0)))
    level = F.when((seen >= 8) & (sources >= 2), "strong").when((seen >= 3) & (sources >= 2), "moderate").otherwise("limited")
    side = lambda f: F.greatest(F.lit(0.0), F.col("q50") * f)
    return j.select("owner", "id", "value", side(1 - width).alias("q10"), side(1 - width / 2).alias("q25"), "q50", side(1 + width / 2).alias("q75"), side(1 + width).alias("q90"), level.alias("evidence"))


def scenario_totals(revalued: DataFrame) -> DataFrame:
    """(owner, value, q10..q90, change_percent, strong, moderate, limited): sums of shock_revalue."""
    sums = revalued.groupBy("owner").agg(*[F.sum(c).alias(c) for c in ("value", "q10", "q25", "q50", "q75", "q90")], *[F.count_if(F.col("evidence") == e).alias(e) for e in ("strong", "moderate", "limited")])
    return sums.withColumn("change_percent", F.when(F.col("value") > 0, 100 * (F.col("q50") / F.col("value") - 1)))


def portfolio_value_series(h: DataFrame, history: DataFrame, grid: DataFrame, currency: str) -> DataFrame:
    """(owner, day, value, cost, priced, held, with_history, coverage_percent) of holdings whose price and cost are in one currency.

    A holding whose product has a price on or after its purchase carries the last such price forward, and counts nothing before the
    first; every other holding is flat at its present value. Cost counts from the purchase on. history: product, day, price; grid: the few
    days of the series. coverage_percent is the share of an owner's holdings with a history of their own.
    """
    own = h.where((F.col("currency") == currency) & (F.col("cost_currency") == currency))
    last = history.groupBy("product").agg(F.max("day").alias("__last"))
    own = own.join(last, "product", "left").withColumn("__history", F.coalesce(F.col("__last") >= F.coalesce("bought_on", "__last"), F.lit(False)))
    prices = carry_forward(history.select("product", "day", F.struct("day", "price").alias("__p")), grid, ["product"], "day", "__p")
    keep = ["owner", "__history", "quantity", _value().alias("__flat"), _cost().alias("__cost"), "bought_on"]
    moving = own.where("__history").select("product", *keep).join(prices, "product").drop("product")
    held = F.col("bought_on").isNull() | (F.col("day") >= F.col("bought_on"))
    known = F.when(F.col("bought_on").isNull() | (F.col("__p.day") >= F.col("bought_on")), F.col("__p.price"))
    moving = moving.where(held).select("owner", "day", (known * F.greatest(F.lit(0.0), F.col("quantity"))).alias("__v"), "__cost")
    flat = own.where("not __history").select(*keep).join(F.broadcast(grid.select("day"))).where(held).select("owner", "day", F.col("__flat").alias("__v"), "__cost")
    days = moving.unionByName(flat).groupBy("owner", "day").agg(F.sum(F.coalesce("__v", F.lit(0.0))).alias("value"), F.sum("__cost").alias("cost"), F.count("__v").alias("priced"), F.count("*").alias("held"))
    coverage = own.groupBy("owner").agg(F.count_if("__history").alias("with_history"), F.round(100 * F.count_if("__history") / F.count("*")).cast("long").alias("coverage_percent"))
    return days.join(coverage, "owner")


def forecast_rollup(h: DataFrame, forecasts: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """Per owner: value and quantity-weighted q25, q50 and q75 over holdings whose exact series has an available or limited forecast.

    forecasts: series, observed, q25, q50, q75, status, confidence (null: not disclosed), published, model_updated. Confidence is a span, never an
    average; as_of is the earliest publication, model_updated the latest update.
    """
    j = h.join(forecasts, series, "left")
    ok = F.coalesce(F.col("status").isin("available", "limited"), F.lit(False)) & F.col("observed").isNotNull() & (F.col("quantity") > 0)
    add = lambda c: F.sum(F.when(ok, F.col(c) * F.col("quantity")).otherwise(0.0))
    least, most = F.min(F.when(ok, F.col("confidence"))), F.max(F.when(ok, F.col("confidence")))
    out = j.groupBy(*keys).agg(
        add("observed").alias("approved_value"),
        *[add(q).alias(q) for q in ("q25", "q50", "q75")],
        F.count_if(ok).alias("covered"),
        F.count_if(ok & (F.col("status") == "limited")).alias("limited"),
        F.count("*").alias("held"),
        least.alias("confidence_low"),
        most.alias("confidence_high"),
        F.count_if(ok & F.col("confidence").isNull()).alias("__undisclosed"),
        F.min(F.when(ok, F.col("published"))).alias("as_of"),
        F.max(F.when(ok, F.coalesce("model_updated", "published"))).alias("model_updated"),
    )
    label = F.when(F.col("covered") == 0, "unavailable").when(F.col("__undisclosed") > 0, "varies").when(F.round("confidence_low") == F.round("confidence_high"), "single").otherwise("span")
    return out.withColumn("confidence", label).drop("__undisclosed")


#: The kinds of alerts, in the order in which they are raised.
ALERTS = ("new_catalog_price", "became_unpriced", "price_stale", "target_price", "percent_change", "trend_change", "range_change", "forecast_change")


def alerts(watch: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, alert) for every rule that a watch entry meets against its last baseline.

    watch: key, price, currency, stale, trend, position, signature, fingerprint, target, target_currency, percent, on_trend, on_range, on_forecast; baseline: key and
    the first seven of these. Nothing is raised while fingerprint and staleness are as before; prices are compared in one currency only;
    a target is reached from above, or without a comparable price before.
    """
    names = ("price", "currency", "stale", "trend", "position", "signature", "fingerprint")
    b = baseline.select("key", *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__seen"))
    j = watch.join(b, "key", "left")
    c = F.col
    seen = F.coalesce("__seen", F.lit(False))
    changed = ~seen | ~c("fingerprint").eqNullSafe(c("__fingerprint")) | (F.coalesce("stale", F.lit(False)) != F.coalesce("__stale", F.lit(False)))
    comparable = F.coalesce(c("__price").isNotNull() & (c("__currency") == c("currency")), F.lit(False))
    other = lambda x: (c(f"__{x}") != "") & (c(x) != "") & (c(f"__{x}") != c(x))
    rules = {
        "new_catalog_price": seen & c("__price").isNull() & c("price").isNotNull(),
        "became_unpriced": c("__price").isNotNull() & c("price").isNull(),
        "price_stale": seen & ~F.coalesce("__stale", F.lit(False)) & F.coalesce("stale", F.lit(False)),
        "target_price": (c("target_currency") == c("currency")) & (c("price") <= c("target")) & (~comparable | (c("__price") > c("target"))),
        "percent_change": comparable & (c("__price") > 0) & (c("percent") > 0) & (F.abs(c("price") / c("__price") - 1) * 100 >= c("percent")),
        "trend_change": c("on_trend") & other("trend"),
        "range_change": c("on_range") & other("position"),
        "forecast_change": c("on_forecast") & other("signature"),
    }
    kinds = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in rules.items()]))
    return j.where(changed).select("key", F.explode(kinds).alias("alert"))


def daily_snapshot(h: DataFrame, keys: list[str], day: str, currency: str) -> DataFrame:
    """(keys, day, currency, value, cost, items, quantity): one row for each owner and day; a day that is written again replaces its row
    (merge.merge_snapshots)."""
    s = portfolio_summary(h, [*keys, day], currency)
    return s.select(*keys, day, F.lit(currency).alias("currency"), F.col("market_value").alias("value"), F.col("cost_basis").alias("cost"), F.col("unique_items").alias("items"), F.col("total_quantity").alias("quantity"))
