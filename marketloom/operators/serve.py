"""What is shown of forecasts: availability, lookups, tiers, comparisons, lists; and the end-to-end walks that feed them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import market_identity, natural_key, product_format, product_kind, query_norm, set_family, text_similarity
from marketloom.operators import evaluate, forecast, lab
from marketloom.operators.stats import join_same, leave_one_out_quantile, quantile_of_large
from marketloom.sources.io import settled


def series_forecast_lookup(items: DataFrame, packets: DataFrame, value: str) -> DataFrame:
    """items (item, product, subtype) with the packet of the exact subtype, else the product's only packet, else none."""
    exact = packets.select("product", "subtype", F.col(value).alias("__exact"))
    only = packets.groupBy("product").agg(F.when(F.count("*") == 1, F.first(value)).alias("__only"))
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__only").isNotNull(), "only").otherwise("none")
    return items.join(exact, ["product", "subtype"], "left").join(only, "product", "left").select("item", F.coalesce("__exact", "__only").alias(value), how.alias("how"))


def forecast_availability(holdings: DataFrame, publications: DataFrame, least_tier: int = 4) -> DataFrame:
    """holdings (id, series, currency, manual) with the first reason that holds, or available.

    publications: series, pub_currency, tier, limited.
    """
    j = holdings.join(publications.withColumn("__there", F.lit(True)), "series", "left")
    state = (
        F.when(F.col("series").isNull(), "unmatched")
        .when(F.col("manual"), "manual")
        .when(F.col("__there").isNull(), "no_publication")
        .when(F.col("currency") != F.col("pub_currency"), "currency_differs")
        .when(F.col("tier") < least_tier, "tier_too_low")
        .when(F.col("limited"), "limited")
        .otherwise("available")
    )
    return j.select("id", state.alias("availability"))


def exact_availability(holdings: DataFrame, publications: DataFrame, horizon: int, identity: Sequence[str], currency: str, enabled: bool = True, least_tier: int = 4) -> DataFrame:
    """(id, availability, horizons) of holdings (id, variant, manual, identity columns) at a horizon: the first reason that holds, limited, or available.

    publications: variant, pub_currency, tier, limited, horizons (array of days), and the identity columns; the one whose identity is the
    holding's own, all fields present, is taken. Where none is, the reason tells a field that is missing on the holding's side, or in every publication, from one that
    differs. horizons lists what the taken publication offers.
    """
    own = holdings.select("id", "variant", "manual", *identity)
    pub = publications.select(F.col("variant").alias("__v"), *[F.col(c).alias(f"__{c}") for c in identity], "pub_currency", "tier", "limited", F.array_sort("horizons").alias("horizons"))
    same = F.col("variant") == F.col("__v")
    for c in identity:
        same = same & (F.col(c) == F.col(f"__{c}"))
    there = publications.groupBy(F.col("variant").alias("__w")).agg(F.count("*").alias("__n"), *[F.count(c).alias(f"__n_{c}") for c in identity])
    j = own.join(pub, same, "left").join(there, F.col("variant") == F.col("__w"), "left")
    lacking = F.exists(F.array(*[F.col(c).isNull() | (F.coalesce(F.col(f"__n_{c}"), F.lit(0)) == 0) for c in identity]), lambda x: x)
    state = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("variant").isNull(), "unmatched")
        .when(F.col("manual"), "manual")
        .when(F.col("__n").isNull(), "no_publication")
        .when(F.col("__v").isNull() & lacking, "identity_incomplete")
        .when(F.col("__v").isNull(), "identity_differs")
        .when(F.col("pub_currency") != currency, "currency_differs")
        .when((F.col("tier") < least_tier) | (F.size("horizons") == 0), F.when(F.col("tier") < 2, "history_too_limited").otherwise("tier_too_low"))
        .when(~F.array_contains("horizons", horizon), "horizon_not_published")
        .when(F.col("limited"), "limited")
        .otherwise("available")
    )
    return j.select("id", state.alias("availability"), F.coalesce("horizons", F.expr("cast(array() as array<int>)")).alias("horizons"))


#: Labels of a confidence by the value from which they hold; none is `unknown`.
CONFIDENCE_LABELS = ((float("-inf"), "insufficient"), (20, "low"), (40, "medium-low"), (60, "medium"), (80, "high"))


def comparison_confidence(selection: DataFrame, metrics: DataFrame, key: str, confidences: Sequence[str], labels: Sequence[tuple[float, str]] = CONFIDENCE_LABELS, none: str = "unknown") -> DataFrame:
    """(comparison, slot, key, confidence, label, confidence_differs): the least confidence that a slot's metrics have, its label (the last of `labels`, as
    (from, label) in order, that it reaches), and whether a comparison of several slots has more than one label."""
    least = F.array_min(F.array_compact(F.array(*[F.col(c).cast("double") for c in confidences])))
    label = F.lit(none)
    for bound, name in labels:
        label = F.when(F.col("confidence") >= bound, name).otherwise(label)
    j = selection.join(metrics, key).withColumn("confidence", least).withColumn("label", F.when(F.col("confidence").isNull(), none).otherwise(label))
    w = Window.partitionBy("comparison")
    differs = (F.count("*").over(w) > 1) & (F.size(F.collect_set("label").over(w)) > 1)
    return j.select("comparison", "slot", key, "confidence", "label", differs.alias("confidence_differs"))


def collection_freshness(holdings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, known, stale, latest_age, latest_state) of holdings (keys, manual, state, age_days): those without a manual value and with a known age."""
    known = ~F.coalesce(F.col("manual"), F.lit(False)) & F.col("age_days").isNotNull()
    g = holdings.groupBy(*keys).agg(F.count_if(known).alias("known"), F.count_if(known & (F.col("state") == "stale")).alias("stale"), F.min(F.when(known, F.struct("age_days", "state"))).alias("__l"))
    return g.select(*keys, "known", "stale", F.col("__l.age_days").alias("latest_age"), F.coalesce("__l.state", F.lit("unknown")).alias("latest_state"))


def support_tier_projection(df: DataFrame, columns: dict[str, int], tier: str = "tier") -> DataFrame:
    """df with each column null below the tier from which it is shown."""
    return df.withColumns({c: F.when(F.col(tier) >= t, F.col(c)) for c, t in columns.items()})


def comparison(selection: DataFrame, metrics: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """selection (slot, key) with metrics side by side, and each value's difference from the first slot's."""
    j = selection.join(metrics, key, "left")
    w = Window.partitionBy("comparison").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return j.select("comparison", "slot", key, *values, *[(F.col(v) - F.first(v).over(w)).alias(f"{v}_difference") for v in values])


def published_scorecards(cards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of tier 5 cards, the newest for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("published"), F.desc("card"))
    return cards.where("tier = 5").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def alert_list(alerts: DataFrame, watch: DataFrame, show: str = "all") -> DataFrame:
    """Alerts joined to their watch entry, newest first by (at, id): all, unread or muted."""
    keep = {"all": F.lit(True), "unread": ~F.col("read"), "muted": F.col("muted")}[show]
    return alerts.join(watch, "key", "left").where(keep).withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("at"), "id")))


def sort_holdings(h: DataFrame, owner: str, order: str) -> DataFrame:
    """h with place: its rank for the owner by value, gain, name or date, missing last, ties by id."""
    by = {"value": F.desc_nulls_last("value"), "gain": F.desc_nulls_last("gain"), "date": F.desc_nulls_last("bought_on"), "name": F.asc_nulls_last("name")}[order]
    return h.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(by, "id")))


#: Days that each nominal horizon really spans, and the tiers of evidence.
ACTUAL_DAYS = {30: 28, 60: 63, 90: 91}
EVIDENCE = ("category-validated", "relative-validated", "range-only", "attribute-reference")


def ordered_quantile_guard(bands: DataFrame) -> DataFrame:
    """bands (q10..q90, horizon, horizon_days_actual, tier) with rejected: why a band is not shown, or null. Nothing is repaired."""
    qs = ("q10", "q25", "q50", "q75", "q90")
    wrong = F.lit(False)
    for q in qs:
        wrong = wrong | F.coalesce(~(F.col(q) >= 0) | F.isnan(q) | (F.col(q) == float("inf")), F.lit(True))
    crossing = F.lit(False)
    for a, b in zip(qs, qs[1:], strict=False):
        crossing = crossing | (F.col(b) < F.col(a))
    expected = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTUAL_DAYS.items() for x in kv]), F.col("horizon").cast("int"))
    days = F.col("horizon_days_actual")
    rejected = (
        F.when(wrong, "quantile_missing_or_negative")
        .when(F.col("q50") <= 0, "median_not_positive")
        .when(crossing, "quantiles_cross")
        .when((F.coalesce("tier", F.lit("")) != "") & ~F.col("tier").isin(*EVIDENCE), "unknown_tier")
        .when(days <= 0, "days_not_positive")
        .when(days != expected, "days_differ_from_horizon")
    )
    return bands.withColumn("rejected", rejected)


def list_sets(sets: DataFrame, owner: str, query: str = "", category: str = "all", sort: str = "recent-desc") -> DataFrame:
    """sets (owner, set_name, game, category, latest_updated, printings, priced, value) that fit, with their place for the owner by recent-desc, alpha, printings-desc or
    value-desc; sets without a priced holding come last by value."""
    text = query_norm(F.concat_ws(" ", "set_name", "game", "category"))
    q = " ".join(query.lower().split())
    fits = text.contains(q) if q else F.lit(True)
    if category != "all":
        fits = fits & (market_identity(F.col("category")) == category)
    name = [natural_key(F.col("set_name")), F.col("game")]
    by = {
        "alpha": name,
        "printings-desc": [F.desc("printings"), *name],
        "value-desc": [(F.col("priced") == 0), F.desc("value"), *name],
    }.get(sort, [F.desc("latest_updated"), *name])
    return sets.where(fits).withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*by)))


def union_codes(*codes: Column) -> Column:
    """The distinct codes of several arrays, sorted; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, empty) for c in codes]))))


def watch_dedupe(watch: DataFrame, holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Watch entries that no holding stands for."""
    return watch.join(holdings.select(*keys), keys, "left_anti")


def evidence_score(df: DataFrame, title: Column, query: Column, number_hit: Column, visual: Column) -> DataFrame:
    """df with evidence: similarity of title and picture, and the exact number, as one score of at most 1."""
    return df.withColumn("evidence", F.least(F.lit(1.0), 0.55 * text_similarity(title, query) + 0.25 * F.coalesce(visual, F.lit(0.0)) + F.when(number_hit, 0.2).otherwise(0.0)))


def settled_union(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union by name of the sources that could be read, reasons of the others). Reading is tried by schema only."""
    out, failed = None, {}
    for name, read in readers.items():
        try:
            df = read()
            df.schema  # noqa: B018  resolves the source
        except Exception as e:  # noqa: BLE001  a source that fails is reported, not raised
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def prospective_universe(series: DataFrame, obs: DataFrame, cutoff: Column, fresh_days: int, key: str = "series") -> DataFrame:
    """Approved series with an accepted observation known at the cutoff and not older than fresh_days."""
    fresh = obs.where((F.col("available_at") <= cutoff) & (F.col("observed_at") >= cutoff - F.make_dt_interval(F.lit(fresh_days))))
    return series.where("approved").join(fresh.select(key).distinct(), key, "left_semi")


def hedonic_features(products: DataFrame, groups: DataFrame) -> DataFrame:
    """products (product, grp, name, number, rarity, has_meta, price) with family, kind, format, peers' median price and group size.

    groups: grp, set_name, supplemental.
    """
    p = products.join(groups, "grp", "left").withColumns({"kind": product_kind(F.col("number"), F.col("rarity"), F.col("has_meta")), "family": set_family(F.col("set_name"), F.col("supplemental"))})
    p = p.withColumn("format", product_format(F.col("name"), F.col("kind"))).withColumn("log_price", F.log("price"))
    peers = leave_one_out_quantile(p, ["grp"], "product", "log_price", 0.5).select("product", F.col("others").alias("peer_median"))
    size = p.groupBy("grp").agg((-F.log(F.count("*"))).alias("neg_log_size"))
    return p.join(peers, "product", "left").join(size, "grp").select("product", "grp", "family", "kind", "format", "log_price", "peer_median", "neg_log_size")


def cold_start_forecast(catalog: DataFrame, priced: DataFrame, hedonic: DataFrame, offsets: DataFrame, widen: float = 1.75) -> DataFrame:
    """(product, q10..q90) for products that were never priced: the hedonic log price with the category's widest band.

    hedonic: product, hedonic_log; offsets: category, bucket, q10..q90, mad. The widest pool is that of the largest spread times its own MAD.
    """
    qs = list(forecast.QUANTILES)
    widest = offsets.groupBy("category").agg(F.max_by(F.struct(*qs, "mad"), (F.col("q90") - F.col("q10")) * F.col("mad")).alias("w"))
    new = catalog.join(priced.select("product").distinct(), "product", "left_anti").join(hedonic, "product").join(widest, "category")
    return new.select("product", "category", *[F.exp(F.col("hedonic_log") + F.col(f"w.{q}") * F.col("w.mad") * widen).alias(q) for q in qs])


def after_cost_scorecard(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, brier, calibration_error, selected, positive_rate, median_roi) of cases with probability, roi and selected."""
    y = F.col("roi") > 0
    base = cases.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.pow(F.col("probability") - y.cast("double"), 2)).alias("brier"),
        F.count_if(F.col("selected")).alias("selected"),
        F.avg(F.when(F.col("selected"), y.cast("double"))).alias("positive_rate"),
    )
    base = join_same(base, quantile_of_large(cases, by, F.when(F.col("selected"), F.col("roi")), {"median_roi": 0.5}), by)
    return base.join(evaluate.calibration_error(cases, by, "probability", y), list(by))


def forecast_status_history(df: DataFrame, now: Column) -> DataFrame:
    """df (id, matures, realized) once for each id with status matured, awaiting or open."""
    status = F.when(F.col("realized").isNotNull() & (F.col("matures") <= now), "matured").when(F.col("matures") <= now, "awaiting").otherwise("open")
    rest = [c for c in df.columns if c != "id"]
    one = df.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.col("realized").isNotNull(), F.col("matures"))).alias("w")).select("id", *[F.col(f"w.{c}").alias(c) for c in rest])
    return one.withColumn("status", status)


def descriptive_candidate(snapshots: DataFrame) -> DataFrame:
    """snapshots with the drivers of their state and the reasons against it, as arrays of codes."""
    drivers = F.array_compact(F.array(F.when(F.col("slope_90d") > 0, "rising"), F.when(F.col("slope_90d") < 0, "falling"), F.when(F.col("acceleration") > 0, "accelerating"), F.when(F.col("max_drawdown_180d") >= 0.3, "deep_drawdown")))
    against = F.array_compact(F.array(F.when(F.col("density_90d") < 0.5, "sparse_history"), F.when(F.col("staleness_hours") > 168, "stale"), F.when(F.col("source_quality_90d") < 0.5, "weak_source")))
    return snapshots.withColumns({"drivers": drivers, "reasons": against})


def portfolio_cone(holdings: DataFrame, cones: DataFrame, keys: list[str], on: list[str], currency: str) -> DataFrame:
    """Per owner: lower, middle and upper value of the holdings in one currency that have a cone, and how many were left out."""
    j = holdings.join(cones, on, "left")
    ok = (F.col("currency") == currency) & F.col("lo").isNotNull()
    add = lambda c: F.sum(F.when(ok, F.col(c) * F.col("quantity")).otherwise(0.0)).alias(c)
    return j.groupBy(*keys).agg(add("lo"), add("price"), add("hi"), F.count_if(ok).alias("covered"), F.count_if(~ok).alias("left_out"))


def private_trend_and_baseline(obs: DataFrame, origins: DataFrame, keys: list[str], horizons: Sequence[int]) -> DataFrame:
    """(origin, keys, horizon, baseline, log_return, price): each snapshot's baselines at each horizon."""
    s = lab.trend_snapshot(obs, origins, keys).select("origin", *keys, F.col("current_price").alias("price"), F.coalesce("slope_90d", F.lit(0.0)).alias("slope"))
    market = quantile_of_large(s, ["origin"], "slope", {"market_slope": 0.5})
    s = s.join(F.broadcast(market), "origin").withColumns({"cohort": F.lit(0.0), "structural": F.col("price")})
    out = None
    for h in horizons:
        one = forecast.baselines(s, ["origin", *keys], h).withColumn("horizon", F.lit(h))
        out = one if out is None else out.union(one)
    return out
