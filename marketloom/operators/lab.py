"""Trend snapshots, forecast datasets, ensembles, after-cost candidates, rolling weights and structural gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scalars import array_median, clamp, fold_of, freshness_score, ln, log_ratio, normal_cdf, ratio
from marketloom.operators.forecast import origin_parts
from marketloom.operators.market import Z
from marketloom.operators.pit import point_in_time_many
from marketloom.operators.regress import coefficients, predicted
from marketloom.operators.stats import gram_matrix, median_slopes_of_both, model_weights, quantile_of_large
from marketloom.sources.io import bounded, settled

DAY = 86400.0
QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def trend_snapshot(obs: DataFrame, origins: DataFrame, keys: list[str], max_lag_days: float = 3.0, floor: float = 1e-6, least: int = 7, least_quality: float = 0.5) -> DataFrame:
    """One row for each (origin, series): returns, robust slopes, volatility, drawdown, density, quality and state.

    A price of zero has the logarithm minus infinity and counts as such in slopes, steps and drawdown.
    All windows hang on the series' latest point known at the origin. The points of a series at an origin are
    folded as sorted arrays after one shuffle; pairs are taken for no more than 90 days, by median_slope, which bounds what it holds.
    """
    own = ["origin", *keys]
    known = point_in_time_many(obs, origins, keys)
    t = F.unix_micros("observed_at") / 1e6 / DAY
    series = known.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(t.alias("t"), ln(F.col("price")).alias("y"), F.col("quality").alias("q"), F.col("price").cast("double").alias("v")))).alias("p"))
    last = F.try_element_at("p", F.lit(-1))
    series = series.withColumn("last", last).withColumns({f"p{d}": F.expr(f"filter(p, x -> x.t >= last.t - {d})") for d in (30, 90, 180)})

    priced = {d: F.filter(f"p{d}", lambda x: x["y"].isNotNull()) for d in (30, 90)}
    slopes = median_slopes_of_both(F.transform(priced[90], lambda x: x["t"]), F.transform(priced[90], lambda x: x["y"]), F.size(priced[30]))

    def steps(p: str) -> str:
        return f"zip_with(slice({p}, 2, greatest(size({p}) - 1, 0)), slice({p}, 1, greatest(size({p}) - 1, 0)), (b, a) -> (b.y - a.y) / sqrt(b.t - a.t))"

    series = series.withColumn("s", slopes).withColumns({"s30": F.col("s.short"), "s90": F.col("s.whole"), "r90": F.expr(steps("p90")), "r30": F.expr(steps("p30"))})
    series = series.withColumns({"m90": array_median(F.col("r90")), "m30": array_median(F.col("r30"))})
    vol = lambda n: 1.4826 * array_median(F.expr(f"transform(r{n}, x -> abs(x - m{n}))"))
    back = lambda h: F.expr(f"try_element_at(filter(p, x -> x.t <= last.t - {h}), -1)")

    def change(h: int) -> Column:
        ref = back(h)
        return F.when(F.col("last.t") - h - ref["t"] <= max_lag_days, F.col("last.y") - ref["y"])

    drawdown = F.expr("aggregate(p180, struct(cast('-Infinity' as double) as peak, cast(0 as double) as d), (s, x) -> struct(greatest(s.peak, x.y) as peak, greatest(s.d, 1 - exp(x.y - greatest(s.peak, x.y))) as d), s -> s.d)")
    density = F.least(F.lit(1.0), F.expr("size(array_distinct(transform(p90, x -> floor(x.t))))") / (F.floor(F.col("last.t")) - F.floor(F.col("last.t") - 90) + 1))
    out = series.select(
        *own,
        F.col("last.v").alias("current_price"),
        *[change(h).alias(f"return_{h}d") for h in (7, 30, 90, 180, 365)],
        F.col("s30").alias("slope_30d"),
        F.col("s90").alias("slope_90d"),
        (F.col("s30") - F.col("s90")).alias("acceleration"),
        vol(30).alias("volatility_30d"),
        vol(90).alias("volatility_90d"),
        drawdown.alias("max_drawdown_180d"),
        density.alias("density_90d"),
        F.greatest(F.lit(0.0), (F.unix_micros("origin") / 1e6 / DAY - F.col("last.t")) * 24).alias("staleness_hours"),
        array_median(F.expr("transform(p90, x -> x.q)")).alias("source_quality_90d"),
        F.size("p90").alias("observations_90d"),
    )
    out = out.withColumn("evidence_quality", F.least("density_90d", "source_quality_90d", freshness_score(F.col("staleness_hours"))))
    z = F.col("slope_90d") / F.greatest("volatility_90d", F.lit(floor))
    state = (
        F.when(z.isNull() | (F.col("evidence_quality") < least_quality) | (F.col("observations_90d") < least), "insufficient_data")
        .when(z >= 1.5, "strong_rise").when(z >= 0.5, "rise").when(z <= -1.5, "strong_fall").when(z <= -0.5, "fall").otherwise("stable")
    )
    return out.withColumn("slope_z", z).withColumn("state", state)


def forecast_cells(snapshots: DataFrame, realized: DataFrame, keys: list[str], horizons: Sequence[int], as_of: Column, least: int = 7) -> DataFrame:
    """A row for each (series, origin, horizon): feature_abstained, open, unscorable or scored, with the log return of scored ones.

    realized: keys, matures (date), realized.
    """
    c = snapshots.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("matures", F.date_add(F.to_date("origin"), F.col("horizon")))
    j = c.join(realized.select(*keys, "matures", "realized"), [*keys, "matures"], "left")
    state = F.when(F.col("observations_90d") < least, "feature_abstained").when(F.col("matures") > as_of, "open").when(F.col("realized").isNull(), "unscorable").otherwise("scored")
    return j.withColumn("cell", state).withColumn("realized_return", F.when(F.col("cell") == "scored", log_ratio(F.col("realized"), F.col("current_price"))))


def declared_cells(obs: DataFrame, origins: DataFrame, keys: list[str], horizons: Sequence[int]) -> DataFrame:
    """(origin, keys, horizon) of the declared panel: each series of which a point is known at the origin, whether it has a snapshot or not."""
    known = F.when(F.col("observed_at").isNotNull() & F.col("available_at").isNotNull(), F.greatest("observed_at", "available_at"))
    first = obs.groupBy(*keys).agg(F.min(known).alias("__first"))
    own = first.join(F.broadcast(origins.select("origin").distinct()), F.col("__first") <= F.col("origin")).drop("__first")
    return own.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def forecast_examples(snapshots: DataFrame, realized: DataFrame, keys: list[str], horizons: Sequence[int], as_of: Column, least: int = 7) -> DataFrame:
    """(keys, origin, horizon, matures, current_price, realized, cell): the compiled rows. Examples, whose target has matured and has a price, belong to
    scored cells, and targets, which have not matured, to open ones."""
    rows = snapshots.where(F.col("observations_90d") >= least).select(*keys, "origin", "current_price").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    rows = rows.withColumn("matures", F.date_add(F.to_date("origin"), F.col("horizon")))
    labels = realized.where("realized is not null").select(*keys, "matures", "realized")
    examples = rows.where(F.col("matures") <= as_of).join(labels, [*keys, "matures"]).withColumn("cell", F.lit("scored"))
    return examples.unionByName(rows.where(F.col("matures") > as_of).withColumn("cell", F.lit("open")), allowMissingColumns=True)


#: What bars a declared, retrospective panel from promotion, whatever its counts.
PROMOTION_BLOCKERS = ("missing_independently_sealed_input_universe", "retrospective_compilation_not_prospective_evidence")


def coverage_contract(planned: DataFrame, cells: DataFrame, examples: DataFrame, keys: Sequence[str], by: Sequence[str], blockers: Sequence[str] = PROMOTION_BLOCKERS) -> DataFrame:
    """(by, planned, feature_abstained, open, unscorable, scored, reconciled, reasons): declared cells against the ledger of cells and the compiled rows.

    keys name a cell in all three; cells and examples have its state as `cell`, and planned has the columns of `by`. The sides are stacked and meet by key, which is
    their full outer join. Planned are the declared cells, and the states are counted in the ledger, so they add up only if each declared cell
    stands in it once. A scored or open cell has one compiled row of its state, any other has none. Reasons are what breaks the contract, then `blockers`.
    """
    states, carried = ("feature_abstained", "open", "unscorable", "scored"), [c for c in by if c not in keys]
    rows = planned.select(*keys, *carried, F.lit("planned").alias("__side"))
    for side, df in (("cell", cells), ("row", examples)):
        rows = rows.unionByName(df.select(*keys, F.lit(side).alias("__side"), F.col("cell").alias("__state")), allowMissingColumns=True)
    of = lambda side, *state: F.count_if((F.col("__side") == side) & (F.col("__state").isin(*state) if state else F.lit(True)))
    each = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], of("planned").alias("planned"), of("cell").alias("__cells"), of("row").alias("__rows"), *[of("cell", s).alias(s) for s in states], *[of("row", s).alias(f"__{s}") for s in ("open", "scored")])
    problems = {
        "cell_declared_twice": F.col("planned") > 1,
        "declared_cell_missing": (F.col("planned") > 0) & (F.col("__cells") == 0),
        "cell_not_declared": (F.col("planned") == 0) & (F.col("__cells") > 0),
        "cell_repeated": F.col("__cells") > 1,
        "cell_state_unknown": F.col("__cells") > sum((F.col(s) for s in states), F.lit(0)),
        "row_without_its_cell": (F.col("__rows") > F.col("__open") + F.col("__scored")) | (F.col("__open") > F.col("open")) | (F.col("__scored") > F.col("scored")),
        "cell_without_its_row": (F.col("open") > F.col("__open")) | (F.col("scored") > F.col("__scored")),
    }
    out = each.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("planned", *states)], *[F.count_if(p).alias(f"__{c}") for c, p in problems.items()])
    found = F.array_compact(F.array(*[F.when(F.col(f"__{c}") > 0, c) for c in problems]))
    adds_up = F.col("planned") == sum((F.col(s) for s in states), F.lit(0))
    return out.select(*by, "planned", *states, (adds_up & (F.size(found) == 0)).alias("reconciled"), F.concat(found, F.array(*[F.lit(x) for x in blockers])).alias("reasons"))


def fail_closed(contract: DataFrame) -> DataFrame:
    """The contract, or an error that names the first group which does not reconcile, with its reasons."""
    broken = F.raise_error(F.concat(F.lit("coverage does not reconcile: "), F.to_json(F.struct(*contract.columns))))
    return contract.withColumn("planned", F.when(F.col("reconciled"), F.col("planned")).otherwise(broken.cast("long")))


def ensemble_forecast(features: DataFrame, cells: DataFrame, keys: list[str], models: Sequence[str], share: float = 0.25, least: int = 10, sigma_floor: float = 0.03, least_quality: float = 0.5, widen: float = 2.0) -> DataFrame:
    """Quantiles for (origin, series, horizon) from a calibrated mixture of model columns (log returns).

    A label may train an origin if it matured by then. Losses are taken on one block of earlier origins and residual quantiles on a
    later one, a horizon apart (origin_parts). Losses, weights and residual quantiles depend on (origin, horizon)
    only, so they are fitted once for each and joined to the rows; origins are few.
    """
    origins = bounded(features.select(F.col("origin").alias("at"), "horizon").distinct())
    labels = cells.where("cell = 'scored'").select("horizon", F.col("origin").alias("from_origin"), "matures", "realized_return", *models)
    eligible = labels.join(origins, "horizon").where((F.col("from_origin") < F.col("at")) & (F.col("matures") <= F.to_date("at")))
    split = origin_parts(eligible, ["at", "horizon"], "from_origin", F.col("horizon"), share)
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("x")) for m in models]))
    losses = split.where("part = 'validate'").select("at", "horizon", "realized_return", long.alias("m")).groupBy("at", "horizon", "m.model").agg(F.avg(F.abs(F.col("m.x") - F.col("realized_return"))).alias("loss"))
    weights = model_weights(losses, ["at", "horizon"], "model", "loss").groupBy("at", "horizon").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "weight")))).alias("weights"))

    def mixed() -> Column:
        one = F.lit(0.0)
        for m in models:
            one = one + F.coalesce(F.try_element_at("weights", F.lit(m)), F.lit(0.0)) * F.col(m)
        return one

    resid = split.where("part = 'calibrate'").join(weights, ["at", "horizon"]).withColumn("e", F.col("realized_return") - mixed())
    at = ["at", "horizon"]
    cal = resid.groupBy(*at).agg(F.count("*").alias("n")).join(quantile_of_large(resid, at, "e", {f"e_{q}": p for q, p in QUANTILES.items()}), at)
    fitted = features.join(weights.withColumnRenamed("at", "origin"), ["origin", "horizon"], "left").join(cal.withColumnRenamed("at", "origin"), ["origin", "horizon"], "left")
    usable = F.coalesce((F.col("n") >= least) & (F.col("e_q90") > F.col("e_q10")), F.lit(False))
    centre = mixed() + F.coalesce("e_q50", F.lit(0.0))
    sigma = F.greatest(F.lit(sigma_floor), F.coalesce("volatility_90d", F.lit(0.0)) * F.sqrt("horizon"))
    support = clamp((F.coalesce("evidence_quality", F.lit(0.0)) - least_quality) / (1 - least_quality), 0.0, 1.0)
    spread = 1 + (1 - support) * (widen - 1)
    off = lambda q: F.when(usable, F.col(f"e_{q}") - F.col("e_q50")).otherwise(Z[q] * sigma)
    reasons = F.array_compact(F.array(F.when(~usable, "insufficient_calibration_examples"), F.when(F.coalesce("evidence_quality", F.lit(0.0)) < least_quality, "low_evidence_quality"), F.when(support < 1, "evidence_quality_adjusted")))
    status = F.when(F.arrays_overlap("reasons", F.array(F.lit("insufficient_calibration_examples"), F.lit("low_evidence_quality"))), "quarantined").otherwise("research_only")
    out = fitted.select(*keys, "origin", "horizon", "current_price", *[(F.col("current_price") * F.exp(centre * support + off(q) * spread)).alias(q) for q in Z], normal_cdf(centre * support / (sigma * spread)).alias("probability_up"), reasons.alias("reasons"))
    return out.withColumn("status", status)


def watch_candidates(forecasts: DataFrame, costs: DataFrame, keys: list[str], least_probability: float = 0.70) -> DataFrame:
    """forecasts with all-in cost, net returns and gates. costs: keys, price, tax, shipping, fee_rate, exit_fixed."""
    j = forecasts.join(costs, keys)
    all_in = F.col("price") * (1 + F.col("tax")) + F.col("shipping")
    net = lambda q: (F.col(q) * (1 - F.col("fee_rate")) - F.col("exit_fixed")) / all_in - 1
    even = (all_in + F.col("exit_fixed")) / (1 - F.col("fee_rate"))
    sigma = log_ratio(F.col("q90"), F.col("q10")) / (2 * Z["q90"])
    positive = 1 - normal_cdf(ratio(F.log(even) - ln(F.col("q50")), sigma))
    reasons = F.array_compact(F.array(F.when(net("q25") <= 0, "conservative_net_return_not_positive"), F.when(positive < least_probability, "net_probability_below_threshold")))
    out = j.select(*keys, all_in.alias("all_in"), even.alias("break_even"), net("q25").alias("conservative_roi"), net("q50").alias("median_roi"), positive.alias("probability_net_positive"), reasons.alias("reasons"))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "watch_candidate").otherwise("not_selected"))


def selected_pockets(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of selected candidates (selected, roi, conservative_roi): count, positive rate, median return, false discoveries and mean error."""
    s = outcomes.where("selected")
    return s.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("roi") > 0).cast("double")).alias("positive_rate"), F.percentile("roi", 0.5).alias("median_roi"), F.avg((F.col("roi") <= 0).cast("double")).alias("false_discovery_rate"), F.avg(F.abs(F.col("conservative_roi") - F.col("roi"))).alias("mean_error"))


def rolling_held_out(cases: DataFrame, grid: DataFrame, block: str, group: str) -> DataFrame:
    """(block, group, a, b): for each block and group the weights best on earlier blocks without that group.

    Errors are summed by (block, group, weights) first; a running total over blocks less the group's own leaves exactly the
    pool wanted, so cases are never multiplied by groups.
    """
    error = F.abs(F.col("anchor") + F.col("a") * F.col("index_delta") + F.col("b") * F.col("reversion") - F.col("actual"))
    sums = cases.join(F.broadcast(grid)).groupBy(block, group, "a", "b").agg(F.sum(error).alias("e"), F.count("*").alias("n"))
    cells = sums.select(block).distinct().join(F.broadcast(grid)).join(sums.select(group).distinct())
    full = cells.join(sums, [block, group, "a", "b"], "left").fillna(0, ["e", "n"])
    before = Window.partitionBy(group, "a", "b").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    own = full.withColumns({"oe": F.sum("e").over(before), "on": F.sum("n").over(before)})
    pool = Window.partitionBy(block, "a", "b")
    held = own.withColumns({"pe": F.sum("oe").over(pool) - F.col("oe"), "pn": F.sum("on").over(pool) - F.col("on")}).where("pn > 0")
    key = F.struct(F.round(F.col("pe") / F.col("pn"), 12), F.abs(F.col("a")) + F.abs(F.col("b")), F.col("a"), F.col("b"))
    best = held.groupBy(block, group).agg(F.min_by(F.struct("a", "b", (F.col("pe") / F.col("pn")).alias("mae")), key).alias("w"))
    return best.select(block, group, "w.a", "w.b", "w.mae")


def structural_gap(rows: DataFrame, group: str, x: Sequence[str], y: str, folds: int = 5, ridge: float = 1e-6) -> DataFrame:
    """rows with fair, lo, hi and position, cross-fitted by whole groups.

    Fold k is tested, k + 1 calibrates and the rest train. The sums of the fit are taken once by fold; each test fold's training
    sums are the total less two folds'. Rows are written once with their fold, as the fit, the band and the result read them.
    """
    f = settled(rows.withColumn("fold", fold_of(F.col(group), folds)))
    by = gram_matrix(f, ["fold"], x, y)
    sums = [c for c in by.columns if c.startswith("x")]
    total = by.agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    nxt = by.select((F.pmod(F.col("fold") - 1, F.lit(folds))).alias("fold"), *[F.col(c).alias(f"n_{c}") for c in sums])
    # folds are few rows
    train = F.broadcast(by).join(F.broadcast(nxt), "fold").join(F.broadcast(total)).select("fold", *[(F.col(f"t_{c}") - F.col(c) - F.col(f"n_{c}")).alias(c) for c in sums])
    beta = settled(coefficients(train, ["fold"], len(x) + 1, ridge))
    calibrate = f.withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(folds)).cast("int")).join(F.broadcast(beta), "fold").withColumn("e", F.col(y) - predicted(x))
    band = quantile_of_large(calibrate, ["fold"], "e", {"e10": 0.1, "e90": 0.9}, few=True)
    out = f.join(F.broadcast(beta), "fold").join(F.broadcast(band), "fold").withColumn("fair", predicted(x))
    out = out.withColumns({"lo": F.col("fair") + F.col("e10"), "hi": F.col("fair") + F.col("e90")}).drop("beta", "e10", "e90")
    return out.withColumn("position", F.when(F.col(y) < F.col("lo"), "below").when(F.col(y) > F.col("hi"), "above").otherwise("within"))
