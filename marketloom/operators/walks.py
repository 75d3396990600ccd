"""Walk-forward evaluation: forecasts at each origin from what was known then, five baselines, scores, and the gates of a report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import clamp, ln, log_ratio, normal_cdf
from marketloom.operators import evaluate, lab
from marketloom.operators.evaluate import REQUIRED_BASELINES
from marketloom.operators.stats import join_same, quantiles_of_large
from marketloom.operators.windows import spaced_origins
from marketloom.sources.io import bounded, settled

#: The most that a log return and an interval's spread may be, and the damping of slopes.
MOST_RETURN, MOST_SPREAD, DAMPING = 0.70, 1.50, 0.25


def with_baselines(cells: DataFrame, members: DataFrame | None, keys: list[str], damping: float = DAMPING) -> DataFrame:
    """cells (origin, keys, horizon, current_price, slope_90d) with a log return for each required baseline.

    The market's slope is the median over all series at the origin. With members (keys, cohort) a cohort's median slope gives its baseline, undamped, and
    the median price of the cohort the one of convergence; a series without cohort, or a call without members, has neither (null).
    """
    one = cells.select("origin", *keys, "slope_90d", "current_price").distinct()
    market = bounded(quantiles_of_large(one, ["origin"], {"__market": ("slope_90d", 0.5)}))
    out = join_same(cells, market, ["origin"])
    if members is None:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("__cohort", "__worth")}).withColumn("cohort", F.lit(None).cast("string"))
    else:
        own = members.select(*keys, F.col("cohort").cast("string").alias("cohort"))
        known = join_same(one, own, keys).where("cohort is not null")
        typical = bounded(quantiles_of_large(known, ["origin", "cohort"], {"__cohort": ("slope_90d", 0.5), "__worth": (ln(F.col("current_price")), 0.5)}))
        out = join_same(join_same(out, own, keys), typical, ["origin", "cohort"])
    h = F.col("horizon")
    returns = {
        "no_change": F.lit(0.0),
        "damped_momentum": F.coalesce("slope_90d", F.lit(0.0)) * h * damping,
        "market_index": F.col("__market") * h * damping,
        "lifecycle_cohort": F.col("__cohort") * h,
        "structural_convergence": (F.col("__worth") - ln(F.col("current_price"))) * damping,
    }
    return out.withColumns({name: F.when(r.isNotNull(), clamp(r, -MOST_RETURN, MOST_RETURN)) for name, r in returns.items()}).drop("__market", "__cohort", "__worth")


def probability_up(move: Column, sigma: Column) -> Column:
    """Of a normal log return; without spread it is certain, or one half where nothing moves."""
    return F.when(sigma > 0, normal_cdf(move / sigma)).when(move == 0, 0.5).otherwise((move > 0).cast("double"))


def lifts(cases: DataFrame, by: Sequence[str], names: Sequence[str], seed: str, samples: int, level: float, cluster: str = "origin") -> DataFrame:
    """(by, lift_<name>, lower_<name> for each name): lift over each baseline price, null where a case lacks it, and its lower bound
    over samples of whole clusters, null with fewer than two."""
    error = lambda c: F.abs(log_ratio(F.col(c), F.col("realized")))
    whole = cases.groupBy(*by).agg(*[F.when((F.count(n) == F.count("*")) & (F.avg(error(n)) > 0), 1 - F.avg(error("predicted")) / F.avg(error(n))).alias(f"lift_{n}") for n in names])
    bounds = evaluate.cluster_bootstrap(cases, names, cluster, seed, samples, level, by).where("clusters > 1")
    wide = bounds.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("lower"))).alias(f"lower_{n}") for n in names])
    out = join_same(whole, wide, by)
    return out.select(*by, *[f"lift_{n}" for n in names], *[F.when(F.col(f"lift_{n}").isNotNull(), F.col(f"lower_{n}")).alias(f"lower_{n}") for n in names])


def breadth(cases: DataFrame, by: Sequence[str], keys: Sequence[str], spacing_days: int) -> DataFrame:
    """(by, series, cohorts, origins, spaced_origins) of scored cases."""
    counts = cases.groupBy(*by).agg(F.count_distinct(F.struct(*keys)).alias("series"), F.count_distinct("cohort").alias("cohorts"), F.count_distinct("origin").alias("origins"))
    days = cases.select(*by, F.to_date("origin").alias("__day")).distinct()
    spaced = spaced_origins(days, list(by), "__day", spacing_days).groupBy(*by).agg(F.count("*").alias("spaced_origins"))
    return join_same(counts, spaced, by)


def _scored(cases: DataFrame, counts: DataFrame, by: list[str], keys: list[str], seed: str, samples: int, level: float, spacing_days: int, min_cases: int) -> DataFrame:
    """counts with the scores, lifts, breadth, reasons and recommendation of the cases; a group without cases has n 0 and nulls."""
    prices = cases.withColumns({n: F.col("current") * F.exp(n) for n in REQUIRED_BASELINES}).withColumn("baseline", F.col("current"))
    own = settled(prices)  # read by the scores, the lifts, the bootstrap and the counts
    scores = join_same(evaluate.evaluate_cases(own, by), lifts(own, by, REQUIRED_BASELINES, seed, samples, level), by)
    scores = join_same(scores, evaluate.calibration_error(own, by, "probability_up", F.col("realized") > F.col("current")), by)
    out = join_same(counts, join_same(scores, breadth(own, by, keys, spacing_days), by), by)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "series", "cohorts", "origins", "spaced_origins")}
    return evaluate.scorecard_gate(out.withColumns(zero), min_cases=min_cases)


def retrospective_walk_forward(
    obs: DataFrame, origins: DataFrame, keys: list[str], horizons: Sequence[int], as_of: Column, members: DataFrame | None = None, seed: str = "retrospective", damping: float = DAMPING, window_days: int = 7, samples: int = 200, spacing_days: int = 21
) -> DataFrame:
    """(horizon, matured, included, excluded, unscorable, adds_up, scores, lift_ and lower_ of five baselines, breadth, reasons, recommendation).

    At each origin a series' snapshot gives a damped-momentum forecast with normal bands. One without slope or without positive volatility is quarantined and
    left out of the scores; a target without prices in its window is unscorable. The three parts of what matured by as_of are counted, and only included
    cases are scored and gated. A horizon of which nothing matured has no row; one without included cases is insufficient.
    """
    snaps = settled(lab.trend_snapshot(obs, origins, keys))
    cells = snaps.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("matures", F.date_add(F.to_date("origin"), F.col("horizon"))).where(F.col("matures") <= as_of)
    due = cells.select(*keys, "matures").distinct()
    real = evaluate.realized_price(obs, due, keys, window_days)
    cells = with_baselines(join_same(cells, real.select(*keys, "matures", "realized"), [*keys, "matures"]), members, keys, damping)
    move = F.col("damped_momentum")
    sigma = F.when(F.col("volatility_90d") > 0, F.least(F.lit(MOST_SPREAD), F.col("volatility_90d") * F.sqrt("horizon"))).otherwise(0.0)
    status = F.when(F.col("slope_90d").isNull() | ~F.coalesce(F.col("volatility_90d") > 0, F.lit(False)), "quarantined").otherwise("research_only")
    rows = cells.select(
        *keys,
        "origin",
        "horizon",
        "cohort",
        F.col("current_price").alias("current"),
        "realized",
        *REQUIRED_BASELINES,
        status.alias("prediction_status"),
        F.when(F.col("realized").isNull(), "unscorable").otherwise("scored").alias("evaluation_status"),
        probability_up(move, sigma).alias("probability_up"),
        *[(F.col("current_price") * F.exp(move + z * sigma)).alias(q) for q, z in lab.Z.items()],
    )
    rows = settled(evaluate.scorecard_membership(rows))
    counts = evaluate.membership_counts(rows, ["horizon"])
    cases = rows.where("membership = 'included'").withColumn("predicted", F.col("q50"))
    return _scored(cases, counts, ["horizon"], keys, seed, samples, 0.95, spacing_days, 30)


class ShadowPolicy(NamedTuple):
    """Fixed values of the shadow report's gates."""

    cases: int = 200
    series: int = 50
    cohorts: int = 5
    spaced_origins: int = 6
    spacing_days: int = 21
    samples: int = 600
    level: float = 0.95
    calibration_cases: int = 50
    cost_cases: int = 50
    cost_brier: float = 0.25
    cost_calibration: float = 0.10
    pocket_cases: int = 30
    pocket_positive: float = 0.60
    pocket_roi: float = 0.0
    pocket_false: float = 0.40


def shadow_walk_forward(cells: DataFrame, keys: list[str], members: DataFrame | None = None, costs: DataFrame | None = None, seed: str = "shadow", policy: ShadowPolicy = ShadowPolicy(), damping: float = DAMPING, **ensemble: float) -> DataFrame:
    """(horizon, forecasts, quarantined, scores, lift_ and lower_ of five baselines, breadth, cost and pocket figures, reasons, recommendation).

    cells is the result of lab.forecast_cells. The five baselines are the models of the ensemble and, each by itself, what it must beat. Forecasts that are not
    research_only are counted and not scored. costs (keys, origin, horizon, price, tax, shipping, fee_rate, exit_fixed) prices the acquisition of a case; its candidates and
    their return after costs are judged as well. Reasons that begin with insufficient, missing or incomplete make the report insufficient, others reject it.
    """
    by = ["horizon"]
    own = settled(with_baselines(cells, members, keys, damping))
    f = settled(lab.ensemble_forecast(own, own, keys, REQUIRED_BASELINES, **ensemble).select(*keys, "origin", "horizon", *lab.QUANTILES, "probability_up", "status"))
    at = [*keys, "origin", "horizon"]
    targets = own.where("cell = 'scored'").select(*at, "cohort", F.col("current_price").alias("current"), "realized", *REQUIRED_BASELINES)
    matched = settled(join_same(targets, f, at, "inner").withColumn("predicted", F.col("q50")))
    counts = matched.groupBy(*by).agg(F.count("*").alias("forecasts"), F.count_if(F.col("status") != "research_only").alias("quarantined"))
    cases = matched.where("status = 'research_only'")
    out = _scored(cases, counts, by, keys, seed, policy.samples, policy.level, policy.spacing_days, policy.cases)
    out = out.withColumnsRenamed({"reasons": "__card", "recommendation": "__said"})
    if costs is not None:
        picked = lab.watch_candidates(cases.select(*at, *lab.QUANTILES), costs, at)
        both = join_same(join_same(picked, cases.select(*at, "realized"), at, "inner"), costs.select(*at, "fee_rate", "exit_fixed"), at)
        roi = (F.col("realized") * (1 - F.col("fee_rate")) - F.col("exit_fixed")) / F.col("all_in") - 1
        outcomes = settled(both.select(*by, F.col("probability_net_positive").alias("probability"), roi.alias("roi"), "conservative_roi", (F.col("status") == "watch_candidate").alias("selected")))
        net = outcomes.groupBy(*by).agg(F.count("*").alias("cost_cases"), F.avg(F.pow(F.col("probability") - (F.col("roi") > 0).cast("double"), 2)).alias("cost_brier"))
        net = join_same(net, evaluate.calibration_error(outcomes, by, "probability", F.col("roi") > 0).withColumnRenamed("calibration_error", "cost_calibration"), by)
        pockets = lab.selected_pockets(outcomes, by).withColumnsRenamed({"n": "pocket_cases", "positive_rate": "pocket_positive", "median_roi": "pocket_roi", "false_discovery_rate": "pocket_false", "mean_error": "pocket_error"})
        out = join_same(join_same(out, net, by), pockets, by)
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("cost_brier", "cost_calibration", "pocket_positive", "pocket_roi", "pocket_false", "pocket_error")})
        out = out.withColumns({c: F.lit(None).cast("long") for c in ("cost_cases", "pocket_cases")})
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cost_cases", "pocket_cases")})
    lower = [F.col(f"lower_{n}") for n in REQUIRED_BASELINES]
    anyone = lambda tests: F.exists(F.array(*tests), lambda t: t)
    no_interval, enough = anyone([c.isNull() for c in lower]), F.col("cost_cases") >= policy.cost_cases
    # fixed values: the codes of reasons, in the order in which they are listed
    before = {
        "insufficient_scored_cases": F.col("n") < policy.cases,
        "insufficient_probability_calibration_cases": F.col("n") < policy.calibration_cases,
        "insufficient_variant_breadth": F.col("series") < policy.series,
        "insufficient_set_breadth": F.col("cohorts") < policy.cohorts,
        "insufficient_origin_breadth": F.col("spaced_origins") < policy.spaced_origins,
        "missing_clustered_lift_intervals": no_interval,
        "lift_lower_bound_not_positive": ~no_interval & anyone([c <= 0 for c in lower]),
        "missing_scorecard": F.col("n") == 0,
    }
    after = {
        "missing_after_cost_evidence": F.lit(costs is None),
        "incomplete_after_cost_candidate_universe": F.lit(costs is not None) & (F.col("cost_cases") < F.col("n")),
        "insufficient_after_cost_probability_calibration_cases": ~enough,
        "after_cost_brier_above_threshold": enough & (F.col("cost_brier") > policy.cost_brier),
        "after_cost_calibration_error_above_threshold": enough & (F.col("cost_calibration") > policy.cost_calibration),
        "insufficient_selected_pocket_cases": F.col("pocket_cases") < policy.pocket_cases,
        "selected_reference_positive_rate_below_threshold": F.col("pocket_positive") < policy.pocket_positive,
        "selected_median_reference_implied_net_roi_below_threshold": F.col("pocket_roi") <= policy.pocket_roi,
        "selected_reference_false_discovery_rate_above_threshold": F.col("pocket_false") > policy.pocket_false,
    }
    codes = lambda rules: [F.when(F.coalesce(t, F.lit(False)), code) for code, t in rules.items()]
    card = F.when((F.col("n") > 0) & (F.col("__said") != "eligible_for_operator_review"), F.col("__card")).otherwise(F.expr("cast(array() as array<string>)"))
    reasons = F.array_distinct(F.concat(F.array_compact(F.array(*codes(before))), card, F.array_compact(F.array(*codes(after)))))
    out = out.withColumn("reasons", reasons).drop("__card", "__said")
    lacking = F.exists("reasons", lambda r: r.startswith("insufficient_") | r.startswith("missing_") | r.startswith("incomplete_"))
    return out.withColumn("recommendation", F.when(F.size("reasons") == 0, "eligible_for_operator_review").when(lacking, "insufficient").otherwise("reject"))
