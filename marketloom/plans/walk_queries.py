"""Walk-forward evaluations and what they are made of, with SQL from the raw observations on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import ln
from marketloom.operators import evaluate, forecast, lab, walks
from marketloom.operators.evaluate import REQUIRED_BASELINES
from marketloom.operators.stats import join_same
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query
from marketloom.sources.io import settled

_DAYS = ("08", "10", "12", "14", "16", "18", "20", "22", "24", "26")
_HORIZONS, _AS_OF = (2, 5), "2024-01-30"

#: Snapshots at the origins, as the columns that a walk reads. All observations lie within 90 days.
_SNAP = f"""{b.OBS}, o AS (SELECT unnest([{", ".join(f"TIMESTAMP '2024-01-{x}'" for x in _DAYS)}]) AS origin),
k AS (SELECT origin, obs.*, epoch_us(observed_at) / 86400e6 AS t, row_number() OVER (PARTITION BY origin, series, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM obs, o WHERE observed_at <= origin AND available_at <= origin),
p AS (SELECT origin, series, t, ln(price) AS y, price, quality AS q, max(t) OVER (PARTITION BY origin, series) AS lt FROM k WHERE rn = 1),
pk AS (SELECT *, (y - lag(y) OVER (PARTITION BY origin, series ORDER BY t)) / sqrt(t - lag(t) OVER (PARTITION BY origin, series ORDER BY t)) AS r FROM p),
sl AS (SELECT a.origin, a.series, quantile_cont((z.y - a.y) / (z.t - a.t), 0.5) AS s FROM p a JOIN p z ON a.origin = z.origin AND a.series = z.series AND z.t > a.t GROUP BY 1, 2),
md AS (SELECT origin, series, quantile_cont(r, 0.5) AS c FROM pk GROUP BY 1, 2),
g AS (SELECT pk.origin, pk.series, 1.4826 * quantile_cont(abs(r - c), 0.5) AS vol, least(1.0, count(DISTINCT floor(t)) / (floor(max(lt)) - floor(max(lt) - 90) + 1)) AS den, quantile_cont(q, 0.5) AS sq, count(*) AS n, max(lt) AS lt, arg_max(price, t) AS cur FROM pk JOIN md ON md.origin = pk.origin AND md.series = pk.series GROUP BY 1, 2),
sn AS (SELECT g.*, s AS slope, least(den, sq, least(1, greatest(0, 1 - ((epoch_us(g.origin) / 86400e6 - g.lt) * 24 - 24) / 144))) AS quality, CAST(g.series % 6 AS VARCHAR) AS cohort FROM g LEFT JOIN sl ON g.origin = sl.origin AND g.series = sl.series),
h AS (SELECT unnest({list(_HORIZONS)}) AS horizon), ch AS (SELECT sn.*, horizon, CAST(origin AS DATE) + horizon AS matures FROM sn CROSS JOIN h),
rw AS (SELECT m.series, m.matures, price, row_number() OVER (PARTITION BY m.series, m.matures, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM (SELECT DISTINCT series, matures FROM ch) m JOIN obs ON m.series = obs.series AND observed_at::DATE BETWEEN m.matures - 6 AND m.matures AND available_at::DATE <= m.matures),
rl AS (SELECT series, matures, quantile_cont(price, 0.5) AS realized FROM rw WHERE rn = 1 GROUP BY 1, 2),
mk AS (SELECT origin, quantile_cont(slope, 0.5) AS market FROM sn GROUP BY 1), co AS (SELECT origin, cohort, quantile_cont(slope, 0.5) AS cslope, quantile_cont(ln(cur), 0.5) AS worth FROM sn GROUP BY 1, 2),
ce AS (SELECT ch.*, realized, CAST(0 AS DOUBLE) AS no_change, greatest(-0.7, least(0.7, coalesce(slope, 0) * horizon * 0.25)) AS damped_momentum, greatest(-0.7, least(0.7, market * horizon * 0.25)) AS market_index,
  greatest(-0.7, least(0.7, cslope * horizon)) AS lifecycle_cohort, greatest(-0.7, least(0.7, (worth - ln(cur)) * 0.25)) AS structural_convergence
  FROM ch LEFT JOIN rl ON rl.series = ch.series AND rl.matures = ch.matures JOIN mk ON mk.origin = ch.origin JOIN co ON co.origin = ch.origin AND co.cohort = ch.cohort)"""


def _cdf(x: str) -> str:
    """The polynomial of the normal distribution."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN ({x}) >= 0 THEN 0.5 * (2 - {tail}) ELSE 0.5 * {tail} END)"


def _lifts(seed: str, samples: int) -> str:
    """From cases (horizon, origin, current, predicted, realized and the five returns): lift and lower bound by horizon and baseline."""
    long = " UNION ALL ".join(f"SELECT horizon, origin, '{n}' AS name, abs(ln(predicted / realized)) AS e, abs(ln(current * exp({n}) / realized)) AS be FROM cases" for n in REQUIRED_BASELINES)
    return f"""bl AS ({long}), lf AS (SELECT horizon, name, 1 - avg(e) / avg(be) AS lift FROM bl GROUP BY 1, 2), bc AS (SELECT horizon, name, origin, sum(e) AS e, sum(be) AS be FROM bl GROUP BY 1, 2, 3),
bn AS (SELECT horizon, name, e, be, row_number() OVER (PARTITION BY horizon, name ORDER BY origin) AS i, count(*) OVER (PARTITION BY horizon, name) AS n FROM bc),
bd AS (SELECT horizon, name, s, 1 + ('0x' || sha256('{seed}|' || horizon || '|' || name || '|' || s || '|' || d)[1:8])::BIGINT % n AS i FROM (SELECT DISTINCT horizon, name, n FROM bn), generate_series(1, {samples}) a(s), generate_series(1, {len(_DAYS)}) z(d) WHERE d <= n),
bs AS (SELECT bd.horizon, bd.name, s, 1 - sum(e) / sum(be) AS lift FROM bd JOIN bn ON bd.horizon = bn.horizon AND bd.name = bn.name AND bd.i = bn.i GROUP BY 1, 2, 3),
lo AS (SELECT horizon, name, quantile_cont(lift, 0.025) AS lower FROM bs GROUP BY 1, 2),
lw AS (SELECT lf.horizon, {", ".join(f"max(CASE WHEN lf.name = '{n}' THEN lift END) AS lift_{n}, max(CASE WHEN lf.name = '{n}' THEN lower END) AS lower_{n}" for n in REQUIRED_BASELINES)} FROM lf JOIN lo ON lo.horizon = lf.horizon AND lo.name = lf.name GROUP BY 1)"""


_SCORES = """cs AS (SELECT horizon, count(*) AS n, avg(abs(ln(predicted / realized))) AS mae_log, avg(pow(probability_up - (realized > current)::INT, 2)) AS brier, avg((realized BETWEEN q10 AND q90)::INT) AS coverage_80,
  count(DISTINCT series) AS series, count(DISTINCT cohort) AS cohorts, count(DISTINCT origin) AS origins FROM cases GROUP BY 1)"""

_SHOWN = f"""n, round(mae_log, 6) + 0.0 AS mae_log, round(brier, 6) + 0.0 AS brier, round(coverage_80, 6) + 0.0 AS coverage_80, series, cohorts, origins,
{", ".join(f"round(lift_{n}, 6) + 0.0 AS lift_{n}, round(lower_{n}, 6) + 0.0 AS lower_{n}" for n in REQUIRED_BASELINES)}"""
_COLUMNS = ("n", "mae_log", "brier", "coverage_80", "series", "cohorts", "origins", *[f"{k}_{n}" for n in REQUIRED_BASELINES for k in ("lift", "lower")])


def _card(least: int) -> str:
    """The scorecard's reasons, of groups that have cases."""
    some = " OR ".join(f"lift_{n} < 0.02" for n in REQUIRED_BASELINES if n != "no_change")
    return f"""[CASE WHEN n < {least} THEN 'insufficient_evaluation_cases' END, CASE WHEN lift_no_change < 0.02 THEN 'baseline_lift_below_threshold' END, CASE WHEN {some} THEN 'challenger_baseline_lift_below_threshold' END,
CASE WHEN NOT (coverage_80 BETWEEN 0.72 AND 0.88) THEN 'interval_coverage_outside_band' END, CASE WHEN brier > 0.25 THEN 'brier_score_above_threshold' END]"""


def _origins(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(f"2024-01-{x} 00:00:00").cast("timestamp") for x in _DAYS])).alias("origin"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return b.observations(spark, d).select("series").distinct().withColumn("cohort", (F.col("series") % 6).cast("string"))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots at the origins, and the realized prices of their maturities."""
    o = b.observations(spark, d)
    s = settled(lab.trend_snapshot(o, _origins(spark), ["series"]))
    due = s.select("series", F.explode(F.array(*[F.date_add(F.to_date("origin"), h) for h in _HORIZONS])).alias("matures")).distinct()
    return s, evaluate.realized_price(o, due, ["series"])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return lab.forecast_cells(*_labelled(spark, d), ["series"], _HORIZONS, F.lit(_AS_OF).cast("date"))


_Z = lab.Z
_SIGMA = "CASE WHEN vol > 0 THEN least(1.5, vol * sqrt(horizon)) ELSE 0 END"


@query(f"""WITH {_SNAP}, pr AS (SELECT ce.*, cur AS current, {_SIGMA} AS sigma, slope IS NULL OR vol IS NULL OR vol <= 0 AS quarantined FROM ce WHERE matures <= DATE '{_AS_OF}'),
ct AS (SELECT horizon, count(*) AS matured, count(*) FILTER (WHERE NOT quarantined AND realized IS NOT NULL) AS included, count(*) FILTER (WHERE quarantined) AS excluded, count(*) FILTER (WHERE NOT quarantined AND realized IS NULL) AS unscorable FROM pr GROUP BY 1),
cases AS (SELECT *, current * exp(damped_momentum) AS predicted, {_cdf("damped_momentum / sigma")} AS probability_up, {", ".join(f"current * exp(damped_momentum + {z} * sigma) AS {q}" for q, z in _Z.items())} FROM pr WHERE NOT quarantined AND realized IS NOT NULL),
{_SCORES}, {_lifts("retrospective", 200)}, al AS (SELECT *, list_filter({_card(30)}, lambda x: x IS NOT NULL) AS reasons FROM ct JOIN cs USING (horizon) JOIN lw USING (horizon))
SELECT CAST(horizon AS BIGINT) AS horizon, matured, included, excluded, unscorable, {_SHOWN}, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'eligible_for_operator_review' WHEN n < 30 THEN 'insufficient' ELSE 'reject' END AS recommendation FROM al""")
def retrospective_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    w = walks.retrospective_walk_forward(b.observations(spark, d), _origins(spark), ["series"], _HORIZONS, F.lit(_AS_OF).cast("date"), _members(spark, d))
    return rounded(w.select("horizon", "matured", "included", "excluded", "unscorable", *_COLUMNS, F.array_join("reasons", ",").alias("reasons"), "recommendation"))


#: The ensemble by hand: labels that matured by an origin, in three blocks of whole origins, a horizon apart.
_MIXED = " + ".join(f"coalesce(w_{n}, 0) * {n}" for n in REQUIRED_BASELINES)
_ENSEMBLE = f"""lb AS (SELECT * FROM ce WHERE n >= 7 AND matures <= DATE '{_AS_OF}' AND realized IS NOT NULL), ag AS (SELECT DISTINCT origin AS at_origin, horizon FROM ce),
eg AS (SELECT at_origin, lb.*, ln(realized / cur) AS rr FROM lb JOIN ag ON ag.horizon = lb.horizon AND lb.origin < at_origin AND lb.matures <= CAST(at_origin AS DATE)),
og AS (SELECT at_origin, horizon, origin, row_number() OVER (PARTITION BY at_origin, horizon ORDER BY origin) AS r, count(*) OVER (PARTITION BY at_origin, horizon) AS n FROM (SELECT DISTINCT at_origin, horizon, origin FROM eg)),
oh AS (SELECT *, least(greatest(1, floor(n * 0.25)), greatest(1, floor((n - 1) / 2.0))) AS hold FROM og), op AS (SELECT *, CASE WHEN n < 3 OR r <= n - 2 * hold THEN 0 WHEN r <= n - hold THEN 1 ELSE 2 END AS part FROM oh),
nx AS (SELECT at_origin, horizon, part - 1 AS part, min(origin) AS nxt FROM op GROUP BY 1, 2, 3), oe AS (SELECT op.*, CASE WHEN nxt IS NOT NULL AND CAST(op.origin AS DATE) >= CAST(nxt AS DATE) - op.horizon THEN -1 ELSE op.part END AS cut FROM op LEFT JOIN nx ON nx.at_origin = op.at_origin AND nx.horizon = op.horizon AND nx.part = op.part),
es AS (SELECT eg.*, cut FROM eg JOIN oe ON oe.at_origin = eg.at_origin AND oe.horizon = eg.horizon AND oe.origin = eg.origin),
ls AS ({" UNION ALL ".join(f"SELECT at_origin, horizon, '{n}' AS model, avg(abs({n} - rr)) AS loss FROM es WHERE cut = 1 GROUP BY 1, 2" for n in REQUIRED_BASELINES)}),
lr AS (SELECT at_origin, horizon, model, greatest(0.05, exp(-loss / quantile_cont(loss, 0.5) OVER (PARTITION BY at_origin, horizon))) AS raw FROM ls), lq AS (SELECT at_origin, horizon, model, raw / sum(raw) OVER (PARTITION BY at_origin, horizon) AS w FROM lr),
wt AS (SELECT at_origin, horizon, {", ".join(f"max(CASE WHEN model = '{n}' THEN w END) AS w_{n}" for n in REQUIRED_BASELINES)} FROM lq GROUP BY 1, 2),
rs AS (SELECT es.at_origin, es.horizon, rr - ({_MIXED}) AS e FROM es JOIN wt ON wt.at_origin = es.at_origin AND wt.horizon = es.horizon WHERE cut = 2),
cl AS (SELECT at_origin, horizon, count(*) AS cn, {", ".join(f"quantile_cont(e, {p}) AS e_{q}" for q, p in lab.QUANTILES.items())} FROM rs GROUP BY 1, 2),
fm AS (SELECT ce.*, ({_MIXED}) + coalesce(e_q50, 0) AS centre, greatest(0.03, coalesce(vol, 0) * sqrt(ce.horizon)) AS sigma, greatest(0, least(1, (coalesce(quality, 0) - 0.1) / 0.9)) AS support, coalesce(cn >= 10 AND e_q90 > e_q10, false) AS usable, {", ".join(f"e_{q}" for q in lab.QUANTILES)}
  FROM ce LEFT JOIN wt ON wt.at_origin = ce.origin AND wt.horizon = ce.horizon LEFT JOIN cl ON cl.at_origin = ce.origin AND cl.horizon = ce.horizon),
fs AS (SELECT *, 1 + (1 - support) AS spread, CASE WHEN NOT usable OR coalesce(quality, 0) < 0.1 THEN 'quarantined' ELSE 'research_only' END AS status FROM fm),
fc AS (SELECT *, {", ".join(f"cur * exp(centre * support + CASE WHEN usable THEN e_{q} - e_q50 ELSE {z} * sigma END * spread) AS {q}" for q, z in _Z.items())}, {_cdf("centre * support / (sigma * spread)")} AS probability_up FROM fs)"""


def _ensemble_cells(spark: SparkSession, d: str) -> DataFrame:
    return walks.with_baselines(_cells(spark, d), _members(spark, d), ["series"])


@query(f"""WITH {_SNAP}, {_ENSEMBLE} SELECT series, origin, CAST(horizon AS BIGINT) AS horizon, {", ".join(f"round(ln({q}), 6) + 0.0 AS log_{q}" for q in _Z)}, round(probability_up, 6) + 0.0 AS probability_up, status FROM fc""")
def ensemble_forecast(spark: SparkSession, d: str) -> DataFrame:
    c = settled(_ensemble_cells(spark, d))
    f = lab.ensemble_forecast(c, c, ["series"], REQUIRED_BASELINES, least_quality=0.1)
    return rounded(f.select("series", "origin", "horizon", *[ln(F.col(q)).alias(f"log_{q}") for q in forecast.QUANTILES], "probability_up", "status"))


@query(f"""WITH {_SNAP}, {_ENSEMBLE}, mt AS (SELECT *, cur AS current, q50 AS predicted FROM fc WHERE n >= 7 AND matures <= DATE '{_AS_OF}' AND realized IS NOT NULL), ct AS (SELECT horizon, count(*) AS forecasts, count(*) FILTER (WHERE status <> 'research_only') AS quarantined FROM mt GROUP BY 1),
cases AS (SELECT * FROM mt WHERE status = 'research_only'), {_SCORES}, {_lifts("shadow", 600)},
pf AS (SELECT series, horizon, origin, realized, (cur * 0.9 * 1.08 + 1) AS all_in, (q25 * 0.9 - 0.5) / (cur * 0.9 * 1.08 + 1) - 1 AS cons, (ln(((cur * 0.9 * 1.08 + 1) + 0.5) / 0.9) - ln(q50)) / (ln(q90 / q10) / (2 * 1.281551565545)) AS x FROM cases),
pp AS (SELECT horizon, cons, 1 - {_cdf("x")} AS prob, (realized * 0.9 - 0.5) / all_in - 1 AS roi FROM pf), ps AS (SELECT *, cons > 0 AND prob >= 0.7 AS sel FROM pp),
pq AS (SELECT horizon, count(*) AS cost_cases, avg(pow(prob - (roi > 0)::INT, 2)) AS cost_brier, count(*) FILTER (WHERE sel) AS pocket_cases, avg((roi > 0)::INT) FILTER (WHERE sel) AS pocket_positive FROM ps GROUP BY 1)
SELECT CAST(ct.horizon AS BIGINT) AS horizon, forecasts, quarantined, coalesce(n, 0) AS n, round(mae_log, 6) + 0.0 AS mae_log, round(brier, 6) + 0.0 AS brier, round(coverage_80, 6) + 0.0 AS coverage_80, coalesce(series, 0) AS series, coalesce(cohorts, 0) AS cohorts, coalesce(origins, 0) AS origins,
{", ".join(f"round(lift_{n}, 6) + 0.0 AS lift_{n}, round(lower_{n}, 6) + 0.0 AS lower_{n}" for n in REQUIRED_BASELINES)}, coalesce(cost_cases, 0) AS cost_cases, round(cost_brier, 6) + 0.0 AS cost_brier, coalesce(pocket_cases, 0) AS pocket_cases, round(pocket_positive, 6) + 0.0 AS pocket_positive
FROM ct LEFT JOIN cs ON cs.horizon = ct.horizon LEFT JOIN lw ON lw.horizon = ct.horizon LEFT JOIN pq ON pq.horizon = ct.horizon""")
def shadow_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    cells = settled(_cells(spark, d))
    costs = _members(spark, d).select("series").join(cells.groupBy("series").agg(F.max("current_price").alias("__p")), "series").select("series", F.lit(0.08).alias("tax"), F.lit(1.0).alias("shipping"), F.lit(0.1).alias("fee_rate"), F.lit(0.5).alias("exit_fixed"))
    costs = cells.select("series", "origin", "horizon", (F.col("current_price") * 0.9).alias("price")).join(costs, "series")
    w = walks.shadow_walk_forward(cells, ["series"], _members(spark, d), costs, least_quality=0.1)
    return rounded(w.select("horizon", "forecasts", "quarantined", *_COLUMNS, "cost_cases", "cost_brier", "pocket_cases", "pocket_positive"))


@query(f"""WITH {_SNAP}, {_ENSEMBLE} SELECT CAST(horizon AS BIGINT) AS horizon, CAST(at_origin AS DATE) AS cutoff, CASE cut WHEN -1 THEN 'embargo' WHEN 0 THEN 'train' WHEN 1 THEN 'validate' ELSE 'calibrate' END AS part, count(*) AS n FROM es GROUP BY 1, 2, 3""")
def origin_parts(spark: SparkSession, d: str) -> DataFrame:
    c = settled(_ensemble_cells(spark, d))
    labels = c.where("cell = 'scored'").select("horizon", F.col("origin").alias("from_origin"), "matures")
    eligible = labels.join(c.select(F.col("origin").alias("at"), "horizon").distinct(), "horizon").where((F.col("from_origin") < F.col("at")) & (F.col("matures") <= F.to_date("at")))
    parts = forecast.origin_parts(eligible, ["at", "horizon"], "from_origin", F.col("horizon"))
    return rounded(parts.groupBy("horizon", F.to_date("at").alias("cutoff"), "part").agg(F.count("*").alias("n")))


_STATE = """CASE WHEN slope IS NULL OR vol IS NULL OR quality < 0.5 OR n < 7 THEN 'insufficient_data' WHEN slope / greatest(vol, 1e-6) >= 1.5 THEN 'strong_rise' WHEN slope / greatest(vol, 1e-6) >= 0.5 THEN 'rise'
WHEN slope / greatest(vol, 1e-6) <= -1.5 THEN 'strong_fall' WHEN slope / greatest(vol, 1e-6) <= -0.5 THEN 'fall' ELSE 'stable' END"""


@query(f"WITH {_SNAP} SELECT origin, series, round(slope / greatest(vol, 1e-6), 6) + 0.0 AS slope_z, round(quality, 6) + 0.0 AS evidence_quality, {_STATE} AS state FROM sn")
def trend_states(spark: SparkSession, d: str) -> DataFrame:
    s = lab.trend_snapshot(b.observations(spark, d), _origins(spark), ["series"])
    return rounded(s.select("origin", "series", "slope_z", "evidence_quality", "state"))


@query(f"""WITH {_SNAP} SELECT origin, series, CAST(horizon AS BIGINT) AS horizon, CASE WHEN n < 7 THEN 'feature_abstained' WHEN matures > DATE '{_AS_OF}' THEN 'open' WHEN realized IS NULL THEN 'unscorable' ELSE 'scored' END AS cell,
round(CASE WHEN n >= 7 AND matures <= DATE '{_AS_OF}' THEN ln(realized / cur) END, 6) + 0.0 AS realized_return FROM ce""")
def forecast_dataset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cells(spark, d).select("origin", "series", "horizon", "cell", "realized_return"))


@query(f"""WITH {_SNAP}, x AS (SELECT horizon, CASE WHEN n < 7 THEN 'feature_abstained' WHEN matures > DATE '{_AS_OF}' THEN 'open' WHEN realized IS NULL THEN 'unscorable' ELSE 'scored' END AS cell FROM ce)
SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS planned, count(*) FILTER (WHERE cell = 'feature_abstained') AS feature_abstained, count(*) FILTER (WHERE cell = 'open') AS open, count(*) FILTER (WHERE cell = 'unscorable') AS unscorable, count(*) FILTER (WHERE cell = 'scored') AS scored FROM x GROUP BY 1""")
def coverage_contract(spark: SparkSession, d: str) -> DataFrame:
    snapshots, realized = _labelled(spark, d)
    compiled = (snapshots, settled(realized), ["series"], _HORIZONS, F.lit(_AS_OF).cast("date"))
    planned = join_same(lab.declared_cells(b.observations(spark, d), _origins(spark), ["series"], _HORIZONS), _members(spark, d), ["series"])
    c = lab.coverage_contract(planned, lab.forecast_cells(*compiled), lab.forecast_examples(*compiled), ["series", "origin", "horizon"], ["cohort", "horizon"])
    counts = ("planned", "feature_abstained", "open", "unscorable", "scored")
    return rounded(lab.fail_closed(c).groupBy("horizon").agg(*[F.sum(x).alias(x) for x in counts]))
