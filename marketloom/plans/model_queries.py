"""Forecasts, regressions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import evaluate, forecast, hedonic, regress, stats
from marketloom.operators.index import index_levels
from marketloom.operators.windows import step_returns
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import INDEX, KEYS, rounded
from marketloom.plans.registry import query
from marketloom.sources.io import settled


@query("""WITH x AS (SELECT p_partkey AS id, p_retailprice AS price, (p_size - 25) / 500.0 AS slope, 0.001 AS market, (p_partkey % 7 - 3) / 5.0 AS cohort, p_retailprice * (1 + (p_size - 25) / 50.0) AS st FROM part),
y AS (SELECT id, price, unnest(['no_change', 'damped_momentum', 'market_index', 'lifecycle_cohort', 'structural_convergence']) AS baseline, unnest([0, slope * 30 * 0.25, market * 30 * 0.25, cohort, ln(st / price) * 0.25]) AS r FROM x)
SELECT id, baseline, round(least(0.7, greatest(-0.7, r)), 6) + 0.0 AS log_return, round(price * exp(least(0.7, greatest(-0.7, r))), 3) + 0.0 AS price FROM y""")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    x = b.table(spark, d, "part").select(k.alias("id"), F.col("p_retailprice").alias("price"), ((size - 25) / 500.0).alias("slope"), F.lit(0.001).alias("market_slope"), ((k % 7 - 3) / 5.0).alias("cohort"), (F.col("p_retailprice") * (1 + (size - 25) / 50.0)).alias("structural"))
    out = forecast.baselines(x, ["id"], 30)
    return out.select("id", "baseline", (F.round("log_return", 6) + 0.0).alias("log_return"), (F.round("price", 3) + 0.0).alias("price"))


_DAMP = """RECURSIVE {0}, s AS (SELECT category, grp, t, idx AS y, row_number() OVER (PARTITION BY category, grp ORDER BY t) AS i FROM idx WHERE level = 'group'), h AS (
  SELECT a.category, a.grp, a.i, a.t, a.y AS level, z.y - a.y AS trend FROM s a JOIN s z ON a.category = z.category AND a.grp = z.grp AND a.i = 1 AND z.i = 2
  UNION ALL SELECT s.category, s.grp, s.i, s.t, 0.3 * s.y + 0.7 * (h.level + 0.85 * h.trend), 0.1 * (0.3 * s.y + 0.7 * (h.level + 0.85 * h.trend) - h.level) + 0.9 * 0.85 * h.trend FROM h JOIN s ON s.category = h.category AND s.grp = h.grp AND s.i = h.i + 1)""".format(INDEX)


@query(f"WITH {_DAMP} SELECT category, grp, CAST(t AS BIGINT) AS t, round(level, 6) + 0.0 AS level, round(trend, 6) + 0.0 AS trend FROM h")
def damped_trend(spark: SparkSession, d: str) -> DataFrame:
    idx = index_levels(b.week_panel(spark, d), KEYS).where("level = 'group'")
    return rounded(forecast.damped_trend(idx, ["category", "grp"], "t", "idx"))


@query(f"""WITH RECURSIVE {b.PANEL}, st AS (SELECT category, grp, product, t, ln(price / lag(price) OVER w) / (t - lag(t) OVER w) AS r FROM panel WINDOW w AS (PARTITION BY category, grp, product ORDER BY t)),
s AS (SELECT product, r, row_number() OVER (PARTITION BY product ORDER BY t) AS i, count(*) OVER (PARTITION BY product) AS n FROM st WHERE r IS NOT NULL), h AS (SELECT product, i, n, r AS l FROM s WHERE i = 1 UNION ALL SELECT s.product, s.i, s.n, 0.3 * s.r + 0.7 * h.l FROM h JOIN s ON s.product = h.product AND s.i = h.i + 1)
SELECT product, n, round(l * n / (n + 8), 6) + 0.0 AS drift FROM h WHERE i = n""")
def theta_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.theta_drift(step_returns(b.week_panel(spark, d), KEYS), ["product"], "t", "r"))


@query(f"""WITH {b.CASES}, r AS (SELECT category, ln(realized / predicted) AS e FROM cases) SELECT category, {", ".join(f"round(least(0, quantile_cont(e, {p})), 6) + 0.0 AS {q}" for q, p in (("q10", 0.1), ("q25", 0.25)))}, CAST(0 AS DOUBLE) AS q50,
{", ".join(f"round(greatest(0, quantile_cont(e, {p})), 6) + 0.0 AS {q}" for q, p in (("q75", 0.75), ("q90", 0.9)))}, count(*) AS pool FROM r GROUP BY 1""")
def conformal_offsets(spark: SparkSession, d: str) -> DataFrame:
    r = b.cases(spark, d).select("category", F.log(F.col("realized") / F.col("predicted")).alias("standardized"))
    return rounded(forecast.conformal_offsets(r, ["category"]))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'insufficient-history' WHEN p_size < 8 THEN 'low-history' WHEN p_partkey % 13 > 8 THEN 'low-history' ELSE 'standard' END AS tier,
round(CASE WHEN p_size >= 8 THEN ln(p_retailprice) ELSE ln(p_retailprice) + least(1.0986122886681098, greatest(-1.0986122886681098, (1 - p_size / (p_size + 8.0)) * (5 - ln(p_retailprice)))) END, 6) + 0.0 AS anchor FROM part""")
def hedonic_anchor(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    tier = forecast.confidence_tier(F.when(k % 10 != 0, F.lit(0.1)), n, k % 13)
    return rounded(b.table(spark, d, "part").select(k.alias("id"), tier.alias("tier"), forecast.hedonic_anchor(F.log("p_retailprice"), F.lit(5.0), n).alias("anchor")))


#: The panel without series of part sizes above 47, and only early prices of sizes under 5: cold starts and short histories.
_THINNED = INDEX.replace(b.PANEL, b.PANEL.replace("panel AS (", "whole AS (") + ", panel AS (SELECT whole.* FROM whole JOIN part ON product = p_partkey WHERE price > 0 AND p_size <= 47 AND (p_size >= 5 OR t <= -6))")
_HORIZONS, _WEIGHTS = (1, 2, 3), {2: (0.5, 0.1, 0.25)}
_BY_HORIZON = lambda i: f"CASE h.h {' '.join(f'WHEN {h} THEN {w[i]}' for h, w in _WEIGHTS.items())} ELSE {(1.0, 0.0, 1.0)[i]} END"
_QS = list(forecast.QUANTILES)

_TRAJECTORY = f"""WITH RECURSIVE {_THINNED}, ends AS (SELECT min(t) AS lo, max(t) AS hi FROM panel),
hed AS (SELECT p_type AS category, p_brand AS grp, p_partkey AS product, ln(p_retailprice * (0.2 + p_size / 20.0)) AS hl FROM part),
s AS (SELECT coalesce(category, '') AS ca, coalesce(grp, '') AS gr, level AS lv, t, idx AS y, row_number() OVER (PARTITION BY level, category, grp ORDER BY t) AS i FROM idx),
dt AS (SELECT a.lv, a.ca, a.gr, a.i, a.t, a.y AS level, z.y - a.y AS trend FROM s a JOIN s z ON a.lv = z.lv AND a.ca = z.ca AND a.gr = z.gr AND a.i = 1 AND z.i = 2
  UNION ALL SELECT s.lv, s.ca, s.gr, s.i, s.t, 0.3 * s.y + 0.7 * (dt.level + 0.85 * dt.trend), 0.1 * (0.3 * s.y + 0.7 * (dt.level + 0.85 * dt.trend) - dt.level) + 0.9 * 0.85 * dt.trend FROM dt JOIN s ON s.lv = dt.lv AND s.ca = dt.ca AND s.gr = dt.gr AND s.i = dt.i + 1),
tr AS (SELECT s.lv, s.ca, s.gr, s.t, s.y, coalesce(dt.trend, 0) AS trend FROM s LEFT JOIN dt ON s.lv = dt.lv AND s.ca = dt.ca AND s.gr = dt.gr AND s.t = dt.t),
gs AS (SELECT ca, gr, t, y, trend, t - min(t) OVER (PARTITION BY ca, gr) AS n FROM tr WHERE lv = 'group'
  UNION ALL SELECT u.category, u.grp, hi, 0, 0, 0 FROM (SELECT DISTINCT category, grp FROM hed) u CROSS JOIN ends WHERE NOT EXISTS (SELECT 1 FROM tr WHERE lv = 'group' AND ca = u.category AND gr = u.grp)),
ctx AS (SELECT g.ca AS category, g.gr AS grp, g.t, g.y + c.y + m.y AS level, g.trend AS dg, c.trend AS dc, m.trend AS dm, g.n / (g.n + 12.0) AS share FROM gs g JOIN tr c ON c.lv = 'category' AND c.ca = g.ca AND c.t = g.t JOIN tr m ON m.lv = 'market' AND m.t = g.t),
h AS (SELECT unnest({list(_HORIZONS)}) AS h),
mv AS (SELECT category, grp, t, h, (dm + dc + share * dg) * 0.85 * (1 - pow(0.85, h)) / 0.15 AS move FROM ctx CROSS JOIN h),
pt AS (SELECT panel.category, panel.grp, product, panel.t, ln(price) AS y, ln(price) - level AS own FROM panel JOIN ctx ON panel.category = ctx.category AND panel.grp = ctx.grp AND panel.t = ctx.t),
rr AS (SELECT *, (own - lag(own) OVER w) / (t - lag(t) OVER w) AS r, CASE WHEN count(own) OVER z >= 2 THEN quantile_cont(own, 0.5) OVER z - own ELSE 0 END AS near FROM pt
  WINDOW w AS (PARTITION BY category, grp, product ORDER BY t), z AS (PARTITION BY category, grp, product ORDER BY t RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)),
ri AS (SELECT *, count(r) OVER (PARTITION BY category, grp, product ORDER BY t) AS i, count(r) OVER (PARTITION BY category, grp, product) AS n, max(t) OVER (PARTITION BY category, grp, product) AS last FROM rr),
sm AS (SELECT category, grp, product, i, r AS l FROM ri WHERE i = 1 AND r IS NOT NULL UNION ALL SELECT ri.category, ri.grp, ri.product, ri.i, 0.3 * ri.r + 0.7 * sm.l FROM sm JOIN ri ON ri.product = sm.product AND ri.grp = sm.grp AND ri.category = sm.category AND ri.i = sm.i + 1),
md AS (SELECT category, grp, product, 1.4826 * quantile_cont(abs(r - c), 0.5) AS mad FROM (SELECT category, grp, product, r, n, quantile_cont(r, 0.5) OVER (PARTITION BY category, grp, product) AS c FROM ri WHERE r IS NOT NULL) WHERE n >= 2 GROUP BY 1, 2, 3),
pf AS (SELECT ri.*, mad, coalesce(l * ri.i / (ri.i + 8.0), 0) AS drift FROM ri LEFT JOIN sm ON sm.product = ri.product AND sm.grp = ri.grp AND sm.category = ri.category AND sm.i = ri.i LEFT JOIN md ON md.product = ri.product AND md.grp = ri.grp AND md.category = ri.category),
mid AS (SELECT pf.*, h.h, pf.y + {_BY_HORIZON(0)} * move + {_BY_HORIZON(1)} * near + {_BY_HORIZON(2)} * h.h * drift AS mid FROM pf CROSS JOIN h JOIN mv ON mv.category = pf.category AND mv.grp = pf.grp AND mv.t = pf.t AND mv.h = h.h),
og AS (SELECT DISTINCT h, first + CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS t FROM (SELECT h, first, k * (fin - first) / greatest(1, least(5, fin - first + 1) - 1.0) AS x, least(5, fin - first + 1) AS m, k FROM (SELECT h, lo + 15 AS first, hi - h AS fin FROM ends CROSS JOIN h) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k)) WHERE k < m),
cuts AS (SELECT category, quantile_cont(mad, 1.0 / 3) AS q33, quantile_cont(mad, 2.0 / 3) AS q67 FROM md GROUP BY 1),
bk AS (SELECT DISTINCT pf.category, pf.grp, pf.product, mad, CASE WHEN mad IS NULL THEN 'unknown' WHEN mad <= q33 THEN 'low' WHEN mad <= q67 THEN 'mid' ELSE 'high' END AS bucket FROM pf LEFT JOIN cuts ON cuts.category = pf.category),
po AS (SELECT mid.category, bucket, mid.h, (z.y - mid.mid) / greatest(mid.mad, 0.0001) AS e FROM mid JOIN og ON og.h = mid.h AND og.t = mid.t JOIN pt z ON z.category = mid.category AND z.grp = mid.grp AND z.product = mid.product AND z.t = mid.t + mid.h JOIN bk ON bk.category = mid.category AND bk.grp = mid.grp AND bk.product = mid.product WHERE mid.mad IS NOT NULL),
ofs AS (SELECT category, bucket, h, least(0, quantile_cont(e, 0.1)) AS q10, least(0, quantile_cont(e, 0.25)) AS q25, 0.0 AS q50, greatest(0, quantile_cont(e, 0.75)) AS q75, greatest(0, quantile_cont(e, 0.9)) AS q90 FROM po GROUP BY 1, 2, 3),
fb AS (SELECT category, greatest(0.0001, avg(mad) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1))) AS fb FROM (SELECT category, mad, row_number() OVER (PARTITION BY category ORDER BY mad) AS i, count(*) OVER (PARTITION BY category) AS n FROM md) GROUP BY 1),
ty AS (SELECT category, bucket, greatest(0.0001, quantile_cont(mad, 0.5)) AS ty FROM bk WHERE mad IS NOT NULL GROUP BY 1, 2),
wd AS (SELECT * FROM (SELECT ofs.*, coalesce(ty, fb) AS scale, row_number() OVER (PARTITION BY ofs.category, ofs.h ORDER BY (q90 - q10) * coalesce(ty, fb) DESC, ofs.bucket DESC) AS k FROM ofs LEFT JOIN ty ON ty.category = ofs.category AND ty.bucket = ofs.bucket LEFT JOIN fb ON fb.category = ofs.category) WHERE k = 1),
an AS (SELECT mid.*, bucket, hl, CASE WHEN n >= 8 OR hl IS NULL THEN mid.y ELSE mid.y + greatest(-ln(3), least(ln(3), (1 - n / (n + 8.0)) * (hl - mid.y))) END AS anchor, coalesce(n < 8 AND abs((1 - n / (n + 8.0)) * (hl - mid.y)) > ln(3), false) AS saturated
  FROM mid JOIN bk ON bk.category = mid.category AND bk.grp = mid.grp AND bk.product = mid.product LEFT JOIN hed ON hed.product = mid.product WHERE mid.t = mid.last),
served AS (SELECT an.product, an.h AS horizon, CASE WHEN an.mad IS NULL THEN 'insufficient-history' WHEN n < 8 OR (hi - last) * 91 / 7.0 > 8 THEN 'low-history' ELSE 'standard' END AS tier, an.bucket, an.n, last AS origin, exp(an.y) AS price, exp(anchor) AS anchor, saturated,
  {", ".join(f"exp(mid + anchor - an.y + coalesce(ofs.{q}, {(p - 0.5) * 2}) * CASE WHEN an.mad >= 0.0001 THEN an.mad ELSE coalesce(fb, 0.0001) END) AS {q}" for q, p in forecast.QUANTILES.items())}
  FROM an CROSS JOIN ends LEFT JOIN ofs ON ofs.category = an.category AND ofs.bucket = an.bucket AND ofs.h = an.h LEFT JOIN fb ON fb.category = an.category
  UNION ALL SELECT hed.product, mv.h, 'cold-start', 'unknown', 0, hi, NULL, exp(hl), false, {", ".join(f"exp(hl + {_BY_HORIZON(0).replace('h.h', 'mv.h')} * move + coalesce(wd.{q}, {(p - 0.5) * 2}) * coalesce(wd.scale, fb, 0.0001) * 1.75)" for q, p in forecast.QUANTILES.items())}
  FROM hed CROSS JOIN ends JOIN mv ON mv.category = hed.category AND mv.grp = hed.grp AND mv.t = hi LEFT JOIN wd ON wd.category = hed.category AND wd.h = mv.h LEFT JOIN fb ON fb.category = hed.category WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.product = hed.product))"""


def _trajectory(spark: SparkSession, d: str) -> DataFrame:
    part = b.table(spark, d, "part")
    size = F.col("p_size")
    thin = b.week_panel(spark, d).join(part.select(F.col("p_partkey").alias("product"), "p_size"), "product").where("p_size <= 47 and (p_size >= 5 or t <= -6)")
    panel = settled(thin.select("category", "grp", "product", "t", "price"))
    hedonic = part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("grp"), F.col("p_partkey").alias("product"), F.log(F.col("p_retailprice") * (0.2 + size / 20.0)).alias("hedonic_log"))
    return forecast.trajectory_forecast(panel, KEYS, index_levels(panel, KEYS), horizons=_HORIZONS, step_days=91, weights=_WEIGHTS, hedonic=hedonic)


@query(f"{_TRAJECTORY} SELECT product, horizon, tier, bucket, n, CAST(origin AS BIGINT) AS origin, round(price, 7) + 0.0 AS price, round(anchor, 7) + 0.0 AS anchor, saturated, {', '.join(f'round({q}, 4) + 0.0 AS {q}' for q in _QS)} FROM served")
def trajectory_forecast(spark: SparkSession, d: str) -> DataFrame:
    f = _trajectory(spark, d).drop("category", "grp")
    return rounded(f.withColumns({q: F.round(q, 4) + 0.0 for q in _QS}), 7)


@query(f"""{_TRAJECTORY} SELECT product, tier, CAST(min(origin) AS BIGINT) AS origin, count(*) AS horizons, CAST(max(origin + horizon) AS BIGINT) AS path_end, round(max(anchor), 7) + 0.0 AS path_start_price, round(arg_max(q50, horizon), 4) + 0.0 AS path_end_price, round(arg_max(q90 - q10, horizon), 3) + 0.0 AS last_width FROM served GROUP BY 1, 2""")
def forecast_packets(spark: SparkSession, d: str) -> DataFrame:
    packets = forecast.forecast_packets(_trajectory(spark, d), KEYS)
    start, end, band = F.get("path", F.lit(0)), F.try_element_at("path", F.lit(-1)), F.try_element_at("horizons", F.lit(-1))
    return rounded(
        packets.select(
            "product",
            "tier",
            start["t"].alias("origin"),
            F.size("horizons").alias("horizons"),
            end["t"].alias("path_end"),
            start["price"].alias("path_start_price"),
            F.round(end["price"], 4).alias("path_end_price"),
            F.round(band["q90"] - band["q10"], 3).alias("last_width"),
        ),
        7,
    )


@query(f"WITH {b.CASES}, r AS (SELECT product, origin, current AS price, greatest(abs(ln(q10 / current)), abs(ln(q90 / current))) AS rad FROM cases) SELECT product, CAST(origin AS BIGINT) AS origin, round(price * exp(-rad), 4) + 0.0 AS lo, round(price * exp(rad), 4) + 0.0 AS hi FROM r")
def range_only_band(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d).withColumnRenamed("current", "price")
    return rounded(forecast.range_only_band(c).select("product", "origin", "lo", "hi"), 4)


@query(f"""WITH {b.CASES}, o AS (SELECT origin, row_number() OVER (ORDER BY origin) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM cases)) SELECT CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + 1 THEN 'embargo' ELSE 'holdout' END AS block, count(*) AS n FROM cases JOIN o USING (origin) GROUP BY 1""")
def origin_blocks(spark: SparkSession, d: str) -> DataFrame:
    return forecast.origin_blocks(b.cases(spark, d), "origin").groupBy("block").agg(F.count("*").alias("n"))


@query(f"""WITH {b.FACTS}, p AS (SELECT product, day, max(price) AS price FROM facts WHERE day <= DATE '1998-06-30' GROUP BY 1, 2), s AS (SELECT product, day, price, day - lag(day) OVER w AS g, ln(price / lag(price) OVER w) AS r, DATE '1998-06-30' - day AS age FROM p WINDOW w AS (PARTITION BY product ORDER BY day)),
k AS (SELECT *, r / sqrt(g) AS z, g > 0 AND abs(r) / sqrt(g) <= 0.24 AS ok, g > 0 AND abs(r) / sqrt(g) > 0.24 AS jump FROM s),
a AS (SELECT product, arg_max(price, day) AS price, count(*) AS n, count(*) FILTER (WHERE jump) AS excluded, count(*) FILTER (WHERE ok) AS pairs, max(day) - min(day) AS span, DATE '1998-06-30' - max(day) AS stale, sum(pow(0.5, age / 180.0) * r / g) FILTER (WHERE ok) / sum(pow(0.5, age / 180.0)) FILTER (WHERE ok) AS d,
  sum(pow(0.5, age / 60.0) * z) FILTER (WHERE ok) / sum(pow(0.5, age / 60.0)) FILTER (WHERE ok) AS m, sum(pow(0.5, age / 60.0) * z * z) FILTER (WHERE ok) / sum(pow(0.5, age / 60.0)) FILTER (WHERE ok) AS m2 FROM k GROUP BY 1),
v AS (SELECT *, span / (span + 730) * coalesce(d, 0) AS drift, least(0.06, greatest(0.015, sqrt(pairs / (pairs + 10) * CASE WHEN pairs > 1 THEN greatest(0, m2 - m * m) ELSE 0.000625 END + (1 - pairs / (pairs + 10)) * 0.000625))) AS vol, least(0.75, n / (n + 20) * exp(-stale / 90)) AS score FROM a),
b AS (SELECT *, least(0.69 * 90 / 365, greatest(-0.69 * 90 / 365, drift * 90)) AS mv, least(vol * sqrt(90), ln(6) / (2 * 1.533) * sqrt(90 / 365)) AS sp FROM v)
SELECT product, n, excluded, round(drift, 8) + 0.0 AS drift, round(vol, 6) + 0.0 AS volatility, round(CASE WHEN stale <= 180 THEN price * exp(mv - 1.533 * sp) END, 4) + 0.0 AS q10, round(CASE WHEN stale <= 180 THEN price * exp(mv) END, 4) + 0.0 AS q50, CASE WHEN n < 3 OR score < 0.15 THEN 'early' WHEN n < 8 OR score < 0.35 THEN 'low' WHEN n < 21 OR score < 0.55 THEN 'developing' ELSE 'moderate' END AS confidence,
CASE WHEN stale > 180 THEN 'stale' WHEN n < 3 THEN 'early' WHEN n < 8 THEN 'limited' ELSE 'available' END AS status FROM b""")
def volatility_cone(spark: SparkSession, d: str) -> DataFrame:
    p = b.facts(spark, d).groupBy("product", "day").agg(F.max("price").alias("price"))
    v = forecast.volatility_cone(p, ["product"], "day", "price", 90, F.lit("1998-06-30").cast("date"))
    places = {"drift": 8, "volatility": 6, "q10": 4, "q50": 4}
    return v.select("product", "n", "excluded", *[(F.round(c, n) + 0.0).alias(c) for c, n in places.items()], "confidence", "status")


_PACKETS = """pk AS (SELECT p_partkey AS product, p_type AS category, CASE WHEN p_size < 3 THEN 'insufficient-history' WHEN p_size < 10 THEN 'low-history' WHEN p_size = 50 THEN 'cold-start' ELSE 'standard' END AS confidence,
  CASE p_partkey % 4 WHEN 0 THEN 'sealed' WHEN 1 THEN NULL ELSE 'single' END AS kind, p_partkey % 41 = 0 AS saturated, p_retailprice AS price, h AS horizon, p_retailprice * (0.6 + (p_partkey % 50) / 50.0) AS q50 FROM part, (SELECT unnest([30, 90]) AS h)),
el AS (SELECT DISTINCT category, confidence, horizon, CASE WHEN horizon = 30 THEN 'category-validated' WHEN category = 'SMALL' THEN 'relative-validated' ELSE 'odd' END AS tier FROM pk WHERE NOT (category = 'LARGE' AND horizon = 90) AND confidence <> 'insufficient-history'),
sv AS (SELECT pk.*, coalesce(kind, 'unknown') AS kd, el.category IS NOT NULL AS may, CASE WHEN pk.confidence = 'cold-start' THEN 'attribute-reference' WHEN pk.confidence <> 'standard' THEN 'range-only' WHEN tier IN ('category-validated', 'relative-validated') THEN tier ELSE 'range-only' END AS earned
  FROM pk LEFT JOIN el ON pk.category = el.category AND pk.confidence = el.confidence AND pk.horizon = el.horizon),
sd AS (SELECT *, kd IN ('sealed', 'unknown') AND earned IN ('category-validated', 'relative-validated') AS down FROM sv), se AS (SELECT *, CASE WHEN down THEN 'range-only' ELSE earned END AS tier2 FROM sd),
sf AS (SELECT *, CASE WHEN tier2 = 'range-only' THEN price ELSE q50 END AS served_q50 FROM se),
sg AS (SELECT *, CASE WHEN saturated THEN 'anchor_clamp_saturated' WHEN NOT may THEN 'no_eligible_cohort' WHEN kd = 'sealed' AND product % 8 = 0 AND served_q50 < 0.8 * 1500 THEN 'below_list_price_floor' END AS withheld FROM sf)"""


def _served(spark: SparkSession, d: str) -> DataFrame:
    k, size, p = F.col("p_partkey"), F.col("p_size"), b.table(spark, d, "part")
    confidence = F.when(size < 3, "insufficient-history").when(size < 10, "low-history").when(size == 50, "cold-start").otherwise("standard")
    pk = p.select(k.alias("product"), F.col("p_type").alias("category"), confidence.alias("confidence"), F.when(k % 4 == 0, "sealed").when(k % 4 > 1, "single").alias("kind"), (k % 41 == 0).alias("saturated"), F.col("p_retailprice").alias("price"), F.explode(F.array(F.lit(30), F.lit(90))).alias("horizon"))
    pk = pk.withColumn("q50", F.col("price") * (0.6 + (F.col("product") % 50) / 50.0))
    el = pk.select("category", "confidence", "horizon").distinct().where("not (category = 'LARGE' and horizon = 90) and confidence <> 'insufficient-history'")
    el = el.withColumn("tier", F.when(F.col("horizon") == 30, "category-validated").when(F.col("category") == "SMALL", "relative-validated").otherwise("odd"))
    return forecast.serve_tiers(pk, el, p.select(k.alias("product"), F.lit(1500.0).alias("list_price"), (k % 8 == 0).alias("in_print")))


@query(f"""WITH {_PACKETS} SELECT product, horizon, CASE WHEN withheld IS NULL THEN tier2 END AS served, withheld, down AND coalesce(withheld, 'below_list_price_floor') = 'below_list_price_floor' AS downgraded, round(served_q50, 4) + 0.0 AS served_q50 FROM sg""")
def serve_tiers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_served(spark, d).select("product", "horizon", "served", "withheld", "downgraded", "served_q50"), 4)


@query(f"""WITH {_PACKETS}, nm AS (SELECT category, 'served:' || tier2 AS name FROM sg WHERE withheld IS NULL UNION ALL SELECT category, 'withheld:' || withheld FROM sg WHERE withheld IS NOT NULL UNION ALL SELECT category, 'downgraded:' || kd FROM sg WHERE down AND coalesce(withheld, 'below_list_price_floor') = 'below_list_price_floor')
SELECT category, name, count(*) AS n FROM nm GROUP BY 1, 2""")
def serve_counters(spark: SparkSession, d: str) -> DataFrame:
    return forecast.serve_counters(_served(spark, d), ["category"])


def _pin(q: str, a: float) -> str:
    return f"round(avg(greatest({a} * (realized - {q}), ({a} - 1) * (realized - {q}))), 4) + 0.0 AS pinball_{q}"


def _dir(t: str, cond: str) -> str:
    return f"round(avg(CASE WHEN {cond} THEN CASE WHEN sign(predicted - current) = sign(realized - current) THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS {t}"


EVAL = f"""SELECT category, count(*) AS n, round(avg(abs(ln(predicted / realized))), 6) + 0.0 AS mae_log, round(quantile_cont(abs(predicted - realized) / realized, 0.5), 6) + 0.0 AS median_ape, round(avg(2 * abs(predicted - realized) / (predicted + realized)), 6) + 0.0 AS smape,
round(quantile_cont(abs(predicted - realized), 0.5), 3) + 0.0 AS median_error, {_dir("direction", "realized <> current")}, {_dir("direction_10", "abs(realized / current - 1) >= 0.10")}, {_dir("direction_25", "abs(realized / current - 1) >= 0.25")},
round(1 - avg(abs(ln(predicted / realized))) / avg(abs(ln(baseline / realized))), 6) + 0.0 AS lift, round(avg(pow(probability_up - (realized > current)::INT, 2)), 6) + 0.0 AS brier, {", ".join(_pin(q, a) for q, a in evaluate.LEVELS.items())},
round(avg((realized BETWEEN q25 AND q75)::INT), 6) + 0.0 AS coverage_50, round(avg((realized BETWEEN q10 AND q90)::INT), 6) + 0.0 AS coverage_80, round(avg(q75 - q25), 3) + 0.0 AS width_50, round(avg(q90 - q10), 3) + 0.0 AS width_80 FROM cases GROUP BY category"""
_COARSE = {"median_error": 3, "width_50": 3, "width_80": 3, **{f"pinball_{q}": 4 for q in evaluate.LEVELS}}


@query(f"WITH {b.CASES} {EVAL}")
def evaluate_cases(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.evaluate_cases(b.cases(spark, d), ["category"])
    return e.select(*[(F.round(c, _COARSE.get(c, 6)) + 0.0).alias(c) if t == "double" else c for c, t in e.dtypes])


@query(f"""WITH {b.CASES}, k AS (SELECT category, least(floor(probability_up * 10), 9) AS bin, count(*) AS n, avg(probability_up) AS p, avg((realized > current)::INT) AS y FROM cases GROUP BY 1, 2) SELECT category, round(sum(n * abs(p - y)) / sum(n), 6) + 0.0 AS calibration_error FROM k GROUP BY 1""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.calibration_error(b.cases(spark, d), ["category"], "probability_up", F.col("realized") > F.col("current")))


@query(f"""WITH {b.CASES}, x AS (SELECT unnest(['baseline', 'momentum']) AS name, unnest([baseline, momentum]) AS price, predicted, realized FROM cases) SELECT name, round(1 - avg(abs(ln(predicted / realized))) / avg(abs(ln(price / realized))), 6) + 0.0 AS lift FROM x GROUP BY 1""")
def baseline_lifts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.baseline_lifts(b.cases(spark, d), ["baseline", "momentum"]))


@query(f"""WITH {b.CASES}, x AS (SELECT unnest(['baseline', 'momentum']) AS name, unnest([baseline, momentum]) AS price, predicted, realized FROM cases), l AS (SELECT name, 1 - avg(abs(ln(predicted / realized))) / avg(abs(ln(price / realized))) AS lift FROM x GROUP BY 1) SELECT arg_min(name, lift) AS name, round(min(lift), 6) + 0.0 AS lift FROM l""")
def strongest_challenger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.strongest_challenger(evaluate.baseline_lifts(b.cases(spark, d), ["baseline", "momentum"])))


@query(f"""WITH {b.CASES}, x AS (SELECT unnest(['baseline', 'momentum']) AS name, unnest([baseline, momentum]) AS price, origin, predicted, realized FROM cases), cl AS (SELECT name, origin, sum(abs(ln(predicted / realized))) AS e, sum(abs(ln(price / realized))) AS be FROM x GROUP BY 1, 2),
nu AS (SELECT name, e, be, row_number() OVER (PARTITION BY name ORDER BY origin) AS i, count(*) OVER (PARTITION BY name) AS n FROM cl), dr AS (SELECT name, s, 1 + ('0x' || sha256('plan|' || name || '|' || s || '|' || d)[1:8])::BIGINT % n AS i, n FROM (SELECT DISTINCT name, n FROM nu), generate_series(1, 200) a(s), generate_series(1, 40) z(d) WHERE d <= n),
es AS (SELECT dr.name, s, any_value(dr.n) AS n, 1 - sum(e) / sum(be) AS lift FROM dr JOIN nu ON dr.name = nu.name AND dr.i = nu.i GROUP BY 1, 2) SELECT name, any_value(n) AS clusters, round(quantile_cont(lift, 0.025), 6) + 0.0 AS lower FROM es GROUP BY 1""")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.cluster_bootstrap(b.cases(spark, d), ["baseline", "momentum"], "origin", "plan"))


def _axis(axis: str) -> str:
    return f"""k_{axis} AS (SELECT k, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {axis} AS k FROM cells)),
m_{axis} AS (SELECT s, k, count(*) AS m FROM (SELECT s, 1 + ('0x' || sha256('plan|{axis}|' || s || '|' || i)[1:8])::BIGINT % n AS j FROM k_{axis}, generate_series(1, 400) g(s)) d JOIN k_{axis} ON k_{axis}.i = d.j GROUP BY 1, 2)"""


@query(f"""WITH {b.CASES}, cells AS (SELECT origin, grp, sum(abs(ln(predicted / realized))) AS e, sum(abs(ln(baseline / realized))) AS be FROM cases GROUP BY 1, 2), {_axis("origin")}, {_axis("grp")},
l AS (SELECT o.s, 1 - sum(o.m * g.m * e) / sum(o.m * g.m * be) AS lift FROM cells JOIN m_origin o ON o.k = cells.origin JOIN m_grp g ON g.k = cells.grp AND g.s = o.s GROUP BY 1) SELECT round(quantile_cont(lift, 0.05), 6) + 0.0 AS lower FROM l""")
def two_way_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d)
    cells = c.groupBy("origin", "grp").agg(F.sum(F.abs(F.log(F.col("predicted") / F.col("realized")))).alias("e"), F.sum(F.abs(F.log(F.col("baseline") / F.col("realized")))).alias("be"))
    return rounded(evaluate.two_way_bootstrap(cells, "plan"))


@query(f"""WITH {b.CASES}, e AS (SELECT category, count(*) AS n, 1 - avg(abs(ln(predicted / realized))) / avg(abs(ln(baseline / realized))) AS lift, 1 - avg(abs(ln(predicted / realized))) / avg(abs(ln(momentum / realized))) AS challenger, avg(pow(probability_up - (realized > current)::INT, 2)) AS brier, avg((realized BETWEEN q10 AND q90)::INT) AS cov FROM cases GROUP BY 1),
r AS (SELECT category, n < 30 AS a, lift < 0.02 AS b, challenger < 0.02 AS m, NOT (cov BETWEEN 0.72 AND 0.88) AS c, brier > 0.25 AS d FROM e) SELECT category, array_to_string(list_filter([CASE WHEN a THEN 'insufficient_evaluation_cases' END, CASE WHEN b THEN 'baseline_lift_below_threshold' END, CASE WHEN m THEN 'challenger_baseline_lift_below_threshold' END, CASE WHEN c THEN 'interval_coverage_outside_band' END, CASE WHEN d THEN 'brier_score_above_threshold' END], lambda x: x IS NOT NULL), ',') AS reasons,
CASE WHEN a THEN 'insufficient' WHEN b OR m OR c OR d THEN 'reject' ELSE 'eligible_for_operator_review' END AS recommendation FROM r""")
def scorecard_gate(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d)
    error = lambda name: F.avg(F.abs(F.log(F.col(name) / F.col("realized"))))
    challenger = c.groupBy("category").agg((1 - error("predicted") / error("momentum")).alias("lift_momentum"))
    g = evaluate.scorecard_gate(evaluate.evaluate_cases(c, ["category"]).join(challenger, "category"), required=("no_change", "momentum"))
    return g.select("category", F.array_join("reasons", ",").alias("reasons"), "recommendation")


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS card, CASE WHEN o_orderkey % 9 = 0 THEN 'quarantined' ELSE 'research_only' END AS p, CASE WHEN o_orderstatus = 'F' THEN 'unscorable' ELSE 'scored' END AS e FROM orders)
SELECT card, count(*) AS matured, count(*) FILTER (WHERE p = 'research_only' AND e = 'scored') AS included, count(*) FILTER (WHERE p = 'quarantined') AS excluded, count(*) FILTER (WHERE p = 'research_only' AND e = 'unscorable') AS unscorable, true AS adds_up FROM e GROUP BY 1""")
def scorecard_membership(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "orders").select(F.col("o_orderpriority").alias("card"), F.when(F.col("o_orderkey") % 9 == 0, "quarantined").otherwise("research_only").alias("prediction_status"), F.when(F.col("o_orderstatus") == "F", "unscorable").otherwise("scored").alias("evaluation_status"))
    return evaluate.membership_counts(evaluate.scorecard_membership(e), ["card"])


_BY = ("category", "cohort", "horizon")


def _drawn(axis: str) -> str:
    return f"""k_{axis} AS (SELECT category, cohort, k, row_number() OVER (PARTITION BY category, cohort ORDER BY k) AS i, count(*) OVER (PARTITION BY category, cohort) AS n FROM (SELECT DISTINCT category, cohort, {axis} AS k FROM cell)),
m_{axis} AS (SELECT d.category, d.cohort, s, k, count(*) AS m FROM (SELECT category, cohort, s, 1 + ('0x' || sha256('held-out-sets|{axis}|' || s || '|' || i)[1:8])::BIGINT % n AS j FROM k_{axis}, generate_series(1, 400) g(s)) d
  JOIN k_{axis} ON k_{axis}.i = d.j AND k_{axis}.category = d.category AND k_{axis}.cohort = d.cohort GROUP BY 1, 2, 3, 4)"""


HELD_OUT = f"""{b.GATE_CASES}, rr AS (SELECT *, ln(realized / current) AS a, ln(predicted / current) AS p FROM gc), mc AS (SELECT category, cohort, origin, quantile_cont(a, 0.5) AS ac, quantile_cont(p, 0.5) AS pc FROM rr GROUP BY 1, 2, 3),
lf AS (SELECT rr.category, rr.cohort, rr.origin, grp, product, abs(a - ac) - abs((a - ac) - (p - pc)) AS lift FROM rr JOIN mc ON rr.category = mc.category AND rr.cohort = mc.cohort AND rr.origin = mc.origin),
st AS (SELECT category, cohort, grp, avg(lift) AS lift FROM lf GROUP BY 1, 2, 3 HAVING count(DISTINCT product) >= 4), cell AS (SELECT category, cohort, origin, grp, avg(lift) AS cell FROM lf SEMI JOIN st USING (category, cohort, grp) GROUP BY 1, 2, 3, 4),
{_drawn("origin")}, {_drawn("grp")}, sm AS (SELECT c.category, c.cohort, o.s, sum(o.m * g.m * cell) / sum(o.m * g.m) AS mean FROM cell c JOIN m_origin o ON o.k = c.origin AND o.category = c.category AND o.cohort = c.cohort JOIN m_grp g ON g.k = c.grp AND g.category = c.category AND g.cohort = c.cohort AND g.s = o.s GROUP BY 1, 2, 3),
lo AS (SELECT category, cohort, mean AS lower FROM (SELECT *, row_number() OVER (PARTITION BY category, cohort ORDER BY mean) - 1 AS r, count(*) OVER (PARTITION BY category, cohort) AS n FROM sm) WHERE r = floor(0.05 * (n - 1))),
bl AS (SELECT category, cohort, count(DISTINCT origin) AS blocks FROM gc GROUP BY 1, 2), ma AS (SELECT category, cohort, count(*) AS sets, avg(lift) AS macro_lift, avg((lift >= -0.005)::INT) AS share FROM st GROUP BY 1, 2),
bk AS (SELECT category, cohort, count(*) AS outside FROM (SELECT category, cohort, volatility_bucket, age_bucket, avg((realized BETWEEN q10 AND q90)::INT) AS s FROM gc GROUP BY 1, 2, 3, 4 HAVING count(*) >= 500) WHERE NOT (s BETWEEN 0.75 AND 0.88) GROUP BY 1, 2),
ho AS (SELECT bl.category, bl.cohort, blocks, coalesce(sets, 0) AS sets, macro_lift, share, lower, list_filter([CASE WHEN blocks < 3 THEN 'too_few_scored_blocks' END, CASE WHEN coalesce(sets, 0) < 3 THEN 'too_few_eligible_sets' END, CASE WHEN NOT coalesce(macro_lift > 0, false) THEN 'macro_lift_not_positive' END,
  CASE WHEN NOT coalesce(share >= 0.8, false) THEN 'sets_harmed' END, CASE WHEN NOT coalesce(lower > 0, false) THEN 'bootstrap_lower_bound_not_positive' END, CASE WHEN coalesce(outside, 0) > 0 THEN 'bucket_coverage_outside_range' END, CASE WHEN bl.cohort <> 'standard' THEN 'not_the_standard_cohort' END], lambda x: x IS NOT NULL) AS reasons
  FROM bl LEFT JOIN ma ON ma.category = bl.category AND ma.cohort = bl.cohort LEFT JOIN lo ON lo.category = bl.category AND lo.cohort = bl.cohort LEFT JOIN bk ON bk.category = bl.category AND bk.cohort = bl.cohort)"""


@query(f"""WITH {HELD_OUT} SELECT category, cohort, blocks, sets, round(macro_lift, 6) + 0.0 AS macro_lift, round(share, 6) + 0.0 AS no_harm_share, round(lower, 6) + 0.0 AS lower, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM ho""")
def held_out_set_gate(spark: SparkSession, d: str) -> DataFrame:
    g = evaluate.held_out_set_gate(b.gate_cases(spark, d), _BY, min_variants=4)
    return rounded(g.select("category", "cohort", "blocks", "sets", "macro_lift", "no_harm_share", "lower", F.array_join("reasons", ",").alias("reasons"), "passed"))


_CHE = """ch AS (SELECT category, cohort, count(*) AS n, avg(abs(ln(predicted / realized))) AS mae, avg(abs(ln(current / realized))) AS mae0, count(*) FILTER (WHERE abs(ln(realized / current)) >= ln(1.05)) AS movers, avg(((predicted >= current) = (realized >= current))::INT) FILTER (WHERE abs(ln(realized / current)) >= ln(1.05)) AS direction,
avg((realized BETWEEN q10 AND q90)::INT) AS cov, avg(abs(ln(momentum / realized))) AS mm FROM gc GROUP BY 1, 2), cr AS (SELECT *, list_filter([CASE WHEN NOT mae0 - mae > 0 THEN 'lift_not_positive' END, CASE WHEN NOT cov BETWEEN 0.75 AND 0.88 THEN 'coverage_outside_range' END], lambda x: x IS NOT NULL) AS reasons FROM ch)"""


@query(f"""WITH {b.GATE_CASES}, {_CHE} SELECT category, cohort, n, round(mae, 6) + 0.0 AS mae, round(mae0, 6) + 0.0 AS mae_no_change, movers, round(direction, 6) + 0.0 AS direction_movers, round(cov, 6) + 0.0 AS coverage_80, round(mm, 6) + 0.0 AS mae_momentum, round(mae0 - mae, 6) + 0.0 AS lift, round(mae / 2, 6) + 0.0 AS pinball_q50, round(mae0 / 2, 6) + 0.0 AS pinball_no_change, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM cr""")
def cohort_horizon_eval(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.cohort_horizon_eval(b.gate_cases(spark, d), ["category", "cohort"])
    return rounded(e.withColumn("reasons", F.array_join("reasons", ",")))


@query(f"""WITH {HELD_OUT}, {_CHE}, al AS (SELECT cr.category, cr.cohort, n, mae0 - mae AS lift, cov, macro_lift, list_concat(cr.reasons, ho.reasons) AS reasons FROM cr JOIN ho ON cr.category = ho.category AND cr.cohort = ho.cohort)
SELECT category, cohort, n, round(lift, 6) + 0.0 AS lift, round(cov, 6) + 0.0 AS coverage_80, round(macro_lift, 6) + 0.0 AS macro_lift, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN 'range-only' WHEN length(category) > 5 THEN 'relative-validated' ELSE 'category-validated' END AS tier FROM al""")
def gate_category(spark: SparkSession, d: str) -> DataFrame:
    w = b.table(spark, d, "part").select(F.col("p_type").alias("category")).distinct().select("category", F.lit(90).alias("horizon"), F.when(F.length("category") > 5, 0.0).otherwise(0.5).alias("a"))
    g = evaluate.gate_category(b.gate_cases(spark, d), w, _BY, min_variants=4)
    return rounded(g.select("category", "cohort", "n", "lift", "coverage_80", "macro_lift", F.array_join("reasons", ",").alias("reasons"), "tier"))


_MAT = "mat AS (SELECT DISTINCT series, m AS matures FROM obs, (SELECT unnest([DATE '2024-01-14', DATE '2024-01-28']) AS m))"


@query(f"""WITH {b.OBS}, {_MAT}, w AS (SELECT mat.series, matures, price, row_number() OVER (PARTITION BY mat.series, matures, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM mat JOIN obs ON mat.series = obs.series AND observed_at::DATE BETWEEN matures - 6 AND matures AND available_at::DATE <= matures)
SELECT series, matures, round(quantile_cont(price, 0.5), 6) + 0.0 AS realized, count(*) AS points FROM w WHERE rn = 1 GROUP BY 1, 2""")
def realized_price(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d)
    days = F.explode(F.array(F.lit("2024-01-14").cast("date"), F.lit("2024-01-28").cast("date")))
    return rounded(evaluate.realized_price(o, o.select("series").distinct().select("series", days.alias("matures")), ["series"]))


@query(f"""WITH {b.OBS}, d AS (SELECT DISTINCT series, observed_at::DATE AS day FROM obs WHERE observed_at::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'), e AS (SELECT series, day FROM d UNION ALL SELECT DISTINCT series, DATE '2024-01-04' FROM d UNION ALL SELECT DISTINCT series, DATE '2024-01-26' FROM d),
g AS (SELECT series, day - lag(day) OVER (PARTITION BY series ORDER BY day) AS gap FROM e) SELECT series, count(*) - 2 AS observed, CAST(21 AS BIGINT) AS expected, round((count(*) - 2) / 21.0, 6) + 0.0 AS coverage, max(gap) AS largest_gap FROM g GROUP BY 1""")
def target_window_audit(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d).withColumn("day", F.to_date("observed_at"))
    return rounded(evaluate.target_window_audit(o, ["series"], F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")))


@query(f"""WITH {b.GATE_CASES}, o AS (SELECT category, origin, row_number() OVER (PARTITION BY category ORDER BY origin) AS r, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, origin FROM gc)),
ft AS (SELECT category, origin FROM o WHERE r <= greatest(0, least(round_even(n * 0.6, 0), n - least(6, n)))), fc AS (SELECT gc.category, ln(current) AS y, ln(momentum / current) AS i, ln(predicted / current) AS v, probability_up - 0.5 AS t, ln(realized) AS z FROM gc SEMI JOIN ft USING (category, origin) WHERE cohort = 'standard'),
g AS (SELECT a, c, d, row_number() OVER (ORDER BY ia, ic, id) AS k FROM (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS a, unnest([1, 2, 3, 4]) AS ia), (SELECT unnest([0.0, 0.1, 0.25, 0.5]) AS c, unnest([1, 2, 3, 4]) AS ic), (SELECT unnest([-0.25, 0.0, 0.25]) AS d, unnest([1, 2, 3]) AS id)),
s AS (SELECT category, k, any_value(a) AS a, any_value(c) AS c, any_value(d) AS d, count(*) AS n, avg(abs(z - y)) - avg(abs(z - y - a * i - c * v - d * t * 13)) AS lift FROM fc, g GROUP BY 1, 2)
SELECT category, CAST(a AS DOUBLE) AS a, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS b, round(lift, 6) + 0.0 AS lift, n FROM s QUALIFY row_number() OVER (PARTITION BY category ORDER BY lift DESC, k) = 1""")
def component_weights(spark: SparkSession, d: str) -> DataFrame:
    c = b.gate_cases(spark, d).select(
        "category", "horizon", "origin", "cohort", F.log("current").alias("anchor"), F.log(F.col("momentum") / F.col("current")).alias("index_delta"), F.log(F.col("predicted") / F.col("current")).alias("reversion"), (F.col("probability_up") - 0.5).alias("drift"), F.lit(13).alias("steps"), F.log("realized").alias("actual")
    )
    return rounded(evaluate.component_weights(c).drop("horizon"))


@query("""SELECT p_type AS type, count(*) AS n, round(sum(1), 4) + 0.0 AS xx_0_0, round(sum(p_size), 4) + 0.0 AS xx_0_1, round(sum(ln(p_retailprice)), 4) + 0.0 AS xx_0_2, round(sum(p_size * p_size), 4) + 0.0 AS xx_1_1, round(sum(p_size * ln(p_retailprice)), 4) + 0.0 AS xx_1_2, round(sum(ln(p_retailprice) * ln(p_retailprice)), 4) + 0.0 AS xx_2_2,
round(sum(p_partkey % 10), 4) + 0.0 AS xy_0, round(sum(p_size * (p_partkey % 10)), 4) + 0.0 AS xy_1, round(sum(ln(p_retailprice) * (p_partkey % 10)), 4) + 0.0 AS xy_2 FROM part GROUP BY 1""")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"), F.log("p_retailprice").alias("lp"), (F.col("p_partkey") % 10).cast("double").alias("y"))
    return rounded(stats.gram_matrix(p, ["type"], ["size", "lp"], "y"), 4)


@query("""WITH x AS (SELECT p_type, p_size AS x, ln(p_retailprice) AS y, list_reduce(list_prepend(0::BIGINT, [('0x' || h)::BIGINT FOR h IN string_split(sha256(p_brand), '')]), lambda a, z: (a * 16 + z) % 5) AS fold FROM part),
f AS (SELECT a.p_type, a.fold, regr_slope(b.y, b.x) AS s, regr_intercept(b.y, b.x) AS i FROM (SELECT DISTINCT p_type, fold FROM x) a JOIN x b ON a.p_type = b.p_type AND a.fold <> b.fold GROUP BY 1, 2)
SELECT x.p_type AS type, count(*) AS n, round(sqrt(avg(pow(y - i - s * x.x, 2))), 4) + 0.0 AS rmse, round(1 - avg(pow(y - i - s * x.x, 2)) / var_pop(y), 3) + 0.0 AS r2 FROM x JOIN f ON x.p_type = f.p_type AND x.fold = f.fold GROUP BY 1""")
def hedonic_fit(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_type").alias("type"), "p_brand", F.col("p_size").cast("double").alias("x"), F.log("p_retailprice").alias("y"))
    h = regress.hedonic_fit(p, "type", "p_brand", ["x"], "y", ridge=1e-12)
    return h.select("type", "n", (F.round("rmse", 4) + 0.0).alias("rmse"), (F.round("r2", 3) + 0.0).alias("r2"))


_LEVELS = """x AS (SELECT p_partkey AS id, p_type, p_brand, p_name AS name, string_split(p_name, ' ')[1] AS kind, p_size AS x, ln(p_retailprice) AS y, list_reduce(list_prepend(0::BIGINT, [('0x' || h)::BIGINT FOR h IN string_split(sha256(p_brand), '')]), lambda a, z: (a * 16 + z) % 5) AS fold FROM part),
fits AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fit),
top AS (SELECT p_type, fit, name FROM (SELECT p_type, fit, name, row_number() OVER (PARTITION BY p_type, fit ORDER BY count(*) DESC, name) AS r FROM x CROSS JOIN fits WHERE fold <> fit GROUP BY 1, 2, 3) WHERE r <= 20),
lx AS (SELECT x.*, fit, CASE WHEN top.name IS NULL THEN 'other' ELSE x.name END AS lev FROM x CROSS JOIN fits LEFT JOIN top USING (p_type, fit, name)),
mn AS (SELECT p_type, fit, lev, avg(x) AS mx, avg(y) AS my FROM lx WHERE fold <> fit GROUP BY 1, 2, 3),
sl AS (SELECT lx.p_type, lx.fit, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS s FROM lx JOIN mn USING (p_type, fit, lev) WHERE fold <> fit GROUP BY 1, 2),
oof AS (SELECT lx.*, my + s * (lx.x - mx) AS yhat FROM lx JOIN mn USING (p_type, fit, lev) JOIN sl USING (p_type, fit))"""


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), "p_brand", F.col("p_name").alias("name"), F.split("p_name", " ").getItem(0).alias("kind"), F.col("p_size").alias("size"), F.log("p_retailprice").alias("y"))


def _levels_model(spark: SparkSession, d: str) -> hedonic.HedonicModel:
    return hedonic.hedonic_model(_attributes(spark, d), "type", "p_brand", ["name"], ["size"], "y", kind="kind")


@query(f"""WITH {_LEVELS}, k AS (SELECT p_type, kind, avg(abs(y - yhat)) AS mae, count(*) AS c FROM oof WHERE fit = fold GROUP BY 1, 2), km AS (SELECT p_type, array_to_string(list(kind || ':' || c ORDER BY kind), ',') AS kinds, max(mae) AS worst_mae, sum(c * mae) / sum(c) AS mae FROM k GROUP BY 1)
SELECT o.p_type AS type, count(*) AS n, count(*) AS covered, CAST(22 AS BIGINT) AS n_features, count(DISTINCT p_brand) AS n_groups, round(sqrt(avg(pow(y - yhat, 2))), 4) + 0.0 AS rmse, round(1 - avg(pow(y - yhat, 2)) / var_pop(y), 3) + 0.0 AS r2, any_value(kinds) AS kinds, round(any_value(worst_mae), 4) + 0.0 AS worst_mae, round(any_value(mae), 4) + 0.0 AS mae
FROM oof o JOIN km ON km.p_type = o.p_type WHERE fit = fold GROUP BY 1""")
def hedonic_levels(spark: SparkSession, d: str) -> DataFrame:
    m = _levels_model(spark, d).metrics
    kinds = F.array_join(F.transform(F.map_entries("covered_by_kind"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    entries = F.map_entries("mae_by_kind")
    mae = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at("covered_by_kind", e["key"])) / F.col("covered")
    return m.select("type", "n", "covered", F.col("n_features").cast("long").alias("n_features"), "n_groups", (F.round("rmse", 4) + 0.0).alias("rmse"), (F.round("r2", 3) + 0.0).alias("r2"), kinds.alias("kinds"), (F.round(F.array_max(F.map_values("mae_by_kind")), 4) + 0.0).alias("worst_mae"), (F.round(mae, 4) + 0.0).alias("mae"))


@query(f"WITH {_LEVELS} SELECT id, round(yhat, 4) + 0.0 AS hedonic_log FROM oof WHERE fit = -1")
def hedonic_predict(spark: SparkSession, d: str) -> DataFrame:
    p = hedonic.hedonic_predict(_attributes(spark, d), _levels_model(spark, d).coefficients, "type", ["name"], ["size"])
    return rounded(p.select("id", "hedonic_log"), 4)


def _round_sql(k: int, last: str, rows: str) -> str:
    """Round k of the weighted ridge with a constant, a number and its missing indicator, solved by hand: a number and its indicator never meet."""
    return f"""s{k} AS (SELECT type, sum(w) AS s0, sum(w * z) AS sx, sum(w * m) AS sm, sum(w * z * z) + 2 AS xx, sum(w * m) + 2 AS mm, sum(w * y) AS sy, sum(w * z * y) AS xy, sum(w * m * y) AS my FROM {last} GROUP BY 1),
a{k} AS (SELECT *, (sy - sx * xy / xx - sm * my / mm) / (s0 - sx * sx / xx - sm * sm / mm) AS a FROM s{k}), b{k} AS (SELECT type, a, (xy - sx * a) / xx AS b, (my - sm * a) / mm AS c FROM a{k}),
e{k} AS (SELECT t.id, t.type, t.z, t.m, t.y, t.y - a - b * t.z - c * t.m AS e FROM {rows} t JOIN b{k} USING (type)), c{k} AS (SELECT type, quantile_cont(e, 0.5) AS ctr FROM e{k} GROUP BY 1), l{k} AS (SELECT type, 1.5 * greatest(1e-6, 1.4826 * quantile_cont(abs(e - ctr), 0.5)) AS lim FROM e{k} JOIN c{k} USING (type) GROUP BY 1),
r{k} AS (SELECT e{k}.id, e{k}.type, z, m, y, CASE WHEN abs(e - ctr) <= lim THEN 1.0 ELSE lim / abs(e - ctr) END AS w FROM e{k} JOIN c{k} USING (type) JOIN l{k} USING (type))"""


_FAIR = f"""p AS (SELECT p_partkey AS id, p_type AS type, DATE '1998-01-01' + CAST(p_partkey * 7 % 600 AS INTEGER) AS dt, CAST(p_size % 5 AS INTEGER) AS lagged, p_retailprice * (1 + p_partkey % 97 / 50.0) AS price, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS x, p_size % 11 / 10.0 AS quality FROM part),
el AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY dt, id) AS r, count(*) OVER (PARTITION BY type) AS n FROM p WHERE dt < DATE '1999-06-01' AND dt + lagged <= DATE '1999-06-01'),
bl AS (SELECT *, CASE WHEN r <= n - least(greatest(1, floor(n * 0.25)), n - 1) THEN 'train' ELSE 'calibrate' END AS block FROM el),
sc AS (SELECT type, quantile_cont(x, 0.5) AS mid, greatest(1e-6, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349) AS sc, count(*) AS n_training FROM bl WHERE block = 'train' GROUP BY 1),
al AS (SELECT p.*, coalesce((x - mid) / sc, 0) AS z, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS m, ln(price) AS y, 1.0 AS w FROM p JOIN sc USING (type)), tn AS (SELECT al.id, al.type, al.z, al.m, al.y, al.w FROM al JOIN bl ON bl.id = al.id WHERE block = 'train'),
{_round_sql(1, "tn", "tn")}, {_round_sql(2, "r1", "tn")}, {_round_sql(3, "r2", "tn")},
cb AS (SELECT type, count(*) AS n_calibration, {", ".join(f"quantile_cont(y - a - b * z - c * m, {p}) AS {q}" for q, p in hedonic.QUANTILES.items())} FROM (SELECT al.type, al.y, al.z, al.m FROM al JOIN bl ON bl.id = al.id WHERE block = 'calibrate') JOIN b3 USING (type) GROUP BY 1),
st AS (SELECT sc.type, n_training, n_calibration, CASE WHEN n_training < 40 OR n_calibration < 12 THEN 'quarantined' ELSE 'research_only' END AS status FROM sc JOIN cb USING (type)),
es AS (SELECT al.id, al.type, price, quality, st.status, st.n_training, st.n_calibration, {", ".join(f"exp(a + b * z + c * m + {q}) AS {q}" for q in hedonic.QUANTILES)} FROM al JOIN b3 USING (type) JOIN cb USING (type) JOIN st USING (type))"""


@query(f"""WITH {_FAIR} SELECT id, {", ".join(f"round({q}, 3) + 0.0 AS {q}" for q in hedonic.QUANTILES)}, CASE WHEN price < q25 THEN 'below_range' WHEN price > q75 THEN 'above_range' ELSE 'within_range' END AS position, status,
round(CASE WHEN status = 'quarantined' THEN 0 ELSE least(79, 100 * quality * least(1, n_training / 80.0, n_calibration / 24.0)) END, 4) + 0.0 AS confidence FROM es""")
def fair_value(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    at = F.date_add(F.lit("1998-01-01").cast("date"), (k * 7 % 600).cast("int"))
    p = b.table(spark, d, "part").select(k.alias("id"), F.col("p_type").alias("type"), at.alias("at"), F.date_add(at, size % 5).alias("available"), (F.col("p_retailprice") * (1 + k % 97 / 50.0)).alias("price"), F.when(k % 13 != 0, size).alias("x"), (size % 11 / 10.0).alias("quality"))
    model = hedonic.fair_value(p, "type", "id", "at", "available", "price", F.lit("1999-06-01").cast("date"), ["x"], [])
    out = hedonic.fair_estimates(p, model.models, "type", "price", "quality", ["x"], [])
    return out.select("id", *[(F.round(q, 3) + 0.0).alias(q) for q in hedonic.QUANTILES], "position", "status", (F.round("confidence", 4) + 0.0).alias("confidence"))


@query()
def robust_fair_value(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("x"), F.log("p_retailprice").alias("y"))
    return rounded(regress.robust_fair_value(p, "type", ["x"], "y").select("id", "type", "fair", "position"))


@query("""WITH l AS (SELECT p_type AS type, p_brand AS model, avg(p_size) AS loss FROM part GROUP BY 1, 2), w AS (SELECT type, model, greatest(0.05, exp(-loss / quantile_cont(loss, 0.5) OVER (PARTITION BY type))) AS w FROM l) SELECT type, model, round(w / sum(w) OVER (PARTITION BY type), 6) + 0.0 AS weight FROM w""")
def model_weights(spark: SparkSession, d: str) -> DataFrame:
    losses = b.table(spark, d, "part").groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("model")).agg(F.avg("p_size").alias("loss"))
    return rounded(stats.model_weights(losses, ["type"], "model", "loss"))
