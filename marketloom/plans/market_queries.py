"""The daily pass, point-in-time reads, joins by time, windows and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import asof, market, pit, stats, windows
from marketloom.operators.index import cohort_return, index_levels, lifecycle_curve
from marketloom.plans import bindings as b
from marketloom.plans.registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """df with doubles rounded, so that the order of additions does not show."""
    return df.select(*[R(F.col(c), n).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def metrics(spark: SparkSession, d: str) -> DataFrame:
    f = b.facts(spark, d)
    return market.market_metrics(f, b.as_of_day(f), b.SERIES)


METRICS = f"""{b.FACTS}, {b.AS_OF},
raw AS (SELECT facts.* FROM facts, ad WHERE day BETWEEN as_of - 368 AND as_of),
today AS (SELECT category, grp, max(price) AS current_price FROM raw, ad WHERE day = as_of GROUP BY 1, 2),
daily AS (SELECT category, grp, day, max(price) AS price FROM raw WHERE price > 0 GROUP BY 1, 2, 3),
win AS (SELECT *, lag(price) OVER s AS pp, lag(day) OVER s AS pd, max(price) OVER (PARTITION BY category, grp ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM daily WINDOW s AS (PARTITION BY category, grp ORDER BY day)),
enr AS (SELECT *, ln(price / pp) / sqrt(day - pd) AS r, 1 - price / peak AS dd FROM win),
agg AS (SELECT category, grp, count(*) AS n, {", ".join(f"arg_max(price, day) FILTER (WHERE day BETWEEN as_of - {h + 3} AND as_of - {h}) AS ref{h}" for h in market.HORIZONS)},
  CASE WHEN count(*) FILTER (WHERE day >= as_of - 30) > 1 THEN regr_slope(ln(price), day - DATE '1970-01-01') FILTER (WHERE day >= as_of - 30) END AS slope, stddev_samp(r) FILTER (WHERE day >= as_of - 30) AS vol, max(dd) AS dd FROM enr, ad GROUP BY 1, 2),
metrics AS (SELECT today.category, today.grp, CASE WHEN current_price > 0 THEN current_price END AS current_price, coalesce(n, 0) AS observation_count,
  {", ".join(f"CASE WHEN current_price > 0 AND ref{h} > 0 THEN current_price / ref{h} - 1 END AS return_{h}d" for h in market.HORIZONS)},
  CASE WHEN isfinite(slope) THEN slope END AS daily_log_slope_30d, vol AS volatility_30d, dd AS max_drawdown_365d, least(1.0, n / 366.0) AS history_density_365d
  FROM today LEFT JOIN agg USING (category, grp))"""

_M = ["current_price", *[f"return_{h}d" for h in market.HORIZONS], "daily_log_slope_30d", "volatility_30d", "max_drawdown_365d", "history_density_365d"]


def _round_sql(cols: list[str], n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c in cols)


@query(f"WITH {METRICS} SELECT category, grp, observation_count, {_round_sql(_M)} FROM metrics")
def market_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics(spark, d))


_OK = "current_price > 0 AND observation_count >= 14 AND history_density_365d IS NOT NULL AND daily_log_slope_30d IS NOT NULL AND volatility_30d IS NOT NULL"
_Z = "(daily_log_slope_30d / greatest(volatility_30d, 0.01))"
_SCORE = f"""least(100, greatest(0, 45 + least(25, greatest(-25, coalesce(return_30d, 0) * 100)) + 18 * tanh({_Z}) + 12 * (1 - least(1, greatest(0, volatility_30d / 0.15)))
  + 10 * history_density_365d - 15 * least(1, greatest(0, coalesce(max_drawdown_365d, 0)))))"""


@query(f"""WITH {METRICS}, s AS (SELECT category, grp, CASE WHEN {_OK} THEN round({_SCORE}, 4) + 0.0 END AS opportunity_score,
  CASE WHEN {_OK} THEN round(least(100, greatest(0, history_density_365d * 70 + least(observation_count / 90, 1) * 30)), 4) + 0.0 END AS trend_confidence,
  CASE WHEN NOT coalesce({_OK}, false) THEN 'insufficient' WHEN {_Z} >= 0.35 THEN 'strong_rise' WHEN {_Z} >= 0.12 THEN 'rise' WHEN {_Z} <= -0.35 THEN 'strong_fall' WHEN {_Z} <= -0.12 THEN 'fall' ELSE 'stable' END AS trend_status FROM metrics)
SELECT *, CASE WHEN opportunity_score >= 70 THEN 'candidate' WHEN opportunity_score <= 30 THEN 'risk' WHEN opportunity_score IS NOT NULL THEN 'neutral' ELSE 'insufficient' END AS opportunity_status FROM s""")
def shadow_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.shadow_score(metrics(spark, d)).select("category", "grp", "opportunity_score", "trend_confidence", "trend_status", "opportunity_status"), 4)


_DRIFT = "least(0.70, greatest(-0.70, daily_log_slope_30d * horizon * 0.25))"
_SIG = "least(1.20, greatest(0.05, volatility_30d * sqrt(horizon) * 0.75))"
_T = f"(1 / (1 + 0.3275911 * abs({_DRIFT} / {_SIG}) / sqrt(2)))"
_POLY = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))))"
_ERF = f"(1 - {_POLY} * exp(-({_DRIFT} / {_SIG}) * ({_DRIFT} / {_SIG}) / 2))"


@query(f"""WITH {METRICS} SELECT category, grp, CAST(horizon AS BIGINT) AS horizon, {", ".join(f"round(current_price * exp({_DRIFT} + {z} * {_SIG}), 4) + 0.0 AS {q}" for q, z in market.Z.items())},
  round(CASE WHEN {_DRIFT} >= 0 THEN 0.5 * (1 + {_ERF}) ELSE 0.5 * (1 - {_ERF}) END, 4) + 0.0 AS probability_up,
  round(least(100, greatest(0, least(100, greatest(0, history_density_365d * 75 + least(observation_count / 365, 1) * 25)) * sqrt(30 / horizon))), 4) + 0.0 AS confidence
FROM metrics, (SELECT unnest([30, 90, 180, 365]) AS horizon) WHERE {_OK}""")
def shadow_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.shadow_bands(metrics(spark, d), b.SERIES), 4)


@query(f"""WITH {METRICS}, r AS (SELECT grp, count(*) AS series_count, count(current_price) AS priced_series_count, quantile_cont(return_30d, 0.5) AS median_return_30d,
  avg(CASE WHEN return_30d IS NOT NULL THEN CASE WHEN return_30d > 0 THEN 1.0 ELSE 0.0 END END) AS breadth_30d, quantile_cont(volatility_30d, 0.5) AS median_volatility_30d FROM metrics GROUP BY grp),
g AS (SELECT DISTINCT grp FROM facts), j AS (SELECT g.grp, coalesce(series_count, 0) AS series_count, coalesce(priced_series_count, 0) AS priced_series_count, median_return_30d, breadth_30d, median_volatility_30d FROM g LEFT JOIN r ON g.grp = r.grp)
SELECT grp, series_count, priced_series_count, round(median_return_30d, 6) + 0.0 AS median_return_30d, round(breadth_30d, 6) + 0.0 AS breadth_30d, round(median_volatility_30d, 6) + 0.0 AS median_volatility_30d,
  CASE WHEN priced_series_count >= 3 AND median_return_30d IS NOT NULL AND breadth_30d IS NOT NULL THEN round(least(100, greatest(0, 50 + least(25, greatest(-25, median_return_30d * 100)) + (breadth_30d - 0.5) * 30 - 10 * least(1, greatest(0, coalesce(median_volatility_30d, 0) / 0.20)))), 4) + 0.0 END AS hotness_score,
  CASE WHEN priced_series_count >= 3 AND median_return_30d IS NOT NULL AND breadth_30d IS NOT NULL THEN 'available' ELSE 'insufficient' END AS feature_status FROM j""")
def set_hotness(spark: SparkSession, d: str) -> DataFrame:
    groups = b.facts(spark, d).select("grp")
    return rounded(market.set_hotness(market.set_metrics(metrics(spark, d), groups, ["grp"]), least_priced=3))


_CUT = "TIMESTAMP '2024-01-20 00:00:00'"
_PIT = f"{b.OBS}, w AS (SELECT *, row_number() OVER (PARTITION BY series, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM obs WHERE observed_at <= {_CUT} AND available_at <= {_CUT}), pit AS (SELECT * FROM w WHERE rn = 1)"


def cutoff() -> F.Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query(f"WITH {_PIT} SELECT series, count(*) AS points, max(id) AS last_id, round(sum(price), 4) + 0.0 AS total FROM pit GROUP BY series")
def point_in_time(spark: SparkSession, d: str) -> DataFrame:
    p = pit.point_in_time(b.observations(spark, d), cutoff())
    return rounded(p.groupBy("series").agg(F.count("*").alias("points"), F.max("id").alias("last_id"), F.sum("price").alias("total")), 4)


@query(f"""WITH {b.OBS}, w AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'quarantined' ELSE 'accepted' END AS status, row_number() OVER (PARTITION BY series, observed_at ORDER BY available_at DESC, id DESC) AS rn
  FROM obs WHERE observed_at <= {_CUT} AND available_at <= {_CUT}) SELECT series, count(*) AS points, sum(id) AS ids FROM w WHERE rn = 1 AND status = 'accepted' GROUP BY series""")
def point_in_time_all_status(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d).withColumn("status", F.when(F.col("id") % 9 == 0, "quarantined").otherwise("accepted"))
    return pit.point_in_time_all_status(o, cutoff()).groupBy("series").agg(F.count("*").alias("points"), F.sum("id").alias("ids"))


@query(f"""WITH {b.OBS}, o AS (SELECT unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-30']) AS origin),
w AS (SELECT origin, obs.*, row_number() OVER (PARTITION BY origin, series, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM obs, o WHERE observed_at <= origin AND available_at <= origin AND observed_at >= origin - INTERVAL 14 DAY)
SELECT origin, series, count(*) AS points, round(avg(price), 8) + 0.0 AS mean_price FROM w WHERE rn = 1 GROUP BY 1, 2""")
def point_in_time_many(spark: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(*[F.lit(f"2024-01-{x} 00:00:00").cast("timestamp") for x in (10, 20, 30)]))
    origins = spark.range(1).select(days.alias("origin"))
    p = pit.point_in_time_many(b.observations(spark, d), origins, lookback_days=14)
    return rounded(p.groupBy("origin", "series").agg(F.count("*").alias("points"), F.avg("price").alias("mean_price")), 8)


@query(f"""WITH {b.OBS}, h AS (SELECT a.id, a.price, x.price AS hp FROM obs a JOIN obs x ON a.series = x.series AND x.observed_at < a.observed_at AND x.observed_at >= a.observed_at - INTERVAL 7 DAY AND x.available_at <= a.available_at
  QUALIFY row_number() OVER (PARTITION BY a.id, x.observed_at ORDER BY x.available_at DESC, x.id DESC) = 1),
m AS (SELECT id, count(*) AS n, quantile_cont(ln(hp), 0.5) AS c, mad(ln(hp)) AS mad FROM h GROUP BY id)
SELECT obs.id, CASE WHEN coalesce(n, 0) >= 7 AND CASE WHEN mad = 0 THEN abs(ln(price) - c) > ln(3) ELSE abs(ln(price) - c) / (1.4826 * mad) > 3 END THEN 'outlier' ELSE 'accepted' END AS status FROM obs LEFT JOIN m ON obs.id = m.id""")
def outlier_status(spark: SparkSession, d: str) -> DataFrame:
    return pit.outlier_status(b.observations(spark, d), z=3.0, window_days=7).select("id", "status")


@query(f"""WITH RECURSIVE {b.OBS}, s AS (SELECT *, ln(price) AS x, row_number() OVER (PARTITION BY series ORDER BY available_at, observed_at, id) AS i FROM obs),
r AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(o TIMESTAMP, a TIMESTAMP, k BIGINT, x DOUBLE)[]) AS acc, CAST(0 AS BIGINT) AS id, false AS far FROM s
UNION ALL SELECT series, i, CASE WHEN bad THEN acc ELSE list_append(acc, {{'o': observed_at, 'a': available_at, 'k': id, 'x': x}}) END, id, bad FROM (
  SELECT *, len(h) >= 7 AND CASE WHEN mad = 0 THEN abs(x - c) > ln(3) ELSE abs(x - c) / (1.4826 * mad) > 3 END AS bad FROM (
    SELECT *, list_aggregate(list_transform(h, lambda v: abs(v.x - c)), 'median') AS mad FROM (
      SELECT *, list_aggregate(list_transform(h, lambda v: v.x), 'median') AS c FROM (
        SELECT * REPLACE (list_filter(h, lambda v: len(list_filter(h, lambda u: u.o = v.o AND (u.a > v.a OR (u.a = v.a AND u.k > v.k)))) = 0) AS h) FROM (
          SELECT s.series, s.i, s.id, s.x, s.observed_at, s.available_at, r.acc, list_filter(r.acc, lambda v: v.o < s.observed_at AND v.o >= s.observed_at - INTERVAL 7 DAY AND v.a <= s.available_at) AS h FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1)))))
)
SELECT id, CASE WHEN far THEN 'outlier' ELSE 'accepted' END AS status FROM r WHERE i > 0""")
def outlier_status_sequential(spark: SparkSession, d: str) -> DataFrame:
    return pit.outlier_status_sequential(b.observations(spark, d), z=3.0, window_days=7).select("id", "status")


@query(f"""WITH {b.OBS}, r AS (SELECT id, price - 20 AS price, series AS record FROM obs), m AS (SELECT DISTINCT series AS record, series * 7 AS variant, CASE WHEN series % 4 = 0 THEN 0.9 ELSE 0.99 END AS confidence FROM obs WHERE series % 5 <> 0),
p AS (SELECT r.id, CASE WHEN variant IS NULL THEN 'unresolved_exact_mapping' WHEN confidence < 0.98 THEN 'mapping_not_approved' WHEN price IS NULL THEN 'source_value_missing' WHEN price <= 0 THEN 'non_positive_price' END AS reason FROM r LEFT JOIN m ON r.record = m.record)
SELECT coalesce(reason, 'none') AS reason, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'source_value_missing' THEN 'missing' ELSE 'rejected' END AS status, count(*) AS n FROM p GROUP BY 1, 2""")
def prepare_observations(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d)
    raw = o.select("id", (F.col("price") - 20).alias("price"), F.col("series").alias("record"))
    maps = o.where(F.col("series") % 5 != 0).select(F.col("series").alias("record")).distinct().select("record", (F.col("record") * 7).alias("variant"), F.when(F.col("record") % 4 == 0, 0.9).otherwise(0.99).alias("confidence"))
    return pit.prepare_observations(raw, maps).groupBy(F.coalesce("reason", F.lit("none")).alias("reason"), "status").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, rule FROM lineitem, (SELECT unnest(['quantity_range', 'discount_small', 'tax_known']) AS rule)
WHERE CASE rule WHEN 'quantity_range' THEN NOT (l_quantity BETWEEN 1 AND 45) WHEN 'discount_small' THEN NOT (l_discount <= 0.09) ELSE l_tax IS NULL END""")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return pit.validate_rows(rows, "id", {"quantity_range": F.col("l_quantity").between(1, 45), "discount_small": F.col("l_discount") <= 0.09, "tax_known": F.col("l_tax").isNotNull()})


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, 'l_partkey' AS "column" FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_suppkey' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <> 5)""")
def foreign_key_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    parts, supp = b.table(spark, d, "part").where("p_size > 3"), b.table(spark, d, "supplier").where("s_nationkey <> 5")
    return pit.foreign_key_violations(rows, "id", {"l_partkey": (parts, "p_partkey"), "l_suppkey": (supp, "s_suppkey")})


@query("""WITH x AS (SELECT o_custkey % 20 AS k, CAST(o_orderkey AS VARCHAR) AS line FROM orders), p AS (SELECT k, ('0x' || sha256(line)[1:8])::BIGINT % 16 AS bkt, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM x GROUP BY 1, 2)
SELECT k, sha256(string_agg(h, chr(10) ORDER BY bkt)) AS set_hash FROM p GROUP BY k""")
def ordered_set_hash(spark: SparkSession, d: str) -> DataFrame:
    return pit.ordered_set_hash(b.table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 20), ["k"], F.col("o_orderkey").cast("string"))


@query("""SELECT o_custkey AS custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS orderkey FROM orders GROUP BY 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return pit.latest_version(o, ["custkey"], "v").select("custkey", "orderkey")


@query("""SELECT o_custkey AS custkey, o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER w AS DATE) AS valid_to, row_number() OVER w AS version
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def supersede_mappings(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.struct("o_orderdate", "o_orderkey").alias("start"))
    s = pit.supersede(o, ["custkey"], "start")
    return s.select("custkey", "orderkey", F.to_date("valid_from.o_orderdate").alias("valid_from"), F.to_date("valid_to.o_orderdate").alias("valid_to"), F.col("version").cast("long").alias("version"))


@query("""WITH t AS (SELECT p_partkey AS k FROM part), e AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40), u AS (SELECT p_partkey AS k FROM part WHERE p_size < 10 UNION SELECT p_partkey + 1000000 FROM part WHERE p_size = 1)
SELECT coalesce(t.k, e.k, u.k) AS k, CASE WHEN t.k IS NULL THEN 'unexpected' WHEN e.k IS NOT NULL AND u.k IS NOT NULL THEN 'both' WHEN e.k IS NOT NULL THEN 'covered' WHEN u.k IS NOT NULL THEN 'unavailable' ELSE 'uncovered' END AS state
FROM t FULL JOIN e ON t.k = e.k FULL JOIN u ON coalesce(t.k, e.k) = u.k""")
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    t = p.select(F.col("p_partkey").alias("k"))
    e = b.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"))
    u = p.where("p_size < 10").select(F.col("p_partkey").alias("k")).union(p.where("p_size = 1").select((F.col("p_partkey") + 1000000).alias("k")))
    return pit.coverage_union(t, e, u, "k")


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey % 97 AS identity, CAST(o_orderdate AS TIMESTAMP) AS available_at FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 97 END AS identity FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(l.id, n.id) AS id, coalesce(l.identity, n.identity) AS identity, coalesce(available_at, TIMESTAMP '2030-01-01') AS available_at, coalesce(l.identity <> n.identity, false) AS conflict FROM l FULL JOIN n ON l.id = n.id""")
def first_seen_merge(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    ledger = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).alias("identity"), F.col("o_orderdate").cast("timestamp").alias("available_at"))
    batch = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey") % 97).alias("identity"))
    return pit.first_seen_merge(ledger, batch, F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query("""WITH m AS (SELECT p_brand AS source, max(l_quantity) AS lag_hours, count(*) AS total, count(*) FILTER (WHERE l_discount > 0.07) AS quarantined, count(*) FILTER (WHERE l_tax = 0.08) % 2 AS pending FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT *, CASE WHEN total > 0 THEN quarantined / total ELSE 0 END AS share FROM m)
SELECT source, CASE WHEN total = 0 THEN 'blocked' WHEN lag_hours > 49.5 THEN 'failed' WHEN share > 0.28 THEN 'degraded' WHEN pending > 0 THEN 'review_required' ELSE 'healthy' END AS health,
  CAST((lag_hours > 49.5)::INT + (share > 0.28)::INT + (pending > 0)::INT + (total = 0)::INT AS BIGINT) AS n_alerts FROM s""")
def pipeline_health(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = rows.groupBy(F.col("p_brand").alias("source")).agg(F.max("l_quantity").alias("lag_hours"), F.count("*").alias("total"), F.count_if(F.col("l_discount") > 0.07).alias("quarantined"), (F.count_if(F.col("l_tax") == 0.08) % 2).alias("pending"))
    return pit.pipeline_health(m, 49.5, 0.28).select("source", "health", F.size("alerts").cast("long").alias("n_alerts"))


@query(f"""WITH {b.FACTS}, daily AS (SELECT category, grp, day, max(price) AS price FROM facts GROUP BY 1, 2, 3), o AS (SELECT o_orderkey AS id, p_type AS category, p_brand AS grp, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1)
SELECT o.id, CASE WHEN o.day - d.day <= 3 THEN round(d.price, 6) + 0.0 END AS price, CASE WHEN o.day - d.day <= 3 THEN d.day END AS price_at FROM o ASOF LEFT JOIN daily d ON o.category = d.category AND o.grp = d.grp AND o.day >= d.day""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    daily = b.facts(spark, d).groupBy("category", "grp", "day").agg(F.max("price").alias("price"))
    o = b.table(spark, d, "orders").join(b.table(spark, d, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    left = o.select(F.col("o_orderkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("grp"), F.to_date("o_orderdate").alias("day"))
    return rounded(asof.asof_backward(left, daily, ["category", "grp"], "day", "price", 3).select("id", "price", "price_at"))


@query(f"""WITH {b.FACTS}, daily AS (SELECT category, grp, day, max(price) AS price FROM facts GROUP BY 1, 2, 3), g AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-30', INTERVAL 28 DAY)) AS DATE) AS day), c AS (SELECT DISTINCT category, grp, g.day FROM daily, g)
SELECT c.category, c.grp, c.day, round(d.price, 6) + 0.0 AS price FROM c ASOF LEFT JOIN daily d ON c.category = d.category AND c.grp = d.grp AND c.day >= d.day""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    daily = b.facts(spark, d).groupBy("category", "grp", "day").agg(F.max("price").alias("price"))
    grid = spark.range(1).select(F.explode(F.expr("sequence(date '1996-01-01', date '1996-12-30', interval 28 days)")).alias("day"))
    return rounded(asof.carry_forward(daily, grid, ["category", "grp"], "day", "price"))


@query("""WITH e AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity > 48) SELECT s_suppkey AS k, CAST(DATE '1998-01-01' - max(day) AS BIGINT) AS event_age_days FROM supplier LEFT JOIN e ON s_suppkey = k AND day <= DATE '1998-01-01' GROUP BY 1""")
def event_age(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day"))
    t = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return rounded(asof.event_age(t, e, F.lit("1998-01-01").cast("date"), "k", "day"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + 20 AS hi FROM orders), e AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderkey AS other FROM orders)
SELECT a.o_orderkey AS id, other FROM a JOIN e ON a.k = e.k AND day BETWEEN lo AND hi WHERE other <> a.o_orderkey""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    left = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("day").alias("lo"), F.date_add("day", 20).alias("hi"))
    right = o.select(F.col("o_custkey").alias("k"), "day", F.col("o_orderkey").alias("other"))
    return asof.interval_join(left, right, ["k"], "lo", "hi", "day").where("id <> other").select("id", "other")


@query("""WITH c AS (SELECT p_brand AS brand, p_type AS type, p_size % 5 AS grade, p_partkey AS id, p_size AS stamp, CASE WHEN p_size < 25 THEN 1 ELSE p_partkey % 2 END AS identity FROM part),
g AS (SELECT brand, type, grade, arg_max(id, stamp::BIGINT * 100000000 + id) AS id FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT identity) = 1)
SELECT p_partkey AS item, g.id FROM part LEFT JOIN g ON p_brand = brand AND p_type = type AND p_size % 5 = grade""")
def select_exact(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (F.col("p_size") % 5).alias("grade"), F.col("p_size").alias("stamp"))
    c = p.withColumn("identity", F.when(F.col("stamp") < 25, F.lit(1)).otherwise(F.col("item") % 2)).withColumnRenamed("item", "id")
    return asof.select_exact(p.select("item", "brand", "type", "grade"), c, ["brand", "type", "grade"], "stamp", "id").select("item", "id")


_Y = f"{b.FACTS}, daily AS (SELECT category, day, max(price) AS price FROM facts WHERE day BETWEEN DATE '1997-03-01' AND DATE '1997-05-30' GROUP BY 1, 2)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return b.facts(spark, d).where("day between date '1997-03-01' and date '1997-05-30'").groupBy("category", "day").agg(F.max("price").alias("price"))


@query(f"WITH {_Y} SELECT x.category, round(quantile_cont((ln(y.price) - ln(x.price)) / (y.day - x.day), 0.5), 8) + 0.0 AS slope FROM daily x JOIN daily y ON x.category = y.category AND y.day > x.day GROUP BY 1")
def theil_sen_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.theil_sen_slope(_daily(spark, d), ["category"]), 8)


@query(f"WITH {_Y}, s AS (SELECT category, ln(price / lag(price) OVER w) / sqrt(day - lag(day) OVER w) AS r FROM daily WINDOW w AS (PARTITION BY category ORDER BY day)) SELECT category, round(1.4826 * mad(r), 6) + 0.0 AS volatility FROM s WHERE r IS NOT NULL GROUP BY 1")
def mad_volatility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mad_volatility(_daily(spark, d), ["category"]))


@query(f"WITH {_Y}, s AS (SELECT category, price, max(price) OVER (PARTITION BY category ORDER BY day ROWS UNBOUNDED PRECEDING) AS p FROM daily) SELECT category, round(max((p - price) / p), 6) + 0.0 AS max_drawdown FROM s GROUP BY 1")
def max_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.max_drawdown(_daily(spark, d), ["category"]))


@query(f"WITH {b.FACTS} SELECT category, grp, round(least(1.0, count(DISTINCT day) / 183.0), 6) + 0.0 AS density FROM facts WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-07-02' GROUP BY 1, 2")
def history_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.history_density(b.facts(spark, d), b.SERIES, F.lit("1997-01-01").cast("date"), F.lit("1997-07-02").cast("date")))


@query(f"WITH {b.FACTS}, r AS (SELECT category, grp, price, row_number() OVER (PARTITION BY category, grp ORDER BY price) AS i, count(*) OVER (PARTITION BY category, grp) AS n FROM facts) SELECT category, grp, round(avg(price) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 6) + 0.0 AS trimmed_mean, max(n) AS n FROM r GROUP BY 1, 2")
def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.trimmed_mean(b.facts(spark, d), b.SERIES, "price"))


@query(f"WITH {b.FACTS}, r AS (SELECT category, ln(price) AS v, row_number() OVER (PARTITION BY category ORDER BY price) AS i, count(*) OVER (PARTITION BY category) AS n FROM facts) SELECT category, round(avg(v) FILTER (WHERE i > floor(n * 0.2) AND i <= n - floor(n * 0.2)), 6) + 0.0 AS trimmed_mean, max(n) AS n FROM r GROUP BY 1")
def trimmed_mean_of_large(spark: SparkSession, d: str) -> DataFrame:
    f = b.facts(spark, d).select("category", F.log("price").alias("v"))
    return rounded(stats.trimmed_mean_of_large(f, ["category"], "v", 0.2, cell=0.05))


@query(f"WITH {b.FACTS} SELECT category, round(quantile_cont(price, 0.1), 6) + 0.0 AS q10, round(quantile_cont(price, 0.5), 6) + 0.0 AS q50, round(quantile_cont(price, 0.9), 6) + 0.0 AS q90 FROM facts GROUP BY 1")
def empirical_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.empirical_quantile(b.facts(spark, d), ["category"], "price", (0.1, 0.5, 0.9)))


@query(f"WITH {b.FACTS}, r AS (SELECT category, grp, price, row_number() OVER (PARTITION BY category, grp ORDER BY price) - 1 AS i, count(*) OVER (PARTITION BY category, grp) AS n FROM facts) SELECT category, grp, round(price, 6) + 0.0 AS lower_percentile FROM r WHERE i = floor(0.05 * (n - 1))")
def lower_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.lower_percentile(b.facts(spark, d), b.SERIES, "price", 0.05))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand || p_type AS g, p_retailprice AS v FROM part) SELECT a.id, round(quantile_cont(x.v, 0.25), 6) + 0.0 AS others FROM p a JOIN p x ON a.g = x.g AND a.id <> x.id GROUP BY 1""")
def leave_one_out_quantile(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("g"), F.col("p_retailprice").alias("v"))
    return rounded(stats.leave_one_out_quantile(p, ["g"], "id", "v", 0.25).select("id", "others"))


@query("""WITH c AS (SELECT p_type, quantile_cont(p_retailprice, 1/3.0) AS a, quantile_cont(p_retailprice, 2/3.0) AS z FROM part GROUP BY 1) SELECT p_partkey AS id, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= z THEN 'mid' ELSE 'high' END AS bucket FROM part JOIN c USING (p_type)""")
def tercile_bucket(spark: SparkSession, d: str) -> DataFrame:
    return stats.tercile_bucket(b.table(spark, d, "part"), ["p_type"], "p_retailprice").select(F.col("p_partkey").alias("id"), "bucket")


@query("""WITH c AS (SELECT p_type, quantile_cont(p_retailprice, 0.5) AS m, (quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.349 AS s FROM part GROUP BY 1) SELECT p_partkey AS id, round((p_retailprice - m) / s, 6) + 0.0 AS scaled FROM part JOIN c USING (p_type)""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.robust_scale(b.table(spark, d, "part"), ["p_type"], "p_retailprice").select(F.col("p_partkey").alias("id"), "scaled"))


@query("""WITH g AS (SELECT quantile_cont(ln(p_retailprice), 0.5) AS g FROM part) SELECT p_brand AS level, round((sum(ln(p_retailprice)) + 10 * g) / (count(*) + 10) - g, 6) + 0.0 AS encoding FROM part, g GROUP BY p_brand, g HAVING count(*) >= 3""")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_brand").alias("level"), F.log("p_retailprice").alias("y"))
    return rounded(stats.target_encoding(p, "level", "y"))


@query("""WITH c AS (SELECT p_type AS type, p_brand AS brand, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, brand) AS rank FROM c) SELECT type, brand, n, rank FROM r WHERE rank <= 5""")
def categorical_top_k(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    return rounded(stats.categorical_top_k(p, ["type"], "brand", 5))


_PAN = b.PANEL
_W = "WINDOW w AS (PARTITION BY category, grp, product ORDER BY t)"
_STEPS = f"{_PAN}, steps AS (SELECT *, ln(price / lag(price) OVER w) / (t - lag(t) OVER w) AS r FROM panel {_W})"
KEYS = ["category", "grp", "product"]


@query(f"WITH {_STEPS} SELECT product, CAST(t AS BIGINT) AS t, round(r, 6) + 0.0 AS r FROM steps")
def step_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.step_returns(b.week_panel(spark, d), KEYS).select("product", "t", "r"))


@query(f"WITH {_PAN}, l AS (SELECT *, ln(price) AS y FROM panel) SELECT product, CAST(t AS BIGINT) AS t, round(CASE WHEN count(y) OVER w >= 2 THEN quantile_cont(y, 0.5) OVER w - y END, 6) + 0.0 AS reversion FROM l WINDOW w AS (PARTITION BY category, grp, product ORDER BY t RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)")
def level_reversion(spark: SparkSession, d: str) -> DataFrame:
    p = b.week_panel(spark, d).withColumn("y", F.log("price"))
    return rounded(windows.level_reversion(p, KEYS, "t", "y").select("product", "t", "reversion"))


@query(f"WITH {_PAN}, p AS (SELECT product, t, price, row_number() OVER (PARTITION BY product ORDER BY t) - 1 AS i, ceil(count(*) OVER (PARTITION BY product) / 8.0) AS s FROM panel) SELECT product, CAST(floor(i / s) AS BIGINT) AS bucket, round(avg(price), 8) + 0.0 AS price, CAST(max(t) AS BIGINT) AS t FROM p GROUP BY 1, 2")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.downsample(b.week_panel(spark, d), ["product"], "t", "price", 8), 8)


@query(f"WITH {b.FACTS} SELECT product, count(*) AS n, round(avg(price), 6) + 0.0 AS price FROM (SELECT *, max(day) OVER (PARTITION BY product) AS last FROM facts) WHERE day >= last - 365 GROUP BY 1")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.range_filter(b.facts(spark, d), ["product"], "day", 365).groupBy("product").agg(F.count("*").alias("n"), F.avg("price").alias("price")))


@query(f"""WITH {b.FACTS}, c AS (SELECT category, date_trunc('month', day)::DATE AS day, max(price) AS price FROM facts GROUP BY 1, 2), n AS (SELECT *, lead(day) OVER w AS nd, lead(price) OVER w AS np FROM c WINDOW w AS (PARTITION BY category ORDER BY day)),
x AS (SELECT *, unnest(generate_series(0, coalesce(nd - day - 1, 0))) AS i FROM n) SELECT category, CAST(day + CAST(i AS INTEGER) AS DATE) AS day, round(CASE WHEN nd IS NULL THEN price ELSE price + (np - price) * i / (nd - day) END, 6) + 0.0 AS price FROM x""")
def interpolate_daily(spark: SparkSession, d: str) -> DataFrame:
    c = b.facts(spark, d).groupBy("category", F.trunc("day", "month").alias("day")).agg(F.max("price").alias("price"))
    return rounded(windows.interpolate_daily(c, ["category"], "day", "price"))


@query(f"""WITH RECURSIVE {b.FACTS}, days AS (SELECT DISTINCT category, day FROM facts), taken AS (SELECT category, min(day) AS day FROM days GROUP BY 1 UNION ALL
  SELECT t.category, (SELECT min(d.day) FROM days d WHERE d.category = t.category AND d.day >= t.day + 90) FROM taken t WHERE EXISTS (SELECT 1 FROM days d WHERE d.category = t.category AND d.day >= t.day + 90)) SELECT category, day FROM taken""")
def spaced_origins(spark: SparkSession, d: str) -> DataFrame:
    return windows.spaced_origins(b.facts(spark, d), ["category"], "day", 90)


@query(f"""WITH {b.FACTS}, f AS (SELECT category, grp, day, max(price) > 1500 AS flag FROM facts GROUP BY 1, 2, 3), s AS (SELECT *, lag(flag) OVER w AS f1, lag(flag, 2) OVER w AS f2, lag(day) OVER w AS d1, lag(day, 2) OVER w AS d2 FROM f WINDOW w AS (PARTITION BY category, grp ORDER BY day))
SELECT category, grp, day, coalesce(flag AND f1 AND day - d1 BETWEEN 1 AND 20 AND f2 AND d1 - d2 BETWEEN 1 AND 20 AND day - d2 >= 6, false) AS streak FROM s""")
def flag_streak(spark: SparkSession, d: str) -> DataFrame:
    f = b.facts(spark, d).groupBy("category", "grp", "day").agg((F.max("price") > 1500).alias("flag"))
    return windows.flag_streak(f, ["category", "grp"], "day", "flag", 3, 1, 20, 6).select("category", "grp", "day", "streak")


@query(f"WITH {_PAN}, o AS (SELECT unnest([8, 16, 24]) AS origin) SELECT CAST(origin AS BIGINT) AS origin, category, round(mad(price), 6) + 0.0 AS mad FROM panel, o WHERE t <= origin GROUP BY 1, 2")
def expanding_mad(spark: SparkSession, d: str) -> DataFrame:
    o = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (8, 16, 24)])).alias("origin"))
    return rounded(windows.expanding_mad(b.week_panel(spark, d), o, ["category"], "t", "price"))


@query(f"WITH {_PAN} SELECT product, CAST(max(t) AS BIGINT) AS t, round(arg_max(price, t), 8) + 0.0 AS price FROM panel GROUP BY 1")
def last_known(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.last_known(b.week_panel(spark, d), ["product"], "t", "price"), 8)


@query(f"WITH {_PAN} SELECT product, CAST(t AS BIGINT) AS t, round(lag(price) OVER w, 8) + 0.0 AS previous, CASE WHEN lag(price) OVER w IS NULL THEN 'first' WHEN price > lag(price) OVER w THEN 'raised' WHEN price < lag(price) OVER w THEN 'lowered' ELSE 'unchanged' END AS change FROM panel WINDOW w AS (PARTITION BY product ORDER BY t)")
def previous_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.previous_forecast(b.week_panel(spark, d), ["product"], "t", "price").select("product", "t", "previous", "change"), 8)


def _tm(keys: str, n: str) -> str:
    return f"""(SELECT {keys}, avg(r) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)) AS {n} FROM (SELECT {keys}, r, row_number() OVER (PARTITION BY {keys} ORDER BY r) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM steps WHERE r IS NOT NULL) GROUP BY {keys})"""


INDEX = f"""{_STEPS}, m AS {_tm("t", "m")}, c AS {_tm("category, t", "c")}, g AS {_tm("category, grp, t", "g")}, grid AS (SELECT DISTINCT t FROM panel),
lv AS (SELECT 'market' AS level, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS grp, grid.t, coalesce(m, 0) AS step FROM grid LEFT JOIN m ON grid.t = m.t
  UNION ALL SELECT 'category', cs.category, CAST(NULL AS VARCHAR), grid.t, CASE WHEN c IS NOT NULL THEN c - coalesce(m, 0) ELSE 0 END FROM (SELECT DISTINCT category FROM panel) cs CROSS JOIN grid LEFT JOIN c ON c.category = cs.category AND c.t = grid.t LEFT JOIN m ON m.t = grid.t
  UNION ALL SELECT 'group', gs.category, gs.grp, grid.t, CASE WHEN g IS NOT NULL THEN g - coalesce(c, 0) ELSE 0 END FROM (SELECT category, grp, min(t) AS t0 FROM panel GROUP BY 1, 2) gs JOIN grid ON grid.t >= t0
    LEFT JOIN g ON g.category = gs.category AND g.grp = gs.grp AND g.t = grid.t LEFT JOIN c ON c.category = gs.category AND c.t = grid.t),
idx AS (SELECT *, sum(step) OVER (PARTITION BY level, category, grp ORDER BY t ROWS UNBOUNDED PRECEDING) AS idx FROM lv)"""


@query(f"WITH {INDEX} SELECT level, category, grp, CAST(t AS BIGINT) AS t, round(step, 6) + 0.0 AS step, round(idx, 6) + 0.0 AS idx FROM idx")
def index_levels_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(index_levels(b.week_panel(spark, d), KEYS))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    p = b.week_panel(spark, d)
    steps = index_levels(p, KEYS).where("level = 'group'").select("category", "grp", "t", "step")
    released = p.groupBy("category", "grp").agg(F.min("t").alias("released"))
    return lifecycle_curve(steps, released)


CURVE = f"""{INDEX}, rel AS (SELECT category, grp, min(t) AS released FROM panel GROUP BY 1, 2), aged AS (SELECT idx.t - released AS age, step AS r FROM idx JOIN rel ON idx.category = rel.category AND idx.grp = rel.grp WHERE level = 'group' AND idx.t - released BETWEEN 1 AND 260),
curve AS (SELECT age, avg(r) FILTER (WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1)) AS curve, max(n) AS n FROM (SELECT age, r, row_number() OVER (PARTITION BY age ORDER BY r) AS i, count(*) OVER (PARTITION BY age) AS n FROM aged) GROUP BY age)"""


@query(f"WITH {CURVE} SELECT CAST(age AS BIGINT) AS age, round(curve, 6) + 0.0 AS curve, n FROM curve")
def lifecycle_curve_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_curve(spark, d))


@query(f"WITH {CURVE} SELECT CAST(a.age AS BIGINT) AS age, round(sum(coalesce(x.curve, 0)), 6) + 0.0 AS cohort_return FROM curve a LEFT JOIN curve x ON x.age BETWEEN a.age + 1 AND a.age + 4 GROUP BY 1")
def cohort_return_query(spark: SparkSession, d: str) -> DataFrame:
    c = _curve(spark, d)
    return rounded(cohort_return(c, c.select("age"), 4))


@query("""WITH f AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey * 10 + l_linenumber AS id FROM lineitem) SELECT day, count(*) AS n, min(id) AS first_id FROM f GROUP BY day QUALIFY dense_rank() OVER (ORDER BY day DESC) <= 80""")
def last_n_dates(spark: SparkSession, d: str) -> DataFrame:
    from marketloom.operators.ranking import last_n_dates as op

    f = b.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_id"))
    return op(f.withColumn("one", F.lit(1)), ["one"], "day", 80).drop("one")



