"""Demand, votes and portfolios."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import wilson_interval
from marketloom.operators import demand, portfolio
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query

_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for n, k in demand.KINDS.items())
_ELIG = f"""{b.DEMAND}, elig AS (SELECT * FROM demand WHERE "user" % 50 NOT IN (0, 1))"""


def _excluded(events: DataFrame) -> DataFrame:
    return events.where(F.col("user") % 50 < 2).select("user").distinct()


@query(f"""WITH {_ELIG} SELECT variant, CAST(date_trunc('week', ts) AS DATE) AS period, {_COUNTS}, count(DISTINCT "user") AS unique_users, count(DISTINCT "user") >= 15 AS privacy_threshold_met FROM elig GROUP BY 1, 2""")
def demand_aggregate(spark: SparkSession, d: str) -> DataFrame:
    e = b.demand_events(spark, d)
    return demand.demand_aggregate(e, _excluded(e), F.to_date(F.date_trunc("week", "at")), 15)


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    e = b.demand_events(spark, d)
    w = demand.demand_aggregate(e, _excluded(e), F.to_date(F.date_trunc("week", "at")), 5)
    return w.withColumnRenamed("period", "period_start").withColumn("period_end", F.date_add("period_start", 6))


def _rate(end: str, days: int, expr: str, name: str) -> str:
    lo = f"DATE '{end}' - {days - 1}"
    return f"""{name} AS (SELECT variant, CASE WHEN max((gap <> 1)::INT) = 0 AND max(pe) = DATE '{end}' AND bool_and(ok) AND min(u) > 0 THEN sum({expr}) / sum(u * 7) END AS v FROM
  (SELECT variant, ps, ps + 6 AS pe, wa, wr, se, pa, vi, u, ok, ps - coalesce(lag(ps + 6) OVER (PARTITION BY variant ORDER BY ps), {lo} - 1) AS gap FROM wk WHERE ps >= {lo} AND ps + 6 <= DATE '{end}') GROUP BY variant)"""


@query(f"""WITH {_ELIG}, wk AS (SELECT variant, CAST(date_trunc('week', ts) AS DATE) AS ps, count(*) FILTER (WHERE kind = 'watch_add') AS wa, count(*) FILTER (WHERE kind = 'watch_remove') AS wr, count(*) FILTER (WHERE kind = 'search_view') AS se,
  count(*) FILTER (WHERE kind = 'portfolio_add') AS pa, count(*) FILTER (WHERE kind = 'card_view') AS vi, count(DISTINCT "user") AS u, count(DISTINCT "user") >= 5 AS ok FROM elig GROUP BY 1, 2),
{_rate("2024-01-28", 7, "wa - wr", "a")}, {_rate("2024-01-28", 7, "se", "s")}, {_rate("2024-01-28", 7, "vi", "w")}, {_rate("2024-01-28", 7, "wa - wr + pa", "n")}, {_rate("2024-01-21", 7, "wa - wr + pa", "p")}
SELECT v.variant, round(a.v, 6) + 0.0 AS watchlist_velocity_7d, round(s.v, 6) + 0.0 AS search_velocity_7d, round(w.v, 6) + 0.0 AS view_velocity_7d, round(n.v - p.v, 6) + 0.0 AS demand_acceleration
FROM (SELECT DISTINCT variant FROM wk WHERE ps + 6 <= DATE '2024-01-28') v LEFT JOIN a USING (variant) LEFT JOIN s USING (variant) LEFT JOIN w USING (variant) LEFT JOIN n USING (variant) LEFT JOIN p USING (variant)""")
def demand_velocity(spark: SparkSession, d: str) -> DataFrame:
    v = demand.demand_velocity(_weeks(spark, d), datetime.date(2024, 1, 28))
    return rounded(v.select("variant", "watchlist_velocity_7d", "search_velocity_7d", "view_velocity_7d", "demand_acceleration"))


@query(f"""WITH {b.VOTES}, a AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM votes UNION ALL SELECT b FROM votes) GROUP BY 1), w AS (SELECT winner AS v, count(*) AS wins FROM votes GROUP BY 1),
x AS (SELECT a.v, n, coalesce(wins, 0) / n AS p, 1.959963984540054 AS z FROM a LEFT JOIN w ON a.v = w.v WHERE n >= 10),
y AS (SELECT v, n, (p + z * z / (2 * n)) / (1 + z * z / n) AS c, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) AS m FROM x)
SELECT v AS variant, n AS vote_count, round(c, 5) + 0.0 AS score, round(greatest(0, c - m), 5) + 0.0 AS lower_bound, round(least(1, c + m), 5) + 0.0 AS upper_bound FROM y""")
def artwork_scores(spark: SparkSession, d: str) -> DataFrame:
    v = b.votes(spark, d)
    each = v.select(F.explode(F.array("a", "b")).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))
    wins = v.groupBy(F.col("winner").alias("variant")).agg(F.count("*").alias("wins"))
    i = wilson_interval(F.coalesce("wins", F.lit(0)), F.col("n"))
    x = each.join(wins, "variant", "left").where("n >= 10").select("variant", F.col("n").alias("vote_count"), i.alias("i"))
    return rounded(x.select("variant", "vote_count", F.col("i.center").alias("score"), F.col("i.lower").alias("lower_bound"), F.col("i.upper").alias("upper_bound")), 5)


_VAL = "coalesce(market_price * greatest(0, quantity), 0)"
_COST = "coalesce(purchase_price * quantity, 0) + coalesce(fees, 0)"
_BOTH = "currency = 'USD' AND cost_currency = 'USD' AND market_price IS NOT NULL AND purchase_price IS NOT NULL"


@query(f"""WITH {b.HOLDINGS}, s AS (SELECT owner, sum(CASE WHEN currency = 'USD' THEN {_VAL} ELSE 0 END) AS market_value, sum(CASE WHEN cost_currency = 'USD' THEN {_COST} ELSE 0 END) AS cost_basis,
  sum(CASE WHEN {_BOTH} THEN {_VAL} ELSE 0 END) AS cv, sum(CASE WHEN {_BOTH} THEN {_COST} ELSE 0 END) AS cc, count(*) FILTER (WHERE purchase_price IS NOT NULL) AS cost_basis_items, count(*) FILTER (WHERE {_BOTH}) AS gain_eligible_items,
  count(*) FILTER (WHERE market_price IS NULL OR purchase_price IS NULL) AS missing_gain_items, count(*) FILTER (WHERE currency <> 'USD') AS excluded_market_items, count(*) AS unique_items, sum(quantity) AS total_quantity FROM holdings GROUP BY owner)
SELECT owner, round(market_value, 3) + 0.0 AS market_value, round(cost_basis, 3) + 0.0 AS cost_basis, cost_basis_items, gain_eligible_items, missing_gain_items, excluded_market_items, unique_items, round(total_quantity, 3) + 0.0 AS total_quantity,
  round(cv - cc, 3) + 0.0 AS gain, round(CASE WHEN cc > 0 THEN 100 * (cv - cc) / cc END, 3) + 0.0 AS return_percent FROM s""")
def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    s = portfolio.portfolio_summary(b.holdings(spark, d), ["owner"], "USD")
    return rounded(s.select("owner", "market_value", "cost_basis", "cost_basis_items", "gain_eligible_items", "missing_gain_items", "excluded_market_items", "unique_items", "total_quantity", "gain", "return_percent"), 3)


@query(f"WITH {b.HOLDINGS} SELECT owner, category, round(sum(CASE WHEN currency = 'USD' THEN {_VAL} ELSE 0 END), 3) + 0.0 AS value FROM holdings GROUP BY 1, 2")
def portfolio_allocation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.portfolio_allocation(b.holdings(spark, d), ["owner"], "USD"), 3)


@query(f"""WITH {b.HOLDINGS}, v AS (SELECT owner, id, CASE WHEN currency = 'USD' THEN {_VAL} ELSE 0 END AS v FROM holdings), r AS (SELECT owner, id, v, v / sum(v) OVER (PARTITION BY owner) AS s, row_number() OVER (PARTITION BY owner ORDER BY v DESC, id) AS r FROM v WHERE v > 0),
g AS (SELECT owner, sum(s * s) AS hhi, sum(CASE WHEN r <= 5 THEN s ELSE 0 END) AS top5, max(s) AS top, arg_min(id, r) AS top_id FROM r GROUP BY 1)
SELECT owner, round(hhi, 6) + 0.0 AS hhi, round(top5, 6) + 0.0 AS top_five_share, top_id, CASE WHEN hhi >= 0.35 OR top >= 0.5 THEN 'high' WHEN hhi >= 0.2 THEN 'moderate' ELSE 'spread' END AS concentration FROM g""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.concentration(b.holdings(spark, d), ["owner"], "USD").select("owner", "hhi", "top_five_share", "top_id", "concentration"))


@query(f"""WITH {b.HOLDINGS} SELECT owner, category, set_name, count(*) AS holdings, round(sum(quantity), 3) + 0.0 AS copies, count(DISTINCT product) AS printings, round(sum(CASE WHEN currency = 'USD' THEN {_VAL} ELSE 0 END), 3) + 0.0 AS value,
count(*) FILTER (WHERE market_price IS NOT NULL AND currency = 'USD') AS priced, count(*) FILTER (WHERE market_price IS NULL) AS unpriced, count(*) FILTER (WHERE market_price IS NOT NULL AND currency <> 'USD') AS excluded, max(updated_on) AS updated_on, min(id) AS cover FROM holdings GROUP BY 1, 2, 3""")
def portfolio_sets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.portfolio_sets(b.holdings(spark, d), ["owner"], "USD"), 3)


@query(f"""WITH {b.HOLDINGS} SELECT owner, count(*) FILTER (WHERE market_price IS NOT NULL AND currency = 'USD') AS priced, count(*) FILTER (WHERE market_price IS NULL) AS unpriced, count(*) FILTER (WHERE market_price IS NOT NULL AND currency <> 'USD') AS excluded,
round(sum(CASE WHEN currency = 'USD' THEN {_VAL} ELSE 0 END), 3) + 0.0 AS priced_value FROM holdings GROUP BY 1""")
def value_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.value_breakdown(b.holdings(spark, d), ["owner"], "USD"), 3)


_SCENARIO = """sc AS (SELECT owner, id, market_price * quantity AS value, greatest(0, market_price * quantity * (1 + CASE WHEN id % 5 = 0 THEN 0 ELSE greatest(-0.75, least(1.5, (0.08 + CASE category WHEN 'ECONOMY' THEN -0.08 WHEN 'LARGE' THEN 0.08 ELSE 0 END) * sqrt(0.5))) END)) AS q50,
  CASE WHEN id % 12 >= 8 AND id % 4 >= 2 THEN 'strong' WHEN id % 12 >= 3 AND id % 4 >= 2 THEN 'moderate' ELSE 'limited' END AS evidence FROM holdings WHERE currency = 'USD' AND market_price >= 0 AND quantity > 0)"""


def _scenario(spark: SparkSession, d: str) -> DataFrame:
    h = b.holdings(spark, d).withColumn("manual", F.col("id") % 5 == 0)
    evidence = h.where("id % 12 > 0").select("id", (F.col("id") % 12).alias("observations"), (F.col("id") % 4).alias("sources")).distinct()
    return portfolio.shock_revalue(h, evidence, 45, "USD", market="up", categories={"ECONOMY": "down", "LARGE": "up"}, volatility="high")


@query(f"""WITH {b.HOLDINGS}, {_SCENARIO}, w AS (SELECT least(0.65, 0.28 * sqrt(0.5)) AS w) SELECT owner, id, round(value, 3) + 0.0 AS value, round(q50 * (1 - w), 3) + 0.0 AS q10, round(q50 * (1 - w / 2), 3) + 0.0 AS q25, round(q50, 3) + 0.0 AS q50, round(q50 * (1 + w / 2), 3) + 0.0 AS q75, round(q50 * (1 + w), 3) + 0.0 AS q90, evidence FROM sc, w""")
def shock_revalue(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_scenario(spark, d), 3)


@query(f"""WITH {b.HOLDINGS}, {_SCENARIO} SELECT owner, round(sum(value), 2) + 0.0 AS value, round(sum(q50), 2) + 0.0 AS q50, round(CASE WHEN sum(value) > 0 THEN 100 * (sum(q50) / sum(value) - 1) END, 6) + 0.0 AS change_percent, count(*) FILTER (WHERE evidence = 'strong') AS strong, count(*) FILTER (WHERE evidence = 'limited') AS limited FROM sc GROUP BY 1""")
def scenario_totals(spark: SparkSession, d: str) -> DataFrame:
    t = portfolio.scenario_totals(_scenario(spark, d))
    return t.select("owner", (F.round("value", 2) + 0.0).alias("value"), (F.round("q50", 2) + 0.0).alias("q50"), (F.round("change_percent", 6) + 0.0).alias("change_percent"), "strong", "limited")


@query(f"""WITH {b.HOLDINGS}, {b.FACTS}, g AS (SELECT unnest([DATE '1996-06-30', DATE '1997-06-30', DATE '1998-06-30']) AS day), pr AS (SELECT product, day, max(price) AS price FROM facts WHERE product % 10 > 0 GROUP BY 1, 2), la AS (SELECT product, max(day) AS last FROM pr GROUP BY 1),
ow AS (SELECT h.*, coalesce(last >= bought_on, false) AS hist, {_VAL} AS flat, {_COST} AS cost FROM holdings h LEFT JOIN la ON h.product = la.product WHERE currency = 'USD' AND cost_currency = 'USD'),
c AS (SELECT DISTINCT product, g.day FROM pr, g), cf AS (SELECT c.product, c.day, pr.price, pr.day AS pday FROM c ASOF LEFT JOIN pr ON c.product = pr.product AND c.day >= pr.day),
rw AS (SELECT owner, cf.day, CASE WHEN pday >= bought_on THEN price * quantity END AS v, cost FROM ow JOIN cf ON ow.product = cf.product WHERE hist AND cf.day >= bought_on UNION ALL SELECT owner, g.day, flat, cost FROM ow, g WHERE NOT hist AND g.day >= bought_on),
co AS (SELECT owner, count(*) FILTER (WHERE hist) AS with_history, CAST(round(100 * count(*) FILTER (WHERE hist) / count(*)) AS BIGINT) AS coverage_percent FROM ow GROUP BY 1)
SELECT rw.owner, day, round(sum(coalesce(v, 0)) + 0.00000013, 3) + 0.0 AS value, round(sum(cost) + 0.00000013, 3) + 0.0 AS cost, count(v) AS priced, count(*) AS held, any_value(with_history) AS with_history, any_value(coverage_percent) AS coverage_percent FROM rw JOIN co ON rw.owner = co.owner GROUP BY 1, 2""")
def portfolio_value_series(spark: SparkSession, d: str) -> DataFrame:
    hist = b.facts(spark, d).where("product % 10 > 0").groupBy("product", "day").agg(F.max("price").alias("price"))
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(f"{y}-06-30").cast("date") for y in (1996, 1997, 1998)])).alias("day"))
    v = portfolio.portfolio_value_series(b.holdings(spark, d), hist, grid, "USD")
    return rounded(v.withColumns({c: F.col(c) + 0.00000013 for c in ("value", "cost")}), 3)  # sums may end in 5 where they are cut


@query(f"""WITH {b.HOLDINGS}, f AS (SELECT p_partkey AS product, p_retailprice AS obs, p_retailprice * 0.9 AS q25, p_retailprice * 1.01 AS q50, p_retailprice * 1.1 AS q75, CASE p_size % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'limited' ELSE 'withheld' END AS status, CASE WHEN p_size % 8 <> 0 THEN CAST(p_size AS DOUBLE) END AS confidence, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS published, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-02-01' + CAST(p_size AS INTEGER) END AS mu FROM part WHERE p_size > 10),
j AS (SELECT owner, quantity, f.*, coalesce(status IN ('available', 'limited'), false) AND quantity > 0 AS ok FROM holdings LEFT JOIN f ON holdings.product = f.product)
SELECT owner, round(sum(CASE WHEN ok THEN obs * quantity ELSE 0 END), 3) + 0.0 AS approved_value, round(sum(CASE WHEN ok THEN q25 * quantity ELSE 0 END), 3) + 0.0 AS q25, round(sum(CASE WHEN ok THEN q50 * quantity ELSE 0 END), 3) + 0.0 AS q50, round(sum(CASE WHEN ok THEN q75 * quantity ELSE 0 END), 3) + 0.0 AS q75,
count(*) FILTER (WHERE ok) AS covered, count(*) FILTER (WHERE ok AND status = 'limited') AS limited, count(*) AS held, min(confidence) FILTER (WHERE ok) AS confidence_low, max(confidence) FILTER (WHERE ok) AS confidence_high, min(published) FILTER (WHERE ok) AS as_of, max(coalesce(mu, published)) FILTER (WHERE ok) AS model_updated,
CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'unavailable' WHEN count(*) FILTER (WHERE ok AND confidence IS NULL) > 0 THEN 'varies' WHEN min(confidence) FILTER (WHERE ok) = max(confidence) FILTER (WHERE ok) THEN 'single' ELSE 'span' END AS confidence FROM j GROUP BY 1""")
def forecast_rollup(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    f = b.table(spark, d, "part").where("p_size > 10").select(
        F.col("p_partkey").alias("product"), price.alias("observed"), (price * 0.9).alias("q25"), (price * 1.01).alias("q50"), (price * 1.1).alias("q75"), F.when(size % 4 == 0, "available").when(size % 4 == 1, "limited").otherwise("withheld").alias("status"),
        F.when(size % 8 != 0, size.cast("double")).alias("confidence"), F.date_add(F.lit("2024-01-01").cast("date"), size).alias("published"), F.when(F.col("p_partkey") % 2 == 0, F.date_add(F.lit("2024-02-01").cast("date"), size)).alias("model_updated"),
    )
    return rounded(portfolio.forecast_rollup(b.holdings(spark, d).drop("observed"), f, ["owner"], ["product"]), 3)


@query("""WITH w AS (SELECT p_partkey AS key, CASE WHEN p_size > 2 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS cur, p_partkey % 7 = 0 AS stale, 'up' AS trend, p_type AS pos, p_brand AS sig, 'f' || p_partkey AS fp FROM part),
bl AS (SELECT p_partkey AS key, CASE WHEN p_size > 1 THEN p_retailprice * (0.8 + (p_partkey % 5) * 0.1) END AS bp, 'USD' AS bc, p_partkey % 14 = 0 AS bs, CASE WHEN p_partkey % 3 = 0 THEN 'down' ELSE 'up' END AS bt, CASE WHEN p_partkey % 4 = 0 THEN 'within' ELSE p_type END AS bpos, CASE WHEN p_partkey % 6 = 0 THEN 'old' ELSE p_brand END AS bsig, CASE WHEN p_partkey % 8 = 0 THEN 'f' || p_partkey ELSE 'g' END AS bf FROM part WHERE p_size < 48),
j AS (SELECT w.*, bl.key IS NOT NULL AS seen, bp, bc, bs, bt, bpos, bsig, bf, coalesce(bp IS NOT NULL AND bc = cur, false) AS cmp FROM w LEFT JOIN bl ON w.key = bl.key), c AS (SELECT * FROM j WHERE NOT seen OR fp <> bf OR stale <> bs)
SELECT key, unnest(list_filter([CASE WHEN seen AND bp IS NULL AND price IS NOT NULL THEN 'new_catalog_price' END, CASE WHEN bp IS NOT NULL AND price IS NULL THEN 'became_unpriced' END, CASE WHEN seen AND NOT bs AND stale THEN 'price_stale' END, CASE WHEN cur = 'USD' AND price <= 1000 AND (NOT cmp OR bp > 1000) THEN 'target_price' END,
CASE WHEN cmp AND abs(price / bp - 1) * 100 >= 10.5 THEN 'percent_change' END, CASE WHEN seen AND key % 2 = 0 AND bt <> trend THEN 'trend_change' END, CASE WHEN seen AND bpos <> pos THEN 'range_change' END, CASE WHEN seen AND bsig <> sig THEN 'forecast_change' END], lambda x: x IS NOT NULL)) AS alert FROM c""")
def alerts(spark: SparkSession, d: str) -> DataFrame:
    p, k, price, size = b.table(spark, d, "part"), F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    finger = F.concat(F.lit("f"), k.cast("string"))
    w = p.select(
        k.alias("key"), F.when(size > 2, price).alias("price"), F.when(k % 5 == 0, "EUR").otherwise("USD").alias("currency"), (k % 7 == 0).alias("stale"), F.lit("up").alias("trend"), F.col("p_type").alias("position"), F.col("p_brand").alias("signature"), finger.alias("fingerprint"),
        F.lit(1000.0).alias("target"), F.lit("USD").alias("target_currency"), F.lit(10.5).alias("percent"), (k % 2 == 0).alias("on_trend"), F.lit(True).alias("on_range"), F.lit(True).alias("on_forecast"),
    )
    base = p.where("p_size < 48").select(
        k.alias("key"), F.when(size > 1, price * (0.8 + (k % 5) * 0.1)).alias("price"), F.lit("USD").alias("currency"), (k % 14 == 0).alias("stale"), F.when(k % 3 == 0, "down").otherwise("up").alias("trend"), F.when(k % 4 == 0, "within").otherwise(F.col("p_type")).alias("position"),
        F.when(k % 6 == 0, "old").otherwise(F.col("p_brand")).alias("signature"), F.when(k % 8 == 0, finger).otherwise("g").alias("fingerprint"),
    )
    return portfolio.alerts(w, base)
