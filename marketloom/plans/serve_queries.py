"""What is shown of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import pit, resolve, serve
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query


@query("""WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, l_partkey % 300 AS product, l_linenumber % 3 AS subtype FROM lineitem WHERE l_quantity > 45), p AS (SELECT p_partkey % 300 AS product, p_partkey % 2 AS subtype, max(p_size) AS v FROM part WHERE p_partkey % 300 < 200 AND (p_partkey % 4 < 3 OR p_partkey % 300 < 100) GROUP BY 1, 2),
o AS (SELECT product, CASE WHEN count(*) = 1 THEN min(v) END AS ov FROM p GROUP BY 1) SELECT item, CAST(coalesce(p.v, ov) AS BIGINT) AS v, CASE WHEN p.v IS NOT NULL THEN 'exact' WHEN ov IS NOT NULL THEN 'only' ELSE 'none' END AS how FROM i LEFT JOIN p ON i.product = p.product AND i.subtype = p.subtype LEFT JOIN o ON i.product = o.product""")
def series_forecast_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = b.table(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), (F.col("l_partkey") % 300).alias("product"), (F.col("l_linenumber") % 3).cast("long").alias("subtype"))
    k = F.col("p_partkey")
    p = b.table(spark, d, "part").where("p_partkey % 300 < 200 and (p_partkey % 4 < 3 or p_partkey % 300 < 100)").groupBy((k % 300).alias("product"), (k % 2).alias("subtype")).agg(F.max("p_size").alias("v"))
    return rounded(serve.series_forecast_lookup(i, p, "v"))


@query("""WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 3 THEN l_partkey END AS series, l_returnflag AS currency, l_quantity < 3 AS manual FROM lineitem), p AS (SELECT p_partkey AS series, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'N' END AS pc, p_size % 6 AS tier, p_size > 40 AS limited FROM part WHERE p_size > 5)
SELECT id, CASE WHEN h.series IS NULL THEN 'unmatched' WHEN manual THEN 'manual' WHEN p.series IS NULL THEN 'no_publication' WHEN currency <> pc THEN 'currency_differs' WHEN tier < 4 THEN 'tier_too_low' WHEN limited THEN 'limited' ELSE 'available' END AS availability FROM h LEFT JOIN p ON h.series = p.series""")
def forecast_availability(spark: SparkSession, d: str) -> DataFrame:
    h = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("series"), F.col("l_returnflag").alias("currency"), (F.col("l_quantity") < 3).alias("manual"))
    size = F.col("p_size")
    p = b.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("series"), F.when(size % 2 == 0, "A").otherwise("N").alias("pub_currency"), (size % 6).alias("tier"), (size > 40).alias("limited"))
    return serve.forecast_availability(h, p)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 6 >= 2 THEN p_retailprice END AS price, CASE WHEN p_size % 6 >= 4 THEN p_name END AS name FROM part")
def support_tier_projection(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), (F.col("p_size") % 6).alias("tier"))
    return serve.support_tier_projection(p, {"price": 2, "name": 4}).drop("tier")


@query("""WITH s AS (SELECT l_orderkey AS comparison, CAST(l_linenumber AS BIGINT) AS slot, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2) SELECT comparison, slot, s.k, p_retailprice AS price, round(p_retailprice - first(p_retailprice) OVER (PARTITION BY comparison ORDER BY slot, s.k), 4) + 0.0 AS price_difference FROM s LEFT JOIN part ON s.k = p_partkey""")
def comparison(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("comparison"), F.col("l_linenumber").cast("long").alias("slot")).agg(F.min("l_partkey").alias("k"))
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"))
    return rounded(serve.comparison(s, p, "k", ["price"]), 4)


@query("""WITH c AS (SELECT o_orderkey AS card, o_orderstatus AS model, o_orderpriority AS cohort, o_custkey % 6 AS tier, CAST(o_orderdate AS DATE) AS published FROM orders) SELECT card, model, cohort, published FROM c WHERE tier = 5 QUALIFY row_number() OVER (PARTITION BY model, cohort ORDER BY published DESC, card DESC) = 1""")
def published_scorecards(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("cohort"), (F.col("o_custkey") % 6).alias("tier"), F.to_date("o_orderdate").alias("published"))
    return serve.published_scorecards(c, ["model", "cohort"]).drop("tier")


@query("""WITH a AS (SELECT event_id AS id, user_id AS owner, user_id % 40 AS key, ts AS happened, event_id % 3 = 0 AS read FROM events), w AS (SELECT c_custkey AS key, c_mktsegment AS label FROM customer) SELECT id, label, row_number() OVER (PARTITION BY owner ORDER BY happened DESC, id) AS place FROM a LEFT JOIN w ON a.key = w.key WHERE NOT read""")
def alert_list(spark: SparkSession, d: str) -> DataFrame:
    a = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), (F.col("user_id") % 40).alias("key"), F.col("ts").alias("at"), (F.col("event_id") % 3 == 0).alias("read"), F.lit(False).alias("muted"))
    w = b.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    return rounded(serve.alert_list(a, w, "unread").select("id", "label", "place"))


@query(f"""WITH {b.HOLDINGS} SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY market_price * quantity DESC NULLS LAST, id) AS place FROM holdings""")
def sort_holdings(spark: SparkSession, d: str) -> DataFrame:
    h = b.holdings(spark, d).withColumn("value", F.col("market_price") * F.col("quantity"))
    return rounded(serve.sort_holdings(h, "owner", "value").select("owner", "id", "place"))


@query("SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE (c_custkey, c_nationkey) NOT IN (SELECT o_custkey, o_custkey % 25 FROM orders)")
def watch_dedupe(spark: SparkSession, d: str) -> DataFrame:
    w = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    h = b.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 25).alias("n"))
    return rounded(serve.watch_dedupe(w, h, ["k", "n"]))


@query(f"""WITH {b.OBS} SELECT DISTINCT series FROM obs WHERE series % 3 <> 0 AND price > 150 AND available_at <= TIMESTAMP '2024-01-20' AND observed_at >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY""")
def prospective_universe(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d)
    s = o.select("series").distinct().withColumn("approved", F.col("series") % 3 != 0)
    return serve.prospective_universe(s, o.where("price > 150"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 3).select("series")


@query("""WITH p AS (SELECT p_partkey AS product, p_brand AS grp, ln(p_retailprice) AS y, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'single' ELSE 'sealed' END AS kind FROM part)
SELECT a.product, a.kind, CASE a.kind WHEN 'unknown' THEN 'unknown' WHEN 'single' THEN 'single' ELSE 'sealed-other' END AS format, round((SELECT quantile_cont(x.y, 0.5) FROM p x WHERE x.grp = a.grp AND x.product <> a.product), 6) + 0.0 AS peer_median, round(-ln((SELECT count(*) FROM p x WHERE x.grp = a.grp)), 6) + 0.0 AS neg_log_size FROM p a""")
def hedonic_features(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("grp"), F.lit("thing").alias("name"), F.when(size % 2 == 0, "7").alias("number"), F.lit(None).cast("string").alias("rarity"), (size % 5 != 0).alias("has_meta"), F.col("p_retailprice").alias("price"))
    g = p.select("grp").distinct().select("grp", F.col("grp").alias("set_name"), F.lit(False).alias("supplemental"))
    return rounded(serve.hedonic_features(p, g).select("product", "kind", "format", "peer_median", "neg_log_size"))


@query("""WITH o AS (SELECT p_type AS category, p_brand AS bucket, -max(p_size) / 100.0 AS q10, -min(p_size) / 100.0 - 0.01 AS q25, max(p_size) / 80.0 AS q90, min(p_retailprice) / 1000 AS mad FROM part GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY (q90 - q10) * mad DESC) AS rn FROM o)
SELECT p_partkey AS product, round(exp(ln(p_retailprice) + q10 * mad * 1.75), 4) + 0.0 AS q10, round(exp(ln(p_retailprice) + q90 * mad * 1.75), 4) + 0.0 AS q90 FROM part JOIN w ON p_type = category AND rn = 1 WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)""")
def cold_start_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    cat = p.select(F.col("p_partkey").alias("product"), F.col("p_type").alias("category"))
    priced = b.table(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("product"))
    hed = p.select(F.col("p_partkey").alias("product"), F.log("p_retailprice").alias("hedonic_log"))
    off = p.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("bucket")).agg((-F.max("p_size") / 100.0).alias("q10"), (-F.min("p_size") / 100.0 - 0.01).alias("q25"), F.lit(0.0).alias("q50"), F.lit(0.1).alias("q75"), (F.max("p_size") / 80.0).alias("q90"), (F.min("p_retailprice") / 1000).alias("mad"))
    return rounded(serve.cold_start_forecast(cat, priced, hed, off).select("product", "q10", "q90"), 4)


@query("""WITH p AS (SELECT p_partkey AS product, p_brand AS set_id, p_size AS num, p_name AS name FROM part), m AS (SELECT a.product, count(*) FILTER (WHERE a.num = z.num AND a.product % 3 <> 0) AS x, min(z.product) FILTER (WHERE a.num = z.num AND a.product % 3 <> 0) AS xi, count(*) FILTER (WHERE a.name = z.name) AS y, min(z.product) FILTER (WHERE a.name = z.name) AS yi FROM p a LEFT JOIN p z ON a.set_id = z.set_id AND z.product % 4 <> 0 GROUP BY 1)
SELECT product, CASE WHEN x = 1 THEN 'number' WHEN x > 1 THEN 'ambiguous' WHEN y = 1 THEN 'name' WHEN y > 1 THEN 'ambiguous' ELSE 'none' END AS method, CASE WHEN x = 1 THEN xi WHEN x = 0 AND y = 1 THEN yi END AS card_id FROM m""")
def match_products(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), b.table(spark, d, "part")
    own = p.select(k.alias("product"), F.col("p_brand").alias("set_id"), F.when(k % 3 != 0, F.col("p_size").cast("string")).alias("number"), F.upper("p_name").alias("name"))
    card = p.where("p_partkey % 4 <> 0").select(F.explode(F.array(F.concat(k.cast("string"), F.lit(":a")), F.concat(k.cast("string"), F.lit(":b")))).alias("card_id"), F.col("p_brand").alias("set_id"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("number"), F.col("p_name").alias("name"))
    m = resolve.match_products(own, card.withColumn("card_id", F.lpad("card_id", 12, "0")))
    return m.withColumn("card_id", F.col("card_id").cast("long"))


@query("""SELECT p_partkey AS id, round(p_size / 100.0, 6) + 0.0 AS probability, round(CASE WHEN (p_size - 5) / 100.0 > 0 THEN (p_size - 5) / 100.0 END, 6) + 0.0 AS lower, round((p_size + 5) / 100.0, 6) + 0.0 AS upper, abs(3 - 100.0 / p_size) <= 0.15 * 100.0 / p_size AS one_in_ok FROM part""")
def pull_rate_entries(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("percent"), F.lit(5.0).alias("margin"), F.lit(3.0).alias("one_in"))
    return rounded(pit.pull_rate_entries(p).select("id", "probability", "lower", "upper", "one_in_ok"))


@query(f"""WITH {b.OBS}, s AS (SELECT series FROM obs WHERE series % 7 <> 0 GROUP BY 1) SELECT 'repeated_series' AS "check", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'repeated_record', count(*) FROM (SELECT series, observed_at, price FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1)
UNION ALL SELECT 'available_before_observed', count(*) FROM obs WHERE available_at < observed_at UNION ALL SELECT 'unknown_series', count(*) FROM obs WHERE series % 7 = 0 UNION ALL SELECT 'price_not_positive', count(*) FROM obs WHERE price IS NULL OR price <= 0""")
def validate_history_import(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d)
    return pit.validate_history_import(o, o.where("series % 7 <> 0").select("series").distinct())


@query(f"""WITH {b.CASES}, x AS (SELECT category, probability_up AS p, ln(realized / current) AS roi, predicted > current AS sel FROM cases), k AS (SELECT category, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg((roi > 0)::INT) AS y FROM x GROUP BY 1, 2), c AS (SELECT category, sum(n * abs(p - y)) / sum(n) AS ce FROM k GROUP BY 1)
SELECT x.category, count(*) AS n, round(avg(pow(p - (roi > 0)::INT, 2)), 6) + 0.0 AS brier, count(*) FILTER (WHERE sel) AS selected, round(avg((roi > 0)::INT) FILTER (WHERE sel), 6) + 0.0 AS positive_rate, round(quantile_cont(roi, 0.5) FILTER (WHERE sel), 6) + 0.0 AS median_roi, round(any_value(ce), 6) + 0.0 AS calibration_error FROM x JOIN c ON x.category = c.category GROUP BY 1""")
def after_cost_scorecard(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d).select("category", F.col("probability_up").alias("probability"), F.log(F.col("realized") / F.col("current")).alias("roi"), (F.col("predicted") > F.col("current")).alias("selected"))
    return rounded(serve.after_cost_scorecard(c, ["category"]))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND CAST(o_orderdate AS DATE) <= DATE '1998-01-01' THEN 'matured' WHEN CAST(o_orderdate AS DATE) <= DATE '1998-01-01' THEN 'awaiting' ELSE 'open' END AS status FROM orders""")
def forecast_status_history(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = b.table(spark, d, "orders").select(k.alias("id"), F.to_date("o_orderdate").alias("matures"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("realized"))
    return serve.forecast_status_history(o.union(o.where("id % 5 = 0").withColumn("realized", F.lit(None).cast("double"))), F.lit("1998-01-01").cast("date")).select("id", "status")


@query(f"""WITH {b.HOLDINGS}, c AS (SELECT p_type AS category, p_brand AS set_name, min(p_retailprice) AS lo, avg(p_retailprice) AS price, max(p_retailprice) AS hi FROM part WHERE p_size > 45 GROUP BY 1, 2)
SELECT owner, round(sum(CASE WHEN currency = 'USD' AND lo IS NOT NULL THEN lo * quantity ELSE 0 END), 4) + 0.0 AS lo, round(sum(CASE WHEN currency = 'USD' AND lo IS NOT NULL THEN hi * quantity ELSE 0 END), 4) + 0.0 AS hi, count(*) FILTER (WHERE currency = 'USD' AND lo IS NOT NULL) AS covered, count(*) FILTER (WHERE NOT (currency = 'USD' AND lo IS NOT NULL)) AS left_out FROM holdings LEFT JOIN c USING (category, set_name) GROUP BY 1""")
def portfolio_cone(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "part").where("p_size > 45").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("set_name")).agg(F.min("p_retailprice").alias("lo"), F.avg("p_retailprice").alias("price"), F.max("p_retailprice").alias("hi"))
    return rounded(serve.portfolio_cone(b.holdings(spark, d), c, ["owner"], ["category", "set_name"], "USD").drop("price"), 4)


@query()
def private_trend_and_baseline(spark: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(F.lit("2024-01-19 00:00:00").cast("timestamp")))
    return rounded(serve.private_trend_and_baseline(b.observations(spark, d), spark.range(1).select(days.alias("origin")), ["series"], (7, 30)))


@query()
def descriptive_candidate(spark: SparkSession, d: str) -> DataFrame:
    from marketloom.plans.lab_queries import _snapshots

    s = serve.descriptive_candidate(_snapshots(spark, d))
    return s.select("origin", "series", F.array_join("drivers", ",").alias("drivers"), F.array_join("reasons", ",").alias("reasons"))



@query("""WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber <> 3 THEN l_partkey END AS variant, l_quantity < 3 AS manual, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS finish FROM lineitem),
p AS (SELECT p_partkey AS variant, CASE WHEN p_size % 7 > 0 THEN ['A', 'N', 'R'][1 + p_size % 3] END AS finish, CASE WHEN p_size % 5 = 0 THEN 'EUR' ELSE 'USD' END AS pc, p_size % 8 AS tier, p_size > 40 AS limited, CASE WHEN p_size % 2 = 0 THEN 30 ELSE 90 END AS hz FROM part WHERE p_size > 5),
n AS (SELECT variant, count(finish) AS named FROM p GROUP BY 1)
SELECT id, CASE WHEN h.variant IS NULL THEN 'unmatched' WHEN manual THEN 'manual' WHEN n.variant IS NULL THEN 'no_publication' WHEN p.variant IS NULL AND (h.finish IS NULL OR named = 0) THEN 'identity_incomplete' WHEN p.variant IS NULL THEN 'identity_differs' WHEN pc <> 'USD' THEN 'currency_differs'
WHEN tier < 2 THEN 'history_too_limited' WHEN tier < 4 THEN 'tier_too_low' WHEN hz <> 30 THEN 'horizon_not_published' WHEN limited THEN 'limited' ELSE 'available' END AS availability, coalesce(CAST(hz AS VARCHAR), '') AS horizons FROM h LEFT JOIN p ON h.variant = p.variant AND h.finish = p.finish LEFT JOIN n ON n.variant = h.variant""")
def exact_availability(spark: SparkSession, d: str) -> DataFrame:
    line, size = F.col("l_linenumber"), F.col("p_size")
    h = b.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), F.when(line != 3, F.col("l_partkey")).alias("variant"), (F.col("l_quantity") < 3).alias("manual"), F.when(line != 2, F.col("l_returnflag")).alias("finish"))
    finish = F.when(size % 7 > 0, F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), size % 3))
    p = b.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("variant"), finish.alias("finish"), F.when(size % 5 == 0, "EUR").otherwise("USD").alias("pub_currency"), (size % 8).alias("tier"), (size > 40).alias("limited"), F.array(F.when(size % 2 == 0, 30).otherwise(90)).alias("horizons"))
    return serve.exact_availability(h, p, 30, ["finish"], "USD").withColumn("horizons", F.array_join(F.col("horizons").cast("array<string>"), ","))


@query("""WITH s AS (SELECT l_orderkey AS comparison, CAST(l_linenumber AS BIGINT) AS slot, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2), m AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 > 0 THEN p_size * 2.0 END AS a, CASE WHEN p_size % 4 > 0 THEN 100 - p_size * 1.0 END AS z FROM part),
c AS (SELECT comparison, slot, s.k, CASE WHEN a IS NULL THEN z WHEN z IS NULL THEN a ELSE least(a, z) END AS confidence FROM s JOIN m ON s.k = m.k), l AS (SELECT *, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' WHEN confidence >= 40 THEN 'medium-low' WHEN confidence >= 20 THEN 'low' WHEN confidence IS NOT NULL THEN 'insufficient' ELSE 'unknown' END AS label FROM c),
g AS (SELECT comparison, count(*) > 1 AND count(DISTINCT label) > 1 AS differs FROM l GROUP BY 1) SELECT l.comparison, slot, k, confidence + 0.0 AS confidence, label, differs AS confidence_differs FROM l JOIN g ON g.comparison = l.comparison""")
def comparison_confidence(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    s = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("comparison"), F.col("l_linenumber").cast("long").alias("slot")).agg(F.min("l_partkey").alias("k"))
    m = b.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(size % 3 > 0, size * 2.0).alias("a"), F.when(size % 4 > 0, 100 - size * 1.0).alias("z"))
    return serve.comparison_confidence(s, m, "k", ["a", "z"])


@query("""WITH x AS (SELECT o_custkey AS owner, o_orderkey % 9 = 0 AS manual, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 40 / 2.0 END AS age FROM orders), y AS (SELECT *, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 1 THEN 'today' WHEN age <= 7 THEN 'recent' ELSE 'stale' END AS state FROM x)
SELECT owner, count(age) FILTER (WHERE NOT manual) AS known, count(*) FILTER (WHERE NOT manual AND state = 'stale') AS stale, round(min(age) FILTER (WHERE NOT manual), 6) + 0.0 AS latest_age, coalesce(arg_min(state, age) FILTER (WHERE NOT manual AND age IS NOT NULL), 'unknown') AS latest_state FROM y GROUP BY 1""")
def collection_freshness(spark: SparkSession, d: str) -> DataFrame:
    k, age = F.col("o_orderkey"), F.col("age_days")
    x = b.table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), (k % 9 == 0).alias("manual"), F.when(k % 4 > 0, k % 40 / 2.0).alias("age_days"))
    x = x.withColumn("state", F.when(age.isNull(), "unknown").when(age < 1, "today").when(age <= 7, "recent").otherwise("stale"))
    return rounded(serve.collection_freshness(x, ["owner"]))
