"""Trend snapshots, the forecast lab, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import evaluate, lab, pit, portfolio, resolve
from marketloom.operators.ranking import top_per_key
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(*[F.lit(f"2024-01-{x} 00:00:00").cast("timestamp") for x in ("12", "19", "26")]))
    return lab.trend_snapshot(b.observations(spark, d), spark.range(1).select(days.alias("origin")), ["series"])


@query(f"""WITH {b.OBS}, o AS (SELECT unnest([TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-26']) AS origin),
k AS (SELECT origin, obs.*, epoch_us(observed_at) / 86400e6 AS t, row_number() OVER (PARTITION BY origin, series, observed_at ORDER BY available_at DESC, id DESC) AS rn FROM obs, o WHERE observed_at <= origin AND available_at <= origin),
p AS (SELECT origin, series, t, ln(price) AS y, quality AS q, max(t) OVER (PARTITION BY origin, series) AS lt FROM k WHERE rn = 1),
pk AS (SELECT *, max(y) OVER (PARTITION BY origin, series ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak, (y - lag(y) OVER (PARTITION BY origin, series ORDER BY t)) / sqrt(t - lag(t) OVER (PARTITION BY origin, series ORDER BY t)) AS r FROM p),
sl AS (SELECT a.origin, a.series, quantile_cont((z.y - a.y) / (z.t - a.t), 0.5) AS s FROM p a JOIN p z ON a.origin = z.origin AND a.series = z.series AND z.t > a.t GROUP BY 1, 2),
rf AS (SELECT origin, series, max(lt) AS lt, arg_max(y, t) AS ly, max(t) FILTER (WHERE t <= lt - 7) AS rt, arg_max(y, t) FILTER (WHERE t <= lt - 7) AS ry FROM p GROUP BY 1, 2),
g AS (SELECT origin, series, 1.4826 * mad(r) AS vol, max(1 - exp(y - peak)) AS dd, least(1.0, count(DISTINCT floor(t)) / (floor(max(lt)) - floor(max(lt) - 90) + 1)) AS den, quantile_cont(q, 0.5) AS sq, count(*) AS n, max(lt) AS lt FROM pk GROUP BY 1, 2)
SELECT g.origin, g.series, round(sl.s, 6) + 0.0 AS slope_90d, round(vol, 6) + 0.0 AS volatility_90d, round(dd, 6) + 0.0 AS max_drawdown_180d, round(den, 6) + 0.0 AS density_90d, round(sq, 6) + 0.0 AS source_quality_90d, n AS observations_90d,
  round(CASE WHEN rf.lt - 7 - rt <= 3 THEN ly - ry END, 6) + 0.0 AS return_7d, round(greatest(0, (epoch_us(g.origin) / 86400e6 - g.lt) * 24), 3) + 0.0 AS staleness_hours
FROM g LEFT JOIN sl ON g.origin = sl.origin AND g.series = sl.series JOIN rf ON g.origin = rf.origin AND g.series = rf.series""")
def trend_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d).select("origin", "series", "slope_90d", "volatility_90d", "max_drawdown_180d", "density_90d", "source_quality_90d", "observations_90d", "return_7d", F.round("staleness_hours", 3).alias("staleness_hours"))
    return rounded(s)


_ND = "(1 / (1 + 0.3275911 * abs(x) / sqrt(2)))"


@query(f"""WITH f AS (SELECT p_partkey AS k, p_retailprice * 0.8 AS q10, p_retailprice * 0.95 AS q25, p_retailprice * 1.1 AS q50, p_retailprice * 1.6 AS q90, p_retailprice * (0.6 + p_size / 100.0) AS price FROM part), a AS (SELECT *, price * 1.08 + 2 AS all_in FROM f),
z AS (SELECT *, (all_in + 1) / 0.87 AS even, (ln((all_in + 1) / 0.87) - ln(q50)) / (ln(q90 / q10) / (2 * 1.281551565545)) AS x FROM a),
c AS (SELECT *, 1 - ({_ND} * (0.254829592 + {_ND} * (-0.284496736 + {_ND} * (1.421413741 + {_ND} * (-1.453152027 + {_ND} * 1.061405429))))) * exp(-x * x / 2) AS e FROM z),
r AS (SELECT k, all_in, even, (q25 * 0.87 - 1) / all_in - 1 AS cons, 1 - (CASE WHEN x >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END) AS pos FROM c)
SELECT k, round(all_in, 4) + 0.0 AS all_in, round(even, 4) + 0.0 AS break_even, round(cons, 6) + 0.0 AS conservative_roi, round(pos, 5) + 0.0 AS probability_net_positive, CASE WHEN cons > 0 AND pos >= 0.7 THEN 'watch_candidate' ELSE 'not_selected' END AS status FROM r""")
def watch_candidates(spark: SparkSession, d: str) -> DataFrame:
    p, k = b.table(spark, d, "part"), F.col("p_partkey").alias("k")
    f = p.select(k, *[(F.col("p_retailprice") * m).alias(q) for q, m in (("q10", 0.8), ("q25", 0.95), ("q50", 1.1), ("q90", 1.6))])
    c = p.select(k, (F.col("p_retailprice") * (0.6 + F.col("p_size") / 100.0)).alias("price"), F.lit(0.08).alias("tax"), F.lit(2.0).alias("shipping"), F.lit(0.13).alias("fee_rate"), F.lit(1.0).alias("exit_fixed"))
    w = lab.watch_candidates(f, c, ["k"])
    return w.select("k", (F.round("all_in", 4) + 0.0).alias("all_in"), (F.round("break_even", 4) + 0.0).alias("break_even"), (F.round("conservative_roi", 6) + 0.0).alias("conservative_roi"), (F.round("probability_net_positive", 5) + 0.0).alias("probability_net_positive"), "status")


@query(f"""WITH {b.CASES} SELECT category, count(*) AS n, round(avg((ln(realized / current) > 0)::INT), 6) + 0.0 AS positive_rate, round(quantile_cont(ln(realized / current), 0.5), 6) + 0.0 AS median_roi, round(avg((ln(realized / current) <= 0)::INT), 6) + 0.0 AS false_discovery_rate,
round(avg(abs(ln(q25 / current) - ln(realized / current))), 6) + 0.0 AS mean_error FROM cases WHERE predicted > current GROUP BY 1""")
def selected_pockets(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d).select("category", (F.col("predicted") > F.col("current")).alias("selected"), F.log(F.col("realized") / F.col("current")).alias("roi"), F.log(F.col("q25") / F.col("current")).alias("conservative_roi"))
    return rounded(lab.selected_pockets(c, ["category"]))


@query(f"""WITH {b.CASES}, x AS (SELECT CAST(floor(origin / 7) AS INTEGER) AS block, grp, ln(current) AS anchor, ln(momentum / current) AS i, ln(predicted / current) AS r, ln(realized) AS y FROM cases), g AS (SELECT a, z AS b FROM (SELECT unnest([0.0, 0.5, 1.0]) AS a), (SELECT unnest([0.0, 0.5]) AS z)),
t AS (SELECT DISTINCT o.block, h.grp FROM (SELECT DISTINCT block FROM x) o, (SELECT DISTINCT grp FROM x) h), s AS (SELECT block, grp, a, b, sum(abs(anchor + a * i + b * r - y)) AS e, count(*) AS n FROM x, g GROUP BY ALL),
p AS (SELECT t.block, t.grp, s.a, s.b, sum(e) / sum(n) AS mae FROM t JOIN s ON s.block < t.block AND s.grp <> t.grp GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY block, grp ORDER BY round(mae, 12), abs(a) + abs(b), a, b) AS rn FROM p)
SELECT CAST(block AS BIGINT) AS block, grp, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(mae, 6) + 0.0 AS mae FROM w WHERE rn = 1""")
def rolling_held_out(spark: SparkSession, d: str) -> DataFrame:
    c = b.cases(spark, d).select(F.floor(F.col("origin") / 7).cast("int").alias("block"), "grp", F.log("current").alias("anchor"), F.log(F.col("momentum") / F.col("current")).alias("index_delta"), F.log(F.col("predicted") / F.col("current")).alias("reversion"), F.log("realized").alias("actual"))
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])).alias("a")).select("a", F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("b"))
    return rounded(lab.rolling_held_out(c, grid, "block", "grp"))


@query("""WITH x AS (SELECT p_partkey AS id, p_size AS x, ln(p_retailprice) AS y, list_reduce(list_prepend(0::BIGINT, [('0x' || h)::BIGINT FOR h IN string_split(sha256(p_brand), '')]), lambda a, z: (a * 16 + z) % 5) AS fold FROM part),
f AS (SELECT k AS fold, regr_slope(y, x.x) AS s, regr_intercept(y, x.x) AS i FROM generate_series(0, 4) g(k) JOIN x ON x.fold <> k AND x.fold <> (k + 1) % 5 GROUP BY 1), e AS (SELECT f.fold, quantile_cont(y - i - s * x.x, 0.1) AS lo, quantile_cont(y - i - s * x.x, 0.9) AS hi FROM f JOIN x ON x.fold = (f.fold + 1) % 5 GROUP BY 1)
SELECT id, round(i + s * x.x, 4) + 0.0 AS fair, round(i + s * x.x + lo, 4) + 0.0 AS lo, round(i + s * x.x + hi, 4) + 0.0 AS hi, CASE WHEN y < i + s * x.x + lo THEN 'below' WHEN y > i + s * x.x + hi THEN 'above' ELSE 'within' END AS position FROM x JOIN f USING (fold) JOIN e USING (fold)""")
def structural_gap(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("x"), F.log("p_retailprice").alias("y"))
    return rounded(lab.structural_gap(p, "grp", ["x"], "y", ridge=1e-14).select("id", "fair", "lo", "hi", "position"), 4)


@query(f"""WITH {b.OBS}, s AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'outlier' WHEN id % 13 = 0 THEN 'missing' WHEN id % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM obs) SELECT id, status AS kind, CASE status WHEN 'outlier' THEN 'high' WHEN 'rejected' THEN 'medium' ELSE 'low' END AS severity, sha256(id || '|' || status) AS event_hash FROM s WHERE status <> 'accepted'""")
def quality_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    o = b.observations(spark, d).withColumn("status", F.when(k % 17 == 0, "outlier").when(k % 13 == 0, "missing").when(k % 11 == 0, "rejected").otherwise("accepted"))
    return pit.quality_events(o)


@query("SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS accepted, CAST(0 AS BIGINT) AS missing, count(*) FILTER (WHERE event_id % 3 <> 0) AS outlier, CAST(0 AS BIGINT) AS rejected FROM events")
def batch_status_counts(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "accepted").otherwise("outlier").alias("status"))
    return pit.batch_status_counts(e)


@query("""WITH i AS (SELECT l_orderkey AS id, l_linenumber AS import_id, CAST(l_shipdate AS DATE) AS created FROM lineitem), r AS (SELECT id, import_id, row_number() OVER (PARTITION BY id ORDER BY created, import_id) AS rn FROM i WHERE created <= DATE '1999-01-01') SELECT o_orderkey AS id, CAST(import_id AS BIGINT) AS import_id FROM orders LEFT JOIN r ON o_orderkey = id AND rn = 1""")
def first_eligible_import(spark: SparkSession, d: str) -> DataFrame:
    i = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("import_id"), F.to_date("l_shipdate").alias("created_at"))
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rounded(pit.first_eligible_import(o, i, F.lit("1999-01-01").cast("date")))


@query("""WITH m AS (SELECT p_type AS area, CAST(sum(p_size) AS BIGINT) AS bytes FROM part WHERE p_type <> 'SMALL' GROUP BY 1), g AS (SELECT p_type AS area, 25 * count(*) AS budget FROM part GROUP BY 1)
SELECT g.area, CASE WHEN bytes IS NULL THEN 'unmeasured' WHEN bytes / budget > 1 THEN 'exceeded' WHEN bytes / budget >= 0.8 THEN 'warning' ELSE 'ok' END AS state, round(bytes / budget, 6) + 0.0 AS ratio FROM g LEFT JOIN m ON g.area = m.area""")
def storage_budget(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").withColumnRenamed("p_type", "area")
    m = p.where("area <> 'SMALL'").groupBy("area").agg(F.sum("p_size").alias("bytes"))
    return rounded(pit.storage_budget(m, p.groupBy("area").agg((25 * F.count("*")).alias("budget"))).select("area", "state", "ratio"))


@query("SELECT count(*) FILTER (WHERE greatest(o_orderdate, o_orderdate + INTERVAL 3 DAY) > TIMESTAMP '1998-01-01') AS late FROM orders")
def features_known(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.to_timestamp("o_orderdate").alias("a"), (F.to_timestamp("o_orderdate") + F.expr("interval 3 days")).alias("b"))
    return pit.features_known(o, ["a", "b"], F.lit("1998-01-01").cast("timestamp"))


@query(f"""WITH {b.HOLDINGS} SELECT owner, bought_on, 'USD' AS currency, round(sum(CASE WHEN currency = 'USD' THEN coalesce(market_price * quantity, 0) ELSE 0 END) + 0.00000013, 3) + 0.0 AS value, round(sum(CASE WHEN cost_currency = 'USD' THEN coalesce(purchase_price * quantity, 0) + coalesce(fees, 0) ELSE 0 END) + 0.00000013, 3) + 0.0 AS cost,
count(*) AS items, round(sum(quantity), 3) + 0.0 AS quantity FROM holdings GROUP BY 1, 2""")
def daily_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = portfolio.daily_snapshot(b.holdings(spark, d), ["owner"], "bought_on", "USD")
    return rounded(s.withColumns({c: F.col(c) + 0.00000013 for c in ("value", "cost")}), 3)


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 > 0 THEN 1990 + p_size END AS year, p_type AS game, p_partkey % 7 = 0 AS sup, ['Commander Legends', 'Starter Deck', 'Promo Pack', 'Plain Set'][1 + p_partkey % 4] AS name FROM part),
f AS (SELECT CASE WHEN name LIKE 'Commander%' THEN 'commander' WHEN name LIKE 'Starter%' THEN 'preconstructed' WHEN name LIKE 'Promo%' THEN 'promos' WHEN sup THEN 'other-supplemental' ELSE 'main' END AS bucket, year FROM x),
g AS (SELECT 'family' AS mode, bucket, count(*) AS n, min(year) AS fy, list_position(['main', 'commander', 'preconstructed', 'promos', 'other-supplemental'], bucket) AS o1, 0 AS o2 FROM f GROUP BY 2
UNION ALL SELECT 'year', coalesce(CAST(year AS VARCHAR), 'undated'), count(*), min(year), (min(year) IS NULL)::INT, -min(year) FROM x GROUP BY 2 UNION ALL SELECT 'game', game, count(*), min(year), dense_rank() OVER (ORDER BY game), 0 FROM x GROUP BY 2)
SELECT mode, bucket, n, CAST(fy AS BIGINT) AS first_year, row_number() OVER (PARTITION BY mode ORDER BY o1, o2) AS place FROM g""")
def group_sets(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(x) for x in ("Commander Legends", "Starter Deck", "Promo Pack", "Plain Set")])
    x = b.table(spark, d, "part").select(F.get(names, (k % 4).cast("int")).alias("name"), (k % 7 == 0).alias("supplemental"), F.when(size % 9 > 0, 1990 + size).alias("year"), F.col("p_type").alias("game"))
    parts = [resolve.group_sets(x, m).withColumn("mode", F.lit(m)) for m in ("family", "year", "game")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"""WITH {b.HOLDINGS}, r AS (SELECT owner, id, market_price * quantity AS value, row_number() OVER (PARTITION BY owner ORDER BY market_price * quantity DESC NULLS LAST, id) AS rank FROM holdings) SELECT owner, id, round(value, 3) + 0.0 AS value, rank FROM r WHERE rank <= 3""")
def top_holdings(spark: SparkSession, d: str) -> DataFrame:
    h = b.holdings(spark, d).select("owner", "id", (F.col("market_price") * F.col("quantity")).alias("value"))
    return rounded(top_per_key(h, ["owner"], [F.desc_nulls_last("value"), F.col("id")], 3), 3)


@query("""WITH p AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem), u AS (SELECT k, d FROM p WHERE k % 7 = 0), s AS (SELECT p_partkey AS k, 5 AS seen FROM part WHERE p_partkey % 14 = 0) SELECT u.k, min(d) AS first_seen, max(d) AS last_seen, CAST(count(*) + coalesce(max(seen), 0) AS BIGINT) AS total FROM u LEFT JOIN s ON u.k = s.k GROUP BY 1""")
def unresolved_counter(spark: SparkSession, d: str) -> DataFrame:
    prices = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("d"))
    known = b.table(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"))
    state = b.table(spark, d, "part").where("p_partkey % 14 = 0").select(F.col("p_partkey").alias("k"), F.lit(5).alias("seen"))
    return resolve.unresolved_counter(prices, known, state, "k", "d")


@query(f"WITH {b.CASES} SELECT count(DISTINCT product) AS variants, count(DISTINCT grp) AS sets, count(DISTINCT origin) AS origins FROM cases")
def count_distinct_breadth(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.count_distinct_breadth(b.cases(spark, d), {"variants": "product", "sets": "grp", "origins": "origin"})
