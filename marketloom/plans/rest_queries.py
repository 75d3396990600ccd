"""Queries of small rules that no other query exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import scalars as s
from marketloom.operators import forecast, pit, ranking, resolve, serve
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query
from marketloom.plans.scalar_queries import _QN, _grams


@query("""SELECT p_partkey AS id, round(CASE WHEN p_size % 4 > 0 THEN p_retailprice / (p_size % 4) END, 6) + 0.0 AS pack_price, round(1.5 + 0.2 * (10 * p_size / 50.0) + 0.3 * (p_partkey % 10), 6) + 0.0 AS log_price FROM part""")
def pack_and_legacy_price(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    p = b.table(spark, d, "part")
    return rounded(p.select(k.alias("id"), s.unit_pack_price(F.col("p_retailprice"), size % 4).alias("pack_price"), s.legacy_log_price(1.5, 0.2, 50.0, 0.3, size, k % 10).alias("log_price")))


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + CAST(o_custkey % 200 AS INTEGER) <= DATE '1998-01-01' AS mature FROM orders""")
def label_is_mature(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pit.label_is_mature(F.to_date("o_orderdate"), F.col("o_custkey") % 200, F.lit("1998-01-01").cast("date")).alias("mature"))


@query("""WITH x AS (SELECT p_partkey AS id, p_size AS n, (p_partkey % 11 - 5) / 10.0 AS own, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 13 - 6) / 4.0 END AS co FROM part)
SELECT id, round(n / (n + 12.0) * own + (1 - n / (n + 12.0)) * least(0.7, greatest(-0.7, coalesce(co, 0))), 6) + 0.0 AS delta FROM x""")
def group_delta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = b.table(spark, d, "part").select(k.alias("id"), F.col("p_size").alias("n"), ((k % 11 - 5) / 10.0).alias("own_delta"), F.when(k % 7 > 0, (k % 13 - 6) / 4.0).alias("cohort_return"))
    return rounded(forecast.group_delta(x).select("id", "delta"))


@query(f"""WITH {b.PANEL}, o AS (SELECT origin, horizon FROM (SELECT unnest([6, 10, 14, 18, 22]) AS origin, 4 AS horizon UNION ALL SELECT unnest([6, 13, 20]), 7)) SELECT CAST(origin AS BIGINT) AS origin, CAST(horizon AS BIGINT) AS horizon, count(*) AS n FROM panel JOIN o ON t = origin GROUP BY 1, 2""")
def walk_forward_origins(spark: SparkSession, d: str) -> DataFrame:
    at = [(o, h) for h in (4, 7) for o in forecast.walk_forward_origins(6, 27, h, apart=True)]
    origins = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(o).alias("t"), F.lit(h).alias("horizon")) for o, h in at])).alias("o")).select("o.*")
    return rounded(b.week_panel(spark, d).join(F.broadcast(origins), "t").groupBy(F.col("t").alias("origin"), "horizon").agg(F.count("*").alias("n")))


_SIM = """CASE WHEN {a} = '' OR {q} = '' THEN 0 WHEN {a} = {q} THEN 1 ELSE greatest({j}, 0.55 * {j} + 0.45 * {d}) END"""


def _similar(a: str, q: str) -> str:
    j = f"(len(list_intersect(list_distinct(string_split({a}, ' ')), string_split({q}, ' '))) / len(list_distinct(list_concat(string_split({a}, ' '), string_split({q}, ' ')))))"
    d = f"(2 * len(list_intersect({_grams(a)}, {_grams(q)})) / (len({_grams(a)}) + len({_grams(q)})))"
    return _SIM.format(a=a, q=q, j=j, d=d)


@query(f"""WITH n AS (SELECT p_partkey AS id, {_QN("p_name")} AS name, {_QN("p_name || ' ' || p_type")} AS detail, CAST(p_size AS VARCHAR) AS number, 'red widget 7' AS q FROM part)
SELECT id, round(least(1.0, greatest({_similar("name", "q")}, 0.92 * {_similar("detail", "q")}) + CASE WHEN number = '7' THEN 0.12 ELSE 0 END), 6) + 0.0 AS score FROM n""")
def rank_hits(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("detail"), F.col("p_size").cast("string").alias("number"))
    return rounded(ranking.rank_hits(p, "red widget 7").select("id", "score"))


@query(f"""WITH n AS (SELECT p_partkey AS id, {_QN("p_name")} AS name, 'red widget' AS q, p_size FROM part)
SELECT id, round(least(1.0, 0.55 * {_similar("name", "q")} + CASE WHEN p_size % 3 > 0 THEN 0.25 * p_size / 50.0 ELSE 0 END + CASE WHEN p_size = 7 THEN 0.2 ELSE 0 END), 6) + 0.0 AS evidence FROM n""")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    p, size = b.table(spark, d, "part"), F.col("p_size")
    return rounded(serve.evidence_score(p, F.col("p_name"), F.lit("red widget"), size == 7, F.when(size % 3 > 0, size / 50.0)).select(F.col("p_partkey").alias("id"), "evidence"))


@query("""SELECT 'parts' AS source, p_partkey AS id, p_name AS name, CAST(NULL AS BIGINT) AS nation FROM part UNION ALL SELECT 'suppliers', s_suppkey, s_name, CAST(s_nationkey AS BIGINT) FROM supplier UNION ALL SELECT 'failed: gone', NULL, NULL, NULL""")
def settled_union(spark: SparkSession, d: str) -> DataFrame:
    readers = {
        "parts": lambda: b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "gone": lambda: b.table(spark, d, "no_such_table"),
        "suppliers": lambda: b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation")),
    }
    good, failed = serve.settled_union(readers)
    lost = spark.range(len(failed)).select(F.lit(f"failed: {', '.join(sorted(failed))}").alias("source"))
    return good.unionByName(lost, allowMissingColumns=True).select("source", "id", "name", "nation")


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2) SELECT p_partkey AS product, k AS card, 'number' AS method FROM part JOIN c ON part.p_brand = c.p_brand AND part.p_size = c.p_size AND n = 1""")
def bridge_table(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), b.table(spark, d, "part")
    own = p.select(k.alias("product"), F.col("p_brand").alias("set_id"), F.col("p_size").cast("string").alias("number"), F.lit(None).cast("string").alias("name"))
    card = p.where("p_partkey % 4 <> 0").select(F.lpad(k.cast("string"), 12, "0").alias("card_id"), F.col("p_brand").alias("set_id"), F.col("p_size").cast("string").alias("number"), F.col("p_name").alias("name"))
    m = resolve.bridge_table(resolve.match_products(own, card))
    return m.select("product", F.col("card_id").cast("long").alias("card"), "method")


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice * 0.8 END AS q10, p_retailprice * 0.9 AS q25, CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE p_retailprice END AS q50, p_retailprice * CASE WHEN p_partkey % 7 = 0 THEN 0.95 ELSE 1.1 END AS q75, p_retailprice * 1.2 AS q90,
CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 60 ELSE 90 END AS h, CASE p_partkey % 4 WHEN 0 THEN 28 WHEN 1 THEN 63 WHEN 2 THEN 91 END AS a, CASE WHEN p_partkey % 31 = 0 THEN 'odd' WHEN p_partkey % 2 = 0 THEN 'range-only' END AS tier FROM part)
SELECT id, CASE WHEN q10 IS NULL THEN 'quantile_missing_or_negative' WHEN q50 <= 0 THEN 'median_not_positive' WHEN q75 < q50 OR q50 < q25 THEN 'quantiles_cross' WHEN tier = 'odd' THEN 'unknown_tier' WHEN a <> CASE h WHEN 30 THEN 28 WHEN 60 THEN 63 ELSE 91 END THEN 'days_differ_from_horizon' END AS rejected FROM x""")
def ordered_quantile_guard(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    x = b.table(spark, d, "part").select(
        k.alias("id"), F.when(k % 23 != 0, price * 0.8).alias("q10"), (price * 0.9).alias("q25"), F.when(k % 29 == 0, 0.0).otherwise(price).alias("q50"), (price * F.when(k % 7 == 0, 0.95).otherwise(1.1)).alias("q75"), (price * 1.2).alias("q90"),
        F.when(k % 3 == 0, 30).when(k % 3 == 1, 60).otherwise(90).alias("horizon"), F.when(k % 4 == 0, 28).when(k % 4 == 1, 63).when(k % 4 == 2, 91).alias("horizon_days_actual"), F.when(k % 31 == 0, "odd").when(k % 2 == 0, "range-only").alias("tier"),
    )
    return serve.ordered_quantile_guard(x).select("id", "rejected")


@query(f"""WITH {b.HOLDINGS}, g AS (SELECT owner, set_name, category, count(*) AS printings, count(market_price) AS priced, sum(coalesce(market_price * quantity, 0)) AS value FROM holdings WHERE lower(category) = 'promo' GROUP BY 1, 2, 3)
SELECT owner, set_name, row_number() OVER (PARTITION BY owner ORDER BY priced = 0, value DESC, length(set_name), set_name) AS place FROM g""")
def list_sets(spark: SparkSession, d: str) -> DataFrame:
    g = b.holdings(spark, d).groupBy("owner", "set_name", "category").agg(F.max("updated_on").alias("latest_updated"), F.count("*").alias("printings"), F.count("market_price").alias("priced"), F.sum(F.coalesce(F.col("market_price") * F.col("quantity"), F.lit(0.0))).alias("value"))
    return rounded(serve.list_sets(g.withColumn("game", F.lit("cards")), "owner", "brand", "promo", "value-desc").select("owner", "set_name", "place"))


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat([p_type, p_brand], CASE WHEN p_size % 2 = 0 THEN [p_brand, 'even'] ELSE [] END))), ',') AS codes FROM part""")
def union_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = serve.union_codes(F.array("p_type", "p_brand"), F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.lit("even"))))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(codes, ",").alias("codes"))


_TREE = """n AS (SELECT {k} count(*) AS dn, sum(c) AS n FROM x {by}), d AS (SELECT {k} n, CAST(greatest(0, ceil(ln(dn / {leaf}.0) / ln(16))) AS INTEGER) AS d FROM n),
lf AS (SELECT {xk} d, h[1:d] AS p, sha256(string_agg(h || ' ' || c, chr(10) ORDER BY h || ' ' || c)) AS x FROM x, d WHERE {same} GROUP BY ALL),
l1 AS (SELECT {k} d, p, x FROM lf WHERE d = 1 UNION ALL SELECT {k} d, p[1:1], sha256(string_agg(p || ' ' || x, chr(10) ORDER BY p || ' ' || x)) FROM lf WHERE d = 2 GROUP BY {k} d, p[1:1]),
rt AS (SELECT {k} x AS root FROM lf WHERE d = 0 UNION ALL SELECT {k2} sha256(string_agg(p || ' ' || x, chr(10) ORDER BY p || ' ' || x)) FROM l1 {by2})"""


@query(f"""WITH o AS (SELECT o_custkey % 20 AS k, CAST(o_orderkey % 9000 AS VARCHAR) AS line FROM orders), x AS (SELECT k, sha256(line) AS h, count(*) AS c FROM o GROUP BY 1, 2),
{_TREE.format(k="k,", by="GROUP BY 1", leaf=64, xk="x.k,", same="x.k = d.k", k2="k,", by2="GROUP BY 1")} SELECT rt.k, root, CAST(n AS BIGINT) AS n FROM rt JOIN d ON d.k = rt.k""")
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), (F.col("o_orderkey") % 9000).cast("string").alias("line"))
    return pit.merkle_root(o, ["k"], F.col("line"), leaf_lines=64)


@query(f"""WITH {b.OBS}, rec AS (SELECT sha256(CAST(series AS VARCHAR)) AS s, sha256(series || '|' || CAST(observed_at AS VARCHAR) || '|' || CAST(price AS VARCHAR)) AS r FROM obs),
lines AS (SELECT 'series' AS "set", CAST(series AS VARCHAR) AS line FROM (SELECT DISTINCT series FROM obs) UNION ALL SELECT 'observations', r FROM rec UNION ALL SELECT 'dataset', s || '|' || r FROM rec),
x AS (SELECT "set" AS k, sha256(line) AS h, count(*) AS c FROM lines GROUP BY 1, 2), {_TREE.format(k="k,", by="GROUP BY 1", leaf=4096, xk="x.k,", same="x.k = d.k", k2="k,", by2="GROUP BY 1")}
SELECT rt.k AS "set", root, CAST(n AS BIGINT) AS n FROM rt JOIN d ON d.k = rt.k""")
def import_hashes(spark: SparkSession, d: str) -> DataFrame:
    o = b.observations(spark, d)
    return pit.import_hashes(o, o.select("series"))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, p_type AS what, CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 3 WHEN p_partkey % 10 < 7 THEN p_partkey + 1 + p_size % 3 END AS nxt FROM part UNION ALL SELECT p_partkey, p_type, p_partkey + 2 FROM part WHERE p_partkey % 97 = 0),
i AS (SELECT id, min(nxt) AS nxt, min(what) AS what, count(DISTINCT nxt) AS outs FROM m GROUP BY 1), ind AS (SELECT nxt, count(DISTINCT id) AS ins FROM m WHERE nxt IS NOT NULL GROUP BY 1),
f AS (SELECT i.*, t.id AS known, t.what AS twhat, ins FROM i LEFT JOIN i t ON t.id = i.nxt LEFT JOIN ind ON ind.nxt = i.nxt),
w AS (SELECT id, id AS at_id, 0 AS steps FROM f UNION ALL SELECT w.id, f.known, steps + 1 FROM w JOIN f ON f.id = w.at_id WHERE f.known IS NOT NULL AND steps < 400),
e AS (SELECT w.id, w.at_id AS head, steps FROM w JOIN f ON f.id = w.at_id WHERE f.known IS NULL)
SELECT f.id, head, CAST(steps AS BIGINT) AS steps, array_to_string(list_filter([CASE WHEN e.id IS NULL THEN 'cycle' END, CASE WHEN outs > 1 THEN 'fork' END, CASE WHEN what <> twhat THEN 'identity_changed' END, CASE WHEN ins > 1 THEN 'merged' END, CASE WHEN f.nxt IS NOT NULL AND known IS NULL THEN 'missing_successor' END], lambda c: c IS NOT NULL), ',') AS problems
FROM f LEFT JOIN e ON e.id = f.id""")
def mapping_chains(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), b.table(spark, d, "part")
    nxt = F.when(k % 50 == 49, k - 3).when(k % 10 < 7, k + 1 + F.col("p_size") % 3)
    m = p.select(k.alias("id"), nxt.alias("nxt"), F.col("p_type").alias("what")).union(p.where("p_partkey % 97 = 0").select(k, k + 2, F.col("p_type")))
    return pit.mapping_chains(m, "id", "nxt", ["what"]).withColumn("problems", F.array_join("problems", ","))
