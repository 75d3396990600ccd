"""Merges, sync, retention and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import merge, resolve
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query

DAY = "2024-06-01"


def day() -> F.Column:
    return F.lit(DAY).cast("date")


@query(f"""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal, DATE '2024-01-01' AS first_seen, DATE '2024-02-01' AS changed_on FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0),
j AS (SELECT coalesce(c.k, n.k) AS k, c.k IS NOT NULL AS o, n.k IS NOT NULL AS w, c.seg AS cs, c.bal AS cb, n.seg AS ns, n.bal AS nb, first_seen, changed_on FROM c FULL JOIN n ON c.k = n.k),
a AS (SELECT *, CASE WHEN NOT o THEN 'insert' WHEN NOT w THEN 'keep' WHEN cs IS DISTINCT FROM ns OR cb IS DISTINCT FROM nb THEN 'update' ELSE 'same' END AS action FROM j)
SELECT k, CASE WHEN w THEN ns ELSE cs END AS seg, CASE WHEN w THEN nb ELSE cb END AS bal, coalesce(first_seen, DATE '{DAY}') AS first_seen, CASE WHEN action IN ('insert', 'update') THEN DATE '{DAY}' ELSE changed_on END AS changed_on, action FROM a""")
def upsert_changed(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    current = c.where("k % 4 <> 0").withColumns({"first_seen": F.lit("2024-01-01").cast("date"), "changed_on": F.lit("2024-02-01").cast("date")})
    batch = c.where("k % 3 <> 0").withColumn("seg", F.when(F.col("k") % 7 != 0, F.col("seg")))
    return merge.upsert_changed(current, batch, ["k"], ["seg", "bal"], day())


@query("""SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE NOT (c_nationkey < 5 AND c_custkey % 3 = 0)""")
def delete_missing_in_scope(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    return merge.delete_missing_in_scope(c, c.where("k % 3 <> 0"), ["k"], "n", c.where("n < 5").select("n"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS stamp FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, (c_custkey * 7) % 10 AS stamp FROM customer) SELECT n.k, n.stamp FROM n LEFT JOIN c ON n.k = c.k WHERE c.stamp IS NULL OR n.stamp > c.stamp""")
def apply_if_newer(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return merge.apply_if_newer(c.where("k % 2 = 0").withColumn("stamp", F.col("k") % 10), c.withColumn("stamp", F.col("k") * 7 % 10), ["k"], "stamp")


@query("""SELECT o_orderkey AS id, o_custkey % 30 AS batch FROM orders WHERE o_custkey % 30 NOT IN (SELECT DISTINCT c_custkey % 30 FROM customer WHERE c_custkey % 30 < 11)""")
def replay_guard(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("batch"))
    sealed = b.table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("batch")).where("batch < 11")
    return merge.replay_guard(sealed, o, "batch")


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, (c_custkey * 13) % 100 AS stamp, 0 AS side FROM customer WHERE c_custkey % 3 <> 0), z AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, (c_custkey * 17) % 100 AS stamp, 1 AS side FROM customer WHERE c_custkey % 4 <> 0),
u AS (SELECT * FROM a UNION ALL SELECT * FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY stamp DESC, side DESC) AS rn FROM u), t AS (SELECT c_custkey AS k, 50 AS del FROM customer WHERE c_custkey % 5 = 0)
SELECT r.k, v, stamp FROM r LEFT JOIN t ON r.k = t.k WHERE rn = 1 AND (del IS NULL OR stamp > del)""")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    a = c.where("k % 3 <> 0").withColumn("stamp", F.col("k") * 13 % 100)
    z = c.where("k % 4 <> 0").select("k", (F.col("v") + 1).alias("v"), (F.col("k") * 17 % 100).alias("stamp"))
    return merge.lww_merge(a, z, c.where("k % 5 = 0").select("k", F.lit(50).alias("deleted_at")), "k", "stamp")


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT coalesce(o.day, r.day) AS day, coalesce(o.n, r.n) AS n, CASE WHEN o.day IS NULL THEN 'rebuilt' ELSE 'observed' END AS origin FROM r FULL JOIN o ON r.day = o.day""")
def merge_snapshots(spark: SparkSession, d: str) -> DataFrame:
    r = b.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    o = b.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return merge.merge_snapshots(r, o, ["day"])


@query("""WITH l AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_nationkey END AS v FROM customer)
SELECT n.k, CAST(n.v AS BIGINT) AS v, CAST(CASE WHEN l.k IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision FROM n LEFT JOIN l ON n.k = l.k WHERE l.k IS NULL OR n.v IS DISTINCT FROM l.v""")
def append_revision(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    ledger = c.where("k % 2 = 0").withColumn("revision", F.lit(1))
    obs = c.withColumn("v", F.when(F.col("k") % 6 == 0, -1).otherwise(F.col("v")))
    return rounded(merge.append_revision(ledger, obs, ["k"], "v"))


@query("""WITH c AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(c.k, n.k) AS k, c.v AS cv, n.v AS nv FROM c FULL JOIN n ON c.k = n.k), r AS (SELECT k, array_to_string(list_filter([CASE WHEN nv IS NULL THEN 'new' END, CASE WHEN cv IS NULL THEN 'gone' END, CASE WHEN cv <> nv THEN 'changed' END, CASE WHEN ('0x' || sha256(CAST(k AS VARCHAR))[1:8])::BIGINT % 7 = 3 THEN 'audit' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j)
SELECT k, reasons FROM r WHERE reasons <> ''""")
def refresh_plan(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    known = p.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return merge.refresh_plan(p.where("k % 11 <> 0"), known, "k", "v", 3).select("k", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT o_orderkey AS id FROM orders WHERE DATE '1999-01-01' - CAST(o_orderdate AS DATE) <= 900")
def prune(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at"))
    return merge.prune(o, "at", F.lit("1999-01-01").cast("date"), 900).select("id")


@query("SELECT 'events' AS name, count(*) AS n FROM events WHERE user_id % 10 <> 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 3)")
def erase_user(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select(F.col("user_id").alias("user"))
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("user"))
    left = merge.erase_user({"events": e, "orders": o}, e.where("user % 10 = 3").distinct(), "user")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return parts[0].union(parts[1])


@query("""SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)) AS missing, CAST(0 AS BIGINT) AS unexpected, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 GROUP BY 1 HAVING count(*) > 1)) AS repeated""")
def exact_cover(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    return merge.exact_cover(s, b.table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k")


_EXT = """cat AS (SELECT p_partkey AS id, p_type AS game, p_brand AS set_key, p_size AS num, p_name AS name, p_partkey % 2 AS finish FROM part),
ext AS (SELECT p_partkey AS ext_id, p_type AS game, p_brand AS set_key, p_size AS num, CASE WHEN p_partkey % 9 = 0 THEN 'other' WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name, (p_partkey + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 2 AS finish FROM part WHERE p_partkey % 3 <> 0),
app AS (SELECT p_partkey AS ext_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END AS approved_id FROM part WHERE p_partkey % 31 = 0)"""


@query(f"""WITH {_EXT}, j AS (SELECT e.ext_id, e.name, c.id, c.name = e.name AS same, c.name = e.name AND c.finish = e.finish AS exact FROM ext e LEFT JOIN cat c ON e.game = c.game AND e.set_key = c.set_key AND e.num = c.num),
g AS (SELECT ext_id, any_value(name) AS name, count(id) AS cand, count(*) FILTER (WHERE same) AS named, count(*) FILTER (WHERE exact) AS exact, min(id) FILTER (WHERE exact) AS exact_id, min(id) FILTER (WHERE same) AS named_id, min(id) AS any_id FROM j GROUP BY 1),
s AS (SELECT g.*, approved_id, CASE WHEN approved_id > 0 THEN 'approved' WHEN approved_id IS NOT NULL THEN 'target_missing' WHEN name = '' OR cand = 0 THEN 'unmapped' WHEN named = 0 THEN 'quarantined_name' WHEN exact = 1 THEN 'exact' WHEN exact > 1 THEN 'quarantined_several' WHEN named = 1 THEN 'review' ELSE 'quarantined_finish' END AS status FROM g LEFT JOIN app ON g.ext_id = app.ext_id)
SELECT ext_id, status, CASE status WHEN 'approved' THEN approved_id WHEN 'quarantined_name' THEN any_id WHEN 'exact' THEN exact_id WHEN 'quarantined_several' THEN exact_id WHEN 'review' THEN named_id WHEN 'quarantined_finish' THEN named_id END AS id,
  CAST(CASE status WHEN 'approved' THEN 1 WHEN 'quarantined_name' THEN 0.5 WHEN 'exact' THEN 0.99 WHEN 'quarantined_several' THEN 0.8 WHEN 'review' THEN 0.9 WHEN 'quarantined_finish' THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM s""")
def map_products(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), b.table(spark, d, "part")
    common = [F.col("p_type").alias("game"), F.col("p_brand").alias("set_key"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("number")]
    cat = p.select(k.alias("id"), *common, F.upper("p_name").alias("name"), (k % 2).alias("finish"))
    ext = p.where("p_partkey % 3 <> 0").select(
        k.alias("ext_id"), F.col("p_type").alias("game"), F.col("p_brand").alias("set_key"), F.col("p_size").cast("string").alias("number"), F.when(k % 9 == 0, "other").when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("name"), ((k + F.when(k % 4 == 0, 1).otherwise(0)) % 2).alias("finish")
    )
    app = p.where("p_partkey % 31 = 0").select(k.alias("ext_id"), F.when(k % 2 == 0, k).otherwise(-1).alias("approved_id"))
    return resolve.map_products(ext, cat, app)


@query(f"""WITH {_EXT}, m AS (SELECT e.game, e.ext_id, (SELECT min(c.id) FROM cat c WHERE c.name = e.name AND c.game = e.game) AS id FROM ext e) SELECT game, count(*) AS total, count(id) AS matched, round(count(id) / count(*), 6) + 0.0 AS rate FROM m GROUP BY 1""")
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), b.table(spark, d, "part")
    ext = p.where("p_partkey % 3 <> 0").select(k.alias("ext_id"), F.col("p_type").alias("game"), F.when(k % 9 == 0, "other").when(k % 13 == 0, "").otherwise(F.col("p_name")).alias("name"))
    cat = p.groupBy(F.col("p_type").alias("game"), F.col("p_name").alias("name")).agg(F.min(k).alias("id"))
    return rounded(resolve.match_rates(ext.join(cat, ["game", "name"], "left"), ["game"]))


@query("""WITH e AS (SELECT o_custkey % 500 AS ext_id, o_orderpriority AS a, o_orderstatus AS s FROM orders) SELECT ext_id, count(*) AS copies, CASE WHEN count(DISTINCT a || '|' || s) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'repeated' ELSE 'single' END AS state FROM e GROUP BY 1""")
def mapping_batch(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("ext_id"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("s"))
    return resolve.mapping_batch(o, ["a", "s"])


_GS = """g AS (SELECT c_nationkey % 3 AS category, c_custkey AS id, c_name AS name, 'c' || (c_custkey % 300) AS code, DATE '2020-01-01' + CAST(c_custkey % 200 AS INTEGER) AS day FROM customer),
s AS (SELECT c_nationkey % 3 AS category, c_custkey + 5000 AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN c_name || 'x' ELSE 'nothing ' || c_custkey END AS name, CASE WHEN c_custkey % 4 = 2 THEN 'c' || (c_custkey % 300) ELSE 'z' || c_custkey END AS code, DATE '2020-01-05' + CAST(c_custkey % 200 AS INTEGER) AS day FROM customer)"""


@query(f"""WITH {_GS}, nm AS (SELECT g.id AS gid, s.id AS sid, 1 AS tier, 1.0 AS score FROM g JOIN s ON g.category = s.category AND lower(g.name) = lower(s.name) UNION ALL SELECT g.id, s.id, 2, 1.0 FROM g JOIN s ON g.category = s.category AND g.code = s.code
UNION ALL SELECT g.id, s.id, 3, 1 - levenshtein(lower(regexp_replace(g.name, '[^A-Za-z0-9]+', ' ', 'g')), lower(regexp_replace(s.name, '[^A-Za-z0-9]+', ' ', 'g'))) / greatest(length(g.name), length(s.name)) FROM g JOIN s ON g.category = s.category AND abs(g.day - s.day) <= 45 WHERE 1 - levenshtein(lower(regexp_replace(g.name, '[^A-Za-z0-9]+', ' ', 'g')), lower(regexp_replace(s.name, '[^A-Za-z0-9]+', ' ', 'g'))) / greatest(length(g.name), length(s.name)) >= 0.88),
f AS (SELECT *, min(tier) OVER (PARTITION BY gid) AS ft FROM nm), h AS (SELECT *, max(score) OVER (PARTITION BY gid) AS best FROM f WHERE tier = ft), r AS (SELECT gid, any_value(tier) AS tier, count(DISTINCT sid) AS n, min(sid) AS sid FROM h WHERE score >= best - 0.02 GROUP BY 1)
SELECT g.id AS group_id, CASE WHEN tier IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN tier = 1 THEN 'name' WHEN tier = 2 THEN 'code' ELSE 'similar' END AS method, CASE WHEN n = 1 THEN sid END AS set_id FROM g LEFT JOIN r ON g.id = gid""")
def match_sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = b.table(spark, d, "customer")
    g = c.select((F.col("c_nationkey") % 3).alias("category"), k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("c"), (k % 300).cast("string")).alias("code"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 200).cast("int")).alias("day"))
    name = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.concat("c_name", F.lit("x"))).otherwise(F.concat(F.lit("nothing "), k.cast("string")))
    s = c.select((F.col("c_nationkey") % 3).alias("category"), (k + 5000).alias("id"), name.alias("name"), F.when(k % 4 == 2, F.concat(F.lit("c"), (k % 300).cast("string"))).otherwise(F.concat(F.lit("z"), k.cast("string"))).alias("code"), F.date_add(F.lit("2020-01-05").cast("date"), (k % 200).cast("int")).alias("day"))
    return resolve.match_sets(g, s)


@query("""SELECT 'repeated_product' AS "check", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'product_without_group', count(*) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') UNION ALL SELECT 'price_without_product', count(*) FROM lineitem WHERE l_partkey % 10 = 0""")
def catalog_integrity(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("grp"))
    g = p.where("grp not in ('Brand#1', 'Brand#2')").select("grp")
    prices = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"))
    live = p.where("product % 10 <> 0")
    parts = resolve.catalog_integrity(p, g, prices).where("check <> 'price_without_product'")
    return parts.union(resolve.catalog_integrity(live, g, prices).where("check = 'price_without_product'"))


@query("""SELECT p_partkey AS product, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'card ' || p_partkey WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name FROM part""")
def enrich_from_bridge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = b.table(spark, d, "part").select(k.alias("product"), F.when(k % 3 != 0, F.col("p_name")).alias("name"))
    bridge = p.where("product % 2 = 0").select("product", (F.col("product") + 7).alias("card_id"))
    cards = bridge.select("card_id", F.concat(F.lit("card "), (F.col("card_id") - 7).cast("string")).alias("name"))
    return resolve.enrich(p, bridge, cards, ["name"]).select("product", "name")
