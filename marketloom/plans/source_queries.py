"""Sources and sinks: what is written in the shared folder from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans import bindings as b
from marketloom.plans.market_queries import rounded
from marketloom.plans.registry import query
from marketloom.sources import io

_DOCS = """docs AS (SELECT make_date(year(l_shipdate)::INT, 1, 1) AS archive_date, CAST(p_size % 3 + 1 AS INTEGER) AS category_id, CAST(p_partkey % 5 AS INTEGER) AS group_id, p_partkey AS product_id, l_linestatus AS subtype_name,
  max(CASE WHEN p_partkey % 7 <> 0 THEN l_extendedprice END) AS market, min(l_extendedprice) AS low FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.col("l_extendedprice")
    keys = [F.trunc(F.to_date("l_shipdate"), "year").alias("archive_date"), (F.col("p_size") % 3 + 1).cast("int").alias("category_id"), (F.col("p_partkey") % 5).cast("int").alias("group_id"), F.col("p_partkey").alias("product_id"), F.col("l_linestatus").alias("subtype_name")]
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("p_partkey") % 7 != 0, unit)).alias("marketPrice"), F.min(unit).alias("lowPrice"))


@query(f"""WITH {_DOCS} SELECT archive_date, category_id, group_id, product_id, subtype_name, round(coalesce(market, low), 2) + 0.0 AS price, CASE WHEN market IS NULL THEN 'low' ELSE 'market' END AS field FROM docs WHERE category_id <> 3""")
def read_price_archive(spark: SparkSession, d: str) -> DataFrame:
    folder = io.work_folder(spark)
    io.write_price_archive(_docs(spark, d), folder)
    rows = io.read_price_archive(spark, folder, [1, 2])
    return rows.select("archive_date", "category_id", "group_id", "product_id", "subtype_name", (F.round(F.col("best.price").cast("double"), 2) + 0.0).alias("price"), F.col("best.field").alias("field"))


_BAD = """bad AS (SELECT archive_date, category_id, CASE WHEN product_id % 13 = 0 THEN 'invalid_product_id' WHEN product_id % 17 = 0 THEN 'missing_subtype_name' WHEN product_id % 19 = 0 THEN 'no_price_data' END AS reason, group_id FROM docs)"""


def _lenient(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("product_id")
    broken = _docs(spark, d).withColumns(
        {
            "marketPrice": F.when(k % 19 != 0, F.col("marketPrice")),
            "lowPrice": F.when(k % 19 != 0, F.col("lowPrice")),
            "subtype_name": F.when(k % 17 == 0, " ").otherwise(F.col("subtype_name")),
            "product_id": F.when(k % 13 == 0, -k).otherwise(k),
        }
    )
    folder = io.work_folder(spark)
    io.write_price_archive(broken, folder)
    return io.read_panel_members(spark, folder, [1, 2, 3])


@query(f"""WITH {_DOCS}, {_BAD} SELECT archive_date, category_id, coalesce(reason, 'read') AS reason, count(*) AS n FROM bad GROUP BY 1, 2, 3""")
def read_panel_members(spark: SparkSession, d: str) -> DataFrame:
    rows, rejects = _lenient(spark, d)
    return rejects.union(rows.groupBy("archive_date", "category_id", F.lit("read").alias("reason")).agg(F.count("*").alias("n")))


@query(f"""WITH {_DOCS}, {_BAD} SELECT archive_date, category_id, count(DISTINCT CASE WHEN reason IS NULL THEN group_id END) AS groups, count(*) FILTER (WHERE reason IS NULL) AS rows, count(*) FILTER (WHERE reason IS NOT NULL) AS rejects FROM bad GROUP BY 1, 2""")
def archive_receipt(spark: SparkSession, d: str) -> DataFrame:
    return io.archive_receipt(*_lenient(spark, d)).drop("digest")


@query(f"""WITH {_DOCS} SELECT archive_date, category_id, count(*) AS n, round(sum(low), 2) + 0.0 AS total, min(product_id) AS first FROM docs GROUP BY 1, 2""")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    folder = io.work_folder(spark)
    io.write_price_history(_docs(spark, d), folder)
    h = io.read_price_history(spark, folder)
    return rounded(h.groupBy("archive_date", "category_id").agg(F.count("*").alias("n"), F.sum("lowPrice").alias("total"), F.min("product_id").alias("first")), 2)


@query("""SELECT p_type AS category, p_brand AS grp, count(*) AS n, round(sum(p_retailprice), 2) + 0.0 AS total FROM part WHERE p_size % 5 NOT IN (0, 1, 2) GROUP BY 1, 2""")
def read_weekly_panel(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size") % 5
    price = F.when(size == 0, F.lit(float("nan"))).when(size == 1, 0.0).when(size == 2, F.lit(None)).otherwise(F.col("p_retailprice"))
    folder = io.work_folder(spark)
    b.table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("grp"), price.alias("price")).write.parquet(folder)
    return rounded(io.read_weekly_panel(spark, folder).groupBy("category", "grp").agg(F.count("*").alias("n"), F.sum("price").alias("total")), 2)


def _published(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").where("p_size > 3").select(F.col("p_type").alias("category"), F.col("p_size").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_name").alias("v"))
    return io.publish_grouped_documents(p, ["category", "grp"], ["id"], ["id", "v"], max_bytes=300)


@query("SELECT p_type AS category, p_size AS grp, p_partkey AS id, p_name AS v FROM part WHERE p_size > 3")
def publish_grouped_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = F.explode(F.from_json("body", "array<struct<id:long,v:string>>")).alias("r")
    return _published(spark, d).select("category", "grp", rows).select("category", "grp", "r.id", "r.v")


@query("""WITH g AS (SELECT p_type AS category, p_size AS grp, count(*) FILTER (WHERE p_size > 3) AS n FROM part GROUP BY 1, 2)
SELECT category, count(*) FILTER (WHERE n > 0) AS published, count(*) FILTER (WHERE n = 0) AS excluded, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1""")
def publish_manifest(spark: SparkSession, d: str) -> DataFrame:
    groups = b.table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_size").alias("grp"))
    return io.manifest_totals(io.publish_manifest(_published(spark, d), ["category", "grp"], groups), "category").select("category", "published", "excluded", "rows")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '''-' || p_name WHEN 2 THEN p_name || '=1' ELSE p_name END AS v FROM part""")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    k, name, folder = F.col("p_partkey"), F.col("p_name"), io.work_folder(spark)
    v = F.when(k % 4 == 0, F.concat(F.lit("="), name)).when(k % 4 == 1, F.concat(F.lit("-"), name)).when(k % 4 == 2, F.concat(name, F.lit("=1"))).otherwise(name)
    io.export_csv(b.table(spark, d, "part").select(k.alias("id"), v.alias("v")), folder)
    return spark.read.option("header", True).schema("id long, v string").csv(folder)


@query("""SELECT 'orders' AS "table", count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) FILTER (WHERE o_totalprice <= 50000) AS excluded FROM orders UNION ALL SELECT 'part', count(*), count(DISTINCT p_partkey), count(*) FILTER (WHERE p_size < 5) FROM part""")
def catalog_snapshot(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: b.table(spark, d, n) for n in ("orders", "part")}
    found = io.catalog_snapshot(tables, {"orders": "o_orderkey", "part": "p_partkey"}, {"orders:excluded": F.col("o_totalprice") <= 50000, "part:excluded": F.col("p_size") < 5})
    one = [df.select(F.lit(n).alias("table"), "rows", "keys", "excluded") for n, df in found.items()]
    return one[0].union(one[1])


@query("""WITH w AS (SELECT p_size AS id, arg_max(p_type, p_partkey) AS t, arg_max(p_partkey, p_partkey) AS k FROM part GROUP BY 1), n AS (SELECT id, t AS name, CASE WHEN k % 2 = 0 THEN t || ' Card' ELSE t END AS display_name, CAST(k % 5 AS BIGINT) AS popularity FROM w)
SELECT CAST(id AS INTEGER) AS category_id, name, display_name, popularity, contains(lower(display_name), 'card') AS is_card, sha256(name || chr(31) || display_name) AS semantic_sha256 FROM n""")
def normalize_category(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = b.table(spark, d, "part").select(F.col("p_size").alias("categoryId"), F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("name"), F.when(k % 2 == 0, F.concat(F.col("p_type"), F.lit(" Card "))).alias("displayName"), (k % 5).alias("popularity"), k.alias("modifiedOn"))
    return io.normalize_category(raw)


@query("""SELECT p_partkey AS product_id, p_name AS name, upper(p_name) AS clean_name, CAST(p_size AS VARCHAR) AS number, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS rarity, p_type AS card_type,
sha256(p_name || chr(31) || upper(p_name) || chr(31) || p_size || chr(31) || CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END || chr(31) || p_type) AS semantic_sha256 FROM part""")
def normalize_product(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    rarity = F.when(F.col("p_partkey") % 3 != 0, "Rarity").otherwise("Other")
    data = F.array(pair("NUMBER", F.col("p_size")), F.struct(rarity.alias("name"), F.col("p_brand").alias("value")), pair("CardType", F.col("p_type")))
    return io.normalize_product(b.table(spark, d, "part").select(F.col("p_partkey").alias("productId"), F.concat(F.lit(" "), "p_name").alias("name"), F.upper("p_name").alias("cleanName"), data.alias("extendedData")))


@query("""SELECT o_orderkey AS group_id, o_orderpriority AS name, upper(o_orderstatus) || 'X' AS abbreviation, CAST(o_orderdate AS DATE) AS published_on, o_custkey % 3 = 0 AS is_supplemental FROM orders""")
def normalize_group(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").alias("groupId"), F.concat(F.lit(" "), "o_orderpriority").alias("name"), F.concat(F.lower("o_orderstatus"), F.lit("x ")).alias("abbreviation"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("publishedOn"), F.when(F.col("o_custkey") % 3 == 0, True).alias("isSupplemental"))
    return io.normalize_group(raw)


@query("""SELECT p_partkey AS id, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS is_card FROM part""")
def classify_card_category(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 2 == 0, F.concat("p_name", F.lit(" Singles")))
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(" TCG"))).otherwise(F.col("p_name"))
    return b.table(spark, d, "part").select(k.alias("id"), io.classify_card_category(label, name).alias("is_card"))


@query("""SELECT CAST(ts AS DATE) AS day, any_value(event_id % 90) AS views FROM events WHERE user_id = 5 AND event_id % 90 >= 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1 HAVING count(*) = 1""")
def parse_pageviews(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("user_id").cast("string").alias("article"), F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("00")).alias("timestamp"), (F.col("event_id") % 90).alias("views"))
    return io.parse_pageviews(b.table(spark, d, "events").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body")), "5", "2024-01-05", "2024-01-25")


@query("""WITH f AS (SELECT DISTINCT p_type AS rarity, CASE WHEN p_size % 2 = 0 THEN 'foil' ELSE 'normal' END AS finish FROM part WHERE p_type <> 'SMALL')
SELECT p_brand AS set_id, p_partkey AS card_id, p_type AS rarity, coalesce(finish, 'unspecified') AS finish FROM part LEFT JOIN f ON p_type = rarity""")
def seed_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    finishes = p.where("p_type <> 'SMALL'").select(F.col("p_type").alias("rarity"), F.when(F.col("p_size") % 2 == 0, "foil").otherwise("normal").alias("finish"))
    return io.seed_catalog(p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("card_id"), F.col("p_type").alias("rarity")), finishes).select("set_id", "card_id", "rarity", "finish")


@query(f"""WITH {b.PANEL} SELECT category, count(DISTINCT t) AS dates, count(*) AS rows, count(DISTINCT (grp, product)) AS variants, CAST(min(t) AS BIGINT) AS first, CAST(max(t) AS BIGINT) AS last FROM panel WHERE price > 0 GROUP BY 1""")
def panel_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = io.panel_coverage(b.week_panel(spark, d), "category", "t", ["grp", "product"])
    return c.withColumns({"first": F.col("first").cast("long"), "last": F.col("last").cast("long")})


@query("""SELECT o_orderkey AS provider_id, 'shop' AS vendor, l_linestatus AS finish, CAST(l_shipdate AS DATE) AS observed_on, round(l_extendedprice, 2) + 0.0 AS price, CAST(o_orderdate AS DATE) AS available_on, CAST(0.85 AS DOUBLE) AS quality FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def provider_history_records(spark: SparkSession, d: str) -> DataFrame:
    lines = b.table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_extendedprice").alias("price")).alias("p"))
    finishes = lines.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list("p").alias("points"))
    body = finishes.groupBy("l_orderkey").agg(F.to_json(F.create_map(F.lit("shop"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", "points"))))).alias("body"))
    raw = body.join(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("retrieved_at")), "l_orderkey").select(F.col("l_orderkey").alias("provider_id"), "retrieved_at", "body")
    r = io.provider_history_records(raw)
    return r.select("provider_id", "vendor", "finish", "observed_on", (F.round("price", 2) + 0.0).alias("price"), F.to_date("available_at").alias("available_on"), "quality")
