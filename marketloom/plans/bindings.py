"""The given tables as price facts, panels, holdings, events and catalogs, in Spark and in SQL.

Each binding is a frame; the text of the same name in capitals is the matching SQL, for use in a WITH list.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Price facts: category, grp, product, day, price, available_at, line."""
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return (
        table(spark, d, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("grp"),
            F.col("l_partkey").alias("product"),
            F.to_date("l_shipdate").alias("day"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            (F.to_date("l_shipdate") + F.col("l_linenumber")).alias("available"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
        )
    )


FACTS = """facts AS (SELECT p_type AS category, p_brand AS grp, l_partkey AS product, CAST(l_shipdate AS DATE) AS day,
  l_extendedprice / l_quantity AS price, CAST(l_shipdate AS DATE) + l_linenumber AS available, l_orderkey * 10 + l_linenumber AS obs_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SERIES = ["category", "grp"]


def as_of_day(rows: DataFrame) -> datetime.date:
    """The day from 1997 on with the most rows, the earliest of equals: one row comes to the driver."""
    found = rows.where("day >= date '1997-01-01'").groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").first()
    return found["day"] if found else datetime.date(1997, 1, 1)


AS_OF = "ad AS (SELECT day AS as_of FROM facts WHERE day >= DATE '1997-01-01' GROUP BY day ORDER BY count(*) DESC, day LIMIT 1)"


def week_panel(spark: SparkSession, d: str) -> DataFrame:
    """One price for each (category, grp, product) and quarter: category, grp, product, t, price."""
    day = F.to_date("l_shipdate")
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product"),
        F.floor(F.datediff(day, F.lit("1995-01-01")) / 91).cast("int").alias("t"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct(day.alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id")).alias("at"),
    )
    # dealt out by product once: the aggregate, the join and the series windows that follow need no other shuffle, and rows carry no names
    prices = lines.repartition("product").groupBy("product", "t").agg(F.max_by("price", "at").alias("price")).where("price > 0")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_type").alias("category"), F.col("p_brand").alias("grp"))
    return prices.join(parts.repartition("product").distinct(), "product").select("category", "grp", "product", "t", "price")


PANEL = f"""{FACTS}, panel AS (SELECT category, grp, product, CAST(floor((day - DATE '1995-01-01') / 91.0) AS INTEGER) AS t,
  arg_max(price, {{'d': day, 'o': obs_id}}) AS price FROM facts GROUP BY ALL)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as bitemporal observations: series, observed_at (the hour), available_at, price, quality, id."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("series"),
        F.date_trunc("hour", "ts").alias("observed_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod("event_id", F.lit(5)).cast("int"))).alias("available_at"),
        F.col("value").alias("price"),
        (0.5 + F.pmod("event_id", F.lit(50)) / 100).alias("quality"),
        F.col("event_id").alias("id"),
    )


OBS = """obs AS (SELECT user_id AS series, date_trunc('hour', ts) AS observed_at, ts + to_hours(CAST(event_id % 5 AS INTEGER)) AS available_at,
  value AS price, 0.5 + (event_id % 50) / 100 AS quality, event_id AS id FROM events)"""


def demand_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a demand ledger: user, variant, kind, at."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(spark, d, "events").select(
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("int").alias("variant"),
        F.try_element_at(kinds, "event_type").alias("kind"),
        F.col("ts").alias("at"),
    )


KINDS = {"view": "card_view", "click": "search_view", "purchase": "portfolio_add", "signup": "watch_add", "error": "watch_remove"}
DEMAND = """demand AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INTEGER) AS variant,
  CASE event_type WHEN 'view' THEN 'card_view' WHEN 'click' THEN 'search_view' WHEN 'purchase' THEN 'portfolio_add'
    WHEN 'signup' THEN 'watch_add' WHEN 'error' THEN 'watch_remove' END AS kind, ts AS ts FROM events)"""


def holdings(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as holdings with three currencies."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    currency = F.when(F.col("l_returnflag") == "A", "EUR").when(F.col("l_returnflag") == "R", "GBP").otherwise("USD")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("owner"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("product"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("set_name"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_linenumber") % 7 != 0, unit).alias("purchase_price"),
            (F.col("l_tax") * unit).alias("fees"),
            F.when(F.col("l_linestatus") == "O", F.col("p_retailprice")).alias("market_price"),
            currency.alias("currency"),
            F.when(F.col("l_linenumber") == 2, "EUR").otherwise(currency).alias("cost_currency"),
            F.to_date("o_orderdate").alias("bought_on"),
            F.to_date("l_shipdate").alias("updated_on"),
        )
    )


HOLDINGS = """holdings AS (SELECT o_custkey AS owner, l_orderkey * 10 + l_linenumber AS id, l_partkey AS product, p_type AS category, p_brand AS set_name,
  l_quantity AS quantity, CASE WHEN l_linenumber % 7 <> 0 THEN l_extendedprice / l_quantity END AS purchase_price, l_tax * l_extendedprice / l_quantity AS fees,
  CASE WHEN l_linestatus = 'O' THEN p_retailprice END AS market_price,
  CASE l_returnflag WHEN 'A' THEN 'EUR' WHEN 'R' THEN 'GBP' ELSE 'USD' END AS currency,
  CASE WHEN l_linenumber = 2 THEN 'EUR' ELSE CASE l_returnflag WHEN 'A' THEN 'EUR' WHEN 'R' THEN 'GBP' ELSE 'USD' END END AS cost_currency,
  CAST(o_orderdate AS DATE) AS bought_on, CAST(l_shipdate AS DATE) AS updated_on
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents that are neighbours by id, as pairwise votes: a, b, winner."""
    rows = table(spark, d, "labels").select("doc_id", "quality")
    right = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("quality").alias("qb"))
    return rows.join(right, "doc_id").select(F.pmod("doc_id", F.lit(20)).alias("a"), F.pmod("b", F.lit(20)).alias("b"), F.when(F.col("qb") > F.col("quality"), F.pmod("b", F.lit(20))).otherwise(F.pmod("doc_id", F.lit(20))).alias("winner"))


VOTES = """votes AS (SELECT x.doc_id % 20 AS a, y.doc_id % 20 AS b, CASE WHEN y.quality > x.quality THEN y.doc_id % 20 ELSE x.doc_id % 20 END AS winner
  FROM labels x JOIN labels y ON y.doc_id = x.doc_id + 1)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Forecast cases of the panel: half of the last step carried on, scored by the next price."""
    from pyspark.sql import Window

    from marketloom.functions.scalars import clamp
    from marketloom.operators.market import Z
    from marketloom.operators.windows import step_returns

    keys = ["product", "category", "grp"]  # a series is told by its product already: the sort compares names last
    s = step_returns(week_panel(spark, d), keys)
    w = Window.partitionBy(*keys).orderBy("t")
    c = s.withColumn("realized", F.lead("price").over(w)).where("realized is not null")
    r = clamp(F.coalesce("r", F.lit(0.0)), -0.7, 0.7)
    c = c.select(*SERIES, "product", F.col("t").alias("origin"), F.col("price").alias("current"), "realized", (F.col("price") * F.exp(0.5 * r)).alias("predicted"), F.col("price").alias("baseline"), (F.col("price") * F.exp(r)).alias("momentum"), clamp(0.5 + 0.3 * r, 0.01, 0.99).alias("probability_up"))
    return c.withColumns({q: F.col("predicted") * F.exp(F.lit(z * 0.2)) for q, z in Z.items()})


CASES = f"""{PANEL}, steps AS (SELECT *, ln(price / lag(price) OVER w) / (t - lag(t) OVER w) AS r, lead(price) OVER w AS realized FROM panel WINDOW w AS (PARTITION BY category, grp, product ORDER BY t)),
c0 AS (SELECT category, grp, product, t AS origin, price AS current, realized, price * exp(0.5 * least(0.7, greatest(-0.7, coalesce(r, 0)))) AS predicted, price AS baseline, price * exp(least(0.7, greatest(-0.7, coalesce(r, 0)))) AS momentum,
  least(0.99, greatest(0.01, 0.5 + 0.3 * least(0.7, greatest(-0.7, coalesce(r, 0))))) AS probability_up FROM steps WHERE realized IS NOT NULL),
cases AS (SELECT *, predicted * exp(-1.281551565545 * 0.2) AS q10, predicted * exp(-0.674489750196 * 0.2) AS q25, predicted AS q50, predicted * exp(0.674489750196 * 0.2) AS q75, predicted * exp(1.281551565545 * 0.2) AS q90 FROM c0)"""


def gate_cases(spark: SparkSession, d: str) -> DataFrame:
    """The cases with cohort, horizon and buckets, as the gates take them."""
    k = F.col("product")
    return cases(spark, d).withColumns(
        {
            "horizon": F.lit(90),
            "cohort": F.when(k % 7 == 0, "low-history").otherwise("standard"),
            "volatility_bucket": F.when(k % 3 == 0, "low").otherwise("high"),
            "age_bucket": F.when(k % 2 == 0, "new").otherwise("old"),
        }
    )


GATE_CASES = f"""{CASES}, gc AS (SELECT *, 90 AS horizon, CASE WHEN product % 7 = 0 THEN 'low-history' ELSE 'standard' END AS cohort, CASE WHEN product % 3 = 0 THEN 'low' ELSE 'high' END AS volatility_bucket,
  CASE WHEN product % 2 = 0 THEN 'new' ELSE 'old' END AS age_bucket FROM cases)"""
