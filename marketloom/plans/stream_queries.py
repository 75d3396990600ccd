"""Streams over the given tables: each runs until the input is used up, writes in the shared folder, and gives what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import demand
from marketloom.plans import bindings as b
from marketloom.plans.market_queries import outlier_status_sequential  # noqa: F401  the batch form, whose SQL the stream shares
from marketloom.plans.registry import _SQL, query
from marketloom.sources.io import work_folder
from marketloom.sources.tables import BucketTable
from marketloom.streaming import streams

Sink = Callable[[DataFrame, int], None]
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _source(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; the pattern lets a single file be a source."""
    schema = b.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")


def _demand(stream: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in b.KINDS.items() for x in kv])
    return stream.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("variant"), F.try_element_at(kinds, "event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))


def _run(stream: DataFrame, sink: Callable[[SparkSession, str], Sink] | None = None, mode: str = "append", states: bool = False, table: bool = False) -> DataFrame:
    """Run the stream to its end. Without a sink, each batch is a folder, which a repeated batch overwrites."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def batch(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/v={i}")

    before = spark.conf.get(_STORE, None)
    if states:
        spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.foreachBatch(sink(spark, f"{folder}/out") if sink else batch).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if states:
            spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return BucketTable(spark, f"{folder}/out", []).read().drop("__bucket") if table else spark.read.parquet(f"{folder}/out")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for n, k in demand.KINDS.items())


@query(f"""WITH {b.DEMAND} SELECT DISTINCT "user", variant, kind, date_trunc('hour', ts) AS hour FROM demand""")
def dedupe_demand_stream(spark: SparkSession, d: str) -> DataFrame:
    return _run(streams.dedupe_demand(_demand(_source(spark, d)))).select("user", "variant", "kind", F.col("hour").cast("timestamp_ntz").alias("hour"))


@query(f"""WITH {b.DEMAND} SELECT "user", variant, kind, count(*) AS n FROM demand WHERE "user" % 50 NOT IN (0, 1) GROUP BY 1, 2, 3""")
def eligible_demand_stream(spark: SparkSession, d: str) -> DataFrame:
    excluded = b.demand_events(spark, d).where(F.col("user") % 50 < 2)
    return _run(streams.eligible_demand(_demand(_source(spark, d)), excluded)).groupBy("user", "variant", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {b.DEMAND} SELECT variant, CAST(date_trunc('week', ts) AS DATE) AS period, {_COUNTS}, CAST(count(DISTINCT "user") AS INTEGER) AS unique_users, count(DISTINCT "user") >= 15 AS privacy_threshold_met FROM demand GROUP BY 1, 2""")
def weekly_demand_stream(spark: SparkSession, d: str) -> DataFrame:
    keys = ["period", "variant", "user"]
    rows = _run(streams.weekly_user_demand(_demand(_source(spark, d))), lambda s, path: streams.upsert_sink(s, path, keys), "update", table=True)
    return streams.weekly_counts(rows, threshold=15)


@query(f"""WITH {b.DEMAND}, w AS (SELECT CAST(date_trunc('day', ts) AS DATE) + CAST(k AS INTEGER) AS until, variant, "user" FROM demand, generate_series(1, 7) g(k)) SELECT until, variant, count(*) AS events, CAST(count(DISTINCT "user") AS INTEGER) AS users FROM w GROUP BY 1, 2""")
def sliding_velocity_stream(spark: SparkSession, d: str) -> DataFrame:
    keys = ["day", "variant", "user"]
    return streams.sliding_velocity_of_days(_run(streams.daily_user_events(_demand(_source(spark, d))), lambda s, path: streams.upsert_sink(s, path, keys), "update", table=True))


@query("SELECT DISTINCT user_id AS id FROM events")
def first_seen_stream(spark: SparkSession, d: str) -> DataFrame:
    return _run(streams.first_seen_stream(_source(spark, d).select(F.col("user_id").alias("id"), F.col("ts").alias("available_at")))).select("id")


@query(_SQL["outlier_status_sequential"])
def outlier_stream(spark: SparkSession, d: str) -> DataFrame:
    s = _source(spark, d)
    obs = s.select(F.col("user_id").alias("series"), F.date_trunc("hour", "ts").alias("observed_at"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod("event_id", F.lit(5)).cast("int"))).alias("available_at"), F.col("value").alias("price"), F.col("event_id").alias("id"))
    return _run(streams.outlier_stream(obs, z=3.0, window_days=7), states=True).select("id", "status")


@query("""WITH a AS (SELECT user_id AS key, ts, CASE WHEN event_id % 5 > 0 THEN value END AS price, CASE WHEN event_id % 11 = 0 THEN 'EUR' ELSE 'USD' END AS cur, event_id % 4 = 0 AS stale, event_type AS trend, event_id % 3 AS fp, event_id FROM events),
l AS (SELECT *, lag(1) OVER w AS seen, lag(price) OVER w AS bp, lag(cur) OVER w AS bc, lag(stale) OVER w AS bs, lag(trend) OVER w AS bt, lag(fp) OVER w AS bf FROM a WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
j AS (SELECT *, coalesce(bp IS NOT NULL AND bc = cur, false) AS cmp FROM l WHERE seen IS NULL OR fp <> bf OR stale <> bs),
k AS (SELECT key, unnest(list_filter([CASE WHEN seen = 1 AND bp IS NULL AND price IS NOT NULL THEN 'new_catalog_price' END, CASE WHEN bp IS NOT NULL AND price IS NULL THEN 'became_unpriced' END, CASE WHEN seen = 1 AND NOT bs AND stale THEN 'price_stale' END, CASE WHEN cur = 'USD' AND price <= 100 AND (NOT cmp OR bp > 100) THEN 'target_price' END,
CASE WHEN cmp AND bp > 0 AND abs(price / bp - 1) * 100 >= 10 THEN 'percent_change' END, CASE WHEN seen = 1 AND bt <> trend THEN 'trend_change' END], lambda x: x IS NOT NULL)) AS alert FROM j) SELECT key, alert, count(*) AS n FROM k GROUP BY 1, 2""")
def alert_stream(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("event_id"), F.lit(None).cast("string")
    # times of one user may be equal: as many microseconds as the id says keep their order
    at = F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k / 1_000_000)
    s = _source(spark, d).select(
        F.col("user_id").alias("key"), at.alias("at"), F.when(k % 5 > 0, F.col("value")).alias("price"), F.when(k % 11 == 0, "EUR").otherwise("USD").alias("currency"), (k % 4 == 0).alias("stale"), F.col("event_type").alias("trend"), none.alias("position"), none.alias("signature"), (k % 3).cast("string").alias("fingerprint"),
        F.lit(100.0).alias("target"), F.lit("USD").alias("target_currency"), F.lit(10.0).alias("percent"), F.lit(True).alias("on_trend"), F.lit(True).alias("on_range"), F.lit(True).alias("on_forecast"),
    )
    return _run(streams.alert_stream(s), states=True).groupBy("key", "alert").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id FROM events), m AS (SELECT max(day) AS d FROM e) SELECT day, event_type, count(*) AS n FROM e, m WHERE day > d - 30 GROUP BY 1, 2""")
def retention_stream(spark: SparkSession, d: str) -> DataFrame:
    kept = _run(_source(spark, d).select("ts", "event_type", "event_id"), lambda s, path: streams.retention_sink(s, path, "ts", 30))
    return kept.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, max(ts) AS stamp FROM events GROUP BY 1")
def archive_stream(spark: SparkSession, d: str) -> DataFrame:
    return _run(_source(spark, d).select(F.col("user_id").alias("key"), F.col("ts").alias("stamp")), lambda s, path: streams.ordered_sink(s, path, ["key"], "stamp"), table=True)
