"""Structured Streaming forms of the demand ledger, the outlier gate, first-seen ledger and the daily arrival.

Each takes a streaming frame with columns as in the batch form and returns one; its state is bounded by a watermark.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.demand import KINDS
from marketloom.operators.merge import apply_if_newer
from marketloom.operators.pit import gate
from marketloom.operators.portfolio import ALERTS
from marketloom.sources.tables import BucketTable, replace_rows


def dedupe_demand(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """One event for each user, variant, kind and hour."""
    hourly = stream.withColumn("hour", F.date_trunc("hour", "at"))
    return hourly.withWatermark("at", delay).dropDuplicatesWithinWatermark(["user", "variant", "kind", "hour"])


def eligible_demand(stream: DataFrame, excluded: DataFrame) -> DataFrame:
    """Events of users that a static table does not exclude."""
    return stream.join(excluded.select("user").distinct().withColumn("__x", F.lit(True)), "user", "left").where("__x is null").drop("__x")


def weekly_user_demand(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(period, variant, user, a count of each kind) of Monday-to-Sunday weeks: a state row for each user, of constant size."""
    w = stream.withWatermark("at", delay).groupBy(F.window("at", "7 days", "7 days", "4 days"), "variant", "user")
    return w.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in KINDS.items()]).select(F.to_date("window.start").alias("period"), "variant", "user", *KINDS)


def weekly_counts(rows: DataFrame, threshold: int = 20) -> DataFrame:
    """The second step: (period, variant, counts, unique_users, privacy_threshold_met) of the newest rows of weekly_user_demand."""
    users = F.count("*").cast("int")
    return rows.groupBy("period", "variant").agg(*[F.sum(n).alias(n) for n in KINDS], users.alias("unique_users"), (users >= threshold).alias("privacy_threshold_met"))


def sliding_user_events(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(until, variant, user, events) of the last seven days, moved on by a day: a state row for each user, of constant size."""
    w = stream.withWatermark("at", delay).groupBy(F.window("at", "7 days", "1 day"), "variant", "user")
    return w.agg(F.count("*").alias("events")).select(F.to_date("window.end").alias("until"), "variant", "user", "events")


def daily_user_events(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """(day, variant, user, events): a state row for each user and day. With a delay longer by the six days that a window lies open after its first, an event
    counts as long as any of its windows of sliding_user_events would take it."""
    w = stream.withWatermark("at", delay).groupBy(F.window("at", "1 day"), "variant", "user")
    return w.agg(F.count("*").alias("events")).select(F.to_date("window.start").alias("day"), "variant", "user", "events")


def sliding_velocity_of_days(rows: DataFrame, days: int = 7) -> DataFrame:
    """The second step: as sliding_velocity, from the newest rows of daily_user_events. A user's row is kept for the windows from its day on up to the user's next
    day, so each user counts once in a window, without repeated rows for the events and without a distinct count."""
    ahead = F.least(F.lit(days), F.datediff(F.lead("day").over(Window.partitionBy("variant", "user").orderBy("day")), "day"))
    first = rows.select("variant", "day", "events", F.coalesce(ahead, F.lit(days)).alias("ahead")).groupBy("variant", "day", "ahead").agg(F.sum("events").alias("events"), F.count("*").alias("users"))
    each = first.select("variant", "day", "ahead", "events", "users", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("k"))
    counted = F.sum(F.when(F.col("k") <= F.col("ahead"), F.col("users")).otherwise(0)).cast("int")
    return each.groupBy(F.date_add("day", F.col("k")).alias("until"), "variant").agg(F.sum("events").alias("events"), counted.alias("users"))


def sliding_velocity(rows: DataFrame) -> DataFrame:
    """The second step: (until, variant, events, users) of the newest rows of sliding_user_events."""
    return rows.groupBy("until", "variant").agg(F.sum("events").alias("events"), F.count("*").cast("int").alias("users"))


class OutlierGate(StatefulProcessor):
    """Accepts or rejects each price of a series by the log prices accepted before it, within a window of days.

    State is the series' accepted points of the last two windows, so a point that comes up to a window late is judged as in a batch.
    """

    def __init__(self, min_history: int = 7, z: float = 8.0, zero_mad: float = 1.0986122886681098, window_days: int = 90) -> None:
        self.policy = (min_history, z, zero_mad, window_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "observed timestamp, available timestamp, id long, x double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = [(pd.Timestamp(o), pd.Timestamp(a), i, x) for o, a, i, x in self.accepted.get()] if self.accepted.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["available_at", "observed_at", "id"])
        status, known = gate(pdf, known, *self.policy)
        newest = max((p[0] for p in known), default=None)
        self.accepted.put([(o.to_pydatetime(), a.to_pydatetime(), int(i), float(x)) for o, a, i, x in known if o >= newest - pd.Timedelta(days=2 * self.policy[3])])
        yield pd.DataFrame({"series": pdf["series"], "id": pdf["id"], "status": status})

    def close(self) -> None:
        pass


def outlier_stream(stream: DataFrame, **policy: float) -> DataFrame:
    """(series, id, status): needs the RocksDB state store."""
    return stream.select("series", "observed_at", "available_at", "price", "id").groupBy("series").transformWithStateInPandas(OutlierGate(**policy), "series long, id long, status string", "Append", "None")


BASELINE = ("price", "currency", "stale", "trend", "position", "signature", "fingerprint")


def alert_kinds(now: dict, last: dict | None) -> list[str]:
    """The alerts of a watch entry against its last baseline: portfolio.alerts, one entry at a time."""
    seen, before = last is not None, last or dict.fromkeys(BASELINE)
    if seen and before["fingerprint"] == now["fingerprint"] and bool(before["stale"]) == bool(now["stale"]):
        return []
    price, was = now["price"], before["price"]
    comparable = was is not None and before["currency"] == now["currency"]
    changed = lambda x: bool(before[x]) and bool(now[x]) and before[x] != now[x]
    rules = (
        seen and was is None and price is not None,
        was is not None and price is None,
        seen and not before["stale"] and bool(now["stale"]),
        price is not None and now["target"] is not None and now["target_currency"] == now["currency"] and price <= now["target"] and (not comparable or was > now["target"]),
        price is not None and comparable and was > 0 and (now["percent"] or 0) > 0 and abs(price / was - 1) * 100 >= now["percent"],
        bool(now["on_trend"]) and changed("trend"),
        bool(now["on_range"]) and changed("position"),
        bool(now["on_forecast"]) and changed("signature"),
    )
    return [kind for kind, met in zip(ALERTS, rules, strict=True) if met]


class AlertState(StatefulProcessor):
    """Compares each watch entry with its last baseline, and keeps the newest as the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double, currency string, stale boolean, trend string, position string, signature string, fingerprint string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # plain lists: most keys have few rows, for which a frame's own operations cost more than the rules
        columns, parts = None, []
        for pdf in rows:
            columns = list(pdf.columns)
            own = (pdf[c] for c in columns)
            parts += zip(*[x.tolist() if x.dtype.kind in "bi" else [None if v is None or v != v else v for v in x.tolist()] for x in own], strict=True)
        place = columns.index("at")
        parts.sort(key=lambda r: (r[place] is None, r[place]))
        before = self.last.get()
        last = dict(zip(BASELINE, before, strict=True)) if before is not None else None
        out = []
        for part in parts:
            row = dict(zip(columns, part, strict=True))
            out += [(key[0], row["at"], kind) for kind in alert_kinds(row, last)]
            last = {c: row[c] for c in BASELINE}
        self.last.update(tuple(last.values()))
        yield pd.DataFrame(out, columns=["key", "at", "alert"])

    def close(self) -> None:
        pass


def alert_stream(stream: DataFrame) -> DataFrame:
    """(key, at, alert) from rows of watch entries as portfolio.alerts takes them, with their time `at`: needs the RocksDB state store."""
    own = ["key", "at", *BASELINE, "target", "target_currency", "percent", "on_trend", "on_range", "on_forecast"]
    return stream.select(*own).groupBy("key").transformWithStateInPandas(AlertState(), "key long, at timestamp, alert string", "Append", "None")


def first_seen_stream(stream: DataFrame) -> DataFrame:
    """The first row of each id that ever came: keyed state without a timeout, one entry for each id."""
    return stream.dropDuplicates(["id"])


def upsert_sink(spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces the keys' rows in a BucketTable: what is written follows the buckets that a batch touches, and
    a batch that is run again leaves no repeats."""
    table = BucketTable(spark, path, keys, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, replace_rows(keys))

    return write


def retention_sink(spark: SparkSession, path: str, day: str, keep_days: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows by day and drops what is older than `keep_days` before the newest day.

    A batch's rows go to day=<day>/batch=<id>, so a batch that is run again replaces its own. Expired days are dropped as whole folders
    and late rows of such days are not written. At least 30 days are kept.
    """
    if keep_days < 30:
        raise ValueError("at least 30 days must be kept")

    def write(batch: DataFrame, batch_id: int) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = batch.withColumn("__day", F.to_date(day)).where("__day is not null")
        newest = own.agg(F.max("__day").alias("d")).first()["d"]
        there = {datetime.date.fromisoformat(x.getPath().getName()[len("__day=") :]): x.getPath() for x in fs.listStatus(folder)} if fs.exists(folder) else {}
        if newest is None and not there:
            return
        oldest = max([*there, *([newest] if newest else [])]) - datetime.timedelta(days=keep_days)
        rows = own.where(F.col("__day") > F.lit(oldest)).withColumn("__batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__day", "__batch").parquet(path)
        for d, old in there.items():
            if d <= oldest:
                fs.delete(old, True)

    return write


def ordered_sink(spark: SparkSession, path: str, keys: list[str], stamp: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """As upsert_sink, but of each key only rows with a later stamp than the table's are applied, the newest of a batch: an
    arrival out of order is not applied."""
    table = BucketTable(spark, path, keys, buckets)

    def merge(old: DataFrame, change: DataFrame) -> DataFrame:
        newer = apply_if_newer(old, change, keys, stamp)
        return old.join(newer.select(*keys), keys, "left_anti").unionByName(newer)

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        own = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest])
        table.apply(own, batch_id, merge)

    return write


def archive_stream(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run `handle` on every file that has come since the last run, then stop."""
    q = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
