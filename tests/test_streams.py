import datetime as dt
import glob
import os

import pytest

from marketloom.operators import demand, pit
from marketloom.sources.tables import BucketTable, replace_rows
from marketloom.streaming import streams


def ledger(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, v, k, start + dt.timedelta(hours=6 * i + u, minutes=7 * v)) for i in range(100) for u in range(3) for v in range(2) for k in ("card_view", "watch_add")]
    return spark.createDataFrame(rows, "user long, variant long, kind string, at timestamp")


def run(spark, frame, path, build, mode="append"):
    frame.repartition(1).write.mode("overwrite").parquet(f"{path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{path}/in")
    name = "out_" + str(abs(hash(path)))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_weekly_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    e = ledger(spark)
    got = streams.weekly_counts(run(spark, e, str(tmp_path), streams.weekly_user_demand, "complete"), threshold=2)
    want = demand.demand_aggregate(e, e.limit(0).select("user"), F.to_date(F.date_trunc("week", "at")), 2)
    cols = ["variant", "period", "views", "watch_adds", "unique_users", "privacy_threshold_met"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_hourly_dedupe(spark, tmp_path):
    e = ledger(spark)
    assert run(spark, e.union(e), str(tmp_path), streams.dedupe_demand).count() == e.count()


def test_eligible(spark, tmp_path):
    e = ledger(spark)
    out = run(spark, e, str(tmp_path), lambda s: streams.eligible_demand(s, spark.createDataFrame([(1,)], "user long")))
    assert {r["user"] for r in out.select("user").distinct().collect()} == {0, 2}


def test_first_seen(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))]
    out = run(spark, spark.createDataFrame(rows, "id long, available_at timestamp"), str(tmp_path), streams.first_seen_stream)
    assert sorted(r["id"] for r in out.collect()) == [1, 2]


def test_outlier_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [(s, dt.datetime(2024, 1, d), dt.datetime(2024, 1, d), 500.0 if d in (9, 20) else 10.0 + (d * s) % 3, 100 * s + d) for s in (1, 2) for d in range(1, 25)]
    obs = spark.createDataFrame(rows, "series long, observed_at timestamp, available_at timestamp, price double, id long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(spark, obs, str(tmp_path), streams.outlier_stream)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = pit.outlier_status_sequential(obs)
    assert {(r["id"], r["status"]) for r in got.collect()} == {(r["id"], r["status"]) for r in want.select("id", "status").collect()}


WATCH = "key long, at timestamp, price double, currency string, stale boolean, trend string, position string, signature string, fingerprint string, target double, target_currency string, percent double, on_trend boolean, on_range boolean, on_forecast boolean"


def watch_rows():
    at = lambda d: dt.datetime(2024, 1, d)
    row = lambda d, price, unit="USD", stale=False, trend="up", position="within", signature="s", finger=None: (1, at(d), price, unit, stale, trend, position, signature, finger or f"f{d}", 9.0, "USD", 10.0, True, True, False)
    return [
        row(1, None),
        row(2, 10.0),
        row(3, 10.5),
        row(4, 8.9),  # reaches the target from above, and moves by 10 %
        row(5, 8.0, finger="f4"),  # the same publication
        row(6, 20.0, "EUR"),  # not comparable
        row(7, None, "EUR"),
        row(8, None, "EUR", stale=True, trend="down", position="above", signature="t"),
    ]


WATCH_ALERTS = [(2, "new_catalog_price"), (4, "target_price"), (4, "percent_change"), (7, "became_unpriced"), (8, "price_stale"), (8, "range_change"), (8, "trend_change")]


def test_alert_stream(spark, tmp_path):
    frame = spark.createDataFrame(watch_rows(), WATCH)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(spark, frame, str(tmp_path), streams.alert_stream)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["at"].day, r["alert"]) for r in got.collect()) == sorted(WATCH_ALERTS)


def test_alerts_of_a_batch_agree_with_the_stream(spark):
    from marketloom.operators import portfolio

    rows, got = watch_rows(), []
    for now, last in zip(rows[1:], rows, strict=False):
        frame = spark.createDataFrame([now], WATCH)
        base = spark.createDataFrame([last], WATCH).select("key", *streams.BASELINE)
        got += [(now[1].day, r["alert"]) for r in portfolio.alerts(frame, base).collect()]
    assert got and sorted(got) == sorted(WATCH_ALERTS)


def test_upsert_sink_replaces_rows_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    write = streams.upsert_sink(spark, path, ["k"])
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    write(frame((1, "a"), (2, "b")), 0)
    for _ in range(2):
        write(frame((2, "c")), 1)
    assert {(r["k"], r["v"]) for r in BucketTable(spark, path, ["k"]).read().collect()} == {(1, "a"), (2, "c")}


def test_bucket_table_writes_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], buckets=16)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/*/*/*.parquet")}
    want = {i: "old" for i in range(500)}
    table.apply(spark.createDataFrame(list(want.items()), "k long, v string"), 0, replace_rows(["k"]))
    first = files()
    for version, keys in ((1, [3, 4]), (2, [5]), (2, [5]), (4, [3, 900])):  # version 2 twice, version 3 never came
        assert table.apply(spark.createDataFrame([(k, f"v{version}") for k in keys], "k long, v string"), version, replace_rows(["k"])) <= 2
        want |= {k: f"v{version}" for k in keys}
        assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.read().count() == len(want)
        assert table.versions()[-1] == version and len(table.versions()) <= 2
    assert len(files()) <= len(first) + 4 and len(set(files()) & set(first)) >= 10  # most buckets were never written again
    before = table.read(table.versions()[-2])
    assert before.count() == 500  # the version before can still be read
    table.apply(spark.createDataFrame([], "k long, v string"), 5, replace_rows(["k"]))
    assert table.read().count() == len(want)
    table.apply(spark.createDataFrame([(7, "x")], "k long, v string"), 6, lambda old, change: old.where("k > 1000"))
    assert table.read().where("k = 7").count() == 0
    assert BucketTable(spark, str(tmp_path / "none"), ["k"]).read(schema="k long").count() == 0


def test_archive_stream_handles_new_files_once(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        streams.archive_stream(spark, str(tmp_path / "in"), "id long", lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == 3


def test_first_seen_never_forgets(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1))], [(2, dt.datetime(2024, 6, 1))], [(1, dt.datetime(2025, 1, 1)), (3, dt.datetime(2025, 1, 1))]
    for part in rows:
        spark.createDataFrame(part, "id long, available_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.first_seen_stream(spark.readStream.schema("id long, available_at timestamp").parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_retention_drops_whole_days_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    write = streams.retention_sink(spark, path, "at", 30)
    frame = lambda *days: spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), d) for d in days], "at timestamp, k int")
    kept = lambda: sorted(r["k"] for r in spark.read.parquet(path).collect())
    write(frame(0, 1, 29), 0)
    write(frame(0, 1, 29), 0)
    assert kept() == [0, 1, 29]
    write(frame(31, 40, 2), 1)  # day 2 is too old by now
    assert kept() == [29, 31, 40]
    write(frame().where("false"), 2)
    assert kept() == [29, 31, 40]
    with pytest.raises(ValueError, match="30 days"):
        streams.retention_sink(spark, path, "at", 7)


def test_ordered_sink_does_not_apply_older_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    write = streams.ordered_sink(spark, path, ["k"], "stamp")
    frame = lambda *r: spark.createDataFrame(list(r), "k long, stamp int, v string")
    write(frame((1, 5, "a"), (1, 7, "b"), (2, 1, "c")), 0)
    for _ in range(2):
        write(frame((1, 6, "old"), (2, 3, "d"), (3, 1, "e")), 1)
    assert {(r["k"], r["v"]) for r in BucketTable(spark, path, ["k"]).read().collect()} == {(1, "b"), (2, "d"), (3, "e")}


def test_sliding_velocity_counts_users_exactly(spark, tmp_path):
    e = ledger(spark)
    got = {(r["until"], r["variant"]): (r["events"], r["users"]) for r in streams.sliding_velocity(run(spark, e, str(tmp_path), streams.sliding_user_events, "complete")).collect()}
    want = {}
    for r in e.collect():
        for d in range(1, 8):
            want.setdefault(((r["at"] + dt.timedelta(days=d)).date(), r["variant"]), []).append(r["user"])
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
