import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof, evaluate, forecast, market, merge, pit, portfolio, regress, stats, windows
from marketloom.operators.index import index_levels


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_revisions_are_chosen_before_status(spark):
    rows = [(1, ts("2024-01-01"), ts("2024-01-02"), 10.0, 1, "accepted"), (1, ts("2024-01-01"), ts("2024-01-03"), 99.0, 2, "quarantined")]
    obs = spark.createDataFrame(rows, "series long, observed_at timestamp, available_at timestamp, price double, id long, status string")
    at = lambda d: F.lit(d).cast("timestamp")
    assert [r["id"] for r in pit.point_in_time(obs, at("2024-01-02"))  .collect()] == [1]
    assert [r["id"] for r in pit.point_in_time(obs, at("2024-01-04")).collect()] == [2]
    assert pit.point_in_time_all_status(obs, at("2024-01-04")).count() == 0


def test_outlier_gate_does_not_learn_from_outliers(spark):
    rows = [(1, ts(f"2024-01-{d:02d}"), ts(f"2024-01-{d:02d}"), 1000.0 if d > 9 else 10.0 + d % 2, d) for d in range(1, 13)]
    obs = spark.createDataFrame(rows, "series long, observed_at timestamp, available_at timestamp, price double, id long")
    got = {r["id"]: r["status"] for r in pit.outlier_status_sequential(obs).collect()}
    assert [got[d] for d in (9, 10, 11, 12)] == ["accepted", "outlier", "outlier", "outlier"]


def test_market_metrics_by_hand(spark):
    day = dt.date(2024, 6, 30)
    rows = [("a", day - dt.timedelta(days=7), 10.0), ("a", day, 12.0), ("b", day, 0.0), ("c", day - dt.timedelta(days=1), 5.0)]
    m = {r["k"]: r for r in market.market_metrics(spark.createDataFrame(rows, "k string, day date, price double"), day, ["k"]).collect()}
    assert set(m) == {"a", "b"}
    assert m["a"]["return_7d"] == pytest.approx(0.2) and m["a"]["return_30d"] is None and m["a"]["observation_count"] == 2
    assert m["b"]["current_price"] is None and m["b"]["observation_count"] == 0


def test_bands_do_not_cross(spark):
    rows = [("a", 10.0, 200, 0.001, 0.02, 0.9), ("b", 10.0, 13, 0.001, 0.02, 0.9)]
    m = spark.createDataFrame(rows, "k string, current_price double, observation_count long, daily_log_slope_30d double, volatility_30d double, history_density_365d double")
    found = market.shadow_bands(m, ["k"]).collect()
    assert len(found) == 4 and all(r["q10"] < r["q25"] < r["q50"] < r["q75"] < r["q90"] for r in found)


def test_theil_sen_resists_an_outlier(spark):
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), math.exp(0.01 * i) * (50 if i == 5 else 1)) for i in range(20)]
    slope = stats.theil_sen_slope(spark.createDataFrame(rows, "k string, day date, price double"), ["k"]).first()["slope"]
    assert slope == pytest.approx(0.01, abs=1e-3)


def test_leave_one_out(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([1, 2, 3, 10])], "g string, id long, v double")
    got = {r["id"]: r["others"] for r in stats.leave_one_out_quantile(df, ["g"], "id", "v", 0.5).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 2.0, 3: 2.0}


def test_index_of_two_dates(spark):
    rows = [("c", "g", p, t, 10.0 * (1.1 if t else 1.0)) for p in (1, 2, 3) for t in (0, 1)]
    idx = {(r["level"], r["t"]): r["idx"] for r in index_levels(spark.createDataFrame(rows, "category string, grp string, product long, t int, price double"), ["category", "grp", "product"]).collect()}
    assert idx["market", 1] == pytest.approx(math.log(1.1)) and idx["category", 1] == pytest.approx(0.0) and idx["group", 0] == 0.0


def test_damped_trend_by_hand(spark):
    rows = [("k", t, y) for t, y in enumerate([1.0, 2.0, 2.5])]
    got = forecast.damped_trend(spark.createDataFrame(rows, "k string, t int, y double"), ["k"], "t", "y").orderBy("t").collect()
    level, trend = 0.3 * 2.0 + 0.7 * (1.0 + 0.85 * 1.0), None
    trend = 0.1 * (level - 1.0) + 0.9 * 0.85 * 1.0
    assert (got[0]["level"], got[0]["trend"]) == (1.0, 1.0)
    assert got[1]["level"] == pytest.approx(level) and got[1]["trend"] == pytest.approx(trend)


def test_conformal_middle_is_zero(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)], "k string, standardized double")
    r = forecast.conformal_offsets(df, ["k"]).first()
    assert r["q50"] == 0.0 and r["q10"] == 0.0 and r["q90"] > r["q75"] > 0


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 1, 10)), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2023, 12, 1))], "k string, day date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5.0)], "k string, day date, price double")
    got = {r["day"].isoformat(): r["price"] for r in asof.asof_backward(left, right, ["k"], "day", "price", 3).collect()}
    assert got == {"2024-01-10": None, "2024-01-02": 5.0, "2023-12-01": None}


def test_upsert_moves_changed_on_only_on_change(spark):
    d0, d1 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    cur = spark.createDataFrame([(1, "a", d0, d0), (2, None, d0, d0), (3, "c", d0, d0)], "k long, v string, first_seen date, changed_on date")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, v string")
    got = {r["k"]: (r["v"], r["first_seen"], r["changed_on"], r["action"]) for r in merge.upsert_changed(cur, batch, ["k"], ["v"], F.lit(d1)).collect()}
    assert got == {1: ("a", d0, d0, "same"), 2: ("b", d0, d1, "update"), 3: ("c", d0, d0, "keep"), 4: ("d", d1, d1, "insert")}


def test_tombstone_wins_a_tie(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 9)], "k long, v string, stamp int")
    dead = spark.createDataFrame([(1, 5), (2, 8)], "k long, deleted_at int")
    assert [r["k"] for r in merge.lww_merge(a, a.limit(0), dead, "k", "stamp").collect()] == [2]


def test_no_currency_is_guessed(spark):
    h = spark.createDataFrame([("o", 1, 2.0, 10.0, 1.0, 15.0, "USD", "USD"), ("o", 2, 1.0, 5.0, 0.0, 9.0, "EUR", "USD")], "owner string, id long, quantity double, purchase_price double, fees double, market_price double, currency string, cost_currency string")
    r = portfolio.portfolio_summary(h, ["owner"], "USD").first()
    assert (r["market_value"], r["cost_basis"], r["gain"], r["excluded_market_items"]) == (30.0, 26.0, 9.0, 1)


def test_spaced_origins_are_greedy(spark):
    df = spark.createDataFrame([("k", dt.date(2024, 1, d)) for d in (1, 3, 6, 8, 20)], "k string, day date")
    assert sorted(r["day"].day for r in windows.spaced_origins(df, ["k"], "day", 5).collect()) == [1, 6, 20]


def test_regression_residuals_are_orthogonal(spark):
    rows = [("a", float(i % 7), float(i % 5), 3.0 + 2.0 * (i % 7) - (i % 5) + 0.1 * math.sin(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, x1 double, x2 double, y double")
    beta = regress.coefficients(stats.gram_matrix(df, ["k"], ["x1", "x2"], "y"), ["k"], 3)
    e = F.col("y") - regress.predicted(["x1", "x2"])
    r = df.join(beta, "k").agg(F.sum(e).alias("a"), F.sum(e * F.col("x1")).alias("b"), F.sum(e * F.col("x2")).alias("c")).first()
    assert max(abs(x) for x in r) < 1e-2


def test_bootstrap_is_reproducible(spark):
    rows = [(o, 10.0 + o, 10.0 + o + 0.1 * (o % 3), 11.0 + o) for o in range(12)]
    c = spark.createDataFrame(rows, "origin int, realized double, predicted double, naive double")
    a, b = (evaluate.cluster_bootstrap(c, ["naive"], "origin", "seed", 50).first()["lower"] for _ in range(2))
    assert a == b and 0 < a < 1


def test_wrong_retention_is_refused(spark):
    with pytest.raises(ValueError):
        merge.prune(spark.range(1), "id", F.current_date(), 7)


def brute_gate(rows, sequential, days=90, least=7):
    """Status by id of (series, observed, available, price, id) rows, one at a time, by the rule's words."""
    import statistics

    status = {}
    for s, o, a, price, i in sorted(rows, key=lambda r: (r[2], r[1], r[4])):
        newest = {}
        for t, p, q, x, k in sorted(rows, key=lambda r: (r[2], r[4])):
            if t == s and p < o and p >= o - dt.timedelta(days=days) and q <= a and (not sequential or status.get(k) == "accepted"):
                newest[p] = math.log(x)
        past, out = list(newest.values()), False
        if len(past) >= least:
            centre = statistics.median(past)
            mad = statistics.median(abs(x - centre) for x in past)
            off = abs(math.log(price) - centre)
            out = off > math.log(3) if mad == 0 else off / (1.4826 * mad) > 8
        status[i] = "outlier" if out else "accepted"
    return status


@pytest.mark.parametrize("gate, sequential", [(pit.outlier_status, False), (pit.outlier_status_sequential, True)])
def test_outlier_gate_with_revisions_and_late_points(spark, gate, sequential):
    r = random.Random(3)
    rows = []
    for i in range(400):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(150))
        price = 500.0 if r.random() < 0.1 else 10.0 + r.choice([0, 0, 0.5, 1])
        rows.append((i % 3, day, day + dt.timedelta(days=r.choice([0, 0, 1, 20])), price, i))
    obs = spark.createDataFrame(rows, "series long, observed_at timestamp, available_at timestamp, price double, id long")
    want = brute_gate(rows, sequential)
    assert "outlier" in want.values()
    assert {x["id"]: x["status"] for x in gate(obs).select("id", "status").collect()} == want


def test_quantiles_of_large_below_zero_and_infinite(spark):
    r = random.Random(5)
    values = [-(10 ** r.uniform(0, 4)) for _ in range(4000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", -math.inf), ("b", 1.0), ("b", 2.0), ("c", -math.inf), ("c", -math.inf)], "k string, v double")
    got = {x["k"]: x for x in stats.quantile_of_large(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    values.sort()
    at = lambda p: values[int(p * 3999)] + (values[int(p * 3999) + 1] - values[int(p * 3999)]) * (p * 3999 - int(p * 3999))
    assert got["a"]["lo"] == pytest.approx(at(0.1), rel=1e-12) and got["a"]["mid"] == pytest.approx(at(0.5), rel=1e-12)
    assert (got["b"]["lo"], got["b"]["mid"], got["c"]["mid"]) == (-math.inf, 1.0, -math.inf)


def test_median_slope_in_bounded_memory_equals_all_pairs():
    r = random.Random(2)
    for n in (2, 3, 40, 90):
        t, y = np.array(sorted(r.sample(range(1000), n))) / 24, np.array([-math.inf if k % 17 == 16 else math.log(r.uniform(1, 50)) for k in range(n)])
        with np.errstate(invalid="ignore"):
            every = np.sort([(y[j] - y[i]) / (t[j] - t[i]) for i in range(n) for j in range(i + 1, n)])
        m = len(every)
        want = (every[(m - 1) // 2] + every[m // 2]) / 2
        assert stats.median_slope(t, y) == want and stats.median_slope(t, y, 50) == want
    assert stats.median_slope(t[:1], y[:1]) is None


def test_gate_reads_a_window_not_all_points():
    r, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(pd.Timestamp(start + dt.timedelta(hours=r.randrange(720))), k) for k in range(1500)]
    points = pd.DataFrame([(o, o + pd.Timedelta(hours=k % 5), k, 10 * math.exp(r.gauss(0, 0.3))) for o, k in rows], columns=["observed_at", "available_at", "id", "price"]).sort_values(["available_at", "observed_at", "id"])
    span = pd.Timedelta(days=1)
    status, accepted = pit.gate(points, [], 7, 2.0, 1.1, 1)
    want, known = [], []
    for o, a, i, price in zip(points["observed_at"], points["available_at"], points["id"], points["price"], strict=True):
        past = np.array(list({p[0]: p[3] for p in sorted(p for p in known if o - span <= p[0] < o and p[1] <= a)}.values()))
        c = np.median(past) if len(past) else 0.0
        m = np.median(np.abs(past - c)) if len(past) else 0.0
        off = abs(math.log(price) - c)
        out = len(past) >= 7 and (off > 1.1 if m == 0 else off / (1.4826 * m) > 2.0)
        want.append("outlier" if out else "accepted")
        known += [] if out else [(o, a, i, math.log(price))]
    assert status == want and 10 < want.count("outlier") < 1000
    # in two batches as in one, the later of which has late points
    first, held = pit.gate(points[:700], [], 7, 2.0, 1.1, 1)
    assert first + pit.gate(points[700:], held, 7, 2.0, 1.1, 1)[0] == want
