import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluate, forecast, lab, walks

OBS = "series long, observed_at timestamp, available_at timestamp, price double, quality double, id long"
START = datetime.datetime(2024, 1, 1)


def parts_by_hand(origins, embargo, share=0.25, k=3):
    origins = sorted(origins)
    n = len(origins)
    if n < k:
        return dict.fromkeys(origins, "train")
    hold = min(max(1, int(n * share)), max(1, (n - 1) // (k - 1)))
    first = n - hold * (k - 1)
    blocks = [origins[:first], *[origins[first + i * hold : first + (i + 1) * hold] for i in range(k - 1)]]
    out = {}
    for i, block in enumerate(blocks):
        for o in block:
            near = i < k - 1 and o >= blocks[i + 1][0] - embargo
            out[o] = "embargo" if near and embargo else ("train", "validate", "calibrate")[i]
    return out


@pytest.mark.parametrize("embargo", [0, 3, 9])
def test_origin_parts_equal_the_definition(spark, embargo):
    r = random.Random(embargo)
    rows, want = [], {}
    for g in range(14):
        origins = sorted(r.sample(range(60), g))
        own = parts_by_hand(origins, embargo)
        for o in origins:
            rows += [(g, o, i) for i in range(r.randint(1, 3))]
            want[g, o] = own[o]
    got = forecast.origin_parts(spark.createDataFrame(rows, "g int, o int, i int"), ["g"], "o", embargo).collect()
    assert len(got) == len(rows) and {(x["g"], x["o"]): x["part"] for x in got} == want
    # a label of one part never matures inside the next
    for g in range(14):
        day = {p: [o for (h, o), q in want.items() if h == g and q == p] for p in ("train", "validate", "calibrate")}
        for a, z in (("train", "validate"), ("validate", "calibrate")):
            if embargo and day[a] and day[z]:
                assert max(day[a]) + embargo < min(day[z])


def observations(spark, series, days, flat=()):
    r = random.Random(3)
    rows = []
    for s in range(series):
        y, slope = math.log(r.uniform(5, 50)), r.gauss(0, 0.01)
        for d in range(days):
            y += slope + r.gauss(0, 0.02)
            at = START + datetime.timedelta(days=d)
            rows.append((s, at, at + datetime.timedelta(hours=1), 7.0 if s in flat else math.exp(y), 0.9, s * 1000 + d))
    return spark.createDataFrame(rows, OBS)


def origins(spark, days):
    return spark.createDataFrame([(START + datetime.timedelta(days=d),) for d in days], "origin timestamp")


def test_retrospective_partition_and_baselines(spark):
    obs = observations(spark, 12, 60, flat=(3,)).where("not (series = 5 and observed_at > timestamp'2024-01-22')")
    members = spark.createDataFrame([(s, f"c{s % 3}") for s in range(12)], "series long, cohort string")
    walk = {x["horizon"]: x for x in walks.retrospective_walk_forward(obs, origins(spark, (20, 27, 34)), ["series"], (7, 14, 90), F.lit("2024-02-20").cast("date"), members).collect()}
    assert set(walk) == {7, 14}  # nothing of 90 days has matured
    for x in walk.values():
        assert x["matured"] == 36 and x["adds_up"] and x["excluded"] == 3  # the flat series has no volatility
        assert x["unscorable"] >= 2 and x["included"] == x["n"] == 36 - x["excluded"] - x["unscorable"]
        assert x["lift_no_change"] == pytest.approx(x["lift"]) and x["lift_damped_momentum"] == pytest.approx(0.0)
        assert all(x[f"{k}_{b}"] is not None for k in ("lift", "lower") for b in evaluate.REQUIRED_BASELINES)
        assert x["brier"] != 0.25 and x["series"] in (10, 11) and x["cohorts"] == 3 and x["origins"] == 3 and x["spaced_origins"] == 1
    alone = {x["horizon"]: x for x in walks.retrospective_walk_forward(obs, origins(spark, (20,)), ["series"], (7,), F.lit("2024-02-20").cast("date")).collect()}
    assert alone[7]["lift_lifecycle_cohort"] is None and "missing_required_baselines" in alone[7]["reasons"] and alone[7]["recommendation"] == "insufficient"
    assert alone[7]["lower_no_change"] is None  # one origin cannot be resampled


def test_no_included_cases_is_insufficient(spark):
    obs = observations(spark, 2, 40, flat=(0, 1))
    x = walks.retrospective_walk_forward(obs, origins(spark, (20,)), ["series"], (7,), F.lit("2024-02-20").cast("date")).collect()
    assert len(x) == 1 and x[0]["n"] == 0 and x[0]["excluded"] == 2 and x[0]["recommendation"] == "insufficient"
    assert walks.retrospective_walk_forward(obs.where("false"), origins(spark, (20,)), ["series"], (7,), F.lit("2024-02-20").cast("date")).count() == 0


def test_shadow_report(spark):
    obs = observations(spark, 14, 70)
    from marketloom.operators import lab

    snaps = lab.trend_snapshot(obs, origins(spark, range(10, 60, 4)), ["series"])
    due = snaps.select("series", F.date_add(F.to_date("origin"), 3).alias("matures")).distinct()
    cells = lab.forecast_cells(snaps, evaluate.realized_price(obs, due, ["series"]), ["series"], (3,), F.lit("2024-03-10").cast("date"))
    members = spark.createDataFrame([(s, f"c{s % 2}") for s in range(14)], "series long, cohort string")
    x = walks.shadow_walk_forward(cells, ["series"], members, least_quality=0.1).first()
    assert x["forecasts"] == 14 * 13 and x["n"] == x["forecasts"] - x["quarantined"] > 0 and x["cohorts"] == 2
    assert {"insufficient_set_breadth", "missing_after_cost_evidence", "insufficient_selected_pocket_cases"} <= set(x["reasons"]) and x["recommendation"] == "insufficient"
    costs = cells.select("series", "origin", "horizon", (F.col("current_price") * 0.7).alias("price"), F.lit(0.0).alias("tax"), F.lit(0.0).alias("shipping"), F.lit(0.0).alias("fee_rate"), F.lit(0.0).alias("exit_fixed"))
    small = walks.ShadowPolicy(cases=5, series=5, cohorts=2, spaced_origins=1, calibration_cases=5, cost_cases=5, pocket_cases=5)
    y = walks.shadow_walk_forward(cells, ["series"], members, costs, policy=small, least_quality=0.1).first()
    assert y["cost_cases"] == y["n"] and y["pocket_cases"] > 0 and y["pocket_positive"] > 0.9 and "missing_after_cost_evidence" not in y["reasons"]


def test_a_price_of_zero_is_minus_infinity_and_no_error(spark):
    prices = [10.0, 0.0, 12.0, 11.0, 13.0, 12.0, 14.0, 0.0]
    rows = [(1, START + datetime.timedelta(days=d), START + datetime.timedelta(days=d), p, 0.9, d) for d, p in enumerate(prices)] + [(1, START + datetime.timedelta(days=9), START + datetime.timedelta(days=9), 5.0, 0.9, 9)]
    obs, at = spark.createDataFrame(rows, OBS), START + datetime.timedelta(days=7)
    snaps = lab.trend_snapshot(obs, spark.createDataFrame([(at,)], "origin timestamp"), ["series"])
    s = snaps.first()
    y = [math.log(p) if p else -math.inf for p in prices]
    slopes = sorted(x for x in ((y[j] - y[i]) / (j - i) for i in range(8) for j in range(i + 1, 8)) if not math.isnan(x))
    assert len(slopes) == 27 and s["slope_90d"] == pytest.approx((slopes[13] + slopes[14]) / 2) and s["max_drawdown_180d"] == 1.0  # the NaN comes last
    real = evaluate.realized_price(obs, spark.createDataFrame([(1, (at + datetime.timedelta(days=2)).date())], "series long, matures date"), ["series"], 1)
    cell = lab.forecast_cells(snaps, real, ["series"], [2], F.lit("2024-02-01").cast("date")).first()
    assert cell["cell"] == "scored" and cell["realized_return"] == math.inf
    case = spark.createDataFrame([("a", 0.0, 0.0, 5.0), ("a", 5.0, 5.0, 5.0)], "origin string, predicted double, x double, realized double")
    assert walks.lifts(case, ["origin"], ["x"], "s", 2, 0.9).count() == 1
    base = {r["baseline"]: r for r in forecast.baselines(spark.createDataFrame([(1, 0.0, 0.1, 0.0, 0.0, 0.0)], "id long, price double, slope double, market_slope double, cohort double, structural double"), ["id"], 7).collect()}
    assert base["structural_convergence"]["log_return"] == 0.0 and base["structural_convergence"]["price"] == 0.0
