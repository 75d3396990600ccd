import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluate, forecast, stats

CASE = "category string, cohort string, horizon int, origin int, grp string, product long, current double, realized double, predicted double, momentum double, q10 double, q90 double, volatility_bucket string, age_bucket string"


def gate_rows(skill, sets=4, variants=25, origins=5, cohort="standard", spread=0.055):
    r = random.Random(7)
    rows = []
    for o in range(origins):
        market = r.uniform(-0.1, 0.1)
        for s in range(sets):
            for v in range(variants):
                move = r.gauss(0, 0.1)
                current, realized = 10.0, 10 * math.exp(market + move)
                predicted = current * math.exp(market + skill * move)
                rows.append(("c", cohort, 30, o, f"s{s}", 1000 * s + v, current, realized, predicted, current, predicted * math.exp(-spread), predicted * math.exp(spread), "low", "new"))
    return rows


def test_held_out_gate_passes_relative_skill_only(spark):
    one = lambda **k: evaluate.held_out_set_gate(spark.createDataFrame(gate_rows(**k), CASE), min_variants=20).first()
    good = one(skill=0.6)
    assert good["passed"] and good["tier"] == "category-validated" and good["sets"] == 4 and good["blocks"] == 5 and good["lower"] > 0
    # returns against the market are no skill
    assert set(one(skill=-0.1)["reasons"]) >= {"macro_lift_not_positive", "bootstrap_lower_bound_not_positive"}
    assert one(skill=-0.5)["no_harm_share"] == 0.0
    assert "too_few_eligible_sets" in one(skill=0.6, variants=19)["reasons"]
    assert "too_few_scored_blocks" in one(skill=0.6, origins=2)["reasons"]
    assert one(skill=0.6, cohort="low-history")["reasons"] == ["not_the_standard_cohort"]
    # a bucket is tested only with 500 cases
    assert one(skill=0.6, spread=0.001, origins=4)["passed"]
    assert one(skill=0.6, spread=0.001, origins=5)["reasons"] == ["bucket_coverage_outside_range"]


def test_gate_category_needs_both(spark):
    df = spark.createDataFrame(gate_rows(0.6), CASE)
    weights = spark.createDataFrame([("c", 30, 0.0)], "category string, horizon int, a double")
    got = evaluate.gate_category(df, weights, min_variants=20).first()
    assert 0.75 <= got["coverage_80"] <= 0.88 and got["tier"] == "relative-validated"
    assert evaluate.gate_category(df, weights.withColumn("a", F.lit(0.5)), min_variants=20).first()["tier"] == "category-validated"
    assert evaluate.gate_category(spark.createDataFrame(gate_rows(0.6, spread=0.2, origins=4), CASE), weights, min_variants=20).first()["reasons"] == ["coverage_outside_range"]


def test_scorecard_reasons_in_order(spark):
    schema = "n long, lift double, coverage_80 double, brier double, lift_damped_momentum double, lift_market_index double, lift_lifecycle_cohort double, lift_structural_convergence double"
    fine = [40, 0.05, 0.8, 0.2, 0.05, 0.05, 0.05, 0.05]

    def one(**changed):
        names = [x.split()[0] for x in schema.split(", ")]
        row = evaluate.scorecard_gate(spark.createDataFrame([tuple({**dict(zip(names, fine, strict=True)), **changed}.values())], schema)).first()
        return row["recommendation"], row["reasons"]

    assert one() == ("eligible_for_operator_review", [])
    assert one(n=29, lift=0.01) == ("insufficient", ["insufficient_evaluation_cases", "baseline_lift_below_threshold"])
    assert one(lift_market_index=0.019) == ("reject", ["challenger_baseline_lift_below_threshold"])
    assert one(lift_market_index=None) == ("insufficient", ["missing_required_baselines"])
    assert one(lift=None, coverage_80=None, brier=None) == ("insufficient", ["missing_required_baselines", "missing_baseline_comparison", "missing_interval_coverage", "missing_probability_score"])
    assert one(coverage_80=0.89, brier=0.26) == ("reject", ["interval_coverage_outside_band", "brier_score_above_threshold"])
    # without a column for a required baseline it is missing
    assert evaluate.scorecard_gate(spark.createDataFrame([(40, 0.05, 0.8, 0.2)], "n long, lift double, coverage_80 double, brier double")).first()["reasons"] == ["missing_required_baselines"]


def test_membership_adds_up(spark):
    rows = [("research_only", "scored"), ("research_only", "unscorable"), ("quarantined", "scored"), ("quarantined", "unscorable")]
    members = evaluate.scorecard_membership(spark.createDataFrame(rows, "prediction_status string, evaluation_status string"))
    got = evaluate.membership_counts(members, []).first()
    assert (got["matured"], got["included"], got["excluded"], got["unscorable"], got["adds_up"]) == (4, 1, 2, 1, True)
    odd = spark.createDataFrame([*rows, ("research_only", "new")], "prediction_status string, evaluation_status string")
    assert not evaluate.membership_counts(evaluate.scorecard_membership(odd), []).first()["adds_up"]


def test_component_weights_use_earlier_standard_cases(spark):
    schema = "category string, horizon int, origin int, cohort string, steps int, anchor double, index_delta double, reversion double, drift double, actual double"
    r = random.Random(1)
    rows = []
    for o in range(15):
        for cohort in ("standard", "low-history"):
            i, c, b = r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)
            truth = (0.5, 0.25, -0.25) if o < 9 and cohort == "standard" else (1.0, 0.0, 0.25)
            rows.append(("x", 30, o, cohort, 4, 2.0, i, c, b, 2.0 + truth[0] * i + truth[1] * c + truth[2] * b * 4))
    got = evaluate.component_weights(spark.createDataFrame(rows, schema)).first()
    assert (got["a"], got["c"], got["b"], got["n"]) == (0.5, 0.25, -0.25, 9) and got["lift"] > 0
    none = evaluate.component_weights(spark.createDataFrame(rows, schema).where("cohort <> 'standard'")).first()
    assert (none["a"], none["c"], none["b"], none["lift"], none["n"]) == (1.0, 0.0, 1.0, None, 0)


def test_serving_rules(spark):
    schema = "category string, product long, confidence string, kind string, saturated boolean, price double, horizon int, q50 double"
    rows = [
        ("c", 1, "standard", "single", False, 10.0, 30, 12.0),
        ("c", 2, "standard", "sealed", False, 10.0, 30, 12.0),
        ("c", 3, "standard", None, False, 10.0, 30, 12.0),
        ("c", 4, "standard", "single", True, 10.0, 30, 12.0),
        ("c", 5, "low-history", "single", False, 10.0, 30, 12.0),
        ("c", 6, "insufficient-history", "single", False, 10.0, 30, 12.0),
        ("c", 7, "standard", "sealed", False, 7.0, 30, 12.0),
        ("c", 8, "cold-start", "single", False, None, 30, 12.0),
    ]
    eligible = spark.createDataFrame([("c", "standard", 30, "category-validated"), ("c", "low-history", 30, "category-validated"), ("c", "cold-start", 30, "category-validated")], "category string, confidence string, horizon int, tier string")
    listed = spark.createDataFrame([(2, 10.0, True), (7, 10.0, True)], "product long, list_price double, in_print boolean")
    served = forecast.serve_tiers(spark.createDataFrame(rows, schema), eligible, listed)
    got = {x["product"]: (x["served"], x["withheld"], x["downgraded"]) for x in served.collect()}
    assert got == {
        1: ("category-validated", None, False),
        2: ("range-only", None, True),
        3: ("range-only", None, True),
        4: (None, "anchor_clamp_saturated", False),
        5: ("range-only", None, False),
        6: (None, "no_eligible_cohort", False),
        7: (None, "below_list_price_floor", True),
        8: ("attribute-reference", None, False),
    }
    counts = {x["name"]: x["n"] for x in forecast.serve_counters(served, []).collect()}
    assert counts["downgraded:sealed"] == 2 and counts["downgraded:unknown"] == 1 and counts["withheld:no_eligible_cohort"] == 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantile_of_large_equals_numpy(spark, keys):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0.0, 0.0, 1.5, r.gauss(0, 1), r.lognormvariate(0, 4), -r.lognormvariate(0, 4)])) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"] if keys else 0: (x["q1"], x["q5"], x["q9"]) for x in stats.quantile_of_large(df, keys, "v", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, steps=2).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k if keys else 0, []).append(v)
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert np.allclose(got[k], np.quantile(values, [0.1, 0.5, 0.9]), rtol=1e-12, atol=1e-15)
