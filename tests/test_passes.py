"""How often an operator reads what it is given."""

import numpy as np
from pyspark.sql import functions as F
from test_gates import CASE, gate_rows

from marketloom.functions.scalars import fold_of
from marketloom.operators import evaluate, lab, stats


def counted(spark, df):
    """df, and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema), made


def test_gates_read_their_cases_once(spark):
    rows = gate_rows(0.6)
    df, made = counted(spark, spark.createDataFrame(rows, CASE))
    assert evaluate.held_out_set_gate(df, min_variants=20).first()["passed"]
    assert made.value == len(rows)
    df, made = counted(spark, spark.createDataFrame(rows, CASE))
    weights = spark.createDataFrame([("c", 30, 0.0)], "category string, horizon int, a double")
    assert evaluate.gate_category(df, weights, min_variants=20).first()["tier"] == "relative-validated"
    assert made.value == len(rows)


def test_quantiles_of_few_groups_are_exact_for_any_steps(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 2 else g, float(v)) for g in range(3) for v in np.concatenate([rng.normal(0, 0.3, 400), np.full(30 * g, 0.1)])]
    df = spark.createDataFrame([*rows, (0, None), (0, float("nan"))], "g int, v double")
    for steps in (1, 64):
        got = {r["g"]: (r["q10"], r["q50"]) for r in stats.quantile_of_large(df, ["g"], "v", {"q10": 0.1, "q50": 0.5}, steps, few=True).collect()}
        for g in (0, 1, None):
            assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.1, 0.5]), atol=1e-12)


def test_structural_gap_reads_its_rows_once(spark):
    df, made = counted(spark, spark.range(500).select("id", (F.col("id") % 23).cast("string").alias("grp"), (F.col("id") % 50).cast("double").alias("x"), F.log(F.col("id") + 1.0).alias("y")))
    assert lab.structural_gap(df, "grp", ["x"], "y").count() == 500
    assert made.value == 500


def test_fold_is_the_whole_hash_modulo_folds(spark):
    import hashlib

    for folds in (2, 5, 97, 2_000_000_011):
        for r in spark.range(40).select("id", fold_of(F.col("id"), folds).alias("fold")).collect():
            assert r["fold"] == int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16) % folds


def test_slopes_of_both_windows_are_taken_once_where_they_are_the_same(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    sizes, calls = (0, 1, 2, 7, 256, 257, 400), []
    t = [np.sort(rng.uniform(0, 90, n)) for n in sizes]
    y = [rng.normal(0, 1, n) for n in sizes]
    y[3][2] = -np.inf
    one, slow = stats.median_slope, lambda a, b: np.median([(b[j] - b[i]) / (a[j] - a[i]) for i in range(len(a)) for j in range(i + 1, len(a))]) if len(a) > 1 else None
    monkeypatch.setattr(stats, "median_slope", lambda a, b: calls.append(len(a)) or one(a, b))
    got = stats.median_slopes_of_both.func(pd.Series(t), pd.Series(y), pd.Series([n if n < 100 else n - 50 for n in sizes]))
    assert calls == [0, 1, 2, 7, 256, 206, 257, 207, 400, 350]
    for k, n in enumerate(sizes):
        for name, m in (("whole", n), ("short", n if n < 100 else n - 50)):
            want = slow(t[k][n - m :], y[k][n - m :])
            assert pd.isna(got[name][k]) if want is None else np.isclose(got[name][k], want, atol=1e-12)


def test_expanding_mad_reads_its_points_once_and_ranks_no_whole_group(spark):
    from marketloom.operators import windows

    rng = np.random.default_rng(9)
    rows = [("a" if i % 3 else None, int(i % 30), None if i % 97 == 0 else float(rng.lognormal(3, 1))) for i in range(3000)]
    df, made = counted(spark, spark.createDataFrame(rows, "k string, t int, v double"))
    origins = spark.createDataFrame([(8,), (16,)], "origin int")
    found = windows.expanding_mad(df, origins, ["k"], "t", "v")
    got = {(r["k"], r["origin"]): r["mad"] for r in found.collect()}
    assert made.value == len(rows) and len(got) == 4
    for (k, o), mad in got.items():
        own = np.array([v for kk, t, v in rows if kk == k and t <= o and v is not None])
        assert np.isclose(mad, np.median(np.abs(own - np.median(own))), atol=1e-12)
    assert "percentile" not in found._jdf.queryExecution().toString()


def test_tercile_buckets_of_few_groups_are_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2] if i % 5 else None, None if i % 31 == 0 else float(rng.normal(0, 1))) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    of = lambda **k: {r["id"]: r["bucket"] for r in stats.tercile_bucket(df, ["g"], "v", **k).collect()}
    assert of(few=True) == of() and set(of(few=True).values()) == {"low", "mid", "high", "unknown"}
