import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import hedonic, stats

ROWS = "key string, grp long, id long, artist string, rarity string, kind string, age double, size double, y double"


def rows_of(r, n):
    out = []
    for i in range(n):
        artist = r.choice([f"a{int(r.expovariate(0.12))}", None, ""])
        rarity = r.choice("CURM")
        age, size = r.gauss(20, 5), r.choice([1.0, 2.0, None, float("nan")])
        y = 2 + 0.03 * age + {"C": 0, "U": 0.3, "R": 0.9, "M": 1.7}[rarity] + (len(artist or "") % 3) * 0.2 + r.gauss(0, 0.3)
        out.append((r.choice(["k1", "k1", "k2"]), r.randint(0, 12), i, artist, rarity, r.choice(["card", "sealed", None]), age, size, y if i % 50 else None))
    return out + [("alone", 1, n, "x", "C", "card", 1.0, 1.0, 0.5)]


def dense(rows, folds, top_k, ridge=1e-6):
    """Out-of-fold predictions and the final coefficients of one key, with dense NumPy matrices."""
    groups = {x[1] for x in rows}
    n_folds = max(2, min(folds, len(groups)))
    fold = [int(hashlib.sha256(str(x[1]).encode()).hexdigest(), 16) % n_folds for x in rows]

    def spec(train):
        names = []
        for f, c in ((3, "artist"), (4, "rarity")):
            count = {}
            for x in train:
                count[x[f] or "unknown"] = count.get(x[f] or "unknown", 0) + 1
            names += [(f, f"{c}={v}", v) for v in [v for v, _ in sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))][:top_k]]
        return names

    def design(some, names):
        num = lambda v: v if v is not None and math.isfinite(v) else 0.0
        return np.array([[1.0, *[float((x[f] or "unknown") == v) for f, _, v in names], num(x[6]), num(x[7])] for x in some])

    def fit(train):
        names = spec(train)
        x = design(train, names)
        beta = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ np.array([t[8] for t in train]))
        return names, beta

    out = {}
    for f in range(n_folds):
        train, test = [x for x, g in zip(rows, fold, strict=True) if g != f], [x for x, g in zip(rows, fold, strict=True) if g == f]
        if train and test:
            names, beta = fit(train)
            out |= dict(zip([x[2] for x in test], design(test, names) @ beta, strict=True))
    names, beta = fit(rows)
    return out, dict(zip(["", *[n for _, n, _ in names], "age", "size"], beta, strict=True)), dict(zip([x[2] for x in rows], design(rows, names) @ beta, strict=True))


def test_model_equals_dense_matrices(spark):
    rows = rows_of(random.Random(4), 900)
    df = spark.createDataFrame(rows, ROWS)
    model = hedonic.hedonic_model(df, "key", "grp", ["artist", "rarity"], ["age", "size"], "y", kind="kind", top_k=6)
    held = {x["id"]: x["predicted"] for x in model.held_out.collect()}
    metrics = {x["key"]: x for x in model.metrics.collect()}
    predicted = {x["id"]: x["hedonic_log"] for x in hedonic.hedonic_predict(df, model.coefficients, "key", ["artist", "rarity"], ["age", "size"]).collect()}
    betas = {x["key"]: x["beta"] for x in model.coefficients.collect()}
    for key in ("k1", "k2"):
        own = [x for x in rows if x[0] == key and x[8] is not None]
        want, beta, every = dense(own, 5, 6)
        assert {i: held[i] for i in want} == pytest.approx(want, abs=1e-6)
        assert set(betas[key]) == set(beta) and {x[2]: predicted[x[2]] for x in own} == pytest.approx(every, abs=1e-6)
        e = np.array([x[8] - want[x[2]] for x in own])
        y = np.array([x[8] for x in own])
        m = metrics[key]
        assert (m["n"], m["covered"], m["n_features"], m["n_groups"]) == (len(own), len(own), len(beta), len({x[1] for x in own}))
        assert m["rmse"] == pytest.approx(math.sqrt((e**2).mean())) and m["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
        for kind in ("card", "sealed", "unknown"):
            part = [abs(v) for v, x in zip(e, own, strict=True) if (x[5] or "unknown") == kind]
            assert m["mae_by_kind"][kind] == pytest.approx(statistics.mean(part)) and m["covered_by_kind"][kind] == len(part)
    assert metrics["alone"]["covered"] == 0 and metrics["alone"]["n_folds"] == 2
    empty = hedonic.hedonic_model(spark.createDataFrame([], ROWS), "key", "grp", ["artist"], ["age"], "y")
    assert empty.metrics.count() == 0 and empty.coefficients.count() == 0


def test_singular_systems_fall_back():
    same = np.ones((3, 3))
    beta, fallback = hedonic.ridge_solution(same, np.array([2.0, 2.0, 2.0]), 1e-6, False)
    assert not fallback and same[0] @ beta == pytest.approx(2.0, abs=1e-4)
    beta, fallback = hedonic.ridge_solution(np.array([[4.0, np.inf], [np.inf, 1.0]]), np.array([8.0, 1.0]), 1e-6, False)
    assert fallback and beta.tolist() == [2.0, 0.0]


FAIR = "key string, id long, at date, available date, price double, quality double, x double, z double, series string"


def fair_rows(spark, n):
    r = random.Random(11)
    rows = []
    for i in range(n):
        x, z, series = r.gauss(5, 2), r.gauss(0, 1), r.choice(["p", "q", "rare" if i % 40 == 0 else "q", None, " "])
        noise = r.gauss(0, 0.2) + (3 if i % 29 == 0 else 0)
        day = np.datetime64("2024-01-01") + i * 200 // n
        rows.append((r.choice("ab"), (i * 7919) % n, day.astype(object), (day + r.randint(0, 3)).astype(object), math.exp(1 + 0.3 * x - 0.2 * z + (series == "p") * 0.5 + noise), r.random(), x if i % 9 else None, z, series))
    return rows


def dense_fair(rows, cutoff):
    own = sorted((x for x in rows if x[2] < cutoff and x[3] <= cutoff), key=lambda x: (x[2], x[1]))
    late = min(max(1, int(len(own) * 0.25)), len(own) - 1)
    train, cal = own[:-late], own[-late:]
    centre, scale = [], []
    for f in (6, 7):
        v = [x[f] for x in train if x[f] is not None]
        centre.append(np.median(v))
        scale.append(max(1e-6, (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.349))
    count = {}
    for x in train:
        if x[8] and x[8].strip():
            count[x[8].strip()] = count.get(x[8].strip(), 0) + 1
    levels = sorted(k for k, c in count.items() if c >= 3)

    def design(some):
        return np.array([[1.0, *[v for f, c, s in zip((6, 7), centre, scale, strict=True) for v in ((0.0, 1.0) if x[f] is None else ((x[f] - c) / s, 0.0))], *[float((x[8] or "").strip() == k) for k in levels]] for x in some])

    x, y, w = design(train), np.log([t[4] for t in train]), np.ones(len(train))
    for _ in range(3):
        a = (x.T * w) @ x + 2.0 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        beta = np.linalg.solve(a, (x.T * w) @ y)
        e = y - x @ beta
        away = abs(e - np.median(e))
        limit = 1.5 * max(1e-6, 1.4826 * np.median(away))
        w = np.where(away <= limit, 1.0, limit / np.maximum(away, 1e-300))
    residual = np.log([t[4] for t in cal]) - design(cal) @ beta
    return len(train), len(cal), np.quantile(residual, list(hedonic.QUANTILES.values())), dict(zip([t[1] for t in rows], design(rows) @ beta, strict=True)), {t[1] for t in cal}


def test_fair_value_equals_dense_matrices(spark):
    rows = fair_rows(spark, 900)
    df = spark.createDataFrame(rows, FAIR)
    cutoff = np.datetime64("2024-06-20").astype(object)
    fitted = hedonic.fair_value(df, "key", "id", "at", "available", "price", F.lit("2024-06-20").cast("date"), ["x", "z"], ["series"])
    models = {x["key"]: x for x in fitted.models.collect()}
    out = {x["id"]: x for x in hedonic.fair_estimates(df, fitted.models, "key", "price", "quality", ["x", "z"], ["series"]).collect()}
    assert len(out) == len(rows)
    for key in "ab":
        own = [x for x in rows if x[0] == key]
        n, late, bands, centre, cal = dense_fair(own, cutoff)
        m = models[key]
        assert (m["n_training"], m["n_calibration"], m["status"]) == (n, late, "research_only")
        assert [m[q] for q in hedonic.QUANTILES] == pytest.approx(bands.tolist(), abs=1e-9)
        assert {x["id"] for x in fitted.blocks.where(f"block = 'calibrate' and key = '{key}'").collect()} == cal
        for x in own:
            assert [out[x[1]][q] for q in hedonic.QUANTILES] == pytest.approx(np.exp(centre[x[1]] + bands).tolist())
            assert out[x[1]]["position"] == ("below_range" if x[4] < out[x[1]]["q25"] else "above_range" if x[4] > out[x[1]]["q75"] else "within_range")
    later = [out[x[1]]["q10"] <= x[4] <= out[x[1]]["q90"] for x in rows if x[2] >= cutoff]
    assert len(later) > 80 and 0.72 <= sum(later) / len(later) <= 0.9


def test_fair_value_of_few_rows(spark):
    df = spark.createDataFrame(fair_rows(spark, 30) + [("one", 99, np.datetime64("2024-01-01").astype(object), np.datetime64("2024-01-01").astype(object), 5.0, 1.0, 1.0, 1.0, "p")], FAIR)
    fitted = hedonic.fair_value(df, "key", "id", "at", "available", "price", F.lit("2024-09-01").cast("date"), ["x"], [])
    assert {x["key"]: x["status"] for x in fitted.models.collect()} == {"a": "quarantined", "b": "quarantined"}
    assert "insufficient_training_rows" in fitted.models.first()["reasons"]
    out = {x["id"]: x for x in hedonic.fair_estimates(df, fitted.models, "key", "price", "quality", ["x"], []).collect()}
    assert out[99]["q50"] is None and out[99]["position"] is None


def test_several_quantiles_in_one_pass(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b"]), r.gauss(0, 1), None if r.random() < 0.2 else float(r.randint(0, 3))) for _ in range(500)]
    got = {x["k"]: x for x in stats.quantiles_of_large(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], {"m": ("v", 0.5), "hi": ("v", 0.9), "wm": ("w", 0.25), "a": (F.abs("v"), 0.5)}).collect()}
    for k in (None, "a", "b"):
        v, w = [x[1] for x in rows if x[0] == k], [x[2] for x in rows if x[0] == k and x[2] is not None]
        assert (got[k]["m"], got[k]["hi"], got[k]["wm"], got[k]["a"]) == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9), np.quantile(w, 0.25), np.quantile(np.abs(v), 0.5)))
