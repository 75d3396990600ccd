import math
import random
import statistics

import numpy as np
import pytest

from marketloom.operators import forecast, windows
from marketloom.operators.index import index_levels

PANEL = "category string, grp string, product long, t int, price double"
KEYS = ["category", "grp", "product"]


def panel_rows(series, steps, seed, sigma=0.05, missing=0.1, common=0.02):
    r = random.Random(seed)
    rows = []
    market = [0.0]
    for _ in range(steps):
        market.append(market[-1] + r.gauss(0.002, common))
    for s in range(series):
        y, scale = math.log(r.uniform(5, 50)), sigma * r.choice([0.5, 1, 2])
        for t in range(steps):
            y += r.gauss(0, scale)
            if r.random() >= missing:
                rows.append((f"c{s % 2}", f"g{s % 6}", s, t, math.exp(y + market[t])))
    return rows


def brute(rows, index, horizons, weights, min_origin=15, lookback=13):
    """The forecast by its definition, series after series."""
    levels, trends = {}, {}
    for x in index:
        levels.setdefault((x["level"], x["category"], x["grp"]), {})[x["t"]] = x["idx"]
    for k, v in levels.items():
        days = sorted(v)
        if len(days) < 2:
            continue
        level, trend = v[days[0]], v[days[1]] - v[days[0]]
        trends[k] = {days[0]: trend}
        for t in days[1:]:
            new = 0.3 * v[t] + 0.7 * (level + 0.85 * trend)
            trend = 0.1 * (new - level) + 0.9 * 0.85 * trend
            level = new
            trends[k][t] = trend
    damp = lambda x, h: x * sum(0.85**i for i in range(1, h + 1))
    part = lambda c, g: (("market", None, None), ("category", c, None), ("group", c, g))
    combined = lambda c, g, t: sum(levels[k][t] for k in part(c, g))

    def delta(c, g, t, h):
        m, k, own = (damp(trends.get(x, {}).get(t, 0.0), h) for x in part(c, g))
        n = t - min(levels[("group", c, g)])
        return m + k + own * n / (n + 12)

    series = {}
    for c, g, s, t, price in rows:
        series.setdefault((c, g, s), {})[t] = math.log(price)
    last_day = max(t for *_, t, _ in rows)
    facts, mads = {}, {}
    for key, y in series.items():
        c, g, _ = key
        days = sorted(y)
        own = {t: y[t] - combined(c, g, t) for t in days}
        r = [(b, (own[b] - own[a]) / (b - a)) for a, b in zip(days, days[1:], strict=False)]
        if len(r) >= 2:
            centre = statistics.median(x for _, x in r)
            mads[key] = 1.4826 * statistics.median(abs(x - centre) for _, x in r)
        facts[key] = (y, own, r)

    def middle(key, o, h):
        c, g, _ = key
        y, own, r = facts[key]
        known = [x for t, x in r if t <= o]
        level = None
        for x in known:
            level = x if level is None else 0.3 * x + 0.7 * level
        drift = level * len(known) / (len(known) + 8) if known else 0.0
        near = [own[t] for t in own if o - lookback < t <= o]
        reversion = statistics.median(near) - own[o] if len(near) >= 2 else 0.0
        a, w, b = weights.get(h, (1.0, 0.0, 1.0))
        return y[o] + a * delta(c, g, o, h) + w * reversion + b * drift * h

    cuts = {c: np.quantile([m for k, m in mads.items() if k[0] == c], [1 / 3, 2 / 3]) for c in {k[0] for k in mads}}
    bucket = lambda k: "unknown" if k not in mads else "low" if mads[k] <= cuts[k[0]][0] else "mid" if mads[k] <= cuts[k[0]][1] else "high"
    pools = {}
    for key in mads:
        y = facts[key][0]
        for h in horizons:
            for o in forecast.walk_forward_origins(min_origin, last_day, h):
                if o in y and o + h in y:
                    pools.setdefault((key[0], bucket(key), h), []).append((y[o + h] - middle(key, o, h)) / max(mads[key], 1e-4))
    out = {}
    for key in series:
        last = max(series[key])
        own_mads = sorted(m for k, m in mads.items() if k[0] == key[0])
        cut = math.floor(len(own_mads) * 0.1)
        width = mads[key] if mads.get(key, 0) >= 1e-4 else max(1e-4, statistics.mean(own_mads[cut : len(own_mads) - cut]))
        for h in horizons:
            pool = pools.get((key[0], bucket(key), h))
            for q, p in forecast.QUANTILES.items():
                off = (p - 0.5) * 2 if not pool else 0.0 if p == 0.5 else min(0, np.quantile(pool, p)) if p < 0.5 else max(0, np.quantile(pool, p))
                out[(*key, h, q)] = math.exp(middle(key, last, h) + off * width)
    return out


@pytest.mark.parametrize("weights", [{}, {2: (0.5, 0.25, -0.25), 4: (0.0, 0.1, 0.25)}])
def test_equals_definition(spark, weights):
    rows = panel_rows(24, 24, 5) + [("c0", "g0", 900, 20, 7.0)]
    panel = spark.createDataFrame(rows, PANEL)
    index = index_levels(panel, KEYS).cache()
    got = forecast.trajectory_forecast(panel, KEYS, index, (2, 4), 7, weights).collect()
    want = brute(rows, index.collect(), (2, 4), weights)
    assert len(got) * 5 == len(want)
    for x in got:
        for q in forecast.QUANTILES:
            assert x[q] == pytest.approx(want[(x["category"], x["grp"], x["product"], x["horizon"], q)], rel=1e-9)
    assert {x["tier"] for x in got if x["product"] == 900} == {"insufficient-history"}


@pytest.mark.parametrize("alpha", [0.3, 0.9, 0.02])
def test_smoothing_equals_the_fold_at_any_length(spark, alpha):
    r = random.Random(7)
    rows, want = [], {}
    for s, n in enumerate([1, 10, 51, 52, 1_990, 5_000, 20_000]):
        level, known = None, 0
        for t in range(n):
            v = None if t % 11 == 3 or (s == 1 and t == 0) else r.gauss(0, 1)
            rows.append((s, t, v))
            if v is not None:
                known += 1
                level = v if level is None else alpha * v + (1 - alpha) * level
            want[s, t] = (level, known)
    got = windows.smoothed(spark.createDataFrame(rows, "s long, t int, v double"), ["s"], "t", "v", alpha).collect()
    for x in got:
        level, known = want[x["s"], x["t"]]
        assert x["smoothed_n"] == known
        if x["v"] is not None:
            assert x["smoothed"] == pytest.approx(level, rel=1e-9, abs=1e-9)


def test_long_series_have_finite_bands(spark):
    """2,200 dates, which a running sum of r / 0.7^i does not survive."""
    rows = panel_rows(6, 2_200, 9, missing=0.02)
    got = forecast.trajectory_forecast(spark.createDataFrame(rows, PANEL), KEYS, index_levels(spark.createDataFrame(rows, PANEL), KEYS), (4,)).collect()
    assert len(got) == 6 and all(0 < x["q10"] <= x["q25"] <= x["q50"] <= x["q75"] <= x["q90"] < math.inf for x in got)
    assert {x["tier"] for x in got} == {"standard"}


def test_anchor_cold_starts_and_packets(spark):
    rows = panel_rows(24, 24, 5) + [("c0", "g0", 900, t, 7.0 + t % 2) for t in range(19, 24)]
    panel = spark.createDataFrame(rows, PANEL)
    index = index_levels(panel, KEYS)
    hedonic = [("c0", "g0", 900, math.log(70.0)), ("c0", "g0", 901, math.log(9.0)), ("c0", "new", 902, math.log(3.0)), ("c9", "g0", 903, 1.0), ("c0", "g0", 0, 9.0), ("c0", "g0", 904, None)]
    plain = {(x["product"], x["horizon"]): x for x in forecast.trajectory_forecast(panel, KEYS, index, (2, 4)).collect()}
    rows = forecast.trajectory_forecast(panel, KEYS, index, (2, 4), hedonic=spark.createDataFrame(hedonic, "category string, grp string, product long, hedonic_log double"))
    got = {(x["product"], x["horizon"]): x for x in rows.collect()}
    assert set(got) == set(plain) | {(p, h) for p in (901, 902) for h in (2, 4)}
    n = got[900, 2]["n"]
    assert n == 4 and got[900, 2]["price"] == pytest.approx(8.0) and got[900, 2]["saturated"]
    assert got[900, 2]["anchor"] == pytest.approx(24.0) and got[900, 2]["q50"] == pytest.approx(3 * plain[900, 2]["q50"])  # held at three times the own price
    assert got[0, 2] == plain[0, 2] and not plain[0, 2]["saturated"]  # enough history: the hedonic price has no say
    for p, price in ((901, 9.0), (902, 3.0)):
        cold = got[p, 4]
        assert cold["tier"] == "cold-start" and cold["price"] is None and cold["anchor"] == pytest.approx(price) and cold["origin"] == 23 and cold["n"] == 0
        widest = max((x for k, x in plain.items() if k[1] == 4 and x["category"] == "c0"), key=lambda x: math.log(x["q90"] / x["q10"]))
        assert math.log(cold["q90"] / cold["q10"]) > 0 and cold["q10"] < cold["q50"] < cold["q90"] and widest["bucket"] in ("mid", "high")
    packets = {x["product"]: x for x in forecast.forecast_packets(rows, KEYS).collect()}
    assert len(packets) * 2 == len(got)
    assert [(x["t"], round(x["price"], 6)) for x in packets[901]["path"]] == [(23, 9.0), (25, round(got[901, 2]["q50"], 6)), (27, round(got[901, 4]["q50"], 6))]
    assert [x["horizon"] for x in packets[900]["horizons"]] == [2, 4]


def test_bands_cover_held_out_steps(spark):
    rows = panel_rows(600, 44, 8, missing=0.0, common=0.004)  # one date: a move of all series would be one draw, not 600
    panel = spark.createDataFrame([x for x in rows if x[3] < 40], PANEL)
    later = {(x[2], x[3]): x[4] for x in rows}
    got = forecast.trajectory_forecast(panel, KEYS, index_levels(panel, KEYS), (1, 4)).collect()
    for h in (1, 4):
        inside = [x["q10"] <= later[(x["product"], 39 + h)] <= x["q90"] for x in got if x["horizon"] == h]
        assert len(inside) == 600 and 0.75 <= sum(inside) / 600 <= 0.88


def test_empty_panel(spark):
    panel = spark.createDataFrame([], PANEL)
    assert forecast.trajectory_forecast(panel, KEYS, index_levels(panel, KEYS)).count() == 0
