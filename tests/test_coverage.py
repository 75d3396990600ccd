import datetime

import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluate, lab

KEYS, BY = ["series", "horizon"], ["cohort", "horizon"]
STATES = {1: "scored", 2: "open", 3: "unscorable", 4: "feature_abstained", 5: "scored", None: "unscorable"}


def contract(spark, cells=(), examples=(), without=(), rows_without=(), declared=()):
    """Six declared series at two horizons, in cohorts of odd and even ones; the arguments add to a ledger that reconciles or take from it."""
    own = [(s, h) for s in STATES for h in (2, 9)]
    planned = spark.createDataFrame([(s, h, "none" if s is None else f"c{s % 2}") for s, h in [*own, *declared]], "series long, horizon int, cohort string")
    ledger = spark.createDataFrame([(s, h, STATES[s]) for s, h in own if (s, h) not in without] + [*cells], "series long, horizon int, cell string")
    rows = spark.createDataFrame([(s, h, STATES[s]) for s, h in own if STATES[s] in ("scored", "open") and (s, h) not in rows_without] + [*examples], "series long, horizon int, cell string")
    return lab.coverage_contract(planned, ledger, rows, KEYS, BY, ["retrospective"])


def test_a_ledger_that_reconciles(spark):
    got = {(x["cohort"], x["horizon"]): x for x in contract(spark).collect()}
    assert set(got) == {(c, h) for c in ("c0", "c1", "none") for h in (2, 9)}
    for h in (2, 9):
        assert got["c1", h][2:] == (3, 0, 0, 1, 2, True, ["retrospective"])
        assert got["c0", h][2:] == (2, 1, 1, 0, 0, True, ["retrospective"])
        assert got["none", h][2:] == (1, 0, 0, 1, 0, True, ["retrospective"])


@pytest.mark.parametrize(
    "change, cohort, found",
    [
        ({"without": [(3, 2)]}, "c1", ["declared_cell_missing"]),
        ({"without": [(None, 2)]}, "none", ["declared_cell_missing"]),
        ({"without": [(1, 2)]}, "c1", ["declared_cell_missing", "row_without_its_cell"]),
        ({"cells": [(7, 2, "unscorable")]}, None, ["cell_not_declared"]),
        ({"cells": [(3, 2, "unscorable")]}, "c1", ["cell_repeated"]),
        ({"cells": [(7, 2, "lost")], "declared": [(7, 2)]}, "c1", ["cell_state_unknown"]),
        ({"without": [(3, 2)], "cells": [(5, 2, "unscorable")]}, "c1", ["declared_cell_missing", "cell_repeated"]),  # the sums agree
        ({"examples": [(4, 2, "scored")]}, "c0", ["row_without_its_cell"]),
        ({"examples": [(2, 2, "open")]}, "c0", ["row_without_its_cell"]),
        ({"examples": [(2, 2, "scored")], "rows_without": [(2, 2)]}, "c0", ["row_without_its_cell", "cell_without_its_row"]),
        ({"rows_without": [(5, 2)]}, "c1", ["cell_without_its_row"]),
        ({"declared": [(3, 2)]}, "c1", ["cell_declared_twice"]),
    ],
)
def test_what_breaks_the_contract(spark, change, cohort, found):
    c = contract(spark, **change)
    got = {(x["cohort"], x["horizon"]): x for x in c.collect()}
    assert got[cohort, 2]["reasons"] == [*found, "retrospective"] and not got[cohort, 2]["reconciled"]
    assert all(x["reconciled"] for k, x in got.items() if k != (cohort, 2))
    with pytest.raises(Exception, match="coverage does not reconcile"):
        lab.fail_closed(c).collect()


def test_a_lost_snapshot_is_found(spark):
    at = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    rows = [(s, at(d), at(d, 1), 5.0 + d + s, 0.9, s * 100 + d) for s in range(4) for d in range(5 * (s == 3), 12) if (s, d) != (2, 11)]
    obs = spark.createDataFrame(rows, "series long, observed_at timestamp, available_at timestamp, price double, quality double, id long")
    origins, as_of = spark.createDataFrame([(at(5),), (at(8),), (at(10),)], "origin timestamp"), F.lit("2024-01-12").cast("date")
    snaps = lab.trend_snapshot(obs, origins, ["series"])
    due = snaps.select("series", F.explode(F.array(*[F.date_add(F.to_date("origin"), h) for h in (1, 3)])).alias("matures")).distinct()
    real = evaluate.realized_price(obs, due, ["series"], 1)
    planned = lab.declared_cells(obs, origins, ["series"], (1, 3)).withColumn("cohort", F.col("series") % 2)

    def of(snapshots):
        own = (snapshots, real, ["series"], (1, 3), as_of)
        c = lab.coverage_contract(planned, lab.forecast_cells(*own), lab.forecast_examples(*own), ["series", "origin", "horizon"], ["cohort", "horizon"])
        return {(x["cohort"], x["horizon"]): x for x in c.collect()}

    whole = of(snaps)  # series 3 is not known at the first origin: its first point comes out an hour later
    assert {k: tuple(x[2:8]) for k, x in whole.items()} == {(0, 1): (6, 2, 0, 1, 3, True), (0, 3): (6, 2, 2, 1, 1, True), (1, 1): (5, 3, 0, 0, 2, True), (1, 3): (5, 3, 1, 0, 1, True)}
    lost = of(snaps.where("not (series = 1 and origin = timestamp'2024-01-11')"))
    assert lost[1, 1]["planned"] == 5 and lost[1, 1]["scored"] == 1 and lost[1, 1]["reasons"][0] == "declared_cell_missing" and lost[0, 1]["reconciled"]
