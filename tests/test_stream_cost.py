"""What the streams keep and do for each key."""

import datetime as dt

import pandas as pd
from test_streams import WATCH, WATCH_ALERTS, ledger, run, watch_rows

from marketloom.streaming import streams


def test_sliding_velocity_keeps_a_row_for_each_day_and_counts_users_once(spark, tmp_path):
    e = ledger(spark)
    kept = run(spark, e, str(tmp_path), streams.daily_user_events, "complete")
    rows = [(r["at"].date(), r["variant"], r["user"]) for r in e.collect()]
    assert kept.count() == len(set(rows))
    got = {(r["until"], r["variant"]): (r["events"], r["users"]) for r in streams.sliding_velocity_of_days(kept).collect()}
    want = {}
    for day, variant, user in rows:
        for k in range(1, 8):
            want.setdefault((day + dt.timedelta(days=k), variant), []).append(user)
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_a_user_who_comes_again_counts_once_in_a_window(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(day(1), 1, 7, 2), (day(3), 1, 7, 1), (day(20), 1, 7, 1), (day(3), 1, 8, 1)], "day date, variant int, user long, events long")
    got = {r["until"].day: (r["events"], r["users"]) for r in streams.sliding_velocity_of_days(rows).collect()}
    assert got == {**{n: (2, 1) for n in (2, 3)}, **{n: (4, 2) for n in range(4, 9)}, 9: (2, 2), 10: (2, 2), **{n: (1, 1) for n in range(21, 28)}}


class _Value:
    held = None

    def get(self):
        return self.held

    def exists(self):
        return self.held is not None

    def update(self, held):
        self.held = held


def test_alerts_of_a_key_make_no_frame_of_its_rows(monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a frame for each key")

    monkeypatch.setattr(streams.pd, "concat", refused)
    rows = pd.DataFrame(watch_rows(), columns=[c.split()[0] for c in WATCH.split(", ")])
    state = streams.AlertState()
    state.last = _Value()
    got = [*state.handleInputRows((1,), iter([rows.iloc[:2]]), None), *state.handleInputRows((1,), iter([rows.iloc[3:], rows.iloc[2:3]]), None)]
    assert sorted((at.day, alert) for f in got for at, alert in zip(f["at"], f["alert"], strict=True)) == sorted(WATCH_ALERTS)
