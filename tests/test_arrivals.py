"""Streams with a defined arrival order: late and repeated rows, restarts, idle projects."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetaudit.plans import more_queries
from fleetaudit.streaming import arrivals

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
T0 = datetime(2024, 5, 1)


def at(event: int, hours: float, user: int = 1, kind: str = "error"):
    return (event, T0 + timedelta(hours=hours), user, kind)


def landed(spark, folder, *parts):
    for p in parts:
        arrivals.land_events(spark, spark.createDataFrame(p, SCHEMA), folder)
    return folder


def test_lateness_is_judged_at_landing(spark, tmp_path):
    folder = landed(
        spark, f"{tmp_path}/in", [at(1, 0), at(2, 10)], [at(3, 9.5), at(4, 8.5), at(2, 10), at(1, 0)], [at(4, 8.5), at(5, 30)],
    )
    rows = spark.read.parquet(folder).select("event_id", "late").collect()
    assert sorted(map(tuple, rows)) == [(1, False), (1, True), (2, False), (2, False), (3, False), (4, True), (4, True), (5, False)]
    # an event that arrived in time once is not late, one that arrived late twice is late once
    assert [r["event_id"] for r in arrivals.late_events(spark, folder).collect()] == [4]


def test_sliding_counts_whatever_the_restarts(spark, tmp_path):
    parts = [[at(1, 0.2), at(2, 10)], [at(3, 9.6, kind="view"), at(4, 2.0), at(2, 10)], [at(5, 40)]]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for p in parts:
        landed(spark, folder, p)
        resumed = arrivals.sliding_alert_counts(spark, folder, out)
    whole = arrivals.sliding_alert_counts(spark, folder, f"{tmp_path}/anew")
    got = sorted(map(tuple, resumed.collect()))
    assert got == sorted(map(tuple, whole.collect()))
    hour = lambda h: T0 + timedelta(hours=h)
    want = [(w, "vulnerabilities", 1, 0) for w in (-0.5, 0, 9.5, 10, 39.5, 40)]
    want += [(w, "pipeline", 1, 0) for w in (9, 9.5)] + [(w, "vulnerabilities", 0, 1) for w in (1.5, 2)]
    assert got == sorted((hour(w), hour(w + 1), c, n, late) for w, c, n, late in want)


def test_idle_projects_close_and_late_rows_stay_out(spark, tmp_path):
    parts = [
        [at(1, 0), at(2, 5, kind="signup"), at(3, 0, user=2)],
        [at(4, 16.9), at(5, 17, user=3), at(3, 0, user=2)],  # 4 joins 1 and 2; 3 again is late
        [at(6, 60, user=3, kind="view")],
    ]
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for p in parts:
        landed(spark, folder, p)
        resumed = arrivals.project_episodes(spark, folder, out)
    hour = lambda h: T0 + timedelta(hours=h)
    want = [
        (1, hour(0), hour(16.9), 1, 2, 0, 0, 69, "WARNING"), (2, hour(0), hour(0), 0, 1, 0, 0, 92, "SECURE"),
        (3, hour(17), hour(17), 0, 1, 0, 0, 92, "SECURE"),
    ]  # the last episode of project 3 is open
    assert sorted(map(tuple, resumed.collect())) == want
    assert sorted(map(tuple, arrivals.project_episodes(spark, folder, f"{tmp_path}/anew").collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40), st.integers(1, 40), st.integers(1, 5))
def test_joined_spans_do_not_depend_on_portions(times, idle, portion):
    spans: list = []
    for i in range(0, len(times), portion):
        spans = arrivals.joined_spans(spans + [(t, t, 1) for t in times[i : i + portion]], idle)
    want: list = []
    for t in sorted(times):
        if want and t - want[-1][1] < idle:
            want[-1] = (want[-1][0], t, want[-1][2] + 1)
        else:
            want.append((t, t, 1))
    assert spans == want


def test_every_event_is_counted_or_late(spark):
    out = more_queries.stream_late_windows(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    got = out.agg(F.sum("n_alerts").alias("a"), F.sum("n_late").alias("l")).first()
    assert got["a"] + got["l"] == 2 * n and got["l"] > 0  # each event lies in two windows


class Handle:
    """State and timers of one key, counting what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.value)

    def put(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = []

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_projects_share_the_calls_to_the_state(monkeypatch):
    """F16: state, timer and portions of many projects at once, each project's episodes as by a plain loop."""
    monkeypatch.setattr(arrivals, "PORTION", 50)
    draw, ms = random.Random(16), 1000
    idle = 40 * ms
    job, handle = arrivals.Episodes(idle), Handle()
    job.init(handle)
    seen: list[tuple[int, int]] = []
    for _ in range(3):  # micro-batches
        parts = []
        for _ in range(4):
            new = [(draw.randrange(300), draw.randrange(1000) * ms) for _ in range(250)]
            seen += new
            counts = {c: [int(c == "n_high")] * len(new) for c in arrivals.COUNTS}
            parts.append(pd.DataFrame({"project_id": [p for p, _ in new], "us": [t for _, t in new], **counts}))
        handle.calls = 0
        assert list(job.handleInputRows((7,), iter(parts), None)) == []
        assert handle.calls == 3 and len(handle.timers) == 1  # read, written, timer: whatever the number of projects
    want = []
    for p in range(300):
        times = sorted(t for q, t in seen if q == p)
        for k, t in enumerate(times):
            if k and t - times[k - 1] < idle:
                want[-1] = (p, want[-1][1], t, 0, want[-1][4] + 1, 0, 0)
            else:
                want.append((p, t, t, 0, 1, 0, 0))
    until = 700
    assert handle.timers == [min(w[2] + idle for w in want) // ms]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: until)
    (closed,) = job.handleExpiredTimer((7,), clock, None)
    done = [w for w in want if w[2] + idle <= until * ms]
    assert 0 < len(done) < len(want)
    assert closed.values.tolist() == [[7, *w] for w in done]
    left = np.concatenate([np.array(part).T for part in handle.value]).tolist()
    assert left == [list(w) for w in want if w not in done] and len(handle.value) > 1
    assert handle.timers == [min(w[2] + idle for w in map(tuple, left)) // ms]


def test_projects_without_an_id_are_kept_apart(spark, tmp_path):
    folder = landed(spark, f"{tmp_path}/in", [at(1, 0, None), at(2, 0, 0), at(3, 1, None, "signup")], [at(4, 60)])
    got = arrivals.project_episodes(spark, folder, f"{tmp_path}/out").select("project_id", "n_critical", "n_high")
    assert sorted(map(tuple, got.collect()), key=str) == [(0, 0, 1), (None, 1, 1)]
