"""Alert streams with a defined arrival order: late rows, repeated rows, sliding windows, idle projects.

Events land arrival by arrival (``land_events``).  Whether a row is late is judged when it
lands: it is late if its time is more than ``DELAY`` before the newest time of all earlier
arrivals.  Spark's watermark never runs ahead of that bound, so a row that is on time is never dropped
by it, and results depend on the order of arrivals only, not on how a run cuts them into
micro-batches or how often it is restarted.  A run reads whole arrivals: land first, then run.

* T3 ``sliding_alert_counts``: sliding event-time windows over the rows on time, each event once;
  late events are counted apart.
* T4 ``project_episodes``: per-project counters in keyed state; a timer closes an episode when the
  project has been idle for ``IDLE`` and gives its counts and score.  Projects are dealt into ``SLOTS`` by
  hash; a slot is the key of state and timers, as a call per project costs far more than its rows.

An event that arrives again counts once; one that arrived only late is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetaudit.operators import report
from fleetaudit.streaming.alerts import _run, _upsert_log, alert_stream, latest_state, scratch_dir

DELAY = "1 hour"
WINDOW, SLIDE = "1 hour", "30 minutes"
IDLE = "12 hours"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land_events(spark: SparkSession, events: DataFrame, landing: str) -> None:
    """Add one arrival to ``landing``, each row with ``late``: behind the newest earlier arrival by over ``DELAY``."""
    try:
        seen = spark.read.parquet(landing).agg(F.max("ts").alias("ts"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the first arrival
            raise
        seen = events.limit(0).agg(F.max("ts").alias("ts"))
    limit = seen.select((F.col("ts") - F.expr(f"INTERVAL {DELAY}")).alias("limit"))  # one row
    judged = events.join(F.broadcast(limit), F.lit(True), "left")
    late = F.coalesce(F.col("ts") < F.col("limit"), F.lit(False))
    judged.select(*events.columns, late.alias("late")).write.mode("append").parquet(landing)


def _on_time(spark: SparkSession, landing: str) -> DataFrame:
    """The landed rows that are on time as alerts, each event once."""
    rows = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)
    return alert_stream(rows.where(~F.col("late"))).withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])


def late_events(spark: SparkSession, landing: str) -> DataFrame:
    """The events that arrived only late, as alerts, each once."""
    rows = spark.read.parquet(landing)
    only = rows.groupBy("event_id").agg(F.min("late").alias("late")).where("late").select("event_id")
    late = rows.where("late").join(only, "event_id", "left_semi")
    return alert_stream(late).dropDuplicates(["event_id"])


def _windows(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy(F.window("ts", WINDOW, SLIDE).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "n")
    )


# ------------------------------------------------------------------ T3
def sliding_alert_counts(spark: SparkSession, landing: str, out: str | None = None) -> DataFrame:
    """(window_start, window_end, category, n_alerts, n_late) over sliding windows.

    ``n_alerts`` comes from the stream; with the same ``out`` again it resumes and reads only new
    arrivals.  ``n_late`` reports the events that the stream has left out.
    """
    out = out or scratch_dir(spark, "sliding")
    key = ["window_start", "window_end", "category"]
    counts = _windows(_on_time(spark, landing)).withColumnRenamed("n", "n_alerts")
    _run(_upsert_log(counts, out + "/data", out + "/ckpt", key))
    late = _windows(late_events(spark, landing)).withColumnRenamed("n", "n_late")
    both = latest_state(spark, out + "/data", key).join(late, key, "full")
    return both.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_alerts", "n_late")])


# ------------------------------------------------------------------ T4
COUNTS = [f"n_{s.lower()}" for s in report.SEVERITIES]
EPISODE = ["project_id", "first_us", "last_us", *COUNTS]
SLOTS = 512  # groups of projects that share a state and a timer; a checkpoint holds for this number only
PORTION = 10_000  # episodes in one row of the state


def joined_episodes(rows: np.ndarray, idle_us: int) -> np.ndarray:
    """Rows of ``EPISODE`` by project and time, those of a project less than ``idle_us`` apart as one."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if len(rows) < 2:
        return rows
    project, first = rows[:, 0], rows[:, 1]
    reached = pd.Series(rows[:, 2]).groupby(project).cummax().to_numpy()
    opens = np.append(True, (project[1:] != project[:-1]) | (first[1:] - reached[:-1] >= idle_us))
    at = np.flatnonzero(opens)
    last, counts = np.maximum.reduceat(rows[:, 2], at), np.add.reduceat(rows[:, 3:], at)
    return np.column_stack([rows[at, :2], last, counts])


def joined_spans(spans: list[tuple], idle_us: int) -> list[tuple]:
    """``joined_episodes`` of one project: spans (first, last, counts...) in order."""
    rows = np.array([(0, *s) for s in spans], dtype=np.int64)
    return [tuple(r[1:]) for r in joined_episodes(rows, idle_us).tolist()]


class Episodes(StatefulProcessor):
    """Open episodes of a slot's projects; a timer at the end of the earliest one's idle time closes it.

    State holds the open episodes, not rows; those of a project are at least the idle time apart.  Rows of a
    slot come in portions, each reduced to episodes; all its projects are worked on at once.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ", ".join(f"{c} array<long>" for c in EPISODE))

    def _opened(self) -> np.ndarray:
        parts = [np.array(p, dtype=np.int64).T for p in self.open.get()]
        return np.concatenate([np.empty((0, len(EPISODE)), dtype=np.int64), *parts])

    def _ends(self, rows: np.ndarray) -> np.ndarray:
        return -(-(rows[:, 2] + self.idle_us) // 1000)  # in milliseconds, rounded up

    def _keep(self, rows: np.ndarray) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            self.open.put([tuple(rows[k : k + PORTION].T.tolist()) for k in range(0, len(rows), PORTION)])
            self.handle.registerTimer(int(self._ends(rows).min()))
        else:
            self.open.clear()

    def _found(self, part: pd.DataFrame) -> np.ndarray:
        us = part["us"]
        if us.hasnans:  # a row without a time counts with its project's newest one here
            us = us.fillna(us.groupby(part["project_id"]).transform("max"))
            part, us = part[us.notna()], us[us.notna()]
        rows = np.column_stack([part["project_id"], us, us, part[COUNTS].fillna(0)]).astype(np.int64)
        return joined_episodes(rows, self.idle_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [self._opened()]
        for part in rows:
            spans.append(self._found(part))
            if sum(map(len, spans[1:])) > len(spans[0]) + PORTION:  # so that an episode is joined a few times only
                spans = [joined_episodes(np.concatenate(spans), self.idle_us)]
        self._keep(joined_episodes(np.concatenate(spans), self.idle_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self._opened()
        closed = self._ends(rows) <= timerValues.getCurrentWatermarkInMs()
        self._keep(rows[~closed])
        found = pd.DataFrame(rows[closed], columns=EPISODE)
        found.insert(0, "slot", int(key[0]))
        yield found

    def close(self) -> None:
        pass


def project_episodes(spark: SparkSession, landing: str, out: str | None = None, idle: str = IDLE) -> DataFrame:
    """T4: closed episodes (project_id, first_ts, last_ts, counts per severity, security_score, band).

    An episode is a run of a project's alerts less than ``idle`` apart; it closes when the watermark is
    ``idle`` behind its last alert, and the project's state goes.  With the same ``out`` again, the query resumes.
    """
    out = out or scratch_dir(spark, "episodes")
    idle_us = int(pd.Timedelta(idle).total_seconds()) * 1_000_000
    alerts = _on_time(spark, landing).withColumn("sev", report.counted_severity())
    counted = [(F.col("sev") == s).cast("long").alias(c) for s, c in zip(report.SEVERITIES, COUNTS)]
    project = F.col("project_id")
    slot = F.when(project.isNull(), -1).otherwise(F.pmod(F.xxhash64(project), F.lit(SLOTS)).cast("int"))
    schema = ", ".join(["slot int", *(f"{c} long" for c in EPISODE)])
    episodes = (
        alerts.select(
            slot.alias("slot"), F.coalesce(project, F.lit(0)).alias("project_id"), "ts", F.unix_micros("ts").alias("us"), *counted
        )
        .groupBy("slot")
        .transformWithStateInPandas(Episodes(idle_us), schema, "Append", "EventTime")
    )
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)  # keyed state with timers needs it; read when the query starts
    try:
        query = (
            episodes.writeStream.format("parquet").outputMode("append").option("path", out + "/data")
            .option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start()
        )
        _run(query)
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    score = F.lit(100)
    for s, c in zip(report.SEVERITIES, COUNTS):
        score = score - F.col(c) * report.SCORE_WEIGHTS[s]
    closed = spark.read.schema(schema).parquet(out + "/data")
    return closed.select(
        F.when(F.col("slot") >= 0, project).alias("project_id"),
        F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"),
        *COUNTS, F.greatest(F.lit(0), score).cast("int").alias("security_score"),
    ).withColumn("band", report.score_band(F.col("security_score")))
