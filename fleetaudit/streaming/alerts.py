"""Structured Streaming versions of the jobs.

* T1 ``stream_outdated``: manifests arrive as Parquet files (``land_manifests``
  lands each content once); each micro-batch is parsed and joined (stream-static) to the latest-release lookup; alerts
  are appended to a Parquet sink.
* T2 ``dedup_alerts``: repeated alerts dropped with
  ``dropDuplicatesWithinWatermark``.
* T3 ``windowed_alert_counts``: event-time windows under a watermark.
* T4 ``running_scores``: per-project running severity counts and score
  (update mode; state kept by Spark's aggregation state store).

Aggregations run in update mode through ``foreachBatch``: every micro-batch
writes the rows it changed into its own ``batch_id=<n>`` folder (overwrite, so
a retried batch does not duplicate rows), and the current state is "latest
row per key" — read back as a batch DataFrame.  Sinks and
checkpoints live under the session's shared checkpoint folder, so a restarted
query resumes from its checkpoint instead of starting over.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetaudit.operators import outdated, report
from fleetaudit.session import ensure_checkpoint_dir, written
from fleetaudit.sources import manifests as M

# How the demo alert stream (``events``) maps to alert category and severity.
EVENT_CATEGORY = {
    "error": ("vulnerabilities", "HIGH"),
    "signup": ("dep_confusion", "CRITICAL"),
    "click": ("typosquatting", "MEDIUM"),
    "view": ("pipeline", "MEDIUM"),
    "purchase": ("versions", "LOW"),
}
# A micro-batch of manifests takes files up to this size (one at least): each costs its own planning and
# job starts, and a handful of files leaves most cores idle.
BATCH_BYTES = 1 << 30
WATERMARK = "1 hour"
WINDOW = "1 hour"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stream-{label}-{uuid.uuid4().hex[:12]}"


def read_events_stream(spark: SparkSession, events_path: str) -> DataFrame:
    """Stream the Parquet file(s) at ``events_path`` (a file or a folder of files)."""
    schema = spark.read.parquet(events_path).schema
    folder, _, name = events_path.rstrip("/").rpartition("/")
    if name.endswith(".parquet"):  # a single landed file: watch its folder, pick the file by name
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(events_path)


def _run(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def alert_stream(events: DataFrame) -> DataFrame:
    """Events -> alert rows (project_id, category, severity, package, ts as TIMESTAMP)."""
    cat = F.lit(None).cast("string")
    sev = F.lit(None).cast("string")
    for e, (c, s) in EVENT_CATEGORY.items():
        cat = F.when(F.col("event_type") == e, F.lit(c)).otherwise(cat)
        sev = F.when(F.col("event_type") == e, F.lit(s)).otherwise(sev)
    return events.select(
        F.col("user_id").alias("project_id"),
        cat.alias("category"),
        sev.alias("severity"),
        F.concat(F.lit("pkg-"), (F.col("event_id") % 97).cast("string")).alias("package"),
        F.col("ts").cast("timestamp").alias("ts"),  # watermarks need TIMESTAMP, not TIMESTAMP_NTZ
        "event_id",
    )


def _write_batch(batch: DataFrame, out: str, batch_id: int) -> None:
    """Idempotent micro-batch sink: a re-run of the same batch overwrites its own folder."""
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def _upsert_log(df: DataFrame, out: str, ckpt: str, keys: list[str]) -> StreamingQuery:
    """Write each micro-batch's changed rows (update mode) into the batch's own folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, out, batch_id)

    return (
        df.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )


def latest_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current state of an upsert log: the row of the highest batch per key."""
    log = spark.read.parquet(out)  # batch_id comes back as a partition column
    vals = [c for c in log.columns if c not in keys and c != "batch_id"]
    agg = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("batch_id")).alias("v"))
    return agg.select(*keys, *[F.col(f"v.{c}").alias(c) for c in vals])


# ------------------------------------------------------------------ T3
def windowed_alert_counts(spark: SparkSession, events_path: str, out: str | None = None) -> DataFrame:
    """Alerts per (1-hour event-time window, category) under a 1-hour watermark."""
    src = read_events_stream(spark, events_path)
    counts = (
        alert_stream(src)
        .withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", WINDOW).alias("w"), "category")
        .agg(F.count("*").alias("n_alerts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "category", "n_alerts")
    )
    out = out or scratch_dir(spark, "counts")  # the same folder again resumes the query
    _run(_upsert_log(counts, out + "/data", out + "/ckpt", ["window_start", "window_end", "category"]))
    return latest_state(spark, out + "/data", ["window_start", "window_end", "category"])


# ------------------------------------------------------------------ T2
def dedup_alerts(spark: SparkSession, events_path: str, out: str | None = None) -> DataFrame:
    """Drop repeats of (project, category, package) arriving within the watermark delay."""
    src = read_events_stream(spark, events_path)
    dedup = (
        alert_stream(src)
        .withWatermark("ts", WATERMARK)
        .dropDuplicatesWithinWatermark(["project_id", "category", "package"])
        .select("project_id", "category", "package", "severity")
    )
    out = out or scratch_dir(spark, "dedup")  # the same folder again resumes the query
    q = (
        dedup.writeStream.format("parquet").outputMode("append").option("path", out + "/data")
        .option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start()
    )
    _run(q)
    return spark.read.parquet(out + "/data")


# ------------------------------------------------------------------ T4
def running_scores(spark: SparkSession, events_path: str, out: str | None = None) -> DataFrame:
    """T4: per-project running severity counts and health score."""
    src = read_events_stream(spark, events_path)
    a = alert_stream(src).withColumn("sev", report.counted_severity())
    counts = a.groupBy("project_id").agg(
        *[F.count_if(F.col("sev") == s).alias(f"n_{s.lower()}") for s in report.SEVERITIES]
    )
    out = out or scratch_dir(spark, "scores")  # the same folder again resumes the query
    _run(_upsert_log(counts, out + "/data", out + "/ckpt", ["project_id"]))
    st = latest_state(spark, out + "/data", ["project_id"])
    score = F.lit(100)
    for s in report.SEVERITIES:
        score = score - F.col(f"n_{s.lower()}") * report.SCORE_WEIGHTS[s]
    score = F.greatest(F.lit(0), score).cast("int")
    return st.withColumn("security_score", score).withColumn("band", report.score_band(F.col("security_score")))


# ------------------------------------------------------------------ T1
def land_manifests(spark: SparkSession, manifests: DataFrame, landing: str) -> None:
    """Add manifests to the arrival folder ``landing``, each (project, path, content) once.

    An arrival is known by its project, path and content hash; what the folder holds already, or the
    same call repeats, adds nothing, so a landing can be tried again after a failure.
    """
    key = ["project_id", "path", "content_hash"]
    new = manifests.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(key)
    try:
        new = new.join(spark.read.parquet(landing).select(*key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing landed yet
            raise
    new.select(*manifests.columns, "content_hash").write.mode("append").parquet(landing)


def stream_outdated(spark: SparkSession, landing: str, releases: DataFrame, out: str | None = None) -> DataFrame:
    """Manifests landing as files in ``landing`` -> parsed rows -> staleness alerts, per micro-batch.

    The latest-release lookup is computed once; each micro-batch is parsed once and joined to it; its alerts go to the
    batch's own folder.  Batches are bounded by bytes (``BATCH_BYTES``).  With the same ``out`` again, the query resumes: only files that have arrived
    since are read.  Returns all alerts so far.
    """
    out = out or scratch_dir(spark, "outdated")
    latest = written(outdated.latest_release(releases), "latest")  # once, not again in each micro-batch
    schema = spark.read.parquet(landing).schema
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(landing)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        deps, _ = M.parse_manifests(batch.drop("ecosystem", "content_hash"))
        deps = deps.persist()  # the lookup of the batch's packages and its alerts read it
        _write_batch(outdated.alerts_behind(deps, latest), out + "/alerts", batch_id)
        deps.unpersist()

    q = (
        src.writeStream.foreachBatch(per_batch).option("checkpointLocation", out + "/ckpt")
        .trigger(availableNow=True).start()
    )
    _run(q)
    try:
        return spark.read.parquet(out + "/alerts").drop("batch_id")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], outdated_schema())  # no batch produced any alert


def outdated_schema() -> str:
    return ("project_id bigint, ecosystem string, type string, package string, installed_version string, "
            "latest_version string, severity string, message string")
