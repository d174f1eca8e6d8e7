"""Streams run to completion over the event table and read back."""

import uuid

from pyspark.sql import functions as F

from plumbline.functions.numeric import fixed, micros
from plumbline.operators.shared import materialized
from plumbline.plans import anomaly, incidents
from plumbline.session import shared_dir
from plumbline.streaming import folds, sources, windows

from .base import ORACLES, register
from .ctes import fx, with_
from .ingest import STEP, TTL
from .rules import RECOVERED, TRACKED, feature_rows

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(w):
    raw = sources.table_stream(w.spark, w.folder, EVENTS, "events.parquet")
    return raw.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"), "value")


def fresh(w, name: str) -> str:
    return f"{shared_dir(w.spark)}/{name}-{uuid.uuid4().hex[:8]}"


def finished(w, df, name):
    base = fresh(w, name)
    query = sources.to_files(df, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return w.spark.read.parquet(f"{base}/out")


@register("stream_quarter_hours", with_("ev", select=f"""
  SELECT event_type, epoch_us(b) AS bucket_us, count(*) AS readings, {fx('avg(value)', 4)} AS mean FROM (
    SELECT *, time_bucket(INTERVAL 15 MINUTE, at) AS b FROM ev) GROUP BY event_type, b
  HAVING b + INTERVAL 15 MINUTE <= (SELECT max(at) FROM ev) - INTERVAL 1 HOUR"""))
def stream_quarter_hours(w):
    out = finished(w, windows.tumbling(events(w), ["event_type"], "at", "value"), "quarters")
    return out.select("event_type", micros("bucket").alias("bucket_us"), "readings", fixed("mean", 4).alias("mean"))


@register("stream_bursts", with_("ev", ("g", """
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY at) AS burst FROM (
    SELECT *, epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY event_type ORDER BY at)) AS gap FROM ev)"""), select="""
  SELECT event_type, count(*) AS burst_size, epoch_us(max(at)) AS last_us FROM g GROUP BY event_type, burst
  HAVING max(at) + INTERVAL 30 MINUTE <= (SELECT max(at) FROM ev) - INTERVAL 1 HOUR"""))
def stream_bursts(w):
    out = finished(w, windows.bursts(events(w), ["event_type"], "at", "30 minutes"), "bursts")
    return out.select("event_type", "burst_size", micros("last_at").alias("last_us"))


@register("stream_spaced_events", with_("ev", STEP, ("r", f"""
  SELECT event_type, rn, t AS last, true AS kept, event_id FROM n WHERE rn = 1 UNION ALL
  SELECT n.event_type, n.rn, CASE WHEN n.t - r.last >= {TTL} THEN n.t ELSE r.last END, n.t - r.last >= {TTL}, n.event_id
  FROM r JOIN n ON n.event_type = r.event_type AND n.rn = r.rn + 1"""), recursive=True, select="SELECT event_type, event_id FROM r WHERE kept"))
def stream_spaced_events(w):
    rows = events(w).select("event_type", "event_id", "at")
    fold = folds.Fold(w.spark, fresh(w, "spaced"), folds.spaced(["event_type"], "at", TTL, "event_id"),
                      "event_type string, event_id bigint, at timestamp")
    fold.start(rows).awaitTermination()
    return fold.output().select("event_type", "event_id")


def in_batches(w, rows, name: str, fold, parts: int = 4):
    """What the fold gives for the rows as a stream of ``parts`` micro-batches in the order of their times.

    A batch is all the files that have come since the last one, so as many tasks write it as its rows have partitions.
    """
    folder = fresh(w, name)
    kept = materialized(rows, name)
    ends = kept.agg(F.min(F.unix_micros("at")).alias("first"), F.max(F.unix_micros("at")).alias("last")).first()
    step = (ends["last"] - ends["first"]) // parts + 1
    for i in range(parts):
        since, until = (F.timestamp_micros(F.lit(ends["first"] + n * step)) for n in (i, i + 1))
        kept.filter((F.col("at") >= since) & (F.col("at") < until)).write.mode("append").parquet(folder)
        fold.start(w.spark.readStream.schema(kept.schema).parquet(folder)).awaitTermination()
    return fold.output()


@register("stream_merged", with_("ev", select="""
  SELECT user_id, event_id, event_type, epoch_us(at) AS at_us FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at DESC, event_id DESC) = 1"""))
def stream_merged(w):
    """The newest event of every user, merged over four micro-batches."""
    rows = w.events.select("user_id", "event_id", "event_type", "at")
    fold = folds.Fold(w.spark, fresh(w, "merged"), folds.merged(["user_id"], ["at", "event_id"]),
                      "user_id bigint, event_id bigint, event_type string, at timestamp", folds.MERGED_SETTLED)
    return in_batches(w, rows, "users", fold).select("user_id", "event_id", "event_type", micros("at").alias("at_us"))


@register("stream_incidents", with_("metrics alerts", TRACKED, *RECOVERED, ("ended", """
  SELECT t.*, (SELECT min(r.at) FROM rec r WHERE r.repo_id = t.repo_id AND r.type = t.type AND r.scope = t.scope
    AND r.subject_id = t.subject_id AND r.at > t.at) AS closed FROM tracked t"""), select="""
  SELECT repo_id, type, scope, subject_id, CASE WHEN closed IS NULL THEN 'open' ELSE 'closed' END AS status,
    arg_max(severity, (at, sha)) AS severity, epoch_us(min(at)) AS opened_us, epoch_us(closed) AS closed_us,
    arg_min(title, (at, sha)) AS opened_alert_title, arg_max(title, (at, sha)) AS latest_alert_title, count(*) AS alert_count
  FROM ended GROUP BY repo_id, type, scope, subject_id, closed"""))
def stream_incidents(w):
    """The incident lifecycle over four micro-batches of alerts and recoveries."""
    rows = incidents.tracked_alerts(w.alerts).withColumn("kind", F.lit("alert")).unionByName(
        incidents.index_recoveries(anomaly.assess_indexes(w.metrics)).withColumn("kind", F.lit("recovery")), allowMissingColumns=True)
    fold = folds.Fold(w.spark, fresh(w, "incidents"), folds.incident_fold, folds.INCIDENT_STATE, folds.INCIDENT_SETTLED)
    return in_batches(w, rows, "signals", fold).select(*incidents.KEY, "status", "severity", micros("opened_at").alias("opened_us"), micros("closed_at").alias("closed_us"),
                                "opened_alert_title", "latest_alert_title", "alert_count")


@register("stream_drift", ORACLES["embedding_drift"])
def stream_drift(w):
    """Drift of module features over four micro-batches; the state is the last snapshot of each module."""
    fold = folds.Fold(w.spark, fresh(w, "drift"), folds.module_drift, folds.DRIFT_STATE)
    return in_batches(w, feature_rows(w), "features", fold).select("repo_id", "module", micros("at").alias("at_us"), "distance", "composite", "severity")
