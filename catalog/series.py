"""Lookbacks, rolling baselines and anomalies."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import micros
from plumbline.operators.running import asof_join, open_intervals
from plumbline.plans import anomaly

from .base import register
from .ctes import fx, with_

SERIES_SQL = {
    "entropy": "key = 'code_entropy_index' AND scope IN ('repo', 'module')",
    "pressure": "key = 'pressure_index' AND scope = 'module'",
}


def series(kind: str):
    part = "PARTITION BY repo_id, scope, subject_id, key ORDER BY at"
    return [
        ("s", f"SELECT repo_id, scope, subject_id, key, at, sha, value FROM metrics WHERE {SERIES_SQL[kind]}"),
        ("b", f"""SELECT *,
            coalesce(last_value(value) OVER ({part} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)
              AS prev,
            coalesce(avg(value) OVER ({part} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)
              AS mean,
            coalesce(stddev_pop(value) OVER ({part} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)
              AS dev,
            count(*) OVER ({part} RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n,
            coalesce(last_value(value) OVER ({part} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 24 HOUR PRECEDING), 0)
              AS day_before
          FROM s"""),
    ]


ENTROPY_STEPS = [*series("entropy"), ("t", f"""
  SELECT *, {fx('value - prev', 2)} AS delta,
    {fx('CASE WHEN dev > 0.001 THEN (value - mean) / dev WHEN value > mean THEN 4 ELSE 0 END', 2)} AS z,
    CASE WHEN n >= 4 THEN greatest(45.0, mean + greatest(dev * 2, 6.0)) ELSE 60.0 END AS warn,
    CASE WHEN n >= 4 THEN greatest(65.0, mean + greatest(dev * 3, 10.0)) ELSE 80.0 END AS err,
    greatest(35.0, mean + greatest(dev * 1.15, 3.0)) AS clr FROM b"""), ("assessed", """
  SELECT *, CASE
      WHEN value >= err AND (prev < err - 10 OR delta >= greatest(10.0, dev * 1.5) OR z >= 3.25) THEN 'error'
      WHEN value >= warn AND (prev < warn - 8 OR delta >= greatest(6.0, dev) OR z >= 2.25) THEN 'warn' END AS anomaly
  FROM t""")]
PRESSURE_STEPS = [*series("pressure"), ("t", f"""
  SELECT *, CASE WHEN day_before <> 0 THEN day_before ELSE prev END AS base,
    {fx('value - CASE WHEN day_before <> 0 THEN day_before ELSE prev END', 2)} AS delta,
    {fx('CASE WHEN dev > 0.001 THEN (value - mean) / dev WHEN value > mean THEN 4 ELSE 0 END', 2)} AS z,
    CASE WHEN n >= 4 THEN greatest(45.0, mean + greatest(dev * 2, 7.0)) ELSE 75.0 END AS warn,
    CASE WHEN n >= 4 THEN greatest(60.0, mean + greatest(dev * 3, 12.0)) ELSE 85.0 END AS err,
    greatest(30.0, mean + greatest(dev * 1.15, 4.0)) AS clr FROM b"""), ("assessed", """
  SELECT *, CASE WHEN value >= err AND (prev < err - 10 OR delta >= 12 OR z >= 3.1) THEN 'error'
      WHEN value >= warn AND (prev < warn - 7 OR delta >= 6 OR z >= 2.1) THEN 'warn' END AS anomaly
  FROM t""")]
ASSESSED = f"""repo_id, scope, subject_id, epoch_us(at) AS at_us, value, prev AS previous_value, delta,
  {fx('mean', 2)} AS baseline_mean, {fx('dev', 2)} AS baseline_stddev, n AS baseline_samples, z AS z_score,
  {fx('warn', 2)} AS warn_threshold, {fx('err', 2)} AS error_threshold, {fx('clr', 2)} AS clear_threshold, anomaly"""


def shown(df, *extra):
    return df.select("repo_id", "scope", "subject_id", micros("at").alias("at_us"), "value", "previous_value", "delta",
                     "baseline_mean", "baseline_stddev", "baseline_samples", "z_score", "warn_threshold",
                     "error_threshold", "clear_threshold", "anomaly", *extra)


@register("entropy_anomalies", with_("metrics", *ENTROPY_STEPS, select=f"SELECT {ASSESSED} FROM assessed"))
def entropy_anomalies(w):
    return shown(anomaly.assess_entropy(w.metrics))


@register("pressure_anomalies", with_("metrics", *PRESSURE_STEPS, select=f"""
  SELECT {ASSESSED}, {fx('base', 2)} AS baseline_24h FROM assessed"""))
def pressure_anomalies(w):
    return shown(anomaly.assess_pressure(w.metrics), "baseline_24h")


@register("previous_value", with_("metrics", select="""
  SELECT repo_id, scope, subject_id, key, epoch_us(at) AS at_us, value,
    coalesce(lag(value) OVER (PARTITION BY repo_id, scope, subject_id, key ORDER BY at, sha), 0) AS previous_value
  FROM metrics"""))
def previous_value(w):
    rows = w.metrics.select(*anomaly.SERIES, "at", "sha", "value")
    return anomaly.with_previous(rows).select(*anomaly.SERIES, micros("at").alias("at_us"), "value", "previous_value")


@register("change_attribution", with_("telemetry changes", select="""
  SELECT c.change_id, c.repo_id, epoch_us(c.at) AS at_us, t.provenance, t.editor, t.session_id
  FROM changes c LEFT JOIN telemetry t ON t.repo_id = c.repo_id
    AND (t.file_path = c.file_path OR t.absolute_path = c.absolute_path)
    AND t.observed_at <= c.at AND t.observed_at >= c.at - INTERVAL 45 MINUTE
  QUALIFY row_number() OVER (PARTITION BY c.change_id ORDER BY t.observed_at DESC NULLS LAST, t.id DESC) = 1"""))
def change_attribution(w):
    from plumbline.plans.ingest import attribute_changes
    return attribute_changes(w.changes, w.telemetry).select(
        "change_id", "repo_id", micros("at").alias("at_us"), "provenance", "editor", "session_id")


@register("open_incident_count", with_("snapshots incidents", select="""
  SELECT s.repo_id, s.sha, s.scope, s.subject_id, epoch_us(s.at) AS at_us,
    (SELECT count(*) FROM incidents i WHERE i.repo_id = s.repo_id AND i.opened_at <= s.at
       AND (i.closed_at IS NULL OR i.closed_at >= s.at)) AS incident_count
  FROM snapshots s"""))
def open_incident_count(w):
    out = open_intervals(w.snapshots, w.incidents, ["repo_id"], "at", "opened_at", "closed_at", "incident_count")
    return out.select("repo_id", "sha", "scope", "subject_id", micros("at").alias("at_us"), "incident_count")


@register("snapshot_at_alert", with_("snapshots alerts", select="""
  SELECT a.repo_id, a.sha, epoch_us(a.at) AS at_us, a.type, s.entropy AS snapshot_entropy, epoch_us(s.at) AS snapshot_us
  FROM alerts a ASOF LEFT JOIN (SELECT repo_id, at, entropy FROM snapshots WHERE scope = 'repo') s
    ON s.repo_id = a.repo_id AND s.at <= a.at"""))
def snapshot_at_alert(w):
    snaps = w.snapshots.filter(F.col("scope") == "repo").select("repo_id", "at", "sha", F.col("signature.health.entropyIndex").alias("entropy"))
    out = asof_join(w.alerts.select("repo_id", "sha", "at", "type"), snaps, ["repo_id"], "at", "at", ["entropy"], name="snap", tie="sha")
    return out.select("repo_id", "sha", micros("at").alias("at_us"), "type", F.col("snap.entropy").alias("snapshot_entropy"),
                      micros(F.col("snap.at")).alias("snapshot_us"))
