"""Rankings and tallies of the dashboards (survey section 2.14, F39)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.numeric import finite, fixed
from .components import component_list


def fleet_ranking(overview: DataFrame, n: int = 6) -> DataFrame:
    """Repositories by pressure, severity and alerts."""
    weight = finite("pressure_index") + bands.severity_weight("latest_severity") * 0.35 + F.col("alert_count") * 6
    return overview.withColumn("weight", fixed(weight, 6)).orderBy(F.desc("weight"), "repo_id").limit(n)


def surface_ranking(overview: DataFrame, n: int = 6) -> DataFrame:
    weight = (bands.surface_weight("latest_severity") + finite("pressure_index") + finite("entropy_index") * 0.35
              + F.col("alert_count") * 6 + F.col("activity_24h") * 0.4)
    return overview.withColumn("weight", fixed(weight, 6)).orderBy(F.desc("weight"), "repo_id").limit(n)


def component_ranking(metrics: DataFrame, repo_id: str, n: int = 8) -> DataFrame:
    rows = component_list(metrics.filter(F.col("repo_id") == repo_id))
    weight = finite("pressure_index") * 1.2 + finite("avg_ai_risk") + finite("avg_cyclomatic") * 3 + finite("entropy_index") * 0.65
    return rows.withColumn("weight", fixed(weight, 6)).orderBy(F.desc("weight"), "component").limit(n)


def component_means(metrics: DataFrame) -> DataFrame:
    """Mean risk and complexity over the components of each repository."""
    return component_list(metrics).groupBy("repo_id").agg(
        fixed(F.avg(finite("avg_ai_risk")), 6).alias("avg_ai_risk"), fixed(F.avg(finite("avg_cyclomatic")), 6).alias("avg_cyclomatic"))


def signal_mix(alerts: DataFrame, n: int = 6) -> DataFrame:
    """Most frequent alert labels."""
    label = bands.alert_label("type", F.col("evidence.heuristicCategory"))
    return alerts.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "label").limit(n)


def severity_tally(overview: DataFrame) -> DataFrame:
    return overview.groupBy(bands.severity_label("latest_severity").alias("posture")).agg(F.count(F.lit(1)).alias("repos"))


def status_tally(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("status", F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("total"))


def category_list(alerts: DataFrame) -> DataFrame:
    found = bands.alert_category("type", F.col("evidence.heuristicCategory"))
    return alerts.select(found.alias("category")).filter(F.col("category").isNotNull()).distinct()


def watch_rollup(listed: DataFrame) -> DataFrame:
    """Watch-state counts, mean coverage and unsupported events of live repositories."""
    states = [F.count_if(F.col("watch_state") == s).alias(s) for s in ("active", "pending", "blocked", "inactive")]
    return listed.filter(F.col("archived_at").isNull()).agg(
        F.count(F.lit(1)).alias("repos"), *states, F.round(F.avg("coverage_percent"), 0).cast("bigint").alias("coverage_avg"),
        F.sum("unsupported_events").alias("unsupported_events"))


def idle_surfaces(listed: DataFrame) -> DataFrame:
    watched = F.col("watch_enabled") & (F.col("watch_state") == "active")
    return listed.filter(watched & (F.col("activity_24h") == 0)).select("repo_id", "name")


def first_activity(recent: DataFrame, n: int = 6) -> DataFrame:
    """The newest entry per repository among the recent activity."""
    keep = [c for c in recent.columns if c != "repo_id"]
    one = recent.groupBy("repo_id").agg(F.max_by(F.struct(*keep), F.struct("at", "event_id")).alias("r")).select("repo_id", "r.*")
    return one.orderBy(F.desc("at"), F.desc("event_id")).limit(n)


def minute_series(metrics: DataFrame, repo_id: str, component: str, n: int = 80) -> DataFrame:
    """Entropy and pressure of a component folded per minute of the day from its newest readings."""
    from .components import component_readings

    rows = component_readings(metrics, repo_id, component, n)
    order = F.struct("at", "sha", "subject_id")
    last = lambda k: F.coalesce(F.max_by("value", F.when(F.col("key") == k, order)), F.lit(0.0))
    return rows.groupBy(F.date_format("at", "HH:mm").alias("label")).agg(
        last("code_entropy_index").alias("entropy"), last("pressure_index").alias("pressure"))


def activity_facts(activity: DataFrame) -> DataFrame:
    """Reason and tone of every activity row."""
    return activity.select("event_id", bands.activity_reason("parser_status", "alert_count").alias("reason"),
                           bands.activity_tone("parser_status", "alert_count").alias("tone"),
                           bands.fleet_tone("parser_status", "alert_count").alias("fleet_tone"))
