"""Component lists and reports (survey J5, J14, A20, T1, T3, P5, P13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import bands
from ..functions.numeric import fixed
from ..operators.latest import latest_per_key, top_per_key
from .fleet import count_where

FRAMES = {"6": 6, "12": 12, "24": 24, "all": 96}
TREND_KEYS = {"code_entropy_index": "entropy_index", "pressure_index": "pressure_index",
              "ai_risk_score": "ai_risk", "cyclomatic": "cyclomatic"}


def component_list(metrics: DataFrame) -> DataFrame:
    """Components of every repository with mean complexity and risk of their
    symbols and the module's latest indexes (J5).

    Both sides are reduced to one row per component before the join; joining
    symbols to module rows first would multiply them and leave the means as
    they are.
    """
    symbols = latest_per_key(metrics.filter(F.col("scope") == "symbol"), ["repo_id", "subject_id", "key"], ["at", "sha"],
                             ["value", "module", "at"])
    of = lambda k: F.avg(F.when(F.col("key") == k, F.col("value")))
    mine = symbols.groupBy("repo_id", F.coalesce("module", F.lit("root")).alias("component")).agg(
        fixed(of("cyclomatic"), 2).alias("avg_cyclomatic"), fixed(of("ai_risk_score"), 2).alias("avg_ai_risk"),
        F.max("at").alias("_symbol_at"))
    modules = metrics.filter(F.col("scope") == "module")
    order = F.struct("at", "sha")
    last = lambda k: F.max_by("value", F.when(F.col("key") == k, order))
    theirs = modules.groupBy("repo_id", F.col("subject_id").alias("component")).agg(
        fixed(last("code_entropy_index"), 2).alias("entropy_index"), fixed(last("pressure_index"), 2).alias("pressure_index"),
        F.max("at").alias("_module_at"))
    return mine.join(theirs, ["repo_id", "component"], "left").select(
        "repo_id", "component", "avg_cyclomatic", "avg_ai_risk", "entropy_index", "pressure_index",
        F.greatest("_symbol_at", "_module_at").alias("last_seen"))


def component_summary(metrics: DataFrame) -> DataFrame:
    """Means over the whole history of a component and its latest indexes."""
    of = lambda k: fixed(F.avg(F.when(F.col("key") == k, F.col("value"))), 2)
    order = F.struct("at", "sha")
    is_module = F.col("scope") == "module"
    last = lambda k: fixed(F.max_by("value", F.when(is_module & (F.col("key") == k), order)), 2)
    return metrics.filter(F.col("module").isNotNull()).groupBy("repo_id", F.col("module").alias("component")).agg(
        of("cyclomatic").alias("avg_cyclomatic"), of("ai_risk_score").alias("avg_ai_risk"),
        of("nesting_depth").alias("avg_nesting"), last("code_entropy_index").alias("entropy_index"),
        last("pressure_index").alias("pressure_index"))


def component_trend(metrics: DataFrame, frames: int = 12) -> DataFrame:
    """Readings of each component folded to one frame per time.

    The newest ``8 * frames`` readings are folded, and of those frames the
    newest ``frames`` are kept.
    """
    rows = metrics.filter(F.col("key").isin(list(TREND_KEYS)) & F.col("module").isNotNull()).select(
        "repo_id", F.col("module").alias("component"), "at", "sha", "scope", "subject_id", "key", "value")
    key = ["repo_id", "component"]
    newest = top_per_key(rows, key, [F.desc("at"), F.desc("sha"), F.desc("scope"), F.desc("subject_id"), F.desc("key")], frames * 8)
    order = F.struct("sha", "scope", "subject_id")
    folded = newest.groupBy(*key, "at").agg(*[
        F.coalesce(F.max_by("value", F.when(F.col("key") == k, order)), F.lit(0.0)).alias(n) for k, n in TREND_KEYS.items()])
    return top_per_key(folded, key, [F.desc("at")], frames).drop("rank")


def component_readings(metrics: DataFrame, repo_id: str, component: str, n: int = 100) -> DataFrame:
    """The newest readings of one component."""
    mine = (F.col("repo_id") == repo_id) & (F.col("module") == component)
    return metrics.filter(mine).orderBy(F.desc("at"), F.desc("sha"), F.desc("subject_id"), F.desc("key")).limit(n)


def touches_component(component: str) -> Column:
    """Activity paths that belong to a component (P5)."""
    p = F.col("file_path")
    return (p == component) | p.startswith(f"{component}/") | p.contains(f"/{component}/") | p.contains(f"/{component}.")


def component_activity(activity: DataFrame, repo_id: str, component: str, n: int = 16) -> DataFrame:
    mine = (F.col("repo_id") == repo_id) & touches_component(component)
    return activity.filter(mine).orderBy(F.desc("at"), F.desc("event_id")).limit(n)


def component_languages(activity: DataFrame, repo_id: str, component: str, n: int = 8) -> DataFrame:
    """Lane counts per language of one component over its whole activity."""
    mine = (F.col("repo_id") == repo_id) & touches_component(component)
    full = F.col("parser_status").isin(S.FULL_STATUSES)
    return activity.filter(mine).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        count_where(F.col("parser_status") == "unsupported").alias("watched_only_events"),
        count_where(full).alias("full_events"), F.count(F.lit(1)).alias("total_events"),
    ).orderBy(F.desc("total_events"), "language").limit(n)


def component_alerts(alerts: DataFrame, repo_id: str, component: str, n: int = 8) -> DataFrame:
    ev = F.col("evidence")
    mine = (F.col("repo_id") == repo_id) & ((ev["module"] == component) | ev["filePath"].startswith(component))
    return alerts.filter(mine).orderBy(F.desc("at"), F.desc("sha")).limit(n)


def component_notes(summary: DataFrame, alerts: DataFrame) -> DataFrame:
    """Advice codes per component: high pressure, no direct alerts."""
    raised = alerts.groupBy("repo_id", F.col("evidence.module").alias("component")).agg(F.count(F.lit(1)).alias("alert_count"))
    return summary.join(raised, ["repo_id", "component"], "left").select(
        "repo_id", "component", bands.component_notes("pressure_index", "alert_count").alias("notes"))


def repo_modules(metrics: DataFrame, n: int = 8) -> DataFrame:
    """The heaviest components of every repository report."""
    rows = component_list(metrics).select("repo_id", F.col("component").alias("name"), F.col("pressure_index").alias("pressure"),
                                          F.col("entropy_index").alias("entropy"), F.col("avg_ai_risk").alias("ai_risk"))
    order = [F.desc_nulls_last("pressure"), F.desc_nulls_last("entropy"), F.col("name")]
    return top_per_key(rows, ["repo_id"], order, n)


def repo_report_notes(listed: DataFrame) -> DataFrame:
    """Advice codes of every repository in a ``repo_list`` result."""
    return listed.select("repo_id", bands.repo_notes("coverage_percent", "activity_24h", "entropy_index").alias("notes"))


def repo_languages(counts: DataFrame, n: int = 8) -> DataFrame:
    return top_per_key(counts, ["repo_id"], [F.desc("total_events"), F.col("language")], n).drop("rank")


def entropy_current(metrics: DataFrame) -> DataFrame:
    """Latest entropy index, posture and contributors per repository."""
    from .fleet import latest_repo_values

    values = latest_repo_values(metrics, S.ENTROPY_KEYS).fillna(0.0)
    return values.withColumn("posture", bands.entropy_posture("code_entropy_index"))


def entropy_trend(metrics: DataFrame, size: str = "15 minutes", n: int = 16) -> DataFrame:
    """Mean index per quarter of an hour, the last sixteen per repository."""
    rows = metrics.filter((F.col("scope") == "repo") & (F.col("key") == "code_entropy_index"))
    means = rows.groupBy("repo_id", F.window("at", size)["start"].alias("bucket")).agg(fixed(F.avg("value"), 2).alias("entropy_index"))
    return top_per_key(means, ["repo_id"], [F.desc("bucket")], n).drop("rank")


def entropy_modules(metrics: DataFrame, n: int = 10) -> DataFrame:
    """Modules with the highest latest index, their risk and last sight."""
    rows = metrics.filter((F.col("scope") == "module") & F.col("key").isin("code_entropy_index", "ai_risk_score"))
    order = F.struct("at", "sha")
    is_entropy, is_risk = F.col("key") == "code_entropy_index", F.col("key") == "ai_risk_score"
    found = rows.groupBy("repo_id", F.col("subject_id").alias("module")).agg(
        F.max_by("value", F.when(is_entropy, order)).alias("_e"), F.max(F.when(is_entropy, F.col("at"))).alias("_e_at"),
        F.max_by("value", F.when(is_risk, order)).alias("_r"), F.max(F.when(is_risk, F.col("at"))).alias("_r_at"),
    ).filter(F.col("_e").isNotNull())
    top = top_per_key(found, ["repo_id"], [F.desc("_e"), F.col("module")], n)
    return top.select("repo_id", "module", fixed("_e", 2).alias("entropy_index"),
                      fixed(F.coalesce("_r", F.lit(0.0)), 2).alias("ai_risk"), F.greatest("_e_at", "_r_at").alias("last_seen"))
