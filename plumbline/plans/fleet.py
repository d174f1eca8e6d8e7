"""Repository lists, coverage and the fleet overview (survey J1, J2, J9, A8, A11-A13, A21, T1, T6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import bands
from ..functions.numeric import fixed
from ..operators.timegrid import hour_grid


def since(at, as_of: Column, interval: str) -> Column:
    return F.col(at) >= as_of - F.expr(f"INTERVAL {interval}")


def live(repos: DataFrame) -> DataFrame:
    return repos.filter(F.col("archived_at").isNull())


def of_live_repos(df: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of repositories that are not archived."""
    return df.join(live(repos).select("repo_id"), "repo_id", "left_semi")


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def coverage_counts() -> list[Column]:
    """Event counts by analysis lane and the covered share in percent."""
    full = F.col("parser_status").isin(S.FULL_STATUSES)
    total = F.count(F.lit(1))
    return [
        total.cast("bigint").alias("total_events"),
        count_where(F.col("parser_status") == "unsupported").alias("watched_only_events"),
        count_where(full).alias("full_events"),
        count_where(F.col("parser_status") == "analyzed").alias("analyzed_events"),
        fixed(F.try_divide(F.count_if(full) * 100.0, total), 1).alias("coverage_percent"),
    ]


def repo_coverage(activity: DataFrame, as_of: Column) -> DataFrame:
    return activity.filter(since("at", as_of, "24 HOURS")).groupBy("repo_id").agg(*coverage_counts())


def language_coverage(activity: DataFrame, as_of: Column, top: int = 10) -> DataFrame:
    """Coverage per language of the last day, most watched-only first."""
    named = activity.filter(since("at", as_of, "24 HOURS")).withColumn(
        "language", F.coalesce("language", F.lit("unknown")))
    return named.groupBy("language").agg(*coverage_counts()).orderBy(
        F.desc("watched_only_events"), F.desc("total_events"), "language").limit(top)


def latest_repo_values(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Latest repository-level value per wanted key, one column each.

    The key filter sits below the aggregation, so it reaches the scan; all
    wanted keys share one shuffle.
    """
    rows = metrics.filter((F.col("scope") == "repo") & F.col("key").isin(keys))
    order = F.struct("at", "sha")
    return rows.groupBy("repo_id").agg(*[
        F.max_by("value", F.when(F.col("key") == k, order)).alias(k) for k in keys])


def repo_list(repos: DataFrame, metrics: DataFrame, activity: DataFrame, as_of: Column,
              include_archived: bool = False) -> DataFrame:
    """Repositories with latest indexes and one-day coverage (GET /repos)."""
    shown = repos.filter(F.lit(include_archived) | F.col("archived_at").isNull())
    values = latest_repo_values(metrics, ["code_entropy_index", "pressure_index"])
    cover = repo_coverage(activity, as_of)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return shown.join(values, "repo_id", "left").join(cover, "repo_id", "left").select(
        *[F.col(c) for c in repos.columns],
        F.col("code_entropy_index").alias("entropy_index"), "pressure_index",
        zero("total_events").alias("activity_24h"), zero("full_events").alias("analyzable_events"),
        zero("analyzed_events").alias("analyzed_events"), zero("watched_only_events").alias("unsupported_events"),
        F.coalesce("coverage_percent", F.lit(0.0)).alias("coverage_percent"),
    )


def overview_repos(repos: DataFrame, metrics: DataFrame, alerts: DataFrame, activity: DataFrame,
                   as_of: Column) -> DataFrame:
    """Live repositories with component and alert figures (the overview's main list)."""
    # distinct modules per repo in two steps: no expansion, partial aggregation on both
    modules = metrics.select("repo_id", F.coalesce("module", F.lit("root")).alias("module")).groupBy(
        "repo_id", "module").count().groupBy("repo_id").agg(F.count(F.lit(1)).alias("component_count"))
    seen = alerts.groupBy("repo_id").agg(
        F.max_by("severity", F.struct("at", "sha")).alias("latest_severity"), F.max("at").alias("latest_alert_at"),
        count_where(since("at", as_of, "24 HOURS")).alias("alert_count"))
    listed = repo_list(repos, metrics, activity, as_of)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return listed.join(modules, "repo_id", "left").join(seen, "repo_id", "left").select(
        *listed.columns, zero("component_count"), "latest_severity", "latest_alert_at", zero("alert_count"),
        F.coalesce("latest_alert_at", "created_at").alias("sort_at"))


def alert_signals(alerts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Seven-day signal counts per repository."""
    return alerts.filter(since("at", as_of, f"{days} DAYS")).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("week_alerts"),
        count_where(F.col("type").isin(S.ARCH_SIGNALS)).alias("arch_signals"),
        count_where(F.col("type") == "SEMANTIC_DUPLICATION").alias("duplication_signals"),
        count_where(F.col("type") == "VOLATILITY_ZONE").alias("volatility_signals"))


def classified_repos(repos: DataFrame, metrics: DataFrame, alerts: DataFrame, activity: DataFrame,
                     as_of: Column) -> DataFrame:
    """Overview repositories with their pattern (M20, overview variant)."""
    listed = overview_repos(repos, metrics, alerts, activity, as_of)
    zero = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0)).cast(t)
    joined = listed.join(alert_signals(alerts, as_of), "repo_id", "left").select(
        *listed.columns, zero("entropy_index", "double").alias("_e"), zero("pressure_index", "double").alias("_p"),
        zero("arch_signals").alias("arch_signals"), zero("duplication_signals").alias("duplication_signals"),
        zero("volatility_signals").alias("volatility_signals"))
    found = bands.pattern(bands.FLEET_PATTERN, "_p", "_e", "alert_count",
                          [("arch_signals", "_p"), ("duplication_signals", "_e"), ("volatility_signals", "_p")])
    return joined.withColumn("pattern", found)


def fleet_patterns(classified: DataFrame) -> DataFrame:
    """Pattern groups with averages and members, strongest first."""
    rank = F.struct((-F.unix_micros("sort_at")).alias("s"), F.col("repo_id"))
    groups = classified.groupBy(F.col("pattern.label").alias("label")).agg(
        F.count(F.lit(1)).alias("repo_count"),
        F.avg("_e").alias("avg_entropy"), F.avg("_p").alias("avg_pressure"),
        F.min_by("pattern.dominant", rank).alias("dominant_signals"))
    rounded = groups.select("label", "repo_count", fixed("avg_entropy", 2).alias("avg_entropy"),
                            fixed("avg_pressure", 2).alias("avg_pressure"), "dominant_signals")
    return rounded.withColumn("weight", F.col("avg_pressure") + F.col("avg_entropy") + F.col("repo_count") * 6).orderBy(
        F.desc("weight"))


def pattern_members(classified: DataFrame) -> DataFrame:
    """One row per repository and pattern, instead of one growing list per pattern."""
    return classified.select(F.col("pattern.label").alias("label"), "repo_id", "name")


def overview_stats(repos: DataFrame, metrics: DataFrame, alerts: DataFrame, activity: DataFrame,
                   as_of: Column) -> DataFrame:
    """Eleven fleet figures in one row (A12): one pass per base table, each
    reduced to one row before the one-row results meet."""
    day = since("at", as_of, "24 HOURS")
    ours = live(repos).select("repo_id")
    of_ours = lambda df: df.join(ours, "repo_id", "left_semi")
    values = latest_repo_values(of_ours(metrics), ["code_entropy_index", "pressure_index"]).agg(
        fixed(F.avg("code_entropy_index"), 2).alias("avg_entropy"), fixed(F.avg("pressure_index"), 2).alias("avg_pressure"),
        fixed(F.max("code_entropy_index"), 2).alias("max_entropy"), fixed(F.max("pressure_index"), 2).alias("max_pressure"))
    covered = repo_coverage(of_ours(activity), as_of).agg(
        fixed(F.avg("coverage_percent"), 1).alias("avg_coverage"),
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("activity_24h"),
        F.coalesce(F.sum("watched_only_events"), F.lit(0)).alias("watched_only_24h"))
    raised = of_ours(alerts).filter(day).agg(
        F.count(F.lit(1)).alias("alerts_24h"), count_where(F.col("severity") == "error").alias("critical_24h"))
    signals = of_ours(metrics).filter(day).agg(F.count(F.lit(1)).alias("signals_24h"))
    # every part is a single row; stacked, one aggregation lines their figures up
    out = ours.agg(F.count(F.lit(1)).alias("repo_count"))
    for part in (values, covered, raised, signals):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def recent_commits(commits: DataFrame, repo_id: str, n: int = 50) -> DataFrame:
    """The newest commits of one repository."""
    return commits.filter(F.col("repo_id") == repo_id).orderBy(F.desc("ts"), F.desc("sha")).limit(n)


def commit_alerts(commits: DataFrame, alerts: DataFrame) -> DataFrame:
    """Commits that raised alerts, with counts by severity."""
    counts = alerts.groupBy("repo_id", "sha").agg(
        F.count(F.lit(1)).alias("alert_count"), count_where(F.col("severity") == "error").alias("error_count"))
    return commits.join(counts, ["repo_id", "sha"])


def recent_alerts(alerts: DataFrame, repos: DataFrame, n: int = 16) -> DataFrame:
    return of_live_repos(alerts, repos).orderBy(F.desc("at"), F.desc("sha")).limit(n)


def recent_activity(activity: DataFrame, repos: DataFrame, n: int = 14) -> DataFrame:
    named = live(repos).select("repo_id", F.col("name").alias("repo_name"))
    return activity.join(named, "repo_id").orderBy(F.desc("at"), F.desc("event_id")).limit(n)


def language_trend(activity: DataFrame, repos: DataFrame, as_of: Column, languages: int = 6,
                   hours: int = 24) -> DataFrame:
    """Hourly counts of the leading languages on a dense grid.

    Events are counted per (language, hour) first and joined to the grid by
    equality, instead of matching each event against each bucket's range.
    """
    ours = of_live_repos(activity, repos).withColumn("language", F.coalesce("language", F.lit("unknown")))
    leading = ours.filter(since("at", as_of, "24 HOURS")).groupBy("language").agg(*coverage_counts()).orderBy(
        F.desc("watched_only_events"), F.desc("total_events"), "language").limit(languages).select("language")
    start = F.date_trunc("hour", as_of - F.expr(f"INTERVAL {hours - 1} HOURS"))
    full = F.col("parser_status").isin(S.FULL_STATUSES)
    counted = ours.filter(F.col("at") >= start).groupBy("language", F.date_trunc("hour", "at").alias("bucket")).agg(
        count_where(F.col("parser_status") == "unsupported").alias("watched_only_events"),
        F.count(F.lit(1)).alias("total_events"), count_where(full).alias("full_events"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return hour_grid(leading, as_of, hours).join(counted, ["language", "bucket"], "left").select(
        "language", "bucket", zero("watched_only_events"), zero("total_events"), zero("full_events"))


def trend_totals(trend: DataFrame) -> DataFrame:
    """Per language: totals and the dense list of hourly points.

    The list holds one entry per grid hour, so its length is fixed."""
    share = F.coalesce(fixed(F.try_divide(F.col("watched_only_events") * 100.0, F.col("total_events")), 1), F.lit(0.0))
    point = F.struct("bucket", "watched_only_events", "total_events", "full_events", share.alias("watched_only_percent"))
    return trend.groupBy("language").agg(
        F.sum("watched_only_events").alias("watched_only_total"), F.sum("total_events").alias("events_total"),
        F.array_sort(F.collect_list(point)).alias("points")
    ).orderBy(F.desc("watched_only_total"), F.desc("events_total"), "language")


def languages_of_repo(activity: DataFrame, as_of: Column, n: int = 8) -> DataFrame:
    """Lane counts per language of one repository report."""
    full = F.col("parser_status").isin(S.FULL_STATUSES)
    return activity.filter(since("at", as_of, "24 HOURS")).groupBy(
        "repo_id", F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        count_where(F.col("parser_status") == "unsupported").alias("watched_only_events"),
        count_where(full).alias("full_events"), F.count(F.lit(1)).alias("total_events"))
