"""Fleet queries."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import micros
from plumbline.operators.latest import latest_per_key, pivot_values
from plumbline.plans import fleet
from plumbline.schema import PRESSURE_KEYS

from .base import register
from .ctes import ASOF, fx, fxt, with_

FULL = "parser_status IN ('pending', 'analyzed', 'no_symbols')"
COVER = f"""count(*) AS total_events, count(*) FILTER (parser_status = 'unsupported') AS watched_only_events,
  count(*) FILTER ({FULL}) AS full_events, count(*) FILTER (parser_status = 'analyzed') AS analyzed_events,
  {fx(f"count(*) FILTER ({FULL}) * 100.0 / nullif(count(*), 0)", 1)} AS coverage_percent"""
DAY = f"at >= {ASOF} - INTERVAL 24 HOUR"
LATEST_REPO = ("latest_repo", """
  SELECT repo_id, key, value FROM metrics WHERE scope = 'repo'
  QUALIFY row_number() OVER (PARTITION BY repo_id, key ORDER BY at DESC, sha DESC) = 1""")
REPO_VALUES = ("repo_values", """
  SELECT repo_id, max(value) FILTER (key = 'code_entropy_index') AS entropy_index,
    max(value) FILTER (key = 'pressure_index') AS pressure_index FROM latest_repo GROUP BY repo_id""")
CAST_COVER = ("cover", f"SELECT repo_id, {COVER} FROM activity WHERE {DAY} GROUP BY repo_id")


def repo_list_sql(archived: bool) -> str:
    return with_(
        "repos metrics activity", LATEST_REPO, REPO_VALUES, CAST_COVER,
        select=f"""SELECT r.repo_id, r.name, r.kind, r.root_path, r.watch_enabled, r.watch_state, v.entropy_index,
          v.pressure_index, coalesce(c.total_events, 0) AS activity_24h, coalesce(c.full_events, 0) AS analyzable_events,
          coalesce(c.analyzed_events, 0) AS analyzed_events, coalesce(c.watched_only_events, 0) AS unsupported_events,
          coalesce(c.coverage_percent, 0) AS coverage_percent, epoch_us(r.created_at) AS created_us
        FROM repos r LEFT JOIN repo_values v USING (repo_id) LEFT JOIN cover c USING (repo_id)
        WHERE {'true' if archived else 'r.archived_at IS NULL'}""")


REPO_COLUMNS = ["repo_id", "name", "kind", "root_path", "watch_enabled", "watch_state", "entropy_index",
                "pressure_index", "activity_24h", "analyzable_events", "analyzed_events", "unsupported_events",
                "coverage_percent"]


@register("repo_list", repo_list_sql(False))
def repo_list(w):
    out = fleet.repo_list(w.repos, w.metrics, w.activity, w.as_of)
    return out.select(*REPO_COLUMNS, micros("created_at").alias("created_us"))


@register("repo_list_with_archived", repo_list_sql(True))
def repo_list_with_archived(w):
    out = fleet.repo_list(w.repos, w.metrics, w.activity, w.as_of, include_archived=True)
    return out.select(*REPO_COLUMNS, micros("created_at").alias("created_us"))


@register("latest_metric_values", with_("metrics", select="""
  SELECT repo_id, scope, subject_id, key, value, epoch_us(at) AS at_us FROM metrics
  QUALIFY row_number() OVER (PARTITION BY repo_id, scope, subject_id, key ORDER BY at DESC, sha DESC) = 1"""))
def latest_metric_values(w):
    out = latest_per_key(w.metrics, ["repo_id", "scope", "subject_id", "key"], ["at", "sha"], ["value", "at"])
    return out.select("repo_id", "scope", "subject_id", "key", "value", micros("at").alias("at_us"))


@register("pressure_pivot", with_("metrics", select="""
  SELECT repo_id, subject_id, """ + ", ".join(
    f"max(value) FILTER (key = '{k}') AS {k}" for k in PRESSURE_KEYS) + """
  FROM (SELECT repo_id, subject_id, key, value FROM metrics WHERE scope = 'module' AND key LIKE 'pressure_%'
        QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1)
  GROUP BY repo_id, subject_id"""))
def pressure_pivot(w):
    rows = w.metrics.filter((F.col("scope") == "module") & F.col("key").isin(PRESSURE_KEYS))
    latest = latest_per_key(rows, ["repo_id", "subject_id", "key"], ["at", "sha"], ["value"])
    return pivot_values(latest, ["repo_id", "subject_id"], "key", "value", PRESSURE_KEYS)


@register("repo_coverage", with_("activity", CAST_COVER, select="SELECT * FROM cover"))
def repo_coverage(w):
    return fleet.repo_coverage(w.activity, w.as_of)


@register("language_coverage", with_("activity", select=f"""
  SELECT coalesce(language, 'unknown') AS language, {COVER} FROM activity WHERE {DAY} GROUP BY 1
  ORDER BY watched_only_events DESC, total_events DESC, language LIMIT 10"""))
def language_coverage(w):
    return fleet.language_coverage(w.activity, w.as_of)


OVERVIEW = (LATEST_REPO, REPO_VALUES, CAST_COVER,
            ("comp", "SELECT repo_id, count(DISTINCT coalesce(module, 'root')) AS component_count FROM metrics GROUP BY 1"),
            ("seen", f"""SELECT repo_id, arg_max(severity, (at, sha)) AS latest_severity, max(at) AS latest_alert_at,
               count(*) FILTER ({DAY}) AS alert_count FROM alerts GROUP BY 1"""),
            ("overview", """
               SELECT r.repo_id, r.name, r.created_at, r.watch_enabled, r.watch_state, v.entropy_index, v.pressure_index,
                 coalesce(c.total_events, 0) AS activity_24h, coalesce(c.coverage_percent, 0) AS coverage_percent,
                 coalesce(c.watched_only_events, 0) AS unsupported_events,
                 coalesce(p.component_count, 0) AS component_count, s.latest_severity, s.latest_alert_at,
                 coalesce(s.alert_count, 0) AS alert_count, coalesce(s.latest_alert_at, r.created_at) AS sort_at
               FROM repos r LEFT JOIN repo_values v USING (repo_id) LEFT JOIN cover c USING (repo_id)
                 LEFT JOIN comp p USING (repo_id) LEFT JOIN seen s USING (repo_id) WHERE r.archived_at IS NULL"""))


@register("overview_repos", with_("repos metrics activity alerts", *OVERVIEW, select="""
  SELECT repo_id, name, entropy_index, pressure_index, activity_24h, coverage_percent, component_count,
    latest_severity, epoch_us(latest_alert_at) AS latest_alert_us, alert_count FROM overview"""))
def overview_repos(w):
    out = fleet.overview_repos(w.repos, w.metrics, w.alerts, w.activity, w.as_of)
    return out.select("repo_id", "name", "entropy_index", "pressure_index", "activity_24h", "coverage_percent",
                      "component_count", "latest_severity", micros("latest_alert_at").alias("latest_alert_us"), "alert_count")


SIGNALS = ("signals", f"""
  SELECT repo_id, count(*) FILTER (type IN ('ARCH_PRESSURE', 'ARCH_VIOLATION', 'ARCH_EMBED_DRIFT')) AS arch,
    count(*) FILTER (type = 'SEMANTIC_DUPLICATION') AS dup, count(*) FILTER (type = 'VOLATILITY_ZONE') AS vol
  FROM alerts WHERE at >= {ASOF} - INTERVAL 7 DAY GROUP BY repo_id""")
CLASSIFIED = (
    ("scored", """
      SELECT o.*, coalesce(entropy_index, 0) AS e, coalesce(pressure_index, 0) AS p,
        coalesce(arch, 0) + coalesce(pressure_index, 0) / 25 AS s0,
        coalesce(dup, 0) + coalesce(entropy_index, 0) / 30 AS s1,
        coalesce(vol, 0) + coalesce(pressure_index, 0) / 30 AS s2
      FROM overview o LEFT JOIN signals USING (repo_id)"""),
    ("strong", """
      SELECT repo_id, list(label ORDER BY score DESC, place)[1:2] AS labels FROM (
        SELECT repo_id, 0 AS place, 'Boundary Pressure' AS label, s0 AS score FROM scored UNION ALL
        SELECT repo_id, 1, 'Duplication Drift', s1 FROM scored UNION ALL
        SELECT repo_id, 2, 'Volatility Hotspots', s2 FROM scored) WHERE score > 0.5 GROUP BY repo_id"""),
    ("classified", """
      SELECT s.*, CASE WHEN p < 35 AND e < 35 AND alert_count < 3 THEN 'Stable Core'
          WHEN labels IS NULL THEN 'Mixed Drift' ELSE labels[1] END AS label,
        CASE WHEN p < 35 AND e < 35 AND alert_count < 3 THEN ['low entropy', 'low pressure']
          WHEN labels IS NULL THEN ['pressure spread', 'entropy spread'] ELSE labels END AS dominant
      FROM scored s LEFT JOIN strong USING (repo_id)"""),
)


@register("fleet_patterns", with_("repos metrics activity alerts", *OVERVIEW, SIGNALS, *CLASSIFIED, select=f"""
  SELECT label, repo_count, {fx('e', 2)} AS avg_entropy, {fx('p', 2)} AS avg_pressure, dominant_signals,
    {fx(f"{fx('p', 2)} + {fx('e', 2)} + repo_count * 6", 6)} AS weight
  FROM (SELECT label, count(*) AS repo_count, avg(e) AS e, avg(p) AS p,
    array_to_string(arg_min(dominant, (-epoch_us(sort_at), repo_id)), '|') AS dominant_signals
    FROM classified GROUP BY label)"""))
def fleet_patterns(w):
    out = fleet.fleet_patterns(fleet.classified_repos(w.repos, w.metrics, w.alerts, w.activity, w.as_of))
    from plumbline.functions.numeric import fixed
    return out.withColumn("dominant_signals", F.array_join("dominant_signals", "|")).withColumn("weight", fixed("weight", 6))


@register("pattern_members", with_("repos metrics activity alerts", *OVERVIEW, SIGNALS, *CLASSIFIED, select="""
  SELECT label, repo_id, name FROM classified"""))
def pattern_members(w):
    return fleet.pattern_members(fleet.classified_repos(w.repos, w.metrics, w.alerts, w.activity, w.as_of))


LIVE = "repo_id IN (SELECT repo_id FROM repos WHERE archived_at IS NULL)"


@register("overview_stats", with_(
    "repos metrics activity alerts", LATEST_REPO, REPO_VALUES, CAST_COVER, select=f"""
  SELECT (SELECT count(*) FROM repos WHERE archived_at IS NULL) AS repo_count,
    (SELECT count(*) FROM alerts WHERE {DAY} AND {LIVE}) AS alerts_24h,
    (SELECT count(*) FROM alerts WHERE {DAY} AND {LIVE} AND severity = 'error') AS critical_24h,
    (SELECT count(*) FROM metrics WHERE {DAY} AND {LIVE}) AS signals_24h,
    (SELECT {fx('avg(entropy_index)', 2)} FROM repo_values WHERE {LIVE}) AS avg_entropy,
    (SELECT {fx('avg(pressure_index)', 2)} FROM repo_values WHERE {LIVE}) AS avg_pressure,
    (SELECT {fx('max(entropy_index)', 2)} FROM repo_values WHERE {LIVE}) AS max_entropy,
    (SELECT {fx('max(pressure_index)', 2)} FROM repo_values WHERE {LIVE}) AS max_pressure,
    (SELECT {fx('avg(coverage_percent)', 1)} FROM cover WHERE {LIVE}) AS avg_coverage,
    (SELECT CAST(coalesce(sum(total_events), 0) AS BIGINT) FROM cover WHERE {LIVE}) AS activity_24h,
    (SELECT CAST(coalesce(sum(watched_only_events), 0) AS BIGINT) FROM cover WHERE {LIVE}) AS watched_only_24h"""))
def overview_stats(w):
    return fleet.overview_stats(w.repos, w.metrics, w.alerts, w.activity, w.as_of)


@register("recent_alerts", with_("repos alerts", select=f"""
  SELECT repo_id, sha, epoch_us(at) AS at_us, severity, type, title, recommendation FROM alerts WHERE {LIVE}
  ORDER BY at DESC, sha DESC LIMIT 16"""))
def recent_alerts(w):
    return fleet.recent_alerts(w.alerts, w.repos).select(
        "repo_id", "sha", micros("at").alias("at_us"), "severity", "type", "title", "recommendation")


@register("recent_activity", with_("repos activity", select="""
  SELECT a.event_id, a.repo_id, r.name AS repo_name, epoch_us(a.at) AS at_us, a.file_path, a.language, a.parser_status
  FROM activity a JOIN repos r ON r.repo_id = a.repo_id AND r.archived_at IS NULL
  ORDER BY a.at DESC, a.event_id DESC LIMIT 14"""))
def recent_activity(w):
    return fleet.recent_activity(w.activity, w.repos).select(
        "event_id", "repo_id", "repo_name", micros("at").alias("at_us"), "file_path", "language", "parser_status")


TREND = (
    ("ours", f"SELECT *, coalesce(language, 'unknown') AS lang FROM activity WHERE {LIVE}"),
    ("lead_lang", f"""SELECT lang FROM ours WHERE {DAY} GROUP BY lang
      ORDER BY count(*) FILTER (parser_status = 'unsupported') DESC, count(*) DESC, lang LIMIT 6"""),
    ("buckets", f"""SELECT unnest(generate_series(date_trunc('hour', {ASOF} - INTERVAL 23 HOUR),
      date_trunc('hour', {ASOF}), INTERVAL 1 HOUR)) AS bucket"""),
    ("trend", f"""SELECT l.lang AS language, b.bucket,
        count(o.event_id) FILTER (o.parser_status = 'unsupported') AS watched_only_events,
        count(o.event_id) AS total_events, count(o.event_id) FILTER (o.{FULL}) AS full_events
      FROM lead_lang l CROSS JOIN buckets b LEFT JOIN ours o
        ON o.lang = l.lang AND o.at >= b.bucket AND o.at < b.bucket + INTERVAL 1 HOUR
      GROUP BY l.lang, b.bucket"""),
)


@register("language_trend", with_("repos activity", *TREND, select="""
  SELECT language, epoch_us(bucket) AS bucket_us, watched_only_events, total_events, full_events FROM trend"""))
def language_trend(w):
    out = fleet.language_trend(w.activity, w.repos, w.as_of)
    return out.select("language", micros("bucket").alias("bucket_us"), "watched_only_events", "total_events", "full_events")


@register("language_trend_totals", with_("repos activity", *TREND, select=f"""
  SELECT language, CAST(sum(watched_only_events) AS BIGINT) AS watched_only_total,
    CAST(sum(total_events) AS BIGINT) AS events_total,
    string_agg(watched_only_events || '/' || total_events || '/' || full_events || '/' ||
      {fxt('CASE WHEN total_events = 0 THEN 0 ELSE watched_only_events * 100.0 / total_events END', 1)}, ',' ORDER BY bucket)
      AS points
  FROM trend GROUP BY language"""))
def language_trend_totals(w):
    out = fleet.trend_totals(fleet.language_trend(w.activity, w.repos, w.as_of))
    point = lambda p: F.concat_ws("/", *[p[c].cast("string") for c in (
        "watched_only_events", "total_events", "full_events", "watched_only_percent")])
    return out.withColumn("points", F.array_join(F.transform("points", point), ","))


@register("recent_commits", with_("commits", select="""
  SELECT sha, author, message, epoch_us(ts) AS ts_us FROM commits WHERE repo_id = 'repo-4' ORDER BY ts DESC, sha DESC LIMIT 50"""))
def recent_commits(w):
    return fleet.recent_commits(w.commits, "repo-4").select("sha", "author", "message", micros("ts").alias("ts_us"))


@register("commit_alerts", with_("commits alerts", ("c", "SELECT * REPLACE ('c' || substr(sha, 2) AS sha) FROM commits"), select="""
  SELECT c.repo_id, c.sha, c.author, count(*) AS alert_count, count(*) FILTER (a.severity = 'error') AS error_count
  FROM c JOIN alerts a ON a.repo_id = c.repo_id AND a.sha = c.sha GROUP BY ALL"""))
def commit_alerts(w):
    commits = w.commits.withColumn("sha", F.concat(F.lit("c"), F.substring("sha", F.lit(2), F.length("sha"))))
    return fleet.commit_alerts(commits, w.alerts).select("repo_id", "sha", "author", "alert_count", "error_count")
