"""Component and entropy reports, refactor suggestions."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import fixed, micros
from plumbline.operators.timegrid import page_info
from plumbline.plans import components, fleet, refactors
from plumbline.schema import ENTROPY_KEYS

from .base import register
from .ctes import ASOF, fx, with_
from .fleet import repo_list_sql

LATEST = """QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1"""
COMPONENTS = (
    ("ls", f"SELECT * FROM metrics WHERE scope = 'symbol' {LATEST}"), ("lm", f"SELECT * FROM metrics WHERE scope = 'module' {LATEST}"),
    ("comp", f"""SELECT s.repo_id, coalesce(s.module, 'root') AS component,
        {fx("avg(CASE WHEN s.key = 'cyclomatic' THEN s.value END)", 2)} AS avg_cyclomatic,
        {fx("avg(CASE WHEN s.key = 'ai_risk_score' THEN s.value END)", 2)} AS avg_ai_risk,
        {fx("max(CASE WHEN m.key = 'code_entropy_index' THEN m.value END)", 2)} AS entropy_index,
        {fx("max(CASE WHEN m.key = 'pressure_index' THEN m.value END)", 2)} AS pressure_index,
        greatest(max(s.at), max(m.at)) AS last_seen
      FROM ls s LEFT JOIN lm m ON m.repo_id = s.repo_id AND m.subject_id = coalesce(s.module, 'root') GROUP BY 1, 2"""),
)


@register("component_list", with_("metrics", *COMPONENTS, select="""
  SELECT * EXCLUDE (last_seen), epoch_us(last_seen) AS last_seen_us FROM comp"""))
def component_list(w):
    return components.component_list(w.metrics).withColumn("last_seen_us", micros("last_seen")).drop("last_seen")


@register("component_summary", with_("metrics", select=f"""
  SELECT repo_id, module AS component, {fx("avg(value) FILTER (key = 'cyclomatic')", 2)} AS avg_cyclomatic,
    {fx("avg(value) FILTER (key = 'ai_risk_score')", 2)} AS avg_ai_risk, {fx("avg(value) FILTER (key = 'nesting_depth')", 2)} AS avg_nesting,
    {fx("arg_max(value, (at, sha)) FILTER (scope = 'module' AND key = 'code_entropy_index')", 2)} AS entropy_index,
    {fx("arg_max(value, (at, sha)) FILTER (scope = 'module' AND key = 'pressure_index')", 2)} AS pressure_index
  FROM metrics WHERE module IS NOT NULL GROUP BY ALL"""))
def component_summary(w):
    return components.component_summary(w.metrics)


@register("component_trend", with_("metrics", ("n", """
  SELECT * FROM metrics WHERE module IS NOT NULL AND key IN ('code_entropy_index', 'pressure_index', 'ai_risk_score', 'cyclomatic')
  QUALIFY row_number() OVER (PARTITION BY repo_id, module ORDER BY at DESC, sha DESC, scope DESC, subject_id DESC, key DESC) <= 96"""),
    ("f", "SELECT repo_id, module AS component, at, " + ", ".join(
        f"coalesce(arg_max(value, (sha, scope, subject_id)) FILTER (key = '{k}'), 0) AS {n}" for k, n in components.TREND_KEYS.items()) +
     " FROM n GROUP BY ALL"),
    select="""SELECT * EXCLUDE (at), epoch_us(at) AS at_us FROM f
      QUALIFY row_number() OVER (PARTITION BY repo_id, component ORDER BY at DESC) <= 12"""))
def component_trend(w):
    return components.component_trend(w.metrics).withColumn("at_us", micros("at")).drop("at")


@register("component_readings", with_("metrics", select="""
  SELECT epoch_us(at) AS at_us, scope, subject_id, key, value FROM metrics WHERE repo_id = 'repo-3' AND module = 'domain'
  ORDER BY at DESC, sha DESC, subject_id DESC, key DESC LIMIT 100"""))
def component_readings(w):
    return components.component_readings(w.metrics, "repo-3", "domain").select(micros("at").alias("at_us"), "scope", "subject_id", "key", "value")


TOUCH = "(file_path = 'web' OR file_path LIKE 'web/%' OR file_path LIKE '%/web/%' OR file_path LIKE '%/web.%')"


@register("component_activity", with_("activity", select=f"""
  SELECT event_id, epoch_us(at) AS at_us, file_path, parser_status FROM activity WHERE repo_id = 'repo-2' AND {TOUCH}
  ORDER BY at DESC, event_id DESC LIMIT 16"""))
def component_activity(w):
    return components.component_activity(w.activity, "repo-2", "web").select("event_id", micros("at").alias("at_us"), "file_path", "parser_status")


@register("component_languages", with_("activity", select=f"""
  SELECT coalesce(language, 'unknown') AS language, count(*) FILTER (parser_status = 'unsupported') AS watched_only_events,
    count(*) FILTER (parser_status IN ('pending', 'analyzed', 'no_symbols')) AS full_events, count(*) AS total_events
  FROM activity WHERE repo_id = 'repo-2' AND {TOUCH} GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 8"""))
def component_languages(w):
    return components.component_languages(w.activity, "repo-2", "web")


@register("component_alerts", with_("alerts", select="""
  SELECT sha, epoch_us(at) AS at_us, type, severity, status FROM alerts
  WHERE repo_id = 'repo-5' AND (ev_module = 'core' OR ev_path LIKE 'core%') ORDER BY at DESC, sha DESC LIMIT 8"""))
def component_alerts(w):
    return components.component_alerts(w.alerts, "repo-5", "core").select("sha", micros("at").alias("at_us"), "type", "severity", "status")


@register("component_notes", with_("metrics alerts", ("c", f"""
  SELECT repo_id, module AS component, {fx("arg_max(value, (at, sha)) FILTER (scope = 'module' AND key = 'pressure_index')", 2)} AS p
  FROM metrics WHERE module IS NOT NULL GROUP BY ALL"""), select="""
  SELECT c.repo_id, component, concat_ws('|', CASE WHEN coalesce(p, 0) > 60 THEN 'high_pressure' END,
    CASE WHEN coalesce(n, 0) = 0 THEN 'no_alerts' END) AS notes
  FROM c LEFT JOIN (SELECT repo_id, ev_module, count(*) AS n FROM alerts GROUP BY ALL) a ON a.repo_id = c.repo_id AND a.ev_module = c.component"""))
def component_notes(w):
    out = components.component_notes(components.component_summary(w.metrics), w.alerts)
    return out.withColumn("notes", F.array_join("notes", "|"))


@register("repo_report_modules", with_("metrics", *COMPONENTS, select="""
  SELECT repo_id, component AS name, pressure_index AS pressure, entropy_index AS entropy, avg_ai_risk AS ai_risk,
    row_number() OVER (PARTITION BY repo_id ORDER BY pressure_index DESC NULLS LAST, entropy_index DESC NULLS LAST, component) AS rank
  FROM comp QUALIFY rank <= 8"""))
def repo_report_modules(w):
    return components.repo_modules(w.metrics).withColumn("rank", F.col("rank").cast("bigint"))


@register("repo_report_languages", with_("activity", select=f"""
  SELECT repo_id, coalesce(language, 'unknown') AS language, count(*) FILTER (parser_status = 'unsupported') AS watched_only_events,
    count(*) FILTER (parser_status IN ('pending', 'analyzed', 'no_symbols')) AS full_events, count(*) AS total_events
  FROM activity WHERE at >= {ASOF} - INTERVAL 24 HOUR GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, coalesce(language, 'unknown')) <= 8"""))
def repo_report_languages(w):
    return components.repo_languages(fleet.languages_of_repo(w.activity, w.as_of))


@register("repo_report_notes", f"""SELECT repo_id, concat_ws('|', CASE WHEN coverage_percent < 35 THEN 'low_coverage' END,
    CASE WHEN activity_24h = 0 THEN 'idle' END, CASE WHEN entropy_index > 70 THEN 'high_entropy' END) AS notes
  FROM ({repo_list_sql(False)})""")
def repo_report_notes(w):
    out = components.repo_report_notes(fleet.repo_list(w.repos, w.metrics, w.activity, w.as_of))
    return out.withColumn("notes", F.array_join("notes", "|"))


@register("entropy_current", with_("metrics", ("l", f"SELECT * FROM metrics WHERE scope = 'repo' {LATEST}"), ("p", "SELECT repo_id, " + ", ".join(
    f"coalesce(max(value) FILTER (key = '{k}'), 0) AS {k}" for k in ENTROPY_KEYS) +
    " FROM l WHERE key IN (" + ", ".join(f"'{k}'" for k in ENTROPY_KEYS) + ") GROUP BY repo_id"), select="""
  SELECT *, CASE WHEN code_entropy_index < 20 THEN 'stable' WHEN code_entropy_index < 40 THEN 'normal'
    WHEN code_entropy_index < 60 THEN 'drifting' WHEN code_entropy_index < 80 THEN 'unstable' ELSE 'chaotic' END AS posture FROM p"""))
def entropy_current(w):
    return components.entropy_current(w.metrics)


@register("entropy_trend", with_("metrics", select=f"""
  SELECT repo_id, epoch_us(time_bucket(INTERVAL 15 MINUTE, at)) AS bucket_us, {fx('avg(value)', 2)} AS entropy_index FROM metrics
  WHERE scope = 'repo' AND key = 'code_entropy_index' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY epoch_us(time_bucket(INTERVAL 15 MINUTE, at)) DESC) <= 16"""))
def entropy_trend(w):
    return components.entropy_trend(w.metrics).select("repo_id", micros("bucket").alias("bucket_us"), "entropy_index")


@register("entropy_modules", with_("metrics", ("l", f"SELECT * FROM metrics WHERE scope = 'module' AND key = 'code_entropy_index' {LATEST}"),
                                   select=f"""
  SELECT repo_id, subject_id AS module, {fx('value', 2)} AS entropy_index, 0.0::DOUBLE AS ai_risk, epoch_us(at) AS last_seen_us FROM l
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY value DESC, subject_id) <= 10"""))
def entropy_modules(w):
    return components.entropy_modules(w.metrics).withColumn("last_seen_us", micros("last_seen")).drop("last_seen")


STATE = ("st", "SELECT repo_id, subject_id AS module, " + ", ".join(
    f"coalesce(max(value) FILTER (key = '{k}'), 0) AS {k}" for k in refactors.STATE_KEYS) + f" FROM (SELECT * FROM metrics WHERE scope = 'module' {LATEST}) GROUP BY ALL")
STATE2 = ("sim", f"""SELECT repo_id, module, {fx('code_entropy_index', 2)} AS e, {fx('pressure_index', 2)} AS p, {fx('duplication_entropy', 2)} AS d,
  {fx('greatest(dependency_entropy, (pressure_coupling + pressure_boundary) / 2)', 2)} AS c FROM st""")


@register("simulation_state", with_("metrics", STATE, STATE2, select="""
  SELECT repo_id, module, e AS entropy, p AS pressure, d AS duplication, c AS coupling FROM sim
  WHERE (repo_id, module) IN (SELECT (repo_id, subject_id) FROM metrics WHERE scope = 'module' AND key IN
    ('code_entropy_index', 'pressure_index', 'duplication_entropy', 'dependency_entropy', 'pressure_coupling', 'pressure_boundary'))"""))
def simulation_state(w):
    return refactors.simulation_state(w.metrics)


def cut(x: str, share: float, least: float, linear: str) -> str:
    return fx(f"greatest(0.0, least(100.0, {x} - least(greatest({x} * {share}, {least}), {linear})))", 2)


def flat(x: str) -> str:
    return fx(f"greatest(0.0, least(100.0, {x}))", 2)


GENERATED = (
    STATE, STATE2, *COMPONENTS,
    ("ra", """SELECT *, coalesce(ev_module, split_part(ev_path, '/', 2), split_part(ev_symbol, '/', 2), 'root') AS module,
        row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) AS age FROM alerts QUALIFY age <= 200"""),
    ("g1", """SELECT repo_id, coalesce(ev_path, 'unknown') AS target, 'file' AS scope, 'DEDUPE_CLUSTER' AS type, count(*) AS n, 0 AS b,
        arg_min(module, age) AS module, coalesce(avg(nb_score) FILTER (nb_score > 0), 0) AS s, 0.0 AS cp, 0.0 AS ce FROM ra
      WHERE type = 'SEMANTIC_DUPLICATION' GROUP BY ALL HAVING count(*) >= 2"""),
    ("g2", """SELECT repo_id, edge AS target, 'boundary' AS scope, 'INVERT_BOUNDARY' AS type, count(*) AS n, 0 AS b, arg_min(module, age) AS module,
        0.0 AS s, 0.0 AS cp, 0.0 AS ce FROM ra WHERE type = 'ARCH_VIOLATION' GROUP BY repo_id, edge
      QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY least(0.96, count(*) * 0.07 + 0.72) DESC, min(age), edge) <= 6"""),
    ("g3", """SELECT c.repo_id, c.component AS target, 'module' AS scope, 'EXTRACT_MODULE' AS type, count(*) FILTER (r.type = 'SEMANTIC_DUPLICATION') AS n,
        count(*) FILTER (r.type = 'ARCH_VIOLATION') AS b, c.component AS module, 0.0 AS s,
        coalesce(max(pressure_index), 0) AS cp, coalesce(max(entropy_index), 0) AS ce
      FROM comp c JOIN ra r ON r.repo_id = c.repo_id AND r.module = c.component WHERE pressure_index >= 50 OR entropy_index >= 70
      GROUP BY c.repo_id, c.component
      HAVING count(*) FILTER (r.type IN ('SEMANTIC_DUPLICATION', 'ARCH_VIOLATION', 'ARCH_EMBED_DRIFT', 'ARCH_PRESSURE')) > 0"""),
    ("allg", """SELECT g.*, coalesce(sim.e, 0) AS e, coalesce(sim.p, 0) AS p, coalesce(sim.d, 0) AS d, coalesce(sim.c, 0) AS c
      FROM (SELECT * FROM g1 UNION ALL BY NAME SELECT * FROM g2 UNION ALL BY NAME SELECT * FROM g3) g LEFT JOIN sim USING (repo_id, module)"""),
    ("proj", f"""SELECT *, 'rfx_' || substr(sha1(repo_id || ':' || type || ':' || target), 1, 14) AS id,
        CASE type WHEN 'DEDUPE_CLUSTER' THEN {fx('least(0.95, n * 0.08 + 0.6 + s * 0.18)', 2)} WHEN 'INVERT_BOUNDARY'
          THEN {fx('least(0.96, n * 0.07 + 0.72)', 2)} ELSE {fx('least(0.93, 0.58 + cp / 250 + ce / 400 + n * 0.03 + b * 0.04)', 2)} END AS confidence,
        CASE type WHEN 'DEDUPE_CLUSTER' THEN {cut('e', .16, 6, 'n * 4.5 + s * 8')} WHEN 'INVERT_BOUNDARY' THEN {cut('e', .18, 8, 'n * 6 + 6')}
          ELSE {cut('e', .24, 10, 'n * 5 + b * 4 + 10')} END - {flat('e')} AS de,
        CASE type WHEN 'DEDUPE_CLUSTER' THEN {cut('p', .14, 4, 'n * 3 + s * 5')} WHEN 'INVERT_BOUNDARY' THEN {cut('p', .22, 8, 'n * 7 + 8')}
          ELSE {cut('p', .28, 12, 'n * 4 + b * 5 + 12')} END - {flat('p')} AS dp,
        CASE type WHEN 'DEDUPE_CLUSTER' THEN {cut('d', .35, 10, 'n * 9 + s * 10')} WHEN 'INVERT_BOUNDARY' THEN {flat('d')}
          ELSE {cut('d', .22, 8, 'n * 8 + 8')} END - {flat('d')} AS dd,
        CASE type WHEN 'DEDUPE_CLUSTER' THEN {cut('c', .08, 2, 'n * 2.5')} WHEN 'INVERT_BOUNDARY' THEN {cut('c', .24, 10, 'n * 9 + 8')}
          ELSE {cut('c', .2, 8, 'b * 9 + 6')} END - {flat('c')} AS dc FROM allg"""),
)


@register("refactor_suggestions", with_("metrics alerts", *GENERATED, select=f"""
  SELECT repo_id, id, scope, target, type, module, confidence, {fx('de', 2)} AS entropy_delta, {fx('dp', 2)} AS pressure_delta,
    {fx('dd', 2)} AS duplication_delta, {fx('dc', 2)} AS coupling_delta FROM proj
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY {fx(f"confidence + abs({fx('dp', 2)}) + abs({fx('de', 2)})", 6)} DESC, id) <= 12"""))
def refactor_suggestions(w):
    out = refactors.generate(w.alerts, w.metrics)
    delta = lambda n: F.col(f"impact.{n}").alias(f"{n}_delta")
    return out.select("repo_id", "id", "scope", "target", "type", "module", "confidence", delta("entropy"), delta("pressure"),
                      delta("duplication"), delta("coupling"))


@register("refactor_page", with_("refactors", select=f"""
  SELECT id, type, target, {fx('confidence', 6)} AS confidence, status FROM refactors WHERE repo_id = 'repo-1'
  ORDER BY CASE status WHEN 'applied' THEN 0 WHEN 'accepted' THEN 1 WHEN 'proposed' THEN 2 ELSE 3 END, confidence DESC, at DESC, id
  LIMIT 8 OFFSET 8"""))
def refactor_page(w):
    out = refactors.refactor_page(w.refactors, "repo-1", number=2)
    return out.select("id", "type", "target", fixed("confidence", 6).alias("confidence"), "status")


@register("refactor_page_info", with_("refactors", select="""
  SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(8 AS BIGINT) AS page_size,
    CAST(greatest(1, ceil(count(*) / 8.0)) AS BIGINT) AS total_pages FROM refactors WHERE repo_id = 'repo-1'"""))
def refactor_page_info(w):
    return page_info(w.refactors.filter(F.col("repo_id") == "repo-1"), 2, 8)


@register("refactor_transitions", with_("refactors", select="""
  SELECT repo_id, id, CASE WHEN ok THEN wanted ELSE status END AS status, NOT ok AS refused FROM (
    SELECT *, wanted = status OR (status, wanted) IN (('proposed', 'accepted'), ('proposed', 'dismissed'), ('accepted', 'proposed'),
      ('accepted', 'applied'), ('accepted', 'dismissed'), ('applied', 'accepted'), ('dismissed', 'proposed')) AS ok
    FROM (SELECT *, (['proposed','accepted','applied','dismissed'])[length(id) % 4 + 1] AS wanted FROM refactors))"""))
def refactor_transitions(w):
    from plumbline.schema import REFACTOR_STATUSES
    from plumbline.sources.workspace import pick
    wanted = w.refactors.select("repo_id", "id", pick(REFACTOR_STATUSES, F.length("id") % 4).alias("status"))
    return refactors.apply_status(w.refactors, wanted).select("repo_id", "id", "status", "refused")
