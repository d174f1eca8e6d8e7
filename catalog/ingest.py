"""Event folds, merges and spacing rules."""

import uuid

from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions.numeric import fixed, micros
from plumbline.operators.merge import delete_cascade, delete_for, insert_absent, orphans, patch, replace_keeping, upsert
from plumbline.operators.spacing import coalesced, keep_spaced, quiet_after, quiet_before
from plumbline.operators.versioned import Versions
from plumbline.plans import graph, ingest
from plumbline.session import shared_dir

from .base import register
from .ctes import fx, with_

CHANGES = ("ch", """
  SELECT repo_id, sha AS commit_sha, file_path, min(at) AS at, max(at) AS updated, arg_max(language, at) AS language FROM (
    SELECT *, (['typescript','python','css','json','markdown','javascript','go'])[k % 7 + 1] AS language FROM ev) GROUP BY ALL""")


@register("activity_fold", with_("ev alerts", CHANGES, ("sy", """
  SELECT repo_id, sha AS commit_sha, file_path, arg_max(k % 3, at) AS symbols FROM ev WHERE event_type = 'click' GROUP BY ALL"""), ("al", """
  SELECT repo_id, sha AS commit_sha, ev_path AS file_path, count(*) AS n FROM alerts WHERE ev_path IS NOT NULL GROUP BY ALL"""), select="""
  SELECT c.commit_sha || ':' || c.file_path AS event_id, c.repo_id, epoch_us(c.at) AS at_us, c.language,
    CASE WHEN symbols > 0 THEN 'analyzed' WHEN symbols = 0 THEN 'no_symbols' WHEN language IN ('typescript', 'javascript', 'python') THEN 'pending'
      ELSE 'unsupported' END AS parser_status, CAST(coalesce(symbols, 0) AS BIGINT) AS symbol_count, coalesce(n, 0) AS alert_count
  FROM ch c LEFT JOIN sy USING (repo_id, commit_sha, file_path) LEFT JOIN al USING (repo_id, commit_sha, file_path)"""))
def activity_fold(w):
    changes = w.events.select("repo_id", F.col("sha").alias("commit_sha"), "at", "file_path", paths.language("file_path").alias("language"),
                              F.lit("modified").alias("change_type"))
    parsed = w.events.filter(F.col("event_type") == "click").select(
        "repo_id", F.col("sha").alias("commit_sha"), "file_path", (F.col("k") % 3).cast("bigint").alias("symbol_count"), "at")
    out = ingest.activity_of(changes, parsed, w.alerts)
    return out.select("event_id", "repo_id", micros("at").alias("at_us"), "language", "parser_status", "symbol_count", "alert_count")


@register("activity_telemetry", with_("telemetry changes", ("said", """
  SELECT c.repo_id, c.commit_sha, c.file_path, c.at, c.change_type, t.provenance, t.source, t.editor, t.session_id
  FROM changes c LEFT JOIN telemetry t ON t.repo_id = c.repo_id
    AND (t.file_path = c.file_path OR t.absolute_path = c.absolute_path)
    AND t.observed_at <= c.at AND t.observed_at >= c.at - INTERVAL 45 MINUTE
  QUALIFY row_number() OVER (PARTITION BY c.change_id ORDER BY t.observed_at DESC NULLS LAST, t.id DESC) = 1"""), select="""
  SELECT commit_sha || ':' || file_path AS event_id, repo_id, epoch_us(max(at)) AS updated_us, arg_max(change_type, at) AS change_type,
    arg_max(provenance, at) FILTER (provenance IS NOT NULL) AS provenance, arg_max(source, at) FILTER (source IS NOT NULL) AS telemetry_source,
    arg_max(editor, at) FILTER (editor IS NOT NULL) AS telemetry_editor, arg_max(session_id, at) FILTER (session_id IS NOT NULL) AS telemetry_session_id
  FROM said GROUP BY repo_id, commit_sha, file_path"""))
def activity_telemetry(w):
    """Changes attributed, folded to activity rows and patched with the telemetry that was found."""
    said = ingest.attribute_changes(w.changes, w.telemetry).withColumnsRenamed({"editor": "telemetry_editor", "session_id": "telemetry_session_id"})
    none = w.events.filter(F.lit(False)).select("repo_id", F.col("sha").alias("commit_sha"), "file_path", F.lit(0).cast("bigint").alias("symbol_count"), "at")
    out = ingest.activity_of(w.changes.withColumn("language", paths.language("file_path")), none, w.alerts.filter(F.lit(False)))
    return ingest.with_telemetry(out, said).select("event_id", "repo_id", micros("updated_at").alias("updated_us"), "change_type", *ingest.TOLD)


def _pages(mode, where):
    @register(f"activity_page_{mode}", with_("activity", ("r", f"SELECT * FROM activity WHERE repo_id = 'repo-3' AND {where}"), select="""
      SELECT event_id, epoch_us(at) AS at_us, parser_status, (SELECT count(*) FROM r) AS total, greatest(1, (SELECT count(*) + 11 FROM r) // 12) AS total_pages
      FROM r ORDER BY at DESC, event_id DESC LIMIT 12 OFFSET 12"""))
    def build(w):
        out = ingest.activity_page(w.activity, "repo-3", mode, number=2)
        return out.select("event_id", micros("at").alias("at_us"), "parser_status", "total", "total_pages")
    return build


for _mode, _where in (("all", "true"), ("full", "parser_status <> 'unsupported'"), ("watched", "parser_status = 'unsupported'")):
    _pages(_mode, _where)


@register("activity_page_after", with_("activity", select="""
  SELECT event_id, epoch_us(at) AS at_us FROM activity WHERE repo_id = 'repo-3' AND parser_status = 'analyzed' ORDER BY at DESC, event_id DESC LIMIT 12 OFFSET 12"""))
def activity_page_after(w):
    """The second page, found behind the last row of the first."""
    first = ingest.activity_page(w.activity, "repo-3", parser_status="analyzed")
    last = first.agg(F.min(F.struct("at", "event_id"))).scalar()
    out = ingest.activity_page(w.activity, "repo-3", parser_status="analyzed", after=last)
    return out.select("event_id", micros("at").alias("at_us"))


@register("new_telemetry", with_("telemetry", select="""
  SELECT min(id) AS id, repo_id, file_path, provenance, session_id, epoch_us(observed_at) AS observed_us FROM telemetry t
  WHERE NOT EXISTS (SELECT 1 FROM telemetry b WHERE b.editor = 'vim' AND b.repo_id = t.repo_id AND b.file_path = t.file_path AND b.provenance = t.provenance
    AND b.source = t.source AND b.session_id IS NOT DISTINCT FROM t.session_id AND b.observed_at = t.observed_at)
  GROUP BY repo_id, file_path, provenance, source, session_id, observed_at"""))
def new_telemetry(w):
    out = ingest.new_telemetry(w.telemetry.filter(F.col("editor") == "vim"), w.telemetry)
    return out.select("id", "repo_id", "file_path", "provenance", "session_id", micros("observed_at").alias("observed_us"))


@register("heuristic_backfill", with_("alerts", select="""
  SELECT repo_id, sha, coalesce(ev_path, title) AS file_path, CASE WHEN k % 2 = 0 THEN 'todo x2|placeholder x1' ELSE 'fake secret placeholder|tbd x' || (k % 3) END AS drivers,
    CASE WHEN k % 2 = 0 THEN 'PLACEHOLDER_CONTENT' ELSE 'SECRET_PLACEHOLDER' END AS category
  FROM alerts WHERE type = 'CONTENT_HEURISTIC' AND coalesce(ev_category, '') = ''"""))
def heuristic_backfill(w):
    out = ingest.complete_heuristics(w.alerts)
    return out.select("repo_id", "sha", "file_path", F.array_join("drivers", "|").alias("drivers"), "category")


LIFE = """CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'deleted' WHEN event_type = 'signup' THEN 'registered' ELSE 'updated' END"""


@register("watch_states", with_("ev", select=f"""
  SELECT repo_id, CASE WHEN kind = 'deleted' THEN 'closed' WHEN error IS NOT NULL THEN 'blocked' WHEN NOT enabled OR root_path IS NULL THEN 'inactive'
    ELSE 'active' END AS watch_state FROM (SELECT 'u' || user_id AS repo_id, {LIFE} AS kind, k % 4 <> 0 AS enabled,
      CASE WHEN k % 6 <> 0 THEN '/r' END AS root_path, CASE WHEN k % 7 = 0 THEN 'no access' END AS error
    FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY at DESC) = 1)"""))
def watch_states(w):
    k = F.col("k")
    kind = F.when((F.col("event_type") == "error") & (k % 10 == 0), "deleted").when(F.col("event_type") == "signup", "registered").otherwise("updated")
    rows = w.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), "at", kind.alias("kind"), (k % 4 != 0).alias("enabled"),
                           F.when(k % 6 != 0, "/r").alias("root_path"), F.when(k % 7 == 0, "no access").alias("error"))
    return ingest.watch_states(rows).select("repo_id", "watch_state")


@register("watch_state_updates", with_("repos", select="""
  SELECT repo_id, CASE WHEN NOT enabled THEN 'inactive' WHEN kind = 'remote' AND NOT watch_enabled THEN 'pending' WHEN kind = 'remote' THEN watch_state
    WHEN coalesce(next_root, '') = '' THEN 'inactive' WHEN NOT watch_enabled OR rtrim(coalesce(root_path, ''), '/') <> rtrim(next_root, '/') THEN 'pending'
    WHEN watch_state IN ('active', 'blocked') THEN watch_state ELSE 'pending' END AS next_state,
    CASE WHEN NOT enabled THEN 'inactive' WHEN kind = 'local' AND coalesce(next_root, '') <> '' THEN 'pending' ELSE 'inactive' END AS first_state
  FROM (SELECT *, length(name) % 2 = 0 AS enabled, CASE WHEN length(name) % 3 <> 0 THEN root_path || '/' END AS next_root FROM repos)"""))
def watch_state_updates(w):
    rows = w.repos.withColumn("enabled", F.length("name") % 2 == 0).withColumn(
        "next_root", F.when(F.length("name") % 3 != 0, F.concat("root_path", F.lit("/"))))
    return rows.select("repo_id", paths.next_watch_state("kind", "watch_enabled", "watch_state", "root_path", "enabled", "next_root").alias("next_state"),
                       paths.initial_watch_state("kind", "enabled", "next_root").alias("first_state"))


@register("watchable_repos", with_("repos", select="""
  SELECT repo_id, root_path, replace(root_path, '/host-repos', '/mnt/r') AS mounted FROM repos
  WHERE kind = 'local' AND root_path IS NOT NULL AND archived_at IS NULL"""))
def watchable_repos(w):
    out = ingest.watchable(w.repos)
    return out.select("repo_id", "root_path", paths.container_path("root_path", "/host-repos/", "/mnt/r").alias("mounted"))


@register("file_listing_changes", """
  WITH p AS (SELECT 'r' || (doc_id % 4) AS repo_id, 'src/d' || doc_id || '.py' AS f, md5(text) AS h FROM documents WHERE lang <> 'fr'),
    c AS (SELECT 'r' || (doc_id % 4) AS repo_id, CASE WHEN lang = 'es' THEN '.cache/' ELSE 'src/' END || 'd' || doc_id || '.py' AS f,
      md5(replace(text, 'and', 'AND')) AS h FROM documents WHERE lang <> 'de')
  SELECT coalesce(p.repo_id, c.repo_id) AS repo_id, coalesce(p.f, c.f) AS file_path, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'deleted'
    ELSE 'modified' END AS change_type FROM p FULL JOIN (SELECT * FROM c WHERE f NOT LIKE '.%') c ON p.repo_id = c.repo_id AND p.f = c.f
  WHERE p.h IS DISTINCT FROM c.h""")
def file_listing_changes(w):
    repo = F.concat(F.lit("r"), (F.col("doc_id") % 4).cast("string")).alias("repo_id")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py"))
    folder = F.when(F.col("lang") == "es", ".cache/").otherwise("src/")
    before = w.documents.filter(F.col("lang") != "fr").select(repo, F.concat(F.lit("src/"), name).alias("file_path"), F.md5("text").alias("hash"))
    after = w.documents.filter(F.col("lang") != "de").select(
        repo, F.concat(folder, name).alias("file_path"), F.md5(F.replace("text", F.lit("and"), F.lit("AND"))).alias("hash"))
    return ingest.changes_between(before, after).select("repo_id", "file_path", "change_type")


@register("commit_upsert", with_("commits", select="""
  SELECT repo_id, sha, author, CASE WHEN message LIKE '1-%' THEN 'amended' ELSE message END AS message FROM commits"""))
def commit_upsert(w):
    amended = w.commits.filter(F.col("message").startswith("1-")).withColumn("message", F.lit("amended"))
    return upsert(w.commits, amended, ["repo_id", "sha"], ["ts"]).select("repo_id", "sha", "author", "message")


@register("metric_upsert", with_("metrics", ("u", """
  SELECT *, 0 AS src FROM metrics UNION ALL SELECT * REPLACE (value + 1 AS value), 1 FROM metrics WHERE scope = 'module'"""), select="""
  SELECT repo_id, scope, subject_id, key, count(*) AS readings, """ + fx("sum(value)", 4) + """ AS total FROM (
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY repo_id, sha, at, scope, subject_id, key ORDER BY src DESC) = 1) GROUP BY ALL"""))
def metric_upsert(w):
    from plumbline.functions.numeric import fixed
    cols = ["repo_id", "sha", "at", "scope", "subject_id", "key", "value"]
    base = w.metrics.select(*cols)
    raised = base.filter(F.col("scope") == "module").withColumn("value", F.col("value") + 1)
    out = upsert(base, raised, cols[:6], ["value"])
    return out.groupBy("repo_id", "scope", "subject_id", "key").agg(F.count(F.lit(1)).alias("readings"), fixed(F.sum("value"), 4).alias("total"))


@register("alert_insert", with_("alerts", select="""
  SELECT repo_id, sha, epoch_us(at) AS at_us, type, title FROM alerts WHERE severity <> 'error'"""))
def alert_insert(w):
    """Alerts not stored yet: the error ones are, and every alert arrives twice."""
    keys = ["repo_id", "sha", "at", "type", "title"]
    rows = w.alerts.select(*keys, "severity")
    out = insert_absent(rows.filter(F.col("severity") == "error"), rows.unionByName(rows), keys, ["severity"])
    return out.select("repo_id", "sha", micros("at").alias("at_us"), "type", "title")


@register("refactor_replace", with_("refactors", select="""
  SELECT repo_id, id, CASE WHEN status IN ('accepted', 'applied', 'dismissed') AND scope <> 'file' THEN status ELSE 'proposed' END AS status
  FROM refactors WHERE scope <> 'module'"""))
def refactor_replace(w):
    """Boundary and file suggestions regenerated; stored ones of files and modules are gone."""
    new = w.refactors.filter(F.col("scope") != "module").withColumn("status", F.lit("proposed"))
    old = w.refactors.filter(F.col("scope") != "file")
    return replace_keeping(new, old, ["repo_id", "id"], "status", ["accepted", "applied", "dismissed"]).select("repo_id", "id", "status")


@register("repo_delete", with_("repos metrics alerts activity", ("d", "SELECT repo_id FROM repos WHERE archived_at IS NOT NULL"), select="""
  SELECT 'alerts' AS name, count(*) AS left_rows FROM alerts WHERE repo_id NOT IN (SELECT repo_id FROM d) UNION ALL
  SELECT 'activity', count(*) FROM activity WHERE repo_id NOT IN (SELECT repo_id FROM d) UNION ALL
  SELECT 'metrics', count(*) FROM metrics WHERE repo_id NOT IN (SELECT repo_id FROM d)"""))
def repo_delete(w):
    doomed = w.repos.filter(F.col("archived_at").isNotNull())
    kept = delete_for({"alerts": w.alerts, "activity": w.activity, "metrics": w.metrics}, doomed, "repo_id")
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("name"), "left_rows")
        out = part if out is None else out.unionByName(part)
    return out


SUITE = {"repos": "repos", "commits": "commits", "metrics": "metrics", "alerts": "alerts", "refactors": "refactors", "snapshots": "snapshots",
         "incidents": "incidents", "activity": "activity", "telemetry": "telemetry", "changes": "changes", "edges": "edges", "vectors": "vectors",
         "files": "python_sources"}


@register("repo_cascade_delete", with_(" ".join(SUITE.values()), ("d", "SELECT repo_id FROM repos WHERE archived_at IS NOT NULL"), select=" UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS left_rows FROM {t} WHERE repo_id NOT IN (SELECT repo_id FROM d)" for n, t in SUITE.items()) + """
  UNION ALL SELECT 'nodes', count(DISTINCT split_part(edge, '->', 2)) FROM edges WHERE repo_id NOT IN (SELECT repo_id FROM d)"""))
def repo_cascade_delete(w):
    """Rows left in each table once archived repositories are gone everywhere, read back through the manifest."""
    store = Versions(w.spark, f"{shared_dir(w.spark)}/suite-{uuid.uuid4().hex[:8]}")
    tables = {n: getattr(w, t) for n, t in SUITE.items()}
    delete_cascade(tables, w.repos.filter(F.col("archived_at").isNotNull()), "repo_id", "edges", "edge", store)
    out = None
    for name in store.paths()[1]:
        part = store.read(name).agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(name).alias("name"), "left_rows")
        out = part if out is None else out.unionByName(part)
    return out


@register("snapshot_upsert", with_("snapshots", select=f"""
  SELECT repo_id, sha, scope, subject_id, epoch_us(CASE WHEN scope = 'module' THEN at + INTERVAL 1 HOUR ELSE at END) AS at_us, {fx("entropy", 4)} AS entropy
  FROM snapshots QUALIFY row_number() OVER (PARTITION BY repo_id, sha, scope, subject_id ORDER BY at DESC) = 1"""))
def snapshot_upsert(w):
    """Snapshots written twice: again for every module an hour later, so the later one of a commit and subject stays."""
    again = w.snapshots.filter(F.col("scope") == "module").withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR"))
    out = ingest.upsert_snapshots(ingest.upsert_snapshots(w.snapshots.limit(0), w.snapshots), again)
    return out.select("repo_id", "sha", "scope", "subject_id", micros("at").alias("at_us"), fixed("signature.health.entropyIndex", 4).alias("entropy"))


@register("orphan_packages", """
  SELECT p_partkey AS package FROM part WHERE p_partkey NOT IN (
    SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity > 40)""")
def orphan_packages(w):
    """Parts as packages: those no remaining order line points to."""
    lines = w.table("lineitem").filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    nodes = w.table("part").select(F.col("p_partkey").alias("package"))
    return orphans(nodes, lines, "package", "l_partkey")


@register("gate_patch", with_("repos", select="""
  SELECT repo_id, CASE WHEN length(name) % 2 = 0 THEN 'renamed' ELSE name END AS name, watch_enabled AS enabled FROM repos"""))
def gate_patch(w):
    gates = w.repos.select("repo_id", "name", F.col("watch_enabled").alias("enabled"))
    change = gates.select("repo_id", F.when(F.length("name") % 2 == 0, "renamed").alias("name"), F.lit(None).cast("boolean").alias("enabled"))
    return patch(gates, change, ["repo_id"])


@register("replaced_file_edges", with_("edges", ("c", "SELECT DISTINCT repo_id, module, file_path, edge FROM edges WHERE at >= TIMESTAMP '2024-01-16'"),
    ("p", "SELECT DISTINCT repo_id, module, file_path, edge FROM edges WHERE at < TIMESTAMP '2024-01-16'"), select="""
  SELECT * FROM c UNION ALL SELECT * FROM p WHERE (repo_id, file_path) NOT IN (SELECT (repo_id, file_path) FROM c)"""))
def replaced_file_edges(w):
    cols = ["repo_id", "module", "file_path", "edge"]
    cut = F.lit("2024-01-16").cast("timestamp")
    return graph.replace_files(w.edges.filter(F.col("at") < cut).select(*cols).distinct(), w.edges.filter(F.col("at") >= cut).select(*cols).distinct())


STEP = ("n", """SELECT event_type, epoch_us(at) // 1000 AS t, value > 150 AS forced, event_id, row_number() OVER (PARTITION BY event_type ORDER BY at) AS rn FROM ev""")
TTL = 900_000


@register("spaced_events", with_("ev", STEP, ("r", f"""
  SELECT event_type, rn, t AS last, true AS kept, event_id FROM n WHERE rn = 1 UNION ALL
  SELECT n.event_type, n.rn, CASE WHEN n.t - r.last >= {TTL} THEN n.t ELSE r.last END, n.t - r.last >= {TTL}, n.event_id
  FROM r JOIN n ON n.event_type = r.event_type AND n.rn = r.rn + 1"""), recursive=True, select="SELECT event_type, event_id FROM r WHERE kept"))
def spaced_events(w):
    return keep_spaced(w.events.select("event_type", "event_id", "at"), ["event_type"], "at", TTL, tie="event_id").select("event_type", "event_id")


@register("spaced_snapshots", with_("ev", STEP, ("r", """
  SELECT event_type, rn, t AS last, true AS kept, event_id FROM n WHERE rn = 1 UNION ALL
  SELECT n.event_type, n.rn, CASE WHEN n.forced OR n.t - r.last >= 600000 THEN n.t ELSE r.last END, n.forced OR n.t - r.last >= 600000, n.event_id
  FROM r JOIN n ON n.event_type = r.event_type AND n.rn = r.rn + 1"""), recursive=True, select="SELECT event_type, event_id FROM r WHERE kept"))
def spaced_snapshots(w):
    """Ten-minute snapshot throttle where large values are always written."""
    rows = w.events.select("event_type", "event_id", "at", (F.col("value") > 150).alias("force"))
    return keep_spaced(rows, ["event_type"], "at", 600_000, tie="event_id", forced="force").select("event_type", "event_id")


@register("refresh_throttle", with_("ev", select="""
  SELECT repo_id, event_id FROM ev QUALIFY lag(at) OVER (PARTITION BY repo_id ORDER BY at) IS NULL
    OR epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY repo_id ORDER BY at)) >= 600000000"""))
def refresh_throttle(w):
    return quiet_before(w.events.select("repo_id", "event_id", "at"), ["repo_id"], "at", 600_000_000).select("repo_id", "event_id")


@register("refresh_debounce", with_("ev", ("g", """
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id ORDER BY at) AS burst FROM (
    SELECT *, epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY repo_id ORDER BY at)) AS gap FROM ev)"""), select="""
  SELECT repo_id, arg_max(event_id, at) AS event_id, count(*) AS burst_size, epoch_us(max(at)) + 1800000000 AS fires_us FROM g GROUP BY repo_id, burst"""))
def refresh_debounce(w):
    out = quiet_after(w.events.select("repo_id", "event_id", "at"), ["repo_id"], "at", "30 minutes", "event_id")
    return out.select("repo_id", "event_id", "burst_size", micros("fires_at").alias("fires_us"))


@register("storable_files", """
  SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND length(repeat(text, 20)) <= 200000""")
def storable_files(w):
    """File versions worth storing: deletions and very long contents are left out."""
    d = F.col("doc_id")
    files = w.documents.select("doc_id", F.when(d % 5 == 0, "deleted").otherwise("modified").alias("change_type"), F.repeat("text", 20).alias("content"))
    return ingest.storable_snapshots(files).select("doc_id")


@register("fallback_languages", with_("activity", select="""
  SELECT file_path, max(CASE WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.js' THEN 'javascript' WHEN file_path LIKE '%.py' THEN 'python' END)
    AS language, max(CASE WHEN language IN ('typescript', 'javascript', 'python') THEN 'none' WHEN language IS NULL THEN 'unknown'
      WHEN language = 'go' THEN 'watch_only' ELSE 'light' END) AS lane FROM (SELECT DISTINCT file_path,
      (['typescript','python','css','json','markdown','javascript','go'])[list_position(['.ts','.py','.css','.json','.md','.js','.go'], '.' || split_part(file_path, '.', -1))] AS language
    FROM activity) GROUP BY file_path"""))
def fallback_languages(w):
    files = w.activity.select("file_path").distinct()
    return files.select("file_path", paths.fallback_language("file_path").alias("language"), paths.parser_lane(paths.language("file_path")).alias("lane"))


@register("watched_roots", with_("repos", select="""
  SELECT repo_id, lower(regexp_replace(string_split(root_path, '/')[-1], '[^a-zA-Z0-9_-]', '-', 'g')) AS derived_id FROM repos WHERE root_path IS NOT NULL"""))
def watched_roots(w):
    return w.repos.filter(F.col("root_path").isNotNull()).select("repo_id", paths.repo_id_from_path("root_path").alias("derived_id"))


@register("coalesced_refreshes", with_("ev", STEP, ("r", f"""
  SELECT event_type, rn, t AS last, event_id, event_id AS opener FROM n WHERE rn = 1 UNION ALL
  SELECT n.event_type, n.rn, CASE WHEN n.t - r.last >= {TTL} THEN n.t ELSE r.last END, n.event_id, CASE WHEN n.t - r.last >= {TTL} THEN n.event_id ELSE r.opener END
  FROM r JOIN n ON n.event_type = r.event_type AND n.rn = r.rn + 1"""), recursive=True, select=f"""
  SELECT event_type, opener AS event_id, count(*) - 1 AS absorbed, (any_value(last) + {TTL}) * 1000 AS fires_us FROM r GROUP BY event_type, opener"""))
def coalesced_refreshes(w):
    """Refreshes scheduled by the first event of a window, with the number of events each absorbs."""
    out = coalesced(w.events, ["event_type"], "at", TTL, tie="event_id")
    return out.select("event_type", "event_id", "absorbed", micros("fires_at").alias("fires_us"))
