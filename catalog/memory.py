"""Architecture memory, similarity and rankings."""

from pyspark.sql import functions as F

from plumbline.functions import vectors
from plumbline.functions.bands import module_role
from plumbline.functions.numeric import fixed, micros
from plumbline.operators.shared import materialized
from plumbline.plans import fleet, memory, rankings, similarity

from .base import register
from .ctes import ASOF, fx, fxt, with_
from .fleet import OVERVIEW, repo_list_sql
from .reports import COMPONENTS
from .rules import FIX_COLUMNS, FIXES

DELTAS = {"entropyIndex": ("entropy", 2), "pressureIndex": ("pressure", 2), "avgCyclomatic": ("avg_cyc", 2), "aiEditRatio": ("ai_ratio", 4),
          "duplicationAlerts": ("dup_alerts", 2), "archViolations": ("arch_violations", 2), "churn24h": ("churn", 2)}
MEMORY = (
    ("rs", "SELECT * FROM snapshots WHERE scope = 'repo'"),
    ("cur", "SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) = 1"),
    ("healthy", """SELECT *, 'latest_healthy' AS strategy FROM rs WHERE entropy <= 45 AND pressure <= 45
       QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) = 1"""),
    ("best", """SELECT *, 'best_recent' AS strategy FROM rs
       QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY entropy + pressure + arch_violations * 20, at DESC, sha DESC) = 1"""),
    ("base", "SELECT * FROM healthy UNION ALL SELECT * FROM best WHERE repo_id NOT IN (SELECT repo_id FROM healthy)"),
    ("mem", "SELECT c.repo_id, c AS c, CASE WHEN b.sha = c.sha AND b.at = c.at THEN NULL ELSE b END AS b FROM cur c LEFT JOIN base b USING (repo_id)"),
)


@register("memory_baseline", with_("snapshots", *MEMORY, select="SELECT repo_id, epoch_us(c.at) AS current_us, epoch_us(b.at) AS baseline_us, b.strategy AS strategy, " +
          ", ".join(f"{fx(f'c.{s} - b.{s}', n)} AS d_{s}" for s, n in DELTAS.values()) + " FROM mem"))
def memory_baseline(w):
    out = memory.repo_memory(w.snapshots)
    return out.select("repo_id", micros(F.col("current.at")).alias("current_us"), micros(F.col("baseline.at")).alias("baseline_us"), "strategy",
                      *[F.col(f"delta.{f}").alias(f"d_{s}") for f, (s, _) in DELTAS.items()])


@register("memory_modules", with_("snapshots", *MEMORY, ("mods", "SELECT * FROM snapshots WHERE scope = 'module'"), ("lm", """
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(pressure * 1.25 + entropy * 0.85 + arch_violations * 18, 6) DESC, subject_id) AS rank FROM (
    SELECT * FROM mods QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id ORDER BY at DESC, sha DESC) = 1) QUALIFY rank <= 8"""),
    ("j", """SELECT lm.*, mem.b.at AS base_at FROM lm LEFT JOIN mem USING (repo_id)"""),
    ("k", f"""SELECT j.*, {fx('j.entropy - o.entropy', 2)} AS de, {fx('j.pressure - o.pressure', 2)} AS dp FROM j ASOF LEFT JOIN mods o
       ON o.repo_id = j.repo_id AND o.subject_id = j.subject_id AND o.at <= j.base_at"""), select="""
  SELECT repo_id, subject_id AS module, rank, de AS entropy_delta, dp AS pressure_delta,
    CASE WHEN pressure >= 80 OR entropy >= 80 OR coalesce(dp, 0) >= 20 OR coalesce(de, 0) >= 20 THEN 'critical'
      WHEN pressure >= 60 OR entropy >= 60 OR coalesce(dp, 0) >= 10 OR coalesce(de, 0) >= 10 THEN 'pressured'
      WHEN pressure >= 35 OR entropy >= 40 OR coalesce(dp, 0) >= 5 OR coalesce(de, 0) >= 5 THEN 'warming' ELSE 'stable' END AS posture FROM k"""))
def memory_modules(w):
    out = memory.module_memory(w.snapshots, memory.repo_memory(w.snapshots))
    return out.select("repo_id", "module", F.col("rank").cast("bigint").alias("rank"), F.col("delta.entropyIndex").alias("entropy_delta"),
                      F.col("delta.pressureIndex").alias("pressure_delta"), "posture")


@register("memory_timeline", with_("snapshots incidents", ("top", """
  SELECT * FROM snapshots WHERE scope = 'repo' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) <= 18"""), select="""
  SELECT repo_id, sha, epoch_us(at) AS at_us, entropy AS entropy_index, pressure AS pressure_index, CAST(arch_violations AS DOUBLE) AS arch_violations,
    CAST(ai_ratio AS DOUBLE) AS ai_edit_ratio, (SELECT count(*) FROM incidents i WHERE i.repo_id = top.repo_id AND i.opened_at <= top.at
      AND (i.closed_at IS NULL OR i.closed_at >= top.at)) AS incident_count FROM top"""))
def memory_timeline(w):
    return memory.timeline(w.snapshots, w.incidents).withColumn("at_us", micros("at")).drop("at")


@register("memory_incidents", with_("incidents", select=f"""
  SELECT repo_id, incident_id, status, {fx('latest_e - pre_e', 2)} AS entropy_to_latest, {fx('latest_p - pre_p', 2)} AS pressure_to_latest,
    {fx('post_e - pre_e', 2)} AS entropy_to_recovered, {fx('post_p - pre_p', 2)} AS pressure_to_recovered FROM incidents
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY opened_at DESC, incident_id DESC) <= 10"""))
def memory_incidents(w):
    return memory.incident_frames(w.incidents).select("repo_id", "incident_id", "status", "entropy_to_latest", "pressure_to_latest",
                                                      "entropy_to_recovered", "pressure_to_recovered")


@register("similar_symbols", with_("vectors", select=f"""
  SELECT v.id, {fx('list_cosine_similarity(v.vector, q.vector)', 6)} AS score FROM vectors v, (SELECT * FROM vectors WHERE id = '7') q
  WHERE v.repo_id = 'repo-1' AND v.id <> '7' ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.id LIMIT 10"""))
def similar_symbols(w):
    return similarity.similar_symbols(w.vectors, "repo-1", "7").select("id", fixed("score", 6).alias("score"))


def modules_of(w):
    """Module rows for the similarity search: mean vector features per repository and module from the readings."""
    s = w.snapshots.filter(F.col("scope") == "module").groupBy("repo_id", F.col("subject_id").alias("module")).agg(
        F.max_by("signature", F.struct("at", "sha")).alias("s"))
    f = F.col("s")
    rows = s.select(
        "repo_id", "module", module_role("module", F.lit("")).alias("role"),
        f["graph"]["moduleDependencyCount"].cast("double").alias("module_dependency_count"),
        (f["graph"]["externalDependencyCount"] / 10.0).cast("double").alias("external_dependency_ratio"),
        f["complexity"]["avgCyclomatic"].alias("avg_cyclomatic"), f["semantic"]["aiEditRatio"].alias("ai_edit_ratio"),
        f["health"]["entropyIndex"].alias("code_entropy_index"), f["health"]["pressureIndex"].alias("pressure_index"),
        (f["volatility"]["churn24h"] / 10.0).cast("double").alias("edge_churn_ratio"))
    return rows.withColumn("vector", vectors.feature_vector(vectors.MODULE_FEATURES))


def fv(*pairs: tuple[str, float]) -> str:
    return "[" + ", ".join(fx(f"greatest(0.0, least(4.0, {c} / greatest({s}, 1.0)))", 6) for c, s in pairs) + "]"


MODS = ("mods", f"""
  SELECT *, {fv(('dep_count', 4), ('ext', .2), ('avg_cyc', 4), ('ai_ratio', .2), ('entropy', 14), ('pressure', 14), ('churn', .25))} AS vector,
    CASE WHEN subject_id LIKE '%web%' THEN 'edge' WHEN subject_id LIKE '%infra%' THEN 'adapter' WHEN subject_id LIKE '%shared%' THEN 'utility' ELSE 'core' END AS role
  FROM (SELECT repo_id, subject_id, dep_count, k5 / 10.0 AS ext, avg_cyc, ai_ratio, entropy, pressure, churn / 10.0 AS churn FROM (
    SELECT *, CAST(pressure AS INT) % 5 AS k5 FROM snapshots WHERE scope = 'module'
    QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id ORDER BY at DESC, sha DESC) = 1))""")


@register("similar_modules", with_("snapshots", MODS, ("q", "SELECT * FROM mods WHERE repo_id = 'repo-1' AND subject_id = 'web'"), ("near", """
  SELECT m.*, list_cosine_similarity(m.vector, q.vector) AS score, m.role = q.role AS same_role FROM mods m, q
  ORDER BY list_cosine_similarity(m.vector, q.vector) DESC, m.repo_id, m.subject_id LIMIT 14"""), select=f"""
  SELECT repo_id, subject_id AS module, role, same_role, {fx('score', 3)} AS score FROM near WHERE NOT (repo_id = 'repo-1' AND subject_id = 'web')
  ORDER BY same_role DESC, score DESC, repo_id, subject_id LIMIT 6"""))
def similar_modules(w):
    return similarity.similar_modules(modules_of(w), "repo-1", "web").select("repo_id", "module", "role", "same_role", "score")


REPO_ROWS = (
    ("lr", """SELECT repo_id, key, value FROM metrics WHERE scope = 'repo' QUALIFY row_number() OVER (PARTITION BY repo_id, key ORDER BY at DESC, sha DESC) = 1"""),
    ("rv", "SELECT repo_id, " + ", ".join(f"max(value) FILTER (key = '{k}') AS {k}" for k in similarity.REPO_VALUES) + " FROM lr GROUP BY 1"),
    ("rc", "SELECT repo_id, count(DISTINCT subject_id) AS component_count FROM metrics WHERE scope = 'module' AND key = 'pressure_index' GROUP BY 1"),
    ("ri", f"SELECT repo_id, count(*) AS incident_count FROM incidents WHERE opened_at >= {ASOF} - INTERVAL 14 DAY GROUP BY 1"),
    ("ra", f"""SELECT repo_id, count(*) AS week, count(*) FILTER (type IN ('ARCH_PRESSURE', 'ARCH_VIOLATION', 'ARCH_EMBED_DRIFT')) AS arch,
       count(*) FILTER (type = 'SEMANTIC_DUPLICATION') AS dup, count(*) FILTER (type = 'VOLATILITY_ZONE') AS vol
       FROM alerts WHERE at >= {ASOF} - INTERVAL 7 DAY GROUP BY 1"""),
    ("rr", "SELECT r.repo_id, r.name, " + ", ".join(f"coalesce({k}, 0)::DOUBLE AS {k}" for k in similarity.REPO_VALUES) + """,
       coalesce(component_count, 0) AS component_count, coalesce(incident_count, 0) AS incident_count, coalesce(week, 0) AS week,
       coalesce(arch, 0) AS arch, coalesce(dup, 0) AS dup, coalesce(vol, 0) AS vol
     FROM repos r LEFT JOIN rv USING (repo_id) LEFT JOIN rc USING (repo_id) LEFT JOIN ri USING (repo_id) LEFT JOIN ra USING (repo_id)"""),
    ("rp", """SELECT repo_id, list(label ORDER BY score DESC, place)[1] AS top FROM (
        SELECT repo_id, 0 AS place, 'Boundary Drift' AS label, arch + pressure_boundary / 22 AS score FROM rr UNION ALL
        SELECT repo_id, 1, 'Clone Drift', dup + pressure_semantic / 22 FROM rr UNION ALL
        SELECT repo_id, 2, 'Volatility Hotspot', vol + pressure_volatility / 22 FROM rr) WHERE score > 0.5 GROUP BY repo_id"""),
    ("rvec", f"""SELECT rr.*, CASE WHEN pressure_index < 35 AND code_entropy_index < 35 AND week < 3 THEN 'Stable Core' ELSE coalesce(top, 'Mixed Drift') END AS pattern,
        {fv(*[(n, s) for n, _, s in vectors.REPO_FEATURES])} AS vector FROM rr LEFT JOIN rp USING (repo_id)"""),
)


@register("repo_signatures", with_("repos metrics alerts incidents", *REPO_ROWS, select="""
  SELECT repo_id, name, pressure_index, code_entropy_index, component_count, incident_count, pattern, array_to_string(list_transform(vector, lambda x: round(x * 1000000)::BIGINT), ',') AS vector
  FROM rvec"""))
def repo_signatures(w):
    out = similarity.repo_rows(w.repos, w.metrics, w.alerts, w.incidents, w.as_of)
    whole = F.transform("vector", lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return out.select("repo_id", "name", "pressure_index", "code_entropy_index", "component_count", "incident_count",
                      F.col("pattern.label").alias("pattern"), F.array_join(whole, ",").alias("vector"))


@register("similar_repos", with_("repos metrics alerts incidents", *REPO_ROWS, ("q", "SELECT * FROM rvec WHERE repo_id = 'repo-3'"), select=f"""
  SELECT v.repo_id, v.name, {fx('list_cosine_similarity(v.vector, q.vector)', 3)} AS score, v.pattern,
    {fx(' + '.join(f"(1 - least(abs(v.{n} - q.{n}) / {s}, 1.0))" for n, _, s in vectors.REPO_FEATURES).join(('(', ') / 8')), 3)} AS feature_score
  FROM rvec v, q WHERE v.repo_id <> 'repo-3' AND list_sum(v.vector) > 0
  ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.repo_id LIMIT 5"""))
def similar_repos(w):
    rows = similarity.repo_rows(w.repos, w.metrics, w.alerts, w.incidents, w.as_of)
    out = similarity.similar_repos(rows, "repo-3")
    return out.select("repo_id", "name", "score", F.col("pattern.label").alias("pattern"), "feature_score")


@register("repo_feature_drivers", with_("repos metrics alerts incidents", *REPO_ROWS, ("q", "SELECT * FROM rvec WHERE repo_id = 'repo-3'"), ("p", " UNION ALL ".join(
    f"""SELECT v.repo_id, {i} AS place, {fx(f'-(1 - least(abs(v.{n} - q.{n}) / {s}, 1.0))', 9)} AS o,
      '{label} ' || {fxt(f'q.{n}', 2)} || ' vs ' || {fxt(f'v.{n}', 2)} AS t FROM rvec v, q WHERE v.repo_id <> 'repo-3' AND list_sum(v.vector) > 0"""
    for i, (n, label, s) in enumerate(vectors.REPO_FEATURES))), select="""
  SELECT repo_id, array_to_string(list(t ORDER BY o, place)[1:3], '|') AS drivers FROM p GROUP BY repo_id"""))
def repo_feature_drivers(w):
    rows = similarity.repo_rows(w.repos, w.metrics, w.alerts, w.incidents, w.as_of)
    out = similarity.similar_repos(rows, "repo-3", limit=None)
    return out.select("repo_id", F.array_join("drivers", "|").alias("drivers"))


@register("similar_repos_fallback", with_("repos metrics alerts incidents", *REPO_ROWS, ("q", "SELECT * FROM rvec WHERE repo_id = 'repo-15'"), select=f"""
  SELECT repo_id, score FROM (SELECT v.repo_id,
    {fx(' + '.join(f"(1 - least(abs(v.{n} - q.{n}) / {s}, 1.0))" for n, _, s in vectors.REPO_FEATURES).join(('(', ') / 8')), 3)} AS score
  FROM rvec v, q WHERE v.repo_id <> 'repo-15') ORDER BY score DESC, repo_id LIMIT 5"""))
def similar_repos_fallback(w):
    """A repository without readings has no direction, so closeness decides."""
    rows = similarity.repo_rows(w.repos, w.metrics, w.alerts, w.incidents, w.as_of)
    return similarity.similar_repos(rows, "repo-15").select("repo_id", "score")


BOUND = (
    ("lb", "SELECT * FROM metrics WHERE scope = 'boundary' AND key = 'pressure_index' QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id ORDER BY at DESC, sha DESC) = 1"),
    ("lm", "SELECT * FROM metrics WHERE scope = 'module' QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1"),
    ("mh", "SELECT repo_id, subject_id, max(value) FILTER (key = 'pressure_index') AS p, max(value) FILTER (key = 'code_entropy_index') AS e FROM lm GROUP BY ALL"),
    ("av", f"""SELECT repo_id, split_part(split_part(edge, ' -> ', 1), '/', 2) || '->' || split_part(split_part(edge, ' -> ', 2), '/', 2) AS b, count(*) AS n
       FROM alerts WHERE type = 'ARCH_VIOLATION' AND at >= {ASOF} - INTERVAL 7 DAY GROUP BY ALL"""),
    ("br", """SELECT lb.repo_id, lb.subject_id AS boundary_id, source_module, target_module, value AS pressure_index, edge_added, external_target,
        coalesce(mh.p, 0) AS source_pressure_index, coalesce(mh.e, 0) AS source_entropy_index, coalesce(n, 0) AS arch_violation_count
      FROM lb LEFT JOIN mh ON mh.repo_id = lb.repo_id AND mh.subject_id = lb.source_module LEFT JOIN av ON av.repo_id = lb.repo_id AND av.b = lb.subject_id"""),
    ("bv", f"SELECT *, {fv(*[(n, s) for n, _, s in vectors.BOUNDARY_FEATURES])} AS vector FROM br"),
)


@register("boundary_signatures", with_("metrics alerts", *BOUND, select="SELECT * FROM br"))
def boundary_signatures(w):
    return similarity.boundary_rows(w.metrics, w.alerts, w.as_of).drop("vector")


@register("similar_boundaries", with_("metrics alerts", *BOUND, ("q", "SELECT * FROM bv WHERE repo_id = 'repo-6' ORDER BY pressure_index DESC, boundary_id LIMIT 1"), ("near", """
  SELECT v.*, list_cosine_similarity(v.vector, q.vector) AS s, q.target_module AS qt, q.external_target AS qe, q.boundary_id AS qb FROM bv v, q
  ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.repo_id, v.boundary_id LIMIT 15"""), ("kept", """
  SELECT * FROM near WHERE NOT (repo_id = 'repo-6' AND boundary_id = qb) ORDER BY s DESC, repo_id, boundary_id LIMIT 5"""), select=f"""
  SELECT repo_id, boundary_id, target_module, {fx('s + CASE WHEN target_module = qt THEN 0.08 ELSE 0.0 END + CASE WHEN external_target = qe THEN 0.04 ELSE 0.0 END', 3)} AS score
  FROM kept"""))
def similar_boundaries(w):
    rows = similarity.boundary_rows(w.metrics, w.alerts, w.as_of)
    return similarity.similar_boundaries(rows, "repo-6").select("repo_id", "boundary_id", "target_module", "score")


# the hits of the three searches as SQL: repo_id and subject_id
HITS = {
    "module": ("snapshots", (MODS, ("q", "SELECT * FROM mods WHERE repo_id = 'repo-1' AND subject_id = 'web'"), ("near", """
      SELECT m.*, list_cosine_similarity(m.vector, q.vector) AS score, m.role = q.role AS same_role FROM mods m, q
      ORDER BY list_cosine_similarity(m.vector, q.vector) DESC, m.repo_id, m.subject_id LIMIT 14"""), ("hits", """
      SELECT repo_id, subject_id FROM near WHERE NOT (repo_id = 'repo-1' AND subject_id = 'web') ORDER BY same_role DESC, score DESC, repo_id, subject_id LIMIT 6"""))),
    "repo": ("repos metrics alerts", (*REPO_ROWS, ("q", "SELECT * FROM rvec WHERE repo_id = 'repo-3'"), ("hits", """
      SELECT v.repo_id, v.repo_id AS subject_id FROM rvec v, q WHERE v.repo_id <> 'repo-3' AND list_sum(v.vector) > 0
      ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.repo_id LIMIT 5"""))),
    "boundary": ("metrics alerts", (*BOUND, ("q", "SELECT * FROM bv WHERE repo_id = 'repo-6' ORDER BY pressure_index DESC, boundary_id LIMIT 1"), ("near", """
      SELECT v.*, list_cosine_similarity(v.vector, q.vector) AS s, q.boundary_id AS qb FROM bv v, q
      ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.repo_id, v.boundary_id LIMIT 15"""), ("hits", """
      SELECT repo_id, boundary_id AS subject_id FROM near WHERE NOT (repo_id = 'repo-6' AND boundary_id = qb) ORDER BY s DESC, repo_id, boundary_id LIMIT 5"""))),
}
OWNER = {"module": "i.scope = 'module' AND i.subject_id = h.subject_id", "repo": "true",
         "boundary": "i.scope = 'module' AND i.subject_id = split_part(h.subject_id, '->', 1)"}


def hits_of(w, scope):
    """The hits of the registered search of a scope, and the column that names them; written once, since two plans read them."""
    if scope == "module":
        return materialized(similarity.similar_modules(modules_of(w), "repo-1", "web").select("repo_id", "module"), "hits"), "module"
    if scope == "repo":
        rows = similarity.repo_rows(w.repos, w.metrics, w.alerts, w.incidents, w.as_of)
        return materialized(similarity.similar_repos(rows, "repo-3").select("repo_id"), "hits"), "repo_id"
    rows = similarity.boundary_rows(w.metrics, w.alerts, w.as_of)
    return materialized(similarity.similar_boundaries(rows, "repo-6").select("repo_id", "boundary_id"), "hits"), "boundary_id"


def _hits(scope):
    tables, steps = HITS[scope]
    plural = {"module": "modules", "repo": "repos", "boundary": "boundaries"}[scope]

    @register(f"similar_{plural}_fixes", with_(f"{tables} incidents refactors", *steps, FIXES[scope], select=f"""
      SELECT {FIX_COLUMNS} FROM fixes WHERE (repo_id, subject_id) IN (SELECT (repo_id, subject_id) FROM hits)"""))
    def fixes(w):
        hits, name = hits_of(w, scope)
        out = similarity.hit_fixes(hits, name, w.refactors, scope)
        return out.select("repo_id", "subject_id", F.col("rank").cast("bigint").alias("rank"), "id", "type", "target",
                          fixed("confidence", 6).alias("confidence"), "status")

    @register(f"similar_{plural}_outcomes", with_(f"{tables} incidents refactors", *steps, FIXES[scope], ("last", f"""
      SELECT h.subject_id AS subject, i.*, row_number() OVER (PARTITION BY h.repo_id, h.subject_id
          ORDER BY closed_at DESC NULLS LAST, opened_at DESC, incident_id DESC) AS rank
      FROM hits h JOIN incidents i ON i.repo_id = h.repo_id AND i.status = 'closed' AND {OWNER[scope]} QUALIFY rank <= 3"""), select=f"""
      SELECT l.repo_id, l.subject AS subject_id, l.rank, l.incident_id, l.type, epoch_us(l.closed_at) AS closed_us, {fx('l.post_e - l.pre_e', 2)} AS delta_entropy,
        {fx('l.post_p - l.pre_p', 2)} AS delta_pressure, coalesce(res_type, f.type, g.type) AS fix_type, coalesce(res_target, f.target, g.target) AS fix_target,
        CASE WHEN res_type IS NOT NULL THEN 'applied' ELSE coalesce(f.status, g.status, 'observed') END AS fix_status
      FROM last l LEFT JOIN fixes f ON f.repo_id = l.repo_id AND f.subject_id = l.subject AND f.rank = l.rank
        LEFT JOIN fixes g ON g.repo_id = l.repo_id AND g.subject_id = l.subject AND g.rank = 1"""))
    def outcomes(w):
        hits, name = hits_of(w, scope)
        out = similarity.hit_outcomes(hits, name, w.incidents, w.refactors, scope)
        return out.select("repo_id", "subject_id", F.col("rank").cast("bigint").alias("rank"), "incident_id", "type", micros("closed_at").alias("closed_us"),
                          "delta_entropy", "delta_pressure", "fix_type", "fix_target", "fix_status")


for _scope in HITS:
    _hits(_scope)


def _trend(frame, n):
    @register(f"report_trend_{frame or 12}", with_("snapshots incidents", ("top", f"""
      SELECT * FROM snapshots WHERE scope = 'repo' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) <= {n}"""), select="""
      SELECT repo_id, sha, epoch_us(at) AS at_us, entropy AS entropy_index, pressure AS pressure_index, CAST(arch_violations AS DOUBLE) AS arch_violations,
        CAST(ai_ratio AS DOUBLE) AS ai_edit_ratio, (SELECT count(*) FROM incidents i WHERE i.repo_id = top.repo_id AND i.opened_at <= top.at
          AND (i.closed_at IS NULL OR i.closed_at >= top.at)) AS incident_count FROM top"""))
    def build(w):
        return memory.report_trend(w.snapshots, w.incidents, frame).withColumn("at_us", micros("at")).drop("at")
    return build


for _frame, _n in ((None, 12), ("24", 24), ("all", 96)):
    _trend(_frame, _n)


def overview_of(w):
    return fleet.overview_repos(w.repos, w.metrics, w.alerts, w.activity, w.as_of)


SEV = "CASE latest_severity WHEN 'error' THEN 100 WHEN 'warn' THEN {} ELSE {} END"


@register("fleet_ranking", with_("repos metrics activity alerts", *OVERVIEW, select=f"""
  SELECT repo_id, {fx(f"coalesce(pressure_index, 0) + {SEV.format(58, 18)} * 0.35 + alert_count * 6", 6)} AS weight FROM overview
  ORDER BY weight DESC, repo_id LIMIT 6"""))
def fleet_ranking(w):
    return rankings.fleet_ranking(overview_of(w)).select("repo_id", "weight")


@register("surface_ranking", with_("repos metrics activity alerts", *OVERVIEW, select=f"""
  SELECT repo_id, {fx(f"{SEV.format(60, 20)} + coalesce(pressure_index, 0) + coalesce(entropy_index, 0) * 0.35 + alert_count * 6 + activity_24h * 0.4", 6)} AS weight
  FROM overview ORDER BY weight DESC, repo_id LIMIT 6"""))
def surface_ranking(w):
    return rankings.surface_ranking(overview_of(w)).select("repo_id", "weight")


@register("severity_tally", with_("repos metrics activity alerts", *OVERVIEW, select="""
  SELECT CASE latest_severity WHEN 'error' THEN 'critical' WHEN 'warn' THEN 'warning' ELSE 'quiet' END AS posture, count(*) AS repos FROM overview GROUP BY 1"""))
def severity_tally(w):
    return rankings.severity_tally(overview_of(w))


@register("component_ranking", with_("metrics", *COMPONENTS, select=f"""
  SELECT component, {fx('coalesce(pressure_index, 0) * 1.2 + coalesce(avg_ai_risk, 0) + coalesce(avg_cyclomatic, 0) * 3 + coalesce(entropy_index, 0) * 0.65', 6)} AS weight
  FROM comp WHERE repo_id = 'repo-0' ORDER BY weight DESC, component LIMIT 8"""))
def component_ranking(w):
    return rankings.component_ranking(w.metrics, "repo-0").select("component", "weight")


@register("component_means", with_("metrics", *COMPONENTS, select=f"""
  SELECT repo_id, {fx('avg(coalesce(avg_ai_risk, 0))', 6)} AS avg_ai_risk, {fx('avg(coalesce(avg_cyclomatic, 0))', 6)} AS avg_cyclomatic FROM comp GROUP BY 1"""))
def component_means(w):
    return rankings.component_means(w.metrics)


@register("watch_rollup", f"""SELECT count(*) AS repos, count(*) FILTER (watch_state = 'active') AS active, count(*) FILTER (watch_state = 'pending') AS pending,
  count(*) FILTER (watch_state = 'blocked') AS blocked, count(*) FILTER (watch_state = 'inactive') AS inactive,
  CAST(round(avg(coverage_percent)) AS BIGINT) AS coverage_avg, CAST(sum(unsupported_events) AS BIGINT) AS unsupported_events FROM ({repo_list_sql(False)})""")
def watch_rollup(w):
    return rankings.watch_rollup(fleet.repo_list(w.repos, w.metrics, w.activity, w.as_of, include_archived=True))


@register("idle_surfaces", f"SELECT repo_id, name FROM ({repo_list_sql(False)}) WHERE watch_enabled AND watch_state = 'active' AND activity_24h = 0")
def idle_surfaces(w):
    return rankings.idle_surfaces(fleet.repo_list(w.repos, w.metrics, w.activity, w.as_of))


@register("first_activity", with_("repos activity", ("r", """SELECT a.*, n.name FROM activity a JOIN repos n ON n.repo_id = a.repo_id AND n.archived_at IS NULL
  ORDER BY a.at DESC, a.event_id DESC LIMIT 14"""), select="""
  SELECT repo_id, event_id, parser_status FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, event_id DESC) = 1)
  ORDER BY at DESC, event_id DESC LIMIT 6"""))
def first_activity(w):
    return rankings.first_activity(fleet.recent_activity(w.activity, w.repos)).select("repo_id", "event_id", "parser_status")


@register("minute_series", with_("metrics", ("n", """SELECT * FROM metrics WHERE repo_id = 'repo-3' AND module = 'web'
  ORDER BY at DESC, sha DESC, subject_id DESC, key DESC LIMIT 80"""), select="""
  SELECT strftime(at, '%H:%M') AS label, coalesce(arg_max(value, (at, sha, subject_id)) FILTER (key = 'code_entropy_index'), 0) AS entropy,
    coalesce(arg_max(value, (at, sha, subject_id)) FILTER (key = 'pressure_index'), 0) AS pressure FROM n GROUP BY 1"""))
def minute_series(w):
    return rankings.minute_series(w.metrics, "repo-3", "web")


@register("activity_facts", with_("activity", select="""
  SELECT event_id, CASE WHEN alert_count > 0 AND parser_status = 'unsupported' THEN 'heuristic fired' WHEN alert_count > 0 THEN 'drift rule hit'
      WHEN parser_status = 'unsupported' THEN 'watched-only lane' WHEN parser_status = 'no_symbols' THEN 'parsed no symbols'
      WHEN parser_status = 'pending' THEN 'awaiting parser' ELSE 'below alert threshold' END AS reason,
    CASE WHEN alert_count > 0 THEN 'error' WHEN parser_status = 'analyzed' THEN 'healthy' ELSE 'warn' END AS tone,
    CASE WHEN alert_count > 0 THEN 'error' WHEN parser_status = 'analyzed' THEN 'healthy' ELSE 'warn' END AS fleet_tone FROM activity"""))
def activity_facts(w):
    return rankings.activity_facts(w.activity)
