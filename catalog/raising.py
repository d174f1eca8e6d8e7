"""Alerts from the rules to the table and on to stale modules."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import micros
from plumbline.operators.shared import materialized
from plumbline.plans import raising

from .base import register
from .ctes import ASOF, fx, with_
from .rules import DUP, RECOVERED

STORED = "2024-01-15"  # what was raised before is in the table already
STEPS = (*RECOVERED[:-1], ("raised", f"""
  SELECT repo_id, sha, at, anomaly AS severity, 'ENTROPY_DRIFT' AS type, CASE scope WHEN 'repo' THEN 'Repo' ELSE 'Module' END || ' entropy rising in ' || subject_id AS title,
    CASE WHEN scope = 'module' THEN subject_id END AS module, {fx('value', 2)} AS x, {fx('prev', 2)} AS y FROM e_assessed WHERE anomaly IS NOT NULL
  UNION ALL SELECT repo_id, sha, at, anomaly, 'ARCH_PRESSURE', 'Architecture pressure building in ' || subject_id, subject_id, {fx('value', 2)}, delta FROM p_assessed WHERE anomaly IS NOT NULL
  UNION ALL SELECT repo_id, sha, at, CASE WHEN cyclomatic >= 25 OR ai_risk_score >= 75 THEN 'error' ELSE 'warn' END, 'COMPLEXITY_CREEP', 'Complexity threshold exceeded for ' || subject_id, NULL, NULL, NULL FROM (
    SELECT repo_id, sha, subject_id, max(at) AS at, coalesce(arg_max(value, at) FILTER (key = 'cyclomatic'), 0) AS cyclomatic,
      coalesce(arg_max(value, at) FILTER (key = 'ai_risk_score'), 0) AS ai_risk_score, coalesce(arg_max(value, at) FILTER (key = 'line_count'), 0) AS line_count
    FROM metrics WHERE scope = 'symbol' AND key IN ('cyclomatic', 'ai_risk_score', 'line_count') GROUP BY repo_id, sha, subject_id) WHERE cyclomatic >= 15 OR ai_risk_score >= 50 OR line_count >= 120
  UNION ALL SELECT repo_id, arg_max(sha, (at, sha)), {ASOF}, 'warn', 'VOLATILITY_ZONE', 'High change volatility detected for ' || file_path, split_part(file_path, '/', 2), NULL, NULL FROM metrics
    WHERE at >= {ASOF} - INTERVAL 24 HOUR AND file_path IS NOT NULL GROUP BY repo_id, file_path HAVING count(DISTINCT sha) > 1
  UNION ALL SELECT repo_id, 'head', {ASOF}, CASE WHEN s > 0.98 AND provenance NOT IN ('human', 'unknown') THEN 'error' WHEN s > 0.95 THEN 'warn' ELSE 'info' END, 'SEMANTIC_DUPLICATION', 'Near-duplicate logic detected for ' || id, NULL, NULL, NULL
    FROM (SELECT repo_id, id, any_value(provenance) AS provenance, max(s) AS s FROM (
      SELECT a.repo_id, a.id, a.provenance, a.norm_hash AS h1, b.norm_hash AS h2, list_cosine_similarity(a.vector, b.vector) AS s
      FROM vectors a JOIN vectors b ON a.repo_id = b.repo_id AND a.id <> b.id AND list_cosine_similarity(a.vector, b.vector) >= {DUP}
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.vector, b.vector) DESC, b.id) <= 4) WHERE h1 <> h2 GROUP BY repo_id, id)
  UNION ALL SELECT repo_id, 'head', {ASOF}, 'warn', 'INTENT_DRIFT', 'Module intent drift detected in ' || module, module, NULL, NULL FROM (
    SELECT a.repo_id, a.module, a.id, list_cosine_similarity(a.vector, b.vector) AS s
    FROM vectors a JOIN vectors b ON a.repo_id = b.repo_id AND a.module = b.module AND a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.vector, b.vector) DESC, b.id) <= 6)
    GROUP BY repo_id, module, id HAVING count(*) >= 3 AND avg(s) < 0.55"""))
INSERTED = (("f", """
  SELECT *, concat_ws('|', repo_id, type, severity, title, module, x, y) AS fp FROM raised WHERE type IN ('ENTROPY_DRIFT', 'ARCH_PRESSURE')"""), ("chain", """
  SELECT fp, min(epoch_us(at) // 1000) AS t FROM f GROUP BY fp
  UNION ALL SELECT c.fp, (SELECT min(epoch_us(f.at) // 1000) FROM f WHERE f.fp = c.fp AND epoch_us(f.at) // 1000 >= c.t + 900000) FROM chain c WHERE c.t IS NOT NULL"""), ("passed", """
  SELECT repo_id, sha, at, severity, type, title, module FROM f WHERE (fp, epoch_us(at) // 1000) IN (SELECT (fp, t) FROM chain)
  UNION ALL SELECT repo_id, sha, at, severity, type, title, module FROM raised WHERE type NOT IN ('ENTROPY_DRIFT', 'ARCH_PRESSURE')"""), ("entered", f"""
  SELECT repo_id, sha, at, type, title, min(severity) AS severity, min(module) AS module FROM passed WHERE at >= TIMESTAMP '{STORED}' GROUP BY repo_id, sha, at, type, title"""))
OUT = "repo_id, sha, epoch_us(at) AS at_us, severity, type, title"


def raised(w):
    head = F.lit("head")
    return raising.from_metrics(w.metrics, w.as_of, volatile_above=1).unionByName(raising.from_vectors(w.vectors, head, w.as_of, min_score=DUP))


def shown(df):
    return df.select("repo_id", "sha", micros("at").alias("at_us"), "severity", "type", "title")


def entered(w):
    rows = materialized(raised(w), "raised_alerts")
    before = w.alerts.select(*raising.KEY).unionByName(rows.filter(F.col("at") < F.lit(STORED).cast("timestamp")).select(*raising.KEY))
    return raising.inserted(rows, before)


@register("raised_alerts", with_("metrics vectors", *STEPS, select=f"SELECT {OUT} FROM raised"))
def raised_alerts(w):
    return shown(raised(w))


@register("inserted_alerts", with_("metrics vectors", *STEPS, *INSERTED, recursive=True, select=f"SELECT {OUT} FROM entered"))
def inserted_alerts(w):
    return shown(entered(w))


@register("refreshed_modules", with_("metrics vectors", *STEPS, *INSERTED, recursive=True, select="""
  SELECT DISTINCT repo_id, module, sha, epoch_us(at) AS at_us FROM entered WHERE type = 'VOLATILITY_ZONE'
  UNION ALL SELECT repo_id, regexp_extract(title, '[0-9]+$') AS module, sha, epoch_us(at) FROM entered WHERE type = 'SEMANTIC_DUPLICATION'"""))
def refreshed_modules(w):
    out = raising.refreshed(entered(w))
    return out.select("repo_id", "module", "sha", micros("at").alias("at_us")).distinct()
