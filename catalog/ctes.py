"""The domain tables as SQL over the fixture tables, one text per table."""

from __future__ import annotations

import re

MODULES = "['domain','web','infra','shared','core','jobs']"
ASOF = "TIMESTAMP '2024-01-31 00:00:00'"


def fx(expr: str, n: int) -> str:
    """Rounding as in the plans: nine decimals first, then half up."""
    return f"CAST(round(CAST({expr} AS DECIMAL(18,9)), {n}) AS DOUBLE)"


def fxt(expr: str, n: int) -> str:
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(18,9)), {n}) AS DECIMAL(18,{n})) AS VARCHAR)"


def c01(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


PARTS = {
    "ev0": f"""
      SELECT event_id, ts AS at, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k,
        'repo-' || (user_id % 10) AS repo_id, ({MODULES})[(user_id // 10) % 6 + 1] AS module
      FROM events""",
    "ev": """
      SELECT *, file_path || ':fn' || (k % 4) || ':' || (k % 4 * 10 + 1) AS symbol_id,
        'c' || (event_id // 5) AS sha,
        (['human','claude','codex','cursor','unknown'])[k % 5 + 1] AS provenance
      FROM (SELECT *, 'src/' || module || '/f' || (k % 7) ||
              (['.ts','.py','.css','.json','.md','.js','.go'])[k % 7 + 1] AS file_path FROM ev0)""",
    "repos": """
      SELECT 'repo-' || n_nationkey AS repo_id, n_name AS name,
        CASE WHEN n_nationkey % 3 <> 0 THEN 'local' ELSE 'remote' END AS kind,
        CASE WHEN n_nationkey % 3 <> 0 THEN '/host-repos/' || n_name END AS root_path,
        n_nationkey % 4 <> 3 AS watch_enabled,
        CASE WHEN n_nationkey % 4 = 3 THEN 'inactive' WHEN n_nationkey % 7 = 0 THEN 'blocked'
             WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'pending' END AS watch_state,
        TIMESTAMP '2023-12-01' + n_nationkey * INTERVAL 1 DAY AS created_at,
        CASE WHEN n_nationkey % 5 = 4 THEN TIMESTAMP '2024-01-10' END AS archived_at
      FROM nation""",
    "metrics": f"""
      SELECT repo_id, sha, at, 'symbol' AS scope, symbol_id AS subject_id,
        CASE event_type WHEN 'click' THEN 'cyclomatic' WHEN 'view' THEN 'line_count'
          WHEN 'purchase' THEN 'ai_risk_score' ELSE 'nesting_depth' END AS key,
        CAST(CASE event_type WHEN 'click' THEN floor(value / 8) + 1 WHEN 'view' THEN floor(value) + 1
          WHEN 'purchase' THEN least(100.0, value) ELSE floor(value / 40) END AS DOUBLE) AS value,
        module, file_path, provenance, NULL::INT AS dep_count, NULL::INT AS ext_count, NULL AS source_module,
        NULL AS target_module, NULL::DOUBLE AS edge_added, NULL::DOUBLE AS external_target
      FROM ev WHERE event_type <> 'error'
      UNION ALL
      SELECT repo_id, sha, at, 'module', module,
        CASE event_type WHEN 'click' THEN 'code_entropy_index' WHEN 'view' THEN 'pressure_index'
          WHEN 'purchase' THEN (['dependency_entropy','duplication_entropy','complexity_entropy',
                                 'change_entropy','architecture_entropy'])[k % 5 + 1]
          ELSE (['pressure_change','pressure_coupling','pressure_semantic','pressure_boundary',
                 'pressure_entropy','pressure_volatility'])[k % 6 + 1] END,
        least(100.0, value * 0.5 + 10), module, NULL, NULL, k % 12, k % 5, NULL, NULL, NULL, NULL
      FROM ev WHERE event_type <> 'error'
      UNION ALL
      SELECT repo_id, sha, at, 'repo', repo_id,
        CASE WHEN event_type = 'purchase' THEN (['pressure_boundary','pressure_coupling','pressure_semantic',
             'pressure_volatility','dependency_entropy'])[k % 5 + 1]
          WHEN k % 2 = 0 THEN 'code_entropy_index' ELSE 'pressure_index' END,
        least(100.0, value * 0.5 + 10), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM ev WHERE event_type IN ('signup', 'purchase')
      UNION ALL
      SELECT repo_id, sha, at, 'boundary', module || '->' || target, 'pressure_index',
        least(100.0, value * 0.5 + 10), module, NULL, NULL, NULL, NULL, module, target,
        CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'pkg:lib' || (k % 3) ELSE ({MODULES})[k % 6 + 1] END AS target
            FROM ev WHERE event_type = 'purchase')""",
    "alerts": """
      SELECT repo_id, sha, at,
        CASE WHEN value > 80 THEN 'error' WHEN value > 30 THEN 'warn' ELSE 'info' END AS severity,
        type, type || ' in ' || module AS title, status, value, k,
        CASE WHEN k % 8 <> 0 THEN file_path END AS ev_path,
        CASE WHEN k % 16 <> 0 THEN symbol_id END AS ev_symbol,
        CASE WHEN k % 4 <> 0 THEN module END AS ev_module,
        CASE WHEN type = 'CONTENT_HEURISTIC' THEN
          (['SECRET_PLACEHOLDER','LOCAL_ENDPOINT','DEBUG_CONFIG',''])[k % 4 + 1] END AS ev_category,
        CASE WHEN type = 'SEMANTIC_DUPLICATION' THEN 'n' || k END AS nb_id,
        CASE WHEN type = 'SEMANTIC_DUPLICATION' THEN k / 100.0 END AS nb_score,
        CASE WHEN type = 'ARCH_VIOLATION' THEN 'src/domain/f' || (k % 3) || '.ts -> src/' ||
          (['web','infra'])[k % 2 + 1] || '/f' || (k % 2) || '.ts' END AS edge,
        'Review changes in ' || file_path || ': fake secret placeholder, tbd x' || (k % 3) || '.' AS recommendation,
        CASE WHEN status <> 'open' THEN at + INTERVAL 1 HOUR END AS acknowledged_at,
        CASE WHEN status <> 'open' THEN 'ops' END AS acknowledged_by,
        CASE WHEN status = 'resolved' THEN at + INTERVAL 2 HOUR END AS resolved_at,
        CASE WHEN status = 'resolved' THEN 'ops' END AS resolved_by
      FROM (SELECT *, (['SEMANTIC_DUPLICATION','INTENT_DRIFT','COMPLEXITY_CREEP','ARCH_VIOLATION',
              'ARCH_EMBED_DRIFT','ARCH_PRESSURE','ENTROPY_DRIFT','VOLATILITY_ZONE','CONTENT_HEURISTIC']
              )[event_id % 9 + 1] AS type,
              (['open','acknowledged','resolved'])[k % 3 + 1] AS status
            FROM ev WHERE event_type = 'error')""",
    "activity": """
      SELECT 'a' || event_id AS event_id, repo_id, sha AS commit_sha, at, file_path,
        CASE WHEN k % 11 <> 0 THEN
          (['typescript','python','css','json','markdown','javascript','go'])[k % 7 + 1] END AS language,
        (['added','modified','deleted'])[k % 3 + 1] AS change_type,
        (['pending','analyzed','unsupported','no_symbols'])[k % 4 + 1] AS parser_status,
        k AS symbol_count, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS alert_count
      FROM ev""",
    "telemetry": """
      SELECT 't' || event_id AS id, repo_id,
        CASE WHEN k % 3 <> 0 THEN 'src/' || module || '/index.ts' ELSE 'elsewhere.ts' END AS file_path,
        '/host-repos/' || repo_id || '/src/' || module || '/index.ts' AS absolute_path, provenance,
        'editor' AS source, (['vim','code'])[k % 2 + 1] AS editor,
        CASE WHEN k % 3 <> 1 THEN 's' || (k % 10) END AS session_id, at AS observed_at
      FROM ev WHERE event_type = 'signup'""",
    "changes": """
      SELECT event_id AS change_id, repo_id, sha AS commit_sha, at, 'src/' || module || '/index.ts' AS file_path,
        '/host-repos/' || repo_id || '/src/' || module || '/index.ts' AS absolute_path,
        (['added','modified','deleted'])[k % 3 + 1] AS change_type
      FROM ev WHERE event_type = 'view'""",
    "snapshots": """
      SELECT repo_id, sha, at, CASE WHEN k % 2 = 0 THEN 'repo' ELSE 'module' END AS scope,
        CASE WHEN k % 2 = 0 THEN repo_id ELSE module END AS subject_id,
        k % 3 AS arch_violations, k % 12 AS dep_count, k % 10 / 10.0 AS ai_ratio, k % 4 AS dup_alerts,
        least(100.0, value) AS entropy, CAST(k AS DOUBLE) AS pressure, CAST(k % 9 AS DOUBLE) AS avg_cyc, k % 6 AS churn
      FROM ev WHERE event_type = 'purchase'""",
    "incidents": """
      SELECT repo_id, 'i' || event_id AS incident_id, (['ENTROPY_DRIFT','ARCH_PRESSURE'])[k % 2 + 1] AS type,
        CASE WHEN k % 5 = 0 THEN 'repo' ELSE 'module' END AS scope,
        CASE WHEN k % 5 = 0 THEN repo_id ELSE module END AS subject_id,
        CASE WHEN k % 4 = 0 THEN 'open' ELSE 'closed' END AS status,
        CASE WHEN value > 80 THEN 'error' ELSE 'warn' END AS severity, at AS opened_at,
        CASE WHEN k % 4 <> 0 THEN at + CAST(floor(value * 10) AS INT) * INTERVAL 1 MINUTE END AS closed_at,
        least(100.0, value) AS pre_e, CAST(k AS DOUBLE) AS pre_p, least(100.0, value) AS latest_e,
        CAST(k + 1 AS DOUBLE) AS latest_p,
        CASE WHEN k % 4 <> 0 THEN least(100.0, value / 2) END AS post_e,
        CASE WHEN k % 4 <> 0 THEN CAST(k - 10 AS DOUBLE) END AS post_p, sha AS opened_sha,
        CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN
          (['DEDUPE_CLUSTER','INVERT_BOUNDARY','EXTRACT_MODULE'])[k % 3 + 1] END AS res_type,
        CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN module END AS res_target
      FROM ev WHERE event_type = 'error'""",
    "refactors": f"""
      SELECT 'repo-' || (o_custkey % 10) AS repo_id, 'rfx_' || o_orderkey AS id, o_orderdate AS at,
        (['file','boundary','module'])[o_orderkey % 3 + 1] AS scope,
        CASE o_orderkey % 3 WHEN 0 THEN 'src/' || module || '/f0.ts' WHEN 1 THEN edge ELSE module END AS target,
        (['DEDUPE_CLUSTER','INVERT_BOUNDARY','EXTRACT_MODULE'])[o_orderkey % 3 + 1] AS type,
        least(0.96, o_totalprice / 600000.0) AS confidence, -(o_orderkey % 30) AS entropy_delta,
        -(o_orderkey % 40) AS pressure_delta, module, edge, 'src/' || module || '/f0.ts' AS file,
        (['proposed','accepted','applied','dismissed'])[(o_orderkey // 6) % 4 + 1] AS status
      FROM (SELECT *, ({MODULES})[o_orderkey % 6 + 1] AS module,
              ({MODULES})[o_orderkey % 6 + 1] || '->' || ({MODULES})[(o_orderkey // 7) % 6 + 1] AS edge FROM orders)""",
    "commits": """
      SELECT 'repo-' || (o_custkey % 10) AS repo_id, 'o' || o_orderkey AS sha, 'dev' || o_custkey AS author,
        o_orderpriority AS message, o_orderdate AS ts
      FROM orders""",
    "edges": f"""
      SELECT repo_id, module, file_path, at, module || '->' ||
        CASE WHEN k % 4 = 0 THEN 'pkg:lib' || (k % 3) ELSE ({MODULES})[k % 6 + 1] END AS edge
      FROM ev WHERE event_type = 'purchase'""",
    "page_files": """
      SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo_id,
        'src/' || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS file_path, html AS source
      FROM pages""",
    "vectors": """
      SELECT CAST(vec_id AS VARCHAR) AS id, 'repo-' || (vec_id % 3) AS repo_id, 'm' || label AS module,
        'h' || (vec_id % 50) AS norm_hash, (['human','claude','codex','cursor','unknown'])[vec_id % 5 + 1] AS provenance,
        CAST(embedding AS DOUBLE[]) AS vector, vec_id
      FROM embeddings""",
    "python_sources": """
      SELECT doc_id, 'repo-' || (doc_id % 10) AS repo_id, 'src/' || lang || '/d' || doc_id || '.py' AS file_path,
        'from "./base" import Base' || chr(10) || 'class Doc' || doc_id || '(Base):' || chr(10) || '    def run_' || doc_id ||
        '(self):' || chr(10) || '        ' || replace(text, chr(10), chr(10) || '        ') || chr(10) || chr(10) || 'def tail_' ||
        doc_id || '(x):' || chr(10) || '    return run_' || doc_id || '(x)' || chr(10) AS source
      FROM documents""",
}
NEEDS = {
    "ev": ["ev0"], "metrics": ["ev0", "ev"], "alerts": ["ev0", "ev"], "activity": ["ev0", "ev"],
    "telemetry": ["ev0", "ev"], "changes": ["ev0", "ev"], "snapshots": ["ev0", "ev"], "incidents": ["ev0", "ev"],
    "edges": ["ev0", "ev"],
}


def with_(tables: str = "", *own: tuple[str, str], select: str, recursive: bool = False) -> str:
    """A query with the named domain tables and its own steps in front."""
    order: list[str] = []
    for name in tables.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in order:
                order.append(part)
    steps = [f"{n} AS ({PARTS[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in own]
    head = "WITH RECURSIVE " if recursive else "WITH "
    sql = (head + ",\n".join(steps) + "\n" if steps else "") + select
    # "at" is a keyword of the checking engine
    return re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', sql)
