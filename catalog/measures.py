"""Module, repository and boundary readings; dependency edges."""

from pyspark.sql import functions as F

from plumbline.functions.numeric import fixed
from plumbline.operators.edges import bucket_entropy
from plumbline.plans import graph, measures
from plumbline.schema import ENTROPY_KEYS, PRESSURE_KEYS

from .base import register
from .ctes import ASOF, c01, fx, with_

DAY = f"at >= {ASOF} - INTERVAL 24 HOUR"
AI = "CASE WHEN coalesce(provenance, 'unknown') IN ('human', 'unknown') THEN 0.0 ELSE 1.0 END"
STATE = ("state", """SELECT * FROM metrics WHERE scope = 'symbol'
  QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1""")


def summary(keys: str) -> str:
    return f"""SELECT {keys}, count(DISTINCT subject_id) AS symbol_count, count(DISTINCT file_path) AS file_count,
      coalesce(avg(value) FILTER (key = 'cyclomatic'), 0) AS avg_cyc,
      coalesce(stddev_pop(value) FILTER (key = 'cyclomatic'), 0) AS dev_cyc,
      coalesce(max(value) FILTER (key = 'cyclomatic'), 0) AS max_cyc,
      coalesce(avg(value) FILTER (key = 'ai_risk_score'), 0) AS avg_risk,
      coalesce(avg(value) FILTER (key = 'nesting_depth'), 0) AS avg_nest,
      coalesce(max(value) FILTER (key = 'line_count'), 0) AS max_lines,
      {c01(f"coalesce(avg({AI}) FILTER (key = 'ai_risk_score'), 0)")} AS ai FROM state GROUP BY ALL"""


COUNTS = """count(*) FILTER (type = 'SEMANTIC_DUPLICATION') AS dup, count(*) FILTER (type = 'ARCH_VIOLATION') AS viol,
  count(*) FILTER (type = 'ARCH_EMBED_DRIFT') AS drift, count(*) FILTER (type = 'ARCH_PRESSURE') AS press,
  count(*) FILTER (type = 'VOLATILITY_ZONE') AS vola"""
MODULE_STEPS = (
    STATE, ("ms", summary("repo_id, module")),
    ("mc", f"SELECT repo_id, module, count(DISTINCT sha) AS churn FROM metrics WHERE scope = 'symbol' AND {DAY} GROUP BY ALL"),
    ("ma", f"""SELECT m.repo_id, m.module, {COUNTS} FROM ms m JOIN alerts a ON a.repo_id = m.repo_id
       AND (a.ev_module = m.module OR a.ev_path LIKE 'src/' || m.module || '/%' OR a.ev_symbol LIKE 'src/' || m.module || '/%')
       WHERE a.{DAY} GROUP BY ALL"""),
    ("inp", """SELECT ms.*, coalesce(churn, 0) AS churn, coalesce(dup, 0) AS dup, coalesce(viol, 0) AS viol,
       coalesce(drift, 0) AS drift, coalesce(press, 0) AS press, coalesce(vola, 0) AS vola
       FROM ms LEFT JOIN mc USING (repo_id, module) LEFT JOIN ma USING (repo_id, module)"""),
)


@register("module_inputs", with_("metrics alerts", *MODULE_STEPS, select=f"""
  SELECT repo_id, module, symbol_count, file_count, {fx('avg_cyc', 6)} AS avg_cyclomatic, {fx('dev_cyc', 4)} AS stddev_cyclomatic,
    max_cyc AS max_cyclomatic, {fx('avg_risk', 6)} AS avg_ai_risk, {fx('ai', 6)} AS ai_edit_ratio, churn AS churn_24h,
    dup AS duplication_alerts, viol AS arch_violations, drift AS arch_drift_alerts, vola AS volatility_alerts FROM inp"""))
def module_inputs(w):
    out = measures.module_inputs(w.metrics, w.alerts, w.as_of)
    return out.select("repo_id", "module", "symbol_count", "file_count", fixed("avg_cyclomatic", 6).alias("avg_cyclomatic"),
                      fixed("stddev_cyclomatic", 4).alias("stddev_cyclomatic"), "max_cyclomatic",
                      fixed("avg_ai_risk", 6).alias("avg_ai_risk"), fixed("ai_edit_ratio", 6).alias("ai_edit_ratio"),
                      "churn_24h", "duplication_alerts", "arch_violations", "arch_drift_alerts", "volatility_alerts")


@register("repo_inputs", with_(
    "metrics alerts", STATE, ("rs", summary("repo_id")),
    ("rc", f"SELECT repo_id, count(DISTINCT sha) AS churn FROM metrics WHERE scope = 'symbol' AND {DAY} GROUP BY ALL"),
    ("ra", f"SELECT repo_id, {COUNTS} FROM alerts WHERE {DAY} GROUP BY ALL"),
    ("rb", "SELECT repo_id, count(DISTINCT subject_id) AS n FROM metrics WHERE scope = 'boundary' GROUP BY ALL"),
    select=f"""SELECT repo_id, symbol_count, file_count, {fx('avg_cyc', 6)} AS avg_cyclomatic, {fx('avg_risk', 6)} AS avg_ai_risk,
      {fx('ai', 6)} AS ai_edit_ratio, coalesce(churn, 0) AS churn_24h, coalesce(press, 0) AS arch_pressure_alerts,
      coalesce(viol, 0) AS arch_violations, coalesce(n, 0) AS boundary_count
    FROM rs LEFT JOIN rc USING (repo_id) LEFT JOIN ra USING (repo_id) LEFT JOIN rb USING (repo_id)"""))
def repo_inputs(w):
    out = measures.repo_inputs(w.metrics, w.alerts, w.as_of)
    return out.select("repo_id", "symbol_count", "file_count", fixed("avg_cyclomatic", 6).alias("avg_cyclomatic"),
                      fixed("avg_ai_risk", 6).alias("avg_ai_risk"), fixed("ai_edit_ratio", 6).alias("ai_edit_ratio"),
                      "churn_24h", "arch_pressure_alerts", "arch_violations", "boundary_count")


CUR = f"at >= {ASOF} - INTERVAL 15 DAY"
GRAPH = (
    ("cur", f"SELECT DISTINCT repo_id, module, file_path, edge FROM edges WHERE {CUR}"),
    ("prv", f"SELECT DISTINCT repo_id, module, file_path, edge FROM edges WHERE NOT ({CUR})"),
    ("added", "SELECT * FROM cur EXCEPT SELECT * FROM prv"), ("removed", "SELECT * FROM prv EXCEPT SELECT * FROM cur"),
    ("tgt", "SELECT DISTINCT repo_id, module, split_part(edge, '->', 2) AS target FROM cur"),
    ("dep", """SELECT repo_id, module, count(*) AS deps, count(*) FILTER (target LIKE 'pkg:%') AS ext,
       CAST(count(*) > 1 AS DOUBLE) AS dep_entropy FROM tgt GROUP BY ALL"""),
)


def current(w):
    return w.edges.filter(F.col("at") >= w.as_of - F.expr("INTERVAL 15 DAYS"))


def before(w):
    return w.edges.filter(F.col("at") < w.as_of - F.expr("INTERVAL 15 DAYS"))


@register("file_edge_changes", with_("edges", *GRAPH, select="""
  SELECT *, 'added' AS change FROM added UNION ALL SELECT *, 'removed' FROM removed"""))
def file_edge_changes(w):
    return graph.file_edge_changes(before(w), current(w))


@register("module_dependencies", with_("edges", *GRAPH, select="""
  SELECT repo_id, module, deps AS dependency_count, ext AS external_count, dep_entropy AS dependency_entropy FROM dep"""))
def module_dependencies(w):
    return graph.module_dependencies(current(w)).withColumn("dependency_entropy", fixed("dependency_entropy", 6))


TRADE = """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey"""


@register("weighted_edge_entropy", f"""
  WITH n AS (SELECT c_nationkey, s_nationkey, count(*) AS n {TRADE} GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM n)
  SELECT 'N' || c_nationkey AS module, count(*) AS buckets,
    {fx('CASE WHEN count(*) <= 1 THEN 0.0 ELSE greatest(0.0, least(1.0, sum(-(n / total) * log2(n / total)) / log2(count(*)))) END', 6)}
      AS entropy
  FROM t GROUP BY c_nationkey""")
def weighted_edge_entropy(w):
    """Entropy of repeated edges: customer nation to supplier nation over all order lines."""
    lines = w.table("lineitem").select("l_orderkey", "l_suppkey")
    orders = w.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = w.table("customer").select("c_custkey", "c_nationkey")
    sellers = w.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    edges = lines.join(orders, "l_orderkey").join(buyers, "c_custkey").join(sellers, "l_suppkey")
    rows = edges.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("module"), "s_nationkey")
    out = bucket_entropy(rows, ["module"], "s_nationkey")
    return out.select("module", "buckets", fixed("entropy", 6).alias("entropy"))


ENTROPY = ("ent", f"""
  SELECT *, {c01('dup * 2.0 / greatest(symbol_count, 1)')} AS e_dup,
    {c01('dev_cyc / greatest(avg_cyc, 4.0) * 0.7 + least(max_cyc / greatest(avg_cyc * 3, 1.0), 3.0) / 3 * 0.3')} AS e_cx,
    {c01('churn / greatest(file_count * 4.0, 1) * 0.55 + ai * 0.3 + least(vola / 4.0, 1.0) * 0.15')} AS e_chg,
    {c01('ext / greatest(deps, 1) * 0.35 + least((viol + drift) / greatest(deps, 1), 1.0) * 0.65')} AS e_arch
  FROM (SELECT inp.*, coalesce(deps, 0) AS deps, coalesce(ext, 0) AS ext, coalesce(dep_entropy, 0) AS e_dep
        FROM inp LEFT JOIN dep USING (repo_id, module))""")
INDEX = ("eidx", f"""
  SELECT *, {fx('(e_dep * 0.25 + e_dup * 0.2 + e_cx * 0.2 + e_chg * 0.2 + e_arch * 0.15) * 100', 2)} AS e_index FROM ent""")


@register("module_entropy", with_("metrics alerts edges", *MODULE_STEPS, *GRAPH, ENTROPY, INDEX, select=f"""
  SELECT repo_id, module, {fx('e_dep', 6)} AS dependency, {fx('e_dup', 6)} AS duplication, {fx('e_cx', 6)} AS complexity,
    {fx('e_chg', 6)} AS change, {fx('e_arch', 6)} AS architecture, e_index AS entropy_index FROM eidx"""))
def module_entropy(w):
    out = measures.module_entropy(measures.module_inputs(w.metrics, w.alerts, w.as_of), graph.module_dependencies(current(w)))
    names = ["dependency", "duplication", "complexity", "change", "architecture"]
    return out.select("repo_id", "module", *[fixed(n, 6).alias(n) for n in names], "entropy_index")


def nb(v: str, b: str) -> str:
    return f"CASE WHEN ({b}) <= 0 THEN {c01(v)} ELSE {c01(f'({v}) / ({b})')} END"


PRESSURE = (
    ("rep", "SELECT repo_id, avg(e_index) AS repo_e FROM eidx GROUP BY 1"),
    ("gain", "SELECT repo_id, module, count(*) AS gained FROM added GROUP BY ALL"),
    ("prevs", f"""SELECT repo_id, subject_id AS module,
        coalesce(max(dep_count) FILTER (key = 'dependency_entropy'), 0) AS p_deps,
        coalesce(max(value) FILTER (key = 'code_entropy_index'), 0) AS p_e,
        coalesce(max(value) FILTER (key = 'pressure_index'), 0) AS p_p
      FROM (SELECT * FROM metrics WHERE scope = 'module' AND at < {ASOF}
              AND key IN ('dependency_entropy', 'code_entropy_index', 'pressure_index')
            QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1) GROUP BY ALL"""),
    ("pin", """SELECT e.*, repo_e, coalesce(gained, 0) AS gained, coalesce(p_deps, 0) AS p_deps, coalesce(p_e, 0) AS p_e
      FROM eidx e JOIN rep USING (repo_id) LEFT JOIN gain USING (repo_id, module) LEFT JOIN prevs USING (repo_id, module)"""),
    ("prs", f"""SELECT *,
        {c01(nb('churn', 'greatest(file_count * 4.0, 1)') + ' * (ai * 0.65 + 1)')} AS p_chg,
        {c01(nb('greatest(deps - p_deps, 0)', 'greatest(CASE WHEN p_deps = 0 THEN 2 ELSE p_deps END, 1)') + ' + ' +
             nb('ext', 'greatest(deps * 0.75, 1)') + ' * 0.35')} AS p_cpl,
        {c01(nb('dup', 'greatest(symbol_count * 0.45, 1)') + ' + ai * 0.2')} AS p_sem,
        {c01(nb('gained', 'greatest(deps * 0.35, 1)') + ' + ' + nb('viol', 'greatest(deps * 0.4, 1)') + ' * 0.75')} AS p_bnd,
        {c01(nb('greatest(e_index - repo_e, 0.0)', '20.0') + ' + ' + nb('greatest(e_index - p_e, 0.0)', '15.0') + ' * 0.8')} AS p_ent,
        {c01(nb('vola', '2.0') + ' + ' + nb('churn', 'greatest(file_count * 7.0, 1)') + ' * 0.5')} AS p_vol FROM pin"""),
    ("pidx", f"""SELECT *, {fx('(p_chg * 0.25 + p_cpl * 0.2 + p_sem * 0.15 + p_bnd * 0.15 + p_ent * 0.15 + p_vol * 0.1) * 100', 2)}
        AS p_index FROM prs"""),
)


def pressure_of(w):
    changes = graph.file_edge_changes(before(w), current(w))
    entropy = measures.module_entropy(measures.module_inputs(w.metrics, w.alerts, w.as_of), graph.module_dependencies(current(w)))
    added = changes.filter(F.col("change") == "added")
    return measures.module_pressure(entropy, added, measures.previous_state(w.metrics, w.as_of)), changes, added


@register("module_pressure", with_("metrics alerts edges", *MODULE_STEPS, *GRAPH, ENTROPY, INDEX, *PRESSURE, select=f"""
  SELECT repo_id, module, {fx('p_chg', 6)} AS pressure_change, {fx('p_cpl', 6)} AS pressure_coupling,
    {fx('p_sem', 6)} AS pressure_semantic, {fx('p_bnd', 6)} AS pressure_boundary, {fx('p_ent', 6)} AS pressure_entropy,
    {fx('p_vol', 6)} AS pressure_volatility, p_index AS pressure_index FROM pidx"""))
def module_pressure(w):
    out = pressure_of(w)[0]
    return out.select("repo_id", "module", *[fixed(k, 6).alias(k) for k in PRESSURE_KEYS[:6]], "pressure_index")


@register("boundary_pressure", with_("metrics alerts edges", *MODULE_STEPS, *GRAPH, ENTROPY, INDEX, *PRESSURE, select=f"""
  SELECT c.repo_id, c.module, c.edge AS subject_id, split_part(c.edge, '->', 2) AS target_module,
    CAST(c.added AS INT) AS edge_added, CAST(c.edge LIKE '%->pkg:%' AS INT) AS external_target,
    {fx(f'''(CASE WHEN c.added THEN 1.0 ELSE 0.2 END * 0.35 + CASE WHEN c.edge LIKE '%->pkg:%' THEN 1.0 ELSE 0.2 END * 0.2
      + {nb('viol', 'greatest(deps * 0.45, 1)')} * 0.25 + {nb('p_index', '100.0')} * 0.15 + {nb('repo_e', '85.0')} * 0.05) * 100''', 2)}
      AS value
  FROM (SELECT DISTINCT repo_id, module, edge, (repo_id, module, edge) IN (SELECT (repo_id, module, edge) FROM added) AS added
        FROM cur) c JOIN pidx USING (repo_id, module)"""))
def boundary_pressure(w):
    pressure, _, added = pressure_of(w)
    return measures.boundary_pressure(pressure, graph.current_edges(current(w)), added)


@register("module_snapshots", with_("metrics alerts edges", *MODULE_STEPS, *GRAPH, ENTROPY, INDEX, *PRESSURE, select=f"""
  SELECT repo_id, module AS subject_id, e_index AS entropy_index, p_index AS pressure_index, {fx('ai', 4)} AS ai_edit_ratio,
    {fx('avg_cyc', 2)} AS avg_cyclomatic, churn AS churn_24h, deps AS dependency_count, coalesce(na, 0) AS added,
    coalesce(nr, 0) AS removed, coalesce(la, '') AS edges_added,
    (e_index >= 70 OR p_index >= 60 OR viol > 0 OR drift > 0 OR coalesce(na, 0) > 0 OR coalesce(nr, 0) > 0) AS force
  FROM pidx LEFT JOIN (SELECT repo_id, module, count(DISTINCT edge) AS na,
      array_to_string(list_sort(list(DISTINCT edge))[1:8], ',') AS la FROM added GROUP BY ALL) USING (repo_id, module)
    LEFT JOIN (SELECT repo_id, module, count(DISTINCT edge) AS nr FROM removed GROUP BY ALL) USING (repo_id, module)"""))
def module_snapshots(w):
    pressure, changes, _ = pressure_of(w)
    out = measures.module_snapshots(pressure, changes, F.lit("head"), w.as_of)
    s = F.col("signature")
    return out.select(
        "repo_id", "subject_id", s["health"]["entropyIndex"].alias("entropy_index"), s["health"]["pressureIndex"].alias("pressure_index"),
        s["semantic"]["aiEditRatio"].alias("ai_edit_ratio"), s["complexity"]["avgCyclomatic"].alias("avg_cyclomatic"),
        s["volatility"]["churn24h"].alias("churn_24h"), s["graph"]["moduleDependencyCount"].alias("dependency_count"),
        s["graph"]["addedEdgeCount"].alias("added"), s["graph"]["removedEdgeCount"].alias("removed"),
        F.array_join(s["graph"]["edgesAdded"], ",").alias("edges_added"), "force")


ROLL_KEYS = [*ENTROPY_KEYS, *PRESSURE_KEYS]


@register("repo_rollup", with_(
    "metrics", ("l", """SELECT repo_id, subject_id, key, value FROM metrics WHERE scope = 'module'
    QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1"""),
    select="SELECT repo_id, count(DISTINCT subject_id) AS module_count, " + ", ".join(
        f"""{fx(f"coalesce(avg(value) FILTER (key = '{k}'), 0)", 6)} AS {k}""" for k in ROLL_KEYS) + " FROM l GROUP BY repo_id"))
def repo_rollup(w):
    out = measures.repo_rollup(w.metrics, ROLL_KEYS)
    return out.select("repo_id", "module_count", *[fixed(k, 6).alias(k) for k in ROLL_KEYS])


@register("repo_snapshots", with_(
    "metrics alerts", STATE, ("rs", summary("repo_id")),
    ("ra", f"SELECT repo_id, {COUNTS} FROM alerts WHERE {DAY} GROUP BY ALL"),
    ("l", """SELECT repo_id, subject_id, key, value FROM metrics WHERE scope = 'module'
      QUALIFY row_number() OVER (PARTITION BY repo_id, subject_id, key ORDER BY at DESC, sha DESC) = 1"""),
    ("v", """SELECT repo_id, avg(value) FILTER (key = 'code_entropy_index') AS e, avg(value) FILTER (key = 'pressure_index') AS p,
      count(DISTINCT subject_id) AS n FROM l GROUP BY 1"""),
    select=f"""SELECT repo_id, {fx('e', 2)} AS entropy_index, {fx('p', 2)} AS pressure_index, n AS module_count,
      {fx('avg_risk', 2)} AS avg_ai_risk, coalesce(viol, 0) AS arch_violations,
      (e >= 65 OR p >= 55 OR coalesce(viol, 0) > 0 OR coalesce(press, 0) > 0) AS force
    FROM rs JOIN v USING (repo_id) LEFT JOIN ra USING (repo_id)"""))
def repo_snapshots(w):
    out = measures.repo_snapshots(measures.repo_rollup(w.metrics, ENTROPY_KEYS), measures.repo_rollup(w.metrics, PRESSURE_KEYS),
                                  measures.repo_inputs(w.metrics, w.alerts, w.as_of), F.lit("head"), w.as_of)
    s = F.col("signature")
    return out.select("repo_id", s["health"]["entropyIndex"].alias("entropy_index"), s["health"]["pressureIndex"].alias("pressure_index"),
                      s["graph"]["moduleCount"].alias("module_count"), s["semantic"]["avgAiRisk"].alias("avg_ai_risk"),
                      s["graph"]["archViolations"].alias("arch_violations"), "force")
