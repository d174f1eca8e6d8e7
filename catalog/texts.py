"""Scanners and digests over documents and pages."""

from pyspark.sql import functions as F

from plumbline.functions import digests, paths, text, vectors
from plumbline.functions.numeric import fixed
from plumbline.plans import graph, measures, symbols

from .base import register
from .ctes import fx, with_

WS = text.SPACE
BRANCH = r"\b(if|else if|for|while|case|catch)\b|&&|\|\||\?"
LOW = "lower(text)"
DUMMY = rf"regexp_matches({LOW}, '\b(test|example|placeholder|mock|lorem ipsum)\b')"
SECRET = rf"""regexp_matches({LOW}, '\b(password|secret|token){WS}*[:=]{WS}*["''][^"'']+["'']')"""
TODO = rf"regexp_matches({LOW}, '\b(todo|fixme|not implemented)\b')"


@register("document_readings", with_(select=f"""
  SELECT *, CAST(least(100, cyclomatic * 2 + nesting * 4 + dummy_data * 20 + hardcoded_secrets * 25 + todo_markers * 8) AS BIGINT)
    AS ai_risk FROM (
  SELECT doc_id, 1 + len(regexp_extract_all(text, '{BRANCH}')) AS cyclomatic,
    CAST(0 AS BIGINT) AS nesting, length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
    CAST({DUMMY} AS BIGINT) AS dummy_data, CAST({SECRET} AS BIGINT) AS hardcoded_secrets,
    CAST({TODO} AS BIGINT) AS todo_markers FROM documents)""", tables=""))
def document_readings(w):
    rows = w.documents.select("doc_id", F.col("text").alias("body"), F.lit("run").alias("name"))
    out = measures.read_symbols(rows)
    return out.select("doc_id", "cyclomatic", F.col("nesting_depth").alias("nesting"), F.col("line_count").alias("lines"),
                      "dummy_data", "hardcoded_secrets", "todo_markers", F.col("ai_risk_score").alias("ai_risk"))


@register("page_nesting", """
  WITH braces AS (SELECT page_id, regexp_replace(html, '[^{}]', '', 'g') AS b FROM pages),
    ch AS (SELECT page_id, unnest(range(1, length(b) + 1)) AS i, b FROM braces),
    run AS (SELECT page_id, i, sum(CASE WHEN b[i] = '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM ch),
    low AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS m FROM run)
  SELECT p.page_id, CAST(coalesce(max(s - m), 0) AS BIGINT) AS nesting FROM pages p LEFT JOIN low USING (page_id) GROUP BY p.page_id""")
def page_nesting(w):
    return w.pages.select("page_id", text.nesting("html").alias("nesting"))


@register("name_words", r"""
  SELECT p_partkey, part_name, len(regexp_extract_all(part_name, '[A-Z][^A-Z_]*|[^A-Z_]+')) > 4 AS over_abstracted
  FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_type || p_size AS part_name FROM part)""")
def name_words(w):
    """Over-long names: part names joined with their type."""
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), "p_type", F.col("p_size").cast("string"))
    flags = text.smells(F.lit(""), "part_name")
    return w.table("part").select("p_partkey", name.alias("part_name")).select(
        "p_partkey", "part_name", (flags["over_abstracted_name"] == 1).alias("over_abstracted"))


@register("document_digests", r"""
  SELECT doc_id, sha256(text) AS code_hash,
    sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '//[^\n\r\x{2028}\x{2029}]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '"[^"]*"|''[^'']*''|`[^`]*`', '"str"', 'g'),
      '\b[0-9]+\b', '0', 'g'), '""" + WS + r"""+', ' ', 'g'))) AS norm_hash,
    sha256(array_to_string(list_sort(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')), '|'))
      AS tokens_hash,
    substr(sha256(doc_id::VARCHAR), 1, 8) || '-' || substr(sha256(doc_id::VARCHAR), 9, 4) || '-' ||
      substr(sha256(doc_id::VARCHAR), 13, 4) || '-' || substr(sha256(doc_id::VARCHAR), 17, 4) || '-' ||
      substr(sha256(doc_id::VARCHAR), 21, 12) AS point_id,
    CASE WHEN contains(lower(text), 'generated-by: claude') THEN 'claude' WHEN contains(lower(text), 'generated-by: codex')
      THEN 'codex' WHEN contains(lower(text), 'generated-by: cursor') THEN 'cursor' ELSE 'unknown' END AS provenance
  FROM documents""")
def document_digests(w):
    return w.documents.select(
        "doc_id", digests.code_hash("text").alias("code_hash"), digests.normalized_hash("text").alias("norm_hash"),
        digests.tokens_hash("text").alias("tokens_hash"), digests.stable_id(F.col("doc_id").cast("string")).alias("point_id"),
        text.provenance("text").alias("provenance"))


@register("document_hash_vectors", """
  WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS t FROM documents),
    uniq AS (SELECT DISTINCT t FROM words WHERE t <> ''),
    h0 AS (SELECT t, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: ord(c)::BIGINT)),
      lambda a, c: (a * 31 + c) % 4294967296) AS h FROM uniq),
    h1 AS (SELECT t, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS h FROM h0),
    s AS (SELECT doc_id, h % 384 AS slot, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END) AS v
      FROM words JOIN h1 USING (t) GROUP BY ALL),
    n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS len FROM s)
  SELECT doc_id, CAST(slot AS INT) AS slot, """ + fx("v / len", 6) + """ AS weight FROM n WHERE v <> 0""")
def document_hash_vectors(w):
    return vectors.hashed_slots(w.documents, "doc_id", "text").select("doc_id", "slot", fixed("weight", 6).alias("weight"))


@register("document_calls", with_(select=rf"""
  SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*){WS}*\(', 1),
    lambda n: n NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'typeof'))[1:32], ',') AS calls,
    array_to_string(regexp_extract_all(text, '(?:from|import){WS}+["'']([^"'']+)["'']', 1), ',') AS imports
  FROM (SELECT doc_id, source AS text FROM python_sources)""", tables="python_sources"))
def document_calls(w):
    return w.python_sources.select("doc_id", F.array_join(text.calls("source"), ",").alias("calls"),
                                   F.array_join(text.imports("source"), ",").alias("imports"))


@register("python_symbols", with_("python_sources", (
    "lines", r"""SELECT doc_id, repo_id, file_path, i, line, length(line) - length(ltrim(line)) AS indent, trim(line) = '' AS blank
      FROM (SELECT doc_id, repo_id, file_path, unnest(string_split_regex(source, '\r?\n')) AS line,
              generate_subscripts(string_split_regex(source, '\r?\n'), 1) AS i FROM python_sources)"""),
    ("heads", r"""SELECT *, CASE WHEN regexp_matches(line, '^\s*def\s+[A-Za-z_]\w*\s*\(') THEN 'function' ELSE 'class' END AS kind,
        regexp_extract(line, '^\s*(?:def|class)\s+([A-Za-z_]\w*)', 1) AS name FROM lines
      WHERE regexp_matches(line, '^\s*def\s+[A-Za-z_]\w*\s*\(|^\s*class\s+[A-Za-z_]\w*\s*[:(]')"""),
    ("ends", """SELECT h.doc_id, h.i, min(l.i) AS stop FROM heads h JOIN lines l ON l.doc_id = h.doc_id AND l.i > h.i
      AND NOT l.blank AND l.indent <= h.indent GROUP BY ALL"""),
    ("total", "SELECT doc_id, max(i) AS n FROM lines GROUP BY 1"),
    ("body", """SELECT h.doc_id, h.i, string_agg(l.line, chr(10) ORDER BY l.i) AS body, h.kind, h.name, h.repo_id, h.file_path,
        coalesce(e.stop - 1, t.n) AS last
      FROM heads h LEFT JOIN ends e USING (doc_id, i) JOIN total t USING (doc_id)
        JOIN lines l ON l.doc_id = h.doc_id AND l.i BETWEEN h.i AND coalesce(e.stop - 1, t.n) GROUP BY ALL"""),
    select="""SELECT repo_id, file_path || ':' || name || ':' || i AS symbol_id, kind, name, CAST(i AS INT) AS start_line,
      CAST(last AS INT) AS end_line, sha256(body) AS hash FROM body"""))
def python_symbols(w):
    return symbols.extract(w.python_sources).select("repo_id", "symbol_id", "kind", "name", "start_line", "end_line", "hash")


@register("script_symbols", """
  SELECT doc_id, n.kind, n.name FROM documents, (VALUES ('class', 'Doc'), ('method', 'run'), ('function', 'tail')) n(kind, prefix),
    LATERAL (SELECT n.kind, CASE WHEN n.kind = 'method' THEN 'run' ELSE n.prefix || doc_id END AS name) x""".replace(
        "n.kind, n.name FROM", "x.kind, x.name FROM"))
def script_symbols(w):
    found = symbols.extract(w.script_sources)
    return found.select(F.regexp_extract("file_path", "/d([0-9]+)[.]ts$", 1).cast("bigint").alias("doc_id"), "kind", "name")


@register("call_edges", """
  SELECT 'src/' || lang || '/d' || doc_id || '.py:tail_' || doc_id AS source, 'run_' || doc_id AS target FROM documents
  UNION ALL SELECT 'src/' || lang || '/d' || doc_id || '.py:Doc' || doc_id, 'run_' || doc_id FROM documents""")
def call_edges(w):
    """Calls inside each wrapped document: the class contains, and the tail calls, the method."""
    found = symbols.extract(w.python_sources)
    edges = graph.call_edges(found)
    short = lambda c: F.regexp_replace(c, ":[0-9]+$", "")
    return edges.select(short(F.col("source_id")).alias("source"),
                        F.regexp_extract("target_id", ":([^:]+):[0-9]+$", 1).alias("target"))


@register("graph_edge_counts", """
  SELECT rel, count(*) AS edges FROM (
    SELECT 'IMPORTS' AS rel FROM documents UNION ALL SELECT 'CONTAINS' FROM documents UNION ALL
    SELECT 'CALLS' FROM documents UNION ALL SELECT 'CALLS' FROM documents UNION ALL
    SELECT unnest(['DEFINES', 'DEFINES', 'DEFINES', 'BELONGS_TO', 'BELONGS_TO', 'BELONGS_TO']) FROM documents) GROUP BY rel""")
def graph_edge_counts(w):
    found = symbols.extract(w.python_sources)
    return graph.graph_edges(graph.import_edges(w.python_sources), found).groupBy("rel").agg(F.count(F.lit(1)).alias("edges"))


@register("page_imports", with_("page_files", select="""
  SELECT DISTINCT repo_id, file_path, CASE WHEN href LIKE '.%' THEN 'File' ELSE 'Package' END AS target_kind,
    CASE WHEN href LIKE '@%' THEN CASE WHEN split_part(href, '/', 2) <> '' THEN split_part(href, '/', 1) || '/' || split_part(href, '/', 2)
      ELSE href END ELSE split_part(href, '/', 1) END AS target
  FROM (SELECT repo_id, file_path, substr(unnest(regexp_extract_all(source, 'href="([^"]+)"', 1)), 2) AS href FROM page_files)
  WHERE href NOT LIKE '.%'"""))
def page_imports(w):
    """Links of every page as import targets; relative ones are checked by the layer query."""
    links = F.transform(F.regexp_extract_all("source", F.lit('href="([^"]+)"'), F.lit(1)), lambda h: F.substring(h, F.lit(2), F.length(h)))
    files = w.page_files.select("repo_id", "file_path", F.filter(links, lambda h: ~h.startswith(".")).alias("imports"))
    return graph.import_edges(files)


@register("layer_violations", with_("page_files", select="""
  SELECT DISTINCT p.repo_id, 'src/domain/p' || p.page_id || '.ts' AS source_path,
    'src/' || CASE n WHEN 0 THEN 'web' WHEN 1 THEN 'infra' ELSE 'core' END || '/' || word AS target_path
  FROM (SELECT page_id, repo_id, unnest(words) AS word, generate_subscripts(words, 1) % 3 AS n FROM (
      SELECT page_id, repo_id, list_filter(regexp_extract_all(source, 'href="/([^"/]+)"', 1), lambda x: x NOT IN ('.', '..')) AS words
      FROM page_files)) p WHERE n < 2"""))
def layer_violations(w):
    """Links of every page rewritten as relative imports into three layers."""
    words = F.filter(F.regexp_extract_all("source", F.lit('href="/([^"/]+)"'), F.lit(1)), lambda x: ~x.isin(".", ".."))
    layers = F.array(F.lit("web"), F.lit("infra"), F.lit("core"))
    rel = F.transform(words, lambda x, i: F.concat(F.lit("../"), F.get(layers, (i + 1) % 3), F.lit("/./x/../"), x))
    files = w.page_files.select("repo_id", F.concat(F.lit("src/domain/p"), F.col("page_id").cast("string"), F.lit(".ts")).alias("file_path"),
                                rel.alias("imports"))
    return graph.layer_violations(graph.import_edges(files)).select("repo_id", "source_path", "target_path")


def _html_sql() -> str:
    tokens = [("placeholder", r"(?i)\bplaceholder\b"), ("todo", r"\bTODO\b"), ("tbd", r"(?i)\btbd\b"), ("example", r"(?i)\bexample\b"),
              ("mock", r"(?i)\bmock\b"), ("lorem ipsum", r"(?i)\blorem ipsum\b"), ("coming soon", r"(?i)\bcoming soon\b")]
    counts = " UNION ALL ".join(
        f"SELECT page_id, {i} AS place, '{t}' AS token, len(regexp_extract_all(html, '{p}')) AS n FROM pages"
        for i, (t, p) in enumerate(tokens))
    return rf"""
      WITH c AS ({counts}),
        top AS (SELECT page_id, list(token || ' x' || n ORDER BY n DESC, place)[1:3] AS toks FROM c WHERE n > 0 GROUP BY page_id),
        d AS (SELECT p.page_id, list_concat(coalesce(toks, []), list_filter([
            CASE WHEN regexp_matches(html, '(?i)<title>.*(todo|placeholder|coming soon).*</title>') THEN 'placeholder document title' END,
            CASE WHEN regexp_matches(html, '(?i)\b(id|class)=["''][^"'']*(placeholder|mock|demo|test)[^"'']*["'']') THEN 'placeholder markup hooks' END,
            CASE WHEN regexp_matches(html, '(?i)https?://(localhost|127\.0\.0\.1|example\.com)') THEN 'local/example endpoint' END],
            lambda x: x IS NOT NULL))[1:4] AS drivers FROM pages p LEFT JOIN top USING (page_id))
      SELECT page_id, array_to_string(drivers, '|') AS drivers, CASE WHEN len(drivers) >= 3 THEN 'error' ELSE 'warn' END AS severity,
        CASE WHEN list_contains(drivers, 'local/example endpoint') THEN 'LOCAL_ENDPOINT'
          WHEN len(list_filter(drivers, lambda x: contains(x, 'placeholder') OR contains(x, 'todo'))) > 0 THEN 'PLACEHOLDER_CONTENT'
          ELSE 'CONTENT_DRIFT' END AS category
      FROM d WHERE len(drivers) > 0"""


@register("page_content_alerts", _html_sql())
def page_content_alerts(w):
    files = w.pages.select("page_id", F.col("url").alias("file_path"), F.col("html").alias("source"), F.lit("html").alias("language"))
    return symbols.content_alerts(files).select("page_id", F.array_join("drivers", "|").alias("drivers"), "severity", "category")


@register("config_content_alerts", r"""
  WITH d AS (SELECT doc_id, list_filter([
      CASE WHEN regexp_matches(text, '(?i)\b(debug|devMode|mockMode)""" + WS + r"*[:=]" + WS + r"""*(true|1|yes)\b') THEN 'debug mode enabled' END,
      CASE WHEN regexp_matches(text, '(?i)\b(password|token|secret|apikey|api_key)""" + WS + r"*[:=]" + WS +
          r"""*(changeme|example|test|placeholder|123456)\b') THEN 'fake secret placeholder' END], lambda x: x IS NOT NULL) AS rules,
      len(regexp_extract_all(text, '(?i)\bexample\b')) AS n_example
    FROM (SELECT doc_id, text || chr(10) || 'debug = true' || chr(10) || 'token: ' ||
      CASE WHEN doc_id % 2 = 0 THEN 'changeme' ELSE 'x' || doc_id END AS text FROM documents))
  SELECT doc_id, list_contains(rules, 'fake secret placeholder') AS fake_secret, len(rules) >= 1 AS debug_on FROM d""")
def config_content_alerts(w):
    d = F.col("doc_id")
    tail = F.when(d % 2 == 0, "changeme").otherwise(F.concat(F.lit("x"), d.cast("string")))
    files = w.documents.select("doc_id", F.lit("app.ini").alias("file_path"), F.lit("config").alias("language"),
                               F.concat("text", F.lit("\ndebug = true\ntoken: "), tail).alias("source"))
    out = symbols.content_alerts(files)
    return out.select("doc_id", F.array_contains("drivers", "fake secret placeholder").alias("fake_secret"),
                      F.array_contains("drivers", "debug mode enabled").alias("debug_on"))


@register("path_facts", with_("page_files", (
    "f", """SELECT page_id, file_path || ([ '.ts', '.tsx', '.cts', '.jsx', '.py', '.scss', '.md', '.yml', '.toml', '.env.local', '/Dockerfile',
        '/node_modules/a.js', '/.github/workflows/ci.yml', '.bin'])[page_id % 14 + 1] AS path FROM page_files"""),
    select=r"""SELECT page_id, path,
      CASE WHEN split_part(path, '/', 1) = 'src' AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 1
        THEN list_filter(string_split(path, '/'), lambda x: x <> '')[2] ELSE list_filter(string_split(path, '/'), lambda x: x <> '')[1] END AS module,
      language, NOT (base = '.env' OR base LIKE '.env.%' OR path LIKE '%/.github/%') AND
        (regexp_matches(path, '(^|/)\.') OR regexp_matches(path, '(^|/)node_modules(/|$)')) AS ignored,
      coalesce(language IN ('typescript', 'javascript', 'python'), false) AS parsed
    FROM (SELECT *, string_split(path, '/')[-1] AS base, CASE WHEN string_split(path, '/')[-1] = 'Dockerfile' THEN 'dockerfile'
        WHEN path LIKE '%/.github/workflows/%' THEN 'workflow' WHEN regexp_matches(path, '\.(ts|tsx|cts)$') THEN 'typescript'
        WHEN regexp_matches(path, '\.jsx?$') THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.scss' THEN 'scss'
        WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.yml' THEN 'yaml' WHEN path LIKE '%.toml' THEN 'toml'
        WHEN string_split(path, '/')[-1] LIKE '.env.%' THEN 'config' END AS language FROM f)"""))
def path_facts(w):
    tails = [".ts", ".tsx", ".cts", ".jsx", ".py", ".scss", ".md", ".yml", ".toml", ".env.local", "/Dockerfile",
             "/node_modules/a.js", "/.github/workflows/ci.yml", ".bin"]
    from plumbline.sources.workspace import pick
    rows = w.page_files.select("page_id", F.concat("file_path", pick(tails, F.col("page_id") % 14)).alias("path"))
    lang = paths.language("path")
    return rows.select("page_id", "path", paths.module_name("path").alias("module"), lang.alias("language"),
                       paths.is_ignored("path").alias("ignored"), (paths.parser_status(lang) == "pending").alias("parsed"))


@register("module_roles", with_("activity", select="""
  SELECT DISTINCT file_path, CASE WHEN file_path LIKE '%/web/%' THEN 'edge' WHEN file_path LIKE '%/infra/%' THEN 'adapter'
    WHEN file_path LIKE '%/shared/%' THEN 'utility' ELSE 'core' END AS role FROM activity"""))
def module_roles(w):
    from plumbline.functions.bands import module_role
    files = w.activity.select("file_path").distinct()
    return files.select("file_path", module_role(paths.module_name("file_path"), "file_path").alias("role"))
