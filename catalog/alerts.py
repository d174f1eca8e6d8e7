"""Alert pages, lifecycle, detail and deduplication."""

from pyspark.sql import functions as F

from plumbline.functions import digests
from plumbline.functions.numeric import micros
from plumbline.operators.timegrid import page_info
from plumbline.plans import alerts, rankings

from .base import register
from .ctes import ASOF, with_

ID = r"""md5(concat_ws('|', repo_id, coalesce(sha, ''), regexp_replace(strftime(at, '%Y-%m-%d %H:%M:%S.%f'), '\.?0+$', '') || '+00', type, title))"""


@register("alert_ids", with_("alerts", select=f"SELECT repo_id, sha, epoch_us(at) AS at_us, {ID} AS alert_id FROM alerts"))
def alert_ids(w):
    return alerts.with_ids(w.alerts).select("repo_id", "sha", micros("at").alias("at_us"), "alert_id")


@register("alert_search", with_("alerts", select="""
  SELECT repo_id, sha, epoch_us(at) AS at_us, type, severity FROM alerts
  WHERE at >= TIMESTAMP '2024-01-10' AND severity = 'warn' AND status = 'open' AND coalesce(ev_category, '') = ''"""))
def alert_search(w):
    out = alerts.matching(w.alerts, since="2024-01-10", severity="warn", status="open", category="")
    return out.select("repo_id", "sha", micros("at").alias("at_us"), "type", "severity")


@register("alert_page", with_("alerts", select=f"""
  SELECT {ID} AS alert_id, epoch_us(at) AS at_us, severity, status, type, title FROM alerts WHERE type = 'CONTENT_HEURISTIC'
  ORDER BY at DESC, sha DESC, type DESC LIMIT 12 OFFSET 24"""))
def alert_page(w):
    out = alerts.alert_page(alerts.matching(w.alerts, type="CONTENT_HEURISTIC"), number=3)
    return out.select("alert_id", micros("at").alias("at_us"), "severity", "status", "type", "title")


@register("alert_page_info", with_("alerts", select="""
  SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(12 AS BIGINT) AS page_size,
    CAST(greatest(1, ceil(count(*) / 12.0)) AS BIGINT) AS total_pages FROM alerts WHERE type = 'CONTENT_HEURISTIC'"""))
def alert_page_info(w):
    return page_info(alerts.matching(w.alerts, type="CONTENT_HEURISTIC"), 3, 12)


@register("latest_alerts", with_("alerts", select="""
  SELECT sha, epoch_us(at) AS at_us, type, title FROM alerts WHERE repo_id = 'repo-7' ORDER BY at DESC, sha DESC LIMIT 25"""))
def latest_alerts(w):
    return alerts.latest_alerts(w.alerts, "repo-7").select("sha", micros("at").alias("at_us"), "type", "title")


@register("repo_report_alerts", with_("alerts", select="""
  SELECT repo_id, sha, epoch_us(at) AS at_us, type, row_number() OVER (PARTITION BY repo_id ORDER BY at DESC, sha DESC) AS rank
  FROM alerts QUALIFY rank <= 8"""))
def repo_report_alerts(w):
    return alerts.newest_per_repo(w.alerts).select("repo_id", "sha", micros("at").alias("at_us"), "type", F.col("rank").cast("bigint").alias("rank"))


@register("alert_status_counts", with_("alerts", select="SELECT repo_id, coalesce(status, 'open') AS status, count(*) AS total FROM alerts GROUP BY ALL"))
def alert_status_counts(w):
    return alerts.status_counts(w.alerts)


@register("alert_status_maps", with_("alerts", select="""
  SELECT repo_id, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status
  FROM (SELECT repo_id, status, count(*) AS n FROM alerts GROUP BY ALL) GROUP BY repo_id"""))
def alert_status_maps(w):
    out = alerts.status_maps(alerts.status_counts(w.alerts))
    pairs = F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("repo_id", F.array_join(pairs, ",").alias("by_status"))


@register("alert_status_update", with_("alerts", ("w", f"""
  SELECT *, (['open','acknowledged','resolved',NULL])[length(title) % 4 + 1] AS s FROM alerts"""), select=f"""
  SELECT repo_id, sha, epoch_us(at) AS at_us, coalesce(s, status) AS status,
    epoch_us(CASE WHEN s = 'acknowledged' AND acknowledged_at IS NULL THEN {ASOF} WHEN s = 'open' THEN NULL ELSE acknowledged_at END) AS ack_us,
    CASE WHEN s = 'acknowledged' AND acknowledged_by IS NULL THEN 'me' WHEN s = 'open' THEN NULL ELSE acknowledged_by END AS acknowledged_by,
    epoch_us(CASE WHEN s = 'resolved' THEN {ASOF} WHEN s IS NOT NULL THEN NULL ELSE resolved_at END) AS resolved_us,
    CASE WHEN s = 'resolved' THEN 'me' WHEN s IS NOT NULL THEN NULL ELSE resolved_by END AS resolved_by FROM w"""))
def alert_status_update(w):
    from plumbline.sources.workspace import pick
    rows = alerts.with_ids(w.alerts)
    wanted = rows.select("alert_id", pick(["open", "acknowledged", "resolved", None], F.length("title") % 4).alias("status"), F.lit("me").alias("actor"))
    out = alerts.set_status(rows, wanted.filter(F.col("status").isNotNull()), w.as_of)
    return out.select("repo_id", "sha", micros("at").alias("at_us"), "status", micros("acknowledged_at").alias("ack_us"), "acknowledged_by",
                      micros("resolved_at").alias("resolved_us"), "resolved_by")


@register("related_alerts", with_("alerts", ("a", f"SELECT *, {ID} AS alert_id FROM alerts WHERE ev_path IS NOT NULL"), select="""
  SELECT a.repo_id, a.alert_id, b.alert_id AS related_id, epoch_us(b.at) AS related_us FROM a JOIN a b ON a.repo_id = b.repo_id
    AND a.ev_path = b.ev_path AND a.alert_id <> b.alert_id
  QUALIFY row_number() OVER (PARTITION BY a.alert_id ORDER BY b.at DESC, b.alert_id) <= 6"""))
def related_alerts(w):
    return alerts.related_alerts(w.alerts).select("repo_id", "alert_id", "related_id", micros("related_at").alias("related_us"))


@register("related_refactors", with_("alerts refactors", ("a", f"SELECT *, {ID} AS alert_id FROM alerts"), select="""
  SELECT a.repo_id, a.alert_id, r.id, coalesce(r.id = l.first, false) AS linked FROM a LEFT JOIN (SELECT repo_id, module, min(id) AS first FROM refactors GROUP BY ALL) l
    ON l.repo_id = a.repo_id AND l.module = a.ev_module JOIN refactors r ON r.repo_id = a.repo_id
    AND (r.target = a.ev_path OR r.file = a.ev_path OR r.target = a.ev_module OR r.module = a.ev_module
         OR r.module = a.ev_path OR r.file = a.ev_module)
  QUALIFY row_number() OVER (PARTITION BY a.alert_id ORDER BY CASE r.status WHEN 'applied' THEN 0 WHEN 'accepted' THEN 1
    WHEN 'proposed' THEN 2 ELSE 3 END, r.at DESC, r.id) <= 6"""))
def related_refactors(w):
    """Every alert with its suggestions, linked to the first suggestion of its module."""
    rows = alerts.with_ids(w.alerts)
    first = w.refactors.groupBy("repo_id", "entities.modules").agg(F.min("id").alias("refactor_id"))
    links = rows.select("repo_id", "alert_id", F.array("evidence.module").alias("modules")).join(first, ["repo_id", "modules"])
    return alerts.related_refactors(rows, w.refactors, links).select("repo_id", "alert_id", "id", "linked")


@register("alert_fingerprints", with_("alerts", select=r"""
  SELECT repo_id, sha, type, sha256('{"evidence":{"filePath":' || coalesce('"' || ev_path || '"', 'null') ||
    ',"graphEdgesAdded":[' || coalesce('"' || edge || '"', '') || '],"graphEdgesRemoved":[],"metrics":' ||
    CASE type WHEN 'ENTROPY_DRIFT' THEN '{"entropyIndex":' || rtrim(rtrim(printf('%.2f', value), '0'), '.') || ',"previousEntropyIndex":10}'
      WHEN 'ARCH_PRESSURE' THEN '{"pressureDelta24h":' || k || ',"pressureIndex":' || rtrim(rtrim(printf('%.2f', value), '0'), '.') || '}'
      ELSE 'null' END || ',"module":' || coalesce('"' || ev_module || '"', 'null') || ',"neighbours":[],"symbolId":' ||
    coalesce('"' || ev_symbol || '"', 'null') || '},"repoId":"' || repo_id || '","severity":"' || severity || '","title":"' || title ||
    '","type":"' || type || '"}') AS fingerprint FROM alerts WHERE type <> 'SEMANTIC_DUPLICATION'"""))
def alert_fingerprints(w):
    rows = w.alerts.filter(F.col("type") != "SEMANTIC_DUPLICATION")
    return rows.select("repo_id", "sha", "type", digests.alert_fingerprint().alias("fingerprint"))


@register("alert_suppression", with_("alerts", ("f", """
  SELECT *, concat_ws('|', repo_id, type, severity, title, ev_path, ev_symbol, ev_module, edge,
    CASE WHEN type IN ('ENTROPY_DRIFT', 'ARCH_PRESSURE') THEN value::VARCHAR || '/' || k END) AS fp FROM alerts
  WHERE type IN ('ARCH_VIOLATION', 'ARCH_EMBED_DRIFT', 'ARCH_PRESSURE', 'ENTROPY_DRIFT')"""), ("chain", """
  SELECT fp, min(epoch_us(at) // 1000) AS t FROM f GROUP BY fp
  UNION ALL SELECT c.fp, (SELECT min(epoch_us(f.at) // 1000) FROM f WHERE f.fp = c.fp AND epoch_us(f.at) // 1000 >= c.t + 900000) FROM chain c WHERE c.t IS NOT NULL"""),
    recursive=True, select="""
  SELECT repo_id, type, epoch_us(at) // 1000 AS at_ms FROM f WHERE (fp, epoch_us(at) // 1000) IN (SELECT (fp, t) FROM chain)
  UNION ALL SELECT repo_id, type, epoch_us(at) // 1000 FROM alerts WHERE type NOT IN ('ARCH_VIOLATION', 'ARCH_EMBED_DRIFT', 'ARCH_PRESSURE', 'ENTROPY_DRIFT')"""))
def alert_suppression(w):
    return alerts.deduplicated(w.alerts).select("repo_id", "type", F.floor(micros("at") / 1000).alias("at_ms"))


@register("alert_search_terms", with_("alerts", select=r"""
  SELECT repo_id, sha, array_to_string(list_concat(list_filter([
      CASE WHEN length(split_part(ev_symbol, ':', -1)) >= 3 THEN split_part(split_part(ev_symbol, ':', -1), '.', -1) END,
      CASE WHEN length(ev_module) >= 3 THEN ev_module END], lambda x: x IS NOT NULL),
    list_filter(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9_]{3,}')[1:6], lambda t: t IS DISTINCT FROM ev_module)), '|') AS terms FROM alerts"""))
def alert_search_terms(w):
    return w.alerts.select("repo_id", "sha", F.array_join(alerts.search_terms("evidence", "title"), "|").alias("terms"))


LINES = r"string_split_regex(text, '\r?\n')"


@register("document_previews", rf"""
  WITH d AS (SELECT doc_id, {LINES} AS l, [ 'zzzz', 'Than', ' de ' ] AS terms FROM documents),
    p AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, 'Than')), true) AS p2,
      list_position(list_transform(l, lambda x: contains(x, ' de ')), true) AS p3 FROM d),
    a AS (SELECT *, CASE WHEN p2 > 0 THEN p2 WHEN p3 > 0 THEN p3 ELSE 1 END AS anchor,
      CASE WHEN p2 > 0 THEN 'Than' WHEN p3 > 0 THEN ' de ' END AS term FROM p)
  SELECT doc_id, CAST(len(l) AS INT) AS total_lines, CAST(greatest(1, anchor - 16) AS INT) AS preview_start,
    CAST(least(len(l), greatest(1, anchor - 16) + 119) AS INT) AS preview_end, term AS matched_term,
    CAST(len(list_filter(l[greatest(1, anchor - 16):greatest(1, anchor - 16) + 119], lambda x: contains(x, term))) AS INT) AS highlights FROM a""")
def document_previews(w):
    files = w.documents.select("doc_id", F.col("text").alias("content"), F.array(F.lit("zzzz"), F.lit("Than"), F.lit(" de ")).alias("terms"))
    out = alerts.preview(files)
    return out.select("doc_id", "total_lines", "preview_start", "preview_end", "matched_term",
                      F.size(F.filter("lines", lambda l: l["highlight"])).alias("highlights"))


@register("document_diffs", rf"""
  WITH v AS (SELECT doc_id, {LINES} AS p, string_split_regex(replace(text, 'an', 'AN') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'tail' ELSE '' END, '\r?\n') AS c
      FROM documents),
    h AS (SELECT *, (SELECT coalesce(min(i), least(len(p), len(c)) + 1) - 1 FROM (SELECT unnest(range(1, least(len(p), len(c)) + 1)) AS i) WHERE p[i] <> c[i]) AS head FROM v),
    r AS (SELECT *, p[head + 1:] AS pr, c[head + 1:] AS cr FROM h),
    t AS (SELECT *, (SELECT coalesce(min(i), least(len(pr), len(cr)) + 1) - 1 FROM (SELECT unnest(range(1, least(len(pr), len(cr)) + 1)) AS i)
        WHERE pr[len(pr) - i + 1] <> cr[len(cr) - i + 1]) AS tail FROM r)
  SELECT doc_id, array_to_string(list_concat(
      list_concat(list_transform(p[greatest(1, head - 2):head], lambda x: ' ' || x), list_transform(pr[1:len(pr) - tail], lambda x: '-' || x)),
      list_concat(list_transform(cr[1:len(cr) - tail], lambda x: '+' || x),
        list_transform(cr[len(cr) - tail + 1:len(cr) - tail + least(tail, 3)], lambda x: ' ' || x)))[1:220], chr(10)) AS diff FROM t""")
def document_diffs(w):
    tail = F.when(F.col("doc_id") % 3 == 0, "\ntail").otherwise("")
    pairs = w.documents.select("doc_id", F.col("text").alias("previous"), F.concat(F.replace("text", F.lit("an"), F.lit("AN")), tail).alias("current"))
    return alerts.snapshot_diff(pairs).select("doc_id", F.array_join(F.transform("diff", lambda l: l["text"]), "\n").alias("diff"))


@register("signal_mix", with_("alerts", select="""
  SELECT replace(CASE WHEN type = 'CONTENT_HEURISTIC' AND ev_category IS NOT NULL THEN ev_category ELSE type END, '_', ' ') AS label,
    count(*) AS total FROM alerts GROUP BY 1 ORDER BY total DESC, label LIMIT 6"""))
def signal_mix(w):
    return rankings.signal_mix(w.alerts)


@register("alert_categories", with_("alerts", select="""
  SELECT DISTINCT coalesce(ev_category, 'CONTENT_HEURISTIC') AS category FROM alerts WHERE type = 'CONTENT_HEURISTIC'"""))
def alert_categories(w):
    return rankings.category_list(w.alerts)


@register("alert_status_tally", with_("alerts", select="SELECT coalesce(status, 'open') AS status, count(*) AS total FROM alerts GROUP BY 1"))
def alert_status_tally(w):
    return rankings.status_tally(w.alerts)


@register("alert_activity_history", with_("alerts activity", ("f", "SELECT DISTINCT repo_id, ev_path AS file_path FROM alerts WHERE ev_path IS NOT NULL"), select="""
  SELECT repo_id, file_path, event_id, parser_status, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY at DESC, event_id DESC) AS rank
  FROM activity WHERE (repo_id, file_path) IN (SELECT (repo_id, file_path) FROM f) QUALIFY rank <= 12"""))
def alert_activity_history(w):
    out = alerts.activity_history(w.alerts, w.activity)
    return out.select("repo_id", "file_path", "event_id", "parser_status", F.col("rank").cast("bigint").alias("rank"))


@register("linked_alert_resolution", with_("alerts refactors", ("a", f"SELECT *, {ID} AS alert_id FROM alerts"), ("l", """
  SELECT repo_id, module, bool_or(status = 'applied') AS applied FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, module ORDER BY id) AS n FROM refactors) WHERE n = 1 GROUP BY ALL"""), select=f"""
  SELECT a.alert_id, CASE WHEN l.applied THEN 'resolved' ELSE a.status END AS status,
    CASE WHEN l.applied AND a.status <> 'resolved' THEN 'engine' ELSE a.resolved_by END AS resolved_by
  FROM a LEFT JOIN l ON l.repo_id = a.repo_id AND l.module = a.ev_module"""))
def linked_alert_resolution(w):
    """Every alert linked to the first suggestion of its module; applied ones resolve it."""
    from plumbline.plans import refactors
    rows = alerts.with_ids(w.alerts)
    first = w.refactors.groupBy("repo_id", F.col("entities.modules").alias("modules")).agg(F.min("id").alias("refactor_id"))
    links = rows.select("repo_id", "alert_id", F.array("evidence.module").alias("modules")).join(first, ["repo_id", "modules"])
    out = refactors.resolve_linked(rows, links, w.refactors, w.as_of, "engine")
    return out.select("alert_id", "status", "resolved_by")


@register("alert_notifications", with_("alerts", select="""
  SELECT channel, count(*) AS notices FROM (SELECT 'repo:' || repo_id AS channel FROM alerts UNION ALL SELECT 'fleet' FROM alerts) GROUP BY 1"""))
def alert_notifications(w):
    from plumbline.streaming.sources import notifications
    return notifications(w.alerts, "alert").groupBy("channel").agg(F.count(F.lit(1)).alias("notices"))


@register("stale_modules", with_("alerts", ("o", """
  SELECT repo_id, sha, at, coalesce(ev_module, split_part(ev_path, '/', 2), split_part(ev_symbol, '/', 2)) AS module FROM alerts
  WHERE type IN ('SEMANTIC_DUPLICATION', 'ARCH_VIOLATION', 'ARCH_EMBED_DRIFT', 'VOLATILITY_ZONE')"""), select="""
  SELECT repo_id, module, sha, epoch_us(at) AS at_us FROM o WHERE module IS NOT NULL
  QUALIFY lag(at) OVER (PARTITION BY repo_id, module, sha ORDER BY at) IS NULL
    OR epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY repo_id, module, sha ORDER BY at)) >= 2000000"""))
def stale_modules(w):
    from plumbline.plans import ingest
    return ingest.modules_to_refresh(w.alerts).select("repo_id", "module", "sha", micros("at").alias("at_us"))
