"""Alert pages, lifecycle and detail (survey P2, P7, W5, J10, X1, F31-F33, A14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, digests
from ..operators.latest import top_per_key
from ..operators.merge import fold_filters
from ..operators.spacing import keep_spaced
from ..operators.timegrid import page

TTL_MS = 15 * 60 * 1000
PREVIEW_ABOVE, PREVIEW_LINES = 16, 120
DIFF_CONTEXT, DIFF_LINES = 3, 220
NEWLINE = "\r?\n"


def with_ids(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_id", digests.alert_id("repo_id", "sha", "at", "type", "title"))


def matching(alerts: DataFrame, *, repo_id=None, since=None, type=None, severity=None, status=None, category=None) -> DataFrame:
    """Alerts that meet every condition given."""
    found = F.coalesce(F.col("evidence.heuristicCategory"), F.lit(""))
    return alerts.filter(fold_filters([
        (repo_id, lambda v: F.col("repo_id") == v),
        (since, lambda v: F.col("at") >= F.lit(v).cast("timestamp")),
        (type, lambda v: F.col("type") == v),
        (severity, lambda v: F.col("severity") == v),
        (status, lambda v: F.col("status") == v),
        (category, lambda v: found == v),
    ]))


def alert_page(alerts: DataFrame, number: int = 1, size: int = 12) -> DataFrame:
    return with_ids(page(alerts, [F.desc("at"), F.desc("sha"), F.desc("type")], number, size))


def latest_alerts(alerts: DataFrame, repo_id: str, n: int = 25) -> DataFrame:
    return with_ids(alerts.filter(F.col("repo_id") == repo_id).orderBy(F.desc("at"), F.desc("sha")).limit(n))


def newest_per_repo(alerts: DataFrame, n: int = 8) -> DataFrame:
    """The newest alerts of every repository report."""
    return with_ids(top_per_key(alerts, ["repo_id"], [F.desc("at"), F.desc("sha")], n))


def status_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per repository and status."""
    return alerts.groupBy("repo_id", F.coalesce("status", F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("total"))


def status_maps(counts: DataFrame) -> DataFrame:
    """One map per repository; its size is the number of statuses."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "total"))))
    return counts.groupBy("repo_id").agg(entries.alias("by_status"))


def set_status(alerts: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Alerts after requested status changes.

    ``wanted`` has alert_id, status and actor.  Acknowledging stamps once and
    clears a resolution, resolving stamps, reopening clears both.
    """
    rows = with_ids(alerts) if "alert_id" not in alerts.columns else alerts
    asked = wanted.select("alert_id", F.col("status").alias("_s"), F.col("actor").alias("_a"))
    joined = rows.join(asked, "alert_id", "left")
    s, a, none = F.col("_s"), F.col("_a"), F.lit(None)

    def acknowledged(name, value):
        old = F.col(name)
        return F.when((s == "acknowledged") & old.isNull(), value).when(s == "open", none).otherwise(old)

    def resolved(name, value):
        return F.when(s == "resolved", value).when(s.isNotNull(), none).otherwise(F.col(name))

    new = {
        "status": F.coalesce(s, F.col("status")),
        "acknowledged_at": acknowledged("acknowledged_at", now), "acknowledged_by": acknowledged("acknowledged_by", a),
        "resolved_at": resolved("resolved_at", now), "resolved_by": resolved("resolved_by", a),
        "status_updated_at": F.when(s.isNotNull(), now).otherwise(F.col("status_updated_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def status_comment(status, actor, note) -> Column:
    """Text of the comment a status change leaves."""
    verb = F.when(F.col(status) == "acknowledged", "Acknowledged").when(F.col(status) == "resolved", "Resolved").otherwise("Reopened")
    said = F.trim(F.coalesce(F.col(note), F.lit("")))
    head = F.concat(verb, F.lit(" by "), F.col(actor), F.lit("."))
    return F.when(said != "", F.concat(head, F.lit(" "), said)).otherwise(head)


def deduplicated(alerts: DataFrame) -> DataFrame:
    """Alerts after fingerprint suppression.

    Only four types are suppressed: a repeat within fifteen minutes of the
    last alert let through is dropped.
    """
    covered = F.col("type").isin(digests.FINGERPRINTED_TYPES)
    marked = alerts.filter(covered).withColumn("fingerprint", digests.alert_fingerprint())
    kept = keep_spaced(marked, ["fingerprint"], "at", TTL_MS, tie="sha")
    return kept.drop("fingerprint").unionByName(alerts.filter(~covered))


def related_alerts(alerts: DataFrame, n: int = 6) -> DataFrame:
    """For every alert with a file: the newest other alerts of the same file.

    Ranking needs only the file's newest ``n + 1`` alerts, so those are taken
    first and the alert itself is left out afterwards.
    """
    rows = with_ids(alerts).filter(F.coalesce("evidence.filePath", F.lit("")) != "").withColumn("_file", F.col("evidence.filePath"))
    newest = top_per_key(rows, ["repo_id", "_file"], [F.desc("at"), F.desc("alert_id")], n + 1, rank="_rank").select(
        "repo_id", "_file", F.col("alert_id").alias("related_id"), F.col("at").alias("related_at"), "_rank")
    paired = rows.select("repo_id", "_file", "alert_id").join(newest, ["repo_id", "_file"]).filter(F.col("alert_id") != F.col("related_id"))
    # an alert among the newest n + 1 loses its own place, any other keeps the first n
    return top_per_key(paired, ["alert_id"], [F.col("_rank")], n).select("repo_id", "alert_id", "related_id", "related_at", "rank")


def activity_history(alerts: DataFrame, activity: DataFrame, n: int = 12) -> DataFrame:
    """The newest activity of every alert's file, found once per file."""
    files = alerts.select("repo_id", F.col("evidence.filePath").alias("file_path")).filter(F.col("file_path").isNotNull()).distinct()
    newest = top_per_key(activity, ["repo_id", "file_path"], [F.desc("at"), F.desc("event_id")], n)
    return newest.join(files, ["repo_id", "file_path"], "left_semi")


def related_refactors(alert: DataFrame, refactors: DataFrame, links: DataFrame, n: int = 6) -> DataFrame:
    """Suggestions for the file or module of each given alert, with a link flag.

    Suggestions are spread over every file and module they name and met by
    equality.
    """
    subjects = alert.select("repo_id", "alert_id", F.explode(F.array_distinct(F.filter(
        F.array(F.col("evidence.filePath"), F.col("evidence.module")), lambda s: s.isNotNull()))).alias("subject"))
    named = F.array_distinct(F.concat(F.array("target"), "entities.files", "entities.modules"))
    spread = refactors.select("repo_id", "id", "type", "status", "at", F.explode(named).alias("subject"))
    order = [bands.refactor_rank("status"), F.desc("at"), F.col("id")]
    # the best n per subject are enough for the best n per alert
    best = top_per_key(spread, ["repo_id", "subject"], order, n).drop("rank")
    met = subjects.join(best, ["repo_id", "subject"]).drop("subject").distinct()
    top = top_per_key(met, ["alert_id"], order, n)
    linked = links.select("repo_id", "alert_id", F.col("refactor_id").alias("id")).distinct().withColumn("_linked", F.lit(True))
    return top.join(linked, ["repo_id", "alert_id", "id"], "left").withColumn("linked", F.coalesce("_linked", F.lit(False))).drop("_linked")


def search_terms(evidence, title) -> Column:
    """Words to look for in the file, in order of preference (F32)."""
    ev = F.col(evidence)
    symbol = F.element_at(F.split(F.element_at(F.split(ev["symbolId"], ":"), -1), "[.]"), -1)
    words = F.slice(F.regexp_extract_all(F.col(title), F.lit("[A-Za-z][A-Za-z0-9_]{3,}"), F.lit(0)), 1, 6)
    own = F.filter(F.array(symbol, ev["module"]), lambda t: t.isNotNull() & (F.length(t) >= 3))
    return F.array_distinct(F.concat(own, words))


def preview(files: DataFrame) -> DataFrame:
    """Window of lines around the first hit of the best term (F32).

    ``files`` has ``content`` and ``terms``.  Adds the total line count, the
    first and last shown line, the term and the shown lines with highlights.
    """
    rows = files.withColumn("_lines", F.split("content", NEWLINE))
    hits = F.transform("terms", lambda t: F.struct(
        F.array_position(F.transform(F.col("_lines"), lambda l: l.contains(t)), F.lit(True)).alias("line"), t.alias("term")))
    rows = rows.withColumn("_hit", F.get(F.filter(hits, lambda h: h["line"] > 0), F.lit(0)))
    first = F.greatest(F.lit(1), F.coalesce(F.col("_hit.line"), F.lit(1)) - PREVIEW_ABOVE).cast("int")
    rows = rows.withColumn("total_lines", F.size("_lines")).withColumn("preview_start", first)
    last = F.least(F.col("total_lines"), F.col("preview_start") + PREVIEW_LINES - 1)
    shown = F.slice("_lines", F.col("preview_start"), F.lit(PREVIEW_LINES))
    marked = F.transform(shown, lambda l, i: F.struct(
        (F.col("preview_start") + i).alias("number"), l.alias("text"),
        F.coalesce(l.contains(F.col("_hit.term")), F.lit(False)).alias("highlight")))
    return rows.select(*files.columns, "total_lines", "preview_start", last.alias("preview_end"),
                       F.col("_hit.term").alias("matched_term"), marked.alias("lines"))


def _common(a: Column, b: Column) -> Column:
    """Number of equal leading entries of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    miss = F.array_position(same, F.lit(False)).cast("int")
    return F.when(miss > 0, miss - 1).otherwise(F.size(same))


def snapshot_diff(pairs: DataFrame) -> DataFrame:
    """Line diff of two file versions by common head and tail.

    ``pairs`` has ``previous`` and ``current`` text.  Adds ``diff``: up to 220
    structs of kind (context, remove, add) and text.
    """
    rows = pairs.withColumn("_p", F.split("previous", NEWLINE)).withColumn("_c", F.split("current", NEWLINE))
    rows = rows.withColumn("_head", _common(F.col("_c"), F.col("_p")))
    rest = lambda c: F.slice(F.col(c), F.col("_head") + 1, F.size(c) - F.col("_head"))
    rows = rows.withColumn("_pr", rest("_p")).withColumn("_cr", rest("_c"))
    tail = F.when((F.size("_pr") == 0) | (F.size("_cr") == 0), 0).otherwise(
        F.least(_common(F.reverse("_cr"), F.reverse("_pr")), F.size("_pr"), F.size("_cr")))
    rows = rows.withColumn("_tail", tail)
    lead = F.least(F.col("_head"), F.lit(DIFF_CONTEXT))
    line = lambda kind, prefix: lambda t: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), t).alias("text"))
    before = F.transform(F.slice("_p", F.col("_head") - lead + 1, lead), line("context", " "))
    removed = F.transform(F.slice("_pr", F.lit(1), F.size("_pr") - F.col("_tail")), line("remove", "-"))
    added = F.transform(F.slice("_cr", F.lit(1), F.size("_cr") - F.col("_tail")), line("add", "+"))
    after = F.transform(F.slice("_cr", F.size("_cr") - F.col("_tail") + 1, F.least(F.col("_tail"), F.lit(DIFF_CONTEXT))), line("context", " "))
    return rows.withColumn("diff", F.slice(F.concat(before, removed, added, after), 1, DIFF_LINES)).select(*pairs.columns, "diff")


def latest_pairs(snapshots: DataFrame) -> DataFrame:
    """The two newest stored versions of every file."""
    two = top_per_key(snapshots, ["repo_id", "file_path"], [F.desc("observed_at"), F.desc("id")], 2)
    at = lambda r: F.max_by("content", F.when(F.col("rank") == r, F.lit(1)))
    return two.groupBy("repo_id", "file_path").agg(at(1).alias("current"), at(2).alias("previous")).filter(
        F.col("previous").isNotNull())


def diff_line_kind(line) -> Column:
    """Kind of one line of a unified diff."""
    l = F.col(line)
    meta = l.startswith("@@") | l.startswith("diff --git") | l.startswith("index ") | l.startswith("---") | l.startswith("+++")
    return F.when(meta, "meta").when(l.startswith("+"), "add").when(l.startswith("-"), "remove").otherwise("context")
