"""Event folds of the ingest side (survey J7, J8, S1-S13, S20, S23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import bands, digests, heuristics, paths
from ..operators.merge import insert_absent, upsert
from ..operators.running import MINUTE, asof_join
from ..operators.spacing import quiet_before
from ..operators.timegrid import page

LOOKBACK = 45 * MINUTE
SNAPSHOT_LIMIT = 200_000


def attribute_changes(changes: DataFrame, telemetry: DataFrame, within_us: int = LOOKBACK) -> DataFrame:
    """File changes with the newest telemetry of the same file in the last 45 minutes.

    The telemetry may name the file by relative or by absolute path.  Each is
    an equality lookup; the later of the two matches wins.
    """
    payload = ["id", "provenance", "source", "editor", "session_id", "observed_at"]
    # both paths of a change ask in one lookup, both paths of a report answer
    asks = changes.select(*changes.columns, F.posexplode(F.array(
        F.concat(F.lit("r:"), "file_path"), F.concat(F.lit("a:"), "absolute_path"))).alias("_pos", "_path"))
    said = telemetry.select("repo_id", *payload, F.explode(F.filter(F.array(
        F.concat(F.lit("r:"), "file_path"), F.concat(F.lit("a:"), "absolute_path")), lambda p: p.isNotNull())).alias("_path"))
    looked = asof_join(asks, said, ["repo_id", "_path"], "at", "observed_at", payload, name="_hit", tie="id", within_us=within_us)
    hit = F.col("_hit")
    out = looked.groupBy(*changes.columns).agg(F.max_by("_hit", F.struct(hit["observed_at"], hit["id"])).alias("_best"))
    best = F.col("_best")
    known = F.when(best["provenance"].isin(S.PROVENANCES), best["provenance"])
    return out.select(
        *changes.columns, known.alias("provenance"), best["source"].alias("telemetry_source"),
        best["editor"].alias("editor"), best["session_id"].alias("session_id"))


def changes_between(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, modified and deleted files between two listings.

    Listings have repo_id, file_path and a content hash; one full outer join
    on the path, ignored paths dropped first.
    """
    before = previous.filter(~paths.is_ignored(F.concat(F.lit("/"), "file_path"))).select("repo_id", "file_path", F.col("hash").alias("_old"))
    after = current.filter(~paths.is_ignored(F.concat(F.lit("/"), "file_path"))).select("repo_id", "file_path", F.col("hash").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("modified")
    return before.join(after, ["repo_id", "file_path"], "full").filter(
        ~F.col("_old").eqNullSafe(F.col("_new"))
    ).select("repo_id", "file_path", kind.alias("change_type"), paths.language("file_path").alias("language"))


def as_commits(changes: DataFrame) -> DataFrame:
    """One synthetic commit per file change; the id is random, so only for sinks."""
    return changes.withColumn("commit_sha", digests.random_id("local"))


def activity_of(changes: DataFrame, symbols: DataFrame, alerts: DataFrame) -> DataFrame:
    """Fold file changes, parse results and alerts into one activity row each.

    ``changes`` has repo_id, commit_sha, at, file_path, language, change_type;
    ``symbols`` has repo_id, commit_sha, file_path, symbol_count and at;
    ``alerts`` is the alert table.  Each side is reduced to one row per file
    and commit before they meet.
    """
    key = ["repo_id", "commit_sha", "file_path"]
    latest = changes.groupBy(*key).agg(
        F.min("at").alias("at"), F.max("at").alias("updated_at"),
        F.max_by(F.struct("language", "change_type"), "at").alias("_c"))
    parsed = symbols.groupBy(*key).agg(F.max_by("symbol_count", "at").alias("_symbols"))
    raised = alerts.filter(F.col("evidence.filePath").isNotNull()).groupBy(
        "repo_id", F.col("sha").alias("commit_sha"), F.col("evidence.filePath").alias("file_path"), "type"
    ).agg(F.count(F.lit(1)).alias("_n")).groupBy(*key).agg(
        F.sum("_n").alias("alert_count"),
        # at most one entry per alert type
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "_n"))),
                                 lambda t: F.concat(t["type"], F.lit(" x"), t["_n"].cast("string"))), ", ").alias("_types"))
    lang = F.col("_c.language")
    status = F.when(F.col("_symbols") > 0, "analyzed").when(F.col("_symbols") == 0, "no_symbols").otherwise(
        paths.parser_status(lang))
    lane = F.when(F.col("_symbols") > 0, F.concat(F.lit("analyzed "), F.col("_symbols").cast("string"))).when(
        F.col("_symbols") == 0, F.lit("no symbols found")).otherwise(paths.parser_lane(lang))
    note = F.when(F.col("_types").isNotNull(), F.concat(lane, F.lit("; alerts: "), F.col("_types"))).otherwise(lane)
    return latest.join(parsed, key, "left").join(raised, key, "left").select(
        F.concat_ws(":", "commit_sha", "file_path").alias("event_id"), *key, "at", "updated_at",
        lang.alias("language"), F.col("_c.change_type").alias("change_type"), status.alias("parser_status"),
        F.coalesce("_symbols", F.lit(0)).cast("bigint").alias("symbol_count"),
        F.coalesce("alert_count", F.lit(0)).cast("bigint").alias("alert_count"), note.alias("note"))


TOLD = ["provenance", "telemetry_source", "telemetry_editor", "telemetry_session_id"]


def with_telemetry(activity: DataFrame, reports: DataFrame) -> DataFrame:
    """Activity rows patched with what later reports say about their file and commit.

    ``reports`` has repo_id, commit_sha, file_path, at and the four columns of
    ``TOLD``.  Each column takes its newest value that is not null, so a report
    that says nothing of it changes nothing; of reports at one time the
    greatest value counts.
    """
    key = ["repo_id", "commit_sha", "file_path"]
    newest = reports.groupBy(*key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", c))).alias(f"_{c}") for c in TOLD])
    rest = [c for c in activity.columns if c not in TOLD]
    stored = [F.col(c) if c in activity.columns else F.lit(None).cast("string") for c in TOLD]
    return activity.join(newest, key, "left").select(
        *rest, *[F.coalesce(f"_{c}", old).alias(c) for c, old in zip(TOLD, stored)])


# fixed values: parser states of each activity page
PAGE_MODES = {"all": None, "full": ["pending", "analyzed", "no_symbols"], "watched": ["unsupported"]}


def activity_page(activity: DataFrame, repo_id: str, mode: str = "all", number: int = 1, size: int = 12,
                  parser_status: str | None = None, after: Column | None = None) -> DataFrame:
    """One page of a repository's activity, newest first, with the totals of all its pages.

    ``parser_status`` counts in mode ``all`` only.  ``after`` is a struct (at,
    event_id), the last row of the page before: the page then starts behind it
    and nothing in front of it is sorted, however deep the page lies.
    """
    wanted = PAGE_MODES[mode] or ([parser_status] if parser_status else None)
    rows = activity.filter(F.col("repo_id") == repo_id)
    if wanted:
        rows = rows.filter(F.col("parser_status").isin(wanted))
    total = rows.agg(F.count(F.lit(1))).scalar()
    shown = rows if after is None else rows.filter(F.struct("at", "event_id") < after)
    order = [F.desc("at"), F.desc("event_id")]
    part = page(shown, order, number, size) if after is None else shown.orderBy(*order).limit(size)
    return part.withColumn("total", total).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))


def new_telemetry(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Telemetry rows not stored yet, equal on six columns, null sessions equal."""
    return insert_absent(base, incoming, ["repo_id", "file_path", "provenance", "source", "session_id", "observed_at"], ["id"])


def storable_snapshots(files: DataFrame) -> DataFrame:
    """File contents worth keeping: not deleted and at most 200 000 characters."""
    return files.filter((F.col("change_type") != "deleted") & (F.length("content") <= SNAPSHOT_LIMIT))


def upsert_snapshots(base: DataFrame, written: DataFrame) -> DataFrame:
    """Snapshots of a commit and subject replaced by the one written last."""
    return upsert(base, written, ["repo_id", "sha", "scope", "subject_id"], ["at"])


def complete_heuristics(alerts: DataFrame) -> DataFrame:
    """Content alerts without a category, completed from their advice text."""
    ev = F.col("evidence")
    lacking = (F.col("type") == "CONTENT_HEURISTIC") & (F.coalesce(ev["heuristicCategory"], F.lit("")) == "")
    rows = alerts.filter(lacking)
    path = F.coalesce(ev["filePath"], F.trim(F.regexp_replace("title", r"(?i)^Non-code content drift detected in\s+", "")))
    found = F.coalesce(ev["heuristicDrivers"], heuristics.drivers_from_recommendation("recommendation"))
    return rows.withColumn("_path", path).withColumn("_found", found).select(
        "repo_id", "sha", "at", "title", F.col("_path").alias("file_path"), F.col("_found").alias("drivers"),
        heuristics.legacy_category("_found", "_path").alias("category"))


def watch_states(events: DataFrame) -> DataFrame:
    """Latest watch state per repository from lifecycle events.

    Events have repo_id, at, kind (registered, updated, deleted), enabled,
    root_path and error.
    """
    last = events.groupBy("repo_id").agg(
        F.max_by(F.struct("kind", "enabled", "root_path", "error"), "at").alias("e"), F.max("at").alias("at"))
    e = F.col("e")
    state = (
        F.when(e["kind"] == "deleted", "closed").when(e["error"].isNotNull(), "blocked")
        .when(~e["enabled"] | e["root_path"].isNull(), "inactive").otherwise("active"))
    return last.select("repo_id", "at", state.alias("watch_state"), e["error"].alias("watch_error"))


def watchable(repos: DataFrame) -> DataFrame:
    """Repositories the watcher starts with."""
    return repos.filter((F.col("kind") == "local") & F.col("root_path").isNotNull() & F.col("archived_at").isNull())


def modules_to_refresh(alerts: DataFrame, gap_us: int = 2_000_000) -> DataFrame:
    """Modules whose readings an alert makes stale, two seconds apart at least."""
    ev = F.col("evidence")
    stale = alerts.filter(F.col("type").isin("SEMANTIC_DUPLICATION", "ARCH_VIOLATION", "ARCH_EMBED_DRIFT", "VOLATILITY_ZONE"))
    owned = stale.withColumn("module", bands.alert_module(ev["module"], ev["filePath"], ev["symbolId"], None)).filter(
        F.col("module").isNotNull())
    return quiet_before(owned.select("repo_id", "module", "sha", "at"), ["repo_id", "module", "sha"], "at", gap_us)
