"""Incident lifecycle from alerts and recoveries (survey X5, X6, T7, T8, J16, M28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.numeric import fixed
from ..operators.edges import source_of
from ..operators.latest import leading, top_per_key
from ..operators.running import asof_join
from ..operators.shared import materialized
from . import anomaly
from .fleet import since

KEY = ["repo_id", "type", "scope", "subject_id"]
ENTROPY_CLASS = ["ENTROPY_DRIFT", "SEMANTIC_DUPLICATION", "COMPLEXITY_CREEP", "VOLATILITY_ZONE"]
PRESSURE_CLASS = ["ARCH_PRESSURE", "ARCH_VIOLATION", "ARCH_EMBED_DRIFT"]


def tracked_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts that open or update incidents, with their subject."""
    module = F.when(F.col("evidence.module") != "", F.col("evidence.module"))
    kept = (F.col("type") == "ENTROPY_DRIFT") | ((F.col("type") == "ARCH_PRESSURE") & module.isNotNull())
    return alerts.filter(kept).select(
        "repo_id", "type", F.when(module.isNotNull(), "module").otherwise("repo").alias("scope"),
        F.coalesce(module, "repo_id").alias("subject_id"), "at", "sha", "severity", "title")


def recoveries(entropy: DataFrame, pressure: DataFrame) -> DataFrame:
    """Readings without anomaly at or below the clear line."""
    calm = F.col("anomaly").isNull() & (F.col("value") <= F.col("clear_threshold"))
    pick = lambda df, kind: df.filter(calm).select(
        "repo_id", F.lit(kind).alias("type"), "scope", "subject_id", "at", "sha", "value", "clear_threshold",
        "baseline_mean", "baseline_stddev")
    return pick(entropy, "ENTROPY_DRIFT").unionByName(pick(pressure, "ARCH_PRESSURE"))


def index_recoveries(assessed: DataFrame) -> DataFrame:
    """``recoveries`` of readings assessed in one pass (``anomaly.assess_indexes``)."""
    kind = F.when(F.col("key") == "code_entropy_index", "ENTROPY_DRIFT").otherwise("ARCH_PRESSURE")
    calm = F.col("anomaly").isNull() & (F.col("value") <= F.col("clear_threshold"))
    return assessed.filter(calm).select(
        "repo_id", kind.alias("type"), "scope", "subject_id", "at", "sha", "value", "clear_threshold", "baseline_mean", "baseline_stddev")


def lifecycle(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """Incidents of all readings and alerts (X5); the readings are assessed once and their recoveries kept in the shared folder."""
    calm = materialized(index_recoveries(anomaly.assess_indexes(metrics)), "recoveries")
    return fold(tracked_alerts(alerts), calm)


def fold(alerts: DataFrame, recovered: DataFrame) -> DataFrame:
    """Incidents as the alerts that share the same next recovery.

    An alert opens an incident, later ones update it, the first recovery
    after it closes it; so all alerts of one incident see the same next
    recovery, and the state machine becomes a lookup and one aggregation.
    An optional ``weight`` says how many alerts a row stands for.
    """
    payload = ["sha", "value", "clear_threshold", "baseline_mean", "baseline_stddev"]
    if "weight" not in alerts.columns:
        alerts = alerts.withColumn("weight", F.lit(1).cast("bigint"))
    looked = asof_join(alerts, recovered.select(*KEY, "at", *payload), KEY, "at", "at", payload,
                       name="_end", strict=True, forward=True)
    order = F.struct("at", "sha")
    grouped = looked.groupBy(*KEY, F.col("_end.at").alias("closed_at")).agg(
        F.min("at").alias("opened_at"), F.max("at").alias("last_alert_at"),
        F.min_by(F.struct("sha", "title", "severity"), order).alias("_first"), F.max_by(F.struct("severity", "title", "sha"), order).alias("_last"),
        F.sum("weight").alias("alert_count"), F.any_value("_end").alias("_end"))
    end = F.col("_end")
    return grouped.select(
        F.concat(F.lit("incident_"), F.md5(F.concat_ws("|", *KEY, F.unix_micros("opened_at").cast("string")))).alias("incident_id"),
        *KEY, F.when(end.isNull(), "open").otherwise("closed").alias("status"), F.col("_last.severity").alias("severity"),
        "opened_at", "last_alert_at", "closed_at", F.coalesce("closed_at", "last_alert_at").alias("updated_at"),
        F.col("_first.sha").alias("opened_sha"), F.col("_last.sha").alias("latest_sha"), end["sha"].alias("closed_sha"),
        F.col("_first.title").alias("opened_alert_title"), F.col("_last.title").alias("latest_alert_title"), "alert_count",
        F.when(end.isNotNull(), F.struct(
            F.lit("returned_to_baseline").alias("reason"), fixed(end["clear_threshold"], 2).alias("clearThreshold"),
            fixed(end["value"], 2).alias("currentValue"), fixed(end["baseline_mean"], 2).alias("baselineMean"),
            fixed(end["baseline_stddev"], 2).alias("baselineStddev"))).alias("resolution"))


def open_alerts(incidents: DataFrame) -> DataFrame:
    """Open incidents as alerts to fold on with: the first and the last of each,
    weighted so that the counts continue."""
    single = F.col("opened_at") == F.col("last_alert_at")
    first = F.struct(F.col("opened_at").alias("at"), F.col("opened_sha").alias("sha"), F.col("severity").alias("severity"),
                     F.col("opened_alert_title").alias("title"),
                     F.when(single, F.col("alert_count")).otherwise(F.col("alert_count") - 1).alias("weight"))
    last = F.when(~single, F.struct(F.col("last_alert_at").alias("at"), F.col("latest_sha").alias("sha"), F.col("severity").alias("severity"),
                                    F.col("latest_alert_title").alias("title"), F.lit(1).cast("bigint").alias("weight")))
    rows = F.filter(F.array(first, last), lambda r: r.isNotNull())
    return incidents.filter(F.col("status") == "open").select(*KEY, F.inline(rows))


def with_signatures(incidents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Attach the snapshots in force at open, last update and close.

    The three times of an incident ask in one lookup and are folded back to
    one row per incident.
    """
    key = ["repo_id", "scope", "subject_id"]
    times = {"pre": "opened_at", "latest": "last_alert_at", "post": "closed_at"}
    asks = F.filter(F.array(*[F.struct(F.lit(n).alias("_which"), F.col(c).alias("_when")) for n, c in times.items()]),
                    lambda a: a["_when"].isNotNull())
    spread = incidents.select(*key, "incident_id", F.struct(*incidents.columns).alias("_incident"), F.inline(asks))
    looked = asof_join(spread, snapshots.select(*key, "at", "sha", "signature"), key, "_when", "at", ["signature"],
                       name="_snap", tie="sha")
    at = lambda n: F.max_by("_snap.signature", F.when(F.col("_which") == n, F.lit(1))).alias(f"{n}_signature")
    folded = looked.groupBy("incident_id").agg(F.any_value("_incident").alias("_incident"), *[at(n) for n in times])
    return folded.select("_incident.*", *[f"{n}_signature" for n in times])


def ranked_fixes(refactors: DataFrame, scope: str, n: int = 3, subjects: DataFrame | None = None) -> DataFrame:
    """The best fixes per subject: applied, accepted, then confidence and recency.

    A suggestion belongs to its target and to every module or edge it names;
    it is spread over those subjects and ranked within each, with the limit
    applied inside the input partitions first.  With ``subjects`` (repo_id,
    subject_id) only theirs are ranked.
    """
    rows = refactors.filter(F.col("status") != "dismissed")
    if scope == "repo":
        rows = rows.withColumn("subject_id", F.col("repo_id"))
    else:
        named = F.col("entities.modules" if scope == "module" else "entities.edgesAdded")
        rows = rows.withColumn("subject_id", F.explode(F.array_distinct(F.concat(F.array("target"), named))))
    rows = _of(rows, "subject_id", subjects)
    if n == 1:
        rows = leading(rows, ["repo_id", "subject_id"], bands.fix_rank("status"), F.col("confidence"))
    order = [bands.fix_rank("status"), F.desc("confidence"), F.desc("at"), F.col("id")]
    return top_per_key(rows, ["repo_id", "subject_id"], order, n).select(
        "repo_id", "subject_id", "rank", "id", "type", "confidence", "target", "impact", "status")


def _of(rows: DataFrame, name: str, subjects: DataFrame | None) -> DataFrame:
    """The rows of the given subjects; all rows without any given."""
    if subjects is None:
        return rows
    return rows.join(subjects.select("repo_id", F.col("subject_id").alias(name)).distinct(), ["repo_id", name], "left_semi")


def with_resolution_fix(incidents: DataFrame, refactors: DataFrame) -> DataFrame:
    """Attach the best fix of each closed incident's subject (X5): a module's own, a repository's best of all."""
    fix = F.struct(F.col("type").alias("refactorType"), fixed("confidence", 2).alias("refactorConfidence"),
                   F.col("target").alias("refactorTarget"), F.col("status").alias("refactorStatus"))
    best = None
    for scope in ("module", "repo"):
        part = ranked_fixes(refactors, scope, 1).select("repo_id", F.lit(scope).alias("scope"), "subject_id", fix.alias("fix"))
        best = part if best is None else best.unionByName(part)
    return incidents.join(best, ["repo_id", "scope", "subject_id"], "left").withColumn(
        "fix", F.when(F.col("status") == "closed", F.col("fix")))


def recent_outcomes(incidents: DataFrame, scope: str, n: int = 3, subjects: DataFrame | None = None) -> DataFrame:
    """The last closed incidents per subject with what changed.

    The outcomes of a boundary are those of its source module, so boundaries
    have to be given as ``subjects`` (repo_id, subject_id); for the other
    scopes they restrict the answer.
    """
    if scope == "boundary":
        if subjects is None:
            raise ValueError("outcomes of boundaries need the boundaries")
        edges = subjects.select("repo_id", F.col("subject_id").alias("_edge"), source_of("subject_id").alias("subject_id")).distinct()
        found = recent_outcomes(incidents, "module", n, edges)
        return edges.join(found, ["repo_id", "subject_id"]).withColumn("subject_id", F.col("_edge")).drop("_edge")
    closed = incidents.filter(F.col("status") == "closed")
    if scope == "repo":
        closed = closed.withColumn("subject", F.col("repo_id"))
    else:
        closed = closed.filter(F.col("scope") == "module").withColumn("subject", F.col("subject_id"))
    closed = _of(closed, "subject", subjects)
    order = [F.desc_nulls_last("closed_at"), F.desc("opened_at"), F.desc("incident_id")]
    last = top_per_key(closed, ["repo_id", "subject"], order, n)
    delta = lambda f: F.coalesce(fixed(F.col(f"post_signature.health.{f}") - F.col(f"pre_signature.health.{f}"), 2), F.lit(0.0))
    return last.select("repo_id", F.col("subject").alias("subject_id"), "rank", "incident_id", "type", "closed_at",
                       delta("entropyIndex").alias("delta_entropy"), delta("pressureIndex").alias("delta_pressure"), "resolution")


def outcomes_with_fixes(outcomes: DataFrame, fixes: DataFrame) -> DataFrame:
    """Pair the i-th outcome with the i-th fix, else the first."""
    key = ["repo_id", "subject_id"]
    part = ["type", "target", "confidence", "status"]
    ith = fixes.select(*key, "rank", F.struct(*part).alias("_ith"))
    first = fixes.filter(F.col("rank") == 1).select(*key, F.struct(*part).alias("_first"))
    fix = F.coalesce("_ith", "_first")
    r = F.col("resolution")
    joined = outcomes.join(ith, [*key, "rank"], "left").join(first, key, "left")
    return joined.select(
        *key, "rank", "incident_id", "type", "closed_at", "delta_entropy", "delta_pressure",
        F.coalesce(r["reason"], F.lit("recovered")).alias("resolution_reason"),
        F.coalesce(r["refactorType"], fix["type"]).alias("fix_type"),
        F.coalesce(r["refactorTarget"], fix["target"]).alias("fix_target"),
        F.coalesce(fixed(r["refactorConfidence"], 2), fix["confidence"], F.lit(0.0)).alias("fix_confidence"),
        F.coalesce(r["refactorStatus"], fix["status"], F.lit("observed")).alias("fix_status"))


def backfill(alerts: DataFrame, entropy: DataFrame, pressure: DataFrame, as_of: Column) -> DataFrame:
    """One incident per repository, class and module from the last two weeks of alerts.

    Active when the latest index reading of the subject is anomalous; subjects
    without a reading give none.
    """
    kind = F.when(F.col("type").isin(ENTROPY_CLASS), "ENTROPY_DRIFT").otherwise("ARCH_PRESSURE")
    rows = alerts.filter(F.col("type").isin([*ENTROPY_CLASS, *PRESSURE_CLASS]) & since("at", as_of, "14 DAYS"))
    owner = F.coalesce("evidence.module", "repo_id")
    last = rows.groupBy("repo_id", kind.alias("kind"), owner.alias("owner")).agg(
        F.max_by(F.struct("sha", "at", "severity", "title", "evidence"), F.struct("at", "sha")).alias("a"))
    ev = F.col("a.evidence")
    subject = bands.alert_module(ev["module"], ev["filePath"], ev["symbolId"], "repo_id")
    placed = last.withColumn("subject_id", subject).withColumn(
        "scope", F.when(F.col("subject_id") == F.col("repo_id"), "repo").otherwise("module"))
    newest = lambda df, kind: df.groupBy("repo_id", "scope", "subject_id").agg(
        F.max_by(F.struct("anomaly"), F.struct("at", "sha")).alias("m")).withColumn("kind", F.lit(kind))
    state = newest(entropy, "ENTROPY_DRIFT").unionByName(newest(pressure, "ARCH_PRESSURE"))
    joined = placed.join(state, ["repo_id", "scope", "subject_id", "kind"])
    active = F.col("m.anomaly").isNotNull()
    prefix = F.when(active, "[backfill] ").otherwise("[historical] ")
    return joined.select(
        "repo_id", F.col("kind").alias("type"), "scope", "subject_id", F.when(active, "open").otherwise("closed").alias("status"),
        F.col("a.severity").alias("severity"), F.col("a.at").alias("opened_at"), F.when(~active, F.col("a.at")).alias("closed_at"),
        F.concat(prefix, "a.title").alias("title"))
