"""Architecture memory: baseline, change, timeline (survey M26, M27, F23, J6, J7, T2, T3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.numeric import finite, fixed
from ..operators.latest import latest_per_key, top_per_key
from ..operators.running import asof_join, open_intervals

HEALTHY = 45
# fixed values: fields compared between two snapshots and their decimals
DELTA_FIELDS = {
    "entropyIndex": ("health", 2), "pressureIndex": ("health", 2), "avgCyclomatic": ("complexity", 2),
    "aiEditRatio": ("semantic", 4), "duplicationAlerts": ("semantic", 2), "archViolations": ("graph", 2), "churn24h": ("volatility", 2),
}


def reading(signature, group: str, field: str) -> Column:
    c = F.col(signature) if isinstance(signature, str) else signature
    return finite(c[group][field])


def delta(current, baseline) -> Column:
    """struct of the seven changes, null when a side is missing."""
    now, then = (F.col(c) if isinstance(c, str) else c for c in (current, baseline))
    each = [fixed(reading(now, g, f) - reading(then, g, f), n).alias(f) for f, (g, n) in DELTA_FIELDS.items()]
    return F.when(now.isNotNull() & then.isNotNull(), F.struct(*each))


def repo_memory(snapshots: DataFrame) -> DataFrame:
    """Current and baseline snapshot of every repository.

    The baseline is the newest healthy snapshot, else the one with the lowest
    combined load (newest on ties); none when it is the current one.  All
    three picks come from one aggregation.
    """
    rows = snapshots.filter(F.col("scope") == "repo")
    e, p, v = reading("signature", "health", "entropyIndex"), reading("signature", "health", "pressureIndex"), reading("signature", "graph", "archViolations")
    row, order = F.struct("sha", "at", "signature"), F.struct("at", "sha")
    load = F.struct((-(e + p + v * 20)).alias("l"), F.col("at"), F.col("sha"))
    picked = rows.groupBy("repo_id").agg(
        F.max_by(row, order).alias("current"),
        F.max_by(row, F.when((e <= HEALTHY) & (p <= HEALTHY), order)).alias("_healthy"), F.max_by(row, load).alias("_best"))
    base = F.coalesce("_healthy", "_best")
    same = (base["sha"] == F.col("current.sha")) & (base["at"] == F.col("current.at"))
    out = picked.withColumn("baseline", F.when(~same, base)).withColumn(
        "strategy", F.when(~same, F.when(F.col("_healthy").isNotNull(), "latest_healthy").otherwise("best_recent")))
    return out.select("repo_id", "current", "baseline", "strategy", delta("current.signature", "baseline.signature").alias("delta"))


def module_memory(snapshots: DataFrame, memory: DataFrame, n: int = 8) -> DataFrame:
    """The heaviest modules of every repository against their state at the
    repository's baseline time, with posture (T3, J7, F23)."""
    rows = snapshots.filter(F.col("scope") == "module")
    latest = latest_per_key(rows, ["repo_id", "subject_id"], ["at", "sha"], ["sha", "at", "signature"])
    e, p, v = reading("signature", "health", "entropyIndex"), reading("signature", "health", "pressureIndex"), reading("signature", "graph", "archViolations")
    risk = fixed(p * 1.25 + e * 0.85 + v * 18, 6)
    top = top_per_key(latest.withColumn("_risk", risk), ["repo_id"], [F.desc("_risk"), F.col("subject_id")], n)
    timed = top.join(memory.select("repo_id", F.col("baseline.at").alias("_base_at")), "repo_id", "left")
    known = timed.filter(F.col("_base_at").isNotNull())
    looked = asof_join(known, rows.select("repo_id", "subject_id", "at", "sha", "signature"), ["repo_id", "subject_id"], "_base_at", "at",
                       ["signature"], name="_then", tie="sha")
    every = looked.unionByName(timed.filter(F.col("_base_at").isNull()), allowMissingColumns=True)
    out = every.withColumn("delta", delta("signature", "_then.signature"))
    posture = bands.module_posture(p, e, F.col("delta.pressureIndex"), F.col("delta.entropyIndex"))
    return out.select("repo_id", F.col("subject_id").alias("module"), "rank", "at", "signature", "delta", posture.alias("posture"))


def timeline(snapshots: DataFrame, incidents: DataFrame, n: int = 18) -> DataFrame:
    """The newest repository snapshots with the incidents open at that time."""
    rows = snapshots.filter(F.col("scope") == "repo")
    top = top_per_key(rows, ["repo_id"], [F.desc("at"), F.desc("sha")], n)
    counted = open_intervals(top, incidents, ["repo_id"], "at", "opened_at", "closed_at", "incident_count")
    return counted.select(
        "repo_id", "sha", "at", reading("signature", "health", "entropyIndex").alias("entropy_index"),
        reading("signature", "health", "pressureIndex").alias("pressure_index"),
        reading("signature", "graph", "archViolations").alias("arch_violations"),
        reading("signature", "semantic", "aiEditRatio").alias("ai_edit_ratio"), "incident_count")


# fixed values: frames shown for each choice of time frame; any other choice shows twelve
FRAMES = {"6": 6, "24": 24, "all": 96}


def report_trend(snapshots: DataFrame, incidents: DataFrame, frame: str | None = None) -> DataFrame:
    """The trend of a repository report: its newest frames, oldest first."""
    return timeline(snapshots, incidents, FRAMES.get(frame or "", 12)).orderBy("repo_id", "at", "sha")


def incident_frames(incidents: DataFrame, n: int = 10) -> DataFrame:
    """The newest incidents of every repository with what changed since they opened."""
    top = top_per_key(incidents, ["repo_id"], [F.desc("opened_at"), F.desc("incident_id")], n)

    def change(later, field):
        then, now = F.col("pre_signature.health")[field], F.col(f"{later}.health")[field]
        return F.when(F.col("pre_signature").isNotNull() & F.col(later).isNotNull(), fixed(finite(now) - finite(then), 2))

    return top.select(
        "repo_id", "incident_id", "type", "scope", "subject_id", "status", "severity", "opened_at", "closed_at",
        change("latest_signature", "entropyIndex").alias("entropy_to_latest"), change("latest_signature", "pressureIndex").alias("pressure_to_latest"),
        F.when(F.col("closed_at").isNotNull(), change("post_signature", "entropyIndex")).alias("entropy_to_recovered"),
        F.when(F.col("closed_at").isNotNull(), change("post_signature", "pressureIndex")).alias("pressure_to_recovered"))
