"""From rule findings to rows of the alert table, and on to what they make stale (survey U3, X9).

Every rule's findings become rows of one shape, are united, pass the
suppression of repeats and enter the table unless it holds them already; what
was inserted says which modules must be read anew.  The two stages stay in order:
readings raise alerts, inserted alerts refresh readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.merge import insert_absent
from ..operators.shared import materialized
from . import alerts as alert_plans
from . import anomaly, ingest, rules
from .fleet import since

KEY = ["repo_id", "sha", "at", "type", "title"]
#: The readings that an alert's evidence names, and the columns they come from.
ENTROPY_READINGS = {
    "code_entropy_index": "value", "previous_entropy_index": "previous_value", "entropy_delta": "delta",
    "entropy_baseline_mean": "baseline_mean", "entropy_baseline_stddev": "baseline_stddev", "entropy_z_score": "z_score",
    "entropy_warn_threshold": "warn_threshold", "entropy_error_threshold": "error_threshold",
    "entropy_clear_threshold": "clear_threshold", "entropy_baseline_samples": "baseline_samples",
}
PRESSURE_READINGS = {
    "pressure_index": "value", "previous_pressure_index": "previous_value", "pressure_baseline_24h": "baseline_24h",
    "pressure_delta_24h": "delta", "pressure_baseline_mean": "baseline_mean", "pressure_baseline_stddev": "baseline_stddev",
    "pressure_z_score": "z_score", "pressure_warn_threshold": "warn_threshold", "pressure_error_threshold": "error_threshold",
    "pressure_clear_threshold": "clear_threshold", "pressure_baseline_samples": "baseline_samples",
}
#: Advice texts of our own.
ADVICE = {
    "ENTROPY_DRIFT": "Lower the spread of dependencies, copies and churn of this part.",
    "ARCH_PRESSURE": "Slow the growth of this module's boundaries or split what it is responsible for.",
    "COMPLEXITY_CREEP": "Split this symbol or simplify its branches.",
    "VOLATILITY_ZONE": "Cover this file with tests or divide it before it changes again.",
    "SEMANTIC_DUPLICATION": "Compare with the neighbour and keep one of the two.",
    "INTENT_DRIFT": "Check that this symbol still belongs to its module.",
    "ARCH_VIOLATION": "Turn the dependency around or go through the layer between.",
}


def evidence(**given: Column) -> Column:
    """An evidence struct with the given fields, the others null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct_type(S.EVIDENCE).fields])


def readings(names: dict[str, str], *more: str) -> Column:
    """A map of the readings that are there."""
    pairs = [(n, c) for n, c in names.items()] + [(n, n) for n in more if n not in names]
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.col(c).cast("double").alias("v")) for n, c in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def rows(found: DataFrame, kind: str, title: Column, proof: Column) -> DataFrame:
    """Findings with repo_id, sha, at and severity as alert rows."""
    return found.select("repo_id", "sha", "at", "severity", F.lit(kind).alias("type"), title.alias("title"), proof.alias("evidence"),
                        F.lit(ADVICE[kind]).alias("recommendation"))


def from_metrics(metrics: DataFrame, as_of: Column, volatile_above: int = rules.VOLATILE_COMMITS) -> DataFrame:
    """What complexity, pressure, entropy and volatility rules raise (R3-R6); the readings are assessed once, their anomalies kept, and parts found for both kinds at once."""
    found = materialized(anomaly.assess_indexes(metrics).filter(F.col("anomaly").isNotNull()), "anomalies")
    own = lambda names, keys: [k for k in keys if k not in names]
    entropy_parts, pressure_parts = own(ENTROPY_READINGS, S.ENTROPY_KEYS), own(PRESSURE_READINGS, S.PRESSURE_KEYS)
    known = rules.with_parts(found, metrics, [*entropy_parts, *pressure_parts]).withColumn("severity", F.col("anomaly"))
    is_entropy = F.col("key") == "code_entropy_index"
    either = lambda entropy, pressure: F.when(is_entropy, entropy).otherwise(pressure)
    label = F.when(F.col("scope") == "repo", "Repo").otherwise("Module")
    raised = known.select(
        "repo_id", "sha", "at", "severity", either(F.lit("ENTROPY_DRIFT"), F.lit("ARCH_PRESSURE")).alias("type"),
        F.concat(either(F.concat(label, F.lit(" entropy rising in ")), F.lit("Architecture pressure building in ")), "subject_id").alias("title"),
        evidence(module=F.when(~is_entropy | (F.col("scope") == "module"), F.col("subject_id")),
                 metrics=either(readings(ENTROPY_READINGS, *entropy_parts), readings(PRESSURE_READINGS, *pressure_parts))).alias("evidence"),
        either(F.lit(ADVICE["ENTROPY_DRIFT"]), F.lit(ADVICE["ARCH_PRESSURE"])).alias("recommendation"))
    complexity = rules.complexity_creep(metrics)
    raised = raised.unionByName(rows(complexity, "COMPLEXITY_CREEP", F.concat(F.lit("Complexity threshold exceeded for "), "subject_id"), evidence(
        symbolId=F.col("subject_id"), metrics=readings({"cyclomatic": "cyclomatic", "lineCount": "line_count", "aiRisk": "ai_risk_score"}))))
    last = metrics.filter(since("at", as_of, "24 HOURS") & F.col("file_path").isNotNull()).groupBy("repo_id", "file_path").agg(
        F.max_by("sha", F.struct("at", "sha")).alias("sha"))
    volatile = rules.volatile_files(metrics, as_of, volatile_above).join(last, ["repo_id", "file_path"]).withColumn("at", as_of)
    return raised.unionByName(rows(volatile, "VOLATILITY_ZONE", F.concat(F.lit("High change volatility detected for "), "file_path"), evidence(
        filePath=F.col("file_path"), metrics=readings({"churn": "churn"}))))


def from_vectors(vec: DataFrame, sha: Column, as_of: Column, min_score: float = rules.DUPLICATE_SCORE, max_score: float = rules.INTENT_SCORE) -> DataFrame:
    """What near copies and strangers among a module's symbols raise."""
    placed = lambda df: df.select("*", sha.alias("sha"), as_of.alias("at"))
    near = F.array(F.struct(F.col("neighbour_id").alias("id"), F.col("score").alias("score")))
    raised = rows(placed(rules.duplicates(vec, min_score)), "SEMANTIC_DUPLICATION", F.concat(F.lit("Near-duplicate logic detected for "), "id"), evidence(
        symbolId=F.col("id"), neighbours=near))
    return raised.unionByName(rows(placed(rules.intent_drift(vec, max_score)), "INTENT_DRIFT", F.concat(F.lit("Module intent drift detected in "), "module"), evidence(
        symbolId=F.col("id"), module=F.col("module"))))


def from_violations(violations: DataFrame, sha: Column, as_of: Column) -> DataFrame:
    """What imports against the layer rule raise."""
    return rows(violations.select("*", sha.alias("sha"), as_of.alias("at")), "ARCH_VIOLATION", F.concat(F.lit("Architecture boundary violated: "), "rule"), evidence(
        filePath=F.col("source_path"), graphEdgesAdded=F.array("edge")))


def inserted(raised: DataFrame, table: DataFrame) -> DataFrame:
    """The raised alerts that enter the table: repeats suppressed, rows it holds left alone, one row a key."""
    let_through = alert_plans.deduplicated(raised)
    return insert_absent(table, let_through, KEY, ["severity", "recommendation"])


def refreshed(new: DataFrame) -> DataFrame:
    """The modules whose readings the inserted alerts make stale."""
    return ingest.modules_to_refresh(new)
