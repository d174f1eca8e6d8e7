"""Alert rules (survey R1-R8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import vectors
from ..functions.numeric import fixed
from ..operators.knn import knn_join
from ..operators.running import DAY, asof_join, open_intervals
from .fleet import since

# --- fixed values: thresholds ----------------------------------------------
DUPLICATE_SCORE, DUPLICATE_NEIGHBOURS = 0.92, 4
INTENT_NEIGHBOURS, INTENT_MINIMUM, INTENT_SCORE = 6, 3, 0.55
COMPLEX = {"cyclomatic": (15, 25), "ai_risk_score": (50, 75), "line_count": (120, None)}
VOLATILE_COMMITS = 8
DRIFT_WARN, DRIFT_ERROR, DRIFT_ERROR_AI = 0.18, 0.28, 0.22
COMPOSITE_WARN, COMPOSITE_ERROR, COMPOSITE_ERROR_AI = 0.55, 0.95, 0.75
AI_HEAVY = 0.6
# ---------------------------------------------------------------------------


def duplicates(vec: DataFrame, min_score: float = DUPLICATE_SCORE) -> DataFrame:
    """Near-duplicate logic inside a repository.

    Of the four nearest symbols above the threshold, the first whose
    normalised text differs; exact clones use up places but raise nothing.
    """
    near = knn_join(vec, vec, DUPLICATE_NEIGHBOURS, id="id", vec="vector", group=["repo_id"], min_score=min_score, mark="norm_hash")
    other = near.filter(~F.col("query_mark").eqNullSafe(F.col("neighbour_mark")))
    first = other.groupBy("repo_id", "query_id").agg(F.min_by(F.struct("neighbour_id", "score"), "rank").alias("n"))
    named = first.join(vec.select(F.col("id").cast("string").alias("query_id"), "provenance"), "query_id")
    score = F.col("n.score")
    ai = ~F.coalesce("provenance", F.lit("unknown")).isin("human", "unknown")
    severity = F.when((score > 0.98) & ai, "error").when(score > 0.95, "warn").otherwise("info")
    return named.select("repo_id", F.col("query_id").alias("id"), F.col("n.neighbour_id").alias("neighbour_id"),
                        score.alias("score"), severity.alias("severity"), F.lit("SEMANTIC_DUPLICATION").alias("type"))


def module_affinity(vec: DataFrame) -> DataFrame:
    """Mean score and count of each symbol's six nearest in its own module (V2)."""
    near = knn_join(vec, vec, INTENT_NEIGHBOURS, id="id", vec="vector", group=["repo_id", "module"])
    return near.groupBy("repo_id", "module", F.col("query_id").alias("id")).agg(
        F.count(F.lit(1)).alias("neighbours"), F.avg("score").alias("mean_score"))


def intent_drift(vec: DataFrame, max_score: float = INTENT_SCORE) -> DataFrame:
    """Symbols that no longer resemble their module (R2)."""
    odd = (F.col("neighbours") >= INTENT_MINIMUM) & (F.col("mean_score") < max_score)
    return module_affinity(vec).filter(odd).select("*", F.lit("warn").alias("severity"), F.lit("INTENT_DRIFT").alias("type"))


def complexity_creep(metrics: DataFrame) -> DataFrame:
    """Symbols over a complexity, risk or size limit in one commit."""
    rows = metrics.filter((F.col("scope") == "symbol") & F.col("key").isin(list(COMPLEX)))
    wide = rows.groupBy("repo_id", "sha", "subject_id").agg(
        F.max("at").alias("at"),
        *[F.coalesce(F.max_by("value", F.when(F.col("key") == k, F.col("at"))), F.lit(0.0)).alias(k) for k in COMPLEX])
    over = error = F.lit(False)
    for key, (warn_at, error_at) in COMPLEX.items():
        over = over | (F.col(key) >= warn_at)
        if error_at:
            error = error | (F.col(key) >= error_at)
    return wide.filter(over).withColumn("severity", F.when(error, "error").otherwise("warn"))


COMMIT = ["repo_id", "scope", "subject_id", "sha"]


def _parts(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The latest values of the keys in each commit and subject, a column a key."""
    return metrics.filter(F.col("key").isin(keys)).groupBy(*COMMIT).agg(
        *[fixed(F.max_by("value", F.when(F.col("key") == k, F.col("at"))), 2).alias(k) for k in keys])


def with_parts(found: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The readings, which are read twice, with the latest values of the keys in the same commit and subject.

    What belongs to none of them leaves before the columns are made.
    """
    theirs = metrics.filter(F.col("key").isin(keys)).select(*COMMIT, "key", "at", "value").join(found.select(*COMMIT), COMMIT, "left_semi")
    return found.join(_parts(theirs, keys), COMMIT, "left")


def anomaly_alerts(assessed: DataFrame, metrics: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Alerts for anomalous index readings with the contributing readings of the
    same commit and subject (R4, R5)."""
    raised = assessed.filter(F.col("anomaly").isNotNull())
    return raised.drop("key").join(_parts(metrics, keys), COMMIT, "left").withColumn("severity", F.col("anomaly")).withColumn("type", F.lit(kind))


def pressure_alerts(assessed: DataFrame, metrics: DataFrame) -> DataFrame:
    return anomaly_alerts(assessed, metrics, S.PRESSURE_KEYS, "ARCH_PRESSURE")


def entropy_alerts(assessed: DataFrame, metrics: DataFrame) -> DataFrame:
    return anomaly_alerts(assessed, metrics, S.ENTROPY_KEYS, "ENTROPY_DRIFT")


def volatile_files(metrics: DataFrame, as_of: Column, more_than: int = VOLATILE_COMMITS) -> DataFrame:
    """Files changed by more than eight commits in the last day."""
    recent = metrics.filter(since("at", as_of, "24 HOURS") & F.col("file_path").isNotNull())
    commits = recent.groupBy("repo_id", "file_path", "sha").agg(F.lit(1).alias("_")).groupBy("repo_id", "file_path").agg(
        F.count(F.lit(1)).alias("churn"))
    return commits.filter(F.col("churn") > more_than).withColumn("severity", F.lit("warn"))


def file_churn_over_time(metrics: DataFrame, file: Column | None = None) -> DataFrame:
    """Distinct commits of the last day at every reading of a file (A6, sliding R6).

    A commit counts from each of its readings until a day later; overlapping
    spans of one commit merge first, so open spans are distinct commits.
    """
    name = F.col("file_path") if file is None else file
    rows = metrics.filter(F.col("file_path").isNotNull()).select("repo_id", name.alias("file_path"), "sha", "at").distinct()
    one = ["repo_id", "file_path", "sha"]
    w = Window.partitionBy(*one).orderBy("at")
    t = F.unix_micros("at")
    fresh = F.when(F.lag(t).over(w).isNull() | (t - F.lag(t).over(w) > DAY), 1).otherwise(0)
    spans = rows.withColumn("_new", fresh).withColumn("_span", F.sum("_new").over(w)).groupBy(*one, "_span").agg(
        F.min("at").alias("opens"), (F.max("at") + F.expr("INTERVAL 24 HOURS")).alias("closes"))
    return open_intervals(rows, spans, ["repo_id", "file_path"], "at", "opens", "closes", "churn")


def embedding_drift(snapshots: DataFrame) -> DataFrame:
    """Drift of a module's feature vector against its previous snapshot.

    ``snapshots`` has repo_id, module, at and the seventeen readings in a
    ``features`` struct.  A module's first snapshot raises nothing.
    """
    rows = snapshots.withColumn("vector", vectors.drift_vector("features"))
    looked = asof_join(rows, rows.select("repo_id", "module", "at", "features", "vector"), ["repo_id", "module"],
                       "at", "at", ["features", "vector"], name="_prev", strict=True)
    known = looked.filter(F.col("_prev").isNotNull()).withColumn(
        "distance", vectors.cosine_distance("_prev.vector", "vector")).withColumn(
        "composite", vectors.drift_score("features", "_prev.features", "distance"))
    ai, d, c = F.col("features.ai_edit_ratio") >= AI_HEAVY, F.col("distance"), F.col("composite")
    severity = (
        F.when((d >= DRIFT_ERROR) | ((d >= DRIFT_ERROR_AI) & ai), "error").when(d >= DRIFT_WARN, "warn")
        .when((c >= COMPOSITE_ERROR) | ((c >= COMPOSITE_ERROR_AI) & ai), "error").when(c >= COMPOSITE_WARN, "warn"))
    return known.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select(
        "repo_id", "module", "at", fixed("distance", 4).alias("distance"), fixed("composite", 4).alias("composite"),
        "severity", vectors.top_deltas("features", "_prev.features").alias("deltas"))


def module_features(inputs: DataFrame, dependencies: DataFrame, changes: DataFrame, indexes: DataFrame) -> DataFrame:
    """The seventeen readings of ``embedding_drift`` from module inputs, edge
    counts, edge changes and latest indexes."""
    key = ["repo_id", "module"]
    moved = changes.groupBy(*key).agg(F.count_if(F.col("change") == "added").alias("edge_additions"),
                                      F.count_if(F.col("change") == "removed").alias("edge_removals"))
    rows = inputs.join(dependencies, key, "left").join(moved, key, "left").join(indexes, key, "left").fillna(0)
    deps, files = F.greatest("dependency_count", F.lit(1)), F.greatest("file_count", F.lit(1))
    own = ["file_count", "symbol_count", "avg_cyclomatic", "max_cyclomatic", "avg_nesting", "max_lines", "avg_ai_risk",
           "ai_edit_ratio", "edge_additions", "edge_removals", "code_entropy_index", "pressure_index"]
    return rows.select(*key, F.struct(
        *own, F.col("dependency_count").alias("module_dependency_count"), F.col("external_count").alias("external_dependency_count"),
        ((F.col("edge_additions") + F.col("edge_removals")) / deps).alias("edge_churn_ratio"),
        (F.col("dependency_count") / files).alias("dependency_per_file"),
        (F.col("external_count") / deps).alias("external_dependency_ratio")).alias("features"))
