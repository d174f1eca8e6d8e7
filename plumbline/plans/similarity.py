"""Similar symbols, modules, repositories and boundaries (survey V3-V6, J3, J4, A7, M17-M20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, vectors
from ..functions.numeric import finite, fixed
from ..operators.edges import target_of
from ..operators.knn import nearest
from . import incidents as closed_incidents
from .fleet import alert_signals, latest_repo_values, since

MODULE_EXTRA, BOUNDARY_EXTRA = 8, 10
SAME_TARGET, SAME_EXTERNAL = 0.08, 0.04
REPO_VALUES = ["code_entropy_index", "pressure_index", "pressure_boundary", "pressure_coupling", "pressure_semantic", "pressure_volatility"]


def similar_symbols(vec: DataFrame, repo_id: str, symbol_id: str, k: int = 10) -> DataFrame:
    """The ``k`` nearest symbols of one repository, the symbol itself excluded (V3)."""
    ours = vec.filter(F.col("repo_id") == repo_id)
    query = ours.filter(F.col("id") == symbol_id).agg(F.any_value("vector").alias("vector")).scalar()
    others = ours.filter(F.col("id") != symbol_id)
    return nearest(others, query, "vector", k, "id")


def similar_modules(modules: DataFrame, repo_id: str, module: str, limit: int = 6) -> DataFrame:
    """Nearest modules over all repositories, same role first (V4).

    ``modules`` has repo_id, module, role, vector and the compared features.
    """
    mine = (F.col("repo_id") == repo_id) & (F.col("module") == module)
    features = F.struct(*[F.col(n) for n, _, _ in vectors.MODULE_FEATURES])
    me = modules.filter(mine).select(F.struct("role", "vector", features.alias("f")).alias("m")).scalar()
    known = modules.withColumn("_me", me)
    near = nearest(known, F.col("_me.vector"), "vector", limit + MODULE_EXTRA, "repo_id", "module").filter(~mine)
    ranked = near.withColumn("same_role", F.col("role") == F.col("_me.role"))
    drivers = vectors.feature_drivers(vectors.MODULE_FEATURES, F.col("_me.f"), features)
    return ranked.withColumn("drivers", drivers).drop("_me").orderBy(
        F.desc("same_role"), F.desc("score"), "repo_id", "module").limit(limit).withColumn("score", fixed("score", 3))


def repo_rows(repos: DataFrame, metrics: DataFrame, alerts: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """One row of signature features per repository."""
    values = latest_repo_values(metrics, REPO_VALUES)
    parts = metrics.filter((F.col("scope") == "module") & (F.col("key") == "pressure_index"))
    counted = parts.groupBy("repo_id", "subject_id").agg(F.lit(1).alias("_")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("component_count"))
    opened = incidents.filter(since("opened_at", as_of, "14 DAYS")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("incident_count"))
    signals = alert_signals(alerts, as_of)
    out = repos.select("repo_id", "name")
    for part in (values, counted, signals, opened):
        out = out.join(part, "repo_id", "left")
    counts = ["component_count", "incident_count", "week_alerts", "arch_signals", "duplication_signals", "volatility_signals"]
    rows = out.select("repo_id", "name", *[finite(c).alias(c) for c in REPO_VALUES],
                      *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    found = bands.pattern(bands.SIGNATURE_PATTERN, "pressure_index", "code_entropy_index", "week_alerts", [
        ("arch_signals", "pressure_boundary"), ("duplication_signals", "pressure_semantic"), ("volatility_signals", "pressure_volatility")])
    return rows.withColumn("pattern", found).withColumn("vector", vectors.feature_vector(vectors.REPO_FEATURES))


def similar_repos(rows: DataFrame, repo_id: str, limit: int | None = 5) -> DataFrame:
    """Nearest repositories by signature (V5); all of them if ``limit`` is None.

    A repository with a signature finds at least itself, so feature closeness
    decides only when its signature has no direction.  Both scores come from
    one pass over the other repositories.
    """
    features = vectors.REPO_FEATURES
    mine = F.col("repo_id") == repo_id
    own = F.struct(*[F.col(n).cast("double").alias(n) for n, _, _ in features])
    me = rows.filter(mine).select(F.struct("vector", own.alias("f")).alias("m")).scalar()
    out = rows.filter(~mine).withColumn("_me", me).filter(F.col("_me").isNotNull())
    out = out.withColumn("_cos", vectors.cosine("vector", "_me.vector")).withColumn(
        "feature_score", vectors.feature_score(features, F.col("_me.f"), own)).withColumn(
        "drivers", vectors.feature_drivers(features, F.col("_me.f"), own))
    directed = vectors.norm("_me.vector") > 0
    score = F.when(directed, F.col("_cos")).otherwise(F.col("feature_score"))
    out = out.withColumn("score", score).filter(F.col("score").isNotNull())
    if limit is not None:
        out = out.orderBy(F.desc("score"), "repo_id").limit(limit)
    return out.withColumn("score", fixed("score", 3)).drop("_me", "_cos")


def boundary_rows(metrics: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row of signature features per boundary.

    Violation alerts name file edges; their module edge is what boundaries
    are called by, so they are counted under that.
    """
    from ..functions.paths import module_name

    order = F.struct("at", "sha")
    rows = metrics.filter((F.col("scope") == "boundary") & (F.col("key") == "pressure_index"))
    latest = rows.groupBy("repo_id", F.col("subject_id").alias("boundary_id")).agg(F.max_by(F.struct("value", "tags"), order).alias("r"))
    tag = lambda k: F.col("r.tags")[k]
    named = latest.select(
        "repo_id", "boundary_id", F.coalesce(tag("sourceModule"), F.split("boundary_id", "->")[0]).alias("source_module"),
        F.coalesce(tag("targetModule"), target_of("boundary_id")).alias("target_module"), finite("r.value").alias("pressure_index"),
        finite(tag("edgeAdded").try_cast("double")).alias("edge_added"), finite(tag("externalTarget").try_cast("double")).alias("external_target"))
    modules = metrics.filter((F.col("scope") == "module") & F.col("key").isin("pressure_index", "code_entropy_index"))
    at_key = lambda k: F.max_by("value", F.when(F.col("key") == k, order))
    health = modules.groupBy("repo_id", F.col("subject_id").alias("source_module")).agg(
        at_key("pressure_index").alias("source_pressure_index"), at_key("code_entropy_index").alias("source_entropy_index"))
    edge = alerts.filter((F.col("type") == "ARCH_VIOLATION") & since("at", as_of, "7 DAYS")).select(
        "repo_id", F.explode("evidence.graphEdgesAdded").alias("e"))
    side = lambda i: module_name(F.trim(F.split("e", "->")[i]))
    broken = edge.groupBy("repo_id", F.concat(side(0), F.lit("->"), side(1)).alias("boundary_id")).agg(F.count(F.lit(1)).alias("arch_violation_count"))
    out = named.join(health, ["repo_id", "source_module"], "left").join(broken, ["repo_id", "boundary_id"], "left")
    return out.fillna(0, ["source_pressure_index", "source_entropy_index", "arch_violation_count"]).withColumn(
        "vector", vectors.feature_vector(vectors.BOUNDARY_FEATURES))


def similar_boundaries(rows: DataFrame, repo_id: str, boundary_id: str | None = None, limit: int = 5) -> DataFrame:
    """Nearest boundaries with a bonus for the same target or kind (V6).

    Without a boundary the one under most pressure is taken.
    """
    ours = rows.filter(F.col("repo_id") == repo_id)
    if boundary_id is None:
        current = ours.orderBy(F.desc("pressure_index"), "boundary_id").limit(1)
    else:
        current = ours.filter(F.col("boundary_id") == boundary_id)
    own = F.struct(*[F.col(n).cast("double").alias(n) for n, _, _ in vectors.BOUNDARY_FEATURES])
    me = current.select(F.struct("boundary_id", "target_module", "external_target", "vector", own.alias("f")).alias("m")).scalar()
    near = nearest(rows.withColumn("_me", me), F.col("_me.vector"), "vector", limit + BOUNDARY_EXTRA, "repo_id", "boundary_id")
    other = near.filter(~((F.col("repo_id") == repo_id) & (F.col("boundary_id") == F.col("_me.boundary_id"))))
    kept = other.orderBy(F.desc("score"), "repo_id", "boundary_id").limit(limit)
    bonus = F.when(F.col("target_module") == F.col("_me.target_module"), SAME_TARGET).otherwise(0.0) + F.when(
        F.col("external_target") == F.col("_me.external_target"), SAME_EXTERNAL).otherwise(0.0)
    return kept.withColumn("drivers", vectors.feature_drivers(vectors.BOUNDARY_FEATURES, F.col("_me.f"), own)).withColumn(
        "score", fixed(F.col("score") + bonus, 3)).drop("_me").orderBy(F.desc("score"), "repo_id", "boundary_id")


def hit_fixes(hits: DataFrame, subject: str, refactors: DataFrame, scope: str, n: int = 3) -> DataFrame:
    """The best ``n`` fixes of every hit (V4-V6); hits without a fix give no row.

    ``hits`` has repo_id and the column named ``subject``.  Suggestions are cut
    down to the subjects of the hits before they are ranked.
    """
    subjects = hits.select("repo_id", F.col(subject).alias("subject_id"))
    return closed_incidents.ranked_fixes(refactors, scope, n, subjects)


def hit_outcomes(hits: DataFrame, subject: str, incidents: DataFrame, refactors: DataFrame, scope: str, n: int = 3) -> DataFrame:
    """The last ``n`` closed incidents of every hit, each with the fix that goes with it.

    A boundary shows the incidents of its source module.
    """
    subjects = hits.select("repo_id", F.col(subject).alias("subject_id"))
    outcomes = closed_incidents.recent_outcomes(incidents, scope, n, subjects)
    return closed_incidents.outcomes_with_fixes(outcomes, hit_fixes(hits, subject, refactors, scope, n))
