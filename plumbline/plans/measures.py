"""Symbol, module, repository and boundary readings (survey M1-M16, M29, M30, A2-A5, A19, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scores, text
from ..functions.numeric import clamp01, finite, fixed, fixed_text
from ..operators.edges import target_of
from ..operators.latest import latest_per_key
from .fleet import count_where, since

MODULE = ["repo_id", "module"]
SYMBOL_KEYS = ["cyclomatic", "nesting_depth", "line_count", "ai_risk_score", "dummy_data",
               "hardcoded_secrets", "over_abstracted_name", "todo_markers"]


def read_symbols(symbols: DataFrame) -> DataFrame:
    """Per symbol: complexity, size, smells and risk from its text."""
    smell = text.smells("body", "name")
    out = symbols.withColumn("cyclomatic", text.cyclomatic("body")).withColumn("nesting_depth", text.nesting("body")).withColumn(
        "line_count", text.line_count("body")).withColumn("_s", smell)
    parts = {"cyclomatic": "cyclomatic", "nesting": "nesting_depth", **{
        k: F.col("_s")[k] for k in ("dummy_data", "hardcoded_secrets", "over_abstracted_name", "todo_markers")}}
    return out.select(*symbols.columns, "cyclomatic", "nesting_depth", "line_count", "_s.*",
                      scores.ai_risk(parts).alias("ai_risk_score"))


def symbol_metrics(symbols: DataFrame) -> DataFrame:
    """Eight metric rows per symbol in long form, from one pass over the text."""
    read = read_symbols(symbols)
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in SYMBOL_KEYS])
    return read.select("repo_id", F.col("commit_sha").alias("sha"), "at", F.lit("symbol").alias("scope"),
                       F.col("symbol_id").alias("subject_id"), "module", "file_path", "provenance", F.inline(each))


def symbol_state(metrics: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Latest value of every symbol reading (A5)."""
    rows = metrics.filter(F.col("scope") == "symbol")
    if as_of is not None:
        rows = rows.filter(F.col("at") <= as_of)
    return latest_per_key(rows, ["repo_id", "subject_id", "key"], ["at", "sha"],
                          ["value", "module", "file_path", "provenance", "at"])


def _summary(state: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, complexity moments and AI share of the latest symbol readings.

    Rolled up by symbol, file and then group, so distinct symbols and files
    are plain counts and every step aggregates before its shuffle.
    """
    cyc = F.when(F.col("key") == "cyclomatic", F.col("value"))
    risk = F.when(F.col("key") == "ai_risk_score", F.col("value"))
    ai = F.when(F.col("key") == "ai_risk_score", text.is_ai_provenance("provenance").cast("double"))
    of = lambda k: F.when(F.col("key") == k, F.col("value"))
    per_symbol = state.groupBy("repo_id", "module", "file_path", "subject_id").agg(
        F.max(cyc).alias("cyc"), F.max(risk).alias("risk"), F.max(ai).alias("ai"),
        F.max(of("nesting_depth")).alias("nest"), F.max(of("line_count")).alias("lines"))
    sums = [
        F.count_if(F.col("subject_id") != "").alias("symbols"),
        F.count("cyc").alias("n_cyc"), F.sum("cyc").alias("s_cyc"), F.sum(F.col("cyc") * F.col("cyc")).alias("q_cyc"),
        F.max("cyc").alias("x_cyc"), F.count("risk").alias("n_risk"), F.sum("risk").alias("s_risk"), F.sum("ai").alias("s_ai"),
        F.count("nest").alias("n_nest"), F.sum("nest").alias("s_nest"), F.max("lines").alias("x_lines"),
    ]
    per_file = per_symbol.groupBy(*dict.fromkeys([*keys, "repo_id", "module", "file_path"])).agg(*sums)
    total = lambda c: F.sum(c).alias(c)
    g = per_file.groupBy(*keys).agg(
        F.count("file_path").alias("file_count"), total("symbols"), total("n_cyc"), total("s_cyc"), total("q_cyc"),
        F.max("x_cyc").alias("x_cyc"), total("n_risk"), total("s_risk"), total("s_ai"), total("n_nest"), total("s_nest"),
        F.max("x_lines").alias("x_lines"))
    mean = F.coalesce(F.try_divide(F.col("s_cyc"), F.col("n_cyc")), F.lit(0.0))
    square = F.coalesce(F.try_divide(F.col("q_cyc"), F.col("n_cyc")), F.lit(0.0))
    part = lambda s, n: F.coalesce(F.try_divide(F.col(s), F.col(n)), F.lit(0.0))
    return g.select(
        *keys, F.col("symbols").alias("symbol_count"), "file_count", mean.alias("avg_cyclomatic"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev_cyclomatic"),
        finite("x_cyc").alias("max_cyclomatic"), part("s_risk", "n_risk").alias("avg_ai_risk"),
        clamp01(part("s_ai", "n_risk")).alias("ai_edit_ratio"), part("s_nest", "n_nest").alias("avg_nesting"),
        finite("x_lines").alias("max_lines"))


def _churn(metrics: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    recent = metrics.filter((F.col("scope") == "symbol") & since("at", as_of, "24 HOURS"))
    return recent.groupBy(*keys, "sha").agg(F.lit(1).alias("_")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("churn_24h"))


def alert_modules(alerts: DataFrame) -> DataFrame:
    """Each alert once per module it counts for.

    An alert counts for its named module, for the module its path or symbol
    lies in under ``src/``, and for ``root`` when it has a path or symbol at
    all.  At most four rows per alert, instead of an OR join to the modules.
    """
    ev = F.col("evidence")

    def under_src(c):
        part = F.regexp_extract(c, "^src/([^/]+)/", 1)
        return F.when(part != "", part)

    root = F.when(ev["filePath"].isNotNull() | ev["symbolId"].isNotNull() | (ev["module"] == "root"), F.lit("root"))
    owners = F.array_distinct(F.filter(
        F.array(ev["module"], under_src(ev["filePath"]), under_src(ev["symbolId"]), root), lambda m: m.isNotNull()))
    return alerts.select("repo_id", "at", "type", F.explode(owners).alias("module"))


def _alert_counts(alerts: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    recent = alerts.filter(since("at", as_of, "24 HOURS"))
    kinds = {"duplication_alerts": "SEMANTIC_DUPLICATION", "arch_violations": "ARCH_VIOLATION",
             "arch_drift_alerts": "ARCH_EMBED_DRIFT", "arch_pressure_alerts": "ARCH_PRESSURE",
             "volatility_alerts": "VOLATILITY_ZONE"}
    return recent.groupBy(*keys).agg(*[count_where(F.col("type") == t).alias(n) for n, t in kinds.items()])


ALERT_COUNTS = ["duplication_alerts", "arch_violations", "arch_drift_alerts", "arch_pressure_alerts", "volatility_alerts"]


def _inputs(metrics, alerts, keys, as_of, state) -> DataFrame:
    out = _summary(state, keys).join(_churn(metrics, keys, as_of), keys, "left").join(
        _alert_counts(alerts, keys, as_of), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    counts = ["churn_24h", *ALERT_COUNTS]
    return out.select(*[c for c in out.columns if c not in counts], *[zero(c) for c in counts])


def module_inputs(metrics: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Everything the module formulas need, one row per module."""
    return _inputs(metrics, alert_modules(alerts), MODULE, as_of, symbol_state(metrics))


def repo_inputs(metrics: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """The same per repository, with the number of distinct boundaries."""
    whole = _inputs(metrics, alerts, ["repo_id"], as_of, symbol_state(metrics))
    rows = metrics.filter((F.col("scope") == "boundary") & (F.col("key") == "pressure_index"))
    edges = rows.groupBy("repo_id", "subject_id").agg(F.lit(1).alias("_")).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("boundary_count"))
    return whole.join(edges, "repo_id", "left").withColumn("boundary_count", F.coalesce("boundary_count", F.lit(0)))


def module_entropy(inputs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Five entropies and the index per module (M1-M6)."""
    rows = inputs.join(dependencies, MODULE, "left").withColumn(
        "dependency_count", F.coalesce("dependency_count", F.lit(0))).withColumn(
        "external_count", F.coalesce("external_count", F.lit(0))).withColumn(
        "dependency", F.coalesce("dependency_entropy", F.lit(0.0))).drop("dependency_entropy")
    external = F.col("external_count") / F.greatest(F.col("dependency_count"), F.lit(1))
    rows = (
        rows.withColumn("duplication", scores.duplication_entropy("duplication_alerts", "symbol_count"))
        .withColumn("complexity", scores.complexity_entropy("avg_cyclomatic", "stddev_cyclomatic", "max_cyclomatic"))
        .withColumn("change", scores.change_entropy("churn_24h", "file_count", "ai_edit_ratio", "volatility_alerts"))
        .withColumn("architecture", scores.architecture_entropy(external, "arch_violations", "dependency_count", "arch_drift_alerts"))
    )
    return rows.withColumn("entropy_index", scores.entropy_index({k: k for k in scores.ENTROPY_WEIGHTS}))


def repo_rollup(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Repository means of the latest module values, with the module count."""
    rows = metrics.filter((F.col("scope") == "module") & F.col("key").isin(keys))
    latest = latest_per_key(rows, ["repo_id", "subject_id", "key"], ["at", "sha"], ["value"])
    wide = latest.groupBy("repo_id", "subject_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    return wide.groupBy("repo_id").agg(
        *[F.coalesce(F.avg(k), F.lit(0.0)).alias(k) for k in keys], F.count(F.lit(1)).alias("module_count"))


def previous_state(metrics: DataFrame, before: Column) -> DataFrame:
    """Last module readings strictly before a time."""
    rows = metrics.filter((F.col("scope") == "module") & (F.col("at") < before) & F.col("key").isin(
        "dependency_entropy", "code_entropy_index", "pressure_index"))
    order = F.struct("at", "sha")
    at_key = lambda k, v: F.max_by(v, F.when(F.col("key") == k, order))
    return rows.groupBy("repo_id", F.col("subject_id").alias("module")).agg(
        F.coalesce(at_key("dependency_entropy", F.col("tags")["moduleDependencyCount"]).try_cast("bigint"), F.lit(0))
        .alias("previous_dependencies"),
        F.coalesce(at_key("code_entropy_index", F.col("value")), F.lit(0.0)).alias("previous_entropy"),
        F.coalesce(at_key("pressure_index", F.col("value")), F.lit(0.0)).alias("previous_pressure"))


def module_pressure(entropy: DataFrame, added: DataFrame, previous: DataFrame) -> DataFrame:
    """Six pressure components and the index per module.

    ``entropy`` is the output of ``module_entropy``; the repository index is
    the mean over its modules.
    """
    repo = entropy.groupBy("repo_id").agg(F.avg("entropy_index").alias("repo_entropy"))
    gained = added.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("added_edges"))
    rows = entropy.join(repo, "repo_id").join(gained, MODULE, "left").join(previous, MODULE, "left")
    rows = rows.fillna(0, ["added_edges", "previous_dependencies", "previous_entropy", "previous_pressure"])
    parts = {
        "change": scores.pressure_change("churn_24h", "file_count", "ai_edit_ratio"),
        "coupling": scores.pressure_coupling("dependency_count", "previous_dependencies", "external_count"),
        "semantic": scores.pressure_semantic("duplication_alerts", "symbol_count", "ai_edit_ratio"),
        "boundary": scores.pressure_boundary("added_edges", "dependency_count", "arch_violations"),
        "entropy": scores.pressure_entropy("entropy_index", "repo_entropy", "previous_entropy"),
        "volatility": scores.pressure_volatility("volatility_alerts", "churn_24h", "file_count"),
    }
    out = rows.select("*", *[c.alias(f"pressure_{k}") for k, c in parts.items()])
    return out.withColumn("pressure_index", scores.pressure_index({k: f"pressure_{k}" for k in parts}))


def boundary_pressure(pressure: DataFrame, edges: DataFrame, added: DataFrame) -> DataFrame:
    """One row per current module edge with its pressure."""
    new = added.select("repo_id", "module", "edge").distinct().withColumn("_new", F.lit(True))
    rows = edges.select("repo_id", "module", "edge").distinct().join(new, ["repo_id", "module", "edge"], "left").join(
        pressure.select(*MODULE, "pressure_index", "dependency_count", "arch_violations", "repo_entropy"), MODULE)
    target = target_of("edge")
    fresh, external = F.coalesce("_new", F.lit(False)), target.startswith("pkg:")
    value = scores.boundary_index(fresh, external, "arch_violations", "dependency_count", "pressure_index", "repo_entropy")
    return rows.select("repo_id", "module", F.col("edge").alias("subject_id"), target.alias("target_module"),
                       fresh.cast("int").alias("edge_added"), external.cast("int").alias("external_target"),
                       value.alias("value"))


def module_metric_rows(pressure: DataFrame, sha: Column, at: Column) -> DataFrame:
    """Module readings in long form with their tags (section 1.5)."""
    hundred = lambda c: F.col(c) * 100
    values = {
        **{f"{k}_entropy": hundred(k) for k in scores.ENTROPY_WEIGHTS}, "code_entropy_index": F.col("entropy_index"),
        **{f"pressure_{k}": hundred(f"pressure_{k}") for k in scores.PRESSURE_WEIGHTS}, "pressure_index": F.col("pressure_index"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("double").alias("value")) for k, c in values.items()])
    tags = F.create_map(
        F.lit("moduleDependencyCount"), F.col("dependency_count").cast("string"),
        F.lit("externalDependencyCount"), F.col("external_count").cast("string"),
        F.lit("symbolCount"), F.col("symbol_count").cast("string"), F.lit("fileCount"), F.col("file_count").cast("string"),
        F.lit("churn24h"), F.col("churn_24h").cast("string"), F.lit("aiEditRatio"), fixed_text("ai_edit_ratio", 4),
        F.lit("addedEdgeCount"), F.col("added_edges").cast("string"),
        F.lit("previousPressureIndex"), fixed_text("previous_pressure", 2),
        F.lit("repoEntropyIndex"), fixed_text("repo_entropy", 2))
    none = F.lit(None).cast("string")
    return pressure.select("repo_id", sha.alias("sha"), at.alias("at"), F.lit("module").alias("scope"),
                           F.col("module").alias("subject_id"), "module", none.alias("file_path"),
                           none.alias("provenance"), tags.alias("tags"), F.inline(each))


def force_module_snapshot(entropy, pressure, violations, drift, added, removed) -> Column:
    c = F.col
    return (c(entropy) >= 70) | (c(pressure) >= 60) | (c(violations) > 0) | (c(drift) > 0) | (c(added) > 0) | (c(removed) > 0)


def force_repo_snapshot(entropy, pressure, violations, pressure_alerts) -> Column:
    c = F.col
    return (c(entropy) >= 65) | (c(pressure) >= 55) | (c(violations) > 0) | (c(pressure_alerts) > 0)


def _listed(changes: DataFrame, kind: str, name: str, keep: int = 8) -> DataFrame:
    """Count and the first few edges by name; ranked before they are gathered."""
    from ..operators.latest import top_per_key

    rows = changes.filter(F.col("change") == kind).select(*MODULE, "edge").distinct()
    few = top_per_key(rows, MODULE, [F.col("edge")], keep).groupBy(*MODULE).agg(
        F.array_sort(F.collect_list("edge")).alias(f"edges_{name}"))
    return rows.groupBy(*MODULE).agg(F.count(F.lit(1)).alias(f"{name}_count")).join(few, MODULE)


def module_snapshots(pressure: DataFrame, changes: DataFrame, sha: Column, at: Column) -> DataFrame:
    """Nested snapshot signature per module with its force flag."""
    rows = pressure.join(_listed(changes, "added", "added"), MODULE, "left").join(
        _listed(changes, "removed", "removed"), MODULE, "left").fillna(0, ["added_count", "removed_count"])
    none = F.array().cast("array<string>")
    two = lambda c: fixed(F.col(c) * 100, 2)
    signature = F.struct(
        F.struct(F.col("dependency_count").alias("moduleDependencyCount"), F.col("external_count").alias("externalDependencyCount"),
                 F.col("dependency_count").alias("currentEdgeCount"), F.col("added_count").alias("addedEdgeCount"),
                 F.col("removed_count").alias("removedEdgeCount"), F.col("arch_violations").alias("archViolations"),
                 F.col("arch_drift_alerts").alias("archDriftAlerts"), F.coalesce("edges_added", none).alias("edgesAdded"),
                 F.coalesce("edges_removed", none).alias("edgesRemoved")).alias("graph"),
        F.struct(F.col("symbol_count").alias("symbolCount"), F.col("file_count").alias("fileCount"),
                 fixed("ai_edit_ratio", 4).alias("aiEditRatio"), F.col("duplication_alerts").alias("duplicationAlerts")).alias("semantic"),
        F.struct(F.col("entropy_index").alias("entropyIndex"), F.col("pressure_index").alias("pressureIndex"),
                 *[two(k).alias(f"{k}Entropy") for k in scores.ENTROPY_WEIGHTS],
                 *[two(f"pressure_{k}").alias(f"pressure{k.capitalize()}") for k in scores.PRESSURE_WEIGHTS]).alias("health"),
        F.struct(fixed("avg_cyclomatic", 2).alias("avgCyclomatic"), fixed("stddev_cyclomatic", 2).alias("stddevCyclomatic"),
                 fixed("max_cyclomatic", 2).alias("maxCyclomatic")).alias("complexity"),
        F.struct(F.col("churn_24h").alias("churn24h"), F.col("volatility_alerts").alias("volatilityAlerts")).alias("volatility"),
    )
    force = force_module_snapshot("entropy_index", "pressure_index", "arch_violations", "arch_drift_alerts", "added_count", "removed_count")
    return rows.select("repo_id", sha.alias("sha"), at.alias("at"), F.lit("module").alias("scope"),
                       F.col("module").alias("subject_id"), force.alias("force"), signature.alias("signature"))


def repo_snapshots(entropy: DataFrame, pressure: DataFrame, inputs: DataFrame, sha: Column, at: Column) -> DataFrame:
    """Nested snapshot signature per repository: ``entropy`` and ``pressure`` are
    repository rollups, ``inputs`` comes from ``repo_inputs``."""
    rows = inputs.join(entropy, "repo_id", "left").join(pressure.drop("module_count"), "repo_id", "left")
    two = lambda c: fixed(finite(c), 2)
    signature = F.struct(
        F.struct(F.coalesce("module_count", F.lit(0)).alias("moduleCount"), F.col("boundary_count").alias("boundaryCount"),
                 F.col("arch_violations").alias("archViolations")).alias("graph"),
        F.struct(F.col("symbol_count").alias("symbolCount"), F.col("file_count").alias("fileCount"),
                 fixed("avg_ai_risk", 2).alias("avgAiRisk"), fixed("ai_edit_ratio", 4).alias("aiEditRatio"),
                 F.col("duplication_alerts").alias("duplicationAlerts")).alias("semantic"),
        F.struct(two("code_entropy_index").alias("entropyIndex"), two("pressure_index").alias("pressureIndex"),
                 *[two(k).alias(k.replace("_entropy", "Entropy")) for k in S.ENTROPY_KEYS[:5]],
                 *[two(k).alias("pressure" + k.split("_")[1].capitalize()) for k in S.PRESSURE_KEYS[:6]]).alias("health"),
        F.struct(fixed("avg_cyclomatic", 2).alias("avgCyclomatic"), fixed("max_cyclomatic", 2).alias("maxCyclomatic")).alias("complexity"),
        F.struct(F.col("churn_24h").alias("churn24h"), F.col("volatility_alerts").alias("volatilityAlerts"),
                 F.col("arch_pressure_alerts").alias("archPressureAlerts")).alias("volatility"),
    )
    rows = rows.withColumn("_e", finite("code_entropy_index")).withColumn("_p", finite("pressure_index"))
    force = force_repo_snapshot("_e", "_p", "arch_violations", "arch_pressure_alerts")
    return rows.select("repo_id", sha.alias("sha"), at.alias("at"), F.lit("repo").alias("scope"),
                       F.col("repo_id").alias("subject_id"), force.alias("force"), signature.alias("signature"))
