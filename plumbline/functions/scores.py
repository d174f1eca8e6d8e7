"""Scoring formulas as column expressions (survey M1-M14, F16, R11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp01, col, fixed, over_baseline

# --- fixed values: weights --------------------------------------------------
RISK_WEIGHTS = {
    "cyclomatic": 2, "nesting": 4, "dummy_data": 20, "hardcoded_secrets": 25,
    "over_abstracted_name": 10, "todo_markers": 8,
}
ENTROPY_WEIGHTS = {
    "dependency": 0.25, "duplication": 0.2, "complexity": 0.2, "change": 0.2, "architecture": 0.15,
}
PRESSURE_WEIGHTS = {
    "change": 0.25, "coupling": 0.2, "semantic": 0.15, "boundary": 0.15, "entropy": 0.15, "volatility": 0.1,
}
BOUNDARY_WEIGHTS = {"added": 0.35, "external": 0.2, "violation": 0.25, "module": 0.15, "entropy": 0.05}
# ---------------------------------------------------------------------------


def at_least(x, low) -> Column:
    return F.greatest(col(x).cast("double"), F.lit(float(low)))


def weighted(parts: dict, weights: dict) -> Column:
    total = None
    for name, weight in weights.items():
        term = col(parts[name]) * weight
        total = term if total is None else total + term
    return total


def ai_risk(parts: dict) -> Column:
    return F.least(F.lit(100), weighted(parts, RISK_WEIGHTS)).cast("bigint")


def duplication_entropy(duplicates, symbols) -> Column:
    return clamp01(col(duplicates) * 2 / at_least(symbols, 1))


def complexity_entropy(mean, stddev, top) -> Column:
    spread = col(stddev) / at_least(mean, 4)
    spikes = col(top) / at_least(col(mean) * 3, 1)
    return clamp01(spread * 0.7 + F.least(spikes, F.lit(3.0)) / 3 * 0.3)


def change_entropy(churn, files, ai_ratio, volatility) -> Column:
    churned = col(churn) / at_least(col(files) * 4, 1)
    volatile = F.least(col(volatility) / 4, F.lit(1.0))
    return clamp01(churned * 0.55 + col(ai_ratio) * 0.3 + volatile * 0.15)


def architecture_entropy(external_ratio, violations, dependencies, drift) -> Column:
    rules = F.least((col(violations) + col(drift)) / at_least(dependencies, 1), F.lit(1.0))
    return clamp01(col(external_ratio) * 0.35 + rules * 0.65)


def entropy_index(parts: dict) -> Column:
    return fixed(weighted(parts, ENTROPY_WEIGHTS) * 100, 2)


def pressure_change(churn, files, ai_ratio) -> Column:
    return clamp01(over_baseline(churn, at_least(col(files) * 4, 1)) * (col(ai_ratio) * 0.65 + 1))


def pressure_coupling(dependencies, previous, external) -> Column:
    grown = F.greatest(col(dependencies) - col(previous), F.lit(0))
    base = F.when(col(previous) == 0, F.lit(2)).otherwise(col(previous))
    return clamp01(
        over_baseline(grown, at_least(base, 1))
        + over_baseline(external, at_least(col(dependencies) * 0.75, 1)) * 0.35
    )


def pressure_semantic(duplicates, symbols, ai_ratio) -> Column:
    return clamp01(over_baseline(duplicates, at_least(col(symbols) * 0.45, 1)) + col(ai_ratio) * 0.2)


def pressure_boundary(added, dependencies, violations) -> Column:
    return clamp01(
        over_baseline(added, at_least(col(dependencies) * 0.35, 1))
        + over_baseline(violations, at_least(col(dependencies) * 0.4, 1)) * 0.75
    )


def pressure_entropy(module_index, repo_index, previous_index) -> Column:
    gap = F.greatest(col(module_index) - col(repo_index), F.lit(0.0))
    rise = F.greatest(col(module_index) - col(previous_index), F.lit(0.0))
    return clamp01(over_baseline(gap, F.lit(20.0)) + over_baseline(rise, F.lit(15.0)) * 0.8)


def pressure_volatility(volatility, churn, files) -> Column:
    return clamp01(over_baseline(volatility, F.lit(2.0)) + over_baseline(churn, at_least(col(files) * 7, 1)) * 0.5)


def pressure_index(parts: dict) -> Column:
    return fixed(weighted(parts, PRESSURE_WEIGHTS) * 100, 2)


def boundary_index(added, external, violations, dependencies, module_index, repo_index) -> Column:
    """Pressure of one module edge; ``added`` and ``external`` are booleans."""
    parts = {
        "added": F.when(col(added), 1.0).otherwise(0.2),
        "external": F.when(col(external), 1.0).otherwise(0.2),
        "violation": over_baseline(violations, at_least(col(dependencies) * 0.45, 1)),
        "module": over_baseline(module_index, F.lit(100.0)),
        "entropy": over_baseline(repo_index, F.lit(85.0)),
    }
    return fixed(weighted(parts, BOUNDARY_WEIGHTS) * 100, 2)


def z_score(x, mean, stddev) -> Column:
    """Distance from the mean in deviations; without a spread 4 above the mean, where binary noise below 1e-9 is not above."""
    flat = F.when(col(x) - col(mean) > 1e-9, 4.0).otherwise(0.0)
    return F.when(col(stddev) > 0.001, F.try_divide(col(x) - col(mean), col(stddev))).otherwise(flat)
