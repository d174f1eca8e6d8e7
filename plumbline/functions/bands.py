"""Postures, roles, labels and patterns (survey F22, F23, F25, F30, F38, F39, M20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# --- fixed values: bands, transitions, weights, pattern labels --------------
ENTROPY_BANDS = [(20, "stable"), (40, "normal"), (60, "drifting"), (80, "unstable")]
TOP_ENTROPY_BAND = "chaotic"
MODULE_BANDS = [  # posture, pressure, entropy, either delta
    ("critical", 80, 80, 20), ("pressured", 60, 60, 10), ("warming", 35, 40, 5),
]
REFACTOR_TRANSITIONS = {
    "proposed": ["accepted", "dismissed"],
    "accepted": ["proposed", "applied", "dismissed"],
    "applied": ["accepted"],
    "dismissed": ["proposed"],
}
REFACTOR_ORDER = {"applied": 0, "accepted": 1, "proposed": 2}
SIGNATURE_PATTERN = {
    "signals": [("Boundary Drift", 22), ("Clone Drift", 22), ("Volatility Hotspot", 22)],
    "stable": ["low pressure", "low entropy"],
    "mixed": ["pressure spread", "entropy drift"],
}
FLEET_PATTERN = {
    "signals": [("Boundary Pressure", 25), ("Duplication Drift", 30), ("Volatility Hotspots", 30)],
    "stable": ["low entropy", "low pressure"],
    "mixed": ["pressure spread", "entropy spread"],
}
# ---------------------------------------------------------------------------


def _first(cases, default) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def entropy_posture(value) -> Column:
    return _first([(col(value) < top, name) for top, name in ENTROPY_BANDS], TOP_ENTROPY_BAND)


def module_posture(pressure, entropy, pressure_delta, entropy_delta) -> Column:
    dp, de = F.coalesce(col(pressure_delta), F.lit(0.0)), F.coalesce(col(entropy_delta), F.lit(0.0))
    cases = [
        ((col(pressure) >= p) | (col(entropy) >= e) | (dp >= d) | (de >= d), name)
        for name, p, e, d in MODULE_BANDS
    ]
    return _first(cases, "stable")


def module_role(module, path) -> Column:
    m, p = F.lower(col(module)), F.lower(col(path))
    return _first(
        [
            (m.contains("web") | p.contains("/controller") | p.contains("/route"), "edge"),
            (m.contains("infra") | m.contains("adapter") | p.contains("/adapter"), "adapter"),
            (p.contains("gateway") | p.contains("client"), "gateway"),
            (m.contains("util") | m.contains("shared"), "utility"),
        ],
        "core",
    )


def refactor_rank(status) -> Column:
    return _first([(col(status) == s, r) for s, r in REFACTOR_ORDER.items()], 3)


def fix_rank(status) -> Column:
    """Order in which a fix is offered; everything not applied or accepted is equal."""
    return _first([(col(status) == "applied", 0), (col(status) == "accepted", 1)], 2)


def transition_allowed(current, wanted) -> Column:
    cases = [(col(current) == s, col(wanted).isin(targets)) for s, targets in REFACTOR_TRANSITIONS.items()]
    return _first(cases, F.lit(False))


def pattern(kind: dict, pressure, entropy, alerts, scores) -> Column:
    """struct(label, dominant) of a repository.

    ``scores`` are three signal counts and the index that adds to each; the
    strongest signal names the pattern unless the repository is calm or no
    signal stands out.
    """
    ranked = F.array_sort(F.array(*[
        F.struct(
            (-(col(count).cast("double") + col(index) / scale)).alias("order"),
            F.lit(i).alias("place"),
            F.lit(label).alias("label"),
        )
        for i, ((label, scale), (count, index)) in enumerate(zip(kind["signals"], scores))
    ]))
    strong = F.transform(F.slice(F.filter(ranked, lambda s: s["order"] < -0.5), 1, 2), lambda s: s["label"])

    def listed(words):
        return F.array(*[F.lit(w) for w in words])

    calm = (col(pressure) < 35) & (col(entropy) < 35) & (col(alerts) < 3)
    quiet = F.size(strong) == 0
    return F.struct(
        F.when(calm, "Stable Core").when(quiet, "Mixed Drift").otherwise(F.get(strong, F.lit(0))).alias("label"),
        F.when(calm, listed(kind["stable"])).when(quiet, listed(kind["mixed"])).otherwise(strong).alias("dominant"),
    )


def repo_notes(coverage, activity, entropy) -> Column:
    """Advice codes of a repository report."""
    notes = F.array(
        F.when(F.coalesce(col(coverage), F.lit(0)) < 35, F.lit("low_coverage")),
        F.when(F.coalesce(col(activity), F.lit(0)) == 0, F.lit("idle")),
        F.when(F.coalesce(col(entropy), F.lit(0.0)) > 70, F.lit("high_entropy")),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def component_notes(pressure, alerts) -> Column:
    notes = F.array(
        F.when(F.coalesce(col(pressure), F.lit(0.0)) > 60, F.lit("high_pressure")),
        F.when(F.coalesce(col(alerts), F.lit(0)) == 0, F.lit("no_alerts")),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def activity_reason(status, alerts) -> Column:
    s = col(status)
    return _first(
        [
            ((col(alerts) > 0) & (s == "unsupported"), "heuristic fired"),
            (col(alerts) > 0, "drift rule hit"),
            (s == "unsupported", "watched-only lane"),
            (s == "no_symbols", "parsed no symbols"),
            (s == "pending", "awaiting parser"),
        ],
        "below alert threshold",
    )


def activity_tone(status, alerts) -> Column:
    waiting = col(status).isin("unsupported", "no_symbols", "pending")
    return _first([(col(alerts) > 0, "error"), (waiting, "warn")], "healthy")


def fleet_tone(status, alerts) -> Column:
    return _first([(col(alerts) > 0, "error"), (col(status) == "analyzed", "healthy")], "warn")


def coverage_tone(percent) -> Column:
    return _first([(col(percent) >= 75, "healthy"), (col(percent) >= 40, "warn")], "error")


def severity_weight(severity) -> Column:
    return _first([(col(severity) == "error", 100), (col(severity) == "warn", 58)], 18)


def surface_weight(severity) -> Column:
    return _first([(col(severity) == "error", 100), (col(severity) == "warn", 60)], 20)


def severity_label(severity) -> Column:
    return _first([(col(severity) == "error", "critical"), (col(severity) == "warn", "warning")], "quiet")


def alert_label(kind, category) -> Column:
    named = (col(kind) == "CONTENT_HEURISTIC") & col(category).isNotNull()
    return F.translate(F.when(named, col(category)).otherwise(col(kind)), "_", " ")


def alert_category(kind, category) -> Column:
    return F.when(col(kind) == "CONTENT_HEURISTIC", F.coalesce(col(category), F.lit("CONTENT_HEURISTIC")))


def alert_module(module, path, symbol, default) -> Column:
    """Module an alert belongs to: named, else from its path, else from its symbol."""
    from .paths import module_name

    def given(c):
        return F.when(col(c) != "", col(c))

    owner = F.get(F.split(given(symbol), ":"), F.lit(0))
    return F.coalesce(
        given(module),
        F.when(given(path).isNotNull(), module_name(path)),
        F.when(owner.isNotNull(), module_name(owner)),
        col(default) if default is not None else F.lit(None).cast("string"),
    )
