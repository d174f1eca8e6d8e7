"""One refresh of all readings, alerts and incidents in a fixed order (survey 3.1, X9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import anomaly, graph, incidents, measures, rules


@dataclass(frozen=True)
class Refreshed:
    """Tables of one refresh; all lazy."""

    module_pressure: DataFrame
    module_metrics: DataFrame
    boundary_metrics: DataFrame
    module_snapshots: DataFrame
    repo_snapshots: DataFrame
    entropy: DataFrame
    pressure: DataFrame
    incidents: DataFrame


def refresh(metrics: DataFrame, alerts: DataFrame, edges_before: DataFrame, edges_now: DataFrame, sha: Column,
            as_of: Column) -> Refreshed:
    """Symbols and edges to module readings, snapshots, anomalies and incidents.

    The readings written by this refresh take part in the anomaly series, so
    alerts raised here and readings refreshed by alerts stay two ordered
    stages instead of a cycle.
    """
    changes = graph.file_edge_changes(edges_before, edges_now)
    added = changes.filter(F.col("change") == "added")
    entropy = measures.module_entropy(measures.module_inputs(metrics, alerts, as_of), graph.module_dependencies(edges_now))
    pressure = measures.module_pressure(entropy, added, measures.previous_state(metrics, as_of))
    written = measures.module_metric_rows(pressure, sha, as_of)
    boundary = measures.boundary_pressure(pressure, graph.current_edges(edges_now), added)
    everything = metrics.select(*written.columns).unionByName(written)
    on_entropy, on_pressure = anomaly.assess_entropy(everything), anomaly.assess_pressure(everything)
    return Refreshed(
        pressure, written, boundary, measures.module_snapshots(pressure, changes, sha, as_of),
        measures.repo_snapshots(measures.repo_rollup(everything, S.ENTROPY_KEYS), measures.repo_rollup(everything, S.PRESSURE_KEYS),
                                measures.repo_inputs(metrics, alerts, as_of), sha, as_of),
        rules.entropy_alerts(on_entropy, everything), rules.pressure_alerts(on_pressure, everything),
        incidents.fold(incidents.tracked_alerts(alerts), incidents.recoveries(on_entropy, on_pressure)))
