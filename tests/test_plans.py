"""Incidents, memory and refresh on small tables; registry sanity."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.plans import incidents, refactors, refresh, rules
from plumbline.sources.workspace import Workspace

T0 = dt.datetime(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_incident_state_machine(spark):
    alerts = spark.createDataFrame(
        [("r", "ENTROPY_DRIFT", "module", "m", hours(h), f"s{h}", sev, f"t{h}") for h, sev in ((1, "warn"), (2, "error"), (5, "warn"), (9, "warn"))],
        "repo_id string, type string, scope string, subject_id string, at timestamp, sha string, severity string, title string")
    calm = spark.createDataFrame(
        [("r", "ENTROPY_DRIFT", "module", "m", hours(h), f"c{h}", 40.0, 45.0, 40.0, 1.0) for h in (0, 3, 4, 6)],
        "repo_id string, type string, scope string, subject_id string, at timestamp, sha string, value double, clear_threshold double, "
        "baseline_mean double, baseline_stddev double")
    got = sorted((x["opened_at"], x["closed_at"], x["status"], x["severity"], x["alert_count"]) for x in incidents.fold(alerts, calm).collect()
                 if x["closed_at"]) + [(x["opened_at"], x["status"]) for x in incidents.fold(alerts, calm).collect() if not x["closed_at"]]
    assert got == [(hours(1), hours(3), "closed", "error", 2), (hours(5), hours(6), "closed", "warn", 1), (hours(9), "open")]


def test_volatility_limit(spark):
    rows = [("r", "f.py", f"s{i}", hours(i * 0.1)) for i in range(9)] + [("r", "g.py", f"s{i}", hours(i * 0.1)) for i in range(8)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, sha string, at timestamp")
    out = rules.volatile_files(df, F.lit(hours(2)).cast("timestamp"))
    assert [(x["file_path"], x["churn"]) for x in out.collect()] == [("f.py", 9)]


def test_refresh_runs_end_to_end(spark):
    w = Workspace(spark, SMALL)
    cut = w.as_of - F.expr("INTERVAL 15 DAYS")
    out = refresh.refresh(w.metrics, w.alerts, w.edges.filter(F.col("at") < cut), w.edges.filter(F.col("at") >= cut), F.lit("head"), w.as_of)
    modules = out.module_pressure.count()
    assert modules > 0 and out.module_metrics.count() == modules * 13
    values = out.module_pressure.agg(F.min("pressure_index"), F.max("pressure_index"), F.min("entropy_index"), F.max("entropy_index")).first()
    assert all(0 <= v <= 100 for v in values)
    assert out.boundary_metrics.count() > 0 and out.repo_snapshots.count() > 0


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) >= 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_refactor_limits_of_none_are_everything(spark):
    w = Workspace(spark, SMALL)
    edges = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit("->b")))
    alerts = w.alerts.withColumn("type", F.lit("ARCH_VIOLATION")).withColumn("evidence", F.col("evidence").withField("graphEdgesAdded", edges))
    rows = lambda *limits: Counter(r["repo_id"] for r in refactors.generate(alerts, w.metrics, *limits).filter("type = 'INVERT_BOUNDARY'").collect())
    assert set(rows(None, None, None).values()) == {20} and max(rows().values()) <= 6


def test_script_sources_hold_the_whole_text(spark):
    w = Workspace(spark, SMALL)
    texts = {r["doc_id"]: r["text"] for r in w.documents.select("doc_id", "text").collect()}
    for row in w.script_sources.select("doc_id", "source").collect():
        note = "\n    // ".join(texts[row["doc_id"]].replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        assert note in row["source"]


def test_the_best_fix_is_ranked_among_ties_only(spark):
    """Numbers decide in a hash table of the subjects; nulls, absent subjects and ties come out as in the ranking of all."""
    from plumbline.operators.latest import leading, top_per_key

    rows = [("r", s, i % 3 + (i % 7 == 0), c, i) for s in ("a", "b", None) for i in range(1, 60) for c in (None, float(i % 4), float("nan") if s == "b" else 0.5)]
    rows += [("r", "none", 2, None, 1), ("r", "none", 3, 1.0, 2)]
    df = spark.createDataFrame(rows, "repo_id string, subject_id string, low int, high double, id int")
    key, order = ["repo_id", "subject_id"], [F.col("low"), F.desc("high"), F.col("id")]
    kept = leading(df, key, F.col("low"), F.col("high"))
    assert 0 < kept.count() < df.count() / 4 and kept.columns == df.columns
    best = lambda d: sorted(map(str, top_per_key(d, key, order, 1).collect()))
    assert best(kept) == best(df) and len(best(df)) == 4
