"""Raised alerts: rows of the table's shape, suppression, guarded insert, stale modules."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline import schema as S
from plumbline.plans import raising

T0 = dt.datetime(2024, 1, 10)
METRICS = ("repo_id string, sha string, at timestamp, scope string, subject_id string, key string, value double, module string, "
           "file_path string, provenance string, tags map<string,string>")


def reading(minute, scope, subject, key, value, file=None, sha="c1"):
    return ("r", sha, T0 + dt.timedelta(minutes=minute), scope, subject, key, float(value), "m", file, None, {})


def metric_frame(spark):
    rows = [reading(0, "module", "m", "code_entropy_index", 90), reading(0, "repo", "r", "code_entropy_index", 70), reading(0, "module", "m", "dependency_entropy", 12.345),
            reading(1, "module", "m", "pressure_index", 95), reading(2, "symbol", "src/m/a.ts:f:1", "cyclomatic", 30, "src/m/a.ts")]
    rows += [reading(10 + i, "symbol", "s", "nesting_depth", 1, "src/web/b.ts", f"x{i}") for i in range(10)]
    return spark.createDataFrame(rows, METRICS)


def test_rules_become_alert_rows(spark):
    raised = raising.from_metrics(metric_frame(spark), F.lit(T0 + dt.timedelta(hours=3)))
    assert dict(raised.dtypes)["evidence"].lower().replace(" ", "") == S.struct_type(S.EVIDENCE).simpleString().lower()
    got = {r["title"]: r for r in raised.collect()}
    assert set(got) == {"Module entropy rising in m", "Repo entropy rising in r", "Architecture pressure building in m",
                        "Complexity threshold exceeded for src/m/a.ts:f:1", "High change volatility detected for src/web/b.ts"}
    entropy = got["Module entropy rising in m"]
    assert (entropy["severity"], entropy["evidence"]["module"]) == ("error", "m")
    assert entropy["evidence"]["metrics"]["code_entropy_index"] == 90.0 and entropy["evidence"]["metrics"]["dependency_entropy"] == 12.35
    assert got["Repo entropy rising in r"]["evidence"]["module"] is None
    assert got["Complexity threshold exceeded for src/m/a.ts:f:1"]["severity"] == "error"
    assert (got["High change volatility detected for src/web/b.ts"]["sha"], got["High change volatility detected for src/web/b.ts"]["evidence"]["filePath"]) == ("x9", "src/web/b.ts")


def test_insert_suppresses_and_guards(spark):
    edge = [("r", f"src/domain/{n}.ts", "src/web/b.ts", "domain must not use web", "error", f"src/domain/{n}.ts -> src/web/b.ts") for n in "ab"]
    violations = spark.createDataFrame(edge, "repo_id string, source_path string, target_path string, rule string, severity string, edge string")
    times = [0, 5, 20]
    raised = None
    for minute in times:
        part = raising.from_violations(violations, F.lit("c"), F.lit(T0 + dt.timedelta(minutes=minute)))
        raised = part if raised is None else raised.unionByName(part)
    none = raised.limit(0).select(*raising.KEY)
    new = raising.inserted(raised, none)
    # both edges have one key (same title and time); within fifteen minutes the second is held back
    assert sorted(r["at"] for r in new.collect()) == [T0, T0 + dt.timedelta(minutes=20)]
    assert raising.inserted(raised, new.select(*raising.KEY)).count() == 0
    stale = raising.refreshed(new).collect()
    assert sorted((r["repo_id"], r["module"], r["at"]) for r in stale) == [("r", "domain", T0), ("r", "domain", T0 + dt.timedelta(minutes=20))]


def test_query_of_duplicates_has_the_severities_of_its_sql(spark, tmp_path):
    """Scores above 0.98 of generated code are a warning there, whatever wrote it, and an error among raised alerts."""
    from catalog.rules import semantic_duplicates
    from plumbline.plans import rules
    from plumbline.sources.workspace import Workspace

    rows = [(i, [1.0, 0.01 * i, 0.0, 0.0], 1) for i in range(1, 9)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    w = Workspace(spark, str(tmp_path))
    assert {r["severity"] for r in semantic_duplicates(w).collect()} == {"warn"}
    assert {r["severity"] for r in rules.duplicates(w.vectors, min_score=0.35).collect()} == {"warn", "error"}


def test_a_level_series_raises_nothing(spark):
    """Three times 75.055 have a mean that falls short of it by a rounding: no reading is above the baseline."""
    rows = [reading(i, "module", "m", "code_entropy_index", 75.055, sha=f"c{i}") for i in range(8)]
    raised = raising.from_metrics(spark.createDataFrame(rows, METRICS), F.lit(T0 + dt.timedelta(hours=3)))
    assert [r["at"] for r in raised.collect()] == [T0]


def test_readings_are_read_once_for_the_parts_of_both_kinds(spark, tmp_path):
    """Parts, complexity, volatile files and their last commits: four readings of the metrics, the anomalies' own are kept."""
    metric_frame(spark).write.parquet(str(tmp_path / "m"))
    raised = raising.from_metrics(spark.read.parquet(str(tmp_path / "m")), F.lit(T0 + dt.timedelta(hours=3)))
    plan = raised._jdf.queryExecution().optimizedPlan().toString()
    assert sum("tags#" in line for line in plan.splitlines() if "Relation" in line) == 4
    got = {r["title"]: r["evidence"]["metrics"] for r in raised.collect()}
    assert got["Module entropy rising in m"]["dependency_entropy"] == 12.35 and "pressure_index" not in got["Module entropy rising in m"]
    assert got["Architecture pressure building in m"]["pressure_index"] == 95.0 and "dependency_entropy" not in got["Architecture pressure building in m"]
