"""A stream in several batches gives the rows of one batch."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from plumbline.operators.spacing import keep_spaced
from plumbline.plans import incidents
from plumbline.session import shared_dir
from plumbline.streaming import folds, sources, windows

T0 = dt.datetime(2024, 1, 1)
EVENTS = "k string, id int, at timestamp, v double"


def rows(n, step, keys=2):
    return [(f"k{i % keys}", i, T0 + dt.timedelta(seconds=step * i), float(i)) for i in range(n)]


def in_parts(spark, data, ddl, folder, parts):
    size = -(-len(data) // parts)
    for p in range(parts):
        spark.createDataFrame(data[p * size:(p + 1) * size], ddl).coalesce(1).write.mode("append").parquet(folder)


def test_spaced_stream_equals_batch(spark, tmp_path):
    data = rows(400, 97)
    source = str(tmp_path / "in")
    in_parts(spark, data, EVENTS, source, 4)
    stream = sources.table_stream(spark, source, EVENTS, files_per_trigger=1)
    fold = folds.Fold(spark, str(tmp_path / "fold"), folds.spaced(["k"], "at", 900_000, "id"), EVENTS)
    fold.start(stream).awaitTermination()
    batch = keep_spaced(spark.createDataFrame(data, EVENTS), ["k"], "at", 900_000, tie="id")
    assert sorted(x["id"] for x in fold.output().collect()) == sorted(x["id"] for x in batch.collect())


def test_fold_replays_a_batch(spark, tmp_path):
    fold = folds.Fold(spark, str(tmp_path / "fold"), folds.merged(["k"], ["id"]), EVENTS, folds.MERGED_SETTLED)
    first, second = (spark.createDataFrame(part, EVENTS) for part in (rows(4, 1), rows(8, 1)[4:]))
    fold.advance(first, 0)
    fold.advance(second, 1)
    fold.advance(second, 1)
    assert {x["k"]: x["id"] for x in fold.state(1).collect()} == {"k0": 6, "k1": 7}
    assert sorted((x["k"], x["id"]) for x in fold.output().collect()) == [("k0", 6), ("k1", 7)]


def test_incident_output_has_each_incident_once(spark, tmp_path):
    ddl = ("kind string, repo_id string, type string, scope string, subject_id string, at timestamp, sha string, severity string, title string, "
           "value double, clear_threshold double, baseline_mean double, baseline_stddev double")
    data = [("alert" if c == "A" else "recovery", "r", "ENTROPY_DRIFT", "module", "m", T0 + dt.timedelta(hours=i), f"s{i:02d}", "warn", f"t{i}", 1.0, 2.0, 1.0, 0.0)
            for i, c in enumerate("AARAAARAA")]
    fold = folds.Fold(spark, str(tmp_path / "fold"), folds.incident_fold, folds.INCIDENT_STATE, folds.INCIDENT_SETTLED)
    for batch in range(3):
        fold.advance(spark.createDataFrame(data[batch * 3:batch * 3 + 3], ddl), batch)
    assert sorted(x["alert_count"] for x in fold.output().collect()) == [2, 2, 3]


def test_file_edges_stream(spark):
    ddl = "repo_id string, module string, file_path string, edge string, at timestamp"
    mk = lambda edges, t: spark.createDataFrame([("r", "m", "f", e, t) for e in edges], ddl)
    none = spark.createDataFrame([], folds.EDGE_STATE)
    out1, state = folds.file_edges(mk(["a", "b"], T0), none)
    out2, state = folds.file_edges(mk(["b", "c"], T0 + dt.timedelta(1)), state)
    assert sorted((x["edge"], x["change"]) for x in out1.collect()) == [("a", "added"), ("b", "added")]
    assert sorted((x["edge"], x["change"]) for x in out2.collect()) == [("a", "removed"), ("c", "added")]
    assert sorted(x["edge"] for x in state.collect()) == ["b", "c"]


def test_incident_stream_equals_batch(spark):
    ddl = ("kind string, repo_id string, type string, scope string, subject_id string, at timestamp, sha string, severity string, title string, "
           "value double, clear_threshold double, baseline_mean double, baseline_stddev double")
    pattern = "AARAARRAAAAR" * 3 + "A"
    data = [("alert" if c == "A" else "recovery", "r", "ENTROPY_DRIFT", "module", "m", T0 + dt.timedelta(hours=i), f"s{i:02d}", "warn", f"t{i}", 1.0, 2.0, 1.0, 0.0)
            for i, c in enumerate(pattern)]
    whole = spark.createDataFrame(data, ddl)
    pick = lambda df: sorted((x["opened_at"], x["last_alert_at"], x["closed_at"] or T0, x["alert_count"], x["opened_alert_title"]) for x in df.collect())
    expected = pick(folds.incident_fold(whole, spark.createDataFrame([], folds.INCIDENT_STATE))[0])
    state, seen = spark.createDataFrame([], folds.INCIDENT_STATE), {}
    for a in range(0, len(data), 5):
        out, state = folds.incident_fold(spark.createDataFrame(data[a:a + 5], ddl), state)
        for x in out.collect():
            seen[x["opened_at"]] = x
        state = spark.createDataFrame(state.collect(), folds.INCIDENT_STATE)
    got = sorted((x["opened_at"], x["last_alert_at"], x["closed_at"] or T0, x["alert_count"], x["opened_alert_title"]) for x in seen.values())
    assert got == expected


def test_tumbling_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    in_parts(spark, rows(200, 60), EVENTS, source, 3)
    stream = sources.table_stream(spark, source, EVENTS, files_per_trigger=1)
    out = windows.tumbling(stream, ["k"], "at", "v", delay="10 minutes")
    q = sources.to_files(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.max("readings")).first()[0] == 8 and got.groupBy("k", "bucket").count().filter("count > 1").count() == 0


def test_bus_round_trip(spark):
    raw = spark.createDataFrame([('{"schemaVersion":1,"repoId":"r","deletedAt":"2024-01-01T00:00:00Z"}',), ("broken",)], "value string")
    typed = sources.decode(raw, "repo_deleted")
    assert typed.count() == 1
    assert '"repoId":"r"' in sources.encode(typed).first()["value"]


def test_a_batch_is_written_by_several_tasks(spark, tmp_path):
    """Four batches in the order of their times, whatever number of files each has."""
    from catalog.streams import in_batches
    from plumbline.sources.workspace import Workspace

    seen = []

    def step(rows, state):
        seen.append(tuple(rows.agg(F.min("id"), F.max("id")).first()))
        return rows, state

    fold = folds.Fold(spark, str(tmp_path / "fold"), step, EVENTS)
    data = spark.createDataFrame(rows(400, 60), EVENTS).repartition(3)
    sizes = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}  # a few rows are a split
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        out = in_batches(Workspace(spark, str(tmp_path)), data, "numbers", fold)
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert sorted(x["id"] for x in out.collect()) == list(range(400))
    assert seen == [(0, 99), (100, 199), (200, 299), (300, 399)]
    assert len(list(Path(shared_dir(spark)).glob("numbers-*/*.parquet"))) == 12


def test_incident_state_is_made_of_the_written_incidents(spark):
    ddl = ("kind string, repo_id string, type string, scope string, subject_id string, at timestamp, sha string, severity string, title string, "
           "value double, clear_threshold double, baseline_mean double, baseline_stddev double")
    data = [("alert", "r", "ENTROPY_DRIFT", "module", "m", T0, "s", "warn", "t", 1.0, 2.0, 1.0, 0.0)]
    out, state = folds.incident_fold(spark.createDataFrame(data, ddl), spark.createDataFrame([], folds.INCIDENT_STATE))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (out, state)]
    assert out.count() == state.count() == 1 and not any("Window" in p or "Aggregate" in p for p in plans)
