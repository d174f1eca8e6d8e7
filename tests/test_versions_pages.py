"""Versioned tables, cascade delete, activity pages and patches, fixes and outcomes of hits."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.merge import delete_cascade
from plumbline.operators.versioned import Versions
from plumbline.plans import incidents, ingest, similarity


def test_version_counts_once_its_manifest_is_there(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.paths() == (-1, {})
    a, b = spark.range(3), spark.range(5)
    assert store.publish({"a": a, "b": b}) == 0
    assert store.publish({"a": spark.range(1)}) == 1
    assert store.read("a").count() == 1 and store.read("b").count() == 5
    with pytest.raises(Exception):  # a table that cannot be computed leaves the version before
        store.publish({"a": spark.range(2), "b": spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))})
    assert store.paths()[0] == 1 and store.read("a").count() == 1


def test_cascade_takes_rows_and_lone_nodes(spark, tmp_path):
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    edges = spark.createDataFrame([("r1", "a->pkg:x"), ("r1", "a->b"), ("r2", "c->b"), (None, "d->e")], "repo_id string, edge string")
    store = Versions(spark, str(tmp_path))
    delete_cascade({"repos": repos, "edges": edges}, repos.filter("repo_id = 'r1'"), "repo_id", "edges", "edge", store)
    assert [r[0] for r in store.read("repos").collect()] == ["r2"]
    assert sorted(r[0] for r in store.read("nodes").collect()) == ["b", "e"]  # rows of no repository stay


def test_telemetry_patches_only_what_it_says(spark):
    rows = spark.createDataFrame([("r", "c", "f", "human"), ("r", "c", "g", None)], "repo_id string, commit_sha string, file_path string, provenance string")
    said = spark.createDataFrame([("r", "c", "f", 1, None, "editor", None, "s1"), ("r", "c", "f", 2, None, None, "vim", "s2")],
                                 "repo_id string, commit_sha string, file_path string, at int, provenance string, telemetry_source string, "
                                 "telemetry_editor string, telemetry_session_id string")
    got = {r["file_path"]: tuple(r[c] for c in ingest.TOLD) for r in ingest.with_telemetry(rows, said).collect()}
    assert got == {"f": ("human", "editor", "vim", "s2"), "g": (None, None, None, None)}
    assert ingest.with_telemetry(rows, said.limit(0)).count() == 2


def test_activity_pages_meet(spark):
    rows = spark.createDataFrame([("r", f"e{i:02d}", i // 3, "pending" if i % 2 else "unsupported") for i in range(10)],
                                 "repo_id string, event_id string, at int, parser_status string")
    pages = [[r["event_id"] for r in ingest.activity_page(rows, "r", number=n, size=4).orderBy(F.desc("at"), F.desc("event_id")).collect()] for n in (1, 2, 3, 4)]
    assert sum(pages, []) == [f"e{i:02d}" for i in range(9, -1, -1)]
    after = F.struct(F.lit(2).alias("at"), F.lit("e06").alias("event_id"))
    assert [r["event_id"] for r in ingest.activity_page(rows, "r", size=4, after=after).collect()] == pages[1]
    watched = ingest.activity_page(rows, "r", "watched", size=4).collect()
    assert {(r["total"], r["total_pages"]) for r in watched} == {(5, 2)}
    assert ingest.activity_page(rows, "none").count() == 0


def test_hits_carry_their_own_fixes_and_outcomes(spark):
    refactors = spark.createDataFrame(
        [("r", "f1", 1, "web", "A", 0.5, "proposed", ["web"], []), ("r", "f2", 1, "web->x", "B", 0.1, "applied", ["web"], ["web->x"]),
         ("r", "f3", 1, "web", "C", 0.9, "dismissed", [], []), ("q", "f4", 1, "web", "D", 0.9, "applied", [], [])],
        "repo_id string, id string, at int, target string, type string, confidence double, status string, modules array<string>, edges array<string>"
    ).withColumn("entities", F.struct("modules", F.col("edges").alias("edgesAdded"))).withColumn("impact", F.lit("x"))
    health = "struct<health:struct<entropyIndex:double,pressureIndex:double>>"
    resolution = "struct<reason:string,refactorType:string,refactorTarget:string,refactorConfidence:double,refactorStatus:string>"
    closed = spark.createDataFrame(
        [("r", f"i{n}", "T", "module", "web", "closed", n, n + 1, ((5.0, 5.0),), ((4.0, 3.0),), None) for n in range(4)],
        f"repo_id string, incident_id string, type string, scope string, subject_id string, status string, opened_at int, closed_at int, "
        f"pre_signature {health}, post_signature {health}, resolution {resolution}")
    hits = spark.createDataFrame([("r", "web"), ("r", "none")], "repo_id string, module string")
    assert [r["id"] for r in similarity.hit_fixes(hits, "module", refactors, "module").orderBy("rank").collect()] == ["f2", "f1"]
    got = similarity.hit_outcomes(hits, "module", closed, refactors, "module").orderBy("rank").collect()
    assert [(r["incident_id"], r["fix_type"], r["delta_pressure"]) for r in got] == [("i3", "B", -2.0), ("i2", "A", -2.0), ("i1", "B", -2.0)]
    edges = spark.createDataFrame([("r", "web->x"), ("r", "web->y")], "repo_id string, edge string")
    got = similarity.hit_outcomes(edges, "edge", closed, refactors, "boundary").orderBy("subject_id", "rank").collect()
    assert [(r["subject_id"], r["incident_id"], r["fix_type"]) for r in got] == [
        ("web->x", "i3", "B"), ("web->x", "i2", "B"), ("web->x", "i1", "B"), ("web->y", "i3", None), ("web->y", "i2", None), ("web->y", "i1", None)]
    with pytest.raises(ValueError):
        incidents.recent_outcomes(closed, "boundary")
