"""Buckets of the time line: how they are dealt out, and what a reading's assessment costs to write down."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators.running import answer, dealt, evened
from plumbline.plans import anomaly, incidents

T0 = dt.datetime(2024, 1, 1)


def marks(spark, keys, n):
    return spark.range(n).select((F.col("id") % keys).cast("string").alias("k"), (F.col("id") * 60_000_000).alias("_t"), F.lit(1).alias("_side"),
                                 F.lit("").alias("_tie"), F.struct("id").alias("_row"), F.lit(1).cast("bigint").alias("_n"))


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_partitions_grow_with_the_marks(spark):
    """A task sorts a few buckets: neither many series nor one long series end up in the session's four partitions."""
    for keys, several in ((100, False), (1, True)):
        placed, cut = dealt(marks(spark, keys, 4000), ["k"], 100)
        assert cut == several
        assert placed.rdd.getNumPartitions() == 160 and largest(placed) <= 800
        got = answer(marks(spark, keys, 4000), ["k"], ["_n"], [], depth=100).select("_row.id", "_n").collect()
        assert len(got) == 4000 and all(r["_n"] == r["id"] // keys + 1 for r in got)


def test_few_marks_stay_in_one_bucket(spark):
    placed, cut = dealt(marks(spark, 3, 50), ["k"], 100)
    assert not cut and {r["_bucket"] for r in placed.select("_bucket").distinct().collect()} == {0}
    none, cut = dealt(marks(spark, 3, 0), ["k"], 100)
    assert not cut and none.count() == 0


def test_an_assessment_is_written_once(spark):
    """Filters on the severity that move down must not take copies of the deviation along."""
    rows = [("r", "module", "m", key, T0 + dt.timedelta(hours=i), f"s{i}", 50.0) for i in range(3) for key in ("code_entropy_index", "pressure_index")]
    metrics = spark.createDataFrame(rows, "repo_id string, scope string, subject_id string, key string, at timestamp, sha string, value double")
    calm = incidents.index_recoveries(anomaly.assess_indexes(metrics))
    assert calm._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1
    assert calm.count() == 4  # all but the first reading of each series, which has no mean yet


def test_marks_are_placed_once(spark):
    """What is carried over buckets comes from the placed marks: nothing is left to derive and sort them a second time."""
    got = answer(marks(spark, 2, 1000), ["k"], ["_n"], [], depth=100)
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["_n"]) for r in got.select("_row.id", "_n").collect()) == [(i, i // 2 + 1) for i in range(1000)]


def test_lasts_are_carried_over_buckets_without_any(spark):
    placed = marks(spark, 1, 1000).withColumn("v", F.when(F.col("_row.id") % 350 == 0, F.col("_row.id")))
    got = answer(placed, ["k"], [], ["v"], depth=100).select("_row.id", "v").collect()
    assert len(got) == 1000 and all(r["v"] == r["id"] // 350 * 350 for r in got)


def test_stored_rows_are_dealt_out_evenly(spark, tmp_path):
    """A split of a column file is many rows: a task gets about as many as it is to hold, few rows stay where they are."""
    spark.range(5000).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    even = evened(stored, ["id"], most=100)
    assert even.rdd.getNumPartitions() == 50 and largest(even) <= 200
    assert evened(stored, ["id"]).rdd.getNumPartitions() == stored.rdd.getNumPartitions()
    assert even.distinct().count() == 5000
