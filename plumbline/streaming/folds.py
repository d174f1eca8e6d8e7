"""Keyed folds over micro-batches (survey X1, X3, X5, X7, X8, S9-S15).

A fold takes the rows of a micro-batch and the state table left by the one
before, and gives output rows and the next state.  Both are written under the
batch number, so a batch that runs again after a failure overwrites its own
results and reads the same earlier state: every row counts exactly once.  The
folds reuse the batch operators, so a hot key is split in a stream as it is in
a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors
from ..operators.edges import edge_diff
from ..operators.merge import upsert
from ..operators.shared import materialized
from ..operators.spacing import keep_spaced
from ..plans import incidents, rules

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


class Fold:
    """Runs one fold over a stream inside a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, step: Step, state_ddl: str, settled: str = "true"):
        """``settled`` is a condition on output rows that no later batch repeats."""
        self.spark, self.folder, self.step, self.state_ddl, self.settled = spark, folder.rstrip("/"), step, state_ddl, settled

    def state(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.state_ddl)
        return self.spark.read.schema(self.state_ddl).parquet(f"{self.folder}/state/{batch}")

    def advance(self, rows: DataFrame, batch: int) -> None:
        out, state = self.step(rows, self.state(batch - 1))
        out.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")
        state.write.mode("overwrite").parquet(f"{self.folder}/state/{batch}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self.advance).option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())

    def output(self, ddl: str | None = None) -> DataFrame:
        """Every row once: those of the last batch, and the settled ones of the batches before."""
        reader = self.spark.read if ddl is None else self.spark.read.schema(ddl)
        try:
            rows = reader.parquet(f"{self.folder}/out")
            if "batch" not in rows.columns or self.settled == "true":
                return rows.drop("batch")
            last = rows.agg(F.max("batch")).scalar()
            return rows.filter((F.col("batch") == last) | F.expr(self.settled)).drop("batch")
        except AnalysisException:  # no batch has run yet
            return self.spark.createDataFrame([], ddl or "none string")


def spaced(keys: list[str], at: str, gap_ms: int, tie: str, forced: str | None = None) -> Step:
    """Keep rows a gap apart across batches; state is the last kept row of each key.

    The kept row of the batch before joins the batch as a row that must stay, at the
    start of its millisecond, and is taken out of the result again.
    """

    def step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        must = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
        now = rows.select(*rows.columns, must.alias("_must"), F.lit(False).alias("_old"))
        before = state.select(*rows.columns, F.lit(True).alias("_must"), F.lit(True).alias("_old")).withColumn(
            at, F.date_trunc("MILLISECOND", at))
        kept = keep_spaced(before.unionByName(now), keys, at, gap_ms, tie=tie, forced="_must")
        last = kept.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(at, tie)).alias("r")).select("r.*")
        return kept.filter(~F.col("_old")).select(*rows.columns), last.select(*rows.columns)

    return step


def merged(keys: list[str], version: list[str]) -> Step:
    """Latest row per key; the output is the merged state itself, so a fold of it settles no row (``MERGED_SETTLED``)."""

    def step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        table = upsert(state, rows, keys, version)
        return table, table

    return step


def file_edges(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge changes of re-read files; state holds the current edges of every file.

    Of several readings of one file in a batch the latest counts.
    """
    owner = ["repo_id", "module", "file_path"]
    newest = rows.groupBy(*owner).agg(F.max("at").alias("at"))
    fresh = rows.join(newest, [*owner, "at"]).select(*owner, "edge").distinct()
    touched = newest.select(*owner)
    old = state.join(touched, owner, "left_semi").select(*owner, "edge")
    rest = state.join(touched, owner, "left_anti").select(*owner, "edge")
    return edge_diff(old, fresh, owner), rest.unionByName(fresh)


def incident_fold(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents over batches of alerts and recoveries (X5); ``kind`` tells them apart.

    State is the alerts of open incidents, two rows each.
    """
    alerts = rows.filter(F.col("kind") == "alert").select(*incidents.KEY, "at", "sha", "severity", "title").withColumn(
        "weight", F.lit(1).cast("bigint"))
    calm = rows.filter(F.col("kind") == "recovery").select(
        *incidents.KEY, "at", "sha", "value", "clear_threshold", "baseline_mean", "baseline_stddev")
    held = state.select(*incidents.KEY, "at", "sha", "severity", "title", "weight")
    folded = materialized(incidents.fold(held.unionByName(alerts), calm), "folded")  # both tables are made of it
    return folded, incidents.open_alerts(folded)


def module_drift(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drift of module feature vectors across batches; state is the last snapshot of each module."""
    cols = ["repo_id", "module", "at", "features"]
    both = state.select(*cols).unionByName(rows.select(*cols))
    found = rules.embedding_drift(both).join(rows.select("repo_id", "module", "at").distinct(), ["repo_id", "module", "at"], "left_semi")
    last = both.groupBy("repo_id", "module").agg(F.max_by(F.struct("at", "features"), "at").alias("r")).select("repo_id", "module", "r.*")
    return found, last


MERGED_SETTLED, INCIDENT_SETTLED = "false", "closed_at IS NOT NULL"
INCIDENT_STATE = ("repo_id string, type string, scope string, subject_id string, at timestamp, sha string, severity string, "
                  "title string, weight bigint")
EDGE_STATE = "repo_id string, module string, file_path string, edge string"
FEATURES = [name for name, _ in vectors.DRIFT_FEATURES] + ["code_entropy_index", "pressure_index"]
DRIFT_STATE = "repo_id string, module string, at timestamp, features struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"
