"""Tables that change together: readers see all of a change or nothing of it (survey S18)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, name string, path string"


class Versions:
    """Named tables in a shared folder under a manifest.

    A version is written table by table into a folder of its own and counts
    once its rows of the manifest are there, which one file brings at once.
    Tables that a version does not bring keep their files.  Only the manifest,
    one row a table and version, is read by the driver.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def paths(self) -> tuple[int, dict[str, str]]:
        """The newest version (-1 before the first) and where its tables lie."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            last = rows.agg(F.max("version")).scalar()
            found = rows.filter(F.col("version") == last).collect()
        except AnalysisException:  # nothing published yet
            found = []
        return (found[0].version if found else -1), {r.name: r.path for r in found}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths()[1][name])

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Write the tables and make them the newest version; a failed try leaves the version before."""
        before, known = self.paths()
        version = before + 1
        for name, df in tables.items():
            known[name] = f"{self.folder}/v{version}/{name}"
            df.write.mode("overwrite").parquet(known[name])
        rows = self.spark.createDataFrame([(version, n, p) for n, p in sorted(known.items())], MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version
