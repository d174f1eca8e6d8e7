"""Parallel work over inputs that come as few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out to all cores when it has fewer splits than cores.

    Text rules and symbol positions cost far more than moving the rows, and a
    small file is a single split.  Large inputs have splits enough and are
    left alone, so no shuffle is added where it would matter.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
