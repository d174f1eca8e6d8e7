"""Edge sets of files and modules in long form (survey U1, U2, A7, A16, J12, J13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01


def edge_diff(previous: DataFrame, current: DataFrame, keys: list[str], edge: str = "edge") -> DataFrame:
    """Added and removed edges per owner.

    Both sides are reduced to distinct (owner, edge) flags in one aggregation,
    so an owner with very many edges is never gathered into one array.
    """
    stacked = previous.select(*keys, edge, F.lit(1).alias("_p"), F.lit(0).alias("_c")).unionByName(
        current.select(*keys, edge, F.lit(0).alias("_p"), F.lit(1).alias("_c")))
    flags = stacked.groupBy(*keys, edge).agg(F.max("_p").alias("_p"), F.max("_c").alias("_c"))
    return flags.filter(F.col("_p") != F.col("_c")).select(
        *keys, edge, F.when(F.col("_c") == 1, "added").otherwise("removed").alias("change"))


def target_of(edge) -> Column:
    """Part after the first arrow, or the whole edge."""
    parts = F.split(F.col(edge) if isinstance(edge, str) else edge, "->")
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def source_of(edge) -> Column:
    """Part before the first arrow."""
    return F.get(F.split(F.col(edge) if isinstance(edge, str) else edge, "->"), F.lit(0))


def bucket_entropy(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Shannon entropy of bucket counts over log2 of the bucket count, 0 for one bucket.

    Two aggregations: counts per (key, bucket), then sums of n and n*log2(n)
    per key; H = log2(N) - sum(n*log2 n)/N.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").cast("double")
    raw = F.log2(total) - F.sum(F.col("_n") * F.log2(F.col("_n"))) / total
    buckets = F.count(F.lit(1))
    return counts.groupBy(*keys).agg(
        F.when(buckets <= 1, F.lit(0.0)).otherwise(clamp01(F.try_divide(raw, F.log2(buckets.cast("double"))))).alias("entropy"),
        buckets.alias("buckets"),
    )
