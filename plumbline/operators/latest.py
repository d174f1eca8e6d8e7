"""Latest row per key (survey A5, W1, S9, S14) and ranked rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialized


def latest_per_key(df: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """One row per key: the one greatest by ``order``.

    ``max_by`` aggregates before the shuffle, so a key that holds most of the
    rows still sends one row per input partition.
    """
    ranked = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), ranked).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, with their rank; all rows if ``k`` is None.

    The rank filter lets Spark limit each group within its input partition
    before the shuffle; without one a key's rows are sorted in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def leading(df: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """The rows that can be the first of their key: of the least ``low`` those of the greatest ``high`` (null only where there is no other).

    Numbers are compared in a hash table of the keys inside the input partitions, where a ranking of all
    rows sorts every partition whole; what is left to rank are ties.
    """
    rows = df.withColumns({"_low": low, "_high": high})
    each = materialized(rows.groupBy(*keys, "_low").agg(F.max("_high").alias("_high")), "leading")
    best = each.groupBy(*keys).agg(F.min(F.struct("_low", "_high")).alias("_best")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_best._low").alias("_least"), F.col("_best._high").alias("_most"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    same += [F.col("_low").eqNullSafe(F.col("_least")), F.col("_high").eqNullSafe(F.col("_most"))]
    return rows.join(best, same, "left_semi").drop("_low", "_high")


def pivot_values(df: DataFrame, keys: list[str], name: str, value: str, wanted: list[str]) -> DataFrame:
    """Long rows to one column per wanted name, by filtered maximum (survey A4, A15)."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted]
    )
