"""Time buckets, dense grids and paging (survey A9, J9, W5, F35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_grid(df: DataFrame, as_of: Column, hours: int, name: str = "bucket") -> DataFrame:
    """Each row once per hour of the last ``hours`` hours, the current one included."""
    last = F.date_trunc("hour", as_of)
    first = last - F.expr(f"INTERVAL {hours - 1} HOURS")
    return df.withColumn(name, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, page, page size and page count (at least one)."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).cast("bigint").alias("page"), F.lit(size).cast("bigint").alias("page_size"),
        pages.alias("total_pages"))

