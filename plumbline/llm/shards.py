"""Proportional stratified interleaving of documents into shards.

Within each source, rows are shuffled by a seeded hash and ranked; row r of n
has the fractional rank (r - u) / n, where u is a seeded hash of the source
between 0 and 1, so that sources of few rows spread over all ranks.  Sorted by fractional rank, any run of
consecutive rows has every source in proportion, so cutting the order into
equal runs gives shards that match the mixture, to within one row per source of
what the run's range of fractional ranks holds.

Neither rank is taken in one task: the hash space of every source, and then the
fractional ranks, are cut into so many buckets that one of all rows would hold
``bucket_rows``; rows are numbered within a bucket, and the counts of the
buckets before it are added.  No shuffle is by source alone.

Defined cases: a null source is a source; a null text counts no bytes and has
the checksum 0; equal rows share the hash and take neighbouring ranks in any
order, which gives the same rows; fewer rows than shards leave shards empty;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Rows numbered from 1 by ``order`` within ``keys``, and how many ``keys`` has; buckets follow that order and are sorted one by one."""
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select(*keys, bucket, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_rows"))
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    joined = own.join(sums, [*keys, bucket])
    return joined.withColumn(out, F.col("_own") + F.col("_before")).select(*df.columns, out, "_rows")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = 50_000,
               source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; counts of shards differ by one at most."""
    blank = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"), (F.octet_length(blank) + 1).cast("long").alias("size"),
        F.crc32(blank.cast("binary")).alias("text_crc32"))
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_u", F.shiftrightunsigned(mixed, 11) / F.lit(float(1 << 53)))

    total = docs.count()
    buckets = max(1, -(-total // bucket_rows))
    rows = rows.withColumn("_bucket", F.floor(F.col("_u") * buckets))
    rows = _numbered(rows, ["_source"], "_bucket", ["_u", "doc_id", "text_crc32", "size"], "_rank")

    offset = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("offset"), "_source"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    place = (F.col("_rank") - offset) / F.col("_rows")
    rows = rows.withColumn("_place", place).withColumn("_slice", F.floor(F.col("_place") * buckets)).drop("_rows").withColumn("_all", F.lit(0))
    rows = _numbered(rows, ["_all"], "_slice", ["_place", F.xxhash64(F.lit(seed), "_source"), "_source"], "_position")

    rows = rows.withColumn("_at", F.col("_position") - 1)  # shard k holds the positions from ceil(k n / shards)
    rows = rows.withColumn("shard", F.expr(f"CAST((_at * {shards}) DIV {max(total, 1)} AS INT)"))
    start = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - start).cast("long").alias("slot"))


def sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of ``interleave`` with the law they keep."""
    return interleave(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
