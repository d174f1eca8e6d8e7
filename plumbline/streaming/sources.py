"""Event streams in and out (survey S8, S21, X10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schema as S


def table_stream(spark: SparkSession, folder: str, ddl: str, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New parquet files of a folder, with an explicit row type."""
    reader = spark.readStream.schema(ddl).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """JSON messages of one subject from text files, one message per line."""
    return decode(spark.readStream.text(folder), name)


def kafka_stream(spark: SparkSession, servers: str, topic: str, name: str) -> DataFrame:
    """JSON messages of one subject from Kafka; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return decode(raw.select(F.col("value").cast("string").alias("value")), name)


def decode(raw: DataFrame, name: str) -> DataFrame:
    """Typed rows of a subject; messages that are no JSON object are dropped."""
    row = F.from_json("value", S.struct_type(S.EVENTS[name]), {"mode": "PERMISSIVE"})
    return raw.select(row.alias("e")).filter(F.col("e.repoId").isNotNull()).select("e.*")


def encode(df: DataFrame) -> DataFrame:
    """Rows as JSON messages keyed by repository."""
    return df.select(F.col("repoId").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def notifications(df: DataFrame, kind: str) -> DataFrame:
    """One notice per row for the repository's channel and one for the fleet's."""
    payload = F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("repo_id").alias("repoId"), F.col("at")))
    channels = F.array(F.concat(F.lit("repo:"), "repo_id"), F.lit("fleet"))
    return df.select(F.explode(channels).alias("channel"), payload.alias("payload"))


def to_files(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    return df.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint)
