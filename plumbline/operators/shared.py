"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: it is computed once, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
