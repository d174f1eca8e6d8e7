"""Source trees as tables (survey S1, S2, S7).

Spark's own file listing leaves out names that start with a dot, but watched
trees need some of them (.env, .github, .circleci).  So the listing walks the
trees inside tasks, one root after the other, and the files are then read by
tasks of their own; both need the roots mounted on the executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, paths

LISTING = "repo_id string, file_path string, absolute_path string, at timestamp"
CHUNK = 2_000
CHUNK_BYTES = 32 << 20
_CLOSED = re.compile(r"(^|/)\.|(^|/)node_modules(/|$)|(^|/)dist(/|$)")
_OPEN = re.compile(r"/\.(github|circleci)(/|$)")


def _descends(folder: str) -> bool:
    """A folder that is itself ignored is not entered."""
    return bool(_OPEN.search(folder)) or not _CLOSED.search(folder)


def list_trees(roots: DataFrame) -> DataFrame:
    """Followed files below every root; ``roots`` has repo_id and root_path."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["repo_id", "file_path", "absolute_path", "at"]
        rows: list[tuple] = []
        for pdf in batches:
            for repo_id, root in zip(pdf["repo_id"], pdf["root_path"]):
                for folder, subs, files in os.walk(root):
                    inside = "/" + os.path.relpath(folder, root).replace(os.sep, "/") if folder != root else ""
                    subs[:] = sorted(s for s in subs if _descends(f"{inside}/{s}"))
                    for name in files:
                        full = os.path.join(folder, name)
                        changed = datetime.fromtimestamp(os.path.getmtime(full), timezone.utc)
                        rows.append((repo_id, f"{inside}/{name}"[1:], full, changed))
                    if len(rows) >= CHUNK:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    listed = roots.select("repo_id", "root_path").mapInPandas(walk, LISTING)
    kept = listed.filter(~paths.is_ignored(F.concat(F.lit("/"), "file_path")))
    return kept.withColumn("language", paths.language("file_path"))


def read_files(listing: DataFrame) -> DataFrame:
    """The whole text and content hash of every listed file."""
    cols = listing.columns
    ddl = ", ".join([*[f"{n} {t}" for n, t in listing.dtypes], "source string"])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size, start = [], 0, 0
            for i, path in enumerate(pdf["absolute_path"]):
                with open(path, encoding="utf-8", errors="replace", newline="") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pdf.iloc[start:i + 1].assign(source=held)
                    held, size, start = [], 0, i + 1
            if held:
                yield pdf.iloc[start:].assign(source=held)

    spread = listing.repartition("repo_id", "file_path")  # a big tree is read by many tasks
    return spread.select(*cols).mapInPandas(load, ddl).withColumn("hash", digests.code_hash("source"))


def read_tree(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """Every followed file of one tree with its text."""
    roots = spark.createDataFrame([(repo_id, root.rstrip("/"))], "repo_id string, root_path string")
    return read_files(list_trees(roots))
