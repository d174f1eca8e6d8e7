"""Keep rows spaced at least a gap apart (survey X1, X2, X3, X4, X12).

The greedy rule (keep a row when the last *kept* row of its key is a full gap
ago) is a chain, not a lag filter.  The chain is cut into time chunks:

1. rows of one key and millisecond collapse to the earliest before any shuffle, so a
   (key, chunk) group has a fixed upper size whatever the key's share;
2. every chunk computes, on its own, which last-kept time it would leave
   behind for each time that could have been kept before it;
3. those small step functions are chained per key in time order;
4. every chunk replays its rows from its true start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import HOUR, asof_join

NEVER = -(1 << 62)


def _next_kept(t: np.ndarray, forced: np.ndarray, gap: int) -> np.ndarray:
    """Index of the row kept after each row, ``len(t)`` when none is."""
    n = len(t)
    after = np.searchsorted(t, t + gap, side="left")
    must = np.flatnonzero(forced)
    if len(must):
        at = np.searchsorted(must, np.arange(n), side="right")
        nearest = np.where(at < len(must), must[np.minimum(at, len(must) - 1)], n)
        after = np.minimum(after, nearest)
    return after


def _step_function(t: np.ndarray, forced: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """Times up to which an entry threshold leads to the same last-kept time."""
    n = len(t)
    if n == 1:
        return [(1 << 62) if forced[0] else int(t[0])], [int(t[0])]
    nxt = _next_kept(t, forced, gap)
    end = np.where(nxt < n, nxt, np.arange(n))
    while True:  # path doubling to the last kept row of each chain
        jumped = end[end]
        if (jumped == end).all():
            break
        end = jumped
    exits = t[end]
    must = np.flatnonzero(forced)
    last_start = must[0] if len(must) else n - 1  # an entry never passes a forced row
    exits = exits[: last_start + 1]
    times = t[: last_start + 1].copy()
    if len(must):
        times[-1] = (1 << 62)
    edge = np.append(np.flatnonzero(np.diff(exits)), len(exits) - 1)
    return times[edge].tolist(), exits[edge].tolist()


def _numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of each key numbered from 1 (``_i``), together and in order, for a walk over the batches of a partition.

    A window asks for its keys to be together; a plain ``repartition`` after a join does
    not: adaptive execution may turn the join into a broadcast one and read its shuffle locally.
    """
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def keep_spaced(
    df: DataFrame, keys: list[str], at: str, gap_ms: int, *, tie: str, forced: str | None = None,
    chunk_ms: int = HOUR // 1000,
) -> DataFrame:
    """Rows the greedy rule keeps; ``forced`` rows are kept and restart the gap.

    Gaps are whole milliseconds, the order is that of the times themselves: of the
    rows sharing a key and millisecond every forced one is kept, and of the others
    only the earliest can be (at equal times a forced one comes first, then ``tie`` decides).
    Rows without a time are left out.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    ms = F.floor(us / 1000).cast("bigint")
    force = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    cols = df.columns
    tagged = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, k in enumerate(keys)],
                       ms.alias("_ms"), us.alias("_us"), force.alias("_force"), F.struct(*cols).alias("_row")).filter(F.col("_ms").isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    order = F.struct("_us", ~F.col("_force"), F.col("_row")[tie])
    one = tagged.groupBy(*names, "_ms").agg(
        F.max("_force").alias("_force"), F.min_by(F.struct("_row", "_force"), order).alias("_first"),
    ).withColumn("_chunk", F.floor(F.col("_ms") / chunk_ms).cast("bigint"))
    placed = _numbered(one, [*names, "_chunk"], "_ms")
    key_fields = [T.StructField(n, T.StringType()) for n in names]

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times, musts = None, [], []  # rows of the chunk being read; bounded by its length

        def closed():
            until, left = _step_function(np.asarray(times, dtype="int64"), np.asarray(musts, dtype=bool), gap_ms)
            return [*key, until, left]

        for pdf in batches:
            out = []
            heads = pdf[[*names, "_chunk"]].itertuples(index=False, name=None)
            for i, head, t, must in zip(pdf["_i"], heads, pdf["_ms"], pdf["_force"]):
                if i == 1:
                    if key is not None:
                        out.append(closed())
                    key, times, musts = head, [], []
                times.append(t)
                musts.append(must)
            if out:
                yield pd.DataFrame(out, columns=[*names, "_chunk", "_until", "_left"])
        if key is not None:
            yield pd.DataFrame([closed()], columns=[*names, "_chunk", "_until", "_left"])

    steps = placed.select(*names, "_chunk", "_ms", "_force", "_i").mapInPandas(
        summarize,
        T.StructType([*key_fields, T.StructField("_chunk", T.LongType()),
                      T.StructField("_until", T.ArrayType(T.LongType())),
                      T.StructField("_left", T.ArrayType(T.LongType()))]),
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = NEVER
        for pdf in batches:
            entry = []
            for n, until, left in zip(pdf["_i"], pdf["_until"], pdf["_left"]):
                if n == 1:
                    last = NEVER
                entry.append(last)
                i = int(np.searchsorted(until, last + gap_ms, side="left"))
                if i < len(left):
                    last = int(left[i])
            yield pdf[[*names, "_chunk"]].assign(_entry=entry)

    entries = (
        _numbered(steps, names, "_chunk")
        .mapInPandas(chain, T.StructType([*key_fields, T.StructField("_chunk", T.LongType()),
                                          T.StructField("_entry", T.LongType())]))
    )

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = NEVER
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (n, t, must, entry) in enumerate(zip(pdf["_i"], pdf["_ms"], pdf["_force"], pdf["_entry"])):
                if n == 1:
                    last = entry
                keep[i] = t >= last + gap_ms
                if must or keep[i]:
                    last = t
            yield pdf.loc[keep, [*names, "_ms"]]

    kept = (
        _numbered(one.select(*names, "_chunk", "_ms", "_force").join(entries, [*names, "_chunk"]), [*names, "_chunk"], "_ms")
        .mapInPandas(replay, T.StructType([*key_fields, T.StructField("_ms", T.LongType())]))
    )
    earliest = one.filter(~F.col("_first._force")).join(kept, [*names, "_ms"], "left_semi").select("_first._row.*")
    if forced is None:
        return earliest
    return earliest.unionByName(tagged.filter("_force").select("_row.*"))


def quiet_before(df: DataFrame, keys: list[str], at: str, gap_us: int) -> DataFrame:
    """Rows with no earlier row of their key within the gap (sliding throttle, X2)."""
    looked = asof_join(df, df.select(*keys, at), keys, at, at, [], name="_prev", strict=True)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    prev = F.unix_micros(F.col("_prev")[at].cast("timestamp"))
    return looked.filter(prev.isNull() | (t - prev >= gap_us)).drop("_prev")


def quiet_after(df: DataFrame, keys: list[str], at: str, gap: str, tie: str) -> DataFrame:
    """The last row of every burst (trailing debounce, X4)."""
    keep = F.struct(*df.columns)
    burst = df.groupBy(*keys, F.session_window(F.col(at), gap).alias("_burst")).agg(
        F.max_by(keep, F.struct(F.col(at), F.col(tie))).alias("_row"),
        F.count(F.lit(1)).alias("burst_size"),
    )
    return burst.select("_row.*", "burst_size", F.col("_burst.end").alias("fires_at"))


def coalesced(df: DataFrame, keys: list[str], at: str, gap_ms: int = 120, *, tie: str) -> DataFrame:
    """One refresh per window that an event opens (leading window, X12): keys, ``tie`` of that event, absorbed, fires_at.

    An event outside any window of its key schedules a refresh a gap later;
    events before that are absorbed by it, ``absorbed`` counts them.  Times
    are whole milliseconds.  Rows without a time schedule nothing.
    """
    ms = F.timestamp_millis(F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("bigint"))
    rows = df.filter(F.col(at).isNotNull()).select(*keys, tie, at)
    opened = keep_spaced(rows, keys, at, gap_ms, tie=tie).withColumn(at, ms)
    looked = asof_join(rows.select(*keys, ms.alias(at)), opened, keys, at, at, [tie], name="_by")
    out = looked.groupBy(*keys, F.col("_by")[tie].alias(tie), F.col("_by")[at].alias("_opened")).agg(
        (F.count(F.lit(1)) - 1).alias("absorbed"))
    return out.select(*keys, tie, "absorbed", F.timestamp_micros(F.unix_micros("_opened") + gap_ms * 1000).alias("fires_at"))
