"""Exact top-k search by inner product over a bit-sliced index.

Every attribute is quantised to an integer.  A block of rows is indexed by
slices: bitmap (d, b) has a bit per row, set where bit b of the row's attribute
d (less the block's least value) is set.  A query's scores of all rows of a
block are a bit-sliced number again: for every set bit c of the query's
attribute d, the slices of d are added at weight b + c.  Bitmaps of one weight
are summed by carry-save adders (three become one, and one of the next
weight), so a score costs bitmap operations only.  A negative query attribute
adds the complements of the slices instead, which differs by a constant.

Of the sum, rows are selected from the most significant slice downward: rows
whose slice is set are in as long as they are at most k, else the search goes
on among them.  What is left over shares the last place; of these boundary
rows the smaller ids are taken.

Queries (a stated subset) go against all rows in blocks: each block of queries
meets each block of the index once, in whichever task holds the pair, and gives
at most k rows a query.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part, nor do rows with a null id; rows with the query's id are the
query's own; rows of equal id that differ are candidates of others each, and
queries of their own; equal rows are one query; only vectors of equal length are
compared, those without components score 0; components beyond +-2**62 after
quantising count as that, scores beyond 64 bits as the largest number;
ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

BLOCK_ROWS = 65_536
QUERY_ROWS = 256
LIMIT = float(1 << 62)


def usable(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): rows that take part, quantised."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * scale, F.lit(-LIMIT)), F.lit(LIMIT))))
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.where(~odd).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slices[d, b], least[d]) of a matrix of rows x attributes; a slice is 64 rows a word."""
    n, dims = values.shape
    least = values.min(axis=0)
    raised = (values - least).astype(np.uint64)
    bits = int(raised.max()).bit_length() if raised.size else 0
    words = -(-n // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    for b in range(bits):
        plane = np.zeros((words * 64, dims), bool)
        plane[:n] = (raised >> np.uint64(b)) & np.uint64(1)
        out[:, b] = np.packbits(np.ascontiguousarray(plane.T), axis=1, bitorder="little").view(np.uint64)
    return out, least


def added(slices: np.ndarray, query: list[int]) -> list[np.ndarray]:
    """The bit-sliced sum of |q| * (attribute, or its complement where q is negative), least significant first."""
    dims, bits, words = slices.shape
    levels: list[list[np.ndarray]] = []
    for d in range(dims):
        q = query[d]
        weight, size = 0, abs(q)
        while size:
            if size & 1:
                while len(levels) < weight + bits:
                    levels.append([])
                for b in range(bits):
                    levels[weight + b].append(slices[d, b] if q > 0 else ~slices[d, b])
            size, weight = size >> 1, weight + 1
    sums, at = [], 0
    while at < len(levels):
        maps = levels[at]
        while len(maps) > 1:
            x, y = maps.pop(), maps.pop()
            z = maps.pop() if maps else None
            half = x ^ y
            carry = x & y
            if z is not None:
                carry |= half & z
                half = half ^ z
            maps.insert(0, half)
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(carry)
        sums.append(maps[0] if maps else np.zeros(words, np.uint64))
        at += 1
    return sums


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def selected(sums: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest among the rows of a bitmap; positions are in order of id, so ties go to the first."""
    sure, open_ = np.zeros_like(rows), rows
    for plane in reversed(sums):
        inside = sure | (open_ & plane)
        n = _count(inside)
        if n > k:
            open_ = open_ & plane
        else:
            sure = inside
            open_ = open_ & ~plane
            if n == k:
                return _rows(sure)
    return np.concatenate([_rows(sure), _rows(open_)[: k - _count(sure)]])


def search_block(index: pd.Series, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best rows of one block for every query: places of queries, ids of rows, and scores."""
    ids = np.frombuffer(index["ids"], np.int64)
    least = np.frombuffer(index["least"], np.int64)
    dims, words = len(least), -(-len(ids) // 64)
    slices = np.frombuffer(index["slices"], np.uint64)
    slices = slices.reshape(dims, len(slices) // max(dims * words, 1), words)
    everyone = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    top = (1 << slices.shape[1]) - 1
    out = ([], [], [])
    for place, (query_id, query) in enumerate(zip(query_ids.tolist(), queries.tolist())):
        sums = added(slices, query)
        rows = everyone
        for own in np.flatnonzero(ids == query_id):
            rows = rows.copy()
            rows[own // 64] &= ~np.uint64(1 << (int(own) % 64))
        shift = sum(q * int(m) for q, m in zip(query, least)) + sum(q * top for q in query if q < 0)
        for at in selected(sums, rows, k).tolist():
            bits = sum(((int(plane[at // 64]) >> (at % 64)) & 1) << weight for weight, plane in enumerate(sums))
            out[0].append(place)
            out[1].append(int(ids[at]))
            out[2].append(min(max(bits + shift, -(1 << 63)), (1 << 63) - 1))
    return out


def top_scores(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner product, for every query."""
    spark = rows.sparkSession
    small_batches(spark)
    rows, asked = usable(rows, key, vector, scale), usable(queries, key, vector, scale).distinct()
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    asked_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    dealt = lambda df, n: df.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).alias("block"), "id", "v")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        values = np.array(group["v"].tolist(), np.int64).reshape(len(group), int(group["dims"].iloc[0]))
        slices, least = slices_of(values)
        return pd.DataFrame([{"dims": group["dims"].iloc[0], "block": group["block"].iloc[0], "ids": group["id"].to_numpy(np.int64).tobytes(),
                              "least": least.tobytes(), "slices": slices.tobytes()}])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        values = np.array(group["v"].tolist(), np.int64).reshape(len(group), int(group["dims"].iloc[0]))
        return pd.DataFrame([{"dims": group["dims"].iloc[0], "query_ids": group["id"].to_numpy(np.int64).tobytes(),
                              "query_keys": group["key"].to_numpy(np.int64).tobytes(), "queries": values.tobytes()}])

    index = dealt(rows, blocks).groupBy("dims", "block").applyInPandas(build, "dims int, block long, ids binary, least binary, slices binary")
    packed = dealt(asked, asked_blocks).withColumn("key", F.xxhash64("v")).groupBy("dims", "block").applyInPandas(pack, "dims int, query_ids binary, query_keys binary, queries binary")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    places = min(2 * blocks, 20_000)  # a number of its own, since few small rows mean much work
    pairs = index.repartition(places, "dims", "block").join(packed.repartition(places, "dims", "block"), ["dims", "block"])

    def search(batches):
        for frame in batches:
            for _, pair in frame.iterrows():
                ids = np.frombuffer(pair["query_ids"], np.int64)
                keys = np.frombuffer(pair["query_keys"], np.int64)
                places, vec_ids, scores = search_block(pair, ids, np.frombuffer(pair["queries"], np.int64).reshape(len(ids), int(pair["dims"])), k)
                yield pd.DataFrame({"query_id": ids[np.array(places, np.int64)], "query_key": keys[np.array(places, np.int64)], "vec_id": vec_ids, "score": scores}).astype("int64")

    found = pairs.mapInPandas(search, "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    return top_scores(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
