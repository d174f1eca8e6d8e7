"""Exact nearest neighbours by cosine (survey V1-V6).

A group that fits in one block is compared as it is.  Larger groups go through
an index of pivots, about the square root of the rows: every vector belongs to
its nearest pivot, each pivot knows the nearest and the farthest of its vectors,
and neighbouring pivots form a segment of about a block.  A query first looks
into the segment it lies in, which gives a bound on its k-th score; by the triangle
inequality on the sphere only segments with a pivot whose ring reaches into the bound
are visited then.  Nothing is approximated: where vectors are so far apart that no ring
can be ruled out, all segments are visited.

One task compares one block of queries with one block of candidates by matrix
product and returns at most ``k`` rows per query, so no pair list is ever
formed and a group holding a third of all vectors is spread over many tasks.
A block of candidates has several segments, as many as a task may hold in single precision,
and a query is sent to a block once, with the segments it visits there.  On their way
vectors are packed without loss.  So what is stored and shuffled grows with the rows
times the blocks of a group, not times its segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialized

BLOCK_ROWS = 16_384
HELD_BYTES = 100_000_000  # of candidates in single precision that a task holds; a block of theirs has four times BLOCK_ROWS at most
PARTS = 4  # of a group's candidates, and of the queries of a block, while they are larger than BLOCK_ROWS
MOST_PIVOTS = 1024  # bound on what the driver reads: twice as many vectors
SLACK = 1e-9
SINGLE = T.ArrayType(T.FloatType())  # stays so on its way: a task widens it without loss
ANGLE_SLACK = 1e-6  # arc cosine near 1 loses half the digits
FEW = 4  # times k candidates of a row are scored exactly without a search for the k-th
SLAB = 1_000_000  # angles that a task holds at once
QUERY_ROWS = 512  # that a task compares at once
PRODUCTS = 4_000_000  # scores that a task holds at once
MOST_CANDIDATES = 8192  # that it compares at once
EXACT = 1_000_000  # numbers of the vectors that it scores exactly at once
KINDS = np.dtype("float32"), np.dtype("float64")


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _pack(v: np.ndarray) -> bytes:
    """A vector as bytes, without loss: all its numbers, or where that is shorter its distinct numbers, a bit for each place that is not 0 and a byte for the number there."""
    kind = KINDS.index(v.dtype)
    at = v != 0
    values, code = np.unique(np.ascontiguousarray(v[at]).view(f"u{v.itemsize}"), return_inverse=True)
    if len(values) > 256 or 7 + values.nbytes + -(-len(v) // 8) + len(code) >= v.nbytes:
        return bytes([kind]) + v.tobytes()
    return b"".join([bytes([kind + 2]), len(v).to_bytes(4, "little"), len(values).to_bytes(2, "little"), values.tobytes(), np.packbits(at).tobytes(), code.astype("u1").tobytes()])


def _unpack(b: bytes) -> np.ndarray:
    if b[0] < 2:
        return np.frombuffer(b, KINDS[b[0]], offset=1).astype("float64")
    kind, size, count = KINDS[b[0] - 2], int.from_bytes(b[1:5], "little"), int.from_bytes(b[5:7], "little")
    at = 7 + count * kind.itemsize
    marked = np.unpackbits(np.frombuffer(b, "u1", -(-size // 8), at), count=size).view(bool)
    out = np.zeros(size)
    out[marked] = np.frombuffer(b, kind, count, 7)[np.frombuffer(b, "u1", offset=at + -(-size // 8))]
    return out


def packed(vec: Column | str) -> Column:
    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        numbers, there = vectors.flatten().to_numpy(zero_copy_only=False), vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
        return pa.array([_pack(v) if known else None for v, known in zip(np.split(numbers, ends[:-1]), there)], pa.binary())

    return pack(vec)


def _matrix(vectors: Iterable) -> np.ndarray:
    return _unit(np.vstack([_unpack(v) if isinstance(v, (bytes, bytearray)) else np.asarray(v, dtype="float64") for v in vectors]))


class Rows:
    """Unit vectors of a block: in double precision only those asked for, unpacked when they are."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return self.all("float64", places)

    def all(self, kind: str, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Rows unpacked a few at a time."""
        vectors = self.vectors[places]
        out = np.zeros((len(vectors), 0), kind)
        for a in range(0, len(vectors), 1024):
            part = _matrix(vectors[a:a + 1024])
            out = out if a else np.empty((len(vectors), part.shape[1]), kind)
            out[a:a + 1024] = part
        return out


def _angles(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Angles between vectors and pivots; a vector without direction is at a right angle to all, as its score of 0 says."""
    return np.arccos(np.clip(_matrix(vectors) @ pivots.T, -1.0, 1.0))


def _slabs(vectors: pd.Series, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The angles of a bounded number of vectors at a time, with the rows they are of."""
    step = max(1, SLAB // max(1, len(pivots)))
    for a in range(0, len(vectors), step):
        yield slice(a, a + step), _angles(vectors.iloc[a:a + step], pivots)


def _same(mine: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every query's own id among the sorted ``ids``."""
    first, after = np.searchsorted(ids, mine, side="left"), np.searchsorted(ids, mine, side="right")
    times = after - first
    row = np.repeat(np.arange(len(mine)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


def _best(
    own: np.ndarray, cand: np.ndarray | Rows, rough: np.ndarray, k: int, floor: float | np.ndarray, without: tuple[np.ndarray, np.ndarray] | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and score of the best ``k`` candidates of each row; equal scores (to twelve places) by place.

    ``floor`` is the least score, of all rows or of each: a k-th score that is known already spares the search for one.
    The product in single precision only rules out: what lies within its error of the
    k-th score, and of the floor, is scored in double precision before places are given.
    """
    score = own.astype("float32") @ rough.T
    if without is not None:
        score[without] = -3.0
    error = np.float32(2e-7 * (own.shape[1] + 16))
    floor = np.broadcast_to(np.maximum(floor, -2.0), len(own))
    bound = (floor - error).astype("float32")
    over = score >= bound[:, None]
    hopeful = np.flatnonzero(np.count_nonzero(over, axis=1) > FEW * k) if k < score.shape[1] else []
    if len(hopeful):
        kth = np.partition(np.nan_to_num(score[hopeful], copy=False, nan=-3.0), score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        bound[hopeful] = np.maximum(bound[hopeful], kth - 2 * error)
        over[hopeful] = score[hopeful] >= bound[hopeful, None]
    row, place = np.divmod(np.flatnonzero(over), score.shape[1])
    del score, over
    named = np.zeros(len(rough), bool)
    named[place] = True
    there, nth = cand[np.flatnonzero(named)], np.cumsum(named) - 1
    exact = np.empty(len(row))
    step = max(1, EXACT // max(1, own.shape[1]))
    for a in range(0, len(row), step):  # a slab with many equal scores names many pairs
        cut = slice(a, a + step)
        exact[cut] = np.einsum("ij,ij->i", own[row[cut]], there[nth[place[cut]]])
    exact = np.round(np.clip(exact, -1.0, 1.0), 12)
    enough = exact >= floor[row]
    row, place, exact = row[enough], place[enough], exact[enough]
    order = np.lexsort((place, -exact, row))
    row, place, exact = row[order], place[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[nth < k], place[nth < k], exact[nth < k]


class PivotIndex:
    """Pivots, their segments and rings; small enough to be sent to every task."""

    def __init__(self, rows: DataFrame, total: int, block_rows: int, largest: int | None = None):
        wanted = min(MOST_PIVOTS, math.isqrt(total) + 1)
        share = F.lit(int(min(1.0, wanted / total) * (1 << 53)))
        chosen = rows.filter(F.shiftrightunsigned(F.xxhash64("_id", F.lit("pivot")), 11) <= share).select("_v").limit(2 * wanted).collect()
        self.pivots = _matrix([r["_v"] for r in chosen]) if chosen else np.zeros((0, 0))
        leaders = max(1, min(len(chosen), -(-2 * (largest or total) // block_rows)))
        self.segment = np.argmax(self.pivots @ self.pivots[:leaders].T, axis=1) if len(chosen) else np.zeros(0, np.int64)
        self.least = self.most = np.zeros(len(chosen))

    def place(self, vec: str) -> Column:
        """(pivot, segment, angle) of a vector."""
        pivots, segment = self.pivots, self.segment

        @F.pandas_udf("pivot int, segment int, angle double")
        def find(v: pd.Series) -> pd.DataFrame:
            if v.empty:
                return pd.DataFrame({"pivot": [], "segment": [], "angle": []})
            near, angle = np.empty(len(v), np.int64), np.empty(len(v))
            for rows, angles in _slabs(v, pivots):
                near[rows], angle[rows] = angles.argmin(axis=1), angles.min(axis=1)
            return pd.DataFrame({"pivot": near, "segment": segment[near], "angle": angle})

        return find(vec)

    def measure(self, placed: DataFrame) -> None:
        """Take the rings from the placed rows: at most a row a pivot reaches the driver."""
        rings = placed.groupBy("_at.pivot").agg(F.min("_at.angle").alias("a"), F.max("_at.angle").alias("b")).collect()
        self.least, self.most = np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        for r in rings:
            self.least[r["pivot"]], self.most[r["pivot"]] = r["a"], r["b"]

    def visits(self, vec: str, bound: str, home: str) -> Column:
        """The segments, but for the home, that may hold a vector whose score is not below the bound."""
        pivots, segment, least, most = self.pivots, self.segment, self.least, self.most

        @F.pandas_udf("array<int>")
        def find(v: pd.Series, score: pd.Series, own: pd.Series) -> pd.Series:
            if v.empty:
                return pd.Series([], dtype=object)
            reach, homes, found = np.arccos(np.clip(score.to_numpy(dtype="float64") - SLACK, -1.0, 1.0))[:, None] + ANGLE_SLACK, own.to_numpy(), []
            for rows, angles in _slabs(v, pivots):
                near = (angles - most <= reach[rows]) & (least - angles <= reach[rows])
                found += [np.setdiff1d(segment[row], [at]).tolist() for row, at in zip(near, homes[rows])]
            return pd.Series(found)

        return find(vec, bound, home)


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, *, id: str, vec: str, group: list[str],
    min_score: float | None = None, include_self: bool = False, mark: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` candidates of the same group for every query.

    Returns the group columns, ``query_id``, ``neighbour_id``, ``score`` and
    ``rank`` (ties by id).  ``mark`` names a column to carry along; both its
    values are returned as ``query_mark`` and ``neighbour_mark``.  The vectors
    are computed once and kept in the shared folder.
    """
    g = [f"_g{i}" for i in range(len(group))]
    carried = F.col(mark).cast("string") if mark else F.lit(None).cast("string")
    floor = -2.0 if min_score is None else min_score

    def side(df: DataFrame, name: str) -> DataFrame:
        return materialized(df.select(
            *[F.col(c).alias(n) for c, n in zip(group, g)], F.col(id).cast("string").alias("_id"),
            packed(vec if df.schema[vec].dataType == SINGLE else F.col(vec).cast("array<double>")).alias("_v"), carried.alias("_m"),
        ), name)

    c = side(corpus, "candidates")
    q = c.select(*[F.col(n).alias(n) for n in c.columns]) if queries is corpus else side(queries, "queries")
    total = c.count()
    w = Window.partitionBy(*g, "query_id").orderBy(F.col("score").desc(), F.col("neighbour_id"))
    sizes = c.groupBy(*g).agg(F.count(F.lit(1)).alias("_size"))
    largest = total if total <= block_rows else sizes.agg(F.max("_size")).first()[0]
    if largest <= block_rows:
        home = F.lit(0).alias("_cell")
        best = _compare(q.select("*", F.array(home).alias("_visits")), Blocks(c.select("*", home), g), k, floor, include_self, block_rows)
    else:
        index = PivotIndex(c, total, block_rows, largest)
        held = max(block_rows, min(-(-largest // PARTS), 4 * block_rows, HELD_BYTES // (4 * max(1, index.pivots.shape[1]))))
        large = materialized(sizes.filter(F.col("_size") > block_rows).select(*g, F.lit(True).alias("_large")), "large")

        def placed(df: DataFrame, name: str) -> DataFrame:
            """Small groups are one cell, the segments of large ones a cell each."""
            known = df.join(large, g, "left").withColumn("_at", F.when(F.col("_large"), index.place("_v")))
            return materialized(known.withColumn("_cell", F.coalesce("_at.segment", F.lit(0))), name)

        cells = placed(c, "placed")
        asked = cells.select(*[F.col(n).alias(n) for n in cells.columns]) if queries is corpus else placed(q, "placed_queries")
        index.measure(cells.filter("_large"))
        blocks = Blocks(cells.drop("_at", "_large"), g, held)
        first = _compare(asked.select(*g, "_id", "_v", "_m", F.array("_cell").alias("_visits")), blocks, k, floor, include_self, block_rows)
        first = materialized(first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank"), "home_neighbours")
        bounds = first.groupBy(*g, F.col("query_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
        bounded = asked.filter("_large").join(bounds, [*g, "_id"], "left").withColumn(
            "_bound", F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(max(floor, -1.0))))
        bounded = materialized(bounded.select(*g, "_id", "_v", "_m", "_bound", index.visits("_v", "_bound", "_cell").alias("_visits")), "bounded")
        best = first.unionByName(_compare(bounded, blocks, k, floor, include_self, block_rows))
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    extra = ["query_mark", "neighbour_mark"] if mark else []
    return ranked.select(*[F.col(n).alias(o) for n, o in zip(g, group)], "query_id", "neighbour_id", "score", "rank", *extra)


class Blocks:
    """Candidates dealt out in blocks of about ``held`` rows: the cells of a group stand in a line that is cut evenly, so a block has several cells or a part of one.

    The sizes are stored, so joins with them need no shuffle of the vectors.  Without ``held`` a group is one cell and one block.
    """

    def __init__(self, c: DataFrame, g: list[str], held: int | None = None):
        self.g, self.held = g, held
        if held is None:
            self.rows = c.withColumn("_cb", F.lit(0))
            return
        cell = [*g, "_cell"]
        before = Window.partitionBy(*g).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        line = c.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        line = materialized(line, "cells")
        at = lambda place: F.floor((F.col("_from") + place) / held).cast("int")
        self.rows = c.join(line, cell).withColumn("_cb", at(F.pmod(F.xxhash64("_id"), F.col("_n")))).drop("_n", "_from")
        self.cells = materialized(line.select(*cell, F.explode(F.sequence(at(F.lit(0)), at(F.col("_n") - 1))).alias("_cb")).groupBy(
            *g, "_cb").agg(F.collect_list("_cell").alias("_has")), "blocks")


def _pairs(left: pd.DataFrame, right: pd.DataFrame, k: int, floor: float, include_self: bool) -> pd.DataFrame:
    """The best ``k`` candidates of a block for each of the queries, among the cells it visits."""
    right = right.sort_values("_id")
    copies = k + right["_id"].value_counts(dropna=False).max()  # of equal vectors, more are never among the best k after a query's own id
    right = right[right.groupby("_v", dropna=False, sort=False).cumcount() < copies]
    by_id = right["_id"].to_numpy()
    turn = np.argsort(right["_cell"].to_numpy(), kind="stable")  # of a place, which id in order is there
    right = right.iloc[turn]
    ids, marks, cand = right["_id"].to_numpy(), right["_m"].to_numpy(), Rows(right["_v"].to_numpy())
    rough = cand.all("float32")
    cells, start = np.unique(right["_cell"].to_numpy(), return_index=True)
    spans = list(zip(start, [*start[1:], len(ids)]))
    mine, vectors, own_marks = left["_id"].to_numpy(), left["_v"].to_numpy(), left["_m"].to_numpy()
    bounds = left["_bound"].to_numpy() if "_bound" in left else np.full(len(left), floor)
    visited = np.zeros((len(left), len(cells)), bool)
    wanted = np.concatenate(left["_cells"].to_numpy())
    nth = np.searchsorted(cells, wanted)
    known = cells[np.minimum(nth, len(cells) - 1)] == wanted  # a cell on the edge of the block may have no row in it
    visited[np.repeat(np.arange(len(left)), left["_cells"].str.len())[known], nth[known]] = True
    own_row, own_place = (np.zeros(0, np.int64),) * 2 if include_self else _same(mine, by_id)
    own_place = np.argsort(turn)[own_place]
    found = []
    for a in range(0, len(left), QUERY_ROWS):
        own, bound = _matrix(vectors[a:a + QUERY_ROWS]), bounds[a:a + QUERY_ROWS].copy()
        here = (own_row >= a) & (own_row < a + QUERY_ROWS)
        self_row, self_place = own_row[here] - a, own_place[here]
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for nth, (first, last) in enumerate(spans):
            some = np.flatnonzero(visited[a:a + QUERY_ROWS, nth])
            if not len(some):
                continue
            within = np.full(len(own), -1)
            within[some] = np.arange(len(some))
            step = max(1, min(MOST_CANDIDATES, PRODUCTS // len(some)))
            for i in range(first, last, step):
                j = min(last, i + step)
                own_here = (self_place >= i) & (self_place < j) & (within[self_row] >= 0)
                row, place, score = _best(
                    own[some], Rows(cand.vectors[i:j]), rough[i:j], k, bound[some], None if include_self else (within[self_row[own_here]], self_place[own_here] - i))
                if not len(row):
                    continue
                row, place, score = (np.concatenate(x) for x in zip(best, (some[row], place + i, score)))
                order = np.lexsort((turn[place], -score, row))
                row, place, score = row[order], place[order], score[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                bound[row[rank == k - 1]] = score[rank == k - 1]
                best = row[rank < k], place[rank < k], score[rank < k]
        row, place, score = best
        found.append(pd.DataFrame({
            "query_id": mine[a + row], "neighbour_id": ids[place], "score": score,
            "query_mark": own_marks[a + row], "neighbour_mark": marks[place]}))
    return pd.concat(found)


def _compare(q: DataFrame, blocks: Blocks, k: int, floor: float, include_self: bool, block_rows: int) -> DataFrame:
    """The best ``k`` of every query among the cells of ``_visits``, a row a block at most, or those not below a ``_bound`` that the queries have."""
    g = blocks.g
    out_cols = [*g, "query_id", "neighbour_id", "score", "query_mark", "neighbour_mark"]
    types = dict(q.dtypes)
    schema = ", ".join([*[f"{n} {types[n]}" for n in g], "query_id string, neighbour_id string, score double",
                        "query_mark string, neighbour_mark string"])
    if blocks.held is None:
        q = q.withColumn("_cb", F.lit(0)).withColumnRenamed("_visits", "_cells")
    else:
        q = q.join(blocks.cells, g).withColumn("_cells", F.array_intersect("_visits", "_has")).drop("_visits", "_has").filter(F.size("_cells") > 0)
    asked = F.col("_asked")
    parts = F.greatest(F.least(F.ceil(asked / block_rows), F.lit(PARTS)), F.ceil(asked / (2 * (blocks.held or block_rows)))).cast("int")
    parts = q.groupBy(*g, "_cb").agg(F.count(F.lit(1)).alias("_asked")).select(*g, "_cb", parts.alias("_parts"))
    if blocks.held is not None:
        parts = materialized(parts, "parts")
    pair = [*g, "_cb", "_qb"]
    q = q.join(parts, [*g, "_cb"]).withColumn("_qb", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")
    c = blocks.rows.join(parts, [*g, "_cb"]).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    if blocks.held is not None:  # few pairs of blocks with much work each, which by their bytes would go to few tasks
        tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1000, 4 * (parts.agg(F.sum("_parts")).first()[0] or 0)))
        q, c = q.repartition(tasks, *pair), c.repartition(tasks, *pair)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=out_cols)
        out = _pairs(left, right, k, floor, include_self)
        for n in g:
            out[n] = left[n].iloc[0]
        return out[out_cols]

    return q.groupBy(*pair).cogroup(c.groupBy(*pair)).applyInPandas(compare, schema)


def nearest(corpus: DataFrame, query: Column, vec: str, k: int, *ties: str) -> DataFrame:
    """Top ``k`` rows of a collection for one vector (survey V3-V6).

    ``query`` is usually a scalar subquery for a stored vector: it is read
    once, the collection is scanned once, and only ``k`` rows per task are kept.
    """
    from ..functions.vectors import cosine

    scored = corpus.withColumn("_query", query).filter(F.col("_query").isNotNull())
    scored = scored.withColumn("score", cosine(vec, "_query")).drop("_query")
    return scored.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), *ties).limit(k)
