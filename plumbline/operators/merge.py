"""Upserts, guarded inserts, replacement and cascading deletes (survey S9-S15, S18, J11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import target_of
from .versioned import Versions


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The table with its changed rows replaced; later changes beat earlier ones.

    The table holds one row per key.  Only the changes are reduced; where they
    are small, Spark sends their keys to the table, which is then not shuffled.
    """
    cols = base.columns
    rest = [c for c in cols if c not in keys]
    order = F.struct(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(version)])
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    last = last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in cols])
    changed = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return base.join(changed, same, "left_anti").unionByName(last)


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first per key that the table does not hold yet."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])).alias("_row"))
    fresh = first.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])
    same = [fresh[k].eqNullSafe(base[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return fresh.join(base, condition, "left_anti")


def replace_keeping(
    new: DataFrame, old: DataFrame, keys: list[str], column: str, kept_values: list[str],
) -> DataFrame:
    """Replace a set of rows but keep an old row's value of ``column`` when it is one of
    ``kept_values``; old rows without a successor disappear."""
    before = old.select(*keys, F.col(column).alias("_before"))
    joined = new.join(before, keys, "left")
    kept = F.when(F.col("_before").isin(kept_values), F.col("_before")).otherwise(F.col(column))
    return joined.select(*[kept.alias(c) if c == column else F.col(c) for c in new.columns])


def delete_for(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed keys."""
    gone = doomed.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def orphans(nodes: DataFrame, edges: DataFrame, node_key: str, edge_key: str) -> DataFrame:
    """Nodes no edge points to."""
    return nodes.join(edges.select(F.col(edge_key).alias(node_key)).distinct(), node_key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], doomed: DataFrame, key: str, edges: str, edge: str, store: Versions) -> int:
    """Take the doomed keys out of every table, and targets that lose their last edge out of the graph, as one version.

    The table named ``edges`` holds the graph; its remaining targets are
    published as ``nodes``.
    """
    kept = delete_for(tables, doomed, key)
    kept["nodes"] = kept[edges].select(target_of(edge).alias("node")).distinct()
    return store.publish(kept)


def fold_filters(pairs) -> Column:
    """AND of the conditions whose parameter was given (survey P2)."""
    out = F.lit(True)
    for value, condition in pairs:
        if value is not None:
            out = out & condition(value)
    return out


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the given, non-null fields of a change written over the stored ones."""
    fields = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = base.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])
