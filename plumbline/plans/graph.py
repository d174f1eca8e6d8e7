"""Dependency edges, rule violations and call edges (survey J12, J13, S17, U1, U2, X7, R7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators.edges import bucket_entropy, edge_diff, target_of

# fixed values: the layer rule
RULE_SOURCE, RULE_TARGETS = "src/domain/", ["src/web/", "src/infra/"]
RULE_NAME = "domain must not import web or infra"


def import_edges(files: DataFrame) -> DataFrame:
    """File to import target edges (one row per distinct target).

    ``files`` has repo_id, file_path and either ``imports`` or ``source``.
    """
    found = F.col("imports") if "imports" in files.columns else text.imports("source")
    spread = files.select("repo_id", "file_path", F.explode(found).alias("specifier"))
    target = paths.import_target("file_path", "specifier")
    return spread.select("repo_id", "file_path", target.alias("t")).select(
        "repo_id", "file_path", F.col("t.kind").alias("target_kind"), F.col("t.id").alias("target")).distinct()


def module_edges(imports: DataFrame) -> DataFrame:
    """Module edges of each file: ``a->b`` inside, ``a->pkg:name`` outside."""
    source = paths.module_name("file_path")
    label = F.when(F.col("target_kind") == "Package", F.concat(F.lit("pkg:"), "target")).otherwise(
        paths.module_name("target"))
    return imports.select(
        "repo_id", "file_path", source.alias("module"), F.concat(source, F.lit("->"), label).alias("edge")).distinct()


def current_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges of each module over all its files."""
    return edges.select("repo_id", "module", "edge").distinct()


def file_edge_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Edges each file gained or lost."""
    return edge_diff(previous, current, ["repo_id", "module", "file_path"])


def module_dependencies(edges: DataFrame) -> DataFrame:
    """Per module: dependency entropy, edge count and external edge count (M1)."""
    rows = current_edges(edges).withColumn("target", target_of("edge"))
    spread = bucket_entropy(rows, ["repo_id", "module"], "target")
    counts = rows.groupBy("repo_id", "module").agg(
        F.count(F.lit(1)).alias("dependency_count"),
        F.count_if(F.col("target").startswith("pkg:")).alias("external_count"))
    return counts.join(spread.select("repo_id", "module", F.col("entropy").alias("dependency_entropy")),
                       ["repo_id", "module"])


def breaks_layer_rule(source, target) -> Column:
    return F.col(source).startswith(RULE_SOURCE) & paths.any_of([F.col(target).startswith(t) for t in RULE_TARGETS])


def layer_violations(imports: DataFrame) -> DataFrame:
    """Imports that break the layer rule.

    Both file names are in the edge, so no join to the node table is needed.
    """
    files = imports.filter(F.col("target_kind") == "File")
    return files.filter(breaks_layer_rule("file_path", "target")).select(
        "repo_id", F.col("file_path").alias("source_path"), F.col("target").alias("target_path"),
        F.lit(RULE_NAME).alias("rule"), F.lit("error").alias("severity"),
        F.concat("file_path", F.lit(" -> "), "target").alias("edge"))


def call_edges(symbols: DataFrame) -> DataFrame:
    """Calls between symbols of one file; the last symbol of a name is the target.

    ``symbols`` has repo_id, file_path, symbol_id, name, start_line, calls.
    """
    definition = F.struct(F.col("name").alias("name"), F.lit(None).cast("string").alias("source_id"),
                          F.struct("start_line", "symbol_id").alias("target"))
    none = F.lit(None).cast("struct<start_line:int,symbol_id:string>")
    uses = F.transform(F.array_distinct("calls"), lambda c: F.struct(
        c.alias("name"), F.col("symbol_id").alias("source_id"), none.alias("target")))
    # definitions and uses of a name meet in one group of one file: one pass, one shuffle
    rows = symbols.select("repo_id", "file_path", F.inline(F.concat(F.array(definition), uses)))
    same_name = Window.partitionBy("repo_id", "file_path", "name")
    met = rows.withColumn("_t", F.max("target").over(same_name)["symbol_id"])
    return met.filter(F.col("source_id").isNotNull() & (F.col("_t") != F.col("source_id"))).select(
        "repo_id", "file_path", "source_id", F.col("_t").alias("target_id")).distinct()


def graph_nodes(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Repo, File, Module, Symbol and Package nodes of the property graph."""
    repo = imports.select("repo_id", F.lit("Repo").alias("label"), F.col("repo_id").alias("id"))
    file = imports.select("repo_id", F.lit("File").alias("label"), F.col("file_path").alias("id"))
    seen = imports.select("repo_id", F.col("target_kind").alias("label"), F.col("target").alias("id"))
    module = imports.select("repo_id", F.lit("Module").alias("label"), paths.module_name("file_path").alias("id"))
    symbol = symbols.select("repo_id", F.lit("Symbol").alias("label"), F.col("symbol_id").alias("id"))
    out = repo
    for part in (file, seen, module, symbol):
        out = out.unionByName(part)
    return out.distinct()


def graph_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """IMPORTS, CONTAINS, DEFINES, BELONGS_TO and CALLS edges.

    ``symbols`` is read for two branches; pass a stored table when it comes
    from parsing.
    """
    module = paths.module_name("file_path")
    edge = lambda rel, src, dst: F.struct(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))
    path, target, symbol = F.col("file_path"), F.col("target"), F.col("symbol_id")
    files = imports.select("repo_id", F.inline(F.array(edge("IMPORTS", path, target), edge("CONTAINS", module, path))))
    defined = symbols.select("repo_id", F.inline(F.array(edge("DEFINES", path, symbol), edge("BELONGS_TO", symbol, module))))
    called = call_edges(symbols).select("repo_id", F.lit("CALLS").alias("rel"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return files.unionByName(defined).unionByName(called).distinct()


def replace_files(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges with those of re-read files replaced by their new ones."""
    touched = fresh.select("repo_id", "file_path").distinct()
    return stored.join(touched, ["repo_id", "file_path"], "left_anti").unionByName(fresh)
