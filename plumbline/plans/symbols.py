"""Symbols and content alerts from source files (survey F4-F11, F19, R12, V8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests, heuristics, locate, paths, text, vectors


def extract(files: DataFrame) -> DataFrame:
    """One row per symbol of every parsed file.

    ``files`` has repo_id, file_path, source and optionally language,
    commit_sha, at and reported provenance.
    """
    lang = F.coalesce(F.col("language"), paths.fallback_language("file_path")) if "language" in files.columns else (
        F.coalesce(paths.language("file_path"), paths.fallback_language("file_path")))
    carried = [c for c in ("commit_sha", "at", "absolute_path", "reported_provenance") if c in files.columns]
    parsed = files.withColumn("language", lang).filter(F.col("language").isin(paths.PARSED_LANGUAGES))
    found = parsed.withColumn("_imports", text.imports("source")).withColumn(
        "_span", F.explode(locate.spans("language", "file_path", "source")))
    span = F.col("_span")
    python = F.col("language") == "python"
    body = F.substring(F.col("source"), span["start"] + 1, span["end"] - span["start"])
    body = F.when(python, F.regexp_replace(body, "\r\n", "\n")).otherwise(body)
    symbol_id = F.when(python, F.concat_ws(":", "file_path", span["name"], span["start_line"].cast("string"))).otherwise(
        F.concat_ws(":", F.col("file_path"), span["name"], span["start"].cast("string"), span["end"].cast("string")))
    named = found.select(
        "repo_id", "file_path", "language", *carried, symbol_id.alias("symbol_id"), span["kind"].alias("kind"),
        span["name"].alias("name"), span["start_line"].alias("start_line"), span["end_line"].alias("end_line"),
        F.col("_imports").alias("imports"), body.alias("body"))
    tag = text.provenance("body")
    if "reported_provenance" in carried:
        tag = text.merge_provenance(tag, "reported_provenance")
    return named.select(
        "*", digests.code_hash("body").alias("hash"), digests.normalized_hash("body").alias("norm_hash"),
        digests.tokens_hash("body").alias("tokens_hash"), paths.module_name("file_path").alias("module"),
        tag.alias("provenance"), text.calls("body").alias("calls"),
        F.concat(F.lit("inline://"), "file_path", F.lit("#"), "name").alias("text_ref"))


def embed(symbols: DataFrame, dimension: int = vectors.VECTOR_SIZE) -> DataFrame:
    """Vector rows of symbols with a stable point id."""
    return symbols.select(
        digests.stable_id("symbol_id").alias("id"), "repo_id", "module", "symbol_id", "file_path", "norm_hash", "provenance",
        vectors.hash_embed("body", dimension).alias("vector"))


def content_alerts(files: DataFrame) -> DataFrame:
    """Alerts for files outside the parsed languages.

    ``files`` has repo_id, file_path and source; the language comes from the
    path unless given.
    """
    lang = F.col("language") if "language" in files.columns else paths.language("file_path")
    checked = files.withColumn("language", F.coalesce(lang, F.lit("unknown"))).filter(
        ~F.col("language").isin(paths.PARSED_LANGUAGES))
    # generated, not projected: the filter below must not compute the rules a second time
    found = checked.select("*", F.explode(F.array(heuristics.drivers("language", "source"))).alias("drivers")).filter(F.size("drivers") > 0)
    listed = F.array_join("drivers", ", ")
    return found.drop("source").select(
        "*", heuristics.severity("drivers").alias("severity"), F.lit("CONTENT_HEURISTIC").alias("type"),
        F.concat(F.lit("Content rules matched in "), "file_path").alias("title"),
        heuristics.category("language", "drivers").alias("category"),
        F.concat(F.lit("Review unparsed file "), "file_path", F.lit(": "), listed, F.lit(".")).alias("recommendation"))
