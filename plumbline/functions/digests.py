"""Stable identities (survey section 1.6, F10, F11, F26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .numeric import col, finite, short_number

# fixed values: alert types that are suppressed by fingerprint
FINGERPRINTED_TYPES = ["ARCH_VIOLATION", "ARCH_EMBED_DRIFT", "ARCH_PRESSURE", "ENTROPY_DRIFT"]


def stable_id(value) -> Column:
    """First 32 hex digits of SHA-256 in 8-4-4-4-12 groups."""
    h = F.sha2(col(value), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, start, size) for start, size in cuts])


def code_hash(source) -> Column:
    return F.sha2(col(source), 256)


def normalized_hash(source) -> Column:
    return F.sha2(text.normalized_code(source), 256)


def tokens_hash(source) -> Column:
    """Order-free hash of the bag of tokens."""
    return F.sha2(F.array_join(F.array_sort(text.tokens(source)), "|"), 256)


def refactor_id(repo_id, kind, target) -> Column:
    return F.concat(
        F.lit("rfx_"), F.substring(F.sha1(F.concat_ws(":", col(repo_id), col(kind), col(target))), 1, 14)
    )


def timestamp_text(at) -> Column:
    """``2024-01-01 00:00:07.5+00``: no trailing zeros, UTC offset."""
    full = F.date_format(col(at).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(full, r"\.?0+$", ""), F.lit("+00"))


def alert_id(repo_id, sha, at, kind, title) -> Column:
    return F.md5(
        F.concat_ws("|", col(repo_id), F.coalesce(col(sha), F.lit("")), timestamp_text(at), col(kind), col(title))
    )


def random_id(prefix: str) -> Column:
    """Non-deterministic id, for sinks only."""
    return F.concat(F.lit(prefix + "_"), F.uuid())


def _json_text(value) -> Column:
    """A string column as a JSON literal, ``null`` when missing."""
    wrapped = F.to_json(F.struct(col(value).alias("v")))
    return F.when(col(value).isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    )


def _json_list(items) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def alert_fingerprint(alert: Column | None = None) -> Column:
    """SHA-256 of the canonical alert content.

    Expects columns repo_id, type, severity, title and an ``evidence`` struct.
    Keys are written in alphabetical order, lists sorted, scores to three
    places and the index readings that belong to the alert type to two.
    """
    ev = col("evidence")
    metrics = ev["metrics"]

    def reading(name):
        return short_number(finite(F.coalesce(metrics[name], F.lit(0.0))), 2)

    readings = (
        F.when(
            col("type") == "ENTROPY_DRIFT",
            F.concat(F.lit('{"entropyIndex":'), reading("code_entropy_index"),
                     F.lit(',"previousEntropyIndex":'), reading("previous_entropy_index"), F.lit("}")),
        )
        .when(
            col("type") == "ARCH_PRESSURE",
            F.concat(F.lit('{"pressureDelta24h":'), reading("pressure_delta_24h"),
                     F.lit(',"pressureIndex":'), reading("pressure_index"), F.lit("}")),
        )
        .otherwise(F.lit("null"))
    )

    def listed(name):
        items = F.array_sort(F.coalesce(ev[name], F.array().cast("array<string>")))
        return _json_list(F.transform(items, _json_text))

    near = F.array_sort(F.coalesce(ev["neighbours"], F.array().cast("array<struct<id:string,score:double>>")))
    near_json = _json_list(F.transform(
        near,
        lambda n: F.concat(F.lit('{"id":'), _json_text(n["id"]), F.lit(',"score":'), short_number(n["score"], 3), F.lit("}")),
    ))
    body = F.concat(
        F.lit('{"evidence":{"filePath":'), _json_text(ev["filePath"]),
        F.lit(',"graphEdgesAdded":'), listed("graphEdgesAdded"),
        F.lit(',"graphEdgesRemoved":'), listed("graphEdgesRemoved"),
        F.lit(',"metrics":'), readings,
        F.lit(',"module":'), _json_text(ev["module"]),
        F.lit(',"neighbours":'), near_json,
        F.lit(',"symbolId":'), _json_text(ev["symbolId"]),
        F.lit('},"repoId":'), _json_text("repo_id"),
        F.lit(',"severity":'), _json_text("severity"),
        F.lit(',"title":'), _json_text("title"),
        F.lit(',"type":'), _json_text("type"), F.lit("}"),
    )
    return F.sha2(body, 256)
