"""Vector expressions (survey F18, M17-M19, M24, M25, V7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import col, finite, fixed, fixed_text

# --- fixed values: features compared, with the scale that counts as "far" ----
MODULE_FEATURES = [
    ("module_dependency_count", "fan-out", 4.0),
    ("external_dependency_ratio", "external dependency ratio", 0.2),
    ("avg_cyclomatic", "avg cyclomatic", 4.0),
    ("ai_edit_ratio", "AI edit ratio", 0.2),
    ("code_entropy_index", "entropy", 14.0),
    ("pressure_index", "pressure", 14.0),
    ("edge_churn_ratio", "edge churn", 0.25),
]
REPO_FEATURES = [
    ("pressure_index", "pressure", 16.0),
    ("code_entropy_index", "entropy", 16.0),
    ("pressure_boundary", "boundary pressure", 16.0),
    ("pressure_coupling", "coupling pressure", 16.0),
    ("pressure_semantic", "semantic pressure", 16.0),
    ("pressure_volatility", "volatility pressure", 16.0),
    ("component_count", "component count", 10.0),
    ("incident_count", "incident count", 6.0),
]
BOUNDARY_FEATURES = [
    ("pressure_index", "boundary pressure", 18.0),
    ("source_pressure_index", "source pressure", 18.0),
    ("source_entropy_index", "source entropy", 18.0),
    ("arch_violation_count", "boundary violations", 4.0),
    ("edge_added", "recent edge adds", 1.0),
    ("external_target", "external edge ratio", 1.0),
]
DRIFT_FEATURES = [
    ("file_count", 1.0), ("symbol_count", 8.0), ("avg_cyclomatic", 3.0), ("max_cyclomatic", 4.0),
    ("avg_nesting", 2.0), ("max_lines", 25.0), ("avg_ai_risk", 12.0), ("ai_edit_ratio", 0.2),
    ("module_dependency_count", 1.0), ("external_dependency_count", 1.0), ("edge_additions", 1.0),
    ("edge_removals", 1.0), ("edge_churn_ratio", 0.2), ("dependency_per_file", 1.0),
    ("external_dependency_ratio", 0.25),
]
VECTOR_SIZE = 384
EMBEDDED_TEXTS = 1000  # that are embedded at once
# ---------------------------------------------------------------------------


def dot(a, b) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(products, lambda p: p.isNotNull()), F.lit(0.0), lambda acc, p: acc + p)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity over the common length, null when a side has no length."""
    shared = F.least(F.size(col(a)), F.size(col(b)))
    left, right = F.slice(col(a), F.lit(1), shared), F.slice(col(b), F.lit(1), shared)
    size = norm(left) * norm(right)
    return F.when((shared > 0) & (size > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(left, right) / size)))


def cosine_distance(a, b) -> Column:
    """1 - cosine, 0 when either vector is empty or all zero."""
    return F.coalesce(1 - cosine(a, b), F.lit(0.0))


def _token_hashes(tokens: pa.Array) -> np.ndarray:
    """The hash of :func:`hash_embed` for tokens of ASCII letters, all tokens at once, a letter at a time."""
    tokens = tokens.cast(pa.large_string())
    _, offsets, letters = tokens.buffers()
    ends = np.frombuffer(offsets, "int64", len(tokens) + 1, 8 * tokens.offset)
    at, size = ends[:-1], np.diff(ends)
    letters = np.frombuffer(letters, "u1") if len(tokens) and letters else np.zeros(0, "u1")
    h = np.zeros(len(tokens), "uint32")
    left, nth = np.flatnonzero(size), 0
    while len(left):
        h[left] = h[left] * np.uint32(31) + letters[at[left] + nth]
        nth += 1
        left = left[size[left] > nth]
    return np.abs(h.view("int32").astype("int64"))


def _embedded(texts: pa.Array, dimension: int) -> pa.Array:
    """The vectors of some texts, given as lists of tokens; each distinct token is hashed once."""
    coded = texts.flatten().dictionary_encode()
    h, code = _token_hashes(coded.dictionary), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy())
    v = np.bincount(text * dimension + (h % dimension)[code], np.where(h % 2 == 0, 1.0, -1.0)[code], len(texts) * dimension).astype("float64", copy=False).reshape(len(texts), dimension)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, length, out=v, where=length > 0)
    starts = pa.array(np.arange(len(texts) + 1, dtype="int32") * np.int32(dimension))
    return pa.ListArray.from_arrays(starts, pa.array(v.ravel()), mask=texts.is_null())


def hash_embed(source, dimension: int = VECTOR_SIZE) -> Column:
    """Unit vector of signed token counts, each token hashed to one slot.

    The token hash is the 31-polynomial over characters in 32-bit signed
    arithmetic, made non-negative; even hashes count +1, odd ones -1.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = [_embedded(texts.slice(a, EMBEDDED_TEXTS), dimension) for a in range(0, len(texts), EMBEDDED_TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    from .text import tokens

    return embed(tokens(source))


def token_hash(token) -> Column:
    """The hash that :func:`hash_embed` gives a token, as an expression: 31-polynomial in 32 signed bits, made non-negative."""
    letters = F.filter(F.split(col(token), ""), lambda c: c != "")
    h = F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def hashed_slots(df: DataFrame, key: str, source: str, dimension: int = VECTOR_SIZE) -> DataFrame:
    """The slots of :func:`hash_embed` that are not zero, one row each: ``key``, slot, weight.  ``key`` identifies a text.

    Token counts are summed by slot inside the input partitions, so at most
    ``dimension`` rows a text are shuffled.
    """
    from .text import tokens

    hashed = df.select(key, F.explode(tokens(source)).alias("_t")).select(key, token_hash("_t").alias("_h"))
    sums = hashed.groupBy(key, (F.col("_h") % dimension).cast("int").alias("slot")).agg(
        F.sum(F.when(F.col("_h") % 2 == 0, 1).otherwise(-1)).alias("_v")).filter("_v <> 0")
    length = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(key)))  # at most ``dimension`` rows
    return sums.select(key, "slot", (F.col("_v") / length).alias("weight"))


def feature_vector(features) -> Column:
    """Scaled features clamped to [0, 4]; the zero padding of the stored form
    does not change a cosine and is left out."""
    return F.array(*[
        fixed(F.greatest(F.lit(0.0), F.least(F.lit(4.0), finite(name) / max(scale, 1.0))), 6)
        for name, _, scale in features
    ])


def closeness(a, b, scale: float) -> Column:
    return 1 - F.least(F.abs(finite(a) - finite(b)) / scale, F.lit(1.0))


def feature_score(features, left, right) -> Column:
    """Mean closeness of two feature structs, three places."""
    total = None
    for name, _, scale in features:
        c = closeness(col(left)[name], col(right)[name], scale)
        total = c if total is None else total + c
    return fixed(total / len(features), 3)


def feature_drivers(features, left, right) -> Column:
    """The three closest features as ``label x.xx vs y.yy``."""
    ranked = F.array_sort(F.array(*[
        F.struct(
            fixed(-closeness(col(left)[name], col(right)[name], scale), 9).alias("order"),
            F.lit(i).alias("place"),
            F.concat(F.lit(label + " "), fixed_text(finite(col(left)[name]), 2), F.lit(" vs "),
                     fixed_text(finite(col(right)[name]), 2)).alias("text"),
        )
        for i, (name, label, scale) in enumerate(features)
    ]))
    return F.transform(F.slice(ranked, 1, 3), lambda e: e["text"])


def drift_vector(s) -> Column:
    """Seventeen scaled readings of a module snapshot struct."""
    v = lambda name: col(s)[name].cast("double")
    ratio = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.array(
        F.log1p(v("file_count")), F.log1p(v("symbol_count")),
        v("avg_cyclomatic") / 20, v("max_cyclomatic") / 40, v("avg_nesting") / 10,
        F.log1p(v("max_lines")) / 6, v("avg_ai_risk") / 100, v("ai_edit_ratio"),
        F.log1p(v("module_dependency_count")) / 4, F.log1p(v("external_dependency_count")) / 4,
        F.log1p(v("edge_additions")) / 3, F.log1p(v("edge_removals")) / 3,
        ratio(v("edge_churn_ratio")), F.least(v("dependency_per_file") / 8, F.lit(1.0)),
        ratio(v("external_dependency_ratio")), v("code_entropy_index") / 100, v("pressure_index") / 100,
    )


def _deltas(now, before) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("place"), F.lit(name).alias("name"),
            (finite(col(now)[name]) - finite(col(before)[name])).alias("delta"),
            F.least(F.abs(finite(col(now)[name]) - finite(col(before)[name])) / scale, F.lit(1.5)).alias("scaled"),
        )
        for i, (name, scale) in enumerate(DRIFT_FEATURES)
    ])


def drift_score(now, before, distance) -> Column:
    """Cosine distance plus the mean of the four largest scaled changes."""
    scaled = F.slice(F.sort_array(F.transform(_deltas(now, before), lambda d: d["scaled"]), asc=False), 1, 4)
    return col(distance) + F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x) / 4


def top_deltas(now, before) -> Column:
    """The four largest raw changes as ``delta_<feature>`` -> value."""
    ranked = F.array_sort(F.transform(
        _deltas(now, before),
        lambda d: F.struct((-F.abs(d["delta"])).alias("order"), d["place"].alias("place"),
                           d["name"].alias("name"), d["delta"].alias("delta")),
    ))
    best = F.slice(ranked, 1, 4)
    return F.map_from_arrays(
        F.transform(best, lambda d: F.concat(F.lit("delta_"), d["name"])),
        F.transform(best, lambda d: fixed(d["delta"], 4)),
    )
