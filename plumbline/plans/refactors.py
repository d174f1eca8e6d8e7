"""Refactor suggestions and their page (survey R13, A17, A18, M22, M23, T4, P11, F30, S15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import bands, digests
from ..functions.numeric import clamp, fixed, fixed_text
from ..operators.latest import latest_per_key, top_per_key
from ..operators.timegrid import page
from .components import component_list

# --- fixed values: windows, limits and projections --------------------------
RECENT_ALERTS, BOUNDARY_LIMIT, TOTAL_LIMIT = 200, 6, 12
EXTRACT_PRESSURE, EXTRACT_ENTROPY = 50, 70
STATE_KEYS = ["code_entropy_index", "pressure_index", "duplication_entropy", "dependency_entropy", "pressure_coupling", "pressure_boundary"]
STATE = ["entropy", "pressure", "duplication", "coupling"]
# index: (share of the index, least cut, then per-signal terms of the linear cut)
DEDUPE_CUTS = {"entropy": (0.16, 6, {"n": 4.5, "s": 8}), "pressure": (0.14, 4, {"n": 3, "s": 5}),
               "duplication": (0.35, 10, {"n": 9, "s": 10}), "coupling": (0.08, 2, {"n": 2.5})}
BOUNDARY_CUTS = {"entropy": (0.18, 8, {"n": 6, "1": 6}), "pressure": (0.22, 8, {"n": 7, "1": 8}),
                 "coupling": (0.24, 10, {"n": 9, "1": 8})}
EXTRACT_CUTS = {"entropy": (0.24, 10, {"d": 5, "b": 4, "1": 10}), "pressure": (0.28, 12, {"d": 4, "b": 5, "1": 12}),
                "duplication": (0.22, 8, {"d": 8, "1": 8}), "coupling": (0.2, 8, {"b": 9, "1": 6})}
KEPT_STATUSES = ["accepted", "applied", "dismissed"]
# ---------------------------------------------------------------------------


def recent(alerts: DataFrame, n: int | None = RECENT_ALERTS) -> DataFrame:
    """The newest alerts of every repository, or all, with the module they belong to."""
    ev = F.col("evidence")
    kept = top_per_key(alerts, ["repo_id"], [F.desc("at"), F.desc("sha")], n, rank="age")
    return kept.withColumn("module", bands.alert_module(ev["module"], ev["filePath"], ev["symbolId"], F.lit("root")))


def simulation_state(metrics: DataFrame) -> DataFrame:
    """Latest indexes per module that a projection starts from."""
    rows = metrics.filter((F.col("scope") == "module") & F.col("key").isin(STATE_KEYS))
    order = F.struct("at", "sha")
    last = lambda k: F.coalesce(F.max_by("value", F.when(F.col("key") == k, order)), F.lit(0.0)).alias(k)
    wide = rows.groupBy("repo_id", F.col("subject_id").alias("module")).agg(*[last(k) for k in STATE_KEYS])
    coupling = F.greatest("dependency_entropy", (F.col("pressure_coupling") + F.col("pressure_boundary")) / 2)
    return wide.select(
        "repo_id", "module", fixed("code_entropy_index", 2).alias("entropy"), fixed("pressure_index", 2).alias("pressure"),
        fixed("duplication_entropy", 2).alias("duplication"), fixed(coupling, 2).alias("coupling"))


def _project(df: DataFrame, state: DataFrame, cuts: dict, signals: dict[str, Column], confidence: Column) -> DataFrame:
    """Add before and after states, index changes and the confidence."""
    known = df.join(state, ["repo_id", "module"], "left").fillna(0.0, STATE)
    index = lambda c: fixed(clamp(c, 0, 100), 2)

    def after(name):
        now = F.col(name)
        if name not in cuts:
            return now
        share, least, terms = cuts[name]
        linear = None
        for key, factor in terms.items():
            term = F.lit(float(factor)) if key == "1" else signals[key].cast("double") * factor
            linear = term if linear is None else linear + term
        return now - F.least(F.greatest(now * share, F.lit(float(least))), linear)

    before = F.struct(*[index(F.col(n)).alias(n) for n in STATE])
    later = F.struct(*[index(after(n)).alias(n) for n in STATE])
    out = known.withColumn("before", before).withColumn("after", later).withColumn("confidence", fixed(confidence, 2))
    change = F.struct(*[fixed(F.col("after")[n] - F.col("before")[n], 2).alias(n) for n in STATE])
    return out.withColumn("impact", change)


def _few(values: Column, n: int) -> Column:
    """The first distinct values by age; ranked rows arrive as (age, value)."""
    ordered = F.transform(F.array_sort(F.filter(values, lambda v: v["v"].isNotNull())), lambda v: v["v"])
    return F.slice(F.array_distinct(ordered), 1, n)


def _few_of_lists(lists: Column, n: int) -> Column:
    """The first distinct values of all lists, the lists by age; ranked rows arrive as (age, list)."""
    ordered = F.flatten(F.transform(F.array_sort(F.filter(lists, lambda v: v["v"].isNotNull())), lambda v: v["v"]))
    return F.slice(F.array_distinct(F.filter(ordered, lambda v: v.isNotNull())), 1, n)


def _listed(value: Column) -> Column:
    # at most the 200 newest alerts of a repository reach any of these lists, unless the caller asked for more
    return F.collect_list(F.struct(F.col("age").alias("a"), value.alias("v")))


COLUMNS = ["repo_id", "id", "scope", "target", "type", "module", "confidence", "impact", "before", "after", "drivers",
           "files", "symbols", "edges", "alert_shas"]


def _suggestion(df: DataFrame, scope: str, kind: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        "repo_id", digests.refactor_id("repo_id", F.lit(kind), "target").alias("id"), F.lit(scope).alias("scope"), "target",
        F.lit(kind).alias("type"), "module", "confidence", "impact", "before", "after", "drivers",
        *[(F.col(c) if c in df.columns else none).alias(c) for c in ("files", "symbols", "edges")], "alert_shas")


def dedupe_clusters(alerts: DataFrame, state: DataFrame) -> DataFrame:
    """Files with two or more duplication alerts."""
    rows = alerts.filter(F.col("type") == "SEMANTIC_DUPLICATION").withColumn(
        "target", F.coalesce("evidence.filePath", F.lit("unknown")))
    near = F.filter(F.coalesce("evidence.neighbours", F.array().cast("array<struct<id:string,score:double>>")), lambda n: n["score"] > 0)
    total = F.aggregate(near, F.lit(0.0), lambda acc, n: acc + n["score"])
    groups = rows.groupBy("repo_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("module", "age").alias("module"),
        F.coalesce(F.try_divide(F.sum(total), F.sum(F.size(near))), F.lit(0.0)).alias("s"),
        _few(_listed(F.col("evidence.symbolId")), 6).alias("symbols"),
        F.slice(F.transform(F.array_sort(_listed(F.col("sha"))), lambda v: v["v"]), 1, 4).alias("alert_shas"),
    ).filter(F.col("n") >= 2)
    confidence = F.least(F.lit(0.95), F.col("n") * 0.08 + 0.6 + F.col("s") * 0.18)
    out = _project(groups, state, DEDUPE_CUTS, {"n": F.col("n"), "s": F.col("s")}, confidence)
    drivers = F.array(F.concat(F.lit("duplicate cluster of "), F.col("n").cast("string")),
                      F.concat(F.lit("mean similarity "), fixed_text(F.col("s") * 100, 1), F.lit("%")))
    return _suggestion(out.withColumn("drivers", drivers).withColumn("files", F.array("target")), "file", "DEDUPE_CLUSTER")


def boundary_inversions(alerts: DataFrame, state: DataFrame, limit: int | None = BOUNDARY_LIMIT) -> DataFrame:
    """Forbidden edges seen in the recent alerts, the surest per repository."""
    rows = alerts.filter(F.col("type") == "ARCH_VIOLATION").withColumn("target", F.explode("evidence.graphEdgesAdded"))
    groups = rows.groupBy("repo_id", "target").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("module", "age").alias("module"), F.min("age").alias("_first"),
        _few(_listed(F.coalesce("evidence.filePath", F.lit("unknown"))), 3).alias("files"),
        F.slice(F.transform(F.array_sort(_listed(F.col("sha"))), lambda v: v["v"]), 1, 4).alias("alert_shas"))
    confidence = F.least(F.lit(0.96), F.col("n") * 0.07 + 0.72)
    out = _project(groups, state, BOUNDARY_CUTS, {"n": F.col("n")}, confidence)
    best = top_per_key(out, ["repo_id"], [F.desc("confidence"), F.col("_first"), F.col("target")], limit)
    drivers = F.array(F.concat(F.lit("forbidden edge seen "), F.col("n").cast("string"), F.lit(" time(s)")), F.col("target"))
    return _suggestion(best.withColumn("drivers", drivers).withColumn("edges", F.array("target")), "boundary", "INVERT_BOUNDARY")


def pressure_drivers(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The strongest pressure components per module as text (T5)."""
    keys = S.PRESSURE_KEYS[:6]
    rows = metrics.filter((F.col("scope") == "module") & F.col("key").isin(keys))
    latest = latest_per_key(rows, ["repo_id", "subject_id", "key"], ["at", "sha"], ["value"])
    label = F.concat(F.translate(F.replace("key", F.lit("pressure_"), F.lit("")), "_", " "), F.lit(" pressure "), fixed_text("value", 2))
    ranked = latest.groupBy("repo_id", F.col("subject_id").alias("module")).agg(  # six keys at most
        F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("o"), F.col("key").alias("k"), label.alias("t")))).alias("r"))
    return ranked.select("repo_id", "module", F.transform(F.slice("r", 1, n), lambda e: e["t"]).alias("pressure_drivers"))


def module_extractions(alerts: DataFrame, metrics: DataFrame, state: DataFrame) -> DataFrame:
    """Modules under pressure that also raised signals."""
    kind = F.col("type")
    groups = alerts.groupBy("repo_id", "module").agg(
        F.count_if(kind == "SEMANTIC_DUPLICATION").alias("d"), F.count_if(kind == "ARCH_VIOLATION").alias("b"),
        F.count_if(kind.isin("ARCH_EMBED_DRIFT", "ARCH_PRESSURE")).alias("r"),
        _few(_listed(F.when(kind == "SEMANTIC_DUPLICATION", F.col("evidence.symbolId"))), 6).alias("symbols"),
        _few_of_lists(_listed(F.when(kind == "ARCH_VIOLATION", F.col("evidence.graphEdgesAdded"))), 4).alias("edges"),
        F.slice(F.transform(F.array_sort(_listed(F.col("sha"))), lambda v: v["v"]), 1, 5).alias("alert_shas"))
    p, e = F.coalesce("pressure_index", F.lit(0.0)), F.coalesce("entropy_index", F.lit(0.0))
    heavy = component_list(metrics).select("repo_id", F.col("component").alias("module"), p.alias("_p"), e.alias("_e")).filter(
        (F.col("_p") >= EXTRACT_PRESSURE) | (F.col("_e") >= EXTRACT_ENTROPY))
    rows = heavy.join(groups, ["repo_id", "module"]).filter((F.col("d") > 0) | (F.col("b") > 0) | (F.col("r") > 0))
    confidence = F.least(F.lit(0.93), F.lit(0.58) + F.col("_p") / 250 + F.col("_e") / 400 + F.col("d") * 0.03 + F.col("b") * 0.04)
    out = _project(rows, state, EXTRACT_CUTS, {"d": F.col("d"), "b": F.col("b")}, confidence)
    count = lambda c, t: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t)))
    said = F.filter(F.array(count("d", " duplication signal(s)"), count("b", " boundary signal(s)")), lambda x: x.isNotNull())
    named = out.join(pressure_drivers(metrics), ["repo_id", "module"], "left")
    drivers = F.slice(F.concat(F.coalesce("pressure_drivers", F.array().cast("array<string>")), said), 1, 4)
    fallback = F.array(F.concat(F.lit("module pressure "), fixed_text("_p", 2)), F.concat(F.lit("module entropy "), fixed_text("_e", 2)))
    return _suggestion(named.withColumn("drivers", F.when(F.size(drivers) > 0, drivers).otherwise(fallback)).withColumn("target", F.col("module")),
                       "module", "EXTRACT_MODULE")


def generate(alerts: DataFrame, metrics: DataFrame, recent_alerts: int | None = RECENT_ALERTS,
             boundary_limit: int | None = BOUNDARY_LIMIT, total_limit: int | None = TOTAL_LIMIT) -> DataFrame:
    """The best suggestions of every repository (R13, T4); a limit of None is everything."""
    newest, state = recent(alerts, recent_alerts), simulation_state(metrics)
    every = dedupe_clusters(newest, state).unionByName(boundary_inversions(newest, state, boundary_limit)).unionByName(
        module_extractions(newest, metrics, state))
    weight = fixed(F.col("confidence") + F.abs("impact.pressure") + F.abs("impact.entropy"), 6)
    return top_per_key(every, ["repo_id"], [weight.desc(), F.col("id")], total_limit).withColumn("status", F.lit("proposed"))


def plan_steps(kind: str) -> list[str]:
    """Steps proposed with a suggestion of a kind."""
    return {
        "DEDUPE_CLUSTER": ["pick one implementation to keep", "move the shared behaviour into a helper",
                           "point callers at the helper", "cover the kept behaviour with tests"],
        "INVERT_BOUNDARY": ["add an interface on the inner side", "move the concrete code to the outer layer",
                            "replace direct imports", "test the boundary"],
        "EXTRACT_MODULE": ["cut out a focused submodule", "move the entangled symbols behind it",
                           "update callers", "drop forbidden imports and add tests"],
    }[kind]


def refactor_page(refactors: DataFrame, repo_id: str, number: int = 1, size: int = 8, kind: str | None = None,
                  status: str | None = None) -> DataFrame:
    rows = refactors.filter(F.col("repo_id") == repo_id)
    for name, value in (("type", kind), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    order = [bands.refactor_rank("status"), F.desc("confidence"), F.desc("at"), F.col("id")]
    return page(rows, order, number, size)


def apply_status(refactors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status after requested changes; a change the table forbids is refused.

    ``wanted`` has repo_id, id and the requested status.
    """
    asked = wanted.select("repo_id", "id", F.col("status").alias("wanted"))
    ok = bands.transition_allowed("status", "wanted") | (F.col("status") == F.col("wanted"))
    return refactors.join(asked, ["repo_id", "id"], "left").select(
        *[c for c in refactors.columns if c != "status"],
        F.when(F.col("wanted").isNotNull() & ok, F.col("wanted")).otherwise(F.col("status")).alias("status"),
        (F.col("wanted").isNotNull() & ~ok).alias("refused"))


def resolve_linked(alerts: DataFrame, links: DataFrame, refactors: DataFrame, at: Column, actor: str) -> DataFrame:
    """Alerts with those linked to an applied refactor resolved.

    ``alerts`` carries its ``alert_id``.
    """
    applied = refactors.filter(F.col("status") == "applied").select("repo_id", F.col("id").alias("refactor_id"))
    done = links.join(applied, ["repo_id", "refactor_id"], "left_semi").select("repo_id", "alert_id").distinct().withColumn("_done", F.lit(True))
    joined = alerts.join(done, ["repo_id", "alert_id"], "left")
    hit = F.col("_done").isNotNull() & (F.col("status") != "resolved")
    new = {"status": F.lit("resolved"), "resolved_at": at, "resolved_by": F.lit(actor), "status_updated_at": at}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in alerts.columns])
