"""Path and module naming (survey F1-F3, S2-S4, F24, F28, F29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# --- fixed values: language names by special file name and by suffix -------
WORKFLOW_FILES = [".gitlab-ci.yml", "azure-pipelines.yml", "buildkite.yml"]
SUFFIX_LANGUAGES = [
    ("typescript", [".ts", ".tsx"]),
    ("typescript", [".mts", ".cts"]),
    ("javascript", [".js", ".jsx"]),
    ("javascript", [".mjs", ".cjs"]),
    ("python", [".py"]),
    ("go", [".go"]),
    ("rust", [".rs"]),
    ("css", [".css"]),
    ("scss", [".scss", ".sass"]),
    ("json", [".json"]),
    ("markdown", [".md", ".mdx"]),
    ("yaml", [".yml", ".yaml"]),
    ("html", [".html"]),
    ("xml", [".xml"]),
    ("toml", [".toml"]),
    ("config", [".ini", ".conf", ".cfg"]),
]
FALLBACK_SUFFIXES = [
    (".ts", "typescript"),
    (".tsx", "typescript"),
    (".js", "javascript"),
    (".jsx", "javascript"),
    (".py", "python"),
]
PARSED_LANGUAGES = ["typescript", "javascript", "python"]
WATCHED_LANGUAGES = [
    "css", "scss", "json", "markdown", "yaml", "html", "toml", "config", "xml",
    "dockerfile", "workflow",
]
# ---------------------------------------------------------------------------


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def slashes(path) -> Column:
    return F.translate(col(path), "\\", "/")


def segments(path) -> Column:
    return F.filter(F.split(slashes(path), "/"), lambda p: p != "")


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def module_name(path) -> Column:
    """``src/X/...`` -> X, otherwise the first segment, otherwise root."""
    parts = segments(path)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((first == "src") & second.isNotNull(), second).otherwise(
        F.coalesce(first, F.lit("root"))
    )


def resolve_import(source_path, specifier) -> Column:
    """POSIX path of a relative import, null for a bare specifier."""
    src, imp = slashes(source_path), col(specifier)
    parts = F.split(src, "/")
    steps = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.split(imp, "/"))
    rooted = src.startswith("/")

    def walk(acc, step):
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        up = F.when(can_pop, popped).when(rooted, acc).otherwise(F.concat(acc, F.array(step)))
        return F.when((step == "") | (step == "."), acc).when(step == "..", up).otherwise(
            F.concat(acc, F.array(step))
        )

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    joined = F.array_join(walked, "/")
    tail = F.when(imp.endswith("/") & (joined != ""), F.lit("/")).otherwise(F.lit(""))
    body = F.when(rooted, F.concat(F.lit("/"), joined, tail)).when(
        joined == "", F.when(imp.endswith("/"), F.lit("")).otherwise(F.lit("."))
    ).otherwise(F.concat(joined, tail))
    return F.when(imp.startswith("."), body)


def package_name(specifier) -> Column:
    """``@scope/name/...`` -> ``@scope/name``, otherwise the first segment."""
    imp = col(specifier)
    parts = F.split(imp, "/")
    scope, name = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    scoped = F.when(name != "", F.concat(scope, F.lit("/"), name)).otherwise(imp)
    return F.when(imp.startswith("@"), scoped).otherwise(scope)


def import_target(source_path, specifier) -> Column:
    """struct(kind, id): a File for a relative import, a Package otherwise."""
    imp = col(specifier)
    local = imp.startswith(".")
    return F.struct(
        F.when(local, F.lit("File")).otherwise(F.lit("Package")).alias("kind"),
        F.when(local, resolve_import(source_path, imp)).otherwise(package_name(imp)).alias("id"),
    )


def language(path) -> Column:
    """Language of a watched file; the first matching rule wins."""
    p = col(path)
    low = F.lower(p)
    base = base_name(low)
    yaml = p.endswith(".yml") | p.endswith(".yaml")
    in_workflows = low.startswith(".github/workflows/") | low.contains("/.github/workflows/")
    out = (
        F.when((base == "dockerfile") | base.startswith("dockerfile."), "dockerfile")
        .when(in_workflows & yaml, "workflow")
        .when(base.isin(WORKFLOW_FILES), "workflow")
        .when(low.contains("/.circleci/config.yml"), "workflow")
    )
    for name, suffixes in SUFFIX_LANGUAGES:
        out = out.when(any_of([p.endswith(s) for s in suffixes]), name)
    return out.when((base == ".env") | base.startswith(".env."), "config")


def fallback_language(path) -> Column:
    """The parser's own suffix table, used when a change names no language."""
    out = None
    for suffix, name in FALLBACK_SUFFIXES:
        out = F.when(col(path).endswith(suffix), name) if out is None else out.when(
            col(path).endswith(suffix), name
        )
    return out


def is_ignored(path) -> Column:
    """True for paths the watcher must not follow."""
    p = slashes(path)
    base = base_name(p)
    kept = (
        (base == ".env") | base.startswith(".env.") | (base == ".gitlab-ci.yml")
        | p.endswith("/.github") | p.contains("/.github/")
        | p.endswith("/.circleci") | p.contains("/.circleci/")
    )
    dropped = (
        p.rlike(r"(^|/)\.") | p.rlike(r"(^|/)node_modules(/|$)")
        | p.rlike(r"(^|/)dist(/|$)") | p.rlike(r"(^|/)\.next(/|$)")
    )
    return ~kept & dropped


def parser_status(lang) -> Column:
    """Pending for parsed languages, unsupported for everything else."""
    return F.when(col(lang).isin(PARSED_LANGUAGES), "pending").otherwise("unsupported")


def parser_lane(lang) -> Column:
    """Which of the four status notes applies: none, unknown, light or watch_only."""
    v = col(lang)
    return (
        F.when(v.isNull() | (v == ""), "unknown")
        .when(v.isin(PARSED_LANGUAGES), "none")
        .when(v.isin(WATCHED_LANGUAGES), "light")
        .otherwise("watch_only")
    )


def parser_note(lang) -> Column:
    """Operator-facing note for the lane of a changed file."""
    lane, v = parser_lane(lang), col(lang)
    return (
        F.when(lane == "unknown", F.lit("Changed file has no known language; it is only watched."))
        .when(lane == "light", F.concat(v, F.lit(" is checked with content rules only; it has no symbols or graph.")))
        .when(lane == "watch_only", F.concat(v, F.lit(" is shown in the activity stream but not analyzed yet.")))
    )


def repo_id_from_path(path) -> Column:
    return F.lower(F.regexp_replace(base_name(F.regexp_replace(slashes(path), "/+$", "")), "[^a-zA-Z0-9_-]", "-"))


def trimmed_path(path) -> Column:
    return F.regexp_replace(slashes(path), "/+$", "")


def container_path(host_path, host_prefix: str | None, container_prefix: str | None) -> Column:
    """Translate a host path under ``host_prefix``; null when it is elsewhere."""
    if not host_prefix or not container_prefix:
        return F.lit(None).cast("string")
    host, cont = host_prefix.replace("\\", "/").rstrip("/"), container_prefix.replace("\\", "/").rstrip("/")
    p = trimmed_path(host_path)
    suffix = F.regexp_replace(F.substring(p, F.lit(len(host) + 1), F.length(p)), "^/+", "")
    inside = (p == host) | p.startswith(host + "/")
    return F.when(inside, F.when(suffix == "", F.lit(cont)).otherwise(F.concat(F.lit(cont + "/"), suffix)))


def initial_watch_state(kind, enabled, root_path) -> Column:
    on_disk = (col(kind) == "local") & (F.coalesce(col(root_path), F.lit("")) != "")
    return F.when(~col(enabled), "inactive").when(on_disk, "pending").otherwise("inactive")


def next_watch_state(kind, was_enabled, state, old_root, enabled, new_root) -> Column:
    """Decision table for the watch state after an update."""
    turned_on = ~col(was_enabled) & col(enabled)
    old = F.coalesce(trimmed_path(old_root), F.lit(""))
    new = F.coalesce(trimmed_path(new_root), F.lit(""))
    return (
        F.when(~col(enabled), F.lit("inactive"))
        .when((col(kind) == "remote") & turned_on, F.lit("pending"))
        .when(col(kind) == "remote", col(state))
        .when(F.coalesce(col(new_root), F.lit("")) == "", F.lit("inactive"))
        .when(turned_on | (old != new), F.lit("pending"))
        .when(col(state).isin("active", "blocked"), col(state))
        .otherwise(F.lit("pending"))
    )
