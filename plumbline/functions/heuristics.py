"""Content rules for files outside the parsed languages (survey F19, F20, S20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, once
from .paths import any_of
from .text import SPACE, WORD

MAX_DRIVERS = 4
MAX_TOKENS = 3
_B = rf"(?<!{WORD})"  # word start
_E = rf"(?!{WORD})"  # word end
_HOST = r"https?://(localhost|127\.0\.0\.1|example\.com)"
_FAKE = "(changeme|example|test|placeholder|123456)"

# --- fixed values: residue tokens, per-language patterns, categories --------
RESIDUE_TOKENS = ["placeholder", "todo", "tbd", "example", "mock", "lorem ipsum", "coming soon"]
UPPER_ONLY = ["todo"]  # counted only when written in capitals
LANGUAGE_RULES = {
    "json": [
        ("local/example endpoint", [rf"(?i){_HOST}"]),
        ("fake credential value", [
            rf'(?i)"(password|token|secret)"{SPACE}*:{SPACE}*"(123456|changeme|test|example)"']),
    ],
    "markdown": [
        ("template residue", ["(?i)generated by|copy here|fill this in|write content here"]),
        ("todo in code block", ["(?is)```.*TODO.*```"]),
    ],
    "yaml": [
        ("mutable image tag latest", [rf"(?i){_B}image:{SPACE}*.+:latest{_E}"]),
        ("local/example endpoint", [rf"(?i){_B}(host|url|endpoint):{SPACE}*{_HOST}"]),
        ("fake secret placeholder", [rf"(?i){_B}(password|token|secret|apiKey):{SPACE}*{_FAKE}{_E}"]),
    ],
    "html": [
        ("placeholder document title", ["(?i)<title>.*(todo|placeholder|coming soon).*</title>"]),
        ("placeholder markup hooks", [
            rf"""(?i){_B}(id|class)=["'][^"']*(placeholder|mock|demo|test)[^"']*["']"""]),
        ("local/example endpoint", [rf"(?i){_HOST}"]),
    ],
    "config": [
        ("debug mode enabled", [rf"(?i){_B}(debug|devMode|mockMode){SPACE}*[:=]{SPACE}*(true|1|yes){_E}"]),
        ("fake secret placeholder", [
            rf"(?i){_B}(password|token|secret|apikey|api_key){SPACE}*[:=]{SPACE}*{_FAKE}{_E}"]),
        ("local/example endpoint", [rf"(?i){_B}(url|host|endpoint){SPACE}*[:=]{SPACE}*{_HOST}"]),
    ],
    "xml": [
        ("placeholder xml nodes", [
            "(?i)<(mock|placeholder|demo|test)[^>]*>",
            rf"""(?i){_B}(id|name)=["'][^"']*(mock|placeholder|demo|test)[^"']*["']"""]),
        ("local/example endpoint", [rf"(?i){_HOST}"]),
        ("template comment residue", ["(?is)<!--.*(todo|placeholder|tbd).*-->"]),
    ],
    "dockerfile": [
        ("base image latest", [r"(?im)^from\s+\S+:latest\s*$"]),
        ("container runs as root", [r"(?im)^\s*user\s+root\s*$"]),
        ("pipe-to-shell install", [
            r"(?i)curl\s+[^|\n]+?\|\s*(sh|bash)", r"(?i)wget\s+[^|\n]+?\|\s*(sh|bash)"]),
        ("fake env placeholder", [rf"(?im)^\s*env\s+{WORD}+={_FAKE}\s*$"]),
    ],
    "workflow": [
        ("unpinned action ref", [rf"(?i){_B}uses:{SPACE}*[^@\n]+@(main|master|latest){_E}"]),
        ("continue-on-error true", [rf"(?i){_B}continue-on-error:{SPACE}*true{_E}"]),
        ("local/example endpoint", [rf"(?i){_B}(url|host|endpoint):{SPACE}*{_HOST}"]),
        ("workflow placeholder residue", [rf"(?i){_B}(debug|mock|placeholder){_E}"]),
    ],
}
LANGUAGE_RULES["toml"] = LANGUAGE_RULES["config"]
STYLE_LANGUAGES = ["css", "scss"]
IMPORTANT_PATTERN, IMPORTANT_MINIMUM = "(?i)!important", 3
LAYER_PATTERN, LAYER_MINIMUM = rf"(?i)z-index{SPACE}*:{SPACE}*([0-9]+)", 1000
STYLE_PLACEHOLDER = r"(?i)\.placeholder|#placeholder|skeleton|shim"
CATEGORY_WORDS = [
    ("SECRET_PLACEHOLDER", ["fake secret", "fake credential"]),
    ("LOCAL_ENDPOINT", ["local/example endpoint"]),
    ("DEBUG_CONFIG", ["debug mode enabled"]),
    ("WORKFLOW_RISK", ["unpinned action ref", "continue-on-error"]),
    ("CONTAINER_RISK", ["base image latest", "container runs as root", "pipe-to-shell"]),
    ("STYLING_OVERRIDE", ["!important", "z-index", "styling"]),
    ("PLACEHOLDER_CONTENT", ["placeholder", "template", "todo"]),
]
LANGUAGE_CATEGORIES = [("workflow", "WORKFLOW_DRIFT"), ("dockerfile", "CONTAINER_DRIFT")]
DEFAULT_CATEGORY = "CONTENT_DRIFT"
# ---------------------------------------------------------------------------


def _written_as(token: str):
    if token in UPPER_ONLY:
        return lambda hit: hit == token.upper()
    return lambda hit: F.lower(hit) == token


def residue_drivers(source) -> Column:
    """Up to three ``token xN`` entries, most frequent first, list order on ties."""
    # no token can overlap another, so one scan finds the hits of all of them
    pattern = rf"(?i){_B}(?:{'|'.join(RESIDUE_TOKENS)}){_E}"
    found = F.regexp_extract_all(col(source), F.lit(pattern), F.lit(0))

    def ranked(hits):
        counted = F.array(*[
            F.struct((-F.size(F.filter(hits, _written_as(token)))).alias("order"), F.lit(i).alias("place"), F.lit(token).alias("token"))
            for i, token in enumerate(RESIDUE_TOKENS)
        ])
        return F.transform(
            F.slice(F.array_sort(F.filter(counted, lambda e: e["order"] < 0)), 1, MAX_TOKENS),
            lambda e: F.concat(e["token"], F.lit(" x"), (-e["order"]).cast("string")),
        )

    return once(found, ranked)


def _hits(source, rules) -> Column:
    found = F.array(*[
        F.when(any_of([col(source).rlike(p) for p in patterns]), F.lit(label)) for label, patterns in rules
    ])
    return F.filter(found, lambda label: label.isNotNull())


def _style_drivers(source) -> Column:
    s = col(source)
    important = F.regexp_count(s, F.lit(IMPORTANT_PATTERN))
    layers = F.regexp_extract_all(s, F.lit(LAYER_PATTERN), F.lit(1))
    high = F.exists(layers, lambda d: d.try_cast("double") >= LAYER_MINIMUM)
    found = F.array(
        F.when(important >= IMPORTANT_MINIMUM, F.concat(F.lit("!important x"), important.cast("string"))),
        F.when(high, F.lit("z-index >= 1000")),
        F.when(s.rlike(STYLE_PLACEHOLDER), F.lit("placeholder styling")),
    )
    return F.filter(found, lambda label: label.isNotNull())


def drivers(lang, source) -> Column:
    """Rule hits of the file's language, cut to four before they are classified."""
    l, none = col(lang), F.array().cast("array<string>")
    # style hits go before the residue tokens, the hits of every other language after them
    first = F.when(l.isin(STYLE_LANGUAGES), _style_drivers(source)).otherwise(none)
    last = F.when(l.isin(STYLE_LANGUAGES), none)
    for name, rules in LANGUAGE_RULES.items():
        last = last.when(l == name, _hits(source, rules))
    found = F.slice(F.concat(first, residue_drivers(source), last.otherwise(none)), 1, MAX_DRIVERS)
    return F.when(l.isin([*STYLE_LANGUAGES, *LANGUAGE_RULES]), found).otherwise(none)


def _contains_any(words: list[str]):
    return lambda d: any_of([d.contains(w) for w in words])


def _category_of(found: Column):
    low = F.transform(found, lambda d: F.lower(d))
    out = None
    for category, words in CATEGORY_WORDS:
        hit = F.exists(low, _contains_any(words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def category(lang, found) -> Column:
    out = _category_of(col(found))
    for name, value in LANGUAGE_CATEGORIES:
        out = out.when(col(lang) == name, value)
    return out.otherwise(DEFAULT_CATEGORY)


def severity(found) -> Column:
    return F.when(F.size(col(found)) >= 3, "error").otherwise("warn")


def drivers_from_recommendation(text) -> Column:
    """Drivers listed after the first colon of an older alert's advice."""
    t = col(text)
    listed = F.split(F.substring(t, F.instr(t, ":") + 1, F.length(t)), ",")
    clean = F.transform(listed, lambda d: F.regexp_replace(F.trim(d), r"\.$", ""))
    return F.when(
        t.isNull() | (F.instr(t, ":") == 0), F.array().cast("array<string>")
    ).otherwise(F.filter(clean, lambda d: d != ""))


def legacy_category(found, path) -> Column:
    """Category of an older alert, with fallbacks on its path."""
    p = F.lower(F.coalesce(col(path), F.lit("")))
    return (
        _category_of(col(found))
        .when(p.contains(".github/workflows/") | p.endswith(".gitlab-ci.yml"), "WORKFLOW_RISK")
        .when(p.endswith("dockerfile"), "CONTAINER_RISK")
        .when(p.endswith(".env") | p.contains(".env."), "DEBUG_CONFIG")
        .otherwise(DEFAULT_CATEGORY)
    )
