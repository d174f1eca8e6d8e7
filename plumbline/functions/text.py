"""Source-text features (survey F4, F5, F8-F16).

Patterns avoid engine-specific word boundaries and white-space classes: the
ASCII word class and an explicit white-space class give the same matches in
every regex dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

WORD = "[A-Za-z0-9_]"
SPACE = (
    r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# --- fixed values: words and patterns --------------------------------------
IMPORT_PATTERN = rf"""(?:from|import){SPACE}+["']([^"']+)["']"""
RESERVED_CALLS = ["if", "for", "while", "switch", "catch", "return", "typeof"]
MAX_CALLS = 32
BRANCH_WORDS = ["if", "else if", "for", "while", "case", "catch"]
DUMMY_WORDS = ["test", "example", "placeholder", "mock", "lorem ipsum"]
SECRET_WORDS = ["password", "secret", "token"]
TODO_WORDS = ["todo", "fixme", "not implemented"]
GENERATORS = ["claude", "codex", "cursor"]
# ---------------------------------------------------------------------------


def whole_words(words) -> str:
    """A pattern for any of the words standing between non-word characters."""
    return rf"(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"


def imports(source) -> Column:
    """Quoted import specifiers in source order, repeats kept."""
    return F.regexp_extract_all(col(source), F.lit(IMPORT_PATTERN), F.lit(1))


def calls(source) -> Column:
    """The first 32 names followed by an opening parenthesis."""
    found = F.regexp_extract_all(
        col(source), F.lit(rf"(?<!{WORD})([A-Za-z_]{WORD}*){SPACE}*\("), F.lit(1)
    )
    return F.slice(F.filter(found, lambda n: ~n.isin(RESERVED_CALLS)), 1, MAX_CALLS)


def cyclomatic(source) -> Column:
    pattern = whole_words(BRANCH_WORDS) + r"|&&|\|\||\?"
    return (F.regexp_count(col(source), F.lit(pattern)) + 1).cast("bigint")


def nesting(source) -> Column:
    """Deepest brace level; a stray closing brace never goes below zero."""
    braces = F.regexp_replace(col(source), "[^{}]+", "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc, ch):
        depth = F.when(ch == "{", acc.depth + 1).when(ch == "}", F.greatest(acc.depth - 1, F.lit(0))).otherwise(acc.depth)
        return F.struct(depth.alias("depth"), F.greatest(acc.deepest, depth).alias("deepest"))

    return F.aggregate(F.split(braces, ""), zero, step, lambda acc: acc.deepest).cast("bigint")


def line_count(source) -> Column:
    s = col(source)
    return (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def smells(source, name) -> Column:
    """struct of four 0/1 flags."""
    low = F.lower(col(source))
    secret = rf"""(?<!{WORD})(?:{'|'.join(SECRET_WORDS)}){SPACE}*[:=]{SPACE}*["'][^"']+["']"""
    name_words = F.regexp_count(col(name), F.lit("[A-Z][^A-Z_]*|[^A-Z_]+"))
    return F.struct(
        low.rlike(whole_words(DUMMY_WORDS)).cast("bigint").alias("dummy_data"),
        low.rlike(secret).cast("bigint").alias("hardcoded_secrets"),
        (name_words > 4).cast("bigint").alias("over_abstracted_name"),
        low.rlike(whole_words(TODO_WORDS)).cast("bigint").alias("todo_markers"),
    )


def provenance(source) -> Column:
    low = F.lower(col(source))
    out = None
    for name in GENERATORS:
        hit = low.contains(f"generated-by: {name}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def merge_provenance(symbol_value, reported) -> Column:
    """Reported provenance fills in only where the symbol's own is unknown."""
    mine, theirs = F.coalesce(col(symbol_value), F.lit("unknown")), F.coalesce(col(reported), F.lit("unknown"))
    return F.when((mine == "unknown") & (theirs != "unknown"), theirs).otherwise(mine)


def is_ai_provenance(value) -> Column:
    return ~F.coalesce(col(value), F.lit("unknown")).isin("human", "unknown")


def normalized_code(source) -> Column:
    """Comments dropped, literals and numbers masked, white space collapsed."""
    s = F.regexp_replace(col(source), r"//[^\n\r\x{2028}\x{2029}]*", "")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", "")
    s = F.regexp_replace(s, "\"[^\"]*\"|'[^']*'|`[^`]*`", '"str"')
    s = F.regexp_replace(s, rf"(?<!{WORD})[0-9]+(?!{WORD})", "0")
    return F.trim(F.regexp_replace(s, SPACE + "+", " "))


def tokens(source) -> Column:
    """Lower-case word tokens in order."""
    return F.regexp_extract_all(F.lower(col(source)), F.lit("[a-z0-9_]+"), F.lit(0))
