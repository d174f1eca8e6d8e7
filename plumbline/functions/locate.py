"""Where symbols start and end in a source text (survey F6, F7).

Only positions are found here; hashes, tokens, calls, metrics and provenance
are column expressions over the located text.  Python blocks follow
indentation.  TypeScript and JavaScript declarations are matched by pattern on
a copy of the text with strings and comments blanked, and their ends by
bracket matching.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col
from .paths import base_name

SPAN = "array<struct<kind:string,name:string,start_line:int,end_line:int,start:int,end:int>>"
DEF = re.compile(r"\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")
CLASS = re.compile(r"\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:(]")
NAME = r"[A-Za-z_$][\w$]*"
QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
ARROW = rf"(?:async\s+)?(?:<[^<>()]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\s*:\s*[^=;{{}}]+?)?|{NAME})\s*=>"
FUNCTION = rf"(?:async\s+)?function\b\s*\*?\s*(?:{NAME})?"
VALUE = rf"((?:{NAME}(?:\.{NAME})*\s*\(|\(|\s)*)({FUNCTION}|{ARROW})"
MODIFIERS = r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*"
# Patterns begin with the characters their first words begin with, so that the search passes over all others at once;
# what must not stand before is checked after that.
APART = r"(?<![\w$.].)"
DECLARED = re.compile(
    rf"([edaf]{APART}(?:(?<=e)xport\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?function|(?<=d)efault\s+(?:declare\s+)?(?:async\s+)?function"
    rf"|(?<=d)eclare\s+(?:async\s+)?function|(?<=a)sync\s+function|(?<=f)unction))\b\s*\*?\s*({NAME})?\s*[<(]", re.S)
CLASSES = re.compile(
    rf"[edac]{APART}(?:(?<=e)xport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class|(?<=d)efault\s+(?:declare\s+)?(?:abstract\s+)?class"
    rf"|(?<=d)eclare\s+(?:abstract\s+)?class|(?<=a)bstract\s+class|(?<=c)lass)\s+({NAME})", re.S)
BOUND = re.compile(rf"[clv]{APART}(?:(?<=c)onst|(?<=l)et|(?<=v)ar)\s+({NAME})\s*(?::[^=;]+?)?=\s*{VALUE}", re.S)
LATER = re.compile(rf",\s*({NAME})\s*(?::[^=;,]+?)?=\s*{VALUE}")
PROPERTY = re.compile(rf"[{{,]\s*({NAME})\s*:\s*{VALUE}")
EXPORTED = re.compile(rf"e{APART}xport\s+default\s+{VALUE}", re.S)
BEFORE_METHOD = re.compile(r"[{};,\n]\s*")
METHOD = re.compile(rf"({MODIFIERS}\*?\s*({NAME})\s*(?:<[^<>()]*>)?)\s*\(")
BRACKETS = {opener: re.compile("[" + re.escape(opener + closer) + "]") for opener, closer in ("{}", "()", "[]")}
NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "new", "typeof", "await", "do", "else"}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def python_spans(source: str) -> list[tuple]:
    lines = re.split(r"\r?\n", source)
    starts, pos = [], 0
    for m in re.finditer(r"\r?\n|$", source):
        starts.append((pos, m.start()))
        pos = m.end()
    out = []
    for i, line in enumerate(lines):
        kind, m = "function", DEF.match(line)
        if not m:
            kind, m = "class", CLASS.match(line)
        if not m:
            continue
        level, j = _indent(line), i + 1
        while j < len(lines) and (not lines[j].strip() or _indent(lines[j]) > level):
            j += 1
        out.append((kind, m.group(1), i + 1, j, starts[i][0], starts[j - 1][1]))
    return out


def _blanked(source: str) -> str:
    """The text with comments as spaces and string contents as underscores."""

    def quiet(m):
        found = m.group()
        if "\n" not in found:
            return " " * len(found) if found[0] == "/" else found[0] + "_" * (len(found) - 2) + found[-1]
        if found[0] == "/":
            return re.sub(r"[^\n]", " ", found)
        return found[0] + re.sub(r"[^\n]", "_", found[1:-1]) + found[-1]

    return QUIET.sub(quiet, source)


def _closing(text: str, at: int) -> int:
    """Index after the bracket matching the one at ``at``; the end when unbalanced."""
    opener = text[at]
    depth = 0
    for m in BRACKETS[opener].finditer(text, at):
        depth += 1 if m.group() == opener else -1
        if depth == 0:
            return m.end()
    return len(text)


def _body_end(text: str, at: int) -> int:
    """End of a function whose parameter list opens at or after ``at``; -1 without a body."""
    opened = text.find("(", at)
    if opened < 0:
        return -1
    after = _closing(text, opened)
    typed = re.compile(r"\s*(?::(?:[^{};=]|\{[^{}]*\}(?=\s*(?:\||&|\[|\{)))*)?\{").match(text, after)
    return _closing(text, typed.end() - 1) if typed else -1


def _value_end(text: str, start: int, end: int) -> int:
    """End of a function or arrow expression whose head spans start..end."""
    if text[start:end].rstrip().endswith("=>"):
        m = re.compile(r"\s*").match(text, end)
        if m.end() < len(text) and text[m.end()] == "{":
            return _closing(text, m.end())
        depth = 0
        for m in re.finditer(r"[()\[\]{},;\n]", text[end:]):
            ch, here = m.group(), end + m.start()
            if ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
                if depth < 0:
                    return len(text[:here].rstrip())
            elif depth == 0 and (ch in ",;" or (ch == "\n" and text[end:here].strip())):
                return len(text[:here].rstrip())
        return len(text.rstrip())
    return _body_end(text, start)


def script_spans(source: str, file_name: str) -> list[tuple]:
    text = _blanked(source)
    stem = re.sub(r"\.[^.]+$", "", file_name) or "defaultExport"
    found: dict[tuple[int, int], tuple] = {}

    def add(kind, name, start, end):
        if end > start:
            found.setdefault((start, end), (kind, name))

    for m in DECLARED.finditer(text):
        lead = m.group(1)[:-len("function")]
        named = m.group(2) or (stem if "default" in lead else None)
        if named and (lead.strip() or text[: m.start()].rstrip()[-1:] in ("", "{", "}", ";", ")") or
                      text[: m.start()].endswith("\n")):
            end = _body_end(text, m.end() - 1)
            if end < 0 and "declare" in lead:
                end = text.find(";", m.end()) + 1
            add("function", named, m.start(), end)
    for m in CLASSES.finditer(text):
        brace = text.find("{", m.end())
        if brace >= 0:
            end = _closing(text, brace)
            add("class", m.group(1), m.start(), end)
    done = 0
    for before in BEFORE_METHOD.finditer(text):
        m = METHOD.match(text, before.end()) if before.start() >= done else None
        if not m:
            continue
        done = m.end()
        if m.group(2) not in NOT_METHODS:
            end = _body_end(text, m.end() - 1)
            if end > 0:
                add("method", m.group(2), m.start(1), end)
    for pattern in (BOUND, LATER, PROPERTY, EXPORTED):
        for m in pattern.finditer(text):
            groups = m.groups()
            name = groups[0] if pattern is not EXPORTED else stem
            start, end = m.start(len(groups)), m.end(len(groups))
            if pattern is EXPORTED and groups[-1].startswith(("function", "async function")) and not groups[-2].strip():
                continue  # a default function declaration, found above
            add("function", name, start, _value_end(text, start, end))
    line = lambda p: source.count("\n", 0, p) + 1
    return [(kind, name, line(s), line(e), s, e) for (s, e), (kind, name) in sorted(found.items())]


def spans(language, path, source) -> Column:
    """Located symbols of a file; empty for languages without symbols."""

    @F.pandas_udf(SPAN)
    def locate(lang: pd.Series, name: pd.Series, text: pd.Series) -> pd.Series:
        def one(l, n, s):
            if s is None:
                return []
            if l == "python":
                return python_spans(s)
            return script_spans(s, n) if l in ("typescript", "javascript") else []

        fields = ("kind", "name", "start_line", "end_line", "start", "end")
        return pd.Series([[dict(zip(fields, t)) for t in one(*row)] for row in zip(lang, name, text)])

    return locate(col(language), base_name(col(path)), col(source))
