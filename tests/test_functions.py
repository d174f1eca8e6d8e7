"""Hand-worked values of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bands, digests, heuristics, numeric, paths, scores, text, vectors


@pytest.mark.parametrize("path,module", [
    ("src/domain/x.ts", "domain"), ("README.md", "README.md"), ("", "root"), ("src/a.ts", "a.ts"), ("a\\b\\c", "a"), ("/lib//x", "lib")])
def test_module_name(one, path, module):
    assert one(paths.module_name("p"), p=path) == module


@pytest.mark.parametrize("source,spec,target", [
    ("src/domain/x.ts", "../web/c", "src/web/c"), ("src/domain/x.ts", "./y", "src/domain/y"), ("a.ts", "./b", "b"),
    ("a.ts", "../b", "../b"), ("src/a.ts", "../../../b", "../../b"), ("/abs/a.ts", "../../../b", "/b"), ("src/d/x.ts", "node:fs", None),
    ("src/d/x.ts", ".", "src/d"), ("a.ts", ".", "."), ("src/d/x.ts", "../", "src/")])
def test_resolve_import(one, source, spec, target):
    assert one(paths.resolve_import("s", "i"), s=source, i=spec) == target


@pytest.mark.parametrize("spec,name", [("@a/b/c", "@a/b"), ("node:fs", "node:fs"), ("lodash/fp", "lodash"), ("@a", "@a"), ("@a/", "@a/")])
def test_package_name(one, spec, name):
    assert one(paths.package_name("i"), i=spec) == name


@pytest.mark.parametrize("path,lang", [
    ("Dockerfile", "dockerfile"), ("x/dockerfile.dev", "dockerfile"), (".github/workflows/a.yml", "workflow"), ("a/.gitlab-ci.yml", "workflow"),
    ("x/.circleci/config.yml", "workflow"), ("a.tsx", "typescript"), ("a.cjs", "javascript"), ("a.py", "python"), ("a.sass", "scss"),
    ("a.yaml", "yaml"), (".env.local", "config"), ("a.TS", None), ("a.bin", None)])
def test_language(one, path, lang):
    assert one(paths.language("p"), p=path) == lang


@pytest.mark.parametrize("path,ignored", [
    ("src/a.ts", False), (".git/config", True), (".env", False), ("a/.env.prod", False), (".github/x", True), ("a/.github/x", False),
    ("a/node_modules/b", True), ("dist/x", True), ("distance/x", False), (".gitlab-ci.yml", False)])
def test_ignored(one, path, ignored):
    assert one(paths.is_ignored("p"), p=path) is ignored


def test_text_readings(one):
    code = "if (a && b || c) { for (;;) { x?.y ?? z } } else if (d) { case 1: }"
    # if, &&, ||, for, ?., ?? (two), "else if" (one), case
    assert one(text.cyclomatic("s"), s=code) == 1 + 9
    assert one(text.cyclomatic("s"), s="iffy elseif") == 1
    assert one(text.cyclomatic("s"), s="a?.b ?? c") == 4
    assert one(text.nesting("s"), s="}} { { } {{ } }") == 3
    assert one(text.line_count("s"), s="") == 1
    assert one(text.line_count("s"), s="a\r\nb\n") == 3
    assert one(text.calls("s"), s="if (x) foo(bar (1)) é(2) 1abc(3)") == ["foo", "bar"]
    assert one(text.imports("s"), s="import a from \"x\"; import 'y'; from z import w") == ["x", "y"]
    assert one(text.tokens("s"), s="Foo-bar  BAZ foo") == ["foo", "bar", "baz", "foo"]


def test_smells_and_risk(one):
    body = 'const password = "demo"; // TODO mock'
    flags = one(text.smells("s", "n"), s=body, n="loadEveryOpenOrderAgain")
    assert flags == {"dummy_data": 1, "hardcoded_secrets": 1, "over_abstracted_name": 1, "todo_markers": 1}
    assert one(text.smells("s", "n"), s="attest todos", n="aB_cD")["dummy_data"] == 0
    assert one(text.smells("s", "n"), s="", n="PayClient")["over_abstracted_name"] == 0
    risk = scores.ai_risk({k: F.lit(v) for k, v in dict(
        cyclomatic=2, nesting=1, dummy_data=1, hardcoded_secrets=1, over_abstracted_name=0, todo_markers=0).items()})
    assert one(risk) == 53


def test_digests(one):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(digests.tokens_hash("s"), s="Foo-bar  BAZ foo") == sha("bar|baz|foo|foo")
    assert one(text.normalized_code("s"), s='let a = 12; // x\nconst u = "http://h/1";') == 'let a = 0; const u = "http:'
    h = sha("src/pay/client.py:Client:1")
    assert one(digests.stable_id("s"), s="src/pay/client.py:Client:1") == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
    made = hashlib.sha1(b"shop:EXTRACT_MODULE:core").hexdigest()[:14]
    assert one(digests.refactor_id("r", "t", "g"), r="shop", t="EXTRACT_MODULE", g="core") == "rfx_" + made
    assert one(digests.timestamp_text(F.lit("2024-01-01 00:00:07.500").cast("timestamp"))) == "2024-01-01 00:00:07.5+00"
    assert one(digests.timestamp_text(F.lit("2024-01-01 10:00:00").cast("timestamp"))) == "2024-01-01 10:00:00+00"


def test_hashed_slots_equal_the_embedding(spark):
    """The expression form against the other form: long tokens, repeated ones, none, null."""
    texts = ["hello total invoice customer_id hello", "a" * 5000 + " b_9 Zz", "polynomial_overflow_of_thirty_two_bits x", "", None, "++"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    want = {(r["id"], i): w for r in df.select("id", vectors.hash_embed("s").alias("v")).collect() for i, w in enumerate(r["v"] or []) if w}
    got = {(r["id"], r["slot"]): r["weight"] for r in vectors.hashed_slots(df, "id", "s").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hash_embedding(one):
    v = one(vectors.hash_embed("s"), s="hello total invoice customer_id")
    slots = {i: x for i, x in enumerate(v) if x}
    assert set(slots) == {82, 68, 301, 100}
    assert slots[301] == pytest.approx(-0.5) and slots[82] == pytest.approx(0.5)
    assert sum(x * x for x in one(vectors.hash_embed("s"), s="")) == 0


def test_cosine_distance(one):
    d = vectors.cosine_distance("a", "b")
    assert one(d, a=[1.0, 0.0], b=[0.0, 1.0]) == pytest.approx(1.0)
    assert one(d, a=[0.0], b=[1.0]) == 0.0
    assert one(d, a=[1.0, 2.0, 9.0], b=[2.0, 4.0]) == pytest.approx(0.0)


def test_scores(one):
    assert one(scores.complexity_entropy(F.lit(4.0), F.lit(2.0), F.lit(12.0))) == pytest.approx(0.45)
    index = scores.entropy_index({k: F.lit(v) for k, v in zip(scores.ENTROPY_WEIGHTS, (1.0, .5, .25, .5, .2))})
    assert one(index) == 53.0
    boundary = scores.boundary_index(F.lit(True), F.lit(True), F.lit(0), F.lit(4), F.lit(50.0), F.lit(42.5))
    assert one(boundary) == 65.0
    assert one(scores.z_score(F.lit(60.0), F.lit(50.0), F.lit(0.0))) == 4.0
    assert one(scores.pressure_coupling(F.lit(2), F.lit(0), F.lit(0))) == 1.0
    assert one(numeric.clamp01(F.lit(float("nan")))) == 0.0
    assert one(numeric.fixed(F.lit(12.344999999999999), 2)) == 12.35
    assert one(numeric.over_baseline(F.lit(3.0), F.lit(0.0))) == 1.0


def test_bands(one):
    assert [one(bands.entropy_posture(F.lit(x))) for x in (0, 20, 59.9, 60, 80)] == ["stable", "normal", "drifting", "unstable", "chaotic"]
    assert one(bands.module_posture(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(None))) == "critical"
    assert one(bands.transition_allowed(F.lit("applied"), F.lit("accepted"))) is True
    assert one(bands.transition_allowed(F.lit("proposed"), F.lit("applied"))) is False
    p = bands.pattern(bands.SIGNATURE_PATTERN, F.lit(50.0), F.lit(50.0), F.lit(5), [(F.lit(0), F.lit(0.0)), (F.lit(2), F.lit(11.0)), (F.lit(1), F.lit(0.0))])
    assert one(p) == {"label": "Clone Drift", "dominant": ["Clone Drift", "Volatility Hotspot"]}
    assert one(bands.alert_module(F.lit(""), F.lit(None).cast("string"), F.lit("src/web/a.ts:f:1"), None)) == "web"


@pytest.mark.parametrize("lang,source,expected,category", [
    ("css", ".placeholder { z-index: 1500; a: b !important; c: d !IMPORTANT; e: f !important }",
     ["!important x3", "z-index >= 1000", "placeholder styling", "placeholder x1"], "STYLING_OVERRIDE"),
    ("yaml", "image: repo/example:latest\nendpoint: http://localhost:9000\napiKey: placeholder\n",
     ["placeholder x1", "example x1", "mutable image tag latest", "local/example endpoint"], "LOCAL_ENDPOINT"),
    ("dockerfile", "FROM node:latest\n\nUSER root\nRUN curl -fsSL https://x/example | sh\n",
     ["example x1", "base image latest", "container runs as root", "pipe-to-shell install"], "CONTAINER_RISK"),
    ("xml", "<page><!-- TODO placeholder -->\n<mock-box id=\"test-placeholder\"/></page>",
     ["placeholder x2", "todo x1", "mock x1", "placeholder xml nodes"], "PLACEHOLDER_CONTENT"),
    ("markdown", "# Notes\nnothing here", [], None),
    ("go", "TODO example", [], None),
    ("workflow", "uses: a/b@main\ncontinue-on-error: true", ["unpinned action ref", "continue-on-error true"], "WORKFLOW_RISK"),
    ("json", '{"token": "changeme", "u": "http://127.0.0.1"}', ["local/example endpoint", "fake credential value"], "SECRET_PLACEHOLDER"),
    ("toml", "debug = true", ["debug mode enabled"], "DEBUG_CONFIG")])
def test_content_rules(one, lang, source, expected, category):
    found = one(heuristics.drivers("l", "s"), l=lang, s=source)
    assert found == expected
    if category:
        assert one(heuristics.category("l", heuristics.drivers("l", "s")), l=lang, s=source) == category


def test_drivers_from_older_advice(one):
    read = heuristics.drivers_from_recommendation("t")
    assert one(read, t="Review a.yml: todo x2, fake secret placeholder.") == ["todo x2", "fake secret placeholder"]
    assert one(read, t="no list") == []
    assert one(heuristics.legacy_category(F.array().cast("array<string>"), "p"), p="x/Dockerfile") == "CONTAINER_RISK"


def test_embedding_of_lists_of_tokens_equals_one_token_at_a_time():
    """Nulls, empty lists, a slice, long tokens, and hashes over 31 bits."""
    import numpy as np
    import pyarrow as pa

    def hashed(token):
        h = 0
        for ch in token:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >> 31 else h)

    words = [["a", "b_9", "a"], None, [], ["z" * 500, "polynomial_overflow"], ["total"] * 7 + ["x1"], None]
    lists = pa.array([["left", "out"], *words], pa.list_(pa.string())).slice(1)
    for tokens, got in zip(words, vectors._embedded(lists, 384).to_pylist()):
        want = np.zeros(384)
        for t in tokens or []:
            want[hashed(t) % 384] += 1 if hashed(t) % 2 == 0 else -1
        length = np.sqrt((want * want).sum())
        assert got is None if tokens is None else got == (want / length if length else want).tolist()
    assert vectors._embedded(lists.slice(1, 1), 384).to_pylist() == [None] and len(vectors._embedded(lists.slice(0, 0), 384)) == 0
