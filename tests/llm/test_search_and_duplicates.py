"""Bit-sliced search, BagMinHash, components, suffix index and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import bagminhash, bitslice, graph, suffix

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def brute_top(rows, queries, k):
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    out = []
    for q in queries:
        if q in whole:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 64])
def test_top_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block)
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.25, -3.0]) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 330)] + [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(330, 360)] + [(1000, [1.0]), (1001, [2.0])]
    bad = [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, bitslice.neighbours(frame).collect()))
    assert got == brute_top(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert bitslice.neighbours(frame.limit(0)).count() == 0


def test_top_scores_of_large_empty_and_repeated_vectors(spark):
    rows = [(50, [1.0]), (50, [1.0]), (1, [float(1 << 33)]), (2, [float(1 << 35)]), (3, [float(1 << 34)]), (4, [-float(1 << 50)]), (5, [0.5]), (6, [0.25]),
            (100, []), (101, []), (102, []), (150, [2.0, 1.0]), (150, [-2.0, 1.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0])]
    got = sorted(map(tuple, bitslice.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    one = [(50, n + 1, i, 256 * (256 * v)) for n, (i, v) in enumerate([(2, 1 << 35), (3, 1 << 34), (1, 1 << 33)])] + [(50, 4, 5, 256 * 128), (50, 5, 6, 256 * 64)]
    empty = [(100, 1, 101, 0), (100, 2, 102, 0)]
    two = sorted([(150, 1, 7, 512 * 256), (150, 2, 8, -512 * 256), (150, 1, 8, 512 * 256), (150, 2, 7, -512 * 256)])
    assert got == one + empty + two


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({("", text or ""): 1})


def brute_classes(texts):
    bags, root = [bag(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, min(x for x in g if x is not None), len(g)) for g in groups.values() for d in g if d is not None)


def copies(rng, n_words, edits):
    base = [f"w{rng.randint(0, 900)}" for _ in range(n_words)]
    out = []
    for e in edits:
        w = list(base)
        for i in rng.sample(range(n_words), e):
            w[i] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_duplicate_classes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(bagminhash, "CHUNK", chunk)
    rng = random.Random(6)
    texts = copies(rng, 150, [0, 0, 1, 2, 3, 4, 5] + [rng.randint(0, 9) for _ in range(60)]) + copies(rng, 60, [0, 1, 1, 1]) + copies(rng, 900, [0, 30, 5])
    texts += ["spam spam spam eggs ham " * 40, "spam spam spam eggs ham " * 44, "spam spam spam eggs ham " * 90, "one two", "one two", "One, two!", "one", "", None, "!!", "!!", "??"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[0])]
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], DOCS)
    got = sorted(tuple(r) for r in bagminhash.near_duplicates(frame).collect() if r["doc_id"] is not None)
    assert got == brute_classes(rows)
    assert bagminhash.near_duplicates(frame.limit(0)).count() == 0
    kept = bagminhash.one_of_each(frame).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for _, c, _ in got})


@pytest.mark.parametrize("chunk, size", [(2048, 16 << 20), (40, 16 << 20), (2048, 40_000)])
def test_borderline_copies_of_one_base_give_a_forest_of_links(spark, monkeypatch, chunk, size):
    """A large group in which most pairs are close to the threshold: classes as by brute force, and few links."""
    monkeypatch.setattr(bagminhash, "CHUNK", chunk)
    monkeypatch.setattr(bagminhash, "CHUNK_BYTES", size)
    rng, seen, plain = random.Random(21), [], bagminhash.forest
    texts = copies(rng, 160, [rng.randint(2, 7) for _ in range(170)])
    rows = [(i, t) for i, t in enumerate(texts)]

    def spied(members, *rest):
        seen.append((plain(members, *rest).count(), members.select("bucket", "i", "j", "node").distinct().count()))
        return plain(members, *rest)

    monkeypatch.setattr(bagminhash, "forest", spied)
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], DOCS)
    assert sorted(tuple(r) for r in bagminhash.near_duplicates(frame).collect()) == brute_classes(rows)
    links, nodes = seen[0]
    assert links < max(nodes, 1)


def test_columns_without_an_order_do_not_stop_the_reduction(spark):
    rows = [(1, "a b c d e f", {"k": 1}, [{"z": 2}]), (1, "a b c d e f", {"k": 2}, None), (2, "g h i j k l", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, list array<map<string,int>>")
    assert sorted(r["doc_id"] for r in bagminhash.one_of_each(frame).collect()) == [1, 2]


def test_texts_of_one_id_are_kept_apart(spark):
    rng = random.Random(13)
    one, two, three = copies(rng, 80, [0, 1]), copies(rng, 80, [0, 1]), copies(rng, 80, [0])
    hot = [copies(rng, 40, [0])[0] for _ in range(30)]
    rows = [(1, one[0]), (1, two[0]), (1, two[0]), (2, one[1]), (3, two[1]), (1, three[0]), (4, three[0]), (5, None), (5, ""), *[(7, t) for t in hot], (7, one[0])]
    kept = bagminhash.one_of_each(spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], DOCS)).collect()
    want = [(1, one[0]), (1, two[0]), (1, three[0]), (5, None), *[(7, t) for t in hot]]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)


def test_the_margin_misses_less_than_the_bands():
    n, p = bagminhash.REGISTERS, bagminhash.SIMILARITY
    least = p - bagminhash.MARGIN * math.sqrt(p * (1 - p) / n)
    missed = sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(math.ceil(least * n)))
    assert missed < (1 - p ** bagminhash.ROWS) ** bagminhash.BANDS


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(9)
    memo, off = bagminhash.word_hashes(), []
    for n in range(60):
        base = [f"{n}-{rng.randint(0, 60)}" for _ in range(200)] + [f"{n}-a", f"{n}-b"] * rng.randint(0, 30)
        other = base[:rng.randint(60, len(base))] + [f"{n}-z{i}" for i in range(rng.randint(0, 40))]
        one, two = bagminhash.bags_of([" ".join(base), " ".join(other)], memo)
        a, b = bagminhash.signatures([one, two])
        assert (bagminhash.signatures([two])[0] == b).all()  # the batch does not matter
        off.append((a == b).mean() - bagminhash.similarity(one, two))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(bool(gone[i]) and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeated_strings_equal_brute_force(spark, limit):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdeé fg") for _ in range(n))
    shared, other = make(260), make(230)
    texts = [make(300) + shared + make(100), shared[40:] + make(200), make(50) + shared + other, other, other, make(199), make(200), "a" * 700, "a" * 250,
             "ab" * 300, make(30) + "ba" * 150, None, "", "short", "short", make(900)]
    texts += [texts[0][:-1] + "z", texts[-1] + texts[-1], shared + make(1), make(1) + shared]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, other), (None, make(10) + other)]
    frame = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], DOCS)
    got = Counter(tuple(r) for r in suffix.removal(frame, group_limit=limit).collect())
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 200)))
    assert suffix.removal(frame.limit(0)).count() == 0


def test_long_texts_are_cut_in_overlapping_chunks(spark, monkeypatch):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [body, body[2000:2600] + "x" * 30, body[:150] + "y" + body[5000:]]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "c") for i, t in enumerate(texts)], DOCS)
    want = Counter((i, *x) for i, x in enumerate(brute_repeats(texts, 200)))
    assert Counter(tuple(r) for r in suffix.removal(frame).collect()) == want
    data = np.frombuffer(body.encode(), np.uint8)
    whole = {(int(g), int(p)) for g, p, *_ in zip(*suffix.anchors(data, np.array([len(data)])))}
    parts = set()
    for start in range(0, len(data) - 199, 700 - 200):
        part = data[start:start + 699]
        parts |= {(int(g), int(p) + start) for g, p, *_ in zip(*suffix.anchors(part, np.array([len(part)])))}
    assert parts == whole


def test_repeated_rows_give_their_contexts_once(spark):
    rng = random.Random(15)
    hot, other = ("".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(2))
    texts = [hot] * 60 + [other + hot[300:900], other]
    docs = spark.createDataFrame([(7 if t == hot else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = suffix.keyed(docs, "doc_id", "text")
    found = suffix.suffixes(rows, 200).select("gram", "rid", "t", "loc")
    around = suffix.contexts(found, rows)
    assert around.count() <= 8 * around.distinct().count()  # once in each task at most
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removal(docs).collect())
    assert got == sorted(brute_repeats(texts, 200))


def test_pipeline_on_the_smallest_table(spark):
    final = corpus_pipeline.run(spark, SMALL).collect()
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    items = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    lettered = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    first = {d for d, c, _ in brute_classes(lettered) if d == c}
    kept = [(d, t) for d, t in lettered if d in first]
    cut = {}
    data = [t.encode() for _, t in kept]
    seen = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    for (d, _), b in zip(kept, data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left:
            cut[d] = left
    clean = {d: t for d, t in cut.items() if not any(i in t for i in items)}
    assert {r["doc_id"]: r["text"] for r in final} == clean
    assert all(r["token_ids"] for r in final)
