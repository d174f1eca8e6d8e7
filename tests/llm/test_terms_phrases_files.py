"""Source divergence, collocations and token id files against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import collocations, divergence, idfiles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, digest long, phrase string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", 1, "y") for i, t, lang, s in rows], DOCS)


def documents(seed, n=90):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Ünder", "über", "ßa", "日本", "x"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        count = rng.choice([0, 1, 5, 40, 80])
        text = "".join(rng.choice(words[: rng.choice([4, 12, 68])]) + rng.choice([" ", " ", " ", " ", "\t", ". ", "\n", "1", "  "]) for _ in range(count))
        rows.append((i, rng.choice([text, text, text, None, ""]) if i % 9 == 0 else text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "Ç", None])))
    return rows + rows[:5] + [(None, "alpha beta beta", "en", "a"), (500, "alpha beta " * 400, "en", "hot"), (501, "!!!", "zz", "s1"), (502, None, "zz", "s2")]


def brute_audit(rows):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add(key)
        counts[key].update(terms)
        df[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:200]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_equals_brute_force(spark, bits):
    rows = documents(3)
    got = sorted(map(tuple, divergence.audit(frame(spark, rows), bits=bits).collect()))
    assert got == brute_audit(rows)


def test_audit_of_one_source_and_of_nothing(spark):
    rows = [(i, "one two", "en", "a") for i in range(4)]
    got = divergence.audit(frame(spark, rows)).collect()
    assert got == []  # no other source, and no term above the language's share
    assert divergence.audit(frame(spark, []).limit(0)).count() == 0
    lone = [(1, None, None, None), (2, "", None, "s")]
    assert sorted(map(tuple, divergence.audit(frame(spark, lone)).collect())) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = b"ab cdefghijklmnop  q,rst UVW " + "éÀ".encode() * 9
    whole = text.translate(divergence.TERMS).split()
    assert [t for part in divergence.pieces(text) for t in part] == whole


def brute_phrases(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute_collocations(rows, least, top):
    out = []
    counts, n = brute_phrases(rows)
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, _, le, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), " ".join(p), le, r))
        out += [(lang, i + 1, p, -a, le, r, n[lang], -s) for i, (s, a, _, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(3, 25), (30, 2000)])
def test_collocations_equal_brute_force(spark, least, top):
    rows = documents(5)
    got = sorted(map(tuple, collocations.collocations(frame(spark, rows), least, top).collect()))
    assert got == brute_collocations(rows, least, top)
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0


def test_words_of_long_texts_overlap_by_three(monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 40)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "Bc", "déf"]) + rng.choice(" \t.\n,  ") for _ in range(n)) for n in (0, 3, 300, 50)] + [None, "x" * 200 + " y"]
    rows = [(0, t, "en", "s") for t in texts]
    got, known = Counter(), collocations.Words()
    for words, given in collocations.word_lists(texts):
        numbers = known.numbers(words)
        for length, starts, _ in collocations.phrases_of(numbers, known.hashes, given, 1):
            got.update(tuple(words[s + i].decode() for i in range(length)) for s in starts.tolist())
    assert got == brute_phrases(rows)[0]["en"]


def test_merged_summaries_keep_every_frequent_item():
    rng = np.random.default_rng(1)
    items = np.concatenate([np.minimum(rng.zipf(1.3, 20_000), 5000), rng.integers(10_000, 14_000, 20_000)])
    least = 60
    capacity = len(items) // least + 1
    held, short = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
    for part in np.array_split(rng.permutation(items), 40):
        ids, counts = np.unique(part.astype(np.uint64), return_counts=True)
        ids, counts = collocations.summed(np.concatenate([held[0], ids]), np.concatenate([held[1], counts]))
        ids, counts, less = collocations.reduced(ids, counts, capacity)
        held, short = (ids, counts), short + less
        assert len(ids) <= capacity
    true = Counter(items.tolist())
    assert 0 < short < least
    assert {i for i, n in true.items() if n >= least} <= set(held[0].tolist())
    assert all(true[i] - short <= n <= true[i] for i, n in zip(held[0].tolist(), held[1].tolist()))


ODD = ["Hello  WORLD's isn't 12 3a", "it’s ﬁne “q”", "İstanbul ΣΑΣ é x y \x1cfoo\x0bbar", "<|endoftext|> a<|startoftext|>b", "", " ", "日本語テスト 한국 ☃️",
       "á ́b", "µ ª × ÷ ½ ²", "don'tcan'll''s 's", "tab\tnl\r\nq", "ẞß Ⅷ ǅ", " x\u0085y z​", "a,'s 'tis 9's x''t", "'", "ÀÉ×Ö÷ø", "x" * 5000, "word " * 3000]


def library(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(idfiles, "SPLIT_BYTES", 64)
    texts = ODD + [text for _, text, *_ in documents(7)]
    coder = idfiles.Encoder(VOCABULARY)
    for _ in range(2):
        got = [np.frombuffer(ids, coder.kind).tolist() + [1] for ids in coder.encode([t or "" for t in texts])]
        assert got == [ids.tolist() for ids in library(texts)]


def test_files_give_every_document_back(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)] + [(7, "again", "en", "s"), (7, "again", "en", "s"), (7, "other", "en", "s"), (-4, "neg", "en", "s"), (None, "no key", None, None), (3000, None, "en", "s")]
    folder = idfiles.write(frame(spark, rows).repartition(5), VOCABULARY, str(tmp_path / "store"))
    got = sorted((d is not None, d or 0, start, n, bytes(ids)) for d, start, n, ids in map(tuple, idfiles.read(spark, folder).collect()))
    coded = [ids.tobytes() for ids in library([t for _, t, *_ in rows])]
    assert sorted(g[4] for g in got) == sorted(coded)
    at = 0
    for _, _, start, n, ids in sorted(got, key=lambda g: g[2]):
        assert (start, n) == (at, len(ids) // 4)
        at += n
    order = [g[:2] for g in sorted(got, key=lambda g: g[2])]
    assert order == sorted((i is not None, i or 0) for i, *_ in rows)

    wanted = spark.createDataFrame([(7,), (3000,), (-4,), (12345,), (None,)], "doc_id long")
    found = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in idfiles.fetch(spark, folder, wanted).collect()}
    assert {k[0] for k in found} == {7, 3000, -4} and len(found) == 6
    assert all((True, d, s, len(ids) // 4, ids) in got for (d, s), ids in found.items())


def test_a_store_with_another_dictionary_is_refused(spark, tmp_path):
    rows = [(i, f"alpha beta {i} gamma delta " * 5, "en", "s") for i in range(300)]
    folder = idfiles.write(frame(spark, rows), VOCABULARY, str(tmp_path / "store"))
    (name,) = [n for n in os.listdir(folder) if n.startswith("dictionary-")]
    assert os.path.getsize(f"{folder}/{name}") > 0
    with open(f"{folder}/{name}", "ab") as out:
        out.write(b"x")
    with pytest.raises(ValueError, match="damaged"):
        idfiles.dictionary_of(folder)
    file = next(n for n in os.listdir(folder) if n.endswith(".idz"))
    with pytest.raises(ValueError, match="another dictionary"):
        idfiles.Reader(folder, file, b"else")


def test_digests_of_an_empty_table_and_of_checksums(spark):
    assert idfiles.digests(frame(spark, []).limit(0), VOCABULARY).count() == 0
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD[:6])]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in idfiles.digests(frame(spark, rows), VOCABULARY).collect()}
    at = 0
    for i, ids in enumerate(library(ODD[:6])):
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
