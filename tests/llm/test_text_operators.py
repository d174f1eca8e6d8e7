"""BPE, language, chat, licences, quality, shards and decontamination against brute force, and their odd cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import bpe, chat, common, decontaminate, language, licenses, quality, shards

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token_ids string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and a column with a clashing name."""
    long = " ".join(f"word{i % 977} thing" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and the dog", "en", "a", 1, "x"), (1, "the cat sat on the mat and the dog", "en", "a", 1, "x"),
            (2, None, None, None, None, None), (3, "", "en", "b", 0, ""), (None, "the cat sat", None, "a", 3, "y"),
            (4, long, "en", None, 5, "z"), (5, "12 !! \u0000 \U0001f600", "fr", "b", 2, None), (6, "le chat est sur la table et le chien", "fr", "b", 2, "q"),
            (7, "Der Hund und die Katze sind auf dem Tisch", "de", "c", 2, "q"), (7, "other text", None, "c", 2, "q")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_is_tiktoken_and_comes_back(odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect():
        assert row["token_ids"] == want.encode_ordinary(row["text"] or "")
    got = bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    texts = Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect())
    assert Counter(r["decoded_sha256"] for r in got) == texts
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0
    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abé \n\t漢😀'sXtheing<|endoftext|>0123") for _ in range(rng.randint(0, 300)))
        assert codec.encode(text).tolist() == want.encode_ordinary(text)
        assert codec.decode(codec.encode(text).tolist()) == text.encode()
    for text in ("a" * 20_000, " " * 999, "ab" * 5000, "x  y \n z", " x", "x "):
        assert codec.encode(text).tolist() == want.encode_ordinary(text)


def rank_order(text, length):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        counts.update(w)
    joined = " " + " ".join(words) + " "
    counts.update(joined[i:i + 2] for i in range(len(joined) - 1))
    counts.update(joined[i:i + 3] for i in range(len(joined) - 2) if joined[i + 1] != " ")
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:length] if words else [], counts


def test_language_profiles_and_predictions(odd, none, monkeypatch):
    rows = [r for r in odd.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] and r["text"]:
            counts[r["lang"]].update(rank_order(r["text"], 1)[1])
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    profile = {k: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:50])} for k, c in counts.items()}
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in ("ab ab  ba!", "x", "Élan vital, a b c " * 40):
            assert dict(zip(*map(list, language.counted(text)))) == {code(g): n for g, n in rank_order(text, 1)[1].items()}
    monkeypatch.undo()
    for r in odd.join(language.identify(odd, 50).withColumnRenamed("doc_id", "d").dropDuplicates(), odd.doc_id.eqNullSafe(
            language.F.col("d"))).where("doc_id <> 7").collect():
        top = rank_order(r["text"] or "", 50)[0]
        away = {k: sum(abs(p[g] - i) if g in p else 50 for i, g in enumerate(top)) for k, p in profile.items()}
        want = min(sorted(away), key=away.get) if top and away else "und"
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1
    assert language.identify(none).count() == 0
    assert {r["doc_id"] for r in language.readable(odd).collect()} == {1, None, 4, 6, 7}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_start|> <\\| <\\\\|im_end|>"), (1, 1, "assistant", "a\nb<|"), (1, 2, "user", None), (1, 3, "assistant", ""),
            (2, 1, "assistant", "out of order"), (2, 0, "system", "s"), (None, 0, "us\ner\\n", "x"), (None, None, None, "é😀"),
            (3, 0, "user", "same"), (3, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", chat.F.lit("clash"))
    probe = "<|im_end|><|im_start|>assistant ok"
    talks = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        talks[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.digests(table).collect()}
    assert got.keys() == talks.keys()
    for key, turns in talks.items():
        turns.sort()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[key]["n_turns"] == len(turns)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert got[key]["loss_chars"] == len(learned)
        assert got[key]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert [got[k]["valid_order"] for k in (-1, 1, 2, 3, None)] == [True, True, False, False, False]
    assert chat.digests(table.limit(0)).count() == 1
    segments = chat.format_chat(table).collect()
    assert sum(s["loss"] for s in segments) == 3
    assert not any("<|" in s["text"] for s in segments if s["part"] == chat.TEXT)


def test_license_passages(spark, none, odd):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"Some words before.\n{notice}\nafter"), (2, None), (3, ""), (4, "license of the cat"), (5, notice), (5, notice),
            (6, licenses.TEMPLATES[2][1].replace("without restriction", "with no restriction") + " more text " * 50), (None, "Released under the MIT License.")]
    got = licenses.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter({(1, "Apache-2.0"): 1, (5, "Apache-2.0"): 2, (6, "MIT"): 1, (None, "MIT"): 1})
    first = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][first["first_char"]:first["end_char"]] == notice[:-1] and first["score"] == 1.0
    assert licenses.matches(none).count() == 0 and licenses.matches(odd).count() == 0
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.7)
    rng = random.Random(2)
    vocabulary = licenses.words(" ".join(t for _, t in licenses.TEMPLATES))
    for _ in range(30):  # against all passages
        text = [rng.choice(vocabulary) for _ in range(20)]
        text[5:11] = rng.choice([t for _, t in licenses.TEMPLATES if len(t) < 50]).lower().replace(".", " ").replace(",", "").split()[:6]
        text = licenses.words(" ".join(text))
        pairs = list(zip(text, text[1:]))
        for number, (name, grams, size, *_) in enumerate(scanner.templates):
            best = max((2 * sum((Counter(pairs[i:j]) & grams).values()) / (j - i + size) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)), default=0)
            found = {n: s for n, s, *_ in scanner.scan(" ".join(text))}
            assert found.get(number, 0) == pytest.approx(best if best >= 0.7 else 0)


def test_licenses_are_told_apart(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["of", "the", "software", "license", "xyz", "any"]) for _ in range(n))
    rows, want = [], []
    for number, (name, text) in enumerate(licenses.TEMPLATES):
        found = text.split()
        for at in rng.sample(range(len(found)), len(found) // 60):
            found[at] = "changed"
        rows.append((number, f"{filler(40)}\n{' '.join(found)}\n{filler(40)}"))
        want.append((number, name))
    gnu = {n: t for n, t in licenses.TEMPLATES if t.startswith("This program is free software")}
    edited = gnu["GPL-3.0"].replace("published", "printed")
    rows += [(1000, f"{gnu['AGPL-3.0']}\n{filler(9)}\n{edited}")]  # each has a notice of its own
    want += [(1000, "AGPL-3.0"), (1000, "GPL-3.0")]
    got = licenses.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == sorted(want)
    assert all(r["score"] > 0.9 for r in got)


def test_repeated_notices_name_no_relatives():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    for name, text in licenses.TEMPLATES:
        for times in (2, 3, 5):
            assert {scanner.templates[n][0] for n, *_ in scanner.licenses(f"\n{text}" * times)} == {name}


def test_licences_compete_for_places_as_by_brute_force():
    """Against all passages of all templates, taken in order of their scores."""
    sizes = sorted(licenses.TEMPLATES, key=lambda t: len(t[1]))[:24]
    scanner = licenses.Scanner(sizes, 0.7)
    rng = random.Random(5)
    for _ in range(40):
        text = []
        for _ in range(rng.randint(1, 5)):
            part = licenses.words(rng.choice(sizes)[1])[:25]
            for at in rng.sample(range(len(part)), len(part) // 12):
                part[at] = rng.choice(["software", "license", "x"])
            text += part + ["the"] * rng.randint(0, 2)
        pairs = list(zip(text, text[1:]))
        passages = []
        for number, (name, grams, size, low, high) in enumerate(scanner.templates):
            for i in range(len(pairs)):
                left, common = Counter(grams), 0
                for j in range(i, min(len(pairs), i + int(high))):
                    if left[pairs[j]] > 0:
                        left[pairs[j]] -= 1
                        common += 1
                    score = 2 * common / (j - i + 1 + size)
                    if score >= 0.7 and j - i + 1 >= low and pairs[i] in grams and pairs[j] in grams:
                        passages.append((-score, i - j, number, i, j))
        taken, want = set(), {}
        for score, _, number, i, j in sorted(passages):
            if 2 * len(taken & set(range(i, j + 1))) <= j - i + 1:
                want.setdefault(scanner.templates[number][0], (number, -score, i, j))
                taken |= set(range(i, j + 1))
        assert scanner.licenses(" ".join(text)) == sorted(want.values())


def test_quality_separates_and_shrinks(spark, odd, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)] + (["junk$$"] * 9 if bad else []) + (["moron"] if toxic else [])
        rows.append((i, " ".join(words), "en", f"s{i % 7}", 1, None))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows.append((9000, "alpha beta", None, "never seen before", 1, None))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    toxic = [got[i]["p_toxic"] for i in range(0, 600, 5)]
    assert len(got) == 601 and min(toxic) > 0.5 > max(got[i]["p_toxic"] for i in range(600) if i % 5)
    assert abs(got[9000]["path_quality"] - got[9000]["host_quality"]) < 0.05  # a sparse site falls back
    for frame in (odd, none):
        assert quality.classify(frame, known.limit(0)).count() == frame.count()


def test_shards_match_the_mixture(spark, odd, none):
    rows = [(i, f"t{i % 90}", "en", "hot" if i % 3 == 0 else f"s{i % 11}", 1, None) for i in range(1003)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [shards.interleave(docs, 16, bucket_rows=b).collect() for b in (50_000, 40)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    by = defaultdict(list)
    for r in got[0]:
        by[r["shard"]].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {r[0]: r[3] for r in rows}
    total = Counter(source.values())
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        for name, n in Counter(source[r["doc_id"]] for r in part).items():
            assert abs(n - total[name] * len(part) / 1003) < 2 + total[name] / 1003 * len(total)
    got = shards.sharding(odd).collect()
    assert len(got) == odd.count() and {r["law"] for r in got} == {"rows"}
    sizes = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sizes
    assert shards.sharding(none).count() == 0


def test_small_sources_spread_over_the_shards(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i}" if i < 600 else "large", 1, None) for i in range(1000)], DOCS)
    got = shards.interleave(docs, 16).collect()
    tail = Counter(r["shard"] for r in got if r["doc_id"] < 600)
    assert len(got) == 1000 and all(15 <= tail[k] <= 60 for k in range(16))


def test_leaks_are_found_and_nothing_else(spark, odd, none, monkeypatch):
    rng = random.Random(8)
    words = [a + b for a in ("an", "er", "th", "on", "ti") for b in ("ea", "sh", "ou", "re", "ing", "ly")] + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30)) + ". Answer " + " ".join(rng.choice(words) for _ in range(6)) + ".") for i in range(60)]
    docs, truth = [], set()
    for d in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        if d % 7 == 0:
            item, text_ = items[d % 60]
            at = rng.randint(0, len(text))
            text[at:at] = text_.upper().split()
            truth.add((d, item))
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1]), (903, items[3][1][:60])]
    truth |= {(902, 0), (None, 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (70, None), (71, ""), (72, "...")], "item_id long, text string")
    for size in (50_000, 20):
        got = decontaminate.leaks(frame, bench, shard_items=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    kept = decontaminate.clean(frame, bench).collect()
    assert len(kept) == len(docs) - sum((d, i) in truth for d, _ in docs for i in range(60))
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == len(docs)
    index = decontaminate.Index(items, Counter(w for _, t in items for w in set(decontaminate.words(t))), 60, 37.0)
    texts = [decontaminate.words(t) for _, t in docs[:60]]
    found = {(t, s) for t, s, *_ in index.candidates(texts, 0.3)}
    share = {(n, w): s for w, t in index.term.items() for n, s in zip(index.items[t].tolist(), index.shares[t].tolist())}
    for t, text in enumerate(texts):  # no window above the threshold is skipped
        for start in range(0, max(1, len(text)), index.stretch):
            part = set(text[start:start + 2 * index.stretch])
            if max(sum(share.get((n, w), 0) for w in part) for n in range(60)) >= 0.3:
                assert (t, start) in found


def test_leaks_with_changed_words_are_found():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    pick = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [f"{pick(20)}. {pick(5)}.", f"{pick(25)}. {pick(1)}.", f"{pick(12)}? {pick(7)}. {pick(2)}.", f"{pick(14)}? {pick(1)}", f"{pick(4)}. {pick(2)}.", f"{pick(9)}? {pick(4)}"]
    bags = [decontaminate.words(t) for t in items]
    index = decontaminate.Index(list(enumerate(items)), Counter(w for b in bags for w in set(b)), len(items), sum(map(len, bags)) / len(bags))
    leaks = lambda text: {n for _, n in index.scan([decontaminate.words(text)], decontaminate.THRESHOLD, decontaminate.QUESTION_OVERLAP, decontaminate.ANSWER_OVERLAP)}
    for number, item in enumerate(items):
        own = item.split()
        edits = [own[:i] + ["put in"] + own[i:] for i in range(len(own) + 1)] + [own[:i] + own[i + 1:] for i in range(len(own))]
        edits += [own[:i] + ["changed"] + own[i + 1:] for i in range(len(own))]
        for words in edits:
            assert number in leaks(f"{pick(50)} {' '.join(words)} {pick(30)}"), (item, words)
    for number in (0, 1):
        assert leaks(f"{pick(9)} {items[number].rsplit('. ', 1)[0]} {pick(40)}") == {number}  # without its last sentence
    assert leaks(items[2].split("?")[0] + "? " + pick(40)) == set()  # a question without its answer is none
    for _ in range(50):
        assert leaks(pick(100)) == set()
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, n))] for n in (9, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(a, b) == table[-1][-1]


def test_a_worker_lets_go_of_an_encoder_that_the_task_has_no_use_for():
    made = []

    @common.lasting
    def large(name):
        made.append(name)
        return [name]

    first = large("a")
    common.release(large)
    assert large("a") is first and made == ["a"]
    common.release()
    assert large("a") is not first and made == ["a", "a"]


def test_encoding_and_decoding_take_one_worker_a_task(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b héllo\n"), (2, None), (3, ""), (4, "one two two")], "doc_id long, text string")
    both = bpe.both_ways(docs, RANKS, public_tokenizers.PATTERN)
    apart = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))
    for plan in (both, bpe.digests(docs, RANKS, public_tokenizers.PATTERN), corpus_pipeline.byte_bpe(spark, docs, str(tmp_path))):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
