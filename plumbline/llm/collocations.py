"""Phrase collocations: frequent phrases by Misra-Gries summaries, counted exactly afterwards.

First pass: every task counts the digests of all phrases of one to four words
and hands the counts over as summaries, one for each range of the digest space (a
hash partition).  The summaries of a partition are merged: counters add up, and
when there are more than the capacity, the largest counter beyond it is
subtracted from all, and what is not above 0 goes.  A count is short by the sum of these
subtractions at most, and they are fewer than the partition's mass over its
capacity.  The capacity is the mass over the threshold, plus one, so a phrase that
occurs as often as the threshold says always survives, whatever the data are.

Second pass: the survivors set bits of a filter of bounded size, which all tasks
get; phrases that it lets through are counted by their words, not by digests,
so what the filter or a digest confuses is told apart again, and phrases below
the threshold go.  A filter that many survivors fill lets more phrases through
and costs shuffle, never a result.

Scores and the rule that a phrase inside a longer one goes are joins of the
counted phrases with themselves.

A hot phrase is one counter in every summary.  Partitions grow in number with
the corpus; a merge holds two summaries at a time.

Defined cases: a null text is an empty one; the language of a null is ``und``;
words hold any characters but blanks, tabs and the signs that end a piece; equal
rows count as often as they occur; a language without phrases has no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, small_batches, steps, stored

LONGEST = 4
LEAST = 30
TOP = 2000
#: Occurrences of phrases that a hash partition of the first pass stands for, on average.
PARTITION_MASS = 16_000_000
#: Counters that a task holds before it hands them over.
HELD = 500_000
#: Counted phrases that a task holds before it hands them over, and the words it knows by number.
KEPT, KNOWN = 700_000, 200_000
#: The filter's bits a survivor, and bounds of its size in bits.
BITS_EACH, FILTER_LEAST, FILTER_MOST = 32, 1 << 16, 1 << 28
#: Bytes of text that are split at once.
PIECE = 1 << 20
#: Ends a piece, stands between texts; UTF-8 has no such byte.
STOP = b"\xff"
#: The signs that end a piece.
STOPS = b".,;:!?\n\x0b\x0c\r"

NORMAL = bytes(b + 32 if 65 <= b <= 90 else 255 if b in STOPS else 32 if b == 9 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)


def word_lists(texts: list):
    """Words of the texts with STOP between pieces, in lists of bounded size; a list begins with the words that reach into it from the last one.

    Gives (words, how many at the start were given before).
    """
    held, size = [], 0
    for text in texts:
        data = (text or "").encode().translate(NORMAL).replace(STOP, b" \xff ")
        if len(data) <= PIECE:
            held.append(data)
            size += len(data)
            if size >= PIECE:
                yield b" \xff ".join(held).split(), 0
                held, size = [], 0
            continue
        tail: list[bytes] = []
        while data:
            at = data.rfind(b" ", 0, PIECE) if len(data) > PIECE else len(data)
            if at <= 0:
                at = data.find(b" ", PIECE)
                at = len(data) if at < 0 else at
            words = tail + data[:at].split()
            yield words, len(tail)
            tail, data = words[-(LONGEST - 1):], data[at:]
    if held:
        yield b" \xff ".join(held).split(), 0


class Words(dict):
    """The words a task has met by number, with a hash of each; STOP is 0."""

    def __init__(self):
        super().__init__({STOP: 0})
        self.list = [STOP]
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.list)
        self.list.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        fresh = [xxhash.xxh64_intdigest(w) for w in self.list[len(self.hashes):]]
        if fresh:
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
        return found


def phrases_of(numbers: np.ndarray, hashes: np.ndarray, given: int, seed: int):
    """(length, starts, digests) of all phrases of a length that end beyond what was given before."""
    stops = np.concatenate(([0], np.cumsum(numbers == 0)))
    hashes = hashes[numbers]
    digests = np.full(len(hashes), seed, np.uint64)
    for length in range(1, LONGEST + 1):
        n = len(hashes) - length + 1
        if n <= 0:
            return
        with np.errstate(over="ignore"):
            digests = (digests[:n] ^ hashes[length - 1 :]) * MIX
            digests ^= digests >> np.uint64(29)
            ended = digests * TURN
            ended ^= ended >> np.uint64(32)
        starts = np.flatnonzero(stops[length:] == stops[:n])
        starts = starts[starts + length > given]
        yield length, starts, ended[starts]


def told_apart(digests: np.ndarray, front: np.ndarray, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts added up by the words of a phrase (two numbers in ``front``, two in ``back``).

    Rows are sorted by digest alone; where phrases share one, a phrase may get several rows, which are added later.
    """
    order = np.argsort(digests, kind="stable")
    digests, front, back = digests[order], front[order], back[order]
    heads = np.flatnonzero(np.r_[True, (front[1:] != front[:-1]) | (back[1:] != back[:-1])])
    return digests[heads], front[heads], back[heads], np.add.reduceat(counts[order], heads)


def summed(digests: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters of equal digests added up, in ascending order."""
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    heads = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, np.int64)
    return digests[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


def reduced(digests: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` counters, and what was subtracted from all."""
    if len(counts) <= capacity:
        return digests, counts, 0
    less = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > less
    return digests[left], counts[left] - less, less


def by_language(part: pa.RecordBatch):
    """(language, texts) of a slice of rows."""
    groups: dict[str, list] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
        groups.setdefault(lang, []).append(text)
    return groups.items()


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


#: Rows of a summary: kind 0 has a task's mass in a hash partition, kind 1 its counters: ids in two arrays (low 32 and high 8 bits) and counts.
SUMMARY = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("mass", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])
ID_BITS = np.uint64(40)
ID = np.uint64((1 << 40) - 1)


def summaries(rows: DataFrame, partitions: int) -> DataFrame:
    """The counters of every task, cut by ranges of the digest space; within a range the low bits of a digest are its id."""

    def out(digests, counts):
        places = (digests >> ID_BITS) * np.uint64(partitions) >> np.uint64(24)
        heads = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else []
        for start, end in zip(heads, [*heads[1:], len(places)]):
            place, ids = int(places[start]), digests[start:end] & ID
            yield pa.RecordBatch.from_pylist([
                {"place": place, "kind": 0, "mass": int(counts[start:end].sum())},
                {"place": place, "kind": 1, "low": ids.astype(np.uint32).tobytes(), "high": (ids >> np.uint64(32)).astype(np.uint8).tobytes(),
                 "counts": counts[start:end].astype(np.uint32).tobytes()}], schema=SUMMARY)

    def run(batches):
        held, size, known = [], 0, Words()
        for part in steps(batches):
            for lang, texts in by_language(part):
                for words, given in word_lists(texts):
                    if len(known) > KNOWN:
                        known = Words()
                    numbers = known.numbers(words)
                    for _, _, digests in phrases_of(numbers, known.hashes, given, seed_of(lang)):
                        held.append(np.unique(digests, return_counts=True))
                        size += len(held[-1][0])
                    if size > 2 * HELD:
                        merged = summed(np.concatenate([d for d, _ in held]), np.concatenate([c for _, c in held]))
                        held, size = [merged], len(merged[0])
                        if size > HELD:
                            yield from out(*merged)
                            held, size = [], 0
        if held:
            yield from out(*summed(np.concatenate([d for d, _ in held]), np.concatenate([c for _, c in held])))
        release()

    return rows.mapInArrow(run, "place long, kind int, mass long, low binary, high binary, counts binary")


def survivors(parts: DataFrame, least: int) -> DataFrame:
    """(id) of all phrases that may occur ``least`` times: the summaries of each hash partition, merged.

    The rows of kind 0 come first, so the partition's mass is known when its counters are merged.
    """
    dealt = parts.repartition("place").sortWithinPartitions("place", "kind")

    def merge(batches):
        place, capacity = None, 1
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = short = 0

        def settle():
            nonlocal waiting, size, short
            ids, counts = summed(np.concatenate([d for d, _ in waiting]), np.concatenate([c for _, c in waiting]))
            ids, counts, less = reduced(ids, counts, capacity)
            waiting, size, short = [(ids, counts)], len(ids), short + less
            return ids[counts + short >= least]

        mass = 0
        for batch in batches:
            for at in range(batch.num_rows):
                here = batch.column(0)[at].as_py()
                if here != place:
                    if waiting:
                        yield pa.RecordBatch.from_arrays([pa.array(settle().astype(np.int64))], names=["id"])
                    place, mass, waiting, size, short = here, 0, [], 0, 0
                if batch.column(1)[at].as_py() == 0:
                    mass += batch.column(2)[at].as_py()
                    capacity = mass // least + 1
                    continue
                low, high, counts = (np.frombuffer(batch.column(i)[at].as_buffer(), kind) for i, kind in ((3, np.uint32), (4, np.uint8), (5, np.uint32)))
                waiting.append((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), counts.astype(np.int64)))
                size += len(low)
                if size > capacity + 2 * HELD:
                    settle()
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(settle().astype(np.int64))], names=["id"])
        release()

    return dealt.mapInArrow(merge, "id long")


def filter_of(ids: DataFrame) -> np.ndarray:
    """A filter of a power of two bits, at most FILTER_MOST, that is set at every id."""
    wanted = ids.count() * BITS_EACH
    bits = FILTER_LEAST
    while bits < min(wanted, FILTER_MOST):
        bits *= 2
    at = F.col("id").bitwiseAND(F.lit(bits - 1))
    words = ids.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(id & 63 AS INT)))").alias("set"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def exact(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(lang, phrase, words, n) of what passes the filter, partly summed; the phrase '' counts all words."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def part_of(lang, phrases, lengths, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())],
            names=["lang", "phrase", "words", "n"])

    def run(batches):
        bits = shared.value
        last = np.uint64(len(bits) * 64 - 1)
        words, totals, size, full = Words(), {}, 0, False
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def merge() -> int:
            for lang, parts in held.items():
                held[lang] = [told_apart(*(np.concatenate(column) for column in zip(*parts)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def out():
            for lang, parts in held.items():
                for _, front, back, counts in parts:
                    for at in range(0, len(counts), 50_000):
                        cut = slice(at, at + 50_000)
                        rows = np.stack([front[cut] >> 32, front[cut] & 0xFFFFFFFF, back[cut] >> 32, back[cut] & 0xFFFFFFFF], axis=1)
                        phrases = [b" ".join([words.list[n] for n in row if n]).decode() for row in rows.tolist()]
                        yield part_of(lang, phrases, (rows > 0).sum(axis=1), counts[cut])

        for part in steps(batches):
            for lang, texts in by_language(part):
                for given_words, given in word_lists(texts):
                    numbers = words.numbers(given_words)
                    ahead = np.concatenate([numbers, np.zeros(LONGEST, np.int64)])
                    for length, starts, digests in phrases_of(numbers, words.hashes, given, seed_of(lang)):
                        if length == 1:
                            totals[lang] = totals.get(lang, 0) + len(starts)
                        at = digests & last
                        passed = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                        starts, digests = starts[passed], digests[passed]
                        if not len(starts):
                            continue
                        columns = [ahead[starts + n] if n < length else np.zeros(len(starts), np.int64) for n in range(LONGEST)]
                        found = told_apart(digests, columns[0] << 32 | columns[1], columns[2] << 32 | columns[3], np.ones(len(starts), np.int64))
                        held.setdefault(lang, []).append(found)
                        size += len(found[0])
                    if size > KEPT * 3 // 2:
                        size = merge()
                        full = size > KEPT
                    if full or len(words) > KNOWN:
                        merge()
                        yield from out()
                        held, size, words, full = {}, 0, Words(), False
        if held:
            merge()
            yield from out()
        for lang, total in totals.items():
            yield part_of(lang, [""], [0], [total])
        release()

    return rows.mapInArrow(run, "lang string, phrase string, words int, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, words and n of all phrases of one to four words that occur ``least`` times; the phrase '' has all words of the language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(8, -(-size * LONGEST // 6 // PARTITION_MASS))
    found = stored(survivors(summaries(rows, partitions), least), "survivors")
    table = filter_of(found)
    discard(found)
    counts = exact(rows, table).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of two to four words.

    Of the cuts of a phrase the one with the lowest score 2000000 a / (l + r) counts, of equal
    ones the first.  A phrase goes where a longer one that holds it occurs at least ``covered`` percent as often.
    """
    phrases = stored(frequent_phrases(docs, least, lang, text), "phrases")
    parts = F.split("phrase", " ")
    candidates = phrases.where(F.col("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"), parts.alias("parts"))
    join = lambda c: F.array_join(c, " ")
    cuts = candidates.select("lang", "phrase", "a", "words", "parts", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", join(F.slice("parts", F.lit(1), F.col("k"))).alias("head"), join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"))
    known = phrases.where(F.col("words") > 0)
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    spans = F.expr(f"""flatten(transform(sequence(2, words - 1), size -> transform(sequence(1, words - size + 1),
        start -> array_join(slice(parts, start, size), ' '))))""")
    inner = candidates.where(F.col("words") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    hidden = F.expr(f"100 * CAST(longest AS DECIMAL(20,0)) >= {covered} * CAST(a AS DECIMAL(20,0))")
    kept = best.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = phrases.where(F.col("words") == 0).select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
lists AS (SELECT row_number() OVER () AS i, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT i, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS s FROM lists),
runs AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY i ORDER BY s)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, 1 AS k, w1, NULL AS w2, NULL AS w3, NULL AS w4, w1 AS phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30 UNION ALL
  SELECT lang, 2, w1, w2, NULL, NULL, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 UNION ALL
  SELECT lang, 3, w1, w2, w3, NULL, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 UNION ALL
  SELECT lang, 4, w1, w2, w3, w4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w1 AS head, concat_ws(' ', w2, w3, w4) AS rest FROM phrases WHERE k > 1 UNION ALL
  SELECT lang, phrase, a, 2, w1 || ' ' || w2, concat_ws(' ', w3, w4) FROM phrases WHERE k > 2 UNION ALL
  SELECT lang, phrase, a, 3, w1 || ' ' || w2 || ' ' || w3, w4 FROM phrases WHERE k > 3
), scored AS (
  SELECT c.*, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT) // (x.a + y.a) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = c.head JOIN phrases y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a, w1 || ' ' || w2 AS phrase FROM phrases WHERE k > 2 UNION ALL SELECT lang, a, w2 || ' ' || w3 FROM phrases WHERE k > 2 UNION ALL
  SELECT lang, a, w3 || ' ' || w4 FROM phrases WHERE k > 3 UNION ALL SELECT lang, a, w1 || ' ' || w2 || ' ' || w3 FROM phrases WHERE k > 3 UNION ALL
  SELECT lang, a, w2 || ' ' || w3 || ' ' || w4 FROM phrases WHERE k > 3
), inside AS (SELECT lang, phrase, max(a) AS longest FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longest IS NULL OR 100 * i.longest::HUGEINT < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
