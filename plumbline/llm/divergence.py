"""How the terms of a language's sources differ, by late string materialization.

Terms are counted per language and source by a 64-bit digest; only digests and
counts are shuffled.  Beside the counts every task gives each term it met once,
with its digest; the least and the greatest string of a digest say whether it
stands for one term.  Where they differ, the digest is split: its terms are
counted anew by their strings, and numbered.  Strings come back at the end only,
for the terms that are reported.

Shares are whole numbers: p = 1 + floor(1000000000 (count + 1) / (N + V)), with N
the occurrences of the language's kept terms in the source and V their number.
A source departs from a share q by f = floor((p - q)^2 / q).

Two sources are compared over all kept terms without a row for every term and
pair.  Most terms are absent from both; with p0 the share of an absent term,

    sum f(p, q) = V f(p0, q0) + sum over terms of the one  f(p, q0) - f(p0, q0)
                              + sum over terms of the other f(p0, q) - f(p0, q0)
                              + sum over shared terms  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The middle sums need only how many terms a source has of every share; the last
is summed in the tasks that hold the term's sources, so what leaves them is a row
a pair of sources and block of terms.

Defined cases: a null text, language or source is ''; a source without terms is
a group all the same; a language without kept terms has differences of 0 and no
term rows; equal rows count as often as they occur, also as documents; other
columns are ignored.  Counts are exact as long as 1000000000 times a count fits
38 digits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, small_batches, steps, stored

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counters that a task holds before it hands them over.
HELD = 1_000_000
#: Pairs that are worked on at once.
PAIRS = 1 << 21
#: Bytes of one text that are split at once.
PIECE = 4 << 20


def _table() -> bytes:
    """Bytes of terms, A-Z lower-cased; everything else is a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


TERMS = _table()


def pieces(text: bytes):
    """The terms of a text, in lists of bounded size."""
    text = text.translate(TERMS)
    while len(text) > PIECE:
        at = text.rfind(b" ", 1, PIECE)
        if at < 0:
            at = text.find(b" ", PIECE)
            at = len(text) if at < 0 else at
        yield text[:at].split()
        text = text[at:]
    yield text.split()


class Numbers(dict):
    """Terms by the order in which they were met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def count_part(texts: list, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a slice of rows, and (group, term, occurrences, documents) of every term in a group."""
    numbers = Numbers()
    words, lengths = [], np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        for part in pieces((text or "").encode()):
            found = np.fromiter(map(numbers.__getitem__, part), np.int64, len(part))
            lengths[at] += len(found)
            words.append(found)
    words = np.concatenate(words) if words else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    terms = len(numbers) or 1
    pairs, times = np.unique(rows * terms + words, return_counts=True)
    keys = groups[pairs // terms] * terms + pairs % terms
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(keys):
        return [], *(np.zeros(0, np.int64) for _ in range(4))
    return list(numbers), keys[firsts] // terms, keys[firsts] % terms, np.add.reduceat(times, firsts), np.diff(firsts, append=len(keys))


class Counters:
    """Counts by (group, digest) that a task has gathered, handed over when there are many."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def group(self, key: tuple[str, str]) -> int:
        return self.names.setdefault(key, len(self.names))

    def add(self, groups, digests, times, documents) -> None:
        self.parts.append(np.stack([groups, digests, times, documents]))
        self.size += len(groups)

    def merge(self) -> None:
        if not self.size:
            return
        groups, digests, times, documents = np.concatenate(self.parts, axis=1)
        order = np.lexsort((digests, groups))
        groups, digests = groups[order], digests[order]
        firsts = np.flatnonzero(np.r_[True, (np.diff(groups) != 0) | (np.diff(digests) != 0)])
        self.parts = [np.stack([groups[firsts], digests[firsts], np.add.reduceat(times[order], firsts), np.add.reduceat(documents[order], firsts)])]
        self.size = len(firsts)

    def rows(self):
        self.merge()
        names = list(self.names)
        for part in self.parts:
            for start in range(0, part.shape[1], 100_000):
                groups, digests, times, documents = part[:, start : start + 100_000]
                keys = pa.DictionaryArray.from_arrays(pa.array(groups, pa.int32()), pa.array([k[0] for k in names])).cast(pa.string())
                sources = pa.DictionaryArray.from_arrays(pa.array(groups, pa.int32()), pa.array([k[1] for k in names])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    keys, sources, pa.array(digests), pa.nulls(len(groups), pa.string()), pa.array(times), pa.array(documents)], names=COUNTED)
        self.names, self.parts, self.size = {}, [], 0


COUNTED = ["lang", "source", "digest", "term", "n", "docs"]
COUNTED_SCHEMA = "lang string, source string, digest long, term string, n long, docs long"


def counted(rows: DataFrame, bits: int, with_strings: bool) -> DataFrame:
    """Partial counts of every task.

    Without strings: a row a group and digest, and beside them a row without group for
    each term met.  With strings: a row a group and term, for digests that need it.
    """
    mask = (1 << bits) - 1

    def run(batches):
        counters, met = Counters(), set()
        for part in steps(batches):
            pairs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            groups = np.array([counters.group(pair) for pair in pairs], np.int64)
            terms, group, term, times, documents = count_part(part.column(2).to_pylist(), groups)
            digests = np.array([xxhash.xxh64_intdigest(t) & mask for t in terms], np.uint64).astype(np.int64)
            if with_strings:
                names = list(counters.names)
                for start in range(0, len(term), 100_000):
                    cut = slice(start, start + 100_000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[g][0] for g in group[cut]], pa.string()), pa.array([names[g][1] for g in group[cut]], pa.string()), pa.array(digests[term[cut]]),
                        pa.array([terms[t].decode() for t in term[cut]], pa.string()), pa.array(times[cut]), pa.array(documents[cut])], names=COUNTED)
                continue
            counters.add(group, digests[term], times, documents)
            fresh = [(d, t) for d, t in zip(digests.tolist(), terms) if t not in met]
            met.update(t for _, t in fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(len(fresh), pa.string()), pa.nulls(len(fresh), pa.string()), pa.array([d for d, _ in fresh], pa.int64()),
                    pa.array([t.decode() for _, t in fresh], pa.string()), pa.nulls(len(fresh), pa.int64()), pa.nulls(len(fresh), pa.int64())], names=COUNTED)
            if len(met) > HELD:
                met = set()
            if counters.size > 2 * HELD:
                counters.merge()
                if counters.size > HELD:
                    yield from counters.rows()
        yield from counters.rows()
        release()

    return rows.mapInArrow(run, COUNTED_SCHEMA)


TERM = ["digest", "split"]


def term_counts(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Counts (lang, source, digest, split, n, docs) and the dictionary (digest, split, term), both exact, and the tables that only the counts read."""
    raw = stored(counted(rows, bits, False), "term_counts")
    ends = raw.where(F.col("lang").isNull()).groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    words = stored(ends, "term_words")
    counts = raw.where(F.col("lang").isNotNull()).select("lang", "source", "digest", F.lit(0).alias("split"), "n", "docs")
    clean, shared = words.where(F.col("term") == F.col("last")), words.where(F.col("term") != F.col("last")).select("digest")
    dictionary = clean.select("digest", F.lit(0).alias("split"), "term")
    if shared.isEmpty():
        return counts, dictionary, [raw]
    again = stored(counted(rows, bits, True).join(shared, "digest", "left_semi"), "split_counts")
    numbered = again.select("digest", "term").distinct().withColumn("split", F.row_number().over(Window.partitionBy("digest").orderBy("term")))
    numbered = stored(numbered, "split_words")
    counts = counts.join(shared, "digest", "left_anti").unionByName(again.join(numbered, ["digest", "term"]).select(*counts.columns))
    return counts, dictionary.unionByName(numbered.select("digest", "split", "term")), [raw, again]


def share(count, total, terms):
    """The share of a term as a whole number."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", (wide(count) + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(terms)) + 1)


def departure(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, s, t, value): the last sum of the module's formula, in parts.  Rows: lang, digest, split, place, p, absent."""
    rows = rows.select("lang", "digest", "split", F.col("place").cast("long"), "p", "absent")
    dealt = rows.repartition("lang", "digest").sortWithinPartitions("lang", "digest", "split")

    def f(p, q):
        return (p - q) ** 2 // q

    def sums(lang, starts, place, p, absent):
        sizes = np.diff(starts)
        for size in np.unique(sizes[sizes > 1]).tolist():
            firsts, most = starts[:-1][sizes == size], max(1, PAIRS // (size * size))
            width = max(1, min(size, PAIRS // size))
            for begin in range(0, len(firsts), most):
                at = firsts[begin : begin + most, None] + np.arange(size)
                s, ps, zs = place[at], p[at], absent[at]
                for left in range(0, size, width):
                    cut = slice(left, left + width)
                    a, za = ps[:, cut, None], zs[:, cut, None]
                    b, zb = ps[:, None, :], zs[:, None, :]
                    value = (f(a, b) - f(a, zb) - f(za, b) + f(za, zb)).ravel()
                    key = ((s[:, cut, None] << 32) | s[:, None, :]).ravel()
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    heads = np.flatnonzero(np.diff(key, prepend=-1))
                    key, value = key[heads], np.add.reduceat(value[order], heads)
                    apart = (key >> 32) != (key & 0xFFFFFFFF)
                    key, value = key[apart], value[apart]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(value)], names=["lang", "s", "t", "value"])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(batch, last):
            """Yield the sums of the whole terms of a batch; return the rows of its unfinished last term."""
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            digest, split, place, p, absent = (batch.column(i).to_numpy() for i in range(1, 6))
            new = np.flatnonzero(np.r_[True, (np.diff(codes) != 0) | (np.diff(digest) != 0) | (np.diff(split) != 0)])
            whole = len(digest) if last else int(new[-1])
            new = new[new < whole]
            for code in np.unique(codes[new]).tolist():
                firsts = new[codes[new] == code]
                at = np.searchsorted(new, firsts[-1]) + 1
                starts = np.append(firsts, new[at] if at < len(new) else whole)
                yield from sums(langs.dictionary[code].as_py(), starts, place, p, absent)
            return batch.slice(whole)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 17:
                rest = yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0], False)
                held = [rest] if rest.num_rows else []
        if sum(b.num_rows for b in held):
            yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)

    return dealt.mapInArrow(run, "lang string, s long, t long, value long")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, bits: int = 64,
          lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank, as the module says.

    Part ``pair`` has a row for every other source of the language, part ``term`` the
    ``top`` terms that the source has in excess.  ``bits`` is the width of a digest; results do not depend on it.
    """
    small_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counts, dictionary, tables = term_counts(rows, bits)

    summed = counts.repartition("lang", "digest").groupBy("lang", *TERM, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", *TERM)
    summed = summed.withColumn("all_docs", F.sum("docs").over(term)).withColumn("all_n", F.sum("n").over(term))
    summed = summed.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    kept = stored(summed.where(F.col("all_docs") >= least_documents).select("lang", *TERM, "source", "n", "all_n", "first"), "kept_terms")
    discard(*tables)

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("own"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["size", "own"])
    every = Window.partitionBy("lang")  # a row a source
    groups = groups.withColumn("terms", F.sum("own").over(every)).withColumn("all_size", F.sum("size").over(every))
    groups = groups.withColumn("place", F.row_number().over(every.orderBy("source")).cast("long"))
    groups = stored(groups.withColumn("absent", share(F.lit(0), F.col("size"), F.col("terms"))).drop("own"), "groups")

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", *TERM, "place", "absent",
        share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("all_n"), F.col("all_size"), F.col("terms")).alias("q"))
    shares = stored(shares, "shares")
    discard(kept)

    return _pairs(shares, groups).unionByName(_terms(shares, dictionary, top))


def _terms(shares: DataFrame, dictionary: DataFrame, top: int) -> DataFrame:
    """The terms in excess; a cut at the last value comes first, so that strings are joined to few terms."""
    over = shares.where(F.col("p") > F.col("q")).select("lang", "source", *TERM, departure(F.col("p"), F.col("q")).alias("value"))
    group = Window.partitionBy("lang", "source")
    best = over.withColumn("r", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("r") <= top)
    cuts = best.groupBy("lang", "source").agg(F.min("value").alias("cut"))
    near = over.join(cuts, ["lang", "source"]).where(F.col("value") >= F.col("cut"))
    named = near.join(dictionary, TERM)
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


#: Sources that one key of the join of histograms and sources holds.
BLOCK = 64


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """How far each source is from each other source of its language."""
    shared = shared_terms(shares)
    tally = shares.groupBy("lang", F.col("place").alias("s"), "p", F.col("absent").alias("zs")).agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("place").alias("t"), F.col("absent").alias("zt"), F.floor(F.col("place") / BLOCK).alias("block"))
    blocks = others.select("lang", "block").distinct()
    met = tally.join(blocks, "lang").join(others, ["lang", "block"]).where(F.col("s") != F.col("t"))
    none = departure(F.col("zs"), F.col("zt")), departure(F.col("zt"), F.col("zs"))
    alone = met.select("lang", F.explode(F.array(
        F.struct("s", "t", (F.col("times") * (departure(F.col("p"), F.col("zt")) - none[0])).alias("value")),
        F.struct(F.col("t").alias("s"), F.col("s").alias("t"), (F.col("times") * (departure(F.col("zt"), F.col("p")) - none[1])).alias("value")))).alias("x"))
    alone = alone.select("lang", "x.*").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    sums = shared.unionByName(alone).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))

    one = groups.select("lang", F.col("place").alias("s"), "source", F.col("absent").alias("zs"), "terms")
    two = groups.select("lang", F.col("place").alias("t"), F.col("source").alias("item"), F.col("absent").alias("zt"))
    both = one.join(two, "lang").where(F.col("s") != F.col("t")).join(sums, ["lang", "s", "t"], "left")
    base = F.when(F.col("terms") > 0, F.col("terms") * departure(F.col("zs"), F.col("zt"))).otherwise(0)
    valued = both.withColumn("value", F.coalesce("value", F.lit(0)) + base)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), words AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS all_n FROM groups g JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)),
shares AS (
  SELECT *, 1 + (1000000000 * (n + 1)::HUGEINT) // (sum(n) OVER g + count(*) OVER g) AS p,
    1 + (1000000000 * (all_n + 1)::HUGEINT) // (sum(all_n) OVER g + count(*) OVER g) AS q FROM grid WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 200
"""
