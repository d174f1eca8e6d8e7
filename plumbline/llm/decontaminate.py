"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index holds, for every word, the items that have it and what the word adds
to the item's BM25 score, as a share of the item's score against itself; so a
passage's score for an item is the share of the item's weight it covers (words
counted once).  Postings are in blocks of items, and every word keeps its
largest share in each block, and in each of at most 64 runs of blocks.

Every passage of every text is a query: windows of two stretches, a stretch
having as many words as the longest item, so that any run as long as an item
lies whole in a window.  All items above the threshold are found: a window
whose words' largest shares within a run of blocks add up to less cannot reach
it there (the bound that WAND skips by), nor can a block whose block maxima do;
only the remaining blocks are scored.  The bounds of the runs are added up for
all windows of many texts at once.

What is found is verified on the words themselves: the question's word
trigrams must be in the passage, and the words of the answer in order, in a run
little longer or shorter than the answer, so that words may be put in, left out
or changed.  The answer is what follows the last question mark; an item without
one, or with an answer of under ``SHORT_ANSWER`` words, is verified as a whole,
like a question.  Questions of under ``SHORT_QUESTION`` words, of whose trigrams
one changed word may spoil too many, are verified in order like answers.

The index is sent to the tasks in shards of at most ``shard_items`` items and
``shard_chars`` characters, so its size is bounded whatever the benchmark's.
Texts are not shuffled.

Defined cases: null and empty texts match nothing, nor do items without words;
items of equal text match alike; texts of any length are scanned whole, window
by window; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, free_name, release, small_batches, steps

WORD = re.compile(r"\w+")
THRESHOLD = 0.6
QUESTION_OVERLAP = 0.6
ANSWER_OVERLAP = 0.6
SHORT_QUESTION, SHORT_ANSWER = 10, 4
BLOCK = 4
RUNS = 64
SHARD_ITEMS, SHARD_CHARS = 50_000, 32 << 20
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item; without an answer to tell by, all words are the question."""
    cut = text.rfind("?") + 1
    question, answer = words(text[:cut]), words(text[cut:])
    return (question, answer) if question and len(answer) >= SHORT_ANSWER else (question + answer, [])


def trigrams(found: list[str]) -> set:
    return set(zip(found, found[1:], found[2:])) or {tuple(found)}


def common_length(one: list[str], two: list[str]) -> int:
    """Length of the longest common subsequence, a bit for every word of ``one``."""
    places: dict[str, int] = {}
    for i, word in enumerate(one):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << len(one)) - 1
    left = whole
    for word in two:
        here = left & places.get(word, 0)
        left = (left + here | left - here) & whole
    return len(one) - left.bit_count()


def in_order(answer: list[str], passage: list[str]) -> float:
    """Share of the answer's words that a run of the passage has in their order; the run starts and ends at most
    a quarter of the answer's length beside where the answer would."""
    if not answer:
        return 1.0
    at: dict[str, list] = {}
    for i, word in enumerate(passage):
        at.setdefault(word, []).append(i)
    shifts = Counter(i - j for j, word in enumerate(answer) for i in at.get(word, ()))
    slack, best = max(1, len(answer) // 4), 0
    near = Counter()  # matches within the slack of a shift; no run there has more words in order
    for shift, n in shifts.items():
        for by in range(-slack, slack + 1):
            near[shift + by] += n
    for shift, n in near.most_common():
        if n <= best:
            break
        best = max(best, common_length(answer, passage[max(0, shift - slack):max(0, shift + len(answer) + slack)]))
    return best / len(answer)


class Index:
    """One shard of items."""

    def __init__(self, items: list[tuple[int, str]], document_frequency: dict[str, int], n_items: int, mean_length: float):
        self.ids, self.texts = [], []
        bags = []
        for item, text in items:
            found = words(text)
            if found:
                self.ids.append(item)
                self.texts.append((found, *parts(text)))
                bags.append(Counter(found))
        self.term = {w: i for i, w in enumerate(sorted(set().union(*bags)))} if bags else {}
        self.stretch = max((len(t[0]) for t in self.texts), default=1)
        postings: list[list] = [[] for _ in self.term]
        for number, bag in enumerate(bags):
            length = sum(bag.values())
            weights = {}
            for word, n in bag.items():
                df = document_frequency[word]
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                weights[word] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_length))
            total = sum(weights.values())
            for word, weight in weights.items():
                postings[self.term[word]].append((number, weight / total))
        self.items = [np.array([p[0] for p in post], np.int64) for post in postings]
        self.shares = [np.array([p[1] for p in post]) for post in postings]
        self.blocks = -(-len(bags) // BLOCK)
        self.block_largest = np.zeros((len(self.term), max(self.blocks, 1)))
        for term, (numbers, shares) in enumerate(zip(self.items, self.shares)):
            np.maximum.at(self.block_largest[term], numbers // BLOCK, shares)

        per_run = -(-max(self.blocks, 1) // RUNS)
        starts = np.arange(0, max(self.blocks, 1), per_run)
        self.run_largest = np.maximum.reduceat(self.block_largest, starts, axis=1).T.copy() if self.term else np.zeros((1, 0))
        self.run_blocks = [slice(x, x + per_run) for x in starts.tolist()]

    def found(self, terms: np.ndarray, runs: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items in some runs of blocks whose share covered by these distinct terms reaches the threshold."""
        alive = np.zeros(self.blocks, bool)
        for run in runs:
            here = self.run_blocks[run]
            alive[here] = self.block_largest[terms, here].sum(axis=0) >= threshold
        if not alive.any():
            return []
        scores = np.zeros(self.blocks * BLOCK)
        for term in terms.tolist():
            numbers = self.items[term]
            here = alive[numbers // BLOCK]
            scores[numbers[here]] += self.shares[term][here]
        best = np.flatnonzero(scores >= threshold)
        return list(zip(best.tolist(), scores[best].tolist()))

    def candidates(self, texts: list[list[str]], threshold: float):
        """(text number, first word, runs of blocks, distinct terms) of the windows that may reach the threshold."""
        lengths = np.array([len(t) for t in texts], np.int64)
        stretches = -(-lengths // self.stretch)
        first = np.concatenate([[0], np.cumsum(stretches)])
        get = self.term.get
        terms = np.array([get(w, -1) for t in texts for w in t], np.int64)
        of = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = terms >= 0
        pairs = np.unique((first[of[known]] + at[known] // self.stretch) * max(len(self.term), 1) + terms[known])
        where, terms = pairs // max(len(self.term), 1), pairs % max(len(self.term), 1)
        bounds = np.stack([np.bincount(where, largest[terms], first[-1]) for largest in self.run_largest], axis=1)
        # a window is a stretch and the next; a word in both counts once
        both = pairs[np.isin(pairs + max(len(self.term), 1), pairs, assume_unique=True)]
        shared, again = both // max(len(self.term), 1), both % max(len(self.term), 1)
        twice = np.stack([np.bincount(shared, largest[again], first[-1]) for largest in self.run_largest], axis=1)
        text_of = np.repeat(np.arange(len(texts)), stretches)
        next_ = np.zeros_like(bounds)
        next_[:-1] = np.where((text_of[1:] == text_of[:-1])[:, None], bounds[1:] - twice[:-1], 0)
        windows, runs = np.nonzero(bounds + next_ >= threshold - 1e-9)
        for window in np.unique(windows).tolist():
            text = int(text_of[window])
            end = window + 2 if window + 1 < first[text + 1] else window + 1
            here = np.unique(terms[np.searchsorted(where, window):np.searchsorted(where, end)])
            yield text, (window - int(first[text])) * self.stretch, runs[windows == window].tolist(), here

    def scan(self, texts: list[list[str]], threshold: float, question: float, answer: float) -> dict[tuple, tuple]:
        """(text number, item number) -> (score, question overlap, answer overlap, first word) of the best verified window."""
        out: dict[tuple, tuple] = {}
        if not self.term or not any(texts):
            return out
        for text, start, runs, terms in self.candidates(texts, threshold):
            for number, score in self.found(terms, runs, threshold):
                part = texts[text][start:start + 2 * self.stretch]
                _, asked, answered = self.texts[number]
                if len(asked) < SHORT_QUESTION:
                    overlap = in_order(asked, part)
                else:
                    wanted = trigrams(asked)
                    overlap = len(wanted & trigrams(part)) / len(wanted)
                rest = in_order(answered, part)
                if overlap >= question and rest >= answer and ((text, number) not in out or (overlap, rest) > out[text, number][1:3]):
                    out[text, number] = (score, overlap, rest, start)
        return out


@lru_cache(maxsize=1)
def built(shared) -> Index:
    """The index of a broadcast shard, built once per worker."""
    return Index(*shared.value)


def _shards(items: DataFrame, shard_items: int, shard_chars: int):
    """Broadcast index shards of bounded size, with statistics over all items."""
    spark = items.sparkSession
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    found = F.array_remove(F.split(F.lower("text"), r"(?U)[^\w]+"), "")
    tokens = items.select("item_id", found.alias("w"))
    facts = tokens.where(F.size("w") > 0).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).first()
    frequency = tokens.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = max(1, -(-size["n"] // shard_items), -(-(size["chars"] or 0) // max(1, shard_chars // 2)))
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", F.lit(9)), F.lit(shards)) == shard).collect()  # bounded by the two limits
        used = sorted({w for r in own for w in words(r["text"])})
        wanted = spark.createDataFrame([(w,) for w in used] or [("",)], "w string")
        counts = {r["w"]: r["df"] for r in frequency.join(wanted, "w").collect()}
        counts = {w: counts.get(w, 1) for w in used}
        yield spark.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in own], counts, facts["n"] or 1, facts["mean"] or 1.0))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP,
          answer: float = ANSWER_OVERLAP, shard_items: int = SHARD_ITEMS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and first_word of every leaked item."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
    kinds = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"

    def one(shared) -> DataFrame:
        def run(batches):
            index = Index(*shared.value)
            for batch in steps(batches, 1 << 20):
                keys, texts = batch.column(0), [words(text) for text in batch.column(1).to_pylist()]
                found = index.scan(texts, threshold, question, answer)
                rows = [(keys[text].as_py(), index.ids[number], *row) for (text, number), row in found.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            release()

        return docs.select("doc_id", "text").mapInArrow(run, kinds)

    return reduce(DataFrame.unionByName, [one(shared) for shared in _shards(items, shard_items, shard_chars)])


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP,
          answer: float = ANSWER_OVERLAP) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    out, flag = docs, free_name(docs, "leaked")
    for shared in _shards(items, SHARD_ITEMS, SHARD_CHARS):
        at = docs.columns.index("text")

        def fill(part, shared=shared):
            found = built(shared).scan([words(t) for t in part.column(at).to_pylist()], threshold, question, answer)
            leaked = {text for text, _ in found}
            return [pa.array([i in leaked for i in range(part.num_rows)], pa.bool_())]

        out = add_columns(out, [T.StructField(flag, T.BooleanType(), False)], fill).where(~F.col(flag)).drop(flag)
    return out.select(*docs.columns)
