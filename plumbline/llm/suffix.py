"""Removal of repeated byte strings: sparse suffixes, a prefilter of their prefixes in levels, suffix arrays per prefix.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else in the corpus goes.

Sparse suffixes.  A suffix is kept only at anchors: of every window of
``length`` bytes, the place whose next ``GRAM`` bytes hash lowest (the first of
equals).  The choice depends on the window's content alone, so equal windows
have their anchors at equal offsets, and each window belongs to one anchor;
there is about one anchor in ``length / 2.4`` bytes.

Prefilter.  Documents come in batches, hash slices of the table.  A batch's
distinct fingerprints of the first ``GRAM`` bytes of suffixes become a level of
rank 0, after they were joined with every existing level for prefixes that both
have.  Two levels of one rank are merged to one of the next rank, so there are
about log2(batches) levels and a fingerprint is rewritten as often.  Levels hold
no places and are deleted at the end; later batches cannot be added.

Long matches.  Suffixes whose prefix occurs again fetch the bytes around them.
Those of one prefix are sorted twice, by what follows and by what precedes
backwards: two suffix arrays with the longest common prefixes of neighbours.
Windows at the same offset l of two anchors are equal exactly when the
neighbours' common prefixes are at least ``length - l`` to the right and ``l``
to the left, which cuts either array into runs; windows that share both runs
with another are repeated.  A prefix that occurs over ``group_limit`` times is
not gathered: its windows are counted by a 128-bit fingerprint instead, in
grouped aggregation.  Both ways give the same rows.

Documents of equal text are known by their fingerprint; one of them goes
through the index, and all are repeated whole if they are long enough.  Their common
places count once when prefixes are counted.

Defined cases: null counts as empty; texts under ``length`` bytes stay whole
(they have no such string); repeated rows are copies; null ids are documents of
their own; texts of any length are worked on whole, in chunks; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, small_batches, steps, stored

LENGTH, GRAM = 200, 32
BATCHES = 4
GROUP_LIMIT = 20_000
#: Bytes whose anchors are found at once, and contexts that are compared at once.
CHUNK = 1 << 19
COMPARED = 16_384
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the 32 bytes from every place on."""
    h = data.astype(np.uint64) + np.uint64(1)
    for i, odd in enumerate(ODD):
        h = h[: -(1 << i)] * odd + h[1 << i:]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(gram, anchor, first window, last window) of all anchors of concatenated texts; ``ends`` are the texts' ends."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = grams(data)
    bits = np.uint64(20)
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    key = np.minimum(key[:n], key[width - reach:][:n])
    at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    inside = np.ones(n, bool)  # windows that lie in one text
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1):end] = False
    windows = np.flatnonzero(inside)
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = at[windows]
    new = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1])
    last = np.concatenate([new[1:] - 1, [len(windows) - 1]])
    return h[at[new]].view(np.int64), at[new], windows[new], windows[last]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, rid, t, body): rid and t name a row; rows of equal id and text share them."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), plain.alias("body")).withColumn("t", F.xxhash64("body"))
    return rows.select("doc_id", F.xxhash64("doc_id", F.lit(5), "t").alias("rid"), "t", "body")


def suffixes(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, rid, t, loc) of every anchor; loc packs its place and the offsets of its last and first window."""
    small_batches(rows.sparkSession)
    schema = pa.schema([("gram", pa.int64()), ("rid", pa.int64()), ("t", pa.int64()), ("loc", pa.int64())])

    def pieces(part):
        """Runs of texts of about CHUNK bytes; a longer text in overlapping chunks."""
        texts, owners, offsets, size = [], [], [], 0
        for row, text in enumerate(part.column(2).to_pylist()):
            data = text.encode()
            for start in range(0, max(1, len(data) - length + 1), CHUNK - length):
                piece = data[start:start + CHUNK - 1] if len(data) > CHUNK else data
                if len(piece) >= length:
                    texts.append(piece)
                    owners.append(row)
                    offsets.append(start)
                    size += len(piece)
                if size >= CHUNK // 2:
                    yield texts, owners, offsets
                    texts, owners, offsets, size = [], [], [], 0
                if len(data) <= CHUNK:
                    break
        if texts:
            yield texts, owners, offsets

    def run(batches):
        for part in steps(batches):
            rid, t = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for texts, owners, offsets in pieces(part):
                ends = np.cumsum([len(x) for x in texts])
                gram, at, first, last = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
                of = np.searchsorted(ends, first, side="right")
                starts = ends - [len(x) for x in texts]
                place = at - starts[of] + np.array(offsets)[of]
                loc = (place << 16) | ((at - last) << 8) | (at - first)
                row = np.array(owners)[of]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, rid[row], t[row], loc)], schema=schema)
        release()

    return rows.select("rid", "t", "body").mapInArrow(run, "gram long, rid long, t long, loc long")


class Family:
    """Levels of distinct fingerprints of suffix prefixes; rank r holds about 2**r batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.written: list[DataFrame] = []

    def _written(self, run: DataFrame) -> DataFrame:
        self.written.append(stored(run.sortWithinPartitions("gram"), "level"))
        return self.written[-1]

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Take in a batch of suffixes; (gram) frames of prefixes that it repeats, in itself or in a level.

        The same place of equal texts is one place, so that copies alone make
        no prefix repeated; equal texts must be in one batch.
        """
        place = F.xxhash64("t", "loc")
        own = batch.groupBy("gram").agg((F.min(place) != F.max(place)).alias("again"))
        run = self._written(own)
        found = [run.where("again").select("gram")]
        run = run.select("gram")
        found += [run.join(level, "gram", "left_semi") for level in self.levels.values()]
        rank = 0
        while rank in self.levels:
            run, rank = self._written(run.unionByName(self.levels.pop(rank)).distinct()), rank + 1
        self.levels[rank] = run
        return found


def repeated_prefixes(entries: DataFrame, family: Family, batches: int = BATCHES) -> DataFrame:
    """(gram) of all prefixes at several places; ``entries`` are split into batches by a column ``batch``, equal texts together."""
    found = []
    for batch in range(batches):
        found += family.add(entries.where(F.col("batch") == batch))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _common(rows: list[bytes], order: list[int], width: int) -> np.ndarray:
    """Common prefix lengths of neighbours in an order; the first 8 bytes are the group's, -1 if they differ."""
    lengths = np.array([len(rows[i]) for i in order])
    table = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(first, np.minimum(lengths[1:], lengths[:-1])) - 8
    return np.where(common < 0, -1, common)


def repeated_windows(groups: np.ndarray, low: np.ndarray, high: np.ndarray, contexts: list[bytes], length: int = LENGTH):
    """(least, largest) offset of the repeated windows of every anchor; largest is -1 where there is none.

    A context starts ``high`` bytes before its anchor and holds the windows of
    the offsets from ``low`` to ``high``.
    """
    heads = [int(g).to_bytes(8, "big", signed=True) for g in groups]
    right = [h + c[k:] for h, c, k in zip(heads, contexts, high.tolist())]
    left = [h + c[:k][::-1] for h, c, k in zip(heads, contexts, high.tolist())]
    n = len(contexts)
    arrays = []
    for rows, width in ((right, length + 8), (left, length - GRAM + 8)):
        order = sorted(range(n), key=rows.__getitem__)
        arrays.append((np.array(order), _common(rows, order, width)))
    least, largest = np.full(n, length), np.full(n, -1)
    runs = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for offset in range(int(low.min()), int(high.max()) + 1):
        active = np.flatnonzero((low <= offset) & (offset <= high))
        if len(active) < 2:
            continue
        for (order, common), run, need in zip(arrays, runs, (length - offset, offset)):
            run[order[1:]] = np.cumsum(common < need)
            run[order[0]] = 0
        pair = runs[0][active] * n + runs[1][active]
        by = np.argsort(pair, kind="stable")
        ordered = pair[by]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(by), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = active[by[again]]
        least[hit] = np.minimum(least[hit], offset)
        largest[hit] = offset
    return least, largest


CONTEXTS = "gram long, rid long, t long, loc long, context binary"


def contexts(suspects: DataFrame, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """The suspects with the bytes that their windows cover; of repeated rows a task takes the first."""
    per_text = suspects.groupBy("rid", "t").agg(F.collect_set(F.struct("gram", "loc")).alias("anchors"))  # bounded by the text
    found = rows.join(per_text, ["rid", "t"]).select("doc_id", "rid", "t", "body", "anchors")
    schema = pa.schema([("gram", pa.int64()), ("rid", pa.int64()), ("t", pa.int64()), ("loc", pa.int64()), ("context", pa.binary())])

    def run(batches):
        seen = set()  # a rid is a hash of id and text
        for part in steps(batches):
            for i, rid in enumerate(part.column(1).to_pylist()):
                if rid in seen:
                    continue
                seen.add(rid)
                data = part.column(3)[i].as_py().encode()
                values = part.column(4)[i].values
                gram, loc = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                place, low, high = loc >> 16, (loc >> 8) & 255, loc & 255
                cut = [data[a:b] for a, b in zip((place - high).tolist(), (place - low + length).tolist())]
                own = [np.full(len(loc), part.column(k)[i].as_py()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, own), pa.array(loc), pa.array(cut, pa.binary())], schema=schema)
        release()

    return found.mapInArrow(run, CONTEXTS)


def matched(around: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, t, start, end) of the repeated bytes at every anchor, prefix by prefix."""
    schema = pa.schema([("rid", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def spans(held):
        gram, rid, t, loc = (np.concatenate([h[i] for h in held]) for i in range(4))
        place, low, high = loc >> 16, (loc >> 8) & 255, loc & 255
        least, largest = repeated_windows(gram, low, high, [c for h in held for c in h[4]], length)
        hit = np.flatnonzero(largest >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(x[hit]) for x in (rid, t, place - largest, place - least + length)], schema=schema)

    def run(batches):
        held, size = [], 0
        for part in steps(batches):
            columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            texts = part.column(4).to_pylist()
            cuts = [0, *(np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1).tolist(), len(texts)]
            for start, end in zip(cuts, cuts[1:]):
                other = bool(held) and held[-1][0][-1] != columns[0][start]
                if other and size >= COMPARED:
                    yield spans(held)
                    held, size = [], 0
                held.append((*(c[start:end] for c in columns), texts[start:end]))
                size += end - start
        if held:
            yield spans(held)
        release()

    dealt = around.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "rid long, t long, start long, end long")


def counted(around: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same rows for prefixes too frequent to gather: windows counted by fingerprint."""
    high, low = F.col("loc").bitwiseAND(255), F.shiftright("loc", 8).bitwiseAND(255)
    windows = around.select("rid", "t", "loc", "context", F.explode(F.sequence(low, high)).alias("offset"))
    window = F.substring("context", (F.col("loc").bitwiseAND(255) - F.col("offset") + 1).cast("int"), F.lit(length))
    windows = windows.select("rid", "t", "loc", "offset", F.xxhash64(window).alias("a"), F.xxhash64(F.lit(1), window).alias("b"))
    again = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    hits = windows.join(again, ["a", "b"]).groupBy("rid", "t", "loc").agg(F.min("offset").alias("x"), F.max("offset").alias("y"))
    place = F.shiftright("loc", 16)
    return hits.select("rid", "t", (place - F.col("y")).alias("start"), (place - F.col("x") + length).alias("end"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = BATCHES,
            group_limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): the keyed rows, and (rid, t, spans) of those with repeated bytes; a span without end is all of the text."""
    rows = keyed(docs, key, text)
    batch = F.pmod(F.col("t"), F.lit(batches)).cast("int").alias("batch")
    entries = stored(suffixes(rows, length).select("gram", "rid", "t", "loc", batch), "suffixes", "batch")
    family = Family()
    grams_ = stored(repeated_prefixes(entries, family, batches), "repeated")  # a table of its own, so that a frequent prefix is split in the join

    names = rows.select("rid", "t", F.xxhash64(F.lit(1), "body").alias("t2"), F.octet_length("body").alias("size"))
    names = stored(names, "names")
    copies = names.groupBy("t", "t2", "size").agg(F.count("*").alias("n"), F.min("rid").alias("kept")).where("n > 1")
    copied = stored(names.join(copies, ["t", "t2", "size"]).select("rid", "t", "size", "kept"), "copies")
    others = copied.where("rid <> kept").select("rid", "t").distinct()

    suspects = entries.join(grams_, "gram", "left_semi").join(others, ["rid", "t"], "left_anti").select("gram", "rid", "t", "loc")
    suspects = stored(suspects, "suspects")
    discard(entries, names, grams_, *family.written)  # what follows reads the suspects and copies only
    frequent = stored(suspects.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("gram"), "frequent")
    # both parts read one exchange of the texts, as does the caller's join with the marks
    found = matched(contexts(suspects.join(frequent, "gram", "left_anti"), rows, length), length)
    if frequent.limit(1).count():
        found = found.unionByName(counted(contexts(suspects.join(frequent, "gram", "left_semi"), rows, length), length))
    whole = copied.where(F.col("size") >= length).select("rid", "t", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    marks = found.unionByName(whole).groupBy("rid", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # bounded by the text
    return rows, marks


def kept_bytes(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the runs they form."""
    kept, at, removed, runs = [], 0, 0, 0
    reach = -1
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if start > reach:
            runs += 1
        elif end <= reach:
            continue
        kept.append(data[at:max(at, start)])
        removed += end - max(at, start)
        at = reach = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def removal(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text."""
    rows, marks = repeats(docs, **settings)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for part in steps(batches):
            out = []
            for i in range(part.num_rows):
                data = part.column(3)[i].as_py().encode()
                left, removed, runs = kept_bytes(data, part.column(4)[i].as_py())
                out.append((part.column(0)[i].as_py(), len(data), removed, runs, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        release()

    joined = rows.join(marks, ["rid", "t"], "left").select("doc_id", "rid", "t", "body", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """The documents with repeated bytes taken out of their texts, in their own columns.

    What is left is read as UTF-8; bytes of a character that was cut are
    dropped.  ``n_chars`` follows the text.  A document of which nothing is
    left goes, as does an empty one.
    """
    rows, marks = repeats(docs, **settings)
    names, position = docs.columns, docs.columns.index("text")

    def run(batches):
        for part in steps(batches):
            texts = []
            for i in range(part.num_rows):
                text, spans = part.column(position)[i].as_py(), part.column(part.num_columns - 1)[i].as_py()
                texts.append(kept_bytes(text.encode(), spans)[0].decode("utf-8", "ignore") if spans else text)
            arrays = [pa.array(texts, pa.string()) if i == position else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        release()

    small_batches(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumn("_t", F.xxhash64(body)).withColumn("_rid", F.xxhash64(F.col("doc_id").cast("long"), F.lit(5), "_t"))
    marks = marks.select(F.col("rid").alias("_rid"), F.col("t").alias("_t"), F.col("spans").alias("_spans"))
    joined = named.join(marks, ["_rid", "_t"], "left")
    cut = joined.select(*docs.columns, "_spans").mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").isNull() | (F.col("text") != "")).select(*docs.columns)
