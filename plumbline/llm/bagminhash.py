"""Near-duplicates by BagMinHash over bags of five-word shingles.

A text is a bag: its five-word shingles with their multiplicities.  Two bags
are near copies when their weighted Jaccard similarity, sum of minima over sum
of maxima, is ``similarity`` or more.

Signature.  Weights are discretised to whole levels.  Every (shingle, level)
has a Poisson process of points in time, each point with a random register; a
register keeps its earliest point over all levels that a bag reaches.  Two bags
agree in a register with probability equal to their weighted Jaccard
similarity.  Levels are generated by a hierarchy: level 1, level 2, levels 3-4,
5-8, ... are one process each at the summed rate, and a point of it then falls
on one of its levels and is dropped if the bag does not reach that level, so a
weight w costs about log w processes.  Processes run until all registers are
filled, and no further.

Candidates.  ``bands`` bands of ``rows`` registers; a pair of similarity 0.8
shares one of 40 bands of 6 but for five in a million.  Texts of equal bags are
one node.  In every bucket all nodes are compared with one of them, the hashed
least; verified links (on the texts, by the bags' overlap) are contracted to
components.  Only buckets that still hold more than one component go on: there
every pair of nodes of different components is compared by signature, in
blocks, and the pairs whose agreement is within five standard deviations of
the threshold are verified, which misses a pair of similarity 0.8 less often
than the bands do.  They are verified where they are found, the texts of their
nodes beside them, and a pair that earlier links connect already needs no look:
only links of a forest leave a task, fewer than it has nodes.  Nothing is
capped.

Defined cases: a text of one to four words is a single shingle; texts without
words are copies of equal texts only; null counts as empty; repeated rows are
copies; a class is named by its least id, and texts of one id may be in several
classes; null ids are in classes, and name one only if there is no other; texts
of any length count whole; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo
from .common import discard, free_name, release, small_batches, steps, stored
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
#: Standard deviations by which the register agreement of a pair that is verified may fall short of the threshold.
MARGIN = 5
#: Nodes of a bucket, and bytes of their texts, that a task compares with each other at once; no links depend on them.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Memo:
    """64-bit hashes of words, as signed numbers."""
    return Memo(lambda word: xxhash.xxh64_intdigest(word) - (1 << 63), lambda word: len(word) <= 64)


def bags_of(texts: list[str], memo: Memo) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text its distinct shingles, ascending, and their multiplicities."""
    found = [WORD.findall(t.lower()) for t in texts]
    words = np.array([len(f) for f in found])
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), np.int64, int(words.sum())).view(np.uint64)
    starts = np.cumsum(words) - words
    hashes = np.zeros(len(flat), np.uint64)
    short = np.repeat(words < SHINGLE, words)
    for i in range(SHINGLE):  # the shingle of a short text has all its words, and starts with the first
        n = len(flat) - i
        if n <= 0:
            break
        step = mix(hashes[:n] * np.uint64(31) + flat[i:] + GOLDEN)
        inside = np.repeat(words > i, words)[:n] | ~short[:n]
        hashes[:n] = np.where(inside, step, hashes[:n])
    out = []
    for start, n in zip(starts.tolist(), words.tolist()):
        own = hashes[start:start + max(n - SHINGLE + 1, min(n, 1))]
        own.sort()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if n else np.zeros(0, np.int64)
        out.append((own[first], np.diff(np.append(first, len(own)))))
    return out


def bag(text: str, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    return bags_of([text], memo)[0]


def similarity(one, two) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(one[1][i], two[1][j]).sum())
    whole = int(one[1].sum() + two[1].sum()) - common
    return common / whole if whole else 1.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """One row of ``m`` 16-bit registers for every bag that is not empty."""
    sizes = [len(b[0]) for b in bags]
    shingle, weight = (np.concatenate([b[i] for b in bags]) for i in (0, 1))
    of = np.repeat(np.arange(len(bags)), sizes)
    total = np.bincount(of, weight, len(bags))
    seeds, owners, rates, floors, reach = [], [], [], [], []
    level, rate = 0, 1  # a process holds the levels above ``level``, ``rate`` of them
    while (here := weight > level).any():
        seeds.append(mix(shingle[here] + np.uint64(level * int(GOLDEN) & (1 << 64) - 1)))
        owners.append(of[here])
        rates.append(np.full(int(here.sum()), rate))
        floors.append(np.full(int(here.sum()), level))
        reach.append(weight[here])
        level, rate = level + rate, max(1, level + rate if level else 1)
    seed, owner, rate, floor, reach = (np.concatenate(x) for x in (seeds, owners, rates, floors, reach))
    best = np.full(len(bags) * m, np.inf)
    spans = m * (math.log(m) + 4) / total
    todo = np.ones(len(bags), bool)
    while todo.any():
        active = np.flatnonzero(todo[owner])
        time, made = np.zeros(len(active)), 0
        while len(active):
            width = max(1, min(256, 30_000 // len(active)))  # points of each process made in this round
            steps_ = GOLDEN * np.arange(made + 1, made + width + 1, dtype=np.uint64)
            first = mix(seed[active][:, None] + steps_)
            gaps = -np.log(((first >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate[active][:, None]
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)  # adds one by one, so the width does not change a time
            row, col = np.nonzero(times <= spans[owner[active]][:, None])
            process, second = active[row], mix(first[row, col] ^ GOLDEN)
            at = floor[process] + 1 + ((second >> np.uint64(32)).astype(np.int64) * rate[process] >> 32)
            slot = owner[process] * m + ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * m >> 32)
            counts = at <= reach[process]
            np.minimum.at(best, slot[counts], times[row, col][counts])
            on = times[:, -1] <= spans[owner[active]]
            active, time, made = active[on], times[on, -1], made + width
        todo = np.isinf(best.reshape(-1, m)).any(axis=1)
        spans = np.where(todo, spans * 2, spans)  # such a bag's processes run again, twice as long
    return (mix(best.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16).reshape(-1, m)


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, t, fa, fb, sig): the bag's fingerprint and signature of every text; t tells texts of an id apart."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        memo = word_hashes()
        for part in steps(batches):
            texts = part.column(2).to_pylist()
            bags = bags_of(texts, memo)
            full = [b for b in bags if len(b[0])]
            rows = iter(signatures(full)) if full else iter(())
            sums = [(int((mix(h) * c.astype(np.uint64)).sum()), int((mix(h ^ GOLDEN) * c.astype(np.uint64)).sum())) if len(h) else
                    (xxhash.xxh64_intdigest(t, 1), xxhash.xxh64_intdigest(t, 2)) for (h, c), t in zip(bags, texts)]
            signed = [np.array([s[i] for s in sums], np.uint64).view(np.int64) for i in (0, 1)]
            sig = pa.array([next(rows).tobytes() if len(b[0]) else None for b in bags], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signed[0]), pa.array(signed[1]), sig], schema=schema)
        release()

    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(plain).alias("t"), plain.alias("body"))
    return rows.mapInArrow(run, "doc_id long, t long, fa long, fb long, sig binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough; ``texts`` is (node, body)."""
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        memo, held = word_hashes(), OrderedDict()

        def of(node, text):
            if node not in held:
                held[node] = bag(text.as_py(), memo)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[node]

        for part in steps(batches):
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            good = [i for i, (x, y) in enumerate(zip(a, b))
                    if similarity(of(x, part.column(3)[i]), of(y, part.column(2)[i])) >= least - 1e-12]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in good], pa.int64()) for v in (a, b)], schema=schema)
        release()

    return pairs.select("a", "b", "body_b", "body_a").mapInArrow(run, "a long, b long")


class Group(NamedTuple):
    """Nodes of two chunks of a bucket (or of one): arrays by node, and their texts where they are wanted."""

    key: tuple
    side: np.ndarray
    node: np.ndarray
    comp: np.ndarray
    band: np.ndarray
    sig: np.ndarray
    body: list[str]


MEMBERS = "bucket long, i long, j long, side long, node long, comp long, band int, sig binary"


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """The groups of members sorted by (bucket, i, j); one is held at a time, as large as CHUNK and CHUNK_BYTES let it be."""
    held, here = [], None

    def closed():
        bodies = list(chain.from_iterable(h[5] for h in held))
        return Group(here, *(np.concatenate([h[k] for h in held]) for k in range(5)), bodies)

    for part in steps(batches):
        key = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        rows = [part.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7)]
        rows.append(np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint16).reshape(part.num_rows, -1))
        bodies = part.column(8).to_pylist() if part.num_columns > 8 else []
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]).tolist()
        for start, end in zip(cuts, cuts[1:]):
            if here != tuple(key[start].tolist()):
                if held:
                    yield closed()
                held, here = [], tuple(key[start].tolist())
            held.append((*(r[start:end] for r in rows), bodies[start:end]))
    if held:
        yield closed()


def candidates(group: Group, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places x in the group, each with places of other components that agree with it in enough registers, the best first.

    Only nodes outside the group's largest component are an x; of two such
    nodes the first has the second.  Pairs within a chunk are its own group's,
    and a pair that shares several buckets is given in that of its first
    common band only.
    """
    _, side, node, comp, band, sig, _ = group
    names, which, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    inside, place, apart = which == sizes.argmax(), np.arange(len(node)), len(np.unique(side)) > 1
    for x in np.flatnonzero(~inside).tolist():
        same = (sig == sig[x]).sum(axis=1)
        other = (comp != comp[x]) & (inside | (place > x)) & (same >= least * REGISTERS)
        if apart:
            other &= side != side[x]
        found = np.flatnonzero(other)
        common = (sig[found] == sig[x]).reshape(len(found), BANDS, ROWS).all(axis=2)
        found = found[common.argmax(axis=1) == band[x]]
        if len(found):
            yield x, found[np.argsort(-same[found], kind="stable")]


def dealt(members: DataFrame) -> DataFrame:
    return members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def involved(members: DataFrame, least: float) -> DataFrame:
    """The members that are in a pair to verify, at most once a group."""
    schema = pa.schema([*((n, pa.int64()) for n in ("bucket", "i", "j", "side", "node", "comp")), ("band", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        for group in groups(batches):
            wanted = np.zeros(len(group.node), bool)
            for x, others in candidates(group, least):
                wanted[x] = wanted[others] = True
            at = np.flatnonzero(wanted)
            if len(at):
                keys = [np.full(len(at), k) for k in group.key]
                rows = [*keys, group.side[at], group.node[at], group.comp[at], group.band[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array([s.tobytes() for s in group.sig[at]], pa.binary())], schema=schema)
        release()

    return dealt(members).mapInArrow(run, MEMBERS)


def forest(members: DataFrame, register: float, least: float) -> DataFrame:
    """Verified links (a, b) between components of each group's nodes; members have their texts.

    Every candidate pair is verified unless links found before already connect
    its two components, so a group gives fewer links than it has nodes and no
    list of pairs leaves the task.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        memo = word_hashes()
        for group in groups(batches):
            bags, above, links = {}, {}, []

            def of(place):
                if place not in bags:
                    own = bag(group.body[place], memo)
                    bags[place] = own, int(own[1].sum())
                return bags[place]

            def top(comp):
                while (up := above.get(comp, comp)) != comp:
                    above[comp] = above.get(up, up)
                    comp = up
                return comp

            comps = group.comp.tolist()
            for x, others in candidates(group, register):
                for y in others.tolist():
                    one, two = top(comps[x]), top(comps[y])
                    if one == two:
                        continue
                    (p, m), (q, n) = of(x), of(y)
                    # the smaller bag has to be large enough for the threshold at all
                    if min(m, n) >= least * max(m, n) - 1e-6 and similarity(p, q) >= least - 1e-12:
                        above[one] = two
                        links.append(sorted((int(group.node[x]), int(group.node[y]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], schema=schema)
        release()

    return dealt(members).mapInArrow(run, "a long, b long")


def classes_of(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for every bag (fa, fb) its class_id, class_t and class_size.

    A class is represented by its least (doc_id, t), for one id may have texts in several classes.
    """
    rows = stored(sketched(docs, key, text), "sketched")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t")))
    nodes = rows.groupBy("fa", "fb").agg(first.alias("r"), F.min("t").alias("t"), F.min("sig").alias("sig"), F.count("*").alias("n"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "fa", "fb", "n", F.col("r.doc_id").alias("rep"),
                                F.coalesce("r.t", "t").alias("t"), "sig"), "nodes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    buckets = nodes.where(F.col("sig").isNotNull()).select("node", F.posexplode(bands).alias("band", "bucket"))
    buckets = buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")
    buckets = stored(buckets, "buckets")
    order = F.struct(F.xxhash64("bucket", "node").alias("h"), "node")
    leaders = buckets.groupBy("bucket").agg(F.min(order).alias("l")).select("bucket", F.col("l.node").alias("leader"))
    star = buckets.join(leaders, "bucket").where(F.col("node") != F.col("leader"))
    star = stored(star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "star")

    bodies = docs.select(F.col(key).cast("long").alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bodies = bodies.withColumn("t", F.xxhash64("body"))
    linked = buckets.select("node").distinct().join(nodes.select("node", "rep", "t"), "node")
    same = F.col("p.rep").eqNullSafe(F.col("q.rep")) if nodes.where(F.col("rep").isNull()).limit(1).count() else F.col("p.rep") == F.col("q.rep")
    texts = bodies.alias("p").join(linked.alias("q"), same & (F.col("p.t") == F.col("q.t"))).select("node", "body")
    texts = texts.groupBy("node").agg(F.min("body").alias("body")).select("node", "body", F.octet_length("body").cast("long").alias("bytes"))
    texts = stored(texts, "texts")

    edges = stored(verified(star, texts, least), "links")
    roots = components(edges)
    known = buckets.join(roots, "node", "left").select("bucket", "band", "size", "node", F.coalesce("root", "node").alias("comp"))
    known = stored(known.join(texts.select("node", "bytes"), "node"), "known")
    open_ = known.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum("bytes").alias("mass")).where("x <> y").select("bucket", "mass")
    rest = known.join(open_, "bucket").join(nodes.select("node", "sig"), "node")
    chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("mass") / CHUNK_BYTES))
    rest = rest.withColumn("side", F.pmod(F.xxhash64("node"), chunks)).withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1).cast("array<bigint>")))
    rest = rest.select("bucket", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "node", "comp", "band", "sig")
    margin = least - MARGIN * math.sqrt(least * (1 - least) / REGISTERS)
    more = stored(involved(rest, margin), "more")
    edges = edges.unionByName(stored(forest(more.join(texts.select("node", "body"), "node").select(*more.columns, "body"), margin, least), "links"))
    discard(buckets, star, texts, known, more)  # what follows reads the links only

    named = nodes.select("node", "fa", "fb", "n", "rep", "t").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "t")))
    classes = named.groupBy("root").agg(first.alias("r"), F.sum("n").alias("class_size"))
    classes = classes.select("root", F.col("r.rep").alias("class_id"), F.col("r.t").alias("class_t"), "class_size")
    return rows, named.join(classes, "root").select("fa", "fb", "class_id", "class_t", "class_size")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and class_size of every row; a class is a component of near copies."""
    rows, named = classes_of(docs, key, text, least)
    return rows.select("doc_id", "fa", "fb").join(named, ["fa", "fb"]).select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class, that of its least id and text, with its own columns; rows with a null id stay."""
    named = classes_of(docs, "doc_id", "text", SIMILARITY)[1]
    own, nth = free_name(docs, "_t"), free_name(docs, "_nth")
    kept = named.where(F.col("class_id").isNotNull()).select(F.col("class_id").alias("doc_id"), F.col("class_t").alias(own)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, ["doc_id", own], "left_semi")
    plain = {f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)}
    by = [F.col(c) if c in plain else F.to_json(F.struct(c)) for c in docs.columns if c != "doc_id"]  # maps have no order
    alone = Window.partitionBy("doc_id", own).orderBy(*by)
    rows = rows.withColumn(nth, F.row_number().over(alone)).where(F.col(nth) == 1).select(*docs.columns)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))
