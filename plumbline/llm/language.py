"""Language identification with rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to
three characters, a blank on either side of a word).  A document's own most
frequent n-grams are ranked the same way; the out-of-place distance to a
profile is the sum, over them, of how far the two ranks are apart, and the
profile's length for an n-gram it lacks.  The nearest profile wins.  The score
is 1 - distance / largest possible distance.

Profiles count every training document: each task counts its n-grams, Spark
adds the counts and keeps the first ``length`` of each language.  Only the
profiles reach the driver: languages times ``length`` rows.

Defined cases: null texts and texts without letters are ``und`` with score 0,
as is everything when nothing was learned; equal counts rank by code points,
equal distances by language name; texts of any length are counted whole, in
chunks; rows with a null id are not learned from and not held out; repeated
rows are predicted each; columns ``lang`` and ``source`` are never inputs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, release, small_batches, steps

UNKNOWN = "und"
#: Stands for a blank in a packed n-gram; no letter, and not 0, so that packed n-grams of different lengths differ.
BLANK = 1
LENGTH = 400
#: Characters counted at once; counts of the chunks are added.
CHUNK = 1 << 20
#: Counted n-grams a training task holds before it hands them on.
HELD = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters one BLANK, and one at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes[~letters()[codes]] = BLANK
    codes = np.concatenate([[BLANK], codes, [BLANK]])
    return codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Packed n-grams that start at any position: 21 bits a character; words are not crossed."""
    one = codes[codes != BLANK]
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.concatenate([one, two, three[codes[1:-1] != BLANK]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, ascending, and their counts."""
    found = []
    codes = _codes(text)
    for start in range(0, max(1, len(codes) - 2), CHUNK):  # a chunk ends with the first two characters of the next
        last = start + CHUNK >= len(codes) - 2
        part = codes[start:] if last else codes[start:start + CHUNK + 2]
        grams = _grams(part)
        if not last:  # n-grams that start in the shared characters belong to the next chunk
            shared = part[-2:]
            extra = np.concatenate([shared[shared != BLANK], [(shared[0] << 21) | shared[1]]])
            values, counts = np.unique(grams, return_counts=True)
            np.subtract.at(counts, np.searchsorted(values, extra), 1)
            found.append((values, counts))
        else:
            found.append(np.unique(grams, return_counts=True))
    if len(found) == 1:
        return found[0]
    values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
    return values[counts > 0], counts[counts > 0]


def ranked(text: str, length: int) -> np.ndarray:
    """The most frequent n-grams, in order."""
    values, counts = counted(text)
    if len(counts) > length:  # all of at least the last place's count, so that ties are decided by code
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:length]


def profiles(docs: DataFrame, length: int = LENGTH, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank) of every language: ``length`` rows each, counted over all given documents."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        release()
        held: dict[str, list] = {}
        size = 0

        def flush():
            for name, parts in held.items():
                values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
                for i in range(0, len(values), 1 << 16):
                    part = values[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(sums[i:i + (1 << 16)])], schema=schema)

        for batch in steps(batches):
            for body, name in zip(batch.column(0), batch.column(1)):
                counts = counted(body.as_py())
                held.setdefault(name.as_py(), []).append(counts)
                size += len(counts[0])
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()
        release()

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    total = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", order).where(F.col("rank") <= length).select("lang", "gram", "rank")


def predict(docs: DataFrame, learned: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """The frame with ``lang_pred`` and ``score`` of every whole text."""
    rows = learned.collect()
    names = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    place = np.full((len(grams) + 1, len(names)), -1, np.int32)  # the last row is of n-grams in no profile
    for r in rows:
        place[np.searchsorted(grams, r["gram"]), names.index(r["lang"])] = r["rank"] - 1
    shared, at = docs.sparkSession.sparkContext.broadcast((names, grams, place)), docs.columns.index(text)

    def guess(body):
        names, grams, place = shared.value
        if not body or not names:
            return UNKNOWN, 0.0
        top = ranked(body, length)
        if not len(top):
            return UNKNOWN, 0.0
        found = np.searchsorted(grams, top)
        found[(found == len(grams)) | (grams[np.minimum(found, len(grams) - 1)] != top)] = len(grams)
        ranks = place[found]
        away = np.where(ranks < 0, length, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(away.argmin())
        return names[best], 1 - float(away[best]) / (length * len(top))

    def fill(part):
        got = [guess(body.as_py()) for body in part.column(at)]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return add_columns(docs, [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)], fill)


def fold(column: str = "doc_id") -> F.Column:
    """The remainder by 3 of the checksum of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def identify(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the two other folds."""
    learned = profiles(docs.where(fold() != 1), length)
    out = predict(docs.select("doc_id", "text"), learned, length)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def readable(docs: DataFrame, least: float = 0.0, length: int = LENGTH) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, with their own columns."""
    learned = profiles(docs.where(fold() != 1), length)
    kept = predict(docs, learned, length).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*docs.columns)
