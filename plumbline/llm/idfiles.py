"""Token ids as binary files: a shared zstandard dictionary, every document a frame of its own.

``write`` encodes every text, trains one dictionary on the serialized ids of a
bounded sample, compresses each document separately with it, and writes the
frames in ascending order of the key.  A store is a folder of

* ``dictionary-<sha256>``: the dictionary (empty where the sample is too small),
* ``ids-<place>-<unique>.idz``: header (magic, bytes an id, end id, the
  dictionary's sha256), frames, index, footer.  The index holds key, token
  count and offset of every document, so one document is read by two short reads,
* ``manifest``: a Parquet table of the files that count, with the ids before
  each.  A file that a lost or repeated task left behind is not in it.

``read`` gives every document back, ``fetch`` those of the wanted keys only.
Both refuse a store whose dictionary is not the one its files name.

Texts are encoded once, compressed, and stored; only frames are sorted.  Keys
that repeat are told apart by the text's hash and, where the whole row repeats,
by the place of the row, so a key that holds a third of the rows is spread over
several files.

Words are looked up before they are encoded: runs of plain characters between
spaces are cut into the words of the vocabulary's own pattern, in numpy, and each word the
process has not met is given to the library, many at once.  Everything else
between two spaces goes through the library as it is.

Defined cases: a null text is an empty one and has the end id only; rows with a
null key come first; strings of special tokens are ordinary text; an empty table
gives a store without files; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import discard, release, scratch, small_batches, steps, stored

MAGIC = b"IDZ1"
HEADER = struct.Struct("<4sBI32s")
FOOTER = struct.Struct("<QQ4s")
#: The dictionary is trained on so many documents at most, each of so few bytes of text.
SAMPLE_DOCS, SAMPLE_TEXT, DICTIONARY_BYTES = 4096, 8192, 32 << 10
#: Compressed bytes that a file is to hold.
FILE_BYTES = 16 << 20
#: Words that a process remembers before it forgets them all, some 200 bytes each.
HELD = 1_000_000
LEVEL = 3

#: Words that no normal form and no neighbour changes; the others go to the library one by one.
PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of text that are split at once.
SPLIT_BYTES = 2 << 20
#: Kinds of bytes: plain letters (a to z, and the bytes of À to ÿ without the two signs among them), digits,
#: other printable ASCII, white space, and all else.
LETTER, DIGIT, SIGN, SPACE, OTHER = range(5)
#: Stands between texts; UTF-8 has no such byte.
BETWEEN = 0xFF


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x21:0x7F] = SIGN
    kinds[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), 0xC3]] = LETTER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[[*b" \t\n\r", BETWEEN]] = SPACE
    return kinds


KINDS = _kinds()


def split_words(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, as the vocabulary's pattern cuts its lower-case form.

    A run between white space with any byte outside the plain kinds stays one
    word as it is: no rule of the vocabulary looks beyond white space.
    """
    data = np.frombuffer(bytes([BETWEEN]).join([b"", *texts, b"  "]), np.uint8).copy()
    kinds = KINDS[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    signs = (data[after] == 0x97) | (data[after] == 0xB7)  # multiplication and division sign
    kinds[after] = np.where(signs, OTHER, LETTER)

    run = np.cumsum(kinds == SPACE, dtype=np.int32)
    odd = np.zeros(int(run[-1]) + 1, bool)
    odd[run[kinds == OTHER]] = True
    plain = ~odd[run]
    capitals = plain & (data >= ord("A")) & (data <= ord("Z"))
    capitals[after] |= plain[after] & (data[after] >= 0x80) & (data[after] <= 0x9E)
    data[capitals] += 32

    cut = np.zeros(len(data), bool)  # a word starts here though no space is before
    cut[1:] = plain[1:] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
    quotes = np.flatnonzero((data[:-2] == ord("'")) & plain[:-2])
    quotes = quotes[kinds[quotes - 1] != SIGN]  # the shortened word begins where the pattern begins anew
    one, two = data[quotes + 1], data[quotes + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    cut[quotes[short | long] + 1] = False
    for ends in (quotes[short] + 2, quotes[long] + 3):
        cut[ends[ends < len(data)]] = True

    out = np.full(len(data) + int(cut.sum()), ord(" "), np.uint8)
    out[np.arange(len(data)) + np.cumsum(cut)] = data
    return [text.split() for text in out.tobytes().split(bytes([BETWEEN]))[1:]]


def chunks(data: bytes, limit: int):
    """The text in parts of about ``limit`` bytes, cut at spaces and line ends."""
    while len(data) > limit:
        at = max(data.rfind(b" ", 1, limit), data.rfind(b"\n", 1, limit))
        if at < 0:
            at = min((x for x in (data.find(b" ", limit), data.find(b"\n", limit)) if x >= 0), default=len(data))
        yield data[:at]
        data = data[at:]
    yield data


class Encoder:
    """Ids of texts under a vocabulary file whose words end in ``</w>``, as little-endian bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self.words: dict[bytes, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[bytes]) -> None:
        """Encode plain words at once; each ends with the one token that carries the end mark."""
        ids = self._library(b" ".join(words).decode())
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        if len(cuts) != len(words):
            raise ValueError("the vocabulary does not mark the end of every word")
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, cuts):
            self.words[word], start = raw[start:end], end

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        if len(self.words) > HELD:
            self.words.clear()
        split = split_words(parts)
        unknown = set().union(*split).difference(self.words)
        plain = [word for word in unknown if PLAIN.fullmatch(word)]
        if plain:
            self._learn(plain)
        for word in unknown.difference(plain):
            self.words[word] = self._library(word.decode()).tobytes()
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            for (at, _), ids in zip(held, self._parts([part for _, part in held])):
                out[at].append(ids)
            held.clear()

        for at, text in enumerate(texts):
            for part in chunks(text.encode(), SPLIT_BYTES):
                held.append((at, part))
                size += len(part)
                if size >= SPLIT_BYTES:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def trained(documents: list[bytes]) -> bytes:
    """A dictionary for the serialized ids; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, documents).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def codecs(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data), zstandard.ZstdDecompressor(dict_data=data)


def sample(docs: DataFrame, text: str) -> list[str]:
    """At most SAMPLE_DOCS different short texts, about as many as there are: a share of the hash space is taken, the same texts each time."""
    short = docs.select(F.col(text).alias("text")).where((F.octet_length("text") <= SAMPLE_TEXT) & (F.length("text") > 0))
    known = short.count()
    share = F.lit(int(min(1.0, SAMPLE_DOCS / max(known, 1)) * (1 << 53)))
    chosen = short.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 11) <= share).distinct()
    return [row["text"] for row in chosen.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCS).collect()]


def frames(docs: DataFrame, vocabulary: str, dictionary: bytes, end_id: int, key: str, text: str) -> DataFrame:
    """(key, tie, tokens, frame) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        coder, (compressor, _) = encoder(vocabulary), codecs(dictionary)
        end = np.array([end_id], coder.kind).tobytes()
        for part in steps(batches):
            ids = [coded + end for coded in coder.encode(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(one) // coder.kind.itemsize for one in ids], pa.int64()),
                pa.array([compressor.compress(one) for one in ids], pa.binary())], names=["key", "tie", "tokens", "frame"])
        release()

    return rows.mapInArrow(run, "key long, tie long, tokens long, frame binary")


class Writer:
    """One file, written from its frames in order."""

    def __init__(self, folder: str, place: int, width: int, end_id: int, digest: bytes):
        self.system, inner = filesystem(folder)
        self.name = f"ids-{place:06d}-{uuid.uuid4().hex}.idz"
        self.out = self.system.open_output_stream(f"{inner}/{self.name}")
        self.at = self.out.write(HEADER.pack(MAGIC, width, end_id, digest))
        self.keys, self.nulls, self.tokens, self.offsets = [], [], [], []

    def add(self, keys: pa.Array, tokens: pa.Array, data: list[bytes]) -> None:
        self.nulls.append(np.asarray(keys.is_null()).astype(np.uint8))
        self.keys.append(keys.fill_null(0).to_numpy())
        self.tokens.append(tokens.to_numpy())
        lengths = np.array([len(one) for one in data], np.int64)
        self.offsets.append(self.at + np.cumsum(lengths) - lengths)
        self.out.write(b"".join(data))
        self.at += int(lengths.sum())

    def close(self) -> dict:
        tokens = np.concatenate(self.tokens)
        offsets = np.append(np.concatenate(self.offsets), self.at)
        index = b"".join(part.tobytes() for part in (np.concatenate(self.keys).astype("<i8"), np.concatenate(self.nulls), tokens.astype("<i8"), offsets.astype("<i8")))
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(index)
        self.out.write(packed + FOOTER.pack(self.at, len(tokens), MAGIC))
        self.out.close()
        return {"file": self.name, "docs": len(tokens), "tokens": int(tokens.sum())}


class Reader:
    """Random access to one file of a store."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        system, inner = filesystem(folder)
        self.file = system.open_input_file(f"{inner}/{name}")
        magic, width, _, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        size = self.file.size()
        self.start, docs, tail = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{name} is not a file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        packed = self.file.read_at(size - FOOTER.size - self.start, self.start)
        index = zstandard.ZstdDecompressor().decompress(packed, max_output_size=docs * 25 + 8)
        self.keys = np.frombuffer(index, "<i8", docs)
        self.nulls = np.frombuffer(index, np.uint8, docs, docs * 8).astype(bool)
        self.tokens = np.frombuffer(index, "<i8", docs, docs * 9)
        self.offsets = np.frombuffer(index, "<i8", docs + 1, docs * 17)
        self.decompressor = codecs(dictionary)[1]

    def ids(self, offset: int, length: int, tokens: int) -> bytes:
        """The ids of one document as little-endian unsigned 32-bit integers."""
        got = np.frombuffer(self.decompressor.decompress(self.file.read_at(length, offset)), self.kind)
        if len(got) != tokens:
            raise ValueError("a document has another length than its index says")
        return got.astype("<u4").tobytes()


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> str:
    """Write all rows as a store in ``folder``, a new path all executors can reach; gives the folder back."""
    spark = docs.sparkSession
    small_batches(spark)
    coder = encoder(vocabulary)
    end = np.array([end_id], coder.kind).tobytes()
    width = coder.kind.itemsize
    dictionary = trained([ids + end for ids in coder.encode(sample(docs, text))])
    digest = hashlib.sha256(dictionary).digest()
    system, inner = filesystem(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    coded = stored(frames(docs, vocabulary, dictionary, end_id, key, text), "frames")
    total = coded.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).first()[0]
    order = ["key", "tie", "row"]
    ranged = coded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // FILE_BYTES)), *order)

    def save(batches):
        place, writer = TaskContext.get().partitionId(), None
        for part in steps(batches):
            writer = writer or Writer(folder, place, width, end_id, digest)
            writer.add(part.column(0), part.column(2), part.column(3).to_pylist())
        if writer:
            done = writer.close()
            yield pa.RecordBatch.from_pylist([{"place": place, **done}])

    saved = stored(ranged.sortWithinPartitions(*order).mapInArrow(save, "place long, file string, docs long, tokens long"), "saved")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    saved.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/manifest")
    discard(coded, saved)
    return folder


MANIFEST = "place long, file string, docs long, tokens long, start long"
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
#: Bytes of ids that a task hands over at once.
OUT_BYTES = 4 << 20


def dictionary_of(folder: str) -> bytes:
    """The store's dictionary, whose name is its sha256."""
    system, inner = filesystem(folder)
    (found,) = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("dictionary-")]
    with system.open_input_stream(found.path) as source:
        data = source.read()
    if hashlib.sha256(data).hexdigest() != found.base_name.removeprefix("dictionary-"):
        raise ValueError(f"{found.path} is damaged")
    return data


def _documents(rows):
    """Record batches of (doc_id, start, n_tokens, ids), each of about OUT_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 32
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=DOCUMENT.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=DOCUMENT.names)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count, one a task."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return manifest.repartition(max(1, manifest.count()), "place")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document of a store."""

    def every(batches):
        dictionary = dictionary_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(folder, row["file"], dictionary)
                starts = row["start"] + np.cumsum(reader.tokens) - reader.tokens
                for at, tokens in enumerate(reader.tokens.tolist()):
                    offset = int(reader.offsets[at])
                    ids = reader.ids(offset, int(reader.offsets[at + 1]) - offset, tokens)
                    yield None if reader.nulls[at] else int(reader.keys[at]), int(starts[at]), tokens, ids

    return files(spark, folder).mapInArrow(lambda batches: _documents(every(batches)), DOCUMENT)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, file, offset and length of every document, from the files' indexes alone."""
    schema = "doc_id long, start long, n_tokens long, file string, offset long, length long"

    def entries(batches):
        dictionary = dictionary_of(folder)
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(folder, row["file"], dictionary)
                starts = row["start"] + np.cumsum(reader.tokens) - reader.tokens
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.keys, pa.int64(), mask=reader.nulls), pa.array(starts, pa.int64()), pa.array(reader.tokens, pa.int64()),
                    pa.array([row["file"]] * len(starts)), pa.array(reader.offsets[:-1], pa.int64()), pa.array(np.diff(reader.offsets), pa.int64())],
                    names=["doc_id", "start", "n_tokens", "file", "offset", "length"])

    return files(spark, folder).mapInArrow(entries, schema)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the wanted keys; of the files only their indexes and these documents are read."""
    keys = wanted.select(F.col(key).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    places = index(spark, folder).join(keys, "doc_id").repartition("file").sortWithinPartitions("file", "offset")

    def some(batches):
        dictionary, name, reader = dictionary_of(folder), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, reader = row["file"], Reader(folder, row["file"], dictionary)
                yield row["doc_id"], row["start"], row["n_tokens"], reader.ids(row["offset"], row["length"], row["n_tokens"])

    return places.mapInArrow(lambda batches: _documents(some(batches)), DOCUMENT)


def digests(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, all from the written files."""
    spark = docs.sparkSession
    folder = write(docs, vocabulary, scratch(spark, "token-ids"), end_id)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
