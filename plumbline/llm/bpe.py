"""Byte-level BPE encoding in linear time, and decoding.

The rank file gives every token's bytes; a merge takes place in order of rank.
Instead of merging, the encoder matches: the longest token at a place is found
in an automaton over the bytes of all tokens, read as Latin-1.
From the left, the longest token at a position is taken if it is compatible
with the token before it (merging the bytes of the two gives exactly the two),
else the next shorter token that starts there, else the encoder steps back over
the last token; a position once left that way is not entered again, so the work
is linear in the bytes.  A sequence whose neighbours are all compatible is
unique and is the one that merging gives.  Compatibility of a pair is
remembered.

Defined cases: a null text is encoded as an empty one, an empty text has no
tokens; texts of any length are encoded whole; repeated rows are encoded each;
a column that has the name of a new one is replaced; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, lasting

#: What a worker remembers at most in one generation of words, pieces or pairs; what is forgotten is computed again.
REMEMBERED = 300_000
#: Longer pieces are not remembered.
REMEMBERED_LENGTH = 64
#: A blank beside other white space.
BESIDE = regex.compile(r"\s | \s")
#: The pattern of which it is known that no piece spans the place before a blank between other characters.
CUT_AT_BLANKS = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


NEVER = 1 << 62
#: A pair of ranks is one number, the first times this plus the second.
PAIR = 1 << 30


def merged(text: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[int]:
    """The tokens of a short byte string by plain merging in order of rank, as far as ranks under ``below`` go."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Memo(dict):
    """A dictionary that computes what is missing and holds a bounded number of entries, in two generations."""

    def __init__(self, compute, keep=lambda key: True):
        super().__init__()
        self.compute, self.keep, self.older = compute, keep, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if self.keep(key):
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = [line.split() for line in rank_file.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.cuts = pattern == CUT_AT_BLANKS
        self.sizes = [len(self.bytes_of.get(rank, b"")) for rank in range(max(self.bytes_of) + 1)]
        self.reach = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.parts = Memo(lambda rank: merged(self.bytes_of[rank], self.ranks, rank))
        self.right_edge = Memo(lambda rank: self._edge(rank, -1))
        self.left_edge = Memo(lambda rank: self._edge(rank, 0))
        self.shorter = Memo(self._shorter)
        self.compatible = Memo(self._compatible)
        short = lambda text: len(text) <= REMEMBERED_LENGTH
        self.pieces = Memo(lambda piece: array("i", self.encode_piece(piece)).tobytes(), short)
        self.words = Memo(self._word, short)

    def _word(self, word: str) -> bytes:
        """Ids of a word behind a blank; its first piece is itself such a word, so nothing is remembered a second time by pieces."""
        first, *more = self.split.findall(f" {word}")
        if not more:
            return array("i", self.encode_piece(first)).tobytes()
        start = self.words[first[1:]] if len(first) > 1 and first[0] == " " else array("i", self.encode_piece(first)).tobytes()
        return start + array("i", chain.from_iterable(map(self.encode_piece, more))).tobytes()

    def _shorter(self, rank: int) -> int | None:
        """The longest token that starts the given one and is not it."""
        token = self.bytes_of[rank]
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it is merged, from its byte on, each with the rank that ends it."""
        chain_ = [rank]
        while len(self.parts[chain_[-1]]) == 2:
            chain_.append(self.parts[chain_[-1]][side])
        if len(self.bytes_of[chain_[-1]]) != 1:
            return []  # merging never makes this token
        chain_.reverse()
        return [(self.bytes_of[r], end) for r, end in zip(chain_, [*chain_[1:], NEVER])]

    def _compatible(self, pair: int) -> bool:
        """Whether merging leaves the border between two tokens alone.

        Ranks of merges rise from part to whole, so at each rank one known
        string stands on either side of the border.  The two join if their
        join ranks before what ends either; of equal ranks the left one goes
        first.
        """
        one, two = divmod(pair, PAIR)
        left, right = self.right_edge[one], self.left_edge[two]
        if not left or not right:
            return merged(self.bytes_of[one] + self.bytes_of[two], self.ranks) == [one, two]
        i = j = 0
        while True:
            (a, end_a), (b, end_b) = left[i], right[j]
            joined = self.ranks.get(a + b, NEVER)
            if joined < end_a and joined <= end_b and joined < NEVER:
                return False
            if end_a == end_b == NEVER:
                return True
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if data in self.ranks:
            return [self.ranks[data]]
        latin, ranks, compatible, sizes = data.decode("latin-1"), self.ranks, self.compatible, self.sizes
        reach, walk, last = self.reach, self.automaton.longest_prefix, len(data)
        tokens, at, open_, before, token = [], 0, bytearray(b"\1") * (last + 1), -1, None
        while at < last:
            if token is None:  # the longest token from here: the trie's longest path, cut to the last token on it
                end = at + walk(latin[at:at + reach])
                while (token := ranks.get(data[at:end])) is None:
                    end -= 1
            else:
                end = at + sizes[token]
            if open_[end] and (before < 0 or compatible[before * PAIR + token]):
                tokens.append(token)
                at, before, token = end, token, None
                continue
            token = self.shorter[token]
            while token is None:  # nothing fits here: step back, and do not come here again
                open_[at] = 0
                token = self.shorter[left := tokens.pop()]
                at -= sizes[left]
                before = tokens[-1] if tokens else -1
        return tokens

    def encode_pieces(self, text: str) -> bytes:
        """Ids, four bytes each, of the pieces of a text; one of over a million characters is split as it is read."""
        pieces = self.split.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.split.finditer(text))
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text.

        With a pattern that lets a piece hold a blank only in front or among
        white space, no piece spans the place before a blank that has other
        characters on both sides.  A text in which all blanks are such is cut
        there, and the words between are remembered with their pieces.
        """
        if not self.cuts or text[:1].isspace() or text[-1:].isspace() or BESIDE.search(text):
            return np.frombuffer(self.encode_pieces(text), np.int32)
        first, *words = text.split(" ")
        return np.frombuffer(self.encode_pieces(first) + b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lasting
def token_bytes(rank_file: bytes) -> dict[int, bytes]:
    """The bytes of every token, which is all that decoding needs; once per worker process."""
    return {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in rank_file.splitlines() if line)}


@lasting
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(rank_file, pattern)


def _shared(df: DataFrame, rank_path: str):
    """The rank file as seen by tasks; it (under 2 MB) is read on the driver only."""
    return df.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())


def _ids(own: Codec, texts: pa.Array) -> pa.ListArray:
    ids = [own.encode(text.as_py() or "") for text in texts]
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))


def _texts(of: dict[int, bytes], ids: pa.ListArray) -> pa.Array:
    values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([b"".join(map(of.__getitem__, values[a:b].tolist())) for a, b in zip(ends, ends[1:])], pa.binary())


def encode(df: DataFrame, rank_path: str, pattern: str, column: str = "text", out: str = "token_ids") -> DataFrame:
    """The frame with the token ids of whole texts as ``array<int>``."""
    shared, at = _shared(df, rank_path), df.columns.index(column)
    field = T.StructField(out, T.ArrayType(T.IntegerType(), False), False)
    return add_columns(df, [field], lambda part: [_ids(codec(shared.value, pattern), part.column(at))], codec)


def decode(df: DataFrame, rank_path: str, pattern: str, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The frame with the bytes that the ids stand for."""
    shared, at = _shared(df, rank_path), df.columns.index(column)
    return add_columns(df, [T.StructField(out, T.BinaryType(), False)], lambda part: [_texts(token_bytes(shared.value), part.column(at))], token_bytes)


def both_ways(df: DataFrame, rank_path: str, pattern: str, column: str = "text", out: str = "token_ids", back: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass: one worker process a task, and the ids do not travel in between."""
    shared, at = _shared(df, rank_path), df.columns.index(column)

    def fill(part):
        own = codec(shared.value, pattern)
        ids = _ids(own, part.column(at))
        return [ids, _texts(own.bytes_of, ids)]

    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False), T.StructField(back, T.BinaryType(), False)]
    return add_columns(df, fields, fill, codec)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    coded = both_ways(docs.select("doc_id", "text"), rank_path, pattern)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
