"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is one last token of its encoding. An automaton yields all tokens that end at a
position, longest first; the one that is the last is the first whose neighbour, the last token of the prefix
before it, is compatible with it: two tokens are compatible if no merge would ever join bytes across
their border before both are complete. Back-pointers from the end give the ids, in time linear in the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Path of the rank file; a parameter, for the vocabulary is no part of this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs that a worker remembers.
CACHE = 400_000


class PrefixEncoder:
    """Encodes text with the ranks of one vocabulary; ids are ranks."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            # The automaton works on texts; Latin-1 makes each byte one character.
            self.automaton.add_word(token.decode("latin-1"), (r, len(token)))
        self.automaton.make_automaton()
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._piece: dict[str, list[int]] = {}

    def _merged(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: its bytes merged by lower ranks only."""
        text = self.bytes[token]
        if len(text) == 1:
            return None
        parts = [bytes([b]) for b in text]
        while len(parts) > 2:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= token:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            return None
        return self.rank[parts[0]], self.rank[parts[1]]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one border of ``token`` in the order they come to be, each with the rank that absorbs it."""
        memo = self._right if side else self._left
        if token not in memo:
            halves = self._merged(token)
            if halves is None:
                memo[token] = [(token, float("inf"))]
            else:
                below = self._spine(halves[side], side)
                memo[token] = [*below[:-1], (below[-1][0], float(token)), (token, float("inf"))]
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of both, merged together, stay ``a`` then ``b``."""
        known = self._pair.get((a, b))
        if known is None:
            known = self._check(a, b)
            if len(self._pair) > CACHE:
                self._pair.clear()
            self._pair[a, b] = known
        return known

    def _check(self, a: int, b: int) -> bool:
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            joined = self.rank.get(self.bytes[x] + self.bytes[y])
            # Of equal ranks the leftmost merges first: before this border on the left, after it on the right.
            if joined is not None and joined < x_ends and joined <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        last = [-1] * (n + 1)
        length = [0] * (n + 1)
        compatible, done = self.compatible, 0
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            stop = end + 1
            if done == stop:  # this prefix has its token
                continue
            start = stop - size
            if start == 0 or compatible(last[start], token):
                last[stop], length[stop], done = token, size, stop
        ids = []
        while n:
            ids.append(last[n])
            n -= length[n]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        memo, out = self._piece, []
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(memo) > CACHE:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_encoders: dict[tuple[int, str], PrefixEncoder] = {}


def encode_texts(rows: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(row_id, ids)`` of every row; null and empty texts have an empty list, special tokens are ordinary text.

    The rank file is read on the driver and sent to the executors as a broadcast; its size is
    that of the vocabulary, whatever the data. Rows with a null id are dropped; repeated rows repeat.
    """
    spark = rows.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    sent = spark.sparkContext.broadcast(ranks)
    key = (hash(ranks), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders[key] = PrefixEncoder(sent.value, pattern)
        encode = _encoders[key].encode
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["row_id", "ids"])

    source = spread(rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")))
    return source.mapInArrow(run, "row_id long, ids array<int>").withColumnRenamed("row_id", row_id)
