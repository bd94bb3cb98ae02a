"""Problem 8: encoding of a corpus with a byte-level BPE vocabulary, and the encoder that problem 2 counts with.

Merging. A pre-token's bytes are the leaves of a segment tree over byte positions. A leaf holds the rank of the pair that
starts there, an inner node the lesser of its children, the left one on ties; the root is therefore the leftmost pair of
least rank. A merge changes the pairs of the merged piece and of its live neighbour to the left, and takes away the right
piece's own: three point updates of logarithmic cost, so a pre-token of n bytes takes O(n log n) whatever it holds.

Batches. Texts are cut at single spaces first. In the pre-token pattern a space can only begin a match, so a chunk between
two single spaces has the same ids wherever it stands; its ids are kept in a table of the worker. Where white space runs over
such a cut, the whole text takes the pattern as it is. Ids are gathered with NumPy and go to Arrow without Python lists.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabularies of public tokenizers lie, unless a call says otherwise.
TOKENIZER_DIR = os.environ.get("GLASRA_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks that a worker remembers before it starts anew; bounds its memory, never the result.
REMEMBERED = 400_000
#: Ids that a worker holds for chunks, and the longest chunk or pre-token that it remembers.
HELD_IDS, LONG = 4_000_000, 200
#: Characters of text taken into one NumPy batch.
BATCH_CHARS = 4_000_000

_NONE = 1 << 60


class MergeTree:
    """Segment tree over byte positions with the leftmost least pair rank at its root."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int]):
        self.piece, self.ranks, n = piece, ranks, len(piece)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.end = list(range(1, n + 1))  # of the piece that begins here
        self.left = list(range(-1, n - 1))  # where the piece before begins
        key = [_NONE] * (2 * self.size)
        for i in range(n - 1):
            key[self.size + i] = self._key(i)
        for k in range(self.size - 1, 0, -1):
            a, b = key[2 * k], key[2 * k + 1]
            key[k] = a if a <= b else b
        self.key = key

    def _key(self, i: int) -> int:
        """Rank of the pair that begins at i, above its position: the lesser key is the lesser rank, then the one further left."""
        j = self.end[i]
        if j >= len(self.piece):
            return _NONE
        rank = self.ranks.get(self.piece[i : self.end[j]])
        return _NONE if rank is None else (rank << 32) | i

    def _set(self, i: int, value: int) -> None:
        key, k = self.key, self.size + i
        key[k] = value
        while k > 1:
            k >>= 1
            a, b = key[2 * k], key[2 * k + 1]
            least = a if a <= b else b
            if key[k] == least:
                break
            key[k] = least

    def ids(self) -> list[int]:
        n, end, left = len(self.piece), self.end, self.left
        while self.key[1] < _NONE:
            i = self.key[1] & 0xFFFFFFFF
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                left[end[i]] = i
            self._set(j, _NONE)
            self._set(i, self._key(i))
            if left[i] >= 0:
                self._set(left[i], self._key(left[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[self.piece[i : end[i]]])
            i = end[i]
        return out


class _Chunks(dict):
    """Chunk -> row of its ids; a chunk that can't stand alone gets row 0."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> int:
        row = 0 if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.encoder.add(" " + chunk)
        if len(chunk) <= LONG:
            self[chunk] = row
        return row


class Encoder:
    """One vocabulary of a worker, with the ids of the chunks seen so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, tuple[int, ...]] = {}
        self.forget()

    def forget(self) -> None:
        self.words.clear()
        self.chunks = _Chunks(self)
        self.firsts: dict[str, int] = {}
        self.flat: list[int] = []
        self.starts: list[int] = [0, 0]
        self.arrays = None

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.words.get(w)
        if ids is None:
            ids = tuple(MergeTree(w.encode("utf-8", "surrogatepass"), self.ranks).ids())
            if len(w) <= LONG:
                self.words[w] = ids
        return ids

    def whole(self, text: str) -> list[int]:
        return [i for w in self.pattern.findall(text) for i in self.word(w)]

    def add(self, s: str) -> int:
        self.flat.extend(self.whole(s))
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.arrays is None or len(self.arrays[0]) != len(self.starts):
            self.arrays = np.array(self.starts, np.int64), np.array(self.flat, np.int32)
        return self.arrays

    def batch(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts of the texts, and all their ids in one array unless only counts are wanted; null and empty have none."""
        if len(self.starts) > REMEMBERED or len(self.words) > REMEMBERED or len(self.flat) > HELD_IDS:
            self.forget()
        rows: list[int] = []
        sizes: list[int] = []
        irregular: dict[int, int] = {}
        get = self.chunks.__getitem__
        for k, text in enumerate(texts):
            if not text:
                sizes.append(0)
                continue
            parts = text.split(" ")
            mine = list(map(get, parts[1:]))
            first = parts[0]
            if first and not first[-1].isspace() and 0 not in mine or len(parts) == 1:
                row = self.firsts.get(first)
                if row is None:
                    row = self.add(first)
                    if len(first) <= LONG:
                        self.firsts[first] = row
                rows.append(row)
                rows.extend(mine)
                sizes.append(1 + len(mine))
            else:
                rows.append(self.add(text))
                irregular[k] = rows[-1]
                sizes.append(1)
        starts, flat = self.tables()
        at = np.array(rows, np.int64)
        lengths = starts[at + 1] - starts[at]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        total = np.concatenate(([0], np.cumsum(lengths)))
        counts = total[bounds[1:]] - total[bounds[:-1]]
        if counts_only:
            return counts, None
        where = np.repeat(starts[at] - total[:-1], lengths) + np.arange(total[-1])
        return counts, flat[where]


_ENCODERS: dict[str, Encoder] = {}
_SHIPPED: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Give the executors a vocabulary of the driver's disk, once per application; where the driver has none they look at the path."""
    sc = spark.sparkContext
    if os.path.exists(path) and (sc.applicationId, path) not in _SHIPPED:
        sc.addFile(path)
        _SHIPPED.add((sc.applicationId, path))


def encoder(path: str) -> Encoder:
    """Loaded once per worker, from the file shipped to it."""
    if path not in _ENCODERS:
        shipped = SparkFiles.get(os.path.basename(path))
        _ENCODERS[path] = Encoder(shipped if os.path.exists(shipped) else path)
    return _ENCODERS[path]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about BATCH_CHARS characters; a longer text has its own."""
    start, chars = 0, 0
    for k, t in enumerate(texts):
        if chars > BATCH_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(t) if t else 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """`key` and `ids ARRAY<INT>` of each row of `df`, without special tokens.

    Null and empty texts give the empty list; special-token strings are ordinary text; a null key stays null; repeated rows
    give repeated rows; other columns aren't read. One narrow pass: no shuffle, no state beyond a worker's remembered chunks.
    """
    path = os.path.join(tokenizer_dir, vocabulary)
    ship_file(df.sparkSession, path)
    plain = df.select(df[key], df[text].alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for i, j in slices(texts):
                counts, ids = e.batch(texts[i:j])
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists], names=[key, "ids"])

    kind = plain.schema[0].dataType.simpleString()
    return plain.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR, carry: tuple[str, ...] = ()) -> DataFrame:
    """The `carry` columns of `df` and `n_tokens BIGINT`, the exact count of each row's text; null and empty texts have 0."""
    path = os.path.join(tokenizer_dir, vocabulary)
    ship_file(df.sparkSession, path)
    plain = df.select(*[df[c] for c in carry], df[text].alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for i, j in slices(texts):
                counts, _ = e.batch(texts[i:j], counts_only=True)
                kept = [b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*carry, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1])
    return plain.mapInArrow(count, f"{fields}{', ' if fields else ''}n_tokens bigint")
