"""Problem 9: passages of evaluation items inside training documents.

Each shard of the corpus gets an FM-index over words: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet
matrix for ranks, and every eighth suffix position sampled. The phrases are all runs of four words of the items: a passage of
twelve words with two of them changed, dropped or added still holds one of these unbroken (ten words left in three parts).
Backward search runs for all phrases at once; occurrences are located by walking to sampled positions, and an exact alignment
around them decides. Words that no item has can't be part of a phrase, so they end a run of the indexed text; it is small and
nothing is lost. The items are a fixed set of checked size and go to every worker; the corpus is read once and not shuffled. More
items than that go in parts, a search each, and the spans of all parts meet by document before the closest are told.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a searched phrase, of the least passage, and words to each allowed edit.
PHRASE, LEAST, PER_EDIT = 4, 12, 6
#: Words of a shard; bounds a task's memory (about 100 bytes each), never the result.
SHARD_WORDS = 1_500_000
SAMPLE = 8
#: Characters of evaluation items that may go to every worker at a time. More are searched in parts, with the same result.
ITEM_CHARS = 20_000_000
#: Places of phrases in documents and items that are held at a time; bounds a task's memory, never the result.
HELD_PLACES = 2_000_000
#: Chunks that a worker remembers before it starts anew.
REMEMBERED = 400_000

_JOINED = re.compile("(?<=\\w)(?:-[ \\t]*\\r?\\n\\s*|['’‘ʼ`´­​‌‍⁠﻿‐‑-])(?=\\w)")
_BROKEN = re.compile(r"[-‐]\s*\n")
_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, accents and punctuation; apostrophes and hyphens inside a word join its parts."""
    if not text:
        return []
    s = text.lower()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
    return _WORD.findall(_JOINED.sub("", s))


class WaveletMatrix:
    """Ranks of symbols in prefixes of an integer sequence, for many (symbol, position) pairs at a time."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i."""
        start = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[start], ones[i]
            start = np.where(up, zeros + a, start - a)
            i = np.where(up, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at i, and how often it occurs before i."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            up = ones[at + 1] > ones[at]
            symbol = symbol * 2 + up
            a, b = ones[start], ones[at]
            start = np.where(up, zeros + a, start - a)
            at = np.where(up, zeros + b, at - b)
        return symbol, at - start


class FMIndex:
    """FM-index over symbols 1..V; 0 parts runs. Suffixes are compared as far as the 0 that ends their run."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = self.n = len(text)
        sep = text == 0
        rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
        k = 1
        while True:
            nxt = np.full(n, -1, np.int64)
            nxt[:-k] = rank[k:]
            nxt[sep] = -1
            keyed = rank * (max(n, int(rank.max())) + 2) + nxt + 1
            order = np.argsort(keyed, kind="stable")
            s = keyed[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
            rank = new
            if int(rank.max()) == n - 1 or k >= n:
                break
            k *= 2
        bwt = text[order - 1]  # the last symbol is a 0, so it stands before the first
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1)))).astype(np.int64)
        self.tree = WaveletMatrix(bwt.astype(np.int64), max(1, int(n_symbols).bit_length()))
        # every eighth position, and the starts of runs, beyond which no walk goes
        keep = (order % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate(([0], np.cumsum(keep))).astype(np.int64)
        self.sampled = order[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase (one a row)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.counts[c] + self.tree.rank(c, lo), self.counts[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full_like(rows, -1)
        todo = np.arange(len(rows))
        while len(todo):
            r = at[todo]
            done = self.kept[r + 1] > self.kept[r]
            out[todo[done]] = self.sampled[self.kept[r[done]]] + steps[todo[done]]
            todo = todo[~done]
            c, before = self.tree.access(at[todo])
            at[todo] = self.counts[c] + before
            steps[todo] += 1
        return out


def _reach(item: list[int], doc: list[int], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Furthest (item, document) positions that end with an equal word, for 0, 1, 2 ... edits, from a match that ends at (i, j).

    Only the furthest position on each diagonal is kept for each number of edits. It stops where more edits gain too little.
    """
    n, m = (len(item), len(doc)) if step > 0 else (-1, -1)
    front, best, out = {j - i: i}, (i, j), []
    while True:
        for d, x in front.items():
            y = x + d
            x0 = x
            while x != n and y != m and item[x] == doc[y]:
                x += step
                y += step
            front[d] = x
            if x != x0 and (x - best[0]) * step > 0:
                best = x, y
        out.append(best)
        if len(out) > 2 and abs(best[0] - i) + 2 * LEAST < PER_EDIT * (len(out) - 1):
            return out
        new: dict[int, int] = {}
        for d, x in front.items():
            if x != n:
                for e, z in ((d, x + step), (d - step, x + step)):  # changed; dropped
                    if e not in new or (z - new[e]) * step > 0:
                        new[e] = z
            if x + d != m:  # added
                e = d + step
                if e not in new or (x - new[e]) * step > 0:
                    new[e] = x
        front = {d: x for d, x in new.items() if (x + d - m) * step <= 0}
        if not front:
            return out


def spans(item: list[int], doc: list[int], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first, end, words of the item, edits) of spans that hold LEAST consecutive words of the item with one edit in PER_EDIT at most.

    `runs` are (diagonal, first, end in the item) of unbroken phrases, in order. A span begins and ends with a word of the item
    that is there unchanged. Each run is extended both ways by as many edits as its length allows; the longest span counts.
    """
    found: list[tuple[int, int, int, int]] = []
    for d, q0, q1 in runs:
        if any(a <= q0 + d and q1 + d <= b for a, b, *_ in found):
            continue
        ahead = _reach(item, doc, q1, q1 + d, 1)
        back = _reach(item, doc, q0 - 1, q0 - 1 + d, -1)
        best = None
        for x, (i1, j1) in enumerate(ahead):
            for y, (i0, j0) in enumerate(back):
                n = i1 - i0 - 1
                if n >= LEAST and n >= PER_EDIT * (x + y) and (best is None or n > best[2]):
                    best = j0 + 1, j1, n, x + y
        if best:
            found.append(best)
    return found


def closest(item: np.ndarray, first: np.ndarray, end: np.ndarray, n: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """For the spans of one document: whether no other item's span lies over most of it and is the better likeness of the same words."""
    likeness = n - PER_EDIT * edits
    out = np.ones(len(item), bool)
    for k in range(len(item)):
        over = np.minimum(end, end[k]) - np.maximum(first, first[k])
        out[k] = not ((2 * over > end[k] - first[k]) & (likeness > likeness[k]) & (item != item[k])).any()
    return out


class _Chunks(dict):
    """Numbers of the words of what stands between white space; a worker works each out once."""

    def __init__(self, items: Items):
        super().__init__()
        self.items = items

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        ids = tuple(self.items.numbers(chunk))
        if len(chunk) <= 200:
            self[chunk] = ids
        return ids


class Items:
    """Words and phrases of the evaluation items, numbered from 1."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.chunks = _Chunks(self)
        self.ids: list[int] = []
        self.texts: list[list[int]] = []
        self.vocabulary: dict[str, int] = {}
        for i, text in rows:
            ws = words(text)
            if len(ws) >= LEAST:
                self.ids.append(i)
                self.texts.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws])
        where: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(self.texts):
            for q in range(len(ws) - PHRASE + 1):
                where[tuple(ws[q : q + PHRASE])].append((k, q))
        self.phrases = np.array(list(where), np.int64).reshape(-1, PHRASE)
        # places (item, first word) of phrase i are those from begin[i] to begin[i + 1]
        self.begin = np.concatenate(([0], np.cumsum([len(x) for x in where.values()]))).astype(np.int64)
        self.places = np.array(list(chain.from_iterable(where.values())), np.int64).reshape(-1, 2)

    def numbers(self, text: str) -> list[int]:
        """0 for a word that no item has."""
        return [self.vocabulary.get(w, 0) for w in words(text)]


class Shard:
    """Documents of a task, as far as they can hold phrases."""

    def __init__(self, items: Items):
        self.items = items
        self.keys: list = []
        self.docs: list[list[int]] = []
        self.size = 0

    def add(self, key, text: str | None) -> None:
        if not text:
            return
        if _BROKEN.search(text):  # a word that goes on after the line's end
            ids = self.items.numbers(text)
        else:
            ids = list(chain.from_iterable(map(self.items.chunks.__getitem__, text.split())))
        if len(ids) - ids.count(0) >= LEAST - LEAST // PER_EDIT:
            self.keys.append(key)
            self.docs.append(ids)
            self.size += len(ids)

    def leaks(self) -> Iterator[tuple]:
        """(key, item id, first word, end, words of the item, edits, closest) of each span."""
        if not self.docs or not len(self.items.phrases):
            return
        flat = np.concatenate([np.array([*d, 0], np.int64) for d in self.docs])
        ends = np.cumsum([len(d) + 1 for d in self.docs])
        # runs of at least PHRASE known words, each with one 0 after it
        known = np.concatenate(([False], flat > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= PHRASE
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return
        lengths = stops - starts + 1
        offset = np.concatenate(([0], np.cumsum(lengths)))
        source = np.repeat(starts - offset[:-1], lengths) + np.arange(offset[-1])
        text = flat[source]
        text[offset[1:] - 1] = 0
        index = FMIndex(text, len(self.items.vocabulary))
        lo, hi = index.search(self.items.phrases)
        some = np.flatnonzero(hi > lo)
        n = hi[some] - lo[some]
        begin = np.concatenate(([0], np.cumsum(n)))
        rows = np.repeat(lo[some] - begin[:-1], n) + np.arange(begin[-1])
        at = source[index.locate(rows)]
        doc = np.searchsorted(ends, at, side="right")
        first = np.concatenate(([0], ends[:-1]))
        order = np.argsort(doc, kind="stable")
        phrase, doc, place = np.repeat(some, n)[order], doc[order], (at - first[doc])[order]
        # whole documents at a time, as many as the places allow
        size = np.cumsum(self.items.begin[phrase + 1] - self.items.begin[phrase])
        lo = 0
        while lo < len(doc):
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + HELD_PLACES, side="right"))
            hi = max(int(np.searchsorted(doc, doc[min(hi, len(doc) - 1)], side="left")) if hi < len(doc) else hi, int(np.searchsorted(doc, doc[lo], side="right")))
            yield from self._spans(phrase[lo:hi], doc[lo:hi], place[lo:hi])
            lo = hi

    def _spans(self, phrase: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """Spans of some documents from the places of phrases in them; each phrase stands for all its places in the items."""
        it = self.items
        n = it.begin[phrase + 1] - it.begin[phrase]
        begin = np.concatenate(([0], np.cumsum(n)))
        at = it.places[np.repeat(it.begin[phrase] - begin[:-1], n) + np.arange(begin[-1])]
        doc, place, item, q = np.repeat(doc, n), np.repeat(place, n), at[:, 0], at[:, 1]
        order = np.lexsort((q, place - q, item, doc))
        doc, diagonal, item, q = doc[order], (place - q)[order], item[order], q[order]
        pair = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        new = pair | np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (q[1:] != q[:-1] + 1)))
        starts = np.flatnonzero(new)
        stops = np.concatenate((starts[1:], [len(q)]))
        runs = list(zip(diagonal[starts].tolist(), q[starts].tolist(), (q[stops - 1] + PHRASE).tolist(), strict=True))
        edge = [*np.flatnonzero(pair[starts]).tolist(), len(starts)]
        found: list[tuple[int, int, int, int, int]] = []
        last = -1
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            d, k = int(doc[starts[i]]), int(item[starts[i]])
            if d != last:
                yield from self._told(last, found)
                found, last = [], d
            found += [(k, *span) for span in spans(it.texts[k], self.docs[d], runs[i:j])]
        yield from self._told(last, found)

    def _told(self, d: int, found: list[tuple[int, int, int, int, int]]) -> Iterator[tuple]:
        if found:
            for (k, *span), c in zip(found, closest(*np.array(found, np.int64).T).tolist(), strict=True):
                yield self.keys[d], self.items.ids[k], *span, c


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct `key, item_key, first_word, end_word, item_words, edits, closest`: spans of words of each document that hold a passage of an item.

    `closest` is false where another item is a better likeness of the same words: sentences of one build are within the
    allowed edits of each other, and only the item that the passage was taken from has leaked. Items that are equally
    like it all count. Null, empty and short texts hold none; repeated documents count once. Items of fewer than
    twelve words can't leak.
    """
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    if size <= ITEM_CHARS:
        return _search(docs.select(docs[key].alias("_key"), docs[text].alias("text")), items.select(item_key, item_text), item_key).withColumnRenamed("_key", key).distinct()
    parts = -(-size // ITEM_CHARS)
    numbered = items.select(item_key, item_text, F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)).alias("_part"))
    # a document is its key and text: spans of all parts meet by a hash of both
    plain = docs.select(F.struct(docs[key].alias("_key"), F.xxhash64(docs[key], docs[text]).alias("_hash")).alias("_key"), docs[text].alias("text"))
    found = None
    for p in range(parts):
        one = _search(plain, numbered.where(F.col("_part") == p).select(item_key, item_text), item_key)
        found = one if found is None else found.unionByName(one)
    found = found.select("_key._key", "_key._hash", *found.columns[1:-1]).distinct()

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        which = pd.factorize(pdf[item_key], use_na_sentinel=False)[0]
        return pdf.drop(columns="_hash").assign(closest=closest(which, *[pdf[c].to_numpy() for c in ("first_word", "end_word", "item_words", "edits")]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "_hash")
    return found.groupBy("_hash").applyInPandas(tell, f"{kinds}, closest boolean").withColumnRenamed("_key", key).distinct()


def _search(docs: DataFrame, items: DataFrame, item_key: str) -> DataFrame:
    """Spans of `docs` (`_key`, text) for items that a worker can hold; `closest` is among these items."""
    rows = [(r[0], r[1]) for r in items.distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kinds = [docs.schema["_key"].dataType, items.schema[item_key].dataType]
    item_type = to_arrow_type(kinds[1])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(shared.value)
        shard = Shard(known)
        types: list = []

        def out(s: Shard) -> Iterator[pa.RecordBatch]:
            found = list(s.leaks())
            if found:
                ks, js, *ints, best = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ks, types[0]), pa.array(js, item_type), *[pa.array(x, pa.int32()) for x in ints], pa.array(best, pa.bool_())], names=["_key", item_key, "first_word", "end_word", "item_words", "edits", "closest"])

        for b in batches:
            types = [b.column(0).type]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard.add(k, t)
                if shard.size > SHARD_WORDS:
                    yield from out(shard)
                    shard = Shard(known)
        yield from out(shard)

    return docs.mapInArrow(search, f"_key {kinds[0].simpleString()}, `{item_key}` {kinds[1].simpleString()}, first_word int, end_word int, item_words int, edits int, closest boolean")


def leaked(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """Distinct `doc_id, item_id` of the documents that hold a passage of an item (its closest item, see `leaks`)."""
    return leaks(docs, items, **names).where("closest").select(names.get("key", "doc_id"), names.get("item_key", "item_id")).distinct()


def removal_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """`key, first_word, end_word, n_items`: overlapping spans of a document merged, as they would be cut out."""
    from pyspark.sql import Window as W

    s = leaks(docs, items, key=key, **names)
    w = W.partitionBy(key).orderBy("first_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(reach.isNull() | (F.col("first_word") > reach), 1).otherwise(0))
    s = s.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    item = names.get("item_key", "item_id")
    return s.groupBy(key, "part").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.countDistinct(item).alias("n_items")).drop("part")


def p9_found(spark, sf_dir: str) -> DataFrame:
    from glasra.tables import read, spread

    return leaked(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items"))


def p9_alike(spark, sf_dir: str) -> DataFrame:
    """Also the items that are no more than within the allowed edits of a passage of another one."""
    from glasra.tables import read, spread

    return leaks(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items")).groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("closest").alias("closest"))


def p9_spans(spark, sf_dir: str) -> DataFrame:
    from glasra.tables import read, spread

    return removal_spans(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items"))
