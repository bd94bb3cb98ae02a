"""Edit distances and n-gram scores.

Counts of a row are additive, so a corpus score is a sum of counts (partial on the map side) and a final formula.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from glasra.functions.text import normalised, words


#: Characters that stand for the first items of a pair; further ones are made from their number.
ALPHABET = "".join(chr(0x100 + k) for k in range(4096))


def coded(items: Column, among: Column) -> Column:
    """A string with one character for each item: that of its place in the array `among`."""

    def char(w: Column) -> Column:
        at = F.array_position(among, w).cast("int")
        far = F.decode(F.unhex(F.lpad(F.hex(at + 0x10000), 8, "0")), "UTF-32")
        return F.when(at <= len(ALPHABET), F.substring(F.lit(ALPHABET), at, F.lit(1))).otherwise(far)

    return F.array_join(F.transform(items, char), "")


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edits between two arrays of words, by the built-in distance of strings that have a character for each word; an empty reference has none."""
    # a lambda's argument is worked out once, where an expression would be again for every word
    both = F.transform(F.array(F.array_distinct(F.concat(ref, hyp))), lambda m: F.levenshtein(coded(ref, m), coded(hyp, m)))
    return F.when(F.size(ref) == 0, 0).otherwise(F.get(both, F.lit(0))).cast("long")


def word_errors(df: DataFrame, ref: str = "ref", hyp: str = "hyp", bounded: bool = False) -> DataFrame:
    """`df` with `edits` and `n_ref`. Bounded: the hypothesis is cut to the reference's length. Null texts count as empty."""
    d = df.withColumns({"_r": words(normalised(F.col(ref))), "_h": words(normalised(F.col(hyp)))})
    h = F.slice("_h", F.lit(1), F.size("_r")) if bounded else F.col("_h")
    return d.withColumns({"n_ref": F.size("_r").cast("long"), "edits": word_edits(F.col("_r"), h)}).drop("_r", "_h")


def char_errors(df: DataFrame, ref: str = "ref", hyp: str = "hyp", bounded: bool = False) -> DataFrame:
    """`df` with `edits` and `n_ref` in characters of the normalised texts. Bounded: the hypothesis is cut to the reference's length."""
    d = df.withColumns({"_r": normalised(F.coalesce(F.col(ref), F.lit(""))), "_h": normalised(F.coalesce(F.col(hyp), F.lit("")))})
    h = F.substring("_h", F.lit(1), F.length("_r")) if bounded else F.col("_h")
    return d.withColumns({"n_ref": F.length("_r").cast("long"), "edits": F.when(F.length("_r") == 0, 0).otherwise(F.levenshtein(F.col("_r"), h)).cast("long")}).drop("_r", "_h")


def micro_rate(edits: Column, n: Column) -> Column:
    """All edits by all lengths, in percent."""
    return F.sum(edits) * 100.0 / F.greatest(F.lit(1), F.sum(n))


CHAR_ORDERS, WORD_ORDERS, BETA = 6, 2, 2.0


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _chrf_words(s: str) -> list[str]:
    """Words with a trailing, else a leading mark of ASCII punctuation taken off as one of its own (Popović 2017)."""
    out = []
    for w in s.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_counts(ref: str | None, hyp: str | None) -> list[int]:
    """Matches, n-grams of the hypothesis and of the reference, for six character and two word orders.

    Where the reference has no n-gram of an order, those of the hypothesis don't count either.
    """
    ref, hyp = ref or "", hyp or ""
    out: list[int] = []
    for r, h, orders in (("".join(ref.split()), "".join(hyp.split()), CHAR_ORDERS), (_chrf_words(ref), _chrf_words(hyp), WORD_ORDERS)):
        for n in range(1, orders + 1):
            a, b = _grams(r, n), _grams(h, n)
            out += [sum((a & b).values()), sum(b.values()) if a else 0, sum(a.values())]
    return out


def chrf_of(counts: str) -> Column:
    """chrF++ in percent of an array of counts: precisions and recalls are averaged over the orders that both sides have, then one F."""
    c = F.col(counts)
    both = [(c[k + 1] > 0) & (c[k + 2] > 0) for k in range(0, 3 * (CHAR_ORDERS + WORD_ORDERS), 3)]
    mean = lambda at: sum((F.when(ok, c[3 * k] / c[3 * k + at]).otherwise(0.0) for k, ok in enumerate(both)), F.lit(0.0))
    n = sum((ok.cast("int") for ok in both), F.lit(0))
    p, r = mean(1) / n, mean(2) / n
    return F.when((n > 0) & (p + r > 0), 100.0 * (1 + BETA**2) * p * r / (BETA**2 * p + r)).otherwise(0.0)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _keys(items: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the runs of n items that stay within their row, the row mixed in, and their rows."""
    if len(items) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(items) - n + 1
    h = rows[:last].astype(np.uint64) * _MIX[0]
    for k in range(n):
        h = (h ^ (items[k : last + k].astype(np.uint64) + np.uint64(1))) * _MIX[1]
        h ^= h >> np.uint64(29)
    ok = rows[:last] == rows[n - 1 :]
    return h[ok], rows[:last][ok]


def ngram_counts(refs: list[np.ndarray], hyps: list[np.ndarray], orders: int) -> np.ndarray:
    """[row, order, (matches, of hypothesis, of reference)] for whole batches of integer sequences, by sorting their runs."""
    out = np.zeros((len(refs), orders, 3), np.int64)
    flat = []
    for seqs in (refs, hyps):
        size = np.array([len(x) for x in seqs], np.int64)
        flat.append((np.concatenate([*seqs, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(seqs)), size)))
    for n in range(1, orders + 1):
        (rk, rr), (hk, hr) = (_keys(items, rows, n) for items, rows in flat)
        out[:, n - 1, 1] = np.bincount(hr, minlength=len(refs))
        out[:, n - 1, 2] = np.bincount(rr, minlength=len(refs))
        ru, ri, rc = np.unique(rk, return_index=True, return_counts=True)
        hu, hc = np.unique(hk, return_counts=True)
        _, i, j = np.intersect1d(ru, hu, assume_unique=True, return_indices=True)
        out[:, n - 1, 0] = np.bincount(rr[ri[i]], weights=np.minimum(rc[i], hc[j]), minlength=len(refs)).astype(np.int64)
    return out


def _chars(s: str | None) -> np.ndarray:
    return np.frombuffer("".join((s or "").split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def _numbered(texts: list[list[str]], ids: dict[str, int]) -> list[np.ndarray]:
    return [np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in texts]


@F.pandas_udf(ArrayType(LongType()))
def chrf_stats(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    ids: dict[str, int] = {}
    chars = ngram_counts([_chars(x) for x in ref], [_chars(x) for x in hyp], CHAR_ORDERS)
    ws = ngram_counts(_numbered([_chrf_words(x or "") for x in ref], ids), _numbered([_chrf_words(x or "") for x in hyp], ids), WORD_ORDERS)
    c = np.concatenate((chars, ws), axis=1)
    c[:, :, 1] *= c[:, :, 2] > 0
    return pd.Series(list(c.reshape(len(ref), -1)))


def bleu_counts(ref: str | None, hyp: str | None) -> list[int]:
    """Clipped matches and totals of one to four words, then both lengths; punctuation stands apart (13a)."""
    r, h = _bleu_words(ref or ""), _bleu_words(hyp or "")
    out = []
    for n in range(1, 5):
        a, b = _grams(r, n), _grams(h, n)
        out += [sum((a & b).values()), sum(b.values())]
    return [*out, len(h), len(r)]


# Entities that the 13a rules read.
ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}


def _bleu_words(s: str) -> list[str]:
    s = s.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, ch in ENTITIES.items():
        s = s.replace(name, ch)
    s = re.sub(r"([{-~\[-` -&(-+:-@/])", r" \1 ", f" {s} ")
    s = re.sub(r"([^0-9])([.,])", r"\1 \2 ", s)
    s = re.sub(r"([.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def bleu_of(counts: str) -> Column:
    """Corpus BLEU in percent with exponential smoothing: the k-th order without a match counts as 1 / 2^k of one."""
    c = F.col(counts)
    half, logs, some = F.lit(1.0), F.lit(0.0), F.lit(False)
    for k in range(4):
        match, total = c[2 * k], c[2 * k + 1]
        half = F.when(match == 0, half * 2).otherwise(half)
        logs = logs + F.log(F.when(match == 0, 1 / (half * F.greatest(total, F.lit(1)))).otherwise(match / F.greatest(total, F.lit(1))))
        some = some | (match > 0)
    short = F.when(c[8] < c[9], F.exp(1 - c[9] / c[8])).otherwise(1.0)
    return F.when(some & (c[7] > 0), 100.0 * short * F.exp(logs / 4)).otherwise(0.0)


@F.pandas_udf(ArrayType(LongType()))
def bleu_stats(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    ids: dict[str, int] = {}
    r, h = (_numbered([_bleu_words(x or "") for x in t], ids) for t in (ref, hyp))
    c = ngram_counts(r, h, 4)[:, :, :2].reshape(len(r), -1)
    sizes = np.array([[len(y), len(x)] for x, y in zip(r, h, strict=True)], np.int64).reshape(len(r), 2)
    return pd.Series(list(np.concatenate((c, sizes), axis=1)))


def summed(counts: str, n: int) -> Column:
    """Element-wise sum of an array column of n numbers, as an aggregate."""
    return F.array(*[F.sum(F.col(counts)[k]) for k in range(n)])
