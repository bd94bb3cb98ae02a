"""Column functions on text. All stay in the JVM but `nfc`, for which Spark has no built-in, and what takes an outside model."""

from __future__ import annotations

import os
import unicodedata

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it.
SPACES = r"(?U)\s+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition of every row; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x), na_action="ignore")


#: What composition may change: marks, and the few letters that are doubles of others. All else is composed already.
UNCOMPOSED = r"[\p{M}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A36}\x{A59}-\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{F69}\x{374}\x{37E}\x{387}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{1100}-\x{11FF}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"


def composed(c: Column) -> Column:
    """Canonical composition; only rows that may change leave the JVM."""
    return F.coalesce(nfc(F.when(c.rlike(UNCOMPOSED), c)), c)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """Lower case, composed, all but letters, numbers, underscore and blanks to a blank, blanks collapsed."""
    return trimmed(F.regexp_replace(F.regexp_replace(composed(F.lower(c)), r"[^\p{L}\p{N}_\s]", " "), SPACES, " "))


def words(c: Column) -> Column:
    """Words between white space; the empty array for null and blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


# Openings and closings of chat answers that wrap a transcription.
LEADS = (
    r"^the exact words spoken in the audio are\s*:?\s*",
    r"^the words spoken in the audio are\s*:?\s*",
    r"^the audio says\s*:?\s*",
    r"^sure[,!]?\s*(here.s the transcription\s*:?\s*)?",
)
TRAILERS = (
    r"\s*if you (have|want|need)\b.*$",
    r"\s*(feel free|let me know)\b.*$",
    r"\s*maybe you (could|meant)\b.*$",
    r"\s*(could|can) you please\b.*$",
)
# What stands between two double quotes, straight or curly, anywhere; apostrophes are letters of words such as I'm.
QUOTED = r'(?s)["“”](.+?)["“”]'


def unwrapped(c: Column) -> Column:
    """What a chat answer quotes first if it quotes a word, else the answer without its opening and closing phrases."""
    t = trimmed(c)
    quoted = trimmed(F.regexp_extract(t, QUOTED, 1))
    rest = t
    for p in (*LEADS, *TRAILERS):
        rest = F.regexp_replace(rest, "(?i)" + p, "")
    return F.when(quoted != "", quoted).otherwise(trimmed(rest))


def before_special(c: Column) -> Column:
    """The text before its first special token."""
    return F.regexp_replace(c, r"(?s)<\|[^|>]{1,40}\|>.*$", "")


def before_any(c: Column, stops: list[str]) -> Column:
    """The text before the earliest of several strings."""
    places = [F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1))


def occurrences(c: Column, mark: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("long")


def shingles(ws: Column, n: int) -> Column:
    """All runs of n words as strings; empty if there are fewer."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def most_repeated(items: Column) -> Column:
    """Occurrences of the most frequent item of an array, 0 if it is empty. Sorted runs, so it stays n log n."""
    a = F.array_sort(items)
    state = F.aggregate(
        a,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top")),
        lambda s, x: F.struct(
            x.alias("last"),
            F.when(s.last == x, s.run + 1).otherwise(1).alias("run"),
            F.greatest(s.top, F.when(s.last == x, s.run + 1).otherwise(1)).alias("top"),
        ),
    )
    return state["top"]


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def token_budget(n: Column, factor: float = 1.25, least: int = 8, most: int | None = None) -> Column:
    """Tokens that a generation may take: the reference's, times a factor, one more, within bounds."""
    b = F.greatest(F.lit(least), F.ceil(n * F.lit(factor)) + 1)
    return (F.least(F.lit(most), b) if most is not None else b).cast("long")


# How a marking scheme writes the marks of an answer, sums of marks, and bullets.
MARKS = r"(?i)=\s*\d+\s*mharc"
SUMS = r"(?i)^.*\b\d+\s*mharc(?:\s*\+\s*\d+\s*mharc)*\b"
BULLET = r"^(?:[-•]\s*|\d+[.)]\s*)"


def rubric_answers(rubric: Column, question: Column) -> Column:
    """Answers that a marking scheme accepts: what stands before each `= N mharc`, without the question, totals and bullets."""
    parts = F.split(F.coalesce(rubric, F.lit("")), MARKS)
    asked = trimmed(F.regexp_replace(F.coalesce(question, F.lit("")), SPACES, " "))

    def clean(p: Column) -> Column:
        p = trimmed(F.regexp_replace(F.regexp_replace(p, r"(?s)^.*\?", ""), SPACES, " "))
        p = F.when((asked != "") & F.startswith(p, asked), trimmed(F.substring(p, F.length(asked) + 1, F.length(p)))).otherwise(p)
        p = trimmed(F.regexp_replace(p, SUMS, ""))
        return trimmed(F.regexp_replace(p, BULLET, ""))

    return F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), clean), lambda x: x != "")


def budget_of_longest(answers: Column, factor: float = 1.25, least: int = 8, most: int | None = None) -> Column:
    """Budget for the answer of most words; that of none if there is no answer."""
    return token_budget(F.coalesce(F.array_max(F.transform(answers, n_words)), F.lit(0)), factor, least, most)


def dashed(c: Column, digits: int = 1) -> Column:
    """A number as text, a dash for null."""
    return F.when(c.isNull(), F.lit("–")).otherwise(F.format_string(f"%.{digits}f", c))


def classified(c: Column, model) -> Column:
    """Struct `label, confidence` by an outside classifier, `model(list of texts) -> list of (label, confidence)`, in batches.

    White space is flattened first, as classifiers take a line. Null and blank texts aren't asked about: they are `empty` with
    confidence 1.0.
    """

    @F.pandas_udf("label string, confidence double")
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": ["empty"] * len(s), "confidence": [1.0] * len(s)})
        asked = [i for i, t in enumerate(s) if t]
        if asked:
            got = list(model([s.iloc[i] for i in asked]))
            if len(got) != len(asked):
                raise ValueError(f"{len(got)} labels for {len(asked)} texts")
            out.loc[asked, "label"] = [str(label) for label, _ in got]
            out.loc[asked, "confidence"] = [float(p) for _, p in got]
        return out

    return run(F.coalesce(trimmed(F.regexp_replace(c, SPACES, " ")), F.lit("")))


def counted_tokens(c: Column, count) -> Column:
    """Tokens of each text by an outside tokenizer, `count(list of texts) -> list of numbers`, in batches; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([0] * len(s), dtype="int64")
        asked = [i for i, t in enumerate(s) if t]
        if asked:
            out.iloc[asked] = list(count([s.iloc[i] for i in asked]))
        return out

    return run(c)


_LOADED: dict = {}


def word_tokenizer(path: str):
    """Counts of tokens without special ones by a tokenizer file of the `tokenizers` library, loaded once a worker; from the file shipped to it, if there is one."""

    def count(texts: list[str]) -> list[int]:
        if path not in _LOADED:
            from tokenizers import Tokenizer

            shipped = SparkFiles.get(os.path.basename(path))
            _LOADED[path] = Tokenizer.from_file(shipped if os.path.exists(shipped) else path)
            _LOADED[path].encode_special_tokens = True  # their strings in a text are ordinary text
        return [len(e.ids) for e in _LOADED[path].encode_batch(texts, add_special_tokens=False)]

    return count
