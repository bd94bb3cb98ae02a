"""Problem 7: one form for texts that look alike but differ in their characters.

Skeleton: decompose, put the prototype of the look-alike table for every character, decompose again. The prototype of an invisible
character is nothing, of an odd space a blank, of a compatibility form its plain one, of a look-alike letter or symbol a Latin
letter. Texts with the same skeleton look the same; `skeleton_groups` groups originals by it, and a text whose skeleton isn't its
own decomposition, or that isn't composed, has an odd character. Words of another script keep their letters: a word takes Latin
prototypes only if it holds Latin letters besides, or if every letter of it is the very image of one. The readable form is the
skeleton's composed twin, with quotes and dashes as they were.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and their Latin prototypes, by script.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏүѵАВЕКМНОРСТУХІЈЅӀҮԌѴԚԜ", "aeopcyxijshdqwlyvABEKMHOPCTYXIJSIYGVQW", strict=True))
GREEK = dict(zip("αγικνορυχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ayikvopuxcjABEZHIKMNOPTYXCJ", strict=True))
ARMENIAN = dict(zip("օսհոցզԼՍՕՏ", "ouhngqLUOS", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᎢᏙᎳᏃ", "ABCDEGHJKLMPRTVWZ", strict=True))
OTHER_LATIN = dict(zip("ɑɡ", "ag", strict=True))
# Letters that pass for a Latin one only in its company, by script, and symbols that do in a word.
NEAR_CYRILLIC = dict(zip("ѡѠгкьЬпҽ", "wWrkbbne", strict=True))
NEAR_GREEK = dict(zip("σωητεςϱϝϜ", "owntecpfF", strict=True))
NEAR_ARMENIAN = dict(zip("առւ", "wni", strict=True))
NEAR_CHEROKEE = dict(zip("ᎥᏆᏚᏕᎩᎽᏤᏂᏏᏧᎡᏔᏳ", "iISSyYVhbdRWG", strict=True))
# Lisu letters are drawn as Latin capitals; most are named after the one that they are drawn as
LISU = {unicodedata.lookup(f"LISU LETTER {c}" if c in "AEIOU" else f"LISU LETTER {c}A"): c for c in "ABCDEGIJKLMNOPSTUWY"} | dict(zip("ꓜꓝꓣꓦꓧꓫ", "ZFRVHX", strict=True))
SYLLABICS = dict(zip("ᖇᗪᑭᗷᒪᒍᑌᐯᗅᕼᗰᖴ᙭ᑯᖯᑕᗴᘜ", "RDPBLJUVAHMFXdbCEG", strict=True))
COPTIC = dict(zip("ⲀⲂⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "ABZHIKMNOPCTYX", strict=True))
RUNIC = dict(zip("ᚷᛒᛕᛖᚱᛁ", "XBKMRI", strict=True))
SEMITIC = dict(zip("סוןه", "ollo", strict=True))
SYMBOLS = dict(zip("∨⋁∪⋃∣⍺⍳⍴⍵⊤⋿∘⤫⨯", "vvUUlaipwTEoxx", strict=True))
SURE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | OTHER_LATIN
NEAR = NEAR_CYRILLIC | NEAR_GREEK | NEAR_ARMENIAN | NEAR_CHEROKEE | LISU | SYLLABICS | COPTIC | RUNIC | SEMITIC | SYMBOLS
# small letters that are their capitals' images in small
NEAR |= {c.lower(): p.lower() for t in (CHEROKEE, NEAR_CHEROKEE, COPTIC) for c, p in t.items() if c.lower() != c}
PROTOTYPES = SURE | NEAR
#: Latin letters that a word has to have for a symbol in it to stand for one: `p∨q` is logic.
IN_WORD = 3

# Compatibility characters that are ordinary in text though they have a plain form.
ORDINARY = set("…‥№℃℉™℠ªº´¨¯¸µ″‴‵‶‼⁇⁈⁉")
ORDINARY_KINDS = ("<fraction>", "<super>", "<sub>", "<circle>", "<square>", "<noBreak>")
INVISIBLE = {chr(c) for c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x2800, 0x3164, 0xFFA0)}

#: Texts without any of these characters are in form already.
UNUSUAL = re.compile(r"[^ -~¡-§©«¬®°-³µ-·¹-ɏḀ-ỿ‐-―‘-‟…€№]|[ĲĳĿŀŉſǄ-ǌǱ-ǳẚ]")
_LETTER = f"(?:[^\\W\\d_]|[{''.join(SYMBOLS)}])"
WORD = re.compile(f"{_LETTER}+(?:[̀-ͯ]+{_LETTER}*)*")


@lru_cache(maxsize=65536)
def kind(ch: str) -> str:
    """invisible, space, compat, mark, foreign (a letter with a Latin prototype) or '' for an ordinary character."""
    cat = unicodedata.category(ch)
    if ch in INVISIBLE or cat == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or cat == "Cc" and not ch.isspace():
        return "invisible"
    if cat in ("Zs", "Zl", "Zp"):
        return "" if ch == " " else "space"
    if cat == "Cc":  # tabs and line ends lay text out
        return ""
    if cat == "Mn":
        return "mark"
    if ch in PROTOTYPES:
        return "foreign"
    if ch in ORDINARY:
        return ""
    d = unicodedata.decomposition(ch)
    if d.startswith("<") and not d.startswith(ORDINARY_KINDS):
        return "compat"
    if not d.startswith("<") and d and " " not in d and cat[0] in "LNP":  # one character for another, as the Kelvin sign
        return "compat"
    return ""


def _put(text: str) -> str:
    """The text with the prototype of every character put for it; accents stay as they are, composed or loose."""
    out = []
    for ch in text:
        k = kind(ch)
        if k == "space":
            out.append(" ")
        elif k == "compat":
            out.append(unicodedata.normalize("NFKC", ch))
        elif k != "invisible":
            out.append(ch)
    return WORD.sub(lambda m: _latin(m.group()), "".join(out))


def _latin(word: str) -> str:
    """The word with its look-alike letters made Latin, or as it is where it is truly of another script."""
    if word.isascii() or not any(c in PROTOTYPES for c in unicodedata.normalize("NFD", word)):
        return word
    base = unicodedata.normalize("NFD", word)
    letters = [c for c in base if unicodedata.category(c) != "Mn"]
    latin = sum(c.isascii() or c not in PROTOTYPES and "LATIN" in unicodedata.name(c, "") for c in letters)
    table = SURE if not latin else PROTOTYPES if latin >= IN_WORD else {c: p for c, p in PROTOTYPES.items() if c not in SYMBOLS}
    if not latin and not all(c in SURE for c in letters):
        return word
    return "".join(table.get(c, c) for c in base)


def one_form(text: str | None) -> str | None:
    """Readable form; null stays null and the empty text empty. Idempotent."""
    if text is None or not UNUSUAL.search(text):
        return text
    return unicodedata.normalize("NFC", _put(text))


def _loose(text: str) -> bool:
    """Whether an accent isn't composed with its letter though it can be, or a letter stands as its canonical double."""
    if unicodedata.is_normalized("NFC", text):
        return False
    return any(unicodedata.category(c) == "Mn" or len(n := unicodedata.normalize("NFC", c)) == 1 and n != c for c in text)


def is_odd(text: str | None) -> bool:
    """Whether the text's skeleton isn't its own decomposition, or it isn't composed: some character of it isn't in form."""
    if text is None or not UNUSUAL.search(text):
        return False
    return unicodedata.normalize("NFD", _put(text)) != unicodedata.normalize("NFD", text) or _loose(text)


def skeleton(text: str | None) -> str | None:
    """Decompose, put prototypes, decompose again; quotes, dashes and runs of spaces count as looking alike."""
    return form_and_skeleton(text)[1]


def form_and_skeleton(text: str | None) -> tuple[str | None, str | None]:
    """`one_form` and `skeleton`, with the prototypes put once."""
    if text is None:
        return None, None
    put = _put(text) if UNUSUAL.search(text) else text
    s = unicodedata.normalize("NFD", put)
    if _SHAPED.search(s):
        s = unicodedata.normalize("NFD", s.translate(_SHAPES))
    return (text if put is text else unicodedata.normalize("NFC", put)), " ".join(s.split())


# Marks that look alike in one line of text.
_SHAPES = str.maketrans({"‘": "'", "’": "'", "‛": "'", "ʼ": "'", "“": '"', "”": '"', "‟": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-"} | SURE)

_SHAPED = re.compile(f"[{''.join(map(chr, _SHAPES))}]")


def _sides(df: DataFrame, key: str, sides: tuple[str, ...], want: str, schema: str) -> DataFrame:
    plain = df.select(df[key], *[df[s] for s in sides])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            texts = [b.column(1 + i).to_pylist() for i in range(len(sides))]
            if want == "odd":
                for i, s in enumerate(sides):
                    at = [k for k, t in enumerate(texts[i]) if is_odd(t)]
                    if at:
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array([s] * len(at), pa.string())], names=[key, "side"])
            else:
                both = [list(map(form_and_skeleton, ts)) for ts in texts]
                f, g = ([[x[i] for x in xs] for xs in both] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.string()) for x in f], *[pa.array(x, pa.string()) for x in g]], names=[key, *[f"{s}_form" for s in sides], *[f"{s}_skeleton" for s in sides]])

    return plain.mapInArrow(run, schema)


def odd_texts(df: DataFrame, key: str = "row_id", sides: tuple[str, ...] = ("ref", "hyp")) -> DataFrame:
    """`key, side` of texts with an odd character by their skeleton; distinct rows, so repeated deliveries count once.

    Null texts are no cases, nor are accents that no letter is composed with.
    """
    return _sides(df, key, sides, "odd", f"`{key}` {df.schema[key].dataType.simpleString()}, side string").distinct()


def forms(df: DataFrame, key: str = "row_id", sides: tuple[str, ...] = ("ref", "hyp")) -> DataFrame:
    """`key`, then each side's readable form and skeleton; a row for each row of `df`."""
    cols = ", ".join([f"`{s}_form` string" for s in sides] + [f"`{s}_skeleton` string" for s in sides])
    return _sides(df, key, sides, "forms", f"`{key}` {df.schema[key].dataType.simpleString()}, {cols}")


def skeleton_groups(df: DataFrame, key: str = "row_id", sides: tuple[str, ...] = ("ref", "hyp")) -> DataFrame:
    """`skeleton, n_texts, n_forms`: texts that look the same, how many there are and in how many spellings.

    Distinct originals are counted first (partial on the map side), so a text that holds a third of all rows is one row
    before skeletons meet.
    """
    f = df.select(F.explode(F.array(*[df[s] for s in sides])).alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([skeleton(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["skeleton", "n"])

    return f.mapInArrow(run, "skeleton string, n bigint").groupBy("skeleton").agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_forms"))
