"""Problem 10: text decoded with a wrong encoding, found and put right word by word.

Every distinct clean word of the corpus is garbled under all encoding chains; the distinct tokens of the corpus are
hash-joined with these forms; a token that equals a form of another word is garbled, and that word is its original. Where the
form could be an ordinary token too, the word has to be far more frequent. Equal texts count once. A document with such a token is a case. To restore it, its garbled tokens are replaced by their originals, and
what is left of it takes the inverse of the chain that most of its tokens went through.

Only words with a character beyond ASCII change under these chains, and all chains keep ASCII, so a word is garbled only if
some other token has the same ASCII letters around whatever is not ASCII: the same result with fewer forms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasra.operators.sequences import REPEATED_KEYS
from glasra.session import checkpointed

# The encodings of one byte a character that texts are commonly misread as or from.
BYTE_ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-15")
#: A token that may be a word of its own has at most this share of its original's occurrences; else a rare word might pass for
#: an original. Forms of several characters for one, replacement marks and `?` between letters are garbled at any share.
RARER = 0.25
#: Rows of the verified table that may be broadcast (about 100 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Longer tokens meet by a hash of them, so that their forms aren't written out.
SPELT = 100
#: Tokens whose hashes go to every worker (8 bytes each), to leave out forms that are none of them; beyond, all forms are joined.
KNOWN_TOKENS = 4_000_000
#: Fixed value: the seed of Spark's xxhash64.
HASH_SEED = 42
#: Words that a task garbles: much work for few bytes, so their number tells the tasks.
WORDS_A_TASK = 2_000
#: Parts that the tokens of documents are dealt into where the table is joined by shuffle, as some token may be in most documents.
SALT = 16
#: Distinct tokens that a task counts before it hands them on; bounds its memory, never the result.
HELD_TOKENS = 500_000


def _table(name: str) -> list[str]:
    """Character of each byte; a byte that the encoding leaves open keeps its code, as lenient decoders have it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


DECODE = {e: _table(e) for e in BYTE_ENCODINGS}
ENCODE = {e: {c: b for b, c in reversed(list(enumerate(t)))} for e, t in DECODE.items()}


def to_bytes(s: str, enc: str) -> bytes | None:
    if enc == "utf-8":
        return s.encode("utf-8", "surrogatepass")
    table = ENCODE[enc]
    try:
        return bytes([table[c] for c in s])
    except KeyError:
        return None


def from_bytes(b: bytes, enc: str) -> str | None:
    if enc == "utf-8":
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return None
    table = DECODE[enc]
    return "".join([table[x] for x in b])


def _chains() -> list[tuple[tuple[str, str], ...]]:
    once = [(("utf-8", e),) for e in BYTE_ENCODINGS]
    once += [((a, b),) for a in BYTE_ENCODINGS for b in BYTE_ENCODINGS if a != b]
    wide = ("cp1252", "latin-1")
    twice = [(("utf-8", a), ("utf-8", b)) for a in (*wide, "mac_roman", "cp437", "cp850") for b in wide]
    thrice = [(("utf-8", a),) * 3 for a in wide]
    return once + twice + thrice


#: Steps (encoded as, decoded as) of each chain, likelier ones first: of equal forms the first names the chain.
CHAINS = _chains()


class _Change(dict):
    """What a chain makes of a character; every chain works character by character, so each is worked out once a worker."""

    def __init__(self, chain: tuple[tuple[str, str], ...]):
        super().__init__((chr(c), chr(c)) for c in range(128))
        self.chain = chain

    def __missing__(self, c: str) -> str:
        s = c
        for a, b in self.chain:
            raw = to_bytes(s, a)
            if raw is None:
                raise KeyError(c)
            s = from_bytes(raw, b)
        self[c] = s
        return s


_CHANGES = [(" > ".join(f"{a} as {b}" for a, b in chain), _Change(chain)) for chain in CHAINS]
LOSSY = ("ascii ?", "utf-8 ??", "byte �", "utf-8 ��")


def forms(word: str) -> dict[str, str]:
    """Garbled form -> chain, for every chain that changes the word; lower case too, as texts are folded after they break."""
    out: dict[str, str] = {}
    for name, change in _CHANGES:
        try:
            s = "".join([change[c] for c in word])
        except KeyError:
            continue
        if s != word:
            out.setdefault(s, name)
            out.setdefault(s.lower(), name)
    lossy = (
        re.sub(r"[^\x00-\x7f]", "?", word),
        re.sub(r"[^\x00-\x7f]", lambda m: "?" * len(m.group().encode()), word),
        re.sub(r"[^\x00-\x7f]", "�", word),
        re.sub(r"[^\x00-\x7f]", lambda m: "�" * len(m.group().encode()), word),
    )
    for s, name in zip(lossy, LOSSY, strict=True):
        if s != word:
            out.setdefault(s, name)
    return out


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where some character can't have come through it."""
    if chain in LOSSY:
        return None
    s: str | None = text
    for step in reversed(chain.split(" > ")):
        a, b = step.split(" as ")
        raw = to_bytes(s, b)
        s = from_bytes(raw, a) if raw is not None else None
        if s is None:
            return None
    return s


_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_OPEN = re.compile(r"\?[A-Za-z?]|^\?$")


def odd_tokens(text: str | None) -> list[str]:
    """Tokens that may be garbled, or change when garbled, and the runs of characters beyond ASCII inside them.

    Only ASCII white space parts tokens: the no-break space and U+0085 are halves of garbled letters.
    """
    if not text:
        return []
    wide, asks = not text.isascii(), "?" in text
    if not wide and not asks:
        return []
    parts = text.replace("\n", " ").replace("\r", " ").replace("\t", " ").replace("\f", " ").split(" ") if wide else text.split()
    odd = [t for t in parts if not t.isascii()] if wide else []
    runs = [r for t in set(odd) for r in _RUNS.findall(t) if r != t]
    if asks:
        odd += [t for t in parts if "?" in t and t.isascii() and _OPEN.search(t)]
    return odd + runs


def _token_counts(df: DataFrame, text: str) -> DataFrame:
    """`token, n`: occurrences in distinct texts, counted within each task first, so that what is shuffled then is vocabulary.

    A text that stands in m rows counts 1/m in each of them: repeated texts are known by a hash, and no text is moved to meet its
    copies. A table of checked size says which they are; a larger one is joined by shuffle.
    """
    plain = df.select(df[text].alias("text")).where("text is not null")
    h = F.xxhash64("text").alias("_hash")
    again = checkpointed(plain.select(h).groupBy("_hash").agg(F.count("*").alias("_m")).where("_m > 1"))
    weighed = plain.withColumn("_hash", h).join(F.broadcast(again) if again.count() <= REPEATED_KEYS else again, "_hash", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if m is None:
                    seen.update(odd_tokens(t))
                else:
                    for w in odd_tokens(t):
                        seen[w] += 1 / m
            if len(seen) > HELD_TOKENS:
                yield counted(seen)
                seen.clear()
        if seen:
            yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.float64())], names=["token", "n"])

    return weighed.select("text", "_m").mapInArrow(count, "token string, n double").groupBy("token").agg(F.greatest(F.lit(1), F.round(F.sum("n"))).cast("long").alias("n"))


def garbled_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """`token, original, chain`: distinct tokens that equal a garbled form of a word, of one far more frequent than they are if they may be words."""
    tokens = checkpointed(_token_counts(df, text)).withColumn("met", F.when(F.length("token") <= SPELT, F.col("token")).otherwise(F.concat(F.lit("\0"), F.sha2("token", 256))))
    shape = F.regexp_replace(F.lower("token"), r"[\x{80}-\x{10FFFF}?]+", "\x01")
    shaped = tokens.withColumn("shape", shape)
    wide = shaped.where(F.col("token").rlike(r"[^\x00-\x7F]"))
    # tokens without any ASCII all have one shape, which they share: they needn't meet
    bare = F.col("shape") == "\x01"
    shared = shaped.where(~bare).groupBy("shape").agg(F.count("*").alias("alike")).where("alike > 1")
    words = wide.where(~bare).join(shared, "shape", "left_semi").unionByName(wide.where(bare)).select("token", "n")
    # single characters are words too: what they turn into is found in tokens that stand in no table
    chars = tokens.select(F.explode(F.regexp_extract_all("token", F.lit(r"([^\x00-\x7F])"), 1)).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))

    def met(w: str) -> str:
        return w if len(w) <= SPELT else "\0" + hashlib.sha256(w.encode("utf-8", "surrogatepass")).hexdigest()

    # forms that no token has needn't leave their worker; a table of hashes of checked size says which those are
    n_tokens = tokens.count()
    known = None
    if n_tokens <= KNOWN_TOKENS:
        hashes = np.sort(np.array(tokens.select(F.xxhash64("met").alias("h")).toArrow().column(0).to_numpy(), np.int64))
        known = df.sparkSession.sparkContext.broadcast(hashes)

    def held(made: list[str]) -> np.ndarray:
        """Which of the forms some token may equal."""
        if known is None or not len(known.value):
            return np.full(len(made), known is None)
        h = np.array([xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass"), HASH_SEED) for f in made], np.uint64).view(np.int64)
        return known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] == h

    def garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"form": [], "origin": [], "chain": [], "n_original": []}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = [(met(f), c) for f, c in forms(w).items() if len(f) > 1 or f in "?�"]  # a single character that turns into another proves nothing
                made = [x for x, ok in zip(made, held([f for f, _ in made]).tolist(), strict=True) if ok] if made else made
                out["form"] += [f for f, _ in made]
                out["chain"] += [c for _, c in made]
                out["origin"] += [met(w)] * len(made)
                out["n_original"] += [n] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64() if c == "n_original" else pa.string()) for c in out], names=list(out))

    tasks = max(1, -(-n_tokens // WORDS_A_TASK))
    made = words.unionByName(chars).repartition(tasks, "token").mapInArrow(garble, "form string, origin string, chain string, n_original bigint")
    plain = F.col("chain").startswith("utf-8 as ") | F.col("token").contains("�") | F.col("token").rlike(r"\p{L}\?+\p{L}")
    best = F.max_by(F.struct("origin", "chain"), F.struct("n_original", "origin"))
    found = made.join(tokens, made.form == tokens.met).where(plain | (F.col("n") <= RARER * F.col("n_original"))).groupBy("token").agg(best.alias("b")).select("token", "b.origin", "b.chain")
    long = tokens.where(F.length("token") > SPELT).select(F.col("met").alias("origin"), F.col("token").alias("long"))
    return found.join(long, "origin", "left").select("token", F.coalesce("long", "origin").alias("original"), "chain")


def _places(df: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """Tokens of the table in each document. A table of checked size goes to the workers; a larger one is joined by shuffle."""
    kind = df.schema[key].dataType.simpleString()
    plain = df.select(df[key], df[text])
    if table.count() <= BROADCAST_ROWS:
        known = df.sparkSession.sparkContext.broadcast({r.token: (r.original, r.chain) for r in table.toLocalIterator()})

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = known.value
            for b in batches:
                at, hits = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    for w in set(odd_tokens(t)):
                        if w in find:
                            at.append(k)
                            hits.append((w, *find[w]))
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array([h[i] for h in hits], pa.string()) for i in range(3)]], names=[key, "token", "original", "chain"])

        return plain.mapInArrow(look, f"`{key}` {kind}, token string, original string, chain string").distinct()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, w) for k, t in enumerate(b.column(1).to_pylist()) for w in set(odd_tokens(t))]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in found])), pa.array([w for _, w in found], pa.string())], names=[key, "token"])

    tokens = plain.mapInArrow(own, f"`{key}` {kind}, token string").withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALT)))
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return tokens.join(salted, ["token", "_salt"]).select(key, "token", "original", "chain").distinct()


def _verified(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(places of tokens in documents, table of those tokens that are garbled); see `garbled_places`."""
    table = checkpointed(garbled_tokens(df, text))
    places = checkpointed(_places(df, key, text, table))
    company = places.groupBy(F.col(key).alias("_key"), F.col("chain").alias("_chain")).agg(F.count("*").alias("together"))
    sure = F.col("chain").startswith("utf-8") | F.col("token").contains("�")
    kept = (
        places.join(company, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chain") == F.col("_chain")))
        .groupBy("token", "chain")
        .agg(F.avg((F.col("together") > 1).cast("double")).alias("share"))
        .where(sure | (F.col("share") >= 0.5))
        .select("token")
    )
    return places, table.join(kept, "token", "left_semi")


def garbled_places(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, token, original, chain`: each distinct garbled token of each document; documents without one have no row.

    A token that one-for-one chains could have made may be a foreign word as well. It is verified by its company: in at least
    half of the documents that hold it some other token went through the same chain. Forms of several characters for one, and
    replacement marks, need no company. Null, empty and clean texts have no row; repeated rows count once.
    """
    places, table = _verified(df, key, text)
    return places.join(table.select("token"), "token", "left_semi")


def garbled_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` of each document with a garbled character, whether or not it can be restored."""
    return garbled_places(df, key, text).select(key).distinct()


def _repaired(text: str, m: dict[str, str], chain: str) -> str:
    def put(x: re.Match) -> str:
        w = x.group()
        if w in m:
            return m[w]
        return w if w.isascii() else invert(w, chain) or w

    return re.sub(r"[^ \t\r\n\f]+", put, text)


def _likeliest(chains: list[str]) -> str:
    n = Counter(chains)
    return max(n, key=lambda c: (n[c], c))


def restored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, chain, n_garbled, text, complete`: the garbled documents with their original text as far as it can be had.

    Garbled tokens are replaced by their verified originals; other tokens beyond ASCII take the inverse of the document's
    chain if it exists, the one that most of its tokens went through. `complete` is false if a replacement mark or an open `?`
    form of a lossy chain may be left. Repeated rows count once. A table of checked size goes to the workers, which repair
    texts where they are read; with a larger one texts meet their tokens by key.
    """
    places, table = _verified(df, key, text)
    table = checkpointed(table)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, chain string, n_garbled bigint, text string, complete boolean"
    plain = df.select(df[key].alias(key), df[text].alias("text"))

    def rows(keys: pa.Array, found: list[tuple[int, str, dict[str, str], str]]) -> pa.RecordBatch:
        fixed = [_repaired(t, m, c) for _, t, m, c in found]
        cols = [keys.take(pa.array([k for k, *_ in found], pa.int64())), pa.array([c for *_, c in found], pa.string()), pa.array([len(m) for _, _, m, _ in found], pa.int64()), pa.array(fixed, pa.string()), pa.array(["�" not in s and c not in LOSSY for s, (*_, c) in zip(fixed, found, strict=True)], pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=[key, "chain", "n_garbled", "text", "complete"])

    if table.count() <= BROADCAST_ROWS:
        known = df.sparkSession.sparkContext.broadcast({r.token: (r.original, r.chain) for r in table.toLocalIterator()})

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = known.value
            for b in batches:
                found = []
                for k, t in enumerate(b.column(1).to_pylist()):
                    own = [w for w in set(odd_tokens(t)) if w in find]
                    if own:
                        found.append((k, t, {w: find[w][0] for w in own}, _likeliest([find[w][1] for w in own])))
                if found:
                    yield rows(b.column(0), found)

        return plain.mapInArrow(look, schema).distinct()

    # one document's tokens are bounded by its text
    by_doc = places.join(table.select("token"), "token", "left_semi").groupBy(key).agg(F.collect_set(F.struct("token", "original", "chain")).alias("m"))
    held = plain.join(by_doc, key).distinct()

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, (t, m) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = set(odd_tokens(t))
                m = [x for x in m if x["token"] in own]
                if m:
                    found.append((k, t, {x["token"]: x["original"] for x in m}, _likeliest([x["chain"] for x in m])))
            if found:
                yield rows(b.column(0), found)

    return held.select(key, "text", "m").mapInArrow(fix, schema)


def p10_found(spark, sf_dir: str) -> DataFrame:
    from glasra.tables import read, spread

    return garbled_documents(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_restored(spark, sf_dir: str) -> DataFrame:
    from glasra.tables import read, spread

    return restored(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
