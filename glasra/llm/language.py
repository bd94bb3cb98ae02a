"""Problem 4: the language of each text and of each stretch in it, where labels are missing or wrong.

Model. Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by the forward algorithm; expectation-maximisation over the words of a bounded sample of
labelled texts gives the piece probabilities. Texts of the sample that the first model gives to another language than their
label, or that it finds mixed, are left out of a second fit, so wrong labels don't teach.

Texts. A worker scores each distinct chunk between white space once. Whole batches are then summed with NumPy. A text in which
some run of words favours another language by more than a change of language costs is parted by Viterbi; all others hold one.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasra.llm.bpe import TOKENIZER_DIR
from glasra.llm.lookalike import one_form
from glasra.tables import lang_code, read, spread

LANGS = ("ga", "en", "gd", "cy", "fr")
#: Labelled texts of each language that the model is fitted on: a bounded sample, chosen by a hash of their key.
SAMPLE = 150
#: Characters that a text of the sample counts with at most; of a longer one, a stretch from a place told by its hash.
SAMPLE_CHARS = 20_000
#: Letters of a word that are parted into pieces at a time; longer words count in parts.
PART = 40
#: Words of the least stretch that counts as a language of its text.
LEAST = 6
#: Cost of a change of language, and the most that one word says for a language, in nats.
SWITCH, CLIP = 9.0, 4.0
#: What a stretch has to say for its language against each neighbour, in nats.
SURE = 12.0
#: Share of a piece's probability that comes from all languages together.
SHARED = 1e-4
ROUNDS = 2
#: Chunks, and characters of them, that a worker remembers before it starts anew; bounds its memory, never the result.
REMEMBERED, HELD_CHARS = 400_000, 20_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_SPECIAL = re.compile(r"<\|[^|>\s]{1,40}\|>|</?s>|<unk>|<pad>")
# Letters of the five languages beyond ASCII, and marks that stand beside words. A capital with an accent
# behind a small letter is no letter of its word either, but a wrong decoding of one.
_FOREIGN = re.compile("[^\\x00-\\x7fáéíóúàèìòùâêîôûŵŷäëïöüÿçœæñøåþðÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛŴŶÄËÏÖÜŸÇŒÆÑØÅÞÐḃċḋḟġṁṗṡṫḂĊḊḞĠṀṖṠṪ‘’“”„‚«»‹›–—…·•€£°№×]|[a-z]\\?[a-z]|[a-zß-ÿ][ÀÂÄÈÊËÌÎÏÒÔÖÙÛÜ]|^[ÀÈÌÒÙÂÊÎÔÛ]$")


def parts(chunk: str) -> list[str] | None:
    """Words of letters in a chunk, lower case, composed, in one form of characters; None for a word that says nothing.

    Special tokens hold no words. A word with characters that none of the languages writes (garbled ones, other scripts) counts
    as a word, but for no language.
    """
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", one_form(chunk))
    if "<" in chunk:
        chunk = _SPECIAL.sub(" ", chunk)
    ws = _LETTERS.findall(chunk.lower())
    return None if ws and _FOREIGN.search(chunk) else ws


def in_parts(word: str) -> list[str]:
    """A word in parts of at most PART letters; nearly all words are one."""
    return [word[k : k + PART] for k in range(0, len(word), PART)] if len(word) > PART else [word]


class Model:
    """Piece probabilities of each language. The last row is that of a letter without a piece, the one before it of no piece."""

    def __init__(self, pieces: dict[str, int], table: np.ndarray):
        self.pieces, self.table = pieces, table
        self.longest = max(map(len, pieces), default=1)

    def digest(self) -> str:
        """Name of this model by what it holds: workers keep what they learnt of a model under it."""
        h = hashlib.sha256("\0".join(self.pieces).encode())
        h.update(np.ascontiguousarray(self.table).tobytes())
        return h.hexdigest()

    def lattices(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words by length: their places in the list, and rows [word, start, end] of the pieces they may be parted into."""
        none, letter, by = len(self.pieces), len(self.pieces) + 1, defaultdict(list)
        for k, w in enumerate(words):
            by[len(w) + 1].append(k)
        for n, ks in by.items():
            for at in range(0, len(ks), 2000):
                mine = ks[at : at + 2000]
                rows = np.full((len(mine), n, n + 1), none, np.int32)
                for r, k in enumerate(mine):
                    s = "▁" + words[k]
                    for i in range(n):
                        for j in range(i + 1, min(n, i + self.longest) + 1):
                            row = self.pieces.get(s[i:j])
                            if row is not None:
                                rows[r, i, j] = row
                            elif j == i + 1:
                                rows[r, i, j] = letter
                yield mine, rows

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of each prefix: [word, end, language]."""
        a = np.zeros((len(rows), rows.shape[2], len(LANGS)))
        a[:, 0] = 1.0
        for j in range(1, rows.shape[2]):
            for i in range(max(0, j - self.longest), j):
                a[:, j] += a[:, i] * self.table[rows[:, i, j]]
        return a

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, no further than CLIP below the best. Long words count in parts."""
        cut = [p for w in words for p in in_parts(w)]
        owner = np.repeat(np.arange(len(words)), [max(1, -(-len(w) // PART)) for w in words])
        out = np.zeros((len(words), len(LANGS)))
        for ks, rows in self.lattices(cut):
            np.add.at(out, owner[ks], np.log(np.maximum(self.forward(rows)[:, -1], 1e-300)))
        return np.maximum(out, out.max(1, keepdims=True, initial=-1e9) - CLIP)


def vocabulary(path: str) -> dict[str, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            out.setdefault(sp.id_to_piece(i).lower(), len(out))
    return out


def fit(counts: list[Counter], pieces: dict[str, int], rounds: int = ROUNDS) -> Model:
    """Piece probabilities from the words of each language, by expectation-maximisation. `counts` are parallel to LANGS."""
    words = sorted({p for c in counts for w in c for p in in_parts(w)})
    place = {w: k for k, w in enumerate(words)}
    n = np.zeros((len(words), len(LANGS)))
    for lang, c in enumerate(counts):
        for w, k in c.items():
            for p in in_parts(w):
                n[place[p], lang] += k
    size = len(pieces)
    model = Model(pieces, np.full((size + 2, len(LANGS)), 1.0 / max(1, size)))
    model.table[size:] = [[0.0], [1e-7]]
    lattices = list(model.lattices(words))
    for _ in range(rounds):
        expected = np.zeros_like(model.table)
        for ks, rows in lattices:
            a = model.forward(rows)
            b = np.zeros_like(a)
            b[:, -1] = n[ks] / np.maximum(a[:, -1], 1e-300)
            for i in range(rows.shape[1] - 1, -1, -1):
                for j in range(i + 1, min(rows.shape[1], i + model.longest) + 1):
                    arc = rows[:, i, j]
                    on = np.flatnonzero(arc != size)
                    part = b[on, j] * model.table[arc[on]]
                    b[on, i] += part
                    np.add.at(expected, arc[on], a[on, i] * part)
        expected = expected[:size]
        share = expected / np.maximum(expected.sum(0), 1e-9)
        everywhere = share.mean(1, keepdims=True)
        model.table[:size] = (1 - 2 * SHARED) * share + SHARED * everywhere + SHARED / max(1, size)
    return model


class _Rows(dict):
    """Chunk -> row of its scores, -1 where it holds no word, -2 where it isn't scored yet."""

    def __missing__(self, chunk: str) -> int:
        return -2


class Scorer:
    """A worker's scores of the chunks it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows = _Rows()
        self.held = 0
        self.words: dict[str, np.ndarray] = {}
        self.scores: list[np.ndarray] = []
        self.table = np.zeros((0, len(LANGS)))

    def learn(self, chunks: set[str]) -> None:
        held = {c: parts(c) for c in chunks}
        self.held += sum(map(len, chunks))
        new = sorted({w for ws in held.values() for w in ws or () if w not in self.words})
        self.words.update(zip(new, self.model.scores(new), strict=True))
        for c, ws in held.items():
            if ws is not None and not ws:
                self.rows[c] = -1
                continue
            total = np.zeros(len(LANGS))
            for w in ws or ():
                total = total + self.words[w]
            self.rows[c] = len(self.scores)
            self.scores.append(np.maximum(total, total.max() - CLIP))

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its stretches (language, confidence, first word, end), in order; none for a text without words."""
        if len(self.rows) > REMEMBERED or self.held > HELD_CHARS:
            self.forget()
        split = [(t or "").split() for t in texts]
        get = self.rows.__getitem__
        rows = np.array(list(map(get, chain.from_iterable(split))), np.int64)
        if (rows == -2).any():
            flat = list(chain.from_iterable(split))
            self.learn({flat[k] for k in np.flatnonzero(rows == -2).tolist()})
            rows = np.array(list(map(get, flat)), np.int64)
        size = np.zeros(len(texts), np.int64)
        np.add.at(size, np.repeat(np.arange(len(texts)), [len(c) for c in split])[rows >= 0], 1)
        rows = rows[rows >= 0]
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        if not len(rows):
            return out
        if len(self.table) != len(self.scores):
            self.table = np.array(self.scores)
        x = self.table[rows]
        some = np.flatnonzero(size)
        ends = np.cumsum(size[some])
        starts = ends - size[some]
        sums = np.add.reduceat(x, starts, axis=0)
        main = sums.argmax(1)
        gain = x - x[np.arange(len(x)), np.repeat(main, size[some])][:, None]
        # the run of words that says most for another language: running sums over their least value so far, anew in each text
        mixed = np.zeros(len(some), bool)
        depth = 1e6 * np.arange(len(some))
        each = np.repeat(np.arange(len(some)), size[some])
        for k in range(len(LANGS)):
            g = np.cumsum(gain[:, k])
            g = g - np.concatenate(([0.0], g[ends[:-1] - 1]))[each] - depth[each]
            low = np.concatenate(([0.0], np.minimum.accumulate(g)[:-1]))
            low = np.minimum(low, -depth[each])
            low[starts] = -depth
            mixed |= np.maximum.reduceat(g - low, starts) > SWITCH
        sure = 1.0 / np.exp(np.clip(sums - sums[np.arange(len(some)), main][:, None], -700, 0)).sum(1)
        for k, m, c, n in zip(some.tolist(), main.tolist(), sure.tolist(), size[some].tolist(), strict=True):
            out[k] = [(LANGS[m], c, 0, n)]
        for i in np.flatnonzero(mixed & (size[some] >= 2 * LEAST)).tolist():
            out[some[i]] = stretches(x[starts[i] : ends[i]])
        return out


def confidence(total: np.ndarray, k: int) -> float:
    """Posterior of language k with equal priors."""
    return float(1.0 / np.exp(np.clip(total - total[k], -700, 50)).sum())


def stretches(x: np.ndarray) -> list[tuple[str, float, int, int]]:
    """Viterbi over the words of one text, then short stretches given to their neighbours."""
    n = len(x)
    rows = x.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(best)
        k, least = best.index(top), top - SWITCH
        back.append([m if v >= least else k for m, v in enumerate(best)])
        best = [(v if v >= least else least) + w for v, w in zip(best, row, strict=True)]
    path = np.empty(n, np.int64)
    path[-1] = k = best.index(max(best))
    for i in range(n - 2, -1, -1):
        path[i] = k = back[i][k]
    while True:
        cut = np.flatnonzero(np.diff(path)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
        if len(begin) == 1:
            break
        sure = [_sure(x[a:b], path[a], path[a - 1] if a else -1, path[b] if b < n else -1) for a, b in zip(begin, end, strict=True)]
        k = int(np.argmin(sure))
        if sure[k] >= LEAST:
            break
        a, b = begin[k], end[k]
        near = [path[a - 1]] * bool(a) + ([path[b]] if b < n else [])
        path[a:b] = max(near, key=lambda m: x[a:b, m].sum())
    return [(LANGS[path[a]], confidence(x[a:b].sum(0), int(path[a])), int(a), int(b)) for a, b in zip(begin, end, strict=True)]


def _sure(x: np.ndarray, k: int, before: int, after: int) -> int:
    """Words of a stretch from the first to the last that says more for its language than for its neighbours'; names at its ends don't count."""
    rivals = [m for m in (before, after) if m >= 0]
    more = x[:, [k]] - x[:, rivals]
    if more.sum(0).min() < SURE:
        return 0
    clear = np.flatnonzero(more.min(1) > 1.0)
    return int(clear[-1] - clear[0] + 1) if len(clear) else 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", tokenizer_dir: str = TOKENIZER_DIR, sample: int = SAMPLE) -> Model:
    """A model from about `sample` labelled texts of each language. Labels in any spelling; a language without texts keeps flat odds."""
    d = docs.select(F.xxhash64(docs[key]).alias("h"), lang_code(docs[label]).alias("lang"), docs[text].alias("text")).where(F.col("lang").isin(*LANGS))
    have = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for k, n in have.items():
        part = F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * sample / n))).otherwise(part)
    begin = F.lit(1) + F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    some = F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text")
    rows = d.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < part) & F.col("text").isNotNull()).select("lang", some, "h").collect()
    by: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.h):
        if len(by[r.lang]) < sample:
            by[r.lang].append(Counter(p for c in r.text.split() for p in parts(c) or ()))
    pieces = vocabulary(os.path.join(tokenizer_dir, "piece_bpe_32k.model"))
    # names and numbers of rare use stay in: every language has them alike
    first = fit([_total(by[k]) for k in LANGS], pieces, 1)
    seen = sorted({w for cs in by.values() for c in cs for w in c})
    score = dict(zip(seen, first.scores(seen), strict=True))

    def own(c: Counter, k: int) -> bool:
        total = np.zeros(len(LANGS))
        odd = words = 0
        for w, n in c.items():
            total += n * score[w]
            words += n
            odd += n * (score[w].max() - score[w][k] > 2.0)
        return words > 0 and int(total.argmax()) == k and odd < 0.25 * words

    return fit([_total([c for c in by[k] if own(c, i)]) for i, k in enumerate(LANGS)], pieces)


def save(model: Model, path: str) -> None:
    """Keep a model in one file of the shared folder, so that later jobs needn't read the corpus to fit it again."""
    out = io.BytesIO()
    np.savez_compressed(out, table=model.table, pieces=np.array(list(model.pieces)), langs=np.array(LANGS))
    fs, at = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{at}.part") as f:
        f.write(out.getvalue())
    fs.move(f"{at}.part", at)


def load(path: str) -> Model:
    """A model that `save` kept; one of other languages is refused."""
    fs, at = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with fs.open_input_stream(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
        if tuple(z["langs"].tolist()) != LANGS:
            raise ValueError(f"a model of {z['langs'].tolist()}")
        return Model({p: k for k, p in enumerate(z["pieces"].tolist())}, z["table"])


def _total(counts: list[Counter]) -> Counter:
    out: Counter = Counter()
    for c in counts:
        out.update(c)
    return out


_SCORERS: dict[str, Scorer] = {}


def detect(texts: DataFrame, model: Model, want: str = "found") -> DataFrame:
    """Languages of texts. `texts` has `tab, row_id, label, text`; label null, empty or `und` is missing.

    found: `tab, row_id, lang` of the cases: label missing, label of another language, or several languages in stretches of at
    least six words; a row for each language. texts: `tab, row_id, lang, confidence, n_words` of every text with words, by its
    language of most words. stretches: `tab, row_id, lang, confidence, first_word, end_word`. Texts without words have no rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    token = model.digest()
    plain = texts.select("tab", F.col("row_id").cast("long").alias("row_id"), lang_code(F.col("label")).alias("label"), "text")
    schema = {
        "found": "tab string, row_id bigint, lang string",
        "texts": "tab string, row_id bigint, lang string, confidence double, n_words bigint",
        "stretches": "tab string, row_id bigint, lang string, confidence double, first_word int, end_word int",
    }[want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _SCORERS.get(token)
        if s is None:
            _SCORERS.clear()
            s = _SCORERS[token] = Scorer(shared.value)
        for b in batches:
            at: list[int] = []
            cols: list[list] = [[] for _ in range(schema.count(",") - 1)]
            labels = b.column(2).to_pylist()
            for k, found in enumerate(s.batch(b.column(3).to_pylist())):
                if not found:
                    continue
                if want == "stretches":
                    new = found
                else:
                    n: Counter[str] = Counter()
                    sure: dict[str, float] = defaultdict(float)
                    for lang, conf, i, j in found:
                        n[lang] += j - i
                        sure[lang] = max(sure[lang], conf)
                    if want == "texts":
                        lang = max(n, key=lambda m: (n[m], m))
                        new = [(lang, sure[lang], sum(n.values()))]
                    else:
                        new = [(m,) for m in sorted(n)] if len(n) > 1 or labels[k] != next(iter(n)) else []
                for row in new:
                    at.append(k)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            if at:
                where = pa.array(at)
                names = [f.split()[0] for f in schema.split(", ")]
                types = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
                rest = [pa.array(c, types[f.split()[1]]) for c, f in zip(cols, schema.split(", ")[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), *rest], names=names)

    return plain.mapInArrow(run, schema).distinct()


def project_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the three tables with their labels."""
    pairs, decodes, docs = (read(spark, sf_dir, t) for t in ("asr_pairs", "decodes", "documents"))
    texts = (
        docs.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text")
        .unionByName(pairs.select(F.lit("asr_pairs").alias("tab"), "row_id", F.col("lang").alias("label"), F.col("hyp").alias("text")))
        .unionByName(decodes.select(F.lit("decodes").alias("tab"), "row_id", F.col("lang").alias("label"), F.col("hypothesis").alias("text")))
    )
    return spread(texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(project_texts(spark, sf_dir), train(read(spark, sf_dir, "documents")))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(project_texts(spark, sf_dir), train(read(spark, sf_dir, "documents")), "texts")


def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(project_texts(spark, sf_dir), train(read(spark, sf_dir, "documents")), "stretches")
