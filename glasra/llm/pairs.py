"""Problem 3: defective answers of question-answer pairs, each with the first defect that applies.

empty: no letter, digit or sign is left besides special tokens, punctuation and invisible characters.
refusal: a phrase of the refusal dictionaries, all in the first person and outside of quoted speech; a report of somebody else's
refusal has none.
copied: compressed with the question as its zstandard dictionary the answer takes hardly a byte, and the question likewise
with the answer as dictionary; the words then have to be those of the question.
other_language: the pieces of the language model speak against the question's language, names left out.
truncated: the last word is a known word's beginning, or one after which no sentence ends. The terminal-context model has how often
each word, and each pair of words, ends a sentence of all distinct questions and answers of the table; an answer's own end doesn't
speak for itself. A dictionary of function words is its prior where the counts are few.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasra.llm.language import LANGS, Model, Scorer, train
from glasra.session import checkpointed
from glasra.tables import read, spread

# What says that the answerer declines or is unable, by language; first person throughout.
REFUSALS = {
    "en": r"\bi(?:['’]m| am)(?: sorry,? but i(?:['’]m| am))? (?:not able|unable|not (?:permitted|allowed|comfortable|in a position|sure))\b|\bi (?:can(?:['’]?t|not| not)|could(?:n['’]?t| not)|won['’]?t|will not|wouldn['’]?t|would not|(?:do not|don['’]?t) (?:have|know|feel|think i)|(?:must|have to|shall|will) (?:decline|refuse)|decline|refuse|lack|have no)\b|\bi(?:['’]d| would) (?:rather|prefer) not\b|\b(?:not be|isn['’]t|is not|wouldn['’]t be) (?:appropriate|possible|right) for me\b|\bno way for me\b|\bas an? (?:ai|assistant|language model|artificial)\b|\bbeyond (?:my|what i)\b|\bunable to (?:answer|help|assist|respond|comply|listen)\b.*\b(?:i|me|my)\b",
    "ga": r"\bní (?:féidir|thig|bheidh mé in ann|mian|maith) liom\b|\bní féidir liom\b|\bníl(?:im| mé) (?:in ann|ábalta|cinnte|sásta|in acmhainn)\b|\bníl (?:\w+ ){0,4}(?:agam|orm|dom)\b|\bní (?:leor|fios|eol|heol) (?:\S+ ){0,4}(?:agam|dom)\b|\bt(?:áim|á mé) gan (?:chead|eolas|rochtain)\b|\bb['’]fhearr liom gan\b|\bb['’]fhearr dom gan\b|\bdiúltaím\b|\bcaithfidh mé (?:diúltú|é a dhiúltú)\b|\bní mór dom diúltú\b|\bmar (?:mhúnla|mhúnlá) teanga\b|\bmar (?:chúntóir|inneall|ais)\b.{0,20}\b(?:ní|níl)|\bní bheadh sé (?:cuí|ceart|oiriúnach) dom\b|\bní thabharfaidh mé\b|\bní fhreagróidh mé\b|\bníl a fhios agam\b",
    "gd": r"\bchan urrainn (?:dhomh|dhuinn)\b|\bchan eil (?:fhios|fios|comas|cead)\b.{0,12}\b(?:agam|orm)\b|\bchan eil mi (?:comasach|cinnteach)\b|\bb['’]fheàrr leam gun\b",
    "cy": r"\b(?:ni|alla i|allaf) (?:allaf|ddim|i ddim)\b|\b(?:dydw|dw) i ddim yn (?:gallu|gwybod)\b|\bmae(?:['’]n| yn) ddrwg gen i\b|\bbyddai['’]n well gen i beidio\b",
    "fr": r"\bje (?:ne|n['’]) ?(?:peux|puis|suis pas|sais|dispose|souhaite|ai pas)\b|\bje (?:préfère|refuse|dois refuser|dois décliner)\b|\ben tant que (?:modèle|qu['’]assistant|assistant)\b|\bil m['’]est impossible\b",
}
_REFUSAL = re.compile("|".join(REFUSALS.values()), re.IGNORECASE)
# Words after which no sentence ends, in Irish, English, Gaelic, Welsh and French.
OPEN_WORDS = frozenset(
    "an na a ag ar as ó go i in sa san le do de gan chun mar agus is ach nach ná nó cé gur má dá mo bhur ón den don um idir roimh thar ionas toisc nuair sula ní níor arna trína dtí "
    "the of to at by for from with and or but because that than if when while who which their his her its my your our are was were be been will would has have had although so "
    "ri aig air gus agus gum gun nan nam bho yn y yr i o ac neu ond am fod le la les un une des du et ou mais que qui dans pour avec sur".split()
)
_SPECIAL = re.compile(r"<\|[^|>]{0,40}\|>|</?s>|<(?:unk|pad|eos|bos|mask)>|\[(?:unk|pad|eos|bos|sep|cls|end)\]", re.IGNORECASE)
_LABEL = re.compile(r"^\s*(?:(?:ceist|freagra|question|answer|q|a|c|f)\s*[:.]\s*)+|\s*\b(?:freagra|answer)\s*:?\s*$|\s+[fa]\.\s*$", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_NAME = re.compile(r"(?:(?<=[^\s.!?“”\"] )|(?<=^))(?:[A-ZÁÉÍÓÚ][\w’'-]*)(?: (?:[A-ZÁÉÍÓÚ][\w’'-]*|de|Mac|Giolla))*")
# Speech of others: between quotation marks, or after a verb of saying and a colon. The verbs.
_QUOTED = re.compile(r"“[^“”]*”|\"[^\"]*\"|«[^«»]*»|‘(?:[^‘’]|’(?=\w))*’(?!\w)|\b(?:said|says|replied|answered|wrote|dúirt|deir|arsa|d['’]fhreagair|thuirt|meddai|dywedodd|dit|répond)\b[^.!?:\n]{0,60}:[^.!?\n]*")
#: Bytes beyond a pure copy, and the share of words, that a copied answer may differ by.
COPY_BYTES, COPY_SHARE = 12, 0.8
#: What other_language needs against the question's language, in nats.
AGAINST = 10.0
#: A word seen so often that ends hardly any sentence leaves one open.
OFTEN, SELDOM = 200, 0.01
#: A word's beginnings end so small a share of what might be that word, and stand whole for a still smaller one.
FRAGMENT, WHOLE = 0.02, 0.001
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 500_000
#: A mark ends this share of what it ends by chance after a word that leaves a sentence open; more if the dictionary has the word.
LOW, LOW_KNOWN = 0.1, 0.6
#: Sentences that two words have to end, and their share of all that end in the second one, to be an end in spite of it.
PAIRED, PAIRED_SHARE = 3, 0.2
#: Beginnings of words up to this length are told letter by letter; longer ones by a running hash of them.
SPELT = 60
#: Questions whose scores a worker remembers.
ASKED = 50_000


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but white space, invisible characters, punctuation and special tokens."""
    if answer is None:
        return True
    for ch in _SPECIAL.sub(" ", answer):
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or kind[0] == "S" and ch not in "|~^<>=+`´¨$":
            return False
    return True


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower())
    return " ".join(_WORD.findall("".join(c for c in s if not unicodedata.combining(c))))


def _extra(text: str, dictionary: str) -> int:
    """Bytes that the text takes with the dictionary, beyond what a copy of all of the dictionary would."""
    d = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(c.compress(text.encode())) - len(c.compress(dictionary.encode()))


def is_refusal(answer: str) -> bool:
    """Whether the answerer declines in words of their own; an answer that is all one quotation is their own too."""
    if not _REFUSAL.search(answer):
        return False
    rest = _QUOTED.sub(" ", answer)
    return len(_WORD.findall(rest)) < 2 or _REFUSAL.search(rest) is not None


def is_copied(question: str | None, answer: str) -> bool:
    """All or nearly all of the question, in any case, spacing, punctuation or accents, perhaps twice or labelled, and no answer."""
    q = _fold(question or "")
    if not q:
        return False
    a = _fold(_LABEL.sub(" ", " ".join(answer.split())))
    if not a or len(a) < COPY_SHARE * len(q):
        return False
    if _extra(a, q) > COPY_BYTES or _extra(q, a) > COPY_BYTES + (1 - COPY_SHARE) * len(q):
        return False
    qs, left = q.split(), Counter(q.split())
    fresh, both = 0, 0
    for w in a.split():
        if left[w] > 0:
            left[w] -= 1
            both += 1
        elif w not in left:
            fresh += 1
    return both >= COPY_SHARE * len(qs) and fresh <= (1 - COPY_SHARE) * len(qs) / 2


class Judge:
    """Defects that a pair shows by itself."""

    def __init__(self, model: Model, prior: np.ndarray | None = None):
        self.scorer = Scorer(model)
        self.prior = np.zeros(len(LANGS)) if prior is None else prior
        self.asked: dict[str, tuple[np.ndarray, int]] = {}

    def _sum(self, text: str) -> tuple[np.ndarray, int]:
        chunks = text.split()
        new = {c for c in chunks if c not in self.scorer.rows}
        if new:
            self.scorer.learn(new)
        rows = [self.scorer.rows[c] for c in chunks]
        rows = [r for r in rows if r >= 0]
        return (np.sum([self.scorer.scores[r] for r in rows], axis=0), len(rows)) if rows else (np.zeros(len(LANGS)), 0)

    def _nameless(self, text: str) -> tuple[np.ndarray, int]:
        return self._sum(_NAME.sub(lambda m: m.group() if m.start() == 0 and " " not in m.group() else " ", text.strip()))

    def language(self, question: str | None) -> int | None:
        """Language of a question: its words, names left out, and how common each language is among the table's questions."""
        held = self.asked.get(question or "")
        if held is None:
            held = self._nameless(question or "")
            if len(self.asked) >= ASKED:
                self.asked.clear()
            if len(question or "") <= 1000:
                self.asked[question or ""] = held
        q, n = held
        return int((q + self.prior).argmax()) if n >= 2 else None

    def other_language(self, question: str | None, answer: str) -> bool:
        lang = self.language(question)
        if lang is None:
            return False
        a, n = self._nameless(answer)
        return n >= 3 and a.max() - a[lang] > AGAINST

    def defect(self, question: str | None, answer: str | None) -> str | None:
        if is_empty(answer):
            return "empty"
        if len(self.scorer.rows) > 300_000:
            self.scorer.forget()
        if is_refusal(answer):
            return "refusal"
        if is_copied(question, answer):
            return "copied"
        if self.other_language(question, answer):
            return "other_language"
        return None


_CLOSING = " \t\r\n\f\v\"'”’)]»"
_WORDS = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)([.!?]+[\"'”’)\]»]*(?!\S))?")


def _is_letter(s: str, i: int) -> bool:
    return 0 <= i < len(s) and s[i].isalnum()


def last_word(answer: str) -> tuple[str, str, str] | None:
    """(word, what follows it, word before) of an answer that doesn't end like a sentence; None if it does. Ellipses don't end one.

    Looked for from the end, so a long answer costs no more than a short one.
    """
    s = _SPECIAL.sub(" ", answer).rstrip()
    end = s.rstrip(_CLOSING)
    if end.endswith(("…", "..")):
        s = end.rstrip(".…") + "…"
    elif end.endswith((".", "!", "?")):
        return None
    j = len(s)
    while j and not (_is_letter(s, j - 1) or s[j - 1] == "_"):
        j -= 1
    if not j or s[j - 1] == "_":
        return None
    i = _word_start(s, j)
    tail = s[j:].strip()
    if not tail and not re.search(r"\s", s.strip()):
        return None  # an answer of one word is whole
    k = i
    while k and not _is_letter(s, k - 1):
        k -= 1
    return s[i:j].lower(), tail, s[_word_start(s, k) : k].lower()


def _word_start(s: str, j: int) -> int:
    i = j
    while i and (_is_letter(s, i - 1) or s[i - 1] in "'’" and i < j and _is_letter(s, i) and _is_letter(s, i - 2)):
        i -= 1
    return i


def words_and_ends(text: str) -> tuple[list[str], int, list[int]]:
    """Words of a text, lower case, how many of them are known to be whole (the last is not, unless a mark follows it), and places of those before a mark."""
    ws, marked = [], []
    for m in _WORDS.finditer(_SPECIAL.sub(" ", text)):
        if m.group(2):
            marked.append(len(ws))
        ws.append(m.group(1).lower())
    return ws, len(ws) if text.rstrip(_CLOSING).endswith((".", "!", "?")) else max(0, len(ws) - 1), marked


_JUDGES: dict[str, Judge] = {}


def pair_defects(pairs: DataFrame, model: Model, key: str = "packet_id", question: str = "question", answers: dict[str, str] | None = None) -> DataFrame:
    """Distinct `key, condition, defect`: a row for each defective answer of each pair, repeated deliveries once.

    `answers` names the answer columns by condition. A null question leaves copied and other_language out. Sound answers have
    no row; wrong, short and unpunctuated ones are sound.
    """
    answers = answers or {"just_audio": "answers.just_audio", "no_context": "answers.no_context"}
    kind = pairs.schema[key].dataType.simpleString()
    flat = pairs.select(key, F.col(question).alias("question"), *[F.col(c).alias(k) for k, c in answers.items()])
    names = list(answers)
    counts = ["n", "n_mark", "n_end", "n_given"]
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    token = model.digest()

    def mine(prior: np.ndarray | None) -> Judge:
        j = _JUDGES.get(token)
        if j is None:
            _JUDGES.clear()
            j = _JUDGES[token] = Judge(shared.value)
        if prior is not None:
            j.prior = prior
        return j

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, n = mine(np.zeros(len(LANGS))), Counter()
        for b in batches:
            n.update(j.language(q) for q in b.column(0).to_pylist())
        n.pop(None, None)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["lang", "n"])

    told = {r.lang: r.n for r in flat.select("question").mapInArrow(tell, "lang int, n bigint").groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    common = np.array([told.get(k, 0) + 1.0 for k in range(len(LANGS))])
    common = np.log(common / common.sum())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = mine(common)
        columns = [key, "condition", "defect", "word", "tail", "before", "answer"]
        for b in batches:
            qs = b.column(1).to_pylist()
            at: list[int] = []
            rows: list[tuple] = []
            for i, name in enumerate(names):
                for k, (q, a) in enumerate(zip(qs, b.column(2 + i).to_pylist(), strict=True)):
                    d = j.defect(q, a)
                    if d:
                        at.append(k)
                        rows.append((name, d, None, None, None, a))
                    elif (w := last_word(a)) is not None:
                        at.append(k)
                        rows.append((name, None, *w, None))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array([r[c] for r in rows], pa.string()) for c in range(6)]], names=columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter[str]] = [Counter() for _ in range(4)]
        whole, marks, ends, given = held
        for b in batches:
            for t, answer, asked in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True):
                ws, n, marked = words_and_ends(t)
                whole.update(ws[:n])
                for i in marked:
                    marks[ws[i]] += 1
                    if i:
                        marks[f"{ws[i - 1]} {ws[i]}"] += 1
                if ws and answer:
                    ends[ws[-1]] += 1
                    given[ws[-1]] += asked
            if len(whole) + len(marks) > HELD_WORDS:
                yield counted(held)
                for c in held:
                    c.clear()
        if any(held):
            yield counted(held)

    def counted(held: list[Counter]) -> pa.RecordBatch:
        ws = list(set().union(*held))
        return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *[pa.array([c[w] for w in ws], pa.int64()) for c in held]], names=["word", *counts])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a running hash of each word beyond SPELT letters: linear in its length
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = xxhash.xxh3_128(w[:SPELT].encode())
                made = []
                for ch in w[SPELT : -1 if n is not None else None]:
                    h.update(ch.encode())
                    made.append(h.hexdigest())
                if n is None:
                    made = made[-1:]
                for k in range(0, len(made), 10_000):
                    part = made[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([w if n is None else None] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([n] * len(part), pa.int64())], names=["word", "beginning", "n"])

    passed = checkpointed(flat.mapInArrow(judge, f"`{key}` {kind}, condition string, defect string, word string, tail string, before string, answer string"))
    judged = passed.drop("answer").distinct()
    # words of each question once, and of each answer without a defect so far once, with the number of questions it is given to
    each = [F.struct(F.col(c).alias("text"), F.lit(c != "question").alias("is_answer"), F.xxhash64("question").alias("asked"), F.lit(False).alias("bad")) for c in ("question", *names)]
    defective = passed.where("answer is not null").select(F.col("answer").alias("text"), F.lit(True).alias("is_answer"), F.lit(None).cast("long").alias("asked"), F.lit(True).alias("bad"))
    texts = flat.select(F.inline(F.array(*each))).where("text is not null").unionByName(defective)
    sound = texts.groupBy("text", "is_answer").agg(F.max("bad").alias("bad"), F.count_distinct("asked").alias("asked")).where("not bad").select("text", "is_answer", "asked")
    words = checkpointed(sound.mapInArrow(count, "word string, " + ", ".join(f"{c} bigint" for c in counts)).groupBy("word").agg(*[F.sum(c).alias(c) for c in counts]))
    single = words.where(~F.contains("word", F.lit(" ")))
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_mark"), F.lit(0)).alias("m")).first()
    chance = total.m / max(1, total.n)  # a word before a mark
    lasts = judged.where("word is not null").select("word", "before").distinct()
    last = lasts.select("word").distinct()
    whole = single.where("n > 0").select("word", "n")
    upto = F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(SPELT)))
    starts = whole.where(F.length("word") >= 2).select(F.explode(F.transform(upto, lambda i: F.substring("word", F.lit(1), i))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("begins"))
    hashed = "word string, beginning string, n bigint"
    far = whole.where(F.length("word") > SPELT + 1).mapInArrow(beginnings, hashed).groupBy("beginning").agg(F.sum("n").alias("begins"))
    long = last.where(F.length("word") > SPELT).select("word", F.lit(None).cast("long").alias("n")).mapInArrow(beginnings, hashed).join(far, "beginning").select("word", "begins")
    seen = last.join(single, "word", "left").join(starts.where(F.length("word") <= SPELT).unionByName(long), "word", "left")
    # the answer that is judged is one of those that end so; after open words any number of questions don't speak for it, while
    # for other words ends are all there is to go by, and a stock answer to several questions is an end each time
    n, begins, mark = F.coalesce("n", F.lit(0)), F.coalesce("begins", F.lit(0)), F.coalesce("n_mark", F.lit(0))
    end, given = (F.greatest(F.coalesce(c, F.lit(0)) - 1, F.lit(0)) for c in ("n_end", "n_given"))
    # a fragment ends few answers beside the words that it may be of; a word of its own, as one that is also a beginning, more
    cut = (begins > 0) & (n <= WHOLE * begins) & ((given <= 1) | (given < FRAGMENT * begins))
    known = F.col("word").isin(*sorted(OPEN_WORDS)) & ((n < 20) | (end < 0.05 * n)) & (mark <= LOW_KNOWN * chance * F.greatest(n, F.lit(20)))
    # words that the dictionary lacks: often within sentences, hardly ever at the end of one or of an answer
    learnt = (n >= OFTEN) & (mark < LOW * chance * n) & (given < SELDOM * n)
    told = seen.where(cut | known | learnt).select("word", cut.alias("is_cut"), mark.alias("mark"))
    paired = words.where(F.contains("word", F.lit(" "))).select(F.col("word").alias("both"), F.col("n_mark").alias("pair_mark"))
    broken_ends = (
        lasts.join(told, "word")
        .withColumn("both", F.concat_ws(" ", "before", "word"))
        .join(paired, "both", "left")
        .where(F.col("is_cut") | ~F.coalesce((F.col("pair_mark") >= PAIRED) & (F.col("pair_mark") >= PAIRED_SHARE * F.col("mark")), F.lit(False)))
        .select("word", F.col("before").alias("_before"), F.lit(True).alias("open"))
    )
    broken = F.coalesce("open", F.lit(False)) | F.col("tail").rlike(r"^[-‐‑,;:(–—]$")
    return (
        judged.join(broken_ends, (judged["word"] == broken_ends["word"]) & judged["before"].eqNullSafe(broken_ends["_before"]), "left")
        .withColumn("defect", F.coalesce("defect", F.when(broken, "truncated")))
        .where("defect is not null")
        .select(key, "condition", "defect")
        .distinct()
    )


def p3_found(spark, sf_dir: str) -> DataFrame:
    return pair_defects(spread(read(spark, sf_dir, "packets").select("packet_id", "question", "answers")), train(read(spark, sf_dir, "documents")))


def p3_by_model(spark, sf_dir: str) -> DataFrame:
    """Defects of each model and condition, to be set against its packets."""
    packets = read(spark, sf_dir, "packets")
    found = pair_defects(spread(packets), train(read(spark, sf_dir, "documents")))
    owner = packets.select("packet_id", "model").distinct()
    return found.join(owner, "packet_id").groupBy("model", "condition", "defect").agg(F.countDistinct("packet_id").alias("n_defects"))
