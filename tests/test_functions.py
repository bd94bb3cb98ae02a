import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasra.functions import metrics as M
from glasra.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def plain_edits(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return int(d[-1, -1])


def test_edit_distance_against_the_full_table(spark):
    rnd = random.Random(1)
    rows = [tuple([rnd.choice(["an", "teach", "mór", "tá", ""]) for _ in range(rnd.randint(0, 9))] for _ in range(2)) for _ in range(300)]
    rows += [([f"w{k}" for k in range(700)], [f"w{k}" for k in range(5, 700, 2)]), ([], ["a"]), ([f"w{k}" for k in range(4000)], [f"v{k}" for k in range(300)] + [f"w{k}" for k in range(4000)])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", M.word_edits(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == (300 if len(r.b) == 4300 else plain_edits(r.a, r.b) if r.a else 0)


def test_error_rates(spark):
    rows = [("An Teach, mór!", "an teach mor beag"), ("", "rud"), (None, None), ("a b", None)]
    df = spark.createDataFrame(rows, "ref string, hyp string").withColumn("edits_old", F.lit(1))
    got = [(r.edits, r.n_ref) for r in M.word_errors(df).collect()]
    assert got == [(2, 3), (0, 0), (0, 0), (2, 2)]
    assert [(r.edits, r.n_ref) for r in M.word_errors(df, bounded=True).collect()][0] == (1, 3)
    assert [r.edits for r in M.char_errors(df).collect()] == [plain_edits("an teach mór", "an teach mor beag"), 0, 0, 3]
    e = M.word_errors(df).agg(M.micro_rate(F.col("edits"), F.col("n_ref")).alias("w")).first().w
    assert e == pytest.approx(100 * 4 / 5)
    assert M.word_errors(df.limit(0)).count() == 0


def plain_chrf(c):
    """By the public definition: means of precision and recall over the orders that both sides have, then one F."""
    used = [c[k : k + 3] for k in range(0, 24, 3) if c[k + 1] and c[k + 2]]
    p, r = (sum(x[0] / x[at] for x in used) / len(used) if used else 0 for at in (1, 2))
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def plain_bleu(c):
    if not any(c[0:8:2]) or not c[7]:
        return 0.0
    logs, half = 0.0, 1.0
    for k in range(4):
        if c[2 * k] == 0:
            half *= 2
            logs += np.log(1 / (half * c[2 * k + 1]))
        else:
            logs += np.log(c[2 * k] / c[2 * k + 1])
    return 100 * np.exp(logs / 4) * (np.exp(1 - c[9] / c[8]) if c[8] < c[9] else 1)


def test_chrf_and_bleu(spark):
    def chrf(r, h):
        return spark.createDataFrame([(M.chrf_counts(r, h),)], "c array<bigint>").select(M.chrf_of("c").alias("x")).first().x

    def bleu(r, h):
        return spark.createDataFrame([(M.bleu_counts(r, h),)], "c array<bigint>").select(M.bleu_of("c").alias("x")).first().x

    assert chrf("an teach mór", "an teach mór") == pytest.approx(100)
    assert chrf("abc", "xyz") == 0 and chrf(None, None) == 0 and chrf("", "abc") == 0
    assert M.chrf_counts("ab", "ac")[:6] == [1, 2, 2, 0, 1, 1] and M.chrf_counts("", "ac")[:3] == [0, 0, 0]
    assert M._chrf_words("“dia” (cat) mór, a. . cafe\u0301") == ["“dia”", "(cat", ")", "mór", ",", "a", ".", ".", "cafe\u0301"]
    assert bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(100)
    assert bleu("the cat sat on the mat", "the cat sat on") == pytest.approx(100 * np.exp(1 - 6 / 4))
    # three words in a row, no four: the last order counts half of one
    assert bleu("the cat sat on the mat", "the cat sat upon a mat") == pytest.approx(100 * (4 / 6 * 2 / 5 * 1 / 4 * 1 / (2 * 3)) ** 0.25)
    assert bleu("a b", "c d") == 0 and bleu("a b c d", "") == 0 and bleu("a b c", "a b c") == 0
    assert M.bleu_counts("a, b.", "a b")[9] == 4 and M._bleu_words("&lt;a&gt; &amp; 3.5-4") == ["<", "a", ">", "&", "3.5", "-", "4"]
    rnd = random.Random(4)
    rows = [[" ".join(rnd.choice(["an", "teach", "mór.", "(tá", "“sé”"]) for _ in range(rnd.randint(0, 12))) for _ in range(2)] for _ in range(150)]
    df = spark.createDataFrame(rows, "r string, h string").select(M.chrf_stats("r", "h").alias("c"), M.bleu_stats("r", "h").alias("b"))
    for r in df.select("c", "b", M.chrf_of("c").alias("x"), M.bleu_of("b").alias("y")).collect():
        assert r.x == pytest.approx(plain_chrf(r.c)) and r.y == pytest.approx(plain_bleu(r.b))


def test_composition_is_found_where_it_changes_a_text(spark):
    import unicodedata

    rows = [(c, unicodedata.normalize("NFC", c)) for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)])]
    odd = [r for r in rows if r[0] != r[1]] + [("cafe\u0301", "café"), ("mór", "mór"), (None, None)]
    df = spark.createDataFrame(odd, "a string, b string")
    assert df.where(~T.composed(F.col("a")).eqNullSafe(F.col("b"))).count() == 0
    assert one(spark, T.normalised(F.lit("CAFE\u0301 x\u0323!"))) == "café x" or one(spark, T.normalised(F.lit("CAFE\u0301"))) == "café"


def test_outside_classifiers(spark):
    calls = []

    def model(texts):
        calls.append(len(texts))
        return [("ga" if "tá" in t else "en", 0.5 + len(t) / 1000) for t in texts]

    df = spark.createDataFrame([(1, "tá\n sé"), (2, None), (3, " \t"), (4, "it is")], "i int, t string")
    got = {r.i: tuple(r.c) for r in df.select("i", T.classified(F.col("t"), model).alias("c")).collect()}
    assert got == {1: ("ga", 0.505), 2: ("empty", 1.0), 3: ("empty", 1.0), 4: ("en", 0.505)}
    assert df.limit(0).select(T.classified(F.col("t"), model).alias("c")).count() == 0
    with pytest.raises(Exception, match="labels for"):
        df.select(T.classified(F.col("t"), lambda ts: []).alias("c")).collect()


def test_text_columns(spark):
    assert one(spark, T.normalised(F.lit("  Séan's — ½ Teach_mór!  "))) == "séan s ½ teach_mór"
    assert one(spark, T.n_words(F.lit("  a b\n\tc "))) == 3 and one(spark, T.n_words(F.lit(None).cast("string"))) == 0
    assert one(spark, T.before_special(F.lit("rud <|im_end|> eile\nx"))) == "rud "
    assert one(spark, T.before_any(F.lit("a STOP b END"), ["END", "STOP"])) == "a " and one(spark, T.before_any(F.lit("abc"), ["x", "y"])) == "abc"
    assert one(spark, T.occurrences(F.lit("ababab"), "ab")) == 3
    assert one(spark, T.most_repeated(T.shingles(T.words(F.lit("a b c a b c a b c a b c")), 4))) == 3
    assert one(spark, T.most_repeated(T.shingles(T.words(F.lit("a b")), 4))) == 0
    assert one(spark, T.stem(F.lit("a/b.c/d.e.wav"))) == "d.e"
    assert one(spark, T.nfc(F.lit("á"))) == "á"


def test_unwrapped_answers(spark):
    for s, want in [
        ('The exact words spoken in the audio are: "Dia duit."', "Dia duit."),
        ('The words spoken in the audio are “dia is muire”. If you want more, feel free to ask.', "dia is muire"),
        ("The audio says: dia duit. If you have any other questions, ask!", "dia duit."),
        ("Sure! Here's the transcription: dia duit Let me know.", "dia duit"),
        ("dia duit", "dia duit"),
        ('He said "dia duit" and then more text', "dia duit"),
        ("I'm sorry, the speaker said 'hello'", "I'm sorry, the speaker said 'hello'"),
        ("I'm sorry, I can't make it out. Maybe you could send it again.", "I'm sorry, I can't make it out."),
        ('an "" teach', 'an "" teach'),
        ('"a\nb" rud', "a\nb"),
    ]:
        assert one(spark, T.unwrapped(F.lit(s))) == want


def test_budgets(spark):
    assert one(spark, T.token_budget(F.lit(3))) == 8 and one(spark, T.token_budget(F.lit(8), 1.25, 2, 7)) == 7 and one(spark, T.token_budget(F.lit(30))) == 39


def test_rubric_answers(spark):
    get = lambda r, q="": one(spark, T.rubric_answers(F.lit(r), F.lit(q)))
    assert get("Cén fáth? Chun cuidiú leo = 2 mharc Do dhaoine atá ag fulaingt = 1 mharc Don Afraic = 0") == ["Chun cuidiú leo", "Do dhaoine atá ag fulaingt"]
    assert get("Cé mhéad rannóg a bheidh ann? 6 = 2 mharc") == ["6"]
    assert get("Luaigh rud amháin. 2 mharc + 2 mharc • An fhéile = 2 mharc", "Luaigh rud amháin.") == ["An fhéile"]
    assert get("") == [] and get(None) == []
    assert one(spark, T.budget_of_longest(F.array().cast("array<string>"))) == 8
    assert one(spark, T.dashed(F.lit(None).cast("double"))) == "–" and one(spark, T.dashed(F.lit(1.25), 2)) == "1.25"


def test_batched_ngram_counts_equal_the_plain_ones(spark):
    rnd = random.Random(8)
    texts = [None, "", "a"] + ["".join(rnd.choice("abc áé.,'") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    pairs = [(rnd.choice(texts), rnd.choice(texts)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "r string, h string")
    for r in df.select("r", "h", M.chrf_stats("r", "h").alias("c"), M.bleu_stats("r", "h").alias("b")).collect():
        assert list(r.c) == M.chrf_counts(r.r, r.h) and list(r.b) == M.bleu_counts(r.r, r.h)


def test_outside_tokenizers(spark):
    texts = [None, "", "Tá sé <|endoftext|> go maith", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", T.counted_tokens(F.col("t"), lambda ts: [len(t) for t in ts]).alias("n")).orderBy("i").collect()] == [0, 0, len(texts[2]), 5000]
    from glasra.plans.corpus import TOKENIZER
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    got = df.select("i", T.counted_tokens(F.col("t"), T.word_tokenizer(TOKENIZER)).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, *[len(tok.encode(t, add_special_tokens=False).ids) for t in texts[2:]]]
