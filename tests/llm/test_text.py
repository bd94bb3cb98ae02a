import random

import pytest
from pyspark.sql import functions as F

from glasra.llm import garbled, language, leak, lookalike, pairs


def test_odd_characters():
    for t in ("a​b", "a b", "ｆhada", "difﬁcult", "táinig", "tháіnig", "é і mo", "co͏p", "Carraⅰg", "ar ＢＡＩＬＥ", "x　y"):
        assert lookalike.is_odd(t), t
    for t in (None, "", "Tá sé ‘anseo’ – “maith”… ½ x² Ⓐ 20° №7 €5 3 × 4", "an focal ‘щука’ agus ‘слово’ agus ‘λόγος’", "Ḃí an seanċló ŵyl dŷ Noël"):
        assert not lookalike.is_odd(t), t


def test_forms_are_stable_and_equal_when_alike():
    plain = "Tháinig an t-aire go Carraig"
    for t in ("Tháinig an t-aire go​ Carraig", "Tháinig an ｔ-aire go Carraⅰg", "Тháіnig an t-aire gο Carraig"):
        f = lookalike.one_form(t)
        assert f == plain and lookalike.one_form(f) == f and lookalike.skeleton(t) == lookalike.skeleton(plain)
    assert lookalike.one_form("‘щука’") == "‘щука’" and lookalike.one_form(None) is None and lookalike.one_form("") == ""
    assert lookalike.skeleton("it’s") == lookalike.skeleton("it's")


def test_texts_without_unusual_characters_are_in_form():
    for c in map(chr, range(0x20, 0x2100)):
        if not lookalike.UNUSUAL.search(c):
            assert lookalike.kind(c) in ("", "foreign"), c
    assert lookalike.is_odd("ĳs") and lookalike.one_form("ĳs") == "ijs" and lookalike.one_form("ŉ ǆ ſ") == "ʼn dž s"
    assert not lookalike.is_odd("5 µm") and lookalike.one_form("5 µm\u200b") == "5 µm"


def test_look_alikes_in_latin_words():
    for c, latin in {"ꓲ": "I", "∨": "v", "σ": "o", "⍺": "a", "ꭵ": "i", "Ꮖ": "I", "ѡ": "w", "ᖇ": "R", "ⲟ": "o", "ꓳ": "O", "ס": "o"}.items():
        for t, want in ((f"teagh{c}lach", f"teagh{latin}lach"), (f"{c}rdán", f"{latin}rdán")):
            assert lookalike.is_odd(t) and lookalike.one_form(t) == want and lookalike.skeleton(t) == lookalike.skeleton(want), t
    for t in ("σίγμα agus ωμέγα", "p∨q", "A ∪ B", "ꓲꓐ", "ᐯᖇᑯ", "σ = 5", "гора", "ᏣᎳᎩ", "5 ∘ 3", "ус‌".replace("‌", "") + "лово"):
        assert not lookalike.is_odd(t) and lookalike.one_form(t) == t, t
    assert len(lookalike.SURE) + len(lookalike.NEAR) < 260


def test_odd_texts_frame(spark):
    df = spark.createDataFrame([(1, "a​", "b", 1), (1, "a​", "b", 1), (2, None, "ｂ", 2), (3, "a", None, 3)], "row_id long, ref string, hyp string, side int")
    assert sorted(map(tuple, lookalike.odd_texts(df).collect())) == [(1, "ref"), (2, "hyp")]
    assert lookalike.odd_texts(df.limit(0)).count() == 0
    g = {r.skeleton: (r.n_texts, r.n_forms) for r in lookalike.skeleton_groups(df).collect()}
    assert g["b"] == (3, 2) and g["a"] == (3, 2)
    assert lookalike.forms(df).count() == 4


@pytest.fixture(scope="module")
def garbled_docs(spark):
    words = ["Tháinig", "fáil", "féile", "bóthar", "scéim", "údarás", "“Níl", "fhéile”", "súil", "Cé"]
    rnd = random.Random(2)
    clean = [(k, " ".join(rnd.choice(words) for _ in range(30)) + " an bhfuil? ‘Île’ à la … Øystein") for k in range(200)]
    broken = []
    for k, (a, b) in enumerate([("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("utf-8", "latin-1")]):
        t = "Tháinig an fhéile” go dtí an bóthar fáil scéim"
        raw = garbled.to_bytes(t, a) if a == "utf-8" else garbled.to_bytes(t.replace("”", ""), a)
        broken.append((1000 + k, garbled.from_bytes(raw, b)))
    broken += [(2000, "Th?inig an f?ile f?il"), (2001, "Th�inig an f�ile"), (2002, "an scéim agus â€œNÃ\xadl"), (2003, "dãºn agus fã©ile")]
    odd = [(3000, None), (3001, ""), (3002, "?"), (3003, "an bhfuil? ann?Tá"), (3004, "SÃO ÂGE Ãtla")]
    return spark.createDataFrame(clean + broken + odd + broken, "doc_id long, text string")


def test_garbled_documents_are_found(garbled_docs):
    got = {r.doc_id for r in garbled.garbled_documents(garbled_docs).collect()}
    assert got == {1000, 1001, 1002, 1003, 1004, 2000, 2001, 2002, 2003}


def test_garbled_documents_by_shuffle(garbled_docs, monkeypatch):
    monkeypatch.setattr(garbled, "BROADCAST_ROWS", 0)
    got = {r.doc_id for r in garbled.garbled_documents(garbled_docs).collect()}
    assert got == {1000, 1001, 1002, 1003, 1004, 2000, 2001, 2002, 2003}


def test_token_counts_are_those_of_distinct_texts(spark, monkeypatch):
    from collections import Counter

    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["tá", "fáil", "an", "é?", "Ã©"]) for _ in range(rnd.randint(0, 9))) for _ in range(120)] + [None]
    rows = [rnd.choice(texts[:40]) if rnd.random() < 0.5 else rnd.choice(texts) for _ in range(900)]
    want = Counter(w for t in set(rows) for w in garbled.odd_tokens(t))
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(5)
    for limit in (garbled.REPEATED_KEYS, 0):
        monkeypatch.setattr(garbled, "REPEATED_KEYS", limit)
        assert {r.token: r.n for r in garbled._token_counts(df, "text").collect()} == want


@pytest.mark.parametrize("limit", [garbled.BROADCAST_ROWS, 0])
def test_restored_text(garbled_docs, monkeypatch, limit):
    monkeypatch.setattr(garbled, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(garbled, "KNOWN_TOKENS", limit * 10)
    assert garbled.restored(garbled_docs).count() == 9
    got = {r.doc_id: r for r in garbled.restored(garbled_docs).collect()}
    for k in (1000, 1001, 1004):
        assert got[k].text == "Tháinig an fhéile” go dtí an bóthar fáil scéim" and got[k].complete
    assert got[1002].text == "Tháinig an fhéile go dtí an bóthar fáil scéim"
    assert got[2000].text == "Tháinig an féile fáil"
    assert garbled.restored(garbled_docs.limit(0)).count() == 0


def test_garbled_source_of_a_third_and_repeated_texts(spark):
    rnd = random.Random(3)
    words = ["tá", "fáil", "féile", "bóthar", "scéim", "údarás"]
    texts = [" ".join(rnd.choice(words) for _ in range(20)) + f" a{k}" for k in range(60)]
    wrong = [garbled.from_bytes(t.encode(), "cp1252") for t in texts[:20]] + [t.translate({ord(c): "�" for c in "áéóú"}) for t in texts[20:25]]
    df = spark.createDataFrame(list(enumerate(texts[25:] + wrong)), "doc_id long, text string")
    assert {r.doc_id for r in garbled.garbled_documents(df).collect()} == set(range(35, 60))
    assert {r.text for r in garbled.restored(df).where("doc_id < 55").collect()} == set(texts[:20])
    once = "Tháinig fhéile bóthar fáil scéim"
    hot = garbled.from_bytes(garbled.to_bytes(once, "cp1252"), "mac_roman")  # one character for one: the rarity test holds
    rows = [f"{once} {k}" for k in range(40)] + [hot] * 30 + ["cé", "sé??", "sé"]
    got = garbled.garbled_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(40, 70))


def test_long_words_are_restored(spark, monkeypatch):
    for size in (90, 99, 100, 101, 400):
        word = ("tógálaí" * size)[: size - 1] + "á"
        bare = "щ" * size
        wrong = [garbled.from_bytes(w.encode(), "cp1252") for w in (word, bare)]
        lost = word.replace("ó", "�").replace("á", "�").replace("í", "�")
        df = spark.createDataFrame([(k, f"{word} an {bare} {k}") for k in range(10)] + [(20, f"is é {wrong[0]} é"), (21, f"is é {wrong[1]} é"), (22, f"is é {lost} é")], "doc_id long, text string")
        got = {r.doc_id: r.text for r in garbled.restored(df).collect()}
        assert got == {20: f"is é {word} é", 21: f"is é {bare} é", 22: f"is é {word} é"}


def test_chains_invert():
    for t in ("Tháinig “sí” €5", "dèidh ŵyl"):
        for chain in ("utf-8 as cp1252", "utf-8 as cp1252 > utf-8 as cp1252"):
            s = t
            for step in chain.split(" > "):
                a, b = step.split(" as ")
                s = garbled.from_bytes(garbled.to_bytes(s, a), b)
            assert garbled.invert(s, chain) == t


ITEM = "Leave the gull with Nealla till the lamp turns as straight as the kitchen hurriedly and the key tramples another one"


def passage(words, edits=()):
    out = []
    for i, w in enumerate(words):
        for k, how in edits:
            if k == i and how == "change":
                w = "changed"
            if k == i and how == "drop":
                w = None
            if k == i and how == "add":
                w = w + " added"
        if w:
            out.append(w)
    return " ".join(out)


def test_leaks_and_near_leaks(spark):
    ws = ITEM.split()
    shuffled = ws[:]
    random.Random(3).shuffle(shuffled)
    cases = {
        1: passage(ws[:12]),
        2: passage(ws[3:18], [(5, "change"), (10, "drop")]),
        3: passage(ws[2:14], [(5, "add")]).upper().replace(" ", "\n "),
        4: passage(ws),
        5: "Léave, thé gull -- with Nealla; till the lámp turns as straight as",
    }
    no = {10: passage(ws[:11]), 11: passage(shuffled), 12: passage(ws[:14], [(3, "change"), (6, "change"), (9, "change")]), 13: None, 14: ""}
    filler = "agus bhí an ceol go maith ar fad ansin "
    rows = [(k, None if t is None else f"{filler}{t}. {filler}" if t else t) for k, t in (cases | no).items()]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "one two three"), (9, None)], "item_id long, text string")
    assert sorted(map(tuple, leak.leaked(docs, items).collect())) == [(k, 7) for k in sorted(cases)]
    assert leak.leaked(docs, items.limit(0)).count() == 0 and leak.leaked(docs.limit(0), items).count() == 0
    assert {r.doc_id for r in leak.removal_spans(docs, items).collect()} == set(cases)


def test_items_in_parts_give_the_same(spark, monkeypatch):
    ws = ITEM.split()
    other = passage(ws, [(4, "change"), (15, "change")])
    rows = [(1, ITEM), (2, passage(ws[:14], [(6, "drop")])), (3, other), (3, other), (None, ITEM), (None, other), (5, f"{ITEM} agus {other} " * 40), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, other), (9, ITEM.upper()), (10, passage(ws, [(9, "add")])), (None, other), (11, "short"), (12, None)], "item_id long, text string")
    whole = sorted(map(str, leak.leaks(docs, items).collect()))
    assert len(whole) > 20 and any("closest=False" in r for r in whole)
    monkeypatch.setattr(leak, "HELD_PLACES", 10)
    assert sorted(map(str, leak.leaks(docs, items).collect())) == whole
    for chars in (50, 300):
        monkeypatch.setattr(leak, "ITEM_CHARS", chars)
        assert sorted(map(str, leak.leaks(docs, items).collect())) == whole
        assert leak.leaks(docs.limit(0), items).count() == 0


def test_index_finds_every_phrase():
    import numpy as np

    rnd = random.Random(4)
    runs = [[rnd.randint(1, 6) for _ in range(rnd.randint(4, 40))] for _ in range(60)]
    text = np.array([x for r in runs for x in [*r, 0]], np.int64)
    index = leak.FMIndex(text, 6)
    phrases = np.array([[rnd.randint(1, 6) for _ in range(4)] for _ in range(200)], np.int64)
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_identical_items_both_leak(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM)], "item_id long, text string")
    assert sorted(map(tuple, leak.leaked(docs, items).collect())) == [(1, 7), (1, 8)]


TEXTS = {
    "ga": "Tá an múinteoir ag súil go mbeidh an fhéile réidh i mí na Bealtaine agus ní raibh na daltaí sásta leis sin",
    "en": "The teacher hopes that the yearly festival will be ready in May and the pupils were not happy about that at all",
    "gd": "Tha an tidsear an dòchas gum bi an fhèis deiseil anns a' Chèitean agus cha robh na sgoilearan toilichte mu dheidhinn",
    "cy": "Mae'r athro yn gobeithio y bydd yr ŵyl yn barod ym mis Mai ac nid oedd y plant yn fodlon arno o gwbl",
    "fr": "Le professeur espère que la fête sera prête au mois de mai mais les élèves ne sont pas du tout contents de cela",
}


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(6)
    rows = []
    for lang, t in TEXTS.items():
        ws = t.split()
        rows += [(len(rows) + k, " ".join(rnd.sample(ws, len(ws))), lang) for k in range(30)]
    rows += [(9000, TEXTS["en"], "ga"), (9001, None, "ga"), (9002, "", "en"), (9003, TEXTS["ga"], None)]
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages(spark, model):
    rows = [
        ("t", 1, "ga", TEXTS["ga"]),
        ("t", 2, "GLE", TEXTS["ga"]),
        ("t", 3, "en", TEXTS["ga"]),
        ("t", 4, None, TEXTS["cy"]),
        ("t", 5, "und", TEXTS["fr"]),
        ("t", 6, "ga", TEXTS["ga"] + ". " + TEXTS["en"]),
        ("t", 7, None, None),
        ("t", 8, "", " … 123 <|endoftext|>"),
        ("t", 9, "ga-IE", TEXTS["ga"] + " ‘open mic’ " + TEXTS["ga"]),
        ("t", 4, None, TEXTS["cy"]),
    ]
    df = spark.createDataFrame(rows, "tab string, row_id long, label string, text string")
    got = sorted(map(tuple, language.detect(df, model).collect()))
    assert got == [("t", 3, "ga"), ("t", 4, "cy"), ("t", 5, "fr"), ("t", 6, "en"), ("t", 6, "ga")]
    s = [r for r in language.detect(df, model, "stretches").collect() if r.row_id == 6]
    assert [r.lang for r in sorted(s, key=lambda r: r.first_word)] == ["ga", "en"] and all(r.confidence > 0.9 for r in s)
    assert {r.row_id for r in language.detect(df, model, "texts").collect()} == {1, 2, 3, 4, 5, 6, 9}


def test_models_are_kept(model, tmp_path, monkeypatch):
    path = f"{tmp_path}/models/m.npz"
    language.save(model, path)
    again = language.load(path)
    assert again.digest() == model.digest() and again.pieces == model.pieces
    assert (again.scores(["fhéile", "teacher"]) == model.scores(["fhéile", "teacher"])).all()
    monkeypatch.setattr(language, "LANGS", ("ga", "en"))
    with pytest.raises(ValueError):
        language.load(path)


def test_forward_sums_all_segmentations(model):
    import numpy as np

    word = "fhéile"
    s = "▁" + word

    def rest(i):
        if i == len(s):
            return np.ones(5)
        total = np.zeros(5)
        for j in range(i + 1, len(s) + 1):
            k = model.pieces.get(s[i:j])
            if k is not None:
                total = total + model.table[k] * rest(j)
            elif j == i + 1:
                total = total + model.table[-1] * rest(j)
        return total

    got = model.scores([word])[0]
    want = np.log(rest(0))
    assert np.allclose(got, np.maximum(want, want.max() - language.CLIP))


def test_pair_defects(spark, model):
    q = "Cén fáth ar thacaigh an múinteoir leis an fhéile in Baile Mór?"
    sound = ["Thacaigh sé leis an fhéile mar tá na daltaí sásta.", "Seacht", "Níl a fhios ag an gcomhairle fós", "Dé Luain", "Ó Briain", "i mí na Bealtaine"]
    cases = {
        "empty": [None, "", " ​ ", "—…", "<|endoftext|>", '""'],
        "refusal": ["Ní féidir liom an cheist sin a fhreagairt.", "I’m sorry, but I can’t answer that question", "As an assistant, I must decline to answer."],
        "copied": [q, q.upper(), "Ceist: " + q + " Freagra:", q + " " + q, q.replace("é", "e").replace("á", "a")],
        "other_language": ["The teacher hopes that the yearly festival will be ready in May."],
        "truncated": ["Thacaigh sé leis an", "Thacaigh sé leis mar tá na dal", "Thacaigh sé leis an fhé-", "Bhí na daltaí sásta agus…"],
    }
    rows = [(0, q, s, s) for s in sound] + [(0, q, s + ".", s + ".") for s in sound]
    want = set()
    for d, answers in cases.items():
        for a in answers:
            rows.append((0, q, a, sound[0]))
            want.add((len(rows), "just_audio", d))
    rows = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, q_, (a, b, ""), "x") for i, q_, a, b in rows], "packet_id long, question string, answers struct<just_audio:string,no_context:string,just_transcript:string>, defect string")
    got = set(map(tuple, pairs.pair_defects(df.unionByName(df), model).collect()))
    assert got == want
    assert pairs.pair_defects(df.limit(0), model).count() == 0


def test_truncated_answers_that_are_held_by_many(spark, model):
    q = "Cén fáth ar thacaigh an múinteoir leis an fhéile in Baile Mór?"
    sound = [f"Thacaigh an múinteoir agus na daltaí leis an fhéile {k}." for k in range(60)]
    answers = [*sound, *["Thacaigh sé leis mar tá na dal"] * 30, *["Thacaigh sé leis an fhéile agus"] * 30, *["Ní raibh aon duine in ann an doras a oscailt"] * 50, *["Baile Mór agus na daltaí"] * 300]
    df = spark.createDataFrame([(i, q if a.endswith("dal") else f"{q} An bhfuil an doras oscailte {i}?", (a, "Seacht")) for i, a in enumerate(answers)], "packet_id long, question string, answers struct<just_audio:string,no_context:string>")
    got = set(map(tuple, pairs.pair_defects(df, model).collect()))
    assert got == {(i, "just_audio", "truncated") for i in range(60, 120)}


def test_refusals_are_of_the_answerer():
    for t in ("I cannot answer that.", "“I cannot answer that.”", "Ní féidir liom é a rá", "Chan eil fhios agam", "He said: yes. But I can't answer that", "It's that I don't know"):
        assert pairs.is_refusal(t), t
    for t in ("Chan eil fhios aig an tidsear", "The teacher said “I do not know” and left", 'Dúirt an múinteoir "ní féidir liom" leis', "The mayor said: I cannot answer that", "He says ‘I don’t know’ each time", "An fhéile"):
        assert not pairs.is_refusal(t), t


def test_copies_of_questions_of_any_length():
    for q in ("Cé?", "Cén lá?", "Cén fáth a bhfuil sé?", "Cén fáth ar thacaigh an múinteoir leis an fhéile in Baile Mór?" * 3):
        for a in (q, q.upper(), q + " " + q, "Freagra: " + q, q.replace("é", "e")):
            assert pairs.is_copied(q, a), (q, a)
        assert not pairs.is_copied(q, "Seacht") and not pairs.is_copied(q, q + " Bhí na daltaí sásta leis an bhfreagra sin go léir") and not pairs.is_copied(None, q)


def test_ends_of_answers_of_any_length():
    pad = "focal " * 300
    for t, want in {"Thacaigh sé leis an": ("an", "", "leis"), "sé leis an fhé-": ("fhé", "-", "an"), "tá an t’athair": ("t’athair", "", "an"), "Bhí agus…": ("agus", "…", "bhí"), "a b... ”": ("b", "…", "a"), "deireadh.": None, "deireadh!”": None, "a_": None, "…": None, "": None}.items():
        assert pairs.last_word(t) == want, t
        if want and want[2]:
            assert pairs.last_word(pad + t) == want
    for n in (10, 399, 400, 5000):
        assert pairs.last_word("x" * n) is None and pairs.last_word("a " + "x" * n) == ("x" * n, "", "a")


def test_long_words_have_beginnings(spark, model):
    for size in (58, 62, 300):
        word = "".join(random.Random(size).choice("aeiouctdls") for _ in range(size))
        rows = [(k, "Cad é an focal fada atá anseo againn?", (f"Is é {word} an focal fada {k}. Seo é {word}.", "Seacht")) for k in range(1200)]
        rows += [(5000, "Cad é an focal fada atá anseo againn?", (f"Is é {word[:-2]}", f"Is é {word}")), (5001, "Cad é?", (f"Is é {word[:-2]}x", "Seacht"))]
        df = spark.createDataFrame(rows, "packet_id long, question string, answers struct<just_audio:string,no_context:string>")
        assert set(map(tuple, pairs.pair_defects(df, model).collect())) == {(5000, "just_audio", "truncated")}


def test_workers_keep_models_apart(spark, model):
    rows = [(k, f"{TEXTS[lang]} {k}", lang) for k, lang in enumerate(["ga", "en"] * 60)]
    swapped = language.train(spark.createDataFrame([(k, t, {"ga": "en", "en": "ga"}[lang]) for k, t, lang in rows], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([("t", k, None, TEXTS[lang]) for k, lang in enumerate(["ga", "en"] * 10)], "tab string, row_id long, label string, text string")
    for _ in range(3):
        assert {(r.row_id % 2, r.lang) for r in language.detect(df, model).collect()} == {(0, "ga"), (1, "en")}
        assert {(r.row_id % 2, r.lang) for r in language.detect(df, swapped).collect()} == {(0, "en"), (1, "ga")}
    assert model.digest() != swapped.digest()


def test_very_long_texts(spark, model):
    import time

    began = time.time()
    long = [" ".join(["focal"] * 60000), "x" * 200000, "." * 100000 + "x", "a" + " " * 100000 + "b", "á" * 100000, "-\n" * 50000, "?" * 50000, "<|" * 50000, "E\u0301" * 20000]
    df = spark.createDataFrame([(k, t, t, "t", None) for k, t in enumerate(long)], "row_id long, ref string, hyp string, tab string, label string")
    assert lookalike.odd_texts(df).count() == 2
    assert language.detect(df.withColumn("text", F.col("hyp")), model).count() >= 0
    assert garbled.garbled_documents(df.withColumn("doc_id", F.col("row_id")).withColumn("text", F.col("ref"))).count() == 0
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leak.leaked(df.withColumn("doc_id", F.col("row_id")).withColumn("text", F.col("ref")), items).count() == 0
    p = df.select(F.col("row_id").alias("packet_id"), F.lit("Cad é an focal seo?").alias("question"), F.struct(F.col("ref").alias("just_audio"), F.col("hyp").alias("no_context")).alias("answers"))
    assert pairs.pair_defects(p, model).count() >= 2
    assert time.time() - began < 120


def test_null_keys_and_ids(spark):
    docs = spark.createDataFrame([(None, ITEM), (None, None), (4, "scéim Ã©")], "doc_id long, text string")
    items = spark.createDataFrame([(None, ITEM)], "item_id string, text string")
    assert [tuple(r) for r in leak.leaked(docs, items).collect()] == [(None, None)]
    assert garbled.garbled_documents(docs).count() <= 1
