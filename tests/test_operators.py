import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glasra.operators import gates as G
from glasra.operators import review as R
from glasra.operators import sampling as S
from glasra.operators import sequences as Q
from glasra.operators import vectors as V


def test_running_totals_against_pandas(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.choice([None, 1, 5, 9])) for k in rnd.sample(range(50000), 900)]
    df = spark.createDataFrame(rows, "g string, o long, v int")
    got = {(r.g, r.o): r.t for r in S.running_total(df, ["g"], "o", F.col("v"), "t").collect()}
    sums = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        assert got[g, o] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    assert S.running_total(df.limit(0), ["g"], "o", F.col("v"), "t").count() == 0


def test_budget_includes_the_crossing_row(spark):
    df = spark.createDataFrame([("a", k, 3) for k in range(10)], "g string, o long, v int")
    assert sorted(r.o for r in S.budget_prefix(df, ["g"], "o", F.col("v"), F.lit(7)).collect()) == [0, 1, 2]


def test_schedule_is_exact(spark):
    s = S.schedule(spark.range(999).withColumnRenamed("id", "step"), "step", 0.25, "5")
    assert s.where("picked").count() == 250 and s.count() == 999


def test_quota_and_hold_out(spark):
    import hashlib

    df = spark.createDataFrame([(y, f"q{k}") for k in range(300) for y in ["1", "2", "3"]][:-250], "y string, k string")
    got = S.even_quota(df, "y", "k", 10, "s").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {"1": 4, "2": 3, "3": 3}
    keys = [f"p/{k}.wav" for k in range(3000)]
    out = spark.createDataFrame([(k,) for k in keys], "k string").where(S.held_out(F.col("k"))).collect()
    assert {r.k for r in out} == {k for k in keys if int(hashlib.md5(k.encode()).hexdigest(), 16) % 40 == 0}


def test_one_of_each(spark):
    rows = [("a", [1, 2]), ("a", [1, 2]), ("b", []), ("c", None), (None, [3]), (None, [3]), (None, [4]), ("d", [5])]
    df = spark.createDataFrame(rows, "key string, units array<int>").repartition(3)
    for limit in (None, 0):
        assert sorted(map(str, Q.one_of_each(df, ["key", "units"], limit).collect())) == sorted({f"Row(key={k!r}, units={u!r})" for k, u in rows})
        assert sorted(str(r.key) for r in Q.one_of_each(df, ["key"], limit).collect()) == ["None", "a", "b", "c", "d"]
        assert Q.one_of_each(df.limit(0), ["key"], limit).count() == 0
        assert Q.one_of_each(df.where("key = 'd'"), ["key"], limit).count() == 1


def test_sequences(spark):
    df = spark.createDataFrame([("a", [1, 1, 2, 2, 2, 1, None, None, 3]), ("b", []), ("c", None), ("d", list(range(10)))], "key string, units array<int>")
    got = {r.key: r.u for r in df.select("key", Q.deduped(F.col("units")).alias("u")).collect()}
    assert got == {"a": [1, 2, 1, None, 3], "b": [], "c": None, "d": list(range(10))}
    chunks = Q.chunks(df, "units", 4, ["key"])
    assert [(r.chunk, r.part) for r in chunks.where("key = 'd'").orderBy("chunk").collect()] == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]
    assert {r.key: r["items"] for r in Q.reassembled(chunks, "key").collect()}["d"] == list(range(10))
    assert Q.chunks(df, "units", 0, ["key"]).count() == 2
    n = spark.createDataFrame([("x", 3000), ("y", 10), ("z", 0), ("w", 2999)], "key string, n int")
    w = {(r.key, r.window): (r.start, r.stop) for r in Q.sliding(n, "n", 1500, 1450, ["key"]).collect()}
    assert w == {("x", 0): (0, 1500), ("x", 1): (1450, 2950), ("x", 2): (2900, 3000), ("y", 0): (0, 10), ("w", 0): (0, 1500), ("w", 1): (1450, 2950), ("w", 2): (2900, 2999)}
    parts = spark.createDataFrame([([0, 1, 2, 0, 0, 3],), ([5],), ([0],), ([],)], "u array<int>").select(Q.split_on(F.col("u"), 0).alias("p")).collect()
    assert [r.p for r in parts] == [[[1, 2], [3]], [[5]], [], []]
    assert df.select(Q.in_range(F.col("units"), 10).alias("ok")).where("ok").count() == 4
    assert spark.range(1).select(Q.first_of(F.array(*map(F.lit, [4, 5, 6])), [6, 5]).alias("x")).first().x == [4]
    assert spark.range(1).select(Q.speech_span(F.array(F.lit(1), F.lit(2))).alias("x")).first().x == [152936, 151937, 151938, 152937]


def test_packing_against_plain(spark):
    rnd = random.Random(3)
    docs = {k: [rnd.randint(0, 99) for _ in range(rnd.choice([0, 1, 5, 37, 300]))] for k in rnd.sample(range(20000), 200)}
    df = spark.createDataFrame(list(docs.items()), "id long, t array<int>")
    flat = [x for k in sorted(docs) for x in docs[k]]
    want = {i: flat[i * 64 : (i + 1) * 64] for i in range(len(flat) // 64)}
    assert {r.window: r.tokens for r in Q.packed(df, "t", "id", 64).collect()} == want


def test_next_fit_against_plain(spark):
    rnd = random.Random(4)
    rows = [(g, f"f{k:03d}", rnd.choice([None, 5.0, 40.0, 70.0, 90.0, 120.0])) for k in range(120) for g in ("a", "b")]
    df = spark.createDataFrame(rows, "g string, f string, s double")
    got = {(r.g, r.f): r.shard for r in Q.next_fit(df, "s", 100.0, "f", "g").collect()}
    for g in ("a", "b"):
        shard, used, some = 0, 0.0, False
        for _, f, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] or 0), r[1])):
            if some and used + (s or 0) > 100:
                shard, used = shard + 1, 0.0
            used, some = used + (s or 0), True
            assert got[g, f] == shard


def test_padding(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [3]), (2, [4])], "b int, u array<int>")
    assert sorted((r.u, r.mask) for r in Q.padded(df, "u", "b").collect()) == [([1, 2], [1, 1]), ([3, -100], [1, 0]), ([4], [1])]


def test_turns_keep_their_places_when_a_service_fails(spark):
    def flaky(xs):
        return [x.upper() for x in xs] if len(xs) < 3 else xs[:-1]

    df = spark.createDataFrame([(1, ["a", " ", "b\nc"]), (2, None), (3, ["d", "e", "f", "g"])], "id int, turns array<string>")
    got = {r.id: r.turns for r in Q.restored_turns(df, "id", "turns", flaky).collect()}
    assert got == {1: ["A", "", "B C"], 2: [], 3: ["D", "E", "F", "G"]}


def test_failing_services(spark):
    tries = []

    def late(xs):
        tries.append(1)
        if len(tries) % 3:
            raise ConnectionError("down")
        return xs

    df = spark.createDataFrame([(1, ["a", "b"])], "id int, turns array<string>")
    assert Q.restored_turns(df, "id", "turns", late, wait=0.01).first().turns == ["a", "b"]
    with pytest.raises(Exception, match="down"):
        Q.restored_turns(df, "id", "turns", late, tries=2, wait=0.01).collect()
    with pytest.raises(Exception, match="answers for one turn"):
        Q.restored_turns(df, "id", "turns", lambda xs: []).collect()


def test_best_rows_and_ties(spark):
    rows = [("c", 1, 0.5, 2), ("c", 1, 0.5, 1), ("c", 1, None, 0), ("d", 1, None, 5)]
    df = spark.createDataFrame(rows, "cond string, q int, s double, o int")
    assert sorted((r.cond, r.o) for r in R.best_row(df, ["cond", "q"], F.col("s"), ["o"]).collect()) == [("c", 1), ("d", 5)]


def test_markdown(spark):
    assert R.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 | – |"
    with pytest.raises(ValueError):
        R.markdown(spark.range(5), limit=3)


@pytest.mark.parametrize("block", [7, 2048])
def test_alignment_against_plain(spark, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 8)), rng.normal(size=(20, 8))
    b[:12] = a[:12] + 0.1 * b[:12]
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    df = spark.createDataFrame(pd.DataFrame({"m": "x", "i": range(20), "a": a.tolist(), "b": b.tolist()}), "m string, i long, a array<double>, b array<double>")
    for r in V.alignment(df, ["m"], "a", "b").collect():
        row, col = np.delete(s[r.i], r.i), np.delete(s[:, r.i], r.i)
        assert r.row_rank == 1 + (row > s[r.i, r.i]).sum() and r.col_rank == 1 + (col > s[r.i, r.i]).sum()
        assert r.strict == (s[r.i, r.i] > max(row.max(), col.max()))


def test_alignment_examples(spark):
    eye = np.eye(30)
    df = lambda b: spark.createDataFrame(pd.DataFrame({"m": "x", "i": range(30), "a": eye.tolist(), "b": b.tolist()}), "m string, i long, a array<double>, b array<double>")
    score = lambda b: V.alignment(df(b), ["m"], "a", "b").where("strict").count() / 30
    assert score(eye) == 1.0 and score(np.ones((30, 30))) == 0.0


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert G.duplicates(df, ["k"]).count() == 1
    with pytest.raises(G.GateError):
        G.enforce(G.duplicates(df, ["k"]), "keys")
    with pytest.raises(G.GateError):
        G.exact_columns(df, ["v", "k"])
    with pytest.raises(G.GateError):
        G.non_empty(df.limit(0), "none")
    with pytest.raises(G.GateError):
        G.row_count(df, 4, "rows")
    other = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, G.id_differences(df, other, "k").collect())) == [(1, "missing"), (3, "extra")]
    assert [r.k for r in G.without_partner(df, other, ["k"]).distinct().collect()].count(1) == 2
    packets = spark.createDataFrame([("q1", 2), ("q2", 1)], "question_id string, marks_available int")
    v = spark.createDataFrame([("q1", "x", 3, "r"), ("q2", "x", 1, " "), ("q3", "x", 0, "r"), ("q1", "y", None, "r")], "question_id string, condition string, marks int, reason string")
    got = {(r.question_id, r.condition): r.problem for r in G.verdict_violations(v, packets, ["x", "y"]).collect()}
    assert got == {("q1", "x"): "marks out of range", ("q2", "x"): "no reason", ("q3", "x"): "unknown", ("q1", "y"): "no marks", ("q2", "y"): "missing"}
    open_marks = spark.createDataFrame([("q1", None)], "question_id string, marks_available int")
    ok = spark.createDataFrame([("q1", "x", 9, "r")], "question_id string, condition string, marks int, reason string")
    assert G.verdict_violations(ok, open_marks, ["x"]).count() == 0
    G.at_least(df, 3, "rows")
    with pytest.raises(G.GateError):
        G.at_least(df, 4, "rows")
    assert G.some_of(df, F.col("k") == 1, "ones").count() == 2
    with pytest.raises(G.GateError):
        G.some_of(df, F.col("k") == 9, "nines")
    assert [tuple(r) for r in G.too_long(df, ["v"], [F.col("k"), F.lit(1)], 2).collect()] == [("c", 3)]
    assert [r.k for r in G.in_both(df, other, ["k"]).collect()] == [2]


def test_verdicts_joined_to_answers(spark):
    rows = spark.createDataFrame([("m", "q1", "x", "tá"), ("m", "q1", "y", " "), ("m", "q2", "x", None), ("m", "q3", "x", "rud"), (None, "q1", "x", "a")], "model string, question_id string, condition string, answer string")
    told = spark.createDataFrame([("m", "q1", "x", 2, None), ("m", "q9", "x", 1, "r")], "model string, question_id string, condition string, marks int, reason string")
    got = {(r.model, r.question_id, r.condition): (r.marks, r.reason) for r in R.judged(rows, told).collect()}
    assert got == {("m", "q1", "x"): (2, ""), ("m", "q1", "y"): (0, "no answer given"), ("m", "q2", "x"): (0, "no answer given"), ("m", "q3", "x"): (None, None), (None, "q1", "x"): (None, None)}


def test_best_layer_leaves_out_what_is_no_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0, nan), ("a", 1, 0.2), ("a", 2, 0.5), ("a", 3, 0.5), ("b", 4, nan), ("b", 5, None), ("c", 3, -1.0)], "k string, layer int, s double")
    assert {tuple(r) for r in R.best_over(df, ["k"], "layer", "s").collect()} == {("a", 0.5, 2), ("b", 0.0, 0), ("c", 0.0, 0)}


def test_chart_documents(spark):
    import json

    d = json.loads(R.chart(spark.createDataFrame([("ga", "asr", 1.5), ("en", "asr", None)], "lang string, task string, v double"), "rect", "task", "lang", "v"))
    assert d["mark"] == "rect" and d["encoding"]["color"]["field"] == "v" and len(d["data"]["values"]) == 2
    with pytest.raises(ValueError):
        R.chart(spark.range(9), "bar", "id", "id", limit=3)


def test_first_rows_medians_and_what_comes_before(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40), rnd.choice([None, *[float(k) for k in range(9)]])) for _ in range(3000)] + [("one", 1, 2.5)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(7)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = {}
    for r in S.first_rows(df.select("g", "o"), ["g"], ["o"], 3, parts=5).collect():
        got.setdefault(r.g, []).append((r.o, r.is_first))
    for g, rs in by.items():
        os = sorted(r[1] for r in rs)
        assert sorted(got[g]) == sorted([(o, True) for o in os[:3]] + [(o, False) for o in os[3:]])
    medians = {r.g: r.median for r in S.exact_median(df, ["g"], "v").collect()}
    assert medians == {g: float(np.median([r[2] for r in rs if r[2] is not None])) for g, rs in by.items()}
    skew = spark.createDataFrame([(float(k) ** 3,) for k in range(1001)] + [(1e12,)] * 200, "v double").withColumn("g", F.lit(1))
    assert S.exact_median(skew, ["g"], "v").first().median == float(np.median([float(k) ** 3 for k in range(1001)] + [1e12] * 200))
    assert S.exact_median(df.limit(0), ["g"], "v").count() == 0 and S.first_rows(df.select("g", "o").limit(0), ["g"], ["o"], 3).count() == 0
    seq = spark.createDataFrame([(k % 3, k, None if k % 11 == 0 else k // 7) for k in range(500)], "g int, o int, v int").repartition(5)
    S.BLOCK, held = 16, S.BLOCK
    try:
        back = {(r.g, r.o): r.b for r in S.previous(seq, ["g"], F.struct("g", "o"), "v", "b").collect()}
    finally:
        S.BLOCK = held
    for k in range(500):
        assert (back[k % 3, k] is None) == (k < 3) and (k < 3 or back[k % 3, k].value == (None if (k - 3) % 11 == 0 else (k - 3) // 7))


def test_running_totals_over_hashes_have_few_blocks(spark):
    df = spark.range(20000).select(F.lit("x").alias("g"), F.xxhash64("id").alias("o"), F.lit(1).alias("v"))
    width = S.block_width(df, "o")
    assert df.select(F.floor(F.col("o") / width)).distinct().count() <= 8
    assert S.running_total(df, ["g"], "o", F.col("v"), "t").agg(F.max("t")).first()[0] == 19999


def test_vectors_without_direction(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(12, 4)), rng.normal(size=(12, 4))
    b[:] = a
    rows = [(1, k, a[k].tolist(), b[k].tolist()) for k in range(12)]
    rows[3] = (1, 3, [0.0] * 4, b[3].tolist())
    rows[5] = (1, 5, a[5].tolist(), [float("nan"), 1.0, 1.0, 1.0])
    rows[7] = (1, 7, None, b[7].tolist())
    df = spark.createDataFrame(rows, "m int, i long, a array<double>, b array<double>")
    got = {r.i: (r.row_rank, r.col_rank, r.strict, r.missing) for r in V.alignment(df, ["m"], "a", "b").collect()}
    assert got == {k: (12, 12, False, True) if k in (3, 5, 7) else (1, 1, True, False) for k in range(12)}
    assert {(r.i, r.problem) for r in V.violations(df, ["i"], "a").collect()} == {(3, "zero"), (7, "missing")}
    assert {(r.i, r.problem) for r in V.violations(df, ["i"], "b").collect()} == {(5, "not finite")}
    with pytest.raises(G.GateError):
        G.enforce(V.violations(df, ["i"], "a"), "vectors")
    left, right = df.select("i", F.col("b").alias("v")).where("i < 11"), df.select("i", F.col("b").alias("v")).where("i > 0")
    right = right.withColumn("v", F.when(F.col("i") == 4, F.slice("v", 1, 2)).otherwise(F.col("v"))).unionByName(right.where("i = 6"))
    assert {(r.i, r.problem) for r in V.unparallel(left, right, ["i"], "v").collect()} == {(0, "only left"), (11, "only right"), (4, "sizes differ"), (6, "repeated")}


def test_chunks_and_audio_tokens(spark):
    df = spark.createDataFrame([("a", list(range(10))), ("b", [1])], "key string, u array<int>")
    assert [(r.key, r.part) for r in Q.chunks(df, "u", 4, ["key"], 3).orderBy("start").collect()] == [("a", [0, 1, 2, 3]), ("a", [4, 5, 6, 7])]
    assert Q.chunks(df, "u", 0, ["key"], 2).count() == 1
    got = spark.createDataFrame([(k,) for k in (0, 1, 2, 4, 100, 3000)], "n int").select(Q.audio_tokens(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [0, 0, 0, 1, 25, 750]


def test_alignment_of_a_whole_table(spark, tmp_path):
    from glasra.plans import scoring

    x = np.random.default_rng(6).normal(size=(461, 8))  # the last has no partner
    ids = [7 * k for k in range(461)]
    spark.createDataFrame(pd.DataFrame({"vec_id": ids, "label": 4, "embedding": x.tolist()})).write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:230] @ u[230:460].T
    got = {r.i: (r.row_rank, r.col_rank) for r in scoring.alignment_ranks(spark, str(tmp_path)).collect()}
    assert got == {i: ((s[i] > s[i, i]).sum() + 1, (s[:, i] > s[i, i]).sum() + 1) for i in range(230)}
    assert scoring.mexa_raw(spark, str(tmp_path)).first().n == scoring.mexa_centred(spark, str(tmp_path)).first().n == 230


def test_ragged_union_of_whole_tables(spark, tmp_path):
    from glasra.plans import scoring

    spark.createDataFrame([(k, "base", "ga", k) for k in range(120)], "row_id long, model string, lang string, generated_tokens int").write.parquet(f"{tmp_path}/decodes.parquet")
    spark.createDataFrame([(k, "ctc", "en", float(k)) for k in range(30)], "row_id long, decoder string, lang string, duration_s double").write.parquet(f"{tmp_path}/asr_pairs.parquet")
    got = sorted(map(tuple, scoring.ragged_union(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(k, "base", None, "ga", k) for k in range(120)] + [(k, None, "ctc", "en", None) for k in range(30)], key=str)


def test_places_of_all_ids_sorted_as_text(spark, tmp_path):
    from glasra.plans import corpus

    ids = [*range(997), 10, 10]
    spark.createDataFrame([(k,) for k in ids], "doc_id long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.place, r.doc_id) for r in corpus.sort_as_text(spark, str(tmp_path)).collect())
    assert got == list(enumerate(sorted(ids, key=str)))
    assert S.placed(spark.range(0), F.col("id")).count() == 0


def test_conversations_in_any_spelling(spark, tmp_path):
    from glasra.plans import scoring

    names = ["conversations_ga", "Conversations-GA ", "conversations_ga.parquet", "nce", None]
    spark.createDataFrame([(k, n, "a\nb") for k, n in enumerate(names)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in scoring.restored_turns(spark, str(tmp_path)).collect()} == {0, 1, 2}


def test_nearest_centroids_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [1.0]), (None, [9.0, 9.0]), (5, [0.0, 0.0])], "k int, v array<double>")
    got = {r.k: (r.centroid, r.distance) for r in V.nearest(df, np.array([[0.0, 0.0], [0.0, 2.0]]), "k", "v").collect()}
    assert got[1] == (0, 1.0) and got[2] == got[3] == (None, None) and got[None][0] == 1 and got[5] == (0, 0.0)
    assert V.nearest(df, np.zeros((0, 2)), "k", "v").where("centroid is null").count() == 5


def test_nested_columns_as_json(spark):
    df = spark.createDataFrame([(1, (None, "b"), {"k": 1}, [1, None]), (2, None, None, None)], "i int, s struct<a:string,b:string>, m map<string,int>, l array<int>")
    got = {r.i: (r.s, r.m, r.l) for r in R.nested_as_json(df).collect()}
    assert got == {1: ('{"a":null,"b":"b"}', '{"k":1}', "[1,null]"), 2: (None, None, None)}
