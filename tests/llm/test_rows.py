import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from glasra.llm import mixing, pieces, sample


def test_sample_is_nested_and_keeps_its_rows(spark):
    rows = [(f"clar_{k % 7:03d}/2020_{k // 9}_{k % 9}.wav", k % 12, 1) for k in range(4000)]
    rows += [("./" + a, b + 1, 1) for a, b, _ in rows[:500]] + [(None, 1, 1), ("", 1, 1)]
    df = spark.createDataFrame(rows, "audio string, batch int, bucket int")
    key = sample.path_key(F.col("audio"))
    part = lambda d, share: Counter(r.audio for r in sample.stable_sample(d, key, share).collect())
    small, large = part(df, 1 / 40), part(df, 1 / 10)
    assert not small - large and 40 < sum(small.values()) < 200
    early = part(df.where("batch <= 4"), 1 / 40)
    assert not early - small and part(df.repartition(13), 1 / 40) == small
    by_key = {}
    for a in large:
        by_key.setdefault(a.removeprefix("./"), set()).add(a)
    stored = {r[0] for r in rows if r[0]}
    assert all({"./" + k, k} & stored <= v for k, v in by_key.items())
    assert sample.stable_sample(df.limit(0), key).count() == 0


def test_paths_in_one_spelling(spark):
    same = ["a/b_1.wav", "./a/b_1.wav", "/a/b_1.wav", "a//b_1.wav", "a/./b_1.wav", " A/b_1.WAV ", "a\\b_1.wav", "x/../a/b_1.wav", "../a/b_1.wav", "a/x/./y/../../b_1.wav"]
    df = spark.createDataFrame([(s,) for s in same], "audio string")
    assert {r[0] for r in df.select(sample.path_key(F.col("audio"))).collect()} == {"a/b_1.wav"}


def test_permutation_is_one_to_one():
    assert len({(b * sample.STEP + sample.SHIFT) % sample.BUCKETS for b in range(sample.BUCKETS)}) == sample.BUCKETS


def test_pieces_cover_within_size_and_share_their_overlap():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1024, 1025, 5000, 9000):
        for p in (0.0, 0.001, 0.01, 0.2):
            u = rnd.integers(0, 1000, n)
            nat = rnd.random(n) < p
            got = pieces.cuts(u, nat)
            assert not n or got[0][0] == 0 and got[-1][1] == n
            for (a, b, how), (c, d, _) in zip(got, got[1:], strict=False):
                assert c == b - 64 and b - a <= 1024 and d > b and (how != "natural" or nat[b - 1])
            assert all(b - a <= 1024 for a, b, _ in got)


def test_stretches_from_cuts_are_all_stretches():
    rnd = np.random.default_rng(5)
    for k in range(300):
        u = rnd.integers(0, 1000, int(rnd.integers(0, 6000)))
        nat = rnd.random(len(u)) < rnd.choice([0.0, 0.0005, 0.001, 0.003])
        edge = [-1, *np.flatnonzero(nat).tolist(), len(u)]
        want = [a + 1 for a, b in zip(edge, edge[1:], strict=False) if b - a - 1 > 1024]
        assert pieces.unbroken(nat, pieces.cuts(u, nat)) == want, k


def test_an_edit_changes_only_pieces_near_it():
    rnd = np.random.default_rng(2)
    u, nat = rnd.integers(0, 900, 20000), rnd.random(20000) < 0.02
    v, nat2 = np.insert(u, 3000, 17), np.insert(nat, 3000, False)
    ends = lambda x, m: {b for _, b, _ in pieces.cuts(x, m)}
    a, b = ends(u, nat), {e - 1 if e > 3000 else e for e in ends(v, nat2)}
    far = {e for e in a if e > 12000}
    assert len(far & b) >= 0.8 * len(far)


def test_unbroken_stretches(spark, monkeypatch):
    inv = spark.createDataFrame([(1, "pause"), (2, "breath"), (3, "speech"), (4, "noise")], "unit int, kind string")
    rows = [
        ("a", [3] * 1024 + [1] + [4] * 1025),
        ("b", [3] * 1025 + [2] + [5000] * 2000),
        ("c", [1, 2] * 2000),
        ("d", None),
        ("e", []),
        ("f", [None] * 1100),
        ("b", [3] * 1025 + [2] + [5000] * 2000),
    ]
    df = spark.createDataFrame(rows, "key string, units array<int>").withColumn("kind", F.lit("x"))
    assert sorted(map(tuple, pieces.unbroken_stretches(df, inv).collect())) == [("a", 1025), ("b", 0), ("b", 1026), ("f", 0)]
    p = pieces.pieces(df, inv)
    assert {r.key for r in p.select("key").distinct().collect()} == {"a", "b", "c", "f"}
    by_table = sorted(map(str, p.collect()))
    monkeypatch.setattr(pieces, "NATURAL_UNITS", 1)  # more than a worker may hold: by join
    assert sorted(map(str, pieces.pieces(df, inv).collect())) == by_table
    assert sorted(map(tuple, pieces.unbroken_stretches(df, inv).collect())) == [("a", 1025), ("b", 0), ("b", 1026), ("f", 0)]
    monkeypatch.undo()
    assert pieces.pieces(df.limit(0), inv).count() == 0 and pieces.unbroken_stretches(df, inv.limit(0)).count() == 4


def test_splitting_tree_is_exact():
    rng = np.random.default_rng(3)
    counts = np.array([100, 7, 0, 33])
    got = mixing.split_counts(counts, 6, rng)
    assert len(got) == 6 and (sum(got) == counts).all() and all((g >= 0).all() for g in got)
    assert max(g.sum() for g in got) - min(g.sum() for g in got) <= 3


def test_mix_has_its_shares_and_keeps_its_caps(spark, monkeypatch, tmp_path):
    rnd = random.Random(4)
    docs = [(k, " ".join(["w"] * rnd.randint(1, 30)), rnd.choice(["a", "a", "a", "b", "c.parquet", None])) for k in range(6000)]
    docs += [(9000, None, "a"), (9001, "", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("words", F.lit("x"))
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, None), ("m", "none", 0.0, 1)], "mix string, source string, target_share double, max_repeats int")
    sizes = mixing.document_sizes(df).cache()
    out = mixing.mixes(sizes, targets, 40_000, shards=4).collect()
    words = Counter()
    seen = Counter()
    for r in out:
        words[r.source] += r.words
        seen[r.doc_id] += 1
    total = sum(words.values())
    assert total <= 40_000 and abs(words["a"] / total - 0.5) < 0.01 and abs(words["b"] / total - 0.3) < 0.01
    caps = {"a": 1, "b": 2, "c": 1}
    assert all(n <= caps[s] for d, n in seen.items() for s in {r.source for r in out if r.doc_id == d})
    again = mixing.mixes(sizes.repartition(7), targets, 40_000, shards=4).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mixes(sizes.limit(0), targets, 40_000).count() == 0 and mixing.mixes(sizes, targets.limit(0), 100).count() == 0
    both = targets.unionByName(targets.withColumn("mix", F.lit("n")))
    assert Counter((r.mix, r.doc_id) for r in mixing.mixes(sizes, both, 40_000, shards=4).collect()) == Counter((m, r.doc_id) for r in out for m in "mn")
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 300)
    n = {r.source: r.n for r in mixing.in_blocks(sizes, ["a", "b"]).groupBy("source").agg(F.countDistinct("block").alias("n")).collect()}
    assert n == {"a": -(-sizes.where("source = 'a'").count() // 300), "b": max(4, -(-sizes.where("source = 'b'").count() // 300))}
    mixed = mixing.mixes(sizes, targets, 40_000, shards=4)
    assert 39_000 < mixed.agg(F.sum("words")).first()[0] <= 40_000
    mixing.write_shards(mixed, df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == mixed.count() and back.where("text is null").count() == 0
    shards = {}
    for r in back.select("shard", "place", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i")).collect():
        shards.setdefault(r.shard, []).append((r.f, r.i, r.place))
    assert len(shards) == 4 and all([p for *_, p in sorted(v)] == sorted(p for *_, p in v) for v in shards.values())
    sizes.unpersist()
