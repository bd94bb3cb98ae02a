import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasra.operators.gates import GateError
from glasra.sources import files, sinks
from glasra.streaming import jobs


def test_text_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a b/c d.wav 1.5\nx.wav none\ny.wav 2\n\n")
    assert sorted(map(tuple, files.durations(spark, str(tmp_path / "d.txt")).collect())) == [("c d.wav", 1.5), ("y.wav", 2.0)]
    (tmp_path / "t.tsv").write_text('1\tx "y\tz\n2\tonly\n1\tp\tq\textra\n')
    t = files.bare_tsv(spark, str(tmp_path / "t.tsv"), ["id", "a", "b"])
    assert sorted(map(tuple, t.collect())) == [("1", "p", "q"), ("1", 'x "y', "z")]
    assert {r.id: len(r.rows) for r in files.multimap(t, "id").collect()} == {"1": 2}
    (tmp_path / "p.txt").write_text("# note\nga:raw: Dia duit\n\nen:chat: Hello there\n")
    assert sorted(map(tuple, files.prompts(spark, str(tmp_path / "p.txt")).collect())) == [("en", "chat", "Hello there"), ("ga", "raw", "Dia duit")]
    (tmp_path / "q.txt").write_text("Hello\n")
    with pytest.raises(GateError):
        files.prompts(spark, str(tmp_path / "q.txt"))
    (tmp_path / "c.csv").write_bytes("﻿id,t\n1,a\n1,b\n".encode())
    assert files.csv_with_mark(spark, str(tmp_path / "c.csv")).columns == ["id", "t"]
    with pytest.raises(GateError):
        files.csv_with_mark(spark, str(tmp_path / "c.csv"), "id")
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"l{k}.txt").write_text("".join(f"líne {k} {i}\r\n" if i % 2 else f"líne {k} {i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many splits a file
    got = {(r.file, r.ordinal): r.value for r in files.lines(spark, str(tmp_path / "many")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"l{k}.txt", i): f"líne {k} {i}" for k in range(3) for i in range(4000)}
    assert [(r.ordinal, r.value) for r in files.lines(spark, str(tmp_path / "p.txt")).orderBy("ordinal").collect()][1] == (1, "ga:raw: Dia duit")


def test_binary_sources(spark, tmp_path):
    np.save(tmp_path / "u.npy", np.array([1, 2, 999], np.uint16))
    np.array([7, 4294967295], "<u4").tofile(tmp_path / "s.bin")
    np.savez(tmp_path / "e.npz", **{"text_ga.weighted": np.ones((2, 3, 4), np.float16)})
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("x/y.wav")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    p = str(tmp_path)
    assert files.npy_units(spark, p).first().units == [1, 2, 999]
    assert files.token_streams(spark, p).first().tokens == [7, 4294967295]
    m = files.tar_members(spark, p).first()
    assert (m.name, bytes(m.content)) == ("y.wav", b"abc")
    e = files.embedding_store(spark, p)
    assert e.count() == 6 and {(r.object, r.pooling) for r in e.collect()} == {("text_ga", "weighted")}
    assert files.listing(spark, p, "*.npy").count() == 1
    with pytest.raises(GateError):
        files.required(spark, p, "*.flac")
    assert files.until_budget(files.listing(spark, p), 1).count() == 1
    with pytest.raises(GateError):
        files.sidecar("{}", ["model"])


def test_documents_and_sinks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"run": {"m": "x"},\n "rows": [{"id": 1}]}')
    d = files.json_documents(spark, [f"{tmp_path}/j/*.json", f"{tmp_path}/j/*.json"], "run struct<m:string>, rows array<struct<id:int>>")
    assert d.count() == 1 and d.select(F.explode("rows.id")).first()[0] == 1
    df = spark.createDataFrame([(1, "x", "a"), (2, None, "b")], "id int, t string, condition string")
    sinks.by_condition(df, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c").count() == 2
    sinks.sorted_tsv(df, f"{tmp_path}/s", ["id"])
    assert sinks.concatenated(df, f"{tmp_path}/k", ["id"]) == 2
    assert '"per_source"' in sinks.meta(df)
    sinks.shards(df, f"{tmp_path}/p", "condition")
    sinks.shards(df.where("id = 1"), f"{tmp_path}/p", "condition")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert files.file_sizes(spark, f"{tmp_path}/k").count() >= 1


def test_files_of_rows(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("a", 1, 2, [7, 8]), ("a", 1, 1, [5]), ("a", 2, 1, []), ("b", 0, 1, [4294967295])], "source string, rg int, pos int, ids array<bigint>")
    made = sinks.token_shards(df, f"{p}/t", "source", "rg", "pos", "ids")
    assert sorted(map(tuple, made.collect())) == [("a__rg0001.bin", 12), ("b__rg0000.bin", 4)]
    more = sinks.token_shards(df.unionByName(spark.createDataFrame([("a", 3, 1, [9])], df.schema)), f"{p}/t", "source", "rg", "pos", "ids")
    assert sorted(map(tuple, more.collect())) == [("a__rg0001.bin", 12), ("a__rg0003.bin", 4), ("b__rg0000.bin", 4)]
    names = more.select(F.concat(F.substring_index("name", "__", 1), F.lit(".bin")).alias("target"), F.col("name").alias("place"), "name")
    assert sorted(map(tuple, sinks.joined_files(spark, names, f"{p}/t", f"{p}/j").collect())) == [("a.bin", 16), ("b.bin", 4)]
    assert {r.name: r.tokens for r in files.token_streams(spark, f"{p}/j").collect()} == {"a.bin": [5, 7, 8, 9], "b.bin": [4294967295]}
    clips = spark.createDataFrame([("x.wav", b"\x00\x40\x00\xc0", 8000), ("y.wav", None, 8000), ("z.wav", b"\x01\x00", None)], "name string, audio binary, sr int")
    sinks.write_files(clips.select("name", sinks.wav_bytes("audio", "sr").alias("content")), f"{p}/w")
    assert [(r.name, r.rate, r.n_samples) for r in files.wav_files(spark, f"{p}/w").collect()] == [("x.wav", 8000, 2)]
    e = spark.createDataFrame([("s", "text_ga", "weighted", l, i, [float(l), float(i)]) for l in range(2) for i in range(3)], "store string, object string, pooling string, layer int, sent_idx int, v array<double>")
    sinks.embedding_files(e, f"{p}/e", {"model": "base"})
    back = files.embedding_store_with(spark, f"{p}/e", ["model", "arrays"])
    assert {(r.layer, r.sent_idx, tuple(r.v)) for r in back.collect()} == {(l, i, (float(l), float(i))) for l in range(2) for i in range(3)}
    with pytest.raises(GateError):
        files.embedding_store_with(spark, f"{p}/e", ["model", "step"])
    with pytest.raises(Exception, match="vectors"):
        sinks.embedding_files(e.where("layer = 0 or sent_idx = 0"), f"{p}/f", {})
    spark.range(1000).coalesce(1).write.parquet(f"{p}/q")
    assert [(r.row_groups, r.rows) for r in files.footers(spark, f"{p}/q").collect()] == [(1, 1000)]
    assert '"rows": 2' in sinks.sorted_tsv(clips.select("name", "sr").where("sr > 0"), f"{p}/s", ["name"])
    sinks.csv_of_all([spark.range(1).withColumn("a", F.lit("x")), spark.range(1).withColumn("b", F.lit("y"))], f"{p}/c")
    assert files.csv_with_mark(spark, f"{p}/c").columns == ["id", "a", "b"]


def test_resampled_tones_keep_their_pitch_and_level():
    from glasra.functions import audio

    for rate, to in ((44100, 16000), (8000, 16000), (48000, 16000), (16000, 16000)):
        t = np.arange(rate) / rate
        x = 0.5 * np.sin(2 * np.pi * 440 * t)
        y = audio.resampled(x, rate, to)
        want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(to) / to)
        assert len(y) == to and np.abs(y[500:-500] - want[500:-500]).max() < 0.01
        high = audio.resampled(np.sin(2 * np.pi * 0.48 * rate * t), rate, to)
        assert to >= rate or np.abs(high[500:-500]).max() < 0.05  # beyond the new rate's half
    assert audio.pcm16(b"\x00\x40\x00\xc0\x00\x40\x00\x40", 2).tolist() == [0.0, 0.5] and len(audio.pcm16(b"\x00")) == 0
    assert audio.decoded(b"none") is None and len(audio.resampled(np.zeros(0), 8000, 16000)) == 0
    back = audio.decoded(audio.encoded(np.array([0.25, -0.5]), 8000))
    assert back[0].tolist() == [0.25, -0.5] and back[1] == 8000


def test_shared_folder(spark, tmp_path):
    from glasra import session

    path = sinks.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    session.clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

    class Cluster:
        conf = {"spark.checkpoint.dir": "hdfs://n/shared/"}

        class sparkContext:
            master, applicationId = "spark://n:7077", "a"

    assert session.shared_folder(Cluster()) == "hdfs://n/shared"
    Cluster.conf = {}
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster())


def test_streams(spark, tmp_path):
    rows = [(1, 0, 2, "a"), (1, 1, 2, "b"), (2, 0, 3, "c"), (1, 0, 2, "a")]
    kids = spark.createDataFrame(rows, "p long, i int, of int, v string")
    kids.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = jobs.whole_parents(jobs.stream_parquet(spark, f"{tmp_path}/in"), "p", "i", "of", "v")
    jobs.drained(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [(r.p, r["values"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, ["a", "b"])]
    spark.createDataFrame([(2, 1, 3, "d"), (2, 2, 3, "e")], "p long, i int, of int, v string").write.mode("append").parquet(f"{tmp_path}/in")
    s = jobs.whole_parents(jobs.stream_parquet(spark, f"{tmp_path}/in"), "p", "i", "of", "v")
    jobs.drained(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert {r.p: r["values"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}[2] == ["c", "d", "e"]


def test_watermarked_windows(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01 00:00:30' as ts, 'a' as k union all select timestamp'2025-01-01 00:01:10', 'a' union all select timestamp'2025-01-01 02:00:00', 'a'").write.parquet(f"{tmp_path}/in")
    w = jobs.windowed_counts(jobs.stream_parquet(spark, f"{tmp_path}/in"), "ts", "1 minute", "10 minutes", ["k"])
    jobs.drained(w, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1]


def test_package_stands_without_its_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['glasra.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'corpus_profile' in q and not any(k.startswith('p1_') for k in q); from glasra.session import local_session; s = local_session(2, '1g'); assert q['total_hours'](s, '/root/testdata/sf0.001').count() == 1; s.stop()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
