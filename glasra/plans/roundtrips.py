"""Sources, sinks and streams, each written to the shared folder and read again; the SQL gives what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasra.operators import gates as G
from glasra.operators import review as R
from glasra.operators import sequences as Q
from glasra.plans.corpus import SOURCE_SQL, query
from glasra.plans.manifest import sequences
from glasra.sources import files, sinks
from glasra.streaming import jobs
from glasra.tables import read, source_name


@query("SELECT packet_id, question, marking_scheme FROM packets WHERE question IS NOT NULL AND marking_scheme <> ''")
def csv_with_mark_roundtrip(spark, d):
    """CSV with a byte-order mark, quotes and all."""
    p = sinks.scratch(spark, "csv")
    rows = read(spark, d, "packets").where("question is not null and marking_scheme <> ''").select("packet_id", "question", "marking_scheme")
    sinks.csv_with_mark(rows, p)
    back = files.csv_with_mark(spark, p)
    return back.select(F.col("packet_id").cast("long").alias("packet_id"), "question", "marking_scheme")


@query("SELECT item_id, suite, lang, text FROM eval_items")
def jsonl_roundtrip(spark, d):
    """JSONL appended and read by a given schema; a gate compares row for row."""
    p = sinks.scratch(spark, "jsonl")
    t = read(spark, d, "eval_items").select("item_id", "suite", "lang", "text")
    sinks.append_jsonl(t, p)
    back = files.jsonl(spark, p, "item_id long, suite string, lang string, text string", ["item_id", "suite", "lang", "text"])
    G.enforce(G.same_rows(t, back), "round trip")
    return back


@query("SELECT label, count(*) AS n, sum(CASE WHEN duration_s > 5 THEN 1 ELSE 0 END)::BIGINT AS n_long FROM aligned_setup GROUP BY label")
def tsv_shards_roundtrip(spark, d):
    """Numbered manifests; paths and durations come back by their header."""
    p = sinks.scratch(spark, "tsv")
    t = read(spark, d, "aligned_setup").select("label", "duration_s", F.pmod(F.xxhash64("label"), F.lit(4)).alias("shard"))
    sinks.tsv_shards(t, p)
    back = files.tsv(spark, p, "label string, duration_s double, shard int")
    return back.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("duration_s") > 5).alias("n_long"))


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source")
def source_shards(spark, d):
    """A folder for each source, read again with its partition column."""
    p = sinks.scratch(spark, "shards")
    sinks.shards(read(spark, d, "documents").where("source is not null and text is not null").select("source", "doc_id", "text"), p)
    # a source's blanks at its end are part of its name
    back = spark.read.schema("doc_id long, text string, source string").parquet(p)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


@query("SELECT row_id, model, mean_logprob::FLOAT AS mean_logprob FROM decodes")
def parquet_schema_roundtrip(spark, d):
    """Exact columns and types, zstd."""
    p = sinks.scratch(spark, "zstd")
    sinks.parquet_as(read(spark, d, "decodes"), p, "row_id long, model string, mean_logprob float")
    return files.parquet(spark, p, ["row_id", "model", "mean_logprob"])


@query("SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, NULL::INT AS year FROM documents")
def ordered_concatenation(spark, d):
    """Rows in one order over numbered parts, none lost; an optional column that isn't there reads null."""
    p = sinks.scratch(spark, "ordered")
    sinks.concatenated(read(spark, d, "documents").select("doc_id", "source"), p, ["doc_id"])
    back = files.parquet(spark, p, ["doc_id", "year"], {"year": "int"})
    return back.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("year").alias("year"))


@query("SELECT packet_id, answers.just_audio AS just_audio, model FROM packets")
def nested_json_roundtrip(spark, d):
    """Structs as JSON documents and back."""
    p = sinks.scratch(spark, "nested")
    sinks.nested_json(read(spark, d, "packets").select("packet_id", "model", "answers"), p)
    back = spark.read.text(p).select(F.from_json("value", "packet_id long, model string, answers struct<just_audio:string,no_context:string,just_transcript:string>").alias("r"))
    return back.select("r.packet_id", "r.answers.just_audio", "r.model")


@query("SELECT key, len(units) AS n, (list_sum(units))::BIGINT AS total FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0)")
def token_file_roundtrip(spark, d):
    """Sequences as flat uint32 files and back."""
    p = sinks.scratch(spark, "bin")
    u = sequences(spark, d).select(F.concat("key", F.lit(".bin")).alias("name"), sinks.uint32_bytes("units").alias("content"))
    sinks.write_files(u, p)
    t = files.token_streams(spark, p)
    signed = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))
    return t.select(F.regexp_replace("name", r"\.bin$", "").alias("key"), F.size("tokens").cast("long").alias("n"), signed.alias("total"))


@query("SELECT 100000::BIGINT AS n, 1000::BIGINT AS n_ids, 0::INT AS least, 999::INT AS greatest, 50::BIGINT AS n_repeated")
def synthetic_range(spark, d):
    """Synthetic ids: as many as asked for, each of the vocabulary, none outside; the same for a seed, and of fifty seeds all differ in some."""
    t = files.synthetic_tokens(spark, 100_000, 1000, 7)
    again = files.synthetic_tokens(spark, 50, 1000, 7).exceptAll(t).count()
    return t.agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_ids"), F.min("token").alias("least"), F.max("token").alias("greatest")).withColumn("n_repeated", F.lit(50 - again).cast("long"))


@query("SELECT lang, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang")
def streamed_counts(spark, d):
    """A stream over the files, counted in batches that may come again; sums over batches are the counts."""
    p = sinks.scratch(spark, "stream")
    s = jobs.stream_parquet(spark, f"{d}/documents.parquet*").where("text <> ''")
    jobs.counted_into(s, ["lang"], f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out").groupBy("lang").agg(F.sum("n").alias("n"))


@query("SELECT row_id, model, upper(trim(stop_reason)) AS stop FROM decodes WHERE generated_tokens > 20")
def streamed_append(spark, d):
    """An append that takes up where it ended: run twice, each record comes once."""
    p = sinks.scratch(spark, "append")
    for _ in range(2):
        s = jobs.stream_parquet(spark, f"{d}/decodes.parquet*").where("generated_tokens > 20").select("row_id", "model", F.upper(F.trim("stop_reason")).alias("stop"))
        jobs.drained(s, f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out").select("row_id", "model", "stop")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """Event-time windows of an hour, as a stream into a table of batches."""
    p = sinks.scratch(spark, "windows")
    s = jobs.stream_parquet(spark, f"{d}/events.parquet*").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    jobs.counted_into(s, ["event_type", "hour"], f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out").groupBy("event_type", "hour").agg(F.sum("n").alias("n"))


@query("SELECT model, count(*) AS n FROM decodes GROUP BY model")
def nonempty_gate(spark, d):
    """Gates on columns and rows before a result is used."""
    t = read(spark, d, "decodes").select("model", "row_id")
    G.exact_columns(t, ["model", "row_id"])
    G.non_empty(t, "decodes")
    return t.groupBy("model").agg(F.count("*").alias("n"))


@query("""SELECT key, coalesce(n_gone, 0)::INT AS n_gone FROM (SELECT key, CASE WHEN list_position(units, 530) > 0 THEN len(units) - list_position(units, 530) + 1 END AS n_gone FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0))""")
def cut_at_first_id(spark, d):
    """Sequences cut at the earliest of several ids."""
    u = sequences(spark, d)
    return u.select("key", (F.size("units") - F.size(Q.first_of(F.col("units"), [530, -5]))).alias("n_gone"))


@query("""
SELECT count(*) AS n_files, sum(n)::BIGINT AS n_tokens, sum(total)::BIGINT AS total FROM (SELECT regexp_extract(key, '-([A-Z])-', 1) AS section, sum(len(units)) AS n, sum(list_sum(units)) AS total FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0) GROUP BY section)""")
def token_shards_joined(spark, d):
    """Token shards by row group, and those of a source put one behind another; sizes are checked on the way."""
    p = sinks.scratch(spark, "shards")
    u = sequences(spark, d).select(F.regexp_extract("key", r"-([A-Z])-", 1).alias("source"), F.pmod(F.xxhash64("key"), F.lit(4)).alias("rg"), "key", "units")
    made = sinks.token_shards(u, p, "source", "rg", "key", "units")
    names = made.select(F.concat(F.substring_index("name", "__rg", 1), F.lit(".bin")).alias("target"), F.col("name").alias("place"), "name")
    sinks.joined_files(spark, names, p, f"{p}/joined")
    t = files.token_streams(spark, f"{p}/joined")
    signed = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))
    return t.agg(F.count("*").alias("n_files"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"), F.sum(signed).alias("total"))


@query("SELECT item_id, suite, lang FROM eval_items")
def json_documents_back(spark, d):
    """A JSON document for each suite, read again by two globs that name the same files."""
    p = sinks.scratch(spark, "documents")
    e = read(spark, d, "eval_items").groupBy("suite").agg(F.array_sort(F.collect_list(F.struct("item_id", "lang"))).alias("items"))
    sinks.write_files(e.select(F.concat(F.md5("suite"), F.lit(".json")).alias("name"), F.to_json(F.struct("suite", "items")).cast("binary").alias("content")), p)
    back = files.json_documents(spark, [f"{p}/*.json", f"{p}/*.json"], "suite string, items array<struct<item_id:long,lang:string>>")
    return back.select("suite", F.inline("items")).select("item_id", "suite", "lang")


@query("SELECT suite, count(*) AS n, min(item_id) AS first FROM eval_items GROUP BY suite")
def bare_tsv_back(spark, d):
    """Lines without a header; short ones are left out, columns too many ignored; rows of a key as a map of many."""
    p = sinks.scratch(spark, "bare")
    e = read(spark, d, "eval_items")
    lines = e.select(F.concat_ws("\t", F.col("item_id").cast("string"), "suite", F.regexp_replace("text", r"[\t\r\n]", " "), F.lit("more")).alias("value"))
    lines.unionByName(e.select(F.col("item_id").cast("string").alias("value"))).write.text(p)
    m = files.multimap(files.bare_tsv(spark, p, ["item_id", "suite", "text"]), "suite")
    return m.select("suite", F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda r: r.item_id.cast("long"))).alias("first"))


@query("SELECT regexp_extract(audio, '([^/]*)$', 1) AS name, duration_s FROM aligned_setup WHERE audio IS NOT NULL AND duration_s IS NOT NULL")
def durations_back(spark, d):
    """Sidecar lines of a path and its seconds; lines without a number are left out."""
    p = sinks.scratch(spark, "durations")
    m = read(spark, d, "aligned_setup").where("audio is not null")
    m.select(F.concat_ws(" ", "audio", F.coalesce(F.col("duration_s").cast("string"), F.lit("unknown"))).alias("value")).write.text(p)
    return files.durations(spark, p)


def _pcm_files(spark, d, name):
    p = sinks.scratch(spark, name)
    c = read(spark, d, "clips").where("audio is not null")
    sinks.write_files(c.select(F.concat("section", F.lit("/"), "snippet_id", F.lit(".pcm")).alias("name"), F.col("audio").alias("content")), p)
    return p


@query("SELECT section AS label, count(*) AS n_files, sum(octet_length(audio))::BIGINT AS bytes FROM clips WHERE audio IS NOT NULL GROUP BY section")
def listed_files(spark, d):
    """A folder for each label, from its listing alone; none at all would end the job."""
    return files.required(spark, _pcm_files(spark, d, "listing"), "*.pcm").groupBy("label").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


@query("""
SELECT name, bytes FROM (SELECT section || '/' || snippet_id || '.pcm' AS name, octet_length(audio)::BIGINT AS bytes, coalesce(sum(octet_length(audio)) OVER (ORDER BY section || '/' || snippet_id || '.pcm' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM clips WHERE audio IS NOT NULL) WHERE before < 10000""")
def files_until_budget(spark, d):
    """Files in order until 10,000 bytes are reached."""
    got = files.until_budget(files.listing(spark, _pcm_files(spark, d, "budget"), "*.pcm"), 10_000)
    return got.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"), "bytes")


@query("SELECT DISTINCT ON (key) key || '.npy' AS name, len(units)::INT AS n, md5(array_to_string(units, ',')) AS digest FROM cluas_units WHERE len(units) > 0")
def npy_units_back(spark, d):
    p = sinks.scratch(spark, "npy")
    sinks.write_files(sequences(spark, d).select(F.concat("key", F.lit(".npy")).alias("name"), sinks.npy_bytes("units").alias("content")), p)
    return files.npy_units(spark, p).select("name", F.size("units").alias("n"), F.md5(F.array_join("units", ",")).alias("digest"))


@query("SELECT section || '.tar' AS archive, snippet_id || '.pcm' AS name, octet_length(audio)::INT AS bytes FROM clips WHERE audio IS NOT NULL")
def tar_members_back(spark, d):
    """An archive for each section, and its members."""
    import io
    import tarfile

    import pandas as pd

    def pack(pdf):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for n, c in zip(pdf.snippet_id, pdf.audio, strict=True):
                info = tarfile.TarInfo(f"audio/{n}.pcm")
                info.size = len(c)
                t.addfile(info, io.BytesIO(bytes(c)))
        return pd.DataFrame({"name": [f"{pdf.section.iloc[0]}.tar"], "content": [out.getvalue()]})

    p = sinks.scratch(spark, "tar")
    c = read(spark, d, "clips").where("audio is not null").select("section", "snippet_id", "audio")
    sinks.write_files(c.groupBy("section").applyInPandas(pack, "name string, content binary"), p)
    return files.tar_members(spark, p).select("archive", "name", F.octet_length("content").alias("bytes"))


@query("SELECT label::VARCHAR AS store, 'text_ga' AS object, count(DISTINCT vec_id) AS n, max(len(embedding))::INT AS width FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY label")
def embedding_store_back(spark, d):
    """An array file of each label's vectors with its sidecar, which has to have its keys."""
    from glasra.operators.sampling import ordinal

    p = sinks.scratch(spark, "npz")
    known = read(spark, d, "embeddings").where("label is not null and vec_id is not null and embedding is not null").dropDuplicates(["label", "vec_id"])
    e = ordinal(known.select("label", "vec_id", "embedding"), ["label"], "vec_id", "sent_idx")
    sinks.embedding_files(e.select(F.col("label").cast("string").alias("store"), F.lit("text_ga").alias("object"), F.lit("weighted").alias("pooling"), F.lit(0).alias("layer"), F.col("sent_idx").cast("int").alias("sent_idx"), F.col("embedding").alias("v")), p, {"model": "base", "step": 0})
    back = files.embedding_store_with(spark, p, ["model", "step", "store"])
    return back.groupBy(F.regexp_replace("store", r"\.npz$", "").alias("store"), "object").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"))


@query("SELECT lang, CASE WHEN item_id % 2 = 0 THEN 'raw' ELSE 'chat' END AS format, text FROM eval_items")
def prompts_back(spark, d):
    """Tagged prompts, a line each, among comments and blank lines."""
    p = sinks.scratch(spark, "prompts")
    e = read(spark, d, "eval_items")
    tag = F.concat("lang", F.lit(":"), F.when(F.col("item_id") % 2 == 0, "raw").otherwise("chat"), F.lit(": "), "text")
    e.select(F.explode(F.array(tag, F.lit("# a note"), F.lit("  "))).alias("value")).write.text(p)
    return files.prompts(spark, p)


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS ordinal, text AS value FROM eval_items")
def lines_back(spark, d):
    """One text a line in one file, with its place there."""
    p = sinks.scratch(spark, "lines")
    read(spark, d, "eval_items").select("item_id", F.col("text").alias("value")).repartition(1).sortWithinPartitions("item_id").select("value").write.text(p)
    return files.lines(spark, f"{p}/part-*").select("ordinal", "value")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def meta_back(spark, d):
    """Totals as one JSON document beside the data, read again."""
    p = sinks.scratch(spark, "meta")
    doc = sinks.meta(read(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")))
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(p)
    return files.json_documents(spark, [p], "per_source array<struct<source:string,n:long>>").select(F.inline("per_source"))


@query("SELECT row_id, generated_tokens FROM decodes WHERE generated_tokens IS NOT NULL")
def sorted_tsv_back(spark, d):
    """Counts sorted, with a summary whose totals are checked."""
    import json

    p = sinks.scratch(spark, "sorted")
    t = read(spark, d, "decodes").where("generated_tokens is not null").select("row_id", "generated_tokens")
    summary = json.loads(sinks.sorted_tsv(t, p, ["row_id", "generated_tokens"]))
    back = files.tsv(spark, p, "row_id long, generated_tokens int")
    G.row_count(back, summary["rows"], "sorted counts")
    return back


@query("SELECT condition, count(*) AS n, count_if(hypothesis = '') AS n_empty FROM decodes WHERE condition IS NOT NULL GROUP BY condition")
def by_condition_back(spark, d):
    """A file for each condition."""
    p = sinks.scratch(spark, "conditions")
    sinks.by_condition(read(spark, d, "decodes").where("condition is not null").select("condition", "row_id", "hypothesis"), p)
    back = spark.read.schema("row_id long, hypothesis string, condition string").json(p)
    return back.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("hypothesis") == "").alias("n_empty"))


@query("SELECT '| model | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || model || ' | ' || n || ' |', chr(10) ORDER BY model) AS report FROM (SELECT model, count(*) AS n FROM decodes GROUP BY model)")
def markdown_report(spark, d):
    """A small table as Markdown."""
    return spark.createDataFrame([(R.markdown(read(spark, d, "decodes").groupBy("model").agg(F.count("*").alias("n")).orderBy("model")),)], "report string")


@query("""SELECT decoder, '## ' || decoder || chr(10) || '- before: ' || coalesce(ref, '–') || chr(10) || '- after: ' || coalesce(hyp, '–') AS block FROM (SELECT DISTINCT ON (decoder) * FROM asr_pairs ORDER BY decoder, row_id, added_at)""")
def before_after_text(spark, d):
    """The first pair of each decoder as a block of text, before and after."""
    t = read(spark, d, "asr_pairs").groupBy("decoder").agg(F.min_by(F.struct("ref", "hyp"), F.struct("row_id", "added_at")).alias("r"))
    return t.select("decoder", R.before_after(F.col("decoder"), F.col("r.ref"), F.col("r.hyp")).alias("block"))


@query("SELECT snippet_id || '.wav' AS name, sr AS rate, (octet_length(audio) // 2)::BIGINT AS n_samples FROM clips WHERE audio IS NOT NULL AND sr > 0")
def wav_export(spark, d):
    """Clips as WAV files and back."""
    p = sinks.scratch(spark, "wav")
    c = read(spark, d, "clips").where("audio is not null and sr > 0")
    sinks.write_files(c.select(F.concat("snippet_id", F.lit(".wav")).alias("name"), sinks.wav_bytes("audio", "sr").alias("content")), p)
    return files.wav_files(spark, p).select("name", "rate", "n_samples")


@query("SELECT count(*) AS n_rows, 4 AS n_files FROM documents")
def footer_rows(spark, d):
    """Rows by the footers of the files alone."""
    p = sinks.scratch(spark, "footers")
    read(spark, d, "documents").select("doc_id").repartition(4).write.parquet(p)
    f = files.footers(spark, p)
    G.enforce(f.where("bytes < 1 or row_groups < 1 and rows > 0"), "footers")
    return f.agg(F.sum("rows").alias("n_rows"), F.count("*").cast("int").alias("n_files"))


@query(rf"""SELECT doc_id, len(regexp_split_to_array(text, '\r?\n'))::INT AS n_turns, md5(array_to_string(regexp_split_to_array(text, '\r?\n'), '|')) AS digest FROM documents WHERE {SOURCE_SQL} = 'conversations_ga' AND text IS NOT NULL""")
def streamed_turns(spark, d):
    """Turns as a stream of records in any order, given back as whole conversations once all their turns have come."""
    p = sinks.scratch(spark, "turns")
    t = read(spark, d, "documents").where((source_name(F.col("source")) == "conversations_ga") & F.col("text").isNotNull()).select("doc_id", F.split("text", r"\r?\n").alias("turns"))
    kids = t.select("doc_id", F.size("turns").alias("of"), F.posexplode("turns").alias("i", "turn"))
    kids.repartition(3, F.xxhash64("doc_id", "i")).write.parquet(f"{p}/in")
    s = jobs.whole_parents(jobs.stream_parquet(spark, f"{p}/in", 1), "doc_id", "i", "of", "turn")
    jobs.drained(s, f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out").select("doc_id", F.size("values").alias("n_turns"), F.md5(F.array_join("values", "|")).alias("digest"))


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def watermarked_windows(spark, d):
    """Event-time windows of an hour that the watermark closes: a last record, far ahead, lets all others go; its own window stays open."""
    p = sinks.scratch(spark, "watermark")
    e = read(spark, d, "events").where("ts is not null").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.coalesce(1).write.parquet(f"{p}/in")
    e.agg((F.max("ts") + F.expr("interval 4000 days")).alias("ts")).select("ts", F.lit("end").alias("event_type")).write.mode("append").parquet(f"{p}/in")
    s = jobs.windowed_counts(jobs.stream_parquet(spark, f"{p}/in", 1), "ts", "1 hour", "3650 days", ["event_type"])
    jobs.drained(s, f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
