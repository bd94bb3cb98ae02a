"""Queries on manifests, durations and unit sequences, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasra.functions.text import basename, stem, words
from glasra.operators import sampling as S
from glasra.operators import sequences as Q
from glasra.plans.corpus import QUERIES, SQL, query
from glasra.tables import read, spread


def _m(spark, d):
    return read(spark, d, "aligned_setup")


def _u(spark, d):
    return Q.one_of_each(read(spark, d, "cluas_units"), ["key"])


def sequences(spark, d):
    """Sequences that aren't empty, one of each key."""
    return Q.one_of_each(read(spark, d, "cluas_units").where(F.size("units") > 0), ["key"])


@query("SELECT audio, duration_s FROM aligned_setup WHERE duration_s > 0 AND duration_s <= 12 AND text IS NOT NULL AND text <> ''")
def short_utterances(spark, d):
    """Duration and text filters, pushed down."""
    return _m(spark, d).where("duration_s > 0 and duration_s <= 12 and text is not null and text <> ''").select("audio", "duration_s")


@query("SELECT label, count(*) AS n_files, round(sum(coalesce(duration_s, 0)) / 3600, 6) AS hours, count(duration_s) AS n_known FROM aligned_setup GROUP BY label")
def hours_by_label(spark, d):
    """Files and hours of each label; an unknown duration counts as none."""
    return _m(spark, d).groupBy("label").agg(F.count("*").alias("n_files"), F.round(F.sum(F.coalesce("duration_s", F.lit(0))) / 3600, 6).alias("hours"), F.count("duration_s").alias("n_known"))


@query("SELECT round(sum(duration_s) / 3600, 6) AS hours, count(DISTINCT label) AS n_labels, count(*) AS n_files FROM aligned_setup WHERE duration_s IS NOT NULL")
def total_hours(spark, d):
    return _m(spark, d).where("duration_s is not null").agg(F.round(F.sum("duration_s") / 3600, 6).alias("hours"), F.countDistinct("label").alias("n_labels"), F.count("*").alias("n_files"))


@query("""
SELECT coalesce(section, '(all)') AS section, sum(n)::BIGINT AS n_units, round(sum(n) / 180000.0, 6) AS hours FROM
  (SELECT regexp_extract(key, '-([A-Z])-', 1) AS section, len(coalesce(units, [])) AS n FROM (SELECT DISTINCT ON (key) * FROM cluas_units)) GROUP BY ROLLUP (section)""")
def unit_hours(spark, d):
    """Units as hours, by section and in all."""
    u = _u(spark, d).select(F.regexp_extract("key", r"-([A-Z])-", 1).alias("section"), F.coalesce(F.size(F.col("units")), F.lit(0)).alias("n"))
    g = u.withColumn("n", F.greatest("n", F.lit(0)).cast("long")).rollup("section").agg(F.sum("n").alias("n_units"))
    return g.select(F.coalesce("section", F.lit("(all)")).alias("section"), "n_units", F.round(F.col("n_units") / 180000.0, 6).alias("hours"))


@query("""
WITH s AS (SELECT * FROM aligned_setup ORDER BY audio, added_at LIMIT 200)
SELECT count(*) AS n, sum(CASE WHEN duration_s IS NULL OR duration_s <= 0 THEN 1 ELSE 0 END)::BIGINT AS bad_duration, sum(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE 0 END)::BIGINT AS no_text FROM s""")
def sanity_counts(spark, d):
    """Counts over the first 200 files, as a look before a long run."""
    s = _m(spark, d).orderBy("audio", "added_at").limit(200)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("duration_s").isNull() | (F.col("duration_s") <= 0)).alias("bad_duration"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("no_text"))


@query("""
SELECT label, min(duration_s) AS shortest, round(quantile_cont(duration_s, 0.5), 6) AS median, max(duration_s) AS longest FROM aligned_setup WHERE duration_s > 0 GROUP BY label""")
def duration_stats(spark, d):
    """Least, greatest and exact median duration of each label; a large label is no task's own, see `exact_median`."""
    t = _m(spark, d).where("duration_s > 0").select("label", "duration_s")
    ends = t.groupBy("label").agg(F.min("duration_s").alias("shortest"), F.max("duration_s").alias("longest"))
    m = S.exact_median(t, ["label"], "duration_s").withColumnRenamed("label", "_label")
    return ends.join(m, F.col("label").eqNullSafe(F.col("_label"))).select("label", "shortest", F.round("median", 6).alias("median"), "longest")


@query("""
SELECT sum(len(units))::BIGINT AS tokens, round(sum(duration_s::DOUBLE), 3) AS seconds, round(sum(len(units)) / (sum(duration_s::DOUBLE) / 3600), 3) AS tokens_per_hour
FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0)""")
def audio_rates(spark, d):
    u = sequences(spark, d)
    s = F.col("duration_s").cast("double")
    return u.agg(F.sum(F.size("units").cast("long")).alias("tokens"), F.round(F.sum(s), 3).alias("seconds"), F.round(F.sum(F.size("units")) / (F.sum(s) / 3600), 3).alias("tokens_per_hour"))


def nextfit_shards(spark, d):
    """Shards of five hours by next fit, longest first. A label of more than 100 hours is dealt into parts by hash first, so none outgrows a task."""
    m = _m(spark, d).select("audio", "label", "duration_s", F.date_format("added_at", "yyyyMMddHHmmssSSSSSS").alias("at"))
    parts = m.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce("duration_s", F.lit(0.0))) / (100 * 3600.0))).cast("int").alias("n"))
    m = m.join(parts, "label").withColumn("part", F.concat_ws("/", "label", F.pmod(F.xxhash64("audio"), F.col("n"))))
    out = Q.next_fit(m.withColumn("ord", F.concat_ws("|", "audio", "at")).select("part", "ord", "duration_s"), "duration_s", 5 * 3600.0, "ord", "part")
    return out.groupBy("part", "shard").agg(F.count("*").alias("n_files"), F.round(F.sum("duration_s") / 3600, 6).alias("hours"))


SQL["nextfit_shards"] = """
WITH RECURSIVE o AS (SELECT label, coalesce(duration_s, 0.0) AS s, row_number() OVER (PARTITION BY label ORDER BY coalesce(duration_s, 0.0) DESC, audio || '|' || strftime(added_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S%f')) AS r FROM aligned_setup),
f AS (SELECT label, r, s, s AS used, 0 AS shard FROM o WHERE r = 1
 UNION ALL SELECT o.label, o.r, o.s, CASE WHEN f.used + o.s > 18000.0 THEN o.s ELSE f.used + o.s END, CASE WHEN f.used + o.s > 18000.0 THEN f.shard + 1 ELSE f.shard END FROM f JOIN o ON o.label = f.label AND o.r = f.r + 1)
SELECT label || '/0' AS part, shard, count(*) AS n_files, round(sum(s) / 3600, 6) AS hours FROM f GROUP BY label, shard"""
QUERIES["nextfit_shards"] = nextfit_shards


@query(r"""
SELECT audio, regexp_extract(audio, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(audio, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, 'wav/' || regexp_extract(audio, '([^/]*)$', 1) AS rebased,
  try_cast(regexp_extract(audio, '_([0-9]+)\.wav$', 1) AS INT) AS segment FROM aligned_setup""")
def path_parts(spark, d):
    a = F.col("audio")
    return _m(spark, d).select("audio", basename(a).alias("base"), stem(a).alias("stem"), F.concat(F.lit("wav/"), basename(a)).alias("rebased"), F.expr(r"try_cast(regexp_extract(audio, '_([0-9]+)\\.wav$', 1) as int)").alias("segment"))


@query("""
WITH m AS (SELECT audio, max(duration_s) AS duration_s FROM aligned_setup WHERE duration_s > 0 GROUP BY audio)
SELECT p.row_id, p.audio, coalesce(m.duration_s, p.duration_s, 0) AS duration_s, m.audio IS NOT NULL AS listed FROM asr_pairs p LEFT JOIN m USING (audio)""")
def durations_joined(spark, d):
    """Durations of the manifest, else the pair's own, else none."""
    m = _m(spark, d).where("duration_s > 0").groupBy("audio").agg(F.max("duration_s").alias("listed_s"))
    j = read(spark, d, "asr_pairs").join(m, "audio", "left")
    return j.select("row_id", "audio", F.coalesce("listed_s", "duration_s", F.lit(0.0)).alias("duration_s"), F.col("listed_s").isNotNull().alias("listed"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, units FROM cluas_units WHERE len(units) > 0),
e AS (SELECT key, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM u),
l AS (SELECT *, lag(u) OVER (PARTITION BY key ORDER BY i) AS p FROM e)
SELECT key, count(*)::INT AS n_stored, sum(CASE WHEN i = 1 OR u IS DISTINCT FROM p THEN 1 ELSE 0 END)::INT AS n_runs FROM l GROUP BY key""")
def run_length_dedup(spark, d):
    """Repeats taken once, inside the array: no explode, no shuffle for it."""
    u = sequences(spark, d)
    return u.select("key", F.size("units").alias("n_stored"), F.size(Q.deduped(F.col("units"))).alias("n_runs"))


@query("""
WITH l AS (SELECT user_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n_events, sum(CASE WHEN r = 1 OR event_type IS DISTINCT FROM p THEN 1 ELSE 0 END)::BIGINT AS n_changes FROM l GROUP BY user_id""")
def event_changes(spark, d):
    """Changes of state in a long table."""
    e = read(spark, d, "events")
    c = Q.changed(e.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.count("*").alias("n_changes"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_events")).join(c, "user_id")


@query("""
SELECT round(sum(n_dedup) / sum(n_raw)::DOUBLE, 9) AS retention, round(sum(n_raw) / sum(duration_s::DOUBLE), 6) AS frame_rate FROM (SELECT DISTINCT ON (key) * FROM cluas_units) WHERE n_raw > 0""")
def retention(spark, d):
    u = _u(spark, d).where("n_raw > 0")
    return u.agg(F.round(F.sum("n_dedup") / F.sum("n_raw"), 9).alias("retention"), F.round(F.sum("n_raw") / F.sum(F.col("duration_s").cast("double")), 6).alias("frame_rate"))


@query("""
SELECT key, len(units) + 2 AS n_ids, coalesce(units[1], 0) + 151936 AS first_id, 152936 AS start_id, 152937 AS end_id FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0)""")
def speech_spans(spark, d):
    u = sequences(spark, d).select("key", Q.speech_span(F.col("units")).alias("s"))
    return u.select("key", F.size("s").cast("long").alias("n_ids"), F.element_at("s", 2).alias("first_id"), F.element_at("s", 1).alias("start_id"), F.element_at("s", -1).alias("end_id"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, units FROM cluas_units WHERE len(units) > 0)
SELECT key, (s // 1024)::INT AS chunk, s::INT AS start, least(1024, len(units) - s)::INT AS size, units[s + 1] AS first FROM u, unnest(range(0, len(units), 1024)) AS r(s)""")
def fixed_chunks(spark, d):
    """Windows of 1,024 units."""
    u = sequences(spark, d)
    return Q.chunks(u, "units", 1024, ["key"]).select("key", "chunk", "start", F.size("part").alias("size"), F.get("part", F.lit(0)).alias("first"))


@query("SELECT DISTINCT ON (key) key, len(units) AS n, md5(array_to_string(units, ',')) AS digest FROM cluas_units WHERE len(units) > 0")
def reassembled_chunks(spark, d):
    """Chunks put together again are what they were."""
    u = sequences(spark, d)
    r = Q.reassembled(Q.chunks(u, "units", 500, ["key"]), "key")
    return r.select("key", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", ",")).alias("digest"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, len(units) AS n FROM cluas_units WHERE len(units) > 0)
SELECT key, (s // 1450)::INT AS win, s::INT AS start, least(s + 1500, n)::INT AS stop FROM u, unnest(range(0, n, 1450)) AS r(s) WHERE s = 0 OR n - s >= 50""")
def sliding_windows(spark, d):
    """Windows of 30 s every 29 s at 50 units a second; slivers within the overlap dropped."""
    u = sequences(spark, d).select("key", F.size("units").alias("n"))
    return Q.sliding(u, "n", 1500, 1450, ["key"]).withColumnRenamed("window", "win")


@query("""
SELECT key, coalesce(array_length(list_filter(units, lambda u: u < 0 OR u >= 1000)), 0)::INT AS n_out, n_dedup IS DISTINCT FROM len(units) AS size_differs FROM (SELECT DISTINCT ON (key) * FROM cluas_units WHERE len(units) > 0)
WHERE n_out > 0 OR size_differs""")
def unit_violations(spark, d):
    """Sequences with ids out of range or a stored size that isn't theirs."""
    u = sequences(spark, d)
    out = u.select("key", F.size(F.filter("units", lambda x: (x < 0) | (x >= Q.UNIT_IDS))).alias("n_out"), (~F.col("n_dedup").eqNullSafe(F.size("units"))).alias("size_differs"))
    return out.where("n_out > 0 or size_differs")


@query("""
SELECT c.snippet_id, c.duration_s, u.n_raw, len(u.units) AS n_units FROM (SELECT DISTINCT ON (snippet_id) * FROM clips) c JOIN (SELECT DISTINCT ON (key) * FROM cluas_units) u ON c.snippet_id = u.key""")
def clips_with_units(spark, d):
    """Clips beside their units."""
    c, u = read(spark, d, "clips").select("snippet_id", F.col("duration_s").alias("d")), _u(spark, d)
    return c.join(u, c.snippet_id == u.key).select("snippet_id", F.col("d").alias("duration_s"), "n_raw", F.when(F.col("units").isNotNull(), F.size("units").cast("long")).alias("n_units"))


@query("SELECT snippet_id FROM clips WHERE snippet_id NOT IN (SELECT key FROM cluas_units WHERE key IS NOT NULL AND len(units) > 0)")
def clips_without_units(spark, d):
    """The gate of the join: clips that have no units."""
    u = read(spark, d, "cluas_units").where(F.size("units") > 0).select(F.col("key").alias("snippet_id"))
    return read(spark, d, "clips").select("snippet_id").join(u, "snippet_id", "left_anti")


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(list_append(list_transform(w, lambda x: length(x)), 0)) AS tok, generate_subscripts(list_append(list_transform(w, lambda x: length(x)), 0), 1) AS i FROM t),
g AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM e)
SELECT (p // 512)::BIGINT AS win, sum(tok)::BIGINT AS total, max(tok)::INT AS longest FROM g GROUP BY ALL HAVING count(*) = 512""")
def packed_windows(spark, d):
    """Documents with a separator after each, laid end to end and cut into windows of 512; the remainder is dropped."""
    t = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.transform(words(F.col("text")), lambda x: F.length(x)), F.array(F.lit(0))).alias("tokens"))
    p = Q.packed(t, "tokens", "doc_id", 512)
    return p.select(F.col("window").alias("win"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("tokens").alias("longest"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, units FROM cluas_units WHERE len(units) > 0),
e AS (SELECT key, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM u),
s AS (SELECT *, sum(CASE WHEN u = 530 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS part FROM e),
p AS (SELECT key, part, count(*) AS n FROM s WHERE u <> 530 OR u IS NULL GROUP BY key, part)
SELECT key, count(*)::INT AS n_parts, max(n)::INT AS longest FROM p GROUP BY key""")
def split_on_separator(spark, d):
    """Streams cut at a separator id, empty parts dropped."""
    u = sequences(spark, d)
    p = u.select("key", Q.split_on(F.col("units"), 530).alias("parts"))
    return p.where(F.size("parts") > 0).select("key", F.size("parts").alias("n_parts"), F.array_max(F.transform("parts", lambda x: F.size(x))).alias("longest"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, units, ('0x' || substr(md5(key), 1, 6))::BIGINT % 40 AS batch FROM cluas_units WHERE len(units) > 0)
SELECT batch, count(*) AS n, (max(len(units)) * count(*))::BIGINT AS n_cells, sum(len(units))::BIGINT AS n_real FROM u GROUP BY batch""")
def padded_batches(spark, d):
    """Ragged members filled up to their batch's longest."""
    u = sequences(spark, d)
    u = u.select("key", "units", F.pmod(F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"), F.lit(40)).alias("batch"))
    p = Q.padded(u, "units", "batch")
    return p.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.size("units").cast("long")).alias("n_cells"), F.sum(F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_real"))


@query("SELECT n, greatest(0, 1024 - 200 - n - 3) AS units_left, (ceil(n / 128.0) * 128)::BIGINT AS rounded FROM range(0, 1000, 37) AS t(n)")
def unit_budgets(spark, d):
    """Units that fit beside a question of n tokens, and sizes rounded up to a multiple of 128."""
    n = spark.range(0, 1000, 37).withColumnRenamed("id", "n")
    return n.select("n", F.greatest(F.lit(0).cast("long"), F.lit(1024 - 200 - 3) - F.col("n")).alias("units_left"), (F.ceil(F.col("n") / 128.0) * 128).cast("long").alias("rounded"))


@query("""
SELECT event_id // 100 AS step_window, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def step_windows(spark, d):
    """Tumbling windows of 100 steps."""
    e = read(spark, d, "events")
    return e.groupBy(F.expr("event_id div 100").alias("step_window")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT event_id // 100 AS step_window, event_type, round(avg(value), 6) AS mean_value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def loss_windows(spark, d):
    """Means by kind over the steps of a window that had it."""
    e = read(spark, d, "events").where("value is not null")
    return e.groupBy(F.expr("event_id div 100").alias("step_window"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that occur more than once."""
    from glasra.operators.gates import duplicates

    return duplicates(read(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, len(units) AS n FROM cluas_units WHERE len(units) > 0)
SELECT key, (s // 1500)::INT AS chunk, least(1500, n - s)::INT AS size FROM u, unnest(range(0, n, 1500)) AS r(s) WHERE n - s >= 400""")
def long_chunks(spark, d):
    """Windows of 30 s at 50 units a second; those under 8 s are too short to learn from."""
    return Q.chunks(sequences(spark, d), "units", 1500, ["key"], 400).select("key", "chunk", F.size("part").alias("size"))


@query("""
SELECT frames, CASE WHEN frames > 0 THEN greatest(0, floor((floor((frames - 1) / 2) + 1 - 2) / 2) + 1) ELSE 0 END::BIGINT AS n_tokens
FROM (SELECT DISTINCT greatest(0, (duration_s * 100)::BIGINT) AS frames FROM aligned_setup WHERE duration_s IS NOT NULL)""")
def audio_token_counts(spark, d):
    """Tokens of an utterance by the length of its mel frames."""
    f = _m(spark, d).where("duration_s is not null").select(F.greatest(F.lit(0).cast("long"), F.bround(F.col("duration_s") * 100).cast("long")).alias("frames")).distinct()
    return f.select("frames", Q.audio_tokens(F.col("frames")).alias("n_tokens"))


@query("""
SELECT event_id // 100 AS step_window, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS events_a_second FROM events GROUP BY 1""")
def throughput_windows(spark, d):
    """Throughput of each logging window of 100 steps by its first and last time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(at) - F.min(at)) / 1e6
    e = read(spark, d, "events").groupBy(F.expr("event_id div 100").alias("step_window"))
    return e.agg(F.count("*").alias("n"), F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 6).alias("events_a_second"))


@query("""SELECT run_id, round(elapsed_sec / nullif(total_corpus_words / 9000.0, 0), 12) AS real_time_factor, round(total_corpus_words / elapsed_sec, 3) AS words_a_second FROM text_token_ratio_report WHERE elapsed_sec > 0""")
def run_rates(spark, d):
    """Time taken by time covered (9,000 words are an hour's speech) and throughput of each run."""
    r = read(spark, d, "text_token_ratio_report").where("elapsed_sec > 0")
    w, t = F.col("total_corpus_words"), F.col("elapsed_sec")
    return r.select("run_id", F.round(t / F.nullif(w / 9000.0, F.lit(0.0)), 12).alias("real_time_factor"), F.round(w / t, 3).alias("words_a_second"))
