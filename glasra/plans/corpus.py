"""Corpus queries: profiles, estimates, budgets, subsets and splits, each with its SQL."""

from __future__ import annotations

import os

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasra.functions.text import n_words, word_tokenizer
from glasra.operators import sampling as S
from glasra.session import checkpointed
from glasra.tables import read, source_name, spread

#: A public tokenizer's file, unless the environment names another.
TOKENIZER = os.environ.get("GLASRA_WORD_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")

QUERIES: dict = {}
SQL: dict = {}

#: Source in one spelling, as `source_name` has it.
SOURCE_SQL = r"regexp_replace(regexp_replace(lower(trim(source)), '(\.parquet|\.jsonl|\.json|\.txt)$', ''), '[\s\-]+', '_', 'g')"
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\v\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+'), lambda x: x <> ''))"
_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}]+|\p{N}|[^\s\p{L}\p{N}]'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _counted(spark, d, *columns, where="true"):
    """The given columns, words and bytes of the documents, cut from their lineage: texts are read and split once, whatever follows."""
    t = spread(read(spark, d, "documents").where(where).select("doc_id", "source", "text"))
    return checkpointed(t.select(*columns, n_words(F.col("text")).alias("n_words"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")))


def _docs(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "source", "text")).withColumn("n_words", n_words(F.col("text")))


def _tokens():
    """Stand-in tokenizer of one pattern, built in; the llm subpackage counts by real vocabularies."""
    return F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}]+|\p{N}|[^\s\p{L}\p{N}])"), 1)).cast("long")


@query(f"""
WITH s AS (SELECT source, count(*) AS total_rows, sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE 1 END) AS n_docs,
  sum({_WORDS})::BIGINT AS total_words, sum(length(coalesce(text, '')))::BIGINT AS total_chars, sum({_TOKENS})::BIGINT AS total_tokens
  FROM documents GROUP BY source)
SELECT *, round(total_tokens / nullif(total_words, 0)::DOUBLE, 6) AS tokens_per_word, round(total_words / nullif(total_tokens, 0)::DOUBLE, 6) AS words_per_token,
  round(total_chars / sum(total_chars) OVER ()::DOUBLE, 6) AS size_frac FROM s""")
def corpus_profile(spark, d):
    """Rows, words, characters and tokens of each source, their ratios and the source's share of all text."""
    g = (
        _docs(spark, d)
        .groupBy("source")
        .agg(
            F.count("*").alias("total_rows"),
            F.sum(F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(1)).alias("n_docs"),
            F.sum("n_words").alias("total_words"),
            F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long")).alias("total_chars"),
            F.sum(_tokens()).alias("total_tokens"),
        )
    )
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return g.withColumns(
        {
            "tokens_per_word": ratio("total_tokens", "total_words"),
            "words_per_token": ratio("total_words", "total_tokens"),
            "size_frac": F.round(F.col("total_chars") / F.sum("total_chars").over(W.partitionBy(F.lit(1))), 6),  # a row a source
        }
    )


_ACCEPT = "('0x' || substr(md5('ratio:' || doc_id::VARCHAR), 1, 8))::BIGINT < p * 4294967296.0"


@query(f"""
WITH b AS (SELECT source, doc_id, {_WORDS} AS w, {_TOKENS} AS t, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents WHERE source IS NOT NULL),
p AS (SELECT source, CASE WHEN sum(bytes) < 20000 THEN 1.0 ELSE least(1.0, 20000.0 / (sum(bytes) / 7.0)) END AS p FROM b GROUP BY source),
s AS (SELECT source, sum(w)::BIGINT AS total_words, sum(CASE WHEN {_ACCEPT} THEN w ELSE 0 END)::BIGINT AS sample_words, sum(CASE WHEN {_ACCEPT} THEN t ELSE 0 END)::BIGINT AS sample_tokens
  FROM b JOIN p USING (source) GROUP BY source)
SELECT source, total_words, sample_words, sample_tokens, round(CASE WHEN sample_words > 0 THEN total_words * (sample_tokens / sample_words::DOUBLE) ELSE 0 END, 3) AS est_tokens FROM s
UNION ALL SELECT '(all)', sum(total_words)::BIGINT, sum(sample_words)::BIGINT, sum(sample_tokens)::BIGINT,
  round(sum(CASE WHEN sample_words > 0 THEN total_words * (sample_tokens / sample_words::DOUBLE) ELSE 0 END), 3) FROM s""")
def stratified_token_estimate(spark, d):
    """Each source's words times the token ratio of its sample; small sources whole, larger ones by hash acceptance."""
    b = _counted(spark, d, "source", "doc_id", _tokens().alias("t"), where="source is not null")
    total = b.groupBy("source").agg(F.sum("bytes").alias("all_bytes"))
    p = total.select("source", F.when(F.col("all_bytes") < 20000, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(20000.0) / (F.col("all_bytes") / 7.0))).alias("p"))
    j = b.join(p, "source")
    ok = S.accept(F.col("doc_id"), F.col("p"), "ratio")
    s = j.groupBy("source").agg(F.sum("n_words").alias("total_words"), F.sum(F.when(ok, F.col("n_words")).otherwise(0)).alias("sample_words"), F.sum(F.when(ok, F.col("t")).otherwise(0)).alias("sample_tokens"))
    s = s.withColumn("est", F.when(F.col("sample_words") > 0, F.col("total_words") * (F.col("sample_tokens") / F.col("sample_words"))).otherwise(0.0))
    out = s.rollup("source").agg(*[F.sum(c).alias(c) for c in ("total_words", "sample_words", "sample_tokens")], F.round(F.sum("est"), 3).alias("est_tokens"), F.grouping("source").alias("g"))
    return out.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("source")).alias("source"), "total_words", "sample_words", "sample_tokens", "est_tokens")


@query("""
SELECT run_id, e.key AS source, e.value.total_words AS total_words, e.value.sample_words AS sample_words,
  CASE WHEN isnan(e.value.tokens_per_word) THEN NULL ELSE round(e.value.tokens_per_word, 9) END AS tokens_per_word,
  round(e.value.file_bytes / sum(e.value.file_bytes) OVER (PARTITION BY run_id)::DOUBLE, 9) AS size_frac
FROM (SELECT run_id, unnest(map_entries(per_source)) AS e FROM text_token_ratio_report)""")
def ratio_report_rows(spark, d):
    """The report's nested map as rows, NaN as null."""
    r = read(spark, d, "text_token_ratio_report").select("run_id", F.explode("per_source").alias("source", "v"))
    w = W.partitionBy("run_id")  # a row a source of a run
    return r.select(
        "run_id",
        "source",
        F.col("v.total_words").alias("total_words"),
        F.col("v.sample_words").alias("sample_words"),
        F.when(F.isnan("v.tokens_per_word"), None).otherwise(F.round("v.tokens_per_word", 9)).alias("tokens_per_word"),
        F.round(F.col("v.file_bytes") / F.sum("v.file_bytes").over(w), 9).alias("size_frac"),
    )


@query(f"""
WITH b AS (SELECT doc_id, source, {_WORDS} AS n_words FROM documents WHERE source IS NOT NULL AND text <> ''),
c AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, source, n_words::BIGINT AS n_words FROM c WHERE before < 5000""")
def word_budget_prefix(spark, d):
    """Documents of each source in order until 5,000 words are reached, the crossing one included."""
    b = _counted(spark, d, "doc_id", "source", where="source is not null and text <> ''").drop("bytes")
    return S.budget_prefix(b, ["source"], "doc_id", F.col("n_words"), F.lit(5000))


@query(f"""
WITH b AS (SELECT doc_id, source, doc_id // 250 AS rg, {_WORDS} AS n_words FROM documents WHERE source IS NOT NULL AND text <> ''),
t AS (SELECT source, greatest(1, ceil(6000.0 / count(DISTINCT rg))) AS slice FROM b GROUP BY source),
c AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source, rg ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN t USING (source))
SELECT source, rg, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words FROM c WHERE before < slice GROUP BY source, rg""")
def row_group_budget(spark, d):
    """A source's budget cut evenly over its row groups (blocks of 250 ids here)."""
    b = _counted(spark, d, "doc_id", "source", F.expr("doc_id div 250").alias("rg"), where="source is not null and text <> ''").drop("bytes")
    t = b.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.lit(6000.0) / F.greatest(F.lit(1), F.countDistinct("rg")))).alias("slice"))
    out = S.budget_prefix(b.join(t, "source"), ["source", "rg"], "doc_id", F.col("n_words"), F.col("slice"))
    return out.groupBy("source", "rg").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


@query(f"""
WITH b AS (SELECT doc_id, source, {_WORDS} AS n_words, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents WHERE source IS NOT NULL),
t AS (SELECT source, sum(n_words) AS words, 20000.0 * sum(bytes) / sum(sum(bytes)) OVER () AS target FROM b GROUP BY source),
s AS (SELECT source, target, greatest(1, round_even(words / (3.0 * target), 0))::BIGINT AS stride FROM t WHERE target > 0),
o AS (SELECT b.*, s.target, s.stride, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM b JOIN s USING (source)),
k AS (SELECT * FROM o WHERE ordinal % stride = 0 AND n_words > 0),
c AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT source, stride, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words FROM c WHERE before < target GROUP BY source, stride""")
def proportional_stride_sample(spark, d):
    """Targets in proportion to bytes, reached by every n-th document; ordinals count empty rows too."""
    b = _counted(spark, d, "doc_id", "source", where="source is not null")
    t = b.groupBy("source").agg(F.sum("n_words").alias("words"), F.sum("bytes").alias("sb"))
    t = t.withColumn("target", F.lit(20000.0) * F.col("sb") / F.sum("sb").over(W.partitionBy(F.lit(1)))).where("target > 0")  # a row a source
    t = t.select("source", "target", F.greatest(F.lit(1), F.bround(F.col("words") / (3.0 * F.col("target")))).cast("long").alias("stride"))
    o = S.ordinal(b.join(t, "source"), ["source"], "doc_id")
    k = checkpointed(o.where("ordinal % stride = 0 and n_words > 0").drop("ordinal"))
    out = S.budget_prefix(k, ["source"], "doc_id", F.col("n_words"), F.col("target"))
    return out.groupBy("source", "stride").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


@query(f"""
WITH b AS (SELECT doc_id, source, doc_id // 256 AS batch, {_WORDS} AS n_words, ('0x' || substr(sha256('7:' || (doc_id // 256)::VARCHAR || ':' || doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents WHERE source IS NOT NULL),
c AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source, batch ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, source, batch, n_words::BIGINT AS n_words FROM c WHERE before < 500""")
def batch_shuffle_budget(spark, d):
    """Batches of 256 shuffled by hash, each taken up to its budget."""
    b = _counted(spark, d, "doc_id", "source", F.expr("doc_id div 256").alias("batch"), where="source is not null")
    b = b.select("doc_id", "source", "batch", "n_words", F.conv(F.substring(S.sha_rank("7", F.col("batch"), F.col("doc_id")), 1, 12), 16, 10).cast("long").alias("h"))
    return S.running_total(b, ["source", "batch"], "h", F.col("n_words"), "before", 1 << 40).where("before < 500").select("doc_id", "source", "batch", "n_words")


@query(f"""
WITH b AS (SELECT doc_id, {_WORDS} AS n_words, ('0x' || substr(sha256('11:' || doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents WHERE text <> ''),
c AS (SELECT *, coalesce(sum(n_words) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, n_words::BIGINT AS n_words FROM c WHERE before < 30000""")
def permuted_budget(spark, d):
    """All documents in hash order up to a budget; the running total goes over blocks of hashes."""
    b = _counted(spark, d, "doc_id", where="text <> ''").select("doc_id", "n_words", F.conv(F.substring(S.sha_rank("11", F.col("doc_id")), 1, 12), 16, 10).cast("long").alias("h"), F.lit(1).alias("one"))
    return S.running_total(b, ["one"], "h", F.col("n_words"), "before").where("before < 30000").select("doc_id", "n_words")


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id LIMIT 100")
def sha256_subset(spark, d):
    """The 100 ids of least SHA-256."""
    return S.hash_subset(read(spark, d, "documents").select("doc_id"), "doc_id", 100, "42")


@query("""
WITH q AS (SELECT domain, doc_id, row_number() OVER (PARTITION BY domain ORDER BY sha256('7:' || domain || ':' || doc_id::VARCHAR), doc_id) AS r FROM documents WHERE domain IS NOT NULL),
k AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT domain FROM documents WHERE domain IS NOT NULL))
SELECT domain, doc_id FROM q JOIN k USING (domain) WHERE r <= 95 // k + CASE WHEN i < 95 % k THEN 1 ELSE 0 END""")
def stratified_subset(spark, d):
    """95 documents spread evenly over domains by seeded hash; the first domains take the remainder."""
    return S.even_quota(read(spark, d, "documents").where("domain is not null").select("domain", "doc_id"), "domain", "doc_id", 95, "7")


@query("""
WITH q AS (SELECT coalesce(c.year, 0) AS year, json_extract_string(e, '$.question_id') AS qid, c.snippet_id FROM clips c, unnest(CAST(c.questions_json AS JSON[])) AS u(e)),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY sha256('13:' || year::VARCHAR || ':' || qid || ':' || snippet_id), qid) AS r FROM q),
k AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT year FROM q))
SELECT year, qid AS question_id FROM r JOIN k USING (year) WHERE r <= 33 // k + CASE WHEN i < 33 % k THEN 1 ELSE 0 END""")
def stratified_questions(spark, d):
    """33 questions over all years."""
    from glasra.operators.review import questions

    q = questions(read(spark, d, "clips")).select("year", "question_id", F.concat_ws(":", "question_id", "snippet_id").alias("k"))
    return S.even_quota(q, "year", "k", 33, "13").select("year", "question_id")


_DIGITS = "list_sum(list_transform(string_split(md5(audio), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ('0x' || c)::INT END))"


@query(f"SELECT audio, label, (right(md5(audio), 1) IN ('0', '8') AND ({_DIGITS})::INT % 5 = 0) AS held_out FROM aligned_setup WHERE audio IS NOT NULL")
def md5_holdout(spark, d):
    """Hold-out of one path in forty."""
    a = read(spark, d, "aligned_setup").where("audio is not null")
    return a.select("audio", "label", S.held_out(F.col("audio")).alias("held_out"))


@query("""
WITH r AS (SELECT DISTINCT regexp_replace(audio, '_[0-9]+\\.wav$', '') AS recording FROM aligned_setup)
SELECT recording, ('0x' || substr(md5('split:' || recording), 1, 8))::BIGINT % 20 = 0 AS validation FROM r""")
def recording_split(spark, d):
    """Validation split that never parts a recording."""
    r = read(spark, d, "aligned_setup").select(F.regexp_replace("audio", r"_[0-9]+\.wav$", "").alias("recording")).distinct()
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), "recording")), 1, 8), 16, 10).cast("long")
    return r.select("recording", (h % 20 == 0).alias("validation"))


@query("""
WITH s AS (SELECT id, model, row_number() OVER (PARTITION BY model ORDER BY id, row_id) AS r FROM decodes)
SELECT model, id, CASE WHEN r <= 3 THEN 'demo' ELSE 'test' END AS part FROM s""")
def demo_test_split(spark, d):
    """The first three rows of each model are demonstrations."""
    t = S.first_rows(read(spark, d, "decodes").select("model", "id", "row_id"), ["model"], ["id", "row_id"], 3)
    return t.select("model", "id", F.when(F.col("is_first"), "demo").otherwise("test").alias("part"))


@query("""
WITH l AS (SELECT id, condition, max(generated_tokens) AS n FROM decodes WHERE condition IN ('asr_ga', 'asr_en') GROUP BY id, condition),
p AS (SELECT id, max(n) AS longest FROM l GROUP BY id HAVING count(DISTINCT condition) = 2),
r AS (SELECT *, row_number() OVER (ORDER BY longest, id) AS shortest FROM p)
SELECT id, longest::INT AS longest, CASE WHEN shortest <= 3 THEN 'demo' WHEN longest <= 200 THEN 'scored' ELSE 'too long' END AS part FROM r""")
def common_eligibility(spark, d):
    """Items that both languages have: three shortest as demonstrations, the others scored if both fit. Ids are a fixed set."""
    l = read(spark, d, "decodes").where(F.col("condition").isin("asr_ga", "asr_en")).groupBy("id", "condition").agg(F.max("generated_tokens").alias("n"))
    p = l.groupBy("id").agg(F.max("n").alias("longest"), F.count("*").alias("k")).where("k = 2").drop("k")
    demos = p.orderBy("longest", "id").limit(3).select("id", F.lit(True).alias("demo"))
    part = F.when(F.col("demo"), "demo").when(F.col("longest") <= 200, "scored").otherwise("too long")
    return p.join(F.broadcast(demos), "id", "left").select("id", "longest", part.alias("part"))


@query("SELECT doc_id, doc_id % 4 AS rank, (doc_id // 4) % 2 AS worker FROM documents")
def rank_shards(spark, d):
    """Rows dealt to four ranks of two workers."""
    return read(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(4)).alias("rank"), F.pmod(F.expr("doc_id div 4"), F.lit(2)).alias("worker"))


@query("""
WITH s AS (SELECT range AS step, row_number() OVER (ORDER BY sha256('5:' || range::VARCHAR), range) AS r FROM range(8047))
SELECT step, CASE WHEN r <= round_even(8047 * 0.25, 0) THEN 'audio' ELSE 'text' END AS modality FROM s""")
def modality_schedule(spark, d):
    """A quarter of the steps, exactly and without replacement, are audio."""
    s = S.schedule(spark.range(8047).withColumnRenamed("id", "step"), "step", 0.25, "5")
    return s.select("step", F.when(F.col("picked"), "audio").otherwise("text").alias("modality"))


@query(f"""
WITH b AS (SELECT doc_id, {SOURCE_SQL} AS source, {_WORDS} AS n_words FROM documents WHERE text <> ''),
q AS (SELECT * FROM (VALUES ('hplt3_mono', 0.4), ('finepdfs', 0.4), ('nce', 0.2)) AS t(source, weight)),
c AS (SELECT b.*, weight, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN q USING (source))
SELECT source, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words FROM c WHERE before < 10000 * weight GROUP BY source""")
def stream_quota(spark, d):
    """Streams of weights 0.4, 0.4 and 0.2 filled up to their share of a budget."""
    q = spark.createDataFrame([("hplt3_mono", 0.4), ("finepdfs", 0.4), ("nce", 0.2)], "source string, weight double")
    b = _counted(spark, d, "doc_id", source_name(F.col("source")).alias("source"), where="text <> ''").drop("bytes").join(q, "source")
    out = S.budget_prefix(b, ["source"], "doc_id", F.col("n_words"), F.lit(10000) * F.col("weight"))
    return out.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


@query(f"SELECT doc_id, source FROM documents WHERE {SOURCE_SQL} IS DISTINCT FROM 'nce'")
def skip_existing(spark, d):
    """Work that has no output yet: one source is done and written, the others come out of an anti join with what is there."""
    from glasra.session import scratch

    p = scratch(spark, "done")
    t = read(spark, d, "documents").select("doc_id", "source")
    t.where(source_name(F.col("source")) == "nce").write.parquet(p)
    return t.join(spark.read.parquet(p).select("doc_id"), "doc_id", "left_anti")


def tokenizer_estimate(spark, d):
    """Each source's words times the tokens a word of its sample, by a real tokenizer over the sampled texts only."""
    from glasra.functions.text import counted_tokens

    if os.path.exists(TOKENIZER):
        spark.sparkContext.addFile(TOKENIZER)
    b = spread(read(spark, d, "documents").where("source is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text"))
    w = checkpointed(b.select("doc_id", "source", n_words(F.col("text")).alias("n_words"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")))
    p = w.groupBy("source").agg(F.sum("n_words").alias("total_words"), F.sum("bytes").alias("all"))
    p = p.withColumn("p", F.when(F.col("all") < 20000, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(20000.0) / (F.col("all") / 7.0))))
    sample = b.join(p, "source").where(S.accept(F.col("doc_id"), F.col("p"), "ratio")).select("source", n_words(F.col("text")).alias("w"), counted_tokens(F.col("text"), word_tokenizer(TOKENIZER)).alias("t"))
    s = sample.groupBy("source").agg(F.sum("w").alias("sample_words"), F.sum("t").alias("sample_tokens"))
    ratio = F.col("sample_tokens") / F.nullif(F.col("sample_words"), F.lit(0))
    return p.join(s, "source", "left").select("source", "total_words", "sample_words", "sample_tokens", F.round(F.coalesce(F.col("total_words") * ratio, F.lit(0.0)), 3).alias("est_tokens"))


query()(tokenizer_estimate)


@query("SELECT DISTINCT audio FROM asr_pairs WHERE audio NOT IN (SELECT audio FROM aligned_setup WHERE audio IS NOT NULL)")
def missing_audio(spark, d):
    """Audio of pairs that the manifest doesn't have."""
    return read(spark, d, "asr_pairs").select("audio").where("audio is not null").distinct().join(read(spark, d, "aligned_setup").select("audio"), "audio", "left_anti")


@query("SELECT row_id, audio, decoder FROM asr_pairs WHERE audio IN (SELECT audio FROM aligned_setup)")
def present_audio(spark, d):
    """Pairs whose audio the manifest has."""
    return read(spark, d, "asr_pairs").select("row_id", "audio", "decoder").join(read(spark, d, "aligned_setup").select("audio"), "audio", "left_semi").select("row_id", "audio", "decoder")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('gd', 'cy', 'fr') AND source IN ('hplt3_mono', 'finepdfs')")
def id_list_filter(spark, d):
    """Membership in given lists, pushed down to the scan."""
    return read(spark, d, "documents").where(F.col("lang").isin("gd", "cy", "fr") & F.col("source").isin("hplt3_mono", "finepdfs")).select("doc_id", "lang")


@query("SELECT item_id, suite, text FROM eval_items ORDER BY item_id LIMIT 100")
def head_by_id(spark, d):
    """A fixed head after sorting by id."""
    return read(spark, d, "eval_items").orderBy("item_id").limit(100).select("item_id", "suite", "text")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS place FROM documents")
def sort_as_text(spark, d):
    """Every id with its place from 0 among all ids sorted as strings, by code points."""
    return S.placed(read(spark, d, "documents").select("doc_id"), F.col("doc_id").cast("string"), "place")
