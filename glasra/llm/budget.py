"""Problem 2: tokens of each document under an existing tokenizer, and totals by source, language and domain.

A worker loads the tokenizer once and encodes documents in batches (see bpe); exact counts, no estimate per document. The
totals are one cube over the three labels, partial sums first, so no source is ever in one task however large it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasra.llm.bpe import TOKENIZER_DIR, token_counts
from glasra.tables import lang_code, read, source_name, spread, word_count

LABELS = ("source", "lang", "domain")


def document_tokens(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id, source, lang, domain, n_words, n_chars, n_tokens`: labels in one spelling, null where missing; null and empty texts have 0."""
    d = docs.select(
        docs[key].alias("doc_id"),
        source_name(docs["source"]).alias("source"),
        lang_code(docs["lang"]).alias("lang"),
        docs["domain"].alias("domain"),
        word_count(docs[text]).alias("n_words"),
        F.coalesce(F.length(docs[text]), F.lit(0)).cast("long").alias("n_chars"),
        *[docs[c] for c in carry],
        docs[text].alias("text"),
    )
    return token_counts(d, "text", vocabulary, tokenizer_dir, carry=("doc_id", *LABELS, "n_words", "n_chars", *carry))


def stored_tokens(docs: DataFrame, path: str, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR, key: str = "doc_id") -> DataFrame:
    """`document_tokens` of `docs` from a store of counts at `path`, a folder of the shared file system; only what it lacks is encoded and added.

    A count belongs to a key, a hash of the text with its labels, and the vocabulary, so a changed document is counted anew. What
    meets the store are keys and hashes; texts are moved only for documents that it lacks, and not at all where it is empty.
    """
    spark = docs.sparkSession
    d = docs.select("*", F.xxhash64(docs[text], docs["source"], docs["lang"], docs["domain"], F.lit(vocabulary)).alias("_of"))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    lacking = d
    if there:
        known = spark.read.parquet(path).select("doc_id", "_of")
        same = d[key].eqNullSafe(known["doc_id"]) & (d["_of"] == known["_of"])
        lacking = d.join(known, same, "left_anti")
    counted = document_tokens(lacking, text, vocabulary, tokenizer_dir, key, carry=("_of",))
    counted.write.mode("append").parquet(path)
    store = spark.read.parquet(path)
    wanted = d.select(d[key].alias("_key"), F.col("_of").alias("_hash"))
    mine = store.dropDuplicates(["doc_id", "_of"])
    return wanted.join(mine, wanted["_key"].eqNullSafe(mine["doc_id"]) & (wanted["_hash"] == mine["_of"])).select(*[c for c in mine.columns if c != "_of"])


def token_cube(tokens: DataFrame) -> DataFrame:
    """Totals for every combination of the labels, with `level` telling which are summed over (GROUPING_ID); a missing label reads `(none)`."""
    t = tokens.select(*[F.coalesce(c, F.lit("(none)")).alias(c) for c in LABELS], "n_words", "n_chars", "n_tokens")
    out = t.cube(*LABELS).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n_docs"),
        F.sum("n_words").alias("n_words"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    return out.withColumn("tokens_per_word", F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")))


def latest_report(report: DataFrame, model: str | None = "tok-8b") -> DataFrame:
    """`source, report_words, report_tokens_per_word, report_est_tokens` of the latest run; a source without sample has no ratio."""
    runs = report.where(F.col("model") == model) if model else report
    last = runs.agg(F.max_by(F.struct("run_id", "pooled_tokens_per_word", "per_source"), F.struct("created_at", "run_id")).alias("r")).select("r.*")
    s = last.select("run_id", "pooled_tokens_per_word", F.explode("per_source").alias("source", "v"))
    ratio = F.when(F.isnan("v.tokens_per_word") | (F.col("v.sample_words") == 0), None).otherwise(F.col("v.tokens_per_word"))
    return s.select(source_name(F.col("source")).alias("source"), "run_id", "pooled_tokens_per_word", F.col("v.total_words").alias("report_words"), ratio.alias("report_tokens_per_word"))


def p2_cube(spark, sf_dir: str) -> DataFrame:
    return token_cube(document_tokens(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "domain"))))


def p2_documents(spark, sf_dir: str) -> DataFrame:
    return document_tokens(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "domain")))


def p2_against_report(spark, sf_dir: str) -> DataFrame:
    """Measured tokens per word of each source beside the report's, and what the report's words come to at the measured rate."""
    own = document_tokens(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "domain"))).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
    own = own.withColumn("tokens_per_word", F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")))
    rep = latest_report(read(spark, sf_dir, "text_token_ratio_report"))
    out = own.join(rep, "source", "full_outer")
    rate = F.coalesce("report_tokens_per_word", "pooled_tokens_per_word")
    return out.withColumn("report_est_tokens", F.col("report_words") * rate).withColumn("est_tokens", F.col("report_words") * F.col("tokens_per_word"))


SQL: dict[str, str] = {}
