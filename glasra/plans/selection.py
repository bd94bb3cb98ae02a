"""More queries on picking, pairing and comparing rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glasra.operators import review as R
from glasra.operators import sampling as S
from glasra.plans.corpus import query
from glasra.plans.manifest import sequences
from glasra.tables import lang_code, read


@query("""
WITH r AS (SELECT label, audio, duration_s, row_number() OVER (PARTITION BY label ORDER BY audio, added_at) AS r FROM aligned_setup WHERE duration_s > 0 AND duration_s <= 6)
SELECT label, audio, duration_s FROM r WHERE r = 1""")
def first_qualifying(spark, d):
    """The first utterance of each label that is short enough: an aggregate after a pushed-down filter."""
    m = read(spark, d, "aligned_setup").where("duration_s > 0 and duration_s <= 6").select("label", "audio", "duration_s", "added_at")
    return m.groupBy("label").agg(F.min_by(F.struct("audio", "duration_s"), F.struct("audio", "added_at")).alias("r")).select("label", "r.audio", "r.duration_s")


@query("""
WITH r AS (SELECT condition, id, row_id, row_number() OVER (PARTITION BY condition, id ORDER BY row_id, decoded_at) AS r FROM decodes) SELECT condition, id, row_id FROM r WHERE r = 1""")
def first_answers(spark, d):
    """The policy that takes what comes first."""
    t = read(spark, d, "decodes").select("condition", "id", "row_id", "hypothesis", "decoded_at")
    return R.best_row(t, ["condition", "id"], R.answer_score("first"), ["row_id", "decoded_at"]).select("condition", "id", "row_id")


@query("""
SELECT row_id, CASE WHEN lower(trim(lang)) IN ('ga', 'gle', 'ga-ie', 'gaeilge') THEN lower(ref) ELSE ref END AS target FROM asr_pairs""")
def target_by_language(spark, d):
    """Which of two columns is the target depends on the row's language."""
    return read(spark, d, "asr_pairs").select("row_id", F.when(lang_code(F.col("lang")) == "ga", F.lower("ref")).otherwise(F.col("ref")).alias("target"))


@query("""
WITH a AS (SELECT row_id, row_number() OVER (ORDER BY row_id, decoded_at) AS o FROM decodes WHERE model = 'ab1'), b AS (SELECT row_id, row_number() OVER (ORDER BY row_id, decoded_at) AS o FROM decodes WHERE model = 'ab4')
SELECT a.row_id AS before_id, b.row_id AS after_id FROM a JOIN b USING (o)""")
def positional_pairs(spark, d):
    """Rows of two runs side by side by their place; places in two levels, no global window."""
    t = read(spark, d, "decodes").groupBy("model", "row_id").agg(F.count("*").cast("int").alias("k"))

    def places(model):
        one = t.where(F.col("model") == model).withColumn("one", F.lit(1))
        at = S.running_total(one, ["one"], "row_id", F.col("k"), "o")
        return at.select("row_id", F.explode(F.sequence(F.col("o"), F.col("o") + F.col("k") - 1)).alias("o"))  # repeated deliveries keep their places

    a, b = places("ab1").withColumnRenamed("row_id", "before_id"), places("ab4").withColumnRenamed("row_id", "after_id")
    return a.join(b, "o").select("before_id", "after_id")


@query("SELECT source, string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM (SELECT DISTINCT source, source || '__rg' || lpad((doc_id // 200)::VARCHAR, 4, '0') AS name FROM documents WHERE source IS NOT NULL) GROUP BY source")
def shard_names(spark, d):
    """Ordered names of each source's shards."""
    t = read(spark, d, "documents").where("source is not null")
    n = t.select("source", F.concat("source", F.lit("__rg"), F.lpad(F.expr("doc_id div 200").cast("string"), 4, "0")).alias("name")).distinct()
    return n.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"))


@query("""
SELECT side, count(*) AS n FROM (
 SELECT 'lost' AS side FROM (SELECT id, lang FROM decodes WHERE model = 'ab1' EXCEPT ALL SELECT id, lang FROM decodes WHERE model = 'ab4')
 UNION ALL SELECT 'made' FROM (SELECT id, lang FROM decodes WHERE model = 'ab4' EXCEPT ALL SELECT id, lang FROM decodes WHERE model = 'ab1')) GROUP BY side""")
def row_differences(spark, d):
    """What each of two runs has that the other lacks, repeated rows counted."""
    from glasra.operators.gates import same_rows

    t = read(spark, d, "decodes")
    a, b = (t.where(F.col("model") == m).select("id", "lang") for m in ("ab1", "ab4"))
    return same_rows(a, b).groupBy("side").agg(F.count("*").alias("n"))


@query("""
SELECT coalesce(lang, '(none)') AS lang, decoder, count(*) AS n, count_if(ref = hyp) AS n_same, count_if(hyp IS NULL) AS n_missing, round(avg(abs(length(hyp) - length(ref))), 6) AS mean_change FROM asr_pairs GROUP BY 1, 2""")
def before_after_cells(spark, d):
    """Changes between two texts in each cell of a report."""
    p = read(spark, d, "asr_pairs").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang"), "decoder")
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("ref") == F.col("hyp")).alias("n_same"), F.count_if(F.col("hyp").isNull()).alias("n_missing"), F.round(F.avg(F.abs(F.length("hyp") - F.length("ref"))), 6).alias("mean_change"))


@query("""
WITH u AS (SELECT DISTINCT ON (key) key, len(units) AS n FROM cluas_units WHERE len(units) > 0)
SELECT key, (s // 2000)::INT AS task, s::INT AS start, least(s + 2000, n)::INT AS stop FROM u, unnest(range(0, n, 2000)) AS r(s)""")
def work_ranges(spark, d):
    """Long items cut into numbered ranges of work."""
    u = sequences(spark, d).select("key", F.size("units").alias("n"))
    t = u.select("key", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(2000))).alias("task", "start"))
    return t.select("key", "task", "start", F.least(F.col("start") + 2000, F.col("n")).alias("stop"))


@query("""
WITH g AS (SELECT id, lang, max(length(hypothesis)) AS n FROM decodes WHERE lang IN ('ga', 'en') GROUP BY id, lang)
SELECT a.id, a.n AS ga_chars, b.n AS en_chars FROM g a JOIN g b ON a.id = b.id AND a.lang = 'ga' AND b.lang = 'en'""")
def bilingual_items(spark, d):
    """Items that both languages have, one row each, by a pivot instead of a self join."""
    g = read(spark, d, "decodes").where(F.col("lang").isin("ga", "en"))
    p = R.pivoted(g, "id", "lang", F.max(F.length("hypothesis")), ["ga", "en"])
    both = g.groupBy("id").agg(F.countDistinct("lang").alias("k")).where("k = 2").select("id")
    return p.join(both, "id").select("id", F.col("ga").cast("long").alias("ga_chars"), F.col("en").cast("long").alias("en_chars"))


def file_report(spark, d):
    """Bytes of each table's files beside its rows, from listings and footers."""
    from glasra.sources.files import file_sizes

    out = None
    for t in ("documents", "asr_pairs", "decodes", "packets"):
        one = file_sizes(spark, f"{d}/{t}.parquet").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes")).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out.select("table", "n_files", "bytes")


query()(file_report)
