"""Problem 1: a sample that stays as it is when data grow, by nested hash buckets.

Each key belongs for good to one of 4,096 fine buckets by its hash. A fixed permutation orders the buckets; a sample of a given
share is the first so many buckets of that order. A larger share appends buckets and keeps those it had, and new rows fall into
buckets without moving others. Only built-in expressions are used: no shuffle, no state, the same rows in any layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasra.tables import read

#: Fine buckets, and the permutation bucket -> (STEP * bucket + SHIFT) mod BUCKETS; an odd step makes it one-to-one.
BUCKETS, STEP, SHIFT = 4096, 2477, 1013
#: One recording path in forty.
SHARE = 1 / 40


def path_key(audio: Column) -> Column:
    """A path in one spelling: forward slashes, no `.`, `..` or empty parts at its start or between, no blanks around, lower case."""
    s = F.regexp_replace(F.lower(F.trim(audio)), r"\\", "/")
    s = F.regexp_replace(s, r"^file:", "")
    s = F.regexp_replace(s, r"/+", "/")
    s = F.regexp_replace(s, r"/(\./)+", "/")
    s = F.regexp_replace(s, r"^(\./)+|^/", "")
    # `..` takes the part before it away, and nothing at the start
    up = F.aggregate(F.split(s, "/"), F.lit(""), lambda done, part: F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part)))
    s = F.when(s.rlike(r"(^|/)\.\.(/|$)"), F.regexp_replace(up, "^/", "")).otherwise(s)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def bucket(key: Column, seed: str = "") -> Column:
    """Fine bucket of a key: its first 48 bits of MD5 modulo BUCKETS."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 12), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")


def turn(b: Column) -> Column:
    """Place of a bucket in the fixed order in which buckets are selected."""
    return F.pmod(b * F.lit(STEP) + F.lit(SHIFT), F.lit(BUCKETS)).cast("int")


def stable_sample(df: DataFrame, key: Column, share: float = SHARE, seed: str = "") -> DataFrame:
    """Rows of `df` whose key falls into the first `share` of the buckets; all rows of a key go together.

    A null key is never chosen. Repeated rows stay repeated. Columns of `df` are kept as they are.
    """
    return df.where(F.coalesce(turn(bucket(key, seed)) < F.lit(round(share * BUCKETS)), F.lit(False)))


def p1_sample(spark, sf_dir: str) -> DataFrame:
    """Chosen deliveries with their key and bucket."""
    a = read(spark, sf_dir, "aligned_setup")
    key = path_key(F.col("audio"))
    return stable_sample(a, key).select(key.alias("audio_key"), bucket(key).alias("bucket"), "audio", "label", "batch", "duration_s", "text", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added"))


def p1_by_batch(spark, sf_dir: str) -> DataFrame:
    """What the sample has of each delivery."""
    a = read(spark, sf_dir, "aligned_setup").withColumn("audio_key", path_key(F.col("audio")))
    a = a.withColumn("chosen", F.coalesce(turn(bucket(F.col("audio_key"))) < round(SHARE * BUCKETS), F.lit(False)))
    return a.groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum(F.col("chosen").cast("long")).alias("n_chosen"))


_PATH_SQL = r"""
  (regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(audio)), '\', '/'), '^file:', ''), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+|^/', '', 'g'))
"""
_KEY_SQL = rf"""
  nullif(CASE WHEN regexp_matches({_PATH_SQL}, '(^|/)\.\.(/|$)') THEN
    ltrim(list_reduce(list_prepend('', string_split({_PATH_SQL}, '/')), lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END), '/')
    ELSE {_PATH_SQL} END, '')
"""
_BUCKET_SQL = "(('0x' || substr(md5(audio_key), 1, 12))::BIGINT % 4096)"
SQL = {
    "p1_sample": f"""
WITH k AS (SELECT {_KEY_SQL} AS audio_key, * FROM aligned_setup),
b AS (SELECT {_BUCKET_SQL}::INT AS bucket, * FROM k WHERE audio_key IS NOT NULL)
SELECT audio_key, bucket, audio, label, batch, duration_s, text, strftime(added_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS added
FROM b WHERE (bucket * 2477 + 1013) % 4096 < 102""",
    "p1_by_batch": f"""
WITH k AS (SELECT {_KEY_SQL} AS audio_key, batch FROM aligned_setup)
SELECT batch, count(*) AS n_rows,
  sum(CASE WHEN audio_key IS NOT NULL AND ({_BUCKET_SQL} * 2477 + 1013) % 4096 < 102 THEN 1 ELSE 0 END)::BIGINT AS n_chosen
FROM k GROUP BY batch""",
}
