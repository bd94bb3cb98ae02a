"""Reading the project's tables, and the spellings that several operators have to agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of language names and codes, lower case, by two-letter code.
LANG_CODES = {
    "ga": ("ga", "gle", "gai", "iri", "irish", "gaeilge"),
    "en": ("en", "eng", "english", "béarla", "bearla"),
    "gd": ("gd", "gla", "gàidhlig", "gaidhlig", "scottish gaelic", "scots gaelic"),
    "cy": ("cy", "cym", "wel", "welsh", "cymraeg"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lang_code(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null for a missing one, the label itself for one not known.

    Region and script suffixes (ga-IE, en_GB) are dropped.
    """
    s = F.lower(F.trim(label))
    base = F.regexp_extract(s, r"^([^-_]+)", 1)
    code = F.when(s.isNull() | s.isin("", "und", "unknown", "null", "none"), F.lit(None).cast("string"))
    for c, names in LANG_CODES.items():
        code = code.when(s.isin(*names) | base.isin(*names), F.lit(c))
    return code.otherwise(s)


def source_name(source: Column) -> Column:
    """Source in one spelling: lower case, no file ending, no blanks, `_` between parts; null stays null.

    `uni-archives` and `uni_archives` are one source, in the spelling of the targets.
    """
    s = F.regexp_replace(F.lower(F.trim(source)), r"(\.parquet|\.jsonl|\.json|\.txt)$", "")
    s = F.regexp_replace(s, r"[\s\-]+", "_")
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def word_count(text: Column) -> Column:
    """Words between white space, as Unicode has it; 0 for null."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), " ")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), F.size(parts)).otherwise(0).cast("long")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if its files give fewer than half as many partitions, for work that costs far more than its reading.

    Large inputs have more partitions than cores, and pass as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
