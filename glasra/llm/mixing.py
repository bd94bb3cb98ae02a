"""Problem 5: a training set whose sources have target shares of its size, by a multivariate-hypergeometric splitting tree.

Sizing. Documents are counted in words once. Each source falls into blocks by a hash of the key, at least BLOCKS of them and so
many that a block has some BLOCK_ROWS documents at most; blocks are the unit of the plan, so what is planned is a row for each. The
size is the budget, or as much of it as the scarcest source lets be reached with all shares exact. A source is taken in full passes and a last part, in
the order of a seeded permutation of its blocks; within the block where a quota ends, documents go in hash order to the last
word that fits.

Splitting. The blocks drawn from each source are spread over the output shards by a binary tree: at each node the left half
gets a multivariate hypergeometric draw of its blocks, so all sources reach every shard in proportion up to chance and the
quotas stay exact. A shard takes the next blocks of each source's permutation: draws are disjoint. Each shard is shuffled by
hash on its own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasra.session import checkpointed
from glasra.tables import read, source_name, word_count

#: Least blocks of a source, and documents of a block of a larger source. The plan has a row for each block and pass.
BLOCKS, BLOCK_ROWS = 1024, 50_000
SHARDS = 16


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`doc_id, source, words, hash, ord`: documents with at least one word and a known source."""
    d = docs.select(docs[key].alias("doc_id"), source_name(docs[source]).alias("source"), word_count(docs[text]).alias("words")).where("source is not null and words > 0")
    return d.withColumn("hash", F.xxhash64("doc_id", F.lit(17))).withColumn("ord", F.xxhash64("doc_id", F.lit(71)))


def in_blocks(sizes: DataFrame, sources: list[str]) -> DataFrame:
    """Documents of the given sources with their `block`."""
    d = sizes.where(F.col("source").isin(sources))
    many = {r.source: -(-r.n // BLOCK_ROWS) for r in d.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row a target
    n = F.lit(BLOCKS)
    for s, k in many.items():
        n = F.when(F.col("source") == s, F.lit(k)).otherwise(n) if k > BLOCKS else n
    return d.withColumn("block", F.pmod("hash", n).cast("int")).drop("hash")


def split_counts(counts: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Spread `counts` blocks of each source over the shards; each shard has an even share of all blocks, sources by chance."""
    if shards == 1:
        return [counts]
    left = shards // 2
    total = int(counts.sum())
    take = rng.multivariate_hypergeometric(counts, total * left // shards) if total else counts * 0
    return split_counts(take, left, rng) + split_counts(counts - take, shards - left, rng)


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]], budget: int) -> dict[str, int]:
    """Words of each source: exact shares of the budget, or of the largest size that no source exceeds.

    A source that isn't there, or of share 0, gives nothing, and its share then counts as missing: the others keep their
    proportions. Shares are of those targets that can be met at all.
    """
    usable = [(s, p, r) for s, p, r in targets if p > 0 and r > 0 and available.get(s, 0) > 0]
    whole = sum(p for _, p, _ in usable)
    if not usable or budget <= 0:
        return {}
    size = min(float(budget), *(available[s] * r * whole / p for s, p, r in usable))
    return {s: int(size * p / whole + 1e-6) for s, p, _ in usable}


def plan(blocks: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], budget: int, shards: int = SHARDS, seed: int = 42) -> list[tuple[str, int, int, int, int]]:
    """(source, block, copy, shard, words to take) for every block drawn; -1 words: the whole block."""
    want = quotas({s: sum(b.values()) for s, b in blocks.items()}, targets, budget)
    drawn: dict[str, list[tuple[int, int, int]]] = {}
    names = sorted(want)
    for k, s in enumerate(names):
        order = sorted(blocks[s])
        order = [order[i] for i in np.random.default_rng([seed, k]).permutation(len(order))]
        left, copy, rows = want[s], 0, []
        while left > 0:
            for b in order:
                n = blocks[s][b]
                rows.append((b, copy, -1 if n <= left else left))
                left -= min(n, left)
                if left <= 0:
                    break
            copy += 1
        drawn[s] = rows
    rng = np.random.default_rng(seed)
    out, at = [], defaultdict(int)
    for shard, counts in enumerate(split_counts(np.array([len(drawn[s]) for s in names], np.int64), shards, rng)):
        for s, n in zip(names, counts.tolist(), strict=True):
            out += [(s, b, c, shard, w) for b, c, w in drawn[s][at[s] : at[s] + n]]
            at[s] += n
    return out


def mixes(sizes: DataFrame, targets: DataFrame, budget: int, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """`mix, shard, place, doc_id, source, copy, words`: the composed set of each mix. `sizes` as by `document_sizes`, cut from its lineage.

    Sources without target aren't used, nor are targets without a mix; a target's null `max_repeats` counts as 1. Empty tables give an empty set. What goes
    to the driver is a row for each source of the targets and block. All mixes are planned from one count of the blocks and
    drawn in one pass over the documents.
    """
    spark = sizes.sparkSession
    goals: dict[str, list[tuple[str, float, int]]] = defaultdict(list)
    rows = targets.where("mix is not null").groupBy("mix", source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("p"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    for r in rows.orderBy("mix", "source").collect():
        goals[r.mix].append((r.source, float(r.p or 0), int(r.r)))
    wanted = in_blocks(sizes, sorted({s for g in goals.values() for s, _, _ in g if s is not None}))
    blocks: dict[str, dict[int, int]] = defaultdict(dict)
    for r in wanted.groupBy("source", "block").agg(F.sum("words").alias("n")).collect():
        blocks[r.source][r.block] = r.n
    drawn = [(m, *row) for m, g in goals.items() for row in plan({s: blocks[s] for s, _, _ in g if s in blocks}, g, budget, shards, seed)]
    # Spark knows the size of this table: it is sent to the executors if it is small and joined by shuffle if not
    drawn = spark.createDataFrame(drawn or [(None, "", -1, 0, 0, 0)], "mix string, source string, block int, copy int, shard int, take long")
    met = wanted.join(drawn, ["source", "block"])
    whole = met.where("take < 0").drop("take")
    w = W.partitionBy("mix", "source", "block", "copy").orderBy("ord", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    part = met.where("take >= 0").withColumn("so_far", F.sum("words").over(w)).where("so_far <= take").drop("take", "so_far")  # one block of each source
    place = F.xxhash64("doc_id", "copy", F.lit(seed))
    return whole.unionByName(part).select("mix", "shard", place.alias("place"), "doc_id", "source", "copy", "words")


def write_shards(mixed: DataFrame, docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """The texts of a mix in a folder for each mix and shard, shuffled each on its own: in the order of `place` over its files by name.

    Ranges of (mix, shard, place) are the tasks, so a shard isn't one task's work however large it is.
    """
    full = mixed.join(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), "doc_id")
    ranges = full.repartitionByRange("mix", "shard", "place").sortWithinPartitions("mix", "shard", "place", "copy")
    ranges.write.mode("overwrite").partitionBy("mix", "shard").parquet(path)


def report_budget(report: DataFrame, model: str | None = "tok-8b") -> int:
    """Budget in words of the latest run of the report under the tokenizer that problem 2 goes by; of any if it has none."""
    newest = F.max_by("budget", F.struct("created_at", "run_id"))
    r = report.agg(F.max_by("budget", F.when(F.col("model") == model, F.struct("created_at", "run_id"))).alias("own"), newest.alias("any")).first()
    return int(r.own if r.own is not None else r.any or 0)


def _mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = checkpointed(document_sizes(read(spark, sf_dir, "documents")))
    return mixes(sizes, read(spark, sf_dir, "mix_targets"), report_budget(read(spark, sf_dir, "text_token_ratio_report")))


def p5_quotas(spark, sf_dir: str) -> DataFrame:
    """What is planned: words that each source of a mix has, its target, and the quota of words that it gives."""
    docs = read(spark, sf_dir, "documents").select(source_name(F.col("source")).alias("source"), word_count(F.col("text")).alias("words"))
    have = docs.where("source is not null and words > 0").groupBy("source").agg(F.sum("words").alias("available"))
    t = read(spark, sf_dir, "mix_targets").groupBy("mix", source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = t.where("mix is not null").join(have, "source", "left").collect()  # a row for each source of a mix
    budget = report_budget(read(spark, sf_dir, "text_token_ratio_report"))
    out = []
    for m in sorted({r.mix for r in rows}):
        own = [r for r in rows if r.mix == m]
        q = quotas({r.source: r.available or 0 for r in own}, [(r.source, float(r.target or 0), int(r.max_repeats)) for r in own], budget)
        out += [(m, r.source, r.available, r.target, int(r.max_repeats), q.get(r.source)) for r in own]
    return spark.createDataFrame(out, "mix string, source string, available long, target double, max_repeats int, quota long")


def p5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two mixes of mix_targets at the budget of the latest report; a shard's own order is that of `place`."""
    return _mixes(spark, sf_dir)


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by each source of each mix beside its target."""
    got = _mixes(spark, sf_dir).groupBy("mix", "source").agg(F.sum("words").alias("words"), F.count("*").alias("n_docs"), (F.max("copy") + 1).alias("passes"))
    got = got.withColumn("share", F.col("words") / F.sum("words").over(W.partitionBy("mix")))  # a row for each source of a mix
    t = read(spark, sf_dir, "mix_targets").select("mix", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    return t.join(got, ["mix", "source"], "left").withColumn("off_target", F.coalesce("share", F.lit(0.0)) - F.col("target_share"))


_SOURCE = r"regexp_replace(regexp_replace(lower(trim(source)), '(\.parquet|\.jsonl|\.json|\.txt)$', ''), '[\s\-]+', '_', 'g')"
SQL = {
    "p5_quotas": rf"""
WITH d AS (SELECT {_SOURCE} AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\v\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS words FROM documents),
h AS (SELECT source, sum(words)::BIGINT AS available FROM d WHERE source IS NOT NULL AND words > 0 GROUP BY source),
t AS (SELECT mix, {_SOURCE} AS source, sum(target_share) AS target, max(coalesce(max_repeats, 1)) AS max_repeats FROM mix_targets WHERE mix IS NOT NULL GROUP BY ALL),
j AS (SELECT t.*, h.available, target > 0 AND max_repeats > 0 AND coalesce(available, 0) > 0 AS usable FROM t LEFT JOIN h USING (source)),
b AS (SELECT coalesce(arg_max(budget, (created_at, run_id)) FILTER (WHERE model = 'tok-8b'), arg_max(budget, (created_at, run_id)))::DOUBLE AS budget FROM text_token_ratio_report),
w AS (SELECT mix, sum(target) AS whole FROM j WHERE usable GROUP BY mix),
s AS (SELECT j.mix, least(any_value(b.budget), min(available * max_repeats * whole / target)) AS size FROM j JOIN w USING (mix), b WHERE usable GROUP BY j.mix)
SELECT j.mix, source, available, target, max_repeats::INT AS max_repeats, CASE WHEN usable THEN floor(size * target / whole + 1e-6)::BIGINT END AS quota FROM j LEFT JOIN w USING (mix) LEFT JOIN s USING (mix)"""
}
