"""Deterministic selection: prefixes by budget, hash subsets, quotas, splits and schedules.

Hashes are MD5 or SHA-256 of a seed and a key, never rand(): the same rows come in any layout. Running totals are made in two
levels, so that no task gets more of a hot group than one block of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasra.session import checkpointed

#: Least rows of a block of a running total.
BLOCK = 4096


def block_width(df: DataFrame, order: str) -> int:
    """How wide blocks of `order` have to be: as many rows in a block as there are blocks, at least BLOCK, whether orders are dense or hashes."""
    r = df.agg(F.count(order).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if not r.n:
        return BLOCK
    rows = max(BLOCK, math.isqrt(r.n))
    return max(1, -(-(int(r.hi) - int(r.lo) + 1) * rows // r.n))


def running_total(df: DataFrame, by: list[str], order: str, value: Column, name: str, block: int | None = None) -> DataFrame:
    """`df` with the sum of `value` over all rows of its group before it, by a whole-number `order` that is unique in the group.

    Orders fall into blocks; sums of blocks are totalled first (one row a block), then rows within their block. Null values count 0.
    The input is read twice or, if the width of the blocks isn't given, three times: give it narrow, and checkpointed if its columns are dear.
    """
    block = block or block_width(df, order)
    b, v = F.floor(F.col(order) / F.lit(block)).cast("long"), F.coalesce(value, F.lit(0))
    d = df.withColumn("_block", b).withColumn("_value", v)
    sums = d.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_block")]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    joined = d.alias("l").join(offsets.alias("r"), cond)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._inner") + F.col("r._before")).alias(name))


def budget_prefix(df: DataFrame, by: list[str], order: str, size: Column, budget: Column) -> DataFrame:
    """Rows of each group until the budget is reached; the row that crosses it is in."""
    return running_total(df, by, order, size, "_before").where(F.col("_before") < budget).drop("_before")


def accept(key: Column, p: Column, seed: str) -> Column:
    """Bernoulli acceptance by the first 32 bits of MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double")
    return h < p * F.lit(4294967296.0)


def sha_rank(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def hash_subset(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of least SHA-256; a top-k, so each task keeps n rows."""
    return df.orderBy(sha_rank(seed, F.col(key)), key).limit(n)


def even_quota(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows spread evenly over the strata, the remainder to the first ones; within a stratum those of least SHA-256.

    Strata are few. A stratum's rows are thinned to its quota in each block of hashes before they meet.
    """
    counts = df.groupBy(stratum).agg(F.count("*").alias("_have"))
    w = W.orderBy(stratum)  # a row for each stratum
    q = counts.withColumn("_i", F.row_number().over(w) - 1).withColumn("_k", F.count("*").over(W.partitionBy(F.lit(1))))
    q = q.withColumn("_take", F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_i") < F.lit(n) % F.col("_k"), 1).otherwise(0))
    d = df.join(q.select(stratum, "_take"), stratum).withColumn("_h", sha_rank(seed, F.col(stratum), F.col(key)))
    part = W.partitionBy(stratum, F.substring("_h", 1, 2)).orderBy("_h", key)
    d = d.withColumn("_r", F.row_number().over(part)).where("_r <= _take").drop("_r")
    return d.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy("_h", key))).where("_r <= _take").drop("_r", "_h", "_take")


def held_out(key: Column, modulus: int = 40) -> Column:
    """Whether the MD5 of the key is a multiple of 40: its last hex digit is 0 or 8 and its digits sum to a multiple of 5."""
    if modulus != 40:
        raise ValueError("only 40 has the digit rule")
    h = F.md5(key)
    digits = F.aggregate(F.split(h, ""), F.lit(0), lambda s, d: s + F.coalesce(F.conv(F.when(d != "", d), 16, 10).cast("int"), F.lit(0)))
    return F.substring(h, -1, 1).isin("0", "8") & (digits % 5 == 0)


def schedule(df: DataFrame, order: str, share: float, seed: str) -> DataFrame:
    """`df` with `picked`: exactly round(n x share) rows, those of least hash, half to even.

    Counts of hash prefixes (at most 4,096 rows) tell how many come before each; rows are ranked within their prefix.
    """
    d = df.withColumn("_h", sha_rank(seed, F.col(order))).withColumn("_p", F.substring("_h", 1, 3))
    n = F.bround(F.sum("_n").over(W.partitionBy(F.lit(1))) * F.lit(share))
    ps = d.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_want", n)
    ps = ps.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    j = d.join(ps, "_p").withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("_h", order)) + F.col("_before"))
    return j.select(*df.columns, (F.col("_r") <= F.col("_want")).alias("picked"))


def ordinal(df: DataFrame, by: list[str], order: str, name: str = "ordinal", block: int | None = None) -> DataFrame:
    """Row number from 0 in each group, in two levels."""
    return running_total(df, by, order, F.lit(1), name, block)


def placed(df: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """`df` with each row's place from 0 in the sorted whole: ranges of the order are sorted apart, and counts of ranges (one row each) put before them."""
    d = df.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_m", F.monotonically_increasing_id())
    d = checkpointed(d.select(*df.columns, F.shiftright("_m", 33).alias("_range"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sums = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return d.join(before, "_range").select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def first_rows(df: DataFrame, by: list[str], order: list[str], n: int, name: str = "is_first", parts: int = 64) -> DataFrame:
    """`by` and `order` columns of all rows of `df`, and whether each is among the first `n` of its group; equal rows count each.

    Equal rows are counted first; then each of `parts` parts of a group keeps its n least, and those meet: no group is sorted whole.
    """
    keys = [*by, *order]
    g = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("_k")))
    salt = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("_salt")
    least = g.select("*", salt).withColumn("_r", F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    w = W.partitionBy(*by).orderBy(*order)
    least = least.withColumns({"_r": F.row_number().over(w), "_before": F.coalesce(F.sum("_k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).where((F.col("_r") <= n) & (F.col("_before") < n))
    least = least.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    j = g.join(least, on, "left").withColumn("_of", F.when(F.col("_before").isNull(), 0).otherwise(F.least(F.col("_k"), n - F.col("_before"))))
    return j.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("_i"), "_of").select(*keys, (F.col("_i") <= F.col("_of")).alias(name))


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """`by, median`: the mean of the one or two middle values of each group; nulls don't count.

    A sketch brackets the middle (its error is at most a ten-thousandth of the group, the bracket's half width a hundredth); only
    values inside are counted one by one and sorted. So no task holds a group, nor a map of its values.
    """
    d = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    s = d.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [0.49, 0.51], 10_000).alias("_q"))
    s = s.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", "_q")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = d.join(s, cond)
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    # what is below the bracket counts as one value, just before it
    v = F.when(F.col("_v") < lo, F.lit(float("-inf"))).otherwise(F.col("_v"))
    c = j.where(F.col("_v") <= hi).groupBy(*by, v.alias("_v"), "_n").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    c = c.withColumn("_upto", upto)
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))
    return c.groupBy(*by).agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2).alias(name))


def previous(df: DataFrame, by: list[str], order: Column, value: str, name: str) -> DataFrame:
    """`df` with `value` of the row before in its group, as a struct (null for the first): rows are placed in one sorted whole by
    `order`, which begins with the group, and look back within their block; a block's first row looks at the last of the block before.
    """
    d = placed(df, order, "_place").withColumn("_block", F.floor(F.col("_place") / BLOCK))
    me = F.struct(*[F.col(c).alias(c) for c in by], F.col(value).alias("_value"))
    ends = d.groupBy("_block").agg(F.max_by(me, "_place").alias("_end")).select((F.col("_block") + 1).alias("_block"), "_end")
    back = F.lag(me).over(W.partitionBy("_block").orderBy("_place"))
    d = d.withColumn("_back", back).join(ends, "_block", "left").withColumn("_back", F.coalesce("_back", "_end"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"_back.{c}").eqNullSafe(F.col(c))
    return d.withColumn(name, F.when(F.col("_back").isNotNull() & same, F.struct(F.col("_back._value").alias("value")))).select(*df.columns, name)
