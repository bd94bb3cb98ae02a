"""Unit and token sequences: run-length dedup, windows, packing, padding."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasra.session import checkpointed

#: Ids: text vocabulary, then units, then three sentinels.
TEXT_IDS, UNIT_IDS = 151936, 1000
SPEECH_START, SPEECH_END = TEXT_IDS + UNIT_IDS, TEXT_IDS + UNIT_IDS + 1


#: Hashes of repeated keys that may be broadcast, 8 bytes each; more are met by shuffle.
REPEATED_KEYS = 1_000_000


def one_of_each(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Rows of `df`, one of each value of `keys` (any of them); null is a value.

    Where few keys repeat, only the rows that hold them are shuffled, not all with their long columns: hashes of keys are counted
    first, and rows whose hash doesn't come twice pass as they are.
    """
    h = F.xxhash64(*keys).alias("_hash_of_keys")
    again = checkpointed(df.select(h).groupBy("_hash_of_keys").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash_of_keys"))
    n = again.count()
    if n > (REPEATED_KEYS if limit is None else limit):
        return df.dropDuplicates(keys)
    d = df.withColumn("_hash_of_keys", h)
    once = d.join(F.broadcast(again), "_hash_of_keys", "left_anti").drop("_hash_of_keys")  # at most REPEATED_KEYS longs
    more = d.join(F.broadcast(again), "_hash_of_keys", "left_semi").drop("_hash_of_keys")
    return once.unionByName(more.dropDuplicates(keys)) if n else df


def deduped(units: Column) -> Column:
    """Consecutive repeats taken once."""
    return F.filter(units, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(units, i - 1)))


def in_range(units: Column, n: int = UNIT_IDS) -> Column:
    """Whether all ids lie in [0, n); null and empty arrays do."""
    return F.coalesce((F.array_min(units) >= 0) & (F.array_max(units) < n), F.lit(True))


def speech_span(units: Column) -> Column:
    """Units moved behind the text ids, between the two sentinels."""
    return F.concat(F.array(F.lit(SPEECH_START)), F.transform(units, lambda u: u + TEXT_IDS), F.array(F.lit(SPEECH_END)))


def chunk_starts(n: Column, size: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def chunks(df: DataFrame, items: str, size: int, keep: list[str], least: int = 1) -> DataFrame:
    """`keep` columns, `chunk`, `start`, `part`: windows of at most `size` items in order, the last one as it falls; size 0 is one window.

    Windows of fewer than `least` items are dropped.
    """
    c = F.col(items)
    if size <= 0:
        return df.where(F.size(c) >= max(1, least)).select(*keep, F.lit(0).alias("chunk"), F.lit(0).alias("start"), c.alias("part"))
    starts = F.filter(chunk_starts(F.size(c), size), lambda at: F.size(c) - at >= least)
    return df.select(*keep, c.alias("_c"), F.posexplode(starts).alias("chunk", "start")).select(*keep, "chunk", "start", F.slice("_c", F.col("start") + 1, F.lit(size)).alias("part"))


def reassembled(df: DataFrame, key: str, chunk: str = "chunk", part: str = "part") -> DataFrame:
    """Chunks put together again in their order; one key's chunks are bounded by its sequence."""
    return df.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(chunk, part))), lambda s: s[part])).alias("items"))


def sliding(df: DataFrame, length: str, width: int, hop: int, keep: list[str]) -> DataFrame:
    """`keep`, `window`, `start`, `stop` of overlapping windows; a last one shorter than the overlap is dropped unless it is the only one."""
    n = F.col(length)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, lambda s, i: (i == 0) | (n - s >= width - hop))
    d = df.select(*keep, n.alias("_n"), F.posexplode(starts).alias("window", "start"))
    return d.select(*keep, "window", "start", F.least(F.col("start") + width, F.col("_n")).alias("stop"))


def split_on(items: Column, sep: int) -> Column:
    """Parts between separators; empty parts dropped, the tail kept."""
    at = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: F.element_at(items, i) == sep)
    begins, ends = F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(F.size(items) + 1))
    parts = F.zip_with(begins, ends, lambda a, b: F.when(b - a > 1, F.slice(items, a + 1, b - a - 1)))
    return F.when(F.size(items) > 0, F.filter(parts, lambda p: p.isNotNull())).otherwise(F.array().cast("array<array<int>>"))


def packed(df: DataFrame, items: str, order: str, length: int, by: list[str] | None = None) -> DataFrame:
    """`by`, `window`, `tokens`: sequences in order laid end to end and cut into windows of exactly `length`; the rest is dropped.

    Global places come from two-level running totals of the sequences' sizes, so items aren't sorted and no task sees them all;
    only slices that fall into a window are shuffled by it.
    """
    from glasra.operators.sampling import running_total

    by = by or []
    d = df.withColumn("_one", F.lit(1)) if not by else df
    keys = by or ["_one"]
    d = running_total(d, keys, order, F.size(items), "_at").where(F.size(items) > 0)
    n, at = F.size(items), F.col("_at")
    first, last = F.floor(at / length), F.floor((at + n - 1) / length)
    d = d.select(*keys, "_at", F.col(items).alias("_items"), F.explode(F.sequence(first, last)).alias("window"))
    lo = F.greatest(F.lit(0), F.col("window") * length - F.col("_at")).cast("int")
    hi = F.least(F.size("_items"), ((F.col("window") + 1) * length - F.col("_at")).cast("int"))
    d = d.select(*keys, "window", (F.col("_at") + lo).alias("_p"), F.slice("_items", lo + 1, hi - lo).alias("_s"))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda s: s["_s"]))
    return d.groupBy(*keys, "window").agg(tokens.alias("tokens")).where(F.size("tokens") == length).select(*by, "window", "tokens")


def audio_tokens(frames: Column) -> Column:
    """Tokens that an audio encoder makes of so many mel frames by its lengths alone: a convolution of stride 2, then pooling by 2; 25 of 100."""
    conv = F.floor((frames - 1) / 2) + 1
    return F.when(frames > 0, F.greatest(F.lit(0), F.floor((conv - 2) / 2) + 1)).otherwise(0).cast("long")


def padded(df: DataFrame, items: str, batch: str, value: int = -100) -> DataFrame:
    """`df` with `items` filled up to the longest of its batch, and `mask` of what is real. Batches are small by their nature."""
    longest = df.groupBy(batch).agg(F.max(F.size(items)).alias("_most"))
    d = df.join(longest, batch)
    fill = F.array_repeat(F.lit(value), F.col("_most") - F.size(items))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(items)), F.array_repeat(F.lit(0), F.col("_most") - F.size(items)))
    return d.withColumn("mask", mask).withColumn(items, F.concat(items, fill)).drop("_most")


def next_fit(df: DataFrame, size: str, cap: float, order: str, by: str) -> DataFrame:
    """`df` with `shard`: longest first, a new shard whenever the next row doesn't fit; older shards aren't revisited.

    The state is one running sum, carried through rows that the JVM has sorted within each group `by` (decreasing size, then
    `order`), so a group is never held; it is still one task's work, so groups should be parts of bounded size. Null counts 0.
    """
    d = df.withColumn("_s", F.coalesce(F.col(size).cast("double"), F.lit(0.0)))
    d = d.repartition(F.col(by)).sortWithinPartitions(F.col(by), F.desc("_s"), F.col(order))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, shard, some = object(), 0.0, 0, False
        for b in batches:
            out = []
            for g, s in zip(b[by], b["_s"], strict=True):
                if g != group:
                    group, used, shard, some = g, 0.0, 0, False
                if some and used + s > cap:
                    shard, used = shard + 1, 0.0
                out.append(shard)
                used, some = used + s, True
            yield b.drop(columns="_s").assign(shard=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return d.mapInPandas(fit, f"{schema}, shard int")


def first_of(items: Column, stops: list[int]) -> Column:
    """Items before the earliest of several ids."""
    at = [F.when(F.array_position(items, s) > 0, F.array_position(items, s)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), items).otherwise(F.slice(items, F.lit(1), (first - 1).cast("int")))


def changed(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group, and first ones: run-length dedup of a long table, however large a group."""
    from glasra.operators.sampling import previous

    d = previous(df, [by], F.struct(by, *order), value, "_before")
    return d.where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.value"))).drop("_before")


def restored_turns(df: DataFrame, key: str, turns: str, work, batch: int = 2000, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """`key`, `turns` with `work` (list of texts to list of texts) done on all turns in batches that cross records; blank turns pass by as ''.

    A batch whose answer has another length is halved and tried again, so each turn gets one answer; a single turn that doesn't
    ends the job. A call that fails is made again, `tries` times in all, after `wait` seconds, then twice that, and so on.
    """

    def call(texts: list[str]) -> list[str]:
        for k in range(1, tries):
            try:
                return list(work(texts))
            except Exception:  # noqa: BLE001 a service may fail in any way
                time.sleep(wait * k)
        return list(work(texts))

    def one_each(texts: list[str]) -> list[str]:
        got = call(texts)
        if len(got) == len(texts):
            return got
        if len(texts) == 1:
            raise ValueError(f"{len(got)} answers for one turn")
        k = len(texts) // 2
        return one_each(texts[:k]) + one_each(texts[k:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [(i, j, " ".join((t or "").split("\n")).strip()) for i, ts in enumerate(b[turns]) for j, t in enumerate([] if ts is None else ts)]
            live = [x for x in flat if x[2]]
            done: dict[tuple[int, int], str] = {}
            for k in range(0, len(live), batch):
                part = live[k : k + batch]
                done.update({(i, j): r for (i, j, _), r in zip(part, one_each([t for *_, t in part]), strict=True)})
            out: list[list[str]] = [[] for _ in range(len(b))]
            for i, j, _ in flat:
                out[i].append(done.get((i, j), ""))
            yield pd.DataFrame({key: b[key], turns: out})

    return df.select(key, turns).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{turns}` array<string>")
