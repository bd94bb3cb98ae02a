"""Structured Streaming: resumable ordered append, and parents put together when all their children are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there, exactly once a record, into Parquet; run again it takes up where it ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_parquet(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream over the Parquet files of a folder or file, with the schema that they have."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def counted_into(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Counts of each batch appended with the batch's number; a batch that comes again overwrites its own part."""

    def write(batch: DataFrame, n: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Event-time windows with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def whole_parents(children: DataFrame, parent: str, ordinal: str, of: str, value: str, out: str = "string") -> DataFrame:
    """`parent, values`: parents whose children (numbered from 0, `of` in all) have all come, in order, once each.

    State is the children seen of parents that aren't whole; it is dropped with the parent.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gather(key, batches, state: GroupState):
        seen: dict = {}
        if state.exists:
            at, vals, _ = state.get
            seen = dict(zip(at, vals, strict=True))
        want = None
        for b in batches:
            want = int(b[of].iloc[0])
            for i, v in zip(b[ordinal], b[value], strict=True):
                seen.setdefault(int(i), v)
        if want is not None and len(seen) >= want:
            if state.exists:
                state.remove()
            yield pd.DataFrame({parent: [key[0]], "values": [[seen[i] for i in sorted(seen)]]})
        else:
            state.update((list(seen), list(seen.values()), want or 0))
            yield pd.DataFrame({parent: [], "values": []})

    kind = children.schema[parent].dataType.simpleString()
    return children.groupBy(parent).applyInPandasWithState(gather, f"`{parent}` {kind}, values array<{out}>", f"at array<int>, vals array<{out}>, of int", "append", GroupStateTimeout.NoTimeout)
