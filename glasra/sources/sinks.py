"""Sinks: shards, manifests, files, reports. Tables go through Spark's committers, single files through Arrow's file systems on the workers."""

from __future__ import annotations

import io
import json
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from glasra.functions.audio import encoded, pcm16
from glasra.operators.gates import GateError
from glasra.operators.review import union_all
from glasra.session import checkpointed, scratch  # noqa: F401 sinks write to scratch folders
from glasra.sources.files import listing

MARK = "﻿"


def shards(df: DataFrame, path: str, by: str = "source") -> None:
    """A folder for each source; runs again write only the sources they have."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def parquet_as(df: DataFrame, path: str, schema: str) -> None:
    """Parquet with exactly the given columns and types, zstd."""
    want = df.sparkSession.createDataFrame([], schema).schema
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want]).write.mode("overwrite").option("compression", "zstd").parquet(path)


def concatenated(df: DataFrame, path: str, order: list[str]) -> int:
    """Rows written in one total order as numbered parts (range-sorted, not one task), and how many; a loss ends the job."""
    n = df.count()
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path).count()
    if got != n:
        raise GateError(f"wrote {got} of {n} rows")
    return n


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV with header and a byte-order mark before the first column's name."""
    first = df.columns[0]
    df.withColumnRenamed(first, MARK + first).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def tsv_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Numbered manifests with header."""
    df.write.mode("overwrite").partitionBy(shard).csv(path, sep="\t", header=True, quote="")


def sorted_tsv(df: DataFrame, path: str, order: list[str]) -> str:
    """Rows in one order as TSV parts, and the summary of their numbers as a JSON document beside them, which is returned."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, sep="\t", header=True)
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float")]
    r = df.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in numbers]).first()
    summary = json.dumps({"rows": r.rows, "totals": {c: r[c] for c in numbers}}, sort_keys=True)
    df.sparkSession.createDataFrame([(summary,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-summary")
    return summary


def append_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines behind those that are there; with `order` the parts of an append follow it, read by name."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("append").json(path)


def csv_of_all(frames: list[DataFrame], path: str) -> None:
    """Frames one under another as CSV with mark: the header has every column, in order of first appearance."""
    csv_with_mark(union_all(frames), path)


def nested_json(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def by_condition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("condition").json(path)


def meta(totals: DataFrame, limit: int = 10_000) -> str:
    """Totals by source as one JSON document; refused if there are more sources than a report has."""
    rows = totals.limit(limit + 1).collect()
    if len(rows) > limit:
        raise GateError("too many sources for one document")
    return json.dumps({"per_source": [r.asDict(recursive=True) for r in rows]}, ensure_ascii=False, sort_keys=True, default=str)


def _opened(path: str):
    """(file system, path on it) of any address that Arrow knows; plain paths are local or mounted."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def write_files(df: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """A file for each row in a shared folder, written by the workers; gives `name, bytes`, kept in `_manifest` beside them.

    Each is written under another name and then renamed, so a task that runs again leaves one whole file. Null contents have none.
    """

    def write(batches):
        fs, root = _opened(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            done = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n is not None and c is not None:
                    part = f"{root}/.{n.replace('/', '-')}.{uuid.uuid4().hex}"
                    fs.create_dir(f"{root}/{n}".rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(part) as out:
                        out.write(c)
                    fs.move(part, f"{root}/{n}")
                    done.append((n, len(c)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["name", "bytes"])

    df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(write, "name string, bytes bigint").write.mode("overwrite").parquet(f"{path}/_manifest")
    return df.sparkSession.read.parquet(f"{path}/_manifest")


@F.pandas_udf(BinaryType())
def uint32_bytes(t: pd.Series) -> pd.Series:
    """Flat little-endian uint32 of an array of ids; null stays null."""
    return t.map(lambda x: None if x is None else np.asarray(x, "<u4").tobytes(), na_action="ignore")


@F.pandas_udf(BinaryType())
def npy_bytes(t: pd.Series) -> pd.Series:
    """A .npy file of an array of whole numbers."""

    def one(x):
        out = io.BytesIO()
        np.save(out, np.asarray(x, np.int64))
        return out.getvalue()

    return t.map(one, na_action="ignore")


@F.pandas_udf(BinaryType())
def wav_bytes(audio: pd.Series, rate: pd.Series) -> pd.Series:
    """A mono RIFF file of 16-bit PCM; null where audio or rate is missing."""
    return pd.Series([None if a is None or r is None or not r > 0 else encoded(pcm16(bytes(a)), int(r)) for a, r in zip(audio, rate, strict=True)])


def token_shards(df: DataFrame, path: str, source: str, group: str, order: str, tokens: str) -> DataFrame:
    """`<source>__rg<group>.bin` of flat little-endian uint32 for each group of rows of a source, its rows in order; gives `name, bytes`.

    A group is a row group, so of bounded size; groups without tokens have no file; those that are there already are left, so a
    run takes up where another ended.
    """
    name = F.concat(F.col(source), F.lit("__rg"), F.lpad(F.col(group).cast("string"), 4, "0"), F.lit(".bin"))
    g = df.where(F.size(tokens) > 0).groupBy(name.alias("name")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, tokens))), lambda s: s[tokens])).alias("ids"))
    spark = df.sparkSession
    fs, root = _opened(path)
    fs.create_dir(root, recursive=True)
    there = listing(spark, path, "*.bin").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes") if any(f.base_name.endswith(".bin") for f in fs.get_file_info(FileSelector(root))) else None
    new = g if there is None else g.join(there.select("name"), "name", "left_anti")
    made = write_files(new.select("name", uint32_bytes("ids").alias("content")), path)
    return made if there is None else made.unionByName(checkpointed(there))


def joined_files(spark: SparkSession, names: DataFrame, path: str, out: str, buffer: int = 16 << 20) -> DataFrame:
    """Files of a folder put one behind another: `names` has `target, place, name`; a task for each target copies through a buffer.

    Gives `target, bytes`. A target whose size isn't the sum of its parts' ends the job.
    """
    lists = names.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("parts"))

    def copy(batches):
        fs, root = _opened(path)
        to, folder = _opened(out)
        to.create_dir(folder, recursive=True)
        for b in batches:
            done = []
            for target, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{target}.{uuid.uuid4().hex}"
                with to.open_output_stream(part) as o:
                    for n in parts:
                        with fs.open_input_stream(f"{root}/{n}") as i:
                            while block := i.read(buffer):
                                o.write(block)
                want, got = sum(f.size for f in fs.get_file_info([f"{root}/{n}" for n in parts])), to.get_file_info(part).size
                if want != got:
                    raise GateError(f"{target}: {got} of {want} bytes")
                to.move(part, f"{folder}/{target}")
                done.append((target, got))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["target", "bytes"])

    n = max(1, lists.count())
    lists.repartition(n, "target").mapInArrow(copy, "target string, bytes bigint").write.mode("overwrite").parquet(f"{out}/_manifest")
    return spark.read.parquet(f"{out}/_manifest")


def embedding_files(df: DataFrame, path: str, meta: dict) -> DataFrame:
    """A .npz of each `store` with arrays `<object>.<pooling>` [layers, n, d] in float16, and a JSON sidecar of `meta` beside it.

    `df` has `store, object, pooling, layer, sent_idx, v`; a store's arrays have to be full, else the job ends.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for (o, p), g in pdf.groupby(["object", "pooling"]):
            g = g.sort_values(["layer", "sent_idx"])
            layers, places = g.layer.nunique(), g.sent_idx.nunique()
            if len(g) != layers * places:
                raise GateError(f"{o}.{p}: {len(g)} vectors, {layers} x {places} expected")
            arrays[f"{o}.{p}"] = np.array(g.v.tolist(), np.float16).reshape(layers, places, -1)
        out = io.BytesIO()
        np.savez(out, **arrays)
        store = pdf.store.iloc[0]
        side = json.dumps({**meta, "store": store, "arrays": {k: list(a.shape) for k, a in arrays.items()}}, sort_keys=True)
        return pd.DataFrame({"name": [f"{store}.npz", f"{store}.json"], "content": [out.getvalue(), side.encode()]})

    return write_files(df.groupBy("store").applyInPandas(pack, "name string, content binary"), path)
