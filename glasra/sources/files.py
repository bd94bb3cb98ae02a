"""Sources beyond Spark's own readers. Schemas are given, not inferred; binary files are parsed in Arrow-fed partitions."""

from __future__ import annotations

import ast
import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glasra.functions.audio import decoded
from glasra.operators.gates import GateError, enforce, exact_columns
from glasra.session import checkpointed


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """Projected read; `optional` columns that the files lack come as null of the given type."""
    df = spark.read.parquet(path)
    for c, kind in (optional or {}).items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.select(*columns) if columns else df


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """`file, bytes` of the Parquet files of a path, from the listing alone; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """`file, bytes, row_groups, rows` of the Parquet files of a path from their footers, read by the workers; contents aren't."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for b in batches:
            rows = []
            for p, n in zip(b.path, b.length, strict=True):
                fs, at = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", p))
                m = pq.read_metadata(at, filesystem=fs)
                rows.append((p.rsplit("/", 1)[-1], n, m.num_row_groups, m.num_rows))
            yield pd.DataFrame(rows, columns=["file", "bytes", "row_groups", "rows"])

    return names.mapInPandas(look, "file string, bytes long, row_groups int, rows long")


def jsonl(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    if columns:
        exact_columns(df, columns)
    return df


def json_documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Whole-file JSON documents of several globs, each file once, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(sorted(set(paths))).withColumn("path", F.col("_metadata.file_path"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("quote", "").csv(path, sep="\t", header=True)


def bare_tsv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Headerless TSV: short lines are left out, extra columns ignored, quotes are ordinary characters."""
    parts = F.split("value", "\t")
    df = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= len(fields))
    return df.select(*[F.get("p", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def multimap(df: DataFrame, key: str) -> DataFrame:
    """All rows of a key as an array; keys have few rows by their nature."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))


def csv_with_mark(spark: SparkSession, path: str, unique: str | None = None) -> DataFrame:
    """CSV with a byte-order mark and header, all strings; a repeated key ends the job."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if unique:
        enforce(df.groupBy(unique).count().where("count > 1"), f"repeated {unique}")
    return df


def durations(spark: SparkSession, path: str) -> DataFrame:
    """`name, duration_s` of lines that end in a number after their last space; other lines are left out."""
    df = spark.read.text(path).select(F.regexp_extract("value", r"^(.*) (\S+)$", 1).alias("file"), F.expr(r"try_cast(regexp_extract(value, '^(.*) (\\S+)$', 2) as double)").alias("duration_s"))
    return df.where("file <> '' and duration_s is not null").select(F.substring_index("file", "/", -1).alias("name"), "duration_s")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """`path, label, bytes` of a folder tree; the content column isn't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), F.col("length").alias("bytes"))


def required(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """A listing that has to have a file."""
    df = listing(spark, path, glob)
    if df.isEmpty():
        raise GateError(f"no file matches {glob} in {path}")
    return df


def until_budget(files: DataFrame, budget: int) -> DataFrame:
    """Files in order of path until the bytes are reached; the order is that of ranges, so no task sorts all of them."""
    from glasra.operators.sampling import placed, running_total

    o = checkpointed(placed(files.withColumn("_one", F.lit(1)), F.col("path"), "_o"))
    return running_total(o, ["_one"], "_o", F.col("bytes"), "_before").where(F.col("_before") < budget).select(*files.columns)


def _npy(raw: bytes) -> np.ndarray:
    """Array of a .npy file, read from its header; pickled ones are refused."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = raw[6] > 1
    n = struct.unpack("<I" if wide else "<H", raw[8 : 12 if wide else 10])[0]
    at = (12 if wide else 10) + n
    head = ast.literal_eval(raw[12 if wide else 10 : at].decode("latin-1"))
    if "O" in head["descr"]:
        raise ValueError("pickled array")
    return np.frombuffer(raw, np.dtype(head["descr"]), offset=at).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def npy_units(spark: SparkSession, path: str) -> DataFrame:
    """`name, units ARRAY<INT>` of .npy files of whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b.name, "units": [_npy(bytes(c)).astype("int32").ravel() for c in b.content]})

    return _binary(spark, path, "*.npy").mapInPandas(run, "name string, units array<int>")


def token_streams(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """`name, tokens ARRAY<BIGINT>` of flat little-endian uint32 files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b.name, "tokens": [np.frombuffer(bytes(c), "<u4").astype("int64") for c in b.content]})

    return _binary(spark, path, glob).mapInPandas(run, "name string, tokens array<bigint>")


def tar_members(spark: SparkSession, path: str, glob: str = "*.tar*") -> DataFrame:
    """`archive, name, content` of the files in archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, c in zip(b.name, b.content, strict=True):
                with tarfile.open(fileobj=io.BytesIO(bytes(c))) as t:
                    rows = [(name, m.name.rsplit("/", 1)[-1], t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return _binary(spark, path, glob).mapInPandas(run, "archive string, name string, content binary")


def embedding_store(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """`store, object, pooling, layer, sent_idx, v` of arrays `<object>.<pooling>` [layers, n, d]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, c in zip(b.name, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    for k in z.namelist():
                        a = _npy(z.read(k)).astype("float32")
                        obj, pooling = k.removesuffix(".npy").rsplit(".", 1)
                        yield pd.DataFrame([(name, obj, pooling, i, j, a[i, j]) for i in range(a.shape[0]) for j in range(a.shape[1])], columns=["store", "object", "pooling", "layer", "sent_idx", "v"])

    return _binary(spark, path, glob).mapInPandas(run, "store string, object string, pooling string, layer int, sent_idx int, v array<float>")


def embedding_store_with(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """`embedding_store` whose every store has a JSON sidecar of its name with the given keys; a store without one ends the job."""
    stores = _binary(spark, path, "*.npz").select(F.regexp_replace("name", r"\.npz$", "").alias("store")).distinct()
    sides = _binary(spark, path, "*.json").select(F.regexp_replace("name", r"\.json$", "").alias("store"), F.decode("content", "UTF-8").alias("raw"))
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    enforce(stores.join(sides, "store", "left").select("store", missing.alias("missing")).where("size(missing) > 0"), "sidecars")
    return embedding_store(spark, path)


def sidecar(raw: str, keys: list[str]) -> dict:
    """A JSON sidecar that has to have given keys."""
    d = json.loads(raw)
    missing = [k for k in keys if k not in d]
    if missing:
        raise GateError(f"sidecar lacks {missing}")
    return d


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """`lang, format, text` of lines `<ga|en>:<raw|chat>: text`; blank lines and comments are left out, others end the job."""
    t = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    p = r"^(ga|en):(raw|chat):\s*(.+)$"
    enforce(t.where(~F.col("value").rlike(p)), "lines without a tag")
    return t.select(*[F.regexp_extract("value", p, i).alias(n) for i, n in ((1, "lang"), (2, "format"), (3, "text"))])


def synthetic_tokens(spark: SparkSession, n: int, vocabulary: int, seed: int) -> DataFrame:
    """n uniform ids, the same for a seed in any layout."""
    return spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(vocabulary)).cast("int").alias("token"))


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """`name, rate, n_samples, seconds` of the RIFF files of 16-bit PCM in a folder; nulls for files of another kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decoded(bytes(c)) for c in b.content]
            rows = [(None, None, None) if g is None else (g[1], len(g[0]), len(g[0]) / max(1, g[1])) for g in got]
            out = pd.DataFrame({"name": b.name, "rate": pd.array([r[0] for r in rows], "Int32"), "n_samples": pd.array([r[1] for r in rows], "Int64"), "seconds": [r[2] for r in rows]})
            yield out

    return _binary(spark, path, "*.wav").mapInPandas(run, "name string, rate int, n_samples long, seconds double")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, ordinal, value` of text files, one record a line; the ordinal is the line's place in its own file.

    Files are read in splits like any text. A line's number within its split comes from the order in which it is read, and the
    numbers of lines of the splits before (one row each) are added.
    """
    t = spark.read.option("lineSep", "\n").text(path)
    m = F.col("_metadata")
    t = checkpointed(t.select(m.file_path.alias("path"), m.file_block_start.alias("_start"), F.regexp_replace("value", r"\r$", "").alias("value"), F.monotonically_increasing_id().alias("_id")))
    s = t.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    j = t.join(s.withColumn("_before", before), ["path", "_start"])
    return j.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("_id") - F.col("_first") + F.col("_before")).cast("int").alias("ordinal"), "value")
