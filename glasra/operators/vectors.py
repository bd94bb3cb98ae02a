"""Embedding alignment and pooling. Vectors are arrays; sums are in double.

All pairs of two aligned sets are compared in blocks: one side's blocks are numbered and grouped, and each task multiplies two
blocks of at most BLOCK vectors with NumPy and keeps counts and maxima only, so nothing of quadratic size is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def centred(df: DataFrame, by: list[str], key: str, v: str) -> DataFrame:
    """Vectors with the mean of their set taken off, dimension by dimension; means are one vector a set."""
    m = df.select(*by, F.posexplode(v).alias("_d", "_x")).groupBy(*by, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    m = m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_mean"))
    j = df.join(m, by) if by else df.crossJoin(m)  # one row a set
    return j.withColumn(v, F.zip_with(v, "_mean", lambda x, y: x.cast("double") - y)).drop("_mean")


def violations(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """`keys, problem` of vectors that have no direction: missing, with a number that isn't finite, or of length zero."""
    x = F.transform(v, lambda t: t.cast("double"))
    odd = F.exists(x, lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")))
    problem = F.when(F.col(v).isNull() | (F.size(v) == 0), "missing").when(odd, "not finite").when(norm(F.col(v)) == 0, "zero")
    return df.select(*keys, problem.alias("problem")).where("problem is not null")


def unparallel(left: DataFrame, right: DataFrame, keys: list[str], v: str) -> DataFrame:
    """`keys, problem` of vectors that have no partner at the same place of the other set, several, or one of another size."""
    size = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(f"_n{n}"), F.max(F.size(v)).alias(f"_s{n}"))
    a, b = size(left, 0), size(right, 1)
    problem = F.when(F.col("_n1").isNull(), "only left").when(F.col("_n0").isNull(), "only right").when((F.col("_n0") > 1) | (F.col("_n1") > 1), "repeated").when(F.col("_s0") != F.col("_s1"), "sizes differ")
    return a.join(b, keys, "full_outer").select(*keys, problem.alias("problem")).where("problem is not null")


def alignment(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """`by, i, row_rank, col_rank, strict, missing`: where each pair's own similarity stands in its row and its column of all similarities.

    `pairs` has for each set `by` and place `i` the two vectors. Ranks count from 1; ties go to the lesser place; `strict` is
    whether it is greater than all others in row and column. A pair with a vector of no direction (see `violations`) is missing:
    it comes last in its row and column and isn't strict, and beside others such a vector is neither above nor equal; to
    end the job instead, enforce `violations` first. Sets are cut into BLOCK x BLOCK tiles.
    """
    bare = lambda c: F.coalesce(F.transform(c, lambda t: F.coalesce(t.cast("double"), F.lit(float("nan")))), F.array().cast("array<double>"))
    pairs = pairs.withColumns({a: bare(a), b: bare(b)})
    n = pairs.groupBy(*by).agg(F.floor((F.max("i") + BLOCK) / F.lit(BLOCK)).alias("_tiles"))
    d = pairs.join(n, by).withColumn("_b", F.floor(F.col("i") / F.lit(BLOCK)))
    own = cosine(F.col(a), F.col(b))
    rows = d.select(*by, "i", F.col(a).alias("v"), own.alias("own"), F.col("_b").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_c"), F.lit(0).alias("side"))
    cols = d.select(*by, "i", F.col(b).alias("v"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_r"), F.col("_b").alias("_c"), F.lit(1).alias("side"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf[pdf.side == s].sort_values("i") for s in (0, 1))
        head = {k: pdf[k].iloc[0] for k in by}
        if not len(r) or not len(c):
            return pd.DataFrame(columns=[*by, "i", "side", "above", "equal", "of", "missing"])
        width = max(map(len, [*r.v, *c.v]))
        none = np.full(width, np.nan)
        x, y = (np.array([v if len(v) == width else none for v in s.v], np.float64).reshape(len(s), width) for s in (r, c))
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
            s = np.round(x @ y.T, 12)
        ri, ci = r.i.to_numpy(), c.i.to_numpy()
        off = ri[:, None] != ci[None, :]
        out = []
        for side, own, ids, m, o, first in (
            (0, r.own, ri, s, off, ci[None, :] < ri[:, None]),
            (1, c.own, ci, s.T, off.T, ri[None, :] < ci[:, None]),
        ):
            v = np.round(own.to_numpy(np.float64), 12)[:, None]
            out.append(pd.DataFrame({"i": ids, "side": side, "above": ((m > v) & o).sum(1) + ((m == v) & o & first).sum(1), "equal": ((m >= v) & o).sum(1), "of": m.shape[1], "missing": ~np.isfinite(v[:, 0])}))
        return pd.concat(out).assign(**head)[[*by, "i", "side", "above", "equal", "of", "missing"]]

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    t = rows.unionByName(cols).groupBy(*by, "_r", "_c").applyInPandas(tile, f"{kinds}, i long, side int, above long, equal long, of long, missing boolean")
    pick = lambda c, s: F.sum(F.when(F.col("side") == s, F.col(c)))
    out = t.groupBy(*by, "i").agg((pick("above", 0) + 1).alias("row_rank"), (pick("above", 1) + 1).alias("col_rank"), pick("of", 0).alias("_rows"), pick("of", 1).alias("_cols"), F.sum("equal").alias("_e"), F.max("missing").alias("missing"))
    rank = lambda c, n: F.when(F.col("missing"), F.col(n)).otherwise(F.col(c)).alias(c)
    return out.select(*by, "i", rank("row_rank", "_rows"), rank("col_rank", "_cols"), ((F.col("_e") == 0) & ~F.col("missing")).alias("strict"), "missing")


def weighted_mean(df: DataFrame, by: list[str], position: str, v: str) -> DataFrame:
    """Mean of vectors weighted by their position from 1, and the vector of the last position."""
    e = df.select(*by, position, F.posexplode(v).alias("_d", "_x"))
    w = e.groupBy(*by, "_d").agg((F.sum(F.col("_x").cast("double") * F.col(position)) / F.sum(position)).alias("weighted"), F.max_by("_x", position).cast("double").alias("last"))
    return w.withColumnRenamed("_d", "dim")


#: Numbers of a set of centroids, which goes to every worker.
MOST_NUMBERS = 50_000_000


def nearest(df: DataFrame, centroids: np.ndarray, key: str, v: str) -> DataFrame:
    """`key, centroid, distance` of the nearest of a fixed set of centroids, the first on ties; null for a vector that is missing or of another size."""
    if centroids.size > MOST_NUMBERS:
        raise ValueError(f"{centroids.shape} is more than a worker may hold")
    shared = df.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))

    def assign(batches):
        c = shared.value
        for b in batches:
            ok = np.array([x is not None and len(x) == c.shape[1] and len(c) > 0 for x in b[v]], bool)
            x = np.array([x for x, good in zip(b[v], ok, strict=True) if good], np.float64).reshape(ok.sum(), c.shape[1])
            k, near = np.full(len(b), None, object), np.full(len(b), np.nan)
            if len(x):
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                k[ok] = d.argmin(1)
                near[ok] = np.sqrt(np.maximum(0, d.min(1)))
            out = pd.DataFrame({key: b[key], "centroid": pd.array(k, "Int32"), "distance": near})
            out["distance"] = out["distance"].astype(object).where(ok, None)
            yield out

    return df.select(key, v).mapInPandas(assign, f"`{key}` {df.schema[key].dataType.simpleString()}, centroid int, distance double")
