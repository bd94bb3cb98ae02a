"""Problem 6: oversized unit sequences cut into pieces at natural boundaries, by content-defined chunking.

A rolling hash over the last WINDOW units marks landmarks wherever its low bits are zero. Each landmark snaps to the nearest
natural boundary (just after a pause or breath) between the least and the largest piece; so an edit moves only the cuts near
it. Where no landmark has a boundary, the last boundary in reach is taken; a stretch without any is cut at its last landmark
in reach, or at the full length if it has none. Consecutive pieces share `overlap` units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasra.operators.sequences import one_of_each
from glasra.tables import read

#: Largest piece, overlap, least new units of a piece.
LARGEST, OVERLAP, LEAST = 1024, 64, 384
#: Units that the rolling hash looks back on, and its bits that have to be zero: a landmark in 128 units.
WINDOW, MASK = 16, 127
#: Multiplier of the rolling hash, and kinds of units at which a cut is natural.
BASE = 0x9E3779B1
NATURAL = ("pause", "breath")
#: Natural units that go to every worker, 8 bytes each; with more, their places are found by a join.
NATURAL_UNITS = 1_000_000
#: Parts that the places of one unit are dealt into for that join, as a pause is in every sequence.
SALT = 16


def landmarks(units: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW units has zero low bits. Depends on these units only."""
    n = len(units)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    x = units.astype(np.int64).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(BASE) + x[k : n - WINDOW + 1 + k]
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(MASK)) == 0) + WINDOW


def cuts(units: np.ndarray, natural: np.ndarray, largest: int = LARGEST, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, str]]:
    """Pieces (start, end, how it was cut) of a sequence; they cover it, none is longer than `largest`.

    The first piece starts at 0, each further one `overlap` units before the end of the last. How: natural, landmark, forced, end.
    """
    n = len(units)
    if n == 0:
        return []
    if n <= largest:
        return [(0, n, "end")]
    bounds = np.flatnonzero(natural) + 1
    marks = landmarks(units)
    out, start, done = [], 0, 0
    while n - start > largest:
        lo, hi = min(done + least, start + largest), start + largest
        own = bounds[np.searchsorted(bounds, max(done + 1, start + overlap + 1)) : np.searchsorted(bounds, hi, side="right")]
        near = marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi, side="right")]
        if len(own):
            how, late = "natural", own[own >= lo]
            if len(late) and len(near):
                # the first landmark snaps to the boundary nearest to it
                cut = int(late[np.argmin(np.abs(late - near[0]))])
            else:
                cut = int(own[-1])
        elif len(near):
            how, cut = "landmark", int(near[-1])
        else:
            how, cut = "forced", hi
        out.append((start, cut, how))
        done, start = cut, max(0, cut - overlap)
    out.append((start, n, "end"))
    return out


def unbroken(natural: np.ndarray, pieces: list[tuple[int, int, str]], longest: int = LARGEST) -> list[int]:
    """First positions of the stretches of more than `longest` units without a natural boundary, from the cuts of `pieces`.

    No piece holds such a stretch, so a piece ends inside it, where no boundary is. Each cut that isn't natural is set back to
    the boundary before it and ahead to the one after it; what lies between is long enough or a shorter stretch.
    """
    inside = [end for _, end, how in pieces if how in ("landmark", "forced")]
    if not inside:
        return []
    edge = np.concatenate(([-1], np.flatnonzero(natural), [len(natural)]))
    at = np.unique(np.searchsorted(edge, inside, side="left"))
    return (edge[at - 1][edge[at] - edge[at - 1] - 1 > longest] + 1).tolist()


def _natural_places(clips: DataFrame, natural: DataFrame) -> DataFrame:
    """`clips` (`key, units`) with `places`, those of natural units: a join on unit and salt instead of a table in each worker."""
    d = clips.select("key", "units", F.xxhash64("key", "units").alias("of"))
    at = d.select("of", F.posexplode("units").alias("pos", "unit")).withColumn("salt", F.pmod("pos", F.lit(SALT)))
    n = natural.select("unit", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    places = at.join(n, ["unit", "salt"]).groupBy("of").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    return d.join(places, "of", "left").select("key", "units", F.coalesce("places", F.array().cast("array<int>")).alias("places"))


def _run(clips: DataFrame, inventory: DataFrame, want: str, key: str, units: str, unit: str, kind: str, largest: int, overlap: int, least: int) -> DataFrame:
    plain = clips.select(clips[key].alias("key"), clips[units].alias("units")).where(F.col("units").isNotNull() & (F.size("units") > 0))
    schema = "key string, start_pos int" if want == "unbroken" else "key string, piece int, start_pos int, end_pos int, cut string, units array<int>"
    natural_units = inventory.where(F.col(kind).isin(*NATURAL)).select(F.col(unit).alias("unit")).where("unit is not null").distinct()
    known = None
    rows = natural_units.limit(NATURAL_UNITS + 1).collect()
    if len(rows) > NATURAL_UNITS:
        plain = _natural_places(plain, natural_units)
    else:
        known = clips.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in rows), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, col = b.column(0), b.column(1)
            flat = col.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) for x in col], np.int64)
            ends = np.cumsum(sizes)
            if known is not None:
                natural = np.isin(flat, known.value) & col.flatten().is_valid().to_numpy(zero_copy_only=False)
            else:
                natural = np.zeros(len(flat), bool)
                places = b.column(2)
                natural[places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(ends - sizes, [len(x) for x in places])] = True
            at: list[int] = []
            rows: list[tuple] = []
            for k, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                own, nat = flat[e - n : e], natural[e - n : e]
                pieces = cuts(own, nat, largest, overlap, least)
                if want == "unbroken":
                    new = [(p,) for p in unbroken(nat, pieces, largest)]
                else:
                    new = [(p, s, t, how, own[s:t].astype(np.int32)) for p, (s, t, how) in enumerate(pieces)]
                rows += new
                at += [k] * len(new)
            if not at:
                continue
            own_keys = keys.take(pa.array(at))
            if want == "unbroken":
                yield pa.RecordBatch.from_arrays([own_keys, pa.array([r[0] for r in rows], pa.int32())], names=["key", "start_pos"])
            else:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([own_keys, *[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(list(cols[4]), pa.list_(pa.int32()))], names=["key", "piece", "start_pos", "end_pos", "cut", "units"])

    return plain.mapInArrow(run, schema)


def pieces(clips: DataFrame, inventory: DataFrame, key: str = "key", units: str = "units", unit: str = "unit", kind: str = "kind", largest: int = LARGEST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """`key, piece, start_pos, end_pos, cut, units`: the pieces of each distinct sequence, whole ones as one piece.

    Null and empty arrays have none; ids outside the inventory, null ids too, are neither pause nor breath; repeated keys count
    once if their content is the same.
    """
    once = one_of_each(clips.select(key, units), [key, units])
    return _run(once, inventory, "pieces", key, units, unit, kind, largest, overlap, least)


def unbroken_stretches(clips: DataFrame, inventory: DataFrame, key: str = "key", units: str = "units", unit: str = "unit", kind: str = "kind", largest: int = LARGEST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Distinct `key, start_pos` of stretches longer than the largest piece in which no cut is natural."""
    return _run(clips, inventory, "unbroken", key, units, unit, kind, largest, overlap, least).distinct()


def p6_found(spark, sf_dir: str) -> DataFrame:
    return unbroken_stretches(read(spark, sf_dir, "cluas_units"), read(spark, sf_dir, "unit_inventory"))


def p6_pieces(spark, sf_dir: str) -> DataFrame:
    return pieces(read(spark, sf_dir, "cluas_units"), read(spark, sf_dir, "unit_inventory"))


def p6_piece_report(spark, sf_dir: str) -> DataFrame:
    p = p6_pieces(spark, sf_dir)
    return p.groupBy("cut").agg(F.count("*").alias("n_pieces"), F.min(F.size("units")).alias("shortest"), F.max(F.size("units")).alias("longest"))
