"""Data-quality gates: each gives its violations as rows; `enforce` ends the job if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def enforce(violations: DataFrame, what: str, show: int = 5) -> None:
    bad = violations.limit(show).collect()
    if bad:
        raise GateError(f"{what}: {[r.asDict() for r in bad]}")


def exact_columns(df: DataFrame, names: list[str]) -> None:
    if df.columns != names:
        raise GateError(f"columns {df.columns}, expected {names}")


def non_empty(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise GateError(f"{what}: no rows")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def without_partner(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    j = a.join(b, key, "full_outer").where("in_left is null or in_right is null")
    return j.select(key, F.when(F.col("in_right").isNull(), "missing").otherwise("extra").alias("problem"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that a conversion lost or made."""
    return left.exceptAll(right).withColumn("side", F.lit("lost")).unionByName(right.exceptAll(left).withColumn("side", F.lit("made")))


def at_least(df: DataFrame, n: int, what: str) -> None:
    """The requested number of rows has to be reached; no more than that many are looked at."""
    got = df.limit(n).count()
    if got < n:
        raise GateError(f"{what}: {got} rows, {n} requested")


def some_of(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Rows that meet the condition; none at all ends the job."""
    out = df.where(condition)
    if out.isEmpty():
        raise GateError(f"{what}: no rows")
    return out


def too_long(df: DataFrame, keys: list[str], parts: list[Column], limit: int) -> DataFrame:
    """`keys, total` of rows whose parts together are over the limit, as a prompt and the tokens to be generated."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.select(*keys, total.alias("total")).where(F.col("total") > limit)


def in_both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two sets share though they have to be disjoint."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def row_count(df: DataFrame, n: int, what: str) -> None:
    got = df.count()
    if got != n:
        raise GateError(f"{what}: {got} rows, expected {n}")


def verdict_violations(verdicts: DataFrame, packets: DataFrame, conditions: list[str]) -> DataFrame:
    """A row for each verdict that isn't one: unknown or missing condition, marks out of range or missing, blank reason.

    `verdicts` has question_id, condition, marks, reason; `packets` question_id and marks_available. A verdict is unknown if no
    packet asks for it; where the marks available are null any number from 0 is in range.
    """
    want = packets.select("question_id", "marks_available").withColumn("asked", F.lit(True)).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    j = want.join(verdicts.withColumn("given", F.lit(True)), ["question_id", "condition"], "full_outer")
    problem = (
        F.when(F.col("given").isNull(), "missing")
        .when(F.col("asked").isNull(), "unknown")
        .when(F.col("marks").isNull(), "no marks")
        .when((F.col("marks") < 0) | (F.col("marks") > F.col("marks_available")), "marks out of range")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason")
    )
    return j.withColumn("problem", problem).where("problem is not null").select("question_id", "condition", "problem")
