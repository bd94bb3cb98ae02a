"""Selection of answers, joins with verdicts, routing, gains and report tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION = "array<struct<question_id:string,question_number:string,text_ga:string,rubric_ga:string,marks_available:int,blanks_required:int,canuint:string>>"


def questions(clips: DataFrame) -> DataFrame:
    """A row for each question of each clip; clips without questions have none."""
    q = clips.select("snippet_id", "year", F.explode(F.from_json("questions_json", QUESTION)).alias("q"))
    return q.select("snippet_id", F.coalesce("year", F.lit(0)).alias("year"), "q.*")


def best_row(df: DataFrame, by: list[str], score: Column, order: list[str]) -> DataFrame:
    """The row of greatest score of each group, the first in order on ties; null scores last, but kept if alone.

    An aggregate, so rows are combined before the shuffle and no group is sorted.
    """
    cols = [F.col(c) for c in df.columns]
    least = [F.struct(F.coalesce(-score, F.lit(float("inf"))).alias("s"), *[F.col(o) for o in order])]
    return df.groupBy(*by).agg(F.min_by(F.struct(*cols), least[0]).alias("_r")).select("_r.*")


def answer_score(policy: str = "confidence") -> Column:
    """Score of a decoded row: confidence, longest or first."""
    if policy == "longest":
        return F.length(F.trim("hypothesis")).cast("double")
    if policy == "first":
        return F.lit(0.0)
    return F.when(F.trim("hypothesis") != "", F.col("mean_logprob"))


def pivoted(df: DataFrame, row: str, column: str, value: Column, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Long to wide with the given columns; rows in a dimension without data stay, null."""
    p = df.groupBy(row).pivot(column, columns).agg(value)
    return rows.join(p, row, "left") if rows is not None else p


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames with different columns one under another; columns by first appearance, null where missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def route(score_a: Column, score_b: Column, a: str, b: str, tie: str = "tie") -> Column:
    return F.when(score_a > score_b, F.lit(a)).when(score_b > score_a, F.lit(b)).otherwise(F.lit(tie))


def last_of(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_r")).select("_r.*")


def judged(rows: DataFrame, verdicts: DataFrame, answer: str = "answer") -> DataFrame:
    """`rows` with the `marks` and `reason` of their stored verdict on (model, question_id, condition).

    Without one a blank answer has 0 marks and its reason, any other has null marks: it is pending.
    """
    v = verdicts.select("model", "question_id", "condition", F.col("marks").alias("_marks"), F.col("reason").alias("_reason"), F.lit(True).alias("_told"))
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""
    j = rows.join(v, ["model", "question_id", "condition"], "left")
    marks = F.when(F.col("_told"), F.col("_marks")).when(blank, 0)
    reason = F.when(F.col("_told"), F.coalesce("_reason", F.lit(""))).when(blank, "no answer given")
    return j.withColumns({"marks": marks, "reason": reason}).drop("_marks", "_reason", "_told")


def best_over(scores: DataFrame, by: list[str], layer: str, score: str) -> DataFrame:
    """`by, best, best_layer`: the greatest score over layers, the first layer that has it; from 0, so layer 0 where none is above it.

    Scores that are null or not a number are left out.
    """
    s = F.when(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.col(score) > 0), F.col(score))
    best = F.max_by(layer, F.when(s.isNotNull(), F.struct(s, -F.col(layer))))
    return scores.groupBy(*by).agg(F.coalesce(F.max(s), F.lit(0.0)).alias("best"), F.coalesce(best, F.lit(0)).alias("best_layer"))


def nested_as_json(df: DataFrame) -> DataFrame:
    """`df` with nested columns (structs, arrays, maps) as JSON text, nulls inside kept; plain columns stay as they are."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if kinds[c] in ("struct", "array", "map") else F.col(c) for c in df.columns])


def before_after(head: Column, before: Column, after: Column) -> Column:
    """A block of text that sets what was beside what is now; null is a dash."""
    dash = lambda c: F.coalesce(c, F.lit("–"))
    return F.concat(F.lit("## "), head, F.lit("\n- before: "), dash(before), F.lit("\n- after: "), dash(after))


def chart(df: DataFrame, mark: str, x: str, y: str, value: str | None = None, limit: int = 5000) -> str:
    """A small report frame as a Vega-Lite document: `rect` with `value` is a heat map, `bar` groups by it, `line` has one for each."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    kind = {f.name: "quantitative" if f.dataType.typeName() in ("double", "float", "long", "integer", "bigint", "int") else "nominal" for f in df.schema}
    axes = {"x": {"field": x, "type": "nominal" if mark in ("rect", "bar") else kind[x]}, "y": {"field": y, "type": "nominal" if mark == "rect" else kind[y]}}
    if value:
        axes["color"] = {"field": value, "type": kind[value]}
        if mark == "bar":
            axes["xOffset"] = {"field": value}
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": mark, "data": {"values": [r.asDict(recursive=True) for r in rows]}, "encoding": axes}, ensure_ascii=False, default=str)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; null is a dash. It goes to the driver, so larger frames are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["–" if v is None else str(v) for v in r]) for r in rows]])
