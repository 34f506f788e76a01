"""Rubric scoring: job selection, reply parsing, weights and a resumable batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rubric weights and states.
WEIGHTS = {"정성_구체성": 0.4, "실용성_타겟적합성": 0.2, "독창성": 0.2, "가독성": 0.2}
FINAL = "최종_점수"
STATES = ("선별", "예비", "제외")
RISKS = ("없음", "주의", "높음")


def jobs(rows: DataFrame, first: int | None = None, last: int | None = None, force: bool = False, limit: int = 0) -> DataFrame:
    """Rows with a body in [first, last] that have no score yet (all with `force`); the first `limit`, 0 for no limit."""
    out = rows.filter(F.coalesce(F.trim("body"), F.lit("")) != "")
    if first is not None:
        out = out.filter(F.col("row") >= first)
    if last is not None:
        out = out.filter(F.col("row") <= last)
    if not force:
        out = out.filter("final_score IS NULL")
    return out.orderBy("row").limit(limit) if limit else out


def reply_json(reply: Column) -> Column:
    """The outermost {…} of a reply, without code fences; null without one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def clamped(v: Column, low: int = 0, high: int = 5) -> Column:
    """Text of a JSON value as an integer in [low, high]: true and false are 1 and 0, numbers go half to even; else null."""
    number = F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).when(F.lower(v).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), v.try_cast("double"))
    # greatest and least skip nulls, so an unreadable value is kept out of them.
    return F.when(number.isNotNull(), F.least(F.greatest(F.bround(number), F.lit(float(low))), F.lit(float(high))).cast("int"))


def status_of(score: Column) -> Column:
    return F.when(score >= 4, STATES[0]).when(score == 3, STATES[1]).otherwise(STATES[2])


def weighted(scores: dict[str, Column]) -> Column:
    """Weighted mean of the sub-scores, half to even, in 0-5; null if one is null."""
    total = sum(scores[k] * F.lit(w) for k, w in WEIGHTS.items())
    return F.when(total.isNotNull(), F.least(F.greatest(F.bround(total, 0), F.lit(0.0)), F.lit(5.0)).cast("int"))


def parsed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the scores, status, risk, remark and `valid` of each reply.

    A missing sub-score is 0; an explicit null or text that is no number makes the
    reply invalid. The model's own final score, status and risk win where they are
    valid, else they follow from the sub-scores.
    """
    # from_json to strings keeps 4.6, "3" and true apart from a missing key; null stays null in both, so the key is looked up in the text.
    fields = F.from_json(reply_json(F.col(reply)), "map<string,string>")
    df = replies.withColumn("_m", fields)
    has = lambda k: F.coalesce(F.array_contains(F.map_keys("_m"), k), F.lit(False))
    sub = {k: F.when(has(k), clamped(F.col("_m")[k])).otherwise(F.lit(0)) for k in [*WEIGHTS, "AI_사용도"]}
    df = df.withColumns(sub)
    valid = F.col("_m").isNotNull()
    for k in sub:
        valid = valid & F.col(k).isNotNull()
    final = F.coalesce(clamped(F.col("_m")[FINAL]), weighted({k: F.col(k) for k in WEIGHTS}))
    df = df.withColumn("valid", valid).withColumn(FINAL, final)
    state, risk = F.col("_m")["선별_상태"], F.col("_m")["신뢰성_리스크"]
    return (
        df.withColumn("선별_상태", F.when(state.isin(*STATES), state).otherwise(status_of(F.col(FINAL))))
        .withColumn("신뢰성_리스크", F.when(risk.isin(*RISKS), risk).otherwise(F.lit(RISKS[0])))
        .withColumn("한줄평", F.coalesce(F.trim(F.col("_m")["한줄평"]), F.lit("")))
        .drop("_m")
    )


def prompt(row: dict[str, Column]) -> Column:
    """The labelled lines of a row, as the scorer's message."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"[{k}] "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in row.items()])


def score(rows: DataFrame, scorer: Callable[[str], str], attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """row, reply, error: `scorer` applied to every message in the partitions' tasks, with retries after pause * 2**k seconds.

    The scorer is given, so tests and offline runs pass a deterministic one. An
    executor that is lost repeats its partition; the sink is keyed by row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, message in zip(batch["row"], batch["message"]):
                reply, error = None, None
                for k in range(attempts):
                    try:
                        reply, error = scorer(message), None
                        break
                    except Exception as e:  # noqa: BLE001  the error is the result
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**k)
                out.append((row, reply, error))
            yield pd.DataFrame(out, columns=["row", "reply", "error"])

    return rows.select(F.col("row").cast("long").alias("row"), "message").mapInPandas(run, "row long, reply string, error string")


def remaining(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that no earlier run has finished: what a resumed batch works on."""
    return rows.join(done.filter("error IS NULL").select("row"), "row", "left_anti")
