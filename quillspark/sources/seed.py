"""Deterministic synthetic entity tables, grown from row numbers and hashes; no random state, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scalars import stable_id
from quillspark.sources.schema import STUDENT_TYPES, SUBMISSION_STATES, SUSPICIONS, typed

#: Authors per cohort, questions per cohort.
COHORTS = {5: 88, 6: 81, 7: 99, 8: 69, 9: 92}
QUESTIONS = 5


def _pick(n: int, *keys: Column) -> Column:
    """0 to n - 1, from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _one_of(values: tuple, *keys: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _pick(len(values), *keys) + 1)


def seed(spark: SparkSession, copies: int = 1) -> dict[str, DataFrame]:
    """authors, questions, submissions, qna, evaluations; `copies` multiplies the authors.

    Every author has one submission, two to five answers and one evaluation (two in
    cohorts 8 and 9). Scores are multiples of 20 and sub-scores a tenth of them.
    """
    edges, at = [], 0
    for cohort, n in COHORTS.items():
        edges.append((cohort, at, at + n * copies))
        at += n * copies
    n = F.col("n")
    cohort = F.coalesce(*[F.when((n >= a) & (n < b), F.lit(c)) for c, a, b in edges])
    base = spark.range(at).select(F.col("id").alias("n")).withColumn("cohort", cohort)
    author, submission = stable_id("author", n), stable_id("sub", n)
    kind = F.when(F.col("cohort") == 6, STUDENT_TYPES[0]).otherwise(_one_of(STUDENT_TYPES, F.lit("type"), n))
    authors = base.select(
        author.alias("id"), F.concat(F.lit("author "), n.cast("string")).alias("name"), "cohort", kind.alias("student_type"),
        F.when(F.col("cohort") == 6, 0).otherwise(_pick(5, F.lit("fee"), n) * 50_000).alias("scholarship_amount"), F.format_string("010%08d", n).alias("phone"),
    )
    numbers = spark.range(1, QUESTIONS + 1).select(F.col("id").cast("int").alias("q"))
    questions = numbers.select("q", F.explode(F.array(*[F.lit(c) for c in COHORTS])).alias("cohort")).select(
        stable_id("question", F.col("cohort"), F.col("q")).alias("id"), "cohort", F.concat(F.lit("1-"), F.col("q").cast("string")).alias("question_key"),
        F.concat(F.lit("question "), F.col("q").cast("string")).alias("question_text"), F.lit("section_1").alias("category"), F.col("q").alias("sort_order"),
    )
    submissions = base.select(submission.alias("id"), author.alias("author_id"), _one_of(SUBMISSION_STATES, F.lit("state"), n).alias("status"), F.lit("2024-01-01").alias("submitted_at"))
    answers = base.withColumn("q", F.explode(F.sequence(F.lit(1), 2 + _pick(4, F.lit("answers"), n)))).select(
        stable_id("qna", n, F.col("q")).alias("id"), author.alias("author_id"), submission.alias("submission_id"),
        stable_id("question", F.col("cohort"), F.col("q")).alias("question_id"), F.concat(F.lit("answer "), F.col("q").cast("string")).alias("answer_text"),
    )
    score = (_pick(5, F.lit("score"), n, F.col("e")) + 1) * 20
    evaluations = base.withColumn("e", F.explode(F.sequence(F.lit(1), F.when(F.col("cohort") >= 8, 2).otherwise(1)))).select(
        stable_id("eval", n, F.col("e")).alias("id"), author.alias("author_id"), submission.alias("submission_id"), score.alias("total_score"),
        *[(score / 10).cast("int").alias(s) for s in ("specificity_score", "authenticity_score", "narrative_score", "usefulness_score")],
        _one_of((None, *SUSPICIONS), F.lit("suspicion"), n, F.col("e")).alias("ai_suspicion_level"),
    )
    made = {"authors": authors, "questions": questions, "submissions": submissions, "qna": answers, "evaluations": evaluations}
    return {name: typed(df, name) for name, df in made.items()}
