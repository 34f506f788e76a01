"""Question suggestion: an inverted index over questions, ranked for section descriptions by BM25.

Scores are sums of whole millionths, so that they do not depend on the order in which tasks add them up.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import written

K1, B = 1.2, 0.75
#: Tasks that the postings of a hot term are dealt over; hot terms number at most MOST_HOT, whatever the questions.
SALTS, MOST_HOT = 32, 4096


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class Index(NamedTuple):
    """Written postings (question, term, tf, length), the questions that hold each term, and the totals of the questions with words."""

    postings: DataFrame
    frequencies: DataFrame
    n: int
    length: int
    rows: int


def indexed(questions: DataFrame, question: str, text: str) -> Index:
    """An index of the questions' texts; texts that are null or without words are not in it. `question` tells the questions apart."""
    worded = questions.select(F.col(question).alias("question"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    counted = worded.select("question", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("question", "term", "length").agg(F.count("*").alias("tf"))
    postings = written(counted, "postings")
    frequencies = written(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    per_question = postings.groupBy("question").agg(F.first("length").alias("length"))
    n, length, rows = per_question.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).crossJoin(postings.agg(F.count("*"))).first()
    return Index(postings, frequencies, n, length, rows)


def impact(tf: Column, length: Column, df: Column, n: int, all_: int) -> Column:
    """What one occurrence of a term in the description adds to the score of a question, in millionths."""
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + F.lit(0.5)) / (df + F.lit(0.5)))
    mean = F.lit(all_ / max(1, n))
    return F.floor(F.lit(1e6) * idf * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / mean))).cast("long")


def suggested(index: Index, sections: DataFrame, section: str, text: str, most: int) -> DataFrame:
    """section, place, question, score, shared: the `most` best questions of every section description, equal scores by question; shared counts the terms in common.

    Terms that very many questions hold are dealt over SALTS tasks, and the description's side
    repeats for these terms only. Scores are summed per (section, question) with partial sums, then each
    task keeps its best questions of a section, then all tasks together. Descriptions without words or matches give no rows.
    """
    hot_from = max(1000, index.rows // MOST_HOT)
    hot = index.frequencies.filter(F.col("df") > hot_from).select("term", F.lit(SALTS).alias("salts"))
    asked = sections.select(F.col(section).alias("section"), F.explode(words(F.col(text))).alias("term")).groupBy("section", "term").agg(F.count("*").alias("times"))
    salts = F.when(F.col("df") > hot_from, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = asked.join(index.frequencies, "term").withColumn("salt", F.explode(salts))
    # More than MOST_HOT terms cannot each have more postings than one in MOST_HOT of all.
    salted = index.postings.join(F.broadcast(hot), "term", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("question"), F.col("salts"))).otherwise(0).cast("int"))
    added = F.col("times") * impact(F.col("tf"), F.col("length"), F.col("df"), index.n, index.length)
    scored = salted.join(asked, ["term", "salt"]).groupBy("section", "question").agg(F.sum(added).alias("score"), F.count("*").alias("shared"))
    order = [F.col("score").desc(), F.col("question")]
    dealt = scored.withColumn("_salt", F.pmod(F.xxhash64("question"), F.lit(SALTS)))
    few = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("section", "_salt").orderBy(*order))).filter(F.col("_n") <= most)
    best = few.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).filter(F.col("place") <= most)
    return best.select("section", "place", "question", "score", "shared")


def answering(answers: DataFrame, question: str, approved: DataFrame) -> DataFrame:
    """The answers to approved questions (column `question`), whatever number of sections approved one."""
    return answers.join(approved.select(F.col("question").alias("_q")), F.col(question) == F.col("_q"), "left_semi")
