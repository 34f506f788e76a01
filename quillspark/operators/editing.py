"""Selecting, checking and revising manuscripts for publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_section(candidates: DataFrame, section: str, score: str, key: str, most: int, threshold: int = 80) -> DataFrame:
    """The `most` best candidates of each section, those at the threshold first, with a reason.

    Spark limits each task to `most` rows per section before the shuffle, so a hot section stays cheap.
    """
    order = Window.partitionBy(section).orderBy(F.col(score).desc_nulls_last(), key)
    ranked = candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    reached = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return ranked.withColumn("reason", F.when(reached, "score").otherwise("fill"))


def identity_flags(rows: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, mismatched fields and whether a person has to look: fields compare with nulls as values; unknown keys need a look too."""
    other = known.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    both = rows.join(other, F.col(key) == F.col("_k"), "left")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_o_{f}")), F.lit(f)) for f in fields]))
    return both.select(key, F.concat_ws(",", wrong).alias("mismatched"), (F.col("_k").isNull() | (F.size(wrong) > 0)).alias("needs_review"))


def line_diff(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, before, after of lines that differ at the same place."""
    lines = lambda df, name: df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", name))
    both = lines(before, "before").join(lines(after, "after"), [key, "pos"], "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut after a full stop, question or exclamation mark and at line ends."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def proof_changes(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence, change ('missing' or 'added') of sentences that only one side holds; counts do not matter."""
    own = lambda df: df.select(key, F.explode(sentences(F.col(text))).alias("sentence")).distinct()
    old, new = own(before), own(after)
    gone = old.join(new, [key, "sentence"], "left_anti").withColumn("change", F.lit("missing"))
    return gone.unionByName(new.join(old, [key, "sentence"], "left_anti").withColumn("change", F.lit("added")))


def replaced_terms(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules (pattern, replacement) in order; with a handful of rules one projection, no join."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def subtitle_problems(rows: DataFrame, section: str, subtitle: str, most: int = 25) -> DataFrame:
    """section, subtitle, n, too_long, repeated of subtitles that are too long or stand twice in a section."""
    counted = rows.groupBy(section, subtitle).agg(F.count("*").alias("n"))
    flagged = counted.withColumn("too_long", F.length(subtitle) > most).withColumn("repeated", F.col("n") > 1)
    return flagged.filter("too_long OR repeated")


def export_name(*parts: Column) -> Column:
    """Non-empty parts joined by underscores, without characters that file systems refuse."""
    return F.concat_ws("_", *[F.nullif(F.regexp_replace(F.trim(p), r'[\\/:*?"<>|\s]+', "-"), F.lit("")) for p in parts])


def progress(rows: DataFrame, group: str, states: dict[str, Column]) -> DataFrame:
    """Rows per group and how many satisfy each condition, in one aggregation."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in states.items()])


def insert_by_names(rows: DataFrame, people: DataFrame, questions: DataFrame) -> DataFrame:
    """person_id, question_id, answer for rows of (name, cohort, key, answer): equi-joins, so shared names and keys fan out as a product of the few that fit."""
    return rows.join(people, ["name", "cohort"]).join(questions, ["cohort", "key"]).select("person_id", "question_id", "answer")
