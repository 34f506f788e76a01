"""One essay in at most one section: stable assignment by deferred acceptance in written rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import written

#: Tasks that the proposals of a section are dealt over before its best are known.
SALTS = 32


def _allowed(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """Pairs that their section would not turn down: at or above its bar, or without one."""
    other = bars.select(F.col("section").alias("_s"), "bar_score", "bar_essay")
    above = (F.col("score") > F.col("bar_score")) | ((F.col("score") == F.col("bar_score")) & (F.col("essay") <= F.col("bar_essay")))
    return pairs.join(other, F.col("section") == F.col("_s"), "left").filter(F.col("_s").isNull() | above).select(*pairs.columns)


def _proposals(pairs: DataFrame) -> DataFrame:
    """Each essay with the section that it likes best among its pairs; partial minima keep this a plain aggregate."""
    best = pairs.groupBy("essay").agg(F.min(F.struct("rank", "section", "score")).alias("_b"))
    return best.select("essay", "_b.section", "_b.score")


def _best(proposals: DataFrame, most: int) -> DataFrame:
    """Proposals with their place in the section, 1 to `most`; a section that most essays ask for is dealt over tasks first."""
    order = [F.col("score").desc(), F.col("essay")]
    dealt = proposals.withColumn("_salt", F.pmod(F.xxhash64("essay"), F.lit(SALTS)))
    few = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("section", "_salt").orderBy(*order))).filter(F.col("_n") <= most)
    return few.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).filter(F.col("place") <= most).select("section", "place", "essay", "score")


def candidate_pairs(rows: DataFrame, essay: str, section: str, rank: Column, score: Column) -> DataFrame:
    """essay, section, rank, score, one row per pair: the lowest rank and, for that, the highest score. Rows with a null in any of the four are no candidates."""
    given = rows.select(F.col(essay).alias("essay"), F.col(section).alias("section"), rank.alias("rank"), score.alias("score")).dropna()
    return given.groupBy("essay", "section").agg(F.min(F.struct("rank", (-F.col("score")).alias("less"))).alias("_b")).select("essay", "section", "_b.rank", (-F.col("_b.less")).alias("score"))


def assigned(pairs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(essay, section, place, score of the stable assignment that is best for the essays, rounds).

    `pairs` as from candidate_pairs: essays prefer the lower rank, then the lower section;
    sections the higher score, then the lower essay, and take `most` at most. No section takes more, no essay
    stands twice, and no essay and section prefer each other to what they have.

    In each round every essay asks the section that it likes best among those that have not turned
    it down, and each section with more than `most` proposals raises its bar to the last one that it keeps. Bars only
    rise, and a pair below its bar is turned down for good, also if it was not asked yet. A round's bars, one row a
    section, are written; the driver sees one count, of sections with too many proposals, and stops at 0. Without `most` there is nothing to assign.
    """
    if most < 1:
        return pairs.select("essay", "section", F.lit(0).alias("place"), "score").limit(0), 0
    kept = written(pairs, "assignment-pairs")
    bars = kept.select("section").limit(0).select("section", F.lit(None).cast(kept.schema["score"].dataType).alias("bar_score"), F.lit(None).cast(kept.schema["essay"].dataType).alias("bar_essay"))
    rounds = 0
    while True:
        rounds += 1
        asked = _proposals(_allowed(kept, bars))
        # One more than it takes shows that a section has too many.
        best = written(_best(asked, most + 1), "assignment-round")
        crowded = best.filter(F.col("place") == most + 1).select("section")
        if not crowded.count():
            return best.select("essay", "section", "place", "score"), rounds
        raised = best.filter(F.col("place") == most).join(crowded, "section", "left_semi").select("section", F.col("score").alias("bar_score"), F.col("essay").alias("bar_essay"))
        bars = written(bars.join(raised, "section", "left_anti").unionByName(raised), "assignment-bars")


def blocking(pairs: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """Pairs whose essay and section both prefer each other to what they have: none, if an assignment is stable."""
    own = taken.join(pairs.select("essay", "section", "rank"), ["essay", "section"]).select(F.col("essay").alias("_e"), F.col("rank").alias("_rank"), F.col("section").alias("_own"))
    last = taken.groupBy(F.col("section").alias("_s")).agg(F.count("*").alias("_n"), F.min(F.struct("score", (-F.col("essay")).alias("less"))).alias("_last"))
    both = pairs.join(own, F.col("essay") == F.col("_e"), "left").join(last, F.col("section") == F.col("_s"), "left")
    essay_would = F.col("_e").isNull() | (F.struct("rank", "section") < F.struct(F.col("_rank"), F.col("_own")))
    section_would = F.col("_s").isNull() | (F.col("_n") < most) | (F.struct("score", (-F.col("essay")).alias("less")) > F.col("_last"))
    return both.filter(essay_would & section_would).select(*pairs.columns)
