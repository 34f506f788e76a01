"""Queries of the editorial work: questions suggested for sections, stable assignment, revisions, proofs and term rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import assign, revision, suggest, terms
from quillspark.plans.reports import cents
from quillspark.sources.tables import table

#: Questions per section description, essays per section.
QUESTIONS, ESSAYS = 10, 40


def _turn(role: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("role") == role).select("conv_id", "turn", (F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "text")


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = suggest.indexed(_turn("user", spark, sf_dir), "id", "text")
    return suggest.suggested(index, table(spark, sf_dir, "benchmark"), "item_id", "text", QUESTIONS)


def question_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten questions (what users asked) that fit each section description (benchmark items) best."""
    return _suggested(spark, sf_dir)


def suggested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a suggested question: only these go on to the selection."""
    answers = _turn("assistant", spark, sf_dir).select("conv_id", "turn", (F.col("id") - 1).alias("question_id"))
    return suggest.answering(answers, "question_id", _suggested(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return assign.candidate_pairs(lines, "l_orderkey", "l_suppkey", -F.col("l_quantity").cast("long"), cents("l_extendedprice"))


def stable_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each essay in at most one section, at most 40 in each: essays rank sections, sections score essays."""
    return assign.assigned(_pairs(spark, sf_dir), ESSAYS)[0].drop("place")


def _proofs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and a revision of them: a first line more, lines with a mark left out, the first two lines swapped in every third, spelling changed in long lines."""
    before = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit("!")))
    spelt = F.transform(lines, lambda x: F.when(F.length(x) > 60, F.replace(x, F.lit("ou"), F.lit("oo"))).otherwise(x))
    swapped = F.when((F.col("doc_id") % 3 == 0) & (F.size(spelt) > 1), F.concat(F.slice(spelt, 2, 1), F.slice(spelt, 1, 1), F.slice(spelt, F.lit(3), F.size(spelt)))).otherwise(spelt)
    after = before.select("doc_id", F.array_join(F.concat(F.array(F.lit("proof")), swapped), "\n").alias("text"))
    return before, after


def revision_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that a revision kept, inserted, deleted or replaced."""
    before, after = _proofs(spark, sf_dir)
    return revision.hunks(before, after, "doc_id", "text")


def revision_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision, rebuilt from the original and the hunks."""
    before, after = _proofs(spark, sf_dir)
    new = revision.applied(before, revision.hunks(before, after, "doc_id", "text"), "doc_id", "text")
    return new.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def proof_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every sentence: kept, moved, changed, missing or added."""
    before, after = _proofs(spark, sf_dir)
    return revision.sentence_report(before, after, "doc_id", "text")


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least five letters of the benchmark, and each without its last letter; what stands for them may be nothing."""
    word = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    every = word.unionByName(word.select(F.expr("substring(term, 1, length(term) - 1)").alias("term"))).distinct()
    return every.select("term", F.when(F.length("term") % 5 == 0, F.lit("")).otherwise(F.upper(F.substring("term", 1, 3))).alias("replacement"))


def term_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a rule table of many terms."""
    done = terms.replaced(table(spark, sf_dir, "documents"), _rules(spark, sf_dir), "doc_id", "text")
    return done.select(F.col("key").alias("doc_id"), F.size("hits").cast("long").alias("n_hits"), F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule was used, and in how many documents."""
    return terms.used(terms.replaced(table(spark, sf_dir, "documents"), _rules(spark, sf_dir), "doc_id", "text"))


QUERIES = {f.__name__: f for f in (question_suggestions, suggested_answers, stable_assignment, revision_hunks, revision_applied, proof_report, term_replacements, term_hits)}

_SUGGESTED = r"""
    words AS (SELECT conv_id * 10000 + turn AS question, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations WHERE role = 'user'),
    lengths AS (SELECT question, COUNT(*) AS length FROM words GROUP BY 1),
    postings AS (SELECT question, term, COUNT(*) AS tf FROM words GROUP BY 1, 2),
    frequencies AS (SELECT term, COUNT(*) AS df FROM postings GROUP BY 1),
    totals AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, SUM(length) / CAST(COUNT(*) AS DOUBLE) AS mean FROM lengths),
    asked AS (SELECT item_id AS section, term, COUNT(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY 1, 2),
    scored AS (
        SELECT section, question, COUNT(*) AS shared, CAST(SUM(times * CAST(floor(1e6 * ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE)
               / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS BIGINT)) AS BIGINT) AS score
        FROM asked JOIN postings USING (term) JOIN frequencies USING (term) JOIN lengths USING (question), totals GROUP BY 1, 2),
    suggested AS (
        SELECT section, CAST(place AS INTEGER) AS place, question, score, shared
        FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, question) AS place FROM scored) WHERE place <= 10)"""
_RULES = """
    word AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark),
    rules AS (SELECT term, CASE WHEN length(term) % 5 = 0 THEN '' ELSE upper(substr(term, 1, 3)) END AS replacement FROM (FROM word UNION SELECT substr(term, 1, length(term) - 1) FROM word)),
    pattern AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM rules),
    found AS (SELECT doc_id, text, regexp_extract_all(text, (SELECT p FROM pattern)) AS hits FROM documents)"""

ORACLES = {
    "question_suggestions": f"WITH {_SUGGESTED} FROM suggested",
    "suggested_answers": f"""WITH {_SUGGESTED}
        SELECT conv_id, turn, conv_id * 10000 + turn - 1 AS question_id FROM conversations
        WHERE role = 'assistant' AND conv_id * 10000 + turn - 1 IN (SELECT question FROM suggested)""",
    # Bars of all sections, round by round; a round in which no section has too many is the last.
    "stable_assignment": """
        WITH RECURSIVE pairs AS MATERIALIZED (
            SELECT l_orderkey AS essay, l_suppkey AS section, arg_min(struct_pack(rank, score), (rank, -score)) AS b
            FROM (SELECT l_orderkey, l_suppkey, -CAST(l_quantity AS BIGINT) AS rank, CAST(round(l_extendedprice * 100) AS BIGINT) AS score FROM lineitem) GROUP BY 1, 2),
        bars AS (
            SELECT DISTINCT section, NULL::BIGINT AS bar_score, NULL::BIGINT AS bar_essay, true AS live FROM pairs
            UNION ALL
            SELECT section, COALESCE(new_score, bar_score), COALESCE(new_essay, bar_essay), live
            FROM (
                SELECT r.section, r.bar_score, r.bar_essay, n.new_score, n.new_essay, bool_or(n.new_score IS NOT NULL) OVER () AS live
                FROM bars r LEFT JOIN (
                    SELECT section, score AS new_score, essay AS new_essay
                    FROM (
                        SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, essay) AS place, COUNT(*) OVER (PARTITION BY section) AS n
                        FROM (
                            SELECT p.essay, p.section, p.b.score AS score, row_number() OVER (PARTITION BY p.essay ORDER BY p.b.rank, p.section) AS choice
                            FROM pairs p JOIN bars q USING (section)
                            WHERE q.bar_score IS NULL OR p.b.score > q.bar_score OR (p.b.score = q.bar_score AND p.essay <= q.bar_essay))
                        WHERE choice = 1)
                    WHERE place = 40 AND n > 40) n USING (section))
            WHERE live),
        final AS (SELECT section, max((bar_score, -bar_essay)) FILTER (bar_score IS NOT NULL) AS bar FROM bars GROUP BY 1)
        SELECT essay, section, score FROM (
            SELECT p.essay, p.section, p.b.score AS score, row_number() OVER (PARTITION BY p.essay ORDER BY p.b.rank, p.section) AS choice
            FROM pairs p JOIN final q USING (section) WHERE q.bar IS NULL OR (p.b.score, -p.essay) >= q.bar)
        WHERE choice = 1""",
    "revision_applied": """
        WITH lines AS (
            SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, '!')), lambda x: CASE WHEN length(x) > 60 THEN replace(x, 'ou', 'oo') ELSE x END) AS ls FROM documents),
        new AS (
            SELECT doc_id, array_to_string(list_concat(['proof'], CASE WHEN doc_id % 3 = 0 AND len(ls) > 1 THEN list_concat(ls[2:2], ls[1:1], ls[3:]) ELSE ls END), chr(10)) AS t FROM lines)
        SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM new""",
    "term_replacements": f"""
        WITH {_RULES},
        cut AS (SELECT doc_id, hits, string_split_regex(text, (SELECT p FROM pattern)) AS parts FROM found),
        named AS (SELECT map_from_entries(list((term, replacement))) AS m FROM rules),
        new AS (SELECT doc_id, len(hits) AS n_hits, array_to_string(list_transform(parts, lambda x, i: x || CASE WHEN i <= len(hits) THEN m[hits[i]] ELSE '' END), '') AS t FROM cut, named)
        SELECT doc_id, n_hits, length(t) AS n_chars, md5(t) AS text_md5 FROM new""",
    "term_hits": f"""
        WITH {_RULES}, each AS (SELECT doc_id, unnest(hits) AS term FROM found)
        SELECT term, replacement, COUNT(*) AS hits, COUNT(DISTINCT doc_id) AS texts FROM each JOIN rules USING (term) GROUP BY 1, 2""",
}
