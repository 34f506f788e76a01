"""Dashboard, list and detail queries.

Over the shared tables a customer stands for an author (its nation for the
cohort, its segment for the type), an order for a submission, a line item for an
answer, a part for a question, a document with labels for an evaluation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.dedup import best_by
from quillspark.sources.tables import table


def cents(column: str) -> Column:
    """Money as whole hundredths, so that sums do not depend on the order of rows."""
    return F.round(F.col(column) * 100).cast("long")


def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, answers and evaluations per cohort.

    Each child is summed per author before the join, so the star of outer joins
    never multiplies rows and no distinct count is needed. Answers are dealt by their
    submission once; the distinct, the count and the join all use that.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber")
        .repartition("l_orderkey")
        .distinct()
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n_lines"))
    )
    per_author = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("n_orders"), F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_lines"))
    )
    return (
        customer.join(per_author, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy(F.col("c_nationkey").alias("cohort"))
        .agg(
            F.count("*").alias("n_authors"),
            F.sum(F.coalesce("n_orders", F.lit(0))).cast("long").alias("n_submissions"),
            F.sum(F.coalesce("n_lines", F.lit(0))).cast("long").alias("n_answers"),
        )
        .orderBy("cohort")
    )


def cohort_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee total and number of paid authors per cohort."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("cohort"))
        .agg(F.coalesce(F.sum(cents("c_acctbal")), F.lit(0).cast("long")).alias("fee"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("n_paid"))
        .orderBy("cohort")
    )


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions per status, most frequent first."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def notnull_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per quality mark, without those that have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    marked = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").filter("quality IS NOT NULL")
    return marked.groupBy("quality").agg(F.count("*").alias("n"))


def totals_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with the sizes of five tables: five counts appended, then pivoted by one aggregate."""
    names = {"authors": "customer", "submissions": "orders", "answers": "lineitem", "evaluations": "labels", "articles": "pages"}
    counts = None
    for name, source in names.items():
        one = table(spark, sf_dir, source).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("name") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in names])


def dashboard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort counts with their fees and the sum of all fees in every row.

    The window spans one row per cohort, never the authors.
    """
    counts = cohort_counts(spark, sf_dir)
    fees = cohort_fees(spark, sf_dir).select("cohort", "fee")
    return counts.join(fees, "cohort", "left").select(
        "cohort", "n_authors", "n_answers", F.coalesce("fee", F.lit(0).cast("long")).alias("fee"), F.sum("fee").over(Window.partitionBy()).alias("fee_of_all")
    )


def filtered_authors(
    authors: DataFrame, cohort: int | None = None, kind: str | None = None, university: str | None = None, name: str | None = None
) -> DataFrame:
    """Authors for whom every filter that is given holds; `%` and `_` in texts are wildcards, case does not count."""
    if cohort is not None:
        authors = authors.filter(F.col("cohort") == cohort)
    if kind:
        authors = authors.filter(F.col("student_type") == kind)
    if university:
        authors = authors.filter(F.col("final_university").ilike(f"%{university}%"))
    if name:
        authors = authors.filter(F.col("name").ilike(f"%{name}%"))
    return authors


def essays(
    authors: DataFrame, submissions: DataFrame, answers: DataFrame, evaluations: DataFrame, scores: list[str], min_score: float | None = None, most: int = 300, **filters
) -> DataFrame:
    """One row per author with the largest value of every field of the submissions and evaluations and the number of answers.

    All three children have author_id: `submissions` also status and file_url, `answers`
    answer_id, `evaluations` the columns `scores`, of which the first is the total, and
    suspicion; largest texts go by code point. They are siblings, so each is reduced
    to one row per author before the join. A minimum total drops authors without one.
    Highest cohorts first, then highest totals.
    """
    largest = lambda df, names: df.groupBy("author_id").agg(*[F.max(c).alias(c) for c in names])
    per_answer = answers.select("author_id", "answer_id").distinct().groupBy("author_id").agg(F.count("answer_id").alias("n_answers"))
    judged = largest(evaluations, [*scores, "suspicion"])
    listed = filtered_authors(authors, **filters)
    if min_score is not None:  # such authors have an evaluation
        listed = listed.join(judged.filter(F.col(scores[0]) >= min_score), "author_id")
    else:
        listed = listed.join(judged, "author_id", "left")
    listed = listed.join(largest(submissions, ["status", "file_url"]), "author_id", "left").join(per_answer, "author_id", "left")
    order = [F.col("cohort").desc_nulls_last(), F.col(scores[0]).desc_nulls_last(), "author_id"]
    return listed.withColumn("n_answers", F.coalesce("n_answers", F.lit(0)).cast("long")).orderBy(*order).limit(most)


def _essays(spark: SparkSession, sf_dir: str, **arguments) -> DataFrame:
    """Here a supplier's lines are an author's answers, and a user's events the evaluations."""
    authors = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("cohort"), F.col("c_mktsegment").alias("student_type"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string")).alias("final_university"),
    )
    submissions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("file_url"))
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("author_id"), cents("value").alias("total"), (k % 10).alias("specificity"), (k % 7).alias("authenticity"), (k % 5).alias("narrative"), (k % 3).alias("usefulness"),
        F.col("event_type").alias("suspicion"),
    )
    return essays(authors, submissions, answers, events, ["total", "specificity", "authenticity", "narrative", "usefulness"], **arguments)


def essays_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 authors by cohort and best score."""
    return _essays(spark, sf_dir)


def essays_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of one cohort, type, university and name whose best score reaches a minimum."""
    return _essays(spark, sf_dir, cohort=6, kind="BUILDING", university="ING 6", name="customer#", min_score=100)


def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cohorts and types for the filter bar."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cohort"), F.col("c_mktsegment").alias("student_type")).distinct().orderBy("cohort", "student_type")


def evaluations_list(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """The 500 best evaluations with their documents, of one language if it is given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    docs = docs.filter(F.col("lang") == lang) if lang else docs
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id").limit(500)


def author_qna(spark: SparkSession, sf_dir: str, author: int | None = None) -> DataFrame:
    """Answers with their questions; the filter on an author reaches the scan of the submissions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.filter(F.col("o_custkey") == author) if author is not None else orders
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("o_custkey", "l_orderkey", "l_linenumber", F.col("p_name").alias("question"), F.col("p_type").alias("category"), F.col("l_quantity").alias("answer"))
    )


def evaluations_of_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on a language reaches the scan of the documents."""
    return evaluations_list(spark, sf_dir, lang="fr")


def author_qna_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_qna(spark, sf_dir, author=7)


def evaluations_null_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents by quality, a missing one counting as 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "quality").orderBy(F.coalesce("quality", F.lit(0)).desc(), "doc_id").limit(50)


def articles(existing: DataFrame, candidates: DataFrame, most: int = 100) -> DataFrame:
    """All articles if there are any, else the `most` best candidates; decided inside the plan, by an anti join with one row at most."""
    any_ = F.broadcast(existing.select(F.lit(1).alias("_any")).limit(1))
    best = candidates.orderBy(F.desc("score"), "author_id").limit(most)
    return existing.unionByName(best.join(any_, F.col("_any").isNotNull(), "left_anti"))


def _articles(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    authors = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    existing = orders.filter(F.col("o_orderstatus") == status).join(authors, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.lit("editing").alias("article_status"),
        cents("o_totalprice").alias("score"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("price"),
    )
    best = orders.filter("o_totalprice >= 400000").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    fallback = authors.join(best, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit(None).cast("long").alias("id"), F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.lit("draft").alias("article_status"),
        cents("price").alias("score"), F.lit(None).cast(existing.schema["updated_at"].dataType).alias("updated_at"), "price",
    )
    return articles(existing, fallback)


def articles_list(spark: SparkSession, sf_dir: str, status: str = "F") -> DataFrame:
    """Every article, newest first; only if there is none, the 100 best authors above the threshold."""
    rows = _articles(spark, sf_dir, status).withColumn("day", F.date_format("updated_at", "yyyy-MM-dd"))
    return rows.orderBy(F.desc("updated_at"), F.desc("score"), "author_id", "id").drop("updated_at", "price")


def articles_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best articles above the threshold, as its SQL has them; `articles_list` has all articles."""
    rows = _articles(spark, sf_dir, "F").filter("id IS NOT NULL AND price >= 450000").drop("updated_at", "price")
    return rows.orderBy(F.desc("score"), "author_id", "id").limit(100)


def articles_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No article has this status, so the 100 best authors above the threshold stand in."""
    return _articles(spark, sf_dir, "X").drop("updated_at", "price").orderBy(F.desc("score"), "author_id", "id")


def latest_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest submission of every author: partial maxima instead of a sort per author."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    newest = best_by(orders, ["o_custkey"], F.col("o_orderdate"), -F.col("o_orderkey"))
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


QUERIES = {
    "cohort_counts": cohort_counts,
    "cohort_fees": cohort_fees,
    "status_rollup": status_rollup,
    "notnull_rollup": notnull_rollup,
    "totals_row": totals_row,
    "dashboard_join": dashboard_join,
    "essays_list": essays_list,
    "essays_filtered": essays_filtered,
    "evaluations_of_language": evaluations_of_language,
    "evaluations_null_as_zero": evaluations_null_as_zero,
    "author_qna_of_one": author_qna_of_one,
    "filter_options": filter_options,
    "evaluations_list": evaluations_list,
    "author_qna": author_qna,
    "articles_list": articles_list,
    "articles_existing": articles_existing,
    "articles_fallback": articles_fallback,
    "latest_per_author": latest_article,
}

_COHORTS = """
    SELECT c_nationkey AS cohort,
           COUNT(DISTINCT c_custkey) AS n_authors,
           COUNT(DISTINCT o_orderkey) AS n_submissions,
           COUNT(DISTINCT l_orderkey * 10 + l_linenumber) AS n_answers
    FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_nationkey"""
_FEES = """
    SELECT c_nationkey AS cohort, CAST(COALESCE(SUM(CAST(round(c_acctbal * 100) AS BIGINT)), 0) AS BIGINT) AS fee,
           COUNT(CASE WHEN c_acctbal > 0 THEN 1 END) AS n_paid
    FROM customer GROUP BY c_nationkey"""
#: The star of three siblings as one join, so every maximum and count runs over the multiplied rows.
_ESSAYS = """
    SELECT c_custkey AS author_id, c_name AS name, c_nationkey AS cohort, c_mktsegment AS student_type, c_mktsegment || ' ' || c_nationkey AS final_university,
           MAX(o_orderstatus) AS status, MAX(o_orderpriority) AS file_url, COUNT(DISTINCT l_orderkey * 10 + l_linenumber) AS n_answers,
           MAX(CAST(round(value * 100) AS BIGINT)) AS total, MAX(CAST(props->>'$.k' AS INTEGER) % 10) AS specificity, MAX(CAST(props->>'$.k' AS INTEGER) % 7) AS authenticity,
           MAX(CAST(props->>'$.k' AS INTEGER) % 5) AS narrative, MAX(CAST(props->>'$.k' AS INTEGER) % 3) AS usefulness, MAX(event_type) AS suspicion
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_suppkey = c_custkey LEFT JOIN events ON user_id = c_custkey
    WHERE {where} GROUP BY c_custkey, c_name, c_nationkey, c_mktsegment HAVING {having}
    ORDER BY cohort DESC NULLS LAST, total DESC NULLS LAST, author_id LIMIT 300"""
_CANDIDATES = """
    SELECT CAST(NULL AS BIGINT) AS id, c_custkey AS author_id, c_name AS name, 'draft' AS article_status,
           MAX(CAST(round(o_totalprice * 100) AS BIGINT)) AS score
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice >= 400000
    GROUP BY c_custkey, c_name ORDER BY score DESC, author_id LIMIT 100"""

ORACLES = {
    "cohort_counts": f"{_COHORTS} ORDER BY c_nationkey NULLS FIRST",
    "cohort_fees": f"{_FEES} ORDER BY c_nationkey NULLS FIRST",
    "status_rollup": "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, status",
    "notnull_rollup": "SELECT quality, COUNT(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality",
    "totals_row": """
        SELECT (SELECT COUNT(*) FROM customer) AS authors, (SELECT COUNT(*) FROM orders) AS submissions,
               (SELECT COUNT(*) FROM lineitem) AS answers, (SELECT COUNT(*) FROM labels) AS evaluations,
               (SELECT COUNT(*) FROM pages) AS articles""",
    "dashboard_join": f"""
        SELECT cohort, n_authors, n_answers, COALESCE(fee, 0) AS fee, CAST(SUM(fee) OVER () AS BIGINT) AS fee_of_all
        FROM ({_COHORTS}) c LEFT JOIN ({_FEES}) f USING (cohort)""",
    "essays_list": _ESSAYS.format(where="TRUE", having="TRUE"),
    "essays_filtered": _ESSAYS.format(
        where="c_nationkey = 6 AND c_mktsegment = 'BUILDING' AND c_mktsegment || ' ' || c_nationkey ILIKE '%ING 6%' AND c_name ILIKE '%customer#%'",
        having="MAX(CAST(round(value * 100) AS BIGINT)) >= 100",
    ),
    "evaluations_of_language": """
        SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang = 'fr'
        ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 500""",
    "evaluations_null_as_zero": "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY COALESCE(quality, 0) DESC, doc_id LIMIT 50",
    "author_qna_of_one": """
        SELECT o_custkey, l_orderkey, l_linenumber, p_name AS question, p_type AS category, l_quantity AS answer
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7""",
    "filter_options": "SELECT DISTINCT c_nationkey AS cohort, c_mktsegment AS student_type FROM customer ORDER BY ALL",
    "evaluations_list": """
        SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)
        ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 500""",
    "author_qna": """
        SELECT o_custkey, l_orderkey, l_linenumber, p_name AS question, p_type AS category, l_quantity AS answer
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
    "articles_list": """
        SELECT o_orderkey AS id, c_custkey AS author_id, c_name AS name, 'editing' AS article_status, CAST(round(o_totalprice * 100) AS BIGINT) AS score,
               strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
        ORDER BY o_orderdate DESC, score DESC, author_id, id""",
    "articles_existing": """
        SELECT o_orderkey AS id, c_custkey AS author_id, c_name AS name, 'editing' AS article_status, CAST(round(o_totalprice * 100) AS BIGINT) AS score
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_totalprice >= 450000
        ORDER BY score DESC, author_id, id LIMIT 100""",
    "articles_fallback": _CANDIDATES,
    "latest_per_author": """
        SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
}
