"""Queries of selection, proof and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import delta, editing
from quillspark.plans.reports import cents
from quillspark.sources.tables import table

#: Notation rules of the sample: pattern, replacement.
TERMS = [(r"[ ]{2,}", " "), (r"!{2,}", "!"), (r"\bthe\b", "THE")]


def section_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best submissions per priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", cents("o_totalprice").alias("score"))
    return editing.top_per_section(orders, "o_orderpriority", "score", "o_orderkey", 20, threshold=49_900_000)


def approved_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to approved questions."""
    approved = table(spark, sf_dir, "part").filter("p_type IN ('ECONOMY', 'SMALL') AND p_size >= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(approved, "l_partkey", "left_semi")


def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms whose fields contradict the known person."""
    known = table(spark, sf_dir, "customer").filter("c_nationkey <> 7").select("c_custkey", "c_nationkey", "c_mktsegment")
    forms = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_acctbal") > 5000, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return editing.identity_flags(forms, known, "c_custkey", ["c_nationkey", "c_mktsegment"])


def _revised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return turns, turns.withColumn("text", F.replace(F.col("text"), F.lit("ou"), F.lit("oo")))


def revision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a revision changed."""
    before, after = _revised(spark, sf_dir)
    return editing.line_diff(before, after, "id", "text")


def proof_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are missing from the proof or new in it."""
    before, after = _revised(spark, sf_dir)
    return editing.proof_changes(before, after, "id", "text")


def term_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the notation rules."""
    text = editing.replaced_terms(F.col("text"), TERMS)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"))


def subtitle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles that are too long or repeated inside a section."""
    return editing.subtitle_problems(table(spark, sf_dir, "part").select("p_brand", "p_name"), "p_brand", "p_name", most=11)


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", editing.export_name(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), F.col("o_custkey").cast("string")).alias("file"))


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions per priority: all, finished, above the threshold."""
    return editing.progress(table(spark, sf_dir, "orders"), "o_orderpriority", {"done": F.col("o_orderstatus") == "F", "selected": F.col("o_totalprice") >= 400_000})


def insert_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers found by name, cohort and question key."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("cohort"))
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cohort"), F.col("n_name").alias("question_id"), F.concat(F.lit("k"), (F.col("n_nationkey") % 3).cast("string")).alias("key"))
    rows = people.select("name", "cohort", F.when(F.col("cohort") < 20, F.concat(F.lit("k"), (F.col("cohort") % 3).cast("string"))).otherwise("none").alias("key"), F.concat(F.lit("answer of "), F.col("name")).alias("answer"))
    return editing.insert_by_names(rows, people, questions)


def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load would do: rows inserted, updated or left alone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("price"))
    old = orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("price").alias("old"))
    new = delta.update_where(orders, F.col("o_orderstatus") == "F", price=F.col("price") + 1)
    both = new.join(old, "o_orderkey", "left")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("price"), "update").otherwise("same")
    return both.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed and failed calls with their units, per day."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    failed = F.col("event_type") == "error"
    return events.groupBy("day").agg(F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(F.when(~failed, F.col("k"))), F.lit(0).cast("long")).alias("units"))


def row_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest row of a grid, and the words of the widest line."""
    cells = F.size(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").agg(F.max(cells).alias("most_cells"), F.min(cells).alias("fewest_cells"))


QUERIES = {f.__name__: f for f in (
    section_candidates, approved_only, identity_check, revision_lines, proof_comparison, term_rules, subtitle_check, export_names, progress_counts, insert_answers,
    action_counts, usage_sums, row_width,
)}

_TURNS = "SELECT conv_id || '-' || turn AS id, text AS a, replace(text, 'ou', 'oo') AS b FROM conversations"
_CUT = lambda c: rf"unnest(list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''))"

ORACLES = {
    "section_candidates": """
        SELECT *, CASE WHEN score >= 49900000 THEN 'score' ELSE 'fill' END AS reason FROM (
            SELECT o_orderkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS score,
                   CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice * 100) DESC, o_orderkey) AS INTEGER) AS place FROM orders)
        WHERE place <= 20""",
    "approved_only": """
        SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size >= 25)""",
    "identity_check": """
        WITH f AS (SELECT c_custkey, c_nationkey = 7 AS lost, c_nationkey = 7 AND c_acctbal < 0 AS n_same, c_acctbal < 0 OR c_nationkey = 7 AS n_wrong,
                   c_acctbal > 5000 OR c_nationkey = 7 AS s_wrong FROM customer)
        SELECT c_custkey, concat_ws(',', CASE WHEN n_wrong AND NOT n_same THEN 'c_nationkey' END, CASE WHEN s_wrong THEN 'c_mktsegment' END) AS mismatched,
               lost OR n_wrong OR s_wrong AS needs_review FROM f""",
    "revision_lines": f"""
        SELECT * FROM (
            SELECT id, CAST(unnest(range(len(string_split(a, chr(10))))) AS INTEGER) AS pos, unnest(string_split(a, chr(10))) AS before, unnest(string_split(b, chr(10))) AS after
            FROM ({_TURNS})) WHERE before IS DISTINCT FROM after""",
    "proof_comparison": f"""
        WITH a AS (SELECT DISTINCT id, {_CUT("a")} AS sentence FROM ({_TURNS})), b AS (SELECT DISTINCT id, {_CUT("b")} AS sentence FROM ({_TURNS}))
        SELECT id, sentence, 'missing' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, sentence, 'added' FROM (FROM b EXCEPT FROM a)""",
    "term_rules": r"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5
        FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ ]{2,}', ' ', 'g'), '!{2,}', '!', 'g'), '\bthe\b', 'THE', 'g') AS t FROM documents)""",
    "subtitle_check": """
        SELECT p_brand, p_name, COUNT(*) AS n, length(p_name) > 11 AS too_long, COUNT(*) > 1 AS repeated FROM part GROUP BY 1, 2 HAVING length(p_name) > 11 OR COUNT(*) > 1""",
    "export_names": """
        SELECT o_orderkey, concat_ws('_', replace(o_orderpriority, ' ', '-'), CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, CAST(o_custkey AS VARCHAR)) AS file FROM orders""",
    "progress_counts": """
        SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS done, COUNT(*) FILTER (o_totalprice >= 400000) AS selected FROM orders GROUP BY 1""",
    "insert_answers": """
        SELECT c_custkey AS person_id, n_name AS question_id, 'answer of ' || c_name AS answer FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey < 20""",
    "action_counts": """
        SELECT CASE o_orderstatus WHEN 'P' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'same' END AS action, COUNT(*) AS n FROM orders GROUP BY 1""",
    "usage_sums": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) FILTER (event_type <> 'error') AS completed, COUNT(*) FILTER (event_type = 'error') AS failed,
               CAST(COALESCE(SUM(CAST(props->>'$.k' AS BIGINT)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS units FROM events GROUP BY 1""",
    "row_width": """
        SELECT CAST(MAX(len(string_split(text, chr(10)))) AS INTEGER) AS most_cells, CAST(MIN(len(string_split(text, chr(10)))) AS INTEGER) AS fewest_cells FROM documents""",
}
