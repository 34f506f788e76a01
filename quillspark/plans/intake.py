"""Loading of sheets and files, matching rules, candidate filters, fees of several extracts and small cell functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions import scalars as S
from quillspark.operators import fees, match, scoring, sheets
from quillspark.plans import texts
from quillspark.sources import documents
from quillspark.sources.tables import table


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form sheet as a grid of strings: a title row, the header, and a row per customer."""
    c = table(spark, sf_dir, "customer")
    text = lambda name: F.col(name).cast("string")
    blank = lambda n, value: F.when(F.col("c_custkey") % n == 0, F.lit(" ")).otherwise(value)
    score = F.when(F.col("c_custkey") % 4 == 0, F.concat(text("c_nationkey"), F.lit("/"), F.col("c_mktsegment"))).when(F.col("c_custkey") % 4 == 1, F.col("c_mktsegment")).when(F.col("c_custkey") % 4 == 2, text("c_nationkey"))
    values = [
        F.lit("2024"), blank(10, F.concat(F.col("c_name"), F.lit(" (x) A"))), F.concat(F.lit("010-"), text("c_custkey")), text("c_nationkey"), F.lit("관반"), F.col("c_mktsegment"),
        score, F.when(F.col("c_custkey") % 3 == 0, F.lit("reviewer")), F.when(F.col("c_custkey") % 6 == 0, F.lit("note")), F.concat(text("c_nationkey"), F.lit("기")),
        F.col("c_mktsegment"), blank(3, F.col("c_name")), F.lit("free"),
    ]
    names = [f"_c{i}" for i in range(len(values))]
    data = c.select((F.col("c_custkey") + 2).alias("_row"), *[v.alias(n) for v, n in zip(values, names)])
    header = ["타임\n스탬프", "이름", "전화번호", "관", "관반", "반", "수기평1", "평가자1", "비고1", "재원 기수", "[1-1] 첫 질문", "[2-3] 둘째\n질문", "기타"]
    top = spark.createDataFrame([(0, *["title"] * len(names)), (1, *header)], "_row long, " + ", ".join(f"{n} string" for n in names))
    return top.unionByName(data)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by every second telephone number; some names stand twice."""
    c = table(spark, sf_dir, "customer")
    phone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("010"), F.col("c_custkey").cast("string")))
    people = c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), phone.alias("phone"))
    return people.unionByName(people.filter("person_id % 7 = 0").select((F.col("person_id") + 10**9).alias("person_id"), "name", F.lit(None).cast("string").alias("phone")))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of a sheet, matched."""
    return sheets.loaded(_grid(spark, sf_dir), _people(spark, sf_dir), 7)[0]


def sheet_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.loaded(_grid(spark, sf_dir), _people(spark, sf_dir), 7)[1]


def sheet_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.loaded(_grid(spark, sf_dir), _people(spark, sf_dir), 7)[2]


def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files and pages through the extraction by extension, cleaned."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("path"), F.encode(F.concat(F.lit("\u0001 "), F.col("text"), F.lit(" \t\n\n\n\nend\u007f\r\n")), "UTF-8").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("in/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return documents.extract(docs.unionByName(pages)).select("path", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in UTF-8, cp949 and UTF-16, and one kind that is none of them, whose text is empty."""
    c = table(spark, sf_dir, "customer")
    text, kind = F.concat(F.lit("한글 "), F.col("c_name")), F.col("c_custkey") % 4
    cp949 = F.concat(F.unhex(F.lit("C7D1B1DB20")), F.encode("c_name", "UTF-8"))  # the same Hangul as bytes of that code page
    content = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, cp949).when(kind == 2, F.encode(text, "UTF-16")).otherwise(F.unhex(F.lit("FF")))
    return documents.extract(c.select(F.concat(F.lit("in/"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), content.alias("content")))


def composed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed letters, invisible characters, blanks, groups and Latin letters at the end."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit(" 1é​ "), F.col("c_name"), F.lit(" 가 ("), F.col("c_mktsegment"), F.lit(") ab (c) "))
    return c.select("c_custkey", documents.composed_name(name).alias("name"))


def question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a new sheet by their whole text: known ones keep their id, new ones get one."""
    p = table(spark, sf_dir, "part")
    cohort = (F.col("p_size") % 3).alias("cohort")
    known = p.filter("p_size > 25").select(cohort, F.concat_ws(" ", "p_name", "p_type").alias("text"), F.format_string("q%08d", "p_partkey").alias("question_id"))
    return match.by_text(p.select("p_partkey", cohort, F.concat_ws(" ", "p_name", "p_type").alias("text")), known)


def match_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, ambiguous, new, and unmatched in the cohort whose people are all known."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cohort"), F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 40).cast("string")).alias("name"))
    people = c.filter("c_custkey % 3 = 0").select("cohort", "name", F.col("c_custkey").alias("person_id"))
    return match.by_cohort(c.withColumnRenamed("c_custkey", "row_id"), people)


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a normal form may change."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "")).when(F.col("p_size") % 3 == 1, F.lit("김 (")).otherwise(F.col("p_name")).alias("name"))
    return p.filter(S.needs_normalising(F.col("name")))


def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose class holds one text and not another, with a name or an address."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 6 > 0, F.col("p_brand")).alias("url"), "p_type")
    return sheets.wanted(p, "p_type", require="N", exclude="STANDARD", any_of=["name", "url"])


def fee_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees of four extracts with their own columns and tables, per cohort, type and amount."""
    return fees.histogram(_fees(spark, sf_dir)[0])


def fee_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and money of every cohort and type, with the amounts as a map."""
    return fees.totals(fees.histogram(_fees(spark, sf_dir)[0]))


def fee_extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which extracts could be read: one names a column that its sheet lacks and is left out."""
    return _fees(spark, sf_dir)[1]


def _fees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    row = lambda df, cohort, kind, amount: df.select(F.lit(cohort).alias("cohort"), kind.alias("student_type"), amount.cast("long").alias("amount"))
    extracts = {
        "level": lambda: row(lines.filter("l_returnflag = 'A'"), 9, F.lit("우선선발"), S.lookup(S.LEVEL_AMOUNTS, F.col("l_linenumber"))),
        "grade": lambda: row(lines.filter("l_returnflag = 'N'"), 5, S.student_type_of(F.when(F.col("l_linenumber") % 2 == 0, F.lit("성적향상자"))), S.lookup(S.GRADE_AMOUNTS, F.col("l_linestatus"))),
        "amount": lambda: row(orders.filter("o_orderstatus = 'P'"), 8, F.lit("성적우수"), S.won(F.format_string("%,d원", (F.col("o_orderkey") % 3 * 50000).cast("long")))),
        "broken": lambda: row(orders, 7, F.lit("성적우수"), F.col("no_such_column")),
    }
    return fees.appended(spark, extracts, "cohort int, student_type string, amount long")


def _raw_fees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fee cells as sheets hold them: numbers, words where a number should be, and blanks; one sheet lacks a column."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    amount = F.when(F.col("l_linenumber") % 7 == 0, F.lit("n/a")).when(F.col("l_linenumber") % 5 == 0, F.lit(" ")).otherwise((F.col("l_linenumber") * 1000).cast("string"))
    sources = {
        "lines": lines.select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 9).cast("string").alias("cohort"), amount.alias("amount")),
        "orders": orders.select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("6기")).otherwise(F.lit(" 7 ")).alias("cohort"), F.col("o_custkey").alias("amount")),
        "broken": orders.select(F.col("o_orderkey").alias("name")),
    }
    return fees.quarantined(sources, StructType.fromDDL("name string, cohort int, amount long"), required=("name", "amount"))


def fees_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and fees per source and cohort, of rows without a wrong cell."""
    return _raw_fees(spark, sf_dir)[0].groupBy("src", "cohort").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def fees_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong cells by source, column and reason, with an example."""
    return _raw_fees(spark, sf_dir)[1].groupBy("src", "column", "reason").agg(F.count("*").alias("n"), F.min("value").alias("example"))


def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of empty answers, numbers of URL parameters and an injected time."""
    c = table(spark, sf_dir, "customer")
    answer = F.when(F.col("c_nationkey") % 3 == 0, F.lit(" \n ")).when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("  "), F.col("c_name"), F.lit("\n")))
    parameter = F.when(F.col("c_nationkey") % 4 == 0, F.lit("")).when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).when(F.col("c_nationkey") % 4 == 2, F.lit("abc"))
    return c.select("c_custkey", S.answer_text(answer).alias("answer"), S.parameter_number(parameter).alias("cohort"), F.lit("2024-03-01 00:00:00").alias("updated_at"))


def jobs_of_a_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rows of a range, scored ones too."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("row"), F.col("text").alias("body"), F.col("quality").alias("final_score"))
    return scoring.jobs(docs, first=5, last=120, force=True, limit=40).select("row", "final_score")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of submissions did, as rows of the activity log with stable ids."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    action = F.when(F.col("o_orderstatus") == "P", "insert").otherwise("update")
    entity = F.col("o_orderkey").cast("string")
    return orders.select(
        S.stable_id("log", F.lit("submission"), entity, action).alias("id"), F.lit("submission").alias("entity_type"), entity.alias("entity_id"), action.alias("action"),
        F.concat(action, F.lit(" "), F.col("o_orderpriority")).alias("description"), F.lit("system").alias("actor"), F.lit("2024-03-01 00:00:00").alias("created_at"),
    )


def essays_in_two_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that are selected for more than one section."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_returnflag").alias("section")).distinct()
    return lines.groupBy("submission_id").agg(F.count("*").alias("n_sections")).filter("n_sections > 1")


def question_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct question keys with the parts of their natural order: letters, n and m."""
    p = table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("A"), F.col("p_size").cast("string"))).otherwise(F.concat((F.col("p_size") % 12).cast("string"), F.lit("-"), (F.col("p_partkey") % 15).cast("string")))
    keys = p.select(key.alias("key")).distinct()
    return keys.select("key", *S.natural_parts(F.col("key"))).orderBy("letters", "n", "m", "key")


QUERIES = {f.__name__: f for f in (
    sheet_rows, sheet_answers, sheet_reviews, extracted_files, encoded_files, composed_names, question_lookup, match_by_cohort, name_candidates, class_filter, fee_histogram, fee_totals,
    fee_extract_report, fees_checked, fees_rejected, small_cells, jobs_of_a_range, activity_log, essays_in_two_sections, question_order,
)}

_ROWS = """
    SELECT c_custkey + 2 AS row_id, c_name AS name, '010' || c_custkey AS phone, c_nationkey AS cohort, CAST(c_nationkey AS VARCHAR) AS hall, c_mktsegment AS class, c_custkey, c_nationkey, c_mktsegment
    FROM customer WHERE c_custkey % 10 <> 0"""
_PEOPLE = """
    SELECT c_custkey AS person_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '010' || c_custkey END AS phone FROM customer
    UNION ALL SELECT c_custkey + 1000000000, c_name, NULL FROM customer WHERE c_custkey % 7 = 0"""
_FEES = """
    SELECT 9 AS cohort, '우선선발' AS student_type, (MAP {1: 200000, 2: 240000, 3: 280000, 4: 320000, 5: 400000})[l_linenumber] AS amount FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT 5, CASE WHEN l_linenumber % 2 = 0 THEN '성적향상' ELSE '성적우수' END, CASE l_linestatus WHEN 'F' THEN 100000 END FROM lineitem WHERE l_returnflag = 'N'
    UNION ALL SELECT 8, '성적우수', o_orderkey % 3 * 50000 FROM orders WHERE o_orderstatus = 'P'"""
_HISTOGRAM = f"SELECT cohort, student_type, CAST(amount AS BIGINT) AS amount, COUNT(*) AS n FROM ({_FEES}) WHERE amount IS NOT NULL GROUP BY ALL"

_CELLS = """cells AS (
    SELECT 'lines' AS src, CAST(l_orderkey AS VARCHAR) AS name, CAST(l_suppkey % 9 AS INTEGER) AS cohort, false AS bad_cohort,
           CASE WHEN l_linenumber % 7 = 0 THEN 'n/a' WHEN l_linenumber % 5 = 0 THEN ' ' END AS raw, CASE WHEN l_linenumber % 7 > 0 AND l_linenumber % 5 > 0 THEN l_linenumber * 1000 END AS amount FROM lineitem
    UNION ALL SELECT 'orders', CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey AS VARCHAR) END, 7, o_orderkey % 6 = 0, NULL, o_custkey FROM orders)"""

ORACLES = {
    "sheet_rows": f"""
        WITH p AS ({_PEOPLE}), r AS ({_ROWS})
        SELECT row_id, r.name, r.phone, cohort, hall, class,
               COALESCE((SELECT MAX(person_id) FROM p WHERE p.name = r.name AND p.phone = r.phone), CASE WHEN (SELECT COUNT(*) FROM p WHERE p.name = r.name) = 1 THEN (SELECT MIN(person_id) FROM p WHERE p.name = r.name) END) AS person_id,
               CASE WHEN c_custkey % 2 = 0 THEN 'phone' WHEN c_custkey % 7 = 0 THEN 'ambiguous' ELSE 'name' END AS how
        FROM r""",
    "sheet_answers": f"""
        SELECT row_id, '1-1' AS question_key, c_mktsegment AS answer FROM ({_ROWS})
        UNION ALL SELECT row_id, '2-3', name FROM ({_ROWS}) WHERE c_custkey % 3 <> 0""",
    "sheet_reviews": f"""
        WITH s AS (
            SELECT row_id, CASE WHEN c_custkey % 3 = 0 THEN 'reviewer' END AS reviewer, CASE WHEN c_custkey % 4 IN (0, 2) THEN c_nationkey END AS score,
                   CASE WHEN c_custkey % 4 IN (0, 1) THEN c_mktsegment END AS remark, CASE WHEN c_custkey % 6 = 0 THEN 'note' END AS own
            FROM ({_ROWS}))
        SELECT row_id, 1 AS slot, reviewer, score, nullif(concat_ws(' / ', remark, own), '') AS note FROM s WHERE NOT (score IS NULL AND reviewer IS NULL AND remark IS NULL AND own IS NULL)""",
    "extracted_files": r"""
        WITH t AS (
            SELECT 'in/' || doc_id || '.TXT' AS path, regexp_replace(regexp_replace(regexp_replace(text || E' \t\n\n\n\nend' || chr(127), '[\x00-\x08\x0B-\x1F]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', E'\n\n', 'g') AS text
            FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT 'in/' || doc_id || '.TXT', '' FROM documents WHERE text IS NULL
            UNION ALL SELECT 'in/p' || page_id || '.html', text FROM ({html})),
        s AS (SELECT path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM t)
        SELECT path, length(text) AS n_chars, md5(text) AS text_md5 FROM s""".replace("{html}", texts.ORACLES["html_to_text"]),
    "encoded_files": "SELECT 'in/' || c_custkey || '.txt' AS path, CASE WHEN c_custkey % 4 < 3 THEN '한글 ' || c_name ELSE '' END AS text FROM customer",
    "composed_names": """
        SELECT c_custkey, replace(nfc_normalize('1é' || c_name || chr(4352) || chr(4449)), ' ', '') AS name FROM customer""",
    "question_lookup": """
        WITH p AS (SELECT p_partkey, p_size % 3 AS cohort, p_name || ' ' || p_type AS text, p_size FROM part),
        k AS (SELECT cohort, text, MAX(printf('q%08d', p_partkey)) AS id FROM p WHERE p_size > 25 GROUP BY ALL)
        SELECT p_partkey, cohort, text, COALESCE(id, 'question_' || substr(sha256(cohort || chr(1) || text), 1, 16)) AS question_id, id IS NOT NULL AS known FROM p LEFT JOIN k USING (cohort, text)""",
    "match_by_cohort": """
        WITH c AS (SELECT c_custkey AS row_id, c_nationkey AS cohort, c_mktsegment || (c_custkey % 40) AS name FROM customer),
        p AS (SELECT cohort, name, COUNT(*) AS n, MIN(row_id) AS one FROM c WHERE row_id % 3 = 0 GROUP BY ALL)
        SELECT row_id, CASE WHEN n = 1 THEN one END AS person_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' WHEN cohort = 5 THEN 'unmatched' ELSE 'new' END AS how
        FROM c LEFT JOIN p USING (cohort, name)""",
    "name_candidates": """
        SELECT * FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '') WHEN 1 THEN '김 (' ELSE p_name END AS name FROM part)
        WHERE name LIKE '%(%' OR name GLOB '*[A-Za-z]*'""",
    "class_filter": """
        SELECT * FROM (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name END AS name, CASE WHEN p_size % 6 > 0 THEN p_brand END AS url, p_type FROM part)
        WHERE contains(p_type, 'N') AND NOT contains(p_type, 'STANDARD') AND (name IS NOT NULL OR url IS NOT NULL)""",
    "fee_histogram": _HISTOGRAM,
    "fee_totals": f"""
        SELECT cohort, student_type, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(n * amount) AS BIGINT) AS total, string_agg(amount || ':' || n, ',' ORDER BY amount) AS amounts
        FROM ({_HISTOGRAM}) GROUP BY ALL""",
    "fee_extract_report": "SELECT 'level' AS src, TRUE AS ok UNION ALL SELECT 'grade', TRUE UNION ALL SELECT 'amount', TRUE UNION ALL SELECT 'broken', FALSE",
    "fees_checked": f"""
        WITH {_CELLS} SELECT src, cohort, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS total FROM cells WHERE name IS NOT NULL AND NOT bad_cohort AND amount IS NOT NULL GROUP BY 1, 2""",
    "fees_rejected": f"""
        WITH {_CELLS}
        SELECT src, 'name' AS column, 'missing' AS reason, COUNT(*) AS n, NULL::VARCHAR AS example FROM cells WHERE name IS NULL GROUP BY 1
        UNION ALL SELECT src, 'cohort', 'not a int', COUNT(*), '6기' FROM cells WHERE bad_cohort GROUP BY 1
        UNION ALL SELECT src, 'amount', 'not a bigint', COUNT(*), 'n/a' FROM cells WHERE raw = 'n/a' GROUP BY 1
        UNION ALL SELECT src, 'amount', 'missing', COUNT(*), ' ' FROM cells WHERE raw = ' ' GROUP BY 1
        UNION ALL SELECT 'broken', unnest(['cohort', 'amount']), 'no such column', 1, NULL""",
    "small_cells": """
        SELECT c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN c_name ELSE '(답변 없음)' END AS answer, CASE WHEN c_nationkey % 4 = 1 THEN c_nationkey END AS cohort, '2024-03-01 00:00:00' AS updated_at FROM customer""",
    "jobs_of_a_range": """
        SELECT doc_id AS row, quality AS final_score FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id BETWEEN 5 AND 120 AND COALESCE(trim(text), '') <> '' ORDER BY doc_id LIMIT 40""",
    "activity_log": """
        WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderstatus WHEN 'P' THEN 'insert' ELSE 'update' END AS action FROM orders WHERE o_orderstatus <> 'O')
        SELECT 'log_' || substr(sha256('submission' || chr(1) || k || chr(1) || action), 1, 16) AS id, 'submission' AS entity_type, k AS entity_id, action, action || ' ' || o_orderpriority AS description,
               'system' AS actor, '2024-03-01 00:00:00' AS created_at FROM o""",
    "essays_in_two_sections": "SELECT l_orderkey AS submission_id, COUNT(DISTINCT l_returnflag) AS n_sections FROM lineitem GROUP BY 1 HAVING n_sections > 1",
    "question_order": """
        SELECT DISTINCT key, regexp_extract(key, '^([A-Za-z]*)', 1) AS letters, CAST(regexp_extract(key, '^[A-Za-z]*([0-9]+)', 1) AS INTEGER) AS n, COALESCE(TRY_CAST(regexp_extract(key, '-([0-9]+)', 1) AS INTEGER), 0) AS m
        FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'A' || p_size ELSE (p_size % 12) || '-' || (p_partkey % 15) END AS key FROM part)""",
}
