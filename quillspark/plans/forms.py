"""Sheets of forms: unpivoting, profiling, matching people, fees and cell scalars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.operators import dedup, match, sheets
from quillspark.operators.order import placed
from quillspark.plans.reports import cents
from quillspark.sources.tables import table


def unpivot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank cell of the question columns."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" ").alias("p_type"))
    return sheets.answers(parts, ["p_partkey"], ["p_name", "p_brand", "p_type"])


def unpivot_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewer triples per row as evaluations; a triple without score, reviewer and note is dropped."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    whole = F.col("l_quantity").cast("int")
    second = (F.nullif(F.col("l_linestatus"), F.lit("O")), F.when(F.col("l_discount") >= 0.05, whole), F.nullif(F.col("l_returnflag"), F.lit("N")))
    return sheets.reviews(lines, ["l_orderkey", "l_linenumber"], [(F.col("l_returnflag"), whole, F.col("l_linestatus")), second])


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank cells per column and the share that are addresses: how a sheet's file column is found."""
    pages = table(spark, sf_dir, "pages").select("url", "html", F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise("none").alias("mixed"))
    return sheets.share_matching(pages, ["url", "html", "mixed"], sheets.URL)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are shared by a few people of a cohort, telephone numbers by hardly any."""
    name = F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.abs("c_acctbal") / 20).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), name.alias("name"), cents("c_acctbal").cast("string").alias("phone"), F.col("c_nationkey").alias("cohort"))


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and telephone, else a name that is unique, else new or ambiguous."""
    people = _people(spark, sf_dir)
    rows = people.select(
        F.col("person_id").alias("row_id"),
        F.when(F.col("phone").endswith("7"), F.concat("name", F.lit("?"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("phone").endswith("3"), F.lit("")).otherwise(F.col("phone")).alias("phone"),
    )
    return match.by_name_and_phone(rows, people)


def match_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that several people have is narrowed by the leading characters of another field."""
    people = _people(spark, sf_dir).select("person_id", "name", F.col("phone").alias("univ"))
    rows = people.select(F.col("person_id").alias("row_id"), "name", F.substring("univ", 1, 6).alias("own_univ"))
    return match.narrowed_by_prefix(rows, people, "own_univ", "univ")


def fee_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fee per person; among equal ones the first."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", cents("l_extendedprice").alias("amount"), "l_orderkey", "l_linenumber")
    return dedup.best_by(lines, ["l_suppkey"], F.col("amount"), -F.col("l_orderkey"), -F.col("l_linenumber"))


def fees_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees by cohort and name: the person with the fee's telephone number, else all of that name."""
    people = _people(spark, sf_dir)
    fee = people.groupBy("cohort", "name").agg(F.max("phone").alias("phone"), F.count("*").alias("n"))
    best = fee.select("cohort", "name", F.when(F.col("phone").endswith("3"), F.lit("")).otherwise(F.col("phone")).alias("phone"), (F.col("n") * 1000).alias("amount"))
    return match.fees(best, people)


def fees_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of all cohorts after the fees of some cohorts are written: new amounts where there are any, else what they had."""
    people = _people(spark, sf_dir).withColumn("fee", F.when(F.col("person_id") % 2 == 0, F.lit(500).cast("long")))
    return match.fees_applied(people, fees_matched(spark, sf_dir).join(people.filter("cohort < 12"), "person_id", "left_semi")).select("person_id", "cohort", "fee")


def fee_union_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts with their own grade tables appended; people and money per source and amount."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    extracts = [
        lines.filter("l_returnflag = 'A'").select(F.lit("level").alias("src"), S.lookup(S.LEVEL_AMOUNTS, F.col("l_linenumber")).alias("amount")),
        lines.filter("l_returnflag = 'N'").select(F.lit("grade").alias("src"), S.lookup(S.GRADE_AMOUNTS, F.col("l_linestatus")).alias("amount")),
        lines.filter("l_returnflag = 'R'").select(F.lit("score").alias("src"), S.lookup(S.SCORE_AMOUNTS, F.col("l_linenumber") * 20).alias("amount")),
    ]
    every = reduce(DataFrame.unionByName, extracts).filter("amount IS NOT NULL")
    return every.groupBy("src", "amount").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("long")).alias("total"))


def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent brand per type, the first seen among equals."""
    return dedup.mode_first_seen(table(spark, sf_dir, "part").select("p_type", "p_brand", "p_partkey"), ["p_type"], "p_brand", "p_partkey")


def natural_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys with their place in natural order (letters, then number)."""
    keys = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct()
    letters, number = F.regexp_extract("key", "^([A-Za-z]+)", 1), F.regexp_extract("key", "([0-9]+)$", 1).try_cast("int")
    return placed(keys, [letters, F.coalesce(number, F.lit(0)), F.col("key")])


def name_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, numbers and dates of a form, normalised."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(") B (x)c ")).alias("name"),
        F.concat(F.lit("010-"), F.col("c_custkey").cast("string"), F.lit(" / "), F.col("c_nationkey").cast("string")).alias("phone"),
        F.concat(F.when(F.col("c_nationkey") < 3, "1.2.3").otherwise(F.format_string("₩ %,d.5", F.col("c_custkey"))), F.lit(" won")).alias("fee"),
        F.concat(F.lit("재원 "), F.col("c_nationkey").cast("string"), F.lit(" 기")).alias("cohort"),
        F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.when(F.col("c_nationkey") == 1, "x").otherwise(" ")).alias("born"),
    )
    return c.select(
        "c_custkey",
        S.normal_name(F.col("name")).alias("name"),
        S.normal_name(F.col("name"), inner_spaces=True).alias("tight_name"),
        S.digits(F.col("phone")).alias("phone"),
        S.won(F.col("fee")).alias("fee"),
        S.cohort_number(F.col("cohort"), F.lit(-1)).alias("cohort"),
        S.cohort_number(F.col("phone"), F.lit(-1)).alias("no_cohort"),
        S.birthdate(F.col("born")).alias("born"),
    )


def answer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with remarks, question keys and labelled parts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    score = F.when(F.col("c_nationkey") % 4 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_nationkey") % 4 == 1, F.concat(F.col("c_nationkey").cast("string"), F.lit(" / "), F.col("c_mktsegment"), F.lit("/x")))
    c = c.withColumn("score", score.when(F.col("c_nationkey") % 4 == 2, F.concat(F.lit("4.5/"), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("/"), F.col("c_name"))))
    c = c.withColumn("question", F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") < 20, "-2] ").otherwise("] "), F.col("c_name")))
    both = S.score_field(F.col("score"))
    place = S.hall_and_class(F.concat(F.col("c_mktsegment"), F.lit("  A 1")))
    return c.select(
        "c_custkey",
        both["score"].alias("score"),
        both["comment"].alias("remark"),
        S.question_key(F.col("question")).alias("key"),
        S.section_of(S.question_key(F.col("question"))).alias("section"),
        S.joined(" / ", F.when(F.col("c_nationkey") > 4, F.col("c_name")), F.lit(" "), F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment"))).alias("summary"),
        S.labelled(" / ", {"type": F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment")), "name": F.lit("")}).alias("memo"),
        place["hall"].alias("hall"),
        place["class"].alias("class"),
        S.same_university(F.col("c_mktsegment"), F.concat(F.lit("x"), F.substring("c_mktsegment", 1, 4))).alias("same"),
    )


def file_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and resubmission dates in file names."""
    stem = F.when(F.col("c_nationkey") % 3 == 0, "기수_수기_홍길동_").when(F.col("c_nationkey") % 3 == 1, "report - 김철수").otherwise("a_이영희-b ")
    day = F.when(F.col("c_nationkey") % 2 == 0, "20240").otherwise("2401")
    path = F.concat(F.lit("/in/"), F.col("c_mktsegment"), F.lit("/"), stem, F.when(F.col("c_nationkey") % 3 == 1, "").otherwise(F.concat(day, F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.when(F.col("c_nationkey") > 12, "_수정").otherwise(""))), F.lit(".HWPX"))
    c = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return c.select("c_custkey", S.base_name(F.col("path")).alias("base"), S.name_from_file(F.col("path")).alias("name"), S.name_from_file(F.col("path"), use_tail=False).alias("short_name"), S.file_date_key(F.col("path"), F.col("c_custkey")).alias("date_key"))


def display_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, tones, scales and money as they are shown."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("at"))
    total = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 5000).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "selected").when(F.col("o_orderstatus") == "O", "reviewing").otherwise("unknown")
    money = F.when(F.col("o_orderstatus") != "O", F.floor(F.col("o_totalprice") / 100).cast("long") * 1000)
    return orders.select(
        "o_orderkey",
        S.five_scale(total).alias("five"),
        S.is_selected(total).alias("selected"),
        S.score_tone(total).alias("tone"),
        S.lookup(S.SUBMISSION_LABELS, state, state).alias("label"),
        S.lookup(S.TONES, state, F.lit("gray")).alias("state_tone"),
        S.won_text(money).alias("won"),
        S.man_won_text(money).alias("man_won"),
        S.cohort_text(F.nullif(F.col("o_orderkey") % 7, F.lit(0))).alias("cohort"),
        S.day_text(F.when(F.col("o_orderstatus") != "P", F.col("at"))).alias("day"),
    )


QUERIES = {f.__name__: f for f in (
    unpivot_answers, unpivot_reviewers, column_profile, match_cascade, match_narrowed, fee_argmax, fees_matched, fees_updated, fee_union_histogram, mode_first_seen,
    natural_sort_keys, name_cells, answer_cells, file_cells, display_cells,
)}

_PEOPLE = """SELECT c_custkey AS person_id, c_mktsegment || '-' || c_nationkey || '-' || CAST(floor(abs(c_acctbal) / 20) AS BIGINT) AS name,
    CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) AS phone, c_nationkey AS cohort FROM customer"""
_CASE = lambda values, key: f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + " END"

ORACLES = {
    "unpivot_answers": """
        SELECT p_partkey, question, answer FROM (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 10 THEN p_type ELSE ' ' END AS p_type FROM part)
        UNPIVOT (answer FOR question IN (p_name, p_brand, p_type)) WHERE trim(answer) <> ''""",
    "unpivot_reviewers": """
        SELECT l_orderkey, l_linenumber, 1 AS slot, l_returnflag AS reviewer, CAST(l_quantity AS INTEGER) AS score, l_linestatus AS note FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, 2, NULLIF(l_linestatus, 'O'), CASE WHEN l_discount >= 0.05::DOUBLE THEN CAST(l_quantity AS INTEGER) END, NULLIF(l_returnflag, 'N')
        FROM lineitem WHERE NOT (l_discount < 0.05::DOUBLE AND l_linestatus = 'O' AND l_returnflag = 'N')""",
    "column_profile": r"""
        SELECT name AS column, COUNT(*) AS n, AVG(CASE WHEN regexp_matches(cell, '^https?://\S+') THEN 1.0::DOUBLE ELSE 0 END) AS share
        FROM (SELECT url, html, CASE WHEN page_id % 4 = 0 THEN url ELSE 'none' END AS mixed FROM pages) UNPIVOT (cell FOR name IN (url, html, mixed))
        WHERE trim(cell) <> '' GROUP BY 1""",
    "match_cascade": f"""
        WITH people AS ({_PEOPLE}),
        rows AS (SELECT person_id AS row_id, CASE WHEN phone LIKE '%7' THEN name || '?' ELSE name END AS name, CASE WHEN phone LIKE '%3' THEN '' ELSE phone END AS phone FROM people),
        hits AS (SELECT r.*, (SELECT MAX(person_id) FROM people p WHERE p.name = r.name AND p.phone = r.phone AND p.phone <> '') AS by_phone,
                 (SELECT COUNT(*) FROM people p WHERE p.name = r.name) AS n, (SELECT MIN(person_id) FROM people p WHERE p.name = r.name) AS by_name FROM rows r)
        SELECT row_id, name, phone, COALESCE(by_phone, CASE WHEN n = 1 THEN by_name END) AS person_id,
               CASE WHEN by_phone IS NOT NULL THEN 'phone' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS how FROM hits""",
    "match_narrowed": f"""
        WITH people AS ({_PEOPLE}), rows AS (SELECT person_id AS row_id, name, substr(phone, 1, 6) AS u FROM people),
        pairs AS (SELECT r.row_id, p.person_id, contains(p.phone, substr(u, 1, 4)) OR contains(u, substr(p.phone, 1, 4)) AS fits FROM rows r JOIN people p USING (name)),
        found AS (SELECT row_id, COUNT(*) AS n, MIN(person_id) AS any_one, COUNT(*) FILTER (fits) AS k, MIN(person_id) FILTER (fits) AS fitting FROM pairs GROUP BY 1)
        SELECT row_id, CASE WHEN n = 1 THEN any_one WHEN k = 1 THEN fitting END AS person_id, CASE WHEN n = 1 THEN 'matched' WHEN k = 1 THEN 'narrowed' ELSE 'ambiguous' END AS how FROM found""",
    "fee_argmax": """
        SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_orderkey, l_linenumber FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice * 100) DESC, l_orderkey, l_linenumber) = 1""",
    "fees_matched": f"""
        WITH people AS ({_PEOPLE}),
        fee AS (SELECT cohort, name, CASE WHEN MAX(phone) LIKE '%3' THEN '' ELSE MAX(phone) END AS p, COUNT(*) * 1000 AS amount FROM people GROUP BY 1, 2),
        pairs AS (SELECT person_id, amount, p <> '' AND p = phone AS same, COUNT(*) OVER w AS n, COUNT(*) FILTER (p <> '' AND p = phone) OVER w AS hits
                  FROM fee JOIN people USING (cohort, name) WINDOW w AS (PARTITION BY cohort, name))
        SELECT person_id, amount FROM pairs WHERE n = 1 OR hits <> 1 OR same""",
    "fees_updated": f"""
        WITH people AS ({_PEOPLE}),
        fee AS (SELECT cohort, name, CASE WHEN MAX(phone) LIKE '%3' THEN '' ELSE MAX(phone) END AS p, COUNT(*) * 1000 AS amount FROM people GROUP BY 1, 2),
        pairs AS (SELECT person_id, amount, p <> '' AND p = phone AS same, COUNT(*) OVER w AS n, COUNT(*) FILTER (p <> '' AND p = phone) OVER w AS hits
                  FROM fee JOIN people USING (cohort, name) WINDOW w AS (PARTITION BY cohort, name)),
        new AS (SELECT person_id, MAX(amount) AS amount FROM pairs WHERE n = 1 OR hits <> 1 OR same GROUP BY 1)
        SELECT person_id, cohort, COALESCE(CASE WHEN cohort < 12 THEN amount END, CASE WHEN person_id % 2 = 0 THEN 500 END) AS fee FROM people LEFT JOIN new USING (person_id)""",
    "fee_union_histogram": f"""
        WITH every AS (
            SELECT 'level' AS src, {_CASE(S.LEVEL_AMOUNTS, "l_linenumber")} AS amount FROM lineitem WHERE l_returnflag = 'A'
            UNION ALL SELECT 'grade', {_CASE(S.GRADE_AMOUNTS, "l_linestatus")} FROM lineitem WHERE l_returnflag = 'N'
            UNION ALL SELECT 'score', {_CASE(S.SCORE_AMOUNTS, "l_linenumber * 20")} FROM lineitem WHERE l_returnflag = 'R')
        SELECT src, amount, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS total FROM every WHERE amount IS NOT NULL GROUP BY 1, 2""",
    "mode_first_seen": """
        SELECT p_type, p_brand AS mode, n FROM (SELECT p_type, p_brand, COUNT(*) AS n, MIN(p_partkey) AS first FROM part GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, first) = 1""",
    "natural_sort_keys": """
        SELECT key, CAST(row_number() OVER (ORDER BY regexp_extract(key, '^([A-Za-z]+)', 1), COALESCE(TRY_CAST(regexp_extract(key, '([0-9]+)$', 1) AS INTEGER), 0), key) AS INTEGER) AS place
        FROM (SELECT DISTINCT p_brand AS key FROM part)""",
    "name_cells": r"""
        SELECT c_custkey, c_name AS name, c_name AS tight_name, '010' || c_custkey || c_nationkey AS phone,
               CASE WHEN c_nationkey >= 3 THEN CAST(round_even(c_custkey + 0.5::DOUBLE, 0) AS BIGINT) END AS fee, c_nationkey AS cohort, -1 AS no_cohort,
               CASE WHEN c_nationkey <> 1 THEN regexp_replace(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '^(\d{4})(\d\d)(\d\d)$', '\1-\2-\3') END AS born
        FROM customer""",
    "answer_cells": """
        SELECT c_custkey, CASE WHEN c_nationkey % 4 < 2 THEN c_nationkey END AS score,
               CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment || '/x' WHEN 2 THEN '4.5/' || c_mktsegment ELSE '/' || c_name END AS remark,
               CASE WHEN c_nationkey < 20 THEN c_nationkey || '-2' END AS key, CASE WHEN c_nationkey < 20 THEN 'section_' || c_nationkey END AS section,
               CASE WHEN c_nationkey > 9 THEN c_name || ' / ' || c_mktsegment WHEN c_nationkey > 4 THEN c_name END AS summary,
               CASE WHEN c_nationkey > 4 THEN 'type: ' || c_mktsegment END AS memo, c_mktsegment AS hall, 'A 1' AS class, TRUE AS same
        FROM customer""",
    "file_cells": """
        WITH p AS (SELECT c_custkey, c_nationkey % 3 AS k, CASE WHEN c_nationkey % 2 = 0 THEN '20240' ELSE '2401' END || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS d,
                   CASE WHEN c_nationkey > 12 THEN '_수정' ELSE '' END AS r FROM customer)
        SELECT c_custkey, CASE k WHEN 0 THEN '기수_수기_홍길동_' || d || r WHEN 1 THEN 'report - 김철수' ELSE 'a_이영희-b ' || d || r END AS base,
               CASE k WHEN 0 THEN '홍길동' WHEN 1 THEN '김철수' ELSE '이영희' END AS name,
               CASE k WHEN 0 THEN '홍길동' WHEN 1 THEN '김철수' ELSE '이영희' END AS short_name,
               CASE WHEN k = 1 THEN '000000_0_' ELSE (CASE WHEN length(d) = 8 THEN d ELSE substr(d, 1, 6) END) || (CASE WHEN r = '' THEN '_0_' ELSE '_1_' END) END || c_custkey AS date_key
        FROM p""",
    "display_cells": r"""
        WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 5000) AS INTEGER) END AS t,
                   CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice / 100) AS BIGINT) * 1000 END AS m FROM orders)
        SELECT o_orderkey, COALESCE(CAST(CAST(floor(t / 20.0 + 0.5) AS BIGINT) AS VARCHAR), '-') AS five, COALESCE(t >= 80, FALSE) AS selected,
               CASE WHEN t IS NULL THEN 'none' WHEN t >= 80 THEN 'selected' WHEN t >= 60 THEN 'middle' ELSE 'low' END AS tone,
               CASE o_orderstatus WHEN 'F' THEN '선별됨' WHEN 'O' THEN '검토중' ELSE 'unknown' END AS label,
               CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'amber' ELSE 'gray' END AS state_tone,
               COALESCE(format('{:,}', m) || '원', '-') AS won,
               CASE WHEN m IS NULL THEN '-' WHEN m % 10000 = 0 THEN format('{:,}', m // 10000) || '만원' ELSE format('{:,}', m) || '원' END AS man_won,
               CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE (o_orderkey % 7) || '기' END AS cohort,
               CASE WHEN o_orderstatus = 'P' THEN '-' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
        FROM o""",
}
