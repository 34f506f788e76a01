"""Readers and sinks at work: what is written to the shared folder is read back; packed documents, workbooks and a stand-in scorer."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quillspark.functions import scalars as S
from quillspark.operators import delta, rounds, scoring
from quillspark.plans.reports import cents
from quillspark.sources import commits, documents, seed, sinks, tables
from quillspark.sources.shared import fresh_path
from quillspark.sources.tables import table


def bound_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parametrised SQL; the values are bound."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("bound_customer")
    return tables.query(spark, "SELECT c_custkey, c_name FROM bound_customer WHERE c_mktsegment = ? AND c_nationkey >= ?", "BUILDING", 5)


def bound_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("bound_customer")
    return tables.query_one(spark, "SELECT c_custkey, c_name FROM bound_customer WHERE c_custkey = :id", id=7)


def csv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas, line feeds and nothing in them, through a CSV sheet."""
    c = table(spark, sf_dir, "customer")
    cells = c.select(F.col("c_custkey").cast("string"), F.concat(F.lit('a "b", '), F.col("c_name"), F.lit("\nnext")), F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment")))
    path = fresh_path(spark, "grid")
    cells.write.option("quote", '"').option("escape", '"').option("header", False).csv(path)
    return tables.grid(spark, path)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per line, text beyond ASCII kept."""
    path = fresh_path(spark, "json")
    sinks.write_json(table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring("text", 1, 40).alias("head")), path)
    return spark.read.schema("doc_id long, lang string, head string").json(path)


def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds one JSON list."""
    path = fresh_path(spark, "list")
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    rows.coalesce(1).write.text(path)
    return tables.json_rows(spark, path, "n_nationkey int, n_name string")


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of a table is written from the first; both are there."""
    path = fresh_path(spark, "snapshots")
    first = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_snapshot(first, path, "1")
    changed = delta.add_column(sinks.read_snapshot(spark, path, "1").filter("o_orderstatus <> 'P'"), "note", F.lit("kept"))
    sinks.write_snapshot(changed, path, "2")
    both = sinks.read_snapshot(spark, path, "1").withColumn("note", F.lit(None).cast("string")).withColumn("version", F.lit(1))
    every = both.unionByName(sinks.read_snapshot(spark, path, "2").withColumn("version", F.lit(2)))
    return every.groupBy("version", "o_orderstatus", "note").agg(F.count("*").alias("n"))


def committed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions and answers loaded as one commit, then changed as one; a load on top of the older state is refused, and what is read is whole."""
    root = fresh_path(spark, "commits")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    first = commits.commit(spark, root, {"submissions": orders.filter("o_orderstatus <> 'P'"), "answers": lines}, commits.state(spark, root))
    finished = commits.read(spark, root, "submissions", first).filter("o_orderstatus = 'F'")
    answers = delta.delete_in(commits.read(spark, root, "answers", first), finished.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    commits.commit(spark, root, {"submissions": finished, "answers": answers}, first)
    try:
        commits.commit(spark, root, {"answers": lines.limit(0)}, first)
    except commits.ConflictError:
        pass
    now = commits.state(spark, root)
    by_status = commits.read(spark, root, "submissions", now).groupBy(F.lit("submissions").alias("table"), F.col("o_orderstatus").alias("part"))
    by_line = commits.read(spark, root, "answers", now).groupBy(F.lit("answers").alias("table"), F.col("l_linenumber").cast("string").alias("part"))
    return by_status.agg(F.count("*").alias("n")).unionByName(by_line.agg(F.count("*").alias("n")))


def scored_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer that refuses some messages: calls in rounds over a written state, with the attempts of each row."""

    def scorer(message: str) -> str:
        if message.endswith("3"):
            raise ValueError("no answer")
        return message[::-1]

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.concat_ws("-", "o_orderpriority", "o_custkey").alias("message"))
    return rounds.score_in_rounds(rows, scorer, fresh_path(spark, "rounds"), attempts=3, pause=0.0, errors=(ValueError,))


def scored_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer over messages: replies, and an error after all attempts."""

    def scorer(message: str) -> str:
        if message.endswith("3"):
            raise ValueError("no answer")
        return f'{{"가독성": {len(message) % 6}}}'

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("message"))
    return scoring.score(rows, scorer, attempts=2, pause=0)


def resumed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run still has to do: rows without a result and rows that ended in an error."""
    path = fresh_path(spark, "results")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), "p_name")
    done = rows.filter("row % 3 = 0").select("row", F.lit("{}").alias("reply"), F.when(F.col("row") % 2 == 0, "timeout").alias("error"))
    sinks.append_results(done.filter("row % 4 <> 0"), path)
    sinks.append_results(done.filter("row % 4 = 0"), path)
    return sinks.resume(rows, path)


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result columns of a grid: set where there is a result, the grid's own elsewhere."""
    grid = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("score"))
    results = grid.filter("row % 3 = 0").select("row", F.when(F.col("row") % 2 == 0, F.lit("new")).alias("score"), F.lit("done").alias("state"))
    return sinks.write_back(grid, results, ["score", "state"])


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 5, "matched").when(F.col("c_nationkey") < 9, "new").otherwise("ambiguous").alias("how"))
    return sinks.match_report(rows)


def normal_where_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names replaced by their normal form where that is neither empty nor the same; invisible characters go too."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit("abc (x)")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("7​"), F.col("p_size").cast("string"), F.lit(" (y) z"))).otherwise(F.lit("9")).alias("name"))
    return delta.normalised_where_changed(p, "name", S.normal_name(F.col("name"), zero_width=True))


def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors and evaluations per cohort of the seed tables."""
    made = seed.seed(spark)
    judged = made["evaluations"].groupBy("author_id").agg(F.count("*").alias("n"))
    return made["authors"].join(judged, made["authors"].id == judged.author_id, "left").groupBy("cohort").agg(F.count("*").alias("n_authors"), F.sum("n").alias("n_evaluations"))


@pandas_udf(BinaryType())
def _packed(member: pd.Series, content: pd.Series) -> pd.Series:
    def one(name: str, text: str) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(name, text)
        return data.getvalue()

    return pd.Series([one(n, t) for n, t in zip(member, content)])


def _file(df: DataFrame, extension: str, member: str, content) -> DataFrame:
    # A file costs far more work than its row has bytes, so rows are dealt over all cores, twice, not by the size of the scan.
    dealt = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "c_custkey")
    return dealt.select(F.concat(F.col("c_custkey").cast("string"), F.lit(extension)).alias("path"), _packed(F.lit(member), content).alias("content"))


def packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-processor files of two formats, one per customer, as text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    docx = F.concat(F.lit("<w:p><w:r><w:t>"), F.col("c_name"), F.lit("</w:t></w:r><w:t> &amp; more</w:t></w:p><w:p><w:t>"), F.col("c_mktsegment"), F.lit("</w:t></w:p>"))
    hwpx = F.concat(F.lit('<hp:p><hp:t>'), F.col("c_name"), F.lit('</hp:t><hp:t a="1">second &lt;run&gt;</hp:t></hp:p><hp:p><hp:t>'), F.col("c_mktsegment"), F.lit("</hp:t></hp:p>"))
    files = _file(c.filter("c_custkey % 2 = 0"), ".docx", "word/document.xml", docx).unionByName(_file(c.filter("c_custkey % 2 = 1"), ".hwpx", "Contents/section0.xml", hwpx))
    return documents.extract(files)


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns of a row range of workbooks; a short row has no second cell."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    number = F.col("c_nationkey").cast("string")
    sheet = F.concat(
        F.lit('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>head</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>'),
        F.col("c_name"), F.lit('</t></is></c><c r="C2"><v>'), number, F.lit('</v></c></row><row r="3"><c r="A3"><v>'), number, F.lit("</v></c></row></sheetData></worksheet>"),
    )
    rows = documents.workbook_rows(_file(c, ".xlsx", "xl/worksheets/sheet1.xml", sheet))
    return documents.fixed_columns(rows, {"first": 1, "third": 3}, first=2).groupBy("row", "first", "third").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    bound_scan, bound_row, csv_grid, json_round_trip, json_list, snapshot_versions, scored_batch, committed_load, scored_in_rounds, resumed_batch, written_back, match_report, normal_where_changed, seed_counts,
    packed_files, workbook_cells,
)}

ORACLES = {
    "committed_load": """
        SELECT 'submissions' AS table, o_orderstatus AS part, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
        UNION ALL SELECT 'answers', CAST(l_linenumber AS VARCHAR), COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2""",
    "scored_in_rounds": """
        SELECT o_orderkey AS row, CASE WHEN o_custkey % 10 = 3 THEN 3 ELSE 1 END AS attempts, CASE WHEN o_custkey % 10 <> 3 THEN reverse(o_orderpriority || '-' || o_custkey) END AS reply,
               CASE WHEN o_custkey % 10 = 3 THEN 'ValueError: no answer' END AS error FROM orders""",
    "bound_scan": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 5",
    "bound_row": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7",
    "csv_grid": """SELECT CAST(c_custkey AS VARCHAR) AS _c0, 'a "b", ' || c_name || chr(10) || 'next' AS _c1, CASE WHEN c_nationkey > 9 THEN c_mktsegment END AS _c2 FROM customer""",
    "json_round_trip": "SELECT doc_id, lang, substr(text, 1, 40) AS head FROM documents",
    "json_list": "SELECT n_nationkey, n_name FROM nation",
    "snapshot_versions": """
        SELECT 1 AS version, o_orderstatus, CAST(NULL AS VARCHAR) AS note, COUNT(*) AS n FROM orders GROUP BY 2
        UNION ALL SELECT 2, o_orderstatus, 'kept', COUNT(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2""",
    "scored_batch": """
        SELECT p_partkey AS row, CASE WHEN p_partkey % 10 <> 3 THEN '{"가독성": ' || (length('part ' || p_partkey) % 6) || '}' END AS reply, CASE WHEN p_partkey % 10 = 3 THEN 'ValueError: no answer' END AS error FROM part""",
    "resumed_batch": "SELECT p_partkey AS row, p_name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    "written_back": """
        SELECT p_partkey AS row, CASE WHEN p_partkey % 3 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'new' END AS score, CASE WHEN p_partkey % 3 = 0 THEN 'done' END AS state FROM part""",
    "match_report": """
        SELECT how, COUNT(*) AS n, MIN('{"c_custkey":' || c_custkey || '}') AS example
        FROM (SELECT *, CASE WHEN c_nationkey < 5 THEN 'matched' WHEN c_nationkey < 9 THEN 'new' ELSE 'ambiguous' END AS how FROM customer) GROUP BY how""",
    "normal_where_changed": """
        SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'abc (x)' WHEN 1 THEN '7' || p_size ELSE '9' END AS name FROM part""",
    "seed_counts": "SELECT * FROM (VALUES (5, 88, 88), (6, 81, 81), (7, 99, 99), (8, 69, 138), (9, 92, 184)) t(cohort, n_authors, n_evaluations)",
    "packed_files": """
        SELECT c_custkey || '.docx' AS path, c_name || ' & more' || chr(10) || c_mktsegment AS text FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey || '.hwpx', c_name || chr(10) || 'second <run>' || chr(10) || c_mktsegment FROM customer WHERE c_custkey % 2 = 1""",
    "workbook_cells": """
        SELECT 2 AS row, c_name AS first, CAST(c_nationkey AS VARCHAR) AS third, COUNT(*) AS n FROM customer GROUP BY ALL
        UNION ALL SELECT 3, CAST(c_nationkey AS VARCHAR), NULL, COUNT(*) FROM customer GROUP BY ALL""",
}
