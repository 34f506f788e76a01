"""Changes from one snapshot to the next, and the constraints that guard them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scalars import SCORE_AMOUNTS, lookup
from quillspark.operators import delta, dedup, history, scoring, validate
from quillspark.plans.reports import cents
from quillspark.sources.tables import table


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", cents("c_acctbal").alias("fee"))


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("price"))


def first_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every host; pages without a host all stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return dedup.keep_first_per_key(pages, "host", "page_id")


def backfill_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one cohort, the fee of authors with submissions follows from the level of their best one; other levels give 0."""
    level = F.max(F.least(F.lit(5), F.floor(F.col("o_totalprice") / 80000)) * 20).cast("int")
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(level.alias("level"))
    both = _authors(spark, sf_dir).join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    amount = lookup({k: v for k, v in SCORE_AMOUNTS.items() if k != 40}, F.col("level"), F.lit(0)).cast("long")
    changed = delta.update_where(both, (F.col("c_nationkey") == 6) & F.col("level").isNotNull(), fee=amount)
    return changed.select("c_custkey", "c_nationkey", "fee", "level")


def backfill_from_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fee of every author becomes the largest price of the submissions, 0 without any."""
    return delta.update_from_children(_authors(spark, sf_dir), "c_custkey", "fee", _submissions(spark, sf_dir), "o_custkey", F.max("price"))


def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.update_where(_authors(spark, sf_dir), (F.col("fee") < 0) & (F.col("c_nationkey") >= 5), c_mktsegment=F.lit("OVERDUE"), fee=F.lit(0).cast("long"))


def merged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three precedence rules of an update side by side: overwrite, prefer the new value, fill what is blank."""
    text = F.when(F.col("c_nationkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    old = _authors(spark, sf_dir).select("c_custkey", *[text.alias(c) for c in ("univ", "phone", "hall")])
    fresh = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("v"))
    value = F.when(F.col("v").startswith("1"), F.lit("")).otherwise(F.col("v"))
    updates = fresh.select(F.col("o_custkey").alias("c_custkey"), *[value.alias(c) for c in ("univ", "phone", "hall")])
    return delta.merge(old, updates, "c_custkey", {"univ": "prefer_new", "phone": "overwrite", "hall": "fill"})


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot of the submissions that are not pending, and rows that update the finished and add the pending ones."""
    all_ = _submissions(spark, sf_dir)
    rows = all_.filter("o_orderstatus <> 'O'").withColumn("price", F.col("price") + 100)
    return all_.filter("o_orderstatus <> 'P'"), rows


def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, rows = _changed(spark, sf_dir)
    return delta.upsert(snapshot, rows, "o_orderkey", ["price"])


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, rows = _changed(spark, sf_dir)
    return delta.insert_if_absent(snapshot, rows, ["o_orderkey"])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("price"))


def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of pending submissions give way to one answer that holds their sum."""
    lines = _answers(spark, sf_dir)
    pending = _submissions(spark, sf_dir).filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = lines.join(pending, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.sum("price").alias("price")).withColumn("l_linenumber", F.lit(1))
    return delta.replace_children(lines, pending, fresh, "l_orderkey")


def delete_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _submissions(spark, sf_dir).filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return delta.delete_in(_answers(spark, sf_dir), gone, "l_orderkey")


def split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question columns of the parts move into a table of their own: the parts with the ids that stand for them."""
    return _split(spark, sf_dir)[0]


def question_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that those ids lead to: one row per distinct question."""
    return _split(spark, sf_dir)[1]


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return delta.split_dimension(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"], "question")


def rebuilt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines copied by position into other names, without one column, and checked anew: how many rows break each rule."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax")
    _, broken = delta.rebuild(delta.drop_column(lines, "l_tax"), ["id", "place", "amount", "flag"], {"amount": F.col("amount") <= 40, "flag": F.col("flag") != "R", "id": F.col("id").isNotNull()})
    return broken


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _authors(spark, sf_dir).filter("fee < 0").select(F.col("c_custkey").alias("o_custkey"))
    return validate.cascade(_submissions(spark, sf_dir), gone, "o_custkey")


def set_null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _authors(spark, sf_dir).filter("fee < 0").select(F.col("c_custkey").alias("o_custkey"))
    return validate.set_null(_submissions(spark, sf_dir), gone, "o_custkey")


def restrict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that forbid the deletion of their authors."""
    gone = _authors(spark, sf_dir).filter("fee < 0").select(F.col("c_custkey").alias("o_custkey"))
    return validate.restricted(_submissions(spark, sf_dir), gone, "o_custkey")


def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions without an answer."""
    return validate.orphans(_submissions(spark, sf_dir), _answers(spark, sf_dir), "o_orderkey", "l_orderkey")


def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(_answers(spark, sf_dir), ["l_orderkey", "l_linenumber"])


def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "quantity": F.col("l_quantity").between(1, 45),
        "discount": F.col("l_discount").between(0, 0.08),
        "flag": F.col("l_returnflag").isin("A", "N"),
        "status": F.col("l_linestatus").isin("F", "O"),
    }
    return validate.violations(table(spark, sf_dir, "lineitem"), rules)


def skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no evaluation has finished."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"), F.when(F.col("toxic") == 1, "retry").alias("error"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "lang", "source")
    return scoring.remaining(rows, done)


def symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected documents after a click on every toxic one."""
    labels = table(spark, sf_dir, "labels")
    return delta.toggled(labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 1").select("doc_id"))


_S = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders"
_A = "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem"
_NEW = f"SELECT * REPLACE (price + 100 AS price) FROM ({_S}) WHERE o_orderstatus <> 'O'"
_QUESTION = "'question_' || substr(sha256(p_type || chr(1) || p_brand), 1, 16)"
_GONE = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"

def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines with repeated rows and keys, and a later state: some gone, some twice as often, some with another flag."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    stay = old.filter("NOT (l_returnflag = 'R' AND l_linenumber % 3 = 0)")
    new = stay.withColumn("l_returnflag", F.when(F.col("l_suppkey") % 5 == 0, F.lit("X")).otherwise(F.col("l_returnflag")))
    return old, new.unionByName(new.filter("l_suppkey % 7 = 0"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes between two states of a table, with both images."""
    changes = history.difference(*_snapshots(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    images = [F.col(side)[c].alias(f"{side}_{c[2:]}") for side in ("before", "after") for c in ("l_suppkey", "l_returnflag")]
    return changes.select("action", "l_orderkey", "l_linenumber", *images, "times")


def snapshot_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later state, from the earlier one and the changes alone."""
    old, new = _snapshots(spark, sf_dir)
    return history.replayed(old, history.difference(old, new, ["l_orderkey", "l_linenumber"]))


QUERIES = {f.__name__: f for f in (
    first_per_url, backfill_case, backfill_from_children, conditional_update, merged_columns, upsert_by_key, insert_if_absent, replace_children, delete_in,
    split_questions, question_dimension, rebuilt_table, cascade_delete, set_null_delete, restrict_check, orphan_check, unique_check, range_check, skip_done, symmetric_diff, snapshot_changes, snapshot_replayed,
)}

_SNAPSHOTS = """
    old AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem),
    later AS (SELECT * REPLACE (CASE WHEN l_suppkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM old WHERE NOT (l_returnflag = 'R' AND l_linenumber % 3 = 0)),
    new AS (FROM later UNION ALL FROM later WHERE l_suppkey % 7 = 0)"""

ORACLES = {
    "snapshot_replayed": f"WITH {_SNAPSHOTS} FROM new",
    "snapshot_changes": f"""
        WITH {_SNAPSHOTS},
        gone AS (SELECT *, COUNT(*) AS n FROM (FROM old EXCEPT ALL FROM new) GROUP BY ALL), come AS (SELECT *, COUNT(*) AS n FROM (FROM new EXCEPT ALL FROM old) GROUP BY ALL),
        one AS (
            SELECT l_orderkey, l_linenumber FROM gone JOIN come c USING (l_orderkey, l_linenumber) GROUP BY ALL HAVING COUNT(*) = 1 AND SUM(gone.n) = 1 AND SUM(c.n) = 1)
        SELECT 'update' AS action, l_orderkey, l_linenumber, gone.l_suppkey AS before_suppkey, gone.l_returnflag AS before_returnflag, come.l_suppkey AS after_suppkey, come.l_returnflag AS after_returnflag, 1 AS times
        FROM one JOIN gone USING (l_orderkey, l_linenumber) JOIN come USING (l_orderkey, l_linenumber)
        UNION ALL SELECT 'delete', l_orderkey, l_linenumber, l_suppkey, l_returnflag, NULL, NULL, n FROM gone ANTI JOIN one USING (l_orderkey, l_linenumber)
        UNION ALL SELECT 'insert', l_orderkey, l_linenumber, NULL, NULL, l_suppkey, l_returnflag, n FROM come ANTI JOIN one USING (l_orderkey, l_linenumber)""",
    "first_per_url": """
        SELECT page_id, url, host FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
        QUALIFY COALESCE(host, '') = '' OR row_number() OVER (PARTITION BY host ORDER BY page_id) = 1""",
    "backfill_case": """
        WITH best AS (SELECT o_custkey, CAST(MAX(least(5, floor(o_totalprice / 80000)) * 20) AS INTEGER) AS level FROM orders GROUP BY 1)
        SELECT c_custkey, c_nationkey, level,
               CASE WHEN c_nationkey = 6 AND level IS NOT NULL
                    THEN CAST(CASE level WHEN 100 THEN 250000 WHEN 80 THEN 190000 WHEN 60 THEN 150000 WHEN 20 THEN 100000 ELSE 0 END AS BIGINT)
                    ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS fee
        FROM customer LEFT JOIN best ON o_custkey = c_custkey""",
    "backfill_from_children": f"""
        SELECT c_custkey, c_nationkey, c_mktsegment, COALESCE((SELECT MAX(price) FROM ({_S}) WHERE o_custkey = c_custkey), 0) AS fee FROM customer""",
    "conditional_update": """
        SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 AND c_nationkey >= 5 THEN 'OVERDUE' ELSE c_mktsegment END AS c_mktsegment,
               CASE WHEN c_acctbal < 0 AND c_nationkey >= 5 THEN 0 ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS fee FROM customer""",
    "merged_columns": """
        WITH old AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS t FROM customer),
        fresh AS (SELECT o_custkey, CASE WHEN MAX(o_orderpriority) LIKE '1%' THEN '' ELSE MAX(o_orderpriority) END AS v FROM orders GROUP BY 1)
        SELECT c_custkey, COALESCE(NULLIF(v, ''), t) AS univ, CASE WHEN o_custkey IS NULL THEN t ELSE NULLIF(v, '') END AS phone,
               COALESCE(NULLIF(trim(t), ''), v, t) AS hall
        FROM old LEFT JOIN fresh ON o_custkey = c_custkey""",
    "upsert_by_key": f"SELECT * FROM ({_S}) WHERE o_orderstatus = 'O' UNION ALL {_NEW}",
    "insert_if_absent": f"SELECT * FROM ({_S}) WHERE o_orderstatus <> 'P' UNION ALL {_NEW} AND o_orderstatus = 'P'",
    "replace_children": f"""
        WITH pending AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
        SELECT * FROM ({_A}) WHERE l_orderkey NOT IN (FROM pending)
        UNION ALL SELECT l_orderkey, 1, CAST(SUM(price) AS BIGINT) FROM ({_A}) WHERE l_orderkey IN (FROM pending) GROUP BY 1""",
    "delete_in": f"SELECT * FROM ({_A}) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "split_questions": f"SELECT p_partkey, {_QUESTION} AS question_id FROM part",
    "question_dimension": f"SELECT DISTINCT {_QUESTION} AS id, p_type, p_brand FROM part",
    "rebuilt_table": """
        SELECT 'amount' AS rule, COUNT(*) FILTER (l_quantity > 40) AS n FROM lineitem UNION ALL SELECT 'flag', COUNT(*) FILTER (l_returnflag = 'R') FROM lineitem UNION ALL SELECT 'id', 0""",
    "cascade_delete": f"SELECT * FROM ({_S}) WHERE o_custkey NOT IN {_GONE}",
    "set_null_delete": f"SELECT * REPLACE (CASE WHEN o_custkey IN {_GONE} THEN NULL ELSE o_custkey END AS o_custkey) FROM ({_S})",
    "restrict_check": f"SELECT * FROM ({_S}) WHERE o_custkey IN {_GONE}",
    "orphan_check": f"SELECT * FROM ({_S}) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "unique_check": "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "range_check": """
        SELECT 'quantity' AS rule, COUNT(*) AS n FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45)
        UNION ALL SELECT 'discount', COUNT(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08::DOUBLE)
        UNION ALL SELECT 'flag', COUNT(*) FROM lineitem WHERE NOT (l_returnflag IN ('A', 'N'))
        UNION ALL SELECT 'status', COUNT(*) FROM lineitem WHERE NOT (l_linestatus IN ('F', 'O'))""",
    "skip_done": "SELECT doc_id AS row, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1)",
    "symmetric_diff": "SELECT doc_id FROM labels WHERE (quality = 1) <> (toxic = 1)",
}
