"""Documents as lines, manuscripts as segments, replies of a scorer, nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import scoring
from quillspark.plans.reports import cents
from quillspark.sources.tables import payload_rows, table


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, blanks collapsed, consecutive equal lines once."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.consecutive_distinct(T.text_lines(T.html_to_text(F.col("html")))).alias("lines"))
    return pages.select("page_id", F.array_join("lines", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: Share of a language's documents that makes a line boilerplate; the default 0.25 finds none in these tables.
RATIO = 0.01


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents of a language share."""
    return T.boilerplate(_lines(spark, sf_dir), "lang", "doc_id", "line", min_ratio=RATIO)


def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without boilerplate and guide lines; documents of which nothing is left have no row."""
    lines = _lines(spark, sf_dir)
    return T.stripped(lines, "doc_id", "lang", boilerplate_lines(spark, sf_dir)).select("doc_id", F.length("body").cast("long").alias("n_chars"), F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


def segment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns gathered under the user turn above them; what precedes the first one is dropped."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line"), "role")
    asks = F.col("role") == "user"
    none = F.lit(None).cast("string")
    marks = {"key": F.when(asks, F.concat(F.lit("q"), F.col("pos").cast("string"))), "header": F.when(asks, F.col("line")), "section": none}
    return T.segments(turns, "conv_id", marks).select("conv_id", "segment", "key", "header", "body")


#: Lines of manuscripts, chosen by a number of the data: sections, questions of both templates, guides that look like questions, body.
LINES = ("A. 시기별 질문", "A1. first one", "plain", "[1-2] bracketed", " B. 주제별 질문 ", "B12. 둘째", "[3-1]과 같은 guide", "", "[4] alone", "C. no question here", "more", "A.질문", "[5-1]", "B3.tight", "\tA2. after a tab", "\u3000B4. after a wide blank\u00a0", "\u00a0C. 선택 질문\t", "\u2003[6] spaced")


def _manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manuscript per user, one line per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.element_at(F.array(*[F.lit(x) for x in LINES]), k % len(LINES) + 1)
    line = F.when(line.isin("plain", "more"), F.concat(line, F.lit(" "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))).otherwise(line)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), line.alias("line"))


def manuscript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered manuscripts: section lines name the category of the questions after them."""
    return T.segments(_manuscripts(spark, sf_dir), "doc", T.markers(F.col("line"), lettered=True))


def manuscript_segments_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuscripts with [n] and [n-m] questions."""
    return T.segments(_manuscripts(spark, sf_dir), "doc", T.markers(F.col("line"), lettered=False))


#: Lines of an identity block, chosen by a number of the data.
FIELDS = ("이름", "", "* remark", "나이", "value", "소속 관&반", "", "other", "최종대학", "* note", "이름", "no label", "\u3000", "\t나이", "\u00a0* remark", " \u2003최종대학\u3000", "\tvalued\u00a0")


def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields after known labels: blank lines, remarks and other labels do not count as values."""
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.element_at(F.array(*[F.lit(x) for x in FIELDS]), k % len(FIELDS) + 1)
    line = F.when(line.isin("value", "other"), F.concat(line, F.lit(" "), F.col("event_id").cast("string"))).otherwise(line)
    return T.identity(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), line.alias("line")), "doc")


def boilerplate_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default share: a guide line in a third of the documents is boilerplate, one in a fifth is not."""
    guide = lambda n, text: F.when(F.col("doc_id") % n == 0, F.lit(text))
    lines = F.array_compact(F.array(guide(3, "가이드 하나"), guide(5, "\tsecond guide\u3000"), F.col("source"), guide(4, "quarter"), guide(2, "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(lines).alias("pos", "line"))
    return T.boilerplate(rows, "lang", "doc_id", "line")


def html_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of tables: cells, headers and rows end a line."""
    c = table(spark, sf_dir, "customer")
    page = F.concat(
        F.lit("<html><STYLE>td{}</style><body class='x'><table border=1><tr><th>name</th><td>"), F.col("c_name"), F.lit("</td><TD>a&#13;b &lt;"), F.col("c_mktsegment"),
        F.lit("&gt;&copy;</TD></tr></table>after<h2>"), F.col("c_nationkey").cast("string"), F.lit("</h2><p>x<br>x</body></html>"),
    )
    lines = T.consecutive_distinct(T.text_lines(T.html_to_text(page)))
    return c.select("c_custkey", F.array_join(lines, "|").alias("lines"))


def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without empty lines and lines that repeat the one before."""
    lines = T.consecutive_distinct(F.split("text", "\n"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    return docs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.encode(F.array_join("lines", "\n"), "UTF-8")).alias("lines_md5"))


def scored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies parsed, coerced and weighed: numbers, texts, Booleans, missing and null fields, fences and prose."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    first = F.format_string("%.1f", F.col("k") / 10)
    second = F.when(F.col("k") % 5 == 0, F.lit("null")).when(F.col("k") % 5 == 1, F.lit('"3"')).when(F.col("k") % 5 == 2, F.lit("true")).when(F.col("k") % 5 == 3, F.lit('"many"')).otherwise(F.lit("9"))
    third = F.when(F.col("k") % 3 == 0, F.concat(F.lit('"독창성": '), (F.col("k") % 6).cast("string"), F.lit(", "))).otherwise("")
    final = F.when(F.col("k") % 7 == 0, F.concat(F.lit(', "최종_점수": '), (F.col("k") % 9 - 2).cast("string"), F.lit(', "선별_상태": "예비"'))).otherwise("")
    body = F.concat(F.lit('{"정성_구체성": '), first, F.lit(', "실용성_타겟적합성": '), second, F.lit(", "), third, F.lit('"가독성": 2.5'), final, F.lit(', "한줄평": " ok "}'))
    reply = F.when(F.col("k") % 11 == 0, F.lit("no object")).when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" end")))
    parsed = scoring.parsed(e.withColumn("reply", reply))
    return parsed.select("event_id", "valid", *[F.col(c).alias(a) for c, a in (("정성_구체성", "s1"), ("실용성_타겟적합성", "s2"), ("독창성", "s3"), ("가독성", "s4"), (scoring.FINAL, "final"), ("선별_상태", "state"), ("신뢰성_리스크", "risk"), ("한줄평", "remark"))])


def scoring_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a text and no score yet, with the message that a scorer would get."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 5).alias("final_score"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("row"), F.col("text").alias("body"), "lang", "source", "final_score")
    todo = scoring.jobs(docs)
    return todo.select("row", scoring.prompt({"언어": F.col("lang"), "출처": F.col("source"), "글자수": F.length("body")}).alias("message"))


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a command line's JSON: text before the first bracket, then batches with a list of results each."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    payload = F.concat(F.lit("done. "), F.lit('[{"results":['), F.col("props"), F.lit(',{"k":-1}]},{"results":[]},{"results":['), F.col("props"), F.lit("]}]"))
    payload = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(payload)
    return payload_rows(e.select("event_id", payload.alias("payload")), "payload", "k int").select("event_id", "batch", "pos", "k")


def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and state of sub-scores that are columns already."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("price"), (F.col("l_quantity") % 6).cast("int").alias("a"), (F.col("l_linenumber") % 6).alias("b"), F.round(F.col("l_discount") * 50).cast("int").alias("c"), F.round(F.col("l_tax") * 60).cast("int").alias("d"))
    mean = scoring.weighted(dict(zip(scoring.WEIGHTS, (F.col("a"), F.col("b"), F.col("c"), F.col("d")))))
    return lines.select("l_orderkey", "l_linenumber", "price", mean.alias("final"), scoring.status_of(mean).alias("state"))


QUERIES = {f.__name__: f for f in (
    html_to_text, html_table_text, boilerplate_lines, boilerplate_quarter, strip_boilerplate, segment_turns, manuscript_segments, manuscript_segments_bracketed, identity_lookup, consecutive_dedup, scored_replies, scoring_jobs,
    json_flatten, score_columns,
)}

_LINES = "SELECT doc_id, lang, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"
#: The white space that is trimmed.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_strip = lambda c: f"trim({c}, '{_SPACES}')"
_COMMON = f"""
    SELECT lang, line, c FROM (SELECT lang, {_strip("line")} AS line, COUNT(DISTINCT doc_id) AS c FROM ({_LINES}) WHERE {_strip("line")} <> '' GROUP BY 1, 2)
    JOIN (SELECT lang, COUNT(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) USING (lang) WHERE c >= greatest(3, floor(n * {RATIO}::DOUBLE))"""
_DISTINCT = "list_filter({0}, lambda x, i: x <> '' AND (i = 1 OR x <> {0}[i - 1]))"


def _segments_sql(key: str, section: str) -> str:
    """Gathering of lines under markers, for expressions of a line's question key and section."""
    listed = ", ".join(f"'{x}'" for x in LINES)
    return rf"""
        WITH e AS (
            SELECT user_id AS doc, event_id AS pos, CASE WHEN l IN ('plain', 'more') THEN l || ' ' || event_type || ' ' || event_id ELSE l END AS line
            FROM (SELECT *, ([{listed}])[CAST(props->>'$.k' AS INTEGER) % {len(LINES)} + 1] AS l FROM events)),
        m AS (SELECT *, nullif({key}, '') AS key FROM e),
        s AS (SELECT *, CASE WHEN key IS NULL THEN nullif({section}, '') END AS part FROM m),
        r AS (
            SELECT *, SUM(CASE WHEN key IS NOT NULL OR part IS NOT NULL THEN 1 ELSE 0 END) OVER w AS segment, LAST_VALUE(part IGNORE NULLS) OVER w AS named
            FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT doc, CAST(segment AS BIGINT) AS segment, MAX(key) AS key, MAX(CASE WHEN key IS NOT NULL THEN {_strip('line')} END) AS header,
               MAX(CASE WHEN key IS NOT NULL THEN named END) AS section,
               {_strip("COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (key IS NULL AND part IS NULL), '')")} AS body
        FROM r GROUP BY doc, segment HAVING MAX(key) IS NOT NULL"""


ORACLES = {
    "html_to_text": rf"""
        WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, CASE WHEN regexp_matches(t, '(?i)<body') THEN regexp_replace(t, '(?is)^.*?<body[^>]*>', '') ELSE t END AS t FROM a),
        c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|tr|td|th|br|li|h[1-6]|table)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM b),
        d AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(t, '&#13;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&nbsp;', ' '), '&[a-zA-Z]+;', ' ', 'g') AS t FROM c),
        e AS (SELECT page_id, list_transform(string_split(t, chr(10)), lambda x: {_strip("regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g')")}) AS l FROM d),
        f AS (SELECT page_id, {_DISTINCT.format("l")} AS l FROM e)
        SELECT page_id, array_to_string(l, chr(10)) AS text, len(l) AS n_lines FROM f""",
    "boilerplate_lines": _COMMON,
    "strip_boilerplate": rf"""
        WITH common AS ({_COMMON}),
        kept AS (SELECT doc_id, lang, pos, {_strip('line')} AS line FROM ({_LINES}))
        SELECT doc_id, length(body) AS n_chars, md5(body) AS body_md5 FROM (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM kept
            WHERE line <> '' AND NOT starts_with(line, '※') AND NOT starts_with(line, '*') AND {" AND ".join(f"NOT contains(line, '{h}')" for h in T.GUIDE_HINTS)}
              AND NOT EXISTS (SELECT 1 FROM common c WHERE c.lang = kept.lang AND c.line = kept.line)
            GROUP BY doc_id)""",
    "segment_turns": rf"""
        WITH run AS (SELECT *, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
        SELECT conv_id, CAST(segment AS BIGINT) AS segment, MAX(CASE WHEN role = 'user' THEN 'q' || turn END) AS key, MAX(CASE WHEN role = 'user' THEN text END) AS header,
               {_strip("COALESCE(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user'), '')")} AS body
        FROM run WHERE segment > 0 GROUP BY conv_id, segment""",
    "manuscript_segments": _segments_sql(rf"regexp_extract({_strip('line')}, '^([ABC][0-9]+)\.', 1)", rf"regexp_extract({_strip('line')}, '^([ABC])\.\s*.+질문', 1)"),
    "manuscript_segments_bracketed": _segments_sql(rf"regexp_extract({_strip('line')}, '^\[([0-9]+(-[0-9]+)?)\]\s+\S', 1)", "''"),
    "identity_lookup": f"""
        WITH e AS (
            SELECT user_id AS doc, event_id AS pos, CASE WHEN l IN ('value', 'other') THEN l || ' ' || event_id ELSE l END AS line
            FROM (SELECT *, ([{", ".join(f"'{x}'" for x in FIELDS)}])[CAST(props->>'$.k' AS INTEGER) % {len(FIELDS)} + 1] AS l FROM events)),
        labels AS (SELECT unnest([{", ".join(f"{{'label': '{k}', 'field': '{v}'}}" for k, v in T.IDENTITY_LABELS.items())}], recursive := true)),
        near AS (SELECT *, LEAD(line, 1) OVER w AS l1, LEAD(line, 2) OVER w AS l2, LEAD(line, 3) OVER w AS l3 FROM e WINDOW w AS (PARTITION BY doc ORDER BY pos)),
        found AS (
            SELECT doc, field, pos, list_filter(list_transform([l1, l2, l3], lambda x: {_strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '*') AND x NOT IN ({", ".join(f"'{k}'" for k in T.IDENTITY_LABELS)}))[1] AS value
            FROM near JOIN labels ON {_strip('line')} = label)
        SELECT doc, field, arg_min(value, pos) AS value FROM found WHERE value IS NOT NULL GROUP BY doc, field""",
    "boilerplate_quarter": f"""
        WITH l AS (
            SELECT doc_id, lang, unnest([CASE WHEN doc_id % 3 = 0 THEN '가이드 하나' END, CASE WHEN doc_id % 5 = 0 THEN '\tsecond guide\u3000' END, source, CASE WHEN doc_id % 4 = 0 THEN 'quarter' END]) AS line FROM documents),
        held AS (SELECT lang, {_strip('line')} AS line, COUNT(DISTINCT doc_id) AS c FROM l WHERE {_strip('line')} <> '' GROUP BY ALL),
        n AS (SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang)
        SELECT lang, line, c FROM held JOIN n USING (lang) WHERE c >= greatest(3, CAST(floor(n * 0.25) AS BIGINT))""",
    "html_table_text": """
        SELECT c_custkey, 'name|' || c_name || '|a b <' || c_mktsegment || '>|after|' || c_nationkey || '|x' AS lines FROM customer""",
    "consecutive_dedup": f"""
        SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5
        FROM (SELECT doc_id, {_DISTINCT.format("s")} AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))""",
    "scored_replies": """
        WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
        s AS (SELECT event_id, k, k % 11 <> 0 AS object, CAST(least(5, greatest(0, round_even(k / 10.0::DOUBLE, 0))) AS INTEGER) AS s1,
              CASE k % 5 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 4 THEN 5 END AS s2, CASE WHEN k % 3 = 0 THEN least(5, k % 6) ELSE 0 END AS s3, 2 AS s4 FROM e),
        w AS (SELECT *, CASE WHEN k % 7 = 0 AND object THEN least(5, greatest(0, k % 9 - 2))
              ELSE CAST(round_even((s1 * 4 + s2 * 2 + s3 * 2 + s4 * 2) / 10.0::DOUBLE, 0) AS INTEGER) END AS f FROM s)
        SELECT event_id, object AND s2 IS NOT NULL AS valid, CASE WHEN object THEN s1 ELSE 0 END AS s1, CASE WHEN object THEN s2 ELSE 0 END AS s2,
               CASE WHEN object THEN s3 ELSE 0 END AS s3, CASE WHEN object THEN s4 ELSE 0 END AS s4, CASE WHEN object THEN f ELSE 0 END AS final,
               CASE WHEN object AND k % 7 = 0 THEN '예비' WHEN object AND f >= 4 THEN '선별' WHEN object AND f = 3 THEN '예비' ELSE '제외' END AS state,
               '없음' AS risk, CASE WHEN object THEN 'ok' ELSE '' END AS remark
        FROM w""",
    "scoring_jobs": """
        SELECT doc_id AS row, '[언어] ' || COALESCE(lang, '') || chr(10) || '[출처] ' || COALESCE(source, '') || chr(10) || '[글자수] ' || length(text) AS message
        FROM documents LEFT JOIN labels USING (doc_id) WHERE COALESCE(trim(text), '') <> '' AND quality IS DISTINCT FROM 1""",
    "json_flatten": """
        WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events WHERE event_type <> 'error')
        SELECT event_id, 0 AS batch, 0 AS pos, k FROM e UNION ALL SELECT event_id, 0, 1, -1 FROM e UNION ALL SELECT event_id, 2, 0, k FROM e""",
    "score_columns": """
        WITH s AS (SELECT *, CAST(l_quantity AS INTEGER) % 6 AS a, l_linenumber % 6 AS b, CAST(round(l_discount * 50) AS INTEGER) AS c, CAST(round(l_tax * 60) AS INTEGER) AS d FROM lineitem),
        f AS (SELECT *, least(5, CAST(round_even((a * 4 + b * 2 + c * 2 + d * 2) / 10.0::DOUBLE, 0) AS INTEGER)) AS final FROM s)
        SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, final,
               CASE WHEN final >= 4 THEN '선별' WHEN final = 3 THEN '예비' ELSE '제외' END AS state FROM f""",
}
