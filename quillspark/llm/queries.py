"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import audio, htmltext, jaccard, langid, lexical, licences, mixing, packing, pii, quality, quotes, rules, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(_documents(spark, sf_dir), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of held-out rows are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(_documents(spark, sf_dir), labels)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy class, near-duplicate class and number of links of every document."""
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; languages of held-out rows are not learned from."""
    return langid.classify(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: pattern counts, their digest, and all spans."""
    found = pii.find_pii(_documents(spark, sf_dir))
    count = lambda kind: F.regexp_count("base_spans", F.lit(rf"\b{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    out = rules.apply_rules(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("document.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, with what they reply to and the root of their thread."""
    return quotes.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit audio: digests and features of what is read back, the clip, its active spans and its tensors."""
    return audio.sonify(_documents(spark, sf_dir))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence templates of every document."""
    found = licences.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding, with the exact deviation and the error of the whitening."""
    rows, model, error = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_media_columns": op10_media_columns,
    "op11_license_scans": op11_license_scans,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in rules.STOP_WORDS.values() for w in ws}))


def _rule_sql(rule: rules.Rule) -> str:
    down = rule.denominator or "1"
    parts = []
    if rule.least:
        parts.append(f"{rule.numerator} * {rule.least[1]} >= {down} * {rule.least[0]}")
    if rule.most:
        parts.append(f"{rule.numerator} * {rule.most[1]} <= {down} * {rule.most[0]}")
    return f"({down} = 0 OR ({' AND '.join(parts)}))"


RULES_SQL = rf"""
    WITH texts AS (SELECT *, COALESCE(text, '') AS t FROM documents),
    worded AS (
        SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
               list_filter(string_split(t, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
        FROM texts),
    windows AS (
        SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded WHERE len(ws) >= 3)),
    twice AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY doc_id),
    counted AS (
        SELECT worded.*, len(ws) AS n_words,
               length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
               len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals,
               len(list_intersect(list_distinct(ws), [{_STOPS}])) AS n_stop_words,
               len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
               COALESCE(n, 0) AS n_repeat_words
        FROM worded LEFT JOIN covered USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)"""

QUOTES_SQL = r"""
    WITH RECURSIVE own AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, COALESCE(text, '') AS text FROM conversations),
    split AS (
        SELECT rid, conv_id, turn, pos, ls[pos] AS line, regexp_extract(ls[pos], '^([ \t]*>)+[ \t]?') AS marks
        FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT *, string_split(text, chr(10)) AS ls FROM own))),
    parsed AS (
        SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS content,
               lower(trim(regexp_replace(substr(line, length(marks) + 1), '[\s\xA0]+', ' ', 'g'))) AS normal
        FROM split),
    marked AS (
        SELECT *, CASE WHEN LAG(level) OVER (PARTITION BY rid ORDER BY pos) IS DISTINCT FROM level THEN 1 ELSE 0 END AS starts FROM parsed WHERE normal <> ''),
    lines AS (SELECT *, SUM(starts) OVER (PARTITION BY rid ORDER BY pos) AS run FROM marked),
    passages AS (SELECT rid, conv_id, turn, level, run, string_agg(normal, ' ' ORDER BY pos) AS passage FROM lines GROUP BY rid, conv_id, turn, level, run),
    passage_writers AS (SELECT conv_id, passage, MIN(turn) AS writer FROM passages WHERE level = 0 GROUP BY ALL),
    quoted AS (
        SELECT q.*, CASE WHEN writer < q.turn THEN writer END AS writer
        FROM passages q LEFT JOIN passage_writers USING (conv_id, passage) WHERE level > 0),
    line_writers AS (SELECT conv_id, normal, MIN(turn) AS writer FROM lines WHERE level = 0 GROUP BY ALL),
    found AS (
        SELECT conv_id, turn, level, writer, length(passage) AS size FROM quoted WHERE writer IS NOT NULL
        UNION ALL
        SELECT l.conv_id, l.turn, l.level, w.writer, length(l.normal)
        FROM lines l JOIN quoted q USING (rid, run) JOIN line_writers w ON w.conv_id = l.conv_id AND w.normal = l.normal
        WHERE q.writer IS NULL AND w.writer < l.turn),
    votes AS (SELECT conv_id, turn, level, writer, SUM(size) AS votes FROM found GROUP BY ALL),
    parents AS (
        SELECT conv_id, turn, writer AS parent
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, writer DESC) AS n FROM votes) WHERE n = 1),
    up AS (
        SELECT conv_id, turn, parent AS root, 1 AS depth FROM parents
        UNION ALL SELECT up.conv_id, up.turn, p.parent, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.root),
    roots AS (SELECT conv_id, turn, MIN(root) AS root, MAX(depth) AS depth FROM up GROUP BY ALL),
    counted AS (SELECT rid, COUNT(*) AS n FROM lines WHERE level > 0 GROUP BY ALL),
    placed AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY COALESCE(root, turn), turn) - 1 AS position
        FROM (SELECT DISTINCT conv_id, turn FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL) LEFT JOIN roots USING (conv_id, turn)),
    bare AS (
        SELECT rid, COALESCE(trim(string_agg(content, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (regexp_matches(line,
               '^[ \t]*(On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*\ba écrit|El\b.*\bescribió)[ \t]*:[ \t]*$') AND next > 0)), E' \t\r\n'), '') AS text
        FROM (SELECT *, COALESCE(LEAD(level) OVER (PARTITION BY rid ORDER BY pos), 0) AS next FROM parsed)
        GROUP BY rid HAVING MAX(level) > 0)
    SELECT o.conv_id, o.turn, o.role, COALESCE(b.text, o.text) AS text, p.parent AS parent_turn, COALESCE(r.root, o.turn) AS root_turn,
           COALESCE(r.depth, 0) AS depth, position, COALESCE(c.n, 0) AS n_quoted_lines,
           '<|' || COALESCE(o.role, 'user') || '|>' || chr(10) || COALESCE(b.text, o.text) AS formatted
    FROM own o LEFT JOIN bare b USING (rid) LEFT JOIN parents p USING (conv_id, turn) LEFT JOIN placed USING (conv_id, turn)
    LEFT JOIN roots r USING (conv_id, turn) LEFT JOIN counted c USING (rid)"""

#: The letters that are lower-cased, and the runs that are terms.
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH_SQL = f"""
    WITH words AS (SELECT rid, doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
    asked AS (
        SELECT item, item_id, term, COUNT(*) AS times
        FROM (SELECT item, item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)) GROUP BY ALL),
    lengths AS (SELECT rid, doc_id, COUNT(*) AS n FROM words GROUP BY ALL),
    totals AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS l FROM lengths),
    found AS (SELECT rid, term, COUNT(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM found, totals GROUP BY term, docs),
    impacts AS (
        SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l))) AS impact
        FROM found JOIN lengths USING (rid) JOIN weights USING (term), totals),
    scored AS (SELECT item, item_id, rid, doc_id, CAST(SUM(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING SUM(times * impact) > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored) WHERE rank <= 10"""

ORACLES = {
    "op13_ranked_lexical_search": SEARCH_SQL,
    "op9_chat_formatting": QUOTES_SQL,
    "op7_quality_rules": f"""{RULES_SQL}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(_rule_sql(r) for r in rules.RULES)} AS kept
    FROM judged""",
}
