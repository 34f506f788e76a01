"""Documents as ordered lines: HTML to text, segmentation, identity fields, boilerplate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scalars import strip

#: Identity labels and their fields; hints that mark a guide line.
IDENTITY_LABELS = {
    "이름": "name", "나이(생년)": "birth", "나이": "birth", "소속 관&반": "hall_class", "소속 관 반": "hall_class", "소속관반": "hall_class",
    "N수 경력": "nsu", "n수 경력": "nsu", "시대N 재원기수": "cohort_label", "시대N 재원 기수": "cohort_label", "학원 등원 방식": "commute",
    "수시 지원 여부": "susi", "최종 진학 대학": "final_univ", "최종대학": "final_univ", "최종 합격 대학": "final_univ",
}
GUIDE_HINTS = ("작성용 키워드", "아래 키워드", "키워드를 참고", "선택하여 답변", "해당 셀을 삭제", "해당하는 것만", "구글폼에", "복사", "내용)")


#: Character references and what they stand for, in the order of replacing.
ENTITIES = {"&#13;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&nbsp;": " "}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def consecutive_distinct(lines: Column) -> Column:
    """Non-empty lines that differ from the raw line before."""
    return bound(lines, lambda all_: F.filter(all_, lambda x, i: (x != "") & ((i == 0) | (x != F.coalesce(F.get(all_, i - 1), F.lit(""))))))


def html_to_text(html: Column) -> Column:
    """Visible text of simple HTML: styles as a blank, what follows the first body tag, block and cell ends as line feeds, tags removed, references decoded."""
    t = F.regexp_replace(html, r"(?is)<style.*?</style>", " ")
    # Cut once at the first body tag, so that nothing is scanned twice.
    t = F.element_at(F.split(t, r"(?i)<body[^>]*>", 2), -1)
    t = F.regexp_replace(t, r"(?i)</?(p|div|tr|td|th|br|li|h[1-6]|table)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(t, r"&[a-zA-Z]+;", " ")


def text_lines(text: Column) -> Column:
    """Lines with inner blanks collapsed and ends trimmed."""
    return F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))


def exploded_lines(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """doc, pos, line: one row per line of every document."""
    return docs.select(doc, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))


def markers(line: Column, lettered: bool) -> dict[str, Column]:
    """question key, question header and section of a marker line; null elsewhere.

    Lettered manuscripts mark `A1. …` and sections `A. …질문…`; the others `[n] …` or
    `[n-m] …`, where a blank must follow, so that guides like `[3-1]과` are body.
    """
    s = strip(line)
    none = F.lit(None).cast("string")
    if lettered:
        key = F.nullif(F.regexp_extract(s, r"^([ABC][0-9]+)\.", 1), F.lit(""))
        section = F.when(key.isNull(), F.nullif(F.regexp_extract(s, r"^([ABC])\.\s*.+질문", 1), F.lit("")))
    else:
        key = F.nullif(F.regexp_extract(s, r"^\[([0-9]+(?:-[0-9]+)?)\]\s+\S", 1), F.lit(""))
        section = none
    return {"key": key, "header": F.when(key.isNotNull(), s), "section": section}


def segments(lines: DataFrame, doc: str, marks: dict[str, Column]) -> DataFrame:
    """doc, segment, key, header, section, body: lines gathered under the question marker above them.

    `lines` has doc, pos and line. A section marker ends the segment and names the
    section of later questions. Lines before the first question (identity) and
    between a section marker and the next question belong to no segment. One
    document's lines meet in one window; documents do not.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(doc, "pos", "line", *[c.alias(f"_{k}") for k, c in marks.items()])
    edge = F.col("_key").isNotNull() | F.col("_section").isNotNull()
    run = (
        marked.withColumn("segment", F.sum(edge.cast("int")).over(upto))
        .withColumn("_named", F.last("_section", ignorenulls=True).over(upto))
        .withColumn("_at", edge)
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_at"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return (
        run.groupBy(doc, "segment")
        .agg(F.max("_key").alias("key"), F.max("_header").alias("header"), F.max(F.when(F.col("_key").isNotNull(), F.col("_named"))).alias("section"), strip(body).alias("body"))
        .filter("key IS NOT NULL")
    )


def identity(lines: DataFrame, doc: str, labels: dict[str, str] = IDENTITY_LABELS) -> DataFrame:
    """doc, field, value: the first fitting line among the three after a known label; the first label of a field that finds one counts.

    Empty lines, lines that start with `*` and other labels do not fit.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    field = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), strip(F.col("line")))
    fits = lambda c: F.when((c != "") & ~c.startswith("*") & ~c.isin(*labels), c)
    nearest = F.coalesce(*[fits(strip(F.lead("line", k).over(order))) for k in (1, 2, 3)])
    return (
        lines.select(doc, "pos", field.alias("field"), nearest.alias("value"))
        .filter("field IS NOT NULL AND value IS NOT NULL")
        .groupBy(doc, "field")
        .agg(F.min_by("value", "pos").alias("value"))
    )


def boilerplate(units: DataFrame, key: str, unit: str, line: str, min_count: int = 3, min_ratio: float = 0.25) -> DataFrame:
    """key, line of lines that stand in at least max(min_count, int(n * min_ratio)) of the key's n units.

    `units` has one row per line of a unit (a segment). Counting is two
    aggregations with partial sums; a line that every unit holds costs no more.
    """
    s = units.select(key, unit, strip(F.col(line)).alias("line"))
    number = s.groupBy(key).agg(F.countDistinct(unit).alias("n"))
    held = s.filter("line <> ''").distinct().groupBy(key, "line").agg(F.count("*").alias("c"))
    return held.join(number, key).filter(F.col("c") >= F.greatest(F.lit(min_count).cast("long"), F.floor(F.col("n") * min_ratio))).select(key, "line", "c")


def is_guide(line: Column, hints: tuple[str, ...] = GUIDE_HINTS) -> Column:
    """Blank, starts with ※ or *, or holds a hint."""
    test = (line == "") | line.startswith("※") | line.startswith("*")
    for h in hints:
        test = test | F.contains(line, F.lit(h))
    return test


def stripped(lines: DataFrame, doc: str, key: str, common: DataFrame, hints: tuple[str, ...] = GUIDE_HINTS) -> DataFrame:
    """doc, body: trimmed lines of each document without boilerplate and guide lines, joined by line feeds."""
    # Of an array of one, so that a line is trimmed once and not in every condition.
    fits = F.filter(F.array(strip(F.col("line"))), lambda x: ~is_guide(x, hints))
    s = lines.select(doc, key, "pos", F.explode(fits).alias("line"))
    kept = s.join(common.select(key, "line"), [key, "line"], "left_anti")
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
