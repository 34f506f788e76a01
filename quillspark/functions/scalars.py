"""Column functions for names, numbers, labels and codes found in submission sheets.

All are built-in expressions, so they stay inside code generation. Regular
expressions use (?U) where the source text may hold Unicode blanks or digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: labels, amounts and states ---------------------------------

SUBMISSION_LABELS = {"received": "접수", "reviewing": "검토중", "selected": "선별됨", "rejected": "제외", "archived": "보관"}
ARTICLE_LABELS = {"draft": "초안", "editing": "편집중", "review": "검토", "final": "최종", "published": "발행", "archived": "보관"}
SUSPICION_LABELS = {"low": "낮음", "medium": "중간", "high": "높음"}
TONES = {
    "received": "gray", "reviewing": "amber", "selected": "green", "rejected": "red", "archived": "gray", "draft": "gray", "editing": "amber",
    "review": "amber", "final": "green", "published": "accent", "low": "green", "medium": "amber", "high": "red",
}
SECTION_CATEGORIES = {"A": "시기별", "B": "주제별", "C": "선택"}
LEVEL_AMOUNTS = {5: 400000, 4: 320000, 3: 280000, 2: 240000, 1: 200000}
GRADE_AMOUNTS = {"S": 400000, "A++": 350000, "A+": 350000, "A": 300000, "B": 200000, "C": 150000, "F": 100000, "F-": 100000}
SCORE_AMOUNTS = {100: 250000, 80: 190000, 60: 150000, 40: 120000, 20: 100000, 0: 0}
SELECT_THRESHOLD = 80
NO_ANSWER = "(답변 없음)"


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """values[key], else `default` (null without one)."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def blank_to_null(c: Column) -> Column:
    """Null where the text is empty after trimming."""
    return F.when(strip(c) != "", c)


#: Characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normal_name(c: Column, zero_width: bool = False, inner_spaces: bool = False) -> Column:
    """A person's name without what forms append: trailing (…) groups and Latin letters, in any order and number.

    `zero_width` also removes invisible characters, `inner_spaces` all blanks. The name is
    read backwards from its end, whole runs and groups at a time and none of them
    twice, so names of any length take linear time and no stack.
    """
    if zero_width:
        c = F.regexp_replace(c, "[​-‍­⁠﻿]", "")
    c = strip(F.reverse(F.regexp_replace(F.reverse(c), r"(?U)^(?:\)[^)]*\(|[A-Za-z\s]++)++", "")))
    return F.regexp_replace(c, r"(?U)\s+", "") if inner_spaces else c


def digits(c: Column) -> Column:
    """Only the digits."""
    return F.regexp_replace(c, r"(?U)\D", "")


def won(c: Column) -> Column:
    """Amount in whole won: digits and dots only (a sign is lost), half to even; null if that is no number."""
    return F.bround(F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")).try_cast("bigint")


def header(c: Column) -> Column:
    """A header cell on one line."""
    return F.trim(F.regexp_replace(c, r"[\r\n]", " "))


def cohort_number(c: Column, default: Column) -> Column:
    """The number before 기, else `default`."""
    return F.coalesce(F.regexp_extract(c, r"([0-9]+)\s*기", 1).try_cast("int"), default)


def birthdate(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; null for anything else. Digits only, not the calendar, are checked."""
    return F.when(F.trim(c).rlike(r"^[0-9]{8}$"), F.regexp_replace(F.trim(c), r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"))


def score_field(c: Column) -> Column:
    """`4/comment` as struct<score int, comment string>: cut at the first slash; without a whole number in front, all is comment."""
    t = F.trim(c)
    head = F.trim(F.substring_index(t, "/", 1))
    whole = head.rlike(r"^[+-]?[0-9]+$")
    rest = F.when(F.contains(t, F.lit("/")), F.trim(F.regexp_replace(t, r"^[^/]*/", "")))
    return F.struct(
        F.when(whole, head.try_cast("int")).alias("score"),
        F.when(whole, F.nullif(F.coalesce(rest, F.lit("")), F.lit(""))).otherwise(F.nullif(t, F.lit(""))).alias("comment"),
    )


def question_key(c: Column) -> Column:
    """`n-m` of a header that starts with [n-m], else null."""
    return F.nullif(F.regexp_extract(c, r"^\[([0-9]+-[0-9]+)\]", 1), F.lit(""))


def natural_parts(key: Column) -> tuple[Column, Column, Column]:
    """letters, n, m of a question key such as A12 or 3-1; m is 0 without one."""
    number = lambda pattern: F.regexp_extract(key, pattern, 1).try_cast("int")
    return F.regexp_extract(key, "^([A-Za-z]*)", 1).alias("letters"), number("^[A-Za-z]*([0-9]+)").alias("n"), F.coalesce(number("^[A-Za-z]*[0-9]+-([0-9]+)"), F.lit(0)).alias("m")


def section_of(key: Column) -> Column:
    """section_<n> of a question key."""
    return F.concat(F.lit("section_"), F.substring_index(key, "-", 1))


def base_name(path: Column) -> Column:
    """File name without folders and document extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(hwpx?|docx?|pdf|txt)$", "")


def name_from_file(path: Column, use_tail: bool = True) -> Column:
    """Person in a file name: after the 수기 marker, else (`use_tail`) the part after the last ` - `, else the first part of 2-4 Hangul; else ''."""
    base = base_name(path)
    marked = F.nullif(F.regexp_extract(base, r"수기[_\- ]*([가-힣]{2,4})[_\- ]", 1), F.lit(""))
    tail = F.trim(F.substring_index(base, " - ", -1))
    tailed = F.when(F.contains(base, F.lit(" - ")) & tail.rlike(r"^[가-힣]{2,4}$"), tail)
    parts = F.filter(F.transform(F.split(base, r"[_\-]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^[가-힣]{2,4}$"))
    return F.coalesce(marked, tailed if use_tail else F.lit(None).cast("string"), F.get(parts, F.lit(0)), F.lit(""))


def file_date_key(path: Column, modified: Column, long_first: bool = True) -> Column:
    """Sortable key of a resubmitted file: date digits, 1 for 수정, modification seconds."""
    base = F.substring_index(path, "/", -1)
    run = F.regexp_extract(base, r"([0-9]{8}|[0-9]{6})" if long_first else r"([0-9]{6}|[0-9]{8})", 1)
    return F.concat_ws("_", F.coalesce(F.nullif(run, F.lit("")), F.lit("000000")), F.when(F.contains(base, F.lit("수정")), "1").otherwise("0"), modified.cast("string"))


def clean_text(c: Column) -> Column:
    """Without control characters but tab and line feed, no blanks at line ends, at most one empty line in a row."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")
    c = F.regexp_replace(c, r"(?<![ \t])[ \t]++(?=\n)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def answer_text(c: Column) -> Column:
    """The trimmed answer, or the placeholder of an empty one."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(NO_ANSWER))


def student_type_of(tag: Column) -> Column:
    """Type of a person by a tag: improved where the tag says so, else excellent."""
    return F.when(F.contains(F.coalesce(tag, F.lit("")), F.lit("향상")), "성적향상").otherwise("성적우수")


def parameter_number(c: Column) -> Column:
    """A whole number of a URL parameter; null for blanks and other texts."""
    return F.trim(c).try_cast("int")


def needs_normalising(name: Column) -> Column:
    """Candidates for a normal form: names with a Latin letter or an opening parenthesis."""
    return name.rlike("[A-Za-z]") | F.contains(name, F.lit("("))


def joined(sep: str, *parts: Column) -> Column:
    """Non-empty parts with `sep` between; null if there are none."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(F.trim(p), F.lit("")) for p in parts]), F.lit(""))


def labelled(sep: str, parts: dict[str, Column]) -> Column:
    """`label: value` of every non-empty part; null if there are none."""
    return F.nullif(F.concat_ws(sep, *[F.concat(F.lit(f"{k}: "), F.nullif(F.trim(v), F.lit(""))) for k, v in parts.items()]), F.lit(""))


def hall_and_class(c: Column) -> Column:
    """struct<hall, class> cut at the first white space."""
    parts = F.split(F.trim(c), r"\s+", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("hall"), F.get(parts, F.lit(1)).alias("class"))


def same_university(a: Column, b: Column) -> Column:
    """Four leading characters of either stand in the other; false if one is empty."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return both & (F.contains(b, F.substring(a, 1, 4)) | F.contains(a, F.substring(b, 1, 4)))


def five_scale(total: Column) -> Column:
    """0-100 on the 0-5 scale as text, half up; '-' for null."""
    return F.coalesce(F.floor(total / 20 + 0.5).cast("string"), F.lit("-"))


def is_selected(total: Column) -> Column:
    return F.coalesce(total >= SELECT_THRESHOLD, F.lit(False))


def score_tone(total: Column) -> Column:
    """Tone of a score badge."""
    return F.when(total.isNull(), "none").when(total >= SELECT_THRESHOLD, "selected").when(total >= 60, "middle").otherwise("low")


def won_text(c: Column) -> Column:
    """1,234,000원; '-' for null."""
    return F.coalesce(F.concat(F.format_number(c, 0), F.lit("원")), F.lit("-"))


def man_won_text(c: Column) -> Column:
    """Multiples of 10,000 as 만원, other amounts in full; '-' for null."""
    return F.when(c.isNull(), "-").when(c % 10000 == 0, F.concat(F.format_number(c / 10000, 0), F.lit("만원"))).otherwise(won_text(c))


def cohort_text(c: Column) -> Column:
    return F.coalesce(F.concat(c.cast("string"), F.lit("기")), F.lit("-"))


def day_text(c: Column) -> Column:
    """First ten characters of a timestamp text; '-' for null or empty."""
    return F.coalesce(F.nullif(F.substring(c, 1, 10), F.lit("")), F.lit("-"))


def stable_id(prefix: str, *keys: Column) -> Column:
    """prefix_ and 16 hex digits of the natural key's hash: the same rows get the same ids on every run."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0002")) for k in keys]), 256), 1, 16))
