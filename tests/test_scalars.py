"""Cell functions on edge values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.functions import text as T


def column(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    (S.normal_name, ["  Kim (A) b ", "김철수AB(x)(y)", "(a)", "Lee (open", None, "A1b"], ["", "김철수", "", "Lee (open", None, "A1"]),
    (S.digits, ["010-12 34", "abc", "", None], ["0101234", "", "", None]),
    (S.won, ["100,000", "-5", "1.2.3", ".", "", "2.5", "3.5원"], [100000, 5, None, None, None, 2, 4]),
    (S.birthdate, ["20010203", " 20010203 ", "2001-02-03", "99999999", ""], ["2001-02-03", "2001-02-03", None, "9999-99-99", None]),
    (S.question_key, ["[1-2] a", "[1-2]a", "[12]", "x [1-2]"], ["1-2", "1-2", None, None]),
    (S.blank_to_null, ["", " 　", "a ", None], [None, None, "a ", None]),
    (S.base_name, ["/a/b.HWPX", "b.tar.txt", "c"], ["b", "b.tar", "c"]),
    (S.name_from_file, ["/x/5기_수기_홍길동_1.hwp", "문서 - 김철수.docx", "aa_이영희-b.txt", "none.txt"], ["홍길동", "김철수", "이영희", ""]),
    (S.clean_text, ["a\x00b \n\n\n\nc\t\n", ""], ["ab\n\nc", ""]),
    (S.day_text, ["2024-01-02 03:04", "", None], ["2024-01-02", "-", "-"]),
]


@pytest.mark.parametrize("make,values,want", CASES, ids=[c[0].__name__ for c in CASES])
def test_text(spark, make, values, want):
    got = column(spark, make, values)
    if make is S.normal_name:
        want = [loop(v) if v is not None else None for v in values]
    assert got == want


def loop(name):
    """The same by removing one thing after the other until nothing changes."""
    name = name.strip()
    while True:
        new = re.sub(r"\([^)]*\)$", "", name).strip()
        new = re.sub(r"[A-Za-z]+$", "", new).strip()
        if new == name:
            return name
        name = new


def test_names_against_the_loop(spark):
    import random

    rng = random.Random(5)
    values = ["".join(rng.choice("김a(B) )철1") for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert column(spark, S.normal_name, values) == [loop(v) for v in values]


def test_score_field(spark):
    got = column(spark, S.score_field, ["4/good", "4", "4.5/x", "/x", "memo", "", " 3 / a/b "])
    assert [tuple(r) for r in got] == [(4, "good"), (4, None), (None, "4.5/x"), (None, "/x"), (None, "memo"), (None, None), (3, "a/b")]


def test_numbers(spark):
    assert column(spark, S.five_scale, [100, 70, 50, 0, None], "int") == ["5", "4", "3", "0", "-"]
    assert column(spark, S.is_selected, [80, 79, None], "int") == [True, False, False]
    assert column(spark, S.score_tone, [80, 60, 59, None], "int") == ["selected", "middle", "low", "none"]
    assert column(spark, S.won_text, [1234000, 0, None], "long") == ["1,234,000원", "0원", "-"]
    assert column(spark, S.man_won_text, [250000, 255000, None], "long") == ["25만원", "255,000원", "-"]


def test_same_university(spark):
    df = spark.createDataFrame([("서울대학교", "서울대학교 의대"), ("서울대", "연세대학교"), ("", "x"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(S.same_university(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=20))
def test_ids_are_stable(spark, values):
    first, second = (column(spark, lambda c: S.stable_id("x", c), values) for _ in range(2))
    assert first == second and all(re.fullmatch("x_[0-9a-f]{16}", v) for v in first)
    assert len(set(first)) == len(set(values))


def test_very_long_cells(spark):
    """Runs, groups and blanks of 100,000 characters, at the end of a name and inside it, take linear time and no stack."""
    n = 100_000
    values = ["김" + "a" * n, "김" + "(b)" * n, "a" * n + "김", "(" * n + ")김", "김" + " a(x)" * n, "b" * n, "(" * n, "김" + " " * n + "철 " + "\t" * n, ")" * n]
    want = ["김", "김", "a" * n + "김", "(" * n + ")김", "김", "", "(" * n, "김" + " " * n + "철", ")" * n]
    assert column(spark, S.normal_name, values) == want
    assert column(spark, S.clean_text, ["x" + " " * n + "y" + " " * n + "\n" * n + "z\x7f"]) == ["x" + " " * n + "y\n\nz\x7f"]


def test_small_cells(spark):
    assert column(spark, S.answer_text, [" a ", " \n", None]) == ["a", "(답변 없음)", "(답변 없음)"]
    assert column(spark, S.parameter_number, ["7", " 8 ", "", "x", None]) == [7, 8, None, None, None]
    assert column(spark, S.student_type_of, ["성적향상자", "우수", None]) == ["성적향상", "성적우수", "성적우수"]
    assert column(spark, S.needs_normalising, ["김A", "김(", "김철수"]) == [True, True, False]


def test_strip_takes_what_the_property_white_space_holds(spark):
    """Every character of the basic plane at both ends, beside the regular expression that reads the property."""
    chars = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    texts = chars.select(F.explode(F.array(F.concat("c", F.lit("a b"), "c"), F.concat("c", "c"), F.concat(F.lit(" a"), "c", F.lit("　\n")))).alias("t"))
    assert texts.filter(~S.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s++|(?<!\s)\s++$", ""))).count() == 0


def test_a_line_is_trimmed_once_and_not_in_every_condition(spark):
    lines = spark.range(3).selectExpr("id AS doc", "'k' AS key", "0 AS pos", "concat('  line ', id, '　') AS line")
    made = T.stripped(lines, "doc", "key", spark.createDataFrame([("k", "line 1", 3)], "key string, line string, c long"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") + plan.count("regexp_replace(") == 1
    assert sorted(tuple(r) for r in made.collect()) == [(0, "line 0"), (2, "line 2")]
