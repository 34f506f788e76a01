"""Properties of the table operators."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dedup, delta, match, scoring, sheets, validate


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def snapshot(spark):
    old = spark.createDataFrame([(1, "a", " "), (2, "b", "x"), (3, None, "y")], "id int, name string, univ string")
    new = spark.createDataFrame([(2, "", "z"), (3, "c", ""), (4, "d", "w"), (None, "n", "v")], "id int, name string, univ string")
    return old, new


def test_changes_are_idempotent(spark):
    old, new = snapshot(spark)
    keyed = new.filter("id IS NOT NULL")
    for change in (
        lambda df: delta.upsert(df, keyed, "id", ["name"]),
        lambda df: delta.insert_if_absent(df, keyed, ["id"]),
        lambda df: delta.merge(df, keyed, "id", {"name": "prefer_new", "univ": "fill"}),
        lambda df: delta.replace_children(df, keyed, keyed, "id"),
        lambda df: delta.delete_in(df, keyed, "id"),
        lambda df: delta.update_where(df, F.col("name") == "b", univ=F.lit("q")),
    ):
        assert rows(change(old)) == rows(change(change(old)).select(*old.columns))
        assert change(old.limit(0)).count() in (0, 3)


def test_merge_rules(spark):
    old, new = snapshot(spark)
    got = {r.id: r for r in delta.merge(old, new.filter("id IS NOT NULL"), "id", {"name": "overwrite", "univ": "fill"}).collect()}
    assert (got[2].name, got[2].univ) == (None, "x") and (got[3].name, got[3].univ) == ("c", "y") and got[1].univ == " "


def test_normal_form_and_columns(spark):
    old, _ = snapshot(spark)
    assert [r.name for r in delta.normalised_where_changed(old, "name", F.upper("name")).orderBy("id").collect()] == ["A", "B", None]
    copied, broken = delta.rebuild(old, ["a", "b", "c"], {"a": F.col("a").isNotNull(), "none": F.lit(False)})
    assert copied.columns == ["a", "b", "c"] and {r.rule: r.n for r in broken.collect()} == {"a": old.filter(F.col(old.columns[0]).isNull()).count(), "none": old.count()}
    assert delta.drop_column(copied, "b").columns == ["a", "c"]
    with pytest.raises(KeyError):
        delta.drop_column(copied, "z")
    assert delta.add_column(old, "fee", F.lit(0)).filter("fee = 0").count() == 3
    facts, dimension = delta.split_dimension(old, ["name"], "n")
    assert dimension.count() == 3 and facts.columns == ["id", "univ", "n_id"]


def test_ties(spark):
    df = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, "a"), ("k", 4, "b"), ("", 5, "x"), (None, 6, "y"), ("", 7, "x")], "key string, at int, v string")
    assert dedup.mode_first_seen(df.filter("key = 'k'"), ["key"], "v", "at").first().mode == "b"
    assert sorted(r.at for r in dedup.keep_first_per_key(df, "key", "at").collect()) == [1, 5, 6, 7]
    assert dedup.keep_best(df.filter("key = 'k'"), ["key"], F.desc("v"), F.asc("at")).first().at == 1
    assert dedup.best_by(df.filter("key = 'k'"), ["key"], F.col("v"), -F.col("at")).first().at == 1


def test_matches_partition_the_rows(spark):
    people = spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (3, "b", "3"), (4, "b", "3"), (5, "c", None)], "person_id int, name string, phone string")
    given = spark.createDataFrame([(10, "a", "1"), (11, "a", ""), (12, "b", "3"), (13, "c", "9"), (14, "d", "1"), (15, None, None)], "row_id int, name string, phone string")
    got = {r.row_id: (r.person_id, r.how) for r in match.by_name_and_phone(given, people).collect()}
    assert got == {10: (1, "phone"), 11: (None, "ambiguous"), 12: (4, "phone"), 13: (5, "name"), 14: (None, "new"), 15: (None, "new")}
    narrow = {r.row_id: (r.person_id, r.how) for r in match.narrowed(given.select("row_id", "name", F.col("phone").alias("p")), people, F.col("p") == F.col("phone"), ["p"], ["phone"]).collect()}
    assert narrow[10] == (1, "narrowed") and narrow[11][1] == "ambiguous" and narrow[13] == (5, "matched") and narrow[14][1] == "unmatched"


def test_fees(spark):
    people = spark.createDataFrame([(1, 5, "a", "1"), (2, 5, "a", "2"), (3, 5, "b", "3"), (4, 6, "c", "7"), (5, 6, "c", "8")], "person_id int, cohort int, name string, phone string")
    best = spark.createDataFrame([(5, "a", "2", 10), (5, "b", "", 20), (6, "c", "9", 30)], "cohort int, name string, phone string, amount long")
    assert {r.person_id: r.amount for r in match.fees(best, people).collect()} == {2: 10, 3: 20, 4: 30, 5: 30}


def test_constraints(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (1, "x")], "id int, v string")
    assert [r.v for r in validate.orphans(children, parents, "id", "id").collect()] == ["y"]
    assert [tuple(r) for r in validate.duplicates(children, ["id", "v"]).collect()] == [(1, "x", 2)]
    assert {r.rule: r.n for r in validate.violations(children, {"low": F.col("id") < 3, "text": F.col("v").isNotNull()}).collect()} == {"low": 1, "text": 0}
    assert validate.violations(children.limit(0), {"low": F.col("id") < 3}).first().n == 0


def test_headers():
    head = [["", "메모"], ["이름", "반수반?", "반"]]
    assert sheets.header_row(head, ["이름"]) == 1
    assert sheets.find_column(head[1], ["반"]) == 1 and sheets.find_column(head[1], ["반"], exact=True) == 2
    assert sheets.find_column(head[1], ["관"], optional=True) is None


def test_guides_are_not_markers(spark):
    lines = ["intro", "[3-1]과 같이", "[3-1] why", "※ guide", "body", "[4] x"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "doc int, pos int, line string")
    got = sorted((r.key, r.body) for r in T.segments(df, "doc", T.markers(F.col("line"), lettered=False)).collect())
    assert got == [("3-1", "※ guide\nbody"), ("4", "")]


def test_white_space_around_lines(spark):
    lines = ["\tA1. q one", "\u3000body\u00a0", "\u3000A2. q two", "\tx* hint", "B3. three", "\t* guide", "\u00a0※ guide"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "doc int, pos int, line string")
    got = sorted((r.key, r.header, r.body) for r in T.segments(df, "doc", T.markers(F.col("line"), lettered=True)).collect())
    assert got == [("A1", "A1. q one", "body"), ("A2", "A2. q two", "x* hint"), ("B3", "B3. three", "* guide\n\u00a0※ guide")]
    known = spark.createDataFrame([(1, i, v) for i, v in enumerate(["\u3000이름", "\u3000", "\t* remark", "\u00a0Kim\t"])], "doc int, pos int, line string")
    assert [(r.field, r.value) for r in T.identity(known, "doc").collect()] == [("name", "Kim")]
    none = df.select("doc", "line").limit(0)
    assert [r.body for r in T.stripped(df.withColumn("k", F.lit("k")), "doc", "k", none.select(F.lit("k").alias("k"), "line")).collect()] == ["A1. q one\nbody\nA2. q two\nx* hint\nB3. three"]


def test_a_stopped_batch_goes_on(spark):
    df = spark.createDataFrame([(i, f"m{i}") for i in range(20)], "row long, message string")

    def scorer(message):
        if message == "m7":
            raise ValueError("busy")
        return '{"가독성": 1}'

    done = scoring.score(df, scorer, attempts=2, pause=0.0)
    got = {r.row: r for r in done.collect()}
    assert got[7].error == "ValueError: busy" and got[7].reply is None and got[8].error is None
    assert [r.row for r in scoring.remaining(df, done).collect()] == [7]


def test_replies(spark):
    replies = ['{"정성_구체성": 5, "실용성_타겟적합성": 5, "독창성": 5, "가독성": 5, "AI_사용도": 1}', '{"정성_구체성": null}', "no", '```json\n{"최종_점수": "4.5", "선별_상태": "?", "신뢰성_리스크": "높음"}\n```', '{"정성_구체성": -1, "독창성": 99}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = [(r.valid, r[scoring.FINAL], r["선별_상태"], r["신뢰성_리스크"]) for r in scoring.parsed(df).orderBy("i").collect()]
    assert got[0] == (True, 5, "선별", "없음") and not got[1][0] and not got[2][0]
    assert got[3] == (True, 4, "선별", "높음") and got[4] == (True, 1, "제외", "없음")


def test_fees_applied_keeps_old_fees_and_ignores_unknown_people(spark):
    people = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, "c"), (3, 8, "d")], "person_id long, fee long, note string")
    found = spark.createDataFrame([(1, 10), (1, 30), (2, None), (3, 9), (4, 1), (None, 2)], "person_id long, amount long")
    got = sorted(map(tuple, match.fees_applied(people, found).collect()))
    assert got == [(1, 30, "a"), (2, None, "b"), (3, 9, "c"), (3, 9, "d")]
    assert sorted(map(tuple, match.fees_applied(people, found.limit(0)).collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
