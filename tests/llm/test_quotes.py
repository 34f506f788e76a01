from conftest import DATA, assert_same
from quillspark.llm import quotes
from quillspark.llm.queries import ORACLES, op9_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_against_sql(spark, duck):
    assert_same(op9_chat_formatting(spark, DATA), duck, ORACLES["op9_chat_formatting"])


def test_nested_quotes_against_sql(spark, duck):
    rows = [
        (1, 0, "user", "first line of it\nsecond line"),
        (1, 1, "assistant", "On Monday A wrote:\n> First   line of it\n\nmy answer is here"),
        (1, 2, "user", "> my answer is here\n>> first line of it\nand so on"),
        (1, 3, "assistant", "> nobody wrote this\nfree text"),
        (1, 4, None, ">> second line\n> and so on\nlast"),
        (2, 0, "user", "first line of it"),
        (2, 1, "user", "> first line of it"),
        (3, 0, "user", None),
        (3, 1, None, ""),
        (3, 2, "user", ">\n> \n>>>"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    duck.execute("CREATE OR REPLACE TEMP TABLE quoted_rows (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO quoted_rows VALUES (?, ?, ?, ?)", rows)
    assert_same(quotes.link(df), duck, ORACLES["op9_chat_formatting"].replace("FROM conversations", "FROM quoted_rows"))
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, None, 2]
    assert got[1, 4].root_turn == 0 and got[1, 4].depth == 3
    assert got[1, 1].text == "my answer is here"


def test_null_keys_repeated_rows_and_empty(spark):
    rows = [(None, 0, "user", "> a"), (1, None, "user", "> a"), (1, 1, "user", "a"), (1, 2, "user", "> a"), (1, 2, "user", "> a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", level string")
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    assert [r.parent_turn for r in got if r.turn == 2] == [1, 1]
    assert quotes.link(df.limit(0)).count() == 0


def test_no_user_function_runs(spark):
    plan = op9_chat_formatting(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
