"""Generated mail with nested quotes: every reply's parent is known, and the SQL gives the same rows."""

import random

from conftest import assert_same
from quillspark.llm import quotes
from quillspark.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"


def mail(seed, conversations=12, turns=14):
    """(rows, parents): replies quote the message before them in their thread, whole, by paragraph or by line, with all its own quotes one level deeper."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, parents = [], {}
    for c in range(conversations):
        own, bodies = {}, {}
        for t in range(turns):
            lines = [" ".join(word() for _ in range(rng.randrange(5, 11))) for _ in range(rng.randrange(1, 6))]
            if rng.random() < 0.1:
                lines *= 400  # a long message with lines that repeat
            parent = rng.randrange(t) if t and rng.random() < 0.75 else None
            parents[c, t] = parent
            own[t] = lines
            text = "\n".join(lines)
            if parent is not None:
                way = rng.random()
                body = bodies[parent].split("\n") if way < 0.4 else own[parent] if way < 0.7 else own[parent][: 1 + rng.randrange(len(own[parent]))]
                mark = rng.choice(["> ", ">", " > "])
                quote = "\n".join((mark if not x.startswith(">") else ">") + (x.upper() if rng.random() < 0.2 else x) for x in body)
                text = rng.choice([f"On Monday somebody wrote:\n{quote}\n\n{text}", f"{text}\n{quote}", f"{quote}\n{text}"])
            bodies[t] = text
            rows.append((c, t, rng.choice(["user", "assistant", None]), text))
    return rows, parents


def test_parents_and_sql(spark, duck):
    rows, parents = mail(3)
    rows += rng_rows(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert sum(got[k].parent_turn == v for k, v in parents.items()) == len(parents)
    for (c, t), r in got.items():
        assert ">" not in r.text
        if r.parent_turn is not None:
            up = got[c, r.parent_turn]
            assert (r.root_turn, r.depth) == (up.root_turn, up.depth + 1) and r.position > up.position
    for c in {k[0] for k in got}:
        assert sorted(r.position for k, r in got.items() if k[0] == c) == list(range(sum(k[0] == c for k in got)))
    duck.execute("CREATE OR REPLACE TEMP TABLE mail_rows (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO mail_rows VALUES (?, ?, ?, ?)", rows)
    assert_same(quotes.link(df), duck, ORACLES["op9_chat_formatting"].replace("FROM conversations", "FROM mail_rows"))


def rng_rows(rows):
    """Repeated rows."""
    return [rows[i] for i in (1, 5, 5, 40)]


def test_ties_go_to_the_later_turn_and_passages_before_lines(spark):
    rows = [
        (1, 0, "user", "yes\nthe plan is good"), (1, 1, "user", "other words\nsame size!!"), (1, 2, "user", "> the plan is good\n\nmiddle\n> same size!!"),
        (2, 0, "user", "yes"), (2, 1, "user", "no"), (2, 2, "user", "yes\nno"), (2, 3, "user", "> yes\n> no\nboth"),
        (3, 0, "user", "aaa bbb"), (3, 1, "user", "ccc ddd"), (3, 2, "user", "> aaa bbb\nx\n> ccc ddd"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 2].parent_turn == 0  # longer
    assert got[2, 3].parent_turn == 2  # the passage was written by one message, its lines by others before
    assert got[3, 2].parent_turn == 1  # equal votes


def test_rows_that_share_a_turn_count_their_own_quotes(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "user", "> hello there"), (1, 1, "user", "plain")]
    got = quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.turn, r.n_quoted_lines, r.parent_turn) for r in got if r.turn == 1) == [(1, 0, 0), (1, 1, 0)]


def test_very_long_messages(spark):
    line = "a line of very many words that goes on and on " * 8
    long = "\n".join(f"{line}{i}" for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "\n".join("> " + x for x in long.split("\n")[5:9_000]) + "\nshort"), (1, 2, "user", "> " * 500 + "deep")]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].parent_turn == 0 and got[1].text == "short" and got[1].n_quoted_lines == 8_995 and got[2].text == ""
