from quillspark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
LONG = "The long line of the first message goes on and on without an end, until a mail client wraps it at some column that nobody chose."


def parents(spark, rows):
    got = {r.turn: r for r in quotes.link(spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(rows)], SCHEMA)).collect()}
    assert len(got) == len(rows)
    return [(got[t].parent_turn, got[t].root_turn, got[t].depth) for t in range(len(rows))]


def test_lines_wrapped_anew(spark):
    words = LONG.split()
    wrapped = "\n".join("> " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    joined = "two lines of this\nmessage stand alone\nbut are joined later"
    rows = [LONG, f"On Monday A wrote:\n{wrapped}\n\nyes", joined, f"> {joined.replace(chr(10), ' ')}\nand yes", "hello there\nfriend", "> hello\n> there friend\nhi"]
    assert parents(spark, rows) == [(None, 0, 0), (0, 0, 1), (None, 2, 0), (2, 2, 1), (None, 4, 0), (4, 4, 1)]


def test_parts_of_a_line(spark):
    rows = [LONG, "another message with other words in it", "> until a mail client wraps it\nso it does", "> another message with other\nwell", "> words that nobody here has ever said\nno"]
    assert parents(spark, rows) == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (1, 1, 1), (None, 4, 0)]


def test_near_level_decides_for_wrapped_lines_too(spark):
    rows = [LONG, "a whole line of the second one", "> until a mail client\n> wraps it at some\n>> a whole line of the second one\nlast"]
    assert parents(spark, rows)[2] == (0, 0, 1)


def test_short_lines_wrapped_anew(spark):
    assert parents(spark, ["hello there friend", "> hello\n> there friend\nhi"])[1] == (0, 0, 1)
