"""Chat formatting by quotation linking, with DataFrame functions only.

Quote marks at the start of a line give its nesting level; consecutive lines of one
level are a passage (empty lines part none). A passage's lines are normalised, joined and
hashed; an equal hash of an unquoted passage in the same conversation names the
message that wrote it first. A passage without such a hash quotes less or more than one
passage: its lines are hashed one by one in the same way. Lines that still have no writer
may be wrapped anew or be part of a line only: for them the passage is hashed in windows
of `WINDOW` words, whole if it is shorter, and so are the unquoted passages of the
conversation. Passages, lines and windows of a message's lowest level vote, by
their characters, for the message that it replies to. Replies lead to the root of
their thread by following links in doubling steps. A conversation in reply order
is its messages by `position`: threads by their first turn, and in a thread every reply after
what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import running, scratch, staged

MARKS = r"^([ \t]*>)+[ \t]?"
#: Lines that introduce a quote.
ATTRIBUTION = r"^[ \t]*(On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*\ba écrit|El\b.*\bescribió)[ \t]*:[ \t]*$"


#: Words of a window. A part of a line with fewer words names no message.
WINDOW = 4


def _parsed(text: Column) -> Column:
    """Lines as structs of level and content."""
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")
    )
    return F.transform(F.split(text, "\n"), line)


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\xA0]+", " ")))


def _pieces(messages: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, level, passage, size, lines: the windows of every passage, with the hashes of the lines that a window touches.

    A passage of fewer words is one window. The sizes of the windows of a passage
    add up to its own.
    """
    normal = F.transform(_parsed(F.col("text")), lambda x: F.struct(x.level.alias("level"), _normal(x.content).alias("normal")))
    lines = F.transform(normal, lambda x: F.struct(x.level.alias("level"), F.filter(F.split(x.normal, " "), lambda w: w != "").alias("words"), F.xxhash64(F.col("conv_id"), x.normal).alias("line")))
    # Words as structs of level, word and the hash of their line; an empty line has no words and parts no passage.
    words = F.flatten(F.transform(lines, lambda x: F.transform(x.words, lambda w: F.struct(x.level.alias("level"), w.alias("word"), x.line.alias("line")))))
    # Runs of one level: a word starts a run where the level before it is another.
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get(F.col("words"), i - 1)["level"] != F.get(F.col("words"), i)["level"]))
    run = lambda begin, end: F.slice(F.col("words"), begin + 1, end - begin)
    runs = (
        # Exploded from an array of one, so that the words are made once and not again for each use.
        messages.select("conv_id", "turn", F.explode(F.array(words)).alias("words"))
        .filter(F.size("words") > 0)
        .withColumn("starts", F.concat(starts, F.array(F.size("words"))))
        .select("conv_id", "turn", F.explode(F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: run(F.get(F.col("starts"), i - 1), F.get(F.col("starts"), i)))).alias("run"))
        .withColumn("level", F.col("run")[0]["level"])
        .filter("level > 0" if quoted else "level = 0")
    )
    last = F.greatest(F.size("run") - WINDOW, F.lit(0))
    slices = F.transform(F.sequence(F.lit(0), last), lambda i: F.filter(F.array(*[F.get(F.col("run"), i + k) for k in range(WINDOW)]), lambda x: x.isNotNull()))
    taken = lambda p: F.array_join(F.transform(p, lambda x: x.word), " ")
    piece = lambda p, i: F.struct(
        F.xxhash64(F.col("conv_id"), taken(p)).alias("passage"),
        F.when(i == last, F.length(taken(p))).otherwise(F.length(p[0]["word"]) + 1).alias("size"),
        F.array_distinct(F.transform(p, lambda x: x.line)).alias("lines"),
    )
    # `slice` would copy the whole passage for every window. Made inside the row, so that rows of windows do not carry the passage.
    return runs.select("conv_id", "turn", "level", F.explode(F.transform(slices, piece)).alias("piece")).select("conv_id", "turn", "level", "piece.*")


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of messages with a parent; the driver sees one count a round."""
    now = staged(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "quotes-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        wider = staged(now.join(up, ["conv_id", "root"], "left"), "quotes-roots")
        open_ = wider.filter("up IS NOT NULL").limit(1).count()
        now = wider.select("conv_id", "turn", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not open_:
            return now


def _windows(own: DataFrame, linked: DataFrame) -> DataFrame:
    """conv_id, turn, level, writer, size: votes of windows that touch a quoted line whose own hash names no message."""
    open_lines = linked.filter("writer IS NULL AND conv_id IS NOT NULL AND turn IS NOT NULL")
    asking = open_lines.groupBy("conv_id", "turn").agg(F.collect_set("passage").alias("open"))
    quoted = staged(
        _pieces(own.join(asking.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi"), True)
        .join(asking, ["conv_id", "turn"])
        .filter(F.arrays_overlap("lines", "open"))
        .select("conv_id", "turn", "level", "passage", "size"),
        "quotes-windows",
    )
    conversations = own.filter("turn IS NOT NULL").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    written = _pieces(conversations, False).select("conv_id", "turn", "passage")
    # Lines of fewer words than a window stand for themselves, whatever is around them.
    short = (
        conversations.select("conv_id", "turn", F.explode(_parsed(F.col("text"))).alias("line"))
        .filter("line.level = 0")
        .select("conv_id", "turn", _normal(F.col("line.content")).alias("normal"))
        .filter((F.col("normal") != "") & (F.size(F.split("normal", " ")) < WINDOW))
        .select("conv_id", "turn", F.xxhash64("conv_id", "normal").alias("passage"))
    )
    wanted = quoted.select("conv_id", "passage").distinct()
    first = written.unionByName(short).join(wanted, ["conv_id", "passage"], "left_semi").groupBy("conv_id", "passage").agg(F.min("turn").alias("writer"))
    return quoted.join(first, ["conv_id", "passage"]).filter("writer < turn").select("conv_id", "turn", "level", "writer", "size")


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, size and lines (their hashes and sizes) of every passage of several lines of one level."""
    normal = F.transform(_parsed(F.col("text")), lambda x: F.struct(x.level.alias("level"), _normal(x.content).alias("normal")))
    level = lambda i: F.get(F.col("lines"), i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i - 1) != level(i)))
    run = lambda begin, end: F.slice(F.col("lines"), begin + 1, end - begin)
    runs = (
        # Exploded from an array of one, so that the lines are made once and not again for each use.
        messages.select("conv_id", "turn", F.explode(F.array(F.filter(normal, lambda x: x.normal != ""))).alias("lines"))
        .filter(F.size("lines") > 0)
        .withColumn("starts", F.concat(starts, F.array(F.size("lines"))))
        .select("conv_id", "turn", F.explode(F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: run(F.get(F.col("starts"), i - 1), F.get(F.col("starts"), i)))).alias("run"))
    )
    text = F.array_join(F.transform("run", lambda x: x.normal), " ")
    lines = F.transform("run", lambda x: F.struct(F.xxhash64(F.col("conv_id"), x.normal).alias("passage"), F.length(x.normal).alias("size")))
    return runs.select("conv_id", "turn", F.col("run")[0]["level"].alias("level"), F.xxhash64("conv_id", text).alias("passage"), F.length(text).alias("size"), lines.alias("lines"))


def _first(written: DataFrame) -> DataFrame:
    return written.groupBy("conv_id", "passage").agg(F.min("turn").alias("writer"))


def _earlier(quoted: DataFrame, first: DataFrame) -> DataFrame:
    """`quoted` with the writer of each hash, null where no earlier turn wrote it."""
    joined = quoted.join(first, ["conv_id", "passage"], "left")
    return joined.withColumn("writer", F.when(F.col("writer") < F.col("turn"), F.col("writer")))


def _parents(own: DataFrame, quoting: Column) -> DataFrame:
    """conv_id, turn, parent of every message whose quotes name one."""
    quoted = staged(_passages(own.filter(quoting)).filter("level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL"), "quotes-quoted")
    conversations = own.filter("turn IS NOT NULL").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    written = _passages(conversations).filter("level = 0").select("conv_id", "turn", "passage", F.transform("lines", lambda x: x.passage).alias("lines"))
    written = staged(written, "quotes-written")
    passages = staged(_earlier(quoted, _first(written)), "quotes-passages")
    each = lambda c: F.explode("lines").alias(c)
    lines = passages.filter("writer IS NULL").select("conv_id", "turn", "level", each("line")).select("conv_id", "turn", "level", "line.passage", "line.size")
    linked = staged(_earlier(lines, _first(written.select("conv_id", "turn", each("passage")))), "quotes-linked")
    voting = ["conv_id", "turn", "level", "writer", "size"]
    found = passages.filter("writer IS NOT NULL").select(*voting).unionByName(linked.filter("writer IS NOT NULL").select(*voting))
    votes = found.unionByName(_windows(own, linked)).groupBy("conv_id", "turn", "level", "writer").agg(F.sum("size").alias("votes"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "votes", "writer"))["writer"]
    return votes.groupBy("conv_id", "turn").agg(best.alias("parent"))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, root_turn, depth, position, n_quoted_lines, formatted.

    One row per row of `messages`. A message without quotes that can be linked has
    no parent and is its own root at depth 0. Of several messages that hold a passage, line
    or window, the one with the lowest turn wrote it; only turns before the quoting one
    count, and ties of votes go to the later turn. `position` counts the turns of a
    conversation from 0 in reply order. Text without quote marks is unchanged;
    null text is empty; texts of any length are read whole. Null conversations or turns
    link to nothing and have no position. Rows that share conversation and turn share
    parent and position. Further columns are not read. Empty table: no rows.
    """
    own = messages.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    with scratch(messages.sparkSession) as keep:
        parents = staged(_parents(own, quoting), "quotes-parents")
        links = staged(parents.join(_roots(parents), ["conv_id", "turn"]), "quotes-links")
        turns = own.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct().join(links, ["conv_id", "turn"], "left")
        turns = turns.withColumn("root", F.coalesce("root", "turn"))
        placed = staged(running(turns, [F.col(c) for c in ("conv_id", "root", "turn")], {"rank": F.lit(1)}, "quotes-order"), "quotes-ranks")
        first = placed.groupBy("conv_id").agg(F.min("rank").alias("first"))
        placed = keep(placed.join(first, "conv_id").withColumn("position", F.col("rank") - F.col("first")).drop("rank", "first"), "quotes-turns")

    kept = F.filter(F.col("lines"), lambda x, i: (x.level == 0) & ~(x.content.rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)) > 0)))
    bare = F.btrim(F.array_join(F.transform(kept, lambda x: x.content), "\n"), F.lit(" \t\r\n"))
    count = F.size(F.filter("lines", lambda x: (x.level > 0) & (_normal(x.content) != "")))
    cleaned = own.withColumn("lines", F.when(quoting, _parsed(F.col("text")))).select(
        "conv_id", "turn", "role",
        F.when(F.col("lines").isNotNull(), bare).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lines").isNotNull(), count).otherwise(0).cast("long").alias("n_quoted_lines"),
    )
    return cleaned.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text",
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "position",
        "n_quoted_lines",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text").alias("formatted"),
    )
