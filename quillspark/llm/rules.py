"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a numerator, a denominator and an inclusive range of their
quotient. Counts are integers and the comparison multiplies out, so that no
rounding decides a verdict. No user functions run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES

#: The characters counted as symbols, the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Frequent function words of the supported languages, by language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "with", "as", "was", "by", "be", "are", "this", "from", "at"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "est", "pour", "par", "au", "sur", "pas", "avec"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}


class Rule(NamedTuple):
    """numerator / denominator must lie in [least, most], each a fraction (above, below) or None.

    A denominator of None means 1. A rule with a zero denominator holds.
    """

    name: str
    numerator: str
    denominator: str | None
    least: tuple[int, int] | None
    most: tuple[int, int] | None


#: The threshold table.
RULES = (
    Rule("words", "n_words", None, (50, 1), None),
    Rule("word_length", "word_chars", "n_words", (2, 1), (12, 1)),
    Rule("symbols", "n_symbols", "n_words", None, (15, 100)),
    Rule("exclamations", "n_exclamations", "n_words", None, (30, 100)),
    Rule("capitals", "n_capitals", "word_chars", None, (40, 100)),
    Rule("stop_words", "n_stop_words", None, (2, 1), None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, (50, 100)),
    Rule("repeated_words", "n_repeat_words", "n_words", None, (50, 100)),
)


def compiled(rule: Rule) -> Column:
    """The rule as a Boolean column over the counts."""
    up = F.col(rule.numerator)
    down = F.col(rule.denominator) if rule.denominator else F.lit(1).cast("long")
    holds = F.lit(True)
    if rule.least:
        holds = holds & (up * rule.least[1] >= down * rule.least[0])
    if rule.most:
        holds = holds & (up * rule.most[1] <= down * rule.most[0])
    return (down == 0) | holds


def _chars(text: Column, dropped: str) -> Column:
    """How many characters of `text` are among `dropped`."""
    return (F.length(text) - F.length(F.translate(text, dropped, ""))).cast("long")


def _window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`document` (a struct of all columns of `docs`) and the counts that the rules read; null text is empty.

    n_repeat_words needs the words inside 3-word windows that occur twice or more.
    Each window has a 64-bit hash, and a text whose hashes all differ stops there. Else
    its windows are sorted by hash, words and position, so that equal windows are
    neighbours whatever their hashes; neighbours with the same words mark their positions.
    """
    stops = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    t = F.col("t")
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    base = (
        docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
        .withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
        .withColumn("n", F.size("words"))
    )
    word = lambda i: F.get(F.col("words"), i)
    hashes = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: _window_hash(word(i), word(i + 1), word(i + 2)))
    hashed = base.withColumn("tri", F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(hashes)).withColumn(
        "lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    )
    windows = F.transform("tri", lambda h, i: F.struct(h.alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i")))
    sorted_ = hashed.withColumn("windows", F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array(windows)))
    same = lambda x, y: (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
    next_ = F.slice("windows", F.lit(2), F.size("windows"))
    pairs = F.zip_with(F.slice("windows", F.lit(1), F.size("windows") - 1), next_, lambda x, y: F.when(same(x, y), F.array(x.i, y.i)))
    marked = sorted_.withColumn("marked", F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs)))))
    # Each marked window covers three words, less those that the next one covers too.
    own = F.transform("marked", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("marked"), k + 1) - p, F.lit(3))))
    covered = F.aggregate(own, F.lit(0), lambda total, x: total + x)
    long = lambda c, name: c.cast("long").alias(name)
    found = F.struct(
        long(F.col("n"), "n_words"),
        long(F.length(F.translate(t, SPACE_CHARS, "")), "word_chars"),
        long(_chars(t, SYMBOLS), "n_symbols"),
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(_chars(t, "!"), "n_exclamations"),
        long(F.regexp_count(t, F.lit(r"\p{Lu}")), "n_capitals"),
        long(F.size(F.array_intersect("words", stops)), "n_stop_words"),
    )
    # One generated row per document: conditions on a count stand above it, so that the arrays are made once and not again for each condition.
    return marked.select("document", F.inline(F.array(found)))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`document` (a struct of all columns of `docs`, whatever their names), the counts, base_failed, failed (names of broken rules) and kept.

    One map-only projection; rows keep their partitions and repeated rows their
    count. Null or white text: all counts 0, base_failed, not kept. A text of any length
    is read whole. Empty table: no rows.
    """
    broken = F.array_compact(F.array(*[F.when(~compiled(r), F.lit(r.name)) for r in rules]))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(docs, text_col).select("*", base.alias("base_failed"), broken.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that the threshold table keeps, with all their columns, whatever their names.

    Null, empty and short texts go; repeated rows are judged alike and all stay or all go; an empty table gives no rows.
    """
    return apply_rules(docs, text_col, rules).filter("kept").select("document.*")
