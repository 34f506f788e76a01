"""Term rules as a table: thousands of literal terms replaced in one pass, with a log row per hit."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all rules together that go to every task; a larger table is refused.
MOST_CHARS = 1 << 25
#: Characters of text behind one batch of results.
CHARS = 1 << 20


def rule_list(rules: DataFrame, term: str = "term", replacement: str = "replacement") -> list[tuple[str, str]]:
    """The rules in order of term, one per term: of several the least replacement. Null or empty terms are no rules, a null replacement deletes.

    Raises ValueError beyond MOST_CHARS, before any rule reaches the driver.
    """
    one = rules.filter(F.col(term) != "").groupBy(F.col(term).alias("term")).agg(F.min(F.coalesce(F.col(replacement), F.lit(""))).alias("replacement"))
    size = one.agg(F.sum(F.length("term") + F.length("replacement"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"{size} characters of rules; {MOST_CHARS} is the most")
    return sorted(map(tuple, one.collect()))


def _replacing(rules: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = ahocorasick.Automaton()
        for number, (term, _) in enumerate(rules):
            matcher.add_word(term, (number, len(term)))
        matcher.make_automaton()
        named = pa.array([t for t, _ in rules], pa.string()), pa.array([r for _, r in rules], pa.string())
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # Rows up to about CHARS characters at once; a longer text goes alone.
                first, size, texts = at, 0, []
                places, numbers, edges = array("i"), array("i"), array("i", [0])
                used, times, use_edges = array("i"), array("i"), array("i", [0])
                while at < batch.num_rows and size < CHARS:
                    text = batch.column(1)[at].as_py()
                    end, parts, own = 0, [], array("i")
                    every = [(last + 1 - n, -n, number) for last, (number, n) in matcher.iter(text)] if text and rules else []
                    # Leftmost, then longest, without overlaps.
                    for start, less, number in sorted(every):
                        if start >= end:
                            parts += [text[end:start], rules[number][1]]
                            places.append(start)
                            own.append(number)
                            end = start - less
                    texts.append(None if text is None else "".join([*parts, text[end:]]))
                    numbers.extend(own)
                    edges.append(len(numbers))
                    for number, n in sorted(Counter(own).items()):
                        used.append(number)
                        times.append(n)
                    use_edges.append(len(used))
                    size += len(text or "")
                    at += 1
                rule = lambda which: [names.take(pa.array(which, pa.int32())) for names in named]
                hits = pa.StructArray.from_arrays([pa.array(places, pa.int32()), *rule(numbers)], ["place", "term", "replacement"])
                uses = pa.StructArray.from_arrays([*rule(used), pa.array(times, pa.int32())], ["term", "replacement", "n"])
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((edges, hits), (use_edges, uses))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(texts, pa.string()), *lists], ["key", "text", "hits", "uses"])

    return run


def replaced(docs: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, hits, uses of every row: the text with all terms replaced, (place, term, replacement) of each hit, place in characters from 0, and how often each rule hit.

    A hit starts as far left as one can and is as long as one can; what a replacement writes is not searched again. Matching is
    literal and inside words too; one pass of an automaton finds all terms, however many rules there are. Null texts stay null, without hits; repeated rows stay.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hits = "hits array<struct<place: int, term: string, replacement: string>>, uses array<struct<term: string, replacement: string, n: int>>"
    return rows.mapInArrow(_replacing(rule_list(rules)), f"key {rows.schema['key'].dataType.simpleString()}, text string, {hits}")


def hit_log(done: DataFrame) -> DataFrame:
    """key, nth, place, term, replacement: one row per hit, in order."""
    return done.select("key", F.posexplode("hits").alias("nth", "_h")).select("key", "nth", "_h.*")


def used(done: DataFrame) -> DataFrame:
    """term, replacement, hits, texts: how often each rule was used, and in how many rows; partial sums keep a term that is everywhere cheap."""
    return done.select(F.inline("uses")).groupBy("term", "replacement").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("texts"))
