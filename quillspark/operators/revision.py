"""Original and revision side by side: aligned lines as hunks, and what became of every sentence.

Each document's lines meet in one row, so the alignment runs in tasks; documents are dealt by their key.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.editing import sentences

#: Sentences of a document, on either side, that may hold a token which makes them candidates for each other.
RARE = 20
#: Rows and characters that a task gathers before it hands them on.
ROWS, CHARS = 5_000, 1 << 21
_WORD = re.compile(r"[^\W_]+")


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []  # place of the last value of the best run of each length
    before = [-1] * len(values)
    for at, value in enumerate(values):
        n = bisect_left(tails, value)
        before[at] = ends[n - 1] if n else -1
        tails[n:n + 1] = [value]
        ends[n:n + 1] = [at]
    found = []
    at = ends[-1] if ends else -1
    while at >= 0:
        found.append(at)
        at = before[at]
    return found[::-1]


def _anchors(a: Sequence[Hashable], b: Sequence[Hashable], span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Pairs of equal units, in order on both sides: of those that stand once on either side, else of the first, second ... of each."""
    a0, a1, b0, b1 = span
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    for once in (True, False):
        seen: Counter = Counter()
        place = {}
        for j in range(b0, b1):
            if in_a[b[j]] and (not once or in_a[b[j]] == in_b[b[j]] == 1):
                place[b[j], seen[b[j]]] = j
                seen[b[j]] += 1
        seen.clear()
        pairs = []
        for i in range(a0, a1):
            if (a[i], seen[a[i]]) in place:
                pairs.append((i, place[a[i], seen[a[i]]]))
            seen[a[i]] += 1
        if pairs:
            return [pairs[k] for k in longest_increasing([j for _, j in pairs])]
    return []


def aligned(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs (i, j) of kept units, rising on both sides.

    Equal units at both ends of a span are kept; anchors divide the rest into spans between them, until no
    span has one.
    """
    kept: list[tuple[int, int]] = []
    spans = [(0, len(a), 0, len(b))]
    while spans:
        a0, a1, b0, b1 = spans.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            kept.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            kept.append((a1, b1))
        anchors = _anchors(a, b, (a0, a1, b0, b1)) if a0 < a1 and b0 < b1 else []
        kept += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            spans += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(kept)


def changes(a: Sequence[str], b: Sequence[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, first and number of units before, first and number after) of runs that cover both sides: kept, inserted, deleted, replaced."""
    i = j = run = 0
    for k, m in [*aligned(a, b), (len(a), len(b))]:
        if (k > i or m > j or k == len(a)) and run:
            yield "kept", i - run, run, j - run, run
            run = 0
        if k > i or m > j:
            yield "inserted" if k == i else "deleted" if m == j else "replaced", i, k - i, j, m - j
        i, j, run = k + 1, m + 1, run + 1


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each beside its number of characters, in batches of ROWS rows or about CHARS characters; a document's rows may part anywhere."""
    out: list[tuple] = []
    size = 0
    for row, chars in rows:
        out.append(row)
        size += chars
        if len(out) >= ROWS or size >= CHARS:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, before, after) of one row after the other; only one document's texts are Python objects at a time."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(x.as_py() for x in row)


_HUNK = pa.schema([("key", pa.string()), ("hunk", pa.int32()), ("kind", pa.string()), *[(c, pa.int32()) for c in ("before_at", "before_n", "after_at", "after_n")], *[(c, pa.list_(pa.string())) for c in ("before", "after")]])


def _hunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[tuple, int]]:
        for key, before, after in _documents(batches):
            a, b = ([] if x is None else x.split("\n") for x in (before, after))
            for n, (kind, i, k, j, m) in enumerate(changes(a, b)):
                old, new = ([], []) if kind == "kept" else (a[i : i + k], b[j : j + m])
                yield (key, n, kind, i, k, j, m, old, new), sum(map(len, old)) + sum(map(len, new))

    return _batches(rows(), _HUNK)


def _keyed(df: DataFrame, key: str, value: Column, none: str, side: str) -> DataFrame:
    """key as text of whatever type behind a mark, or `none` where it is null; the value as `side`. The same rows asked for again are the same shuffle."""
    return df.select(_marked(key, none).alias("key"), value.alias(side))


def _marked(key: str, none: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(none))


def _unmarked() -> Column:
    return F.when(F.startswith("key", F.lit("=")), F.expr("substring(key, 2)"))


def _side_by_side(before: DataFrame, after: DataFrame, key: str, value: Column) -> DataFrame:
    """key (as text, of whatever type), before, after; keys that only one side has, and keys that are null, have null on the other."""
    both = _keyed(before, key, value, "<", "before").join(_keyed(after, key, value, ">", "after"), "key", "full")
    return both.select(_unmarked().alias("key"), "before", "after")


def hunks(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """key, hunk, kind ('kept', 'inserted', 'deleted', 'replaced'), before_at, before_n, after_at, after_n, before, after: runs of lines that cover both texts.

    Keys stand once on each side. A text that is null or not there has no lines, an empty one has one empty line. Lines
    of kept hunks are not repeated. Lines that stand once in both texts are the anchors; the longest rising run of
    them divides the texts, and what lies between is divided likewise, so a line that moved is deleted in one place and inserted in another.
    """
    schema = "key string, hunk int, kind string, before_at int, before_n int, after_at int, after_n int, before array<string>, after array<string>"
    made = _side_by_side(before, after, key, F.col(text).cast("string")).mapInArrow(_hunks, schema)
    return made.withColumn("key", F.col("key").cast(before.schema[key].dataType))


def applied(before: DataFrame, made: DataFrame, key: str, text: str) -> DataFrame:
    """key, text: the revision, from the original and its hunks alone; null where no line is left. One document's hunks meet in one row.

    Originals are keyed as in `hunks`, so where both stand in one plan they are shuffled once, and hunks are grouped and joined on one shuffle.
    """
    step = F.struct("hunk", "kind", "before_at", "before_n", "after")
    steps = made.groupBy(_marked("key", "<").alias("key")).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    both = steps.join(_keyed(before, key, F.col(text).cast("string"), "<", "before"), "key", "left")
    none = F.array().cast("array<string>")
    both = both.select("key", "_steps", F.coalesce(F.split("before", "\n"), none).alias("_lines"))
    new = F.flatten(F.transform("_steps", lambda s: F.when(s.kind == "kept", F.slice("_lines", s.before_at + 1, s.before_n)).when(s.kind == "deleted", none).otherwise(s.after)))
    return both.select(_unmarked().cast(made.schema["key"].dataType).alias(key), F.when(F.size(new) > 0, F.array_join(new, "\n")).alias(text))


def _tokens(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def told_apart(a: Sequence[str], b: Sequence[str], least: float) -> list[tuple[str, int | None, int | None, float]]:
    """(kind, place before, place after, similarity) of every sentence of one document, as sentence_report says."""
    out: list[tuple[str, int | None, int | None, float]] = [("kept", i, j, 1.0) for i, j in aligned(a, b)]
    kept_a, kept_b = {i for _, i, _, _ in out}, {j for _, _, j, _ in out}
    left, right = [i for i in range(len(a)) if i not in kept_a], [j for j in range(len(b)) if j not in kept_b]
    # The first, second ... of equal sentences go together.
    again: dict[str, list[int]] = defaultdict(list)
    for j in reversed(right):
        again[b[j]].append(j)
    moved = {i: again[a[i]].pop() for i in left if again.get(a[i])}
    out += [("moved", i, j, 1.0) for i, j in moved.items()]
    have = set(moved.values())
    old, new = ({k: _tokens(units[k]) for k in rest} for units, rest in ((a, [i for i in left if i not in moved]), (b, [j for j in right if j not in have])))
    holding: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, bags in enumerate((old, new)):
        for k, bag in bags.items():
            for token in bag:
                holding[token][side].append(k)
    near = {(i, j) for x, y in holding.values() if len(x) <= RARE and len(y) <= RARE for i in x for j in y}
    alike = sorted((-shared / (len(old[i]) + len(new[j]) - shared), i, j) for i, j in near for shared in [len(old[i] & new[j])])
    done: tuple[set[int], set[int]] = (set(), set())
    for less, i, j in alike:
        if -less >= least and i not in done[0] and j not in done[1]:
            done[0].add(i)
            done[1].add(j)
            out.append(("changed", i, j, -less))
    return out + [("missing", i, None, 0.0) for i in old if i not in done[0]] + [("added", None, j, 0.0) for j in new if j not in done[1]]


_SENTENCE = pa.schema([("key", pa.string()), ("kind", pa.string()), ("before_at", pa.int32()), ("after_at", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("similarity", pa.float64())])


def _reported(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for key, before, after in _documents(batches):
            a, b = before or [], after or []
            for kind, i, j, alike in told_apart(a, b, least):
                old, new = None if i is None else a[i], None if j is None else b[j]
                yield (key, kind, i, j, old, new, alike), len(old or "") + len(new or "")

    return lambda batches: _batches(rows(batches), _SENTENCE)


def sentence_report(before: DataFrame, after: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """key, kind, before_at, after_at, before, after, similarity: what became of every sentence of either side.

    'kept' sentences stand in the same order in both; 'moved' ones stand on both sides, but not in that
    order; 'changed' are a missing and an added sentence at least `least` similar (shared distinct words by all of both), matched
    one to one per document, the most similar first, equal ones by place; the others are 'missing' or 'added'. Candidates share a
    word that at most RARE sentences left over on each side hold, so a document of very many sentences costs its words, not its pairs.
    Keys stand once on each side; texts that are null or not there have no sentences. Both texts of a document meet once, in one row.
    """
    schema = "key string, kind string, before_at int, after_at int, before string, after string, similarity double"
    made = _side_by_side(before, after, key, sentences(F.col(text).cast("string"))).mapInArrow(_reported(least), schema)
    return made.withColumn("key", F.col("key").cast(before.schema[key].dataType))
