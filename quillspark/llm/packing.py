"""Packing documents into fixed-length training sequences.

Shortest-pack-first over the length histogram: lengths are placed longest
first, always into the shortest pack (the one with the most room), and only counts
of packing patterns are kept. The patterns are joined back to the pieces by their
rank among pieces of equal length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import buckets, staged

#: White space other than a single blank or line feed between other characters.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_encodings: dict[str, Encoding] = {}


class Encoding:
    """Ids of the byte-level BPE in a vocabulary file, as `tokenizers` gives them by default: strings of special tokens become their ids.

    The splitter runs several times faster without the look-ahead of its pattern; the
    two agree on texts without special tokens whose white space never stands in runs.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = public_tokenizers.PATTERN
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Token ids of one text."""
        if any(x in text for x in self.special):
            return self.full.encode(text, allowed_special="all")
        runs = "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _RARE_SPACE.search(text)
        return (self.full if runs else self.plain).encode_ordinary(text)


def encoding(path: str | None = None) -> Encoding:
    """The encoding of a vocabulary file, read once in a process."""
    path = path or tokenizer_path()
    if path not in _encodings:
        _encodings[path] = Encoding(path)
    return _encodings[path]


def tokenizer_path() -> str:
    """Where the default vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(max_len: int, end_id: int, path: str | None, with_ids: bool, most_ids: int = 1 << 22):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def made(columns: tuple[list, ...], ids: list) -> pa.RecordBatch:
        arrays = [pa.array(x, pa.int64()) for x in columns] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            columns, ids, held = ([], [], [], [], []), [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = own.ids(text.as_py() or "")
                found.append(end_id)
                array = np.array(found, "<u4")
                for at in range(0, len(array), max_len):
                    part = array[at : at + max_len]
                    for column, value in zip(columns, (doc_id, at, len(part), zlib.crc32(part.data), len(array))):
                        column.append(value)
                    if with_ids:
                        ids.append(part.astype("<i4"))
                held += len(array)
                if with_ids and held > most_ids:
                    yield made(columns, ids)
                    columns, ids, held = ([], [], [], [], []), [], 0
            yield made(columns, ids)

    return run


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Tokenise whole texts, append `end_id` and cut every document into pieces of at most `max_len`.

    A null text is empty: one piece that holds only `end_id`. Columns: doc_id,
    start, length, ids_crc32, doc_tokens, and ids where asked for.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(_pieces(max_len, end_id, tokenizer, with_ids), schema)


#: A pattern: lengths with how often each stands there, in order of placing.
Runs = tuple[tuple[int, int], ...]


def _with(runs: Runs, length: int, times: int = 1) -> Runs:
    if runs and runs[-1][0] == length:
        return (*runs[:-1], (length, runs[-1][1] + times))
    return (*runs, (length, times))


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[int, Runs]]:
    """(count, runs) of patterns that together hold every length as often as the histogram says.

    Shortest pack first: lengths go longest first, each piece into the open pack with
    the most room, and into a new one where none has enough. Packs of equal content
    are one pattern with a count, so many pieces move in one step; a length visits
    each amount of room once and splits one pattern at most, so there are at most
    three patterns per length, and at most sqrt(2 max_len) lengths in a pattern.
    """
    room: dict[int, dict[Runs, int]] = {}

    def put(space: int, runs: Runs, count: int) -> None:
        held = room.setdefault(space, {})
        held[runs] = held.get(runs, 0) + count

    for length in sorted((n for n, k in histogram.items() if k), reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, held in room.items() if held), default=-1)
            if space < length:
                break
            for runs, count in [*room[space].items()]:
                used = min(count, left)
                if used == count:
                    del room[space][runs]
                else:
                    room[space][runs] = count - used
                put(space - length, _with(runs, length), used)
                left -= used
                if not left:
                    break
        # A new pack has the most room of all until it is full of this length.
        per = max_len // length
        if left >= per:
            put(max_len - per * length, ((length, per),), left // per)
        if left % per:
            put(max_len - left % per * length, ((length, left % per),), 1)
    return [(count, runs) for _, held in sorted(room.items()) for runs, count in held.items()]


#: Ranks of a length are cut into so many ranges, each with the slots that reach into it.
RANGES = 8


def slot_rows(patterns: list[tuple[int, Runs]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, range, rank_from, rank_to, base, offset, times): pieces of `length` with these ranks fill this run of one pattern, `times` in each sequence.

    Range r holds the ranks r * width to (r + 1) * width - 1 with width = ceil(pieces / RANGES).
    """
    total: dict[int, int] = {}
    for count, runs in patterns:
        for length, times in runs:
            total[length] = total.get(length, 0) + count * times
    rows, taken, base = [], {}, 0
    for count, runs in patterns:
        offset = 0
        for length, times in runs:
            first = taken.get(length, 0)
            last = taken[length] = first + count * times
            width = -(-total[length] // RANGES)
            rows += [(length, r, first, last, base, offset, times) for r in range(first // width, (last - 1) // width + 1)]
            offset += length * times
        base += count
    return rows


SLOTS = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "range", "rank_from", "rank_to", "base", "slot_offset", "times")])


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Give every piece a sequence_id and an offset there; no sequence is longer than `max_len`.

    `pieces` has doc_id, start and length (1 to `max_len`), and any further
    columns, which stay; it should be a written table, since it is read twice.
    The driver sees one count per length. Ranks among equal lengths come from a
    count per (length, salt) and a row number inside, so that a length that a
    third of all pieces share is still dealt over all tasks. The slot table has at
    most 3 max_len patterns of sqrt(2 max_len) runs and RANGES more rows per length,
    whatever the input (2048: 0.41 million rows of 56 bytes, 23 MB; in practice 24,000
    rows), and is broadcast. A piece meets the slots of its range of ranks only. No pieces: no rows.
    """
    spark = pieces.sparkSession
    # Working columns are one struct, so that no further column can clash with them.
    salted = pieces.select("doc_id", "start", "length", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets(spark))).alias("salt"), F.struct(*pieces.columns).alias("piece"))
    counts = salted.groupBy("length", "salt").count()
    of_length = Window.partitionBy("length")
    below = of_length.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("rank_base", F.coalesce(F.sum("count").over(below), F.lit(0))).withColumn("width", F.ceil(F.sum("count").over(of_length) / RANGES))
    bases = staged(based, "pack-ranks")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(slot_rows(pack_histogram(histogram, max_len)), SLOTS)

    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        # The window has dealt and sorted the pieces by these keys, so a merge moves them no further; the bases grow with the salts and are not broadcast.
        .join(bases.drop("count").hint("merge"), ["length", "salt"])
        .withColumn("rank", F.col("rank_base") + F.col("nth"))
        .withColumn("range", F.expr("rank div width"))
    )
    nth = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(slots), ["length", "range"])
        .filter("rank >= rank_from AND rank < rank_to")
        .select(
            "piece.*",
            (F.col("base") + F.expr("(rank - rank_from) div times")).alias("sequence_id"),
            (F.col("slot_offset") + F.col("length") * (nth % F.col("times"))).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, max_len: int = 2048, with_ids: bool = True, **columns) -> DataFrame:
    """Tokenise, cut and pack `docs`: one row per piece, in no order.

    Nulls, empty texts, repeated ids and extra columns: a null or empty text is
    the end token alone; rows that share a doc_id are separate documents;
    other columns of `docs` are not read. An empty table gives no rows.
    """
    return pack(staged(token_pieces(docs, max_len=max_len, with_ids=with_ids, **columns), "pieces"), max_len)
