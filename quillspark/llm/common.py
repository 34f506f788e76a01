"""Shared folder tables, small Spark helpers and vectorised text hashing."""

from __future__ import annotations

import contextlib
import contextvars

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import delete_paths, fresh_path

#: White space of the word definition `[^\x20\x09-\x0D]+`, as bytes and as a Java class.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Tables that live until release() or the end of the process; in a scope its own list stands here instead.
_lasting: list[str] = []
_scope: contextvars.ContextVar[list[str]] = contextvars.ContextVar("quillspark_scope", default=_lasting)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage: what follows is recomputed from the written table when
    an executor is lost, never from that executor's memory or disk. The table belongs to
    the innermost scratch() around the call, else it lasts until release() or the end of the process.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _scope.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for those given to the function that this yields: they pass to the scope outside.

    Only tables of this very scope go, so other queries of the same driver keep theirs.
    """
    outer, own = _scope.get(), []
    token = _scope.set(own)
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table = staged(df, name)
        kept.append(own.pop())
        return table

    try:
        yield keep
    finally:
        _scope.reset(token)
        outer.extend(kept)
        delete_paths(spark, own)


def release(spark: SparkSession) -> None:
    """Delete the tables that results of this process read; their DataFrames can no longer be evaluated."""
    delete_paths(spark, _lasting)
    _lasting.clear()


#: Bits of a table of keys, in words of 64: half a million rows (about 25 MB) at most, whatever the number of keys.
MEMBER_BITS = 1 << 25


def by_membership(df: DataFrame, own: list[Column], keys: DataFrame, theirs: list[Column], how: str = "left_semi") -> DataFrame:
    """The rows of `df` whose columns `own` may equal `theirs` of a row in `keys`: all that do, and some others; with left_anti, the rows that surely do not.

    The keys set bits of a table of fixed size, which is broadcast, so rows without a partner need no shuffle to find
    that out. The more keys, the more other rows pass (3 % at one million, a quarter at ten million, nearly all from a hundred million on); the join
    that must follow decides in any case. Nulls match nulls.
    """
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(MEMBER_BITS))
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = keys.select(place(theirs).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    asked = place(own)
    return df.join(F.broadcast(words), (F.shiftright(asked, 6) == words["word"]) & (F.getbit(words["bits"], (asked % 64).cast("int")) == 1), how)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """`df` with the sums of what stands before each row in `order`, in parallel.

    Rows are dealt by ranges of the order into tasks and written with their task's
    number; sums of whole tasks, one row each, are added up first, and a window inside each
    range does the rest. `order` must tell all rows apart.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    added = df.select("*", *[c.alias(k) for k, c in sums.items()])
    dealt = staged(added.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), name)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("range").agg(*[F.sum(k).alias(k) for k in sums]).select("range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_base") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_in") for k in sums]).join(bases, "range")
    return placed.select(*df.columns, *[(F.col(f"{k}_base") + F.col(f"{k}_in")).alias(k) for k in sums])


def buckets(spark: SparkSession) -> int:
    """Salts for hot keys: as many as there are shuffle partitions, 32 at least."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Sample keys are hashes of 63 bits.
KEY_BITS = 63


def sample_key(name: str, *columns: str):
    """Place of a row in a sample order, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(name), *columns), 64 - KEY_BITS)


def key_bound(most: int, count: int, first: int = 0) -> int:
    """Keys up to this bound make a sample of about `most` of `count` rows, and the row with the key `first` is in it."""
    return max(first, min((1 << KEY_BITS) - 1, (most << KEY_BITS) // max(1, count)))


# --- vectorised hashing over the UTF-8 bytes of an Arrow column -------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        p, q = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        p[0] = q[0] = 1
        have = _powers[0] = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return have


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for every i, from one prefix sum."""
    p, q = _power(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * q[starts])


def text_slices(column: pa.Array, most_bytes: int = 1 << 18):
    """Yield (first, last, bytes, offsets) for runs of rows of about most_bytes of UTF-8; nulls are empty.

    A longer single text is a run of its own, whole.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each text, and the first word of each text (n + 1 values)."""
    inside = ~_IS_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)
