import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from conftest import DATA
from edge import ROWS, edge, empty
from quillspark.llm import packing
from quillspark.llm.queries import op1_packing


def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def _whole(rows, texts):
    """Every id in one piece, checksums right, sequences gapless and short enough."""
    tok = _tokenizer()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[doc_id] += len(ids)
        own = [r for r in pieces[doc_id] if r.doc_tokens == len(ids)]
        assert {r.start for r in own} == set(range(0, len(ids), 2048))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == dict(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = op1_packing(spark, DATA).collect()
    count = _whole(rows, docs)
    assert count <= 1.05 * -(-sum(r.length for r in rows) // 2048) + 1


def test_edge_rows_and_empty(spark):
    rows = packing.pack_documents(edge(spark), with_ids=True).collect()
    _whole(rows, [r[:2] for r in ROWS])
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack_documents(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st 12\n\t é漢.,\r "), max_size=40) | st.text(max_size=30))
def test_ids_equal_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    assert packing.encoding().ids(text) == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "x", "é", "<|EndOfText|>", "'s"]), max_size=9))
def test_special_tokens(parts):
    text = "".join(parts)
    assert packing.encoding().ids(text) == TOK.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_the_query(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "in<|endoftext|>side  <|endoftext|>\n"]
    docs = list(enumerate(texts))
    _whole(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


TOK = _tokenizer()


def one_by_one(histogram, max_len):
    """Room left in each pack: every single piece, longest first, goes into the pack with the most room, or into a new one."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if rooms and -rooms[0] >= length:
                heapq.heapreplace(rooms, rooms[0] + length)
            else:
                heapq.heappush(rooms, length - max_len)
    return sorted(-r for r in rooms)


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=20))
@example({20: 1, 2: 40})
@example({1: 500, 64: 2, 33: 3})
def test_shortest_pack_first(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    held, rooms = Counter(), []
    for count, runs in patterns:
        size = sum(n * k for n, k in runs)
        assert size <= 64 and count > 0
        rooms += [64 - size] * count
        for n, k in runs:
            held[n] += count * k
    assert held == Counter({n: k for n, k in histogram.items() if k})
    assert sorted(rooms) == one_by_one(histogram, 64)
    assert len(patterns) <= 3 * 64


def test_known_histograms():
    count = lambda h: sum(c for c, _ in packing.pack_histogram(h, 2048))
    assert count({1000: 1, 100: 30}) == 2 and count({1500: 2, 1000: 3, 100: 60}) == 6
    # The work follows the number of lengths, not of pieces.
    wide = {n: 10**12 + n * 977 for n in range(1, 2049)}
    patterns = packing.pack_histogram(wide, 2048)
    assert len(packing.slot_rows(patterns)) <= 3 * 2048 * 63 + packing.RANGES * 2048
    assert sum(c * sum(n * k for n, k in runs) for c, runs in patterns) == sum(n * k for n, k in wide.items())


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_every_rank_has_one_slot(histogram):
    seen = Counter()
    for length, reach, first, last, base, offset, times in packing.slot_rows(packing.pack_histogram(histogram, 64)):
        width = -(-histogram[length] // packing.RANGES)
        for rank in range(max(first, reach * width), min(last, (reach + 1) * width)):
            seen[length, rank] += 1
            assert offset + length * ((rank - first) % times) + length <= 64
    assert set(seen.values()) == {1} and len(seen) == sum(histogram.values())
