"""Terms of texts as Arrow arrays: runs of ASCII letters and digits and of everything beyond ASCII, with only A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.common import text_slices

#: Byte by byte: what belongs to a term (each byte beyond ASCII does, so UTF-8 needs no decoding), and its lower case.
_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _INSIDE[_a : _b + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_slices(column: pa.Array, most_bytes: int = 1 << 22) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Yield (first, last, terms, bounds) for runs of rows of about most_bytes of text: all terms in order, and where each row's terms begin (last - first + 1 values).

    Nulls have no terms. A longer single text is a run of its own, whole.
    """
    for first, last, data, offsets in text_slices(column, most_bytes):
        inside = _INSIDE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        opens[edges] = inside[edges]
        starts = np.flatnonzero(opens)
        letters = _LOWER[data[inside]]
        # Without what separates them, each term ends where the next begins.
        before = np.cumsum(inside) - inside
        ends = np.append(before[starts], len(letters)).astype(np.int64)
        terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
        yield first, last, terms, np.searchsorted(starts, offsets)


def numbers_in(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each term in the vocabulary, -1 for the others; terms are compared whole."""
    return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
