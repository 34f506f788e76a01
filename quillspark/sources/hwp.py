"""Text of binary HWP 5 documents: an OLE container of deflated record streams.

Both formats are public; only what plain text needs is read. Broken input raises
ValueError, which the caller turns into empty text.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Fixed values of the container format: signature, chain ends, directory entry size.
_SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE = 0xFFFFFFFA  # sector numbers from here on end a chain
_ENTRY = 128
#: Fixed values of the document format: paragraph text records, control characters that take one unit.
_PARAGRAPH = 67
_SINGLE = frozenset([0, 10, 13, *range(24, 32)])


def _words(data: bytes) -> list[int]:
    return np.frombuffer(data[: len(data) // 4 * 4], "<u4").tolist()


class Container:
    """Streams of an OLE file by path."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != _SIGNATURE or len(data) < 512:
            raise ValueError("not an OLE file")
        self.data = data
        self.sector, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, self.cutoff, first_small, _, first_list, _ = (struct.unpack_from("<I", data, at)[0] for at in (48, 56, 60, 64, 68, 72))
        lists, at = _words(data[76:512]), first_list
        for _ in range(len(data) // self.sector):
            if at >= _FREE:
                break
            *more, at = _words(self._sector(at))
            lists += more
        self.fat = [x for s in lists if s < _FREE for x in _words(self._sector(s))]
        self.small_fat = _words(self._chain(first_small))
        self.entries = self._chain(first_dir)
        self.pool = b""
        self.streams: dict[str, tuple[int, int]] = {}
        self._walk(struct.unpack_from("<I", self.entries, 76)[0], "", set())
        start, size = struct.unpack_from("<I", self.entries, 116)[0], struct.unpack_from("<I", self.entries, 120)[0]
        self.pool = self._chain(start)[:size]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector]

    def _links(self, at: int, fat: list[int]) -> list[int]:
        out: list[int] = []
        while at < _FREE:
            if at >= len(fat) or len(out) > len(fat):
                raise ValueError("broken chain")
            out.append(at)
            at = fat[at]
        return out

    def _chain(self, at: int) -> bytes:
        return b"".join(self._sector(n) for n in self._links(at, self.fat))

    def _walk(self, n: int, folder: str, seen: set[int]) -> None:
        """Entries of one folder are a tree of siblings; folders hang below their own entry."""
        todo = [(n, folder)]
        while todo:
            n, folder = todo.pop()
            if n in seen or (n + 1) * _ENTRY > len(self.entries):
                continue
            seen.add(n)
            entry = self.entries[n * _ENTRY : (n + 1) * _ENTRY]
            length, kind = struct.unpack_from("<HB", entry, 64)
            left, right, child = struct.unpack_from("<III", entry, 68)
            path = folder + entry[: max(0, length - 2)].decode("utf-16-le", "replace")
            if kind == 2:
                self.streams[path] = struct.unpack_from("<II", entry, 116)
            todo += [(left, folder), (right, folder), (child, f"{path}/")]

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        parts = (self.pool[n * self.small : (n + 1) * self.small] for n in self._links(start, self.small_fat))
        return b"".join(parts)[:size]


def _records(stream: bytes):
    """(tag, payload) of each record; a size of all ones is followed by the real one."""
    at = 0
    while at + 4 <= len(stream):
        (head,) = struct.unpack_from("<I", stream, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            (size,) = struct.unpack_from("<I", stream, at)
            at += 4
        yield head & 0x3FF, stream[at : at + size]
        at += size


def _paragraph(payload: bytes) -> str:
    """Characters of a paragraph; control characters of eight units are skipped whole, a tab stays."""
    units = np.frombuffer(payload[: len(payload) // 2 * 2], "<u2")
    out, at = [], 0
    for stop in [*np.flatnonzero(units < 32).tolist(), len(units)]:
        if stop < at:  # inside a control that was skipped
            continue
        out.append(units[at:stop].tobytes().decode("utf-16-le", "replace"))
        if stop < len(units):
            code = int(units[stop])
            out.append("\n" if code in (10, 13) else "\t" if code == 9 else "")
            stop += 1 if code in _SINGLE else 8
        at = stop
    return "".join(out)


def hwp_text(data: bytes) -> str:
    """Paragraphs of the body, sections in order of number, one line each."""
    try:
        box = Container(data)
        packed = box.read("FileHeader")[36] & 1
        sections = sorted((int(m[1]), p) for p in box.streams if (m := re.fullmatch(r"BodyText/Section([0-9]+)", p)))
        lines = []
        for _, path in sections:
            stream = box.read(path)
            stream = zlib.decompress(stream, -15) if packed else stream
            lines += [_paragraph(x).rstrip("\n") for tag, x in _records(stream) if tag == _PARAGRAPH]
        return "".join(f"{x}\n" for x in lines)
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"broken document: {e}") from e
