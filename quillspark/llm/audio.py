"""Audio columns: log-mel features of sampled bytes with time spans.

A clip is stored as a WAV file of one channel of unsigned 8-bit samples, in a table of the
shared folder. Features are computed from the samples read back from that table:
polyphase resampling to half the rate, overlapped frames through a log-mel filterbank,
and hysteresis on frame energy for the active segments. Patches of frames become
fixed-shape Arrow tensors with the time span that each covers. A clip streams through
in blocks of frames, so that besides the stored clip and its tensors, which are
values of one row, a task holds one block and four bytes of energy per frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import staged

RATE, DOWN = 16_000, 2
OUT_RATE = RATE // DOWN
FRAME, HOP, MELS = 256, 128, 32
PATCH = 32  # frames of a tensor
BLOCK = 512  # frames at a time, whole patches
#: Hysteresis: a segment starts above HIGH and ends below LOW, relative to the clip's mean energy.
HIGH, LOW = 1.05, 0.95


def wav(payload: bytes) -> bytes:
    """A canonical WAV file of 8-bit mono samples; a pad byte follows an odd payload."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a WAV file made of chunks; the first data chunk counts."""
    stream = io.BytesIO(media)
    riff, _, kind = struct.unpack("<4sI4s", stream.read(12))
    if (riff, kind) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    while True:
        name, size = struct.unpack("<4sI", stream.read(8))
        if name == b"data":
            return stream.read(size)
        stream.seek(size + (size & 1), 1)


def _lowpass() -> np.ndarray:
    """FIR low-pass for the resampler: windowed sinc, 16 taps."""
    n = np.arange(16) - 7.5
    taps = np.sinc(n / DOWN) * np.hamming(16)
    return (taps / taps.sum()).astype(np.float32)


_PHASES = np.stack([_lowpass()[p::DOWN] for p in range(DOWN)])


_TAPS = _PHASES.shape[1]


def resampled_size(samples: int) -> int:
    """Samples at half the rate; a last odd sample is left out."""
    return max(samples // DOWN, 1)


def resampled(samples: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples start to stop at half the rate: every phase of the input meets its phase of the filter, and the sums are added.

    Only the input that these samples need is touched; silence stands before and after the clip.
    """
    size = len(samples) // DOWN
    stop = resampled_size(len(samples)) if stop is None else stop
    low, high = max(0, start - _TAPS + 1), min(size, stop)
    x = np.zeros((stop - start + _TAPS - 1, DOWN), np.float32)
    if high > low:
        part = samples[low * DOWN : high * DOWN].astype(np.float32) - 128
        x[low - start + _TAPS - 1 : high - start + _TAPS - 1] = (part * np.float32(1 / 128)).reshape(-1, DOWN)
    return sum(np.convolve(x[:, p], _PHASES[p], "valid") for p in range(DOWN)).astype(np.float32)


def mel_filters() -> np.ndarray:
    """Triangular filters, frequencies x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


_MEL = mel_filters()
_WINDOW = np.hanning(FRAME).astype(np.float32)


class Block(NamedTuple):
    mel: np.ndarray  # frames x MELS
    energy: np.ndarray  # frames


def frame_count(samples: int) -> int:
    """Frames of a clip; the last one is padded with silence."""
    return max(1, -(-(resampled_size(samples) - FRAME) // HOP) + 1)


def blocks(samples: np.ndarray, block: int = BLOCK) -> Iterator[Block]:
    """Log-mel features and energies of `block` frames after the other."""
    frames, size = frame_count(len(samples)), resampled_size(len(samples))
    for at in range(0, frames, block):
        n = min(block, frames - at)
        first, last = at * HOP, (at + n - 1) * HOP + FRAME
        signal = np.zeros(last - first, np.float32)
        signal[: min(last, size) - first] = resampled(samples, first, min(last, size))
        part = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        yield Block(np.log(power.astype(np.float32) @ _MEL + np.float32(1e-6)), (part * part).sum(1))


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds where energy rose above the high mark and has not fallen below the low one."""
    mean = float(energy.mean())
    # State after each frame: the last frame outside the band decides.
    mark = np.where(energy > HIGH * mean, 1, np.where(energy < LOW * mean, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], active.astype(np.int8), [0]))))
    step = HOP / OUT_RATE
    return [(round(float(a) * step, 6), round((float(b - 1) * HOP + FRAME) / OUT_RATE, 6)) for a, b in zip(edge[::2], edge[1::2])]


class Tensors:
    """Patches of PATCH x MELS as a fixed-shape tensor column with start and end seconds, written block by block to an Arrow IPC stream, which keeps the tensor type."""

    KIND = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
    SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", KIND)])

    def __init__(self) -> None:
        self.sink = io.BytesIO()
        self.out = pa.ipc.new_stream(self.sink, self.SCHEMA)
        self.frames = 0

    def add(self, mel: np.ndarray) -> None:
        """Frames in whole patches; the last patch of a clip is padded with the floor."""
        count = -(-len(mel) // PATCH)
        padded = np.full((count * PATCH, MELS), np.log(np.float32(1e-6)), np.float32)
        padded[: len(mel)] = mel
        storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), PATCH * MELS)
        starts = self.frames + np.arange(count) * PATCH
        ends = np.minimum(starts + PATCH, self.frames + len(mel))
        spans = [pa.array(x * (HOP / OUT_RATE)) for x in (starts, ends)]
        self.out.write_batch(pa.RecordBatch.from_arrays([*spans, pa.ExtensionArray.from_storage(self.KIND, storage)], schema=self.SCHEMA))
        self.frames += len(mel)

    def value(self) -> bytes:
        self.out.close()
        return self.sink.getvalue()


def read_tensors(data: bytes) -> pa.Table:
    """The table of an Arrow IPC stream of tensors."""
    return pa.ipc.open_stream(data).read_all()


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes followed by zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def described(media: bytes) -> tuple[str, list[tuple[float, float]], bytes]:
    """Summary, active segments and tensors of a stored clip.

    The summary has frames, segments, active seconds, and mean and deviation of eight mel groups, to two digits.
    """
    samples = np.frombuffer(wav_samples(media), np.uint8)
    energy = np.empty(frame_count(len(samples)), np.float32)
    total, square, at, made = np.zeros(8), np.zeros(8), 0, Tensors()
    for block in blocks(samples):
        energy[at : at + len(block.energy)] = block.energy
        at += len(block.energy)
        groups = block.mel.reshape(len(block.mel), 8, -1).mean(2, dtype=np.float64)
        total += groups.sum(0)
        square += (groups * groups).sum(0)
        made.add(block.mel)
    found = segments(energy)
    mean = total / at
    numbers = ";".join(f"{a:.2f},{b:.2f}" for a, b in zip(mean, np.sqrt(np.maximum(square / at - mean * mean, 0))))
    return f"frames={at};segments={len(found)};active={sum(b - a for a, b in found):.2f};mel={numbers}", found, made.value()


#: Bytes of clips in a batch of results.
_FULL = 1 << 23


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_bytes, media."""
    for batch in batches:
        ids, sizes, clips, held = [], [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            size, data = payload(text.as_py())
            ids.append(doc_id)
            sizes.append(size)
            clips.append(wav(data))
            held += len(data)
            if held > _FULL:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(clips, pa.binary())], _STORED)
                ids, sizes, clips, held = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(clips, pa.binary())], _STORED)


_STORED = ["doc_id", "n_bytes", "media"]
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_COLUMNS = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "segments": _SPANS, "tensors": pa.binary(),
}
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,"
    " media binary, segments array<struct<start_s: double, end_s: double>>, tensors binary"
)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, media as stored -> all columns."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_COLUMNS.values())], list(_COLUMNS))

    for batch in batches:
        rows, held = [], 0
        for doc_id, size, clip in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            media = clip.as_py()
            back = wav_samples(media)
            feature, spans, tensors = described(media)
            digest = len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest()
            rows.append((doc_id, size, *digest, feature, media, [{"start_s": a, "end_s": b} for a, b in spans], tensors))
            held += len(media) + len(tensors)
            if held > _FULL:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a WAV clip, in a written table. Null text: empty, 64 zero bytes."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(pairs.mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "clips")


def sonify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text stored as a WAV clip, then digests and features of what is read back from the written table.

    Columns: the digests and the feature summary, the file (media), its active segments in
    seconds and the Arrow stream of its log-mel tensors. No shuffle. Null text: empty,
    64 zero bytes. Ids are integers and may repeat or be null; equal texts give equal
    values; only id and text are read. Empty table: no rows.
    """
    return store(docs, id_col, text_col).mapInArrow(_featured, SCHEMA)
