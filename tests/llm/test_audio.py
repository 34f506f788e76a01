import cmath
import hashlib
import math
import tracemalloc
import zlib

import numpy as np

from conftest import DATA
from edge import ROWS, edge, empty
from quillspark.llm import audio
from quillspark.llm.queries import op10_media_columns


def test_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op10_media_columns(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_media_round_trip_and_tensors(spark):
    rows = audio.sonify(edge(spark)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        back = audio.wav_samples(bytes(r.media))
        assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and len(r.media) == r.media_bytes
        table = audio.read_tensors(bytes(r.tensors))
        assert table.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS]
        assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
        assert all(s.start_s < s.end_s for s in r.segments)
    twice = [tuple(r) for r in rows if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert audio.sonify(empty(spark)).count() == 0


def test_polyphase_equals_filter_then_decimate():
    x = np.random.Generator(np.random.PCG64(3)).integers(0, 256, 999).astype(np.uint8)
    plain = np.convolve((x.astype(np.float32) - 128) / 128, audio._lowpass())
    got = audio.resampled(x)
    # Each output adds both phases of the input: the plain filter at every second place, one sample later for odd taps.
    paired = np.zeros(len(got))
    taps = audio._lowpass()
    signal = (x[: len(x) - len(x) % 2].astype(float) - 128) / 128
    for i in range(len(got)):
        for p in range(2):
            for k in range(8):
                if 0 <= i - k < len(signal) // 2:
                    paired[i] += taps[2 * k + p] * signal[2 * (i - k) + p]
    assert np.allclose(got, paired, atol=1e-5) and len(plain) > len(got)


def plain_mel(samples):
    """Frames x mels and energies of a short clip by sums over single samples and frequencies."""
    x = [(int(v) - 128) / 128 for v in samples]
    half = [[x[2 * i + p] for i in range(len(x) // 2)] for p in range(2)]
    taps = [[float(audio._lowpass()[2 * k + p]) for k in range(8)] for p in range(2)]
    signal = [sum(taps[p][k] * half[p][i - k] for p in range(2) for k in range(8) if i >= k) for i in range(len(x) // 2)]
    frames = max(1, math.ceil((len(signal) - 256) / 128) + 1)
    signal += [0.0] * ((frames - 1) * 128 + 256 - len(signal))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    step = (mel(4000) - mel(40)) / 33
    edges = [700 * (10 ** ((mel(40) + i * step) / 2595) - 1) for i in range(34)]
    out, energy = [], []
    for t in range(frames):
        part = [signal[t * 128 + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / 255)) for i in range(256)]
        energy.append(sum(v * v for v in part))
        power = [abs(sum(v * cmath.exp(-2j * math.pi * f * i / 256) for i, v in enumerate(part))) ** 2 for f in range(129)]
        row = []
        for m in range(32):
            low, mid, high = edges[m : m + 3]
            weights = [max(0.0, min((f * 31.25 - low) / (mid - low), (high - f * 31.25) / (high - mid))) for f in range(129)]
            row.append(math.log(sum(w * v for w, v in zip(weights, power)) + 1e-6))
        out.append(row)
    return np.array(out), np.array(energy)


def test_log_mel_and_summary_against_plain_sums():
    text = "The clip of this text is short but has more than one frame. " * 30
    media = audio.wav(audio.payload(text)[1])
    feature, spans, tensors = audio.described(media)
    mel, energy = plain_mel(audio.wav_samples(media))
    table = audio.read_tensors(tensors)
    got = np.concatenate([np.array(t.as_py() if hasattr(t, "as_py") else t, np.float32).reshape(audio.PATCH, audio.MELS) for t in table["log_mel"].combine_chunks().storage])
    assert np.allclose(got[: len(mel)], mel, atol=2e-3) and np.all(got[len(mel) :] == np.log(np.float32(1e-6)))
    assert spans == audio.segments(energy.astype(np.float32))
    parts = dict(x.split("=") for x in feature.split(";", 3))
    groups = mel.reshape(len(mel), 8, 4).mean(2)
    want = [v for pair in zip(groups.mean(0), groups.std(0)) for v in pair]
    numbers = [float(v) for v in feature.split("mel=")[1].replace(";", ",").split(",")]
    assert (int(parts["frames"]), int(parts["segments"])) == (len(mel), len(spans)) and np.allclose(numbers, want, atol=0.012)


def test_blocks_do_not_change_the_features():
    samples = np.random.Generator(np.random.PCG64(4)).integers(0, 256, 50_001).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*audio.blocks(samples, 10**6))]
    for size in (1, 7, 32, 64):
        parts = [np.concatenate(x) for x in zip(*audio.blocks(samples, size))]
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, parts))
    assert np.allclose(audio.resampled(samples, 100, 333), audio.resampled(samples)[100:333], atol=1e-6)


def test_memory_follows_the_clip_not_its_frames():
    media = audio.wav(bytes(range(256)) * (1 << 15))  # 8 MB
    tracemalloc.start()
    try:
        _, _, tensors = audio.described(media)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < len(media) * 2.5 + 3 * len(tensors) + (4 << 20)


def test_hysteresis():
    energy = np.array([1, 1, 9, 9, 3.2, 3, 1, 1, 9, 1], np.float32)
    spans = audio.segments(energy)
    assert len(spans) == 2 and spans[0][0] == 2 * audio.HOP / audio.OUT_RATE
