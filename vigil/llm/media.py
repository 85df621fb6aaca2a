"""Media columns: audio files in binary columns, and features from polyphase resampling, log-mel bands and segmentation.

A payload is stored losslessly as the samples of an 8-bit mono PCM WAV file. Features: the samples are resampled by a
rational factor with a windowed-sinc filter in polyphase form, overlapping Hann frames give log energies of triangular
mel bands, and frames are segmented by energy with hysteresis (a segment starts above the upper threshold and lasts
until below the lower one). Frames go into fixed-shape tensors [FRAMES, MELS], each with its time span, in an Arrow
stream; the feature digest is computed from the tensors read back from it. Samples of long audio are worked through in
blocks; a file's tensors (half the size of its samples) are held together.

Defined cases: null text is empty and gets one block of zeros as payload; equal texts have equal rows; a file shorter
than a frame is padded with silence to one frame; texts of any length are taken whole; a null or repeated doc_id is
returned as it is; further columns are kept, but those named like a feature are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 8
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 32
BLOCK = 4096  # frames that are worked on at once
PAD = 64


def to_payload(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono PCM; the payload's length is even, so no pad byte is needed."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def read_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono PCM WAV file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed sinc, cut off at the lower of the two Nyquist rates; one row per phase, latest sample first."""
    half = taps * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.hanning(len(n)) * up / max(up, down)
    h = np.r_[h, np.zeros(-len(h) % up)]
    return h.reshape(-1, up).T.copy()


class Audio:
    """Features of sample arrays at fixed parameters."""

    def __init__(self, rate: int = RATE, up: int = UP, down: int = DOWN):
        self.up, self.down = up, down
        self.phases = _filter(up, down, TAPS)
        self.delay = TAPS * max(up, down)
        self.rate = rate * up / down
        self.window = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(self.rate / 2), MELS + 2) / 2595) - 1)
        f = np.fft.rfftfreq(WINDOW, 1 / self.rate)
        rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
        fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
        self.bank = np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def resample(self, x: np.ndarray, a: int, b: int) -> np.ndarray:
        """Resampled samples a to b of signed bytes-as-samples ``x``; outside it is silence."""
        at = np.arange(a, b, dtype=np.int64) * self.down + self.delay
        phase, base = at % self.up, at // self.up
        k = self.phases.shape[1]
        lo = int(base[0]) - k + 1 if len(at) else 0
        hi = int(base[-1]) + 1 if len(at) else 0
        part = np.zeros(hi - lo, dtype=np.float32)
        s, e = max(lo, 0), min(hi, len(x))
        if e > s:
            part[s - lo : e - lo] = (x[s:e].astype(np.float32) - 128) / 128
        view = np.lib.stride_tricks.sliding_window_view(part, k)
        out = np.empty(len(at), dtype=np.float32)
        for p in range(self.up):
            mine = phase == p
            out[mine] = view[base[mine] - k + 1 - lo] @ self.phases[p][::-1].astype(np.float32)
        return out

    def frames(self, n: int) -> int:
        return max(1, 1 + (self.length(n) - WINDOW) // HOP)

    def log_mel(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(log mel energies [frames, MELS], log energy [frames]) block by block."""
        total = self.frames(len(x))
        for f in range(0, total, BLOCK):
            n = min(BLOCK, total - f)
            y = self.resample(x, f * HOP, f * HOP + (n - 1) * HOP + WINDOW)
            w = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * self.window
            power = np.abs(np.fft.rfft(w, axis=1)).astype(np.float32) ** 2
            yield np.log(power @ self.bank + 1e-6), np.log((w * w).mean(axis=1) + 1e-9)

    def segments(self, energy: np.ndarray, upper: float = 0.6, lower: float = 0.4) -> list[tuple[int, int]]:
        """Frame spans by hysteresis between two quantiles of the file's energy."""
        hi, lo = np.quantile(energy, [upper, lower])
        if hi <= lo:
            return [(0, len(energy))]
        start, stop = energy >= hi, energy < lo
        state = np.where(start, 1, np.where(stop, 0, -1))
        keep = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), 0))
        on = np.where(state[keep] == 1, 1, 0)
        edge = np.flatnonzero(np.diff(np.r_[0, on, 0]))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    def seconds(self, frame: int) -> float:
        return frame * HOP / self.rate


_loaded: list[Audio] = []


def audio() -> Audio:
    if not _loaded:
        _loaded.append(Audio())
    return _loaded[0]


def tensors(mels: np.ndarray) -> pa.ExtensionArray:
    """Arrow fixed-shape tensors [FRAMES, MELS]; the last is filled up with silence."""
    n = -(-len(mels) // FRAMES) * FRAMES
    full = np.full((n, MELS), np.float32(np.log(1e-6)), dtype=np.float32)
    full[: len(mels)] = mels
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(-1, FRAMES, MELS))


def _batch(mels: np.ndarray, a: Audio) -> bytes:
    """One Arrow stream with a fixed-shape tensor and its time span per row."""
    t = tensors(mels)
    start = [a.seconds(i * FRAMES) for i in range(len(t))]
    end = [a.seconds(min(len(mels), (i + 1) * FRAMES) - 1) + WINDOW / a.rate for i in range(len(t))]
    batch = pa.RecordBatch.from_arrays([t, pa.array(start, pa.float64()), pa.array(end, pa.float64())], ["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_wav(to_payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_tensors(stream: bytes) -> np.ndarray:
    """[tensors, FRAMES, MELS] of an Arrow stream that features() stored."""
    return pa.ipc.open_stream(stream).read_all().column("log_mel").combine_chunks().to_numpy_ndarray()


FEATURES = (
    ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"),
    ("spans", "array<struct<start_s:double,end_s:double>>"), ("feature", "string"), ("tensor_shape", "array<int>"), ("tensors", "binary"),
)


def features(media: DataFrame) -> DataFrame:
    """Features of a ``media`` column; all other columns are kept.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, spans (seconds), tensors (an Arrow stream
    of fixed-shape tensors with time spans), their shape, and feature (a digest of the tensors as read back).
    """
    kept = [f for f in media.schema if f.name != "media" and f.name not in dict(FEATURES)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in FEATURES])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string(), pa.list_(pa.int32()), pa.binary()]

    def row(raw: bytes, a: Audio) -> list:
        samples, _ = read_wav(raw)
        parts = [*a.log_mel(np.frombuffer(samples, dtype=np.uint8))]
        energy = np.concatenate([e for _, e in parts])
        spans, n = a.segments(energy), len(energy)
        stream = _batch(np.concatenate([p for p, _ in parts]), a)
        stored = read_tensors(stream)
        mels = stored.reshape(-1, MELS)[:n].astype(np.float64)
        code = np.clip(np.round(np.r_[mels.mean(axis=0), mels.std(axis=0)] * 8) + 128, 0, 255).astype(np.uint8).tobytes().hex()
        return [
            len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(),
            [{"start_s": a.seconds(s), "end_s": a.seconds(e - 1) + WINDOW / a.rate} for s, e in spans],
            f"{n}:{len(spans)}:{code}:{hashlib.sha256(stored.tobytes()).hexdigest()}", list(stored.shape), stream,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = audio()
        for b in batches:
            files = b.column(b.schema.get_field_index("media"))
            for i in range(0, max(1, len(files)), 256):  # tensors of a few files at a time
                part = b.slice(i, 256)
                rows = [row(m.as_py(), a) for m in files[i : i + 256]]
                cols = [part.column(b.schema.get_field_index(f.name)) for f in kept] + [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in kept] + [n for n, _ in FEATURES])

    return media.mapInArrow(run, schema)
