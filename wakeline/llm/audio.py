"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

Three tables, each written to the shared folder before the next is made from what is read back: media (a WAV file of
unsigned 8-bit mono samples, lossless, in a binary column), features of the media, and a digest of both. A windowed-sinc
polyphase filter resamples by UP/DOWN, frames of FRAME samples every HOP are taken to BANDS log-mel energies, and frames
become segments where the energy rises above HIGH and until it falls below LOW decibels relative to the file's median
frame. Samples after the last whole frame are padded with silence to one more frame, so every sample is in a frame.
Log-mel frames are stored as fixed-shape Arrow tensors [TENSOR_FRAMES, BANDS] with the time span that each covers; the
last one is padded with NaN.

Samples are handled in blocks of BLOCK, so arrays stay bounded for long media; a file's features don't depend on which
other rows are in the batch. All sums are in double precision: in single precision, quiet bands depend on the order in
which a machine's linear algebra adds, and equal texts could get different features. Tensors hold the results in half
precision (log energies within 0.004). A very long text is one value of a binary column, up to Arrow's 2 GB.

Defined results: an empty table gives no rows; a null text is empty; an empty payload is one unit of padding; media
shorter than a frame is one frame padded with silence; repeated rows have equal values; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_ID, TEXT, text_column, written

RATE, UP, DOWN = 8000, 3, 4
TAPS = 8  # per phase and side
FRAME, HOP, BANDS = 256, 128, 24
HIGH, LOW = 1.0, -0.5
UNIT, PAD = 192, b" "
BLOCK = 1 << 18
TENSOR_FRAMES = 64
OUT_RATE = RATE * UP // DOWN
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors array<struct<start_s: double, end_s: double, n_frames: int, tensor: binary>>, segments array<struct<start_s: double, end_s: double>>"


def padded(text: bytes) -> bytes:
    return text + PAD * ((-len(text)) % UNIT or (0 if text else UNIT))


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono WAV file; chunks in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError(f"not 8-bit mono PCM: {(form, channels, bits)}")
        elif kind == b"data" and rate is not None:
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def _phases() -> np.ndarray:
    """UP filters of 2 * TAPS coefficients; each sums to 1."""
    n = np.arange(2 * TAPS * UP) - TAPS * UP
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * np.hanning(2 * TAPS * UP + 1)[:-1]
    h = h.reshape(2 * TAPS, UP).T
    return h / h.sum(1, keepdims=True)


def _mel() -> np.ndarray:
    """FRAME // 2 + 1 x BANDS triangular filters."""
    top = 2595 * np.log10(1 + OUT_RATE / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


_PHASES, _MEL, _WINDOW = _phases(), _mel(), np.hanning(FRAME + 1)[:-1]


def resample(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of samples at RATE * UP / DOWN. Output m stands at input place m * DOWN / UP; only its phase's taps are used."""
    n = len(samples)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        left, right = max(0, lo - TAPS), min(n, hi + TAPS + DOWN)
        x = np.zeros(hi - lo + 2 * TAPS + DOWN)
        x[left - (lo - TAPS) : right - (lo - TAPS)] = (samples[left:right].astype(np.float64) - 128) / 128
        views = np.lib.stride_tricks.sliding_window_view(x, 2 * TAPS)
        groups = -(-(hi - lo) // DOWN)
        out = np.empty((groups, UP))
        for phase in range(UP):
            base = phase * DOWN // UP + 1
            # taps run against time: the filter's centre lies on the input place
            out[:, phase] = views[base : base + groups * DOWN : DOWN][:groups] @ _PHASES[(phase * DOWN) % UP][::-1]
        yield out.reshape(-1)[: -(-(hi - lo) * UP // DOWN)]


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """frames x BANDS log energies, and each frame's level in decibels."""
    rest, mels, levels = np.zeros(0), [], []

    def take(y: np.ndarray) -> None:
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mels.append(np.log(power @ _MEL + 1e-6))
        levels.append(10 * np.log10((frames**2).mean(1) + 1e-10))

    for y in resample(samples):
        rest = np.concatenate([rest, y])
        if len(rest) >= FRAME:
            take(rest)
            rest = rest[((len(rest) - FRAME) // HOP + 1) * HOP :]
    if not mels or len(rest) > FRAME - HOP:  # samples that no frame has: one more, padded with silence
        take(np.concatenate([rest, np.zeros(FRAME - len(rest))]))
    return np.concatenate(mels), np.concatenate(levels)


def segments(levels: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds from a frame above HIGH until one below LOW, relative to the median level."""
    x = levels - np.median(levels)
    mark = np.where(x >= HIGH, 1, np.where(x <= LOW, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, np.where(last >= 0, mark[last], -1) > 0, False]
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    return [(float(a * HOP / OUT_RATE), float(b * HOP / OUT_RATE)) for a, b in edges]


_SPAN = [("start_s", pa.float64()), ("end_s", pa.float64())]
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("tensors", pa.list_(pa.struct([*_SPAN, ("n_frames", pa.int32()), ("tensor", pa.binary())]))), ("segments", pa.list_(pa.struct(_SPAN))),
])


class Features(NamedTuple):
    mel: np.ndarray
    spans: list[tuple[float, float]]


def features(media: bytes) -> Features:
    rate, samples = decode_wav(media)
    if rate != RATE:
        raise ValueError(f"rate {rate}, not {RATE}")
    mel, levels = log_mel(np.frombuffer(samples, np.uint8))
    return Features(mel, segments(levels))


def tensor_bytes(mel: np.ndarray) -> bytes:
    """An Arrow stream of one fixed-shape tensor [TENSOR_FRAMES, BANDS]; missing frames are NaN."""
    full = np.full((1, TENSOR_FRAMES, BANDS), np.nan, np.float16)
    full[0, : len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full)
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([column], names=["mel"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensor(raw: bytes) -> np.ndarray:
    with pa.ipc.open_stream(raw) as r:
        return r.read_all().column("mel").combine_chunks().to_numpy_ndarray()[0]


def summary(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    mean = ",".join(f"{v:.2f}" for v in mel.mean(0, dtype=np.float64))
    return f"frames={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};mel={mean}"


def _batches(rows: Iterator[tuple], kinds: pa.Schema, sizes: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of `sizes`."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == sizes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_buffer().to_pybytes() for t in text_column(b, TEXT))
            yield from _batches(((i, len(t), encode_wav(padded(t))) for i, t in zip(b.column(0).to_pylist(), texts, strict=True)), _MEDIA, 256)

    return docs.select(F.col(DOC_ID).cast("long").alias(DOC_ID), TEXT).mapInArrow(run, MEDIA)


def extract(stored: DataFrame) -> DataFrame:
    """Digests, tensors with the seconds that each covers, and segments, of rows (doc_id, n_bytes, media)."""

    def row(doc: int | None, n: int, raw: bytes) -> tuple:
        payload, f = decode_wav(raw)[1], features(raw)
        tensors = []
        for i in range(0, len(f.mel), TENSOR_FRAMES):
            part = f.mel[i : i + TENSOR_FRAMES]
            tensors.append({"start_s": i * HOP / OUT_RATE, "end_s": ((i + len(part) - 1) * HOP + FRAME) / OUT_RATE, "n_frames": len(part), "tensor": tensor_bytes(part)})
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), tensors, [{"start_s": a, "end_s": b} for a, b in f.spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches((row(i, n, x.as_buffer().to_pybytes()) for i, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)), _FEATURES, 64)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The media table and the feature table, both written to the shared folder and read back."""
    stored = written(media(docs), "media", "zstd")
    return stored, written(extract(stored), "features", "zstd")


def describe(docs: DataFrame) -> DataFrame:
    """One row per document: digests of the payload read back and of its stored form, and a summary of the stored features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for tensors, spans in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                mel = np.concatenate([read_tensor(t["tensor"].as_py())[: t["n_frames"].as_py()] for t in tensors])
                said.append(summary(mel, [(x["start_s"], x["end_s"]) for x in spans.as_py()]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(said, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return store(docs)[1].mapInArrow(run, RESULT)
