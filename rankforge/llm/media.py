"""Media columns: audio stored losslessly, with log-mel tensors and speech-like segments.

A text's UTF-8 bytes, padded with blanks to a multiple of ``UNIT``, are the 8-bit
samples of a mono WAV stream. Features are computed from the samples read back:
polyphase resampling by ``UP``/``DOWN``, overlapped frames under a Hann window, a
mel filterbank, logarithms; segments are runs of frames whose energy passes a high
threshold, extended as long as it stays above a low one (hysteresis).

Log-mel frames are kept as fixed-shape tensors (``FRAMES`` x ``MELS``, the last one
padded with the floor), each with the time span that it covers.

Corner cases: null text is empty, and empty text one unit of blanks; equal texts
have equal values, as each text is computed alone; repeated rows give repeated
rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.workspace import bounded_batches, releasing

UNIT, RATE = 192, 16_000
UP, DOWN, TAPS = 1, 2, 16
WINDOW, HOP, MELS, FRAMES = 256, 128, 16, 32
FLOOR = -10.0
#: Bytes of results that one Arrow batch gathers.
BATCH_BYTES = 4 << 20

COLUMNS = "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>, n_frames long"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(data: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit PCM stream; chunks other than fmt and data are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV stream")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM")
        elif kind == b"data":
            return data[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> list[np.ndarray]:
    """A windowed-sinc low pass, split into one filter for each output phase."""
    n = TAPS * max(UP, DOWN)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) / max(UP, DOWN) * np.hamming(n) * UP
    return [np.ascontiguousarray(h[p::UP]).astype(np.float32) for p in range(UP)]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP/DOWN: every output needs the taps of its own phase only."""
    count = -(-len(x) * UP // DOWN)
    out = np.empty(count, np.float32)
    for p, h in enumerate(_phases()):
        which = np.flatnonzero((np.arange(min(count, UP)) * DOWN) % UP == p)
        for first in which:
            at, n = int(first) * DOWN // UP, -(-(count - int(first)) // UP)
            # From one output of a phase to its next, the input advances by DOWN samples.
            padded = np.pad(x, (len(h) // 2, len(h) + DOWN))
            out[first::UP] = np.lib.stride_tricks.sliding_window_view(padded, len(h))[at : at + DOWN * n : DOWN][:n] @ h[::-1]
    return out


@cache
def _filters() -> tuple[np.ndarray, np.ndarray]:
    """(Hann window, mel filterbank: frequencies x MELS)."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS; the signal is padded so that every sample is in a frame."""
    n = max(1, -(-max(0, len(y) - WINDOW) // HOP) + 1)
    y = np.pad(y, (0, (n - 1) * HOP + WINDOW - len(y)))
    hann, bank = _filters()
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for s in range(0, n, 512):
        spectrum = np.fft.rfft(frames[s : s + 512] * hann)
        out[s : s + 512] = np.log10(np.maximum((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank, 10**FLOOR))
    return out


def segment(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last) of frames above the low threshold that pass the high one somewhere."""
    mean, spread = float(energy.mean()), float(energy.std())
    low, high = energy >= mean - 0.5 * spread, energy >= mean + 0.5 * spread
    edge = np.flatnonzero(np.diff(np.r_[0, low.astype(np.int8), 0]))
    passed = np.r_[0, np.cumsum(high)]
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if passed[b] > passed[a]]


def analyse(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]], int]:
    """(tensors, their time spans, segments in seconds, frames) of a stored stream."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    seconds = DOWN / UP / rate
    n = -(-len(mel) // FRAMES)
    tensors = np.full((n * FRAMES, MELS), FLOOR, np.float32)
    tensors[: len(mel)] = mel
    end = len(samples) / rate
    spans = [(i * FRAMES * HOP * seconds, min(end, (min((i + 1) * FRAMES, len(mel)) - 1) * HOP * seconds + WINDOW * seconds)) for i in range(n)]
    parts = [(a * HOP * seconds, min(end, ((b - 1) * HOP + WINDOW) * seconds)) for a, b in segment(mel.mean(1))]
    return tensors.reshape(n, FRAMES * MELS), spans, parts, len(mel)


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


@cache
def stream_schema() -> pa.Schema:
    return pa.schema([("tensor", tensor_type()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def to_stream(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of fixed-shape tensors with their time spans. Spark has no extension types, so a column holds it as bytes."""
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), FRAMES * MELS)
    times = np.array(spans, np.float64).reshape(-1, 2)
    columns = [pa.ExtensionArray.from_storage(tensor_type(), storage), pa.array(times[:, 0]), pa.array(times[:, 1])]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, stream_schema()) as writer:
        writer.write_batch(pa.record_batch(columns, schema=stream_schema()))
    return sink.getvalue().to_pybytes()


def from_stream(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tensors, tensors x FRAMES x MELS; their time spans, tensors x 2)."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    tensor = table["tensor"].chunk(0).to_numpy_ndarray() if table.num_rows else np.empty((0, FRAMES, MELS), np.float32)
    return tensor, np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for b in batches:
        ids = b.column(0)
        for i, t in enumerate(b.column(1)):
            yield ids[i].as_py(), t.as_py()


def _seconds(pairs: list[tuple[float, float]]) -> list[dict]:
    return [{"start_s": a, "end_s": b} for a, b in pairs]


def audio_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded), media (WAV), tensors (``to_stream``), segments, n_frames of every text."""
    bounded_batches(docs.sparkSession)
    seconds = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tensors", pa.binary()), ("segments", seconds), ("n_frames", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for doc, text in _texts(batches):
            media = to_wav(payload_of(text))
            tensors, spans, parts, frames = analyse(media)
            stream = to_stream(tensors, spans)
            rows.append((doc, len((text or "").encode("utf-8", "surrogatepass")), media, stream, _seconds(parts), frames))
            held += len(media) + len(stream)
            if held > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), COLUMNS)


def digests(media: DataFrame) -> DataFrame:
    """What the stored streams hold, read back, and a short text of their features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, data, tensors, parts, frames in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload, _ = from_wav(data)
                mel = from_stream(tensors)[0].reshape(-1, MELS)[:frames]
                mean = ",".join(f"{v:.2f}" for v in mel.mean(0, dtype=np.float64))
                spoken = sum(p["end_s"] - p["start_s"] for p in parts)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={frames};segments={len(parts)};spoken_s={spoken:.3f};mel={mean}"))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media", "tensors", "segments", "n_frames").mapInArrow(releasing(run), schema)
