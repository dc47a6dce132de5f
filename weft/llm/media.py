"""Media columns: whole texts stored as 8-bit PCM audio, and log-mel tensors with time spans from the stored bytes."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, whole_text

#: Payload bytes are padded to a multiple of this.
ALIGN = 64
RATE = 8000
#: Polyphase resampling by UP / DOWN, with TAPS filter taps in each phase.
UP, DOWN, TAPS = 2, 3, 16
#: Analysis frames of the resampled signal.
FRAME, HOP, MELS = 256, 128, 16
#: Frames of one stored tensor and the step between tensors.
PATCH, PATCH_STEP = 32, 16
#: Hysteresis, in natural log energy above the clip's median: a segment starts at ON and ends below OFF.
ON, OFF = 0.05, -0.05
#: Resampled frames handled at once, so that a very long clip takes bounded memory.
CHUNK = 1 << 17


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of ALIGN."""
    return data + bytes(max(1, -(-len(data) // ALIGN)) * ALIGN - len(data))


def to_wav(payload: bytes) -> bytes:
    """The payload as mono unsigned 8-bit PCM in a WAV container."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


@lru_cache(1)
def _phases() -> np.ndarray:
    """Windowed-sinc low-pass split into UP phases: (UP, TAPS), each phase summing to one."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(t * cut) * cut * np.hamming(n)
    phases = taps.reshape(TAPS, UP).T[:, ::-1].copy()
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN: output n takes phase n*DOWN % UP at input n*DOWN // UP."""
    phases, n_out = _phases(), -(-len(samples) * UP // DOWN)
    padded_in = np.concatenate([np.zeros(TAPS // 2, np.float32), samples, np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded_in, TAPS)
    out = np.empty(n_out, np.float32)
    for phase in range(UP):
        n = np.arange(phase, n_out, UP)  # UP consecutive outputs use every phase once
        p = phase * DOWN % UP
        starts = n * DOWN // UP
        if len(n):
            step = DOWN
            out[phase::UP] = windows[starts[0] : starts[-1] + 1 : step] @ phases[p]
    return out


@lru_cache(1)
def _mel_bank() -> np.ndarray:
    """(FRAME // 2 + 1, MELS) triangular filters, equally spaced on the mel scale."""
    top = RATE * UP / DOWN / 2
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    hz = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise = (hz - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS) of overlapped Hann frames and the log energy of each frame."""
    n = max(1, 1 + -(-max(0, len(signal) - FRAME) // HOP))
    signal = np.concatenate([signal, np.zeros((n - 1) * HOP + FRAME - len(signal), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window, bank = np.hanning(FRAME + 1)[:-1].astype(np.float32), _mel_bank()
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    step = max(1, CHUNK // FRAME)
    for at in range(0, n, step):
        part = frames[at : at + step] * window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[at : at + step] = np.log(power.astype(np.float32) @ bank + 1e-6)
        energy[at : at + step] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [start, end) that start where energy reaches ON and end before it falls under OFF."""
    level = energy - np.median(energy)
    marks = np.where(level >= ON, 1, np.where(level < OFF, -1, 0))
    last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
    state = np.where(last >= 0, marks[np.maximum(last, 0)], -1) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, state, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def milliseconds(frame: int) -> int:
    """Start of a frame in milliseconds of the stored clip."""
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def tensors(mels: np.ndarray) -> bytes:
    """Overlapped patches as one Arrow record batch: a fixed-shape tensor column and its time spans."""
    starts = list(range(0, max(1, len(mels) - PATCH + PATCH_STEP), PATCH_STEP)) if len(mels) > PATCH else [0]
    need = starts[-1] + PATCH
    full = np.concatenate([mels, np.full((max(0, need - len(mels)), MELS), np.log(np.float32(1e-6)), np.float32)])
    patches = np.stack([full[s : s + PATCH] for s in starts])
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(patches)
    spans = [pa.array([milliseconds(s) for s in starts], pa.int64()), pa.array([milliseconds(s + PATCH) for s in starts], pa.int64())]
    batch = pa.RecordBatch.from_arrays([column, *spans], ["log_mel", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def from_tensors(stored: bytes, n_frames: int) -> tuple[np.ndarray, int]:
    """Stored tensors to (log-mel frames, number of patches): each patch gives the frames that those before it lack."""
    with pa.ipc.open_stream(io.BytesIO(stored)) as reader:
        batch = reader.read_all().combine_chunks().to_batches()[0]
    patches = batch.column("log_mel").to_numpy_ndarray()
    starts = batch.column("start_ms").to_pylist()
    if starts != [milliseconds(k * PATCH_STEP) for k in range(len(patches))]:
        raise ValueError("stored patches are not in steps of PATCH_STEP")
    frames = np.concatenate([patches[0], patches[1:, PATCH - PATCH_STEP :].reshape(-1, MELS)])
    return frames[:n_frames], len(patches)


def analyse(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Stored bytes to (payload, log-mel frames, segments)."""
    payload = from_wav(media)
    signal = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    mels, energy = log_mel(signal)
    return payload, mels, segments(energy)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, spans array<struct<start_ms:long,end_ms:long>>, n_patches int, tensor_sha256 string"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_blobs: bool = False) -> DataFrame:
    """One row per document: its whole text stored as audio, read back, and the features of what was read.

    The text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, are unsigned 8-bit samples of a WAV
    file. The samples read back are resampled by 2/3 with a polyphase filter, cut into overlapped frames, taken
    to log-mel energies and segmented by energy with hysteresis. The frames are stored as tensors, an Arrow stream with
    a fixed-shape tensor column log_mel and start_ms, end_ms of each patch, and read back: feature sums up what was
    read (frames, segments, voiced milliseconds, mean of each log-mel band), n_patches and tensor_sha256 describe the
    stored tensors; spans are the segments. with_blobs adds media (the WAV bytes) and tensors.

    Null text is the empty text, so 64 zero bytes. Null ids, repeated rows and rows of equal text are kept, the
    latter with equal values; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for id_, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                media = to_wav(padded(raw))
                payload, mels, found = analyse(media)
                spans = [{"start_ms": milliseconds(a), "end_ms": milliseconds(b)} for a, b in found]
                voiced = sum(s["end_ms"] - s["start_ms"] for s in spans)
                stored = tensors(mels)
                frames, n_patches = from_tensors(stored, len(mels))
                bands = ",".join(f"{round(float(x), 2) + 0.0:.2f}" for x in frames.mean(axis=0, dtype=np.float64))
                feature = f"frames={len(frames)};segments={len(found)};voiced_ms={voiced};log_mel={bands}"
                row = (id_.as_py(), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), spans, n_patches, hashlib.sha256(stored).hexdigest())
                rows.append((*row, media, stored) if with_blobs else row)
                if with_blobs and sum(len(r[-1]) + len(r[-2]) for r in rows) > 1 << 25:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    span = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("spans", pa.list_(span)), ("n_patches", pa.int32()), ("tensor_sha256", pa.string())]
    schema += [("media", pa.binary()), ("tensors", pa.binary())] if with_blobs else []
    arrow_rows(docs.sparkSession, 256)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, SCHEMA + (", media binary, tensors binary" if with_blobs else ""))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, (_, t) in zip(zip(*rows), schema)], [n for n, _ in schema])
