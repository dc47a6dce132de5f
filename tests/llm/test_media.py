"""Audio columns against direct formulas, and an exact round trip."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa

from weft.llm import media as M


def test_round_trip_and_contract_columns(spark):
    texts = ["", None, "a", "x" * 64, "é" * 33, "long " * 40000, "a", "\n\t"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "z")], "doc_id long, text string").selectExpr("*", "1 as feature", "2 as media")
    out = {r.doc_id: r for r in M.audio_features(docs, with_blobs=True).collect()}
    for i, t in [*enumerate(texts), (None, "z")]:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = out[i]
        assert r.n_bytes == len(raw) and r.payload_bytes == len(payload) and len(payload) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert M.from_wav(bytes(r.media)) == payload
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        batch = pa.ipc.open_stream(io.BytesIO(bytes(r.tensors))).read_all()
        assert batch.schema.field("log_mel").type.shape == [M.PATCH, M.MELS]
        assert batch["start_ms"].to_pylist() == [M.milliseconds(k * M.PATCH_STEP) for k in range(batch.num_rows)]
    assert out[2].feature == out[6].feature
    assert M.audio_features(docs.limit(0)).count() == 0


def test_resampling_matches_zero_stuffing():
    x = np.random.default_rng(2).normal(size=500).astype(np.float32)
    phases = M._phases()
    padded = np.concatenate([np.zeros(M.TAPS // 2), x, np.zeros(M.TAPS)])
    want = [padded[(n * M.DOWN // M.UP) :][: M.TAPS] @ phases[n * M.DOWN % M.UP] for n in range(-(-500 * M.UP // M.DOWN))]
    assert np.allclose(M.resample(x), want, atol=1e-5)


def test_log_mel_matches_a_direct_transform():
    x = np.random.default_rng(3).normal(size=1000).astype(np.float32)
    mels, energy = M.log_mel(x)
    frame = x[M.HOP : M.HOP + M.FRAME] * np.hanning(M.FRAME + 1)[:-1]
    k = np.arange(M.FRAME // 2 + 1)[:, None]
    spectrum = (frame * np.exp(-2j * np.pi * k * np.arange(M.FRAME) / M.FRAME)).sum(axis=1)
    assert np.allclose(mels[1], np.log(np.abs(spectrum) ** 2 @ M._mel_bank() + 1e-6), atol=1e-3)
    assert np.isclose(energy[1], np.log((frame**2).sum() + 1e-6), atol=1e-4)


def test_hysteresis():
    energy = np.array([0, 0, 0.06, 0.0, -0.04, -0.06, 0.0, 0.04, 0, 0, 0.2, 0.3, 0, 0, 0], dtype=np.float32)
    assert M.segments(energy) == [(2, 5), (10, 15)]
    assert M.segments(np.zeros(5, np.float32)) == []


def test_the_query_stores_and_reads_tensors(spark):
    texts = ["", "a", "long " * 40000, "middling text " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blobs = {r.doc_id: r for r in M.audio_features(docs, with_blobs=True).collect()}
    for r in M.audio_features(docs).collect():
        stored = bytes(blobs[r.doc_id].tensors)
        frames, n = M.from_tensors(stored, r.n_frames)
        assert r.tensor_sha256 == hashlib.sha256(stored).hexdigest() and r.n_patches == n == pa.ipc.open_stream(io.BytesIO(stored)).read_all().num_rows
        _, mels, _ = M.analyse(bytes(blobs[r.doc_id].media))
        assert frames.shape == mels.shape and np.allclose(frames, mels, atol=1e-3) and r.feature == blobs[r.doc_id].feature
