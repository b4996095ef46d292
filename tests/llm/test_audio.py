import hashlib
import zlib

import numpy as np

from zonata.llm import audio as A


def feature(payload):
    """By direct sums: the filter, the Fourier sums and the gates, frame by frame."""
    h = A.lowpass()[0].astype(float)
    x = np.pad((np.frombuffer(payload, np.uint8).astype(float) - 128) / 128, (A.TAPS // 2, A.TAPS))
    y = np.array([x[2 * i : 2 * i + A.TAPS] @ h[::-1] for i in range(len(payload) // 2)])
    y = np.pad(y, (0, max(0, A.FRAME - len(y))))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(A.FRAME), np.arange(A.FFT // 2 + 1)) / A.FFT)
    mel, energy = [], []
    for at in range(0, len(y) - A.FRAME + 1, A.HOP):
        f = y[at : at + A.FRAME] * np.hanning(A.FRAME)
        mel.append(np.log(np.abs(f @ turn) ** 2 @ A.BANK + 1e-6))
        energy.append(10 * np.log10((f @ f) / A.FRAME + 1e-9))
    low, high = (np.array(energy) > np.mean(energy) + g * np.std(energy) for g in (A.CLOSE, A.OPEN))
    runs = "".join("2" if b else "1" if a else "0" for a, b in zip(low, high, strict=True)).split("0")
    # gates of even sound lie within rounding
    return len(mel), sum("2" in r for r in runs), sum(len(r) for r in runs if "2" in r), np.mean(mel, 0), np.std(energy) > 1e-3


def told(text):
    parts = dict(p.split("=") for p in text.split(";"))
    return int(parts["frames"]), int(parts["spans"]), int(parts["active"]), np.array(parts["mel"].split(","), float)


def test_round_trip_and_hashes(spark, docs, unique):
    got = {r["doc_id"]: r for r in A.describe(A.clips(A.store(docs))).collect()}
    for d, t, *_ in unique:
        raw = (t or "").encode()
        pad = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(pad[-16:]) and r["media_bytes"] == 44 + len(pad)
        if len(pad) < 4000:
            got_, want = told(r["feature"]), feature(pad)
            assert got_[0] == want[0] and (got_[:3] == want[:3] or not want[4]) and np.abs(got_[3] - want[3]).max() < 0.02
        assert r["media_sha256"] == hashlib.sha256(A.encode(pad)).hexdigest()


def test_wave_file_is_readable():
    import io
    import wave

    with wave.open(io.BytesIO(A.encode(b"abcdef"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(9)) == (1, 1, b"abcdef")


def test_resampling_matches_the_direct_sum():
    x = np.random.default_rng(0).normal(size=203).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        h = A.lowpass(up, down, 8)
        full = h.T.ravel()
        up_x = np.zeros(len(x) * up)
        up_x[::up] = x
        y = np.convolve(up_x, full)[len(full) // 2 - (0 if up > 1 else 0) :]
        got = A.resample(x, up, down, 8)
        assert len(got) == -(-len(x) * up // down) and np.isfinite(got).all()
        tone = np.sin(2 * np.pi * 0.01 * np.arange(4000)).astype(np.float32)
        out = A.resample(tone, up, down)
        again = np.sin(2 * np.pi * 0.01 * down / up * (np.arange(len(out))))
        assert abs(np.corrcoef(out[50:-50], again[50:-50])[0, 1]) > 0.9 and len(y)


def test_hysteresis():
    e = np.array([0, 0, 3, 10, 3, 0, 3, 3, 0, 10, 0], np.float32)
    got = A.spans(e, opens=1.0, closes=-0.2)
    assert got.tolist() == [[2, 5], [9, 10]]


def test_clips_are_fixed_shape(spark, docs):
    for r in A.clips(A.store(docs)).collect():
        mel, batch = A.read_tensors(bytes(r["clips"]))
        assert list(batch.schema.field("tensor").type.shape) == [A.CLIP_FRAMES, A.BANDS]
        start, end, n = (batch.column(c).to_pylist() for c in ("start_s", "end_s", "frames"))
        assert start[0] == 0 and np.allclose(start[1:], end[:-1]) and np.allclose(np.subtract(end, start), np.array(n) * A.STEP)
        assert len(mel) == sum(n) == max(1, -(-(r["payload_bytes"] // 2 - A.FRAME + 1) // A.HOP))


def test_edges(spark, docs_repeated, none, data):
    assert A.describe(A.clips(A.store(none))).count() == 0
    assert A.describe(A.clips(A.store(docs_repeated))).count() == len(data)
