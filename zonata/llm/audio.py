"""Media columns: payloads stored as 8-bit PCM sound, read back, and turned into log-mel tensors and time spans.

`encode` stores bytes without loss as one-channel WAV (a byte is a sample). `read_back` returns the stored samples. `features`
resamples them by a polyphase filter, takes overlapped log-mel filterbank frames, and marks spans of energy with hysteresis.
`clips` writes fixed-shape Arrow tensors (CLIP_FRAMES x BANDS, 16-bit floats) with their time spans, a stream of clips for each
document; `describe` reads these again and derives the feature digest from them.

Defined results: null texts count as empty; an empty text is one block of 192 spaces; equal bytes give equal values; a text of
any length is worked on in blocks of frames. Repeated rows get a row each, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, pieces, with_id, with_id_text, written

BLOCK = 192
RATE, UP, DOWN, TAPS = 16_000, 1, 2, 24
FRAME, HOP, FFT, BANDS = 200, 80, 256, 20
CLIP_FRAMES = 64
#: Seconds from frame to frame.
STEP = HOP / (RATE * UP / DOWN)
#: Energy gates: deviations above and below the mean level at which a span opens and closes.
OPEN, CLOSE = 0.5, -0.5


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE bytes, one channel, 8 bits a sample."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def read_back(media: bytes) -> bytes:
    """The samples of the data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    return raw + b" " * (-len(raw) % block or (0 if raw else block))


def lowpass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Kaiser-windowed sinc, rows by phase: (up, taps)."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(n * cut) * np.kaiser(up * taps, 6.0)
    return (h * up / h.sum()).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output n uses phase n*down % up of the filter at input n*down // up."""
    h = lowpass(up, down, taps)
    n_out = -(-len(x) * up // down)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(x, (taps // 2, taps)), taps)
    out = np.empty(n_out, np.float32)
    for k in range(up):  # outputs k, k + up, ...: one phase each, inputs `down` apart
        first, phase = (k * down) // up, (k * down) % up
        rows = around[first :: down][: len(out[k::up])]
        out[k::up] = rows @ h[phase][::-1]
    return out


def mel_bank(rate: float, fft: int = FFT, bands: int = BANDS) -> np.ndarray:
    """Triangles, evenly spaced in mel: (fft // 2 + 1, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up, down = (f[:, None] - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f[:, None]) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


BANK = mel_bank(RATE * UP / DOWN)
TAPER = np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) of natural log mel energies and each frame's energy; frames overlap by FRAME - HOP."""
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, energy = np.empty((len(frames), BANDS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), block):
        part = frames[at : at + block] * TAPER
        spectrum = np.fft.rfft(part, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + block] = np.log(power @ BANK + 1e-6)
        energy[at : at + block] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    return mel, energy


def spans(energy: np.ndarray, opens: float = OPEN, closes: float = CLOSE) -> np.ndarray:
    """(n, 2) frame ranges that stay above the lower gate and reach the upper one."""
    level, spread = float(energy.mean()), float(energy.std())
    low, high = energy > level + closes * spread, energy > level + opens * spread
    edge = np.diff(np.concatenate(([0], low.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    reached = np.concatenate(([0], np.cumsum(high)))
    keep = reached[ends] > reached[starts]
    return np.stack([starts[keep], ends[keep]], 1)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and spans of frames of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    return mel, spans(energy)


def _stored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in pieces(frames, "text", 8_000_000):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [len(r) for r in raw], "media": [encode(padded(r)) for r in raw]})


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored form, to be written as a table."""
    return with_id(with_id_text(docs.select("doc_id", "text")).mapInPandas(_stored, "doc_id string, n_bytes long, media binary"))


def tensors(mel: np.ndarray, marked: np.ndarray) -> bytes:
    """Clips of CLIP_FRAMES frames as an Arrow stream: `tensor` of Arrow's fixed-shape tensor type (CLIP_FRAMES, BANDS), the last
    clip filled up with zeros; `frames`, those of its own; `start_s` and `end_s`, its time span; `active`, its frames within spans
    of energy; `opened`, the spans that start in it."""
    n = -(-len(mel) // CLIP_FRAMES)
    whole = np.zeros((n * CLIP_FRAMES, BANDS), np.float16)
    whole[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), (CLIP_FRAMES, BANDS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel(), pa.float16()), CLIP_FRAMES * BANDS)
    active, opened = np.zeros(n * CLIP_FRAMES + 1, np.int64), np.zeros(n * CLIP_FRAMES, np.int64)
    np.add.at(active, marked[:, 0], 1)
    np.add.at(active, marked[:, 1], -1)
    np.add.at(opened, marked[:, 0], 1)
    first, own = np.arange(n) * CLIP_FRAMES, np.minimum(CLIP_FRAMES, len(mel) - np.arange(n) * CLIP_FRAMES)
    batch = pa.record_batch({
        "tensor": pa.ExtensionArray.from_storage(kind, flat), "frames": pa.array(own, pa.int32()), "start_s": first * STEP, "end_s": (first + own) * STEP,
        "active": pa.array(np.cumsum(active)[:-1].reshape(n, -1).sum(1), pa.int32()), "opened": pa.array(opened.reshape(n, -1).sum(1), pa.int32()),
    })
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def read_tensors(stored: bytes) -> tuple[np.ndarray, pa.RecordBatch]:
    """The frames of all clips, (frames, BANDS), and the clips as stored."""
    batch = pa.ipc.open_stream(stored).read_next_batch()
    mel = batch.column("tensor").storage.flatten().to_numpy().reshape(-1, BANDS)
    return mel[: int(batch.column("frames").to_numpy().sum())], batch


def _clips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in pieces(frames, "media", 4_000_000):
        rows = []
        for doc_id, n_bytes, media in zip(part["doc_id"], part["n_bytes"], part["media"], strict=True):
            payload = read_back(media)
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), tensors(*features(payload))))
        yield pd.DataFrame(rows, columns=[*DIGESTS, "clips"])


DIGESTS = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
_SCHEMA = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def clips(media: DataFrame) -> DataFrame:
    """Sizes and hashes of each stored form, and clips: its tensors with their time spans, to be written as a table."""
    return with_id(with_id_text(media).select("doc_id", "n_bytes", "media").mapInPandas(_clips, f"{_SCHEMA}, clips binary"))


def digest(stored: bytes) -> str:
    """Frames, spans, active frames and mean log-mel by band, to three digits, of stored clips."""
    mel, batch = read_tensors(stored)
    means = ",".join(f"{v:.3f}" for v in mel.mean(0, dtype=np.float64) + 0.0)
    total = lambda name: int(batch.column(name).to_numpy().sum())
    return f"frames={len(mel)};spans={total('opened')};active={total('active')};mel={means}"


def describe(stored: DataFrame) -> DataFrame:
    """Sizes, hashes and the feature digest of the stored clips."""

    def digests(column: pd.Series) -> pd.Series:
        return pd.Series([digest(x) for x in column])

    return stored.select(*DIGESTS, F.pandas_udf(digests, "string")("clips").alias("feature"))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(written(clips(written(store(documents(spark, sf_dir)), "media")), "clips"))


QUERIES = {"op5_audio": op5_audio}
SQL: dict[str, str] = {}
