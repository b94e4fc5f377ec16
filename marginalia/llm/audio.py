"""Audio media columns: stored samples, polyphase resampling, log-mel tensors, activity spans.

A payload becomes an 8-bit mono PCM WAV column (:func:`media_table`).  Features
are computed from the samples read back out of that container: the signal is
resampled by a polyphase filter, cut into overlapped Hann frames, projected on
a mel filterbank and grouped into windows of a fixed number of frames, so each
window is one fixed-shape tensor with a time span.  Windows are stored as Arrow
streams with a fixed-shape tensor column, some hundred documents a row
(:func:`feature_store`, :func:`read_features`), or as plain rows
(:func:`feature_table`, :func:`tensors`).  Speech-like activity comes from frame
energy with two thresholds: a segment opens above the upper one and closes below
the lower one.

Every row is computed alone, in frame blocks of bounded size, so nothing is
shuffled and a lost executor costs only its own tasks.

Defined results: a null text is the empty text; its payload is one block of
padding.  Repeated rows give repeated results, an empty table none, and other
columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import runtime

BLOCK = 576
PAD = b"\xff"
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class Spec:
    """Rates in hertz, sizes in samples of the target rate."""

    source_rate: int = 16_000
    target_rate: int = 8_000
    taps: int = 24
    frame: int = 256
    hop: int = 128
    bands: int = 32
    window: int = 64
    opens: float = 0.6
    closes: float = 0.4


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded to a positive multiple of the block, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    short = -len(raw) % BLOCK if raw else BLOCK
    return raw + PAD * short, len(raw)


def to_wav(payload: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF container (a pad byte evens the chunk)."""
    size = len(payload)
    head = _HEADER.pack(b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size)
    return head + payload + b"\0" * (size % 2)


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono container, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _filter_bank(up: int, down: int, taps: int) -> np.ndarray:
    """Low-pass prototype (Kaiser-windowed sinc) split into ``up`` phases of ``taps``."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1.0 / max(up, down)
    proto = np.sinc(n * cut) * cut * np.kaiser(up * taps, 8.0)
    proto *= up / proto.sum()
    return proto.reshape(taps, up).T[:, ::-1].copy()


def resample(samples: np.ndarray, source_rate: int, target_rate: int, taps: int = 24) -> np.ndarray:
    """Rational-rate conversion; only samples that are kept are computed."""
    common = np.gcd(source_rate, target_rate)
    up, down = target_rate // common, source_rate // common
    bank = _filter_bank(int(up), int(down), taps)
    padded = np.concatenate([np.zeros(taps - 1 - taps // 2), samples, np.zeros(taps)])
    n_out = -(-len(samples) * up // down)
    out = np.zeros(n_out)
    for first in range(min(up, n_out)):
        phase, base = first * down % up, first * down // up
        share = out[first::up]
        for tap in range(taps):
            share += bank[phase, tap] * padded[base + tap :: down][: len(share)]
    return out


@functools.cache
def _mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None).T


def log_mel(signal: np.ndarray, spec: Spec, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energy in decibel of each overlapped frame; zeros fill up the last."""
    short = spec.frame - len(signal) if len(signal) < spec.frame else (spec.frame - len(signal)) % spec.hop
    signal = np.concatenate([signal, np.zeros(short)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, spec.frame)[:: spec.hop]
    taper, bank = np.hanning(spec.frame), _mel_bank(spec.target_rate, spec.frame, spec.bands)
    mels, energy = np.empty((len(frames), spec.bands), np.float32), np.empty(len(frames))
    for at in range(0, len(frames), block):
        part = frames[at : at + block]
        spectrum = np.fft.rfft(part * taper, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[at : at + block] = np.log10(power @ bank + 1e-10)
        energy[at : at + block] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / spec.frame + 1e-10)
    return mels, energy


def active(energy: np.ndarray, opens: float, closes: float) -> np.ndarray:
    """(first, after-last) frames of segments, by hysteresis between two levels of the range."""
    low, high = energy.min(), energy.max()
    if high - low < 1e-9:
        return np.empty((0, 2), np.int64)
    verdict = np.where(energy >= low + opens * (high - low), 1, np.where(energy < low + closes * (high - low), 0, -1))
    told = np.where(verdict >= 0, np.arange(len(verdict)), -1)
    last = np.maximum.accumulate(told)
    on = np.where(last >= 0, verdict[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


@dataclass
class Features:
    tensors: np.ndarray  # windows x frames x bands, float32
    spans: np.ndarray  # windows x 2, seconds
    segments: np.ndarray  # segments x 2, seconds
    n_frames: int

    def digest(self, stored: np.ndarray | None = None) -> str:
        """Counts, the active share, and a hash of the tensors (as read back, where given) in hundredths."""
        held = self.tensors if stored is None else stored
        steps = np.rint(held * 100).astype("<i2")
        busy = float((self.segments[:, 1] - self.segments[:, 0]).sum())
        return f"frames={self.n_frames};windows={len(held)};segments={len(self.segments)};active={busy:.3f};mel={hashlib.sha1(steps.tobytes()).hexdigest()}"


def analyse(rate: int, payload: bytes, spec: Spec) -> Features:
    """All features of stored samples."""
    samples = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mels, energy = log_mel(resample(samples, rate, spec.target_rate, spec.taps), spec)
    n = len(mels)
    windows = -(-n // spec.window)
    tensors = np.full((windows * spec.window, spec.bands), np.float32(-10))
    tensors[:n] = mels
    step = spec.hop / spec.target_rate
    first = np.arange(windows) * spec.window
    spans = np.stack([first * step, (np.minimum(first + spec.window, n) - 1) * step + spec.frame / spec.target_rate], axis=1)
    segments = active(energy, spec.opens, spec.closes) * step
    return Features(tensors.reshape(windows, spec.window, spec.bands), spans, segments, n)


def media_table(docs: DataFrame, *, spec: Spec = Spec()) -> DataFrame:
    """doc_id, the stored WAV column and the number of unpadded bytes."""
    runtime.ship(docs.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [payload_of(text.as_py()) for text in part.column(1)]
                media = [to_wav(payload, spec.source_rate) for payload, _ in held]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary()), pa.array([n for _, n in held], pa.int64())], names=["doc_id", "media", "n_bytes"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(store, "doc_id bigint, media binary, n_bytes bigint")


def feature_table(media: DataFrame, *, spec: Spec = Spec()) -> DataFrame:
    """One row per window: doc_id, window, start_s, end_s and the flat tensor."""
    runtime.ship(media.sparkSession)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            for doc_id, stored in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = analyse(*from_wav(stored.as_py()), spec)
                n = len(got.tensors)
                flat = pa.array(list(got.tensors.reshape(n, -1)), kind)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(got.spans[:, 0]), pa.array(got.spans[:, 1]), flat], names=["doc_id", "window", "start_s", "end_s", "tensor"])

    return media.select("doc_id", "media").mapInArrow(windows, "doc_id bigint, window int, start_s double, end_s double, tensor array<float>")


def tensors(table: pa.Table, spec: Spec = Spec()) -> pa.FixedShapeTensorArray:
    """The ``tensor`` column of collected or reread windows as Arrow's fixed-shape tensors."""
    shape = (spec.window, spec.bands)
    flat = pa.concat_arrays([c.flatten() for c in table.column("tensor").chunks]) if table.num_rows else pa.array([], pa.float32())
    held = pa.FixedSizeListArray.from_arrays(flat.cast(pa.float32()), shape[0] * shape[1])
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), held)


def window_stream(doc_ids: list, features: list[Features], spec: Spec = Spec()) -> bytes:
    """The windows of some documents as an Arrow stream: doc_id, document's place, window, time span and tensor."""
    counts = [len(f.tensors) for f in features]
    flat = np.concatenate([f.tensors.reshape(-1) for f in features])
    shape = (spec.window, spec.bands)
    held = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), shape[0] * shape[1])
    spans = np.concatenate([f.spans for f in features])
    columns = {
        "doc_id": pa.array(np.repeat(np.array([0 if i is None else i for i in doc_ids], np.int64), counts), mask=np.repeat([i is None for i in doc_ids], counts)),
        "place": pa.array(np.repeat(np.arange(len(counts), dtype=np.int32), counts)),
        "window": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
        "start_s": pa.array(spans[:, 0]),
        "end_s": pa.array(spans[:, 1]),
        "tensor": pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), held),
    }
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_features(stream: bytes) -> pa.Table:
    """The windows in a stored stream; ``tensor`` is a fixed-shape tensor column."""
    with pa.ipc.open_stream(stream) as held:
        return held.read_all()


def feature_store(media: DataFrame, *, spec: Spec = Spec(), documents: int = 256) -> DataFrame:
    """Rows ``documents, windows, stream``: the windows of up to ``documents`` rows of ``media`` each."""
    runtime.ship(media.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, documents) for batch in batches for at in range(0, batch.num_rows, documents)):
            got = [analyse(*from_wav(held.as_py()), spec) for held in part.column(1)]
            sizes = [pa.array([len(got)], pa.int32()), pa.array([sum(len(f.tensors) for f in got)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*sizes, pa.array([window_stream(part.column(0).to_pylist(), got, spec)], pa.binary())], names=["documents", "windows", "stream"])

    return media.select("doc_id", "media").mapInArrow(store, "documents int, windows bigint, stream binary")


def audio_digest(docs: DataFrame, *, spec: Spec = Spec()) -> DataFrame:
    """Per document: the stored form's and the payload's digests, and a feature string."""
    runtime.ship(docs.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [part.split()[0] for part in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64)):
            rows, got = [], []
            for stored, n_bytes in zip(part.column(1), part.column(2).to_pylist()):
                media = stored.as_py()
                rate, payload = from_wav(media)
                got.append(analyse(rate, payload, spec))
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
            windows = read_features(window_stream(part.column(0).to_pylist(), got, spec))
            held = windows.column("tensor").combine_chunks().to_numpy_ndarray()
            edges = np.searchsorted(np.asarray(windows.column("place")), np.arange(len(got) + 1))
            features = [f.digest(held[a:b]) for f, a, b in zip(got, edges, edges[1:])]
            columns = [[*column] for column in zip(*rows)] + [features]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]], names=names)

    # Stored in the shared folder and read back, as media tables are in use; samples of texts take two thirds of the room as zstd.
    return runtime.materialize(media_table(docs, spec=spec), "media", compression="zstd").mapInArrow(read, schema)
