"""Audio features of 8-bit PCM media columns.

A payload is stored as an 8-bit mono WAV file, which is lossless. Features are computed from the samples read back
from that file: polyphase resampling, overlapped log-mel filterbanks, and energy segmentation with hysteresis.
The log-mel frames become fixed-shape Arrow tensors, each with its time span.

`featurize` returns media, tensors and segments as columns. `materialise` stores them: each task writes its media as an
Arrow file, reads the file again to compute features of what is stored, writes those as a second Arrow file (a row a
tensor), and reads both back to describe them. Batches are written and read one at a time, so a task holds about
one slice of texts whatever its partition's size. Files are written under a name of the attempt's own and then renamed, so a
lost or doubled task leaves whole files. Nothing is shared between rows, so equal payloads have equal features.

Defined cases: null and empty texts are one padded block of zero bytes; very long texts are one row of media and as many
tensors as they need; null ids stay null; repeated rows are alike; an empty table gives an empty result and no files; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from planproof.llm.common import file_system, prepare, scoped, shared_path, text_chunks

RATE, TARGET = 16_000, 8_000
WIN, HOP, FFT, MELS = 200, 80, 256, 40
TENSOR_FRAMES = 64
PAD = 64
#: Decibels over a file's median energy at which a segment begins, and under which it ends.
RISE, FALL = 3.0, 0.0
TAPS = 16
#: Log-mel values are multiples of this (0.16 dB), so the noise below it takes no space.
STEP = np.float32(1 / 64)
CODEC = ("zstd", 6)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> tuple[int, bytes]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.getframerate(), w.readframes(w.getnframes())


@lru_cache
def _phases(up: int, down: int) -> np.ndarray:
    """The low-pass filter's taps by phase (up, taps): a Hann-windowed sinc at the lower of both Nyquist rates."""
    size = TAPS * max(up, down)
    n = np.arange(-size, size + 1)
    cut = 1 / max(up, down)
    h = (cut * np.sinc(cut * n) * (0.5 + 0.5 * np.cos(np.pi * n / (size + 1)))) * up
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int = TARGET) -> np.ndarray:
    """Polyphase: output n uses phase n * down mod up of the filter over the samples before n * down // up."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    bank = _phases(up, down)
    taps, delay = bank.shape[1], TAPS * max(up, down)
    n = np.arange(-(-x.size * up // down)) * down + delay
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps + delay // up + 1, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n.size, np.float32)
    for r in range(min(up, n.size)):
        at = n[r::up]
        out[r::up] = view[at[0] // up : at[-1] // up + 1 : down] @ bank[at[0] % up]
    return out


@lru_cache
def _mel(rate: int) -> np.ndarray:
    to, back = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = back(np.linspace(to(20.0), to(rate / 2), MELS + 2))
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up = (f - edges[:-2, None]) / (edges[1:-1, None] - edges[:-2, None])
    down = (edges[2:, None] - f) / (edges[2:, None] - edges[1:-1, None])
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WIN) / WIN)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS) in half precision; a file shorter than a window is one padded frame."""
    frames = max(1, 1 + -(-(x.size - WIN) // HOP))
    x = np.concatenate([x, np.zeros(max(0, (frames - 1) * HOP + WIN - x.size), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(x, WIN)[::HOP]
    out = np.empty((frames, MELS), np.float16)
    for a in range(0, frames, 1024):
        spec = np.fft.rfft(view[a : a + 1024] * _HANN, FFT)
        out[a : a + 1024] = np.rint(np.log10((spec.real**2 + spec.imag**2) @ _mel(rate) + np.float32(1e-6)) / STEP) * STEP
    return out


def segments(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hops (begin, end): a run begins RISE dB over the median energy and lasts until it is under FALL dB over it."""
    n = -(-x.size // HOP)
    e = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.size, HOP)) / HOP
    db = 10 * np.log10(e + 1e-9)
    db -= np.median(db)
    mark = np.where(db >= RISE, 1, np.where(db < FALL, 0, -1))
    known = np.flatnonzero(mark >= 0)
    at = np.searchsorted(known, np.arange(n), side="right") - 1
    on = np.where(at >= 0, mark[known[np.maximum(at, 0)]] if known.size else 0, 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


TENSOR = pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS))
TENSORS = pa.schema([("row", pa.int32()), ("log_mel", TENSOR), ("begin_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())])
SPAN = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: bytes) -> tuple[np.ndarray, list[dict]]:
    """Log-mel frames and segments of a stored file."""
    rate, back = decode(media)
    x = resample((np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128, rate)
    return log_mel(x, TARGET), [{"begin_s": a * HOP / TARGET, "end_s": b * HOP / TARGET} for a, b in segments(x)]


def tensors(mels: list[np.ndarray], rate: int = TARGET) -> pa.RecordBatch:
    """A row a tensor: the place of its file in the list, log-mel frames (TENSOR_FRAMES, MELS), the last of a file padded,
    begin and end seconds, frames in use."""
    counts = [-(-len(m) // TENSOR_FRAMES) for m in mels]
    full = np.zeros((sum(counts) * TENSOR_FRAMES, MELS), np.float16)
    at = 0
    for m, n in zip(mels, counts):
        full[at : at + len(m)] = m
        at += n * TENSOR_FRAMES
    row = np.repeat(np.arange(len(mels), dtype=np.int32), counts)
    first = (np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)) * TENSOR_FRAMES
    used = np.minimum(TENSOR_FRAMES, np.repeat([len(m) for m in mels], counts) - first)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR_FRAMES * MELS)
    cols = [pa.array(row), pa.ExtensionArray.from_storage(TENSOR, flat), pa.array(first * HOP / rate), pa.array(((first + used - 1) * HOP + WIN) / rate), pa.array(used.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, schema=TENSORS)


def _stream(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, segments array<struct<begin_s:double,end_s:double>>"


def featurize(docs: DataFrame) -> DataFrame:
    """Media, tensors and segments of each whole text's bytes; payload columns are of the samples read back."""
    prepare(docs.sparkSession)

    def run(batches):
        for c in text_chunks(batches):
            rows = []
            for text in c.column("text").to_pylist():
                n, payload = payload_of(text)
                media = encode(payload)
                back = decode(media)[1]
                mel, spans = features(media)
                rows.append((n, media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), _stream(tensors([mel])), spans))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), SPAN)
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), *(pa.array(v, t) for v, t in zip(zip(*rows), kinds))], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _written(fs, path: str, schema: pa.Schema, batches) -> int:
    """Writes the batches to an Arrow file that appears whole or not at all; how many they were."""
    mine, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(mine) as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(*CODEC))) as w:
        for batch in batches:
            w.write_batch(batch)
            n += 1
    if n:
        fs.move(mine, path)
    else:
        fs.delete_file(mine)
    return n


def _batches(fs, path: str):
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)


def _feature(stored: pa.RecordBatch, a: int, b: int, spans: list[dict]) -> str:
    """The tensors' bytes and times in rows a to b, and the segments, as hashes with the number of segments."""
    part = stored.slice(a, b - a)
    flat = part.column("log_mel").storage.flatten().to_numpy(zero_copy_only=False)
    h = hashlib.sha256(np.ascontiguousarray(flat).tobytes())
    for name in ("begin_s", "end_s", "frames"):
        h.update(part.column(name).to_numpy(zero_copy_only=False).tobytes())
    times = ",".join(f"{s['begin_s']:.2f}-{s['end_s']:.2f}" for s in spans)
    return f"{h.hexdigest()}:{len(spans)}:{hashlib.sha256(times.encode()).hexdigest()}"


def materialise(docs: DataFrame, folder: str) -> DataFrame:
    """Stores media, tensors and segments of each whole text in folder (a URI all nodes reach); returns what was read back, as
    counts and digests. Files: media-N.arrow (MEDIA), tensors-N.arrow (TENSORS) and segments-N.arrow, batch by batch alike."""
    prepare(docs.sparkSession)

    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        media, frames, parts = (f"{top}/{kind}-{TaskContext.get().partitionId():06d}.arrow" for kind in ("media", "tensors", "segments"))

        def encoded():
            for c in text_chunks(batches):
                pay = [payload_of(t) for t in c.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in pay], pa.int64()), pa.array([encode(p) for _, p in pay], pa.large_binary())], schema=MEDIA)

        if not _written(fs, media, MEDIA, encoded()):
            return
        found: list[list] = []

        def framed():
            for m in _batches(fs, media):
                mels, spans = zip(*(features(x) for x in m.column("media").to_pylist()))
                found.append(list(spans))
                yield tensors(list(mels))

        _written(fs, frames, TENSORS, framed())
        kind = pa.schema([("segments", SPAN)])
        _written(fs, parts, kind, (pa.RecordBatch.from_arrays([pa.array(s, SPAN)], schema=kind) for s in found))
        found.clear()
        for m, t, s in zip(_batches(fs, media), _batches(fs, frames), _batches(fs, parts)):
            edge = np.searchsorted(t.column("row").to_numpy(), np.arange(m.num_rows + 1)).tolist()
            rows = []
            for x, a, b, spans in zip(m.column("media").to_pylist(), edge, edge[1:], s.column("segments").to_pylist()):
                back = decode(x)[1]
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(x), hashlib.sha256(x).hexdigest(), _feature(t, a, b, spans)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([m.column("doc_id"), m.column("n_bytes"), *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))], [f.split()[0] for f in DIGEST.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


@scoped
def materialised(docs: DataFrame) -> DataFrame:
    """materialise() into a new folder of the shared storage; the result is stored, so files are written once, and stay."""
    return materialise(docs, shared_path(docs.sparkSession, "audio"))
